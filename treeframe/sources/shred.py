"""From documents to the node table: the one place where Python runs over rows, in Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.model import FAULTS, FIELDS, ddl
from treeframe.sources import html, xml

_ATTRS = pa.list_(pa.struct([("prefix", pa.string()), ("local", pa.string()), ("ns", pa.string()), ("value", pa.string())]))
_TYPES = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_KINDS = [_TYPES.get(v, _ATTRS) for v in FIELDS.values()]
_ROWS = 20_000


def _column(values: list, name: str, kind: pa.DataType) -> pa.Array:
    if name == "attrs":
        flat = [a for v in values if v for a in v]
        parts = [pa.array(c, pa.string()) for c in (zip(*flat, strict=True) if flat else [()] * 4)]
        ends = list(accumulate(len(v) if v else 0 for v in values))
        offsets = pa.array([None if v is None else e - len(v) for v, e in zip(values, ends, strict=True)] + [ends[-1] if ends else 0], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)
    elif name == "nsmap":
        values = [None if v is None else list(v.items()) for v in values]
    return pa.array(values, kind)


def _shredder(parse: Callable[[str], list[list]], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    places = [(c, list(FIELDS).index(c), _KINDS[list(FIELDS).index(c)]) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            ids = batch.column(0).take(pa.array(owner))
            return pa.RecordBatch.from_arrays([ids, *(_column([r[i] for r in rows], c, kind) for c, i, kind in places)], names=["doc_id", *columns])

        # rows hold no cycles, so reference counts free them; the collector would only scan them again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                rows: list[list] = []
                owner: list[int] = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    made = parse(text) if text is not None else []
                    rows += made
                    owner += [i] * len(made)
                    if len(rows) >= _ROWS:
                        yield out()
                        rows, owner = [], []
                if rows:
                    yield out()
        finally:
            if collects:
                gc.enable()

    return run


def _nodes(df: DataFrame, id_col: str, text: str, parse: Callable[[str], list[list]], columns: list[str] | None) -> DataFrame:
    columns = columns or list(FIELDS)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_shredder(parse, columns), ddl({c: FIELDS[c] for c in columns}, kind))


def read_xml(df: DataFrame, *, id_col: str = "doc_id", text: str = "xml", limits: xml.Limits = xml.Limits(), mode: str = "failfast", columns: list[str] | None = None) -> DataFrame:
    """The node table of the documents in a column. mode: failfast raises on the first fault, permissive mends, drop leaves faulty documents out."""

    def parse(s: str) -> list[list]:
        try:
            return xml.Reader(limits, recover=mode == "permissive").read(s)
        except xml.XMLFault:
            if mode == "failfast":
                raise
            return []

    return _nodes(df, id_col, text, parse, columns)


def read_html(df: DataFrame, *, id_col: str = "doc_id", text: str = "html", document: bool = True, repair: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The node table of the HTML in a column. repair: reopen formatting, move content out of tables and name foreign elements as the HTML Standard does."""
    return _nodes(df, id_col, text, lambda s: html.read(s, document, repair), columns)


def faults(df: DataFrame, *, id_col: str = "doc_id", text: str = "xml", limits: xml.Limits = xml.Limits()) -> DataFrame:
    """A row for each fault that a permissive reading notes: doc_id, code, message, line, col."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                reader = xml.Reader(limits, recover=True)
                try:
                    reader.read(s or "")
                except xml.XMLFault as e:
                    reader.faults.append((e.code, e.message, *e.at))
                rows += reader.faults
                owner += [i] * len(reader.faults)
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True))], names=["doc_id", *FAULTS])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl(FAULTS, kind))


def events(nodes: DataFrame) -> DataFrame:
    """Pull events of the node table: doc_id, seq, type, prefix, local, ns, attrs, value. Within a document seq orders them; it has gaps."""
    place = lambda a, b, c: (a.cast("long") * 2 + b) * (1 << 20) + c
    keep = ["prefix", "local", "ns", "attrs", "value"]
    begin = F.when(F.col("kind") == "element", "startElement").when(F.col("kind") == "document", "startDocument").otherwise(F.col("kind"))
    opens = F.struct(place(F.col("pre"), 0, F.lit(0)).alias("seq"), begin.alias("type"))
    # closing tags after the last node below, the inner first
    finish = F.when(F.col("kind") == "element", "endElement").otherwise("endDocument")
    closes = F.struct(place(F.col("last"), 1, F.lit((1 << 20) - 1) - F.col("level")).alias("seq"), finish.alias("type"))
    both = F.when(F.col("kind").isin("element", "document"), F.array(opens, closes)).otherwise(F.array(opens))
    return nodes.select("doc_id", F.explode(both).alias("e"), *keep).select("doc_id", "e.seq", "e.type", *keep)
