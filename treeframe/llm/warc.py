"""WARC derivatives: metadata and plain-text conversion records linked to responses.

A response record (headers and an HTTP message) gives two records: ``metadata`` with the facts of the payload as
application/warc-fields, and ``conversion`` with its visible text. Both carry WARC-Refers-To (the response's record id),
the response's target URI, date and payload digest, and a block digest of their own; the metadata repeats the source's
headers, its payload digest among them, and those of its HTTP message. Payloads are decoded by the Content-Encoding (gzip,
deflate) and the charset that the headers name. Header names match in any case; of repeated ones the last counts. Record
ids are UUIDs (version 5) of the source id (or, without one, of the source's digest) and the kind, so a task that runs
again writes the same ids. Records are built row by row where the rows are: no shuffle.

Nulls: a null html or url is empty; an empty payload gives an empty conversion. A response without a record id gets the
refers-to of the empty id. Repeated rows give repeated records. Malformed responses (no blank line) have all as payload;
a Content-Length that is no number, or is over the block, is that of the block; an encoding that fails leaves the bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm.common import table

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs (fixed value)
CRAWLED = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|title|body|head|form|blockquote|pre|dl|dt|dd|hr|main|figure)\b[^>]*>", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s;\"']+)", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def pairs(lines: list[str]) -> list[tuple[str, str]]:
    """Header lines as names and values, in order, repeated ones too; a line led by white space continues the one before."""
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {x.strip()}".strip()
        elif x:
            k, _, v = x.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def value(headers: list[tuple[str, str]], name: str, default: str = "") -> str:
    """The last header of that name, in any case."""
    return next((v for k, v in reversed(headers) if k.lower() == name.lower()), default)


def fields(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers, in order (the version line first, under ""), and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [("", version), *pairs(lines)]
    size = value(headers, "Content-Length")
    return headers, rest[: int(size)] if size.isascii() and size.isdigit() else rest


def decoded(payload: bytes, encoding: str) -> bytes:
    """The payload after its Content-Encoding; unknown or broken ones leave it."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(47).decompress(payload)
            elif name == "deflate":
                try:
                    payload = zlib.decompressobj(15).decompress(payload)
                except zlib.error:
                    payload = zlib.decompressobj(-15).decompress(payload)
        except zlib.error:
            break
    return payload


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """As fields, with the last of repeated headers."""
    headers, block = fields(data)
    return dict(headers), block


def charset(http: list[tuple[str, str]]) -> str:
    """The charset that the Content-Type header names; UTF-8 if there is none, or none that is known."""
    for k, v in http:
        if k.lower() == "content-type" and (m := _CHARSET.search(v)):
            try:
                b" ".decode(m[1], "replace")  # codecs that give no text are errors
                # the web's reading of these names
                return "cp1252" if codecs.lookup(m[1]).name in ("iso8859-1", "ascii") else m[1]
            except (LookupError, ValueError):
                return "utf-8"
    return "utf-8"


def visible(page: str) -> str:
    """Plain text: hidden parts and tags away, blocks on lines, references decoded, white space in a line made one space."""
    stop = page.rfind(">") + 1  # beyond it no tag ends, and a "<" is text
    t = _HIDDEN.sub(" ", page[:stop] + ("" if "<!--" not in page[stop:] else "<!--"))
    t = _TAG.sub("", _BREAK.sub("\n", t)) + page[stop:].partition("<!--")[0]
    lines = (" ".join(x.split()) for x in html_lib.unescape(t).split("\n"))
    return "\n".join(x for x in lines if x)


def response(url: str | None, html: str | None, date: str = CRAWLED) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = re.sub(r"[\r\n]+", " ", url or "")
    own = {"WARC-Record-ID": record_id(f"response {clean} {digest(payload)}"), "WARC-Date": date, "WARC-Target-URI": clean, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(head + payload), "WARC-Payload-Digest": digest(payload)}
    return record("response", own, head + payload)


def derive(source: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response record, as rows."""
    listed, block = fields(source or b"")
    own = lambda name: value(listed, name)
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        head, payload = b"", block
    sid, uri, date = own("WARC-Record-ID"), own("WARC-Target-URI"), own("WARC-Date")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    http = pairs(lines)
    page = decoded(payload, value(http, "Content-Encoding")).decode(charset(http), "replace")
    text = visible(page)
    counts = {"payload-bytes": len(payload), "text-chars": len(text), "links": len(re.findall(r"<a\s[^<>]*href", page, re.I)), "http-status": (status.split(" ") + ["", ""])[1]}
    facts = [*counts.items(), *((f"source-{k.lower()}", v) for k, v in listed if k and k.lower() != "content-length"), *((f"http-header-{k.lower()}", v) for k, v in http if k)]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")), "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))}
    ids = {k: record_id(f"{k} of {sid or digest(source or b'')}") for k in blocks}
    rows = []
    for kind, (type_, data) in blocks.items():
        made = {"WARC-Record-ID": ids[kind], "WARC-Refers-To": sid, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date, "WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": type_, "WARC-Block-Digest": digest(data), "WARC-Concurrent-To": ids["conversion" if kind == "metadata" else "metadata"]}
        rows.append({"record_type": kind, "record_id": ids[kind], "refers_to": sid, "target_uri": uri, "warc_date": date, "content_type": type_, "content_length": len(data), "block_digest": made["WARC-Block-Digest"], "source_digest": own("WARC-Payload-Digest") or digest(payload), "record": record(kind, made, data)})
    return rows


_FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_digest", pa.string()), ("record", pa.binary())]
_DDL = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, block_digest string, source_digest string, record binary"


def derivatives(df: DataFrame, *, id_col: str, source: str = "record") -> DataFrame:
    """Two rows for each response record in the binary column source, with the row's id."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [r for x in part.column(1).to_pylist() for r in derive(x)]
                ids = part.column(0).take(pa.array([i // 2 for i in range(len(rows))]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in _FIELDS)], names=[id_col, *(k for k, _ in _FIELDS)])

    return df.select(F.col(id_col), F.col(source).alias("_tf_record")).mapInArrow(run, f"`{id_col}` {kind}, {_DDL}")


def responses(df: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record for each page: id, record."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [response(u, h) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=[id_col, "record"])

    return df.select(F.col(id_col), F.col(url), F.col(html)).mapInArrow(run, f"`{id_col}` {kind}, record binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")), id_col="page_id")
