"""OASIS and SGML catalogs as a table of rules, and resolution of identifiers as a join with it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.functions.uri import resolve
from treeframe.sources.trees import XML_NS, Tree as T
from treeframe.sources.xml import Limits, Reader

#: Entry, its matching attribute and its target attribute (fixed names).
_ENTRIES = {"system": ("systemId", "uri"), "public": ("publicId", "uri"), "uri": ("name", "uri"), "rewriteSystem": ("systemIdStartString", "rewritePrefix"), "rewriteURI": ("uriStartString", "rewritePrefix"), "systemSuffix": ("systemIdSuffix", "uri"), "uriSuffix": ("uriSuffix", "uri"), "delegatePublic": ("publicIdStartString", "catalog"), "delegateSystem": ("systemIdStartString", "catalog"), "delegateURI": ("uriStartString", "catalog"), "nextCatalog": ("", "catalog")}


MOST_PATTERNS = 10_000


def parse_oasis(text: str, base: str = "") -> list[tuple[str, str, str, bool]]:
    """(kind, key, target, prefer public) of each entry, targets resolved against xml:base."""
    rows = Reader(Limits(allow_doctype=True)).read(text)
    bases, prefer, out = {0: base}, {0: True}, []
    for r in rows[1:]:
        if r[T.KIND] != "element":
            continue
        attrs = {(f"{p}:{k}" if ns == XML_NS else k): v for p, k, ns, v in r[T.ATTRS]}
        up = bases[r[T.PARENT]]
        bases[r[T.PRE]] = resolve(up, attrs["xml:base"]) if "xml:base" in attrs else up
        prefer[r[T.PRE]] = attrs["prefer"] == "public" if "prefer" in attrs else prefer[r[T.PARENT]]
        if r[T.LOCAL] in _ENTRIES:
            key, target = _ENTRIES[r[T.LOCAL]]
            if target in attrs and (not key or key in attrs):
                value = normal_public(attrs[key]) if "ublic" in r[T.LOCAL] else attrs.get(key, "")
                out.append((r[T.LOCAL], value, resolve(bases[r[T.PRE]], attrs[target]), prefer[r[T.PRE]]))
    return out


def parse_sgml(text: str, base: str = "") -> list[tuple[str, str, str, bool]]:
    text = re.sub(r"--.*?--", " ", text, flags=re.S)
    words = [a or b or c for a, b, c in re.findall(r"\"([^\"]*)\"|'([^']*)'|(\S+)", text)]
    out, i, prefer = [], 0, False
    kinds = {"PUBLIC": "public", "SYSTEM": "system", "DELEGATE": "delegatePublic"}
    while i < len(words):
        w = words[i].upper()
        if w == "BASE":
            base, i = resolve(base, words[i + 1]), i + 2
        elif w == "OVERRIDE":
            prefer, i = words[i + 1].upper() == "YES", i + 2
        elif w == "CATALOG":
            out.append(("nextCatalog", "", resolve(base, words[i + 1]), prefer))
            i += 2
        elif w in kinds and i + 2 < len(words):
            key = normal_public(words[i + 1]) if w != "SYSTEM" else words[i + 1]
            out.append((kinds[w], key, resolve(base, words[i + 2]), prefer))
            i += 3
        else:
            i += 1
    return out


def normal_public(s: str) -> str:
    return " ".join(s.split())


def closure(uri: str, load: Callable[[str], str | None]) -> list[tuple[str, str, str, bool]]:
    """The entries of a catalog and of all that it names, first ones first; each catalog once."""
    seen, out, todo = set(), [], [uri]
    while todo:
        at = todo.pop(0)
        if at in seen or (text := load(at)) is None:
            continue
        seen.add(at)
        got = parse_oasis(text, at) if text.lstrip().startswith("<") else parse_sgml(text, at)
        out += got
        todo += [t for k, _, t, _ in got if k == "nextCatalog" or k.startswith("delegate")]
    return out


def rules(spark: SparkSession, entries: list[tuple[str, str, str, bool]]) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "rank int, rule string, key string, target string, prefer boolean")


def resolve_identifiers(ids: DataFrame, table: DataFrame) -> DataFrame:
    """ids: id, public, system, uri (any may be null, rows may repeat). Adds target, the uri that the catalog gives, or null.

    Exact rules come first, then the longest rewritten start, then the longest end; public identifiers count if there is
    no system identifier or the entry prefers them. Exact rules are joined by their key. Rules on starts and ends, of which
    a catalog has ``MOST_PATTERNS`` at most, are a literal that each row is held against.
    """
    s, u, p = F.col("system"), F.col("uri"), F.regexp_replace(F.btrim("public", F.lit(" \t\n\r")), r"\s+", " ")
    patterns = table.where(F.col("rule").isin("rewriteSystem", "rewriteURI", "systemSuffix", "uriSuffix")).limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} rules on starts and ends")
    out = ids

    def exact(name: str, value: Column, where: Column, as_: str) -> None:
        nonlocal out
        rule = table.where((F.col("rule") == name) & where).groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("rank", "target")).alias(as_))
        out = out.join(rule, value == F.col("_key"), "left").drop("_key")

    def longest(name: str, value: Column) -> Column:
        """The rule on the longest start or end: a struct of its length, its rank (negative) and what it gives."""
        own = sorted((r for r in patterns if r.rule == name), key=lambda r: (-len(r.key), r.rank))
        every = F.from_json(F.lit(json.dumps([{"key": r.key, "target": r.target, "rank": r.rank} for r in own])), "array<struct<key:string,target:string,rank:int>>")
        hit = F.get(F.filter(every, lambda r: (F.endswith if name.endswith("Suffix") else F.startswith)(value, r["key"])), F.lit(0))
        gives = hit["target"] if name.endswith("Suffix") else F.concat(hit["target"], F.substring(value, F.length(hit["key"]) + 1, F.lit(1 << 20)))
        return F.when(hit.isNotNull(), F.struct(F.length(hit["key"]).alias("n"), (-hit["rank"]).alias("r"), gives.alias("target")))

    exact("system", s, F.lit(True), "_system")
    exact("uri", u, F.lit(True), "_uri")
    exact("public", p, F.lit(True), "_public")
    exact("public", p, F.col("prefer"), "_preferred")
    first = F.least("_system", "_uri")
    public = F.when(s.isNull(), F.col("_public")).otherwise(F.col("_preferred"))
    best = lambda a, b: F.greatest(longest(a, s), longest(b, u))["target"]
    return out.select(*ids.columns, F.coalesce(first["target"], best("rewriteSystem", "rewriteURI"), best("systemSuffix", "uriSuffix"), public["target"]).alias("target"))
