"""XPointer: parts are tried in order, and a document's result is that of its first part that finds anything."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeframe.xpath.plan import select

_NAME = r"[^\W\d][\w.\-]*"


class PointerError(ValueError):
    pass


def parts(pointer: str) -> list[tuple[str, str]]:
    """(scheme, data) of each part; a bare name is ("id", name)."""
    p = pointer.strip()
    if re.fullmatch(_NAME, p):
        return [("id", p)]
    out, at = [], 0
    while at < len(p):
        m = re.compile(rf"\s*((?:{_NAME}:)?{_NAME})\(").match(p, at)
        if not m:
            raise PointerError(f"no scheme at {p[at:]!r}")
        depth, i, data = 1, m.end(), ""
        while i < len(p):
            if p[i] == "^" and i + 1 < len(p):
                data, i = data + p[i + 1], i + 2
                continue
            depth += {"(": 1, ")": -1}.get(p[i], 0)
            if not depth:
                break
            data, i = data + p[i], i + 1
        if depth:
            raise PointerError("unbalanced parentheses")
        out.append((m[1], data))
        at = i + 1
    return out


def _element_path(data: str) -> str:
    head, *steps = data.split("/")
    if head and not re.fullmatch(_NAME, head) or not all(s.isdigit() for s in steps):
        raise PointerError(f"element({data})")
    return (f'id("{head}")' if head else "") + "".join(f"/*[{s}]" for s in steps)


def resolve(nodes: DataFrame, pointer: str) -> DataFrame:
    """doc_id, part (from 1), pre, band, sub, kind, name, value."""
    bound: dict[str, str] = {}
    found = []
    for i, (scheme, data) in enumerate(parts(pointer), 1):
        if scheme == "xmlns":
            k, _, v = data.partition("=")
            bound[k.strip()] = v.strip()
            continue
        if scheme == "id":
            expression = f'id("{data}")'
        elif scheme == "element":
            expression = _element_path(data)
        elif scheme in ("xpointer", "xpath1"):
            if m := re.fullmatch(r"string-range\((.*),\s*(\"[^\"]*\"|'[^']*')\s*\)", data):
                found.append(string_range(nodes, m[1], m[2][1:-1], bound or None).select("doc_id", F.lit(i).alias("part"), "pre", "band", "sub", F.lit("range").alias("kind"), F.col("offset").cast("string").alias("name"), "value"))
                continue
            m = re.fullmatch(r"range\((.*)\)", data)
            if re.search(r"/range-to\(", data):
                found.append(range_to(nodes, data, bound or None).withColumn("part", F.lit(i)).select("doc_id", "part", "pre", "band", "sub", "kind", "name", "value"))
                continue
            expression = m[1] if m else data
        else:
            continue  # unknown schemes find nothing
        found.append(select(nodes, expression, namespaces=bound or None).withColumn("part", F.lit(i)).select("doc_id", "part", "pre", "band", "sub", "kind", "name", "value"))
    if not found:
        raise PointerError("no part can be evaluated")
    every = reduce(DataFrame.unionByName, found)
    first = F.min("part").over(Window.partitionBy("doc_id"))
    return every.withColumn("_first", first).where("part = _first").drop("_first")


def string_range(nodes: DataFrame, path: str, needle: str, namespaces: dict[str, str] | None = None) -> DataFrame:
    """Non-overlapping places of needle in the string-values of a path: doc_id, pre, band, sub, offset (from 1), value."""
    at = select(nodes, path, namespaces=namespaces)
    gaps = F.split("value", "(?:" + re.escape(needle) + ")")
    places = at.select("doc_id", "pre", "band", "sub", F.posexplode(F.slice(gaps, 1, F.size(gaps) - 1)).alias("i", "_x"), gaps.alias("_g"))
    before = F.aggregate(F.slice("_g", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, s: a + F.length(s))
    return places.select("doc_id", "pre", "band", "sub", (before + F.col("i") * len(needle) + 1).alias("offset"), F.lit(needle).alias("value"))


def range_to(nodes: DataFrame, data: str, namespaces: dict[str, str] | None = None) -> DataFrame:
    """a/range-to(b): the siblings from each a to the first b after it."""
    a, _, b = data.partition("/range-to(")
    start = select(nodes, a, namespaces=namespaces, full=True).select("doc_id", F.col("pre").alias("_a"), "parent")
    end = select(nodes, b.rstrip()[:-1], namespaces=namespaces, full=True).select("doc_id", F.col("pre").alias("_b"), "parent")
    pair = start.join(end, ["doc_id", "parent"]).where("_b >= _a").groupBy("doc_id", "parent", "_a").agg(F.min("_b").alias("_b"))
    run = nodes.select("doc_id", "pre", "parent", "kind", "local", "sval").join(pair, ["doc_id", "parent"]).where("pre BETWEEN _a AND _b")
    return run.select("doc_id", "pre", F.lit(0).alias("band"), F.lit(0).alias("sub"), "kind", F.col("local").alias("name"), F.col("sval").alias("value")).distinct()
