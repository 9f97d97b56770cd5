"""XInclude: include elements are replaced by what a resource table holds, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.functions.uri import resolve
from treeframe.sources.trees import Tree as T
from treeframe.sources.xml import Limits, Reader, XMLFault

XI = "http://www.w3.org/2001/XInclude"


class IncludeError(ValueError):
    pass


def include_text(text: str, base: str, load, depth: int = 16, seen: tuple[str, ...] = ()) -> str:
    """The document's text with inclusions replaced. load gives a resource's text, or None."""
    if depth < 0:
        raise IncludeError("inclusion is too deep")
    if "XInclude" not in text:
        return text
    rows = Reader(Limits()).read(text)
    kids: dict[int, list[list]] = {}
    for r in rows[1:]:
        kids.setdefault(r[T.PARENT], []).append(r)

    def escape(s: str, quote: bool = False) -> str:
        s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return s.replace('"', "&quot;") if quote else s

    def name(p: str, local: str) -> str:
        return f"{p}:{local}" if p else local

    def write(r: list, at: str) -> str:
        kind = r[T.KIND]
        if kind == "text":
            return escape(r[T.VALUE])
        if kind == "cdata":
            return f"<![CDATA[{r[T.VALUE]}]]>"
        if kind == "comment":
            return f"<!--{r[T.VALUE]}-->"
        if kind == "pi":
            return f"<?{r[T.LOCAL]} {r[T.VALUE]}?>"
        attrs = {(p, k): v for p, k, _, v in r[T.ATTRS]}
        here = resolve(at, attrs[("xml", "base")]) if ("xml", "base") in attrs else at
        if r[T.NS] == XI and r[T.LOCAL] == "include":
            return included(r, {k: v for (p, k), v in attrs.items() if not p}, here)
        decl = "".join(f' xmlns{":" + p if p else ""}="{escape(u, True)}"' for p, u in (r[T.NSOWN] or {}).items())
        shown = "".join(f' {name(p, k)}="{escape(v, True)}"' for (p, k), v in attrs.items())
        tag = name(r[T.PREFIX], r[T.LOCAL])
        return f"<{tag}{decl}{shown}>{inside(r, here)}</{tag}>"

    def inside(r: list, at: str) -> str:
        return "".join(write(k, at) for k in kids.get(r[T.PRE], []))

    def included(r: list, attrs: dict[str, str], at: str) -> str:
        fallback = [k for k in kids.get(r[T.PRE], []) if k[T.KIND] == "element" and k[T.NS] == XI and k[T.LOCAL] == "fallback"]
        uri = resolve(at, attrs.get("href", "")).partition("#")[0]
        if attrs.get("parse", "xml") not in ("xml", "text"):
            raise IncludeError(f"parse={attrs['parse']}")
        if uri in seen and attrs.get("parse", "xml") == "xml":
            raise IncludeError(f"{uri} includes itself")
        got = load(uri) if attrs.get("href") else None
        if got is None:
            if fallback:
                return inside(fallback[0], at)
            raise IncludeError(f"no resource {uri}")
        if attrs.get("parse") == "text":
            return escape(got)
        inner = include_text(got, uri, load, depth - 1, (*seen, uri))
        body = Reader(Limits()).read(inner)
        root = next(x for x in body if x[T.KIND] == "element")
        pointer = attrs.get("xpointer", "")
        if pointer:
            hit = next((x for x in body if x[T.KIND] == "element" and any(k == "id" and v == pointer for _, k, _, v in x[T.ATTRS])), None)
            if hit is None:
                if fallback:
                    return inside(fallback[0], at)
                raise IncludeError(f"nothing at {pointer}")
            root = hit
        own: dict[int, list[list]] = {}
        for x in body[1:]:
            own.setdefault(x[T.PARENT], []).append(x)
        kept, kids_of = dict(kids), own
        kids.clear()
        kids.update(kids_of)
        made = write(root, uri)
        kids.clear()
        kids.update(kept)
        return made

    return "".join(write(r, base) for r in kids.get(0, []))


def include(docs: DataFrame, resources: DataFrame, *, id_col: str = "doc_id", text: str = "xml", uri: str = "uri", depth: int = 16) -> DataFrame:
    """doc_id, xml, error. resources: uri, content.

    Which resources a document names is found level by level with joins, so only those reach its row; a row's task then
    splices them. Rows that fail have a null xml and the reason.
    """
    href = F.regexp_extract_all("content", F.lit(r"<(?:\w+:)?include\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), 1)
    from treeframe.functions.uri import resolve_column

    start = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("content"), F.col(uri).alias("base"))
    reach, level = None, start
    for _ in range(depth):
        wanted = level.select("doc_id", "base", F.explode(F.array_distinct(href)).alias("href"))
        wanted = wanted.select("doc_id", resolve_column(F.col("base"), F.col("href")).alias("_uri")).distinct()
        found = wanted.join(resources.select(F.col("uri").alias("_r"), "content"), F.col("_uri") == F.col("_r")).select("doc_id", F.col("_uri").alias("base"), "content")
        if reach is not None:
            found = found.join(reach.select("doc_id", "base"), ["doc_id", "base"], "left_anti")
        found = found.cache()
        if found.isEmpty():
            break
        reach = found if reach is None else reach.unionByName(found)
        level = found
    held = start.withColumn("_rs", F.lit(None).cast("map<string,string>"))
    if reach is not None:
        maps = reach.groupBy(F.col("doc_id").alias("_d")).agg(F.map_from_entries(F.collect_list(F.struct("base", "content"))).alias("_rs"))
        held = start.join(maps, F.col("doc_id") == F.col("_d"), "left")

    @F.udf("struct<xml:string,error:string>", useArrow=True)
    def splice(content, base, rs):
        try:
            return (include_text(content, base or "", (rs or {}).get, depth, (base or "",)), None)
        except (IncludeError, XMLFault) as e:
            return (None, str(e))

    out = splice("content", "base", F.col("_rs") if reach is not None else F.lit(None).cast("map<string,string>"))
    return held.select("doc_id", out.alias("o")).select("doc_id", "o.xml", "o.error")
