"""RFC 3986 references: parsing, resolution, dot segments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)


def remove_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "..":
            if out and (len(out) > 1 or out[0] != ""):
                out.pop()
            if last:
                out.append("")
        elif p == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    joined = "/".join(out)
    return "/" + joined.lstrip("/") if path.startswith("/") and not joined.startswith("/") else joined


def resolve(base: str | None, reference: str | None) -> str | None:
    if reference is None:
        return None
    b, r = _PARTS.match(base or ""), _PARTS.match(reference)
    if r[1]:
        scheme, authority, path, query = r[1], r[2], remove_dots(r[3]), r[4]
    elif r[2] is not None:
        scheme, authority, path, query = b[1], r[2], remove_dots(r[3]), r[4]
    else:
        scheme, authority = b[1], b[2]
        if not r[3]:
            path, query = b[3], r[4] if r[4] is not None else b[4]
        else:
            merged = r[3] if r[3].startswith("/") else "/" + r[3] if authority is not None and not b[3] else b[3][: b[3].rfind("/") + 1] + r[3]
            path, query = remove_dots(merged), r[4]
    return (f"{scheme}:" if scheme else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{r[5]}" if r[5] is not None else "")


def resolve_column(base: Column, reference: Column) -> Column:
    """In Arrow batches; Spark's own functions don't resolve relative references."""

    @F.pandas_udf("string")
    def run(b: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y) for x, y in zip(b, r, strict=True)])

    return run(base, reference)
