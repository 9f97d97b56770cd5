"""Streaming path patterns: filters on the stored path, with no join and no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"(//|/|^)(@?)((?:[\w.\-]+|\*)(?::(?:[\w.\-]+|\*))?)")


class PatternError(ValueError):
    pass


def compile_pattern(pattern: str) -> tuple[str, tuple[str | None, str] | None]:
    """A regular expression on paths, and the attribute's (prefix, name) if the pattern ends in one.

    Names match with any prefix unless they have one; a pattern that doesn't start with / may start anywhere.
    """
    p = pattern.strip()
    if not p or "[" in p:
        raise PatternError("predicates are not allowed" if "[" in p else "empty pattern")
    at, out, attribute = 0, "^" if p.startswith("/") else "^(?:/[^/]+)*", None
    while at < len(p):
        m = _STEP.match(p, at)
        if not m or attribute:
            raise PatternError(f"unexpected {p[at:]!r}")
        gap, is_attribute, name = m.groups()
        at = m.end()
        prefix, colon, local = name.rpartition(":")
        if is_attribute:
            attribute = (prefix or None, local)
            if gap == "//":
                out += "(?:/[^/]+)*"
            continue
        out += "(?:/[^/]+)*" if gap == "//" else ""
        word = "[^/:]+" if local == "*" else re.escape(local)
        out += "/" + (f"{re.escape(prefix)}:{word}" if colon else "[^/]+" if local == "*" else f"(?:[^/:]+:)?{word}")
    return out + "$", attribute


def matches(nodes: DataFrame, pattern: str) -> DataFrame:
    """doc_id, pre, path of each element (or, with /@name appended, attribute) that matches."""
    regex, attribute = compile_pattern(pattern)
    hit = nodes.where((F.col("kind") == "element") & F.col("path").rlike(regex))
    if not attribute:
        return hit.select("doc_id", "pre", "path")
    prefix, local = attribute
    own = F.filter("attrs", lambda a: (F.lit(True) if local == "*" else a["local"] == local) & (a["prefix"] == prefix if prefix else F.lit(True)))
    a = hit.select("doc_id", "pre", "path", F.explode(own).alias("a"))
    name = F.when(F.col("a.prefix") == "", F.col("a.local")).otherwise(F.concat_ws(":", "a.prefix", "a.local"))
    return a.select("doc_id", "pre", F.concat("path", F.lit("/@"), name).alias("path"))
