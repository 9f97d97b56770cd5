"""The common operations in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.operators import emit, patterns, validation, xpointer
from treeframe.plans import relaxng, xslt
from treeframe.sources import shred
from treeframe.sources.xml import Limits, declaration
from treeframe.xpath import compile_xpath, evaluate, select

parse = shred.read_xml
parse_html = shred.read_html
events = shred.events
faults = shred.faults
serialize = emit.serialize
serialize_html = emit.serialize_html
canonicalize = emit.canonical
match_pattern = patterns.matches
point = xpointer.resolve
transform = xslt.transform
validate = validation.validate
validate_relaxng = relaxng.validate


def lint(df: DataFrame, *, id_col: str = "doc_id", text: str = "xml", limits: Limits = Limits(), rules: list[str] | None = None) -> DataFrame:
    """Faults of reading and findings of rules together: doc_id, rule, severity, reason, line, col."""
    read = shred.faults(df, id_col=id_col, text=text, limits=limits).select("doc_id", F.col("code").alias("rule"), F.lit("error").alias("severity"), F.col("message").alias("reason"), "line", "col")
    nodes = shred.read_xml(df, id_col=id_col, text=text, limits=limits, mode="permissive")
    found = validation.validate(nodes, rules or ["unique-attributes"])
    return read.unionByName(found.select(*read.columns))


def text_declaration(df: DataFrame, *, id_col: str = "doc_id", text: str = "xml") -> DataFrame:
    """doc_id, version, encoding, standalone of each document's XML declaration; nulls where there is none."""
    head = F.substring(F.col(text), 1, 400)
    whole = r"^\x{FEFF}?(<\?xml\s+version\s*=[^>]*\?>)"
    got = F.regexp_extract(head, whole, 1)
    one = lambda name: F.nullif(F.regexp_extract(got, rf"{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), one("version").alias("version"), one("encoding").alias("encoding"), one("standalone").alias("standalone"))


__all__ = ["Limits", "canonicalize", "compile_xpath", "declaration", "evaluate", "events", "faults", "lint", "match_pattern", "parse", "parse_html", "point", "select", "serialize", "serialize_html", "text_declaration", "transform", "validate", "validate_relaxng"]
