"""Bytes to text and back. Spark decodes the common charsets itself; others go through Arrow batches and Python's codecs."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Charsets that Spark's decode and encode take (fixed names).
NATIVE = frozenset("US-ASCII ISO-8859-1 UTF-8 UTF-16 UTF-16BE UTF-16LE UTF-32".split())
#: Byte order marks, longest first (fixed values).
MARKS = ((b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xfe\xff", "UTF-16BE"), (b"\xff\xfe", "UTF-16LE"))
#: Starts of documents without a mark (fixed values).
STARTS = ((b"\x00\x00\x00<", "UTF-32BE"), (b"<\x00\x00\x00", "UTF-32LE"), (b"\x00<\x00?", "UTF-16BE"), (b"<\x00?\x00", "UTF-16LE"))


def detect(data: bytes) -> str:
    """The encoding by mark, by the pattern of the first bytes, or by the declaration; else UTF-8."""
    for mark, name in (*MARKS, *STARTS):
        if data.startswith(mark):
            return name
    m = re.match(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z][\w.\-]*)[\"']", data[:400])
    return m[1].decode("ascii") if m else "UTF-8"


def decode_bytes(data: bytes, encoding: str | None = None) -> str:
    name = encoding or detect(data)
    for mark, marked in MARKS:
        if data.startswith(mark) and name.upper().startswith(marked[:6]):
            data = data[len(mark) :]
            break
    return data.decode(codecs.lookup(name).name)


def decode_detected(data: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else decode_bytes(b))

    return run(data)


def decode(data: Column, encoding: str) -> Column:
    if encoding.upper() in NATIVE:
        return F.decode(data, encoding.upper())
    name = codecs.lookup(encoding).name

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else b.decode(name))

    return run(data)


def encode(text: Column, encoding: str) -> Column:
    """Characters that the encoding lacks become numeric references."""
    if encoding.upper() in NATIVE and encoding.upper().startswith("UTF"):
        return F.encode(text, encoding.upper())
    name = codecs.lookup(encoding).name

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else s.encode(name, "xmlcharrefreplace"))

    return run(text)
