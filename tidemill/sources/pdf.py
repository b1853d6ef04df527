"""Text of PDF files, for profiles that come as such.

Reads content streams that are plain or deflated, and the text their operators show in fonts of
one byte a character. Scans and fonts with an encoding of their own give no text, which is an error
here as an empty file is.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text that are kept.
CHARS = 12_000

_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d+(?:\.\d+)?|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
_NEW_LINE = {b"Td", b"TD", b"T*", b"'", b'"', b"ET", b"Tm"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    plain = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _NAMED.get(m[1], m[1]), token[1:-1])
    return plain.decode("cp1252", "replace")


def _shown(stream: bytes) -> str:
    """What a content stream's text operators show; a wide gap in an array is a space."""
    out, pending, inside = [], [], False
    for m in _SHOWN.finditer(stream):
        token = m[0]
        if token[:1] in (b"(", b"<"):
            pending.append(_string(token))
        elif token in (b"[", b"]"):
            inside = token == b"["
        elif token[:1] in b"-0123456789":
            if inside and float(token) < -200:
                pending.append(" ")
        else:
            if token in _NEW_LINE:
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out += pending
            pending = []
    return "".join(out)


def pdf_text(data: bytes | None, chars: int = CHARS) -> tuple[str | None, str | None]:
    """(text, error): exactly one of them is null."""
    if not data:
        return None, "empty file"
    if not data.lstrip()[:5] == b"%PDF-" or b"endobj" not in data:
        return None, "no PDF, or a damaged one"
    if re.search(rb"/Encrypt\b", data):
        return None, "encrypted"
    parts = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                return None, "no PDF, or a damaged one"
        elif b"/Filter" in head:
            continue
        if b"BT" in body:
            parts.append(_shown(body))
    text = "\n".join(filter(None, (re.sub(r"[ \t]+", " ", line).strip() for line in "\n".join(parts).split("\n"))))
    return (text[:chars], None) if text else (None, "no text")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def read(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pdf_text(d) for d in data], columns=["text", "error"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the PDF files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("r")).select("path", "r.text", "r.error")
