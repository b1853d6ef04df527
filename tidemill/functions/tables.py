"""Chunks as a table function, for SQL: SELECT id, c.* FROM postings, LATERAL chunks('section', head, body) c."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemill.functions import text
from tidemill.functions.chunks import CHUNK, STRATEGIES, TAIL

#: The patterns of the columns' noise as Python spells them, and white space as Unicode has it.
_NOISE = [re.compile(p.replace("(?U)", "").replace(r"\z", r"\Z")) for p in (text.URL, *text.BOILERPLATE)]
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


def plain(body: str | None) -> str:
    """A text without addresses and boilerplate, each run of white space being one blank."""
    out = body or ""
    for p in _NOISE:
        out = p.sub(" ", out)
    return _SPACE.sub(" ", out).strip(" ")


def packed(paragraphs: Iterator[str], size: int = CHUNK, tail: int = TAIL) -> list[str]:
    """Paragraphs packed up to size characters; longer ones are cut, and a short last chunk joins the one before."""
    out: list[str] = [""]
    for p in paragraphs:
        if len(out[-1]) + len(p) + 1 <= size:
            out[-1] = f"{out[-1]} {p}" if out[-1] else p
        else:
            out[len(out) - (not out[-1]) :] = [p[i : i + size] for i in range(0, len(p), size)]
    if len(out) > 1 and len(out[-1]) < tail:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return out


class Chunks:
    """(chunk_index, content) of a text, by a strategy; an unknown one raises."""

    def eval(self, strategy: str, head: str, body: str) -> Iterator[tuple[int, str]]:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown chunk strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
        if strategy == "whole":
            yield 0, f"{head}. {plain(body)}"[:1800]
            return
        own = [p for p in map(plain, re.split(r"\n+", body or "")) if p]
        for i, chunk in enumerate(packed(iter(own)) if own else [""]):
            yield i, f"{head}. {chunk}" if own else head


def register(spark: SparkSession, name: str = "chunks") -> None:
    """Makes the function known to SQL; rows reach it and leave it in Arrow batches."""
    spark.udtf.register(name, udtf(Chunks, returnType="chunk_index int, content string"))
