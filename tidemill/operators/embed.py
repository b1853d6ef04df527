"""Vectors of texts, their cost, and the index that is built of them piece by piece."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import storage
from tidemill.functions import chunks, text
from tidemill.operators import history

#: US dollars for a million tokens of a model, read and written.
PRICES: dict[str, tuple[float, float]] = {"hashing": (0.0, 0.0), "text-embedding-3-small": (0.02, 0.0)}
CHARS_A_TOKEN = 4


def tokens(c: Column) -> Column:
    """An estimate of the tokens of a text."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / CHARS_A_TOKEN)


def dollars(read: Column, written: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost of tokens read and written by a model; 0 for a model without a price."""
    table = lambda n: F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(float(p[n])))])
    price = lambda n: F.coalesce(F.try_element_at(table(n), model), F.lit(0.0))
    return (F.coalesce(read, F.lit(0)) * price(0) + F.coalesce(written, F.lit(0)) * price(1)) / 1_000_000


def usage(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """Texts, tokens, dollars and seconds of calls(tokens, usd, latency_ms), added up."""
    return calls.groupBy(*by).agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd"), (F.sum("latency_ms") / 1000).alias("seconds"))


@dataclass(frozen=True)
class Embedder:
    """A model by its name, the length of its vectors, and how a column of texts becomes vectors."""

    name: str
    size: int
    encode: Callable[[Column], Column]


#: Characters of a text that are read at once, and words whose buckets a batch remembers.
STRETCH, REMEMBERED = 1 << 16, 1 << 16


class _Chars(dict):
    """What str.translate makes of each character: small letters and digits stay, others are blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c.lower() if c.isalnum() else " "
        return out


class _Buckets(dict):
    """The bucket of each word."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = int(md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16) % self.size
        return out


def _counts(body: str | None, chars: _Chars, seen: _Buckets, size: int) -> np.ndarray:
    out, rest = np.zeros(size), ""
    body = body or ""
    for low in range(0, len(body), STRETCH):
        part = rest + body[low : low + STRETCH].translate(chars)
        words = part.split()
        # A word may go on in the next stretch.
        rest = words.pop() if words and not part[-1].isspace() and low + STRETCH < len(body) else ""
        out += np.bincount([seen[w] for w in words], minlength=size)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def hashing(size: int = 64) -> Embedder:
    """Words counted in buckets by the first hex digits of their md5, scaled to length 1: needs no model."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: pd.Series) -> pd.Series:
        chars, seen = _Chars(), _Buckets(size)
        return texts.map(lambda t: _counts(t, chars, seen, size))

    def bounded(c: Column) -> Column:
        storage.bounded(SparkSession.active())
        return encode(c)

    return Embedder(f"hashing-{size}", size, bounded)


def new_chunks(postings: DataFrame, index: DataFrame, strategy: str, embedder: Embedder, key: str = "posting_id") -> DataFrame:
    """Chunks with vectors of postings(key, title, company, location, description) that the index lacks.

    index has (key, strategy, model, chunk_index, content, embedding); so has the result.
    """
    have = index.where((F.col("strategy") == strategy) & (F.col("model") == embedder.name))
    rest = history.missing(postings, have, [key])
    head = text.header(F.col("title"), F.col("company"), F.col("location"))
    cut = rest.select(key, F.posexplode(chunks.chunks(strategy, head, F.col("description"))).alias("chunk_index", "content"))
    return cut.select(key, F.lit(strategy).alias("strategy"), F.lit(embedder.name).alias("model"), "chunk_index", "content", embedder.encode(F.col("content")).alias("embedding"))


def merged(index: DataFrame, new: DataFrame, key: str = "posting_id", rebuild: bool = False) -> DataFrame:
    """The index with new chunks in place of those of the same posting, strategy, model and number.

    With rebuild, all the index has of the new chunks' strategies and models goes first.
    """
    same = ["strategy", "model"] if rebuild else [key, "strategy", "model", "chunk_index"]
    gone = new.select(*same).distinct()
    return index.join(gone, same, "left_anti").unionByName(new)


def first_vectors(postings: DataFrame, index: DataFrame, strategy: str, model: str, key: str = "posting_id") -> DataFrame:
    """postings with the vector of their first chunk; those without one are left out, not filled."""
    first = index.where((F.col("strategy") == strategy) & (F.col("model") == model) & (F.col("chunk_index") == 0))
    return postings.join(first.select(key, "embedding"), key)
