"""The grid of reranking experiments: what is read, how many, by which model, and how it is blended."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import answers, search


@dataclass(frozen=True)
class Setting:
    """One configuration; without a model the first stage stays as it is."""

    name: str
    model: str | None = "base"
    document: str = "snippet"
    candidates: int = 30
    alpha: float | None = None
    max_length: int = 512


#: The configurations that are compared; "small" is the cheaper model.
GRID = (
    Setting("first stage", None), Setting("shipped"), Setting("document head", document="head"), Setting("document section", document="section"),
    Setting("pool 20", candidates=20), Setting("pool 50", candidates=50), Setting("alpha 0.3", alpha=0.3), Setting("alpha 0.5", alpha=0.5), Setting("alpha 0.7", alpha=0.7),
    Setting("small", "small"), Setting("length 256", max_length=256), Setting("small, length 256", "small", max_length=256),
    Setting("small, section", "small", "section"), Setting("small, section, length 256", "small", "section", max_length=256),
)

Scorer = Callable[[Column, Column], Column]


def cut(document: Column, words: int) -> Column:
    """The first words of a document, divided by single spaces."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(document, F.lit("")), r"\s+"), lambda w: w != ""), 1, words), " ")


def run(first: DataFrame, queries: DataFrame, documents: DataFrame, key: str, models: dict[str, Scorer], limit: int, settings: Sequence[Setting] = GRID) -> DataFrame:
    """(config, query_id, key, score, rank) of every setting.

    first(query_id, key, score, rank) must be as deep as the largest pool; documents(key, and a column for
    each kind of document); models gives the scorers by name.
    """
    out = None
    for s in settings:
        pool = first.where(F.col("rank") <= (s.candidates if s.model else limit))
        if s.model:
            docs = documents.select(key, cut(F.col(s.document), s.max_length).alias("document"))
            pool = answers.rerank(pool, queries, docs, key, limit, models[s.model], s.alpha)
        own = pool.select(F.lit(s.name).alias("config"), "query_id", key, "score", "rank")
        out = own if out is None else out.unionByName(own)
    return out
