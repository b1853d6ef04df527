"""Language ID by multilingual mixture inference.

Every learnable document adds its byte-trigram counts to its language. A document is then seen
as a mixture: expectation-maximisation estimates the share of each language from the trigram
likelihoods, and languages leave the mixture as long as the penalised likelihood gains by it.
The set that is left and its shares are the result; the predicted language is the one with the
largest share, and the score is that share.

Counts cover all learnable documents: partitions add up locally and only (language, bin, count)
rows are shuffled. The model has languages x BINS numbers whatever the number of documents, 64 KB
for each language; the number of languages has no bound of its own.

Defined cases: null text, empty text and text without a letter (str.isalpha) are `und` with score
0 and no languages, as is every text when nothing can be learned; texts of any length are read
whole; ties go to the language first in order; rows with a null language or a null id teach
nothing; repeated rows count each; rows are kept or dropped by their own text whatever their id, a
null id included; an empty table gives an empty table; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import attach, fresh, held_out, learnable, map_rows, release, settle, table

BINS = 1 << 14
ROUNDS = 12
#: What each further language must gain, in units of log(number of trigrams).
PENALTY = 6.0
SMOOTH = 0.05
#: Share of the predicted language below which the pipeline rejects a document.
MIN_SHARE = 0.5
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams, one per position; ASCII is folded to small letters and spaces."""
    raw = b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint16)
    h = a[:-2] * np.uint16(40503)
    h += a[1:-1] * np.uint16(19891)
    h += a[2:] * np.uint16(8179)
    h >>= np.uint16(16 - (BINS.bit_length() - 1))
    return h


def counts(text: str) -> np.ndarray:
    return np.bincount(trigrams(text), minlength=BINS)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, docs: np.ndarray):
        """table: counts, one row per language; docs: documents per language."""
        self.langs = langs
        p = (table + SMOOTH).astype(np.float32)
        self.p = np.ascontiguousarray((p / p.sum(1, keepdims=True)).T)  # bins x languages
        self.prior = np.log((docs + 1) / (docs + 1).sum())

    def mixture(self, p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Shares that EM reaches, and their log-likelihood."""
        n, pi = c.sum(), np.full(p.shape[1], 1 / p.shape[1])
        pt = np.ascontiguousarray(p.T)
        for _ in range(rounds):
            last = pi
            pi = pi * (pt @ (c / (p @ pi))) / n
            if np.abs(pi - last).max() < 1e-4:
                break
        return pi, float(c @ np.log(p @ pi))

    def languages(self, text: str | None) -> list[tuple[str, float]]:
        """The languages that the penalised likelihood selects, with their shares, largest first."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return []
        full = counts(text)
        at = np.flatnonzero(full)
        c = full[at].astype(np.float64)
        p = self.p[at].astype(np.float64)
        # Of single languages the prior decides between near ties; it is no part of the likelihood.
        alone = c @ np.log(p)
        one = int(np.argmax(alone + self.prior))
        cost = PENALTY * np.log(c.sum() + 1)
        best, shares, value = [one], np.ones(1), float(alone[one])
        alive = np.arange(len(self.langs))
        while len(alive) > 1:
            pi, ll = self.mixture(p[:, alive], c)
            if ll - cost * (len(alive) - 1) > value:
                best, shares, value = alive.tolist(), pi, ll - cost * (len(alive) - 1)
            elif ll - cost <= value:  # not even with one further language's cost
                break
            # Languages of under one trigram go together, else the weakest goes.
            weak = pi * c.sum() < 1
            alive = alive[~weak] if weak.any() and not weak.all() else np.delete(alive, int(np.argmin(pi)))
        order = sorted(range(len(best)), key=lambda k: (-shares[k], best[k]))
        return [(self.langs[best[k]], float(min(1.0, shares[k]))) for k in order]

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """Language, score, all languages of the mixture and their shares."""
        found = self.languages(text)
        return (*found[0], [x for x, _ in found], [s for _, s in found]) if found else ("und", 0.0, [], [])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of all learnable documents with a language."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for lang, text in rows:
            if lang not in sums:
                sums[lang], number[lang] = np.zeros(BINS, np.int64), 0
            number[lang] += 1
            if text:
                sums[lang] += counts(text)
        for lang, s in sums.items():
            yield lang, -1, number[lang]
            for b in np.flatnonzero(s).tolist():
                yield lang, b, int(s[b])

    rows = docs.where(learnable(id_col) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    sums = settle(map_rows(rows, ["l", "t"], run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "langid-counts")
    found = sums.toPandas()  # languages x (BINS + 1) rows at most, whatever the number of documents
    release(sums)
    number = dict(zip(found["lang"][found["bin"] == -1], found["n"][found["bin"] == -1], strict=True))
    found = found[found["bin"] >= 0]
    langs = sorted(number)
    row = {x: i for i, x in enumerate(langs)}
    out = np.zeros((len(langs), BINS))
    out[found["lang"].map(row).to_numpy(int), found["bin"].to_numpy(int)] = found["n"].to_numpy(float)
    return Model(langs, out, np.array([number[x] for x in langs], float))


def _maker(docs: DataFrame, model: Model) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[tuple]], list[tuple]]:
        return lambda rows: [shared.value.predict(text) for (text,) in rows]

    return make


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, languages, shares."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return attach(rows, ["text"], _maker(docs, model), "lang_pred string, score double, languages array<string>, shares array<double>", less=("text",))


def keep_identified(docs: DataFrame, model: Model, min_share: float = MIN_SHARE, text_col: str = "text") -> DataFrame:
    """docs without rows that are `und` or of no language with min_share of the text."""
    lang, score, *_ = added = [fresh(docs, x) for x in ("lang_pred", "score", "languages", "shares")]
    kinds = ("string", "double", "array<string>", "array<double>")
    found = attach(docs, [text_col], _maker(docs, model), ", ".join(f"{a} {k}" for a, k in zip(added, kinds, strict=True)))
    return found.where((F.col(lang) != "und") & (F.col(score) >= min_share)).drop(*added)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).withColumnRenamed("id", "doc_id")
