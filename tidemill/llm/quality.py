"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each word has a fixed sparse index vector made from its hash; its word vector is the sum of the
index vectors of its neighbours in all documents. Words are lower-cased letters, and a second
stream holds the shapes of tokens (case, digits, marks, repetition), indexed the same way. A
document is the mean vector of both streams. A two-layer numpy network scores it, and a
temperature fitted on rows kept from training calibrates its probabilities.

The context sums are whole numbers over the whole table: each partition adds up a table of fixed
size, and the tables are added up by row. Only the network reads a sample: at most FIT_ROWS
labelled rows, those first by hash of their id, so it is bounded and the same on every run; their
pooled vectors reach the driver, no text does.

Defined cases: null and empty texts have the zero vector and a score; texts of any length are read
whole, their vectors added up in bounded parts; rows with a null label or id teach the network
nothing; of an id with several labels the largest counts, and of its several texts the one first
by hash; repeated rows are scored each; ties at the bound of FIT_ROWS go by id; with no or one
label class the score is that class's share (0.5 without labels); an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SLICE, attach, held_out, learnable, release, settle, table

#: Labelled rows that the fit reads at most.
FIT_ROWS = 8000
ROWS, DIM, WINDOW, NONZERO = 1 << 15, 32, 2, 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
CACHE_ROWS = 300_000
#: Tokens whose contexts are added up at a time.
TOGETHER = 200_000

_RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """The token with each run of letters or digits written once, by case, and marks as they are."""
    out = []
    for run in _RUNS.findall(token):
        if run[0].isdigit():
            out.append("9")
        elif run[0].isalpha():
            out.append("AA" if len(run) > 1 and run.isupper() else "Aa" if run[0].isupper() else "a")
        else:
            out.append(run)
    return "".join(out)


def _row(kind: str, word: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}{word}".encode("utf-8", "surrogatepass")) & (ROWS - 1)


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of each row's index vector, by a rule."""
    r = np.random.default_rng(17)
    return r.integers(0, DIM, (ROWS, NONZERO)), r.choice(np.array([-1, 1]), (ROWS, NONZERO))


def index_vectors() -> np.ndarray:
    places, signs = index_entries()
    out = np.zeros((ROWS, DIM), np.float32)
    np.add.at(out, (np.arange(ROWS)[:, None], places), signs)
    return out


_CASES = {"a": _row("s", "a"), "Aa": _row("s", "Aa"), "AA": _row("s", "AA")}
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokens:
    """Rows of the word and of the shape of each white-space token."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.shapes: dict[str, int] = {}

    def row(self, token: str) -> int:
        word = token if token.isalpha() else token.strip(_EDGES)
        if word is token and (token.islower() or token.istitle()):
            own = _CASES["a" if token.islower() else "Aa"]
        else:
            s = shape(token)
            if (own := self.shapes.get(s)) is None:
                own = self.shapes[s] = _row("s", s)
        return (xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) & (ROWS - 1)) << 16 | own

    def rows(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        parts = (text or "").split()
        if len(self.seen) >= CACHE_ROWS:
            self.seen, self.shapes = {}, {}
        seen = self.seen
        for p in set(parts).difference(seen):
            seen[p] = self.row(p)
        out = list(map(seen.__getitem__, parts))
        both = np.array(out, np.int64)
        return both >> 16, both & 0xFFFF


AGAIN = _row("x", "again")


def _mean(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return sum(vectors[rows[s : s + TOGETHER]].sum(0, dtype=np.float64) for s in range(0, len(rows), TOGETHER)) / len(rows)


def pooled(words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector with repetitions, and three bounded sizes."""
    n = len(words)
    if not n:
        return np.zeros(2 * DIM + 3, np.float32)
    again = float(np.mean(words[1:] == words[:-1])) if n > 1 else 0.0
    distinct = len(np.unique(words)) / n
    return np.r_[_mean(vectors, words), _mean(vectors, shapes) + again * vectors[AGAIN], again, distinct, np.log1p(n) / 10].astype(np.float32)


class Contexts:
    """Sums of the index vectors of all neighbours, for each row; whole numbers, so order is no matter."""

    def __init__(self):
        self.places, self.signs = index_entries()
        self.sums = np.zeros(ROWS * DIM)
        self.part: list[np.ndarray] = []
        self.size = 0

    def add(self, stream: np.ndarray) -> None:
        for s in range(0, len(stream), TOGETHER):  # windows reach over the seams of a long stream
            self.part += [stream[max(0, s - WINDOW) : s + TOGETHER], np.full(WINDOW, -1)]
            self.size += len(self.part[-2])
            if s:
                self._seam(stream[s - WINDOW : s])
            if self.size >= TOGETHER:
                self.flush()

    def _seam(self, again: np.ndarray) -> None:
        """Takes back the pairs that lie in the words that two parts share."""
        for gap in range(1, WINDOW):
            self._pairs(again[:-gap], again[gap:], -1)

    def flush(self) -> None:
        if self.part:
            rows = np.concatenate(self.part)
            for gap in range(1, WINDOW + 1):
                a, b = rows[:-gap], rows[gap:]
                ok = (a >= 0) & (b >= 0)
                self._pairs(a[ok], b[ok], 1)
        self.part, self.size = [], 0

    def _pairs(self, a: np.ndarray, b: np.ndarray, sign: int) -> None:
        for x, y in ((a, b), (b, a)):
            at = (x[:, None] * DIM + self.places[y]).ravel()
            self.sums += sign * np.bincount(at, self.signs[y].ravel(), ROWS * DIM)

    def table(self) -> np.ndarray:
        self.flush()
        return self.sums.reshape(ROWS, DIM).astype(np.int64)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context sums over all documents: ROWS x DIM whole numbers, whatever the number of documents."""
    names = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(), Contexts()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(start, SLICE).to_pylist():
                    for stream in tokens.rows(text):
                        sums.add(stream)
        own = sums.table()
        some = np.flatnonzero(own.any(1))
        columns = [pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(own[some, i])) for i in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *names])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "row int, " + ", ".join(f"{n} long" for n in names))
    total = settle(parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]), "quality-contexts")
    found = total.toPandas()  # ROWS rows at most
    release(total)
    out = np.zeros((ROWS, DIM))
    out[found["row"].to_numpy(int)] = found[names].to_numpy(float)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context sums scaled to unit length, without what all have in common."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    mean = sums.sum(0, keepdims=True) / max(1e-9, norm.sum())
    out = np.where(norm > 0, sums / np.maximum(norm, 1e-9) - mean, 0)
    # A word keeps its own index vector beside its context; unseen words have that alone.
    return (out + 0.5 * index_vectors() / np.sqrt(NONZERO)).astype(np.float32)


class Model:
    def __init__(self, vectors: np.ndarray):
        self.vectors, self.temperature = vectors, 1.0
        self.share: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        kept = np.arange(len(y)) % 5 == 4
        tx, ty = x[~kept], y[~kept].astype(np.float32)
        self.mean, self.scale = tx.mean(0), tx.std(0) + 1e-3
        r = np.random.default_rng(5)
        params = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        z = (tx - self.mean) / self.scale
        for _ in range(EPOCHS):
            order = r.permutation(len(ty))
            for s in range(0, len(order), BATCH):
                b = order[s : s + BATCH]
                h0 = z[b] @ params[0] + params[1]
                h = np.maximum(h0, 0)
                d = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - ty[b]) / len(b)
                dh = np.outer(d, params[2]) * (h0 > 0)
                grads = [z[b].T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], d.sum()]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] = params[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params
        if kept.any():
            l, ky = self.logits(x[kept]), y[kept]
            grid = np.exp(np.linspace(-2, 2, 81))
            loss = [np.mean(np.logaddexp(0, np.where(ky == 1, -l, l) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _pooler(docs: DataFrame, vectors: np.ndarray) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make() -> Callable[[list[tuple]], list[tuple]]:
        tokens = Tokens()
        return lambda rows: [(pooled(*tokens.rows(text), shared.value).tolist(),) for (text,) in rows]

    return make


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Word vectors of all documents, and a network fitted on at most fit_rows labelled rows."""
    marks = labels.where(learnable(id_col) & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    marks = settle(marks.orderBy(F.xxhash64("id"), "id").limit(fit_rows), "quality-marks")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where(learnable("id"))
    model = Model(word_vectors(context_sums(docs, text_col)))
    found = attach(rows.join(F.broadcast(marks), "id"), ["text"], _pooler(docs, model.vectors), "x array<double>", less=("text",))
    found = found.groupBy("id", "y").agg(F.min(F.struct("h", "x")).alias("one")).orderBy(F.xxhash64("id"), "id").select("y", "one.x").collect()
    release(marks)
    y = np.array([int(r.y) for r in found])
    if len(set(y.tolist())) < 2:
        model.share = float(np.mean(y)) if len(y) else 0.5
    else:
        model.fit(np.array([r.x for r in found], np.float32), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[tuple]], list[tuple]]:
        m, tokens = shared.value, Tokens()

        def many(rows: list[tuple]) -> list[tuple]:
            x = np.stack([pooled(*tokens.rows(text), m.vectors) for (text,) in rows])
            return [(float(p),) for p in m.score(x)]

        return many

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return attach(rows, ["text"], make, "score double", less=("text",))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
