"""TF-IDF terms of documents, and clusters with names made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import storage
from tidemill.functions import text
from tidemill.operators import kmeans

#: What lies between words; a word is a run of two or more of the others.
BETWEEN = r"[^\p{L}\p{N}_]+"
#: A vocabulary of at most this many terms goes to the texts, a larger one meets their terms by shuffle.
BROADCAST_TERMS = 100_000
#: Distinct terms, and distinct words, that a task counts before it hands them on.
TALLIED = 1 << 21, 1 << 20
#: Rows of a batch that leaves Python.
SLICE = 1 << 18
#: Bytes of a table from which on occurrences are first counted by hashes of terms, and the bits of a hash.
HASHED_BYTES, BITS = 32 << 20, 22


def english() -> list[str]:
    """Spark's own list of English stop words."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def _words(texts: pa.Array, stop: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row, at): the distinct words of a batch, and for each position its row and its number among these."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), BETWEEN)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    fit = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=pa.array(stop, words.type))))
    at = coded.indices.to_numpy().astype(np.int64)
    keep = fit.to_numpy(zero_copy_only=False)[at]
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return words, row[keep], at[keep]


def _codes(row: np.ndarray, at: np.ndarray, words: int, bigrams: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of words and of pairs of neighbours; a code holds the first word and, plus one, the second. Words below 0 are none."""
    known = at >= 0
    rows, codes = [row[known]], [at[known] * (words + 1)]
    if bigrams:
        near = (row[1:] == row[:-1]) & known[1:] & known[:-1]
        rows.append(row[1:][near])
        codes.append((at[:-1] * (words + 1) + at[1:] + 1)[near])
    return np.concatenate(rows), np.concatenate(codes)


def _counted(row: np.ndarray, code: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n): the distinct codes below span of each row, in order."""
    cell, n = np.unique(row * span + code, return_counts=True)
    return cell // span, cell % span, n


def _spelt(words: pa.Array, codes: np.ndarray) -> pa.Array:
    first, second = np.divmod(codes, len(words) + 1)
    one = words.take(pa.array(first))
    return pc.if_else(pa.array(second > 0), pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(second - 1, 0))), pa.scalar(" ", words.type)), one)


def _read(docs: DataFrame, key: str, column: str) -> DataFrame:
    storage.bounded(docs.sparkSession)
    return docs.select(F.col(key), F.lower(F.coalesce(column, F.lit(""))).alias("_t"))


def term_counts(docs: DataFrame, key: str, column: str, stop: Sequence[str], bigrams: bool = True) -> DataFrame:
    """(key, term, tf) of words of two or more characters and of pairs of neighbours, stop words out first.

    Terms are counted within their row, which key tells from others; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, at = _words(batch.column(1), stop)
            row, code, n = _counted(*_codes(row, at, len(words), bigrams), len(words) * (len(words) + 1))
            for low in range(0, len(row), SLICE):
                part = slice(low, low + SLICE)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), _spelt(words, code[part]), pa.array(n[part])], [key, "term", "tf"])

    return _read(docs, key, column).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def _hashes(words: pa.Array, code: np.ndarray, kinds: int) -> np.ndarray:
    """A hash below kinds, a power of two, of each word or pair of words, the same in every task."""
    own = hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    first, second = np.divmod(code, len(words) + 1)
    mixed = own.take(first) * np.uint64(0x9E3779B97F4A7C15) ^ np.append(np.uint64(0), own * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)).take(second)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) & (kinds - 1)


def _occurrences(docs: DataFrame, column: str, stop: Sequence[str], bigrams: bool) -> np.ndarray:
    """How often terms of each hash occur: no term occurs more often than that."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    kinds, step, names = 1 << BITS, 1 << 18, ["part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(kinds, np.int64)
        for batch in batches:
            words, row, at = _words(batch.column(0), stop)
            if len(row):
                counts += np.bincount(_hashes(words, _codes(row, at, len(words), bigrams)[1], kinds), minlength=kinds)
        for n, low in enumerate(range(0, len(counts), step)):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([counts[low : low + step].tobytes()], pa.binary())], names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts[n] = parts.get(n, 0) + np.frombuffer(x, np.int64)
        for n, x in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([x.tobytes()], pa.binary())], names)

    schema = "part int, counts binary"
    rows = _read(docs, docs.columns[0], column).select("_t").coalesce(cores).mapInArrow(run, schema).repartition(cores, "part").mapInArrow(added, schema).collect()
    return np.concatenate([np.frombuffer(bytes(r.counts), np.int64) for r in sorted(rows, key=lambda r: r.part)] or [np.zeros(kinds, np.int64)])


def _tally(docs: DataFrame, column: str, stop: Sequence[str], bigrams: bool, asked: np.ndarray | None = None) -> DataFrame:
    """(term, df, _all): in how many rows a term is and how often, added up over TALLIED terms of a task; of all hashes or of those asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []

        def merge() -> None:
            if len(parts) > 1:
                code, df, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                code, at = np.unique(code, return_inverse=True)
                parts[:] = [(code, np.bincount(at, df, len(code)).astype(np.int64), np.bincount(at, n, len(code)).astype(np.int64))]

        def told() -> Iterator[pa.RecordBatch]:
            merge()
            words = pa.array(list(numbers), pa.string())
            for code, df, n in parts:
                for low in range(0, len(code), SLICE):
                    part = slice(low, low + SLICE)
                    own = (code[part] >> 32) * (len(words) + 1) + (code[part] & 0xFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([_spelt(words, own), pa.array(df[part]), pa.array(n[part])], ["term", "df", "_all"])
            numbers.clear()
            parts.clear()

        for batch in batches:
            words, row, at = _words(batch.column(0), stop)
            row, code = _codes(row, at, len(words), bigrams)
            if asked is not None and len(row):
                had = asked.take(_hashes(words, code, len(asked)))
                row, code = row[had], code[had]
            _, code, n = _counted(row, code, len(words) * (len(words) + 1))
            code, at = np.unique(code, return_inverse=True)
            first, second = np.divmod(code, len(words) + 1)
            if asked is not None:
                used = np.unique(np.concatenate([first, second[second > 0] - 1]))
                words, first, second = words.take(pa.array(used)), np.searchsorted(used, first), np.where(second > 0, np.searchsorted(used, second - 1) + 1, 0)
            own = np.array([numbers.setdefault(w, len(numbers)) for w in words.to_pylist()], np.int64)
            parts.append((own[first] << 32 | np.where(second > 0, own[second - 1] + 1, 0), np.bincount(at), np.bincount(at, n).astype(np.int64)))
            if len(parts) > 1 and sum(len(p[0]) for p in parts) > 2 * TALLIED[0]:
                merge()
            if len(numbers) > TALLIED[1] or sum(len(p[0]) for p in parts) > TALLIED[0] and len(parts) == 1:
                yield from told()
        yield from told()

    return _read(docs, docs.columns[0], column).select("_t").mapInArrow(run, "term string, df long, _all long")


def _bytes(docs: DataFrame) -> int:
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _frequent(docs: DataFrame, column: str, stop: Sequence[str], bigrams: bool, limit: int, fit: Callable[..., DataFrame]) -> DataFrame:
    """Terms that fit, the limit most frequent and all that occur as often among them: most terms are never handed on.

    Only terms whose hash occurs often enough are tallied. If limit of these that fit occur as often themselves, no other
    term is among the most frequent; else terms of rarer hashes are tallied too.
    """
    counts = _occurrences(docs, column, stop, bigrams)
    falling, most = np.sort(counts)[::-1], 2 * limit
    while most <= 32 * limit and most < len(falling) and falling[most] > 1:
        least = int(falling[most])
        found = fit(counts >= least).where(F.col("_all") >= least).toArrow()
        if found.num_rows >= limit:
            return docs.sparkSession.createDataFrame(found)
        most *= 4
    return fit()


def vocabulary(docs: DataFrame, column: str, stop: Sequence[str] = (), min_df: int = 1, max_df: float = 1.0, max_features: int | None = 5000, bigrams: bool = True) -> DataFrame:
    """(term, df, idf): terms in min_df documents or more, and in the share max_df at most; the max_features most frequent, ties by term."""
    total = docs.agg(F.count("*")).scalar()

    def fit(asked: np.ndarray | None = None) -> DataFrame:
        found = _tally(docs, column, stop, bigrams, asked).groupBy("term").agg(F.sum("df").alias("df"), F.sum("_all").alias("_all")).withColumn("_n", total)
        return found.where((F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * max_df))

    found = _frequent(docs, column, stop, bigrams, max_features, fit) if max_features and _bytes(docs) >= HASHED_BYTES else fit()
    if max_features:
        found = found.orderBy(F.desc("_all"), "term").limit(max_features)
    return found.select("term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


@dataclass(frozen=True)
class Terms:
    """A vocabulary of bounded size in the order of its terms, with what is needed to weigh a text by it."""

    terms: list[str]
    df: np.ndarray
    idf: np.ndarray
    stop: tuple[str, ...]
    sublinear: bool
    bigrams: bool

    def weigher(self) -> Callable[[pa.Array], tuple[np.ndarray, ...]]:
        """Of a batch of texts (row, term number, tf, raw, weight), in order; weights of a row have length 1."""
        cut = [t.split(" ") for t in self.terms]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for t in cut for w in t))}
        base = len(known) + 1
        codes = np.array([known[t[0]] * base + (known[t[1]] + 1 if len(t) > 1 else 0) for t in cut], np.int64)
        order = np.argsort(codes)
        codes, spelt = codes[order], pa.array(list(known), pa.string())

        def weigh(texts: pa.Array) -> tuple[np.ndarray, ...]:
            words, row, at = _words(texts, self.stop)
            own = pc.fill_null(pc.index_in(words, value_set=spelt.cast(words.type)), -1).to_numpy().astype(np.int64)
            row, code = _codes(row, own[at], base - 1, self.bigrams)
            place = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[place] == code if len(codes) else np.zeros(len(code), bool)
            row, term, n = _counted(row[hit], order[place[hit]], max(1, len(codes)))
            raw = (1 + np.log(n) if self.sublinear else n) * self.idf[term]
            return row, term, n, raw, raw / np.sqrt(np.bincount(row, raw * raw))[row]

        return weigh


def learned(docs: DataFrame, column: str, stop: Sequence[str] = (), sublinear: bool = False, bigrams: bool = True, **limits) -> Terms:
    """A vocabulary whose size max_features bounds, so that it can go to the texts."""
    rows = sorted(vocabulary(docs, column, stop, bigrams=bigrams, **limits).toLocalIterator(), key=lambda r: r.term)
    return Terms([r.term for r in rows], np.array([r.df for r in rows], np.int64), np.array([r.idf for r in rows], float), tuple(stop), sublinear, bigrams)


def weights(docs: DataFrame, key: str, column: str, stop: Sequence[str] = (), min_df: int = 1, max_df: float = 1.0, max_features: int | None = 5000, sublinear: bool = False, bigrams: bool = True) -> DataFrame:
    """(key, term, tf, df, raw, weight): tf-idf with a smoothed idf, weight being scaled to unit length.

    Terms in fewer than min_df documents or in more than the share max_df are left out; of the
    rest the max_features most frequent stay, ties by term. Null texts have no terms. A row is
    weighed where it lies, which key tells from others; a vocabulary without a bound is joined.
    """
    limits = {"min_df": min_df, "max_df": max_df, "max_features": max_features}
    if max_features and max_features <= BROADCAST_TERMS:
        return weighed(docs, key, column, learned(docs, column, stop, sublinear, bigrams, **limits))
    known = vocabulary(docs, column, stop, bigrams=bigrams, **limits)
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = term_counts(docs, key, column, stop, bigrams).join(known, "term").withColumn("raw", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", "df", "raw", (F.col("raw") / norm).alias("weight"))


def weighed(docs: DataFrame, key: str, column: str, known: Terms, top: int | None = None) -> DataFrame:
    """(key, term, tf, df, raw, weight) by a learned vocabulary; with top (key, term, rank, weight) of the top terms of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, spelt = known.weigher(), pa.array(known.terms, pa.string())
        for batch in batches:
            row, term, n, raw, weight = weigh(batch.column(1))
            if top:
                order = np.lexsort((term, -raw, row))
                row, term, weight = row[order], term[order], weight[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                first = rank <= top
                row, term, weight = row[first], term[first], weight[first]
                columns, names = [rank[first].astype(np.int32), weight], ["rank", "weight"]
            else:
                columns, names = [n, known.df[term], raw, weight], ["tf", "df", "raw", "weight"]
            for low in range(0, len(row), SLICE):
                part = slice(low, low + SLICE)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), spelt.take(pa.array(term[part])), *(pa.array(c[part]) for c in columns)], [key, "term", *names])

    kinds = [("rank", T.IntegerType())] if top else [("tf", T.LongType()), ("df", T.LongType()), ("raw", T.DoubleType())]
    fields = [docs.schema[key], T.StructField("term", T.StringType()), *(T.StructField(n, k) for n, k in kinds), T.StructField("weight", T.DoubleType())]
    return _read(docs, key, column).mapInArrow(run, T.StructType(fields))


def keywords(docs: DataFrame, key: str, column: str, top: int = 10, max_features: int | None = 5000, **options) -> DataFrame:
    """The top terms of each document with their rank; ties by term."""
    if max_features and max_features <= BROADCAST_TERMS:
        return weighed(docs, key, column, learned(docs, column, max_features=max_features, **options), top)
    w = Window.partitionBy(key).orderBy(F.desc("raw"), "term")
    ranked = weights(docs, key, column, max_features=max_features, **options).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top).select(key, "term", "rank", "weight")


def arrays(docs: DataFrame, key: str, column: str, known: Terms) -> DataFrame:
    """(key, indices, values): a row for each document with terms, their numbers in order and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = known.weigher()
        for batch in batches:
            row, term, _, _, weight = weigh(batch.column(1))
            own, starts = np.unique(row, return_index=True)
            at = pa.array(np.append(starts, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(term, pa.int32())), pa.ListArray.from_arrays(at, pa.array(weight))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *lists], [key, "indices", "values"])

    fields = [docs.schema[key], T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    return _read(docs, key, column).mapInArrow(run, T.StructType(fields))


def vectors(terms: DataFrame, key: str, max_features: int = 20_000) -> DataFrame:
    """(key, features) sparse vectors of (key, term, weight); terms are numbered in order.

    Numbering runs in one task over the vocabulary, which max_features bounds. A sparse vector is
    stored as a struct, so the structs are written and read back as vectors, which also spares the
    many passes of a fit the work before.
    """
    numbered = terms.select("term").distinct().withColumn("_i", F.row_number().over(Window.orderBy("term")) - 1)
    rows = terms.join(F.broadcast(numbered) if numbered.count() <= BROADCAST_TERMS else numbered, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "weight"))).alias("_p"))
    features = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(max_features).alias("size"), F.transform("_p", lambda x: x["_i"].cast("int")).alias("indices"), F.transform("_p", lambda x: x["weight"].cast("double")).alias("values"))
    out = rows.select(key, features.alias("features"))
    return _stored(out)


def _stored(rows: DataFrame) -> DataFrame:
    """rows(key, features) written as structs and read back as vectors."""
    from pyspark.ml.linalg import VectorUDT

    at = storage.fresh_path(rows.sparkSession, "vectors")
    rows.write.parquet(at)
    fields = [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in rows.schema]
    out = rows.sparkSession.read.schema(T.StructType(fields)).parquet(at)
    out._stored = True
    return out


def features(docs: DataFrame, key: str, column: str, known: Terms) -> DataFrame:
    """(key, features): a sparse vector of each document with terms; nothing is shuffled."""
    rows = arrays(docs, key, column, known)
    return _stored(rows.select(key, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(known.terms)).alias("size"), "indices", "values").alias("features")))


def dense(rows: DataFrame, key: str, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.where(F.col(column).isNotNull()).select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))


#: What passes read of points that are held.
_HELD: dict[int, kmeans.Points] = {}


@contextmanager
def held(points: DataFrame) -> Iterator[kmeans.Points]:
    """Points are kept while they are fitted, with the models found; a caller's own cache stays, and so do stored points."""
    if id(points) in _HELD:
        yield _HELD[id(points)]
        return
    level = points.storageLevel
    own = not (level.useMemory or level.useDisk or getattr(points, "_stored", False))
    if own:
        points.persist()
    try:
        _HELD[id(points)] = kmeans.Points(points)
        yield _HELD[id(points)]
    finally:
        _HELD.pop(id(points), None)
        if own:
            points.unpersist()


def k_means(points: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> kmeans.Model:
    """The model of the lowest cost of several seeds; their passes are shared."""
    seeds = range(seed, seed + restarts)
    with held(points) as rows:
        rows.fit([k], seeds)
        return min((rows.found[k, s] for s in seeds), key=lambda m: m.cost)


def silhouettes(points: DataFrame, ks: Sequence[int] = range(3, 11), restarts: int = 10, seed: int = 42) -> list[tuple[int, float]]:
    """(k, silhouette over squared distances) of each k below the number of points that gives two clusters or more.

    All fits of all k go through the same passes.
    """
    with held(points) as rows:
        n = points.count()
        ks = [k for k in ks if k < n]
        if not ks:
            return []
        rows.fit(ks, range(seed, seed + restarts))
        scores = rows.silhouettes([k_means(points, k, restarts, seed) for k in ks])
        return [(k, float(s)) for k, s in zip(ks, scores, strict=True) if s is not None]


def row_guard(df: DataFrame, minimum: int, what: str) -> DataFrame:
    """(what, rows, enough): rows counted up to the minimum, and whether they reach it."""
    return df.limit(minimum).agg(F.lit(what).alias("what"), F.count("*").alias("rows")).withColumn("enough", F.col("rows") >= minimum)


def require_rows(df: DataFrame, minimum: int, what: str) -> None:
    """Raises where there are too few rows for what is to be done with them."""
    found = row_guard(df, minimum, what).first()
    if not found.enough:
        raise ValueError(f"{what} needs {minimum} rows or more, got {found.rows}")


def best_model(points: DataFrame, k: int | None = None, ks: Sequence[int] = range(3, 11), restarts: int = 10, seed: int = 42, at_least: int = 20) -> kmeans.Model:
    """A model by k-means; k is that of the best silhouette, the first of equals, if not given."""
    require_rows(points, at_least, "clustering")
    with held(points):
        if k is None:
            scores = silhouettes(points, ks, restarts, seed)
            if not scores:
                raise ValueError("no usable k: too few or too uniform rows")
            k = max(scores, key=lambda s: s[1])[0]
        return k_means(points, k, restarts, seed)


def cluster(points: DataFrame, key: str, k: int | None = None, ks: Sequence[int] = range(3, 11), restarts: int = 10, seed: int = 42, at_least: int = 20) -> DataFrame:
    """(key, cluster) by the best model."""
    return best_model(points, k, ks, restarts, seed, at_least).transform(points).select(key, F.col("prediction").alias("cluster"))


def told(spark: SparkSession, model: kmeans.Model, known: Terms) -> DataFrame:
    """(cluster, term, _s): the weights of each term of a vocabulary, added up over each cluster of a model of its vectors."""
    sums = model.totals()
    cluster, term = np.nonzero(sums)
    columns = [pa.array(cluster, pa.int32()), pa.array(known.terms, pa.string()).take(pa.array(term)), pa.array(sums[cluster, term])]
    return spark.createDataFrame(pa.table(columns, names=["cluster", "term", "_s"]))


def describe(clusters: DataFrame, terms: DataFrame, skills: DataFrame, key: str, top_terms: int = 10, top_skills: int = 8) -> DataFrame:
    """Size, name, strongest terms by mean weight and most frequent skills of each cluster.

    terms(key, term, weight) and skills(key, skill) may lack documents; ties go by name.
    """
    own = terms.join(clusters, key).groupBy("cluster", "term").agg(F.sum("weight").alias("_s"))
    return described(clusters, own, skills, key, top_terms, top_skills)


def described(clusters: DataFrame, sums: DataFrame, skills: DataFrame, key: str, top_terms: int = 10, top_skills: int = 8) -> DataFrame:
    """As describe, of the weights added up: sums(cluster, term, _s)."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("postings"))

    def best(scored: DataFrame, name: str, limit: int, out: str) -> DataFrame:
        w = Window.partitionBy("cluster").orderBy(F.desc("_s"), name)
        top = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
        return top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda x: x[name]).alias(out))

    own = best(sums, "term", top_terms, "top_terms")
    had = best(skills.join(clusters, key).groupBy("cluster", "skill").agg(F.count("*").alias("_s")), "skill", top_skills, "top_skills")
    none = F.array().cast("array<string>")
    j = sizes.join(own, "cluster", "left").join(had, "cluster", "left").select("cluster", "postings", F.coalesce("top_terms", none).alias("top_terms"), F.coalesce("top_skills", none).alias("top_skills"))
    return j.withColumn("label", text.label_of(F.col("top_terms"), F.col("top_skills")))
