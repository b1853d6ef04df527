"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of benchmark words; windows of one length share a searcher. Its shift
table maps each block of two words to how far the scan may move on, so most positions of clean
text are never looked at; where the shift is zero the block's suffix bucket selects test
windows (by the hash of their first block), and direct comparison of the words confirms them.
Tables are arrays: shifts are found by a hash of the block (blocks that collide share the smaller
shift, which is safe), buckets lie together in the order of their suffix hash, and the words
themselves are kept once, as text.

The patterns are broadcast in blocks of at most BLOCK_BYTES of benchmark text, one at a time; a
worker builds a block's tables once. Each block is one pass over the documents that adds to the
spans found so far, so a benchmark of any size is searched without a shuffle of texts.

Defined cases: null or empty texts have no words and no hits; an item of fewer words than a
window is one window; an item without words matches nothing; windows of an item with a null id
hit words but are not listed; repeated item ids are listed once, and items of equal words are
searched once and all listed; documents and items of any length are read whole; spans that meet
or overlap are merged; repeated documents are separate rows, each kept or dropped by its own text
whatever its id, a null id included; empty tables give no rows (documents) or no hits
(benchmark); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import attach, fresh, table

WINDOW = 13
#: Bytes of benchmark text whose windows one broadcast holds.
BLOCK_BYTES = 16_000_000
#: Tables that a worker keeps, for the blocks that its tasks came to last.
KEPT_TABLES = 2
_MIX, _MIX2 = np.int64(0x1E3779B97F4A7C15), np.int64(0x3F58476D1CE4E5B9)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, tokens), np.int64, len(tokens))


def _blocks_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of `size` (1 or 2) words that starts at each position."""
    with np.errstate(over="ignore"):
        out = hashes * _MIX if size == 1 else hashes[:-1] * _MIX + hashes[1:] * _MIX2
        return out ^ (out >> np.int64(29))


class Benchmark:
    """The words of all items, each distinct item once."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        lines: dict[bytes, set[str]] = {}
        for item, text in items:
            if line := b" ".join(words(text)):
                ids = lines.setdefault(line, set())
                if item is not None:
                    ids.add(item)
        self.text, self.ids = b" ".join(lines), list(lines.values())
        tokens = self.text.split()
        self.hashes = _hashes(tokens)
        # Where each word starts in the text, and where the text would go on.
        self.at = np.cumsum([0, *(len(t) + 1 for t in tokens)])
        self.sizes = np.array([line.count(b" ") + 1 for line in lines], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def window(self, start: int, length: int) -> bytes:
        return self.text[self.at[start] : self.at[start + length] - 1]


class Searcher:
    """Wu-Manber tables for the windows of one length in words, which start at some words."""

    def __init__(self, bench: Benchmark, length: int, starts: np.ndarray):
        self.bench, self.m = bench, length
        self.block = block = min(2, length)
        keys = _blocks_of(bench.hashes, block)
        slots = 1 << min(24, max(12, (4 * len(starts)).bit_length()))
        self.mask = np.int64(slots - 1)
        default = length - block + 1
        self.shift = np.full(slots, default, np.uint8 if default < 256 else np.int32)
        for end in range(block, length + 1):  # the last block written to a slot has the least shift
            self.shift[keys[starts + (end - block)] & self.mask] = length - end
        suffix = keys[starts + (length - block)]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.starts = suffix[order], starts[order]
        self.prefix = keys[self.starts]

    def find(self, tokens: list[bytes], keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, word of the benchmark) of every occurrence of every window; keys are those of the text's blocks."""
        m, n, block = self.m, len(tokens), self.block
        shift = self.shift[keys & self.mask]
        shift = shift.tobytes() if shift.dtype == np.uint8 else shift.tolist()
        ends, at, last = [], m - block, n - block
        while at <= last:
            step = shift[at]
            if step:
                at += step
            else:
                ends.append(at)
                at += 1
        if not ends:
            return
        suffix = keys[ends]
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        for k in np.flatnonzero(high > low).tolist():
            start = ends[k] + block - m
            bucket = np.flatnonzero(self.prefix[low[k] : high[k]] == keys[start])
            if len(bucket):
                own = b" ".join(tokens[start : start + m])
                for w in self.starts[bucket + low[k]].tolist():
                    if self.bench.window(w, m) == own:
                        yield start, w


def searchers(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Searcher]:
    """Searchers for (id, text) items, one for each length of window."""
    bench = Benchmark(items)
    lengths = np.minimum(bench.sizes, window)
    out = []
    for m in np.unique(lengths).tolist():
        some = np.flatnonzero(lengths == m)
        count = bench.sizes[some] - m + 1
        before = np.cumsum(count) - count
        starts = np.repeat(bench.firsts[some] - before, count) + np.arange(int(count.sum()))
        out.append(Searcher(bench, m, starts))
    return out


def search(text: str | None, found: list[Searcher], spans: list[int] = (), items: list[str] = ()) -> tuple[int, list[int], list[str]]:
    """Number of words; merged hit spans as start, end, start, end...; sorted ids of items."""
    tokens = words(text)
    hits, ids, owners = set(zip(spans[::2], spans[1::2], strict=True)), set(items), set()
    if tokens and found:
        hashes, keys = _hashes(tokens), {}
        for s in found:
            if len(tokens) < s.m:
                continue
            if s.block not in keys:
                keys[s.block] = _blocks_of(hashes, s.block)
            for start, word in s.find(tokens, keys[s.block]):
                hits.add((start, start + s.m))
                owners.add(word)
        if owners:
            bench = found[0].bench
            for k in np.unique(np.searchsorted(bench.firsts, np.fromiter(owners, np.int64), "right") - 1).tolist():
                ids |= bench.ids[k]
    flat: list[int] = []
    for a, b in sorted(hits):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return len(tokens), flat, sorted(ids)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list[tuple[str | None, str | None]], bool]]:
    """The benchmark in lists of at most limit bytes of text (or one item), and whether it is the last."""
    part, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        own = len((text or "").encode("utf-8", "surrogatepass"))
        if part and size + own > limit:
            yield part, False
            part, size = [], 0
        part.append((item, text))
        size += own
    yield part, True


_BUILT: dict[str, list[Searcher]] = {}


def _built(name: str, shared, window: int) -> list[Searcher]:
    """The searchers of a block, built once in a worker."""
    if name not in _BUILT:
        while len(_BUILT) >= KEPT_TABLES:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = searchers(shared.value, window)
    return _BUILT[name]


def searched(docs: DataFrame, benchmark: DataFrame, added: tuple[str, str, str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, less: tuple[str, ...] = ()) -> DataFrame:
    """docs, less some columns, with those added: number of words, spans (start and end in turn, merged), items."""
    sc = docs.sparkSession.sparkContext
    n, spans, items = added
    first = True
    for block, last in _blocks(benchmark, item_col, item_text, block_bytes):

        def make(shared=sc.broadcast(block), name=uuid.uuid4().hex) -> Callable[[list[tuple]], list[tuple]]:
            found = _built(name, shared, window)
            return lambda rows: [search(text, found, *so_far) for text, *so_far in rows]

        gone = (() if first else added) + (less if last else ())
        docs = attach(docs, [text_col] if first else [text_col, spans, items], make, f"{n} long, {spans} array<int>, {items} array<string>", gone)
        first = False
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, spans (word start and end in turn, merged), items."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return searched(slim, benchmark, ("n_words", "spans", "items"), less=("text",), **how)


def n_hit(spans: Column) -> Column:
    """Words inside merged spans."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x).cast("long")


def is_contaminated(hit: Column, total: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (hit > 0) & (hit * 20 >= total)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows, all columns as they were."""
    n, spans, items = added = tuple(fresh(docs, x) for x in ("n_words", "spans", "items"))
    found = searched(docs, benchmark, added, text_col)
    return found.where(~is_contaminated(n_hit(F.col(spans)), F.col(n))).drop(*added)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(hit, F.col("n_words")).alias("contaminated"),
    )
