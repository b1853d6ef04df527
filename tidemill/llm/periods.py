"""Detection of periodic runs of words, by the longest previous factors of each document.

Words become numbers, and documents are searched many at a time as one array in which no two
documents share a number. Sorting by prefixes of doubled length gives the suffix array and, kept for
each doubling, equality of any two stretches in a few look-ups; from it come the LCP array, the
longest-previous-factor array and its LZ blocks. By Main's theorem a run that touches the border of
two blocks has a period of at most the two blocks' length, so every such period is extended to both
sides of the border; a run inside a block is a copy of a run inside the block's previous occurrence
and is copied from the bucket of its start. Together these are all runs, each once.

A run is a stretch of words with smallest period p, at least min_exponent * p and min_length words
long, that no neighbouring word extends. min_exponent must be at least 2.

Defined cases: null text counts as empty and has no words and no runs; words are divided by ASCII
white space only; very long texts are searched whole, with 4 bytes for each word and doubling of the
longest repeat; runs of equal exponent come by start, then period; repeated rows are searched each; a
null id stays null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from tidemill.llm.common import map_rows, table

#: Words of documents that are searched together, and borders with a period that are looked at at a time.
_AT_ONCE, _PAIRS = 300_000, 1 << 21
#: What a run of words must have at least.
MIN_LENGTH, MIN_EXPONENT = 6, 4

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0, by first occurrence."""
    first = dict.fromkeys(words)
    number = dict(zip(first, range(len(first)), strict=True))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class Suffixes:
    """Suffix array of an array of numbers whose last is unique, and equality of its stretches.

    levels[k][i] is equal for two positions if and only if the 2**k numbers from there are.
    """

    def __init__(self, sym: np.ndarray):
        n = len(sym)
        counts = np.bincount(sym)
        rank = (np.cumsum(counts) - counts)[sym].astype(np.int32)
        sa = np.argsort(sym, kind="stable")
        self.split = np.zeros(n, np.int8)  # the doubling that told a suffix from the one before it
        levels, slots, h = [rank], np.flatnonzero(counts[sym[sa]] > 1), 1
        while len(slots):
            at = sa[slots]
            key = rank[at].astype(np.int64) << 32 | rank[at + h]
            order = np.argsort(key)
            at, key = at[order], key[order]
            sa[slots] = at
            new = np.r_[True, key[1:] != key[:-1]]
            group = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            apart = slots[new & (rank[at] != group)]
            self.split[apart] = len(levels)
            rank = rank.copy()
            rank[at] = group
            levels.append(rank)
            slots = slots[~(new & np.r_[new[1:], True])]
            h *= 2
        self.sa, self.levels = sa, np.stack(levels)
        # A slot whose suffix begins with another number than the one before keeps split 0.

    def lcp(self) -> np.ndarray:
        """How many numbers each suffix shares with the one before it in the array."""
        sa, out = self.sa, np.zeros(len(self.sa), np.int64)
        some = np.flatnonzero(self.split)
        out[some] = np.int64(1) << (self.split[some].astype(np.int64) - 1)
        for k in range(len(self.levels) - 3, -1, -1):
            at = np.flatnonzero(self.split >= k + 2)
            level, shared = self.levels[k], out[at]
            out[at] = shared + ((level[sa[at - 1] + shared] == level[sa[at] + shared]).astype(np.int64) << k)
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on; i and j differ."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i equal those before j; i and j differ."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            inside = (a >= 0) & (b >= 0)
            out += (inside & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the longest stretch that also begins before it, and where: (length, place).

    The place is that of the nearest suffix to either side in the array that begins earlier; it is
    found by jumps, which take the least LCP along with them and end where that is 0.
    """
    n = len(sa)
    length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        shared = lcp.copy() if step < 0 else np.r_[lcp[1:], 0]
        live = np.flatnonzero(shared)
        while len(live := live[sa[to[live]] > sa[live]]):
            over = to[live]
            shared[live], to[live] = np.minimum(shared[live], shared[over]), to[over]
            live = live[shared[live] > 0]
        better = np.flatnonzero(shared > length[sa])
        length[sa[better]], place[sa[better]] = shared[better], sa[to[better]]
    return length, place


def blocks(length: np.ndarray) -> np.ndarray:
    """Where the LZ blocks begin: a block is the longest previous factor, or a number that is new."""
    ahead = (np.arange(len(length)) + np.maximum(length, 1)).tolist()
    out, at, n = [], 0, len(ahead)
    while at < n:
        out.append(at)
        at = ahead[at]
    return np.array(out, np.int64)


def _borders(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(border, period, side): each border of two blocks with each period that a run there can have.

    Side 0 looks back from the border by a period, side 1 ahead by one.
    """
    size = np.diff(np.r_[starts, n])
    border = np.concatenate([starts[1:], starts])
    most = np.concatenate([np.minimum(size[:-1] + size[1:], starts[1:]), np.minimum(size, n - 1 - starts)])
    side = np.repeat(np.array([0, 1]), [len(starts) - 1, len(starts)])
    ends = np.cumsum(most)
    for low in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
        high = min(low + _PAIRS, int(ends[-1]))
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        begin = ends[a:b] - most[a:b]
        count = np.minimum(ends[a:b], high) - np.maximum(begin, low)
        of = np.repeat(np.arange(a, b), count)
        yield border[of], np.arange(low, high) - np.repeat(begin, count) + 1, side[of]


def border_runs(suffixes: Suffixes, starts: np.ndarray, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs that touch a border of blocks."""
    levels, n = suffixes.levels, len(suffixes.sa)
    found: dict[tuple[int, int], int] = {}
    for border, period, side in _borders(starts, n):
        # Of what both sides must extend together, one side has at least half: a single look-up tells.
        need = np.maximum(min_length - period, (min_exponent - 1) * period)
        level = np.frexp((need + 1) // 2)[1] - 1
        keep = level < len(levels)
        border, period, side, need, level = (x[keep] for x in (border, period, side, need, level))
        i = border + np.where(side == 0, -period, 0)
        j = i + period
        half = np.int64(1) << level
        right = levels[level, i] == levels[level, j]
        left = (i >= half) & (levels[level, np.maximum(i - half, 0)] == levels[level, np.maximum(j - half, 0)])
        at = np.flatnonzero(right | left)
        i, j, period, need = i[at], j[at], period[at], need[at]
        left, right = suffixes.behind(i, j), suffixes.ahead(i, j)
        at = np.flatnonzero(left + right >= need)
        for s, e, p in zip((i - left)[at].tolist(), (j + right)[at].tolist(), period[at].tolist(), strict=True):
            if p < found.get((s, e), p + 1):
                found[s, e] = p
    return found


def all_runs(seqs: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[Run]]:
    """The runs (start, length, period) of each sequence of numbers, by start, then period."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    out: list[list[Run]] = [[] for _ in seqs]
    if not seqs:
        return out
    parts, offset = [], 0
    for s in seqs:  # a sequence's own numbers, and one that ends it
        parts += [s + (offset + 1), np.array([offset])]
        offset += (int(s.max()) if len(s) else -1) + 2
    sym = np.concatenate(parts)
    suffixes = Suffixes(sym)
    length, place = previous_factors(suffixes.sa, suffixes.lcp())
    starts = blocks(length)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, e), p in border_runs(suffixes, starts, min_length, min_exponent).items():
        buckets.setdefault(s, []).append((e, p))
    if not buckets:
        return out
    order = sorted(buckets)
    size = np.diff(np.r_[starts, len(sym)])
    long = np.flatnonzero((size >= min_length + 2) & (length[starts] > 0))
    for b, n, src in zip(starts[long].tolist(), size[long].tolist(), place[starts[long]].tolist(), strict=True):
        k, shift = bisect_right(order, src), b - src
        while k < len(order) and order[k] < src + n:
            for e, p in [x for x in buckets[order[k]] if x[0] < src + n]:
                to = order[k] + shift
                if to not in buckets:
                    insort(order, to)
                if (own := (e + shift, p)) not in buckets.setdefault(to, []):
                    buckets[to].append(own)
            k += 1
    begins = np.cumsum([0] + [len(s) + 1 for s in seqs])
    of = (np.searchsorted(begins, np.array(order), "right") - 1).tolist()
    begins = begins.tolist()
    for s, d in zip(order, of, strict=True):
        out[d] += sorted((s - begins[d], e - s, p) for e, p in buckets[s])
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest exponent; of equals the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def _searched(rows: Iterator[tuple], change: Callable[[object, list[bytes]], list[bytes]] | None, min_length: int, min_exponent: int) -> Iterator[tuple]:
    """(id, words, runs) of (id, text) rows, searched many at a time."""
    kept: list[tuple] = []
    size = 0

    def flush() -> Iterator[tuple]:
        found = all_runs([numbered(words) for _, words in kept], min_length, min_exponent)
        for (i, words), runs in zip(kept, found, strict=True):
            yield i, words, runs

    for i, text in rows:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only
        kept.append((i, change(i, words) if change else words))
        size += len(words)
        if size >= _AT_ONCE:
            yield from flush()
            kept, size = [], 0
    yield from flush()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of words of each document."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, _, runs in _searched(rows, None, min_length, min_exponent):
            yield from ((i, *r) for r in runs)

    return map_rows(docs, [id_col, text_col], run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, period long")


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, text): the words that are left when of each run only the first period stays, with single spaces."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, words, runs in _searched(rows, None, min_length, min_exponent):
            yield i, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")

    return map_rows(docs, [id_col, text_col], run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string")


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: the number of runs, the strongest one, and digests of all runs and of the collapsed text.

    change gives the words to search for an id and its words.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, words, runs in _searched(rows, change, MIN_LENGTH, MIN_EXPONENT):
            best = strongest(runs)
            top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
            yield i, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def repeated(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document as the query takes them: in a tenth of the documents the end repeats a stretch."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def query(spark, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "documents"), change=repeated)
