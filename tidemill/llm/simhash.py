"""SimHash near-dedup with pivot distance tables.

Fingerprints are made of word shingles. Distinct fingerprints are dealt into blocks such that
any two within the radius share at least one block. Inside a block each fingerprint has a row of
distances to reference fingerprints (the pivot table), and the block is sorted by the first of
them: only fingerprints whose first distances differ by the radius at most are paired, a pair
whose rows differ by more in any coordinate is discarded, and survivors are compared. Links
within a block leave as a star per component, and components of all stars are found by
distributed rounds.

Pivot distances of random fingerprints lie close together and give no equi-join key, so blocks
come from bit bands: with b bands and a radius of r, two fingerprints that link agree on at
least b - r whole bands, hence the sets of b - r bands are the block keys and no link is lost.
The number of bands follows from the number of fingerprints, so that a block holds few that
don't belong together. Blocks over BLOCK_ROWS are dealt again into parts, and every two parts
meet in one task.

Defined cases: null or empty text has no words and fingerprint zero, which links like any other;
fewer words than a shingle are one shingle; texts of any length are read whole; equal
fingerprints link; repeated rows stay separate rows of one component; ids may be of any type that
has an order; a null id never names a component unless all its ids are null; of a component the
row with the smallest id is kept (of one id the row that stands first by row key), so repeated
and null ids lose nothing; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import attach, drop_rows, join_groups, keyed, release, settle, table
from tidemill.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints that one block may hold by chance, on average, before more bands are used.
CHANCE_ROWS = 16
#: Distinct fingerprints of a block that one task takes at most.
BLOCK_ROWS = 8192
#: Reference fingerprints of the pivot table.
PIVOTS = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s : e - 1], seed) for s, e in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    seen = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + _OFFSETS
    ones = np.bincount(seen.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def bands(n: int, radius: int = RADIUS) -> tuple[int, ...]:
    """Bits of each band for n fingerprints: the fewest bands whose blocks hold CHANCE_ROWS by chance."""
    for count in range(radius + 2, radius + 6):
        out = tuple(64 // count + (i < 64 % count) for i in range(count))
        if n <= CHANCE_ROWS << sum(out[radius:]):
            break
    return out


def fingerprints(rows: DataFrame, text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """rows with fp, the fingerprint as a signed long, in place of the text."""

    def make():
        def signed(rows: list[tuple]) -> list[tuple]:
            found = (fingerprint(text, shingle, seed) for (text,) in rows)
            return [(fp - (1 << 64) if fp >> 63 else fp,) for fp in found]

        return signed

    return attach(rows, [text_col], make, "fp long", less=(text_col,))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the splitmix64 sequence."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one row per reference."""
    return np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int8)


def _survivors(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Positions where no coordinate of two aligned tables differs by more than the radius."""
    alive = np.flatnonzero(np.abs(left[0] - right[0]) <= radius)
    for a, b in zip(left[1:], right[1:], strict=True):
        alive = alive[np.abs(a[alive] - b[alive]) <= radius]
    return alive


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_small(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links inside runs of equal keys, which are sorted by the first pivot distance."""
    tab = pivot_table(fps, refs)
    order = np.lexsort((tab[0], keys))
    keys, fps, tab = keys[order], fps[order], tab[:, order]
    first = tab[0]
    for gap in range(1, len(keys)):
        near = np.flatnonzero((keys[gap:] == keys[:-gap]) & (first[gap:] - first[:-gap] <= radius))
        if not len(near):
            return
        alive = near[_survivors(tab[1:, near], tab[1:, near + gap], radius)]
        alive = alive[np.bitwise_count(fps[alive] ^ fps[alive + gap]) <= radius]
        yield from zip(fps[alive + gap].view(np.int64).tolist(), fps[alive].view(np.int64).tolist(), strict=True)


def link_large(fps: np.ndarray, radius: int, own: int = 32) -> Iterator[tuple[int, int]]:
    """Links inside one large block as stars.

    The references are fingerprints of the block itself, so a distance within the radius is a
    link; pairs that links already join need no look. What is left is discarded by the largest
    coordinate difference, and survivors are compared.
    """
    fps = np.unique(fps)
    n = len(fps)
    union, tab = Union(n), []
    label = np.arange(n)
    for _ in range(own):
        loose = np.flatnonzero(label == np.arange(n))  # a fingerprint for each component so far
        if len(loose) <= 1:
            break
        at = int(loose[len(tab) % len(loose)])
        row = np.bitwise_count(fps ^ fps[at]).astype(np.int8)
        tab.append(row)
        for j in np.flatnonzero(row <= radius).tolist():
            union.join(at, j)
        label = np.fromiter(map(union.find, range(n)), np.int64, n)
    if np.any(label != label[0]):
        tab = np.stack(tab)
        order = np.argsort(tab[0], kind="stable")
        tab, fp, first = tab[:, order], fps[order], tab[0][order].astype(np.int16)
        lab = label[order]
        stop = np.searchsorted(first, first + radius, side="right")
        for i in range(n - 1):
            window = np.arange(i + 1, stop[i])
            window = window[lab[window] != lab[i]]
            for row in tab[1:]:
                if not len(window):
                    break
                window = window[np.abs(row[window] - row[i]) <= radius]
            for j in window[np.bitwise_count(fp[window] ^ fp[i]) <= radius].tolist():
                union.join(int(order[i]), int(order[j]))
                if lab[j] != lab[i]:
                    lab = np.where(lab == lab[j], lab[i], lab)
    signed = fps.view(np.int64)
    for i in range(n):
        if (r := union.find(i)) != i:
            yield int(signed[i]), int(signed[r])


def _link_blocks(batches: Iterator[pa.RecordBatch], radius: int, n_pivots: int, small: int = 64) -> Iterator[pa.RecordBatch]:
    """Links of sorted (key, part, fp) rows; a block may span batches."""
    refs = pivots(n_pivots)

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[edge, len(keys)])
        pairs: list[tuple[int, int]] = []
        size = np.repeat(sizes, sizes)
        some = (size > 1) & (size <= small)
        if some.any():
            pairs += link_small(keys[some], fps[some], refs, radius)
        for s, n in zip(edge[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            pairs += link_large(fps[s : s + n], radius)
        return out(list(dict.fromkeys(pairs)))

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, fps = np.r_[keys, k], np.r_[fps, f]
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1])) if np.all(keys[1:] >= keys[:-1]) else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield done(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield done(keys, fps)


def links(nodes: DataFrame, n: int | None = None, radius: int = RADIUS, block_rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of nodes(fp), enough to join all that link."""
    widths = bands(nodes.count() if n is None else n, radius)
    starts = [0, *accumulate(widths)]
    sets = list(combinations(range(len(widths)), len(widths) - radius))

    def key(n: int, chosen: tuple[int, ...]):
        """The number of the set above the bits of its bands, which is exact, not a hash."""
        out = F.lit(n).cast("long")
        for i in chosen:
            bits = F.shiftrightunsigned(F.col("fp"), starts[i]).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))
            out = F.shiftleft(out, widths[i]).bitwiseOR(bits)
        return out

    keyed = nodes.select("fp", F.explode(F.array(*[key(n, s) for n, s in enumerate(sets)])).alias("key"))
    hot = settle(keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > block_rows), "simhash-hot")
    if not hot.isEmpty():
        both = join_groups(keyed, hot, "key", "c").withColumn("parts", F.coalesce(F.ceil(F.col("c") / block_rows), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        dealt = both.select("key", "fp", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        part = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        keyed = dealt.select(F.when(F.col("parts") == 1, F.col("key")).otherwise(part).alias("key"), "fp")
    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(lambda batches: _link_blocks(batches, radius, n_pivots), "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: key, id, fp (signed long), component_id (smallest id reachable), kept.

    docs and key are what common.keyed() gives; exactly one row of each component is kept.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = settle(fingerprints(slim), "simhash")
    first = F.struct(F.col("id").isNull().alias("nil"), "id", "key")
    nodes = settle(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("c")), "simhash-nodes")
    edges = settle(links(nodes.select("fp"), nodes.count(), radius), "simhash-links")
    member = settle(components(edges, "simhash-cc"), "simhash-members")
    rooted = settle(nodes.join(member, nodes.fp == member.node, "left").select("fp", "first", "c", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    release(edges, member, nodes)
    lowest = settle(rooted.groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("fps")), "simhash-lowest")
    named = settle(join_groups(rooted, lowest, "root", "fps").select("fp", "c", "low"), "simhash-named")
    release(rooted, lowest)
    joined = join_groups(rows, named, "fp", "c")
    return joined.select("key", "id", "fp", F.col("low.id").alias("component_id"), (F.col("low.key") == F.col("key")).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, all columns as they were."""
    rows, key = keyed(docs)
    return drop_rows(rows, key, near_duplicates(rows, key, id_col, text_col, radius).where("not kept").select("key"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(*keyed(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
