"""K-means from many starts and for many numbers of clusters in the same passes, and silhouettes of what it finds.

A pass reads the points once for all fits. What leaves a task is its sums, whose size is that of the
centres, and no point is shuffled. Centres stand side by side, a column each.

Sparse points are packed once, many to a row. Where many centres are asked at once, they lie close to few
directions: points are multiplied by these, what is left out of a product is bounded by the lengths of the
rests, and where that leaves several centres, the products with these are taken whole. So owners are those
of whole products. Fits agree on most points: a point is added up once for fits whose owners come together.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import storage

STEPS, TOLERANCE = 20, 1e-4
#: Rows whose distances are held at once.
ROWS = 1024
#: Entries, and points, of a packed row: Parquet counts 100 rows before it looks at their size.
PACKED = 1 << 15, 1 << 12
#: Directions are tried in steps of this many; a rest as long as its centre costs as much as the products of this many directions.
DIRECTIONS, REST = 32, 70_000
#: Entries that whole products of chosen pairs take at once.
ENTRIES = 1 << 18


class _Block:
    """Some points: a matrix if all are dense, else the numbers and values of their entries."""

    def __init__(self, features: pa.StructArray, size: int):
        dense = features.field("type").to_numpy() == 1
        values = features.field("values")
        self.n, self.values = len(features), values.flatten().to_numpy(zero_copy_only=False).astype(float)
        each = pc.list_value_length(values).to_numpy()
        self.starts = np.append(0, np.cumsum(each))
        self.matrix = self.values.reshape(self.n, size) if dense.all() else None
        if self.matrix is None:
            self.at = np.empty(len(self.values), np.int32)
            whole = np.repeat(dense, each)
            self.at[~whole] = features.field("indices").flatten().to_numpy(zero_copy_only=False)
            self.at[whole] = np.tile(np.arange(size, dtype=np.int32), int(dense.sum()))
            self.room: np.ndarray | None = None
        self.squares = np.bincount(np.repeat(np.arange(self.n), each), self.values * self.values, self.n)

    @classmethod
    def packed(cls, batch: pa.RecordBatch) -> _Block:
        """The sparse points of packed rows as one block."""
        block = cls.__new__(cls)
        each, block.squares, at, values = (np.frombuffer(b"".join(batch.column(i + 1).to_pylist()), t) for i, t in enumerate((np.int32, float, np.int32, np.float32)))
        block.n, block.at, block.values, block.matrix, block.room = len(each), at.astype(np.int64), values, None, None
        block.starts = np.append(0, np.cumsum(each, dtype=np.int64))
        return block

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Points from low to high that fit a packed row."""
        low = 0
        while low < self.n:
            high = int(np.searchsorted(self.starts, self.starts[low] + PACKED[0], "right")) - 1
            high = max(low + 1, min(high, low + PACKED[1], self.n))
            yield low, high
            low = high

    def chosen(self, rows: np.ndarray, columns: np.ndarray, flat: np.ndarray, size: int) -> np.ndarray:
        """Products of pairs of a point and a centre; flat has the centres, one after the other."""
        out, each = np.zeros(len(rows), flat.dtype), self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(each)
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ENTRIES, "right")))
            part = each[low:high]
            first = np.cumsum(part) - part
            place = np.arange(part.sum()) + np.repeat(self.starts[rows[low:high]] - first, part)
            products = flat.take(self.at[place] + np.repeat(columns[low:high] * size, part)) * self.values[place]
            some = part > 0
            if some.any():
                out[low:high][some] = np.add.reduceat(products, first[some])
            low = high
        return out

    def dot(self, columns: np.ndarray, low: int, high: int) -> np.ndarray:
        """Products of the points from low to high with each column."""
        if self.matrix is not None:
            return self.matrix[low:high] @ columns
        out = np.empty((high - low, columns.shape[1]), columns.dtype)
        if self.room is None or self.room.shape[1] != columns.shape[1]:
            self.room = np.empty((int(np.diff(self.starts).max(initial=0)), columns.shape[1]), columns.dtype)
        values = self.values.astype(columns.dtype, copy=False)
        for i in range(low, high):
            a, b = self.starts[i], self.starts[i + 1]
            np.take(columns, self.at[a:b], axis=0, out=self.room[: b - a], mode="clip")
            np.dot(values[a:b], self.room[: b - a], out=out[i - low])
        return out

    def add(self, sums: np.ndarray, owners: np.ndarray) -> None:
        """Adds each point of a dense block to the row of its cluster in each fit."""
        for low in range(0, self.n, ROWS):
            part = owners[low : low + ROWS]
            own = np.zeros((len(part), len(sums)))
            own[np.arange(len(part))[:, None], part] = 1.0
            sums += own.T @ self.matrix[low : low + ROWS]

    def row(self, i: int, size: int) -> np.ndarray:
        out, (a, b) = np.zeros(size), self.starts[i : i + 2]
        out[slice(None) if self.matrix is not None else self.at[a:b]] = self.values[a:b]
        return out


class _Centres:
    """Centres of fits as tasks get them: a column each, or, where few directions nearly hold all, these, the weights and the rests."""

    def __init__(self, fits: list[np.ndarray], size: int, kind: type, whole: bool = False):
        rows = np.ascontiguousarray(np.concatenate(fits) if fits else np.zeros((0, size)), kind)
        self.size, self.cuts = size, np.append(0, np.cumsum([len(f) for f in fits])).astype(int)
        self.norms = np.sum(np.square(rows, dtype=float), axis=1)
        self.basis = None if whole else self._directions(rows)
        if self.basis is None:
            self.columns = np.ascontiguousarray(rows.T)
            return
        self.weights = self.basis.T @ rows.T
        self.flat, self.lengths = rows.ravel(), np.sqrt(self.norms)
        self.rests = np.sqrt(sum(np.square(rows[:, i : i + 1024] - self.weights.T @ self.basis[i : i + 1024].T, dtype=float).sum(axis=1) for i in range(0, size, 1024)))

    def _directions(self, rows: np.ndarray) -> np.ndarray | None:
        """Orthogonal columns that nearly hold the centres; none where they are too many to pay."""
        most = min(len(rows) // 2, self.size // 2)
        if rows.dtype != np.float32 or most < DIRECTIONS:
            return None
        spans, vectors = np.linalg.eigh((rows @ rows.T).astype(float))
        order = np.argsort(-spans)
        held = np.cumsum(np.square(vectors[:, order]) * np.maximum(spans[order], 0.0), axis=1)
        tried = range(DIRECTIONS, most + 1, DIRECTIONS)
        costs = [n + REST * np.sqrt(np.maximum(self.norms - held[:, n - 1], 0.0)).mean() / np.sqrt(self.norms.mean()) for n in tried]
        if not min(costs) < len(rows):
            return None
        return np.ascontiguousarray(np.linalg.qr(rows.T @ vectors[:, order[: tried[int(np.argmin(costs))]]].astype(rows.dtype))[0])

    def owners(self, block: _Block, low: int, high: int) -> np.ndarray:
        """Of each fit the column that is nearest to each point, by directions; of what they leave open, by whole products."""
        cuts, each = self.cuts[:-1], np.diff(self.cuts)
        inside, squares = block.dot(self.basis, low, high), block.squares[low:high]
        far = inside @ self.weights
        far *= -2.0
        far += self.norms.astype(np.float32)
        outside = np.sqrt(np.maximum(squares - np.sum(np.square(inside, dtype=float), axis=1), 0.0) + 1e-5 * squares)
        # what is left out, and what single precision may add
        error = np.outer((2.0 * outside).astype(np.float32), self.rests.astype(np.float32))
        error += np.outer((2e-5 * np.sqrt(squares)).astype(np.float32), self.lengths.astype(np.float32))
        error += (1e-5 * self.norms).astype(np.float32)
        least = np.minimum.reduceat(far + error, cuts, axis=1)
        near = far - error <= np.repeat(least, each, axis=1)
        several = np.add.reduceat(near, cuts, axis=1, dtype=np.int32) > 1
        row, column = np.nonzero(near & np.repeat(several, each, axis=1))
        far[row, column] = self.norms[column] - 2.0 * block.chosen(row + low, column, self.flat, self.size)
        return _least(far, self.cuts)


def _least(far: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.argmin(far[:, a:b], axis=1) + a for a, b in zip(cuts[:-1], cuts[1:], strict=True)], axis=1)


def _nearest(block: _Block, low: int, high: int, c: _Centres) -> tuple[np.ndarray, np.ndarray]:
    """(owners, squares): of each fit the nearest column and its squared distance."""
    far = c.norms - 2.0 * block.dot(c.columns, low, high)
    owners = _least(far, c.cuts)
    return owners, np.maximum(np.take_along_axis(far, owners, axis=1) + block.squares[low:high, None], 0.0)


class _Together:
    """Sums of sparse points for some fits: by combinations of owners that come often, by each owner for the rest."""

    def __init__(self, low: int, high: int, room: int, size: int):
        self.fits, self.room, self.size = slice(low, high), room, size
        self.salts = np.random.default_rng(0).integers(1, 1 << 63, high - low).astype(np.uint64)
        self.codes, self.owners, self.sums = np.empty(0, np.uint64), np.empty((0, high - low), int), np.zeros((room, size))

    def _places(self, codes: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """The number of each point's combination, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        order = np.argsort(self.codes)
        place = order[np.minimum(np.searchsorted(self.codes, codes, sorter=order), len(order) - 1)]
        return np.where((self.codes[place] == codes) & (self.owners[place] == owners).all(axis=1), place, -1)

    def add(self, block: _Block, values: np.ndarray, owners: np.ndarray, total: np.ndarray) -> None:
        own, each = owners[:, self.fits], np.diff(block.starts)
        codes = (own.astype(np.uint64) * self.salts).sum(axis=1, dtype=np.uint64)
        place = self._places(codes, own)
        if len(self.codes) < self.room and (place < 0).any():
            new = np.flatnonzero(place < 0)
            _, first, n = np.unique(codes[new], return_index=True, return_counts=True)
            first = new[first[np.argsort(-n, kind="stable")[: self.room - len(self.codes)]]]
            fresh = first[~np.isin(codes[first], self.codes)]
            self.codes, self.owners = np.append(self.codes, codes[fresh]), np.concatenate([self.owners, own[fresh]])
            place = self._places(codes, own)
        cells = np.repeat(place * self.size, each) + block.at
        left = place < 0
        if not left.any():
            np.add.at(self.sums.reshape(-1), cells, values)
        else:
            open_ = np.repeat(left, each)
            np.add.at(self.sums.reshape(-1), cells[~open_], values[~open_])
            rest, at = values[open_], block.at[open_]
            for column in own[left].T:
                np.add.at(total.reshape(-1), np.repeat(column * self.size, each[left]) + at, rest)

    def told(self, total: np.ndarray) -> None:
        """Adds the sums of combinations to those of their owners."""
        if not len(self.codes):
            return
        low, many = self.owners.min(), len(self.codes)
        own = np.zeros((self.owners.max() + 1 - low, many))
        own[self.owners - low, np.arange(many)[:, None]] = 1.0
        for i in range(0, self.size, ROWS):
            total[low : low + len(own), i : i + ROWS] += own @ self.sums[:many, i : i + ROWS]
        self.sums = np.zeros((0, self.size))


def _together(owners: np.ndarray, cuts: np.ndarray, size: int) -> list[_Together]:
    """Neighbouring fits whose combinations of owners in some points are not many more than their clusters."""
    out, start, code = [], 0, np.zeros(len(owners), int)
    room = lambda end: 3 * int(cuts[end] - cuts[start]) // 2 + DIRECTIONS
    for n in range(owners.shape[1]):
        kinds, joint = np.unique(code * int(cuts[-1]) + owners[:, n], return_inverse=True)
        if n > start and len(kinds) > room(n + 1):
            out.append(_Together(start, n, room(n), size))
            start, (_, joint) = n, np.unique(owners[:, n], return_inverse=True)
        code = joint
    return [*out, _Together(start, owners.shape[1], room(owners.shape[1]), size)]


class Points:
    """points(features, and other columns that tell them apart) as passes read them; fits are kept for who asks again."""

    def __init__(self, points: DataFrame):
        self.spark = points.sparkSession
        storage.bounded(self.spark)
        others = [c for c in points.columns if c != "features"]
        self.rows = points.select(F.xxhash64(*others).alias("hash") if others else F.monotonically_increasing_id().alias("hash"), "features")
        self.rows = self.rows.coalesce(self.spark.sparkContext.defaultParallelism)
        first = self.rows.first().features
        self.size, self.kind = len(first), (np.float64 if hasattr(first, "array") else np.float32)
        self.found: dict[tuple[int, int], Model] = {}
        self.sent: list = []
        if self.kind is np.float32:
            self.rows = self._packed()

    def _packed(self) -> DataFrame:
        """(hashes, each, squares, at, values) of some sparse points a row, which stand as long as these points are asked."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    block, hashes = _Block(batch.column(1), size), batch.column(0).to_numpy()
                    at = np.tile(np.arange(size, dtype=np.int32), block.n) if block.matrix is not None else block.at
                    each, values = np.diff(block.starts).astype(np.int32), block.values.astype(np.float32)
                    for low, high in block.pieces():
                        a, b = block.starts[low], block.starts[high]
                        row = hashes[low:high], each[low:high], block.squares[low:high], at[a:b], values[a:b]
                        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["hashes", "each", "squares", "at", "values"])

        with storage.kept():
            out = storage.settle(self.rows.mapInArrow(run, "hashes binary, each binary, squares binary, at binary, values binary"), "points")
        weakref.finalize(self, storage.release, out).atexit = False
        return out.coalesce(self.spark.sparkContext.defaultParallelism)

    def done(self) -> None:
        """Centres that were sent for a pass are not read again."""
        for at in self.sent:
            at.destroy()
        self.sent.clear()

    def over(self, fits: list[np.ndarray], fn: Callable[..., Iterator[pa.RecordBatch]], schema: str, whole: bool = True) -> DataFrame:
        """fn(blocks with hashes, centres) over the points of each task; fits are centres, a row each, sent whole or by directions too."""
        at = self.spark.sparkContext.broadcast(_Centres(fits, self.size, self.kind, whole))
        self.sent.append(at)
        size, packed = self.size, self.kind is np.float32

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if packed:
                blocks = ((_Block.packed(b), np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64)) for b in batches if b.num_rows)
            else:
                blocks = ((_Block(b.column(1), size), b.column(0).to_numpy()) for b in batches if b.num_rows)
            yield from fn(blocks, at.value)

        return self.rows.mapInArrow(run, schema)

    def sums(self, fits: list[np.ndarray]) -> list[tuple]:
        """(cost, counts, squares, sums) of each fit: of its clusters the points, their squares and, a row each, what they add up to."""
        size, kind, names = self.size, self.kind, ["fit", "cost", "counts", "squares", "sums"]

        def told(blocks, c):
            cuts, wide = c.cuts, int(c.cuts[-1])
            total, groups = np.zeros((wide, size)), None
            counts, squares, costs = np.zeros(wide), np.zeros(wide), np.zeros(len(cuts) - 1)
            for block, _ in blocks:
                parts = [(low, min(block.n, low + ROWS)) for low in range(0, block.n, ROWS)]
                if c.basis is None:
                    near = [_nearest(block, low, high, c) for low, high in parts]
                    owners = np.concatenate([own for own, _ in near])
                    costs += sum(far.sum(axis=0) for _, far in near)
                else:
                    owners = np.concatenate([c.owners(block, low, high) for low, high in parts])
                counts += np.bincount(owners.ravel(), minlength=wide)
                squares += np.bincount(owners.ravel(), np.repeat(block.squares, len(cuts) - 1), wide)
                if block.matrix is not None:
                    block.add(total, owners)
                    continue
                groups = groups or _together(owners, cuts, size)
                values = block.values.astype(float)
                for group in groups:
                    group.add(block, values, owners, total)
            for group in groups or ():
                group.told(total)
            for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                own = total[a:b].astype(kind).tobytes()
                cost = costs[n] if c.basis is None else (squares[a:b] + counts[a:b] * c.norms[a:b]).sum() - 2.0 * np.sum(total[a:b] * c.flat.reshape(wide, size)[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([cost]), *(pa.array([x.tobytes()], pa.binary()) for x in (counts[a:b], squares[a:b])), pa.array([own], pa.binary())], names)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every: dict[int, list] = {}
            for batch in batches:
                for fit, cost, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = [np.float64(cost), np.frombuffer(rest[0]), np.frombuffer(rest[1]), np.frombuffer(rest[2], kind).astype(float)]
                    every[fit] = [x + y for x, y in zip(every[fit], own, strict=True)] if fit in every else own
            for fit, (cost, *rest, sums) in every.items():
                yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([cost]), *(pa.array([x.tobytes()], pa.binary()) for x in (*rest, sums.astype(kind)))], names)

        schema = "fit int, cost double, counts binary, squares binary, sums binary"
        parts = min(len(fits), self.spark.sparkContext.defaultParallelism)
        out: list = [None] * len(fits)
        table = self.over(fits, told, schema, whole=False).repartition(parts, "fit").mapInArrow(added, schema).toArrow()
        self.done()
        for fit, cost, *rest in zip(*(table.column(n) for n in names), strict=True):
            counts, squares, sums = (np.frombuffer(x.as_buffer(), t) for x, t in zip(rest, (float, float, kind), strict=True))
            out[fit.as_py()] = cost.as_py(), counts, squares, sums.reshape(len(counts), size)
        return out

    def chains(self, length: int, seeds: Sequence[int]) -> list[np.ndarray]:
        """Starts of each seed by k-means++: a point is drawn in proportion to its squared distance from those before it.

        Each point draws a time from its hash, and the earliest of all is taken, whatever task it is in. The first k
        points are a start of k clusters. A chain ends where all points lie on it.
        """
        size = self.size
        found: list[list[np.ndarray]] = [[] for _ in seeds]
        for step in range(length):
            live = [i for i, f in enumerate(found) if len(f) == step]
            salts = [np.uint64((seeds[i] * 1_000_003 + step) % (1 << 64)) for i in live]

            def drawn(blocks, c, live=live, salts=salts, step=step):
                best: dict[int, tuple[float, np.ndarray]] = {}
                for block, hashes in blocks:
                    for low in range(0, block.n, ROWS):
                        high = min(block.n, low + ROWS)
                        far = _nearest(block, low, high, c)[1] if step else np.ones((high - low, len(live)))
                        far[far <= 1e-6 * np.maximum(1.0, block.squares[low:high, None])] = 0.0
                        for n, i in enumerate(live):
                            with np.errstate(divide="ignore"):
                                times = -np.log(_uniform(hashes[low:high], salts[n])) / far[:, n]
                            at = int(np.argmin(times))
                            if np.isfinite(times[at]) and (i not in best or times[at] < best[i][0]):
                                best[i] = float(times[at]), block.row(low + at, size)
                for i, (time, row) in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([time]), pa.array([row.tobytes()], pa.binary())], ["chain", "time", "point"])

            if live:
                got = self.over([np.stack(found[i]) for i in live] if step else [], drawn, "chain int, time double, point binary")
                for r in got.groupBy("chain").agg(F.min_by("point", "time").alias("point")).toLocalIterator():
                    found[r.chain].append(np.frombuffer(bytes(r.point)))
                self.done()
        return [np.stack(f) for f in found]

    def fit(self, ks: Sequence[int], seeds: Sequence[int]) -> None:
        """Finds a model for each k and seed that is not there yet, all in the same passes."""
        asked = [(k, s) for k in ks for s in seeds if (k, s) not in self.found]
        if not asked:
            return
        starts = dict(zip(seeds, self.chains(max(k for k, _ in asked), seeds), strict=True))
        now = {(k, s): starts[s][:k] for k, s in asked}
        live = list(asked)
        for _ in range(STEPS):
            moving = []
            for at, (_, counts, _, sums) in zip(live, self.sums([now[at] for at in live]), strict=True):
                own = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1.0)[:, None], now[at])
                if np.sum((own - now[at]) ** 2, axis=1).max() > TOLERANCE**2:
                    moving.append(at)
                now[at] = own
            live = moving
            if not live:
                break
        for at, (cost, *sums) in zip(asked, self.sums([now[at] for at in asked]), strict=True):
            self.found[at] = Model(now[at], float(cost), self, tuple(sums))

    def silhouettes(self, models: Sequence[Model]) -> list[float | None]:
        """The mean silhouette over squared distances of each model; none where all points are in one cluster."""
        fits = [m.centers for m in models]
        counts, squares, sums = (np.concatenate(x) for x in zip(*(m.sums for m in models), strict=True))
        means = sums / np.maximum(counts, 1.0)[:, None]
        spread = np.where(counts > 0, squares / np.maximum(counts, 1.0), np.inf)
        middle = self.spark.sparkContext.broadcast(np.ascontiguousarray(means.T, self.kind))

        def told(blocks, c):
            cuts = c.cuts
            total = np.zeros(len(cuts) - 1)
            for block, _ in blocks:
                for low in range(0, block.n, ROWS):
                    high = min(block.n, low + ROWS)
                    owners, _ = _nearest(block, low, high, c)
                    apart = np.maximum(block.squares[low:high, None] + spread - 2.0 * block.dot(middle.value, low, high), 0.0)
                    own = np.take_along_axis(apart, owners, axis=1)
                    np.put_along_axis(apart, owners, np.inf, axis=1)
                    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        many = counts[owners[:, n]]
                        inner, outer = own[:, n] * many / np.maximum(many - 1.0, 1.0), apart[:, a:b].min(axis=1)
                        most = np.maximum(inner, outer)
                        valid = (many > 1) & np.isfinite(outer) & (most > 0)
                        total[n] += ((outer - inner)[valid] / most[valid]).sum()
            for n, x in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([x])], ["fit", "total"])

        rows = {r.fit: r.total for r in self.over(fits, told, "fit int, total double").groupBy("fit").agg(F.sum("total").alias("total")).toLocalIterator()}
        self.done()
        middle.destroy()
        return [rows[n] / m.sums[0].sum() if np.count_nonzero(m.sums[0]) > 1 else None for n, m in enumerate(models)]


def _uniform(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Numbers between 0 and 1 by a mix of the hash of a row and a salt."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + (salt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54


@dataclass(frozen=True)
class Model:
    """Centres, a row each, the sum of squared distances to them, the points they were found on, and (counts, squares, sums) of clusters."""

    centers: np.ndarray
    cost: float
    points: Points
    sums: tuple[np.ndarray, ...]

    def transform(self, points: DataFrame) -> DataFrame:
        """The other columns of points, and the number of the nearest centre as prediction."""
        kept, kind = [c for c in points.columns if c != "features"], self.points.kind
        centres = _Centres([self.centers], self.points.size, kind, whole=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = _Block(batch.column(len(kept)), centres.size)
                own = [_nearest(block, low, min(block.n, low + ROWS), centres)[0][:, 0] for low in range(0, block.n, ROWS)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate([np.empty(0, int), *own]), pa.int32())], [*kept, "prediction"])

        schema = points.select(*kept).schema.add("prediction", T.IntegerType())
        return points.select(*kept, "features").mapInArrow(run, schema)

    def totals(self) -> np.ndarray:
        """What the points of each cluster add up to, a row each."""
        return self.sums[2].astype(float)
