"""Mutual information by nearest neighbours over series of any length, across tasks.

Points are dealt over cells of a plane: strips of one axis, cut along the other, with cuts from a bounded sample. Within its
cell a point finds k neighbours in a tree, which bound the distance to its k-th one of all; only cells that a square of that
size meets are asked for nearer ones. How many values of each axis lie within that distance is read from ranges of the values:
a point counts in the range of its own value, and asks others only where its bounds lie in them. The points of a cell or range
travel together, in arrays. What no task holds is a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.operators.selection import digamma
from barlume.plans.staging import staged

SHRINK = 1 - 1e-9  # a bound is not reached by the neighbour that sets it, whatever the rounding
TOGETHER = 1 << 17  # rows that are packed at once
LEAF = 32


def noise(row: Column, seed: int) -> Column:
    """A normal number that depends on the row and the seed alone."""
    part = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), row), 11) / F.lit(2.0**53)
    return F.sqrt(-2 * F.ln(F.greatest(part(0), F.lit(1e-300)))) * F.cos(2 * math.pi * part(1))


# ---- rows that travel in arrays


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All values of a column of arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def each(b: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    """Rows with the given columns, arrays as numpy arrays."""
    for part in b.to_batches() if isinstance(b, pa.Table) else [b]:
        for i in range(part.num_rows):
            yield tuple(v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py() for v in (part.column(c)[i] for c in names))


def record(names: str, *columns) -> pa.RecordBatch:  # noqa: ANN002
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def one(values: np.ndarray) -> pa.ListArray:
    """A column of one row that is an array."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def by_key(keys: np.ndarray, *values: np.ndarray) -> list:
    """The different keys in rising order, and for each of values a column with the array of each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
    return [keys[starts], *[pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in values]]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of some TOGETHER rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sample(points: DataFrame, n: int, rows: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """x and y of about so many of n points (row, x, y), dealt by a hash, or all if there are fewer."""
    points = points.select("row", "x", "y")
    some = points if n <= rows else points.filter(F.shiftrightunsigned(F.xxhash64("row", "x", "y"), 11) / F.lit(2.0**53) < rows / n).limit(2 * rows)
    t = some.select("x", "y").toArrow()
    return t["x"].to_numpy(), t["y"].to_numpy()


def dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """df by keys, of which there are so many groups: over some tasks a core, as groups take long for their size."""
    return df.repartition(max(1, min(groups, 4 * df.sparkSession.sparkContext.defaultParallelism)), *keys)


# ---- neighbours


class Tree:
    """Points in leaves of one size: halves by the wider side, level by level. What fills the last leaves is infinitely far.

    Along a side, values within 1/1024 of it count as equal and go by the other side: values that noise alone parts would else
    be cut into slabs that all cover the same places.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: int = LEAF):
        n, self.levels = len(x), max(0, math.ceil(math.log2(max(1, len(x)) / leaf)))
        self.size = max(leaf, -(-n >> self.levels))
        far = np.full((self.size << self.levels) - n, np.inf)
        x, y, at, self.boxes = np.append(x, far), np.append(y, far), np.arange(n + len(far)), []
        for level in range(self.levels + 1):
            x, y, at = (v.reshape(1 << level, -1) for v in (x, y, at))
            x0, y0, x1, y1 = x.min(1), y.min(1), np.where(x < np.inf, x, -np.inf).max(1), np.where(y < np.inf, y, -np.inf).max(1)
            self.boxes.append((x0, x1, y0, y1))
            if level < self.levels:
                turn = (x1 - x0 >= y1 - y0)[:, None]
                side = lambda a, a0, a1, steps: (a - a0[:, None]) * (steps / np.where(a1 > a0, a1 - a0, 1))[:, None]
                with np.errstate(invalid="ignore"):  # of nodes without points
                    along = lambda a, a0, a1, b, b0, b1: np.floor(side(a, a0, a1, 1024)) + side(b, b0, b1, 0.999)
                    key = np.where(turn, along(x, x0, x1, y, y0, y1), along(y, y0, y1, x, x0, x1))
                order = np.argpartition(key, x.shape[1] // 2, axis=1)
                x, y, at = (np.take_along_axis(v, order, 1) for v in (x, y, at))
        self.x, self.y, self.at, self.n = x, y, at.ravel(), n

    def gap(self, level: int, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far points are from boxes, by the larger difference; not above 0 inside."""
        x0, x1, y0, y1 = (v[node] for v in self.boxes[level])
        return np.maximum(np.maximum(x0 - x, x - x1), np.maximum(y0 - y, y - y1))

    def distances(self, leaf: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dx, dy = self.x[leaf], self.y[leaf]
        dx -= x[:, None]
        dy -= y[:, None]
        return np.maximum(np.abs(dx, out=dx), np.abs(dy, out=dy), out=dx)

    def own(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of all points, in the order of the leaves, and the k smallest distances of each to others, rising."""
        there = np.flatnonzero(self.at < self.n)
        out = np.empty((len(there), k))
        for start in range(0, len(there), 1 << 11):
            p = there[start : start + (1 << 11)]
            out[start : start + len(p)] = self.search(self.x.ravel()[p], self.y.ravel()[p], np.full(len(p), np.inf), k, p // self.size, p % self.size)
        return self.at[there], out

    def others(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """The k smallest distances of other points, rising, those below bound at least; inf where there are fewer."""
        out = np.empty((len(x), k))
        for start in range(0, len(x), 1 << 11):
            p = slice(start, start + (1 << 11))
            home = np.zeros(len(x[p]), int)
            for level in range(1, self.levels + 1):
                left = self.gap(level, 2 * home, x[p], y[p]) <= self.gap(level, 2 * home + 1, x[p], y[p])
                home = 2 * home + ~left
            out[p] = self.search(x[p], y[p], bound[p], k, home)
        return out

    def search(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray, k: int, home: np.ndarray, itself: np.ndarray | None = None) -> np.ndarray:
        """Distances in the home leaf first, then in the leaves whose boxes are nearer than the k-th so far, in order of their gaps."""
        d = self.distances(home, x, y)
        if itself is not None:
            d[np.arange(len(d)), itself] = np.inf
        best = np.partition(d, k - 1, axis=1)[:, :k].copy()
        reach = np.minimum(bound, best[:, k - 1])
        q, node = np.arange(len(x)), np.zeros(len(x), int)
        gap = np.zeros(len(x))
        for level in range(1, self.levels + 1):
            q, node = np.repeat(q, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            gap = self.gap(level, node, x[q], y[q])
            near = gap < reach[q]
            q, node, gap = q[near], node[near], gap[near]
        other = node != home[q]
        q, node, gap = q[other], node[other], gap[other]
        order = np.lexsort((gap, q))
        q, node, gap = q[order], node[order], gap[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        left = np.diff(np.append(start, len(q)))
        while len(start):
            i = start[gap[start] < reach[q[start]]]
            p = q[i]
            best[p] = np.partition(np.concatenate([best[p], self.distances(node[i], x[p], y[p])], axis=1), k - 1, axis=1)[:, :k]
            reach[p] = np.minimum(reach[p], best[p, k - 1])
            start, left = start[left > 1] + 1, left[left > 1] - 1
        return np.sort(best, axis=1)


class Cells:
    """Strips of x, each cut along y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, side: int):
        at = np.linspace(0, 1, side + 1)[1:-1]
        self.side, self.x = side, np.quantile(x, at) if side > 1 else np.zeros(0)
        strip = np.searchsorted(self.x, x, "right")
        self.y = [np.quantile(y[strip == s], at) if side > 1 and (strip == s).any() else np.zeros(side - 1) for s in range(side)]

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip, out = np.searchsorted(self.x, x, "right"), np.empty(len(x), np.int32)
        for s in np.unique(strip):
            out[strip == s] = s * self.side + np.searchsorted(self.y[s], y[strip == s], "right")
        return out

    def met(self, cell: int, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell) of each other cell that the square around a point of cell meets."""
        s, j = divmod(cell, self.side)
        edge = lambda cuts, i, none: cuts[i] if 0 <= i < len(cuts) else none
        out = (x - r <= edge(self.x, s - 1, -np.inf)) | (x + r >= edge(self.x, s, np.inf)) | (y - r <= edge(self.y[s], j - 1, -np.inf)) | (y + r >= edge(self.y[s], j, np.inf))
        at = np.flatnonzero(out)
        first, last = np.searchsorted(self.x, x[at] - r[at], "left"), np.searchsorted(self.x, x[at] + r[at], "right")
        places, cells = [], []
        for t in range(int(first.min()), int(last.max()) + 1) if len(at) else []:
            p = at[(first <= t) & (t <= last)]
            lo, hi = np.searchsorted(self.y[t], y[p] - r[p], "left"), np.searchsorted(self.y[t], y[p] + r[p], "right")
            many = hi - lo + 1
            places.append(np.repeat(p, many))
            cells.append(t * self.side + np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum()))
        places, cells = (np.concatenate([np.zeros(0, int), *v]) for v in (places, cells))
        return places[cells != cell], cells[cells != cell].astype(np.int32)


def distances(points: DataFrame, k: int, cells: Cells) -> DataFrame:
    """(row, x, y, r) of points (row, x, y), in arrays: a row for each cell."""
    leaf, n = max(LEAF, k + 1), cells.side**2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in together(batches):
            row, x, y = (t.column(c).to_numpy() for c in ("row", "x", "y"))
            yield record("cell row x y", *by_key(cells.of(x, y), row, x, y))

    def inside(key: tuple, t: pa.Table) -> pa.Table:
        row, x, y = (flat(t.column(c)) for c in ("row", "x", "y"))
        at, near = Tree(x, y, leaf).own(k)
        return pa.Table.from_batches([record("cell row x y near", np.array([key[0].as_py()], np.int32), one(row[at]), one(x[at]), one(y[at]), one(near.ravel()))])

    placed = points.select("row", "x", "y").mapInArrow(place, "cell int, row array<bigint>, x array<double>, y array<double>")
    own = staged(dealt(placed, n, "cell").groupBy("cell").applyInArrow(inside, "cell int, row array<bigint>, x array<double>, y array<double>, near array<double>"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, x, y, near in each(b, "cell", "x", "y", "near"):
                r = near[k - 1 :: k]
                at, to = cells.met(cell, x, y, r)
                keys, *asked = by_key(to, at.astype(np.int32), x[at], y[at], r[at])
                yield record("to home at x y r", keys, np.full(len(keys), cell, np.int32), *asked)

    def answer(points: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if points.num_rows and asked.num_rows:
            tree = Tree(flat(points.column("x")), flat(points.column("y")), leaf)
            for home, at, x, y, r in each(asked, "home", "at", "x", "y", "r"):
                near = tree.others(x, y, r, k)
                some = near[:, 0] < r
                out.append(record("home at near", np.array([home], np.int32), one(at[some]), one(near[some].ravel())))
        return pa.Table.from_batches(out, answers)

    def merge(own: pa.Table, more: pa.Table) -> pa.Table:
        out = []
        for row, x, y, near in each(own, "row", "x", "y", "near"):
            best = near.reshape(-1, k).copy()
            for at, found in each(more, "at", "near"):
                best[at] = np.sort(np.concatenate([best[at], found.reshape(-1, k)], axis=1), axis=1)[:, :k]
            out.append(record("row x y r", one(row), one(x), one(y), one(best[:, k - 1])))
        return pa.Table.from_batches(out, results)

    answers = pa.schema([("home", pa.int32()), ("at", pa.list_(pa.int32())), ("near", pa.list_(pa.float64()))])
    results = pa.schema([("row", pa.list_(pa.int64())), *[(c, pa.list_(pa.float64())) for c in ("x", "y", "r")]])
    asked = own.select("cell", "x", "y", "near").mapInArrow(ask, "to int, home int, at array<int>, x array<double>, y array<double>, r array<double>")
    more = dealt(own.select("cell", "x", "y"), n, "cell").groupBy("cell").cogroup(dealt(asked, n, "to").groupBy("to")).applyInArrow(answer, "home int, at array<int>, near array<double>")
    return dealt(own, n, "cell").groupBy("cell").cogroup(dealt(more, n, "home").groupBy("home")).applyInArrow(merge, "row array<bigint>, x array<double>, y array<double>, r array<double>")


def neighbour_distances(points: DataFrame, k: int, cell_rows: int = 65_536, sample_rows: int = 50_000) -> DataFrame:
    """(row, x, y, r) of points (row, x, y): the distance to the k-th neighbour among all. sample_rows bounds what the cuts are taken from; they decide the work alone."""
    n = points.count()
    return distances(points, k, cut(sample(points, n, sample_rows), n, cell_rows)).select(F.inline(F.arrays_zip("row", "x", "y", "r")))


def cut(some: tuple[np.ndarray, np.ndarray], n: int, cell_rows: int) -> Cells:
    return Cells(*some, max(1, round(math.sqrt(n / cell_rows))) if len(some[0]) else 1)


# ---- values of an axis within a distance


def counts(points: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(axis, row, n) of points (row, x, y, r), both in arrays: see counts_within(). cuts deal the values of each axis over ranges."""
    groups = sum(len(c) + 1 for c in cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x, y, r in each(b, "row", "x", "y", "r"):
                for axis, v in enumerate((x, y)):
                    part, *rest = by_key(np.searchsorted(cuts[axis], v, "right").astype(np.int32), row, v, r * SHRINK)
                    yield record("axis part row v near", np.full(len(part), axis, np.int32), part, *rest)

    def inside(key: tuple, t: pa.Table) -> pa.Table:
        row, v, near = (flat(t.column(c)) for c in ("row", "v", "near"))
        order = np.argsort(v, kind="stable")
        row, v, near = row[order], v[order], near[order]
        n = np.searchsorted(v, v + near, "right") - np.searchsorted(v, v - near, "left")
        axis, part = (np.array([k.as_py()], np.int32) for k in key)
        return pa.Table.from_batches([record("axis part row v near n", axis, part, one(row), one(v), one(near), one(n))])

    placed = points.mapInArrow(deal, "axis int, part int, row array<bigint>, v array<double>, near array<double>")
    own = staged(dealt(placed, groups, "axis", "part").groupBy("axis", "part").applyInArrow(inside, "axis int, part int, row array<bigint>, v array<double>, near array<double>, n array<bigint>"))
    before = [np.zeros(len(c) + 2, int) for c in cuts]  # values in the ranges before each
    for r in own.select("axis", "part", F.size("v").alias("n")).collect():
        before[r["axis"]][r["part"] + 1] = r["n"]
    before = [np.cumsum(b) for b in before]

    def ranges(axis: int, v: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges in which the bounds of values lie."""
        return np.searchsorted(cuts[axis], v - near, "right"), np.searchsorted(cuts[axis], v + near, "right")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for axis, part, v, near in each(b, "axis", "part", "v", "near"):
                for upper, to, bound in zip((False, True), ranges(axis, v, near), (v - near, v + near), strict=True):
                    at = np.flatnonzero(to != part)
                    keys, *asked = by_key(to[at].astype(np.int32), at.astype(np.int32), bound[at])
                    full = lambda x, m=len(keys): np.full(m, x, np.int32)
                    yield record("axis to home upper at bound", full(axis), keys, full(part), full(upper), *asked)

    def answer(values: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for axis, v in each(values, "axis", "v"):
            for home, upper, at, bound in each(asked, "home", "upper", "at", "bound"):
                n = np.searchsorted(v, bound, "right") if upper else len(v) - np.searchsorted(v, bound, "left")
                out.append(record("axis home at n", np.array([axis], np.int32), np.array([home], np.int32), one(at), one(n)))
        return pa.Table.from_batches(out, answers)

    def merge(own: pa.Table, more: pa.Table) -> pa.Table:
        out = []
        for axis, part, row, v, near, n in each(own, "axis", "part", "row", "v", "near", "n"):
            low, high = ranges(axis, v, near)
            b = before[axis]  # whole ranges between a bound's and the value's own
            n = n + np.where(low < part, b[part] - b[np.minimum(low + 1, part)], 0) + np.where(high > part, b[np.maximum(high, part + 1)] - b[part + 1], 0)
            for at, m in each(more, "at", "n"):
                n[at] += m
            out.append(record("axis row n", np.array([axis], np.int32), one(row), one(n)))
        return pa.Table.from_batches(out, results)

    answers = pa.schema([("axis", pa.int32()), ("home", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    results = pa.schema([("axis", pa.int32()), ("row", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    asked = own.select("axis", "part", "v", "near").mapInArrow(ask, "axis int, to int, home int, upper int, at array<int>, bound array<double>")
    more = dealt(own.select("axis", "part", "v"), groups, "axis", "part").groupBy("axis", "part").cogroup(dealt(asked, groups, "axis", "to").groupBy("axis", "to")).applyInArrow(answer, "axis int, home int, at array<int>, n array<bigint>")
    return dealt(own, groups, "axis", "part").groupBy("axis", "part").cogroup(dealt(more, groups, "axis", "home").groupBy("axis", "home")).applyInArrow(merge, "axis int, row array<bigint>, n array<bigint>")


def ranges_of(some: tuple[np.ndarray, np.ndarray], n: int, rows: int) -> list[np.ndarray]:
    """Cuts of each axis into ranges of about so many of n values."""
    at = np.linspace(0, 1, max(1, round(n / rows)) + 1)[1:-1] if len(some[0]) else []
    return [np.quantile(v, at) if len(at) else np.zeros(0) for v in some]


def counts_within(points: DataFrame, range_rows: int = 131_072, sample_rows: int = 50_000) -> DataFrame:
    """(row, axis, n) of points (row, x, y, r): how many values of the axis, its own among them, lie nearer than r."""
    points, n = staged(points), points.count()
    packed = points.mapInArrow(lambda b: (record("row x y r", *[one(t.column(c).to_numpy()) for c in ("row", "x", "y", "r")]) for t in together(b)), "row array<bigint>, x array<double>, y array<double>, r array<double>")
    return counts(packed, ranges_of(sample(points, n, sample_rows), n, range_rows)).select("axis", F.inline(F.arrays_zip("row", "n"))).select("row", "axis", "n")


def large_information(df: DataFrame, row_id: str, features: list[str], target: str, neighbors: int = 3, seed: int = 42, cell_rows: int = 65_536) -> DataFrame:
    """(feature, mi, n): selection.mutual_information() of one group with any number of rows, feature by feature.

    row_id, a whole number, names rows. Rows without the feature or the target do not count; null without more rows than
    neighbours. Values are brought to a spread of 1 and parted by a little noise, which depends on the row and the seed alone; rows may share a name.
    """
    out = []

    def psi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for axis, n in each(b, "axis", "n"):
                yield record("axis s", np.array([axis], np.int32), np.array([digamma(n).sum()]))

    for f in features:
        rows = df.select(F.col(row_id).cast("bigint").alias("row"), F.col(f).cast("double").alias("x"), F.col(target).cast("double").alias("y")).dropna()
        m = rows.agg(F.count("*").alias("n"), *[g(c).alias(f"{k}{c}") for c in ("x", "y") for k, g in (("s", F.stddev_pop), ("m", lambda c: F.avg(F.abs(c))))]).first()
        if m["n"] <= neighbors:
            out.append((f, None, m["n"]))
            continue
        wide = {c: m[f"s{c}"] or 1.0 for c in ("x", "y")}
        level = {c: 1e-10 * max(1.0, m[f"m{c}"] / wide[c]) for c in ("x", "y")}
        points = rows.select("row", *[(F.col(c) / wide[c] + level[c] * noise(F.col("row"), seed + i)).alias(c) for i, c in enumerate(("x", "y"))])
        some = sample(points, m["n"])
        held = counts(distances(points, neighbors, cut(some, m["n"], cell_rows)), ranges_of(some, m["n"], 131_072))
        means = {r["axis"]: r["s"] / m["n"] for r in held.select("axis", "n").mapInArrow(psi, "axis int, s double").groupBy("axis").agg(F.sum("s").alias("s")).collect()}
        fixed = digamma(np.array([m["n"], neighbors]))
        out.append((f, max(0.0, float(fixed[0] + fixed[1] - means[0] - means[1])), m["n"]))
    return df.sparkSession.createDataFrame(out, "feature string, mi double, n bigint")
