"""Assignment round after round with bounds kept in the state, so that most distances to moved centers are not computed.

The state is (id, x, a1, d1, lb): the nearest center, the exact distance to it, and lower bounds on distances to the other
centers, one for each group of centers. When centers move, a bound falls by the largest move in its group; a group is
looked into only by those rows whose bound does not exceed d1. Yinyang has several groups. Exponion has one bound and looks
into the centers around a row's own, in order of their distance from it, up to twice d1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..session import settled
from .assign import Centers

STATE = "id long, x array<double>, a1 int, d1 double, lb array<double>"
#: Centers in a group of yinyang, on average.
IN_GROUP = 9
#: Bounds are used with so much room for rounding, against the size of the numbers.
ROOM = 1e-9


def name_of(algorithm: str, width: int) -> str:
    """The algorithm that `auto` stands for: exponion in few dimensions, else yinyang."""
    if algorithm not in ("standard", "yinyang", "exponion", "auto"):
        raise ValueError(f"no refinement named {algorithm!r}; there are standard, yinyang, exponion and auto")
    return ("exponion" if width < 5 else "yinyang") if algorithm == "auto" else algorithm


class Yinyang:
    """Groups of centers that stay as they are; bounds of the others are exact when their group was looked into."""

    def __init__(self, c: np.ndarray, metric: Metric):
        self.metric = metric
        many = max(1, len(c) // IN_GROUP)
        picked, near, home = [0], metric.kernel(c, c[:1])[:, 0], np.zeros(len(c), int)
        while len(picked) < many and near.max() > 0:
            picked.append(int(near.argmax()))
            d = metric.kernel(c, c[picked[-1:]])[:, 0]
            home[d < near] = len(picked) - 1
            near = np.minimum(near, d)
        self.home = home
        self.groups = [np.flatnonzero(home == g) for g in range(len(picked))]

    def moved(self, moves: np.ndarray) -> np.ndarray:
        return np.array([moves[g].max() for g in self.groups])

    def prepare(self, c: np.ndarray) -> None:
        """What all blocks of a round share."""
        self.c = c

    def first(self, x):
        d = self.metric.kernel(x, self.c)
        a1 = d.argmin(1)
        at = np.arange(len(x))
        d1 = d[at, a1]
        d[at, a1] = np.inf
        return a1, d1, np.stack([d[:, g].min(1) for g in self.groups], 1), d.size

    def step(self, x, a1, lb):
        """a1, d1, lb and the distances computed; lb comes lowered by the moves."""
        n, at = len(x), np.arange(len(x))
        d1 = _own(self.metric, x, self.c, a1)
        count = n
        near, best = d1.copy(), a1.copy()
        open_ = lb <= d1[:, None] * (1 + ROOM)
        least = np.full(lb.shape, np.inf)
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(open_[:, g])
            if not len(rows):
                continue
            d = self.metric.kernel(x[rows], self.c[members])
            count += d.size
            one = d.argmin(1)
            first = d[np.arange(len(rows)), one]
            d[np.arange(len(rows)), one] = np.inf
            second = d.min(1)
            better = (first < near[rows]) | ((first == near[rows]) & (members[one] < best[rows]))
            # what stays behind in this group: its second if its first is (or becomes) the nearest center, else its first
            mine = better | (members[one] == best[rows])
            least[rows, g] = np.where(mine, second, first)
            # the center that is nearest no more stays behind in its own group
            lost = rows[better & (members[one] != best[rows])]
            left = self.home[best[lost]]
            least[lost, left] = np.minimum(least[lost, left], near[lost])
            lb[lost, left] = np.minimum(lb[lost, left], near[lost])
            near[rows], best[rows] = np.where(better, first, near[rows]), np.where(better, members[one], best[rows])
        lb = np.where(open_, least, lb)
        return best, near, lb, count


class Exponion:
    """One bound; centers around each center in order of distance."""

    groups = (None,)

    def __init__(self, c: np.ndarray, metric: Metric):
        self.metric = metric

    def moved(self, moves: np.ndarray) -> np.ndarray:
        return np.array([moves.max()])

    def prepare(self, c: np.ndarray) -> None:
        self.c = c
        between = self.metric.kernel(c, c)
        self.order = np.argsort(between, 1, kind="stable")
        self.far = np.take_along_axis(between, self.order, 1)

    def first(self, x):
        d = self.metric.kernel(x, self.c)
        a1 = d.argmin(1)
        at = np.arange(len(x))
        d1 = d[at, a1]
        d[at, a1] = np.inf
        return a1, d1, d.min(1)[:, None], d.size

    def step(self, x, a1, lb):
        d1 = _own(self.metric, x, self.c, a1)
        count, lb = len(x), lb[:, 0].copy()
        near, best = d1.copy(), a1.copy()
        todo = np.flatnonzero(lb <= d1 * (1 + ROOM))
        for k in np.unique(a1[todo]):
            rows = todo[a1[todo] == k]
            # centers farther than this from the row's own are farther from the row than its own
            many = np.searchsorted(self.far[k], 2 * d1[rows] * (1 + ROOM), "right")
            second = np.full(len(rows), np.inf)
            done, size = 0, 4
            seen = np.zeros(len(rows), int)
            while True:
                on = np.flatnonzero(many > done)
                if not len(on):
                    break
                some = self.order[k][done : done + size]
                d = self.metric.kernel(x[rows[on]], self.c[some])
                count += d.size
                seen[on] = done + len(some)
                for j, center in enumerate(some):
                    if center == k:
                        continue
                    v, r = d[:, j], rows[on]
                    better = (v < near[r]) | ((v == near[r]) & (center < best[r]))
                    second[on] = np.where(better, near[r], np.minimum(second[on], v))
                    near[r], best[r] = np.where(better, v, near[r]), np.where(better, center, best[r])
                done, size = done + size, size * 2
            # the own center, where another has become nearest, was kept as second; the rest stand behind the annulus
            beyond = np.r_[self.far[k], np.inf][np.minimum(seen, len(self.c))] - d1[rows]
            lb[rows] = np.minimum(second, beyond)
        return best, near, lb[:, None], count


def _own(metric: Metric, x, c, a1) -> np.ndarray:
    """Distance of each row to its own center."""
    out = np.empty(len(x))
    for k in np.unique(a1):
        rows = np.flatnonzero(a1 == k)
        out[rows] = metric.kernel(x[rows], c[k : k + 1])[:, 0]
    return out


class BoundedRefinement:
    """The assignment of dense samples (id, x) to centers that move. Each round's table is written anew and the one before
    deleted by its caller. Null vectors, and those with NaN, have no center."""

    def __init__(self, samples: DataFrame, c: np.ndarray, metric: str, algorithm: str):
        self.metric, self.c = Metric(metric), c
        self.kind = (Yinyang if algorithm == "yinyang" else Exponion)(c, self.metric)
        self.n_dist = 0
        self.table = self._round(samples.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")), None)

    def move(self, c: np.ndarray) -> DataFrame:
        """Assign all samples to the moved centers; the table before, for its deletion."""
        pairs = [self.metric.kernel(a[None], b[None])[0, 0] for a, b in zip(self.c, c)]
        falls = self.kind.moved(np.array(pairs))
        before, self.c = self.table, c
        self.table = self._round(before, falls)
        return before

    def _round(self, table: DataFrame, falls) -> DataFrame:
        kind, width = self.kind, self.c.shape[1]
        kind.prepare(self.c)
        counted = table.sparkSession.sparkContext.accumulator(0)
        groups = len(kind.groups)

        def run(batches):
            n = 0
            for batch in batches:
                column = batch.column(1)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                x = np.full((batch.num_rows, width), np.nan)
                flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
                x[valid] = flat.reshape(-1, width)
                sound = np.flatnonzero(~np.isnan(x).any(1))
                a1, d1, lb = np.full(len(x), -1), np.full(len(x), np.nan), np.full((len(x), groups), np.nan)
                if len(sound):
                    if falls is None:
                        found = kind.first(x[sound])
                    else:
                        before = batch.take(pa.array(sound))
                        bounds = before.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, groups) - falls
                        found = kind.step(x[sound], before.column(2).to_numpy(zero_copy_only=False).astype(int), bounds - ROOM * np.abs(bounds))
                    a1[sound], d1[sound], lb[sound] = found[:3]
                    n += found[3]
                none = a1 < 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lb.size + 1, groups), pa.int32()), pa.array(lb.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(a1, pa.int32(), mask=none), pa.array(d1, mask=none), lists], names=["id", "x", "a1", "d1", "lb"])
            counted.add(n)

        out = settled(table.mapInArrow(run, STATE))
        self.n_dist += counted.value
        return out

    def final(self) -> DataFrame:
        """(id, x, a1, d1, a2, d2)."""
        c, metric = self.c, self.metric

        def run(batches):
            near = Centers(c, metric)
            for batch in batches:
                sound = batch.filter(batch.column(2).is_valid())
                x = sound.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, c.shape[1])
                found = near.two_nearest((), x) if len(x) else (np.zeros(0, int), np.zeros(0), None, None)
                two, d2 = (pa.array(found[2], pa.int32()), pa.array(found[3])) if found[2] is not None else (pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.float64()))
                yield pa.RecordBatch.from_arrays([sound.column(0), sound.column(1), pa.array(found[0], pa.int32()), pa.array(found[1]), two, d2], names=["id", "x", "a1", "d1", "a2", "d2"])
                odd = batch.filter(batch.column(2).is_null())
                if odd.num_rows:
                    none = [pa.nulls(odd.num_rows, t) for t in (pa.int32(), pa.float64(), pa.int32(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([odd.column(0), odd.column(1), *none], names=["id", "x", "a1", "d1", "a2", "d2"])

        return settled(self.table.mapInArrow(run, "id long, x array<double>, a1 int, d1 double, a2 int, d2 double"))


def partial_means(state: DataFrame, k: int, width: int) -> dict[int, np.ndarray]:
    """The mean of the samples (a1, x) of each cluster: one row of sums a cluster and task, added up by Spark."""

    def run(batches):
        sums, n = np.zeros((k, width)), np.zeros(k, np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            a1 = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
            np.add.at(sums, a1, batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
            n += np.bincount(a1, minlength=k)
        some = np.flatnonzero(n)
        rows = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["k", "n", "s"])

    parts = state.select("a1", "x").mapInArrow(run, "k int, n long, s array<double>")
    sizes = F.sum("n").alias("n")
    added = parts.groupBy("k").agg(sizes, *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]) if width <= 64 else None
    if added is not None:
        return {r["k"]: np.array([r[f"s{i}"] for i in range(width)]) / r["n"] for r in added.collect()}  # K rows
    long = parts.select("k", "n", F.posexplode("s").alias("pos", "v")).groupBy("k", "pos").agg(F.sum("v").alias("v"), sizes)
    out: dict[int, np.ndarray] = {}
    for r in long.collect():  # K times the width
        out.setdefault(r["k"], np.zeros(width))[r["pos"]] = r["v"] / r["n"]
    return out
