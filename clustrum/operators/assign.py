"""Assignment of samples to centers, and statistics of the assignment.

The state of a clustering is one table, (id, x, a1, d1, a2, d2): a sample, its nearest and second-nearest center and
the distances to them. A medoid is a row of its own cluster with d1 = 0. Centers are (k, x), medoids (k, id, x).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edit
from ..functions.energy import Energy
from ..functions.metrics import Metric

STATE = "id long, x array<double>, a1 int, d1 double, a2 int, d2 double"


class Centers:
    """K centers as a matrix, ready to find the two nearest of each row of a block.

    From PRUNE_FROM centers on they are grouped around root(K) pivots of their own (each next one the farthest from those
    before). A group is looked into by those rows only to which it can be nearer than the second-least distance so far:
    no member of it is nearer than the pivot's distance less the group's radius. Of long vectors the dimensions in which the
    centers vary most are looked at first, block by block: a row whose distance in these alone exceeds its limit for all
    members leaves the group early. `n_dist` counts distances begun, `n_dim` the coordinates they took.
    """

    PRUNE_FROM = 64
    #: Shares of the dimensions after which rows may leave, from EARLY_FROM dimensions on.
    EARLY, EARLY_FROM = (0.125, 0.375), 16
    SLACK = 1e-9

    def __init__(self, c: np.ndarray, metric: Metric, own: dict[int, int] | None = None, pruned: bool = True):
        self.c, self.metric, self.own, self.n_dist, self.n_dim = c, metric, own or {}, 0, 0
        self.groups: list[np.ndarray] = []
        if pruned and len(c) >= self.PRUNE_FROM:
            self._group()

    def _group(self) -> None:
        pivots, many = [0], int(np.ceil(len(self.c) ** 0.5))
        near = self.metric.kernel(self.c, self.c[:1])[:, 0]
        home = np.zeros(len(self.c), int)
        while len(pivots) < many and near.max() > 0:
            pivots.append(int(near.argmax()))
            d = self.metric.kernel(self.c, self.c[pivots[-1:]])[:, 0]
            home[d < near] = len(pivots) - 1
            near = np.minimum(near, d)
        self.pivots = np.array(pivots)
        self.groups = [np.flatnonzero(home == g) for g in range(len(pivots))]
        self.radius = np.array([near[g].max(initial=0.0) for g in self.groups])
        width = self.c.shape[1]
        order = np.argsort(-self.c.var(0), kind="stable")
        self.early = [order[: int(width * share)] for share in self.EARLY] if width >= self.EARLY_FROM else []

    def two_nearest(self, ids, x: np.ndarray):
        """(index, distance) of the nearest center, and of the second, of the rows of x; the lowest index on ties, but a
        medoid's own center is its nearest. With one center the second are None."""
        if not self.groups:
            return self._all(ids, x)
        one, d1, two, d2 = self._pruned(x)
        if self.own:
            mine = np.flatnonzero(np.isin(ids, list(self.own)))
            if len(mine):
                for to, v in zip((one, d1, two, d2), self._all(np.asarray(ids)[mine], x[mine])):
                    to[mine] = v
        return one, d1, two, d2

    def _all(self, ids, x):
        d = self.metric.kernel(x, self.c)
        self.n_dist += d.size
        self.n_dim += d.size * self.c.shape[1]
        order = d.copy()
        for row, i in enumerate(np.asarray(ids).tolist()) if self.own else ():
            if i in self.own:
                order[row, self.own[i]] = -1.0
        at = np.arange(len(d))
        one = order.argmin(1)
        first = d[at, one]
        if len(self.c) == 1:
            return one, first, None, None
        order[at, one] = np.inf
        two = order.argmin(1)
        return one, first, two, d[at, two]

    def _pruned(self, x):
        n, top = len(x), min(2, len(self.pivots))
        to_pivots = self.metric.kernel(x, self.c[self.pivots])
        self.n_dist += to_pivots.size
        self.n_dim += to_pivots.size * x.shape[1]
        home = to_pivots.argmin(1)
        k = np.full((n, 2), len(self.c))
        d = np.full((n, 2), np.inf)
        # pivots are centers: the second-least distance to them is a limit from the start
        limit = np.partition(to_pivots, 1, axis=1)[:, 1] if top == 2 else np.full(n, np.inf)
        for at_home in (True, False):
            for g, members in enumerate(self.groups):
                if at_home:
                    rows = np.flatnonzero(home == g)
                else:
                    rows = np.flatnonzero((home != g) & (to_pivots[:, g] - self.radius[g] <= limit * (1 + self.SLACK) + 1e-300))
                self.n_dist += len(rows) * len(members)
                if not at_home:
                    rows = self._near_enough(x, rows, members, limit)
                if not len(rows):
                    continue
                found = self.metric.kernel(x[rows], self.c[members])
                self.n_dim += found.size * x.shape[1]
                many = min(2, len(members))
                best = np.argsort(found, 1, kind="stable")[:, :many] if len(members) > 2 else np.tile(np.arange(many), (len(rows), 1))
                kk = np.concatenate([k[rows], members[best]], 1)
                dd = np.concatenate([d[rows], np.take_along_axis(found, best, 1)], 1)
                order = np.lexsort((kk, dd), axis=1)[:, :2]
                k[rows], d[rows] = np.take_along_axis(kk, order, 1), np.take_along_axis(dd, order, 1)
            limit = np.minimum(limit, d[:, 1])
        return k[:, 0], d[:, 0], k[:, 1], d[:, 1]


    def _near_enough(self, x, rows, members, limit):
        """Those of the rows that some member may be within the limit of, told by the first blocks of dimensions."""
        for dims in self.early:
            if not len(rows):
                break
            part = self.metric.kernel(x[np.ix_(rows, dims)], self.c[np.ix_(members, dims)]).min(1)
            self.n_dim += len(rows) * len(members) * len(dims)
            rows = rows[part <= limit[rows] * (1 + self.SLACK) + 1e-300]
        return rows


def nearest2_dense(samples: DataFrame, centers: DataFrame, metric: str = "l2", counted=None) -> DataFrame:
    """The state of dense samples (id, x): row-local in Arrow batches, no shuffle. Ties go to the lowest k; a medoid
    (centers with an `id`) belongs to itself. With one center a2 and d2 are null. A null vector, or one with a null or
    NaN component, has no distance: its four columns are null. A vector of another length than the centers' is an error.

    The centers go to every task, as K rows of the vectors' length: the model, not the data. Many centers are pruned in
    groups by the triangle inequality. `counted`, an accumulator, gets the number of distances computed.
    """
    rows = sorted(centers.collect(), key=lambda r: r["k"])
    if not rows:
        raise ValueError("there are no centers")
    ks, c = np.array([r["k"] for r in rows]), np.array([r["x"] for r in rows], float)
    own = {r["id"]: i for i, r in enumerate(rows)} if "id" in centers.columns else {}
    m = Metric(metric)

    def run(batches):
        near = Centers(c, m, own)
        for batch in batches:
            ids, x = batch.column(0), batch.column(1)
            sizes = pc.list_value_length(x)
            odd = pc.sum(pc.not_equal(sizes, c.shape[1])).as_py()
            if odd:
                raise ValueError(f"{odd} vectors have another length than the centers' {c.shape[1]}")
            filled = x.drop_null()
            flat = filled.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, c.shape[1])  # nulls are NaN
            sound = ~np.isnan(flat).any(1) if len(flat) else np.zeros(0, bool)
            where = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))[sound]
            found = near.two_nearest(np.asarray(ids)[where] if own else (), flat[sound]) if len(where) else (None,) * 4
            out = [ids, x]
            for j, (v, kind) in enumerate(zip(found, (pa.int32(), pa.float64()) * 2)):
                if v is None:
                    out.append(pa.nulls(batch.num_rows, kind))
                    continue
                v = ks[v] if j % 2 == 0 else v
                if len(where) == batch.num_rows:
                    out.append(pa.array(v, kind))
                else:
                    place = np.full(batch.num_rows, -1)
                    place[where] = np.arange(len(where))
                    out.append(pa.array(v, kind).take(pa.array(place, pa.int64(), mask=place < 0)))
            yield pa.RecordBatch.from_arrays(out, names=["id", "x", "a1", "d1", "a2", "d2"])
        if counted is not None:
            counted.add(near.n_dist)

    return samples.select(F.col("id").cast("long"), F.col("x").cast("array<double>")).mapInArrow(run, STATE)


def nearest2(samples: DataFrame, centers: DataFrame, distance) -> DataFrame:
    """The same for any `distance(a, b)` column builder: the centers travel as one broadcast row."""
    has_id = "id" in centers.columns
    fields = [F.col("k").cast("int").alias("k"), F.col("x").alias("c")] + ([F.col("id").alias("cid")] if has_id else [])
    one_row = centers.agg(F.collect_list(F.struct(*fields)).alias("centers"))
    mine = lambda c: F.when(c["cid"] == F.col("id"), F.lit(0)).otherwise(F.lit(1)) if has_id else F.lit(1)
    ranked = F.array_sort(F.transform("centers", lambda c: F.struct(mine(c).alias("own"), distance(F.col("x"), c["c"]).alias("d"), c["k"].alias("k"))))
    near = samples.crossJoin(F.broadcast(one_row)).withColumn("near", F.slice(ranked, 1, 2))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    return near.select("id", "x", first["k"].alias("a1"), first["d"].alias("d1"), second["k"].alias("a2"), second["d"].alias("d2"))


def nearest2_edit(samples: DataFrame, centers: DataFrame, costs: edit.Costs = edit.Costs(), normalised: bool = False) -> DataFrame:
    """The same for sequences by the edit distance, row-local in Arrow batches. Centers are visited by how near their
    length is to the sample's, and a distance is given up once it exceeds the second-least so far. A null sequence has no
    distance: its four columns are null. A symbol without a cost is an error."""
    rows = sorted(centers.collect(), key=lambda r: r["k"])
    if not rows:
        raise ValueError("there are no centers")
    ks, xs = [r["k"] for r in rows], [r["x"] for r in rows]
    own = {r["id"]: i for i, r in enumerate(rows)} if "id" in centers.columns else {}

    def near(i, x):
        found = [(0, edit.between(x, xs[own[i]], float("inf"), costs, normalised), own[i])] if i in own else []
        for j in sorted(range(len(xs)), key=lambda j: abs(len(xs[j]) - len(x))):
            if j == own.get(i):
                continue
            d = edit.between(x, xs[j], found[1][1] if len(found) == 2 else float("inf"), costs, normalised)
            if d is not None:
                found = sorted([*found, (1, d, j)])[:2]
        first, second = (*found, None, None)[:2]
        return [v for f in (first, second) for v in ((ks[f[2]], f[1]) if f else (None, None))]

    def run(batches):
        for batch in batches:
            try:
                out = [near(i, x) if x is not None else [None] * 4 for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            except KeyError as e:
                raise ValueError(f"no cost of {e}") from e
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.float64()) * 2)] if out else [pa.array([], kind) for kind in (pa.int32(), pa.float64()) * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "x", "a1", "d1", "a2", "d2"])

    kind = dict(samples.dtypes)["x"]
    return samples.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, f"id long, x {kind}, a1 int, d1 double, a2 int, d2 double")


def cluster_statistics(state: DataFrame, energy: Energy, n_centers_inside: bool = True) -> DataFrame:
    """Per cluster: size, energy, mean energy of the non-medoids, and what bounds swaps: maximum and sum of the margin
    e2 - e1, r1 and r2, the maxima of d1 and d2, and the margins over the number of non-medoids (0 without any)."""
    e1, e2 = energy.column(F.col("d1")), energy.column(F.col("d2"))
    others = F.count(F.lit(1)) - (1 if n_centers_inside else 0)
    # a medoid is in the table with d1 = 0: it adds nothing to an energy, and does not take part in the margins
    inside = state if not n_centers_inside else state.withColumn("medoid", F.col("is_medoid"))
    margin = F.when(~F.col("medoid"), e2 - e1) if n_centers_inside else e2 - e1
    d2 = F.when(~F.col("medoid"), F.col("d2")) if n_centers_inside else F.col("d2")
    zero = F.lit(0.0)
    return inside.groupBy(F.col("a1").alias("k")).agg(
        F.count(F.lit(1)).alias("size"), F.sum(e1).alias("energy"),
        F.coalesce(F.try_divide(F.sum(e1), others), zero).alias("mean_energy"),
        F.coalesce(F.max(margin), zero).alias("max_margin"), F.coalesce(F.sum(margin), zero).alias("sum_margin"),
        F.max("d1").alias("r1"), F.coalesce(F.max(d2), zero).alias("r2"),
        F.coalesce(F.try_divide(F.max(margin), others), zero).alias("m_mean"), F.coalesce(F.try_divide(F.sum(margin), others), zero).alias("m_star_mean"),
    )


def with_medoid_flag(state: DataFrame, medoids: DataFrame) -> DataFrame:
    flags = F.broadcast(medoids.select(F.col("id"), F.lit(True).alias("flag")))
    return state.join(flags, "id", "left").withColumn("is_medoid", F.coalesce("flag", F.lit(False))).drop("flag")


def mean_energy(state: DataFrame, energy: Energy) -> float:
    """Total energy over the number of samples, medoids included; 0 for an empty table."""
    r = state.agg(F.sum(energy.column(F.col("d1"))).alias("e"), F.count(F.lit(1)).alias("n")).first()
    return (r["e"] or 0.0) / max(r["n"], 1)


def center_distances(centers: DataFrame, distance) -> DataFrame:
    """(k, kp, d) for k < kp: all pairs of the K centers."""
    a = centers.select(F.col("k"), F.col("x").alias("xa"))
    b = centers.select(F.col("k").alias("kp"), F.col("x").alias("xb"))
    return a.join(F.broadcast(b), F.col("k") < F.col("kp")).select("k", "kp", distance(F.col("xa"), F.col("xb")).alias("d"))


def nearest_center(centers: DataFrame, distance) -> DataFrame:
    """(k, nearest, d): the closest other center of each, lowest k on ties."""
    pairs = center_distances(centers, distance)
    both = pairs.union(pairs.select(F.col("kp").alias("k"), F.col("k").alias("kp"), "d"))
    return both.groupBy("k").agg(F.min(F.struct("d", "kp")).alias("least")).select("k", F.col("least.kp").alias("nearest"), F.col("least.d").alias("d"))


def dense(metric: str):
    """Column builder of a dense metric by name."""
    return Metric(metric).dense


def sparse(metric: str):
    return Metric(metric).sparse


