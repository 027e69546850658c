"""State and judgement of a swap search, for dense vectors and for any other distance.

A search holds the state table and the medoids. It draws proposals (a medoid and the sample that would replace it), tells
how each would change the total energy, and takes a swap in. Levels 1 and 2 compute fewer distances for the same answer:
with d(k, p) the distance of a proposed sample p to medoid k, no member of k is nearer to p than half of d(k, p) leaves
it (members with d1 <= d(k, p) / 2 stay), and members of the medoid to be replaced go to their second one where
d1 + d2 <= d(k, p). Whole clusters, and the stored row groups that hold them, are passed over by their largest d1 and d2.
Level 2 also keeps the medoids' distances to each other, from which most d(k, p) need not be computed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import PRIME, order_of, row_hash, uniform_value
from ..functions.energy import Energy
from ..functions.metrics import Metric
from ..session import forget, settled
from . import seeding
from .assign import Centers

#: Bounds are used with so much room for rounding.
ROOM = 1 - 1e-9
#: Members that a cluster has in the smallest sample of a screen, on average.
SCREENED = 24.0


def shares(n: int, k: int) -> list[float]:
    """Shares of the samples that level 3 looks at before all of them: growing fourfold from the one that holds about
    SCREENED members of a cluster, none if clusters are not larger than that."""
    levels = math.floor(1 - math.log2(SCREENED / (n / k))) if n / k > SCREENED else 1
    return [2.0**-i for i in range(levels - 1, 0, -2)]


class DenseSearch:
    """Dense samples (id, x) by a metric. The stored state (id, x, a1, d1, a2, d2, h) is sorted by a1 within files and is
    rewritten after every KEEP swaps only; those since then are applied to each block as it is read, with one distance for
    each row near the new medoid. The last stored state is deleted once the next one is there.

    h is a row's hash, made once; each draw orders the rows by it anew. Samples without a center (null or NaN vectors)
    are never drawn and change no energy. Level 2 holds K x K distances on the driver, beside the K medoids themselves.
    """

    KEEP = 8

    def __init__(self, state: DataFrame, medoids: DataFrame, metric: str, energy: Energy, seed: int, level: int = 0):
        rows = sorted(medoids.collect(), key=lambda r: r["k"])
        self.metric, self.energy, self.seed = Metric(metric), energy, seed
        self.ids, self.c = np.array([r["id"] for r in rows], np.int64), np.array([r["x"] for r in rows], float)
        self.level = level if len(rows) > 1 else 0
        self.spark = state.sparkSession
        self.base_ids, self.base_c, self.swaps = self.ids, self.c, []
        self.table = settled(state.withColumn("h", row_hash(seed, F.col("id"))).sortWithinPartitions("a1"))
        self.n_dist, self.pairs, self.between = 0, [], None
        self.n = self.table.where("a1 IS NOT NULL").count()
        self._bounds()
        if self.level >= 2:
            self.between = self.metric.kernel(self.c, self.c)
            self.n_dist += self.between.size // 2

    # blocks

    def _present(self):
        """A function of (ids, x, a1, d1, a2, d2) of a stored block to a1, d1, a2, d2 after all swaps, and the distances it took."""
        metric, base_ids, base_c, swaps = self.metric, self.base_ids, self.base_c, list(self.swaps)

        def present(ids, x, a1, d1, a2, d2):
            a1, d1, a2, d2 = a1.copy(), d1.copy(), a2.copy(), d2.copy()
            c, own, n = base_c.copy(), base_ids.copy(), 0
            for k, new_id, new in swaps:
                c[k], own[k] = new, new_id
                far = metric.kernel(c, c[k : k + 1])[:, 0]
                rows = np.flatnonzero((a1 == k) | (a2 == k) | (ids == new_id) | ~(far[a1] * ROOM > d1 + d2))
                if not len(rows):
                    continue
                dp = metric.kernel(x[rows], c[k : k + 1])[:, 0]
                n += len(rows)
                b1, e1, b2, e2 = a1[rows], d1[rows], a2[rows], d2[rows]
                mine, inner = b1 == k, dp < e1
                again = (dp == e1) | (dp == e2) | (ids[rows] == new_id) | ((mine | (b2 == k)) & ~(dp < e2))
                a1[rows], d1[rows] = np.where(mine | inner, k, b1), np.where(mine | inner, dp, e1)
                a2[rows] = np.where(mine, b2, np.where(inner, b1, np.where(dp < e2, k, b2)))
                d2[rows] = np.where(mine, e2, np.where(inner, e1, np.where(dp < e2, dp, e2)))
                left = rows[again]
                if len(left):
                    near = Centers(c, metric, {i: j for j, i in enumerate(own.tolist())}, pruned=len(left) > 1000)
                    one, first, two, second = near.two_nearest(ids[left], x[left])
                    n += near.n_dist
                    a1[left], d1[left] = one, first
                    a2[left], d2[left] = (two, second) if two is not None else (-1, np.nan)
            return a1, d1, a2, d2, n

        return present

    @staticmethod
    def _arrays(batch: pa.RecordBatch, width: int):
        """The columns of a block without the samples that have no center."""
        batch = batch.filter(batch.column(2).is_valid())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        a1, d1, a2, d2 = (batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(2, 6))
        return ids, x, a1.astype(int), d1, np.nan_to_num(a2, nan=-1).astype(int), d2

    def _bounds(self) -> None:
        """For each pair of stored and present cluster the largest d1 and d2 and the sum of E(d2) - E(d1)."""
        if not self.level:
            return
        present, arrays, width, energy = self._present(), self._arrays, self.c.shape[1], self.energy

        def run(batches):
            sums: dict[tuple[int, int], list[float]] = {}
            n = 0
            for batch in batches:
                ids, x, stored, *rest = arrays(batch, width)
                a1, d1, _, d2, took = present(ids, x, stored, *rest)
                n += took
                margin = energy.values(d2) - energy.values(d1)
                for j, a in set(zip(stored.tolist(), a1.tolist())):
                    at = (stored == j) & (a1 == a)
                    one = sums.setdefault((j, a), [0.0, 0.0, 0.0])
                    one[0], one[1], one[2] = max(one[0], d1[at].max()), max(one[1], d2[at].max()), one[2] + margin[at].sum()
            rows = [(j, a, *v, 0) for (j, a), v in sums.items()] + [(-1, -1, 0.0, 0.0, 0.0, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], names=["j", "a", "r1", "r2", "margin", "n"])

        found = self.table.select("id", "x", "a1", "d1", "a2", "d2").mapInArrow(run, "j int, a int, r1 double, r2 double, margin double, n long")
        total = found.groupBy("j", "a").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"), F.sum("margin").alias("margin"), F.sum("n").alias("n")).collect()  # pairs of clusters
        self.pairs = [r for r in total if r["j"] >= 0]
        self.n_dist += sum(r["n"] for r in total if r["j"] < 0)

    # search

    def draw(self, ordinals: list[int]) -> list[dict]:
        """For each ordinal p a cluster k, uniform, and a sample that is no medoid, uniform: p, k, id, x, and the sample's own state."""
        free = self.table.where(~F.col("id").isin(self.ids.tolist()) & F.col("a1").isNotNull())
        row = F.struct("id", "x", "a1", "d1", "a2", "d2")
        picks = free.agg(*[F.min_by(row, F.struct(order_of(F.col("h"), self.seed, "sample", p), F.col("id"))).alias(f"p{p}") for p in ordinals]).first()
        present, out = self._present(), []
        for p in ordinals:
            r = picks[f"p{p}"]
            if r is None:
                continue
            x = np.array([r["x"]], float)
            a1, d1, *_ = present(np.array([r["id"]]), x, np.array([r["a1"]]), np.array([r["d1"]]), np.array([-1 if r["a2"] is None else r["a2"]]), np.array([np.nan if r["d2"] is None else r["d2"]]))
            out.append({"p": p, "k": int(uniform_value(self.seed, "cluster", p) * len(self.ids)), "id": r["id"], "x": x[0], "a1": int(a1[0]), "d1": float(d1[0])})
        return out

    def _far(self, offers: list[dict]) -> np.ndarray:
        """Distances of the offers to all medoids; infinite where level 2 tells that no member can come nearer."""
        x = np.array([o["x"] for o in offers])
        if self.level < 2:
            self.n_dist += len(x) * len(self.c)
            return self.metric.kernel(x, self.c)
        radius = np.zeros(len(self.c))
        for r in self.pairs:
            radius[r["a"]] = max(radius[r["a"]], r["r1"])
        out = np.full((len(x), len(self.c)), np.inf)
        for row, o in enumerate(offers):
            live = ~((self.between[o["a1"]] - o["d1"]) * ROOM >= 2 * radius)
            live[o["k"]] = True
            at = np.flatnonzero(live)
            out[row, at] = self.metric.kernel(x[row : row + 1], self.c[at])[0]
            self.n_dist += len(at)
        return out

    def deltas(self, offers: list[dict], share: float = 1.0) -> dict[int, float]:
        """By p the change of the total energy, exact over all samples, or an estimate from a share of them."""
        if not offers:
            return {}
        p, k, x = np.array([o["p"] for o in offers]), np.array([o["k"] for o in offers]), np.array([o["x"] for o in offers])
        far = self._far(offers) if self.level else None
        table, known = self.table, np.zeros(len(p))
        if self.level:
            live = {r["j"] for r in self.pairs for i in range(len(p)) if far[i, r["a"]] * ROOM < (r["r1"] + r["r2"] if r["a"] == k[i] else 2 * r["r1"])}
            for r in self.pairs:
                if r["j"] not in live:
                    known += np.where(k == r["a"], r["margin"], 0.0)
            if len(live) < len({r["j"] for r in self.pairs}):
                table = table.where(F.col("a1").isin(sorted(live)))
        if share < 1:
            table = table.where(F.col("h") < int(share * PRIME))
        present, arrays, width, energy, metric = self._present(), self._arrays, self.c.shape[1], self.energy, self.metric

        def run(batches):
            total, n = np.zeros(len(p)), 0
            for batch in batches:
                ids, y, *state = arrays(batch, width)
                a1, d1, _, d2, took = present(ids, y, *state)
                n += took
                e1, e2 = energy.values(d1), energy.values(d2)
                for i in range(len(p)):
                    own = a1 == k[i]
                    if far is None:
                        rows = np.arange(len(y))
                    else:
                        f = far[i][a1] * ROOM
                        need = ~np.where(own, f >= d1 + d2, f >= 2 * d1)
                        rows = np.flatnonzero(need)
                        total[i] += (e2 - e1)[own & ~need].sum()
                    if len(rows):
                        d = metric.kernel(y[rows], x[i : i + 1])[:, 0]
                        n += len(rows)
                        stay = np.where(own[rows], d2[rows], d1[rows])  # fmin ignores the missing d2 of a single cluster
                        total[i] += (energy.values(np.fmin(stay, d)) - e1[rows]).sum()
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(total), pa.array([n] + [0] * (len(p) - 1), pa.int64())], names=["p", "delta", "n"])

        sums = table.select("id", "x", "a1", "d1", "a2", "d2").mapInArrow(run, "p int, delta double, n long").groupBy("p").agg(F.sum("delta").alias("delta"), F.sum("n").alias("n")).collect()
        self.n_dist += sum(r["n"] for r in sums)
        found = {r["p"]: r["delta"] / share for r in sums}
        return {int(q): float(found.get(int(q), 0.0) + known[i]) for i, q in enumerate(p)}

    def accept(self, offer: dict) -> None:
        k, new = offer["k"], np.asarray(offer["x"], float)
        self.ids, self.c = self.ids.copy(), self.c.copy()
        self.ids[k], self.c[k] = offer["id"], new
        self.swaps.append((k, offer["id"], new))
        if len(self.swaps) >= self.KEEP:
            self.store()
        else:
            self._bounds()
        if self.between is not None:
            self.between = self.between.copy()
            self.between[k] = self.between[:, k] = self.metric.kernel(self.c, self.c[k : k + 1])[:, 0]
            self.n_dist += len(self.c)

    def _written(self) -> DataFrame:
        """The stored state after all swaps."""
        present, arrays, width = self._present(), self._arrays, self.c.shape[1]

        def run(batches):
            for batch in batches:
                ids, x, *state = arrays(batch, width)
                a1, d1, a2, d2, _ = present(ids, x, *state)
                none = a2 < 0
                sound = batch.filter(batch.column(2).is_valid())
                columns = [sound.column(0), sound.column(1), pa.array(a1, pa.int32()), pa.array(d1), pa.array(a2, pa.int32(), mask=none), pa.array(d2, mask=none), sound.column(6)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "a1", "d1", "a2", "d2", "h"])
                odd = batch.filter(batch.column(2).is_null())
                if odd.num_rows:
                    yield odd

        names = ["id", "x", "a1", "d1", "a2", "d2", "h"]
        return self.table.select(*names).mapInArrow(run, self.table.select(*names).schema)

    def store(self) -> None:
        """Write the present state, and delete the one before."""
        if self.swaps:
            before, self.table = self.table, settled(self._written().sortWithinPartitions("a1"))
            forget(before)
            self.base_ids, self.base_c, self.swaps = self.ids, self.c, []
            self._bounds()

    def state(self) -> DataFrame:
        self.store()
        return self.table.drop("h")

    def medoids(self) -> DataFrame:
        rows = [(k, int(i), x.tolist()) for k, (i, x) in enumerate(zip(self.ids, self.c))]
        return self.spark.createDataFrame(rows, "k int, id long, x array<double>")


class ColumnSearch:
    """Samples of any kind (id, x) by a distance of two columns. Each swap writes the state (id, x, a1, d1, a2, d2, h) once
    and deletes the one before. Above level 0 distances are computed for those pairs of a sample and a proposal only that
    the bounds leave open; levels 2 and 3 keep no center distances here."""

    def __init__(self, state: DataFrame, medoids: DataFrame, assign, distance, energy: Energy, seed: int, level: int = 0):
        self.assign, self.distance, self.energy, self.seed, self.level = assign, distance, energy, seed, level
        self.table = settled(state.withColumn("h", row_hash(seed, F.col("id"))))
        self.centers = settled(medoids)
        self.ids = [r["id"] for r in self.centers.orderBy("k").collect()]
        self.n, self.n_dist = self.table.count(), 0

    def draw(self, ordinals: list[int]) -> list[dict]:
        return [r.asDict() for r in proposals(self.table, self.ids, ordinals, self.seed).collect()]

    def deltas(self, offers: list[dict], share: float = 1.0) -> dict[int, float]:
        if not offers:
            return {}
        spark = self.table.sparkSession
        kind = dict(self.table.dtypes)["x"]
        offered = spark.createDataFrame([(o["p"], o["k"], o["x"]) for o in offers], f"p int, k int, x {kind}")
        table = self.table if share == 1 else self.table.where(F.col("h") < int(share * PRIME))
        far = None
        if self.level and len(self.ids) > 1:
            c = self.centers.select(F.col("k").alias("ck"), F.col("x").alias("cx"))
            pairs = offered.crossJoin(F.broadcast(c)).select("p", "ck", self.distance(F.col("cx"), F.col("x")).alias("d"))
            far = {o["p"]: [0.0] * len(self.ids) for o in offers}
            for r in pairs.collect():  # a batch of proposals times K
                far[r["p"]][r["ck"]] = r["d"]
            self.n_dist += len(offers) * len(self.ids)
        sums = judged(table, offered, self.energy, self.distance, far).collect()
        self.n_dist += sum(r["n"] for r in sums)
        return {r["p"]: r["delta"] / share for r in sums}

    def accept(self, offer: dict) -> None:
        k, new = offer["k"], offer["x"]
        kind = dict(self.table.dtypes)["x"]
        one = self.table.sparkSession.createDataFrame([(k, offer["id"], new)], f"k int, id long, x {kind}")
        before = self.table, self.centers
        self.centers = settled(self.centers.where(F.col("k") != k).select("k", "id", "x").union(one))
        self.ids = [*self.ids[:k], offer["id"], *self.ids[k + 1 :]]
        present = swapped(self.table.drop("h"), self.centers, k, offer["id"], new, self.assign, self.distance)
        self.table = settled(present.withColumn("h", row_hash(self.seed, F.col("id"))))
        self.n_dist += self.n
        forget(*before)

    def state(self) -> DataFrame:
        return self.table.drop("h")

    def medoids(self) -> DataFrame:
        return self.centers


def proposals(state: DataFrame, medoid_ids: list[int], ordinals: list[int], seed: int) -> DataFrame:
    """(p, k, id, x): for each ordinal a cluster, uniform, and a sample that is no medoid, uniform, that would replace its
    medoid: the first in an order of the rows by their hash (column h, or made here) that the ordinal names."""
    k = len(medoid_ids)
    h = F.col("h") if "h" in state.columns else row_hash(seed, F.col("id"))
    free = state.where(~F.col("id").isin(medoid_ids))
    row = free.agg(*[F.min_by(F.struct("id", "x"), F.struct(order_of(h, seed, "sample", p), F.col("id"))).alias(f"p{p}") for p in ordinals]).first()
    plan = [(p, int(uniform_value(seed, "cluster", p) * k), *row[f"p{p}"]) for p in ordinals if row[f"p{p}"] is not None]
    return state.sparkSession.createDataFrame(plan, f"p int, k int, id long, x {dict(state.dtypes)['x']}")


def judged(state: DataFrame, proposed: DataFrame, energy: Energy, distance, far: dict[int, list[float]] | None = None) -> DataFrame:
    """(p, delta, n): change of the total energy if sample x took the place of medoid k, exact over all samples, and the
    distances computed. `far` has the distances of each proposal to all medoids, from which most samples are settled.

    Members of k fall back to their second center, others keep their first, and each may move to the proposed one;
    medoids are rows with d1 = 0, so the replaced medoid's own cost is part of the sum.
    """
    offered = proposed.select("p", F.col("k").alias("pk"), F.col("x").alias("px"))  # a batch of proposals
    own = F.col("a1") == F.col("pk")
    stay = F.when(own, F.col("d2")).otherwise(F.col("d1"))
    e1 = energy.column(F.col("d1"))
    if far is None:
        pairs = state.crossJoin(F.broadcast(offered))
        idle = None
    else:
        lists = proposed.sparkSession.createDataFrame([(p, d) for p, d in far.items()], "fp int, far array<double>")
        pairs = state.crossJoin(F.broadcast(offered.join(lists, F.col("p") == F.col("fp"))))
        room = F.element_at("far", F.col("a1") + 1) * F.lit(ROOM)
        settled_by_bounds = F.coalesce(F.when(own, room >= F.col("d1") + F.col("d2")).otherwise(room >= 2 * F.col("d1")), F.lit(False))
        idle = pairs.where(settled_by_bounds & own).select("p", (energy.column(F.col("d2")) - e1).alias("delta"), F.lit(0).cast("long").alias("n"))
        pairs = pairs.where(~settled_by_bounds)
    after = energy.column(F.least(stay, distance(F.col("x"), F.col("px"))))  # least ignores the null d2 of a single cluster
    parts = pairs.select("p", (after - e1).alias("delta"), F.lit(1).cast("long").alias("n"))
    every = proposed.select("p", F.lit(0.0).alias("delta"), F.lit(0).cast("long").alias("n"))
    whole = parts.union(every) if idle is None else parts.union(idle).union(every)
    return whole.groupBy("p").agg(F.sum("delta").alias("delta"), F.sum("n").alias("n"))


def swapped(state: DataFrame, medoids: DataFrame, k: int, new_id: int, x, assign, distance) -> DataFrame:
    """The state after sample new_id, x, has become medoid k: one distance a sample decides for all whose two nearest
    centers can be told from it. The others are assigned anew to `medoids` (the new ones): members of k that another
    center is now nearest to, those that lose k as second, medoids, and ties."""
    dp, inner = F.col("dp"), F.col("dp") < F.col("d1")
    ids = [r["id"] for r in medoids.select("id").collect()]
    tied = (F.col("dp") == F.col("d1")) | (F.col("dp") == F.col("d2"))
    lost = ((F.col("a1") == k) | (F.col("a2") == k)) & (F.col("dp") > F.col("d2"))
    again = F.coalesce(tied | lost, F.lit(True)) | F.col("id").isin(ids) | (F.col("id") == int(new_id))
    near = state.withColumn("dp", distance(F.col("x"), seeding.literal(x))).withColumn("again", again)
    own = F.col("a1") == k
    kept = near.where("NOT again").select(
        "id", "x",
        F.when(own | inner, k).otherwise(F.col("a1")).cast("int").alias("a1"), F.when(own | inner, dp).otherwise(F.col("d1")).alias("d1"),
        F.when(own, F.col("a2")).when(inner, F.col("a1")).when(dp < F.col("d2"), k).otherwise(F.col("a2")).cast("int").alias("a2"),
        F.when(own, F.col("d2")).when(inner, F.col("d1")).when(dp < F.col("d2"), dp).otherwise(F.col("d2")).alias("d2"),
    )
    return kept.unionByName(assign(near.where("again").select("id", "x"), medoids))
