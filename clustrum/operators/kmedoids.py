"""K-medoids: CLARANS swap search and Voronoi iteration over the state table.

A batch of swap proposals is evaluated in one job. Greedy search takes the first improving proposal of the batch,
which is what trying them one by one would take, as the state changes on acceptance only; patient search takes the
best. Proposals are keyed by their ordinal, so those after an accepted one are drawn again against the new medoids.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.energy import Energy
from ..functions.metrics import Metric
from ..session import forget, settled
from .assign import mean_energy
from .swaps import ColumnSearch, DenseSearch, shares


BLOCK = 1024
#: Members whose distances to a block are held at once.
STRIPE = 256


@dataclass
class Rounds:
    """What the rounds did, and why they ended."""

    log: list[tuple] = field(default_factory=list)
    halt_reason: str = ""

    SCHEMA = "phase string, r int, mE double, n_proposals int, delta double, seconds double, n_dist long"

    def add(self, phase: str, r: int, m_e: float, n: int, delta: float, seconds: float, n_dist: int = 0) -> None:
        """n_dist: distances that the round computed, screens, bounds and retried tasks included."""
        self.log.append((phase, r, float(m_e), int(n), float(delta), float(seconds), int(n_dist)))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log, self.SCHEMA)


def clarans(samples, medoids, assign, energy, distance, seed, max_rounds, max_proposals, patient, level=0, batch=16, min_me=0.0, deadline=None, rounds=None, metric=None, state=None):
    """(state, medoids, rounds) after at most max_rounds accepted swaps; ends after max_proposals rejections in a row.

    Levels 0 to 2 accept the same swaps, with fewer distances computed the higher they are; level 3 screens proposals on
    growing samples of the samples first, an early rejection that may lose good swaps. With a `metric` the samples are
    dense vectors and a NumPy kernel is used. `state` is the assignment to the medoids, if it is known already.
    """
    rounds = rounds if rounds is not None else Rounds()
    medoids = settled(medoids)
    first = state if state is not None else settled(assign(samples, medoids))
    m_e = mean_energy(first, energy)
    n, n_medoids = first.count(), medoids.count()
    search = DenseSearch(first, medoids, metric, energy, seed, level) if metric else ColumnSearch(first, medoids, assign, distance, energy, seed, level)
    if state is None:
        forget(first)
        search.n_dist += n * n_medoids
    rounds.add("clarans", 0, m_e, 0, 0.0, 0.0, search.n_dist)
    ordinal, accepted, screens = 0, 0, shares(n, n_medoids) if level == 3 else []
    while True:
        if accepted >= max_rounds:
            rounds.halt_reason = "max_rounds"
            break
        if m_e <= min_me:
            rounds.halt_reason = "min_mE"
            break
        began, rejected, swap, counted = time.perf_counter(), 0, None, search.n_dist
        while swap is None and rejected < max_proposals:
            if deadline is not None and time.perf_counter() > deadline:
                break
            todo = list(range(ordinal, ordinal + int(min(batch, max_proposals - rejected))))
            offers = left = search.draw(todo)
            for share in screens:
                promising = search.deltas(left, share)
                left = [o for o in left if promising[o["p"]] < 0]
            good = sorted((p, delta) for p, delta in search.deltas(left).items() if delta < 0)
            if good:
                swap = min(good, key=lambda g: (g[1], g[0])) if patient else good[0]
                used = len(todo) if patient else swap[0] - ordinal + 1
            else:
                used = len(todo)
            rejected += used - (swap is not None)
            ordinal += used
        if swap is None:
            rounds.halt_reason = "max_time" if rejected < max_proposals else "max_proposals"
            break
        search.accept(next(o for o in offers if o["p"] == swap[0]))
        m_e += swap[1] / n
        accepted += 1
        rounds.add("clarans", accepted, m_e, rejected + 1, swap[1], time.perf_counter() - began, search.n_dist - counted)
    return search.state(), search.medoids(), rounds


def _blocks(state: DataFrame):
    """Members (k, x, id) spread over blocks of about BLOCK rows of their cluster, with the number of blocks."""
    blocks = F.broadcast(state.groupBy(F.col("a1").alias("k")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))  # K rows
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return state.select(F.col("a1").alias("k"), "id", "x").join(blocks, "k").withColumn("own", own)


def medoid_costs(state: DataFrame, energy: Energy, distance) -> DataFrame:
    """(k, id, cost): for each member, the summed energy of its cluster if it were the medoid. All pairs within a
    cluster are what the definition asks for; use CLARANS where clusters are large. Blocks of members meet in pairs, so one
    key holds BLOCK * BLOCK pairs however large its cluster is."""
    members, every = _blocks(state), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    i = members.select("k", F.col("own").alias("bi"), every.alias("bj"), F.col("x").alias("xi"))
    j = members.select("k", F.col("own").alias("bj"), every.alias("bi"), "id", F.col("x").alias("xj"))
    return i.join(j, ["k", "bi", "bj"]).groupBy("k", "id").agg(F.sum(energy.column(distance(F.col("xi"), F.col("xj")))).alias("cost"))


def medoid_costs_dense(state: DataFrame, energy: Energy, metric: str) -> DataFrame:
    """The same for dense vectors. A member is sent to each pair of blocks that its own is in; a pair is one matrix of
    distances, of which both blocks get their sums, so no pair of members is ever a row."""
    m = Metric(metric)
    # block b meets block c once, b <= c: there it is on the left, else on the right
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least("own", c).alias("b"), F.greatest("own", c).alias("c")))
    sent = _blocks(state.where("a1 IS NOT NULL")).select("k", "id", "x", "own", F.explode(others).alias("at")).select("k", "at.b", "at.c", "id", "x", (F.col("own") == F.col("at.b")).alias("is_left"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows["is_left"].to_numpy(bool)
        k, whole = rows["k"].iloc[0], rows["b"].iloc[0] == rows["c"].iloc[0]
        ids, x = rows["id"].to_numpy(np.int64), np.stack(rows["x"].to_numpy())
        one, two = (x, x) if whole else (x[left], x[~left])
        cost = np.zeros(len(one)), np.zeros(len(two))
        for i in range(0, len(one), STRIPE):
            e = energy.values(m.kernel(two, one[i : i + STRIPE]))
            cost[0][i : i + STRIPE] = e.sum(0)
            cost[1][:] += e.sum(1)
        parts = [(ids, cost[0])] if whole else [(ids[left], cost[0]), (ids[~left], cost[1])]
        return pd.DataFrame({"k": np.int32(k), "id": np.concatenate([p[0] for p in parts]), "cost": np.concatenate([p[1] for p in parts])})

    return sent.groupBy("k", "b", "c").applyInPandas(block, "k int, id long, cost double").groupBy("k", "id").agg(F.sum("cost").alias("cost"))


def voronoi(samples, medoids, assign, energy, distance, max_rounds, min_me=0.0, deadline=None, rounds=None, metric=None, state=None):
    """Alternate: each cluster takes its cheapest member as medoid if strictly cheaper, then all samples reassign. With a
    `metric` the samples are dense vectors; `state` is the assignment to the medoids, if it is known already."""
    rounds = rounds if rounds is not None else Rounds()
    medoids = settled(medoids)
    state, n_first = (state, 0) if state is not None else (settled(assign(samples, medoids)), 1)
    n, n_medoids = state.count(), medoids.count()
    rounds.add("voronoi", 0, mean_energy(state, energy), 0, 0.0, 0.0, n_first * n * n_medoids)
    for r in range(1, int(max_rounds) + 1):
        if deadline is not None and time.perf_counter() > deadline:
            rounds.halt_reason = "max_time"
            return state, medoids, rounds
        began = time.perf_counter()
        pairs = state.groupBy("a1").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        moved = settled(voronoi_update(state, medoids, energy, distance, metric))
        changed = moved.where("moved").count()
        if not changed:
            rounds.halt_reason = "no center moved"
            return state, medoids, rounds
        before = state, medoids, moved
        medoids = settled(moved.select("k", "id").join(samples.select("id", "x"), "id").select("k", "id", "x"))
        state = settled(assign(samples, medoids))
        forget(*before)
        m_e = mean_energy(state, energy)
        rounds.add("voronoi", r, m_e, changed, 0.0, time.perf_counter() - began, (pairs // 2 if metric else pairs) + n * n_medoids)
        if m_e <= min_me:
            rounds.halt_reason = "min_mE"
            return state, medoids, rounds
    rounds.halt_reason = "max_rounds"
    return state, medoids, rounds


def voronoi_update(state: DataFrame, medoids: DataFrame, energy: Energy, distance, metric: str | None = None) -> DataFrame:
    """(k, id, moved): the medoid after one update; the current one stays unless a member is strictly cheaper."""
    costs = medoid_costs_dense(state, energy, metric) if metric else medoid_costs(state, energy, distance)
    own = costs.join(F.broadcast(medoids.select("k", F.col("id").alias("mid"))), "k")
    best = own.groupBy("k").agg(F.min(F.struct("cost", "id")).alias("best"), F.max(F.when(F.col("id") == F.col("mid"), F.col("cost"))).alias("now"), F.first("mid").alias("mid"))
    better = F.col("best.cost") < F.col("now")
    return best.select("k", F.when(better, F.col("best.id")).otherwise(F.col("mid")).alias("id"), better.alias("moved"))
