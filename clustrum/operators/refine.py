"""Refinement of vector centers: means under l2, dimension-wise upper medians under l1, and sparse means.

Rounds assign samples to the nearest center and recompute centers until none moves by more than TOLERANCE times the
sum of absolute values of both. An empty cluster keeps its center.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.energy import Energy
from ..session import forget, settled
from .assign import mean_energy, nearest2, nearest2_dense
from .bounded import BoundedRefinement, name_of, partial_means
from .kmedoids import Rounds

TOLERANCE = 1e-7


def objective(metric: str, energy: Energy, any_energy: bool = False) -> str:
    """`mean` or `median`, or an error where refinement has no center to offer."""
    if metric == "l2" and (any_energy or energy.name == "quadratic"):
        return "mean"
    if metric == "l1" and energy.name == "identity":
        return "median"
    raise ValueError("refinement needs l2 with the quadratic energy, or l1 with identity")


def vector_centers(labelled: DataFrame, how: str = "mean") -> DataFrame:
    """(k, x) of (k, x) samples: per dimension the mean, or the upper median (element n / 2 of the sorted values)."""
    long = labelled.select("k", F.posexplode("x").alias("pos", "v"))
    by_dim = long.groupBy("k", "pos").agg(F.avg("v").alias("v")) if how == "mean" else upper_medians(long)
    return by_dim.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pv")).select("k", F.transform("pv", lambda p: p["v"]).alias("x"))


#: Values of a group that one task may hold, and the accuracy of the sketch that narrows larger groups.
HELD, ACCURACY = 65536, 2000


def upper_medians(long: DataFrame, held: int = HELD, accuracy: int = ACCURACY) -> DataFrame:
    """(k, pos, v): for each (k, pos) of (k, pos, v) element n / 2, from 0, of its n sorted values, exactly; nulls do not count.

    Groups of at most `held` values are sorted. Of larger ones a mergeable quantile sketch gives values on both sides of the
    median, one pass counts what lies below and between them, and what lies between is narrowed again until it is small
    or one value only. So no task holds a large group, however many different values it has.
    """
    value = lambda at: F.get(F.array_sort(F.collect_list("v")), at)
    rest = long.where(F.col("v").isNotNull() & F.col("k").isNotNull()).select("k", "pos", "v")
    sizes = rest.groupBy("k", "pos").agg(F.count(F.lit(1)).alias("n"))
    if not sizes.where(F.col("n") > held).limit(1).count():
        return rest.groupBy("k", "pos").agg(value(F.floor(F.count(F.lit(1)) / 2).cast("int")).alias("v"))
    rest = settled(rest)
    todo = settled(rest.groupBy("k", "pos").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.floor(F.col("n") / 2).cast("long")))
    done, old = [], []
    while True:
        small = todo.where(F.col("n") <= held).select("k", "pos", "t")
        done.append(rest.join(small, ["k", "pos"]).groupBy("k", "pos", "t").agg(value(F.col("t").cast("int")).alias("v")).select("k", "pos", "v"))
        large = todo.where(F.col("n") > held)
        if not large.limit(1).count():
            break
        spread = rest.join(large, ["k", "pos"])
        # the sketch errs by n / accuracy places at most
        p, off = F.col("t") / F.col("n"), F.lit(2.0 / accuracy)
        cuts = settled(spread.groupBy("k", "pos", "t", "n").agg(F.percentile_approx("v", [i / 64 for i in range(65)], accuracy).alias("cut")))
        low = F.element_at("cut", F.greatest(F.floor((p - off) * 64), F.lit(0)).cast("int") + 1)
        high = F.element_at("cut", F.least(F.ceil((p + off) * 64), F.lit(64)).cast("int") + 1)
        bracket = cuts.select("k", "pos", "t", low.alias("low"), high.alias("high"))
        v, lo, hi = F.col("v"), F.col("low"), F.col("high")
        counts = rest.join(bracket, ["k", "pos"]).groupBy("k", "pos", "t", "low", "high").agg(
            F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_low"), F.count_if((v > lo) & (v < hi)).alias("inside"), F.count_if((v == hi) & (hi > lo)).alias("at_high"), F.count_if(v > hi).alias("above")
        )
        # the part that holds place t: below, at_low, inside, at_high or above; all but the two values are strictly smaller than the group
        ends = [F.col("below"), F.col("below") + F.col("at_low"), F.col("below") + F.col("at_low") + F.col("inside"), F.col("below") + F.col("at_low") + F.col("inside") + F.col("at_high")]
        t = F.col("t")
        part = F.when(t < ends[0], 0).when(t < ends[1], 1).when(t < ends[2], 2).when(t < ends[3], 3).otherwise(4)
        parts = settled(counts.withColumn("part", part))
        done.append(parts.where("part IN (1, 3)").select("k", "pos", F.when(F.col("part") == 1, lo).otherwise(hi).alias("v")))
        narrowed = parts.where("part IN (0, 2, 4)").select(
            "k", "pos", "low", "high", "part", (t - F.when(F.col("part") == 0, 0).when(F.col("part") == 2, ends[1]).otherwise(ends[3])).alias("t"),
            F.when(F.col("part") == 0, F.col("below")).when(F.col("part") == 2, F.col("inside")).otherwise(F.col("above")).alias("n"),
        )
        stays = F.when(F.col("part") == 0, v < lo).when(F.col("part") == 2, (v > lo) & (v < hi)).otherwise(v > hi)
        old += [rest, todo, cuts, parts]
        rest = settled(rest.join(narrowed.select("k", "pos", "low", "high", "part"), ["k", "pos"]).where(stays).select("k", "pos", "v"))
        todo = settled(narrowed.select("k", "pos", "n", "t"))
    out = settled(reduce(DataFrame.unionByName, done))
    forget(rest, todo, *old)
    return out


def sparse_centers(labelled: DataFrame) -> DataFrame:
    """(k, x) of sparse (k, x MAP) samples: sums by index over the cluster's size, exact zeros dropped."""
    sizes = labelled.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sums = labelled.select("k", F.explode("x").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).where("v <> 0")
    full = sums.join(F.broadcast(sizes), "k").groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", (F.col("v") / F.col("n")).alias("v"))))).alias("x"))
    return sizes.join(full, "k", "left").select("k", F.coalesce("x", F.expr("map_from_arrays(array(), array())").cast("map<bigint,double>")).alias("x"))


def refine(samples, centers, metric: str, energy: Energy, max_rounds: int, deadline=None, rounds=None, is_sparse=False, distance=None, any_energy=False, algorithm: str = "standard"):
    """(state, centers, rounds): centers is (k, x), first the medoids or any vectors. The algorithms standard, yinyang and
    exponion (auto: by the number of dimensions) give the same centers; the last two keep bounds and compute fewer distances."""
    how = objective(metric, energy, any_energy)
    name_of(algorithm, 0)
    if algorithm != "standard" and not is_sparse:
        return _bounded(samples, centers, metric, energy, how, max_rounds, deadline, rounds if rounds is not None else Rounds(), algorithm)
    if is_sparse and how != "mean":
        raise ValueError("sparse vectors are refined under l2 only")
    rounds = rounds if rounds is not None else Rounds()
    assign = (lambda s, c: nearest2(s, c, distance)) if is_sparse else (lambda s, c: nearest2_dense(s, c, metric))
    centers = settled(centers.select("k", "x"))
    state = settled(assign(samples, centers))
    n_dist = state.count() * centers.count()
    for r in range(1, int(max_rounds) + 1):
        if deadline is not None and time.perf_counter() > deadline:
            rounds.halt_reason = "rf_max_time"
            break
        began = time.perf_counter()
        labelled = state.select(F.col("a1").alias("k"), "x")
        new = sparse_centers(labelled) if is_sparse else vector_centers(labelled, how)
        old = centers.select("k", F.col("x").alias("old"))
        moved = settled(old.join(new, "k", "left").select("k", "old", F.coalesce("x", "old").alias("x")))
        centers = moved.select("k", "x")
        still = not moved.where(shift("old", "x", is_sparse)).limit(1).count()
        state = settled(assign(samples, centers))
        rounds.add("refine", r, mean_energy(state, energy), 0, 0.0, time.perf_counter() - began, n_dist)
        if still:
            rounds.halt_reason = "no center moved"
            break
    else:
        rounds.halt_reason = "rf_max_rounds"
    return state, centers, rounds


def _bounded(samples, centers, metric, energy, how, max_rounds, deadline, rounds, algorithm):
    """The same over a state with bounds; the centers, K rows, are moved on the driver."""
    spark = samples.sparkSession
    rows = sorted(centers.select("k", "x").collect(), key=lambda r: r["k"])
    ks, c = [r["k"] for r in rows], np.array([r["x"] for r in rows], float)
    run = BoundedRefinement(samples, c, metric, name_of(algorithm, c.shape[1]))
    for r in range(1, int(max_rounds) + 1):
        if deadline is not None and time.perf_counter() > deadline:
            rounds.halt_reason = "rf_max_time"
            break
        began, counted = time.perf_counter(), run.n_dist
        if how == "mean":
            found = partial_means(run.table, len(c), c.shape[1])
        else:
            found = {q["k"]: np.array(q["x"]) for q in vector_centers(run.table.select(F.col("a1").alias("k"), "x"), how).collect()}
        moved = np.array([found.get(k, old) for k, old in enumerate(c)])
        still = not (np.abs(moved - c).sum(1) > TOLERANCE * (np.abs(moved) + np.abs(c)).sum(1)).any()
        c = moved
        forget(run.move(c))
        rounds.add("refine", r, mean_energy(run.table, energy), 0, 0.0, time.perf_counter() - began, run.n_dist - counted)
        if still:
            rounds.halt_reason = "no center moved"
            break
    else:
        rounds.halt_reason = "rf_max_rounds"
    state = run.final()
    forget(run.table)
    names = spark.createDataFrame(list(enumerate(ks)), "i int, k int")
    if ks != list(range(len(ks))):
        one, two = names.toDF("i1", "k1"), names.toDF("i2", "k2")
        named = state.join(F.broadcast(one), F.col("a1") == F.col("i1"), "left").join(F.broadcast(two), F.col("a2") == F.col("i2"), "left")
        state = named.select("id", "x", F.col("k1").alias("a1"), "d1", F.col("k2").alias("a2"), "d2")
    return state, spark.createDataFrame([(k, x.tolist()) for k, x in zip(ks, c)], "k int, x array<double>"), rounds


def shift(old: str, new: str, is_sparse: bool):
    """Whether a center moved."""
    a, b = F.col(old), F.col(new)
    zero = F.lit(0.0)
    if is_sparse:
        total = lambda m, f: F.aggregate(F.map_values(m), zero, lambda s, v: s + f(v))
        moved = total(F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, zero) - F.coalesce(y, zero))), lambda v: v)
        size = total(a, F.abs) + total(b, F.abs)
    else:
        total = lambda x: F.aggregate(x, zero, lambda s, v: s + F.abs(v))
        moved, size = total(F.zip_with(a, b, lambda x, y: x - y)), total(a) + total(b)
    return moved > TOLERANCE * size
