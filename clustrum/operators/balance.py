"""Label balancing: clusters that are too small take the last members of the nearest clusters that can spare some."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assign import center_distances

FACTOR = 1.5
RANGES = 1024


def least_size(n: int, k: int) -> int:
    if n < 3 * k:
        raise ValueError("balancing needs at least 3 K samples")
    return max(2, int(n / (FACTOR * k)))


def transfer_plan(sizes: dict[int, int], apart: dict[tuple[int, int], float], least: int) -> list[tuple[int, int, int]]:
    """(donor, receiver, rows) in order: clusters by k; each that is too small asks the others, nearest first."""
    sizes, plan = dict(sizes), []
    for k in sorted(sizes):
        for donor in sorted((j for j in sizes if j != k), key=lambda j: (apart[min(j, k), max(j, k)], j)):
            rows = min(sizes[donor] - least, least - sizes[k])
            if rows > 0:
                plan.append((donor, k, rows))
                sizes[donor] -= rows
                sizes[k] += rows
    return plan


def last_rows(labelled: DataFrame, most: dict[int, int]) -> DataFrame:
    """(id, k, rank): of each cluster in `most` its last rows by id, ranked from 1 downwards. Ids are cut into RANGES
    ranges; counts by range tell which ranges hold such rows, and only those are sorted, each on its own."""
    ends = labelled.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    at = F.least(F.lit(RANGES - 1), F.floor((F.col("id") - F.col("low")) / (F.col("high") - F.col("low") + 1) * RANGES)).cast("int")
    ranged = labelled.select("id", "k").join(F.broadcast(ends), "k").select("id", "k", at.alias("range"))
    later = Window.partitionBy("k").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("k", "range").count().select("k", "range", F.coalesce(F.sum("count").over(later), F.lit(0)).alias("before"))
    wanted = before.where(F.col("before") < F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("k")))
    inside = Window.partitionBy("k", "range").orderBy(F.desc("id"))
    ranked = ranged.join(F.broadcast(wanted), ["k", "range"]).select("id", "k", (F.row_number().over(inside) + F.col("before")).alias("rank"))
    return ranked.where(F.col("rank") <= F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("k")))


def balance(labelled: DataFrame, centers: DataFrame, distance) -> DataFrame:
    """(id, k) from (id, k) labels and (k, x) centers, such that each cluster has at least the least size.

    The plan comes from K counts and K * K distances; the rows that move are a donor's last by id.
    """
    sizes = {r["k"]: 0 for r in centers.select("k").collect()} | {r["k"]: r["count"] for r in labelled.groupBy("k").count().collect()}
    least = least_size(sum(sizes.values()), len(sizes))
    apart = {(r["k"], r["kp"]): r["d"] for r in center_distances(centers, distance).collect()}
    plan = transfer_plan(sizes, apart, least)
    if not plan:
        return labelled.select("id", "k")
    given: dict[int, int] = {}
    moves = []
    for donor, to, rows in plan:
        at = given.get(donor, 0)
        moves.append((donor, to, at + 1, at + rows))
        given[donor] = at + rows
    spared = last_rows(labelled.where(F.col("k").isin(list(given))), given)
    route = labelled.sparkSession.createDataFrame(moves, "donor int, receiver int, low int, high int")
    moved = spared.join(F.broadcast(route), (F.col("k") == F.col("donor")) & F.col("rank").between(F.col("low"), F.col("high"))).select(F.col("id").alias("mid"), "receiver")
    return labelled.join(moved, F.col("id") == F.col("mid"), "left").select("id", F.coalesce("receiver", "k").cast("int").alias("k"))
