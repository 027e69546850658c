"""Seeding: K sample ids, from given indices, uniformly, by k-means++ (exact, binned, greedy) or by AFK-MC2.

All draws are keyed by (seed, purpose, step, id), so a seeding is the same however the table is partitioned. Medoids
are returned as (k, id, x) with k in order of id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import key, race, uniform, uniform_value
from ..functions.energy import Energy
from ..functions.metrics import Metric
from ..session import forget, settled

SETTLE_EVERY = 8
RACES_PER_JOB = 48


@dataclass(frozen=True)
class Init:
    """A parsed init name: kind and its integer."""

    kind: str
    number: int = 1

    @classmethod
    def parse(cls, name: str) -> "Init":
        if name in ("uniform", "kmeans++"):
            return cls(name)
        m = re.fullmatch(r"(kmeans\+\+-|kmeans\+\+~|afk-mc2-)(\d+)", name)
        if not m or int(m[2]) < 1:
            raise ValueError(f"no init named {name!r}; there are uniform, kmeans++, kmeans++-INT, kmeans++~INT and afk-mc2-INT, INT at least 1")
        kind = {"kmeans++-": "binned", "kmeans++~": "greedy", "afk-mc2-": "afk-mc2"}[m[1]]
        return cls("kmeans++", 1) if (kind, int(m[2])) == ("binned", 1) else cls(kind, int(m[2]))


def medoids_of(samples: DataFrame, ids: list[int]) -> DataFrame:
    """(k, id, x) of the given ids, k in order of id."""
    rows = samples.where(F.col("id").isin([int(i) for i in ids])).select("id", "x")
    return rows.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("k"), "id", "x")


def from_indices(samples: DataFrame, ids: list[int], k: int) -> DataFrame:
    if len(ids) != k:
        raise ValueError(f"{k} indices are needed, {len(ids)} were given")
    if len(set(ids)) < len(ids):
        raise ValueError("an index is given twice")
    found = samples.where(F.col("id").isin([int(i) for i in ids])).count()
    if found != k:
        raise ValueError(f"{k - found} of the indices are not ids of samples")
    return medoids_of(samples, ids)


def uniform_ids(samples: DataFrame, k: int, seed: int, purpose: str = "uniform", but: tuple = ()) -> list[int]:
    """k distinct ids, each set of k equally likely: those of the least hashes."""
    rest = samples.where(~F.col("id").isin([int(i) for i in but])) if but else samples
    return [r["id"] for r in rest.select("id", key(seed, purpose, F.col("id")).alias("h")).orderBy("h", "id").limit(k).collect()]


def literal(x):
    """A sample's value as a literal: a string, a sparse vector, or an array whose elements keep their type, as symbols of
    integer sequences are looked up in cost tables."""
    if isinstance(x, dict):
        return F.map_from_arrays(F.array(*map(F.lit, x)).cast("array<bigint>"), F.array(*map(F.lit, x.values())).cast("array<double>"))
    return F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.lit(x)


def _closer(state: DataFrame, x, new_id: int, distance) -> DataFrame:
    """The state after a center at the sample new_id joins. a1 and a2 are the centers' ids; ties go to the lower id, and a
    center is its own nearest. A sample without a distance keeps no center."""
    dp, new = distance(F.col("x"), literal(x)), F.lit(int(new_id))
    near = state.withColumn("dp", dp)
    mine = F.col("id") == new
    center = F.coalesce(F.col("id") == F.col("a1"), F.lit(False))
    first = mine | (~center & (F.col("d1").isNull() | (F.col("dp") < F.col("d1")) | ((F.col("dp") == F.col("d1")) & (new < F.col("a1")))))
    first = first & F.col("dp").isNotNull() & ~F.isnan("dp")
    second = (F.col("d2").isNull() | (F.col("dp") < F.col("d2")) | ((F.col("dp") == F.col("d2")) & (new < F.col("a2")))) & F.col("dp").isNotNull() & ~F.isnan("dp")
    return near.select(
        "id", "x",
        F.when(first, new).otherwise(F.col("a1")).alias("a1"), F.when(first, F.col("dp")).otherwise(F.col("d1")).alias("d1"),
        F.when(first, F.col("a1")).when(second, new).otherwise(F.col("a2")).alias("a2"),
        F.when(first, F.col("d1")).when(second, F.col("dp")).otherwise(F.col("d2")).alias("d2"),
    )


DENSE_STATE = "id long, x array<double>, a1 long, d1 double, a2 long, d2 double"


def _closer_dense(state: DataFrame, added: list[tuple], metric: str) -> DataFrame:
    """The same for dense vectors and several centers (id, x) one after the other, in Arrow batches."""
    m, width = Metric(metric), len(added[0][1])
    centers = [(int(i), np.array([x], float)) for i, x in added]

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            a1, a2 = (batch.column(j).fill_null(-1).to_numpy(zero_copy_only=False).copy() for j in (2, 4))
            none1, none2 = (batch.column(j).is_null().to_numpy(zero_copy_only=False).copy() for j in (2, 4))
            d1, d2 = (batch.column(j).to_numpy(zero_copy_only=False).astype(float).copy() for j in (3, 5))
            d1[none1], d2[none2] = np.inf, np.inf
            x = np.full((len(ids), width), np.nan)
            x[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            sound = ~np.isnan(x).any(1)
            for new, c in centers:
                dp = np.where(sound, m.kernel(x, c)[:, 0], np.inf)
                first = sound & ((ids == new) | (((ids != a1) | none1) & (none1 | (dp < d1) | ((dp == d1) & (new < a1)))))
                second = sound & ~first & (none2 | (dp < d2) | ((dp == d2) & (new < a2)))
                a2, d2, none2 = np.where(first, a1, np.where(second, new, a2)), np.where(first, d1, np.where(second, dp, d2)), np.where(first, none1, none2 & ~second)
                a1, d1, none1 = np.where(first, new, a1), np.where(first, dp, d1), none1 & ~first
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(a1, mask=none1), pa.array(d1, mask=none1), pa.array(a2, mask=none2), pa.array(d2, mask=none2)], names=["id", "x", "a1", "d1", "a2", "d2"])

    return state.mapInArrow(run, DENSE_STATE)


def _blank(samples: DataFrame) -> DataFrame:
    none = F.lit(None)
    return samples.select(F.col("id").cast("long").alias("id"), "x", none.cast("long").alias("a1"), none.cast("double").alias("d1"), none.cast("long").alias("a2"), none.cast("double").alias("d2"))


def kmeanspp(samples: DataFrame, k: int, seed: int, energy: Energy, distance, bins: int = 1, candidates: int = 1, metric: str | None = None) -> tuple[list[int], DataFrame | None]:
    """(ids in the order drawn, state): the first is uniform, each next one is drawn with probability in proportion to E(d1).

    bins > 1: samples are split at random into that many bins, and all but max(min(k, 50), k / bins) centers are drawn
    from one bin each in turn. candidates > 1: of that many draws per step the one that lowers the energy most is
    taken, later draws on ties. Once all energy is gone, the rest are uniform among the other ids.

    With a `metric` samples are dense vectors. Centers drawn since the state was last written are applied as it is read;
    it is written every SETTLE_EVERY centers, and the one before deleted. The state is (id, x, a1, d1, a2, d2) with
    a1 and a2 numbered in order of the centers' ids, as assignment to them would give it; None if the energy ran out.
    """
    from_bins = max(0, k - max(min(k, 50), -(-k // bins))) if bins > 1 else 0
    base = _blank(samples)
    chosen = uniform_ids(samples, 1, seed, "first")
    added = [(chosen[0], _vector(samples, chosen[0]))]

    def present() -> DataFrame:
        if metric and added:
            return _closer_dense(base, added, metric)
        out = base
        for i, x in added:
            out = _closer(out, x, i, distance)
        return out

    def drawn(pool: DataFrame, step: int, n: int) -> list[tuple]:
        weight = energy.column(F.col("d1"))
        row = pool.agg(*[F.min_by(F.struct("id", "x"), race(weight, seed, "draw", step, c, F.col("id"))).alias(f"p{c}") for c in range(n)]).first()
        return [tuple(r) for r in row if r is not None]

    for step in range(1, k):
        if len(added) > SETTLE_EVERY:
            before, base = base, settled(present())
            forget(before)
            added = []
        state = present()
        picks = drawn(state.where(F.floor(uniform(seed, "bin", F.col("id")) * bins) == (step - 1) % bins), step, candidates) if step <= from_bins else drawn(state, step, candidates)
        if not picks and step <= from_bins:
            from_bins = 0  # a bin without energy: go on with all samples
            picks = drawn(state, step, 1)
        if not picks:
            forget(base)
            return chosen + uniform_ids(samples, k - step, seed, "rest", tuple(chosen)), None
        pick, x = picks[0] if len(picks) == 1 else _best(state, picks, energy, distance)
        chosen.append(pick)
        added.append((pick, list(x) if isinstance(x, list) else x))
    numbers = samples.sparkSession.createDataFrame([(int(i), n) for n, i in enumerate(sorted(chosen))], "c long, k int")  # K rows
    near, second = numbers.toDF("c1", "k1"), numbers.toDF("c2", "k2")
    named = present().join(F.broadcast(near), F.col("a1") == F.col("c1"), "left").join(F.broadcast(second), F.col("a2") == F.col("c2"), "left")
    state = settled(named.select("id", "x", F.col("k1").alias("a1"), "d1", F.col("k2").alias("a2"), "d2"))
    forget(base)
    return chosen, state


def kmeanspp_ids(samples: DataFrame, k: int, seed: int, energy: Energy, distance, bins: int = 1, candidates: int = 1, metric: str | None = None) -> list[int]:
    """The ids alone."""
    ids, state = kmeanspp(samples, k, seed, energy, distance, bins, candidates, metric)
    if state is not None:
        forget(state)
    return ids


def _vector(samples: DataFrame, sample_id: int):
    x = samples.where(F.col("id") == int(sample_id)).select("x").first()["x"]
    return list(x) if isinstance(x, list) else x


def _best(state: DataFrame, picks: list[tuple], energy: Energy, distance) -> tuple:
    """Of the candidates (id, x) in order drawn, the one whose joining lowers the energy most; a later one on ties."""
    e1 = energy.column(F.col("d1"))
    gains = state.agg(*[F.sum(F.greatest(e1 - energy.column(distance(F.col("x"), literal(x))), F.lit(0.0))).alias(f"g{c}") for c, (_, x) in enumerate(picks)]).first()
    return picks[max((gains[c], c) for c in range(len(picks)))[1]]


def afkmc2_ids(samples: DataFrame, k: int, chain: int, seed: int, energy: Energy, distance) -> list[int]:
    """Assumption-free k-MC2: proposals from an even mixture of E(distance to the first center) and uniform, drawn in
    a few passes; then chains of length `chain` over the proposals, whose energies follow each center that is chosen."""
    first = uniform_ids(samples, 1, seed, "first")[0]
    x0 = _vector(samples, first)
    base = samples.select("id", energy.column(distance(F.col("x"), literal(x0))).alias("e0"))
    total = base.agg(F.sum("e0").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n = total["n"]
    q = (F.col("e0") / total["s"] + 1.0 / n) / 2 if total["s"] else F.lit(1.0 / n)
    weighed = base.where(F.col("id") != first).select("id", q.alias("q"))
    draws = [(s, j) for s in range(1, k) for j in range(chain)]
    picks = []
    for at in range(0, len(draws), RACES_PER_JOB):
        part = draws[at : at + RACES_PER_JOB]
        row = weighed.agg(*[F.min_by(F.struct("id", "q"), race(F.col("q"), seed, "mc2", s, j, F.col("id"))).alias(f"p{s}_{j}") for s, j in part]).first()
        picks += [(s, j, row[f"p{s}_{j}"]["id"], row[f"p{s}_{j}"]["q"]) for s, j in part]
    # the proposals, k * chain at most; each new center costs a pass over these rows, and their energies come back
    wanted = samples.sparkSession.createDataFrame([(int(i),) for i in sorted({p[2] for p in picks})] or [(first,)], "id long")
    proposed = settled(samples.join(F.broadcast(wanted), "id", "left_semi").select("id", "x"))
    near: dict[int, float] = {}

    def joins(center: int) -> None:
        e = energy.column(distance(F.col("x"), literal(_vector(samples, center))))
        for r in proposed.select("id", e.alias("e")).collect():
            near[r["id"]] = 0.0 if r["id"] == center else min(r["e"], near.get(r["id"], float("inf")))

    joins(first)
    chosen = [first]
    for s in range(1, k):
        now, weight = None, 0.0
        for _, j, i, q_i in (p for p in picks if p[0] == s):
            new = near[i] / q_i
            if now is None or (new > 0 and (weight == 0 or uniform_value(seed, "accept", s, j) < new / weight)):
                now, weight = i, new
        if weight == 0:  # the chain met chosen places only
            now = uniform_ids(samples, 1, seed, f"rest-{s}", tuple(chosen))[0]
        chosen.append(now)
        if s + 1 < k:
            joins(now)
    return chosen


def seeded(samples: DataFrame, k: int, init, seed: int, energy: Energy, distance, metric: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(medoids (k, id, x), state) by an init name or a list of ids; the state is that of k-means++, so that samples need
    not be assigned again, and None after other ways of seeding."""
    state = None
    if not isinstance(init, str):
        return from_indices(samples, list(init), k), None
    how = Init.parse(init)
    if how.kind == "uniform":
        ids = uniform_ids(samples, k, seed)
    elif how.kind == "afk-mc2":
        ids = afkmc2_ids(samples, k, how.number, seed, energy, distance)
    else:
        ids, state = kmeanspp(samples, k, seed, energy, distance, how.number if how.kind == "binned" else 1, how.number if how.kind == "greedy" else 1, metric)
    return medoids_of(samples, ids), state


def seed_medoids(samples: DataFrame, k: int, init, seed: int, energy: Energy, distance) -> DataFrame:
    """The medoids alone."""
    return seeded(samples, k, init, seed, energy, distance)[0]
