"""Re-mapping of dense vectors that keeps l2 distances: the leading projections first, then the residual.

Mean, variances and the covariance sample come from aggregates; the few leading directions are found on the driver by
power iteration with Gram-Schmidt, and the projection is one row-local pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform

POWER_ROUNDS = 30
MOST_DIRECTIONS = 5
NEGLIGIBLE = 1e-16


def dimension_statistics(samples: DataFrame) -> DataFrame:
    """(pos, mean, var): population statistics of each dimension."""
    return samples.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def dimension_order(samples: DataFrame) -> DataFrame:
    """(rank, pos, var) by decreasing variance, without dimensions of negligible variance; constant data is an error."""
    stats = dimension_statistics(samples).select("pos", "var").collect()
    most = max((r["var"] for r in stats), default=0.0)
    if not most > 0:
        raise ValueError("all samples are equal: there is no variance to re-map")
    kept = sorted(((r["pos"], r["var"]) for r in stats if r["var"] > NEGLIGIBLE * most), key=lambda p: (-p[1], p[0]))
    return samples.sparkSession.createDataFrame([(i, p, v) for i, (p, v) in enumerate(kept)], "rank int, pos int, var double")


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """Gram-Schmidt over the rows."""
    out = []
    for r in rows:
        for q in out:
            r = r - (r @ q) * q
        out.append(r / max(np.linalg.norm(r), 1e-300))
    return np.array(out)


def leading_directions(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n leading covariance directions of the centered rows of x."""
    q = orthonormal(np.random.default_rng(seed).normal(size=(n, x.shape[1])))
    for _ in range(POWER_ROUNDS):
        q = orthonormal((q @ x.T) @ x)
    return q


def remap(samples: DataFrame, metric: str = "l2", seed: int = 0) -> DataFrame:
    """(id, x) with x replaced by [projections | residual], in order of variance; all pairwise l2 distances stay."""
    if metric != "l2":
        raise ValueError("re-mapping keeps l2 distances only")
    stats = sorted(dimension_statistics(samples).collect(), key=lambda r: r["pos"])
    order = [r["pos"] for r in dimension_order(samples).orderBy("rank").collect()]
    mean = [float(stats[p]["mean"]) for p in order]
    n = min(len(order) // 5, MOST_DIRECTIONS)
    place = F.array(*[F.lit(p) for p in order])
    centered = F.zip_with(F.transform(place, lambda p: F.get("x", p)), F.array(*[F.lit(m) for m in mean]), lambda v, m: v - m)
    moved = samples.select("id", centered.alias("x"))
    if not n:
        return moved
    total = samples.count()
    some = moved.where(uniform(seed, "remap", F.col("id")) < min(1.0, 100 * n / max(total, 1))).orderBy("id").select("x").toPandas()["x"]
    q = leading_directions(np.array([np.asarray(v) for v in some], float).reshape(-1, len(order)), n, seed)
    axes = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in q])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)
    projected = moved.withColumn("along", F.transform(axes, lambda a: dot(F.col("x"), a)))
    rest = F.transform("x", lambda v, i: v - F.aggregate(F.zip_with("along", axes, lambda c, a: c * F.get(a, i)), F.lit(0.0), lambda s, t: s + t))
    return projected.select("id", F.concat("along", rest).alias("x"))
