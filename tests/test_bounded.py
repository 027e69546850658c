"""Refinement with bounds, and exact medians of large groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.functions.energy import Energy
from clustrum.functions.metrics import Metric
from clustrum.operators import bounded, refine
from clustrum.plans.api import Clusterer


def data(shape, seed, n=400):
    rng = np.random.default_rng(seed)
    if shape == "groups":
        return np.concatenate([rng.normal(m, 1.0, (n // 8, 3)) for m in rng.uniform(-60, 60, (8, 3))])
    if shape == "grid":
        return rng.integers(0, 4, (n, 2)).astype(float)
    return rng.normal(size=(n, 6))


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("shape", ["groups", "grid", "even"])
@pytest.mark.parametrize("kind", [bounded.Yinyang, bounded.Exponion])
def test_steps_equal_all_distances(kind, metric, shape):
    """Nearest centers, ties by the lowest, and bounds that hold, over rounds of moving centers."""
    m, x = Metric(metric), data(shape, 3)
    rng = np.random.default_rng(1)
    c = x[rng.choice(len(x), 40, replace=False)] + (0 if shape == "grid" else 0.01)
    run = kind(c, m)
    run.prepare(c)
    a1, d1, lb, _ = run.first(x)
    computed = 0
    for r in range(8):
        moved = c + (rng.integers(-1, 2, c.shape) * (rng.random((len(c), 1)) < 0.2) if shape == "grid" else rng.normal(size=c.shape) * 0.5 ** (r + 1))
        falls = run.moved(np.array([m.kernel(p[None], q[None])[0, 0] for p, q in zip(c, moved)]))
        c = moved
        run.prepare(c)
        bounds = lb - falls
        a1, d1, lb, n = run.step(x, a1.copy(), bounds - bounded.ROOM * np.abs(bounds))
        computed += n
        d = m.kernel(x, c)
        assert (a1 == d.argmin(1)).all() and np.allclose(d1, d.min(1), atol=1e-12)
        d[np.arange(len(x)), a1] = np.inf
        true = np.stack([d[:, g].min(1) for g in run.groups], 1) if kind is bounded.Yinyang else d.min(1)[:, None]
        assert (lb <= true * (1 + 1e-9) + 1e-9).all()
    if shape == "groups":
        assert computed < 8 * len(x) * len(c) / 3


def frame(spark, x, more=()):
    return spark.createDataFrame([*((i, [float(v) for v in r]) for i, r in enumerate(x)), *more], "id long, x array<double>").repartition(3).cache()


@pytest.mark.parametrize("algorithm", ["yinyang", "exponion"])
@pytest.mark.parametrize("metric, energy", [("l2", "quadratic"), ("l1", "identity")])
def test_refinement_with_bounds_gives_the_same_centers(spark, algorithm, metric, energy):
    x = data("groups", 5)
    df = frame(spark, x, [(900, None), (901, [1.0, None, 2.0])])
    start = spark.createDataFrame([(k * 3, [float(v) for v in x[k * 17]]) for k in range(20)], "k int, x array<double>")
    rounds = 4 if metric == "l2" else 2
    _, want, _ = refine.refine(df.where("id < 900"), start, metric, Energy(energy), rounds)
    state, got, log = refine.refine(df, start, metric, Energy(energy), rounds, algorithm=algorithm)
    want, got = ({r["k"]: r["x"] for r in t.collect()} for t in (want, got))
    assert sorted(want) == sorted(got) and all(np.allclose(want[k], got[k], atol=1e-9) for k in want)
    ks = sorted(got)
    order = np.argsort(Metric(metric).kernel(x, np.array([got[k] for k in ks])), axis=1, kind="stable")
    labels = {r["id"]: (r["a1"], r["a2"]) for r in state.collect()}
    assert labels == {900: (None, None), 901: (None, None)} | {i: (ks[order[i, 0]], ks[order[i, 1]]) for i in range(len(x))}
    n_dist = [r[6] for r in log.log]
    assert all(n < len(x) * 20 for n in n_dist) and n_dist[-1] < n_dist[0]


def test_names_of_algorithms(spark):
    assert [bounded.name_of("auto", w) for w in (4, 5)] == ["exponion", "yinyang"]
    with pytest.raises(ValueError):
        bounded.name_of("elkan", 3)
    df = frame(spark, data("groups", 2, 80))
    runs = [Clusterer(K=3, seed=1, max_rounds=1, max_proposals=8, max_time=1e6).dense(df, do_refinement=True, rf_max_rounds=3, rf_alg=a) for a in ("standard", "auto")]
    assert np.allclose(*[[r["x"] for r in run.centers.orderBy("k").collect()] for run in runs])


@pytest.mark.parametrize("wide", [3, 70])
def test_partial_means(spark, wide):
    rng = np.random.default_rng(1)
    x, a = rng.normal(size=(200, wide)), rng.integers(0, 4, 200)
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(a, x)] + [(None, None)], "a1 int, x array<double>").repartition(3)
    got = bounded.partial_means(df, 6, wide)
    assert sorted(got) == [0, 1, 2, 3] and all(np.allclose(got[k], x[a == k].mean(0)) for k in got)


@pytest.mark.parametrize("held", [5, 100, 10**6])
def test_upper_medians_are_exact(spark, held):
    rng = np.random.default_rng(6)
    groups = {
        ("a", 0): rng.normal(size=3001), ("a", 1): rng.integers(0, 3, 2000).astype(float), ("b", 0): np.full(1500, 7.0), ("b", 1): np.r_[np.full(900, -np.inf), rng.normal(size=901), [np.inf]],
        ("c", 0): np.array([2.0]), ("c", 1): np.array([1.0, 2.0]), ("d", 0): np.exp(rng.normal(size=999) * 20), ("d", 1): np.array([3.0, 1.0, 2.0, 5.0, 4.0, 6.0]),
    }
    rows = [(k, p, float(v)) for (k, p), vs in groups.items() for v in vs] + [("a", 0, None), ("e", 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(k), int(p), None if v is None else float(v)) for k, p, v in rows], "k string, pos int, v double")
    got = {(r["k"], r["pos"]): r["v"] for r in refine.upper_medians(df, held, accuracy=200).collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}


def test_medians_of_many_different_values(spark):
    """A million values of one group, narrowed: no more than `held` of them are ever in a list."""
    df = spark.range(0, 1_000_000, 1, 4).select(F.lit(0).alias("k"), F.lit(0).alias("pos"), ((F.col("id") * 7919 + 13) % 1_000_003).cast("double").alias("v"))
    got = refine.upper_medians(df, held=1000).collect()
    want = np.sort((np.arange(1_000_000) * 7919 + 13) % 1_000_003)[500_000]
    assert [(r["k"], r["pos"], r["v"]) for r in got] == [(0, 0, float(want))]
