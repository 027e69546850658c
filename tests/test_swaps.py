"""Swap searches: equal answers at all levels, with fewer distances, and a state that stays right over many swaps."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.functions.draws import PRIME, order_of
from clustrum.functions.energy import Energy
from clustrum.functions.metrics import Metric
from clustrum.operators import assign, kmedoids, seeding, swaps
from clustrum.plans.api import Clusterer
from clustrum.session import forget, settled, shared_folder


def frame(spark, x, more=()):
    return spark.createDataFrame([*((i, [float(v) for v in r]) for i, r in enumerate(x)), *more], "id long, x array<double>").repartition(3).cache()


def groups(n, size, seed=1, d=2):
    """Separated groups: centers far apart, members near."""
    rng = np.random.default_rng(seed)
    c = np.array(np.meshgrid(*[np.arange(5) * 20.0] * d)).reshape(d, -1).T[:n]
    return np.concatenate([rng.normal(m, 1.0, (size, d)) for m in c])


def brute(x, ids, metric, energy):
    m = Metric(metric)
    return energy.values(m.kernel(x, x[ids]).min(1)).sum()


def search(kind, df, ids, metric, energy, level, seed=5):
    m = seeding.from_indices(df, ids, len(ids))
    s = assign.nearest2_dense(df, m, metric)
    if kind == "dense":
        return swaps.DenseSearch(s, m, metric, energy, seed, level)
    return swaps.ColumnSearch(s, m, lambda a, c: assign.nearest2_dense(a, c, metric), Metric(metric).dense, energy, seed, level)


@pytest.mark.parametrize("metric", ["l0", "l1", "l2", "li"])
def test_all_levels_and_both_searches_judge_alike(spark, metric):
    x = np.round(groups(6, 20, 3) / (8 if metric == "l0" else 1), 0 if metric == "l0" else 9)
    df = frame(spark, x, [(500, None), (501, [float("nan"), 1.0])])
    ids = [0, 21, 22, 45, 70, 110]
    for energy in (Energy(), Energy("identity"), Energy("squarepotential", critical_radius=1.0)):
        found = []
        for kind, levels in (("dense", (0, 1, 2)), ("columns", (0, 1))):
            for level in levels:
                one = search(kind, df.where("id < 500") if kind == "columns" else df, ids, metric, energy, level)
                offers = one.draw(list(range(12)))
                assert all(o["id"] < 500 and o["id"] not in ids for o in offers)
                deltas = one.deltas(offers)
                found.append([(o["p"], o["k"], o["id"], deltas[o["p"]]) for o in offers])
        now = brute(x, ids, metric, energy)
        for p, k, i, _ in found[0]:
            there = list(ids)
            there[k] = i
            want = brute(x, there, metric, energy) - now
            for f in found:
                q = next(v for v in f if v[0] == p)
                assert q[1:3] == (k, i) and q[3] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("kind", ["dense", "columns"])
def test_higher_levels_compute_fewer_distances(spark, kind):
    df = frame(spark, groups(10, 40))
    ids = list(range(0, 400, 40))
    counts = []
    for level in (0, 1, 2):
        one = search(kind, df, ids, "l2", Energy(), level)
        began = one.n_dist
        one.deltas(one.draw(list(range(16))))
        counts.append(one.n_dist - began)
    assert counts[0] == 16 * 400 and counts[1] <= counts[0] / 2
    assert counts[2] < counts[1] if kind == "dense" else counts[2] == counts[1]


def test_clusters_out_of_reach_are_not_read(spark, monkeypatch):
    df = frame(spark, groups(10, 40))
    one = search("dense", df, list(range(0, 400, 40)), "l2", Energy(), 2)
    offers = [o for o in one.draw(list(range(16))) if o["a1"] == o["k"]][:1] or one.draw([0])
    read = []
    where = type(one.table).where
    monkeypatch.setattr(type(one.table), "where", lambda self, c: read.append(c) or where(self, c))
    one.deltas(offers)
    assert len(read) == 1 and "in(a1" in str(read[0])


@pytest.mark.parametrize("kind", ["dense", "columns"])
@pytest.mark.parametrize("repeats", [False, True])
def test_the_state_after_many_swaps_is_that_of_a_new_assignment(spark, kind, repeats):
    """Swaps at random, ties and repeated vectors among them; the stored state is written in between, and old ones go."""
    x = groups(4, 15, 7)
    if repeats:
        x = np.round(x / 8)
    df = frame(spark, x, [(99, None)] if kind == "dense" else [])
    one = search(kind, df, [0, 16, 31, 46], "l2", Energy(), 2 if kind == "dense" else 1)
    rng = np.random.default_rng(3)
    folder = shared_folder(spark)
    before = len(os.listdir(folder))
    for step in range(19 if kind == "dense" else 5):
        free = [i for i in range(len(x)) if i not in set(int(v) for v in one.ids)]
        i = int(rng.choice(free))
        one.accept({"p": step, "k": int(rng.integers(4)), "id": i, "x": x[i].tolist()})
    m = one.medoids()
    row = lambda r: (r["id"], r["a1"], None if r["d1"] is None else round(r["d1"], 9), r["a2"], None if r["d2"] is None else round(r["d2"], 9))
    assert sorted(map(row, one.state().collect())) == sorted(map(row, assign.nearest2_dense(df, m, "l2").collect()))
    assert len(os.listdir(folder)) <= before + 1


def test_one_medoid(spark):
    x = groups(2, 10)
    df = frame(spark, x)
    one = search("dense", df, [3], "l2", Energy(), 2)
    offers = one.draw(list(range(4)))
    for o in offers:
        assert one.deltas([o])[o["p"]] == pytest.approx(brute(x, [o["id"]], "l2", Energy()) - brute(x, [3], "l2", Energy()))
    one.accept(offers[0])
    assert {(r["a1"], r["a2"]) for r in one.state().collect()} == {(0, None)}


@pytest.mark.parametrize("patient", [False, True])
def test_levels_accept_the_same_swaps(spark, patient):
    df = frame(spark, groups(5, 30, 11))
    runs, counts = [], []
    for level, metric in ((0, "l2"), (1, "l2"), (2, "l2"), (1, None)):
        m = seeding.from_indices(df, [0, 1, 2, 3, 4], 5)
        s, medoids, rounds = kmedoids.clarans(df, m, lambda a, c: assign.nearest2_dense(a, c, "l2"), Energy(), Metric("l2").dense, 9, 6, 32, patient, level, metric=metric)
        runs.append((sorted(r["id"] for r in medoids.collect()), [round(r[4], 7) for r in rounds.log]))
        counts.append(sum(r[6] for r in rounds.log))
    assert all(r == runs[0] for r in runs)
    assert counts[1] < counts[0] and counts[2] < counts[0]


def test_screening_only_rejects(spark):
    df = frame(spark, groups(5, 200, 2))
    run = lambda level: kmedoids.clarans(df, seeding.from_indices(df, [0, 1, 2, 3, 4], 5), lambda a, c: assign.nearest2_dense(a, c, "l2"), Energy(), Metric("l2").dense, 9, 4, 64, True, level, metric="l2")
    _, _, rounds = run(3)
    log = [r[2] for r in rounds.log]
    assert all(b < a for a, b in zip(log, log[1:]))
    assert swaps.shares(1000, 5) == [0.125, 0.5] and swaps.shares(100, 5) == [] and swaps.shares(24 * 64, 1) == [1 / 64, 1 / 16, 1 / 4]


def test_orders_of_rows_are_uniform():
    h = np.random.default_rng(0).integers(0, PRIME, 50)
    wins = np.bincount([int(np.argmin(order_of(h, 3, "sample", p))) for p in range(20_000)], minlength=50)
    assert wins.min() > 250 and wins.max() < 600


@pytest.mark.parametrize("init", ["kmeans++", "kmeans++-2", "kmeans++~2"])
@pytest.mark.parametrize("metric", ["l2", None])
def test_seeding_hands_on_the_state(spark, init, metric):
    x = np.round(groups(4, 15, 7) / 6)  # many ties
    df = frame(spark, x)
    medoids, state = seeding.seeded(df, 6, init, 4, Energy(), Metric("l2").dense, metric)
    row = lambda r: (r["id"], r["a1"], round(r["d1"], 9), r["a2"], round(r["d2"], 9))
    assert sorted(map(row, state.collect())) == sorted(map(row, assign.nearest2_dense(df, medoids, "l2").collect()))


def test_seeding_without_energy_left_hands_on_nothing(spark):
    df = frame(spark, np.repeat([[0.0, 0.0], [1.0, 1.0]], 6, 0))
    medoids, state = seeding.seeded(df, 4, "kmeans++", 4, Energy(), Metric("l2").dense, "l2")
    assert medoids.count() == 4 and state is None


def test_no_assignment_follows_kmeanspp(spark, monkeypatch):
    df = frame(spark, groups(4, 20))
    seen = []
    inner = assign.nearest2_dense
    monkeypatch.setattr("clustrum.plans.api.nearest2_dense", lambda *a: seen.append(a) or inner(*a))
    options = dict(K=4, seed=2, max_rounds=2, max_proposals=16, max_time=1e6, level=2)
    r = Clusterer(init="kmeans++", **options).dense(df)
    assert not seen
    again = Clusterer(init=[q["id"] for q in seeding.seeded(df, 4, "kmeans++", 2, Energy(), Metric("l2").dense, "l2")[0].collect()], **options).dense(df)
    assert len(seen) == 1 and sorted(map(tuple, r.labels.collect())) == sorted(map(tuple, again.labels.collect()))


@pytest.mark.parametrize("metric", ["l0", "l1", "l2", "li"])
@pytest.mark.parametrize("shape", ["groups", "grid", "even"])
def test_pruned_two_nearest_equal_all_distances(metric, shape):
    rng = np.random.default_rng(8)
    k, d = 500, 6
    if shape == "groups":
        c = np.repeat(rng.normal(size=(20, d)) * 9, 25, 0) + rng.normal(size=(k, d)) * 0.1
    else:
        c = rng.integers(0, 3, (k, d)).astype(float) if shape == "grid" else rng.normal(size=(k, d))
    x = np.concatenate([c[:60], c[rng.integers(0, k, 1500)] + (rng.normal(size=(1500, d)) * 0.2 if shape != "grid" else 0)])
    ids, own = np.arange(len(x)), {i: i for i in range(60)}
    plain, pruned = assign.Centers(c, Metric(metric), own, pruned=False), assign.Centers(c, Metric(metric), own)
    for a, b in zip(plain.two_nearest(ids, x), pruned.two_nearest(ids, x)):
        assert (a == b).all()
    assert plain.n_dist == len(x) * k
    if shape == "groups" and metric != "l0":
        assert pruned.n_dist < plain.n_dist / 4


@pytest.mark.parametrize("metric", ["l0", "l1", "l2", "li"])
def test_rows_leave_early_by_the_widest_dimensions(metric):
    """Long vectors that vary in few dimensions: equal results, fewer coordinates."""
    rng = np.random.default_rng(2)
    scale = np.r_[np.full(6, 30.0), np.full(58, 0.5)][rng.permutation(64)]
    c = np.repeat(rng.normal(size=(40, 64)) * scale, 5, 0) + rng.normal(size=(200, 64)) * 0.2
    x = c[rng.integers(0, 200, 1500)] + rng.normal(size=(1500, 64)) * 0.2
    if metric == "l0":
        c, x = np.round(c), np.round(x)
    plain, pruned = assign.Centers(c, Metric(metric), pruned=False), assign.Centers(c, Metric(metric))
    for a, b in zip(plain.two_nearest((), x), pruned.two_nearest((), x)):
        assert (a == b).all()
    assert plain.n_dim == plain.n_dist * 64 and pruned.n_dim <= pruned.n_dist * 64 * 1.5
    if metric in ("l2", "l1"):
        assert pruned.n_dim < pruned.n_dist * 64


def test_pruned_assignment_counts_distances(spark):
    x = groups(20, 20)
    df = frame(spark, x, [(900, None)])
    centers = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x[::4])], "k int, x array<double>")
    counted = spark.sparkContext.accumulator(0)
    got = {r["id"]: (r["a1"], r["a2"]) for r in assign.nearest2_dense(df, centers, "l2", counted).collect()}
    order = np.argsort(Metric("l2").kernel(x, x[::4]), axis=1, kind="stable")
    assert got == {900: (None, None)} | {i: tuple(order[i, :2].tolist()) for i in range(len(x))}
    assert 0 < counted.value < len(x) * 100 / 2


def test_settled_tables_can_be_forgotten(spark):
    df = settled(spark.range(3).withColumn("v", F.lit(1)))
    assert os.path.isdir(df._settled_path)
    forget(df, spark.range(1))
    assert not os.path.isdir(df._settled_path)
