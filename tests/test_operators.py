import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.functions import edit
from clustrum.functions.energy import Energy
from clustrum.functions.metrics import Metric
from clustrum.operators import assign, balance, kmedoids, refine, remap, seeding, swaps
from clustrum.plans.api import Clusterer, kmeans, vcenters
from clustrum.streaming.score import score

L2 = Metric("l2").dense


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    return df.cache(), x


def dense(s, c):
    return assign.nearest2_dense(s, c, "l2")


def test_assignment_engines_agree_with_brute_force(spark, points):
    df, x = points
    m = seeding.from_indices(df, [3, 30, 60, 61], 4)
    d = np.sqrt(((x[:, None] - x[[3, 30, 60, 61]][None]) ** 2).sum(2))
    order = np.argsort(d, axis=1, kind="stable")
    for got in (dense(df, m), assign.nearest2(df, m, L2)):
        for r in got.collect():
            i = r["id"]
            assert (r["a1"], r["a2"]) == tuple(order[i, :2])
            assert r["d1"] == pytest.approx(d[i, order[i, 0]], abs=1e-12) and r["d2"] == pytest.approx(d[i, order[i, 1]], abs=1e-12)


def test_a_duplicate_does_not_steal_a_medoid(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [5.0])], "id long, x array<double>")
    got = {r["id"]: r["a1"] for r in dense(df, seeding.from_indices(df, [0, 1], 2)).collect()}
    assert got[0] == 0 and got[1] == 1
    one = {r["id"]: r["d2"] for r in dense(df, seeding.from_indices(df, [2], 1)).collect()}
    assert set(one.values()) == {None}


def test_swap_delta_is_the_drop_of_energy(spark, points):
    df, x = points
    m = seeding.from_indices(df, [0, 1, 2, 50], 4)
    s = dense(df, m)
    offers = swaps.proposals(s, [0, 1, 2, 50], list(range(12)), 5)
    deltas = {r["p"]: r["delta"] for r in swaps.judged(s, offers, Energy(), L2).collect()}
    energy = lambda ids: (((x[:, None] - x[ids][None]) ** 2).sum(2).min(1)).sum()
    now = energy([0, 1, 2, 50])
    for r in offers.collect():
        ids = [0, 1, 2, 50]
        ids[r["k"]] = r["id"]
        assert deltas[r["p"]] == pytest.approx(energy(ids) - now, abs=1e-9)


def test_greedy_search_does_not_depend_on_the_batch(spark, points):
    df, _ = points
    runs = []
    for batch in (1, 7, 16):
        m = seeding.from_indices(df, [0, 1, 2, 3], 4)
        _, medoids, rounds = kmedoids.clarans(df, m, dense, Energy(), L2, 9, 3, 40, False, batch=batch)
        runs.append((sorted(r["id"] for r in medoids.collect()), [round(x[4], 9) for x in rounds.log]))
    assert runs[0] == runs[1] == runs[2]


def test_voronoi_energy_does_not_increase(spark, points):
    df, _ = points
    _, _, rounds = kmedoids.voronoi(df, seeding.from_indices(df, [0, 1, 2, 99], 4), dense, Energy(), L2, 5)
    e = [x[2] for x in rounds.log]
    assert all(b <= a + 1e-12 for a, b in zip(e, e[1:])) and rounds.halt_reason == "no center moved"


@pytest.mark.parametrize("metric,energy,how", [("l2", "quadratic", "mean"), ("l1", "identity", "median")])
def test_refinement_energy_does_not_increase(spark, points, metric, energy, how):
    df, x = points
    s, c, rounds = refine.refine(df, seeding.from_indices(df, [0, 1, 60, 99], 4).select("k", "x"), metric, Energy(energy), 6)
    e = [r[2] for r in rounds.log]
    assert all(b <= a + 1e-9 for a, b in zip(e, e[1:]))
    labels = {r["id"]: r["a1"] for r in s.collect()}
    if rounds.halt_reason == "no center moved":
        for r in c.collect():
            own = x[[i for i in labels if labels[i] == r["k"]]]
            want = own.mean(0) if how == "mean" else np.sort(own, axis=0)[len(own) // 2]
            assert np.allclose(r["x"], want)
    with pytest.raises(ValueError):
        refine.objective("li", Energy())


def test_sparse_refinement_equals_dense(spark, points):
    df, x = points
    sp = df.select("id", F.map_from_arrays(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), "x").alias("x"))
    seeds = lambda d: seeding.medoids_of(d, [0, 30, 60, 99]).select("k", "x")
    a = {r["k"]: r["x"] for r in refine.refine(df, seeds(df), "l2", Energy(), 2)[1].collect()}
    b = {r["k"]: r["x"] for r in refine.refine(sp, sp.where("id IN (0, 30, 60, 99)").selectExpr("CASE id WHEN 0 THEN 0 WHEN 30 THEN 1 WHEN 60 THEN 2 ELSE 3 END AS k", "x"), "l2", Energy(), 2, is_sparse=True, distance=Metric("l2").sparse)[1].collect()}
    assert all(np.allclose([b[k][0], b[k][1]], a[k]) for k in a)


@pytest.mark.parametrize("init", ["uniform", "kmeans++", "kmeans++-3", "kmeans++~4", "afk-mc2-6"])
def test_seeds_are_distinct_and_repeatable(spark, points, init):
    df, _ = points
    ids = [[r["id"] for r in seeding.seed_medoids(d, 6, init, 3, Energy(), L2).orderBy("k").collect()] for d in (df, df.repartition(3))]
    assert ids[0] == ids[1] and len(set(ids[0])) == 6 and ids[0] == sorted(ids[0])


def test_seeding_goes_on_when_energy_is_gone(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(12)], "id long, x array<double>")
    for init in ("kmeans++", "afk-mc2-3", "kmeans++~2"):
        assert len({r["id"] for r in seeding.seed_medoids(df, 5, init, 1, Energy(), L2).collect()}) == 5


def test_bad_seeds(spark, points):
    df, _ = points
    for ids in ([1, 1], [0, 1000], [1, 2, 3]):
        with pytest.raises(ValueError):
            seeding.from_indices(df, ids, 2)
    for name in ("kmeans++-0", "kmeans++-x", "other"):
        with pytest.raises(ValueError):
            seeding.Init.parse(name)


def test_balance(spark, points):
    df, x = points
    m = seeding.from_indices(df, [0, 1, 2, 99], 4)
    labels = dense(df, m).select("id", F.col("a1").alias("k"))
    out = balance.balance(labels, m, L2)
    sizes = [r["count"] for r in out.groupBy("k").count().collect()]
    assert len(sizes) == 4 and min(sizes) >= int(100 / 6) and sum(sizes) == 100 and out.select("id").distinct().count() == 100
    with pytest.raises(ValueError):
        balance.least_size(11, 4)
    assert balance.transfer_plan({0: 1, 1: 9, 2: 5}, {(0, 1): 2.0, (0, 2): 1.0, (1, 2): 1.0}, 4) == [(2, 0, 1), (1, 0, 2)]


def test_remap_keeps_distances(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 12)) * np.arange(1, 13)
    x[:, 3] = 7.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    y = np.array([r["x"] for r in remap.remap(df).orderBy("id").collect()])
    assert y.shape[1] == 11 + 2
    of = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    assert np.allclose(of(x), of(y), atol=1e-9)
    with pytest.raises(ValueError):
        remap.remap(df, "l1")
    with pytest.raises(ValueError):
        remap.dimension_order(spark.createDataFrame([(0, [1.0]), (1, [1.0])], "id long, x array<double>"))


def test_estimator_invariants(spark, points):
    df, x = points
    r = Clusterer(K=4, seed=2, max_rounds=4, max_proposals=48, max_time=1e6, patient=True, level=3, init="kmeans++").dense(df)
    labels = r.labels.collect()
    assert sorted(q["id"] for q in labels) == list(range(100))
    m = {q["k"]: q["id"] for q in r.medoids.collect()}
    assert len(set(m.values())) == 4
    d = np.sqrt(((x[:, None] - x[[m[k] for k in range(4)]][None]) ** 2).sum(2))
    assert all(q["d"] == pytest.approx(d[q["id"]].min(), abs=1e-12) for q in labels)
    assert r.mean_energy == pytest.approx((d.min(1) ** 2).mean(), abs=1e-9)
    log = [q["mE"] for q in r.rounds.orderBy("r").collect()]
    assert all(b < a for a, b in zip(log, log[1:]))


def test_kmeans_finds_the_four_groups(spark, points):
    df, x = points
    r = kmeans(df, 4, max_rounds=6, max_proposals=64)
    assert sorted(q["count"] for q in r.labels.groupBy("k").count().collect()) == [25, 25, 25, 25]
    labelled = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (2, [1.0, 1.0])], "k int, x array<double>")
    assert {q["k"]: q["x"] for q in vcenters(labelled, 3).collect()} == {0: [2.0, 4.0], 1: None, 2: [1.0, 1.0]}


def test_estimator_rejects(spark, points):
    df, _ = points
    for options in ({"K": 2, "algorithm": "voronoi", "level": 1}, {"K": 2, "level": 4}, {"K": 2, "energy": "exp"}, {"K": 2, "init": [1]}, {"K": 2, "init": "x"}):
        with pytest.raises(ValueError):
            Clusterer(**options)
    with pytest.raises(TypeError, match="max_rounds"):
        Clusterer(K=2, max_round=3)
    for k in (0, 100):
        with pytest.raises(ValueError):
            Clusterer(K=k).dense(df)
    with pytest.raises(ValueError):
        Clusterer(K=2, do_balance_labels=True).dense(df, do_refinement=True)
    with pytest.raises(ValueError):
        Clusterer(K=2, metric="levenshtein").sequences(spark.createDataFrame([(0, ""), (1, "a"), (2, "b")], "id long, x string"))


def test_stream_scoring(spark, points, tmp_path):
    df, _ = points
    df.write.parquet(str(tmp_path / "in"))
    m = seeding.from_indices(df, [0, 30, 60, 99], 4).select("k", "x")
    q = score(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), m).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["id"], r["k"]) for r in spark.table("scored").collect()}
    assert got == {(r["id"], r["a1"]) for r in dense(df, m).collect()}


def test_null_ragged_and_nan_vectors(spark):
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "k int, x array<double>")
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [8.0, 9.0]), (3, [1.0, None]), (4, [nan, 1.0])]
    got = {r["id"]: (r["a1"], r["d1"], r["a2"]) for r in assign.nearest2_dense(spark.createDataFrame(rows, "id long, x array<double>").coalesce(1), centers).collect()}
    assert got == {0: (0, 5**0.5, 1), 1: (None, None, None), 2: (1, 1.0, 0), 3: (None, None, None), 4: (None, None, None)}
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0, 5.0, 6.0])], "id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="another length"):
        assign.nearest2_dense(ragged, centers).collect()


@pytest.mark.parametrize("swap", [(0, 7), (1, 30), (2, 99), (3, 61)])
def test_a_swap_updates_the_state_as_assignment_from_scratch(spark, points, swap):
    df, x = points
    k, new = swap
    ids = [3, 30 if k != 1 else 31, 60, 62]
    before = dense(df, seeding.from_indices(df, ids, 4))
    ids[k] = new
    m = spark.createDataFrame([(i, n, x[n].tolist()) for i, n in enumerate(ids)], "k int, id long, x array<double>")
    seen = []
    got = swaps.swapped(before, m, k, new, x[new].tolist(), lambda s, c: seen.append(s.count()) or dense(s, c), L2)
    row = lambda r: (r["id"], r["a1"], round(r["d1"], 9), r["a2"], round(r["d2"], 9))
    assert sorted(map(row, got.collect())) == sorted(map(row, dense(df, m).collect()))
    assert seen[0] < len(x)


def sequences_with_tables():
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 4, rng.integers(10, 30)).tolist()) for i in range(60)]
    switch = {(a, b): float(8 + (a + b) % 4) for a in range(4) for b in range(4) if a != b}
    return rows, edit.Costs({0: 10.0, 1: 11.0, 2: 10.0, 3: 9.0}, switch)


@pytest.mark.parametrize("init", ["kmeans++", "kmeans++~3", "afk-mc2-4"])
def test_seeding_of_integer_sequences_uses_the_cost_tables(spark, init):
    """Distances that seeding works with are those of the kernel, so that the same ids come out of a table of distances."""
    rows, costs = sequences_with_tables()
    df = spark.createDataFrame(rows, "id long, x array<int>").cache()
    by_columns = lambda a, b: edit.distance(a, b, costs, strings=False)
    by_kernel = F.udf(lambda a, b: edit.kernel(a, b, costs), "double")
    one = [r["id"] for r in seeding.seed_medoids(df, 5, init, 3, Energy("identity"), by_columns).collect()]
    two = [r["id"] for r in seeding.seed_medoids(df, 5, init, 3, Energy("identity"), by_kernel).collect()]
    assert one == two and len(set(one)) == 5


def test_a_lacking_cost_is_an_error(spark):
    _, costs = sequences_with_tables()
    df = spark.createDataFrame([([0, 1], [0, 7])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="cost of"):
        df.select(edit.distance(F.col("a"), F.col("b"), costs, strings=False)).collect()


def test_medoid_costs_do_not_depend_on_blocks(spark, points, monkeypatch):
    df, x = points
    s = dense(df, seeding.from_indices(df, [3, 60], 2)).cache()
    one = {r["id"]: r["cost"] for r in kmedoids.medoid_costs(s, Energy(), L2).collect()}
    monkeypatch.setattr(kmedoids, "BLOCK", 7)
    many = {r["id"]: r["cost"] for r in kmedoids.medoid_costs(s, Energy(), L2).collect()}
    assert sorted(one) == sorted(many) == list(range(100)) and all(abs(one[i] - many[i]) < 1e-9 for i in one)
    monkeypatch.setattr(kmedoids, "STRIPE", 3)
    for block in (7, 1000):
        monkeypatch.setattr(kmedoids, "BLOCK", block)
        blocks = {r["id"]: r["cost"] for r in kmedoids.medoid_costs_dense(s, Energy(), "l2").collect()}
        assert sorted(one) == sorted(blocks) and all(abs(one[i] - blocks[i]) < 1e-9 for i in one)


@pytest.mark.parametrize("far", [0, 10**12])
def test_last_rows_of_uneven_ids(spark, far):
    rows = [(i, i % 2) for i in range(200)] + [(far + 1000, 0)]
    got = {(r["id"], r["rank"]) for r in balance.last_rows(spark.createDataFrame(rows, "id long, k int"), {0: 5, 1: 3}).where("k = 0").collect()}
    assert got == {(far + 1000, 1), (198, 2), (196, 3), (194, 4), (192, 5)}
    whole = balance.last_rows(spark.createDataFrame(rows, "id long, k int"), {0: 101, 1: 100})
    assert whole.count() == 201 and {r["rank"] for r in whole.where("k = 1").collect()} == set(range(1, 101))


@pytest.mark.parametrize("normalised", [False, True])
@pytest.mark.parametrize("medoids", [False, True])
def test_nearest_sequences_equal_all_distances(spark, normalised, medoids):
    rows, costs = sequences_with_tables()
    rows += [(60 + i, rows[i][1]) for i in range(5)]  # repeated sequences tie
    of = {i: x for i, x in rows}
    df = spark.createDataFrame([*rows, (99, None)], "id long, x array<int>")
    chosen = [3, 60, 0, 17, 40]
    c = spark.createDataFrame([(k, i, of[i]) for k, i in enumerate(chosen)], "k int, id long, x array<int>")
    c = c if medoids else c.drop("id")

    def d(a, b):
        v = edit.kernel(a, b, costs)
        return 2 * v / (11.0 * (len(a) + len(b)) + v) if normalised else v

    for r in assign.nearest2_edit(df, c, costs, normalised).collect():
        if r["id"] == 99:
            assert [r["a1"], r["d1"], r["a2"], r["d2"]] == [None] * 4
            continue
        want = sorted(((0 if medoids and i == r["id"] else 1, round(d(r["x"], of[i]), 9), k) for k, i in enumerate(chosen)))[:2]
        assert [r["a1"], r["a2"]] == [w[2] for w in want] and [r["d1"], r["d2"]] == pytest.approx([w[1] for w in want])


def test_batched_distances_equal_the_expression(spark):
    rows, costs = sequences_with_tables()
    df = spark.createDataFrame([(rows[i][1], rows[i + 1][1]) for i in range(20)] + [(rows[0][1], None), ([], [1, 2])], "a array<int>, b array<int>")
    for normalised in (False, True):
        got = df.select(edit.batched(costs, normalised)("a", "b").alias("x"), edit.distance(F.col("a"), F.col("b"), costs, normalised, strings=False).alias("y")).collect()
        assert [r["x"] for r in got] == pytest.approx([r["y"] for r in got]) and got[20]["x"] is None
    with pytest.raises(Exception, match="no cost of"):
        spark.createDataFrame([([0, 1], [0, 7])], "a array<int>, b array<int>").select(edit.batched(costs)("a", "b")).collect()


@pytest.mark.parametrize("algorithm,init", [("clarans", "kmeans++-2"), ("clarans", "kmeans++~2"), ("voronoi", "afk-mc2-3")])
def test_clusters_of_integer_sequences_with_tables(spark, algorithm, init):
    rows, costs = sequences_with_tables()
    df = spark.createDataFrame(rows, "id long, x array<int>").cache()
    c = Clusterer(K=3, algorithm=algorithm, level=0, metric="levenshtein", energy="identity", init=init, max_rounds=2, max_proposals=20, max_time=1e6)
    r = c.sequences(df, costs)
    centers = {m["k"]: m["x"] for m in r.medoids.collect()}
    of = dict(rows)
    for q in r.labels.collect():
        assert q["d"] == pytest.approx(min(edit.kernel(of[q["id"]], x, costs) for x in centers.values()))


@pytest.mark.parametrize("init", ["kmeans++", "kmeans++-2", "kmeans++~2", "afk-mc2-3", "uniform"])
def test_sparse_vectors_with_each_seeding(spark, init):
    rows = [(i, {j: float((i * 7 + j * 3) % 5 + 1) for j in range(i % 4)}) for i in range(40)]  # some are empty
    df = spark.createDataFrame(rows, "id long, x map<bigint,double>").cache()
    r = Clusterer(K=3, init=init, max_rounds=2, max_proposals=10, max_time=1e6, level=0).sparse(df)
    centers, of = [m["x"] for m in r.medoids.collect()], dict(rows)
    far = lambda a, b: sum((a.get(j, 0) - b.get(j, 0)) ** 2 for j in {*a, *b}) ** 0.5
    for q in r.labels.collect():
        assert q["d"] == pytest.approx(min(far(of[q["id"]], c) for c in centers))
