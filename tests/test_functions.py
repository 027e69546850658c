import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.functions import edit
from clustrum.functions.draws import race, uniform, uniform_value
from clustrum.functions.energy import NAMES, Energy
from clustrum.functions.metrics import Metric


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return df.select(column.alias("v")).first()["v"]


def test_golden_distances(spark):
    for name, d in {"l0": 2, "l1": 7, "l2": 5, "li": 4}.items():
        assert one(spark, Metric(name).dense(F.col("a"), F.col("b")), a=[2.0, 2.0], b=[5.0, 6.0]) == d
        assert Metric(name).kernel(np.array([[2.0, 2.0]]), np.array([[5.0, 6.0]]))[0, 0] == d
    with pytest.raises(ValueError):
        Metric("l3")


def test_sparse_equals_dense(spark):
    rng = random.Random(1)
    rows = []
    for i in range(20):
        a, b = ({k: rng.choice([1.0, 2.5, -3.0]) for k in rng.sample(range(8), 4)} for _ in range(2))
        rows.append((i, a, b, [a.get(k, 0.0) for k in range(8)], [b.get(k, 0.0) for k in range(8)]))
    df = spark.createDataFrame(rows, "id int, a map<bigint,double>, b map<bigint,double>, da array<double>, db array<double>")
    for name in ("l0", "l1", "l2", "li"):
        m = Metric(name)
        for r in df.select(m.sparse(F.col("a"), F.col("b")).alias("s"), m.dense(F.col("da"), F.col("db")).alias("d")).collect():
            assert r["s"] == pytest.approx(r["d"])


def test_triangle_inequality(spark):
    x = np.random.default_rng(0).normal(size=(12, 3))
    for name in ("l0", "l1", "l2", "li"):
        d = Metric(name).kernel(x, x)
        assert (d[:, :, None] <= d[:, None, :] + d.T[None, :, :] + 1e-9).all()


def test_energies(spark):
    options = {"exp": {"exponent_coeff": 0.5}, "squarepotential": {"critical_radius": 1.0}}
    want = {"identity": 2.0, "quadratic": 4.0, "cubic": 8.0, "log": math.log(3), "sqrt": math.sqrt(2), "exp": math.e - 1, "squarepotential": 1.0}
    for n in NAMES:
        e = Energy(n, **options.get(n, {}))
        assert one(spark, e.column(F.col("d")), d=2.0) == pytest.approx(want[n])
        assert one(spark, e.column(F.col("d")), d=0.0) == 0
        assert e.values(np.array([2.0]))[0] == pytest.approx(want[n])
    for bad in ({"name": "exp"}, {"name": "log", "exponent_coeff": 1.0}, {"name": "squarepotential"}, {"name": "quadratic", "critical_radius": 1.0}, {"name": "none"}):
        with pytest.raises(ValueError):
            Energy(**bad)


def test_draws_are_the_same_everywhere(spark):
    u = spark.range(1).select(uniform(7, "x", F.lit(12)).alias("u")).first()["u"]
    assert u == uniform_value(7, "x", 12) and 0 < u < 1
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "id long, w double")
    picks = df.agg(*[F.min_by("w", race(F.col("w"), 1, s, F.col("id"))).alias(f"p{s}") for s in range(60)]).first()
    got = list(picks)
    assert 0.0 not in got and 10 <= got.count(1.0) <= 32  # weights 1 and 2: a third of the draws


def brute_edit(a, b, indel, switch):
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                d[i][j] = min(
                    ([d[i - 1][j] + indel(a[i - 1])] if i else []) + ([d[i][j - 1] + indel(b[j - 1])] if j else [])
                    + ([d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else switch(a[i - 1], b[j - 1]))] if i and j else [])
                )
    return d[-1][-1]


def test_weighted_edit_distances(spark):
    indel = {"A": 2.0, "C": 3.0, "G": 2.5}
    switch = {(p, q): 1.5 + abs(ord(p) - ord(q)) / 4 for p in indel for q in indel if p != q}
    costs = edit.Costs(indel, switch)
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ACG", k=rng.randint(0, 6))), "".join(rng.choices("ACG", k=rng.randint(0, 6)))) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", edit.distance(F.col("a"), F.col("b"), costs).alias("d")).collect():
        want = brute_edit(r["a"], r["b"], indel.get, lambda p, q: switch[p, q])
        assert r["d"] == pytest.approx(want) == pytest.approx(edit.kernel(r["a"], r["b"], costs))


def test_normalised_golden(spark):
    costs = edit.Costs({1: 9.0, 2: 10.0}, {(1, 2): 10.0, (2, 1): 10.0})
    d = lambda a, b: one(spark, edit.distance(F.col("a"), F.col("b"), costs, True, strings=False), a=a, b=b)
    assert d([1, 2], [1, 2, 1]) + d([1, 2, 1], [2, 1]) == pytest.approx(36 / 59)
    assert d([1, 2], [2, 1]) == pytest.approx(36 / 58)


def test_cost_violations(spark):
    indel = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 4.0)], "a string, cost double")
    rows = [("a", "b", 5.0), ("b", "a", 5.0), ("a", "c", 1.0), ("c", "a", 1.5), ("b", "c", 1.0), ("c", "b", 1.0)]
    switch = spark.createDataFrame(rows, "a string, b string, cost double")
    rules = {r["rule"] for r in edit.violations(indel, switch, True).collect()}
    assert rules == {"asymmetric", "triangle", "switch above two indels", "indel above switch and indel", "unequal indels"}
    good = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "a string, b string, cost double")
    assert edit.violations(indel.where("a < 'c'"), good, True).count() == 0


def test_bounded_edit_distance_equals_the_kernel():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcd"), n)) for n in (0, 1, 2, 5, 9, 14, 14, 20)]
    tables = edit.Costs({c: 1 + i / 4 for i, c in enumerate("abcd")}, {(p, q): 1 + abs(ord(p) - ord(q)) / 8 for p in "abcd" for q in "abcd" if p != q})
    for costs in (edit.Costs(), edit.Costs(2.0, 3.0), tables):
        for a in words:
            for b in words:
                want = edit.kernel(a, b, costs)
                for limit in (0.0, 1.5, 4.0, 9.0, float("inf")):
                    got = edit.bounded(a, b, limit, costs)
                    assert (got is None) == (want > limit + 1e-9) and (got is None or abs(got - want) < 1e-9)


def test_within_a_limit_as_a_column(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("a", "zzzzzz"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(edit.within(edit.Costs(), 3.0)("a", "b")).collect()] == [3.0, None, None, 0.0]


def test_costs_from_numbers_and_arrays():
    import numpy as np

    assert edit.costs_of(1, np.float32(2)) == edit.Costs(1.0, 2.0)
    switch = [[0, 5, 4], [5, 0, 3], [4, 3, 0]]
    for s in (switch, np.array(switch).ravel()):
        got = edit.costs_of([3, 3, 4], s)
        assert got.indel == {0: 3.0, 1: 3.0, 2: 4.0} and got.switch[0, 1] == 5.0 and got.switch[2, 1] == 3.0 and len(got.switch) == 6
    for indel, switch in ((1.0, [[0.0]]), ([1.0], 2.0), ([1.0, 1.0], [[0.0]]), ([], []), ([1.0, 0.0], np.zeros(4)), ("a", "b"), (0, 1), ([[1.0]], [[0.0]])):
        with pytest.raises(ValueError):
            edit.costs_of(indel, switch)


def test_sequences_check_their_costs(spark):
    from clustrum.plans.api import Clusterer

    c = Clusterer(K=1, metric="levenshtein", energy="identity", init="uniform", max_rounds=1, max_proposals=4, max_time=1e6, level=0)
    rows = spark.createDataFrame([(0, [0, 1]), (1, [1, 1, 0]), (2, [0, 0])], "id long, x array<int>")
    good = [4.0, 4.0], [[0.0, 5.0], [5.0, 0.0]]
    d = {r["id"]: r["d"] for r in c.sequences(rows, good).labels.collect()}
    assert sorted(d) == [0, 1, 2] and min(d.values()) == 0
    with pytest.raises(ValueError, match="symbols 2, 7"):
        c.sequences(rows.union(spark.createDataFrame([(3, [7, 2])], rows.schema)), good)
    with pytest.raises(ValueError, match="no metric"):
        c.sequences(rows, ([1.0, 1.0], [[0.0, 5.0], [5.0, 0.0]]))
    with pytest.raises(ValueError, match="strings take tables"):
        c.sequences(spark.createDataFrame([(0, "ab"), (1, "b")], "id long, x string"), good)
