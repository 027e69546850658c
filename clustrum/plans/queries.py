"""Registered queries of the clustering library; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edit
from ..functions.energy import NAMES, Energy
from ..functions.metrics import Metric
from ..operators import assign, balance, kmedoids, refine, remap, seeding, swaps
from ..session import settled
from ..sources import text, vectors

K = 10
SEED = 1011
INDEL, SWITCH = 2.0, 3.0
TABLE_LIMIT = 14.0


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, sf_dir) -> DataFrame:
    return vectors.dense(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def items(spark, sf_dir) -> DataFrame:
    """Line items as 4-dimensional vectors; the id joins the two key columns and need not be unique here."""
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return vectors.dense(li, "id", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def medoids(spark, sf_dir, k: int = K) -> DataFrame:
    """Seeds given by index: the first k ids."""
    return seeding.from_indices(samples(spark, sf_dir), list(range(k)), k)


def state(spark, sf_dir, metric: str = "l2", k: int = K) -> DataFrame:
    return assign.nearest2_dense(samples(spark, sf_dir), medoids(spark, sf_dir, k), metric)


def dist_dense(spark, sf_dir) -> DataFrame:
    pairs = samples(spark, sf_dir).crossJoin(F.broadcast(medoids(spark, sf_dir).select("k", F.col("x").alias("c"))))
    return pairs.select("id", "k", *[F.round(Metric(m).dense(F.col("x"), F.col("c")), 6).alias(m) for m in ("l0", "l1", "l2", "li")])


def terms(spark, sf_dir) -> DataFrame:
    """Documents as sparse counts of lower-case letters and digits by code point: row-local counts of UTF-8 bytes in
    Arrow batches, no shuffle."""
    codes = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)

    def count(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = np.array([np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256)[codes] for t in texts]).reshape(-1, len(codes))
            row, at = np.nonzero(n)
            ends = np.concatenate([[0], np.cumsum((n > 0).sum(1))])
            x = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[at], pa.int64()), pa.array(n[row, at], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["id", "x"])

    low = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("t"))
    return low.mapInArrow(count, "id long, x map<bigint,double>").where(F.size("x") > 0)


def dist_sparse(spark, sf_dir) -> DataFrame:
    x = settled(terms(spark, sf_dir))
    c = x.where("id < 3").select(F.col("id").alias("k"), F.col("x").alias("c"))
    return x.crossJoin(F.broadcast(c)).select("id", "k", *[F.round(Metric(m).sparse(F.col("x"), F.col("c")), 6).alias(m) for m in ("l0", "l1", "l2", "li")])


def names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("s")).distinct()


def _name_pairs(spark, sf_dir) -> DataFrame:
    n = settled(names(spark, sf_dir))
    return n.select(F.col("s").alias("a")).join(n.select(F.col("s").alias("b")), F.col("a") < F.col("b"))


def edit_unit(spark, sf_dir) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", edit.distance(a, b).alias("d"), F.round(edit.distance(a, b, normalised=True), 6).alias("normalised"))


def edit_weighted(spark, sf_dir) -> DataFrame:
    costs = edit.Costs(INDEL, SWITCH)
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(edit.distance(a, b, costs), 6).alias("d"), F.round(edit.distance(a, b, costs, normalised=True), 6).alias("normalised"))


def edit_tables(spark, sf_dir) -> DataFrame:
    """Names under costs by symbol: the distance, and whether it is found within a limit (null beyond it)."""
    used = [r["symbol"] for r in text.alphabet(names(spark, sf_dir)).collect()]
    costs = edit.Costs({a: 2 + ord(a) % 3 * 0.25 for a in used}, {(a, b): 1 + abs(ord(a) - ord(b)) / 64 for a in used for b in used if a != b})
    pairs = _name_pairs(spark, sf_dir)
    return pairs.select("a", "b", F.round(edit.within(costs)("a", "b"), 6).alias("d"), F.round(edit.within(costs, TABLE_LIMIT)("a", "b"), 6).alias("near"))


def event_sequences(spark, sf_dir) -> DataFrame:
    """Per user the events in order, one letter each: position of the type in the sorted list of types."""
    e = table(spark, sf_dir, "events")
    codes = {r["event_type"]: chr(97 + i) for i, r in enumerate(e.select("event_type").distinct().orderBy("event_type").collect())}
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("event_type"))
    seq = F.array_sort(F.collect_list(F.struct("ts", "event_id", letter.alias("c"))))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.transform(seq, lambda s: s["c"]), "").alias("s"))


def event_sequences_edit(spark, sf_dir) -> DataFrame:
    s = settled(event_sequences(spark, sf_dir))
    first = s.orderBy("id").limit(3).select(F.col("id").alias("k"), F.col("s").alias("c"))
    return s.crossJoin(F.broadcast(first)).select("id", "k", F.length("s").alias("n"), edit.distance(F.col("s"), F.col("c")).alias("d"))


def energies(spark, sf_dir) -> DataFrame:
    d = state(spark, sf_dir).select("id", F.col("d1").alias("d"))
    options = {"exp": {"exponent_coeff": 0.7}, "squarepotential": {"critical_radius": 1.2}}
    return d.select("id", *[F.round(Energy(n, **options.get(n, {})).column(F.col("d")), 6).alias(n) for n in NAMES])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def assign_nearest2(spark, sf_dir) -> DataFrame:
    return _rounded(state(spark, sf_dir).drop("x"), "d1", "d2")


def assign_nearest2_l1_columns(spark, sf_dir) -> DataFrame:
    return _rounded(assign.nearest2(samples(spark, sf_dir), medoids(spark, sf_dir), Metric("l1").dense).drop("x"), "d1", "d2")


def assign_items(spark, sf_dir) -> DataFrame:
    """Sizes and energies of line items around given vectors, by the Arrow kernel."""
    rows = [(k, [5.0 * k + 1, 9000.0 * k + 1000, 0.01 * k, 0.08 - 0.01 * k]) for k in range(K)]
    centers = spark.createDataFrame(rows, "k int, x array<double>")
    s = assign.nearest2_dense(items(spark, sf_dir), centers, "l2")
    return s.groupBy(F.col("a1").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("d1"), 4).alias("mean_d"), F.round(F.max("d1"), 4).alias("max_d"))


def cluster_stats(spark, sf_dir) -> DataFrame:
    s = assign.with_medoid_flag(state(spark, sf_dir), medoids(spark, sf_dir))
    out = assign.cluster_statistics(s, Energy())
    return _rounded(out, "energy", "mean_energy", "max_margin", "sum_margin", "r1", "r2", "m_mean", "m_star_mean")


def center_center(spark, sf_dir) -> DataFrame:
    return _rounded(assign.center_distances(medoids(spark, sf_dir), Metric("l2").dense), "d")


def nearest_center(spark, sf_dir) -> DataFrame:
    return _rounded(assign.nearest_center(medoids(spark, sf_dir), Metric("l2").dense), "d")


def _ids(spark, ids) -> DataFrame:
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(sorted(ids))], "k int, id long")


def seed_uniform(spark, sf_dir) -> DataFrame:
    return _ids(spark, seeding.uniform_ids(samples(spark, sf_dir), 8, SEED))


def seed_kmeanspp(spark, sf_dir) -> DataFrame:
    return _ids(spark, seeding.kmeanspp_ids(samples(spark, sf_dir), 5, SEED, Energy(), Metric("l2").dense, metric="l2"))


def seed_state(spark, sf_dir) -> DataFrame:
    """The state that k-means++ hands on: nearest and second-nearest of its 5 centers, without assigning the samples again."""
    _, s = seeding.kmeanspp(samples(spark, sf_dir), 5, SEED, Energy(), Metric("l2").dense, metric="l2")
    return _rounded(s.drop("x"), "d1", "d2")


def seed_kmeanspp_binned(spark, sf_dir) -> DataFrame:
    return _ids(spark, seeding.kmeanspp_ids(samples(spark, sf_dir), 53, SEED, Energy(), Metric("l2").dense, bins=20, metric="l2"))


def seed_kmeanspp_greedy(spark, sf_dir) -> DataFrame:
    return _ids(spark, seeding.kmeanspp_ids(samples(spark, sf_dir), 4, SEED, Energy(), Metric("l2").dense, candidates=3, metric="l2"))


def seed_afkmc2(spark, sf_dir) -> DataFrame:
    return _ids(spark, seeding.afkmc2_ids(samples(spark, sf_dir), 4, 5, SEED, Energy(), Metric("l2").dense))


def swap_delta(spark, sf_dir) -> DataFrame:
    search = swaps.DenseSearch(state(spark, sf_dir), medoids(spark, sf_dir), "l2", Energy(), SEED, 0)
    return _judged(spark, search)


def swap_delta_pruned(spark, sf_dir) -> DataFrame:
    """The same by bounds: whole clusters and most samples are settled without a distance."""
    search = swaps.DenseSearch(state(spark, sf_dir), medoids(spark, sf_dir), "l2", Energy(), SEED, 2)
    return _judged(spark, search)


def _judged(spark, search) -> DataFrame:
    offers = search.draw(list(range(16)))
    found = search.deltas(offers)
    return spark.createDataFrame([(o["p"], o["k"], o["id"], found[o["p"]]) for o in offers], "p int, k int, id long, delta double").withColumn("delta", F.round("delta", 6))


def clarans_greedy(spark, sf_dir) -> DataFrame:
    return _clarans(spark, sf_dir, False)


def clarans_patient(spark, sf_dir) -> DataFrame:
    return _clarans(spark, sf_dir, True)


def clarans_level1(spark, sf_dir) -> DataFrame:
    """Greedy search with clusters eliminated by their radii."""
    return _clarans(spark, sf_dir, False, 1)


def clarans_level2(spark, sf_dir) -> DataFrame:
    """Patient search with center distances kept across swaps."""
    return _clarans(spark, sf_dir, True, 2)


def _clarans(spark, sf_dir, patient, level=0) -> DataFrame:
    x = samples(spark, sf_dir)
    s, m, _ = kmedoids.clarans(x, medoids(spark, sf_dir), lambda s, c: assign.nearest2_dense(s, c, "l2"), Energy(), Metric("l2").dense, SEED, 2, 64, patient, level, batch=16, metric="l2")
    per = s.groupBy(F.col("a1").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.round(F.sum(F.col("d1") * F.col("d1")), 6).alias("energy"))
    return m.select("k", "id").join(per, "k")


def voronoi(spark, sf_dir) -> DataFrame:
    s, m, _ = kmedoids.voronoi(samples(spark, sf_dir), medoids(spark, sf_dir), lambda s, c: assign.nearest2_dense(s, c, "l2"), Energy(), Metric("l2").dense, 2, metric="l2")
    per = s.groupBy(F.col("a1").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.round(F.sum(F.col("d1") * F.col("d1")), 6).alias("energy"))
    return m.select("k", "id").join(per, "k")


def voronoi_round(spark, sf_dir) -> DataFrame:
    s = settled(state(spark, sf_dir))
    costs = kmedoids.medoid_costs_dense(s, Energy(), "l2")
    return costs.groupBy("k").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "id")).alias("b")).select("k", F.col("b.id").alias("id"), F.round("b.cost", 6).alias("cost"))


def _flat(centers: DataFrame) -> DataFrame:
    return centers.select("k", F.posexplode("x").alias("pos", "v")).select("k", "pos", F.round("v", 6).alias("v"))


def vcenters(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("k"), F.col("embedding").cast("array<double>").alias("x"))
    return _flat(refine.vector_centers(e))


def vmedians(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("k"), F.col("embedding").cast("array<double>").alias("x"))
    return _flat(refine.vector_centers(e, "median"))


def refine_l2(spark, sf_dir) -> DataFrame:
    _, c, _ = refine.refine(samples(spark, sf_dir), medoids(spark, sf_dir), "l2", Energy(), 2)
    return _flat(c)


def refine_yinyang(spark, sf_dir) -> DataFrame:
    """The same centers with bounds by groups of centers."""
    _, c, _ = refine.refine(samples(spark, sf_dir), medoids(spark, sf_dir, 20), "l2", Energy(), 3, algorithm="yinyang")
    return _flat(c)


def refine_exponion(spark, sf_dir) -> DataFrame:
    """Line items around the first four, with centers looked at in order of their distance from a row's own."""
    c = spark.createDataFrame([(k, [5.0 * k + 1, 9000.0 * k + 1000, 0.01 * k, 0.08 - 0.01 * k]) for k in range(K)], "k int, x array<double>")
    _, c, _ = refine.refine(items(spark, sf_dir), c, "l2", Energy(), 2, algorithm="exponion")
    return c.select("k", F.posexplode("x").alias("pos", "v")).select("k", "pos", F.round("v", 4).alias("v"))


def item_medians(spark, sf_dir) -> DataFrame:
    """Upper medians of line items by return flag and status, narrowed to ranges of at most 1000 values."""
    long = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.posexplode(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("pos", "v"))
    return refine.upper_medians(long, held=1000)


def assign_many(spark, sf_dir) -> DataFrame:
    """Nearest two of 200 centers, pruned in groups."""
    return _rounded(state(spark, sf_dir, k=200).drop("x"), "d1", "d2")


def refine_l1(spark, sf_dir) -> DataFrame:
    _, c, _ = refine.refine(samples(spark, sf_dir), medoids(spark, sf_dir), "l1", Energy("identity"), 2)
    return _flat(c)


def refine_sparse_l2(spark, sf_dir) -> DataFrame:
    x = settled(terms(spark, sf_dir))
    seeds = x.where("id < 3").select(F.col("id").cast("int").alias("k"), "x")
    _, c, _ = refine.refine(x, seeds, "l2", Energy(), 1, is_sparse=True, distance=Metric("l2").sparse)
    return c.select("k", F.explode("x").alias("i", "v")).select("k", "i", F.round("v", 6).alias("v"))


def balance_labels(spark, sf_dir) -> DataFrame:
    s = settled(state(spark, sf_dir))
    out = balance.balance(s.select("id", F.col("a1").alias("k")), medoids(spark, sf_dir), Metric("l2").dense)
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"))


def dim_variance_order(spark, sf_dir) -> DataFrame:
    return _rounded(remap.dimension_order(samples(spark, sf_dir)), "var")


def vdimap_distances(spark, sf_dir) -> DataFrame:
    x = settled(remap.remap(samples(spark, sf_dir)))
    c = x.where("id < 3").select(F.col("id").alias("k"), F.col("x").alias("c"))
    return x.crossJoin(F.broadcast(c)).select("id", "k", F.round(Metric("l2").dense(F.col("x"), F.col("c")), 5).alias("d"))


def alphabet(spark, sf_dir) -> DataFrame:
    return text.alphabet(names(spark, sf_dir))


def cost_violations(spark, sf_dir) -> DataFrame:
    """Nations as symbols: indel 1, switch grows with the distance of their keys, so some rules are broken."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("key"))
    indel = n.select("a", F.lit(3.0).alias("cost"))
    m = n.select(F.col("a").alias("b"), F.col("key").alias("other"))
    switch = n.join(m, F.col("a") != F.col("b")).select("a", "b", (F.abs(F.col("key") - F.col("other")) * F.lit(0.5)).alias("cost"))
    return edit.violations(indel, switch, True).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            assign_nearest2, assign_nearest2_l1_columns, assign_items, cluster_stats, dist_dense, dist_sparse, energies, center_center, nearest_center,
            edit_unit, edit_weighted, edit_tables, event_sequences_edit, seed_uniform, seed_kmeanspp, seed_state, seed_kmeanspp_binned, seed_kmeanspp_greedy, seed_afkmc2,
            swap_delta, swap_delta_pruned, clarans_greedy, clarans_patient, clarans_level1, clarans_level2, voronoi_round, voronoi, vcenters, vmedians, item_medians, assign_many, refine_l2, refine_yinyang, refine_exponion, refine_l1, refine_sparse_l2,
            balance_labels, dim_variance_order, vdimap_distances, alphabet, cost_violations,
        )
    }
