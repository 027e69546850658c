"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of each source are put in a shuffled order (a hash of id and text) and get a virtual finish time: the words their
source has served by then, divided by the source's target. All documents are then ordered by virtual time over all
sources and cut where the total budget is reached. A document can be served twice (the second pass follows the first).

No source, however large, is sorted in one task: prefix sums are taken over hash buckets first, then within a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, settled

WEIGHTS = (5, 2, 1)
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): `share` of all words by weight, at most `repeats` times
    a source's size each, the excess reshared by weight. Sources by code point, null last, take the weights in turn.

    Resharing ends where every target is the smaller of its limit and one level times its weight; in order of
    limit / weight, that level is what is left of the budget over the weights not yet filled.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    limit = F.col("source_size") * float(repeats)
    order = Window.orderBy("ratio", "rank")
    every = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        weighed.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    )
    # the level of the first source (in that order) whose limit it does not reach
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return filled.select(
        "source", "source_size", "budget",
        F.when(level.isNull() | (F.col("ratio") <= level), F.col("limit")).otherwise(level * F.col("weight")).alias("target"),
    )


def served(docs: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS, rows_per_bucket: int = 20000, steps: int = 4096) -> DataFrame:
    """What `mix` gives, with the column row of (row, doc_id, text, source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    sized = settled(docs.select(
        "row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), n_words(text).alias("size")
    ))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    largest = sources.agg(F.max("n")).first()[0] or 1
    digits = max(2, math.ceil(math.log(max(largest / rows_per_bucket, 1), 16)))

    goal = targets(sources.select("source", "source_size"), share, repeats, weights)
    bucket = F.substring("key", 1, digits)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("served"))
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(starts["source"].alias("of"), "bucket", "served", "source_size", "target", "budget")

    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queue = sized.withColumn("bucket", bucket).withColumn("own", F.sum("size").over(within))
    placed = queue.join(starts, queue["source"].eqNullSafe(starts["of"]) & (queue["bucket"] == starts["bucket"]), "left")
    finish = F.col("served") + F.col("own")
    placed = settled(placed.select(
        "row", "doc_id", "size", "key", "source_size", "target", "budget",
        *[F.when((F.col("target") > 0) & (F.col("size") > 0), (finish + i * F.col("source_size") - F.col("size") / 2) / F.col("target")).alias(f"v{i}") for i in range(repeats)],
    ))

    # the global order by virtual time: ranges of it, narrowed around the cut until so few rows are left that one task sorts them
    one = placed.select("size", "key", "doc_id", "budget", F.posexplode(F.array(*[f"v{i}" for i in range(repeats)])).alias("copy", "v")).where("v IS NOT NULL")
    low, high, before, cut = 0.0, float(2 * repeats), 0, None
    while True:
        at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / steps)), F.lit(steps - 1)).cast("int")
        inside = one.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))).withColumn("range", at)
        total, cut = before, None
        for r in inside.groupBy("range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("v").alias("from"), F.max("v").alias("to"), F.max("budget").alias("budget")).orderBy("range").collect():
            if total + r["words"] >= r["budget"]:
                cut = r
                break
            total += r["words"]
        if cut is None or cut["n"] <= 4 * rows_per_bucket or cut["to"] <= cut["from"] or (cut["from"], cut["to"]) == (low, high):
            break
        low, high, before = cut["from"], cut["to"], total
    if cut is None:
        last = float("inf"), ""
    else:
        w = Window.orderBy("v", "key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
        ranked = inside.where(F.col("range") == cut["range"]).withColumn("total", F.sum("size").over(w) + total)
        found = ranked.where(F.col("total") - F.col("size") / 2 <= F.col("budget")).agg(F.max(F.struct("v", "key")).alias("last")).first()["last"]
        last = (cut["from"], None) if found is None else (found["v"], found["key"])
    times = sum((F.when(_before(F.col(f"v{i}"), (F.lit(last[0]), F.lit(last[1]))), 1).otherwise(0) for i in range(repeats)), F.lit(0))
    return placed.select("row", "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (times * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS, rows_per_bucket: int = 20000, steps: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of (doc_id, text, source); taken is 0, 1 or 2 times size.

    A document is served if the middle of it lies before the cut, so a source ends within half a document of its
    target. The order is by md5 of the id and the text, so reruns agree; rows equal in both follow each other, and which
    of them is taken more often is not defined. Null sources form one source, null or empty texts have size 0 and are
    taken 0 times. An empty table gives an empty result.
    """
    return served(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text", "source"), share, repeats, weights, rows_per_bucket, steps).drop("row")


def _before(v: Column, cut) -> Column:
    at, key = cut
    return v.isNotNull() & ((v < at) | ((v == at) & (F.col("key") <= key)))


def op6_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents"))


ORACLE = """
WITH sized AS (SELECT row_number() OVER () AS r, doc_id, source, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM sources),
filled AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget, coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM weighed),
levels AS (SELECT *, (budget - before) / remaining AS lvl FROM filled),
filling AS (SELECT (SELECT lvl FROM levels WHERE lim / weight > lvl ORDER BY lim / weight, rank LIMIT 1) AS lvl),
goal AS (SELECT source, source_size, budget, CASE WHEN f.lvl IS NULL OR lim / weight <= f.lvl THEN lim ELSE weight * f.lvl END AS target FROM levels, filling f),
queue AS (SELECT s.*, g.source_size, g.budget, g.target, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS own
    FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
copies AS (SELECT q.*, c, (own + c * source_size - size / 2.0::DOUBLE) / target AS v FROM queue q, (SELECT unnest([0, 1]) AS c) WHERE target > 0 AND size > 0),
served AS (SELECT r, size, budget, sum(size) OVER (ORDER BY v, key, doc_id, c ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT r, sum(size) AS taken FROM served WHERE total - size / 2.0 <= budget GROUP BY r)
SELECT doc_id, size, source_size, round(target, 6)::DOUBLE AS target, coalesce(taken, 0)::BIGINT AS taken FROM queue LEFT JOIN taken USING (r)"""
