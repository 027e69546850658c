"""Merkle manifest of a dataset: a digest of each row, one root for the whole table, and a proof for each row.

A tree is a table of levels. At each level the nodes of a group are partitioned by (group, parent); one full-frame
collect_list in the order of the nodes gives both what the parent is a digest of and a node's siblings. Parents are
deduplicated before the next level, which is half as large, so all levels together cost about two of the first. Proofs
come down again from the root: a node's path is its own sibling, then its parent's path.

No group is numbered in one task: rows are range-sorted, counted by partition, and a row's place is its place within
its partition plus the rows of its group in earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import duckdb_crc32, forget, remainder, settled, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What an empty path entry says: the node is alone in its run.
ALONE = b""
LEFT, RIGHT = b"l", b"r"
SETTLE_EVERY = 4


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """The digest (32 bytes) of a row of values."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _hex(node: Column) -> Column:
    return F.lower(F.hex(node))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with at (long, from 0) by `order` within each group, nulls first, and left, the group's number of rows; a settled table."""
    placed = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    placed = settled(placed.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # one row a group and partition that holds some of it: partitions plus groups
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    starts = counts.select("_g", "_p", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("left"))
    out = placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & (part == starts["_p"]))
    out = settled(out.select(*[c for c in placed.columns if c != "at"], (F.col("at") + F.col("shift")).alias("at"), "left"))
    forget(placed)
    return out


def tree(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels and roots of the trees over (g, at, left, node, ...): at numbers the nodes of a group from 0, left is their number.

    A level is (g, at, left, node, ...) with path (the node's own entry of a proof); other columns stay at the first
    level. Roots are (g, node). While a group has several nodes, every two consecutive ones become the digest of their
    joined hex digests, and a last one alone that of its own.
    """
    levels, level, roots = [], leaves, None
    most = leaves.agg(F.max("left")).first()[0] or 0
    while True:
        done = level.where("left = 1").select("g", "node")
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            levels.append(level.withColumn("path", F.array().cast("array<binary>")))
            return levels, roots
        run = Window.partitionBy("g", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        up = level.withColumn("parent", F.shiftright("at", 1)).withColumn("run", F.collect_list("node").over(run))
        first = F.col("at") % 2 == 0
        entry = F.when(F.size("run") == 1, F.lit(ALONE)).when(first, F.concat(F.lit(RIGHT), F.get("run", F.lit(1)))).otherwise(F.concat(F.lit(LEFT), F.get("run", F.lit(0))))
        kept = settled(up.withColumn("path", F.when(F.col("left") > 1, F.array(entry)).otherwise(F.array().cast("array<binary>"))))
        levels.append(kept.drop("run"))
        parents = kept.where("left > 1").dropDuplicates(["g", "parent"])
        preimage = F.array_join(F.transform("run", _hex), "")
        level = parents.select("g", F.col("parent").alias("at"), F.shiftright(F.col("left") + 1, 1).alias("left"), F.unhex(F.sha2(preimage, 256)).alias("node"))
        most = (most + 1) // 2


def proofs(levels: list[DataFrame]) -> DataFrame:
    """The first level with whole paths: siblings from the leaf to the root of its group, each `l` or `r` (on which side
    it stands) and its digest, or empty where a node is alone."""
    path = levels[-1]
    for i, level in enumerate(reversed(levels[:-1])):
        up = path.select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("path").alias("_path"))
        inner = level.join(up, level["g"].eqNullSafe(up["_g"]) & (level["parent"] == up["_at"]) & (level["left"] > 1), "left")
        path = inner.select(*[level[c] for c in level.columns if c != "path"], F.concat("path", F.coalesce("_path", F.array().cast("array<binary>"))).alias("path"))
        if i % SETTLE_EVERY == SETTLE_EVERY - 1:
            path = settled(path)
    return path


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to, as hex."""

    def step(acc, s):
        other, side = F.lower(F.hex(F.substring(s, 2, 32))), F.substring(s, 1, 1)
        return F.sha2(F.when(F.octet_length(s) == 0, acc).when(side == F.lit(LEFT), F.concat(other, acc)).otherwise(F.concat(acc, other)), 256)

    return F.aggregate(path, _hex(node), step)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified and n_siblings of each row of (doc_id, source, lang, n_chars, text).

    Leaves of a lang ascend by doc_id (null first), rows of one doc_id by their digests; the trees of the langs are
    joined by one over their roots, in order of lang, null first. `tampered` (a condition) adds 1 to n_chars of the leaf
    that is folded and verified against the root; without it all rows verify. A null field is `-`, an empty text `0:`;
    repeated rows are leaves of their own with equal digests. An empty table gives no rows.
    """
    bad = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    fields = [F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c) for c in FIELDS]
    changed = [f + 1 if c == "n_chars" else f for c, f in zip(FIELDS, fields)]
    leaves = docs.select(fields[0].alias("doc_id"), F.col("lang").cast("string").alias("g"), row_digest(*fields).alias("node"), F.when(bad, row_digest(*changed)).alias("changed"))
    placed = numbered(leaves, "g", "doc_id", "node")
    levels, roots = tree(placed)
    roots = settled(roots.select(F.lit("").alias("all"), F.col("g").alias("lang"), "node"))
    tops = numbered(roots, "all", "lang").withColumnRenamed("all", "g")
    upper, top = tree(tops)
    root = top.select(F.col("node").alias("root"))
    over = settled(proofs(upper).select(F.col("lang").alias("g"), F.col("node").alias("subroot"), F.col("path").alias("more")))
    path = proofs(levels)
    subs = over.select(F.col("g").alias("_g"), "subroot", "more").crossJoin(F.broadcast(root))  # one row
    out = path.join(subs, path["g"].eqNullSafe(subs["_g"])).withColumn("path", F.concat("path", "more"))
    siblings = F.array_join(F.transform("path", lambda s: F.lower(F.hex(F.substring(s, 2, 32)))), "")
    fold = folded(F.coalesce("changed", "node"), F.col("path"))
    out = out.select("doc_id", F.col("g").alias("lang"), _hex(F.col("node")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
                     F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root"), F.size(F.filter("path", lambda s: F.octet_length(s) > 0)).alias("n_siblings"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = manifest(docs, F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 7) == 0))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


ORACLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang AS g, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
    CASE WHEN {duckdb_crc32("doc_id::VARCHAR")} % 7 = 0 THEN sha256({" || ".join(_field("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)}) END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id, sha256({" || ".join(map(_field, FIELDS))})) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
low AS (SELECT 0 AS lvl, g, pos, n, leaf AS node FROM leaves
    UNION ALL SELECT max(lvl) + 1, g, pos // 2, max((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, pos // 2),
subs AS MATERIALIZED (SELECT g, node AS subroot, row_number() OVER (ORDER BY g COLLATE C NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, n, subroot AS node FROM subs UNION ALL SELECT max(lvl) + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY pos // 2),
lows AS MATERIALIZED (SELECT * FROM low WHERE n > 1), highs AS MATERIALIZED (SELECT * FROM high WHERE n > 1),
fold AS (SELECT l.doc_id, l.g, 0 AS lvl, l.pos, 0 AS tier, l.n AS n, coalesce(changed, leaf) AS acc, '' AS proof, leaf FROM leaves l
    UNION ALL SELECT f.doc_id, f.g, CASE WHEN f.tier = 0 AND f.n = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN f.tier = 0 AND f.n = 1 THEN u.pos ELSE f.pos // 2 END,
        CASE WHEN f.tier = 0 AND f.n = 1 THEN 1 ELSE f.tier END, CASE WHEN f.tier = 0 AND f.n = 1 THEN u.n ELSE (f.n + 1) // 2 END,
        CASE WHEN f.tier = 0 AND f.n = 1 THEN f.acc WHEN f.pos % 2 = 0 THEN sha256(f.acc || coalesce(s.node, h.node, '')) ELSE sha256(coalesce(s.node, h.node) || f.acc) END,
        f.proof || CASE WHEN f.tier = 0 AND f.n = 1 THEN '' ELSE coalesce(s.node, h.node, '') END, f.leaf
    FROM fold f LEFT JOIN lows s ON f.tier = 0 AND f.n > 1 AND s.lvl = f.lvl AND s.g IS NOT DISTINCT FROM f.g AND s.pos = xor(f.pos, 1)
    LEFT JOIN highs h ON f.tier = 1 AND h.lvl = f.lvl AND h.pos = xor(f.pos, 1) LEFT JOIN subs u ON u.g IS NOT DISTINCT FROM f.g WHERE NOT (f.tier = 1 AND f.n = 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM fold JOIN subs ON subs.g IS NOT DISTINCT FROM fold.g, (SELECT node AS root FROM high WHERE n = 1) WHERE tier = 1 AND fold.n = 1"""
