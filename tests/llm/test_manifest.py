import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clustrum.llm import common, manifest

FIELDS = manifest.FIELDS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [v if c != "n_chars" or v is None else v + more for c, v in zip(FIELDS, row)]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root over nodes, and for each node its (is it second, sibling or none) at each level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for at, pair in enumerate(pairs):
            for j in range(len(pair)):
                for leaf_at in members[2 * at + j]:
                    paths[leaf_at].append((j, pair[1 - j] if len(pair) == 2 else ""))
        members = [sum(members[i : i + 2], []) for i in range(0, len(members), 2)]
        nodes = [h(*pair) for pair in pairs]
    return nodes[0], paths


def brute(rows, is_bad):
    null_first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (null_first(r[0]), leaf(r)))
        trees[lang] = own, *climb([leaf(r) for r in own])
    root, above = climb([trees[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, above):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths):
            path, node = path + up, leaf(r, is_bad(r))
            for second, s in path:
                node = h(s, node) if second else h(node, s)
            out.append((r[0], leaf(r), sub, root, h(*(s for _, s in path)), node, node == root))
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_messy_table_by_brute_force(spark, messy):
    rows = [tuple(r) for r in messy.select(*FIELDS).collect()]
    bad = lambda r: int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
    tampered = F.col("doc_id").isNotNull() & (common.remainder(F.col("doc_id"), 7) == 0)
    found = got(manifest.manifest(messy, tampered))
    assert found == Counter(brute(rows, bad))
    assert any(not k[-1] for k in found) and any(k[-1] for k in found)


@pytest.mark.parametrize("n, langs", [(1, 1), (2, 1), (3, 2), (7, 3), (37, 1), (64, 1), (65, 2)])
def test_sizes(spark, n, langs):
    rows = [(i * 5 % 67, f"s{i}", [None, "é", "z"][i % langs], i, "t" * i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(manifest.manifest(df)) == Counter(brute(rows, lambda r: 0))


def test_a_change_anywhere_changes_the_root(spark):
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(20)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    root = lambda rs: {r["root"] for r in manifest.manifest(spark.createDataFrame(rs, schema)).collect()}
    one = root(rows)
    assert len(one) == 1 and one == root(rows[::-1])
    assert one != root([*rows[:7], (7, "b", "en", 1, "t7"), *rows[8:]]) and one != root(rows[:-1])


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(0, 5000, 1, 13).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    rows = manifest.numbered(df, "g", "v").collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["at"])] == sorted(r["v"] for r in rows)
    assert sorted(r["at"] for r in rows) == list(range(5000)) and {r["left"] for r in rows} == {5000}


def test_crc_in_sql(spark):
    import duckdb

    texts = ["0", "7", "12345", "9223372036854775807", "-4"]
    found = duckdb.sql(f"SELECT {common.duckdb_crc32('t')} FROM (SELECT unnest({texts}) AS t)").fetchall()
    assert [f[0] for f in found] == [zlib.crc32(t.encode()) for t in texts]
