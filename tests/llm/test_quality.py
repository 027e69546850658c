import re

import numpy as np
from pyspark.sql import functions as F

from clustrum.llm import quality
from clustrum.llm.common import table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_by_brute_force(messy_rows):
    for text in [*(r[1] for r in messy_rows if r[1] is None or len(r[1]) < 5000), "a b c a b c d\na b\n\na b\n \n ", "x x x x", "a#b <c> |d|\x0b*e\x85f", "aa\xa0b 　 c"]:
        assert quality.statistics(text)[:5] == plain(text)


def test_forest_scores_by_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    forest = quality.IsolationForest(8, 64).fit(x)
    some = np.concatenate([x[:20], [[9, 9, 9]]])

    def walk(row):
        total = 0.0
        for f, t, left, right, path in forest.grown:
            at = 0
            while f[at] >= 0:
                at = left[at] if row[f[at]] < t[at] else right[at]
            total += path[at]
        return 2 ** (-total / 8 / float(quality._average_path(64)))

    got = forest.score(some)
    assert np.allclose(got, [walk(r) for r in some]) and got[-1] == got.max()


def test_columns_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = quality.op1_query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] < r["threshold"])


def test_verdicts_on_held_out_labels(spark):
    """Fitted and calibrated on four fifths of the labelled rows, judged on the rest."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    docs = table(spark, sf, "documents").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    out = quality.quality_rules(docs, labels.where("NOT held")).join(labels.where("held").select("doc_id", "quality"), "doc_id")
    r = out.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept, n = {x["quality"]: x["kept"] for x in r}, {x["quality"]: x["n"] for x in r}
    assert n[0] > 30 and n[1] > 300 and kept[1] >= 0.99 and kept[0] <= 0.05
    assert out.where("base_failed AND kept").count() == 0


def test_calibration():
    good, bad = np.zeros(quality.BINS), np.zeros(quality.BINS)
    good[600], bad[1400] = 100, 10
    assert 0.3 < quality.calibrate(good, bad) < 0.701
    assert quality.calibrate(good, np.zeros(quality.BINS)) == 0.6
