"""Every operator on messy tables and on empty ones: as many rows as came in, and nothing crashes."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from clustrum.llm import bpe, jaccard, language, licenses, manifest, maxent, mixing, quality, repeats, runs, secrets, toxicity, vectors

OPERATORS = {
    "quality": lambda d, l: quality.quality_rules(d, l),
    "maxent": lambda d, l: maxent.score_texts(d),
    "language": lambda d, l: language.identify(d),
    "licenses": lambda d, l: licenses.license_scan(d),
    "jaccard": lambda d, l: jaccard.jaccard_groups(d),
    "mixing": lambda d, l: mixing.mix(d),
    "bpe": lambda d, l: bpe.bpe_round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "secrets": lambda d, l: secrets.secret_scan(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "repeats": lambda d, l: repeats.remove_repeats(d),
    "runs": lambda d, l: runs.periodic_runs(d),
    "manifest": lambda d, l: manifest.manifest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_and_empty(name, messy, messy_rows, empty, some_labels):
    out = OPERATORS[name](messy, some_labels)
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in messy_rows)
    none = OPERATORS[name](empty, some_labels.limit(0))
    assert none.count() == 0 and none.columns == out.columns
    assert OPERATORS[name](messy, some_labels.limit(0)).count() == len(messy_rows)


def test_vectors_messy_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (8, [1.0]), (9, [3.0]),
            (10, [0.0, 1.0]), (11, [-1.0, 0.0]), (12, [float("inf"), 1.0]), (10, [0.0, 1.0]), (13, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())
    want = [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True),
            (9, 1, 8, False), (10, 2, 10, True), (10, 2, 10, True), (11, 0, 11, True), (12, 0, 12, True), (13, 2, 10, False)]
    assert got == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_repeated_and_null_ids(spark):
    """n_links and component_id by brute force over rows, whatever their ids; ids above 2 ** 53 stay whole."""
    big = 2**60 + 1
    sets = [
        [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])],
        [(None, [-1.0, 0.0]), (7, [-1.0, 0.01]), (8, [0.0, 1.0])],
        [(None, [1.0, 0.0]), (None, [1.0, 0.02]), (None, [0.0, 1.0]), (big, [0.0, -1.0]), (big + 1, [0.01, -1.0]), (big, [-1.0, 0.0])],
        [(5, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [1.0, 0.2]), (3, [1.0, 0.3]), (5, [0.0, 1.0]), (5, [0.0, 1.0])],
    ]
    for rows in sets:
        x = np.array([r[1] for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link = x @ x.T >= 0.95
        reach = np.linalg.matrix_power(link.astype(int), len(rows)) > 0
        want = []
        for i, (vec_id, _) in enumerate(rows):
            name = min((rows[j][0] for j in np.flatnonzero(reach[i]) if rows[j][0] is not None), default=None)
            want.append((vec_id, int(link[i].sum()) - 1, name, vec_id == name))
        got = [tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
