"""Quality rules: an isolation forest over rule statistics.

Every text gets rule statistics (shares of symbols, repeated words and lines, capitals; lengths). Random split trees are grown
on a bounded sample of rows labelled good; a document whose path through them is short is isolated easily, so it is
anomalous. The rejection threshold is calibrated on the scores of all labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, sampled, settled, words_of

SYMBOLS = "#*$%&|<>"
#: Shares of capitals among letters, symbols among characters, repeated words, repeated lines; characters of a word; log of the words.
FEATURES = ("f_upper", "f_symbols", "f_repeat", "f_dup_lines", "f_word_chars", "f_words")
STAT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(
    f"{f} double" for f in FEATURES
)
_BLANKS = [32, *range(9, 14)]
_SYMBOL_BYTES = [ord(c) for c in SYMBOLS]


def repeated_words(words: list[str]) -> int:
    """How many words stand in a window of three words that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, covered_to = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return total


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def statistics(text: str | None) -> tuple:
    """The rule statistics of one text: the five counts, then FEATURES."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars = len(text) - int(by_byte[_BLANKS].sum())
    symbols = int(by_byte[_SYMBOL_BYTES].sum())
    dup_lines, repeats = duplicate_lines(text), repeated_words(words)
    per = 1.0 / max(n, 1)
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    features = upper / max(upper + lower, 1), symbols / max(chars, 1), repeats * per, dup_lines / (1 + text.count("\n")), chars * per, math.log(max(n, 1))
    return n, chars, symbols, dup_lines, repeats, *features


def rule_statistics(docs: DataFrame) -> DataFrame:
    """row, doc_id, the five counts and FEATURES of each row of (row, doc_id, text)."""
    return map_columns(
        docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")),
        lambda rows, ids, texts: [rows, ids, *zip(*map(statistics, texts))] if ids else [[]] * (7 + len(FEATURES)),
        "row long, " + STAT_SCHEMA,
    )


def _average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random split trees over rows of `x`; `score` is 2 ** (-mean path / expected path), near 1 for anomalies."""

    def __init__(self, trees: int = 96, rows_per_tree: int = 256, seed: int = 7):
        self.trees, self.rows_per_tree, self.seed = trees, rows_per_tree, seed

    def fit(self, x: np.ndarray) -> "IsolationForest":
        rng = np.random.default_rng(self.seed)
        self.low, self.high = (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        # splits are drawn over a widened range, so that a value outside what the sample shows is cut off early
        pad = 0.5 * np.maximum(self.high - self.low, 1e-3)
        size = min(self.rows_per_tree, len(x))
        self.size = max(size, 2)
        depth = max(1, math.ceil(math.log2(self.size)))
        self.grown = [self._grow(x[rng.choice(len(x), size, replace=False)] if size else x, self.low - pad, self.high + pad, depth, rng) for _ in range(self.trees)]
        return self

    @staticmethod
    def _grow(x, low, high, depth, rng):
        nodes = []  # feature (-1: leaf), threshold, left, right, path length

        def grow(rows, low, high, at):
            me = len(nodes)
            nodes.append(None)
            if at >= depth or len(rows) <= 1:
                nodes[me] = (-1, 0.0, 0, 0, at + float(_average_path(len(rows))))
                return me
            f = int(rng.integers(x.shape[1]))
            t = float(rng.uniform(low[f], high[f]))
            inner_high, inner_low = high.copy(), low.copy()
            inner_high[f], inner_low[f] = t, t
            below = rows[:, f] < t
            left = grow(rows[below], low, inner_high, at + 1)
            right = grow(rows[~below], inner_low, high, at + 1)
            nodes[me] = (f, t, left, right, 0.0)
            return me

        grow(x, low, high, 0)
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, path in self.grown:
            at = np.zeros(len(x), int)
            while (feature[at] >= 0).any():
                f = feature[at]
                go_left = x[rows, np.maximum(f, 0)] < threshold[at]
                at = np.where(f < 0, at, np.where(go_left, left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.grown) / max(float(_average_path(self.size)), 1e-9))


BINS = 2000


def calibrate(good: np.ndarray, bad: np.ndarray, most_good_lost: float = 0.002, default: float = 0.6) -> float:
    """The score from which documents are rejected, from histograms of labelled scores over BINS: of the thresholds
    that lose at most `most_good_lost` of the good rows, the middle of those that find most bad rows."""
    if not bad.sum():
        return max(default, (np.nonzero(good)[0].max() + 1) / BINS if good.sum() else 0.0)
    lost = 1 - np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1)
    found = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    allowed = lost <= most_good_lost
    best = found[allowed].max()
    at = np.nonzero(allowed & (found >= best - 1e-12))[0]
    return float((at[0] + at[-1]) / 2 / BINS)


def verdicts(docs: DataFrame, labels: DataFrame, fit_rows: int = 16384, trees: int = 96, rows_per_tree: int = 256, seed: int = 7) -> DataFrame:
    """What `quality_rules` gives, with the column row of (row, doc_id, text)."""
    stats = settled(rule_statistics(docs))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sound = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    known = settled(stats.where(sound).join(marked, "doc_id").select("quality", "doc_id", *FEATURES))
    good = known.where("quality = 1")
    fitted = good if good.limit(1).count() else stats
    rows = sampled(fitted, F.col("doc_id"), fitted.count(), fit_rows).select(*FEATURES).toPandas().to_numpy(float)
    rows = rows[np.lexsort(rows.T[::-1])] if len(rows) else rows.reshape(0, len(FEATURES))
    forest = IsolationForest(trees, rows_per_tree, seed).fit(rows)

    scored_known = _scored(known, forest, ("quality",), "quality int").groupBy("quality", F.least((F.col("score") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin")).count().collect()
    hist = np.zeros((2, BINS))
    for r in scored_known:
        hist[1 if r["quality"] == 1 else 0, r["bin"]] += r["count"]
    threshold = calibrate(hist[1], hist[0])

    counts = ("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    scored = _scored(stats, forest, counts, ", ".join(f"{c} long" for c in counts))
    failed = ~sound
    return scored.select(
        *counts, failed.alias("base_failed"), (~failed & (F.col("score") < threshold)).alias("kept"),
        F.col("score"), F.lit(threshold).alias("threshold"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 16384, trees: int = 96, rows_per_tree: int = 256, seed: int = 7) -> DataFrame:
    """One row per row of (doc_id, text): its statistics, base_failed, anomaly score in [0, 1], threshold and kept.

    labels: (doc_id, quality 0/1). The forest is fitted on about `fit_rows` rows labelled good (a documented bound), or
    on any rows if none is; statistics, scores and the threshold use all rows. base_failed: fewer than 50 words, or over
    half of the words in repeated 3-word windows; such a document is never kept. Null or empty texts have no words and
    fail. A doc_id with contradicting labels counts as bad, a null doc_id has none; without bad labels the threshold is
    0.6, or beyond the highest score of a good row. Rows of one doc_id are judged each by its text.
    """
    return verdicts(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), labels, fit_rows, trees, rows_per_tree, seed).drop("row")


def _scored(df: DataFrame, forest: IsolationForest, keep: tuple, schema: str) -> DataFrame:
    def work(*columns):
        held, features = columns[: len(keep)], columns[len(keep) :]
        x = np.array(features, float).T if features[0] else np.zeros((0, len(FEATURES)))
        return [*held, forest.score(x).tolist()]

    return map_columns(df.select(*keep, *FEATURES), work, f"{schema}, score double")


def op1_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
