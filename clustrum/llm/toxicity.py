"""Toxicity by nearest labelled examples.

Terms are words and five-letter beginnings of words; those that mark labelled toxic or clean texts (chi-square) span
the vector space. A bounded sample of labelled examples is held as an inverted index whose postings are cut into
blocks of examples with the largest weight of each block. A text visits blocks in order of the sum of those maxima
times its own weights and stops where that bound is below its k-th best cosine, so the neighbours are exact.
Their distance-weighted vote is calibrated (isotonic) on further labelled rows; the neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE, map_columns, remainder, settled

_WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5
BLOCK = 64
LEVELS = 200


def terms(text: str | None) -> list[str]:
    words = _WORD.findall(text.lower()) if text else []
    return words + ["^" + w[:PREFIX] for w in words if len(w) > PREFIX]


def counted(text: str | None, vocabulary) -> dict[str, int]:
    """How often each term of the vocabulary stands in a text; a repeated word is looked up once."""
    out: dict[str, int] = {}
    for w, n in Counter(_WORD.findall(text.lower()) if text else ()).items():
        if w in vocabulary:
            out[w] = n
        if len(w) > PREFIX and (p := "^" + w[:PREFIX]) in vocabulary:
            out[p] = out.get(p, 0) + n
    return out


class BlockMaxIndex:
    """Normalised TF-IDF vectors of labelled examples; `nearest` finds the k of largest cosine exactly.

    A block holds the weights of its examples as one matrix over the terms that stand in it, below a row of zeros for all others.
    """

    def __init__(self, vocabulary: dict[str, float], examples: list[tuple[int, int, dict[str, int]]], k: int = 16, power: float = 3.0):
        self.idf, self.k, self.power = vocabulary, k, power
        self.term = {t: i for i, t in enumerate(sorted(vocabulary))}
        vectors = [(i, y, v) for i, y, v in ((i, y, self.vector(n)) for i, y, n in examples) if v]
        # examples with the same leading term stand together, so that the maxima of blocks differ
        vectors.sort(key=lambda e: (max(e[2], key=lambda t: (e[2][t], t)), e[0]))
        self.ids = [e[0] for e in vectors]
        self.labels = np.array([e[1] for e in vectors], float)
        blocks = -(-len(vectors) // BLOCK)
        self.most = np.zeros((len(self.term), blocks))
        self.row = np.zeros((blocks, len(self.term)), np.int32)
        self.weights: list[np.ndarray] = []
        for b in range(blocks):
            members = vectors[b * BLOCK : (b + 1) * BLOCK]
            own = np.array(sorted({t for _, _, v in members for t in v}))
            self.row[b, own] = np.arange(1, len(own) + 1)
            w = np.zeros((len(own) + 1, BLOCK))
            for at, (_, _, v) in enumerate(members):
                w[self.row[b, list(v)], at] = list(v.values())
            self.most[own, b] = w[1:].max(axis=1)
            self.weights.append(w)

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        v = {self.term[t]: (1 + np.log(n)) * self.idf[t] for t, n in counts.items() if t in self.term}
        norm = sum(w * w for w in v.values()) ** 0.5
        return {t: w / norm for t, w in v.items()} if norm > 0 else {}

    def nearest(self, counts: dict[str, int]) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a positive cosine, best first, ties by place."""
        v = self.vector(counts)
        if not v or not self.ids:
            return []
        own, weight = np.array(list(v)), np.array(list(v.values()))
        bound = weight @ self.most[own]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            full = len(best) == self.k
            if bound[b] <= 0 or (full and bound[b] < best[-1][0] - 1e-9):
                break
            scores = np.round(weight @ self.weights[b][self.row[b, own]], 12)  # equal vectors tie, whatever the order of their sums
            near = np.flatnonzero((scores > 0) & (scores >= best[-1][0]) if full else scores > 0)
            if len(near):
                best += [(float(scores[i]), int(b) * BLOCK + int(i)) for i in near]
                best = sorted(best, key=lambda x: (-x[0], x[1]))[: self.k]
        return best

    def vote(self, found: list[tuple[float, int]], prior: float, weight: float = 0.5) -> float:
        """Share of toxic labels among the neighbours, weighted by a power of the cosine, drawn to the prior where they are far."""
        total = sum(s**self.power for s, _ in found)
        return (sum(s**self.power * self.labels[i] for s, i in found) + weight * prior) / (total + weight)


def isotonic(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Non-decreasing probability of toxic for each of LEVELS votes, by pooling adjacent violators; smoothed counts."""
    pools: list[list[float]] = []
    for t, c in zip(toxic, clean):
        pools.append([t, t + c, 1])
        while len(pools) > 1 and pools[-2][0] * max(pools[-1][1], 1e-9) >= pools[-1][0] * max(pools[-2][1], 1e-9):
            t, n, width = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + n, pools[-1][2] + width]
    out = np.concatenate([np.full(int(w), (t + 0.02) / (n + 0.04)) if n else np.full(int(w), np.nan) for t, n, w in pools])
    at = np.arange(len(out))
    known = ~np.isnan(out)
    return np.interp(at, at[known], out[known]) if known.any() else at / len(out)


class Judge:
    """Index, prior and calibration; `score` gives (score, evidence)."""

    def __init__(self, index: BlockMaxIndex, prior: float, levels: np.ndarray):
        self.index, self.prior, self.levels = index, prior, levels

    def raw(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.nearest(counted(text, self.index.term))
        return self.index.vote(found, self.prior), found

    def score(self, text: str | None) -> tuple[float, str]:
        vote, found = self.raw(text)
        p = float(self.levels[min(int(vote * LEVELS), LEVELS - 1)])
        return min(1.0, max(0.0, p)), ",".join(f"{self.index.ids[i]}:{int(self.index.labels[i])}:{s:.4f}" for s, i in found[:3])


def fitted(rows: DataFrame, labels: DataFrame, examples: int, least_chi: float, most_terms: int, neighbours: int = 16, power: float = 3.0) -> Judge:
    """Learn from rows (doc_id, text) that have a label: at most about `examples` of each label for the index, as many for calibration."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(remainder(F.col("doc_id")) != 0)
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.create_map(*[x for y in (0, 1) for x in (F.lit(y), F.lit(min(0.7, examples / max(sizes.get(y, 0), 1))))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(place < share[F.col("toxic")], 0).when(place < 2 * share[F.col("toxic")], 1)
    chosen = marked.select("doc_id", "toxic", part.alias("part")).where("part IS NOT NULL")
    sample = settled(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "part", "text"))  # at most 4 * examples ids

    def marks(toxic, texts):
        sums: Counter = Counter()
        for y, text in zip(toxic, texts):
            sums.update((t, y) for t in set(terms(text)))
        return [[t for t, _ in sums], [y for _, y in sums], list(sums.values())]

    own = sample.where("part = 0")
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    by_term = map_columns(own.select("toxic", "text"), marks, "term string, toxic int, n long", WHOLE).groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    chi = (pos + neg) * F.pow(a * (neg - b) - b * (pos - a), 2) / ((a + b) * (pos + neg - a - b) * pos * neg + 1e-9)
    chosen_terms = [r["term"] for r in by_term.where(chi >= least_chi).orderBy(chi.desc(), "term").limit(most_terms).select("term").collect()] if pos and neg else []

    spoken = set(chosen_terms)

    def present(texts):
        sums: Counter = Counter()
        for text in texts:
            sums.update(counted(text, spoken).keys())
        return [[*sums, None], [*sums.values(), len(texts)]]

    seen = {r["term"]: r["n"] for r in map_columns(rows.select("text"), present, "term string, n long", WHOLE).groupBy("term").agg(F.sum("n").alias("n")).collect()} if spoken else {}
    total = seen.get(None, 0)
    idf = {t: float(np.log((total + 1) / (seen.get(t, 0) + 1)) + 1) for t in chosen_terms}

    def held(ids, toxic, texts):
        own_terms = [counted(text, spoken) for text in texts]
        return [ids, toxic, [list(c) for c in own_terms], [list(c.values()) for c in own_terms]]

    found = map_columns(own.select("doc_id", "toxic", "text"), held, "doc_id long, toxic int, terms array<string>, n array<long>").collect() if spoken else []
    index = BlockMaxIndex(idf, sorted((r["doc_id"], r["toxic"], dict(zip(r["terms"], r["n"]))) for r in found if r["terms"]) if found else [], neighbours, power)
    judge = Judge(index, pos / max(pos + neg, 1), np.zeros(LEVELS))

    def votes(toxic, texts):
        return [toxic, [min(int(judge.raw(t)[0] * LEVELS), LEVELS - 1) for t in texts]]

    by_label = np.zeros((2, LEVELS))
    for r in map_columns(sample.where("part = 1").select("toxic", "text"), votes, "toxic int, level int").groupBy("toxic", "level").count().collect():
        by_label[1 if r["toxic"] == 1 else 0, r["level"]] = r["count"]
    for y in (0, 1):  # each label at its share of all labelled rows
        by_label[y] *= sizes.get(y, 0) / max(by_label[y].sum(), 1)
    judge.levels = isotonic(by_label[1], by_label[0]) if spoken else np.zeros(LEVELS)
    return judge


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = 2000, least_chi: float = 20.0, most_terms: int = 4096, neighbours: int = 16, power: float = 3.0) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of each row of (doc_id, text).

    Learns from labels (doc_id, toxic) of documents whose crc32(doc_id) mod 5 is not 0, about `examples` of each label
    for the index and for calibration, and from these examples at most the `most_terms` terms of highest chi-square of
    those that reach `least_chi` (documented bounds of the fit); document frequencies are of all documents. A text without a
    marking term, so also a null or empty one, has no neighbours and the calibrated score of that. Without labels of
    both kinds every score is 0. The `neighbours` examples of largest cosine vote with its `power`-th power; the cosine is
    exact over the terms chosen. evidence: the three nearest examples as id:label:cosine.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judge = fitted(rows, labels, examples, least_chi, most_terms, neighbours, power)

    def work(ids, held_out, texts):
        scored = [judge.score(t) for t in texts]
        return [ids, held_out, [s for s, _ in scored], [int(s >= 0.5) for s, _ in scored], [e for _, e in scored]]

    held = remainder(F.col("doc_id")) == 0
    return map_columns(rows.select("doc_id", held.alias("held_out"), "text"), work, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def op10_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
