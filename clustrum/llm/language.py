"""Language identification by multilingual mixture inference.

Each language gets hashed character n-gram frequencies. A document's language proportions are estimated by
expectation-maximisation over its n-gram likelihoods; languages enter the document's set one by one as long as the
gain in log-likelihood exceeds a penalty, and the largest proportion names the document.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE, map_columns, remainder

BUCKETS = 1 << 15
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    return np.fromiter((i if unicodedata.category(chr(i))[0] == "L" else 32 for i in range(sys.maxunicode + 1)), np.uint64)


def grams(text: str) -> np.ndarray:
    """Hash buckets of the text's letter pairs and triples, with a blank wherever no letter is."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[c]
    at = np.nonzero(c != 32)[0]
    if not len(at):
        return at
    two = c[at] * np.uint64(0x9E3779B97F4A7C15) ^ (c[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) + np.uint64(1)
    every = np.concatenate([two, two ^ (c[at - 1] * np.uint64(0x165667B19E3779F9)) + np.uint64(2)])
    every ^= every >> np.uint64(29)
    every *= np.uint64(0xBF58476D1CE4E5B9)
    return (every >> np.uint64(49)).astype(np.int64)


class Mixture:
    """n-gram likelihoods of the learned languages, and inference of a text's proportions."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = 12.0, rounds: int = 10):
        self.languages, self.penalty, self.rounds = languages, penalty, rounds
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(1, keepdims=True)).T.copy()  # bucket x language

    def _em(self, like: np.ndarray, n: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray]:
        part = like[:, chosen]
        share = np.full(len(chosen), 1.0 / len(chosen))
        for _ in range(self.rounds if len(chosen) > 1 else 0):
            mixed = part @ share
            share = share * ((n / mixed) @ part) / n.sum()
        return float(n @ np.log(part @ share)), share

    def infer(self, text: str) -> tuple[dict[int, float], float]:
        """(proportions of the chosen languages, probability that the leading one leads)."""
        got = grams(text)
        if not len(got):  # letters that lower-casing leaves outside the letter table
            return {0: 1.0}, 1.0 / len(self.languages)
        found = np.bincount(got, minlength=BUCKETS)
        at = np.nonzero(found)[0]
        n, like = found[at].astype(float), self.p[at]
        single = n @ np.log(like)
        chosen = [int(single.argmax())]
        best, share = single[chosen[0]], np.ones(1)
        if len(self.languages) > 1:
            _, full = self._em(like, n, list(range(len(self.languages))))
            for k in map(int, np.argsort(-full, kind="stable")):
                if k in chosen or full[k] < 0.02:
                    continue
                gain, trial = self._em(like, n, [*chosen, k])
                if gain - best <= self.penalty + 0.5 * np.log(n.sum()):
                    continue
                chosen, best, share = [*chosen, k], gain, trial
        top = int(share.argmax())
        rest = np.delete(single, chosen[top])
        margin = (single[chosen[top]] - rest.max()) / n.sum() ** 0.5 if len(rest) else 10.0
        sure = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) if len(chosen) == 1 else 1.0
        return {k: float(s) for k, s in zip(chosen, share)}, float(share[top] * sure)

    def predict(self, text: str | None) -> tuple[str, float, str]:
        """(language, score, proportions as text); `und` without a letter."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, ""
        shares, score = self.infer(text)
        order = sorted(shares, key=lambda k: (-shares[k], self.languages[k]))
        return self.languages[order[0]], min(1.0, max(0.0, score)), ",".join(f"{self.languages[k]}:{shares[k]:.4f}" for k in order)


def fit(rows: DataFrame, fit_rows: int, penalty: float) -> Mixture:
    """Learn from (doc_id, text, lang) rows with a language: about `fit_rows` rows of each language."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Mixture([], np.zeros((0, BUCKETS)), penalty)
    fraction = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, fit_rows / v)))])
    pick = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < fraction[F.col("lang")] * (1 << 30)

    def work(langs, texts):
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(langs, texts):
            sums[lang] = sums.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
        out = [[], [], []]
        for lang, s in sums.items():
            at = np.nonzero(s)[0]
            for to, values in zip(out, ([lang] * len(at), at.tolist(), s[at].tolist())):
                to += values
        return out

    counts = map_columns(rows.where(pick).select("lang", "text"), work, "lang string, i int, n long", WHOLE).groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.zeros((len(languages), BUCKETS))
    table[counts["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(int), counts["i"].to_numpy(int)] = counts["n"].to_numpy(float)
    return Mixture(languages, table, penalty)


def identify(docs: DataFrame, fit_rows: int = 1500, penalty: float = 12.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and proportions of each row of (doc_id, text, lang).

    Learns from rows whose crc32(doc_id) mod 5 is not 0, at most about `fit_rows` of each language (a documented
    bound); lang, source and doc_id are no inputs of a prediction. Null texts and texts without a letter give `und`,
    score 0, as do all texts if no language could be learned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = remainder(F.col("doc_id")) == 0
    model = fit(rows.where(~held), fit_rows, penalty)

    def work(ids, held_out, texts):
        return [ids, held_out, *(zip(*map(model.predict, texts)) if texts else ([], [], []))]

    return map_columns(rows.select("doc_id", held.alias("held_out"), "text"), work, "doc_id long, held_out boolean, lang_pred string, score double, proportions string")


def op3_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return identify(table(spark, sf_dir, "documents"))
