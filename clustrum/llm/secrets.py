"""Secret scans: fixed rules, and character Markov models that tell random strings from ordinary identifiers.

Two first-order models over characters are trained from labelled samples: what the rules find is labelled random;
longer words and identifiers without a digit are labelled ordinary, and so are the paths, dates, versions, points of
time and names with numbers that are put together from neighbouring ones of them (`composite`). A further token of 16 characters or
more with a letter, or what the rules' spans leave of one if that is as long, is a secret if the mean log-likelihood
ratio of its characters exceeds a threshold calibrated on the labelled samples. UUIDs name things and are none.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE, map_columns, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Shorter tokens are not judged: so few characters do not tell random from ordinary.
LEAST = 16
#: What the models judge: runs of at least LEAST key-like characters with a letter, not part of a longer run.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
_LETTER = re.compile("[A-Za-z]")
#: What counts as ordinary in training: longer words and identifiers without a digit, which random strings seldom lack.
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{7,}(?![A-Za-z0-9+/_=-])")
#: Random by design, but a name.
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1  # one more: the start of a token, and any other character
_CODE = np.full(128, SYMBOLS - 1, np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) of what the rules find; leftmost and non-overlapping within a kind."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def codes(token: str) -> np.ndarray:
    raw = np.frombuffer(token.encode("ascii", "replace"), np.uint8)
    return _CODE[raw & 127]


def steps(token: str) -> np.ndarray:
    """Flat indices of a token's (previous, next) symbols; a token begins after the extra symbol."""
    c = codes(token).astype(np.int64)
    return np.concatenate([[SYMBOLS - 1], c[:-1]]) * SYMBOLS + c


#: Symbols by kind: lower-case letters, capitals, digits, marks and all else.
_KIND = np.repeat(np.arange(4), (26, 26, 10, SYMBOLS - 62))


class MarkovRatio:
    """Mean log-likelihood ratio, random against ordinary, of a token's characters. A share `backing` of each step is
    that of the kinds of its characters, so that letter pairs that the samples' words happen to lack weigh little."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, smoothing: float = 0.5, backing: float = 0.005):
        def rows(counts):
            c = counts.reshape(SYMBOLS, SYMBOLS) + smoothing
            of_kind = np.eye(4)[_KIND]
            kinds = of_kind.T @ c @ of_kind / of_kind.sum(0)
            backed = (kinds / (kinds * of_kind.sum(0)).sum(1, keepdims=True))[_KIND][:, _KIND]
            return np.log((1 - backing) * c / c.sum(1, keepdims=True) + backing * backed)

        self.table = (rows(random) - rows(ordinary)).ravel()

    def score(self, token: str) -> float:
        return float(self.table[steps(token)].mean()) if token else 0.0


def _count(docs: DataFrame, work) -> dict[str, np.ndarray]:
    """Sum over all tasks of what `work(label, tokens)` yields as indices of the tokens of one Arrow batch; the driver
    gets sums of fixed size."""

    def run(texts):
        held: dict[str, list[str]] = {}
        for text in texts:
            for label, token in labelled_tokens(text or ""):
                held.setdefault(label, []).append(token)
        out: list[list] = [[], [], []]
        for label, tokens in held.items():
            index, n = np.unique(work(label, tokens), return_counts=True)
            out[0] += [label] * len(index)
            out[1] += index.tolist()
            out[2] += n.tolist()
        return out

    sums = map_columns(docs.select(F.col("text").cast("string")), run, "label string, i long, n long", WHOLE).groupBy("label", "i").agg(F.sum("n").alias("n"))
    out: dict[str, list] = {}
    for r in sums.collect():
        out.setdefault(r["label"], []).append((r["i"], r["n"]))
    return {k: np.array(v, np.int64) for k, v in out.items()}


def all_steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`steps` of each token, one after another, and where each token begins; no token is empty."""
    c = codes("\n".join(["", *tokens])).astype(np.int64)
    begin = np.cumsum([1, *(len(t) + 1 for t in tokens[:-1])])
    inside = np.ones(len(c), bool)
    inside[begin - 1] = False  # line feeds have the extra symbol
    flat = np.concatenate([[0], c[:-1]]) * SYMBOLS + c
    return flat[inside], begin - np.arange(1, len(tokens) + 1)


def composite(words: list[str], form: int) -> str:
    """An ordinary token with marks and digits, of three words: a path, a dated path, a name with a number, a version,
    a constant, a numbered slug, a path of a named file, a record number, a point of time, a short name with a long
    number, a code point with its name, a stretch of the alphabet. What looks drawn comes from a checksum of the words."""
    a, b, c = words
    n, m = len(a) % 10, len(b) % 12 + 1
    drawn = zlib.crc32("".join(words).encode("utf-8", "surrogatepass"))
    number = f"{drawn * 2654435761 % 10**16:016d}"
    return (
        f"{a}/{b}{n}/{c}", f"{a}/20{len(c) % 30:02d}/{m:02d}/{b}-{c}", f"{a.title()}{b.title()}{n}{c.title()}",
        f"{a}_{b}_v{n}-{m}", f"{a}_{b}_{1 << len(c) % 13}".upper(), f"{a}-{m}-{b}-20{len(c) % 30:02d}",
        f"{a}/{b}/{c.title()}{a.title()}{n}{b.title()}", f"{a}_id_{number[:13]}", f"20{drawn % 40:02d}{m:02d}{drawn % 28 + 1:02d}T{drawn % 24:02d}{drawn // 24 % 60:02d}{drawn // 1440 % 60:02d}Z",
        f"{a[:2].lower()}{number}", f"0x{drawn % 0x110000:05X}_{a}_{b}".upper(), (ALPHABET[:26] * 2)[drawn % 26 :][:26],
    )[form % 19 % 12]  # the first seven forms twice as often


def outside(matches, spans: list[tuple[int, int]]):
    """Each match with the ascending spans that it overlaps, in one sweep over both."""
    first = 0
    for m in matches:
        while first < len(spans) and spans[first][1] <= m.start():
            first += 1
        last = first
        while last < len(spans) and spans[last][0] < m.end():
            last += 1
        yield m, spans[first:last]


def merged(found) -> list[tuple[int, int]]:
    """Ascending disjoint spans that cover those of `found`, which ascend by start."""
    out: list[tuple[int, int]] = []
    for a, _, b, *_ in found:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def labelled_tokens(text: str):
    """(label, token) samples of a text: secrets of the rules are random; long words and identifiers outside them are
    ordinary, and composites of each three of these in a row."""
    found = base_spans(text)
    for _, _, _, secret in found:
        yield "random", secret
    held: list[str] = []
    form = len(text)
    for m, spans in outside(ORDINARY.finditer(text), merged(found)):
        if not spans:
            yield "ordinary", m[0]
            held.append(m[0])
            if len(held) == 3:
                yield "ordinary", composite(held, form)
                held, form = [], form + 1


def train(docs: DataFrame) -> tuple[MarkovRatio, float]:
    """The ratio model and its threshold, both from the labelled tokens of all rows of (text)."""

    def counted(label, tokens):
        return all_steps(tokens)[0]

    def dense(pairs):
        flat = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        if pairs is not None and len(pairs):
            flat[pairs[:, 0]] = pairs[:, 1]
        return flat

    sums = _count(docs, counted)
    model = MarkovRatio(dense(sums.get("random")), dense(sums.get("ordinary")))

    def scored(label, tokens):
        long = [t for t in tokens if label == "random" or len(t) >= LEAST]
        if not long:
            return np.zeros(0, np.int64)
        flat, begin = all_steps(long)
        means = np.add.reduceat(model.table[flat], begin) / np.array([len(t) for t in long])
        return np.clip(np.round(means * 100), -1000, 1000).astype(np.int64)

    hist = _count(docs, scored)
    return model, threshold(hist.get("random"), hist.get("ordinary"))


def threshold(random, ordinary) -> float:
    """Midway between the scores that 1% of random tokens stay below and 0.1% of ordinary ones exceed, 0.4 at least:
    there are far more ordinary tokens. Unlabelled secrets among them do not move it while they are fewer than that."""
    if random is None or ordinary is None or not len(random) or not len(ordinary):
        return 1.0

    def quantile(hist, q):
        h = hist[np.argsort(hist[:, 0])]
        return h[np.searchsorted(np.cumsum(h[:, 1]) / h[:, 1].sum(), q), 0] / 100

    return max(0.4, (quantile(random, 0.01) + quantile(ordinary, 0.999)) / 2)


def all_spans(text: str, model: MarkovRatio, least: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' spans and of the model's (kind 3), which overlap none of the rules':
    of a token that does, each run outside them of at least LEAST characters with a letter is judged by itself."""
    found = base_spans(text)
    spans = [(a, k, b) for a, k, b, _ in found]
    more = []
    for m, inside in outside(TOKEN.finditer(text), merged(found)):
        at = m.start()
        for a, b in [*inside, (m.end(), m.end())]:
            run = text[at:a]
            if a - at >= LEAST and _LETTER.search(run) and model.score(run) > least and not UUID.fullmatch(run):
                more.append((at, 3, a))
            at = max(at, b)
    return sorted(spans + more)


def joined(spans) -> str:
    return ",".join(f"{(*KINDS, 'markov')[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. The Markov models
    and their threshold are fitted on the labelled tokens of all rows, every row is scanned whole. Null or empty texts have no spans. Without
    both kinds of labelled tokens the threshold is 1.0.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model, least = fitted(docs)

    def work(ids, texts):
        spans = [all_spans(t or "", model, least) for t in texts]
        counts = [[sum(s[1] == k for s in x) for x in spans] for k in range(3)]
        digests = [hashlib.sha256(joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in spans]
        return [ids, *counts, digests, [joined(x) for x in spans]]

    return map_columns(rows, work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def fitted(docs: DataFrame, text: str = "text") -> tuple[MarkovRatio, float]:
    """The models and their threshold, from all rows: what is kept of them are sums of fixed size."""
    return train(docs.select(F.col(text).cast("string").alias("text")))


def redacted(text: str | None, model: MarkovRatio, least: float) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in all_spans(text, model, least):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{(*KINDS, 'markov')[k]}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each secret span replaced by its kind in angle brackets; other columns as they were. Null texts stay
    null, those without a secret as they are. Without a secret of the rules in any row there is no random sample, and
    the threshold is that of `threshold`. Rows that repeat are treated alike."""
    small_batches(docs.sparkSession)
    model, least = fitted(docs, text)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted(t, model, least), na_action="ignore")

    return docs.withColumn(text, clean(F.col(text).cast("string")))


def op9_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return secret_scan(table(spark, sf_dir, "documents"))
