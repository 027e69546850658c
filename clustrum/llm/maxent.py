"""Language-model scoring with a hashed maximum-entropy model.

A word's probability factors into that of its class, that of a group of words within the class, and that of the word
within the group, each a softmax over hashed features of the two words before it: the previous word, the one before
that (skip), and, for the class, the pair (trigram). Classes and groups are runs of the vocabulary in order of
frequency, and the most frequent words are classes of their own; the words outside it form further classes by their endings, in which a word's probability is its smoothed
count, so that probabilities of all words sum to one. The vocabulary has 8025 words or more, and grows with the root
of the number of distinct words; see `shape_for`.

Training is distributed: in each round every task runs mini-batch gradient steps over its documents of that round,
from the same weights; the changes are averaged per block of weights. Each training document is used in one round.

Word counts cover all training documents. Words frequent enough for a bounded dictionary are scored inside the task;
the rest, which no document repeats often, are joined with their counts by a shuffle on the word.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, settled, small_batches

END = b""  # the end of a text; no word is empty
HEAD_WORDS = 60_000
ALONE = 25  # most frequent words, each a class
SIDE = 20  # at least; classes of the further vocabulary, groups of a class, words of a group
ENDINGS = 7  # classes of the other words
OUTSIDE = ALONE + SIDE**3
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 14
BLOCK = 8192
BATCH = 4096
SLOTS = 4
ROUNDS = 6  # uses of a row in a batch that are added without a segment
PIECE = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_END_HASH = np.uint64(0x165667B19E3779F9)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased, and the end. Bytes split at just the six blanks that bound words."""
    return [*text.lower().split(), END] if text else [END]


def ending(word: bytes) -> int:
    """The class of a word outside the vocabulary: its last two bytes as a number, modulo ENDINGS."""
    return int.from_bytes(word[-2:], "big") % ENDINGS


def ending_column(word: Column) -> Column:
    last = F.hex(F.substring(word.cast("binary"), -2, 2))
    return F.when(F.length(word) == 0, 0).otherwise(F.conv(last, 16, 10).cast("int") % ENDINGS)


class Shape(NamedTuple):
    """Classes, groups of a class and words of a group; rows of the class and the word weights (powers of two)."""

    side: int = SIDE
    class_rows: int = CLASS_ROWS
    word_rows: int = WORD_ROWS

    @property
    def outside(self) -> int:
        return ALONE + self.side**3


def shape_for(distinct: int) -> Shape:
    """A vocabulary of at least 1.6 times the root of the distinct words, and feature rows of about 13 times that root;
    neither less than the defaults. Rows end at 2 ** 16, what 16-bit keys tell apart."""
    side = max(SIDE, int(np.ceil((1.6 * distinct**0.5) ** (1 / 3))))
    rows = min(1 << 16, max(CLASS_ROWS, 1 << int(np.log2(13 * distinct**0.5 + 1))))
    return Shape(side, rows, min(1 << 16, 2 * rows))


class Powers:
    """Powers of the hash base and their inverses modulo 2 ** 64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * PIECE)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse, np.uint64)]))
        return self.up, self.down


class Lexicon:
    """Codes of words without a Python object for each: a 64-bit polynomial hash, looked up among the head words."""

    def __init__(self, vocabulary: list[bytes], head: list[bytes] = (), outside: int = OUTSIDE):
        self.powers, self.outside = Powers(), outside
        words = list(dict.fromkeys([*vocabulary, *head]))
        hashes = self.hashes_of(words)
        order = np.argsort(hashes)
        own, place = {w: i for i, w in enumerate(vocabulary)}, {w: i + 1 for i, w in enumerate(head)}
        self.hashes = np.concatenate([hashes[order], [np.uint64(2**64 - 1)]])
        self.ids = np.array([own.get(words[i], -1) for i in order] + [-1], np.int64)
        self.places = np.array([place.get(words[i], 0) for i in order] + [0], np.int64)

    def hashes_of(self, words: list[bytes]) -> np.ndarray:
        full = [w for w in words if w]
        h = np.concatenate([np.zeros(0, np.uint64), *(self.pieces(b" ".join(full[i : i + 4096]))[0] for i in range(0, len(full), 4096))])
        out = np.full(len(words), _END_HASH)
        out[[i for i, w in enumerate(words) if w]] = h
        return out

    def pieces(self, text: bytes):
        """(hashes, begins, ends, endings) of the words of one piece of text."""
        a = np.frombuffer(text, np.uint8)
        blank = np.concatenate([[True], _BLANK[a], [True]])
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        begin, end = turns[::2], turns[1::2]
        up, down = self.powers.to(len(a) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])])
        h = (sums[end] - sums[begin]) * down[begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        last = a[end - 1].astype(np.int64)
        before = np.where(end - begin > 1, a[np.maximum(end - 2, 0)], 0).astype(np.int64)
        return h, begin, end, (before * 256 + last) % ENDINGS

    def codes(self, texts: list[bytes | None]) -> "Codes":
        """The tokens of several texts in a row, each with its end. The texts are read as one, a blank between them."""
        whole = b"\n".join([text or b"" for text in texts]).lower()
        found, offset = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)], 0
        for piece in cut(whole):
            h, begin, end, e = self.pieces(piece)
            found.append((h, begin + offset, end + offset, e))
            offset += len(piece)
        columns = [np.concatenate(x) for x in zip(*found)]
        sizes = np.array([len(text or b"") + 1 for text in texts], np.int64)
        words = np.diff(np.searchsorted(columns[1], np.cumsum(sizes) - sizes), append=len(columns[1]))
        n = words + 1
        place = np.arange(len(columns[1])) + np.repeat(np.arange(len(texts)), words)

        def with_ends(column, end):
            out = np.full(len(column) + len(texts), end, column.dtype)
            out[place] = column
            return out

        h, begin, end, e = (with_ends(column, of_end) for column, of_end in zip(columns, (_END_HASH, 0, 0, 0)))
        at = np.searchsorted(self.hashes, h)
        hit = self.hashes[at] == h
        word, place = np.where(hit, self.ids[at], -1), np.where(hit, self.places[at], 0)
        return Codes(np.where(word < 0, self.outside + e, word), h, place, np.cumsum(n) - n, n, whole, begin, end)


class Codes:
    """word (vocabulary id, or the vocabulary's size and the class), hash and place among the head words of each token; where each
    text starts, and how many tokens it has; the bytes of all texts, and where in them each token begins and ends."""

    def __init__(self, word, hash, place, starts, n, whole, begin, end):
        self.word, self.hash, self.place, self.starts, self.n, self.whole, self.begin, self.end = word, hash, place, starts, n, whole, begin, end

    def words_at(self, where: np.ndarray) -> list[bytes]:
        """The tokens at these positions."""
        return [self.whole[b:e] for b, e in zip(self.begin[where].tolist(), self.end[where].tolist())]

    def parts(self, limit: int = BATCH):
        """(word, hash, starts) runs of at most `limit` tokens, for steps over a long text one after another."""
        for i in range(0, len(self.word), limit):
            inside = self.starts[(self.starts >= i) & (self.starts < i + limit)] - i
            yield self.word[i : i + limit], self.hash[i : i + limit], inside


def cut(text: bytes):
    """Pieces of about PIECE bytes, cut at blanks; a longer word stays whole."""
    start = 0
    while len(text) - start > PIECE:
        at = min((i for i in (text.find(b, start + PIECE) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0), default=len(text))
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


class Model:
    """Weights: class biases and rows, biases of the parts of each class and group, word rows. Features index rows by hash."""

    def __init__(self, vocabulary: list[bytes], mass: np.ndarray, rest: np.ndarray, shape: Shape = Shape()):
        self.vocabulary, self.shape = vocabulary, shape
        full = np.zeros(shape.outside)
        full[: len(mass)] = mass
        words = full[ALONE:].reshape(-1, shape.side)
        groups = words.sum(1).reshape(-1, shape.side)
        by_class = np.concatenate([groups.sum(1), rest, full[:ALONE]])
        grid = np.concatenate([groups, words])  # a class's groups, for each class; a group's words, for each group
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(by_class / by_class.sum()), -30).astype(np.float32)
            inside = np.log(grid / np.maximum(grid.sum(1, keepdims=True), 1e-9))
        # a slot without a word must stay impossible; an empty class is never asked for
        self.word_bias = np.maximum(inside, -60).astype(np.float32)
        self.class_rows = np.zeros((shape.class_rows, shape.side + ENDINGS + ALONE), np.float32)
        self.word_rows = np.zeros((shape.word_rows, shape.side), np.float32)

    @staticmethod
    def features(h: np.ndarray, starts: np.ndarray):
        """Hashed features of each position: (previous, skip, pair), with nothing before the start of a text."""
        one = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
        two = np.concatenate([np.zeros(2, np.uint64), h[:-2]])[: len(h)]
        one[starts] = 1
        two[starts] = 1
        second = starts + 1
        two[second[second < len(two)]] = 1
        two[starts] = 1
        m = np.uint64(0x9E3779B97F4A7C15)
        prev, skip = (one + np.uint64(11)) * m, (two + np.uint64(0x1000003)) * np.uint64(0xC2B2AE3D27D4EB4F)
        pair = (prev ^ (skip >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        return [prev, skip, pair]

    def at(self, word: np.ndarray, h: np.ndarray, starts: np.ndarray):
        """Per position the class and its rows of weights; then, of the vocabulary words' groups and after them of the
        words themselves: what each is chosen from (a class, a group), its place there, and its rows of weights."""
        side, outside = self.shape.side, self.shape.outside
        w = word - ALONE
        cls = np.where(w < 0, side + ENDINGS + word, np.where(word < outside, w // (side * side), word - (outside - side)))
        hashed = self.features(h, starts)
        class_at = [(f >> np.uint64(40)).astype(np.uint16) & np.uint16(self.shape.class_rows - 1) for f in hashed]
        known = np.flatnonzero((w >= 0) & (word < outside))
        w = w[known]
        group = w // side
        of, place = np.concatenate([w // (side * side), side + group]), np.concatenate([group % side, w % side])
        salt = of.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        word_at = []
        for f in hashed[:2]:
            f = f[known]
            word_at.append(((np.concatenate([f, f]) ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.uint16) & np.uint16(self.shape.word_rows - 1))
        return cls, class_at, known, of, place, word_at

    @staticmethod
    def _sums(z):
        """Sums of the exponentials of logits, which they replace; a matrix product is the fastest way to sum rows."""
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], np.float32)

    @staticmethod
    def _bounded(z):
        """Logits less what keeps their exponentials finite: nothing, as a rule, for weights are small and biases below 0."""
        if z.size and z.max() > 60:
            z -= np.maximum(z.max(1, keepdims=True) - 60, 0)
        return z

    def _chosen(self, z, at):
        """Log probability of one choice of each row of logits."""
        own = self._bounded(z)[np.arange(len(at)), at]
        return own - np.log(self._sums(z))

    def _softmax(self, z):
        """The probabilities, in place of the logits."""
        sums = self._sums(self._bounded(z))
        z *= (1 / sums)[:, None]
        return z

    def _class_logits(self, class_at):
        z = self.class_rows.take(class_at[0], 0)
        z += self.class_rows.take(class_at[1], 0)
        z += self.class_rows.take(class_at[2], 0)
        z += self.class_bias
        return z

    def _word_logits(self, of, word_at):
        z = self.word_bias.take(of, 0)
        z += self.word_rows.take(word_at[0], 0)
        z += self.word_rows.take(word_at[1], 0)
        return z

    def log_prob(self, word: np.ndarray, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probability at each position of the word's class, and of the word within it if that is of the vocabulary."""
        cls, class_at, known, of, place, word_at = self.at(word, h, starts)
        out, inside = np.empty(len(word)), np.empty(len(of))
        for i in range(0, len(word), BATCH):
            k = slice(i, i + BATCH)
            out[k] = self._chosen(self._class_logits([a[k] for a in class_at]), cls[k])
        for i in range(0, len(of), BATCH):
            k = slice(i, i + BATCH)
            inside[k] = self._chosen(self._word_logits(of[k], [a[k] for a in word_at]), place[k])
        out[known] += inside[: len(known)] + inside[len(known) :]
        return out

    def step(self, word: np.ndarray, h: np.ndarray, starts: np.ndarray, rate: float) -> None:
        """One gradient step; a row's step is its summed gradient over the root of how often the batch uses it."""
        cls, class_at, known, of, place, word_at = self.at(word, h, starts)
        p = self._softmax(self._class_logits(class_at))
        p[np.arange(len(cls)), cls] -= 1
        for a in class_at:
            self._update(self.class_rows, a, p, rate)
        if len(known):
            p = self._softmax(self._word_logits(of, word_at))
            p[np.arange(len(of)), place] -= 1
            for a in word_at:
                self._update(self.word_rows, a, p, rate)

    @staticmethod
    def _update(rows, at, gradient, rate):
        """A segment's sum costs more to set up than to add, so only runs of over ROUNDS uses are segments: of the others the
        first members are taken together, then the second are added, and so on."""
        order = np.argsort(at, kind="stable")  # 16-bit keys: a radix sort
        sorted_at = at.take(order)
        first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
        size = np.diff(first, append=len(at))
        sums = gradient.take(order.take(first), 0)
        some = np.flatnonzero((size > 1) & (size <= ROUNDS))
        for j in range(1, ROUNDS):
            if not len(some):
                break
            sums[some] += gradient.take(order.take(first.take(some) + j), 0)
            some = some[size.take(some) > j + 1]
        long = np.flatnonzero(size > ROUNDS)
        if len(long):
            n = size.take(long)
            sums[long] = np.add.reduceat(gradient.take(order[np.repeat(size > ROUNDS, size)], 0), np.cumsum(n) - n, axis=0)
        sums *= (rate / np.sqrt(size)).astype(np.float32)[:, None]
        own = sorted_at.take(first)
        rows[own] = rows.take(own, 0) - sums

    def flat(self) -> np.ndarray:
        return np.concatenate([self.class_rows.ravel(), self.word_rows.ravel()])

    def load(self, flat: np.ndarray) -> None:
        n = self.class_rows.size
        self.class_rows = flat[:n].reshape(self.class_rows.shape).astype(np.float32)
        self.word_rows = flat[n:].reshape(self.word_rows.shape).astype(np.float32)


def batches_of(texts, limit: int = 4 * BATCH):
    """Texts gathered until they hold `limit` bytes; a longer text is a batch of its own."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or b"")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all rows of (text); tasks count first, in dictionaries that are emptied when large."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update(tokens(text))
                if len(held) > 300_000:
                    yield rows()
        yield rows()

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, bound: int) -> tuple[int, dict[bytes, int]]:
    """(least count, words with at least that count), as many counts as fit into `bound` words; found from a histogram."""
    level = F.floor(F.log2("c") * 16).cast("int")
    total, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > bound:
            break
        least = r["c"]
    if least is None:
        return 1 << 62, {}
    return least, {r["word"].encode(): r["c"] for r in counts.where(F.col("c") >= least).collect()}


def trained(model: Model, training: DataFrame, rounds: int, rate: float) -> Model:
    """Rounds of local gradient steps and averaging; round r uses the documents whose hash is r modulo `rounds`."""
    spark = training.sparkSession
    blocks = -(-len(model.flat()) // BLOCK)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches):
            own = Model(sent.value.vocabulary, np.zeros(0), np.ones(ENDINGS), sent.value.shape)
            own.class_bias, own.word_bias = sent.value.class_bias, sent.value.word_bias
            begin = sent.value.flat()
            own.load(begin.copy())
            lexicon = Lexicon(own.vocabulary, outside=own.shape.outside)
            used = 0
            for batch in batches:
                for texts in batches_of(batch.column(0).cast(pa.binary()).to_pylist()):
                    for part in lexicon.codes(texts).parts():
                        own.step(*part, rate)
                        used += len(part[0])
            if used:
                change = np.concatenate([own.flat() - begin, np.zeros(-len(begin) % BLOCK, np.float32)]).reshape(blocks, BLOCK)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(blocks), pa.int32()), pa.array([task] * blocks, pa.int32()), pa.array([used] * blocks, pa.int64()), pa.array([c.tobytes() for c in change], pa.binary())],
                    names=["block", "task", "used", "change"],
                )

        def averaged(rows):
            rows = rows.sort_values("task")
            total, weight = np.zeros(BLOCK), 0
            for used, change in zip(rows["used"], rows["change"]):
                total += used * np.frombuffer(change, np.float32)
                weight += used
            return rows.iloc[:1][["block", "task"]].assign(used=weight, change=[(total / weight).astype(np.float32).tobytes()])

        chosen = training.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == r).select("text")
        kind = "block int, task int, used long, change binary"
        # in two steps, so that no group holds a block's changes of all tasks
        part = chosen.mapInArrow(run, kind).groupBy("block", F.pmod("task", F.lit(SLOTS))).applyInPandas(lambda key, rows: averaged(rows), kind)
        changes = part.groupBy("block").applyInPandas(averaged, kind).select("block", "change").toPandas()
        if len(changes):
            flat = np.zeros(blocks * BLOCK, np.float32)
            for b, change in zip(changes["block"], changes["change"]):
                flat[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(change, np.float32)
            begin = model.flat()
            model.load(begin + flat[: len(begin)])
        sent.unpersist()
    return model


def score_texts(docs: DataFrame, head_words: int = HEAD_WORDS, rounds: int = 2, rate: float = 0.12) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, text).

    Learns from documents whose crc32(doc_id) mod 5 is not 1. base_score: smoothed unigram log10 probability; score:
    the model's. Null or empty texts are one end token. Without training documents the counts are 0 and every word
    has probability 1 under the smoothing; the model then scores the end and unknown words alike. Tasks take gradient
    steps on their own documents before weights are averaged, so that score depends a little on how the table is
    partitioned, base_score on its rows only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", remainder(F.col("doc_id")) == 1)
    small_batches(docs.sparkSession)
    training = rows.where(~F.col("held_out"))
    counts = settled(word_counts(training))
    totals = counts.groupBy(ending_column(F.col("word")).alias("ending")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total, distinct = sum(r["n"] for r in totals), sum(r["v"] for r in totals)
    least, head = frequent(counts, head_words)
    shape = shape_for(distinct)
    top = {r["word"].encode(): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(shape.outside).collect()}
    ranked, head = list(top), head | top
    rest = np.full(ENDINGS, 0.5)  # of an unseen word of each class
    for r in totals:
        rest[r["ending"]] += r["n"] + 0.5 * r["v"]
    for w in ranked:
        rest[ending(w)] -= head[w] + 0.5
    model = trained(Model(ranked, np.array([head[w] for w in ranked], float), rest, shape), training, rounds, rate)

    base_floor, rest_floor = np.log10(total + 0.5 * (distinct + 1)), np.log10(rest)
    by_place = sorted(head)
    sent = docs.sparkSession.sparkContext.broadcast((model, by_place, np.log10(np.array([np.nan, *(head[w] for w in by_place)]) + 0.5)))

    def run(batches):
        own, by_place, logs = sent.value
        lexicon = Lexicon(own.vocabulary, by_place, shape.outside)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, held, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            whole: list[list] = [[] for _ in range(5)]
            few: list[list] = [[], [], []]
            for some in batches_of(texts):
                c = lexicon.codes(some)
                in_head, outside = c.place > 0, c.word >= shape.outside
                log = np.where(in_head, logs[c.place], 0.0)
                floor = np.where(outside, rest_floor[np.where(outside, c.word - shape.outside, 0)], 0.0)
                natural = own.log_prob(c.word, c.hash, c.starts) / np.log(10)
                sums = [np.add.reduceat(v, c.starts) for v in (in_head.astype(np.int64), log - base_floor, natural - floor + np.where(outside, log, 0.0))]
                for to, v in zip(whole, (range(row, row + len(some)), c.n.tolist(), *[x.tolist() for x in sums])):
                    to += v
                at = np.flatnonzero(~in_head)
                rare = Counter(zip((np.searchsorted(c.starts, at, side="right") - 1).tolist(), c.words_at(at)))
                few[0] += [row + d for d, _ in rare]
                few[1] += [w for _, w in rare]
                few[2] += rare.values()
                row += len(some)
            many, rest_rows = len(whole[0]), len(few[0])
            none, nothing = [None] * rest_rows, [None] * many
            columns = [(whole[0] + few[0], pa.int64()), (ids + none, pa.int64()), (held + none, pa.bool_()), (whole[1] + none, pa.int64()), (whole[2] + none, pa.int64())]
            columns += [(nothing + few[1], pa.binary()), (nothing + few[2], pa.int64()), (whole[3] + none, pa.float64()), (whole[4] + none, pa.float64())]
            arrays = [pa.array(v, t) for v, t in columns]
            arrays[5] = arrays[5].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "n_tokens", "n_head", "word", "n", "base", "own"])

    scored = settled(rows.select("doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, word string, n long, base double, own double"))
    rare = counts.where(F.col("c") < least)
    of_rare = scored.where("word IS NOT NULL").select("row", "word", "n").join(rare, "word", "left")
    smooth = F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    tails = of_rare.groupBy("row").agg(smooth.alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail"))
    whole = scored.where("word IS NULL").join(tails, "row", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + tail).alias("base_score"), (F.col("own") + tail).alias("score"),
    )


def op2_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return score_texts(table(spark, sf_dir, "documents"))
