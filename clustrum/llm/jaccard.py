"""N-gram Jaccard join by parity sketches.

Tokens are hashes of five-word shingles. A size band cuts the hash space into parts; the XOR of a set's tokens in a
part is that part's parity, and a part that no token of the symmetric difference falls into has the same parity in
both sets. So the Hamming distance of two parity sketches is at most the symmetric difference, which similarity t
bounds by (|A| + |B|) (1 - t) / (1 + t): of the first bound + 1 parts that are not empty, one at least is equal in
both sets (pigeonhole). Such a parity is a piece, and sets that share one are candidates.

Which pieces must meet. With E pieces considered of each set, in order of their part, a pair of bound D shares E - D of
them. A set may therefore leave out E - D - 1 pieces, provided that all sets leave out by one common order: it leaves
out those that most sets have (`spare`). Passages that many documents share are met by those only that consist of
little else, and a set most of whose pieces occur nowhere else has no candidate at all. Every set has E pieces but
for chance; where one has not, its band is done again with a part for each token, which is exact for any set.

Candidates whose sizes or bitwise sketches (Hamming distance again) exceed the bound are dropped, the others verified
on the sets themselves. Equal sets are one class from the start. Within a piece, members are first verified against
one head; then only members of different components are compared. Where that would still be many pairs, as of texts that
share a template but not enough of it, the members meet on single tokens by their sizes (`sized_pieces`), on which such
texts share nothing that they may not leave out. No group is expanded into all of its pairs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_ascii, forget, map_columns, settled, with_rows, words_of
from .components import connected

#: Largest set of the first band, whose parts are single tokens; each further band goes RATIO times as far.
FIRST, RATIO = 64, 4
#: Tokens in a part, on average, of a band's largest sets: in the second band, in later ones.
LOAD = 1.5, 1.75
#: Below this threshold parts are single tokens in all bands.
LEAST_SHARED = 0.74
BITS = 1024
#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 400_000
#: A piece with more pairs than this across its components is hot: its members meet on single tokens by their sizes instead.
HOT_PAIRS = 100_000
#: Sizes up to EXACT are size classes of their own, larger ones share one with sizes up to GROWTH times theirs.
EXACT, GROWTH = 32, 1.04

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of a shorter text, of all of its words as one."""
    words = words_of(fold_ascii(text)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - width + 1 + i]
    return np.unique(mixed(out))


class Bands(NamedTuple):
    """Size bands for a threshold; with `single`, parts of one token in all of them."""

    threshold: float
    single: bool = False

    def of(self, n: int) -> int:
        return max(0, math.ceil(math.log(n / FIRST, RATIO) - 1e-9)) if n > FIRST else 0

    def largest(self, band: int) -> int:
        return FIRST * RATIO**band

    def both(self, n: int) -> list[int]:
        """The bands of a set: its own, and the next one if a partner may be in that. A pair meets in its larger set's."""
        own = self.of(n)
        return [own, own + 1] if int(n / self.threshold + 1e-9) > self.largest(own) else [own]

    def tokens_alone(self, band: int) -> bool:
        return self.single or band == 0 or self.threshold < LEAST_SHARED

    def parts(self, band: int) -> int:
        return int(self.largest(band) / LOAD[min(band, 2) - 1])

    def considered(self, n: int, band: int) -> float:
        """Pieces that are considered of a set of n, before rounding up: all, or a fifth more than any bound needs, and one."""
        return n if self.tokens_alone(band) else 1.2 * (1 - self.threshold) / self.threshold * n + 1

    def bound(self, a: int, b: int) -> float:
        return (a + b) * (1 - self.threshold) / (1 + self.threshold)

    def spare(self, n: int, band: int) -> int:
        """Pieces that a set of n need not meet on: one less than it shares with any partner. What a pair shares is
        linear in the partner's size on either side of n, so that the smallest and the largest partner decide."""
        least, most = math.ceil(self.threshold * n - 1e-9), int(n / self.threshold + 1e-9)
        if self.tokens_alone(band):  # what is shared are the tokens themselves
            return max(0, math.ceil(self.threshold / (1 + self.threshold) * (n + least) - 1e-9) - 1)
        shared = min(self.considered(least, band) - self.bound(n, least), self.considered(n, band) - self.bound(n, most))
        return max(0, math.floor(shared + 1e-9) - 1)


def pieces(tokens: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, bool]:
    """Signed 64-bit keys of the considered pieces of a set's sorted tokens, and whether there are as many as needed."""
    want = min(len(tokens), math.ceil(bands.considered(len(tokens), band) - 1e-9))
    if bands.tokens_alone(band):
        parity, enough = tokens[:want], True
    else:
        part = (tokens >> np.uint64(32)) * np.uint64(bands.parts(band)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        enough = len(starts) >= want
        end = len(tokens) if len(starts) <= want else starts[want]
        parity = np.bitwise_xor.reduceat(tokens[:end], starts[:want])
    return mixed(parity + np.uint64((2 * band + bands.single + 1) * int(_M2) % 2**64)).view(np.int64), enough


def bit_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of BITS cells, as signed 64-bit words."""
    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


NONE = np.zeros(0, np.int64)


def sketches(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """doc_id, row, n (set size), a fingerprint of the set, the bit sketch, the pieces of its own band and, if it has
    partners there, of the next, the spare pieces of each, and bands in which the set has too few, of (row, doc_id, text)."""
    hashes, bands = WordHashes(), Bands(threshold)

    def work(rows, ids, texts):
        n, one, two, bits, keys, spare, short = [], [], [], [], [[], []], [[], []], []
        for text in texts:
            s = shingles(text, hashes, width)
            n.append(len(s))
            one.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
            two.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            bits.append(bit_sketch(s) if len(s) else NONE)
            few = []
            own = bands.both(len(s)) if len(s) else []
            for i in range(2):
                found, enough = pieces(s, own[i], bands) if i < len(own) else (NONE, True)
                keys[i].append(found)
                spare[i].append(bands.spare(len(s), own[i]) if i < len(own) else 0)
                if not enough:
                    few.append(own[i])
            short.append(few)
        return [rows, ids, n, one, two, bits, *keys, *spare, short]

    return map_columns(
        docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")), work,
        "row long, doc_id long, n long, h1 long, h2 long, bits array<long>, own array<long>, next array<long>, spare0 int, spare1 int, short array<int>",
    )


def single_pieces(texts: DataFrame, again: list[int], threshold: float, width: int) -> DataFrame:
    """(row, place, spare, piece) of the sets of (row, text) that have one of the bands `again`, with a part for each token."""
    hashes, bands = WordHashes(), Bands(threshold, True)

    def work(rows, texts):
        out: list[list] = [[], [], [], []]
        for row, text in zip(rows, texts):
            s = shingles(text, hashes, width)
            for band in bands.both(len(s)) if len(s) else []:
                if band in again:
                    found = pieces(s, band, bands)[0]
                    for to, v in zip(out, ([row] * len(found), [2 + band] * len(found), [bands.spare(len(s), band)] * len(found), found.tolist())):
                        to += v
        return out

    return map_columns(texts, work, "row long, place int, spare int, piece long", rows=64)


def _near(a: str, b: str, threshold: float):
    """Whether sizes and bit sketches allow the threshold."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(F.col(f"{a}.bits"), F.col(f"{b}.bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return (F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9) & (apart <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the pairs (a, b) of rows whose sets reach the threshold."""
    pairs = settled(pairs)
    ids = settled(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    hashes = WordHashes()

    def work(own, texts):
        return [own, [shingles(t, hashes, width).view(np.int64) for t in texts]]

    sets = settled(map_columns(texts.join(F.broadcast(ids) if few else ids, "row", "left_semi"), work, "row long, tokens array<long>"))
    left, right = sets.toDF("a", "ta"), sets.toDF("b", "tb")
    both = F.size(F.array_intersect("ta", "tb"))
    linked = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    out = settled(linked.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b"))
    forget(pairs, ids, sets)
    return out


def members_of_pieces(heads: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(piece, head, row): for each piece on which two sets or more must meet, its members and the least of them."""
    keyed = heads.select("row", F.lit(0).alias("place"), F.col("spare0").alias("spare"), F.explode("own").alias("piece"))
    keyed = keyed.union(heads.select("row", F.lit(1), "spare1", F.explode("next")))
    again = sorted(r[0] for r in heads.where(F.size("short") > 0).select(F.explode("short")).distinct().collect())
    if again:
        keyed = keyed.union(single_pieces(texts.join(heads.select("row"), "row", "left_semi"), again, threshold, width))
    times = settled(keyed.groupBy("piece").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    # of each set's pieces the `spare` that most sets have are left out; those that no other set has come last in that order
    shared = keyed.join(times, "piece")
    most = Window.partitionBy("row", "place").orderBy(F.desc("times"), "piece")
    kept = settled(shared.withColumn("rank", F.row_number().over(most)).where("rank > spare").select("piece", "row"))
    first = kept.groupBy("piece").agg(F.min("row").alias("head"), F.max("row").alias("last")).where("head <> last").select("piece", "head")
    members = settled(kept.join(first, "piece").select("piece", "head", "row"))
    forget(kept, times)
    return members


def class_of(n: int) -> int:
    """The size class of sets of n: n itself, or a range of sizes."""
    c = n if n <= EXACT else EXACT + max(1, math.floor(math.log(n / EXACT, GROWTH)))
    while least_of(c + 1) <= n:
        c += 1
    while least_of(c) > n:
        c -= 1
    return c


def least_of(c: int) -> int:
    """The smallest size of a class."""
    return c if c <= EXACT + 1 else max(c, math.ceil(EXACT * GROWTH ** (c - EXACT)))


def sized_pieces(rows: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(piece, row, cls, other) of the sets of rows: single tokens on which a set meets those of the size class `other`.

    Two sets of n and m tokens that link share S(n, m) = t / (1 + t) (n + m) of them, so each may leave out the S - 1
    that most of these sets have. As S is that of the sizes at hand, not of the smallest partner, sets that share less,
    a template for instance, leave out all that they share, and do not meet.
    """
    hashes = WordHashes()

    def work(rows, texts):
        out: list[list] = [[], [], [], []]
        for row, text in zip(rows, texts):
            s = shingles(text, hashes, width)
            n = len(s)
            own = class_of(n)
            for c in range(class_of(max(1, math.ceil(threshold * n - 1e-9))), class_of(int(n / threshold + 1e-9)) + 1):
                least = max(least_of(c), math.ceil(threshold * n - 1e-9))
                for to, v in zip(out, (row, own, c, max(0, math.ceil(threshold / (1 + threshold) * (n + least) - 1e-9) - 1))):
                    to.append(v)
        return out

    def tokens(rows, texts):
        found = [shingles(t, hashes, width).view(np.int64) for t in texts]
        return [np.repeat(np.array(rows, np.int64), [len(f) for f in found]), np.concatenate([NONE, *found])]

    own = settled(texts.join(rows, "row", "left_semi"))
    keyed = settled(map_columns(own, tokens, "row long, token long", rows=64))
    times = settled(keyed.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    most = Window.partitionBy("row").orderBy(F.desc("times"), "token")
    ranked = keyed.join(times, "token").withColumn("rank", F.row_number().over(most)).select("row", "token", "rank")
    partners = map_columns(own, work, "row long, cls int, other int, spare int")
    pairs = F.least("cls", "other"), F.greatest("cls", "other")
    out = settled(ranked.join(partners, "row").where("rank > spare").select(F.xxhash64("token", *pairs).alias("piece"), "row", "cls", "other"))
    forget(own, keyed, times)
    return out


def _split(placed: DataFrame) -> DataFrame:
    """(piece, members, same, most): pieces whose members are of several components, the one that most are of and how many these are."""
    parts = placed.groupBy("piece", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("piece").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    return whole.where("components > 1").select("piece", "members", F.col("top.n").alias("same"), F.col("top.component").alias("most"))


def _components(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Of (row, doc_id, text): (row, doc_id, n, h1, h2) of all rows, and (n, h1, h2, class_row, class_id, component_row,
    component_id) of each distinct set; a row names the least row, an id the least doc_id (null if all are)."""
    threshold = percent / 100
    texts = docs.select("row", F.col("text").cast("string").alias("text"))
    all_rows = settled(sketches(docs, threshold, width))
    classes = settled(all_rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("class_row"), F.min("doc_id").alias("class_id")))
    whole = all_rows.where("n > 0")
    copies = settled(whole.join(classes, ["n", "h1", "h2"]).where("row <> class_row").select("row"))
    if copies.count() <= BROADCAST_IDS:
        heads = whole.join(F.broadcast(copies), "row", "left_anti")
    else:
        heads = whole.join(classes.select(F.col("class_row").alias("row")), "row", "left_semi")
    card = settled(heads.select("row", "n", "bits"))
    members = members_of_pieces(heads, texts, threshold, width)

    def allowed(pairs: DataFrame) -> DataFrame:
        a, b = card.alias("x"), card.alias("y")
        return pairs.join(a, F.col("a") == F.col("x.row")).join(b, F.col("b") == F.col("y.row")).where(_near("x", "y", threshold)).select("a", "b")

    star = settled(members.where("head <> row").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct())
    links = _verified(allowed(star), texts, percent, width)
    grown = connected(links)

    # what the heads did not join: members of a piece that are in different components so far
    placed = members.join(grown, F.col("row") == F.col("id"), "left").select("piece", "row", F.coalesce("component", "row").alias("component"))
    placed = placed.withColumn("cls", F.lit(0)).withColumn("other", F.lit(0))
    split = settled(_split(placed))
    hot = split.where((F.col("members") - F.col("same")) * F.col("members") > HOT_PAIRS)
    meeting = placed.join(split.where((F.col("members") - F.col("same")) * F.col("members") <= HOT_PAIRS).select("piece", "most"), "piece")
    hot_rows = settled(placed.join(hot.select("piece"), "piece").select("row", "component").distinct())
    if hot_rows.limit(1).count():
        sized = settled(sized_pieces(hot_rows.select("row"), texts, threshold, width).join(hot_rows, "row").select("piece", "row", "component", "cls", "other"))
        meeting = meeting.unionByName(sized.join(_split(sized).select("piece", "most"), "piece"))
    mixed_up = settled(meeting.join(card, "row").select("piece", "row", "component", "most", "cls", "other", "n", "bits"))
    x, y = mixed_up.where("component <> most").alias("x"), mixed_up.alias("y")
    meet = (F.col("x.piece") == F.col("y.piece")) & (F.col("x.cls") == F.col("y.other")) & (F.col("x.other") == F.col("y.cls"))
    across = x.join(y, meet & (F.col("x.component") != F.col("y.component")) & _near("x", "y", threshold))
    across = across.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = _verified(across, texts, percent, width)
    joined = connected(links.union(more)) if more.limit(1).count() else grown
    found = classes.join(joined, F.col("class_row") == F.col("id"), "left").withColumn("component_row", F.coalesce("component", "class_row"))
    # settled, so that the join deals out both sides anew and can split a component that holds many rows
    least = settled(found.groupBy("component_row").agg(F.min("class_id").alias("component_id")))
    found = settled(found.join(least, "component_row").select("n", "h1", "h2", "class_row", "class_id", "component_row", "component_id"))
    rows = settled(all_rows.select("row", "doc_id", "n", "h1", "h2"))
    forget(all_rows, card, members, star, mixed_up, links, more, copies, classes)
    return rows, found


def jaccard_groups(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each row of (doc_id, text).

    Two rows link if 100 * intersection >= percent * union of their sets of `width`-word shingles (A-Z lower-cased;
    a shorter text is one shingle). class_id: smallest doc_id with an equal set; component_id: smallest doc_id
    reachable by links, null where all of them are null. Rows without words, or null, link with nothing. Each row is a
    document of its own, whether or not its doc_id repeats or is null.
    """
    docs, row = with_rows(docs)
    rows, found = _components(docs.select(F.col(row).alias("row"), "doc_id", "text"), percent, width)
    own = rows.join(found, ["n", "h1", "h2"], "left")
    alone = F.col("n") == 0
    return own.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest doc_id (null last), and of several such
    rows the one with the smallest fingerprint of its set. Rows without words, or with a null text, all stay; so does
    every row whose text is near no other's, whether or not its doc_id repeats or is null."""
    columns = docs.columns
    docs, row = with_rows(docs)
    rows, found = _components(docs.select(F.col(row).alias("row"), "doc_id", "text"), percent, width)
    placed = settled(rows.where("n > 0").join(found, ["n", "h1", "h2"]).select("row", "doc_id", "n", "h1", "h2", "component_row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2", "row")
    stays = settled(placed.groupBy("component_row").agg(F.min(order)["row"].alias("stays")))
    gone = settled(placed.join(stays, "component_row").where("row <> stays").select(F.col("row").alias(row)))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*columns)


def op5_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
sized AS (SELECT doc_id, len(s)::BIGINT AS n FROM shingled),
tokens AS (SELECT doc_id, unnest(s) AS t FROM shingled),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id WHERE 100 * same >= 75 * (x.n + y.n - same)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sized UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, n AS n_shingles, (SELECT min(other) FROM reach WHERE id = doc_id)::BIGINT AS component_id FROM sized"""
