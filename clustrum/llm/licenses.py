"""License scans with a positional rare-token index, in DataFrame functions only.

The index posts, for each licence text, the places of its words of highest inverse document frequency in the scanned
corpus (`POSTED` places a text). A file looks up all of its words that are posted; each place gives the offset at which
that licence text would begin. Offsets are intersected in windows of 2 * `DRIFT` words, every `DRIFT` words, so that
words changed, added or left out do not lose a text. A window with enough different posted places is a candidate, and
each mandatory key phrase of the text must stand whole within it. Base phrases are found from their rarest word and
verified word by word.

The texts are read twice, for the document frequencies and for the scan; both times everything is local to a row, so no
text is shuffled and no licence, however common, gathers in one task. Work is linear in the words of a file (a sort of
its hits aside).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold_ascii
from .license_texts import TEXTS

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed values: (label, phrase). They count wherever they stand.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Places of a licence text that are posted, the words of highest inverse document frequency first.
POSTED = 24
#: A licence text is found if all its words move by no more than so many.
DRIFT = 16
#: Least share of a text's posted places that must be met in one window.
SHARE = 0.6
# A hit is one long: text * TEXT + window * WINDOW + rank of the posted place.
WINDOW, TEXT = 1 << 10, 1 << 44


@dataclass(frozen=True)
class Licence:
    label: str
    words: tuple[str, ...]
    phrases: tuple[str, ...]

    @property
    def posted(self) -> int:
        return min(POSTED, len(self.words))

    @property
    def need(self) -> int:
        return math.ceil(SHARE * self.posted)


def licences(texts=TEXTS) -> list[Licence]:
    return [Licence(label, tuple(re.findall(WORDS, fold_ascii(text))), tuple(phrases)) for label, text, phrases in texts]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def strings(values) -> Column:
    return F.lit(list(values))


def frequencies(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each licence word stands, by one pass; no more rows than there are such words."""
    present = F.array_intersect("words", strings(vocabulary))
    return {r["word"]: r["count"] for r in documents.select(F.explode(present).alias("word")).groupBy("word").count().collect()}


def rarest_places(licence: Licence, seen: dict[str, int]) -> list[int]:
    """The posted places of a text, rarest word first; ties by word and place."""
    return sorted(range(len(licence.words)), key=lambda i: (seen.get(licence.words[i], 0), licence.words[i], i))[: licence.posted]


def lookup(postings: dict[str, list[tuple[int, ...]]], names: tuple[str, ...]) -> Column:
    """A map literal from a word to its postings; as text, for the index has some hundred of them."""
    one = lambda p: "named_struct(" + ", ".join(f"'{n}', {v}L" for n, v in zip(names, p)) + ")"
    return F.expr("map(" + ", ".join(f"'{w}', array({', '.join(map(one, at))})" for w, at in sorted(postings.items())) + ")")


def license_scan(docs: DataFrame, texts=TEXTS, base=BASE) -> DataFrame:
    """One row per row of (doc_id, text): word and base-phrase counts, first and last base place, labels and score.

    n_base counts the places of the base phrases; first_word and last_word are null without one. labels adds those of
    the licence texts found: in one window, at least the share `SHARE` of the posted places and all mandatory key
    phrases. score is the largest share of posted places met by a text found, 1 with a base phrase, 0 without either.
    Null and empty texts have no words. Rows that repeat are scanned each by itself; the words of equal document
    frequency are posted in the order of words and places, so ties do not depend on partitioning.
    """
    index = licences(texts)
    longest = -(-max(len(t.words) for t in index) // DRIFT) * DRIFT
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("words"))
    seen = frequencies(text, sorted({w for t in index for w in t.words} | {w for _, p in base for w in p.split()}))

    posted: dict[str, list[tuple[int, ...]]] = {}
    for number, t in enumerate(index):
        for rank, at in enumerate(rarest_places(t, seen)):
            posted.setdefault(t.words[at], []).append((number, rank, at))
    own: dict[str, list[tuple[int, ...]]] = {}
    for number, (_, phrase) in enumerate(base):
        parts = phrase.split()
        at = min(range(len(parts)), key=lambda i: (seen.get(parts[i], 0), parts[i], i))
        own.setdefault(parts[at], []).append((number, at))

    everywhere = F.transform("words", lambda w, i: F.when(w.isin(sorted({*posted, *own})), i))
    places = text.select("doc_id", "words", F.filter(everywhere, lambda i: i.isNotNull()).alias("places"))

    def hits(table: Column, of) -> Column:
        found = F.transform("places", lambda i: F.transform(F.element_at(table, F.get("words", i)), lambda p: of(i.cast("long"), p)))
        return F.flatten(F.filter(found, lambda at: at.isNotNull()))

    def windows(i: Column, p: Column) -> Column:
        at = F.floor((i - p["at"] + longest) / DRIFT) + 1  # the windows that begin here and one step before
        key = p["licence"] * TEXT + at * WINDOW + p["rank"]
        return F.array(key, key - WINDOW)

    phrases = F.array(*[strings(p.split()) for _, p in base])
    stands = lambda h: F.slice("words", F.greatest(h["start"], F.lit(0)) + 1, F.size(F.get(phrases, h["phrase"]))) == F.get(phrases, h["phrase"])
    tried = places.select(
        "doc_id", "words",
        F.filter(hits(lookup(own, ("phrase", "at")), lambda i, p: F.struct(p["phrase"].alias("phrase"), (i - p["at"]).alias("start"))), lambda h: (h["start"] >= 0) & stands(h)).alias("own"),
        F.sort_array(F.array_distinct(F.flatten(hits(lookup(posted, ("licence", "rank", "at")), windows)))).alias("keys"),
    )

    # keys ascend: a window has enough different places if the key so many further on is still of it
    group = lambda k: F.shiftright(k, 10)
    licence = lambda k: F.shiftright(k, 44).cast("int")
    needs, posts = F.array(*[F.lit(t.need - 1) for t in index]), F.array(*[F.lit(float(t.posted)) for t in index])

    def window(k: Column, j: Column) -> Column:
        """The window that begins with key k, with its share of posted places; null if another key is its first or it has too few."""
        still = lambda n: group(F.get("keys", j + n)) == group(k)
        first = (j == 0) | ~still(-1)
        met = reduce(lambda low, n: F.when(still(n), F.lit(n + 1.0)).otherwise(low), range(1, POSTED), F.lit(1.0))
        return F.when(first & still(F.get(needs, licence(k))), F.struct(group(k).alias("at"), (met / F.get(posts, licence(k))).alias("share")))

    candidates = tried.select("doc_id", "words", "own", F.filter(F.transform("keys", window), lambda g: g.isNotNull()).alias("windows"))

    lengths = F.array(*[F.lit(len(t.words)) for t in index])
    mandatory = F.array(*[strings(f" {p} " for p in t.phrases) for t in index])

    def verified(g: Column) -> Column:
        number, begin = F.shiftright(g["at"], 34).cast("int"), ((g["at"] % (TEXT // WINDOW)) - 1) * DRIFT - longest
        end, begin = begin + 2 * DRIFT + F.get(lengths, number), F.greatest(begin, F.lit(0))
        shown = F.concat(F.lit(" "), F.array_join(F.slice("words", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), " "), F.lit(" "))
        return F.forall(F.get(mandatory, number), lambda p: F.contains(shown, p))

    found = candidates.select("doc_id", "words", "own", F.filter("windows", verified).alias("found"))

    def named(labels, numbers: Column) -> Column:
        return F.transform(numbers, lambda n: F.get(strings(labels), n.cast("int")))

    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base_labels = named([n for n, _ in base], F.transform("own", lambda h: h["phrase"]))
    own_labels = named([t.label for t in index], F.transform("found", lambda g: F.shiftright(g["at"], 34)))
    starts = F.transform("own", lambda h: h["start"])
    best = F.coalesce(F.array_max(F.transform("found", lambda g: g["share"])), F.lit(0.0))
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("own").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base_labels).alias("base_labels"), listed(F.concat(base_labels, own_labels)).alias("labels"),
        F.round(F.when(F.size("own") > 0, F.lit(1.0)).otherwise(best), 6).alias("score"),
    )


def op4_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB: base phrases tried at every word; posted places by rank of document frequency, joined and grouped by window."""
    index = licences()
    longest = -(-max(len(t.words) for t in index) // DRIFT) * DRIFT
    quoted = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
    own = " UNION ALL ".join(f"SELECT r, '{label}' AS label, i - 1 AS start FROM places WHERE w[i : i + {len(p.split()) - 1}] = {quoted(p.split())}" for label, p in BASE)
    texts = ", ".join(f"({n}, '{t.label}', {quoted(t.words)}, {quoted(f' {p} ' for p in t.phrases)}, {t.posted}, {t.need})" for n, t in enumerate(index))
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words),
own AS ({own}),
based AS (SELECT r, count(*) AS n, min(start) AS first, max(start) AS last, list(DISTINCT label) AS labels FROM own GROUP BY r),
texts(t, label, body, phrases, posted, need) AS (VALUES {texts}),
bodies AS (SELECT t, posted, unnest(body) AS word, unnest(range(len(body))) AS place FROM texts),
seen AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(w) AS word FROM words) SEMI JOIN bodies USING (word) GROUP BY word),
ranked AS (SELECT t, word, place, posted, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word, place) AS rank FROM bodies LEFT JOIN seen USING (word)),
hits AS (SELECT r, t, rank, floor((i - 1 - place + {longest}) / {DRIFT}.0)::BIGINT AS q FROM (SELECT r, i, w[i] AS word FROM places) JOIN ranked USING (word) WHERE rank <= posted),
met AS (SELECT r, t, q, count(DISTINCT rank) AS n FROM (SELECT r, t, rank, q FROM hits UNION ALL SELECT r, t, rank, q - 1 FROM hits) GROUP BY r, t, q),
tried AS (SELECT r, label, phrases, n / posted::DOUBLE AS share, ' ' || array_to_string(w[greatest(q * {DRIFT} - {longest}, 0) + 1 : q * {DRIFT} - {longest} + {2 * DRIFT} + len(body)], ' ') || ' ' AS shown
  FROM met JOIN texts USING (t) JOIN words USING (r) WHERE n >= need),
found AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM tried WHERE len(list_filter(phrases, lambda p: NOT contains(shown, p))) = 0 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(f.labels, []))), ','), '') AS labels,
  round(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END, 6)::DOUBLE AS score
FROM words LEFT JOIN based b USING (r) LEFT JOIN found f USING (r)"""
