"""Removal of long repeated byte strings by longest-previous-factor arrays, spread over the cluster.

Two equal strings of `length` bytes have the same least k-gram hash at the same place, so that hash (their anchor) brings
them together. Neighbouring strings with one anchor are kept as one stretch, which is what travels:

1. each text is cut into stretches (row-local); a stretch is named by its anchor's hash and the hash of its bytes;
2. equal stretches are one class, counted by a partial aggregate; anchors met once are dropped;
3. stretches of an anchor with several classes are put in suffix order in packs of a bounded size. For each place the
   previous and next smaller positions in that order are the candidates for its longest earlier match, and their mirror
   for a later one. Groups over the bound are split by where in a string the anchor lies and by the bytes that all
   strings of such a part share, until they fit or hold equal strings only;
4. what was found for a class is joined to all its occurrences, and the spans of a text are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_columns, settled, small_batches, table, with_rows

LENGTH = 400
#: Bytes that one task puts in suffix order at once, and that a group may have before it is split.
PACK = 1 << 19
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, grown as needed and kept for each Python worker."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def first(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def cut_stretches(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor's place after the first start, anchor's hash) of the stretches in texts that end at
    `ends` of data: starts of strings of `length` bytes whose least hash of k bytes (the first of equals) is the same one."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64)
    up, down = Powers.first(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * up, out=sums[1:])
    gram = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, size = length - k + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.r_[0, ends[:-1]]
    lasts = ends - length  # of starts; windows behind it run into the next text
    cuts = np.unique(np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, begins, np.maximum(lasts + 1, begins)]))
    cuts = cuts[cuts < len(anchor)]
    size = np.diff(np.r_[cuts, len(anchor)])
    of = np.searchsorted(ends, cuts, side="right")
    good = cuts <= lasts[of]
    first, size = cuts[good], size[good]
    return first, size, anchor[first] - first, gram[anchor[first]]


def stretches(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(row, lo, n, a, h1, h2) of the stretches of (row, text): n starts from byte lo on, the anchor a bytes after lo, hashes of the anchor and of all bytes."""

    def parts(rows, texts) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Blocks of (row, offset, bytes): whole texts together, long ones in parts that overlap by length - 1 bytes."""
        block, held = ([], [], []), 0
        for row, text in zip(rows, texts):
            for at in range(0, max(1, len(text) - length + 1), BLOCK) if len(text) >= length else ():
                piece = text[at : at + BLOCK + length - 1]
                for column, v in zip(block, (row, at, piece)):
                    column.append(v)
                held += len(piece)
                if held >= BLOCK:
                    yield block
                    block, held = ([], [], []), 0
        if held:
            yield block

    def run(batches):
        for batch in batches:
            for rows, offsets, pieces in parts(batch.column(0).to_pylist(), (t.as_buffer() for t in batch.column(1))):
                whole = b"".join(map(memoryview, pieces))
                ends = np.cumsum([len(p) for p in pieces])
                first, size, a, h1 = cut_stretches(np.frombuffer(whole, np.uint8), ends, length, k)
                of = np.searchsorted(ends, first, side="right")
                view = memoryview(whole)
                h2 = [xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(first.tolist(), (first + size + (length - 1)).tolist())]
                lo = first - np.r_[0, ends[:-1]][of] + np.array(offsets)[of]
                columns = [np.array(rows, np.int64)[of], lo, size.astype(np.int32), a.astype(np.int32), h1.view(np.int64), np.array(h2, np.uint64).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "lo", "n", "a", "h1", "h2"])

    small_batches(docs.sparkSession)
    return docs.select("row", "text").mapInArrow(run, "row long, lo long, n int, a int, h1 long, h2 long")


def suffix_ranks(data: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of all places by their first 8, 16, 32, ... bytes (zeros behind the end), up to the last such number within length."""
    x = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        x = (x[:-step] << np.uint64(shift)) | x[step:]
    ranks, depth = [np.unique(x[: len(data)], return_inverse=True)[1]], 8
    while 2 * depth <= length:
        r = ranks[-1].astype(np.int64) + 1
        behind = np.r_[r[depth:], np.zeros(min(depth, len(r)), np.int64)]
        ranks.append(np.unique(r * (len(data) + 2) + behind, return_inverse=True)[1])
        depth *= 2
    return ranks


def nearest_smaller(places: np.ndarray) -> np.ndarray:
    """For each index the last one before it with a smaller value, -1 without any, by jumping over larger ones."""
    at = np.arange(len(places)) - 1
    while True:
        over = np.flatnonzero((at >= 0) & (places[at] > places))
        if not len(over):
            return at
        at[over] = at[at[over]]


def factor_lengths(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending `starts` the longest match, up to `length` bytes, with an earlier start, and with a later one.

    In suffix order (to `length` bytes, equals by place) the best earlier start is the nearest one on either side that
    stands earlier in the text: what lies between stands later, and matches shrink with the distance in that order.
    """
    n = len(starts)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ranks = suffix_ranks(data, length)
    depth = 8 << (len(ranks) - 1)
    last = ranks[-1].astype(np.int64)
    order = np.argsort(last[starts] * (len(data) + 1) + last[starts + length - depth], kind="stable")

    def match(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes of the strings at starts i and j."""
        x, y, common = starts[i], starts[j], np.zeros(len(i), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            size = 8 << level
            for _ in range(2 if level == len(ranks) - 1 else 1):
                ok = common + size <= length
                p, q = np.where(ok, x + common, 0), np.where(ok, y + common, 0)
                common += np.where(ok & (ranks[level][p] == ranks[level][q]), size, 0)
        for _ in range(7):
            ok = common < length
            p, q = np.where(ok, x + common, 0), np.where(ok, y + common, 0)
            same = ok & (data[p] == data[q])
            if not same.any():
                break
            common += same
        return np.minimum(common, length)

    def best(places: np.ndarray) -> np.ndarray:
        """The longest match with a start of smaller place; places in suffix order."""
        out = np.zeros(n, np.int64)
        for at in (nearest_smaller(places), (n - 1 - nearest_smaller(places[::-1])[::-1])):
            at = np.where(at >= n, -1, at)
            here = np.flatnonzero(at >= 0)
            if len(here):
                out[order[here]] = np.maximum(out[order[here]], match(order[here], order[at[here]]))
        return out

    return best(order), best(n - 1 - order)


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


SPANS = "array<struct<a: int, b: int>>"


def matched(slices: DataFrame, length: int, pack: int) -> DataFrame:
    """(h1, h2, again, ahead): starts of a class, counted from its first, that match an earlier or a later string of the same
    group. Slices are (g, row, lo, h1, h2, at, n, bytes); whole groups, in packs of about `pack` bytes, go in suffix order."""

    def found(rows):
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        begins = np.cumsum([0] + [len(r[4]) for r in rows[:-1]])
        starts = np.concatenate([np.arange(b, b + r[3]) for b, r in zip(begins.tolist(), rows)])
        earlier, later = factor_lengths(data, starts, length)
        done, again, ahead = [], [], []
        at = 0
        for r in rows:
            one, two = earlier[at : at + r[3]] >= length, later[at : at + r[3]] >= length
            at += r[3]
            if one.any() or two.any():
                done.append(r)
                again.append([{"a": a + r[2], "b": b + r[2]} for a, b in spans_of(one)])
                ahead.append([{"a": a + r[2], "b": b + r[2]} for a, b in spans_of(two)])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        columns = [pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array(again, kind), pa.array(ahead, kind)]
        return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "again", "ahead"])

    def run(batches):
        rows, held, group = [], 0, None
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and held >= pack:
                    yield found(rows)
                    rows, held = [], 0
                group = g
                rows.append(row)
                held += len(row[4])
        if rows:
            yield found(rows)

    small_batches(slices.sparkSession)
    ordered = slices.repartition("g").sortWithinPartitions("g", "row", "lo", "at").select("g", "h1", "h2", "at", "n", "bytes")
    return ordered.mapInArrow(run, f"h1 long, h2 long, again {SPANS}, ahead {SPANS}")


def halves(slices: DataFrame, length: int) -> DataFrame:
    """Each slice as two, by how far into a string the anchor lies (from b0 up to b1), grouped by the bytes that all strings of a half share."""

    def work(g, row, lo, h1, h2, at, n, a, b0, b1, data):
        out = [[] for _ in range(11)]
        for g_, row_, lo_, h1_, h2_, at_, n_, a_, b0_, b1_, d in zip(g, row, lo, h1, h2, at, n, a, b0, b1, data):
            mid = (b0_ + b1_) // 2
            for c0, c1 in ((b0_, mid), (mid, b1_)):
                first, last = max(0, a_ - c1 + 1), min(n_ - 1, a_ - c0)
                if first <= last:
                    core = d[a_ - c0 : a_ - c1 + 1 + length]
                    key = xxhash.xxh3_64_intdigest(g_.to_bytes(8, "little", signed=True) + c0.to_bytes(4, "little") + core)
                    part = d[first : last + length]
                    for column, v in zip(out, (key - (1 << 64) if key >> 63 else key, row_, lo_, h1_, h2_, at_ + first, last - first + 1, a_ - first, c0, c1, part)):
                        column.append(v)
        return out

    return map_columns(slices.select(*SLICE), work, "g long, row long, lo long, h1 long, h2 long, at int, n int, a int, b0 int, b1 int, bytes binary", rows=256)


SLICE = ("g", "row", "lo", "h1", "h2", "at", "n", "a", "b0", "b1", "bytes")


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, k: int | None = None, pack: int = PACK) -> DataFrame:
    """(row, lo, hi) of byte spans of (row, text binary): each is made of strings of `length` bytes that also start elsewhere,
    or with keep_first earlier (in order of row, then place). Spans of a row may overlap; rows are unique longs, texts not null."""
    if length < 16:
        raise ValueError("strings of 16 bytes at least are compared")
    k = k or max(8, length * 2 // 5)
    every = settled(stretches(docs, length, k))
    classes = settled(every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "lo", "n", "a")).alias("first")).select("h1", "h2", "c", "first.*"))
    groups = settled(classes.groupBy("h1").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + length - 1).alias("size")).where("total > 1"))
    copied = classes.where("c > 1")

    several = groups.where("m > 1").select("h1", "size")
    wanted = settled(classes.join(several, "h1").select("h1", "h2", "row", "lo", "n", "a", "size"))
    pieces = wanted.groupBy("row").agg(F.collect_list(F.struct("h1", "h2", "lo", "n", "a", "size")).alias("pieces"))  # of one text
    cut = F.transform("pieces", lambda s: F.struct(
        s["h1"].alias("g"), s["lo"].alias("lo"), s["h1"].alias("h1"), s["h2"].alias("h2"), F.lit(0).alias("at"), s["n"].alias("n"), s["a"].alias("a"),
        F.lit(0).alias("b0"), F.lit(length - k + 1).alias("b1"), F.substring(F.col("text"), (s["lo"] + 1).cast("int"), (s["n"] + length - 1).cast("int")).alias("bytes"), s["size"].alias("size"),
    ))
    slices = settled(docs.join(pieces, "row").select("row", F.explode(cut).alias("s")).select("row", "s.*"))

    ready, open_, same = slices.where(F.col("size") <= pack).select(*SLICE), slices.where(F.col("size") > pack).select(*SLICE), None
    spent = []
    while open_.limit(1).count():
        split = settled(halves(open_, length))
        sizes = settled(split.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("bytes")).alias("size"), F.max(F.col("b1") - F.col("b0")).alias("width")).where("m > 1"))
        spent += [split, sizes]
        fits = (F.col("size") <= pack) & (F.col("width") > 1)
        ready = ready.unionByName(split.join(sizes.where(fits).select("g"), "g").select(*SLICE))
        # strings of a group that one place of the anchor is left to are equal
        equal = split.join(sizes.where("width = 1").select("g"), "g").select("h1", "h2", "at", "row", "lo", "g")
        same = equal if same is None else same.unionByName(equal)
        open_ = settled(split.join(sizes.where((F.col("size") > pack) & (F.col("width") > 1)).select("g"), "g").select(*SLICE))
        spent.append(open_)
    found = settled(matched(ready, length, pack))
    none = F.array().cast(SPANS)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).cast(SPANS)
    if keep_first:
        results = copied.select("h1", "h2", none.alias("own"), whole.alias("others")).unionByName(found.select("h1", "h2", F.col("again").alias("own"), none.alias("others")))
    else:
        both = F.concat("again", "ahead")
        # strings of a class with copies are all repeated, whatever else they match
        alone = found.join(copied.select("h1", "h2"), ["h1", "h2"], "left_anti")
        results = copied.select("h1", "h2", whole.alias("own"), whole.alias("others")).unionByName(alone.select("h1", "h2", both.alias("own"), both.alias("others")))
    if same is not None:
        least = same.groupBy("g").agg(F.min(F.struct("row", "lo", "at")).alias("least"))
        own = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).cast(SPANS)
        more = same.join(least, "g")
        if keep_first:
            more = more.where(F.struct("row", "lo", "at") > F.col("least"))
        results = results.unionByName(more.select("h1", "h2", own.alias("own"), own.alias("others") if not keep_first else none.alias("others")))
    results = results.join(classes.select("h1", "h2", F.col("row").alias("frow"), F.col("lo").alias("flo")), ["h1", "h2"]) if keep_first else results.withColumn("frow", F.lit(None).cast("long")).withColumn("flo", F.lit(None).cast("long"))
    results = settled(results)
    is_first = F.coalesce((F.col("row") == F.col("frow")) & (F.col("lo") == F.col("flo")), F.lit(False))
    hit = every.join(results, ["h1", "h2"]).select("row", "lo", F.explode(F.when(is_first, F.col("own")).otherwise(F.col("others"))).alias("s"))
    out = settled(hit.select("row", (F.col("lo") + F.col("s.a")).alias("lo"), (F.col("lo") + F.col("s.b") + length - 1).alias("hi")))
    forget(every, classes, groups, wanted, slices, found, results, *spent)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, keep_text: bool = False, pack: int = PACK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of (doc_id, text); with keep_text also kept (binary, as a cut
    may fall inside a character) and spans (lo, hi).

    Removed is each byte of a string of `length` bytes that also starts elsewhere in the table, in the same text too;
    overlaps count, and the input decides, not what is left. With keep_first only strings that also start earlier go, in
    order of doc_id (or of a fixed number of rows, if ids are null or repeated). A null text is empty; texts under `length`
    bytes lose nothing; repeated rows are copies of each other. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    docs, row = with_rows(docs)
    docs = docs.withColumnRenamed(row, "row")
    spans = repeated_spans(docs.select("row", "text"), length, keep_first, pack=pack)
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))  # of one text

    def work(ids, texts, lists):
        out = [[] for _ in range(6)]
        for text, spans in zip(texts, lists):
            merged: list[list[int]] = []
            for s in spans or ():
                if merged and s["lo"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["hi"])
                else:
                    merged.append([s["lo"], s["hi"]])
            edges = [0, *(x for m in merged for x in m), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for column, v in zip(out, (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in merged])):
                column.append(v)
        return [ids, *out[: 6 if keep_text else 4]]

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<lo: long, hi: long>>" if keep_text else "")
    joined = docs.join(listed, "row", "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return map_columns(joined, work, schema, rows=256)


def op11_query(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Strings of 400 bytes by the md5 of their hex digits; spans by gaps between the places that such strings cover.
ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT *, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
o AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
spans AS MATERIALIZED (SELECT doc_id, k, min(i) AS lo, max(i) + 400 AS hi FROM p GROUP BY doc_id, k),
gaps AS (SELECT d.doc_id, coalesce(lag(hi) OVER w, 0) AS a, lo AS b FROM spans JOIN d USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY lo)
    UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
per AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN per USING (doc_id)"""
