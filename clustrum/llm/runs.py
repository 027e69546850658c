"""Periodic runs of words: maximal repetitions by the algorithm of Kolpakov and Kucherov, one document at a time.

A text's words become numbers. Only words that some repeated window of six words covers can be in a run of at least
twelve, so the algorithm goes over the stretches of these, which lose no run. A stretch is cut into LZ factors, read off
its suffix automaton; Main's algorithm finds the runs that touch or cross a border of factors, and runs inside a factor
are copied from its earlier occurrence. All of it is linear in the stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, duckdb_crc32, map_columns, table

LEAST = 12


def automaton(s: list[int]):
    """(transitions, first ends) of the suffix automaton of s: for each state a dict, and where its strings first end."""
    step, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for at, c in enumerate(s):
        new = len(step)
        step.append({})
        length.append(at + 1)
        first.append(at)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step, first


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, source) of the LZ factors: the longest that also begins earlier (at source; it may overlap), else one new letter (source -1)."""
    step, first = automaton(s)
    out, at, n = [], 0, len(s)
    while at < n:
        state, end = 0, at
        while end < n:
            to = step[state].get(s[end])
            if to is None or first[to] >= end:
                break
            state, end = to, end + 1
        if end == at:
            out.append((at, at + 1, -1))
            at += 1
        else:
            out.append((at, end, first[state] - (end - at) + 1))
            at = end
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place the length of the longest prefix of s that begins there (Z function)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(s: list[int], border: int, low: int, high: int, least: int, found: dict) -> None:
    """Main's step: runs that touch or cross `border`, seen in s[low:high], join `found`, (start, end) to period. A
    repetition that could be extended beyond the window is one of another border."""
    n, left, right = len(s), s[low:border], s[border:high]
    back = left[::-1]

    def add(start: int, end: int, p: int) -> None:
        if end - start >= max(least, 2 * p) and not (start and s[start - 1] == s[start - 1 + p]) and not (end < n and s[end] == s[end - p]):
            known = found.get((start, end))
            if known is None or p < known:
                found[start, end] = p

    # periods whose second copy begins right of the border: s[border : border + p] is inside
    ahead = prefixes(right)
    behind = prefixes(back + [-1] + (left + right)[::-1])[len(back) + 1 :]
    total = len(left) + len(right)
    for p in range(1, len(right) + 1):
        more = ahead[p] if p < len(right) else 0
        less = behind[total - len(left) - p] if len(left) else 0
        if more + less >= p:
            add(border - less, border + p + more, p)
    # periods whose first copy ends left of the border: s[border - p : border] is inside
    match = prefixes(right + [-1] + left + right)[len(right) + 1 :] if right else [0] * total
    suffix = prefixes(back)
    for p in range(1, len(left) + 1):
        more = min(match[len(left) - p], len(right)) if right else 0
        less = suffix[p] if p < len(left) else 0
        if more + less >= p:
            add(border - p - less, border + more, p)


def runs(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of s of at least max(least, 2 * period) letters, in order."""
    cut = factors(s)
    found: dict[tuple[int, int], int] = {}
    for i in range(1, len(cut) + 1):
        before = cut[i - 1][1] - cut[i - 1][0]
        here = cut[i][1] - cut[i][0] if i < len(cut) else 0
        if 2 * (before + here) < least:  # a run at this border is shorter
            continue
        border = cut[i - 1][1]
        touching(s, border, max(0, border - 2 * before - here), border + here, least, found)
    starts: dict[int, list[tuple[int, int]]] = {}
    for (start, end), p in found.items():
        starts.setdefault(start, []).append((end, p))
    for a, b, source in cut:
        shift = a - source
        if source >= 0 and b - a > least:
            for at in range(a + 1, b - least):
                for end, p in starts.get(at - shift, ()):
                    if end + shift < b and (at, end + shift) not in found:
                        found[at, end + shift] = p
                        starts.setdefault(at, []).append((end + shift, p))
    return sorted((start, end, p) for (start, end), p in found.items())


def stretches(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of maximal stretches of words that repeated windows of least // 2 words cover. Each word of a run of
    at least max(least, 2 * period) is in such a window: the run shifted by its period covers the other end."""
    width, n = max(1, least // 2), len(codes)
    m = n - width + 1
    if m < 2:
        return []
    h = np.zeros(m, np.uint64)
    c = codes.astype(np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + m] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    where = np.searchsorted(twice, h)
    where[where == len(twice)] = 0
    hit = np.flatnonzero(twice[where] == h)
    change = np.zeros(n + 1, np.int64)
    change[hit] += 1
    change[hit + width] -= 1
    inside = np.r_[0, (np.cumsum(change)[:n] > 0).astype(np.int8), 0]
    edge = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a list of words, by start, then period."""
    seen: dict = {}
    codes = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    out = []
    for a, b in stretches(codes, least):
        out += [(a + start, end - start, p) for start, end, p in runs(codes[a:b].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that follow the first copy in any run."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, p in found:
        change[start + p] += 1
        change[start + length] -= 1
    keep = np.cumsum(change)[:-1] == 0
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Callable | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of each row of (doc_id, text); with
    keep_text also collapsed (the text) and runs (start, length, period).

    A run is a stretch of at least max(least, 2 * period) words that are the same `period` words apart and that no
    neighbouring word extends. start to exponent_milli (1000 times length over period) are those of the longest one (ties: the
    first, then the least period), null without a run. The text without the repetitions is its words joined by single
    blanks, less those that follow a run's first copy. A null text has no words. Rows are judged each by itself, so
    repeated ids and rows do not meet; an empty table gives no rows. `edit(doc_id, words)` may replace the words first.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def work(ids, texts):
        out = [[] for _ in range(7)]
        kept, spans = [], []
        for doc_id, text in zip(ids, texts):
            words = (text or b"").split()
            if edit:
                words = edit(doc_id, words)
            found = runs_of(words, least)
            start, length, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
            short = b" ".join(collapsed(words, found))
            row = [len(found), start, length, p, 1000 * length // p if found else None, hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(), hashlib.sha256(short).hexdigest()]
            for column, v in zip(out, row):
                column.append(v)
            if keep_text:
                kept.append(short.decode())
                spans.append([{"start": a, "length": n, "period": q} for a, n, q in found])
        return [ids, *out, *([kept, spans] if keep_text else [])]

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    more = ", collapsed string, runs array<struct<start: long, length: long, period: long>>" if keep_text else ""
    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")), work, schema + more, rows=256)


def planted(doc_id, words: list) -> list:
    """The words of a document of op12's contract: from one in ten on, the words from some place on repeat a stretch of them."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_query(spark, sf_dir) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), edit=planted)


#: Equal windows of six words stand at both ends of a period; neighbouring ones of one period make a run.
ORACLE = f"""
WITH base AS MATERIALIZED (SELECT doc_id, {duckdb_crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS w FROM documents),
plan AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM base),
words AS MATERIALIZED (SELECT doc_id, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM plan)),
windows AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, string_agg(word, ' ') OVER six AS s, count(*) OVER six AS n FROM words WINDOW six AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE n = 6),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
per AS (SELECT doc_id, count(*) AS n_runs, min_by((start, length, period), (-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.doc_id)
SELECT b.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM base b LEFT JOIN per ON per.doc_id = b.doc_id LEFT JOIN kept ON kept.doc_id = b.doc_id"""
