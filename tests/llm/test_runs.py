import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clustrum.llm import runs


def brute(s, least=12):
    """(start, length, period) of all runs, from every pair of equal words."""
    n, found = len(s), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 6)), max_size=7)


@settings(max_examples=600, deadline=None)
@given(pieces, st.sampled_from([2, 3, 5, 6, 12]))
def test_runs_by_brute_force(parts, least):
    s = [c for part, times in parts for c in part * times]
    assert runs.runs_of(s, least) == brute(s, least)
    assert [(a, b - a, q) for a, b, q in runs.runs(s, least)] == brute(s, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_factors(s):
    cut = runs.factors(s)
    assert [x for a, b, _ in cut for x in s[a:b]] == s
    for a, b, source in cut:
        size = b - a
        occurs = lambda n: any(s[j : j + n] == s[a : a + n] for j in range(a))
        if source < 0:
            assert size == 1 and s[a] not in s[:a]
        else:
            assert source < a and s[source : source + size] == s[a:b] and (b == len(s) or not occurs(size + 1))


def test_nested_and_long_runs():
    inner = list(range(3)) * 5
    s = (inner + list(range(10, 40))) * 4
    assert runs.runs_of(s) == brute(s)
    assert runs.runs_of([0] * 50_000) == [(0, 50_000, 1)]
    assert runs.runs_of(list(range(20_000)) * 2) == [(0, 40_000, 20_000)]
    assert runs.runs_of(list(range(20_000))) == []


def reference(doc_id, text):
    words = (text or "").encode().split()
    found = brute(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_messy_table_by_brute_force(messy, messy_rows):
    rows = [r for r in messy_rows if len(r[1] or "") < 20_000]
    found = runs.periodic_runs(messy.where("text IS NULL OR length(text) < 20000")).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found), key=key) == sorted((reference(r[0], r[1]) for r in rows), key=key)


def test_collapsed_text(spark):
    text = "start " + "a b c d " * 5 + "end"
    docs = spark.createDataFrame([(1, text), (2, "no run here"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs, keep_text=True).collect()}
    assert got[1]["collapsed"] == "start a b c d end" and [tuple(x) for x in got[1]["runs"]] == [(1, 20, 4)] and got[1]["exponent_milli"] == 5000
    assert got[2]["collapsed"] == "no run here" and got[3]["collapsed"] == "" and got[3]["n_runs"] == 0 and got[3]["start"] is None


def test_planting_keeps_the_number_of_words():
    for doc_id in range(200):
        words = [str(i) for i in range(doc_id % 37)]
        assert len(runs.planted(doc_id, words)) == len(words)
    assert runs.planted(None, ["a", "b"]) == ["a", "b"]


def test_least_is_checked(messy):
    with pytest.raises(ValueError):
        runs.periodic_runs(messy, least=1)
