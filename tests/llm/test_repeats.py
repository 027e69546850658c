import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from clustrum.llm import repeats


def common(d, i, j, most):
    k = 0
    while k < most and d[i + k] == d[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_factor_lengths_by_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(60):
        size = rng.choice([16, 17, 20, 31, 33, 64])
        d = bytes(rng.randrange(letters) for _ in range(rng.randrange(size, 150)))
        d += d[: rng.randrange(60)] + bytes([9]) + d[:40]
        starts = np.array(sorted(rng.sample(range(len(d) - size + 1), min(len(d) - size + 1, rng.randrange(1, 60)))))
        earlier, later = repeats.factor_lengths(np.frombuffer(d, np.uint8), starts, size)
        for x, i in enumerate(starts):
            assert earlier[x] == max((common(d, i, j, size) for j in starts[:x]), default=0)
            assert later[x] == max((common(d, i, j, size) for j in starts[x + 1 :]), default=0)


def test_stretches_hold_each_start_once():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    ends = np.array([0, 700, 700, 739, 2000, 5000])
    first, size, a, h = repeats.cut_stretches(data, ends, 40, 16)
    starts = [s for f, n in zip(first, size) for s in range(f, f + n)]
    assert sorted(starts) == [s for b, e in zip([0, *ends[:-1]], ends) for s in range(b, e - 39)]
    of = {}
    for f, n, at, hash_ in zip(first, size, a, h):
        for s in range(f, f + n):
            assert 0 <= f + at - s <= 24
            assert of.setdefault(data[s : s + 40].tobytes(), (f + at - s, hash_)) == (f + at - s, hash_)  # equal strings, equal anchors


def brute(rows, size, keep_first=False):
    """Digest columns by all strings of `size` bytes; rows in order."""
    texts = [(t or "").encode() for _, t in rows]
    met = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    seen, out = set(), []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - size + 1):
            s = t[i : i + size]
            if s in seen if keep_first else met[s] > 1:
                gone[i + 1 : i + 1 + size] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((doc_id, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def some(rng, n, letters="abcd ü"):
    return "".join(rng.choice(letters) for _ in range(n))


def corpus(seed, copies=5):
    rng = random.Random(seed)
    passage, base = some(rng, 130), some(rng, 400)
    rows = [some(rng, rng.randrange(300)) for _ in range(10)]
    rows += [some(rng, rng.randrange(90)) + passage[rng.randrange(30) : 130 - rng.randrange(30)] + some(rng, rng.randrange(90)) for _ in range(copies)]
    for _ in range(copies):
        at = rng.randrange(400)
        rows.append(base[:at] + "X" + base[at + 1 :])
    rows += [base, base, base * 2, "ab" * 200, "x" * 300, "", None, passage[:50]]
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("pack", [1 << 19, 300])
def test_removal_by_brute_force(spark, keep_first, pack):
    rows = corpus(7)
    got = repeats.remove_repeats(frame(spark, rows), 60, keep_first, pack=pack).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 60, keep_first))


def test_hot_groups_are_split_without_loss(spark):
    """Hundreds of texts around one passage, and of near copies: groups far beyond the pack."""
    rows = corpus(11, copies=150)
    got = repeats.remove_repeats(frame(spark, rows), 60, pack=2000).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 60))


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    long = some(rng, 9000)
    rows = [(0, long), (1, long[2000:2500]), (2, some(rng, 700) + long[8000:8300])]
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    got = repeats.remove_repeats(frame(spark, rows), 100).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 100))


def test_messy_table(spark, messy, messy_rows):
    got = repeats.remove_repeats(messy).collect()
    want = brute([(r[0], r[1]) for r in messy_rows], repeats.LENGTH)
    assert Counter(map(tuple, got)) == Counter(want)


def test_kept_text_and_spans(spark):
    rng = random.Random(9)
    shared = some(rng, 80, "qrst")
    rows = [(1, "aé" + shared + "b"), (2, shared), (3, "other")]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(frame(spark, rows), 50, keep_text=True).collect()}
    assert bytes(got[1]["kept"]).decode() == "aéb" and [tuple(s) for s in got[1]["spans"]] == [(3, 83)]
    assert bytes(got[2]["kept"]) == b"" and bytes(got[3]["kept"]) == b"other" and not got[3]["spans"]
    first = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(frame(spark, rows), 50, keep_first=True).collect()}
    assert first == {1: 0, 2: 80, 3: 0}


def test_short_strings_are_refused(messy):
    with pytest.raises(ValueError):
        repeats.remove_repeats(messy, 8)
