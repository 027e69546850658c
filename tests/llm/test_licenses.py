"""Licence texts in documents, against the texts themselves and brute force."""

import random
import re
from collections import defaultdict

import pytest

from clustrum.llm import licenses
from clustrum.llm.licenses import DRIFT, licences, rarest_places

ALL = licences()
BY_LABEL = {t.label: t for t in reversed(ALL)}


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.license_scan(rows).collect()}


def prose(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_phrases_stand_in_their_texts():
    for t in ALL:
        assert all(f" {p} " in f" {' '.join(t.words)} " for p in t.phrases), t.label


def test_every_text_is_found_within_prose(spark):
    rng = random.Random(3)
    texts = [" ".join(prose(rng, 50 + 7 * n) + list(t.words) + prose(rng, 40)) for n, t in enumerate(ALL)]
    for n, r in scanned(spark, texts).items():
        assert ALL[n].label in r["labels"].split(","), ALL[n].label
        assert r["score"] == 1.0


def changed(rng, t, times):
    """Words changed, added and left out, not within a key phrase."""
    text = " ".join(t.words)
    for p in t.phrases:
        text = text.replace(p, p.replace(" ", "_"))
    out = text.split()
    for _ in range(times):
        free = [i for i, w in enumerate(out) if "_" not in w]
        if not free:
            break
        at = rng.choice(free)
        out[at : at + rng.randrange(2)] = [f"changed{rng.randrange(99)}"] if rng.random() < 0.7 else []
    return " ".join(out).replace("_", " ")


@pytest.mark.parametrize("label", ["mit", "isc", "bsd", "zlib", "apache-2", "gpl-3"])
def test_a_text_with_ten_changes_is_found(spark, label):
    rng = random.Random(label)
    texts = [" ".join(prose(rng, 30)) + " " + changed(rng, BY_LABEL[label], 10) for _ in range(6)]
    assert [r["labels"].split(",").count(label) for r in scanned(spark, texts).values()] == [1] * 6


def test_texts_about_licences_are_not_found(spark):
    about = (
        "The licence says that permission is granted free of charge, that copies or substantial portions carry the notice, and that the software is provided as is. "
        "Lawyers discuss the warranties of merchantability, and whether redistribution in source and binary forms needs a notice. "
        "A person who wants to endorse or promote products should read the GNU General Public License first; both are free software."
    )
    shuffled = list(BY_LABEL["mit"].words)
    random.Random(1).shuffle(shuffled)
    without_phrase = " ".join(BY_LABEL["mit"].words).replace("free of charge", "at no charge")
    assert [r["labels"] for r in scanned(spark, [about, " ".join(shuffled), without_phrase]).values()] == ["", "", ""]


def brute_force(texts):
    """Labels by trying each window of each licence text, without an index."""
    split = [re.findall(licenses.WORDS, t.lower()) for t in texts]
    seen = defaultdict(int)
    for w in split:
        for x in set(w):
            seen[x] += 1
    out = []
    for w in split:
        found = {label for label, p in licenses.BASE if f" {p} " in f" {' '.join(w)} "}
        for t in ALL:
            posted = rarest_places(t, seen)
            for begin in range(-20 * DRIFT, len(w) + 1, DRIFT):
                met = sum(any(w[i] == t.words[at] for i in range(max(begin + at, 0), min(begin + at + 2 * DRIFT, len(w)))) for at in posted)
                shown = f" {' '.join(w[max(begin, 0) : max(begin + 2 * DRIFT + len(t.words), 0)])} "
                if met >= t.need and all(f" {p} " in shown for p in t.phrases):
                    found.add(t.label)
        out.append(",".join(sorted(found)))
    return out


def test_labels_by_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(prose(rng, 20) + changed(rng, rng.choice(ALL), rng.randrange(40)).split() + changed(rng, rng.choice(ALL), rng.randrange(60)).split()) for _ in range(24)]
    texts += ["", "Released under the MIT License. All rights reserved.", " ".join(BY_LABEL["bsd"].words[40:])]
    assert [r["labels"] for r in scanned(spark, texts).values()] == brute_force(texts)


def test_many_copies_in_one_text_take_linear_time(spark):
    body = " ".join(BY_LABEL["mit"].words)
    got = scanned(spark, [" ".join([body] * 2000)])
    assert (got[0]["labels"], got[0]["n_words"]) == ("mit", 2000 * len(BY_LABEL["mit"].words))
