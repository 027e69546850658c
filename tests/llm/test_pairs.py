"""Joins, mixing, tokenization and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clustrum.llm import bpe, jaccard, mixing, quality, secrets, vectors
from clustrum.llm.common import settled, table
from tests.checks import agree, connect


def sets(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, linked):
    ids = [r[0] for r in rows]
    label = {i: i for i in ids}
    moved = True
    edges = [(a[0], b[0]) for n, a in enumerate(rows) for b in rows[n + 1 :] if linked(a[1], b[1])]
    while moved:
        moved = False
        for a, b in edges:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_groups_of_copies_and_chains(spark):
    """Exact copies, near copies at many similarities, chains of edits, and many texts that share a passage."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 9, 15, 30, 80, 200, 500]))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            t = list(rng.choice(texts[-3:]))
            for _ in range(rng.randrange(1 + len(t) // 12)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
    chain = [word() for _ in range(100)]
    for i in range(12):
        chain = list(chain)
        chain[(i * 7) % 100] = word()
        texts.append(chain)
    texts += [passage + [word() for _ in range(rng.randrange(20, 200))] for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(150):  # a large group of near copies
        t = list(base)
        t[rng.randrange(150)] = word()
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    s = {i: sets(t) for i, t in rows}
    want = components([(i, s[i]) for i, _ in rows], lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    assert {i: (len(s[i]), want[i]) for i in s} == got


def least_similar_pairs(rng, n):
    """Pairs of sets at similarity 0.75: one within the other, and of about equal sizes."""
    h = rng.integers(0, 2**64, n * 2, dtype=np.uint64)
    common, extra = h[:n], h[n : n + n // 3]
    half = len(extra) // 2
    yield np.unique(common), np.unique(np.concatenate([common, extra]))
    yield np.unique(np.concatenate([common, extra[:half]])), np.unique(np.concatenate([common, extra[half:]]))


@pytest.mark.parametrize("single", [False, True])
def test_linked_sets_share_more_pieces_than_each_may_spare(single):
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(0.75, single)
    for n in (1, 2, 3, 4, 5, 6, 9, 15, 30, 47, 48, 49, 60, 64, 65, 120, 190, 256, 300, 768, 900, 3100):
        for _ in range(40):
            for a, b in least_similar_pairs(rng, n):
                assert 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
                band = bands.of(len(b))
                assert band in bands.both(len(a)) and band in bands.both(len(b))
                (x, enough), (y, also) = jaccard.pieces(a, band, bands), jaccard.pieces(b, band, bands)
                assert enough and also
                shared = len(set(x.tolist()) & set(y.tolist()))
                assert shared > max(bands.spare(len(a), band), bands.spare(len(b), band))


def test_spare_pieces_by_every_partner():
    for threshold in (0.75, 0.8, 0.9, 0.5):
        bands = jaccard.Bands(threshold)
        want = lambda n, band: min(n, -int(-(bands.considered(n, band) - 1e-9) // 1))
        for n in [*range(1, 300), 1000, 1023, 1024, 1025, 5000]:
            for band in bands.both(n):
                for x in range(-int(-(threshold * n - 1e-9) // 1), int(n / threshold + 1e-9) + 1):
                    if bands.of(max(n, x)) == band:
                        apart = int(bands.bound(n, x) + 1e-9)
                        shared = (n + x - apart) / 2 if bands.tokens_alone(band) else min(want(n, band), want(x, band)) - apart
                        assert shared > bands.spare(n, band)


def test_a_boilerplate_shingle_makes_no_candidates(spark, monkeypatch):
    """20,000 short documents that share a sentence, and a few near copies among them."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(10**9)}"
    rows = [(i, " ".join(["all rights are reserved here", *(word() for _ in range(30))])) for i in range(20_000)]
    rows += [(20_000 + i, rows[i][1] + " end") for i in range(40)]
    seen = []
    inner = jaccard.members_of_pieces
    monkeypatch.setattr(jaccard, "members_of_pieces", lambda *a: seen.append(inner(*a)) or seen[-1])
    monkeypatch.setattr(jaccard, "forget", lambda *_: None)
    out = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r["doc_id"], r["component_id"]) for r in out.where("doc_id <> component_id").collect()} == {(20_000 + i, i) for i in range(40)}
    assert seen[0].select("row").distinct().count() == 80


def test_size_classes():
    for n in [*range(1, 3000), 10**4, 10**6]:
        c = jaccard.class_of(n)
        assert jaccard.least_of(c) <= n < jaccard.least_of(c + 1)
        assert c == n or jaccard.least_of(c + 1) <= 1.04 * jaccard.least_of(c) + 1


@pytest.mark.parametrize("n", [4, 8, 40, 200])
def test_linked_sets_meet_on_tokens_by_their_sizes(spark, monkeypatch, n):
    """All pieces hot: groups of all similarities around the threshold, against all pairs."""
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 0)
    rng = random.Random(n)
    word = lambda: f"v{rng.randrange(10**6)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(n + 4)]
        texts.append(base)
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randrange(1 + n // 20)):
                t[rng.randrange(len(t))] = word()
            texts.append(t[: len(t) - rng.randrange(1 + n // 3)] + [word() for _ in range(rng.randrange(1 + n // 6))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    s = {i: sets(t) for i, t in rows}
    want = components([(i, s[i]) for i, _ in rows], lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


@pytest.mark.parametrize("shared, own", [(7, 1), (60, 13), (250, 60)])
def test_a_template_that_is_most_of_a_text_makes_few_candidates(spark, monkeypatch, shared, own):
    """Texts that share most of their words, but under the threshold: pairs stay in proportion to the texts."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(shared)]
    many = 4000 if shared < 10 else 1000
    rows = [(i, " ".join([*template, *(f"u{i}x{j}" for j in range(own))])) for i in range(many)]
    rows += [(many, rows[5][1] + " a"), (many + 1, rows[7][1])] if shared > 10 else [(many, rows[7][1])]
    seen = []
    inner = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: seen.append(pairs.count()) or inner(pairs, *a))
    out = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    linked = {(r["doc_id"], r["component_id"]) for r in out.where("doc_id <> component_id").collect()}
    assert linked == ({(many, 5), (many + 1, 7)} if shared > 10 else {(many, 7)})
    assert max(seen) <= 4 * len(rows)


def test_bands_with_too_few_pieces_are_done_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LOAD", (9.0, 9.0))  # so full parts that most sets have too few
    rng = random.Random(12)
    texts = []
    for n in (60, 70, 100, 190, 250, 300, 700) * 3:
        base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        texts += [base, base[: n - n // 6], [*base[n // 9 :], "x"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    s = {i: sets(t) for i, t in rows}
    bands = jaccard.Bands(0.75)
    full = [jaccard.shingles(t, jaccard.WordHashes()) for _, t in rows]
    assert sum(not jaccard.pieces(x, k, bands)[1] for x in full for k in bands.both(len(x))) > 20
    want = components([(i, s[i]) for i, _ in rows], lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, b), (None, c), (None, b + " end"), (2, "other words"), (2, "other words"), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs).collect())
    assert got == Counter([(1, 36, 1), (1, 36, 1), (None, 36, None), (None, 37, 1), (2, 1, 2), (2, 1, 2), (None, 0, None), (None, 0, None), (3, 0, 3)])
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, a), (1, b), (None, c), (2, "other words"), (None, None), (None, None), (3, "")])


def test_bit_sketch_bounds_the_difference():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 500, dtype=np.uint64)
    a, b = np.unique(h[:400]), np.unique(h[50:])
    apart = int(np.bitwise_count((jaccard.bit_sketch(a) ^ jaccard.bit_sketch(b)).view(np.uint64)).sum())
    assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_links_are_counted_for_both_ends(spark, monkeypatch):
    monkeypatch.setattr(vectors.MultiIndex, "_calibrated", lambda self, *_: 2)  # few visits: many pairs are met from one side only
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x = np.concatenate([x, x + 0.15 * rng.normal(size=x.shape)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, per_cell=4).collect()}
    sizes = Counter(r["component_id"] for r in got.values())
    assert max(sizes.values()) > 1 and all((r["n_links"] > 0) == (sizes[r["component_id"]] > 1) for r in got.values())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(got[i]["n_links"] <= n - 1 for i, n in enumerate((u @ u.T >= 0.95).sum(1)))


def test_calibration_does_not_look_at_the_first_rows_only(monkeypatch):
    seen = []
    monkeypatch.setattr(vectors.MultiIndex, "_calibrated", lambda self, x, *_: seen.append(x) or 4)
    sample = vectors.unit(np.stack([np.arange(1.0, 4097), np.ones(4096)], 1))
    vectors.MultiIndex(sample, 4, 0.95)
    assert len(seen[0]) == 2048 and (seen[0][:, 1] < sample[2048, 1]).any()


def planted(rng, groups, size, dim, alone, spread):
    """Vectors around centers, with cosines on either side of 0.95, among others."""
    centers = rng.normal(size=(groups, dim))
    x = np.concatenate([rng.normal(size=(alone, dim)), np.repeat(centers, size, 0) + rng.normal(size=(groups * size, dim)) * spread])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("per_cell", [64, 2])
def test_planted_links_by_brute_force(spark, per_cell):
    rng = np.random.default_rng(6)
    x = planted(rng, 60, 8, 16, 900, 0.12)
    x = np.concatenate([x, x[:50] * 2])  # copies but for their length
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, per_cell=per_cell).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= linked.sum(1)).all() and found.sum() >= 0.99 * linked.sum() > 1000 and found.sum() % 2 == 0
    whole = np.flatnonzero(found == linked.sum(1))
    assert len(whole) >= 0.98 * len(x)
    want = components([(i, i) for i in range(len(x))], lambda a, b: bool(linked[a, b]))
    missed = {want[i] for i in range(len(x)) if found[i] < linked[i].sum()}  # of these a component may have come apart
    assert all(got[i]["component_id"] == want[i] for i in range(len(x)) if want[i] not in missed) and len(missed) <= 12
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_planted_links_agree_with_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = planted(rng, 30, 6, 12, 200, 0.04)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vectors.op7_query(spark, str(tmp_path))
    assert got.agg(F.sum("n_links")).first()[0] > 500
    agree(got, vectors.ORACLE, connect(str(tmp_path)))


def test_cells_in_order_of_their_sums():
    rng = np.random.default_rng(2)
    x = vectors.unit(rng.normal(size=(500, 6)))
    index = vectors.MultiIndex(x, 9, 0.95)
    one, two = index.distances(x[:40])
    sums = (one[:, :, None] + two[:, None, :]).reshape(40, -1)
    for many in (1, 5, 81):
        got = index.cells(x[:40], many)
        assert np.allclose(np.take_along_axis(sums, got, 1), np.sort(sums, 1)[:, :many])
        assert all(len(set(r)) == many for r in got.tolist())
    own = index.cells(x[40:80], 1)
    ranks = (sums < np.take_along_axis(sums, own, 1) - 1e-12).sum(1) + 1
    assert np.abs(index._ranks(x[:40], x[40:80])[:40] - ranks).max() <= 1


def filled(sizes, weights, budget, repeats=2):
    """Targets by resharing the excess until none is above its limit."""
    full, target = set(), {}
    while True:
        left = budget - sum(repeats * sizes[s] for s in full)
        total = sum(weights[s] for s in sizes if s not in full)
        target = {s: repeats * sizes[s] if s in full else left * weights[s] / total for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > repeats * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.randrange(1, 1000) for s in rng.sample("abcdefghijklm", 7)} | {None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_comes_near_its_targets(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)


def test_encoding_is_that_of_whole_texts(spark, messy, messy_rows):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(8)
    odd = "".join(rng.choices(list("ab 1\n\t\r,'é  \x1c\U0001f600"), k=40_000))
    assert bpe.encode(odd, enc, size=50) == enc.encode_ordinary(odd)
    out = bpe.bpe_round_trip(messy, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True)
    texts = {}
    for r in messy_rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in out.collect():
        t = next(t for t in texts[r["doc_id"]] if hashlib.sha256(t.encode()).hexdigest() == r["decoded_sha256"])
        ids = enc.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode_ids(out.select("doc_id", "ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {bytes(r["bytes"]) for r in back.collect()} == {t.encode() for ts in texts.values() for t in ts}


def test_pipeline_stage_by_stage(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settled(stage(spark, docs, sf))
        kept[name] = docs
        if name != "encoded":
            assert docs.columns == before.columns
        if name == "quality":
            words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
            assert docs.where(words < 50).count() == 0
            labels = table(spark, sf, "labels").where("quality = 1")
            good = before.join(labels, "doc_id").where(words >= 50)
            assert docs.join(labels, "doc_id").count() >= 0.97 * good.count()
        if name == "near_duplicates":
            every = [(r["doc_id"], sets(r["text"])) for r in before.collect()]
            label = components(every, lambda a, b: 100 * len(a & b) >= 75 * len(a | b) > 0)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(label.values()))
        if name == "secrets":
            assert docs.count() == before.count()
            assert not any(secrets.base_spans(r["text"].replace("<assign>", "").replace("<access>", "").replace("<hex>", "")) for r in docs.collect())
        if name == "mixture":
            want = sorted(i for r in mixing.mix(before).where("taken > 0").collect() for i in [r["doc_id"]] * (r["taken"] // r["size"]))
            assert sorted(r["doc_id"] for r in docs.collect()) == want
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = sorted((r["doc_id"], enc.encode_ordinary(r["text"])) for r in kept["mixture"].collect())
    assert sorted((r["doc_id"], r["ids"]) for r in kept["encoded"].collect()) == want


def row_of(r):
    return tuple(map(str, r))


def test_pipeline_on_messy_and_empty_documents(spark, messy, empty, some_labels, tmp_path):
    """Each stage keeps just the rows that its operator decides for, null and repeated ids included."""
    some_labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = settled(messy.select(*columns))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settled(stage(spark, docs, str(tmp_path)))
        old, new = before.collect(), Counter(map(row_of, docs.select(docs.columns[:5]).collect()))
        if name == "quality":
            kept = [r for r in quality.quality_rules(before, some_labels).collect()]
            assert Counter(str(r["doc_id"]) for r in kept if r["kept"]) == Counter(r[0] for r in new.elements())
            assert not new - Counter(map(row_of, old))
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) >= 50 for r in new)
            docs = before  # the next stages see every row
        if name == "near_duplicates":
            every = [(n, sets(r["text"])) for n, r in enumerate(sorted(old, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))]
            label = components(every, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
            assert sum(new.values()) == len(set(label.values())) < len(old)
            texts = Counter(r["text"] for r in old)
            assert all(new[row_of(r)] == texts[r["text"]] for r in old if r["text"] is None or not r["text"].strip())
            assert sum(k[0] == "None" for k in new) == sum(r["doc_id"] is None for r in old)
        if name == "secrets":
            assert sum(new.values()) == len(old) and Counter(k[0] for k in new.elements()) == Counter(str(r["doc_id"]) for r in old)
            assert sum(k[1] != "None" for k in new.elements()) == sum(r["text"] is not None for r in old)
        if name == "mixture":
            n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes = Counter()
            for r in old:
                sizes[r["source"]] += n(r["text"])
            taken = Counter()
            for k, times in new.items():
                assert times <= 2 * sum(row_of(r) == k for r in old) and n(k[1]) > 0
                taken[k[3]] += times * n(k[1])
            order = sorted(sizes, key=lambda s: (s is None, s))
            goal = filled({s: v for s, v in sizes.items() if v}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
            for s, v in goal.items():
                assert abs(taken[str(s)] - v) <= max(n(r["text"]) for r in old if r["source"] == s)
        if name == "encoded":
            assert docs.count() == len(old) and Counter(str(r["doc_id"]) for r in docs.collect()) == Counter(str(r["doc_id"]) for r in old)
    docs = settled(empty.select(*columns))
    for name, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0 and (name == "encoded" or docs.columns == columns)


def test_the_cut_is_found_by_narrowing(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 40), rng.choice("abc")) for i in range(3000)], "doc_id long, text string, source string")
    one = lambda **k: sorted(map(tuple, mixing.mix(docs, **k).collect()))
    assert one(steps=2, rows_per_bucket=2) == one()
