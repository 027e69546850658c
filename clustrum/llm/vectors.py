"""Embedding near-duplicates with an inverted multi-index.

Each half of a vector has its own codebook; the pair of nearest codewords is the vector's cell in a product grid. A
vector looks for neighbours in its own cell and in the next ones in order of the sum of its distances to the two
codewords (the multi-sequence algorithm: a heap over the two sorted lists of codewords, so that the grid is never
written out), as many as reach the target recall on calibration pairs. Candidates are verified by
cosine in double precision, in blocks: a cell, however full, is cut into chunks, and a task sees two chunks at a time.
A block returns numbers of links and a spanning forest of the links, never all pairs. A pair that only one side's
visits find is counted for both.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, sampled, settled
from .components import connected

CHUNK = 1024
#: Codewords of a half at most: enough for 4e9 vectors at 64 a cell; beyond, cells fill up and are cut into more chunks.
MOST_CODEWORDS = 8192
#: Sampled vectors for each codeword of a half, at least.
PER_CODEWORD = 16
#: Up to so many cells (24 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 250_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k codewords of the rows of `x` (a bounded sample)."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[i : i + CHUNK], centers).argmin(1) for i in range(0, len(x), CHUNK)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1), 0)


class MultiIndex:
    """Codebooks of the two halves, and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float = 0.99, seed: int = 5):
        self.half = max(1, sample.shape[1] // 2)
        k = max(1, min(k, len(sample)))
        self.books = [kmeans(part, k, seed=seed + i) for i, part in enumerate(self._halves(sample)) if part.shape[1]]
        self.k = k
        self.visits = self._calibrated(sample[np.random.default_rng(seed).permutation(len(sample))[:2048]], threshold, recall, seed)

    def _halves(self, x):
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each row's halves to the codewords; of vectors with one half, a second list of one 0."""
        d = [squared(part, book) for part, book in zip(self._halves(x), self.books)]
        return d if len(d) == 2 else [d[0], np.zeros((len(x), 1))]

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The `visits` nearest cells of each row, in order of the sum of both distances."""
        one, two = self.distances(x)
        width = two.shape[1]
        first, second = np.argsort(one, 1, kind="stable"), np.argsort(two, 1, kind="stable")
        a, b = np.take_along_axis(one, first, 1), np.take_along_axis(two, second, 1)
        visits = min(visits, one.shape[1] * width)
        return np.array([[first[r, i] * width + second[r, j] for i, j in multi_sequence(a[r].tolist(), b[r].tolist(), visits)] for r in range(len(x))], np.int64).reshape(len(x), visits)

    def _calibrated(self, x, threshold, recall, seed) -> int:
        """Cells to visit so that `recall` of pairs are met: sampled vectors and random neighbours of theirs, with
        cosines spread from the threshold to 1, and the real pairs of the sample."""
        rng = np.random.default_rng(seed)
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        cos = rng.uniform(threshold, 1, (len(x), 1))
        found = [self._ranks(x, cos * x + np.sqrt(1 - cos**2) * noise)]
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        if len(a):
            some = rng.choice(len(a), min(len(a), 4096), replace=False)
            found.append(self._ranks(x[a[some]], x[b[some]]))
        most = max(float(np.quantile(r, recall)) for r in found)
        return int(max(4, np.ceil(most) + 2))

    def _ranks(self, a, b) -> np.ndarray:
        """How many cells `a` visits until that of `b`, at most, in both directions."""
        out = []
        for p, q in ((a, b), (b, a)):
            one, two = self.distances(p)
            i, j = (d.argmin(1) for d in self.distances(q))
            own = one[np.arange(len(p)), i] + two[np.arange(len(p)), j]
            two.sort(1)
            out.append(np.array([np.searchsorted(two[r], own[r] - one[r], "left").sum() + 1 for r in range(len(p))]))
        return np.concatenate(out)


def multi_sequence(a: list[float], b: list[float], many: int):
    """The `many` pairs of places (i, j) of smallest a[i] + b[j], in that order, of two ascending lists. The heap holds
    the next pair of each i begun; i is begun once i - 1 has given its first."""
    heap = [(a[0] + b[0], 0, 0)]
    for _ in range(many):
        _, i, j = heapq.heappop(heap)
        yield i, j
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a boolean matrix of links between rows and columns: the least column label of each linked row's component
    and the same for columns; -1 where nothing is linked."""
    many = linked.shape[1]
    columns = np.arange(many)
    while True:
        rows = np.where(linked, columns[None, :], many).min(1)
        lower = np.minimum(columns, np.where(linked, rows[:, None], many).min(0))
        if (lower == columns).all():
            return np.where(rows < many, rows, -1), np.where(linked.any(0), columns, -1)
        columns = lower


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, sample_rows: int = 8192, per_cell: int = 64) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding).

    Vectors link if their cosine is at least `threshold`. Null or zero vectors, and those with null or non-finite
    components, link with nothing (n_links 0, their own component); vectors of different lengths never link. Equal
    vectors are one class, expanded into counts only. Codewords of a half grow with the root of the vectors, to about
    `per_cell` vectors a cell, up to MOST_CODEWORDS; they are fitted on about `sample_rows` vectors, or PER_CODEWORD for
    each codeword if that is more, and the visits calibrated on 2048 of these, chosen at random (documented bounds).
    Every vector is indexed. Rows of one vec_id are vectors of their own, told apart by their values; components that do not
    meet may so have one name. A null vec_id is no component's name unless all of a component's are null.
    """
    rows = settled(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")))
    sound = (
        F.col("x").isNotNull() & ~F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    )
    good = rows.where(sound).withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    classes = settled(good.groupBy("x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    results = []
    for size in [r["d"] for r in classes.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]:
        results.append(_linked(classes.where(F.size("x") == size), threshold, recall, sample_rows, per_cell))
    if not results:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, edges = results[0]
    for c, e in results[1:]:
        counts, edges = counts.union(c), edges.union(e)
    grown = connected(edges)
    placed = settled(classes.join(counts, "id", "left").join(grown, "id", "left").select("x", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))  # nulls name nothing
    by_class = placed.join(names, "component").select("x", F.col("n_links").cast("long").alias("n_links"), "component_id")
    linked = good.join(by_class, "x").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.union(alone).select("vec_id", "n_links", "component_id", kept.alias("kept"))


def _linked(classes: DataFrame, threshold: float, recall: float, sample_rows: int, per_cell: int):
    """(id, links) and (a, b) edges among classes (x, id, n) of one vector length; id is a number of the class alone."""
    total = classes.count()
    k = int(np.clip(np.ceil((total / per_cell) ** 0.5), 1, MOST_CODEWORDS))
    sample = unit(sampled(classes, F.col("x"), total, max(sample_rows, PER_CODEWORD * k)).orderBy("x").select("x").toPandas()["x"])
    index = MultiIndex(sample, k, threshold, recall)

    def work(ids, ns, xs):
        if not ids:
            return [[], [], [], [], [], []]
        visited = index.cells(unit(xs), index.visits)
        k = visited.shape[1]
        return [np.repeat(ids, k).tolist(), np.repeat(ns, k).tolist(), [x for x in xs for _ in range(k)], visited.ravel().tolist(), list(range(k)) * len(ids), [v for v in visited.tolist() for _ in range(k)]]

    # rank 0 is the vector's own cell: there it is both a member and a probe
    visits = map_columns(classes.select("id", "n", "x"), work, "id long, n long, x array<double>, cell int, rank int, visited array<int>", rows=256)
    sizes = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("probes"), F.sum((F.col("rank") == 0).cast("long")).alias("members")).where("members > 0")
    chunks = sizes.select("cell", F.ceil(F.col("probes") / CHUNK).alias("pc"), F.ceil(F.col("members") / CHUNK).alias("mc"))
    placed = visits.join(F.broadcast(chunks) if k * k <= BROADCAST_CELLS else chunks, "cell")
    slot = F.xxhash64("id")
    probes = placed.select("cell", "id", "n", "x", F.element_at("visited", 1).alias("own"), F.pmod(slot, "pc").alias("p"), F.explode(F.sequence(F.lit(0), F.col("mc") - 1)).alias("m"))
    members = placed.where("rank = 0").select(
        F.col("cell").alias("of"), F.col("id").alias("member"), F.col("n").alias("copies"), F.col("x").alias("y"), "visited",
        F.pmod(slot, "mc").alias("mm"), F.explode(F.sequence(F.lit(0), F.col("pc") - 1)).alias("mp"),
    )

    def block(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "other": [], "links": []}).astype("int64")
        if not len(p) or not len(m):
            return none
        a, b = p["id"].to_numpy(), m["member"].to_numpy()
        linked = (unit(p["x"]) @ unit(m["y"]).T >= threshold) & (a[:, None] != b[None, :])
        if not linked.any():
            return none
        counts = linked @ m["copies"].to_numpy(np.int64)
        # a member that does not visit the probe's own cell finds it nowhere else
        own, visited = p["own"].to_numpy(), np.stack(m["visited"].to_numpy())
        probe, member = np.nonzero(linked)
        back = np.zeros(len(b), np.int64)
        for i in range(0, len(probe), 1 << 16):
            r, c = probe[i : i + (1 << 16)], member[i : i + (1 << 16)]
            unseen = ~(visited[c] == own[r, None]).any(1)
            np.add.at(back, c[unseen], p["n"].to_numpy(np.int64)[r[unseen]])
        rows, columns = forest(linked)
        head = int(linked.shape[1])
        r, c = np.nonzero(rows >= 0)[0], np.nonzero((columns >= 0) & ((columns != np.arange(head)) | (back > 0)))[0]
        return pd.DataFrame({
            "id": np.concatenate([a[r], b[c]]), "other": np.concatenate([b[rows[r]], b[columns[c]]]),
            "links": np.concatenate([counts[r], back[c]]),
        }).astype("int64")

    found = settled(probes.groupBy("cell", "p", "m").cogroup(members.groupBy("of", "mp", "mm")).applyInPandas(block, "id long, other long, links long"))
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))


def op7_query(spark, sf_dir) -> DataFrame:
    from .common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
found AS (SELECT id, min(other)::BIGINT AS component_id FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN found f ON e.vec_id = f.id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id"""
