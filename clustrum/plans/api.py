"""The estimator: options, checks, and the sequence seed, K-medoids, refinement or balancing."""

from __future__ import annotations

import difflib
import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edit
from ..functions.energy import Energy
from ..functions.metrics import Metric
from ..operators import balance as balancing
from ..operators import kmedoids, refine, remap, seeding
from ..operators.assign import nearest2, nearest2_dense, nearest2_edit
from ..session import settled
from ..sources import text as text_source

LEVELS = {"clarans": (0, 1, 2, 3), "voronoi": (0,)}


@dataclass
class Result:
    """labels (id, k, d), medoids (k, id, x), centers (k, x; the refined ones if there was refinement), rounds, and why it ended."""

    labels: DataFrame
    medoids: DataFrame
    centers: DataFrame
    rounds: DataFrame
    halt_reason: str
    mean_energy: float


@dataclass
class Clusterer:
    """K-medoids around K samples that minimise the summed energy of distances, with optional refinement.

    Controls that do not depend on the clock come first: max_rounds, max_proposals, min_mE. max_time (seconds) and
    max_itok (total time in initialisation times) are looked at between jobs. Levels 0 to 2 accept the same swaps,
    with fewer distances each; 3 screens proposals on growing samples first. nthreads and rooted are accepted for familiarity and change nothing.
    """

    K: int = 0
    algorithm: str = "clarans"
    critical_radius: float = 0.0
    do_balance_labels: bool = False
    energy: str = "quadratic"
    exponent_coeff: float = 0.0
    init: object = "kmeans++-20"
    level: int = 3
    max_itok: float = 1e7
    max_proposals: int = 1000
    max_rounds: int = 100000
    max_time: float = 10.0
    metric: str = "l2"
    min_mE: float = 0.0
    nthreads: int = 1
    patient: bool = True
    rooted: bool = False
    seed: int = 1011
    batch: int = 16

    def __init__(self, **options):
        known = {f.name: f.default for f in fields(self)}
        for name in options:
            if name not in known:
                near = difflib.get_close_matches(name, known, 1, 0.4)
                raise TypeError(f"no option {name!r}" + (f"; maybe {near[0]!r} is meant" if near else ""))
        for name, default in known.items():
            setattr(self, name, options.get(name, default))
        self._energy = Energy(self.energy, self.critical_radius, self.exponent_coeff)
        if self.algorithm not in LEVELS or self.level not in LEVELS[self.algorithm]:
            raise ValueError(f"no level {self.level} of algorithm {self.algorithm!r}; there are {LEVELS}")
        if isinstance(self.init, str):
            seeding.Init.parse(self.init)
        elif len(list(self.init)) != self.K:
            raise ValueError("as many initial indices as K are needed")

    def dense(self, samples: DataFrame, do_vdimap: bool = False, do_refinement: bool = False, rf_max_rounds: int = 100, rf_max_time: float = 1e9, rf_alg: str = "auto") -> Result:
        """Cluster (id, x ARRAY<DOUBLE>). rf_alg (standard, yinyang, exponion, or auto by the number of dimensions) has no effect on the result."""
        m = Metric(self.metric)
        if do_vdimap:
            samples = settled(remap.remap(samples, self.metric, self.seed))
        return self._run(samples, lambda s, c: nearest2_dense(s, c, self.metric), m.dense, do_refinement, rf_max_rounds, rf_max_time, metric=self.metric, rf_alg=rf_alg)

    def sparse(self, samples: DataFrame, do_refinement: bool = False, rf_max_rounds: int = 100, rf_max_time: float = 1e9) -> Result:
        """Cluster (id, x MAP<BIGINT, DOUBLE>)."""
        d = Metric(self.metric).sparse
        return self._run(samples, lambda s, c: nearest2(s, c, d), d, do_refinement, rf_max_rounds, rf_max_time, is_sparse=True)

    def sequences(self, samples: DataFrame, costs: edit.Costs | tuple = edit.Costs()) -> Result:
        """Cluster (id, x STRING or ARRAY<INT>) by the edit distance; metric is levenshtein or normalised levenshtein. Costs may
        be a pair (indel, switch) of numbers or arrays by integer symbol. Tables must cover all symbols and be a metric."""
        costs = costs if isinstance(costs, edit.Costs) else edit.costs_of(*costs)
        if self.metric not in ("levenshtein", "normalised levenshtein"):
            raise ValueError("sequences have the metrics levenshtein and normalised levenshtein")
        strings = dict(samples.dtypes)["x"] == "string"
        size = F.length("x") if strings else F.size("x")
        if samples.where(F.col("x").isNull() | (size == 0)).limit(1).count():
            raise ValueError("there is an empty sequence")
        if strings and isinstance(costs.indel, dict) and not all(isinstance(a, str) for a in costs.indel):
            raise ValueError("cost arrays are for integer sequences; strings take tables by character")
        lacking = edit.without_cost(samples, costs)
        if lacking:
            raise ValueError("no costs of the symbols " + ", ".join(map(str, lacking)))
        self._check_costs(samples.sparkSession, costs)
        normalised = self.metric.startswith("norm")
        if costs.unit and strings:
            d = lambda a, b: edit.distance(a, b, costs, normalised)
            return self._run(samples, lambda s, c: nearest2(s, c, d), d)
        return self._run(samples, lambda s, c: nearest2_edit(s, c, costs, normalised), edit.batched(costs, normalised))

    def text(self, spark: SparkSession, files: list[str], costs_file: str, out: str | None = None) -> Result:
        """Cluster the sequences of plain or FASTA files; `out` gets them with their labels."""
        rows = settled(text_source.read_sequences(spark, files))
        costs = text_source.read_costs(spark, costs_file)
        lacking = text_source.missing_costs(rows, costs)
        if lacking:
            raise ValueError("costs are missing: " + ", ".join(lacking))
        result = self.sequences(rows.select("id", F.col("s").alias("x")), costs)
        if out:
            text_source.write_labelled(rows.join(result.labels.select("id", "k"), "id"), out)
        return result

    def _check_costs(self, spark, costs) -> None:
        if not isinstance(costs.indel, dict):
            return
        indel = spark.createDataFrame([(str(a), float(v)) for a, v in costs.indel.items()], "a string, cost double")
        switch = spark.createDataFrame([(str(a), str(b), float(v)) for (a, b), v in costs.switch.items()], "a string, b string, cost double")
        bad = edit.violations(indel, switch, self.metric.startswith("norm")).limit(3).collect()
        if bad:
            raise ValueError("the costs are no metric: " + "; ".join(f"{r['rule']} {r['a']} {r['b'] or ''}".strip() for r in bad))

    def _run(self, samples, assign, distance, do_refinement=False, rf_max_rounds=100, rf_max_time=1e9, is_sparse=False, metric=None, rf_alg="standard") -> Result:
        if do_refinement and self.do_balance_labels:
            raise ValueError("balancing does not go with refinement")
        if do_refinement:
            refine.objective(self.metric, self._energy)
        n = samples.count()
        if not 1 <= self.K < n:
            raise ValueError(f"K must be at least 1 and less than the {n} samples")
        began = time.perf_counter()
        medoids, state = seeding.seeded(samples, self.K, self.init, self.seed, self._energy, distance, metric)
        medoids = settled(medoids)
        now = time.perf_counter()
        deadline = min(began + self.max_time, began + (self.max_itok + 1) * (now - began))
        rounds = kmedoids.Rounds()
        if self.algorithm == "voronoi":
            state, medoids, rounds = kmedoids.voronoi(samples, medoids, assign, self._energy, distance, self.max_rounds, self.min_mE, deadline, rounds, metric, state)
        else:
            state, medoids, rounds = kmedoids.clarans(
                samples, medoids, assign, self._energy, distance, self.seed, self.max_rounds, self.max_proposals, self.patient, self.level, self.batch, self.min_mE, deadline, rounds, metric, state
            )
        centers = medoids.select("k", "x")
        if do_refinement:
            state, centers, rounds = refine.refine(samples, centers, self.metric, self._energy, rf_max_rounds, time.perf_counter() + rf_max_time, rounds, is_sparse, distance, algorithm=rf_alg)
        labels = state.select("id", F.col("a1").alias("k"), F.col("d1").alias("d"))
        if self.do_balance_labels:
            own = balancing.balance(labels.select("id", "k"), medoids, distance)
            x = samples.join(own, "id").join(F.broadcast(medoids.select("k", F.col("x").alias("c"))), "k")
            labels = settled(x.select("id", "k", distance(F.col("x"), F.col("c")).alias("d")))
        return Result(labels, medoids, centers, rounds.frame(samples.sparkSession), rounds.halt_reason, rounds.log[-1][2])


def kmeans(samples: DataFrame, K: int, seed: int = 1011, max_time: float = 1e9, **options) -> Result:
    """K-means: greedy-free binned seeding, CLARANS, re-mapping and refinement of (id, x ARRAY<DOUBLE>)."""
    own = {"init": "kmeans++-5", "metric": "l2", "energy": "quadratic", "max_itok": 10.0, "level": 3, "patient": True}
    return Clusterer(K=K, seed=seed, max_time=max_time, **(own | options)).dense(samples, do_vdimap=True, do_refinement=True)


def vcenters(labelled: DataFrame, K: int) -> DataFrame:
    """(k, x) for k = 0 .. K - 1: the mean of (k, x) samples by label; null for a label without samples."""
    every = labelled.sparkSession.range(K).select(F.col("id").cast("int").alias("k"))
    return every.join(refine.vector_centers(labelled), "k", "left")
