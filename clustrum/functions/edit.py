"""Edit distances between sequences: strings (by code point) or integer arrays.

Unit costs use Spark's own levenshtein for strings. Other costs run the recurrence in NumPy over Arrow batches
(`batched`, `bounded`); `distance` is the same as an expression of nested aggregates, for use inside array functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(cost: Column, message: Column) -> Column:
    """A cost that a table must hold: a symbol without one is an error, not a null that a minimum would skip."""
    return F.coalesce(cost, F.raise_error(message).cast("double"))


@dataclass(frozen=True)
class Costs:
    """Costs of inserting or deleting a symbol, and of switching two: constants, or tables by symbol."""

    indel: float | dict = 1.0
    switch: float | dict = 1.0
    default: float = field(default=0.0, compare=False)

    def __post_init__(self):
        if isinstance(self.indel, dict) != isinstance(self.switch, dict):
            raise ValueError("indel and switch costs are both constants or both tables")
        if not isinstance(self.indel, dict) and (self.indel <= 0 or self.switch <= 0):
            raise ValueError("constant costs must be positive")

    @property
    def largest_indel(self) -> float:
        return max(self.indel.values()) if isinstance(self.indel, dict) else self.indel

    @property
    def unit(self) -> bool:
        return self.indel == 1.0 and self.switch == 1.0

    def indel_column(self, symbol: Column) -> Column:
        if not isinstance(self.indel, dict):
            return F.lit(float(self.indel))
        cost = F.element_at(F.create_map(*[F.lit(x) for kv in self.indel.items() for x in (kv[0], float(kv[1]))]), symbol)
        return _present(cost, F.concat(F.lit("no indel cost of "), symbol.cast("string")))

    def switch_column(self, a: Column, b: Column) -> Column:
        if not isinstance(self.switch, dict):
            return F.when(a == b, 0.0).otherwise(float(self.switch))
        table = F.create_map(*[F.lit(x) for (p, q), v in self.switch.items() for x in (f"{p}|{q}", float(v))])
        pair = F.concat_ws("|", a.cast("string"), b.cast("string"))
        return F.when(a == b, 0.0).otherwise(_present(F.element_at(table, pair), F.concat(F.lit("no switch cost of "), pair)))


def costs_of(indel, switch) -> Costs:
    """Costs from two numbers, or from an array of indel costs and a square array (or its rows in one) of switch costs by
    integer symbols 0, 1, ..."""
    plain = [isinstance(c, (int, float, np.number)) and not isinstance(c, bool) for c in (indel, switch)]
    if all(plain):
        return Costs(float(indel), float(switch))
    if any(plain) or any(isinstance(c, (str, dict)) for c in (indel, switch)):
        raise ValueError("indel and switch costs are two numbers or two arrays")
    i, s = np.asarray(indel, float), np.asarray(switch, float)
    if i.ndim != 1 or not len(i):
        raise ValueError("indel costs are an array of one dimension that is not empty")
    if s.size != len(i) ** 2:
        raise ValueError(f"{len(i)} indel costs need {len(i)} x {len(i)} switch costs, {s.size} were given")
    s = s.reshape(len(i), len(i))
    if not (i > 0).all():
        raise ValueError(f"indel costs must be positive, that of {int(np.flatnonzero(~(i > 0))[0])} is not")
    return Costs({a: float(v) for a, v in enumerate(i)}, {(a, b): float(s[a, b]) for a in range(len(i)) for b in range(len(i)) if a != b})


def without_cost(sequences: DataFrame, costs: Costs) -> list:
    """Symbols of (x: strings or arrays) that the tables have no indel cost of, some of them, in order."""
    if not isinstance(costs.indel, dict):
        return []
    x = symbols(F.col("x")) if dict(sequences.dtypes)["x"] == "string" else F.col("x")
    used = sequences.select(F.explode(F.array_distinct(x)).alias("s")).distinct().where(F.col("s").isNotNull())
    known = list(costs.indel)
    return [r["s"] for r in used.where(~F.col("s").isin(known)).orderBy("s").limit(5).collect()]


def symbols(s: Column) -> Column:
    """A string as the array of its characters."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def distance(a: Column, b: Column, costs: Costs = Costs(), normalised: bool = False, strings: bool = True) -> Column:
    """Cost of the cheapest edit of `a` into `b`; normalised: 2 D / (w (|a| + |b|) + D) with w the largest indel cost."""
    n = (F.length(a) + F.length(b)) if strings else (F.size(a) + F.size(b))
    if costs.unit and strings:
        d = F.levenshtein(a, b).cast("double")
    else:
        d = _recurrence(symbols(a) if strings else a, symbols(b) if strings else b, costs)
    return 2 * d / F.nullif(costs.largest_indel * n + d, F.lit(0.0)) if normalised else d


def _recurrence(x: Column, y: Column, costs: Costs) -> Column:
    def last(row):
        return F.element_at(row, -1)

    first = F.aggregate(y, F.array(F.lit(0.0)), lambda row, q: F.concat(row, F.array(last(row) + costs.indel_column(q))))

    def next_row(above, p):
        at = F.sequence(F.lit(1), F.size(above) - 1)
        start = F.array(F.element_at(above, 1) + costs.indel_column(p))

        def cell(row, j):
            q = F.element_at(y, j)
            return F.concat(row, F.array(F.least(
                F.element_at(above, j) + costs.switch_column(p, q),
                F.element_at(above, j + 1) + costs.indel_column(p),
                last(row) + costs.indel_column(q),
            )))

        return F.when(F.size(above) > 1, F.aggregate(at, start, cell)).otherwise(start)

    return F.aggregate(x, first, next_row, last)


def kernel(a, b, costs: Costs = Costs()) -> float:
    """The same distance for two Python sequences."""
    of = (lambda s: costs.indel[s]) if isinstance(costs.indel, dict) else (lambda s: costs.indel)
    switch = (lambda p, q: 0.0 if p == q else costs.switch[p, q]) if isinstance(costs.switch, dict) else (lambda p, q: 0.0 if p == q else costs.switch)
    insert = np.array([of(q) for q in b], float)
    prefix = np.concatenate([[0.0], np.cumsum(insert)])
    row = prefix.copy()
    for p in a:
        up = row + of(p)
        if len(b):
            up[1:] = np.minimum(up[1:], row[:-1] + np.array([switch(p, q) for q in b]))
        # inserting along the row: running minimum of the value less what insertions up to there cost
        row = np.minimum.accumulate(up - prefix) + prefix
    return float(row[-1])


def bounded(a, b, limit: float, costs: Costs = Costs()) -> float | None:
    """The same distance if it is at most `limit`, else None. Cells farther from the diagonal than the limit allows
    are left out, and a row whose least value exceeds the limit ends the search."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)  # costs are symmetric
    tables = isinstance(costs.indel, dict)
    insert = np.array([costs.indel[q] for q in b] if tables else [costs.indel] * len(b), float)
    least = min([*insert, *([costs.indel[p] for p in a] if tables else [costs.indel])], default=1.0)
    if (len(b) - len(a)) * least > limit:
        return None
    band = len(b) if np.isinf(limit) else min(len(b), int(limit / least))
    prefix = np.concatenate([[0.0], np.cumsum(insert)])
    row = np.where(np.arange(len(b) + 1) <= band, prefix, np.inf)
    for i, p in enumerate(a, 1):
        low, high = max(0, i - band), min(len(b), i + band)
        up = row[low : high + 1] + (costs.indel[p] if tables else costs.indel)
        start = max(low, 1)
        if start <= high:
            switch = [0.0 if p == q else (costs.switch[p, q] if tables else costs.switch) for q in b[start - 1 : high]]
            up[start - low :] = np.minimum(up[start - low :], row[start - 1 : high] + np.array(switch))
        part = prefix[low : high + 1]
        row = np.full(len(b) + 1, np.inf)
        row[low : high + 1] = np.minimum.accumulate(up - part) + part
        if row.min() > limit:
            return None
    return float(row[-1]) if row[-1] <= limit else None


def within(costs: Costs = Costs(), limit: float = float("inf")):
    """A function of two string columns, in Arrow batches: their distance if it is at most `limit`, else null; null if
    a string is null."""

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else bounded(p, q, limit, costs) for p, q in zip(a, b)], dtype="float64")

    return near


def between(a, b, limit: float, costs: Costs, normalised: bool = False) -> float | None:
    """The distance, or the normalised one, of two sequences if it is at most `limit`, else None. The limit has slack for
    rounding, so a distance equal to it is found."""
    if not normalised:
        return bounded(a, b, limit * (1 + 1e-9), costs)
    whole = costs.largest_indel * (len(a) + len(b))
    if whole == 0:
        return None
    d = bounded(a, b, limit * whole / (2 - limit) * (1 + 1e-9) if limit < 1 else float("inf"), costs)
    return None if d is None else 2 * d / (whole + d)


def batched(costs: Costs = Costs(), normalised: bool = False):
    """`distance` as a function of two columns, in Arrow batches; null if a sequence is null. A symbol without a cost is
    an error."""

    @F.pandas_udf("double")
    def d(a: pd.Series, b: pd.Series) -> pd.Series:
        try:
            return pd.Series([None if p is None or q is None else between(p, q, float("inf"), costs, normalised) for p, q in zip(a, b)], dtype="float64")
        except KeyError as e:
            raise ValueError(f"no cost of {e}") from e

    return d


def violations(indel: DataFrame, switch: DataFrame, normalised: bool = False) -> DataFrame:
    """(rule, a, b, c): breaches of what makes the costs a metric; empty if they do.

    indel: (a, cost); switch: (a, b, cost), symmetric pairs both listed. Rules: positive and symmetric costs, the
    triangle inequality, a switch no dearer than two indels, an indel no dearer than a switch and an indel, and for
    the normalised distance equal indels.
    """
    none = F.lit(None).cast("string")
    text = [c.cast("string") for c in (F.col("a"), F.col("b"))]
    x, y, z = switch.alias("x"), switch.alias("y"), switch.alias("z")
    i, j = indel.alias("i"), indel.alias("j")
    found = [
        switch.where("cost < 0").select(F.lit("negative switch").alias("rule"), *text, none.alias("c")),
        indel.where("cost <= 0").select(F.lit("indel not positive"), F.col("a").cast("string"), none, none),
        x.join(y, (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.cost <> y.cost").select(F.lit("asymmetric"), F.col("x.a").cast("string"), F.col("x.b").cast("string"), none),
        x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("z.a") == F.col("x.a")) & (F.col("z.b") == F.col("y.b")))
        .where("x.cost + y.cost < z.cost").select(F.lit("triangle"), F.col("x.a").cast("string"), F.col("x.b").cast("string"), F.col("y.b").cast("string")),
        x.join(i, F.col("x.a") == F.col("i.a")).join(j, F.col("x.b") == F.col("j.a")).where("x.cost > i.cost + j.cost")
        .select(F.lit("switch above two indels"), F.col("x.a").cast("string"), F.col("x.b").cast("string"), none),
        x.join(i, F.col("x.a") == F.col("i.a")).join(j, F.col("x.b") == F.col("j.a")).where("j.cost > i.cost + x.cost")
        .select(F.lit("indel above switch and indel"), F.col("x.a").cast("string"), F.col("x.b").cast("string"), none),
    ]
    if normalised:
        least = indel.agg(F.min("cost").alias("least"))
        found.append(indel.crossJoin(F.broadcast(least)).where("cost <> least").select(F.lit("unequal indels"), F.col("a").cast("string"), none, none))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
