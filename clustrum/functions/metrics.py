"""Distances between two vector columns, visible to Catalyst.

Dense vectors are ARRAY<DOUBLE>, sparse ones MAP<BIGINT, DOUBLE> where a missing key is 0. Each metric also has a NumPy
kernel over matrices, for Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column, finish=lambda s: s) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v, finish)


#: How the differences of two coordinates are turned into terms, and terms into a distance.
_TERM: dict[str, Callable[[Column, Column], Column]] = {
    "l0": lambda x, y: F.when(x != y, 1.0).otherwise(0.0),
    "l1": lambda x, y: F.abs(x - y),
    "l2": lambda x, y: (x - y) * (x - y),
    "li": lambda x, y: F.abs(x - y),
}


def _fold(name: str, terms: Column) -> Column:
    if name == "li":
        return F.coalesce(F.array_max(terms), F.lit(0.0))
    return _sum(terms, F.sqrt) if name == "l2" else _sum(terms)


@dataclass(frozen=True)
class Metric:
    """A metric by name: `dense(a, b)` and `sparse(a, b)` build columns, `kernel(x, c)` a matrix of distances."""

    name: str

    def __post_init__(self):
        if self.name not in _TERM:
            raise ValueError(f"no vector metric named {self.name!r}; there are {', '.join(sorted(_TERM))}")

    def dense(self, a: Column, b: Column) -> Column:
        return _fold(self.name, F.zip_with(a, b, _TERM[self.name]))

    def sparse(self, a: Column, b: Column) -> Column:
        zero = F.lit(0.0)
        return _fold(self.name, F.map_values(F.map_zip_with(a, b, lambda k, x, y: _TERM[self.name](F.coalesce(x, zero), F.coalesce(y, zero)))))

    def kernel(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of each row of x to each row of c, by plain differences, a center at a time."""
        out = np.empty((len(x), len(c)))
        for k, center in enumerate(c):
            apart = x - center
            if self.name == "l0":
                out[:, k] = (apart != 0).sum(1)
            elif self.name == "l1":
                out[:, k] = np.abs(apart).sum(1)
            elif self.name == "l2":
                out[:, k] = np.sqrt((apart * apart).sum(1))
            else:
                out[:, k] = np.abs(apart).max(1, initial=0.0)
        return out
