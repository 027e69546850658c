"""Energies: non-decreasing functions of a distance with E(0) = 0."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("identity", "quadratic", "cubic", "log", "sqrt", "exp", "squarepotential")


@dataclass(frozen=True)
class Energy:
    """An energy by name. `exp` needs exponent_coeff > 0, `squarepotential` critical_radius > 0, and no other takes them."""

    name: str = "quadratic"
    critical_radius: float = 0.0
    exponent_coeff: float = 0.0

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"no energy named {self.name!r}; there are {', '.join(NAMES)}")
        if (self.name == "squarepotential") != (self.critical_radius > 0):
            raise ValueError("critical_radius > 0 goes with the energy squarepotential, and only with it")
        if (self.name == "exp") != (self.exponent_coeff > 0):
            raise ValueError("exponent_coeff > 0 goes with the energy exp, and only with it")

    def column(self, d: Column) -> Column:
        by_name: dict[str, Callable[[], Column]] = {
            "identity": lambda: d,
            "quadratic": lambda: d * d,
            "cubic": lambda: d * d * d,
            "log": lambda: F.log1p(d),
            "sqrt": lambda: F.sqrt(d),
            "exp": lambda: F.exp(d * self.exponent_coeff) - 1,
            "squarepotential": lambda: (d > self.critical_radius).cast("double"),
        }
        return by_name[self.name]()

    def values(self, d: np.ndarray) -> np.ndarray:
        by_name = {
            "identity": lambda: d,
            "quadratic": lambda: d * d,
            "cubic": lambda: d**3,
            "log": lambda: np.log1p(d),
            "sqrt": lambda: np.sqrt(d),
            "exp": lambda: np.exp(d * self.exponent_coeff) - 1,
            "squarepotential": lambda: (d > self.critical_radius).astype(float),
        }
        return by_name[self.name]()
