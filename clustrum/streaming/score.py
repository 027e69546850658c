"""Extension beyond batch clustering: label a stream of vectors by fixed centers.

The assignment is row-local and keeps no state, so the batch operator runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.assign import nearest2_dense


def score(stream: DataFrame, centers: DataFrame, metric: str = "l2") -> DataFrame:
    """(id, k, d) of each (id, x) that arrives; centers is a static (k, x)."""
    return nearest2_dense(stream, centers, metric).selectExpr("id", "a1 AS k", "d1 AS d")
