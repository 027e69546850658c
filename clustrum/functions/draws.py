"""Deterministic draws: uniforms in (0, 1) from md5, and weighted draws as an exponential race.

The same expression gives the same draw in any engine with md5, however rows are partitioned. A weighted draw takes
the row of least -ln(u) / weight, which is one aggregate without a sort or a prefix sum.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts) -> Column:
    """md5 of the parts joined by `|`; strings and numbers are constants."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts) -> Column:
    return (F.conv(F.substring(key(*parts), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def uniform_value(*parts) -> float:
    """The same draw on the driver, for constants."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def race(weight: Column, *parts) -> Column:
    """Arrival time in an exponential race: null (never) where the weight is 0."""
    return -F.log(uniform(*parts)) / F.nullif(weight, F.lit(0.0))


PRIME = 2147483647


def row_hash(seed, row_id: Column) -> Column:
    """A row's own number below PRIME, from which any number of orders of the rows can be made without hashing again."""
    return F.pmod(F.conv(F.substring(key(seed, "row", row_id), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def order_of(h, *parts):
    """Where a row of hash h (a column or an array) stands in the order named by the parts: a * h + b modulo PRIME."""
    named = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    a, b = 1 + int(named[:8], 16) % (PRIME - 1), int(named[8:16], 16) % PRIME
    return (h * F.lit(a) + F.lit(b)) % F.lit(PRIME) if isinstance(h, Column) else (h * a + b) % PRIME
