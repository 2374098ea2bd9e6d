"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, most: int = SMALL_ROWS, bound: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; otherwise as it is, so that
    Spark shuffles both sides. ``bound`` has at least as many rows and is cheaper to count."""
    return F.broadcast(df) if (df if bound is None else bound).limit(most + 1).count() <= most else df
