"""Pattern audit: which texts have one of each required group and none of the forbidden strings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in patterns], F.lit(False))


def audit(rows: DataFrame, required: Sequence[Sequence[str]], forbidden: Sequence[str], text: str = "text") -> DataFrame:
    """Adds ``missing_groups``, ``forbidden_found`` and ``passed``; patterns are plain substrings."""
    t = F.coalesce(F.col(text), F.lit(""))
    missing = reduce(lambda a, b: a + b, [F.when(_any(t, group), 0).otherwise(1) for group in required], F.lit(0))
    found = reduce(lambda a, b: a + b, [F.when(F.contains(t, F.lit(p)), 1).otherwise(0) for p in forbidden], F.lit(0))
    return rows.withColumn("missing_groups", missing).withColumn("forbidden_found", found).withColumn("passed", (F.col("missing_groups") == 0) & (F.col("forbidden_found") == 0))
