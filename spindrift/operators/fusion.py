"""Top-k selection and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators.lexical import ranked


def top_k(rows: DataFrame, k: int, value: str = "value", order: str = "ordinal") -> DataFrame:
    """The k rows with the largest value, first come first on ties; none for k <= 0. NaN is largest."""
    return rows.orderBy(F.desc(value), F.asc(order)).limit(max(k, 0))


def rrf(*lists: DataFrame, k: int = 60, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank_0, rank_1, ...) of ranked lists (query_id, id, rank).

    Scores add up over lists and over repeats within a list; ``rank_i`` is the best rank in list i.
    """
    tagged = [one.select("query_id", "id", F.lit(i).alias("_list"), F.col("rank").alias("_rank")) for i, one in enumerate(lists)]
    rows = tagged[0]
    for one in tagged[1:]:
        rows = rows.unionByName(one)
    best = [F.min(F.when(F.col("_list") == i, F.col("_rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(X.rrf_term(F.col("_rank"), k)), digits).alias("score"), *best)


def fused_candidates(fused: DataFrame, k: int = 20) -> DataFrame:
    """The first k per query: by score, ties by the first list's rank, then by the second's."""
    ranks = sorted(c for c in fused.columns if c.startswith("rank_"))
    return ranked(fused, k, F.desc("score"), *[F.asc_nulls_last(c) for c in ranks], F.col("id"))
