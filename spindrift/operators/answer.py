"""From candidates to answers: fetch, rerank, contexts, prompt, generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators.dense import dense_topk
from spindrift.operators.fusion import fused_candidates, rrf
from spindrift.operators.joins import SMALL_ROWS, small_side
from spindrift.operators.lexical import Bm25Index, bm25_topk, ranked
from spindrift.operators.models import throttled

#: List lengths and the fusion constant.
TOP_K, RRF_K, CANDIDATES, FINAL_K, CONTEXT_CHARS = 50, 60, 20, 5, 2000


def fetch(candidates: DataFrame, collection: DataFrame, queries: DataFrame | None = None, k: int = CANDIDATES) -> DataFrame:
    """Candidates with their ``document``; ids without one are dropped. ``queries``, of at most ``k`` candidates
    each, tell that the candidates are few: then they go to the documents, which stay where they are."""
    if queries is not None:
        candidates = small_side(candidates, SMALL_ROWS // max(1, k), bound=queries)
    return candidates.join(collection.select("id", "document"), "id")


def overlap_score(rows: DataFrame) -> DataFrame:
    """The offline reranker: the share of the query's distinct tokens that the document has."""
    q = F.array_distinct(X.tokens(F.col("query")))
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, X.tokens(F.col("document")))) / F.size(q))
    return rows.withColumn("rerank_score", F.round(share, 9))


def model_score(make: Callable[[], Callable[[list[tuple[str, str]], int], list[float]]], batch_size: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A reranker from a model: ``make`` loads it once per worker; it scores (query, document) pairs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make()
        for queries, documents in batches:
            yield pd.Series([float(x) for x in predict(list(zip(queries, documents)), batch_size)], dtype="float64")

    return lambda rows: rows.withColumn("rerank_score", run.asNondeterministic()("query", "document"))


def rerank(fetched: DataFrame, queries: DataFrame, k: int = FINAL_K, score: Callable[[DataFrame], DataFrame] = overlap_score) -> DataFrame:
    """The k best documents per query by the reranker; ties keep the candidates' order."""
    scored = score(fetched.withColumnRenamed("rank", "candidate_rank").join(queries.select("query_id", "query"), "query_id"))
    return ranked(scored, k, F.desc("rerank_score"), F.col("candidate_rank"))


def contexts(reranked: DataFrame) -> DataFrame:
    """(query_id, contexts): whole documents in rank order. A query has few of them."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "document")))
    return reranked.groupBy("query_id").agg(F.transform(listed, lambda x: x["document"]).alias("contexts"))


def template_answer(rows: DataFrame) -> DataFrame:
    """The offline generator: the start of the first context."""
    first = F.coalesce(F.get("contexts", F.lit(0)), F.lit(""))
    return rows.withColumn("answer", F.concat(F.lit("Based on "), F.size("contexts").cast("string"), F.lit(" contexts: "), F.substring(first, 1, 80)))


def model_answer(make: Callable[[], Callable[[str], str]], seconds: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """A generator from a model: ``make`` loads a client once per worker, which calls it at most once in
    so many seconds; failures become the answer."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(call: Callable[[str], str], prompt: str) -> str:
            try:
                return call(prompt)
            except Exception as failure:  # contexts are returned whatever the model does
                return f"Gen Error: {failure}"

        call = throttled(make(), seconds)
        for prompts in batches:
            yield pd.Series([one(call, p) for p in prompts], dtype="object")

    return lambda rows: rows.withColumn("answer", run.asNondeterministic()("prompt"))


def retrieve(queries: DataFrame, collection: DataFrame, index: Bm25Index | None, top_k: int = TOP_K, rrf_k: int = RRF_K, candidates: int = CANDIDATES) -> DataFrame:
    """Fused candidates of queries (query_id, query, vector). Without an index, by vectors alone."""
    lists = [dense_topk(queries, collection, top_k)]
    if index is not None:
        lists.append(bm25_topk(index, queries, top_k))
    return fused_candidates(rrf(*lists, k=rrf_k), candidates)


def answer(
    queries: DataFrame,
    collection: DataFrame,
    index: Bm25Index | None,
    top_k: int = TOP_K,
    rrf_k: int = RRF_K,
    candidates: int = CANDIDATES,
    final_k: int = FINAL_K,
    context_chars: int = CONTEXT_CHARS,
    score: Callable[[DataFrame], DataFrame] = overlap_score,
    generate: Callable[[DataFrame], DataFrame] = template_answer,
) -> DataFrame:
    """(query_id, query, contexts, prompt, answer) of a batch of queries (query_id, query, vector).

    Blank queries are answered "Empty Query" without contexts and take no part in retrieval. A
    column ``global_context`` goes into the prompt. Contexts are whole, those of the prompt are cut.
    """
    asked = queries.where(~X.is_blank(F.col("query")))
    found = contexts(rerank(fetch(retrieve(asked, collection, index, top_k, rrf_k, candidates), collection, asked, candidates), asked, final_k, score))
    rows = asked.join(found, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    shared = F.col("global_context") if "global_context" in queries.columns else None
    done = generate(rows.withColumn("prompt", X.answer_prompt(F.col("query"), F.col("contexts"), shared, context_chars)))
    blank = queries.where(X.is_blank(F.col("query"))).select(
        "query_id", "query", F.array().cast("array<string>").alias("contexts"), F.lit(None).cast("string").alias("prompt"), F.lit("Empty Query").alias("answer")
    )
    return done.select("query_id", "query", "contexts", "prompt", "answer").unionByName(blank)
