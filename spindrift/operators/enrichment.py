"""Cached enrichment: prune the cache, find what it lacks, apply a generator, merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators.models import throttled
from spindrift.sources.store import SnapshotStore


def prune(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cache rows whose chunk still exists."""
    return cache.join(chunks.select("id"), "id", "left_semi")


def missing(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks without a cache row of the same hash and version."""
    hit = cache.select("id", "file_hash", "pipeline_version")
    return chunks.join(hit, ["id", "file_hash", "pipeline_version"], "left_anti").select(*chunks.columns)


def apply_context(chunks: DataFrame, context: str = "context", error: str = "error") -> DataFrame:
    """Fill ``text_with_context``; where the generator failed, with the plain text. The error stays
    as a column, so that a later run may try again."""
    filled = F.when(F.col(error).isNull(), X.wrap_context(F.col(context), F.col("text"))).otherwise(F.coalesce("text", F.lit("")))
    return chunks.withColumn("text_with_context", filled).drop(context)


def merge(pruned: DataFrame, done: DataFrame) -> DataFrame:
    return pruned.join(done.select("id"), "id", "left_anti").select(*pruned.columns).unionByName(done, allowMissingColumns=True)


def rule_context(chunks: DataFrame) -> DataFrame:
    """The offline default: a context from name and page."""
    made = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(" of "), F.col("pdf_name"))
    return chunks.withColumn("context", made).withColumn("error", F.lit(None).cast("string"))


def generated_context(chunks: DataFrame, make: Callable[[], Callable[[str], str]], retries: int = 0, seconds: float = 0.0) -> DataFrame:
    """Contexts from a model: ``make`` loads it once per worker; it maps a prompt to a context, at most
    once in so many seconds in each worker.

    A failure becomes an error text. Materialise the result: the call isn't free.
    """

    @F.pandas_udf("struct<context:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = throttled(make(), seconds)

        def one(prompt: str) -> tuple[str | None, str | None]:
            for attempt in range(retries + 1):
                try:
                    return call(prompt), None
                except Exception as failure:  # any failure of the model falls back to the text
                    if attempt == retries:
                        return None, str(failure)
            return None, None

        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=["context", "error"])

    made = run.asNondeterministic()(X.enrichment_prompt(F.col("pdf_name"), F.col("page_number"), F.col("text")))
    return chunks.withColumn("_made", made).select("*", "_made.*").drop("_made")


def enrich_stepwise(
    chunks: DataFrame,
    store: SnapshotStore,
    generate: Callable[[DataFrame], DataFrame] = rule_context,
    step_rows: int = 10_000,
    persist: Callable[[DataFrame, int], None] | None = None,
    table: str = "enriched",
) -> DataFrame:
    """The cache, kept in a store's table and filled in steps of about ``step_rows`` chunks.

    Each step is written to the store before the next begins, so that a run that breaks off loses one
    step at most, and the next run goes on from there. ``persist`` is called with the rows of each
    step that was written and its number. The store's key of the table is ``id``. Rows of chunks that
    are gone are pruned first, and written only if there were any.
    """
    with store.lock():
        cache = store.read(table)
        if not cache.join(chunks.select("id"), "id", "left_anti").isEmpty():
            store.commit(**{table: prune(cache, chunks)})
        todo = missing(chunks, store.read(table))
        steps = -(-todo.count() // step_rows)
        for step in range(steps):
            # the cache grows below: rows of later steps stay missing, whatever was written before
            rows = todo.where(F.pmod(F.xxhash64("id"), F.lit(steps)) == step)
            if store.append(table, apply_context(generate(rows))) and persist:
                persist(store.last_part(table), step)
        return store.read(table)


def enrich(chunks: DataFrame, cache: DataFrame, generate: Callable[[DataFrame], DataFrame] = rule_context) -> DataFrame:
    """The new cache: pruned rows, with rows made for all chunks that it lacked."""
    pruned = prune(cache, chunks)
    return merge(pruned, apply_context(generate(missing(chunks, pruned))))
