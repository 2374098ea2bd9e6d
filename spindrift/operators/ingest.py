"""Incremental upkeep of the vector collection, the graph store's batches and their manifests.

A collection has rows (id, document, metadata, embedding), a manifest rows (pdf_name, file_hash).
Each function returns the new state; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators.chunks import first_hash_by_document
from spindrift.session import materialise

#: Pages of a graph batch, rows of an upsert batch.
GRAPH_PAGES, UPSERT_ROWS = 20, 50


def delta(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks of documents that the manifest lacks or knows by another hash."""
    known = manifest.select("pdf_name", F.col("file_hash").alias("_hash"))
    return chunks.join(known, "pdf_name", "left").where(F.col("_hash").isNull() | (F.col("_hash") != F.col("file_hash"))).select(*chunks.columns)


def as_rows(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks as collection rows; the text is the enriched one where there is one."""
    meta = F.struct(F.col("pdf_name").cast("string").alias("source"), F.col("page_number").cast("int").alias("page"), F.col("is_garbled").cast("boolean").alias("is_garbled"))
    rows = chunks.select("id", X.effective_text(F.col("text_with_context"), F.col("text")).alias("document"), meta.alias("metadata"))
    return embed(rows) if embed else rows.withColumn("embedding", F.lit(None).cast("array<float>"))


def stale_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct ids of ``existing`` that aren't in ``new``."""
    return existing.select("id").subtract(new.select("id"))


def _by_source(collection: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of rows with ``_source`` names; rows without a source match none."""
    return collection.withColumn("_source", F.col("metadata.source")).join(names, "_source", how).select(*collection.columns)


def stale_rows(collection: DataFrame, new: DataFrame) -> DataFrame:
    """Collection rows of documents in ``new`` whose id is no longer among theirs."""
    updated = new.select(F.col("pdf_name").alias("_source")).distinct()
    old = _by_source(collection, updated, "left_semi")
    return old.join(new.select("id"), "id", "left_anti").select(*collection.columns)


def removed_documents(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    return manifest.select("pdf_name").distinct().join(chunks.select("pdf_name").distinct(), "pdf_name", "left_anti")


def delete_sources(collection: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select(F.col("pdf_name").alias("_source"))
    return _by_source(collection, gone, "left_anti")


def delete_ids(collection: DataFrame, ids: DataFrame) -> DataFrame:
    return collection.join(ids.select("id"), "id", "left_anti").select(*collection.columns)


def upsert(collection: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or replace by id."""
    return delete_ids(collection, rows).unionByName(rows)


def orphans(collection: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows whose source isn't valid; a row without a source is an orphan."""
    good = valid.select(F.col("source").alias("_source")).distinct()
    return _by_source(collection, good, "left_anti")


def purge(collection: DataFrame, valid: DataFrame) -> DataFrame:
    """The collection without orphans."""
    good = valid.select(F.col("source").alias("_source")).distinct()
    return _by_source(collection, good, "left_semi")


def manifest_upsert(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    return manifest.join(updates.select("pdf_name"), "pdf_name", "left_anti").select(*manifest.columns).unionByName(updates.select(*manifest.columns))


def manifest_remove(manifest: DataFrame, names: DataFrame) -> DataFrame:
    return manifest.join(names.select("pdf_name"), "pdf_name", "left_anti").select(*manifest.columns)


def removed_count(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """One row ``removed``: how many entries a removal takes out; repeated names count once."""
    return manifest.join(names.select("pdf_name"), "pdf_name", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def upsert_batches(rows: DataFrame, order: str = "ordinal", size: int = UPSERT_ROWS) -> DataFrame:
    """Adds ``batch_no`` from a 0-based ordinal; batches matter for failures only."""
    return rows.withColumn("batch_no", F.floor(F.col(order) / size).cast("long"))


def write_batches(rows: DataFrame, make: Callable[[], Callable[[list[dict]], None]], size: int = UPSERT_ROWS) -> DataFrame:
    """Hand rows to an outside store in batches of ``size``; (pdf_name, error) of what failed.

    ``make`` opens the store once per task; the function that it returns upserts a batch of rows (id,
    document, metadata, embedding). A batch that raises ValueError, RuntimeError or OSError fails all
    documents in it, the others go on; any other exception ends the job. The result is written at
    once, and no batch is sent again when it is read. A task that is lost is run again, so the store
    has to bear repeated upserts of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upsert_rows, held = make(), []

        def send(batch: list[dict]) -> pa.RecordBatch:
            try:
                upsert_rows(batch)
                failed = {}
            except (ValueError, RuntimeError, OSError) as failure:
                failed = {r["metadata"]["source"]: str(failure) for r in batch}
            return pa.RecordBatch.from_arrays([pa.array(failed.keys(), pa.string()), pa.array(failed.values(), pa.string())], ["pdf_name", "error"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == size:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    failures = rows.select("id", "document", "metadata", "embedding").mapInArrow(run, "pdf_name string, error string")
    return materialise(failures, "upsert-failures").groupBy("pdf_name").agg(F.min("error").alias("error"))


def failed_documents(batched: DataFrame, failed_batches: DataFrame) -> DataFrame:
    """Documents with a row in any failed batch."""
    return batched.join(failed_batches.select("batch_no"), "batch_no", "left_semi").select("pdf_name").distinct()


def committed(manifest: DataFrame, delta_chunks: DataFrame, failed: DataFrame, removed: DataFrame, order: str = "ordinal") -> DataFrame:
    """The manifest after an ingest: removed documents go; updated ones that didn't fail get their
    first hash, unless it is empty."""
    done = first_hash_by_document(delta_chunks, order).join(failed.select("pdf_name"), "pdf_name", "left_anti")
    return manifest_upsert(manifest_remove(manifest, removed), done)


def ingest(
    chunks: DataFrame,
    collection: DataFrame,
    manifest: DataFrame,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    failed: DataFrame | None = None,
    strict: bool = False,
    write: Callable[[], Callable[[list[dict]], None]] | None = None,
    report: Callable[..., None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New collection and manifest. ``failed(pdf_name)``: documents whose upsert failed; with ``write``,
    rows go to an outside store by :func:`write_batches`, which finds that out. ``report`` is called
    with the name of each step and what it counted.

    All ids of an updated document count as new, so that one with mixed hashes loses no valid
    chunk. With ``strict``, an empty delta leaves everything as it is, removed documents included.
    """
    changed = delta(chunks, manifest)
    if strict and changed.isEmpty():
        return collection, manifest
    names = changed.select("pdf_name").distinct()
    fresh = chunks.join(names, "pdf_name", "left_semi")
    gone = removed_documents(manifest, chunks)
    if write is not None:
        broken = write_batches(as_rows(changed, embed), write)
        failed = broken.select("pdf_name") if failed is None else failed.select("pdf_name").unionByName(broken.select("pdf_name")).distinct()
    failed = failed if failed is not None else names.limit(0)
    if report is not None:
        report("ingest", changed=names.count(), removed=gone.count(), failed=failed.count())
    rows = as_rows(changed.join(failed, "pdf_name", "left_anti"), embed)
    kept = delete_sources(delete_ids(collection, stale_rows(collection, fresh)), gone)
    return upsert(kept, rows), committed(manifest, changed, failed, gone, "page_number")


def graph_batches(chunks: DataFrame, manifest: DataFrame, pages: int = GRAPH_PAGES, order: str = "ordinal") -> DataFrame:
    """(pdf_name, batch_no, batch_text, file_hash): plain page texts of documents whose first hash
    isn't the manifest's, ``pages`` at a time in page order."""
    first = chunks.groupBy("pdf_name").agg(F.min_by("file_hash", order).alias("_first"))
    known = manifest.select("pdf_name", F.col("file_hash").alias("_hash"))
    todo = first.join(known, "pdf_name", "left").where(F.col("_hash").isNull() | (F.col("_hash") != F.col("_first"))).select("pdf_name")
    rows = chunks.join(todo, "pdf_name", "left_semi")
    number = F.row_number().over(Window.partitionBy("pdf_name").orderBy("page_number", "id"))
    batched = rows.withColumn("batch_no", F.floor((number - 1) / pages).cast("long"))
    listed = F.array_sort(F.collect_list(F.struct("page_number", "id", "text", "file_hash")))
    return batched.groupBy("pdf_name", "batch_no").agg(listed.alias("p")).select(
        "pdf_name", "batch_no", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("batch_text"), F.get("p", F.lit(0))["file_hash"].alias("file_hash")
    )
