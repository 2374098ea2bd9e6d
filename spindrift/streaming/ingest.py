"""Incremental ingest as a stream: new files arrive, each micro-batch ends in one snapshot commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.chunks import chunk_table, consistent_state, files_to_process
from spindrift.sources.pdf import Extractor, pages, pypdf_extractor
from spindrift.sources.store import SnapshotStore


def file_stream(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """A stream of (pdf_name, pdf_path, file_hash, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("pdf_name"), F.col("path").alias("pdf_path"), F.sha2("content", 256).alias("file_hash"), "content")


def sync_stream(files: DataFrame, store: SnapshotStore, checkpoint: str, version: str = "1.1", make: Callable[[], Extractor] = pypdf_extractor()) -> StreamingQuery:
    """Start a query that keeps the store's table ``chunks`` in step with the files.

    Each batch adds a part with the chunks of its documents; older versions of these are passed over and
    rewritten now and then, so a batch costs what is new in it. A batch that is run again finds its
    files unchanged and leaves the table as it is. The store's key of ``chunks`` is ``pdf_name``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        with store.lock():
            todo = files_to_process(batch, consistent_state(store.read("chunks")), version)
            if store.append("chunks", chunk_table(pages(todo, make)[0], version)):
                store.vacuum()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windowed counts and sums per event type with a watermark, for streams and tables alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
