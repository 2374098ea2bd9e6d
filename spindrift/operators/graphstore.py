"""Feeding a graph store: batches of a document in order, stop at its first failure, commit the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ingest import graph_batches, manifest_upsert
from spindrift.session import materialise

STATUS = "pdf_name string, batch_no long, ok boolean, error string"


def insert(batches: DataFrame, make: Callable[[], Callable[[str, int, str], None]]) -> DataFrame:
    """Status rows (pdf_name, batch_no, ok, error) of the batches that were tried.

    ``make`` opens the sink once per task; it takes name, batch number and text. Materialise the
    result: each evaluation inserts again.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, stopped = make(), None
        for batch in rows:
            out = []
            for name, number, text in zip(*[batch.column(c).to_pylist() for c in ("pdf_name", "batch_no", "batch_text")]):
                if name == stopped:
                    continue
                try:
                    sink(name, number, text)
                    out.append((name, number, True, None))
                except Exception as failure:  # whatever the store raises ends this document, not the others
                    stopped = name
                    out.append((name, number, False, str(failure)))
            columns = zip(*out) if out else ([], [], [], [])
            types = (pa.string(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["pdf_name", "batch_no", "ok", "error"])

    dealt = batches.select("pdf_name", "batch_no", "batch_text").repartition("pdf_name").sortWithinPartitions("pdf_name", "batch_no")
    return dealt.mapInArrow(run, STATUS)


def commit(manifest: DataFrame, batches: DataFrame, status: DataFrame) -> DataFrame:
    """The manifest with the hash of each document whose batches all succeeded."""
    good = status.groupBy("pdf_name").agg(F.bool_and("ok").alias("ok")).where("ok").select("pdf_name")
    first = batches.groupBy("pdf_name").agg(F.min_by("file_hash", "batch_no").alias("file_hash")).where("file_hash <> ''")
    return manifest_upsert(manifest, first.join(good, "pdf_name", "left_semi"))


def populate(chunks: DataFrame, manifest: DataFrame, make: Callable[[], Callable[[str, int, str], None]], reset: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status, new manifest) of feeding new and changed documents; ``reset`` feeds all of them."""
    known = manifest.limit(0) if reset else manifest
    batches = graph_batches(chunks, known)
    status = materialise(insert(batches, make), "graph-status")
    return status, commit(known, batches, status)
