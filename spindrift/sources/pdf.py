"""Pages of PDF files: a folder scan, content hashes, and a pluggable page extractor."""

from __future__ import annotations

import contextlib
import signal
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.chunks import chunk_table, files_to_process
from spindrift.session import materialise

#: Maps a file's bytes to its page texts (None for a page without text).
Extractor = Callable[[bytes], list[str | None]]


#: Seconds for a file's decryption, and for all of its pages.
DECRYPT_SECONDS, FILE_SECONDS = 5.0, 300.0


@contextlib.contextmanager
def limited(seconds: float | None) -> Iterator[None]:
    """Raise TimeoutError in the body once the time is up; only a process's main thread can be stopped,
    which is where Spark's workers run."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TimeoutError(f"over {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    left = signal.setitimer(signal.ITIMER_REAL, seconds)[0]
    began = time.monotonic()
    try:
        yield
    finally:
        # an outer limit goes on
        signal.setitimer(signal.ITIMER_REAL, max(0.001, left - (time.monotonic() - began)) if left else 0)
        signal.signal(signal.SIGALRM, before)


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf", skip_unreadable: bool = False) -> DataFrame:
    """(pdf_name, pdf_path, file_hash, content) of the files in a folder, not below it.

    With ``skip_unreadable``, a file that can't be read has an empty hash and no content, instead of
    failing the scan; contents are then read twice.
    """

    def files(**options: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).options(**options).load(folder)

    # hashes need whole contents; the size limit of a binary value applies
    name = F.element_at(F.split("path", "/"), -1).alias("pdf_name")
    whole = lambda df: df.select(name, F.col("path").alias("pdf_path"), F.sha2("content", 256).alias("file_hash"), "content")
    if not skip_unreadable:
        return whole(files())
    lenient = files(ignoreCorruptFiles="true", ignoreMissingFiles="true")
    read = lenient.where(F.length("content") >= 0).select("path")
    lost = files().select("path").join(read, "path", "left_anti")
    return whole(lenient).unionByName(lost.select(name, F.col("path").alias("pdf_path"), F.lit("").alias("file_hash"), F.lit(None).cast("binary").alias("content")))


def pypdf_extractor(password: str = "") -> Callable[[], Extractor]:
    """Extraction by the pypdf library, where it is installed; encrypted files are tried with the
    empty password and given up otherwise."""

    def make() -> Extractor:
        import io

        import pypdf

        def extract(content: bytes) -> list[str | None]:
            reader = pypdf.PdfReader(io.BytesIO(content))
            if reader.is_encrypted:
                with limited(DECRYPT_SECONDS):
                    opened = reader.decrypt(password)
                if not opened:
                    raise ValueError("encrypted")
            return [page.extract_text() for page in reader.pages]

        return extract

    return make


def form_feed_extractor() -> Extractor:
    """For plain text in place of PDF: pages end at form feeds. Bytes that aren't UTF-8 fail."""
    return lambda content: list(content.decode("utf-8").split("\f"))


def pages(files: DataFrame, make: Callable[[], Extractor] = pypdf_extractor(), seconds: float | None = FILE_SECONDS, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages (pdf_name, pdf_path, file_hash, page_number, raw_text) and a scan log (pdf_name, error).

    Page numbers start at 1 and count all pages. A file that can't be read, or not in so many seconds,
    gives no pages at all. With ``store``, what was extracted is written, and both results read it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = make()
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["content"] is None:
                        raise OSError("unreadable")
                    with limited(seconds):
                        texts, error = extract(row["content"]), None
                except Exception as failure:  # any damaged file is logged and passed over
                    texts, error = [], str(failure)
                made = [{**{k: row[k] for k in ("pdf_name", "pdf_path", "file_hash")}, "page_number": i, "raw_text": t or "", "error": None} for i, t in enumerate(texts, 1)]
                made.append({**{k: row[k] for k in ("pdf_name", "pdf_path", "file_hash")}, "page_number": None, "raw_text": None, "error": error})
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    schema = pa.schema([("pdf_name", pa.string()), ("pdf_path", pa.string()), ("file_hash", pa.string()), ("page_number", pa.int32()), ("raw_text", pa.string()), ("error", pa.string())])
    out = files.mapInArrow(run, "pdf_name string, pdf_path string, file_hash string, page_number int, raw_text string, error string")
    if store:
        out = materialise(out, "pdf-pages")
    return out.where("page_number IS NOT NULL").drop("error"), out.where("page_number IS NULL").select("pdf_name", "error")


def new_chunks(files: DataFrame, state: DataFrame, version: str = "1.1", make: Callable[[], Extractor] = pypdf_extractor()) -> DataFrame:
    """Chunks of new and changed files; unchanged ones are dropped before extraction."""
    return chunk_table(pages(files_to_process(files, state, version), make)[0], version)
