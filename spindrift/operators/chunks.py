"""Pages to chunks: cleaning, page policy, counters, and the incremental master table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.schema import CHUNK
from spindrift.session import bound, spread

#: Page length, garbled share and length from which a garbled page stays, alert share.
MIN_CHARS, GARBLED, KEEP_GARBLED, ALERT = 100, 0.40, 2000, 0.5


def judged_pages(pages: DataFrame, min_chars: int = MIN_CHARS, threshold: float = GARBLED) -> DataFrame:
    """Pages (pdf_name, page_number, raw_text, ...) with clean ``text`` and its ``verdict``:
    short, dropped_garbled, kept_garbled or kept. Length comes first, so short pages are never
    garbled ones. A page is cleaned once, whatever is asked of the result."""
    clean = bound(spread(pages).withColumn("text", X.sanitize(F.col("raw_text"))).withColumn("_bad", X.is_garbled(F.col("text"), threshold)))
    size, bad = F.length("text"), F.col("_bad")
    verdict = F.when(size < min_chars, "short").when(bad & (size <= KEEP_GARBLED), "dropped_garbled").when(bad, "kept_garbled").otherwise("kept")
    return clean.withColumn("verdict", verdict).drop("_bad")


def chunk_table(pages: DataFrame, version: str = "1.1", min_chars: int = MIN_CHARS, threshold: float = GARBLED) -> DataFrame:
    """The chunk of each page that stays; pages: pdf_name, file_hash, page_number, raw_text, pdf_path."""
    t = F.col("text")
    rows = judged_pages(pages, min_chars, threshold).where(F.col("verdict").startswith("kept"))
    made = {
        "id": X.chunk_id(F.col("pdf_name"), F.col("page_number")),
        "text": t,
        "pipeline_version": F.lit(version),
        "chunk_index": F.lit(0),
        "char_count": F.length(t),
        "word_count": X.word_count(t),
        "has_numbers": X.has_numbers(t),
        "has_formula": X.has_formula(t),
        "text_with_context": F.lit(None),
        "is_garbled": F.col("verdict") == "kept_garbled",
    }
    return rows.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNK.fields])


def page_stats(judged: DataFrame) -> DataFrame:
    """Page counters per document, for documents that have pages."""
    of = lambda verdict: F.count_if(F.col("verdict") == verdict).alias(verdict)
    kept = F.count_if(F.col("verdict").startswith("kept")).alias("kept")
    return judged.groupBy("pdf_name").agg(F.count(F.lit(1)).alias("total"), kept, of("dropped_garbled"), of("kept_garbled"), of("short"))


def high_garble(stats: DataFrame, share: float = ALERT) -> DataFrame:
    return stats.where(F.col("dropped_garbled") / F.col("total") > share)


def consistent_state(chunks: DataFrame) -> DataFrame:
    """(pdf_name, file_hash, pipeline_version) of documents all of whose chunks agree on both."""
    both = F.struct("file_hash", "pipeline_version")
    seen = chunks.groupBy("pdf_name").agg(F.min(both).alias("state"), F.max(both).alias("most"))
    return seen.where(F.col("state") == F.col("most")).select("pdf_name", "state.*")


def files_to_process(files: DataFrame, state: DataFrame, version: str = "1.1") -> DataFrame:
    """Files (pdf_name, file_hash) that are new or changed. A file without a hash is never skipped."""
    known = state.select("pdf_name", F.col("file_hash").alias("_hash"), F.col("pipeline_version").alias("_version"))
    same = (F.col("file_hash") != "") & (F.col("file_hash") == F.col("_hash")) & (F.col("_version") == version)
    return files.join(known, "pdf_name", "left").where(~F.coalesce(same, F.lit(False))).drop("_hash", "_version")


def sync_master(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old chunks of documents that gave new chunks are replaced by these; others stay."""
    return old.join(new.select("pdf_name").distinct(), "pdf_name", "left_anti").select(*old.columns).unionByName(new)


def prune_missing(master: DataFrame, files: DataFrame) -> DataFrame:
    """Optional: drop chunks of documents that are no longer there."""
    return master.join(files.select("pdf_name").distinct(), "pdf_name", "left_semi").select(*master.columns)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one that came last."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")


def ids_by_document(chunks: DataFrame) -> DataFrame:
    """(pdf_name, ids): sorted distinct chunk ids; empty names and ids are passed over."""
    return chunks.where("pdf_name <> '' AND id <> ''").groupBy("pdf_name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def first_hash_by_document(chunks: DataFrame, order: str = "ordinal") -> DataFrame:
    """(pdf_name, file_hash): the first hash that isn't empty, in input order."""
    return chunks.where("pdf_name <> '' AND file_hash <> ''").groupBy("pdf_name").agg(F.min_by("file_hash", order).alias("file_hash"))
