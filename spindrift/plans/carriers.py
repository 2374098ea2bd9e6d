"""Carrier tables: the engine's inputs, derived from the driver's tables in Spark and in SQL alike.

A document is one page; a book is a run of 1000 document ids of one source. Some pages get marks,
white space and private-use characters around their text, so that cleaning has work to do. Books
with a page whose id is a multiple of 97 have mixed hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.session import table

_BEFORE = f"{chr(0xA0)} \t{chr(0x200B)}{chr(0xFFFD)}"
_AFTER = f"{chr(0xAD)} \r\n\n{chr(0x3000)}{chr(7)} \t"
_JUNK = chr(0xE000)

#: White space in RE2, which knows no Unicode class for it.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

PAGES_SQL = f"""
pages AS (
  SELECT doc_id AS ordinal, source || '-' || (doc_id // 1000)::VARCHAR || '.pdf' AS pdf_name, (doc_id % 1000 + 1)::INT AS page_number,
         CASE WHEN doc_id % 4 = 0 THEN '{_BEFORE}' ELSE '' END || coalesce(text, '')
         || CASE WHEN doc_id % 10 = 3 THEN repeat('{_JUNK}', (length(coalesce(text, '')) * 4 // 5)::INT) ELSE '' END
         || CASE WHEN doc_id % 3 = 0 THEN '{_AFTER}' ELSE '' END AS raw_text,
         sha256(source || '-' || (doc_id // 1000)::VARCHAR || CASE WHEN doc_id % 97 = 0 THEN '+' ELSE '' END) AS file_hash, '' AS pdf_path
  FROM documents)"""


def sanitize_sql(t: str) -> str:
    for pattern, to in ((r"[\x{FFFD}\x00]", "' '"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "''"), (r"\p{Cf}", "''"), (r"[ \t]+", "' '"), (r"\n{2,}", "chr(10)"), (rf"^[{SPACE}]+|[{SPACE}]+$", "''")):
        t = f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    return t


def junk_sql(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '[^\P{{C}}\n\r\t]|\x{{FFFD}}'))"


JUDGED_SQL = f"""{PAGES_SQL},
clean AS (SELECT *, {sanitize_sql("raw_text")} AS text FROM pages),
judged AS (
  SELECT *, CASE WHEN length(text) < 100 THEN 'short'
                 WHEN g AND length(text) <= 2000 THEN 'dropped_garbled' WHEN g THEN 'kept_garbled' ELSE 'kept' END AS verdict
  FROM (SELECT *, CASE WHEN length(text) = 0 THEN true ELSE {junk_sql("text")} / length(text) > 0.40 END AS g FROM clean))"""

#: Chunks of the incremental queries: one per page, two pipeline versions.
CHUNKS_SQL = f"""{PAGES_SQL},
chunks AS (SELECT pdf_name || '::p' || page_number::VARCHAR || '::i0' AS id, raw_text AS text, pdf_name, file_hash,
                  CASE WHEN ordinal % 50 = 11 THEN '1.0' ELSE '1.1' END AS pipeline_version, page_number, ordinal FROM pages)"""
MANIFEST_SQL = """
manifest AS (SELECT pdf_name, CASE WHEN o % 4 = 1 THEN 'old' ELSE h END AS file_hash
             FROM (SELECT pdf_name, min(ordinal) AS o, min(file_hash) AS h FROM chunks GROUP BY pdf_name) WHERE o % 3 <> 0
             UNION ALL VALUES ('gone-0.pdf', 'h'), ('gone-1.pdf', 'h'))"""
COLLECTION_SQL = """
collection AS (SELECT CASE WHEN ordinal % 6 = 0 THEN id || '-old' ELSE id END AS id, text AS document,
                      CASE WHEN ordinal % 50 = 7 THEN NULL WHEN ordinal % 40 = 9 THEN 'gone-0.pdf' ELSE pdf_name END AS source, ordinal
               FROM chunks WHERE ordinal % 5 <> 4)"""
CACHE_SQL = """
cache AS (SELECT id, text, pdf_name, CASE WHEN ordinal % 7 = 3 THEN 'old' ELSE file_hash END AS file_hash, '1.1' AS pipeline_version, page_number,
                 'CONTEXT: cached' || text AS text_with_context FROM chunks WHERE ordinal % 2 = 0
          UNION ALL SELECT id || '-gone', text, pdf_name, file_hash, '1.1', page_number, text FROM chunks WHERE ordinal % 9 = 0)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    book = F.concat("source", F.lit("-"), (n / 1000).cast("long").cast("string"))
    junk = F.when(n % 10 == 3, F.expr(f"repeat('{_JUNK}', CAST(length(coalesce(text, '')) * 4 DIV 5 AS INT))")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        n.alias("ordinal"),
        F.concat(book, F.lit(".pdf")).alias("pdf_name"),
        (n % 1000 + 1).cast("int").alias("page_number"),
        F.concat(F.when(n % 4 == 0, _BEFORE).otherwise(""), t, junk, F.when(n % 3 == 0, _AFTER).otherwise("")).alias("raw_text"),
        F.sha2(F.concat(book, F.when(n % 97 == 0, "+").otherwise("")), 256).alias("file_hash"),
        F.lit("").alias("pdf_path"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("ordinal") % 50 == 11, "1.0").otherwise("1.1")
    return pages(spark, sf_dir).select(
        X.chunk_id(F.col("pdf_name"), F.col("page_number")).alias("id"), F.col("raw_text").alias("text"), "pdf_name", "file_hash", version.alias("pipeline_version"), "page_number", "ordinal"
    )


def manifest(spark: SparkSession, chunk_rows: DataFrame) -> DataFrame:
    books = chunk_rows.groupBy("pdf_name").agg(F.min("ordinal").alias("o"), F.min("file_hash").alias("h")).where("o % 3 <> 0")
    known = books.select("pdf_name", F.when(F.col("o") % 4 == 1, "old").otherwise(F.col("h")).alias("file_hash"))
    return known.unionByName(spark.createDataFrame([("gone-0.pdf", "h"), ("gone-1.pdf", "h")], "pdf_name string, file_hash string"))


def collection(chunk_rows: DataFrame) -> DataFrame:
    n = F.col("ordinal")
    source = F.when(n % 50 == 7, F.lit(None)).when(n % 40 == 9, "gone-0.pdf").otherwise(F.col("pdf_name"))
    return chunk_rows.where("ordinal % 5 <> 4").select(
        F.when(n % 6 == 0, F.concat("id", F.lit("-old"))).otherwise(F.col("id")).alias("id"),
        F.col("text").alias("document"),
        F.struct(source.alias("source")).alias("metadata"),
        n.alias("ordinal"),
    )


def cache(chunk_rows: DataFrame) -> DataFrame:
    columns = ["id", "text", "pdf_name", "file_hash", "pipeline_version", "page_number", "text_with_context"]
    kept = chunk_rows.where("ordinal % 2 = 0").withColumn("file_hash", F.when(F.col("ordinal") % 7 == 3, "old").otherwise(F.col("file_hash")))
    kept = kept.withColumn("text_with_context", F.concat(F.lit("CONTEXT: cached"), "text"))
    gone = chunk_rows.where("ordinal % 9 = 0").withColumn("id", F.concat("id", F.lit("-gone"))).withColumn("text_with_context", F.col("text"))
    return kept.unionByName(gone).withColumn("pipeline_version", F.lit("1.1")).select(*columns)
