"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, tokenisation.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again as the next stage's docs. All stages but the last return the columns of
``documents``. The result's rows come in the order of the mixture: the last stage takes its documents in
the order in which they were written, whatever order the files are scanned in.

Defined results: a null or blank text fails the quality rules, so that the later stages see none in a
run; alone, exact dedup takes null as empty, near dedup links such texts with nothing and the last
stage gives them no tokens. Rows without an identifier are never dropped by near dedup; of equal texts
one with an identifier stays, if there is one. Rows that repeat an identifier and a text are copies
of each other. Rows without a source come last in the mixture. An empty table gives an empty result
at every stage. Further columns are kept by all stages but the last, by whatever name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, exact_dedup, minhash, mixing, quality
from spindrift.llm.queries import word_vocabulary
from spindrift.llm.shared import own_name
from spindrift.session import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1."""
    return quality.keep_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact_dedup.keep_one(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at similarity 0.8, the one with the smallest doc_id."""
    return minhash.keep_one(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, sources interleaved by tempered weights for as long as they last."""
    return mixing.all_in_order(mixing.mix_tempered(docs), docs.columns)


def as_written(docs: DataFrame) -> DataFrame:
    """Rows of Parquet files in the order in which they were written: by the numbers that Spark gave the
    files, then by their paths, then by row. A scan would take the files by size. Frames that aren't just
    read from files stay in their own order."""
    if not docs._jdf.queryExecution().analyzed().children().isEmpty():
        return docs
    try:
        at = docs.metadataColumn("_metadata")
    except AnalysisException:  # rows without files
        return docs
    number = lambda pattern: F.regexp_extract(at["file_name"], pattern, 1).try_cast("long")
    keys = [number(r"^part-(\d+)"), number(r"-c(\d+)\."), at["file_path"], at["row_index"]]
    names = [own_name("place") + str(i) for i in range(len(keys))]
    placed = docs.select("*", *[key.alias(name) for key, name in zip(keys, names)])
    return placed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in their order as token ids, with their number and the decoded strings' digest."""
    ordered = as_written(docs).select("doc_id", "lang", "source", "text")
    encoded = bpe.encode_rows(ordered, word_vocabulary())
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("pfair_mix", mixture),
    ("bpe", encode),
]

#: Near dedup, mixing and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
