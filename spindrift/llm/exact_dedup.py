"""Exact dedup with a log-structured merge index of text digests (DataFrame and SQL only).

Each scan partition is a memtable: its rows become (digest, doc_id) pairs, which are flushed as one
run sorted by digest, with a Parquet bloom filter on the digest column. Compaction merges all runs
into one row per digest: the identifier that stays, the group's size. Texts whose digest occurs
more than once (hits, found by a fixed-size bit filter and then exactly) are compared byte by byte:
hits are grouped by digest and whole text, so that equal digests of different texts fall apart.

Defined results: a null text counts as empty; null identifiers are passed over when the one that
stays is chosen, and a group without any has a null ``keep_id`` that its rows equal; rows that
repeat an identifier and a text are marked alike (``keep_one`` keeps one of them); an empty table
gives an empty result; other columns are ignored by ``exact_groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.shared import MemberFilter, attach
from spindrift.session import scratch

def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class DigestIndex:
    """Runs of (digest, id) in a shared folder, and their compaction."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256_hex):
        self.spark, self.path, self.digest = spark, path or scratch(spark, "digest-index"), digest

    def ingest(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Flush the memtables of ``docs``: a sorted run per scan partition, without a shuffle."""
        rows = docs.select(self.digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(doc_id).alias("id"))
        self._flush(rows.sortWithinPartitions("digest", "id"), f"level0/run-{uuid.uuid4().hex[:12]}")

    def _flush(self, rows: DataFrame, where: str) -> None:
        rows.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(f"{self.path}/{where}")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level0/*")

    def lookup(self, digests: Sequence[str]) -> DataFrame:
        """Index rows of a few digests. The equality reaches the scan, where the runs' bloom filters and
        sorted pages leave out most of them; large sets of digests are joined instead."""
        return self.runs().where(F.col("digest").isin(list(digests)))

    def compact(self, keep: str = "min") -> DataFrame:
        """Level 1: (digest, keep_id, n), one row per digest, written sorted.

        ``keep``: "min" keeps the smallest identifier of each digest, "max" the largest.
        """
        best = {"min": F.min, "max": F.max}[keep]
        merged = self.runs().groupBy("digest").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        where = f"level1/{keep}-{uuid.uuid4().hex[:12]}"
        self._flush(merged.sortWithinPartitions("digest"), where)
        return self.spark.read.parquet(f"{self.path}/{where}")


_BEST = {"min": F.min, "max": F.max}


class _Verified:
    """The repeated digests of ``docs``, verified on whole texts; see :func:`exact_groups`."""

    def __init__(self, docs: DataFrame, keep: str, doc_id: str, text: str, digest):
        self.spark, self.keep, self.digest, self.doc_id, self.text = docs.sparkSession, keep, digest, doc_id, text
        self.index = DigestIndex(self.spark, digest=digest)
        self.index.ingest(docs, doc_id, text)
        level1 = self.index.compact(keep)
        repeated = level1.where("n > 1")
        self.rows = level1.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.filter = MemberFilter(repeated, "digest")
        hits = self.split(docs).where("hit")
        groups = hits.groupBy("digest", "text").agg(_BEST[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        path = scratch(self.spark, "digest-verified")
        groups.select("digest", "keep_id", "group_size").write.parquet(path)
        self.groups = self.spark.read.parquet(path)
        #: Digests that stand for several texts: none, as long as the digest holds.
        self.collided = self.groups.groupBy("digest").count().where("count > 1").select("digest")
        self.collides = not self.collided.isEmpty()

    def split(self, docs: DataFrame, *others: Column) -> DataFrame:
        """``id, text, digest`` and ``hit``: whether the filter has the digest. Nothing moves."""
        rows = docs.select(F.col(f"`{self.doc_id}`").alias("id"), F.coalesce(F.col(f"`{self.text}`"), F.lit("")).alias("text"), *others)
        return self.filter.mark(rows.withColumn("digest", self.digest(F.col("text"))), "digest")

    def label(self, rows: DataFrame) -> DataFrame:
        """Adds ``keep_id, group_size`` to rows with ``digest``; null for what isn't repeated."""
        return attach(rows, self.groups.where("group_size > 1"), "digest", "group_size", self.rows)


def exact_groups(docs: DataFrame, keep: str = "min", doc_id: str = "doc_id", text: str = "text", digest=sha256_hex) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    ``digest`` maps a text column to a string column; should equal digests stand for different
    texts, these are told apart by the texts themselves.
    """
    found = _Verified(docs, keep, doc_id, text, digest)
    rows = found.index.runs()
    if found.collides:
        odd = found.split(docs).join(found.collided, "digest", "left_semi")
        told = odd.groupBy("digest", "text").agg(_BEST[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        odd = odd.join(told, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        labelled = found.label(rows.join(found.collided, "digest", "left_anti")).unionByName(odd)
    else:
        labelled = found.label(rows)
    return labelled.select(
        F.col("id").alias("doc_id"),
        F.expr("CASE WHEN group_size IS NULL THEN id ELSE keep_id END").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.expr("group_size IS NULL OR id <=> keep_id").alias("kept"),
        "digest",
    )


def keep_one(docs: DataFrame, keep: str = "min", doc_id: str = "doc_id", text: str = "text", digest=sha256_hex) -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts, all columns as they were.

    Rows that the filter doesn't have stay where they are; only possible copies are moved.
    """
    found = _Verified(docs, keep, doc_id, text, digest)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    split = found.split(docs, whole)
    lone = split.where("NOT hit").select("row.*")
    hits = split.where("hit")
    if found.collides:
        best = hits.groupBy("digest", "text").agg(_BEST[keep]("id").alias("keep_id"))
        kept = hits.join(best, ["digest", "text"]).where("id <=> keep_id").dropDuplicates(["digest", "text"])
    else:
        kept = found.label(hits).where("group_size IS NULL OR id <=> keep_id").dropDuplicates(["digest"])
    return lone.unionByName(kept.select("row.*"))
