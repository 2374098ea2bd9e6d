"""JSON checkpoints of the chunk table: read leniently, written as one sorted array."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators.chunks import last_wins
from spindrift.schema import CHUNK, DEFAULTS, REQUIRED
from spindrift.sources.store import SnapshotStore


def empty_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHUNK)


def clean_rows(raw: DataFrame) -> DataFrame:
    """Chunk rows from JSON objects (ordinal, value): rows that lack a required field or have an
    unknown one go, defaults are filled in, and of equal ids the last stays."""
    known = [f.name for f in CHUNK.fields]
    keys = F.json_object_keys("value")
    parsed = raw.where(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0).select("ordinal", F.from_json("value", CHUNK).alias("c"))
    rows = parsed.select("ordinal", "c.*").where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))
    filled = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return last_wins(filled, "id", "ordinal").select(*known)


def read_checkpoint(spark: SparkSession, path: str, most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """The chunk table in a JSON array; a missing, too large or corrupt file gives an empty one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(conf)
    if not files.exists(where) or files.getFileStatus(where).getLen() > most_bytes:
        return empty_chunks(spark)
    text = spark.read.text(path, wholetext=True)
    objects = text.select(F.from_json("value", T.ArrayType(T.VariantType())).alias("rows"))
    raw = objects.select(F.posexplode("rows").alias("ordinal", "v")).select("ordinal", F.to_json("v").alias("value"))
    return clean_rows(raw.where("value LIKE '{%'"))


def write_json_atomic(rows: list[dict], path: str | Path) -> None:
    """A small table as one JSON array: written aside, synced, renamed. Errors are raised."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(rows, file, ensure_ascii=False, indent=2)
            file.flush()
            os.fsync(file.fileno())
        os.replace(aside, path)
    except BaseException:
        os.unlink(aside)
        raise


def save_chunks(store: SnapshotStore, fresh: DataFrame, table: str = "chunks") -> bool:
    """Add new chunks to a store's table, in which they replace those of their documents; the pointer
    moves in one step. Nothing is written to it without new chunks. Returns whether there were any."""
    with store.lock():
        return store.append(table, fresh)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table as Parquet, sorted by id (code points: p10 comes before p2)."""
    chunks.orderBy("id").write.mode("overwrite").parquet(path)
