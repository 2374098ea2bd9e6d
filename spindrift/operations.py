"""Operations: structured logs, the micro-benchmark and the smoke test."""

from __future__ import annotations

import contextlib
import json
import logging
import os
import sys
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import answer, chunks, fusion, ingest, lexical

LOGGER = logging.getLogger("spindrift")


class JsonLines(logging.Formatter):
    """One JSON object per record; fields of the event come last and may overwrite the others."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if event := getattr(record, "event", None):
            out["event"] = event
        return json.dumps(out | getattr(record, "fields", {}), ensure_ascii=False, default=str)


class _Stderr(logging.StreamHandler):
    def emit(self, record: logging.LogRecord) -> None:
        self.setStream(sys.stderr)
        super().emit(record)


def configure_logging(level: int = logging.INFO) -> None:
    if not any(isinstance(h, _Stderr) for h in LOGGER.handlers):
        handler = _Stderr()
        handler.setFormatter(JsonLines())
        LOGGER.addHandler(handler)
        LOGGER.propagate = False
    LOGGER.setLevel(level)


def log_event(event: str, **fields) -> None:
    configure_logging()
    LOGGER.info(event, extra={"event": event, "fields": fields})


@contextlib.contextmanager
def timed_event(event: str, **fields) -> Iterator[None]:
    """Log the event with its duration, also when its body fails."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log_event(event, elapsed_ms=round((time.perf_counter() - began) * 1000, 3), **fields)


def run_benchmark(spark: SparkSession, samples: int = 20_000, output: str | Path | None = None) -> dict:
    """Top 50 of random scores, grouping by document, orphan purge; on generated rows."""

    def timed(df: DataFrame) -> tuple[float, list]:
        began = time.perf_counter()
        rows = df.collect()
        return round((time.perf_counter() - began) * 1000, 3), rows

    name = lambda n: F.concat(F.lit("book-"), (F.col("id") % n).cast("string"), F.lit(".pdf"))
    top_ms, _ = timed(fusion.top_k(spark.range(samples).select(F.col("id").alias("ordinal"), F.rand(42).alias("value")), 50))
    rows = spark.range(samples).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("id"), name(100).alias("pdf_name"))
    group_ms, books = timed(chunks.ids_by_document(rows).agg(F.count(F.lit(1))))
    held = spark.range(samples).select("id", F.struct(name(120).alias("source")).alias("metadata"))
    purge_ms, gone = timed(ingest.orphans(held, spark.range(100).select(name(100).alias("source"))).agg(F.count(F.lit(1))))
    found = {"samples": samples, "top_k_ms": top_ms, "group_ms": group_ms, "purge_ms": purge_ms, "books": books[0][0], "orphans_deleted": gone[0][0]}
    if output:
        Path(output).write_text(json.dumps(found, indent=2) + "\n", encoding="utf-8")
    return found


@dataclass(frozen=True)
class SmokeResult:
    mode: str
    ok: bool
    message: str


def _reachable(url: str) -> int:
    with urllib.request.urlopen(url, timeout=5) as response:
        return response.status


def run_smoke(spark: SparkSession, live: bool = False, probe: Callable[[str], int] = _reachable, ask: Callable[[str], str] | None = None) -> SmokeResult:
    """Answer one question over two documents offline.

    Live, nothing is answered offline: the model's key has to be in GROQ_API_KEY and the embedding
    server at OLLAMA_BASE_URL has to respond; with ``ask``, the model has to answer a prompt as well.
    The message says what was checked.
    """
    if live:
        if not os.environ.get("GROQ_API_KEY"):
            return SmokeResult("live", False, "GROQ_API_KEY is not set")
        url = os.environ.get("OLLAMA_BASE_URL", "http://localhost:11434").rstrip("/") + "/api/tags"
        try:
            status = probe(url)
            if status != 200:
                return SmokeResult("live", False, f"{url}: status {status}")
            said = ask("Reply with one word: ready") if ask else None
        except Exception as failure:  # network and services fail in many ways, none of which may pass
            return SmokeResult("live", False, f"{type(failure).__name__}: {failure}")
        if ask and not (said or "").strip():
            return SmokeResult("live", False, "the model gave an empty answer")
        return SmokeResult("live", True, "key set, embedding server reached, " + ("model answered" if ask else "model not called"))
    space = spark.createDataFrame([("doc-1", "risk and return", [0.0, 1.0]), ("doc-2", "market spread", [1.0, 0.0])], "id string, document string, embedding array<float>")
    queries = spark.createDataFrame([(1, "what is risk", [0.0, 1.0])], "query_id int, query string, vector array<float>")
    found = answer.answer(queries, space, lexical.build_index(space, text="document"), final_k=1).first()
    return SmokeResult("offline", bool(found.answer and found.contexts), f"{len(found.contexts)} contexts")
