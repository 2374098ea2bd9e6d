"""Registered queries of stores, sinks and models, with their SQL oracles (DuckDB).

They write to the shared folder and read what was written; models and sinks are small deterministic
functions that run in the workers as real ones would.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import answer, enrichment, graphstore, ingest
from spindrift.operators.fusion import fused_candidates
from spindrift.plans import carriers as C
from spindrift.plans.catalogue import _HYBRID_SQL, _documents, _fused, _questions, query
from spindrift.session import scratch
from spindrift.sources import checkpoint, pdf
from spindrift.sources.store import ManifestStore, SnapshotStore

_BOOKS = "books AS (SELECT pdf_name, min(ordinal) AS o, min(file_hash) AS h FROM chunks GROUP BY pdf_name)"


def _books(spark, sf_dir):
    return C.chunks(spark, sf_dir).groupBy("pdf_name").agg(F.min("ordinal").alias("o"), F.min("file_hash").alias("h"))


@query(f"""WITH {C.CHUNKS_SQL}, {_BOOKS}
SELECT pdf_name, CASE WHEN o % 2 = 0 THEN 'new' ELSE h END AS file_hash FROM books WHERE pdf_name NOT IN (SELECT pdf_name FROM books WHERE o % 5 = 3 ORDER BY pdf_name LIMIT 20)""")
def manifest_store(spark, sf_dir):
    """Entries inserted, replaced and removed under the lock; those of another store stay apart."""
    books = _books(spark, sf_dir)
    store = ManifestStore(spark, scratch(spark, "manifest"))
    store.update("one", books.select("pdf_name", F.col("h").alias("file_hash")))
    store.update("two", books.select("pdf_name", F.lit("other").alias("file_hash")))
    store.update("one", books.where("o % 2 = 0").select("pdf_name", F.lit("new").alias("file_hash")))
    store.remove("one", [r[0] for r in books.where("o % 5 = 3").orderBy("pdf_name").limit(20).collect()])  # a removal names its documents
    return store.load("one")


@query(f"""WITH {C.CHUNKS_SQL}, {_BOOKS}, fresh AS (SELECT id, pdf_name, 'new' AS file_hash FROM chunks JOIN books USING (pdf_name) WHERE o % 4 = 0 AND ordinal % 3 <> 1)
SELECT id, pdf_name, file_hash FROM chunks WHERE pdf_name NOT IN (SELECT pdf_name FROM fresh) UNION ALL SELECT * FROM fresh""")
def master_parts(spark, sf_dir):
    """A master table in parts: a later one replaces the documents it holds, an empty one nothing."""
    rows = C.chunks(spark, sf_dir)
    store = SnapshotStore(spark, scratch(spark, "master"), {"chunks": T.StructType.fromDDL("id string, pdf_name string, file_hash string")}, {"chunks": "pdf_name"})
    checkpoint.save_chunks(store, rows)
    changed = rows.join(_books(spark, sf_dir).where("o % 4 = 0"), "pdf_name").where("ordinal % 3 <> 1")
    checkpoint.save_chunks(store, changed.withColumn("file_hash", F.lit("new")))
    checkpoint.save_chunks(store, rows.limit(0))
    return store.read("chunks")


@query(f"""WITH {C.CHUNKS_SQL}
SELECT id, file_hash, CASE WHEN ordinal % 8 = 1 THEN text ELSE 'CONTEXT: Page ' || page_number::VARCHAR || ' of ' || pdf_name || chr(10) || chr(10) || 'ORIGINAL TEXT:' || chr(10) || text END AS text_with_context FROM chunks""")
def enrich_stepwise(spark, sf_dir):
    """Enrichment that is stored step by step; half of the chunks come in a first run, all in a second."""

    def generate(df):
        return enrichment.rule_context(df).withColumn("error", F.when(F.col("ordinal") % 8 == 1, "failed"))

    rows = C.chunks(spark, sf_dir)
    schema = T.StructType([*rows.schema.fields, T.StructField("text_with_context", T.StringType()), T.StructField("error", T.StringType())])
    store = SnapshotStore(spark, scratch(spark, "enriched"), {"enriched": schema}, {"enriched": "id"})
    step = max(1, rows.count() // 3)
    enrichment.enrich_stepwise(rows.where("ordinal % 2 = 0"), store, generate, step)
    return enrichment.enrich_stepwise(rows, store, generate, step).select("id", "file_hash", "text_with_context")


@query(f"WITH {C.CHUNKS_SQL} SELECT pdf_name, 'refused' AS error FROM chunks WHERE ordinal % 37 = 5 GROUP BY pdf_name")
def upsert_failures(spark, sf_dir):
    """Rows handed to a store that refuses some; their documents are marked as failed."""

    def sink():
        def put(batch: list[dict]) -> None:
            if any(int(r["document"]) % 37 == 5 for r in batch):
                raise OSError("refused")

        return put

    meta = F.struct(F.col("pdf_name").alias("source"))
    rows = C.chunks(spark, sf_dir).select("id", F.col("ordinal").cast("string").alias("document"), meta.alias("metadata"), F.array().cast("array<float>").alias("embedding"))
    return ingest.write_batches(rows, sink, 1)


@query(f"WITH {C.CHUNKS_SQL} SELECT id, length(text)::BIGINT AS size, (length(text) % 7)::INT AS rest FROM chunks")
def embedded_rows(spark, sf_dir):
    """Collection rows with vectors from an injected function."""
    n = F.length("document")
    rows = C.chunks(spark, sf_dir).withColumn("text_with_context", F.lit("")).withColumn("is_garbled", F.lit(False))
    made = ingest.as_rows(rows, lambda df: df.withColumn("embedding", F.array(n.cast("float"), (n % 7).cast("float"))))
    return made.select("id", F.get("embedding", F.lit(0)).cast("long").alias("size"), F.get("embedding", F.lit(1)).cast("int").alias("rest"))


@query(f"""WITH {C.CHUNKS_SQL}
SELECT pdf_name, count(DISTINCT (r - 1) // 20)::BIGINT AS batches, true AS ok FROM (SELECT pdf_name, row_number() OVER (PARTITION BY pdf_name ORDER BY page_number, id) AS r FROM chunks) GROUP BY pdf_name""")
def graph_reset(spark, sf_dir):
    """Feeding a graph store anew: the manifest is passed over and all documents go in."""
    rows = C.chunks(spark, sf_dir)
    status, _ = graphstore.populate(rows, C.manifest(spark, rows), lambda: lambda name, number, text: None, reset=True)
    return status.groupBy("pdf_name").agg(F.count(F.lit(1)).alias("batches"), F.bool_and("ok").alias("ok"))


@query(f"""WITH {C.CHUNKS_SQL}, {_BOOKS}
SELECT pdf_name, CASE WHEN o % 3 = 1 THEN 0 ELSE 2 END::BIGINT AS pages, o % 3 = 1 AS failed FROM books""")
def scan_log(spark, sf_dir):
    """Files of which some can't be read: they give no page, and the log says so."""
    content = F.when(F.col("o") % 3 == 1, F.unhex(F.lit("FFFE"))).otherwise(F.encode(F.lit("one\ftwo"), "UTF-8"))
    files = _books(spark, sf_dir).select("pdf_name", F.lit("").alias("pdf_path"), F.col("h").alias("file_hash"), content.alias("content"))
    pages, log = pdf.pages(files, pdf.form_feed_extractor, store=True)
    found = pages.groupBy("pdf_name").agg(F.count(F.lit(1)).alias("pages"))
    return log.join(found, "pdf_name", "left").select("pdf_name", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {_HYBRID_SQL}, fetched AS (SELECT c.query_id, c.id, c.rank AS candidate_rank, coalesce(length(d.text), 0) + 1000 * (length(q.query) % 5) AS s FROM cand c JOIN documents d ON d.doc_id = c.id JOIN q USING (query_id))
SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_rank) - 1)::INT AS rank FROM fetched QUALIFY rank < 5""")
def rerank_model(spark, sf_dir):
    """Reranking by a model that scores batches of pairs in the workers."""

    def make():
        return lambda pairs, batch_size: [len(d or "") + 1000 * (len(q) % 5) for q, d in pairs]

    fetched = answer.fetch(fused_candidates(_fused(spark, sf_dir)), _documents(spark, sf_dir), _questions(spark, sf_dir))
    return answer.rerank(fetched, _questions(spark, sf_dir), score=answer.model_score(make)).select("query_id", "id", "rank")
