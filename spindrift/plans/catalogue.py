"""Registered queries of the retrieval engine and their SQL oracles (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import answer, audit, chunks, dense, enrichment, evaluate, fusion, graphstore, ingest, lexical
from spindrift.plans import carriers as C
from spindrift.session import remembered, table
from spindrift.sources import checkpoint, pdf
from spindrift.streaming.ingest import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as the query of its name, with its oracle if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- cleaning, features, chunks ---------------------------------------------------------------


@query(f"WITH {C.PAGES_SQL} SELECT ordinal, {C.sanitize_sql('raw_text')} AS text FROM pages")
def sanitize_text(spark, sf_dir):
    return C.pages(spark, sf_dir).select("ordinal", X.sanitize(F.col("raw_text")).alias("text"))


@query(f"WITH {C.PAGES_SQL} SELECT ordinal, {C.junk_sql('raw_text')}::BIGINT AS junk, length(raw_text)::BIGINT AS total, CASE WHEN length(raw_text) = 0 THEN true ELSE {C.junk_sql('raw_text')} / length(raw_text) > 0.40 END AS garbled FROM pages")
def garble_ratio(spark, sf_dir):
    t = F.col("raw_text")
    return C.pages(spark, sf_dir).select("ordinal", X.junk_count(t).cast("long").alias("junk"), F.length(t).cast("long").alias("total"), X.is_garbled(t).alias("garbled"))


@query(f"WITH {C.JUDGED_SQL} SELECT ordinal, verdict FROM judged")
def garble_policy(spark, sf_dir):
    return chunks.judged_pages(C.pages(spark, sf_dir)).select("ordinal", "verdict")


_FEATURES_SQL = rf"""length(text)::INT AS char_count, len(regexp_extract_all(text, '[^{C.SPACE}]+'))::INT AS word_count,
  regexp_matches(text, '{X.digit_class()}') AS has_numbers, regexp_matches(text, '[$%=]') AS has_formula"""


@query(f"WITH {C.JUDGED_SQL} SELECT ordinal, {_FEATURES_SQL} FROM clean")
def chunk_features(spark, sf_dir):
    t = F.col("text")
    rows = C.pages(spark, sf_dir).select("ordinal", X.sanitize(F.col("raw_text")).alias("text"))
    return rows.select("ordinal", F.length(t).alias("char_count"), X.word_count(t).alias("word_count"), X.has_numbers(t).alias("has_numbers"), X.has_formula(t).alias("has_formula"))


@query(f"""WITH {C.JUDGED_SQL}
SELECT pdf_name || '::p' || page_number::VARCHAR || '::i0' AS id, text, pdf_name, file_hash, '1.1' AS pipeline_version, page_number, 0 AS chunk_index, pdf_path,
       {_FEATURES_SQL}, NULL::VARCHAR AS text_with_context, verdict = 'kept_garbled' AS is_garbled
FROM judged WHERE verdict LIKE 'kept%'""")
def chunk_table(spark, sf_dir):
    return chunks.chunk_table(C.pages(spark, sf_dir))


_STATS_SQL = f"""WITH {C.JUDGED_SQL}
SELECT pdf_name, count(*) AS total, count(*) FILTER (verdict LIKE 'kept%') AS kept, count(*) FILTER (verdict = 'dropped_garbled') AS dropped_garbled,
       count(*) FILTER (verdict = 'kept_garbled') AS kept_garbled, count(*) FILTER (verdict = 'short') AS short
FROM judged GROUP BY pdf_name"""


@query(_STATS_SQL)
def page_quality_stats(spark, sf_dir):
    return chunks.page_stats(chunks.judged_pages(C.pages(spark, sf_dir)))


@query(f"SELECT * FROM ({_STATS_SQL}) WHERE dropped_garbled / total > 0.05")
def high_garble_books(spark, sf_dir):
    return chunks.high_garble(chunks.page_stats(chunks.judged_pages(C.pages(spark, sf_dir))), 0.05)


@query(f"WITH {C.PAGES_SQL} SELECT pdf_name, sha256(count(*)::VARCHAR || '|' || min(sha256(raw_text)) || '|' || max(sha256(raw_text))) AS content_hash FROM pages GROUP BY pdf_name")
def file_hash_by_book(spark, sf_dir):
    page = F.sha2(F.encode("raw_text", "UTF-8"), 256)
    made = F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.min("h"), F.max("h"))
    return C.pages(spark, sf_dir).select("pdf_name", page.alias("h")).groupBy("pdf_name").agg(F.sha2(made, 256).alias("content_hash"))


_STATE_SQL = "SELECT pdf_name, min(file_hash) AS file_hash, min(pipeline_version) AS pipeline_version FROM chunks GROUP BY pdf_name HAVING count(DISTINCT (file_hash, pipeline_version)) = 1"


@query(f"WITH {C.CHUNKS_SQL} {_STATE_SQL}")
def consistent_state(spark, sf_dir):
    return chunks.consistent_state(C.chunks(spark, sf_dir))


@query(f"""WITH {C.CHUNKS_SQL}, state AS ({_STATE_SQL}), files AS (SELECT pdf_name, CASE WHEN min(ordinal) % 5 = 2 THEN '' ELSE max(file_hash) END AS file_hash FROM chunks GROUP BY pdf_name)
SELECT f.* FROM files f LEFT JOIN state s ON s.pdf_name = f.pdf_name
WHERE NOT coalesce(f.file_hash <> '' AND s.file_hash = f.file_hash AND s.pipeline_version = '1.1', false)""")
def unchanged_skip(spark, sf_dir):
    rows = C.chunks(spark, sf_dir)
    files = rows.groupBy("pdf_name").agg(F.when(F.min("ordinal") % 5 == 2, "").otherwise(F.max("file_hash")).alias("file_hash"))
    return chunks.files_to_process(files, chunks.consistent_state(rows))


_NEW_SQL = "fresh AS (SELECT id, pdf_name, 'new' AS file_hash, page_number FROM chunks WHERE pdf_name IN (SELECT pdf_name FROM chunks GROUP BY pdf_name HAVING min(ordinal) % 4 = 0) AND ordinal % 3 <> 1)"


@query(f"WITH {C.CHUNKS_SQL}, {_NEW_SQL} SELECT id, pdf_name, file_hash, page_number FROM chunks WHERE pdf_name NOT IN (SELECT pdf_name FROM fresh) UNION ALL SELECT * FROM fresh")
def chunk_replace_sync(spark, sf_dir):
    rows = C.chunks(spark, sf_dir).select("id", "pdf_name", "file_hash", "page_number", "ordinal")
    books = rows.groupBy("pdf_name").agg(F.min("ordinal").alias("o")).where("o % 4 = 0").select("pdf_name")
    fresh = rows.join(books, "pdf_name", "left_semi").where("ordinal % 3 <> 1").withColumn("file_hash", F.lit("new"))
    return chunks.sync_master(rows.drop("ordinal"), fresh.drop("ordinal"))


@query(f"WITH {C.CHUNKS_SQL} SELECT id, pdf_name, page_number, '0.0' AS pipeline_version, false AS is_garbled, 0 AS char_count FROM chunks WHERE ordinal % 4 NOT IN (1, 2)")
def checkpoint_required_fields(spark, sf_dir):
    n = F.col("ordinal")
    value = F.to_json(F.struct("id", F.when(n % 4 != 1, F.col("text")).alias("text"), "pdf_name", "file_hash", "page_number", F.lit(0).alias("chunk_index"), F.when(n % 4 == 2, "x").alias("unknown")))
    rows = checkpoint.clean_rows(C.chunks(spark, sf_dir).select("ordinal", value.alias("value")))
    return rows.select("id", "pdf_name", "page_number", "pipeline_version", "is_garbled", "char_count")


@query(f"WITH {C.CHUNKS_SQL} SELECT k AS id, max(ordinal) AS ordinal FROM (SELECT pdf_name || '-' || (page_number // 3)::VARCHAR AS k, ordinal FROM chunks) GROUP BY k")
def checkpoint_last_wins(spark, sf_dir):
    key = F.concat("pdf_name", F.lit("-"), (F.col("page_number") / 3).cast("int").cast("string"))
    return chunks.last_wins(C.chunks(spark, sf_dir).select(key.alias("id"), "ordinal"), "id", "ordinal")


@query(f"WITH {C.CHUNKS_SQL} SELECT pdf_name, list_sort(list(DISTINCT id)) AS ids FROM chunks GROUP BY pdf_name")
def group_ids_by_book(spark, sf_dir):
    return chunks.ids_by_document(C.chunks(spark, sf_dir))


@query(f"WITH {C.CHUNKS_SQL} SELECT pdf_name, arg_min(file_hash, ordinal) AS file_hash FROM chunks WHERE ordinal % 3 <> 0 GROUP BY pdf_name")
def first_hash_by_book(spark, sf_dir):
    rows = C.chunks(spark, sf_dir).withColumn("file_hash", F.when(F.col("ordinal") % 3 == 0, "").otherwise(F.col("file_hash")))
    return chunks.first_hash_by_document(rows)


@query(f"WITH {C.PAGES_SQL} SELECT pdf_name, (row_number() OVER (PARTITION BY pdf_name ORDER BY page_number))::INT AS page_number, replace(raw_text, chr(12), ' ') AS raw_text FROM pages")
def pdf_scan(spark, sf_dir):
    """Books as files whose pages end at form feeds, through the page extractor."""
    page = F.struct("page_number", F.replace("raw_text", F.lit("\f"), F.lit(" ")).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"])
    books = C.pages(spark, sf_dir).groupBy("pdf_name").agg(F.encode(F.array_join(texts, "\f"), "UTF-8").alias("content"))
    files = books.select("pdf_name", F.lit("").alias("pdf_path"), F.sha2("content", 256).alias("file_hash"), "content")
    return pdf.pages(files, pdf.form_feed_extractor)[0].select("pdf_name", "page_number", "raw_text")


# --- enrichment -------------------------------------------------------------------------------


@query(f"WITH {C.CHUNKS_SQL}, {C.CACHE_SQL} SELECT id FROM cache WHERE id IN (SELECT id FROM chunks)")
def enrich_cache_prune(spark, sf_dir):
    rows = C.chunks(spark, sf_dir)
    return enrichment.prune(C.cache(rows), rows).select("id")


_MISSING_SQL = "SELECT c.* FROM chunks c ANTI JOIN cache k ON k.id = c.id AND k.file_hash = c.file_hash AND k.pipeline_version = c.pipeline_version"


@query(f"WITH {C.CHUNKS_SQL}, {C.CACHE_SQL} SELECT id, file_hash, pipeline_version FROM ({_MISSING_SQL})")
def enrich_delta(spark, sf_dir):
    rows = C.chunks(spark, sf_dir)
    return enrichment.missing(rows, C.cache(rows)).select("id", "file_hash", "pipeline_version")


@query(f"""WITH {C.CHUNKS_SQL}, {C.CACHE_SQL}, todo AS ({_MISSING_SQL})
SELECT id, file_hash, text_with_context FROM cache WHERE id IN (SELECT id FROM chunks) AND id NOT IN (SELECT id FROM todo)
UNION ALL SELECT id, file_hash, CASE WHEN ordinal % 8 = 1 THEN text ELSE 'CONTEXT: Page ' || page_number::VARCHAR || ' of ' || pdf_name || chr(10) || chr(10) || 'ORIGINAL TEXT:' || chr(10) || text END FROM todo""")
def enrich_apply(spark, sf_dir):
    def generate(rows: DataFrame) -> DataFrame:
        return enrichment.rule_context(rows).withColumn("error", F.when(F.col("ordinal") % 8 == 1, "failed"))

    rows = C.chunks(spark, sf_dir)
    return enrichment.enrich(rows, C.cache(rows), generate).select("id", "file_hash", "text_with_context")


@query(f"WITH {C.CHUNKS_SQL} SELECT id, coalesce(nullif(CASE WHEN ordinal % 3 = 0 THEN '' WHEN ordinal % 3 = 1 THEN 'CONTEXT: ' || text END, ''), text) AS effective FROM chunks")
def effective_text(spark, sf_dir):
    n = F.col("ordinal")
    enriched = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("CONTEXT: "), "text"))
    return C.chunks(spark, sf_dir).select("id", X.effective_text(enriched, F.col("text")).alias("effective"))


@query(f"""WITH {C.CHUNKS_SQL} SELECT id, 'Generate a 2-3 sentence context for this chunk:
Book: ' || pdf_name || '
Page: ' || page_number::VARCHAR || '
Chunk:
' || substring(text, 1, 1000) || '
Context should explain:
1. What book/chapter this is from
2. The main topic being discussed
3. Key trading concepts mentioned
Return ONLY the context, nothing else.' AS prompt FROM chunks""")
def enrich_prompt(spark, sf_dir):
    return C.chunks(spark, sf_dir).select("id", X.enrichment_prompt(F.col("pdf_name"), F.col("page_number"), F.col("text")).alias("prompt"))


# --- lexical, dense, fusion -------------------------------------------------------------------

_TOK = r"list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]+|[$%().,]'), lambda x: length(x) > 1 OR x IN ('$', '%'))"
_BM25_SQL = f"""
docs AS MATERIALIZED (SELECT doc_id AS id, {_TOK.format(t="text")} AS tokens FROM documents),
stats AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS avgdl FROM docs),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM df, stats),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN (SELECT 0.25::DOUBLE * avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format(t="query")}) AS term FROM q) GROUP BY ALL),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
scores AS MATERIALIZED (SELECT query_id, id, round(sum((qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))::DECIMAL(20, 9)), 6)::DOUBLE AS score
           FROM tf JOIN qt USING (term) JOIN terms USING (term), stats GROUP BY query_id, id),
bm AS MATERIALIZED (SELECT query_id, id, score, rank FROM (
        SELECT q.query_id, d.id, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0) DESC, d.id) - 1 AS rank
        FROM q CROSS JOIN docs d LEFT JOIN scores s ON s.query_id = q.query_id AND s.id = d.id) WHERE rank < 50)"""
_DENSE_SQL = """
qv AS (SELECT b.item_id AS query_id, e.embedding AS vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dn AS MATERIALIZED (SELECT query_id, id, distance, rank FROM (
        SELECT query_id, vec_id AS id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) - 1 AS rank
        FROM (SELECT query_id, vec_id, list_sum(list_transform(range(1, len(vector) + 1), lambda i: (embedding[i]::DOUBLE - vector[i]::DOUBLE) * (embedding[i]::DOUBLE - vector[i]::DOUBLE))) AS d FROM embeddings, qv))
      WHERE rank < 50)"""
_RRF_SQL = """
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score, min(rank) FILTER (l = 0) AS rank_0, min(rank) FILTER (l = 1) AS rank_1
          FROM (SELECT query_id, id, rank, 0 AS l FROM dn UNION ALL SELECT query_id, id, rank, 1 FROM bm) GROUP BY query_id, id)"""
_CAND_SQL = """
cand AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_0 ASC NULLS LAST, rank_1 ASC NULLS LAST, id) - 1 AS rank FROM fused) WHERE rank < 20)"""
_HYBRID_SQL = f"{_BM25_SQL}, {_DENSE_SQL}, {_RRF_SQL}, {_CAND_SQL}"
_RERANK_SQL = f"""
fetched AS (SELECT c.query_id, c.id, c.rank AS candidate_rank, d.text AS document, q.query FROM cand c JOIN documents d ON d.doc_id = c.id JOIN q USING (query_id)),
scored AS (SELECT query_id, id, candidate_rank, document, query,
                  round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, list_distinct(dt))) / len(qt) END, 9) AS rerank_score
           FROM (SELECT *, list_distinct({_TOK.format(t="query")}) AS qt, {_TOK.format(t="document")} AS dt FROM fetched)),
top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, candidate_rank) - 1 AS rank FROM scored) WHERE rank < 5),
ctx AS (SELECT query_id, list(document ORDER BY rank) AS contexts FROM top GROUP BY query_id)"""


def _index(spark, sf_dir) -> lexical.Bm25Index:
    # built once and stored, as a service would; later queries of the application read it
    return remembered(spark, ("bm25", sf_dir), lambda: lexical.build_index(table(spark, sf_dir, "documents"), doc_id="doc_id"))


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _questions(spark, sf_dir).join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def _space(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))


def _fused(spark, sf_dir) -> DataFrame:
    near = dense.dense_topk(_vectors(spark, sf_dir), _space(spark, sf_dir))
    return fusion.rrf(near, lexical.bm25_topk(_index(spark, sf_dir), _questions(spark, sf_dir)))


def _reranked(spark, sf_dir) -> DataFrame:
    found = fusion.fused_candidates(_fused(spark, sf_dir))
    return answer.rerank(answer.fetch(found, _documents(spark, sf_dir), _questions(spark, sf_dir)), _questions(spark, sf_dir))


@query(f"SELECT doc_id AS id, {_TOK.format(t='text')} AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("tokens"))


@query(f"WITH {_BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms")
def term_df_idf(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25_SQL} SELECT id, len(tokens)::BIGINT AS dl FROM docs")
def doc_lengths(spark, sf_dir):
    return _index(spark, sf_dir).docs.select("id", "dl")


@query(f"WITH {_BM25_SQL} SELECT query_id, id, score FROM scores")
def bm25_scores(spark, sf_dir):
    return lexical.bm25_scores(_index(spark, sf_dir), lexical.query_terms(_questions(spark, sf_dir)))


@query(f"WITH {_BM25_SQL} SELECT query_id, id, score, rank::INT AS rank FROM bm")
def bm25_topk(spark, sf_dir):
    return lexical.bm25_topk(_index(spark, sf_dir), _questions(spark, sf_dir))


@query(f"WITH {_DENSE_SQL} SELECT query_id, id, distance, rank::INT AS rank FROM dn")
def dense_topk_l2(spark, sf_dir):
    return dense.dense_topk(_vectors(spark, sf_dir), _space(spark, sf_dir))


@query("SELECT event_id AS ordinal, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def topk_desc(spark, sf_dir):
    return fusion.top_k(table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), "value"), 50)


@query(f"WITH {_BM25_SQL}, {_DENSE_SQL}, {_RRF_SQL} SELECT query_id, id, score, rank_0::INT AS rank_0, rank_1::INT AS rank_1 FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


@query(f"WITH {_HYBRID_SQL} SELECT query_id, id, score, rank::INT AS rank FROM cand")
def hybrid_topk(spark, sf_dir):
    return fusion.fused_candidates(_fused(spark, sf_dir)).select("query_id", "id", "score", "rank")


@query(f"WITH {_HYBRID_SQL} SELECT query_id, id, rank::INT AS rank, d.text AS document FROM cand JOIN documents d ON d.doc_id = id")
def fetch_candidates(spark, sf_dir):
    found = fusion.fused_candidates(_fused(spark, sf_dir))
    return answer.fetch(found, _documents(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", "id", "rank", "document")


@query(f"WITH {_HYBRID_SQL}, {_RERANK_SQL} SELECT query_id, id, rerank_score, rank::INT AS rank FROM top")
def rerank_topk(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "id", "rerank_score", "rank")


@query(f"WITH {_HYBRID_SQL}, {_RERANK_SQL} SELECT query_id, contexts, list_aggregate(list_transform(contexts, lambda c: substring(c, 1, 2000)), 'string_agg', chr(10) || '---' || chr(10)) AS local_context FROM ctx")
def context_assembly(spark, sf_dir):
    return answer.contexts(_reranked(spark, sf_dir)).withColumn("local_context", X.local_context(F.col("contexts")))


_ANSWER_SQL = f"""WITH {_HYBRID_SQL}, {_RERANK_SQL},
answers AS (SELECT query_id, query, coalesce(contexts, []) AS contexts,
  'Answer based on contexts.' || chr(10) || '    GLOBAL: ' || chr(10) || '    LOCAL: ' || coalesce(list_aggregate(list_transform(contexts, lambda c: substring(c, 1, 2000)), 'string_agg', chr(10) || '---' || chr(10)), '')
  || chr(10) || '    Query: ' || query AS prompt,
  'Based on ' || len(coalesce(contexts, []))::VARCHAR || ' contexts: ' || substring(coalesce(contexts[1], ''), 1, 80) AS answer
  FROM q JOIN qv USING (query_id) LEFT JOIN ctx USING (query_id))"""


def _answers(spark, sf_dir) -> DataFrame:
    queries = _vectors(spark, sf_dir)
    found = answer.contexts(_reranked(spark, sf_dir))
    rows = queries.join(found, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return answer.template_answer(rows.withColumn("prompt", X.answer_prompt(F.col("query"), F.col("contexts")))).select("query_id", "query", "contexts", "prompt", "answer")


@query(_ANSWER_SQL + " SELECT query_id, prompt FROM answers")
def answer_prompt(spark, sf_dir):
    return _answers(spark, sf_dir).select("query_id", "prompt")


@query(_ANSWER_SQL + " SELECT query_id, answer FROM answers")
def llm_answer(spark, sf_dir):
    return _answers(spark, sf_dir).select("query_id", "answer")


@query(f"SELECT conv_id, turn, (coalesce(length(regexp_replace(CASE WHEN turn % 3 = 0 THEN chr(160) || ' ' || chr(10) WHEN turn % 7 = 1 THEN NULL ELSE text END, '[{C.SPACE}]+', '', 'g')), 0) = 0) AS blank FROM conversations")
def blank_query_guard(spark, sf_dir):
    asked = F.when(F.col("turn") % 3 == 0, "  \n").when(F.col("turn") % 7 == 1, F.lit(None)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_blank(asked).alias("blank"))


# --- incremental upkeep -----------------------------------------------------------------------

_INGEST_SQL = f"{C.CHUNKS_SQL}, {C.MANIFEST_SQL}, {C.COLLECTION_SQL}"
_DELTA_SQL = "delta AS (SELECT c.* FROM chunks c LEFT JOIN manifest m ON m.pdf_name = c.pdf_name WHERE m.file_hash IS NULL OR m.file_hash <> c.file_hash)"


def _state(spark, sf_dir):
    rows = C.chunks(spark, sf_dir)
    return rows, C.manifest(spark, rows), C.collection(rows)


@query(f"WITH {_INGEST_SQL}, {_DELTA_SQL} SELECT id, pdf_name, file_hash FROM delta")
def ingest_delta(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    return ingest.delta(rows, known).select("id", "pdf_name", "file_hash")


@query(f"WITH {_INGEST_SQL} SELECT DISTINCT id FROM collection EXCEPT SELECT id FROM chunks")
def stale_ids(spark, sf_dir):
    rows, _, held = _state(spark, sf_dir)
    return ingest.stale_ids(held, rows)


@query(f"WITH {_INGEST_SQL}, {_DELTA_SQL} SELECT id, source FROM collection WHERE source IN (SELECT pdf_name FROM delta) AND id NOT IN (SELECT id FROM delta)")
def stale_rows(spark, sf_dir):
    rows, known, held = _state(spark, sf_dir)
    return ingest.stale_rows(held, ingest.delta(rows, known)).select("id", F.col("metadata.source").alias("source"))


@query(f"WITH {_INGEST_SQL} SELECT DISTINCT pdf_name FROM manifest WHERE pdf_name NOT IN (SELECT pdf_name FROM chunks)")
def removed_books(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    return ingest.removed_documents(known, rows)


_VALID_SQL = "valid AS (SELECT DISTINCT pdf_name AS source FROM chunks WHERE ordinal % 1000 <> 0)"


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where("ordinal % 1000 <> 0").select(F.col("pdf_name").alias("source")).distinct()


@query(f"WITH {_INGEST_SQL}, {_VALID_SQL} SELECT id FROM collection c WHERE source IS NULL OR source NOT IN (SELECT source FROM valid)")
def orphan_ids(spark, sf_dir):
    rows, _, held = _state(spark, sf_dir)
    return ingest.orphans(held, _valid(rows)).select("id")


@query(f"WITH {_INGEST_SQL}, {_VALID_SQL} SELECT id, source FROM collection WHERE source IN (SELECT source FROM valid)")
def purge_result(spark, sf_dir):
    rows, _, held = _state(spark, sf_dir)
    return ingest.purge(held, _valid(rows)).select("id", F.col("metadata.source").alias("source"))


@query(f"WITH {_INGEST_SQL}, {_DELTA_SQL} SELECT id, document, source FROM collection WHERE id NOT IN (SELECT id FROM delta) UNION ALL SELECT id, text, pdf_name FROM delta")
def upsert_merge(spark, sf_dir):
    rows, known, held = _state(spark, sf_dir)
    new = ingest.delta(rows, known).select("id", F.col("text").alias("document"), F.struct(F.col("pdf_name").alias("source")).alias("metadata"))
    return ingest.upsert(held.select("id", "document", "metadata"), new).select("id", "document", F.col("metadata.source").alias("source"))


_UPDATES_SQL = "updates AS (SELECT pdf_name, max(file_hash) AS file_hash FROM chunks GROUP BY pdf_name HAVING min(ordinal) % 2 = 0)"


@query(f"WITH {_INGEST_SQL}, {_UPDATES_SQL} SELECT pdf_name, file_hash FROM manifest WHERE pdf_name NOT IN (SELECT pdf_name FROM updates) UNION ALL SELECT * FROM updates")
def manifest_upsert(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    updates = rows.groupBy("pdf_name").agg(F.max("file_hash").alias("file_hash"), F.min("ordinal").alias("o")).where("o % 2 = 0").drop("o")
    return ingest.manifest_upsert(known, updates)


@query(f"WITH {_INGEST_SQL} SELECT pdf_name, file_hash FROM manifest WHERE pdf_name NOT LIKE 'gone%'")
def manifest_remove(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    return ingest.manifest_remove(known, ingest.removed_documents(known, rows))


@query(f"WITH {_INGEST_SQL} SELECT count(*) AS removed FROM manifest WHERE pdf_name LIKE 'gone%'")
def manifest_remove_count(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    return ingest.removed_count(known, ingest.removed_documents(known, rows))


_COMMIT_SQL = f"""WITH {_INGEST_SQL}, {_DELTA_SQL},
failed AS (SELECT DISTINCT pdf_name FROM chunks WHERE ordinal // 50 IN (SELECT ordinal // 50 FROM chunks WHERE ordinal % 900 = 1)),
done AS (SELECT pdf_name, arg_min(file_hash, ordinal) AS file_hash FROM delta WHERE file_hash <> '' AND pdf_name NOT IN (SELECT pdf_name FROM failed) GROUP BY pdf_name)
SELECT pdf_name, file_hash FROM manifest WHERE pdf_name NOT LIKE 'gone%' AND pdf_name NOT IN (SELECT pdf_name FROM done) UNION ALL SELECT * FROM done"""


@query(_COMMIT_SQL)
def manifest_commit_on_success(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    batched = ingest.upsert_batches(rows)
    failed = ingest.failed_documents(batched, batched.where("ordinal % 900 = 1").select("batch_no").distinct())
    return ingest.committed(known, ingest.delta(rows, known), failed, ingest.removed_documents(known, rows))


@query(f"""WITH {_INGEST_SQL},
todo AS (SELECT f.pdf_name FROM (SELECT pdf_name, arg_min(file_hash, ordinal) AS h FROM chunks GROUP BY pdf_name) f LEFT JOIN manifest m USING (pdf_name) WHERE m.file_hash IS NULL OR m.file_hash <> f.h),
b AS (SELECT *, (row_number() OVER (PARTITION BY pdf_name ORDER BY page_number, id) - 1) // 20 AS batch_no FROM chunks WHERE pdf_name IN (SELECT pdf_name FROM todo))
SELECT pdf_name, batch_no, string_agg(text, chr(10) ORDER BY page_number, id) AS batch_text, arg_min(file_hash, page_number) AS file_hash FROM b GROUP BY pdf_name, batch_no""")
def graph_batches_20(spark, sf_dir):
    rows, known, _ = _state(spark, sf_dir)
    return ingest.graph_batches(rows, known)


_GRAPH_SQL = f"""WITH {_INGEST_SQL},
todo AS (SELECT f.pdf_name FROM (SELECT pdf_name, arg_min(file_hash, ordinal) AS h FROM chunks GROUP BY pdf_name) f LEFT JOIN manifest m USING (pdf_name) WHERE m.file_hash IS NULL OR m.file_hash <> f.h),
b AS (SELECT DISTINCT pdf_name, (row_number() OVER (PARTITION BY pdf_name ORDER BY page_number, id) - 1) // 20 AS batch_no FROM chunks WHERE pdf_name IN (SELECT pdf_name FROM todo)),
f AS (SELECT *, (length(pdf_name) + batch_no) % 3 = 2 AS bad FROM b)
SELECT pdf_name, batch_no, NOT bad AS ok FROM f WHERE batch_no <= coalesce((SELECT min(batch_no) FROM f g WHERE g.pdf_name = f.pdf_name AND g.bad), batch_no)"""


@query(_GRAPH_SQL)
def graph_insert(spark, sf_dir):
    """A sink that refuses some batches: a document ends at its first failure."""

    def sink():
        def put(name: str, number: int, text: str) -> None:
            if (len(name) + number) % 3 == 2:
                raise ValueError("refused")

        return put

    rows, known, _ = _state(spark, sf_dir)
    return graphstore.insert(ingest.graph_batches(rows, known), sink).select("pdf_name", "batch_no", "ok")


# --- evaluation, operations -------------------------------------------------------------------


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_QA_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(q)}, {_literal(g)})" for i, (q, g) in enumerate(zip(evaluate.QUESTIONS, evaluate.GROUND_TRUTHS))) + ") t(qid, question, ground_truth)"


@query(_QA_SQL)
def qa_table(spark, sf_dir):
    return evaluate.qa_table(spark)


def _dataset(spark, sf_dir) -> DataFrame:
    return evaluate.dataset(_answers(spark, sf_dir).select(F.col("query_id").alias("qid"), "answer", "contexts"), evaluate.qa_table(spark))


_DATASET_SQL = f"{_ANSWER_SQL}, ds AS (SELECT qid, question, answer, contexts, ground_truth FROM ({_QA_SQL}) JOIN answers ON query_id = qid)"


@query(_DATASET_SQL + " SELECT * FROM ds")
def eval_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir)


def _share_sql(part: str, whole: str) -> str:
    p = f"list_distinct({_TOK.format(t=part)})"
    return f"round(CASE WHEN len({p}) = 0 THEN 0 ELSE len(list_intersect({p}, list_distinct({_TOK.format(t=whole)}))) / len({p}) END, 6)"


@query(_DATASET_SQL + f""" SELECT qid, {_share_sql("answer", "held")} AS faithfulness_proxy, {_share_sql("question", "answer")} AS answer_relevancy_proxy,
 {_share_sql("held", "ground_truth")} AS context_precision_proxy, {_share_sql("ground_truth", "held")} AS context_recall_proxy
FROM (SELECT *, array_to_string(contexts, chr(10)) AS held FROM ds)""")
def eval_proxy_metrics(spark, sf_dir):
    return evaluate.lexical_proxies(_dataset(spark, sf_dir))


@query("SELECT count(*) AS orphans FROM range(20000) t(i) WHERE i % 120 >= 100")
def benchmark_orphans(spark, sf_dir):
    name = lambda n: F.concat(F.lit("book-"), (F.col("id") % n).cast("string"), F.lit(".pdf"))
    held = spark.range(20_000).select(F.col("id"), F.struct(name(120).alias("source")).alias("metadata"))
    valid = spark.range(100).select(name(100).alias("source"))
    return ingest.orphans(held, valid).agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT count(DISTINCT i % 100) AS books FROM range(20000) t(i)")
def benchmark_groups(spark, sf_dir):
    made = F.concat(F.lit("book-"), (F.col("id") % 100).cast("string"), F.lit(".pdf"))
    rows = spark.range(20_000).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("id"), made.alias("pdf_name"))
    return chunks.ids_by_document(rows).agg(F.count(F.lit(1)).alias("books"))


_REQUIRED, _FORBIDDEN = (("<article>", "<main>"), ("<h1>",)), ("!!", "<iframe")


@query("""SELECT page_id, missing_groups, forbidden_found, missing_groups = 0 AND forbidden_found = 0 AS passed FROM (
SELECT page_id, (CASE WHEN contains(html, '<article>') OR contains(html, '<main>') THEN 0 ELSE 1 END + CASE WHEN contains(html, '<h1>') THEN 0 ELSE 1 END)::INT AS missing_groups,
       (CASE WHEN contains(html, '!!') THEN 1 ELSE 0 END + CASE WHEN contains(html, '<iframe') THEN 1 ELSE 0 END)::INT AS forbidden_found FROM pages)""")
def pattern_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "pages"), _REQUIRED, _FORBIDDEN, "html").select("page_id", "missing_groups", "forbidden_found", "passed")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Additional to the reference's operators: the streaming aggregation, over a table."""
    return event_counts(table(spark, sf_dir, "events")).withColumn("total", F.col("total"))
