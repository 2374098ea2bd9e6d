"""The contract queries of this subpackage and the SQL oracles of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, exact_dedup, html, langid, line_dedup, lm, minhash, mixing, quality, suffix_dedup
from spindrift.session import table

#: Words of the contracts, as DuckDB regular expressions.
_WORD = r"[^\x20\x09-\x0D]+"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest doc_id stays."""
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return found.withColumnRenamed("digest", "text_sha256")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all documents: 4-word shingles, similarity 0.8."""
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 400-byte strings, and where it shares passages of
    50 words with a different text."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "passage_words",
    )


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture by tempered source weights."""
    return mixing.mix_tempered(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; a seventh of them is held out."""
    return lm.score(table(spark, sf_dir, "documents"), lm.fold(7, 2))


def word_vocabulary() -> str:
    """The vocabulary file of the contract; other files go to the operator by their own path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded strings of every document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_rows(docs, word_vocabulary()).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every document under policy v1."""
    return quality.quality_filter(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when one line of each class of near-equal lines stays."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_linked", F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of them is held out of training."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, lm.fold(4, 2)))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_minhash": op2_minhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_lm": op5_lm,
    "op6_bpe": op6_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_langid": op10_langid,
    "op7_html": op7_html,
    "op8_quality_rules": op8_quality_rules,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT k, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM d),
p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals
      FROM s LEFT JOIN r USING (k)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 5 * n_dup_lines > 2 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 16 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_rules FROM m)
SELECT *, failed_rules = 0 AS kept, failed_rules & 3 <> 0 AS base_failed FROM f
""",
}
