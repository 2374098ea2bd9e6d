"""Quality rules as a bitmask ledger (DataFrame and SQL functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; policies are versioned bit masks that are applied to the ledger afterwards, so a new
policy or an ablation never touches the texts again.

Defined results: a null text measures as an empty one; a null ``doc_id`` is kept as null; repeated
rows give repeated ledger rows; an empty table gives an empty ledger; columns of the input that
the ledger also has are ignored, apart from the two that are named as arguments.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as SQL string escapes.
WHITE = r" \t\n\u000B\f\r"
#: Up to so many distinct repeated windows of a text are looked up one by one; beyond that the
#: windows are sorted. Both give the same count.
FEW = 48


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements of the ledger."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...] = field(default=())


RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 5 * n_dup_lines > 2 * n_lines"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
POLICIES = {
    "base": Policy("base", ("too_short", "repeated_words")),
    "v1": Policy("v1", tuple(r.name for r in RULES)),
}


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The policy's rules as bits; rule i is bit i."""
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[name] for name in policy.rules)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once a row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Words in 3-word windows that occur twice or more, from the array ``words``. Sorted window hashes
#: show which windows repeat; their positions are then looked up, or sorted along where many repeat.
_HASHES = "transform(sequence(0, n_words - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))"
_REPEATED = "array_distinct(filter(s, (x, i) -> i > 0 AND x = get(s, i - 1)))"
_COVER = "CAST(size(array_distinct(flatten(transform({starts}, i -> array(i, i + 1, i + 2))))) AS BIGINT)"
_BY_LOOKUP = _COVER.format(starts="filter(sequence(0, n_words - 3), i -> array_contains(r, get(h, i)))")
_PAIRS = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
_BY_SORT = _let(
    _PAIRS,
    "p",
    _COVER.format(starts="transform(filter(p, (a, k) -> a.x = get(p, k - 1).x OR a.x = get(p, k + 1).x), a -> a.i)"),
)
_COUNT_REPEATS = _let(
    _let("sort_array(h)", "s", _REPEATED),
    "r",
    f"CASE WHEN size(r) = 0 THEN 0L WHEN size(r) <= {FEW} THEN {_BY_LOOKUP} ELSE {_BY_SORT} END",
)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measurements per document; texts are read once and never moved.

    The observed row count also keeps later filters above the measurements: pushed below, they would
    evaluate them again inside their own lambdas, which takes time quadratic in a text's length.
    """
    spaced = F.coalesce(F.col(text), F.lit(""))
    for white in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(white), F.lit(" "))
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.array_remove(F.split(spaced, " "), "").alias("words"),
    ).withColumn("n_words", F.expr("CAST(size(words) AS BIGINT)"))
    lines = F.expr(rf"filter(split(text, '\n'), l -> btrim(l, '{WHITE}') <> '')")
    hashed = split.select(
        "doc_id",
        "n_words",
        F.expr("CAST(length(array_join(words, '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(r"CAST(length(regexp_replace(text, '\\P{Lu}+', '')) AS BIGINT)").alias("n_capitals"),
        lines.alias("lines"),
        F.expr(f"CASE WHEN n_words >= 3 THEN {_HASHES} ELSE array() END").alias("h"),
    )
    return hashed.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(_COUNT_REPEATS).alias("n_repeat_words"),
        F.expr("CAST(size(lines) AS BIGINT)").alias("n_lines"),
        "n_capitals",
    ).observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("measured"))


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``failed_rules``, a bit per failed rule."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i}L ELSE 0L END" for i, r in enumerate(rules))
    return measured.withColumn("failed_rules", F.expr(bits or "0L"))


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept``: none of the policy's rules failed."""
    return entries.withColumn("kept", F.expr(f"failed_rules & {mask(policy, rules)}L = 0"))


def ablation(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents it rejects, and those it alone rejects.

    One aggregation over distinct masks serves all rules: (rule, version, n_failed, n_only, n_docs).
    """
    whole = mask(policy, rules)
    masks = entries.groupBy(F.expr(f"failed_rules & {whole}L").alias("m")).count()
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules])
    return (
        masks.select("m", "count", F.explode(named).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.expr("CASE WHEN m & r.bit <> 0 THEN count ELSE 0 END")).alias("n_failed"),
            F.sum(F.expr("CASE WHEN m = r.bit THEN count ELSE 0 END")).alias("n_only"),
            F.sum("count").alias("n_docs"),
        )
        .withColumn("version", F.lit(policy.version))
    )


def quality_filter(docs: DataFrame, policy: Policy = POLICIES["v1"], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger under ``policy``, with ``base_failed`` for the two base rules."""
    entries = apply_policy(ledger(measure(docs, doc_id, text)), policy)
    base = mask(POLICIES["base"])
    return entries.withColumn("base_failed", F.expr(f"failed_rules & {base}L <> 0")).withColumn("kept", F.expr("kept AND NOT base_failed"))


def keep_rows(docs: DataFrame, policy: Policy = POLICIES["v1"], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were.

    The verdict is computed beside the row it belongs to, so that nothing is joined or moved.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = quality_filter(docs.select(whole.alias("row"), F.col(f"`{text}`").alias("text")), policy, "row", "text")
    return judged.where("kept").select("doc_id.*")
