import re
from collections import Counter

import pytest

from spindrift.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    t = text or ""
    w = re.findall(WORD, t)
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("few", [0, 48])
def test_measurements(spark, documents, odd, few, monkeypatch):
    if not few:  # the sorting way, whatever repeats
        monkeypatch.setattr(Q, "_COUNT_REPEATS", Q._COUNT_REPEATS.replace("size(r) <= 48", "size(r) <= 0"))
    for df in (documents, odd):
        given = Counter((r.doc_id, *plain(r.text)) for r in df.collect())
        found = Q.measure(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, found)) == given


def test_policies_and_ablation(spark):
    good = " ".join(f"Word{i} and" for i in range(60))
    texts = [good, "short", "a b c " * 40, good.replace("and", "###"), good.upper(), "\n".join(["some words here"] * 9 + [good]), "x" * 999 + " " + good]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in Q.quality_filter(df).collect()}
    assert [rows[i].kept for i in range(7)] == [True, False, False, False, False, False, True]
    assert [rows[i].base_failed for i in range(7)] == [False, True, True, False, False, False, False]
    assert rows[3].failed_rules == 4 and rows[4].failed_rules == 16
    table = {r.rule: r for r in Q.ablation(Q.ledger(Q.measure(df)), Q.POLICIES["v1"]).collect()}
    assert (table["symbols"].n_failed, table["symbols"].n_only, table["symbols"].n_docs) == (1, 1, 7)
    base = Q.apply_policy(Q.ledger(Q.measure(df)), Q.POLICIES["base"])
    assert base.where("kept").count() == 5


def test_rows_keep_their_columns(spark, odd, empty):
    kept = Q.keep_rows(odd.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept"))
    assert kept.columns == ["doc_id", "text", "n_words", "kept", "n_chars"]
    assert Q.keep_rows(empty).collect() == [] and Q.quality_filter(empty).collect() == []


def test_native(documents):
    plan = Q.quality_filter(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
