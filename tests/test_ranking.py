import itertools
import math
import random
from collections import Counter

import pytest

from spindrift.operators import answer, dense, evaluate, fusion, lexical

TOY = [("d1", "Risk is 5% of the $ budget."), ("d2", "The risk of the market"), ("d3", "Market maker spread"), ("d4", "the trend, the risk")]


@pytest.mark.parametrize("values, k, expected", [([0.1, 4.2, 1.0, 8.7, 2.5], 3, [3, 1, 4]), ([], 5, []), ([1.0, 1.0], 1, [0]), ([1.0], 0, []), ([1.0], 9, [0])])
def test_top_k(spark, values, k, expected):
    df = spark.createDataFrame(list(enumerate(values)), "ordinal int, value double")
    assert [r.ordinal for r in fusion.top_k(df, k).collect()] == expected


@pytest.mark.parametrize(
    "query, scores",
    [
        ("market risk", {"d1": 0.079366, "d2": 0.094056, "d4": 0.103648, "d3": 0.0}),
        ("risk risk", {"d1": 0.158733, "d2": 0.188112, "d4": 0.207297}),
        ("zzz", {}),
        ("a $", {"d1": 0.698423}),
    ],
)
def test_bm25_worked_values(spark, query, scores):
    index = lexical.build_index(spark.createDataFrame(TOY, "id string, text string"))
    terms = lexical.query_terms(spark.createDataFrame([(1, query)], "query_id int, query string"))
    found = {r.id: r.score for r in lexical.bm25_scores(index, terms).collect()}
    assert found == {**scores, **({"d3": 0.0} if "market" in query else {})}


def test_bm25_padding(spark):
    index = lexical.build_index(spark.createDataFrame(TOY, "id string, text string"))
    queries = spark.createDataFrame([(1, "zzz"), (2, "$")], "query_id int, query string")
    found = {(r.query_id, r["rank"]): r.id for r in lexical.bm25_topk(index, queries, 3).collect()}
    assert found == {(1, 0): "d1", (1, 1): "d2", (1, 2): "d3", (2, 0): "d1", (2, 1): "d2", (2, 2): "d3"}
    empty = lexical.build_index(spark.createDataFrame([], "id string, text string"))
    assert lexical.bm25_topk(empty, queries, 3).collect() == []


def test_bm25_against_plain_python(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    tokens = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for x in tokens.values() for t in set(x))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: eps if v < 0 else v for t, v in raw.items()}
    query = ["aa", "bb", "bb", "zz"]
    plain = {i: sum(idf.get(q, 0) * x.count(q) * 2.5 / (x.count(q) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for q in query) for i, x in tokens.items()}
    ranked = sorted(plain, key=lambda i: (-round(plain[i], 6), i))[:15]
    index = lexical.build_index(spark.createDataFrame(docs, "id int, text string"))
    found = lexical.bm25_topk(index, spark.createDataFrame([(1, "aa bb bb zz")], "query_id int, query string"), 15).orderBy("rank").collect()
    assert [x.id for x in found] == ranked
    assert all(abs(x.score - plain[x.id]) < 1e-5 for x in found)


def _words(seed, count, vocabulary, longest):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, longest)))) for i in range(count)]


def _plain(docs, queries):
    """BM25 scores of documents with a query term, in exact sums of parts."""
    tokens = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for x in tokens.values() for t in set(x))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: eps if v < 0 else v for t, v in raw.items()}
    scores = {}
    for q, text in queries:
        for i, x in tokens.items():
            parts = [m * idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t, m in Counter(text.split()).items() if t in x]
            if parts:
                scores[q, i] = round(sum(round(p, 9) for p in parts), 6)
    return scores


@pytest.mark.parametrize("common", [False, True])  # with common terms alone, scores are below 0
def test_many_queries_move_no_scores(spark, common):
    """Beyond IN_ROW_TERMS too, scores are made where documents are, in one pass, and padding is part of it."""
    words = ["".join(p) for p in itertools.product("abcdef", repeat=2)]
    docs = _words(1, 150, words[:4] if common else words, 40 if common else 12)
    queries = _words(2, 120, words[:8] if common else words, 9)
    index = lexical.build_index(spark.createDataFrame(docs, "id int, text string").repartition(5))
    asked = spark.createDataFrame(queries, "query_id int, query string")
    terms = lexical.query_terms(asked)
    assert terms.count() > lexical.IN_ROW_TERMS
    scores = lexical.bm25_scores(index, terms)
    expected = _plain(docs, queries)
    assert (min(expected.values()) < 0) is common
    found = {(r.query_id, r.id): r.score for r in scores.collect()}
    assert found == pytest.approx(expected, abs=1.1e-6) and len(found) == len(expected)
    top = lexical.bm25_topk(index, asked, 7)
    ranks = {(r.query_id, r["rank"]): (r.id, r.score) for r in top.collect()}
    for q, _ in queries:
        ordered = sorted((i for i, _ in docs), key=lambda i: (-found.get((q, i), 0.0), i))[:7]
        assert [ranks[q, n] for n in range(7)] == [(i, found.get((q, i), 0.0)) for i in ordered]
    assert len(ranks) == 7 * len(queries)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "LeftAnti" not in plan and "Join" not in plan


def test_scores_in_small_tables(monkeypatch):
    """Tables of few cells, null ids, ties and batches give the same as one table."""
    import pyarrow as pa

    docs = [("b", ["x"]), (None, ["x"]), ("a", ["x", "x", "y"]), ("d", []), ("c", ["y"]), ("e", ["x"])]
    tf = [[{"term": t, "tf": n} for t, n in Counter(w).items()] for _, w in docs]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([len(w) for _, w in docs]), pa.array(tf, kind)], ["id", "dl", "tf"])
    weighted = pa.table({"query_id": [1, 2, 1], "term": ["x", "y", "y"], "weight": [1.0, 2.0, 0.5]})
    block = lexical._Block(pa.array([1, 2, 3]), weighted, 1.5)
    rows = lambda run, *batches: [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]
    order = lambda r: (r[0], -r[2], r[1] is not None, r[1] or "")
    every, first = rows(lexical._Scorer(block).all(6), batch), rows(lexical._Scorer(block).first(3, 6), batch)
    assert len(every) == 5 + 2 and first == sorted(first, key=order) and len(first) == 9
    assert [r[1] for r in first if r[0] == 1] == ["a", None, "b"] and [r[1:] for r in first if r[0] == 3] == [(None, 0.0), ("a", 0.0), ("b", 0.0)]
    monkeypatch.setattr(lexical, "SCORES", 1)
    parts = [batch.slice(0, 2), batch.slice(2, 1), batch.slice(3, 3)]
    assert sorted(rows(lexical._Scorer(block).all(6), *parts), key=order) == sorted(every, key=order)
    assert rows(lexical._Scorer(block).first(3, 6), *parts) == first


def test_term_counts_are_made_in_batches(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (4, ["ü", "b"])]
    made = lexical.term_counts(spark.createDataFrame(rows, "id int, tokens array<string>"))
    assert {r.id: (r.dl, {(t.term, t.tf) for t in r.tf}) for r in made.collect()} == {i: (len(t), set(Counter(t).items())) for i, t in rows}
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_fetch_leaves_documents_where_they_are(spark):
    """Few candidates go to the documents, whatever the optimizer takes their number for."""
    documents = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id int, document string")
    queries = spark.createDataFrame([(7, "q")], "query_id int, query string")
    candidates = spark.createDataFrame([(7, 2, 0), (7, 9, 1)], "query_id int, id int, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = answer.fetch(candidates, documents, queries)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert [(r.query_id, r.id, r.document) for r in found.collect()] == [(7, 2, "two")]


def test_dense(spark):
    space = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 4.0]), (4, [1.0, 0.0])], "id int, embedding array<float>")
    found = dense.dense_topk(spark.createDataFrame([(7, [0.0, 0.0])], "query_id int, vector array<float>"), space, 3).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in found] == [(1, 0.0), (2, 1.0), (4, 1.0)]


def test_rrf_and_ties(spark):
    near = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    words = spark.createDataFrame([(1, "c", 0), (1, "a", 1), (1, "x", 2)], "query_id int, id string, rank int")
    found = fusion.fused_candidates(fusion.rrf(near, words), 4).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [("a", 0.032522475), ("c", 0.032266458), ("b", 0.016129032), ("x", 0.015873016)]
    tie = fusion.rrf(near.limit(0).unionByName(spark.createDataFrame([(1, "p", 0)], near.schema)), spark.createDataFrame([(1, "q", 0)], near.schema))
    assert [r.id for r in fusion.fused_candidates(tie, 2).orderBy("rank").collect()] == ["p", "q"]


def test_answer_end_to_end(spark):
    space = spark.createDataFrame([("a", "doc a", [0.0]), ("b", "doc b", [1.0])], "id string, document string, embedding array<float>")
    queries = spark.createDataFrame([(1, "query", [0.0]), (2, " ", [0.0])], "query_id int, query string, vector array<float>")
    prefers_b = answer.model_score(lambda: lambda pairs, size: [0.9 if d == "doc b" else 0.1 for _, d in pairs])
    says = answer.model_answer(lambda: lambda prompt: "answer text")
    found = {r.query_id: r for r in answer.answer(queries, space, None, final_k=1, score=prefers_b, generate=says).collect()}
    assert (found[1].answer, found[1].contexts) == ("answer text", ["doc b"])
    assert (found[2].answer, found[2].contexts) == ("Empty Query", [])

    def broken():
        def call(prompt):
            raise ValueError("down")

        return call

    failed = answer.answer(queries.where("query_id = 1"), space, None, final_k=1, generate=answer.model_answer(broken)).first()
    assert failed.answer == "Gen Error: down" and failed.contexts == ["doc a"]


def test_evaluation(spark):
    assert len(evaluate.QUESTIONS) == len(evaluate.GROUND_TRUTHS) == evaluate.qa_table(spark).count() == 30
    truths = spark.createDataFrame([(1, "q one", "alpha beta"), (2, "q two", "gamma")], "qid int, question string, ground_truth string")
    answers = lambda q: q.selectExpr("query_id", "'alpha' AS answer", "array('alpha beta') AS contexts")
    found = evaluate.run(truths.selectExpr("qid AS query_id"), truths, answers).orderBy("qid").collect()
    assert [tuple(r) for r in found] == [(1, 1.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 0.0, 0.0)]
