"""Every registered query against its SQL oracle on the smallest dataset."""

import glob
import os

import duckdb
import pytest

from spindrift.plans import stores  # noqa: F401
from spindrift.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    oracle = duck.sql(ORACLE_SQL[name])
    assert sorted(oracle.columns) == columns
    at = [oracle.columns.index(c) for c in columns]
    assert found == sorted(str([plain(r[i]) for i in at]) for r in oracle.fetchall())


def test_plans(spark):
    """Columns are pruned, filters reach the scan, top-k is cut before the shuffle."""

    def plan(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan("pattern_audit")
    assert "PushedFilters" in plan("orphan_ids")
    assert "TakeOrderedAndProject" in plan("topk_desc")
    assert "WindowGroupLimit" in plan("dense_topk_l2")


def test_pages_are_cleaned_once(spark):
    """However many columns read the clean text, its patterns stand in the plan once."""
    for name in ("chunk_table", "garble_policy", "page_quality_stats"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("regexp_replace") <= 6 and plan.count("btrim") + plan.count("BOTH") <= 1, plan


def test_bm25_moves_no_documents(spark):
    """Neither tokens nor documents are shuffled for scores; few queries are cut before any shuffle."""
    from pyspark.sql import functions as F

    from spindrift.operators import lexical

    index = lexical.build_index(spark.read.parquet(f"{SF}/documents.parquet"), doc_id="doc_id")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    many = lexical.query_terms(queries)
    few = lexical.query_terms(queries.where("query_id < 5"))
    assert few.count() <= lexical.IN_ROW_TERMS < many.count()
    scores = lexical.bm25_scores(index, few)
    whole = {(r.query_id, r.id): r.score for r in lexical.bm25_scores(index, many).where("query_id < 5").collect()}
    assert {(r.query_id, r.id): r.score for r in scores.collect()} == pytest.approx(whole, abs=2e-6) and whole
    plan = lexical.bm25_topk(index, queries.where("query_id < 5"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
