import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import exact_dedup as X

DIGESTS = {"whole": X.sha256_hex, "one for all": lambda t: F.lit("x"), "one digit": lambda t: F.substring(X.sha256_hex(t), 1, 1)}


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest", list(DIGESTS))
def test_groups(spark, documents, odd, keep, digest):
    """Byte verification tells texts of equal digests apart."""
    for df in (documents, odd):
        ids = defaultdict(list)
        for r in df.collect():
            ids[r.text or ""].append(r.doc_id)
        best = {t: {"min": min, "max": max}[keep]([i for i in x if i is not None], default=None) for t, x in ids.items()}
        given = sorted(str((i, best[t], len(x), i == best[t])) for t, x in ids.items() for i in x)
        found = X.exact_groups(df, keep, digest=DIGESTS[digest]).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(str(tuple(r)) for r in found) == given


@pytest.mark.parametrize("digest", list(DIGESTS))
def test_keep_one(odd, empty, digest):
    odd = odd.withColumnRenamed("lang", "digest").withColumnRenamed("source", "keep_id")
    kept = X.keep_one(odd, "min", digest=DIGESTS[digest])
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 3 4 6 7 8 9 10 None".split())
    assert X.keep_one(empty).collect() == [] and X.exact_groups(empty).collect() == []


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id DIV 2) END AS text")
    found = X.exact_groups(df, "max")
    assert found.count() == 3000
    assert {(r.keep_id, r.group_size) for r in found.where("doc_id % 3 = 0").collect()} == {(2997, 1000)}


def test_runs_are_sorted_and_merge(spark, documents):
    index = X.DigestIndex(spark)
    index.ingest(documents)
    index.ingest(documents.where("doc_id < 50"))
    level1 = index.compact("min")
    assert level1.agg(F.sum("n")).first()[0] == documents.count() + 50
    assert level1.count() == documents.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_native(documents):
    plan = X.exact_groups(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_lookup_of_few_digests(spark, documents, tmp_path):
    """Runs of several ingests are probed by equality filters that reach the scan."""
    index = X.DigestIndex(spark, f"file://{tmp_path}/index")
    index.ingest(documents.where("doc_id % 2 = 0"))
    index.ingest(documents.where("doc_id % 2 = 1"))
    rows = documents.select("doc_id", X.sha256_hex(F.coalesce("text", F.lit(""))).alias("digest")).collect()
    wanted = {r.digest for r in rows[:3]}
    found = index.lookup(sorted(wanted))
    assert sorted(r.id for r in found.collect()) == sorted(r.doc_id for r in rows if r.digest in wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(digest" in plan and "Exchange" not in plan
    merged = {r.digest: (r.keep_id, r.n) for r in index.compact("max").collect()}
    for d in wanted:
        own = [r.doc_id for r in rows if r.digest == d]
        assert merged[d] == (max(own), len(own))
