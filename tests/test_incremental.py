import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import audit, chunks, enrichment, ingest
from spindrift.sources.store import SnapshotStore

CHUNK = "id string, text string, pdf_name string, file_hash string, pipeline_version string, page_number int, ordinal int"


def made(spark, *items):
    return spark.createDataFrame([(f"{p}::p{n}::i0", f"text {n}", p, h, v, n, i) for i, (p, n, h, v) in enumerate(items)], CHUNK)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def pages(spark, *texts):
    rows = [("a.pdf", i + 1, t, "h", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pdf_name string, page_number int, raw_text string, file_hash string, pdf_path string")


def test_page_policy(spark):
    junk = chr(0xE000)
    given = pages(spark, "x" * 99, "x" * 100, junk * 60 + "x" * 60, junk * 1000 + "x" * 1000, junk * 1001 + "x" * 1000, junk * 40 + "x" * 60, None)
    found = {r.page_number: r.verdict for r in chunks.judged_pages(given).collect()}
    assert found == {1: "short", 2: "kept", 3: "dropped_garbled", 4: "dropped_garbled", 5: "kept_garbled", 6: "kept", 7: "short"}
    stats = chunks.page_stats(chunks.judged_pages(given)).first()
    assert (stats.total, stats.kept, stats.dropped_garbled, stats.kept_garbled, stats.short) == (7, 3, 2, 1, 2)
    table = {r.id: r for r in chunks.chunk_table(given).collect()}
    assert sorted(table) == ["a.pdf::p2::i0", "a.pdf::p5::i0", "a.pdf::p6::i0"]
    assert table["a.pdf::p5::i0"].is_garbled and table["a.pdf::p5::i0"].char_count == 2001 and not table["a.pdf::p6::i0"].is_garbled


def test_state_and_skip(spark):
    rows = made(spark, ("a", 1, "h", "1.1"), ("a", 2, "h", "1.1"), ("b", 1, "h", "1.1"), ("b", 2, "x", "1.1"), ("c", 1, "h", "1.0"))
    state = chunks.consistent_state(rows)
    assert sorted(r.pdf_name for r in state.collect()) == ["a", "c"]
    files = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h"), ("e", "")], "pdf_name string, file_hash string")
    assert sorted(r.pdf_name for r in chunks.files_to_process(files, state).collect()) == ["b", "c", "d", "e"]


def test_sync_keeps_documents_without_new_chunks(spark):
    old = made(spark, ("a", 1, "h", "1.1"), ("a", 2, "h", "1.1"), ("b", 1, "h", "1.1"))
    new = made(spark, ("a", 1, "n", "1.1"), ("c", 1, "n", "1.1"))
    merged = chunks.sync_master(old, new)
    assert ids(merged) == ["a::p1::i0", "b::p1::i0", "c::p1::i0"]
    assert {r.id: r.file_hash for r in merged.collect()}["a::p1::i0"] == "n"
    assert ids(chunks.prune_missing(merged, spark.createDataFrame([("a",)], "pdf_name string"))) == ["a::p1::i0"]


def test_groups_and_first_hash(spark):
    rows = made(spark, ("a", 1, "", "1"), ("a", 2, "h2", "1"), ("a", 3, "h3", "1"), ("", 1, "h", "1"))
    assert {r.pdf_name: r.ids for r in chunks.ids_by_document(rows).collect()} == {"a": ["a::p1::i0", "a::p2::i0", "a::p3::i0"]}
    assert {r.pdf_name: r.file_hash for r in chunks.first_hash_by_document(rows).collect()} == {"a": "h2"}


def test_enrichment(spark):
    rows = made(spark, ("a", 1, "h", "1.1"), ("a", 2, "h", "1.1"), ("b", 1, "h", "1.1"))
    cache = made(spark, ("a", 1, "h", "1.1"), ("a", 2, "old", "1.1"), ("z", 1, "h", "1.1")).withColumn("text_with_context", F.lit("cached"))

    def fails_on_b():
        def call(prompt):
            if "Book: b" in prompt:
                raise RuntimeError("limit")
            return "made"

        return call

    out = enrichment.enrich(rows, cache, lambda df: enrichment.generated_context(df, fails_on_b))
    found = {r.id: (r.text_with_context, r.error) for r in out.collect()}
    assert found == {
        "a::p1::i0": ("cached", None),
        "a::p2::i0": ("CONTEXT: made\n\nORIGINAL TEXT:\ntext 2", None),
        "b::p1::i0": ("text 1", "limit"),
    }


def collection(spark, *items):
    return spark.createDataFrame([(i, (s,)) for i, s in items], "id string, metadata struct<source:string>").withColumn("document", F.lit("d")).withColumn("embedding", F.lit(None).cast("array<float>"))


def full(spark, rows):
    meta = F.struct(F.col("metadata.source").alias("source"), F.lit(1).alias("page"), F.lit(False).alias("is_garbled"))
    return rows.withColumn("metadata", meta).select("id", "document", "metadata", "embedding")


def test_orphans_and_purge(spark):
    held = collection(spark, ("1", "a.pdf"), ("2", "orphan.pdf"), ("3", "b.pdf"), ("4", "orphan.pdf"), ("5", None))
    valid = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "source string")
    assert ids(ingest.orphans(held, valid)) == ["2", "4", "5"]
    assert ids(ingest.purge(held, valid)) == ["1", "3"]
    assert ids(ingest.stale_ids(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a",), ("c",)], "id string"))) == ["b"]


def test_ingest(spark):
    rows = made(spark, ("a", 1, "new", "1"), ("a", 2, "new", "1"), ("b", 1, "h", "1"), ("c", 1, "", "1"), ("m", 1, "x", "1"), ("m", 2, "h", "1"))
    rows = rows.withColumn("text_with_context", F.lit("")).withColumn("is_garbled", F.lit(False))
    manifest = spark.createDataFrame([("a", "old"), ("b", "h"), ("m", "h"), ("gone", "h")], "pdf_name string, file_hash string")
    held = full(spark, collection(spark, ("a::p1::i0", "a"), ("a::p9::i0", "a"), ("b::p1::i0", "b"), ("gone::p1::i0", "gone"), ("m::p2::i0", "m")))
    new, known = ingest.ingest(rows, held, manifest)
    # the chunk of the mixed document that is still valid stays
    assert ids(new) == ["a::p1::i0", "a::p2::i0", "b::p1::i0", "c::p1::i0", "m::p1::i0", "m::p2::i0"]
    assert dict(known.select("pdf_name", "file_hash").collect()) == {"a": "new", "b": "h", "m": "x"}
    again, same = ingest.ingest(rows, new, known)
    assert ids(again) == ids(new) and dict(same.select("pdf_name", "file_hash").collect())["a"] == "new"
    failed = spark.createDataFrame([("a",)], "pdf_name string")
    _, partly = ingest.ingest(rows, held, manifest, failed=failed)
    assert dict(partly.select("pdf_name", "file_hash").collect())["a"] == "old"


def test_strict_ingest_leaves_removed_documents(spark):
    rows = made(spark, ("b", 1, "h", "1")).withColumn("text_with_context", F.lit(None).cast("string")).withColumn("is_garbled", F.lit(False))
    manifest = spark.createDataFrame([("b", "h"), ("gone", "h")], "pdf_name string, file_hash string")
    held = full(spark, collection(spark, ("b::p1::i0", "b"), ("gone::p1::i0", "gone")))
    assert ids(ingest.ingest(rows, held, manifest, strict=True)[0]) == ["b::p1::i0", "gone::p1::i0"]
    assert ids(ingest.ingest(rows, held, manifest)[0]) == ["b::p1::i0"]


def test_graph_batches(spark):
    rows = made(spark, *[("a", n, "h", "1") for n in range(45, 0, -1)], ("b", 1, "h", "1"))
    found = {(r.pdf_name, r.batch_no): r for r in ingest.graph_batches(rows, spark.createDataFrame([("b", "h")], "pdf_name string, file_hash string")).collect()}
    assert sorted(found) == [("a", 0), ("a", 1), ("a", 2)]
    assert found["a", 0].batch_text == "\n".join(f"text {n}" for n in range(1, 21)) and found["a", 2].batch_text.count("\n") == 4


def test_audit(spark):
    df = spark.createDataFrame([("has one x",), ("has two",), ("bad one",), (None,)], "text string")
    found = [tuple(r)[1:] for r in audit.audit(df, [["one", "two"], ["x", "two"]], ["bad"]).collect()]
    assert found == [(0, 0, True), (0, 0, True), (1, 1, False), (2, 0, False)]


def test_enrichment_goes_on_where_it_broke_off(spark, tmp_path):
    """Each step is stored; a failure late loses none of the steps before, and the next run makes the rest."""
    rows = made(spark, *[("a", n, "h", "1.1") for n in range(40)])
    schema = T.StructType.fromDDL(CHUNK + ", text_with_context string, error string")
    store = SnapshotStore(spark, tmp_path / "s", {"enriched": schema}, {"enriched": "id"})
    made_in, fail_at = [], [2]

    def generate(df):
        if len(made_in) == fail_at[0]:
            raise RuntimeError("out of money")
        made_in.append(df.count())
        return enrichment.rule_context(df)

    saved = []
    persist = lambda df, step: saved.append((step, df.count()))
    with pytest.raises(RuntimeError):
        enrichment.enrich_stepwise(rows, store, generate, step_rows=10, persist=persist)
    done = store.read("enriched").count()
    assert 0 < done == sum(made_in) == sum(n for _, n in saved) < 40 and [s for s, _ in saved] == [0, 1]
    fail_at[0] = -1
    found = enrichment.enrich_stepwise(rows, store, generate, step_rows=10, persist=persist)
    assert ids(found) == ids(rows) and sum(made_in) == 40
    before = store.current()
    assert ids(enrichment.enrich_stepwise(rows, store, generate, step_rows=10)) == ids(rows) and store.current() == before and sum(made_in) == 40
    fewer = rows.where("page_number < 5")
    assert ids(enrichment.enrich_stepwise(fewer, store, generate)) == ids(fewer) and sum(made_in) == 40


def test_upsert_in_batches_marks_failed_documents(spark, tmp_path):
    rows = made(spark, *[(p, n, "h", "1.1") for p in "abc" for n in range(4)]).withColumn("text_with_context", F.lit(None).cast("string")).withColumn("is_garbled", F.lit(False)).coalesce(1)

    def make():
        def send(batch):
            (tmp_path / batch[0]["id"].replace(":", "_")).write_text(str(len(batch)))
            if any(r["id"] == "b::p3::i0" for r in batch):
                raise OSError("full")

        return send

    failed = ingest.write_batches(ingest.as_rows(rows), make, 3)
    assert sorted((r.pdf_name, r.error) for r in failed.collect()) == [("b", "full"), ("c", "full")]
    assert sorted(int(f.read_text()) for f in tmp_path.iterdir()) == [3, 3, 3, 3]
    empty = ingest.as_rows(rows).limit(0)
    manifest = spark.createDataFrame([("gone", "h")], "pdf_name string, file_hash string")
    seen = []
    collection, known = ingest.ingest(rows, empty, manifest, write=make, report=lambda step, **n: seen.append(n))
    # one batch holds all rows here, and all documents fail with it
    assert known.collect() == [] and collection.count() == 0 and seen == [{"changed": 3, "removed": 1, "failed": 3}]

    def broken():
        def send(batch):
            raise KeyError("a mistake, not a failure of the store")

        return send

    with pytest.raises(Exception, match="KeyError"):
        ingest.write_batches(ingest.as_rows(rows), broken).collect()
