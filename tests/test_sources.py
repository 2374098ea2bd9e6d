import json
import time

import pytest
from pyspark.sql import types as T

from spindrift.cli import main
from spindrift.operations import log_event, run_benchmark, run_smoke, timed_event
from spindrift.schema import CHUNK
from spindrift.sources import checkpoint, pdf
from spindrift.sources.settings import load_settings
from spindrift.sources.store import MOST_PARTS, ManifestStore, SnapshotStore
from spindrift.streaming.ingest import event_counts, file_stream, sync_stream


def test_settings(tmp_path):
    made = load_settings(tmp_path, {"RRF_K": "7", "GROQ_TIMEOUT": "x", "PIPELINE_VERSION": "2"})
    assert (made.rrf_k, made.groq_timeout, made.pipeline_version, made.final_top_k) == (7, 20.0, "2", 5)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["data", "manifests", "processed", "stores"]


def entry(**more):
    return {"id": "a", "text": "t", "file_hash": "h", "pdf_name": "p", "page_number": 1, "chunk_index": 0} | more


def test_checkpoint(spark, tmp_path):
    path = tmp_path / "chunks.json"
    rows = [entry(), entry(id="b", unknown=1), {"id": "c"}, entry(id="d", text=None), entry(text="last", is_garbled=True)]
    checkpoint.write_json_atomic(rows, path)
    found = checkpoint.read_checkpoint(spark, str(path)).collect()
    assert [(r.id, r.text, r.pipeline_version, r.is_garbled) for r in found] == [("a", "last", "0.0", True)]
    assert checkpoint.read_checkpoint(spark, str(path), most_bytes=10).count() == 0
    assert checkpoint.read_checkpoint(spark, str(tmp_path / "none.json")).count() == 0
    path.write_text("[{")
    assert checkpoint.read_checkpoint(spark, str(path)).count() == 0
    with pytest.raises(TypeError):
        checkpoint.write_json_atomic([{"a": object()}], path)
    assert path.read_text() == "[{" and len(list(tmp_path.iterdir())) == 1


def test_manifest(spark, tmp_path):
    store = ManifestStore(spark, tmp_path)
    store.update("one", {"a.pdf": "h1"})
    store.update("one", {"b.pdf": "h2", "c.pdf": "h3"})
    store.update("two", {"b.pdf": "x"})
    store.update("one", {})
    assert dict(store.load("one").collect()) == {"a.pdf": "h1", "b.pdf": "h2", "c.pdf": "h3"}
    assert store.remove("one", ["b.pdf", "missing.pdf", "b.pdf"]) == 1
    assert store.remove("one", ["missing.pdf"]) == 0
    assert sorted(dict(store.load("one").collect())) == ["a.pdf", "c.pdf"] and store.load("two").count() == 1
    (tmp_path / "_CURRENT").write_text("{")
    with pytest.raises(json.JSONDecodeError):
        store.update("one", {"d.pdf": "h"})


def test_store_parts(spark, tmp_path):
    """Parts replace the documents they hold; nothing is written for an empty one; old versions go."""
    schema = T.StructType.fromDDL("pdf_name string, id string")
    # the second root isn't taken for a local folder, as an object store or HDFS wouldn't be
    for root in (tmp_path / "a", f"viewfs://parts{tmp_path}/b"):
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.parts.link./tmp", "file:///tmp")
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.AbstractFileSystem.viewfs.impl", "org.apache.hadoop.fs.viewfs.ViewFs")
        store = SnapshotStore(spark, root, {"t": schema}, {"t": "pdf_name"})
        df = lambda *rows: spark.createDataFrame(rows, schema)  # noqa: E731, B023
        with store.lock():
            assert store.append("t", df(("a", "1"), ("a", "2"), ("b", "3")))
            assert store.append("t", df(("a", "4"))) and not store.append("t", df().limit(0))
        found = lambda: sorted((r.pdf_name, r.id) for r in store.read("t").collect())  # noqa: E731, B023
        assert found() == [("a", "4"), ("b", "3")] and len(store.current()["t"]) == 2
        for i in range(MOST_PARTS):
            checkpoint.save_chunks(store, df(("c", str(i))), "t")
        assert found() == [("a", "4"), ("b", "3"), ("c", str(MOST_PARTS - 1))] and len(store.current()["t"]) < MOST_PARTS
        before = found()
        assert store.vacuum(3600) == 0 and store.vacuum(0) > 0 and found() == before
        assert not store.folder.exists("_LOCK") or store.folder.local


def files(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.pdf").write_bytes(text if isinstance(text, bytes) else "\f".join(text).encode())


def test_pdf_scan(spark, tmp_path):
    long = "word " * 30
    files(tmp_path, a=[long, "short", long], b=b"\xff\xfe", C=[long])
    (tmp_path / "c.PDF").write_text(long)
    (tmp_path / "sub").mkdir()
    files(tmp_path / "sub", d=[long])
    scanned = pdf.scan_files(spark, str(tmp_path))
    assert sorted(r.pdf_name for r in scanned.select("pdf_name").collect()) == ["C.pdf", "a.pdf", "b.pdf"]
    pages, log = pdf.pages(scanned, pdf.form_feed_extractor)
    assert sorted((r.pdf_name, r.page_number) for r in pages.collect()) == [("C.pdf", 1), ("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3)]
    assert {r.pdf_name: r.error is None for r in log.collect()} == {"a.pdf": True, "b.pdf": False, "C.pdf": True}
    state = spark.createDataFrame([], "pdf_name string, file_hash string, pipeline_version string")
    assert sorted(r.id for r in pdf.new_chunks(scanned, state, make=pdf.form_feed_extractor).collect()) == ["C.pdf::p1::i0", "a.pdf::p1::i0", "a.pdf::p3::i0"]


def test_slow_and_unreadable_files(spark, tmp_path):
    files(tmp_path, fast=["x"], slow=["y"])

    def make():
        def extract(content):
            if content == b"y":
                while True:
                    pass
            return [content.decode()]

        return extract

    began = time.monotonic()
    pages, log = pdf.pages(pdf.scan_files(spark, str(tmp_path)), make, seconds=1, store=True)
    assert [r.pdf_name for r in pages.collect()] == ["fast.pdf"]
    assert {r.pdf_name: r.error for r in log.collect()} == {"fast.pdf": None, "slow.pdf": "over 1 seconds"} and time.monotonic() - began < 30
    with pdf.limited(5), pytest.raises(TimeoutError), pdf.limited(0.05):
        time.sleep(2)
    lost = spark.createDataFrame([("lost.pdf", "lost.pdf", "", None)], "pdf_name string, pdf_path string, file_hash string, content binary")
    pages, log = pdf.pages(pdf.scan_files(spark, str(tmp_path), "fast*", skip_unreadable=True).unionByName(lost), make)
    assert {r.pdf_name: r.error for r in log.collect()} == {"fast.pdf": None, "lost.pdf": "unreadable"} and pages.count() == 1


def test_stream(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    store = SnapshotStore(spark, tmp_path / "store", {"chunks": CHUNK}, {"chunks": "pdf_name"})
    long = "word " * 30

    def go():
        sync_stream(file_stream(spark, str(data)), store, str(tmp_path / "cp"), make=pdf.form_feed_extractor).awaitTermination()
        return sorted(r.id for r in store.read("chunks").collect())

    files(data, a=[long], b=[long, long])
    assert go() == ["a.pdf::p1::i0", "b.pdf::p1::i0", "b.pdf::p2::i0"]
    files(data, c=[long])
    assert len(go()) == 4


def test_event_counts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.5D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2D")
    assert [(r.n, r.total) for r in event_counts(df).collect()] == [(2, 3.5)]


def test_operations(spark, tmp_path, capsys, monkeypatch):
    found = run_benchmark(spark, 20_000, tmp_path / "b.json")
    assert (found["books"], found["orphans_deleted"]) == (100, 3320)
    assert json.loads((tmp_path / "b.json").read_text())["samples"] == 20_000
    assert run_smoke(spark).ok
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    live = run_smoke(spark, live=True)
    assert not live.ok and "GROQ_API_KEY" in live.message
    with pytest.raises(ValueError), timed_event("step", stage=1):
        raise ValueError
    log_event("done", name="é")
    lines = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith("{")]
    assert [x["event"] for x in lines] == ["step", "done"] and lines[1]["name"] == "é" and "elapsed_ms" in lines[0]
    with pytest.raises(SystemExit):
        main(["nothing"])
