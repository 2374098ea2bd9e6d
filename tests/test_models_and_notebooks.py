import json

import pytest
from pyspark.sql import functions as F

from spindrift.cli import main
from spindrift.functions import notebooks
from spindrift.operations import run_smoke
from spindrift.operators import evaluate, graphstore, models


def test_retry_and_throttle():
    waits, fails = [], [ConnectionError(), TimeoutError()]

    def call(x):
        if fails:
            raise fails.pop()
        return x

    assert models.retrying(call, sleep=waits.append)(3) == 3
    assert len(waits) == 2 and all(2 <= w <= 60 for w in waits)

    def down():
        raise ConnectionError

    def wrong():
        raise ValueError

    waits.clear()
    with pytest.raises(ConnectionError):
        models.retrying(down, sleep=waits.append)()
    assert len(waits) == 4
    with pytest.raises(ValueError):
        models.retrying(wrong, sleep=waits.append)()
    now = [0.0]
    slow = models.throttled(lambda: now[0], 0.5, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    assert [slow(), slow(), slow()] == [0.0, 0.5, 1.0]
    assert models.has_model(["llama3:8b"], "llama3") and not models.has_model([], "llama3")


def test_graph_store(spark):
    rows = [(f"{p}::{n}", f"t{n}", p, "h" + p, n, i) for i, (p, n) in enumerate([(p, n) for p in ("a", "b") for n in range(1, 46)])]
    chunks = spark.createDataFrame(rows, "id string, text string, pdf_name string, file_hash string, page_number int, ordinal int")
    manifest = spark.createDataFrame([], "pdf_name string, file_hash string")

    def make():
        def put(name, number, text):
            if name == "b" and number == 1:
                raise RuntimeError("full")

        return put

    status, known = graphstore.populate(chunks, manifest, make)
    assert sorted((r.pdf_name, r.batch_no, r.ok) for r in status.collect()) == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("b", 0, True), ("b", 1, False)]
    assert [tuple(r) for r in known.collect()] == [("a", "ha")]
    again, _ = graphstore.populate(chunks, known, make)
    assert {r.pdf_name for r in again.collect()} == {"b"}
    whole, _ = graphstore.populate(chunks, known, make, reset=True)
    assert {r.pdf_name for r in whole.collect()} == {"a", "b"}


def notebook(path, *cells):
    made = [{"cell_type": "code", "id": f"c{i}", "source": c, "metadata": {}, "outputs": [], "execution_count": None} if isinstance(c, str) else c for i, c in enumerate(cells)]
    path.write_text(json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": made}))
    return str(path)


def test_notebooks(tmp_path, capsys):
    good = notebook(tmp_path / "a.ipynb", "!pip list\nif x:\n    %time y\n", "def f():\n    return 1")
    assert notebooks.problems(good) == [] and main(["validate-notebook", good]) == 0
    assert notebooks.plain_python("if x:\n    !ls") == "if x:\n    pass"
    bad = notebook(tmp_path / "b.ipynb", "x = (")
    assert notebooks.problems(bad)[0].startswith("cell 0") and main(["validate-notebook", bad]) == 1
    assert notebooks.problems(notebook(tmp_path / "c.ipynb", {"cell_type": "code", "source": ""})) == ["cells without id: [0]"]
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"required": [["def g", "def f"], ["class"]], "forbidden": ["return"]}))
    capsys.readouterr()
    assert main(["audit-notebook", good, str(rules)]) == 1
    assert json.loads(capsys.readouterr().out) == {"missing": [["class"]], "forbidden": ["return"]}


def test_notebook_format():
    cell = {"cell_type": "code", "id": "a", "source": ["x = 1"], "metadata": {}, "outputs": [], "execution_count": 1}
    of = lambda *cells, **more: notebooks.schema_problems({"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": list(cells)} | more)
    assert of(cell, {"cell_type": "markdown", "id": "b", "source": "", "metadata": {}}) == []
    assert of(cell, cell) == ["cell 1: id 'a' again"]
    assert of(cell | {"id": "no blanks"}) == ["cell 0: id 'no blanks'"] and of(cell | {"source": 1}) == ["cell 0: source"]
    assert of(cell | {"cell_type": "sql"})[0] == "cell 0: type 'sql'" and of(cell | {"outputs": [{"output_type": "stream", "name": "stdout"}]}) == ["cell 0: output 0"]
    assert of(cell | {"execution_count": "1"}) == ["cell 0: execution_count"] and of(cell | {"metadata": None}) == ["cell 0: metadata"]
    assert of(nbformat=3) == ["version 3.5"] and of(cells=None) == ["no cells"] and notebooks.schema_problems([]) == ["not an object"]


def test_smoke_of_live_services(spark, monkeypatch):
    monkeypatch.setenv("GROQ_API_KEY", "k")
    monkeypatch.setenv("OLLAMA_BASE_URL", "http://there/")
    asked = []
    assert run_smoke(spark, True, lambda url: asked.append(url) or 200).ok and asked == ["http://there/api/tags"]
    assert not run_smoke(spark, True, lambda url: 503).ok

    def down(url):
        raise OSError("refused")

    assert "refused" in run_smoke(spark, True, down).message
    assert not run_smoke(spark, True, lambda url: 200, lambda prompt: " ").ok
    assert "model answered" in run_smoke(spark, True, lambda url: 200, lambda prompt: "ready").message


def test_evaluation_by_batches(spark):
    truths = evaluate.qa_table(spark).where("qid < 7")
    queries = truths.select(F.col("qid").alias("query_id"), F.col("question").alias("query"))
    answerer = lambda q: q.select("query_id", F.upper("query").alias("answer"), F.array("query").alias("contexts"))
    seen = []
    whole = evaluate.run(queries, truths, answerer)
    stepwise = evaluate.run(queries, truths, answerer, progress=lambda done, n: seen.append((done, n)), batch=3)
    assert sorted(whole.collect()) == sorted(stepwise.collect()) and seen == [(3, 7), (6, 7), (7, 7)]
