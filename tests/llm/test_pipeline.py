import math
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from spindrift.llm import bpe, mixing  # noqa: E402
from spindrift.session import materialise  # noqa: E402
from test_minhash import plain as near_plain  # noqa: E402
from test_quality import plain as quality_plain  # noqa: E402

SF = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, dup, rep = quality_plain(text)
    lines = [x for x in (text or "").split("\n") if x.split()]
    capitals = sum(1 for c in text or "" if c.isupper())
    return n >= 50 and 100 * rep <= 50 * n and 5 * symbols <= n and not (dup >= 3 and 5 * dup > 2 * len(lines)) and 100 * capitals <= 30 * chars and 2 * n <= chars <= 15 * n


def test_stages_against_brute_force(spark, documents):
    docs = documents
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == documents.columns
        kept.append({r.doc_id: r for r in docs.collect()})
    rows = documents.collect()
    good = {r.doc_id: r.text for r in rows if passes(r.text)}
    assert set(kept[0]) == set(good)
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    assert set(kept[1]) == set(first.values())
    near = near_plain([(i, good[i]) for i in first.values()], 5)
    assert set(kept[2]) == {i for i, (_, _, stays) in near.items() if stays}
    counts = Counter(r.source for r in kept[2].values())
    slots = mixing.shares(mixing.tempered(counts, 0.7))
    end = mixing.horizon(counts, slots, 8)
    taken = Counter(r.source for r in kept[3].values())
    assert set(kept[3]) <= set(kept[2])
    # whole blocks up to the horizon, none after it
    order = Counter(s for at, s in enumerate(mixing.schedule(slots) * math.ceil(end / sum(slots.values()))) if at < end)
    assert all(order[s] * 8 - 8 < taken[s] <= min(order[s] * 8, counts[s]) or taken[s] == counts[s] for s in counts)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == set(kept[3]) and all(r.n_tokens == len(bpe.unpack(bytes(r.ids))) for r in out)


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    rows = found.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_odd_and_empty_rows(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, SF).count() <= df.count()


def test_mixture_keeps_all_rows(spark, documents, odd, empty):
    """However unequal the sources are, and where there is none."""
    stage = dict(corpus_pipeline.STAGES)["pfair_mix"]
    lone = documents.unionByName(documents.limit(1).selectExpr("-1L AS doc_id", "text", "lang", "'lone' AS source", "n_chars"))
    for df in (lone, odd, empty):
        found = stage(spark, df, SF)
        assert found.columns == df.columns
        assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in df.collect())


def test_clashing_columns(spark, odd):
    """All stages but the last keep further columns, by whatever name."""
    names = ["hit", "digest", "component", "_w", "mix_rank", "n", "keep_id"]
    wide = odd.selectExpr("*", *[f"'{c}' AS {c}" for c in names if c != "mix_rank"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, SF)
        assert found.columns == wide.columns, name
        assert all(r[c] == c for r in found.collect() for c in names if c != "mix_rank")


def test_result_in_the_order_of_the_mixture(spark):
    """Whatever the sizes of the mixture's files are; a scan takes the largest first."""
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-2]:
            docs = materialise(stage(spark, docs, SF), "stage")
        mixed = mixing.mix_tempered(docs).collect()
        expected = [r.doc_id for r in sorted(mixed, key=lambda r: (r.mix_slot is None, r.mix_slot, r.mix_rank))]
        assert [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()] == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_documents_as_written(spark, tmp_path):
    """Rows of files come as they were written, also with a column of the hidden one's name; an order that
    a frame has of its own stays."""
    df = spark.range(0, 60, 1, 6).selectExpr("(id * 37) % 60 AS doc_id", "repeat('word ', cast(1 + id * id as int)) AS text", "'en' AS lang", "'a' AS source", "'x' AS _metadata")
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    written = [i * 37 % 60 for i in range(60)]
    ids = lambda x: [r.doc_id for r in corpus_pipeline.encode(spark, x, SF).collect()]
    assert [r.doc_id for r in docs.collect()] != written
    assert ids(docs) == ids(df) == written
    assert ids(docs.orderBy("doc_id")) == list(range(60))
