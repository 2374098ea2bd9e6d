import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import langid, lm
from spindrift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = QUERIES["op10_langid"](spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_viterbi_against_all_paths():
    from itertools import product

    r = np.random.default_rng(1)
    for _ in range(30):
        scores = r.normal(0, 3, (5, 1, 3)).astype(np.float32)
        best = max(product(range(3), repeat=5), key=lambda p: sum(scores[t, 0, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(langid.viterbi(scores, 2.0)[:, 0]) == best


def test_word_scores_against_plain_counts(spark):
    """Log probabilities of string trigrams, counted without hashing, over all training rows."""
    r = random.Random(4)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word(s) for _ in range(60)), lang) for i, (s, lang) in enumerate([("abcde", "aa"), ("cdefg", "bb"), ("абв", "ru"), ("abcde", "aa")])]
    known = langid.train(spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3))
    assert known.languages == ["aa", "bb", "ru"]
    seen = {lang: Counter() for lang in known.languages}
    for _, t, lang in rows:
        for w in t.split():
            seen[lang].update((f" {w} ")[i : i + 3] for i in range(len(w)))
    distinct = sorted({w for _, t, _ in rows for w in t.split()})
    found = known.word_scores(distinct)
    for w, row in zip(distinct, found):
        plain = []
        for lang in known.languages:
            total = sum(seen[lang].values()) + langid.PRIOR * langid.BUCKETS
            own = sum(math.log((seen[lang][(f" {w} ")[i : i + 3]] + langid.PRIOR) / total) for i in range(len(w)))
            plain.append(own if (lang == "ru") == (w[0] in "абв") else -1e4)
        assert row == pytest.approx(np.array(plain) - max(plain), abs=1e-3)


def test_long_text_and_clashing_columns(spark, model):
    rows = [(1, "abcde fabcd " * 100_000, "x", [1], 0.5), (2, "mnopq", "y", [2], 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, spans array<int>, score double")
    found = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert found[1].lang_pred == "aa" and found[1].score == 1.0 and [tuple(s) for s in found[1].spans] == [(0, 199_999, "aa")]
    assert found[2].lang_pred == "bb"


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    word = lambda s: "".join(r.choice(s) for _ in range(5))
    text = lambda s: " ".join(word(s) for _ in range(200))
    rows = [(1, text("abcdef"), "aa"), (2, text("mnopqr"), "bb"), (3, text("бвгд"), "ru"), (4, text("xyz"), None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_and_scripts(spark, model):
    rows = [(1, "abcde fabcd " * 6 + "mnopq ropqr " * 12), (2, "ббгд вггд"), (3, None), (4, "123 !!"), (5, ""), (6, "日本"), (None, "ABCDE fab")]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(s.first_word, s.last_word, s.lang) for s in found[1].spans] == [(0, 11, "aa"), (12, 35, "bb")]
    assert found[1].lang_pred == "bb" and abs(found[1].score - 2 / 3) < 1e-9
    assert found[2].lang_pred == "ru" and found[None].lang_pred == "aa"
    assert [(found[i].lang_pred, found[i].score, found[i].spans) for i in (3, 4, 5)] == [("und", 0.0, [])] * 3
    assert found[6].lang_pred in ("aa", "bb", "ru")


def test_odd_rows(odd, empty, model):
    assert langid.identify(odd.withColumnRenamed("source", "score"), langid.train(odd, lm.fold(4, 2))).count() == odd.count()
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []
