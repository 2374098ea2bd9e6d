import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import lm


def brute_force(rows, held_out):
    """(doc_id, held_out, n_tokens, n_known, base, score, once share) by dictionaries."""
    texts = [(i, lm.words(t) + [lm.END], held_out(i)) for i, t in rows]
    one, two = Counter(), Counter()
    for _, w, out in texts:
        if not out:
            one.update(w)
            two.update(zip([lm.END, *w], w))
    n, v = sum(one.values()), len(one)
    result = []
    for i, w, out in texts:
        base = [(one[x] + 1) / (n + v + 1) for x in w]
        pairs = list(zip([lm.END, *w], w))
        full = [(two[h, x] + lm.PRIOR * p) / (one[h] + lm.PRIOR) for (h, x), p in zip(pairs, base)]
        once = sum(two[p] <= 1 for p in pairs) / len(w)
        result.append((i, out, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, full)), once))
    return result


def same(found, expected):
    by = lambda r: (str(r[0]), r[2], round(r[5], 6), round(r[6], 6))
    found, expected = sorted(map(tuple, found), key=by), sorted(expected, key=by)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for f, e in zip(found, expected):
        assert f[5:] == pytest.approx(e[5:], rel=1e-9, abs=1e-9)


@pytest.fixture(params=[(5_000_000, 4_000_000), (500, 300)], ids=["whole", "many chunks and parts"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", request.param[0])
    monkeypatch.setattr(lm, "PART_TOKENS", request.param[1])


def test_documents(documents, sizes):
    held_out = lm.fold(7, 2)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = lm.score(documents, held_out).collect()
    same(found, brute_force(rows, held_out))
    assert {r.held_out for r in found} == {True, False}


def test_odd_rows(odd, empty, sizes):
    held_out = lm.fold(3, 1)
    same(lm.score(odd, held_out).collect(), brute_force([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], held_out))
    assert lm.score(empty).collect() == []
    assert all(r.base_score == r.score == 0 and r.n_known == 0 for r in lm.score(odd, lambda i: True).collect())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", 2), (2, None, 6, "y", 3)], "doc_id int, text string, chunk long, kind string, part int")
    same(lm.score(df).collect(), brute_force([(1, "a b"), (2, None)], lambda i: False))


def test_equal_tables_in_several_partitions(spark):
    rows = [(1, "a b c a b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    same(lm.score(df).collect(), brute_force(rows, lambda i: False))


def test_hot_history(spark):
    """One history before a third of all tokens, and words that always follow another."""
    r = random.Random(3)
    rows = [(i, " ".join(w for _ in range(200) for w in ("the", f"w{r.randrange(3000)}", "x"))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(lm.score(df, lm.fold(7, 2)).collect(), brute_force(rows, lm.fold(7, 2)))


def test_states_sum_to_one():
    r = random.Random(1)
    text = [r.randrange(1, 8) for _ in range(300)]
    tokens = np.array([*text, 0])
    symbols = np.bincount(tokens, minlength=10)  # 8 and 9 are unknown to training
    pairs = Counter(zip([0, *text], tokens.tolist()))
    kinds = int((symbols > 0).sum())
    unseen = 1 / (len(tokens) + kinds + 1)
    for history in range(8):
        arcs = np.array([pairs[history, w] for w in range(10)])
        steps = lm.Automaton(symbols, arcs, len(tokens), kinds).traverse(np.arange(10), np.full(10, history), np.arange(10))
        known = (10.0 ** steps)[:8].sum()
        share = lm.PRIOR / (symbols[history] + lm.PRIOR)
        assert known + share * unseen == pytest.approx(1)
        assert 10 ** steps[9] == pytest.approx(share * unseen)


def test_what_is_asked_grows_with_the_corpus(spark):
    def rows(n):
        r = random.Random(n)
        return spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(100))) for i in range(n)], "doc_id long, text string")

    def keys(n):
        found = lm.asked(lm.chunked(rows(n), lambda i: False, "doc_id", "text"), 4).where("kind = 1").collect()
        return sum(len(lm.unpack(bytes(r.counts))) for r in found)

    small, large = keys(50), keys(500)
    assert large > 9 * small > 9 * 4900


def test_packing():
    for values in ([], [0], [255, 256, 0], [2**64 - 1, 5], list(range(1000))):
        x = np.array(values, np.uint64)
        assert lm.unpack(lm.pack(x)).tolist() == values


def test_documents_that_occur_twice(spark):
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(120)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    share = {x.doc_id: x.once_share for x in lm.score(df).collect()}
    assert max(share[i] for i in [*range(20), *range(60, 80)]) < 0.1 < 0.8 < min(share[i] for i in range(20, 60))


def test_fold():
    assert [lm.fold(7, 2)(i) for i in (1, 2, None)] == [zlib.crc32(x) % 7 == 2 for x in (b"1", b"2", b"")]


def test_long_text_and_clashing_columns(spark):
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(200_000))
    df = spark.createDataFrame([(1, long, 1, b"t", 2), (2, "w1 w2", 3, b"u", 4)], "doc_id long, text string, chunk int, tokens binary, n int")
    same(lm.score(df).collect(), brute_force([(1, long), (2, "w1 w2")], lambda i: False))
