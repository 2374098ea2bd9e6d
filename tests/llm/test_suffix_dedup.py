import random
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import repeats as R
from spindrift.llm import suffix_dedup as X


def plain(rows, length):
    datas = [(t or "").encode() for t in rows]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int), [0]))) == 1).sum())
        out.append((len(d), runs, bytes(b for b, c in zip(d, covered) if not c)))
    return Counter(out)


def found(df, length):
    return Counter((r.n_bytes, len(r.removed), bytes(r.kept)) for r in X.remove_repeats(df, length).collect())


def plain_passages(rows, n):
    """Words of each text that lie in n words which a different text has too."""
    texts = [(t or "").encode().split() for t in rows]
    seen = {}
    for t, words in zip(rows, texts):
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), set()).add(t)
    return [len({i + k for i in range(len(w) - n + 1) if len(seen[tuple(w[i : i + n])]) > 1 for k in range(n)}) for w in texts]


@pytest.mark.parametrize("batch", [2000, 200_000])
def test_passages_of_words(spark, documents, batch, monkeypatch):
    """Every shared passage shows, with two thirds of its words at least; nothing shorter than those does."""
    monkeypatch.setattr(R, "BATCH", batch)
    r = random.Random(6)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, short = own(52), own(33)
    rows = [r.text for r in documents.limit(100).collect()]
    rows += [f"{own(30)}  {passage}\n{own(20)}" for _ in range(30)] + [f"{own(30)} {short} {own(20)}" for _ in range(5)]
    rows += ["a " * 200, own(50), "\n " + passage, None, "", " ", passage + " " + passage]
    rows += [rows[-1]] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    found = {x.doc_id: x.passage_words for x in X.remove_repeats(df, 100).collect()}
    for i, (least, most) in enumerate(zip(plain_passages(rows, 50), plain_passages(rows, 34))):
        assert min(least, 34) <= found[i] <= most
    assert all(34 <= found[i] <= 52 for i in range(100, 130)) and not any(found[i] for i in range(130, 137))
    assert {x.passage_words for x in X.remove_repeats(df, 100, passage=0).collect()} == {0}


def test_word_hashes():
    a, b = X.word_hashes(b"  one two\n\tone  "), X.word_hashes("one tw\u00f6".encode())
    assert len(a) == 3 and a[0] == a[2] == b[0] and a[1] != a[0] and b[1] not in a
    assert len(X.word_hashes(b"")) == len(X.word_hashes(b" \n")) == 0
    long = b"x" * 5000
    assert X.word_hashes(long)[0] != X.word_hashes(long + b"x")[0]


def test_many_carriers_and_copies(spark, monkeypatch):
    """A passage in very many texts whose surroundings differ, and very many copies of one text."""
    monkeypatch.setattr(R, "MANY_REGIONS", 50)
    largest, compare = [], R.repeated_starts
    monkeypatch.setattr(R, "repeated_starts", lambda regions, owners, length: (largest.append(len(regions)), compare(regions, owners, length))[1])
    r = random.Random(2)
    passage = "".join(r.choice("abcdef ") for _ in range(600))
    own = lambda n: "".join(r.choice("ghijkl ") for _ in range(n))
    rows = [own(500) + passage + own(500) for _ in range(1500)] + ["copy " + passage[:300] + own(300)] * 3000 + [own(700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    out = {x.doc_id: [(s.start, s.end) for s in x.removed] for x in X.remove_repeats(df, 400, passage=0).collect()}
    assert all(len(out[i]) == 1 and 0 <= 500 - out[i][0][0] < 8 and 0 <= out[i][0][1] - 1100 < 8 for i in range(1500))
    assert all(out[i] == [(0, len(rows[i].encode()))] for i in range(1500, 4500)) and out[4500] == []


@pytest.mark.parametrize("many", [1, 8, 2000])
def test_brute_force(spark, documents, many, monkeypatch):
    """Also with anchors told apart by longer content, however few regions they have."""
    monkeypatch.setattr(R, "MANY_REGIONS", many)
    rows = [r.text for r in documents.limit(60).collect()]
    r = random.Random(4)
    passage = "".join(r.choice("abcdef ") for _ in range(150))
    rows += ["".join(r.choice("xyz ") for _ in range(80)) + passage + "".join(r.choice("uvw") for _ in range(90)) for _ in range(12)]
    rows += ["ab" * 300, "z" * 150, "z" * 99, "z" * 101, None, "", "é" * 120, passage, passage]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert found(df, 100) == plain(rows, 100)


def test_odd_rows(odd, empty):
    rows = [r.text for r in odd.collect() if not (r.text or "").startswith("x")]
    assert found(odd.where("text IS NULL OR text NOT LIKE 'x%'"), 400) == plain(rows, 400)
    long = X.remove_repeats(odd.where("text LIKE 'x%'"), 400).first()
    assert (long.n_bytes, long.kept) == (50_000, b"")
    assert X.remove_repeats(empty).collect() == []


def test_suffix_array_and_prefixes():
    r = random.Random(3)
    for _ in range(60):
        x = np.array([r.randrange(3) for _ in range(r.randrange(1, 60))])
        x = np.append(x, 9)
        order = R.suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        shared = R.common_prefixes(x, order, np.array([0]), np.array([len(x)]), 100)
        for a, b in zip(order, order[1:]):
            n = next(k for k in range(len(x)) if a + k >= len(x) or b + k >= len(x) or x[a + k] != x[b + k])
            assert shared[b] == n


def test_streams_together_and_apart():
    """Anchors of streams that are put together are those of each alone."""
    r = random.Random(11)
    shape = R.Shape(30, 12, 1)
    rows = [(bytes([i]), i * 7, np.frombuffer("".join(r.choice("abc") for _ in range(r.choice([0, 5, 29, 30, 31, 80, 200]))).encode(), np.uint8)) for i in range(60)]

    def anchors(rows):
        return {(a.sids[o], int(p + s), int(f + s), int(z + s), int(h)) for a in R.anchored(rows, shape) for o, s, p, f, z, h in zip(a.own, a.shift, a.place, a.first, a.last, a.h)}

    whole = anchors(rows)
    assert whole == set().union(*(anchors([row]) for row in rows)) and len({w[0] for w in whole}) == sum(len(x) >= 30 for *_, x in rows)
    for sid, _, x in rows:
        covered = sorted(s for w in whole if w[0] == sid for s in range(w[2], w[3] + 1))
        assert covered == list(range(max(0, len(x) - 29)))


def test_long_streams_are_cut_without_loss(spark, monkeypatch):
    r = random.Random(8)
    passage = "".join(r.choice("abcd") for _ in range(130))
    text = "".join(r.choice("efgh") for _ in range(1500)) + passage + "".join(r.choice("ijkl") for _ in range(700)) + passage
    x = np.frombuffer(text.encode(), np.uint8)
    shape = R.Shape(100, 50, 1)
    whole = set()
    for size in (10**6, 400):
        monkeypatch.setattr(R, "CHUNK", size)
        R._POWERS.clear()
        covered = {}
        for at, part in R._chunks(x, shape):
            place, first, last, h = R.anchors(part, shape)
            for p, a, z, k in zip(place, first, last, h):
                covered.update({at + s: (at + p, int(k)) for s in range(a, z + 1)})
        assert sorted(covered) == list(range(len(x) - 99))
        whole.add(str(sorted((s, int(v[0]), v[1]) for s, v in covered.items())))
    R._POWERS.clear()
    assert len(whole) == 1
