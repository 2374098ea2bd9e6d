import random
from collections import Counter

import pytest

from spindrift.llm import line_dedup as X


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return last[-1]


def edited(r, a, n, letters):
    b = bytearray(a)
    for _ in range(n):
        k = r.randrange(3)
        if k == 0 and b:
            del b[r.randrange(len(b))]
        elif k == 1:
            b.insert(r.randint(0, len(b)), r.choice(letters))
        elif b:
            b[r.randrange(len(b))] = r.choice(letters)
    return bytes(b)


def test_distance_and_segments():
    r = random.Random(1)
    for _ in range(4000):
        a = bytes(r.choice(b"abc") for _ in range(r.randint(0, 14)))
        b = edited(r, a, r.randint(0, 4), b"abc")
        assert X.within(a, b) == (distance(a, b) <= 2)
        a = bytes(r.choice(b"ab") for _ in range(r.randint(22, 40)))
        short, long = sorted((a, edited(r, a, 2, b"ab")), key=len)
        index = {(len(short), i, short[p : p + n]) for i, (p, n) in enumerate(X.cuts(len(short)))}
        looked = {(len(long) - d, i, long[p : p + n]) for d, i, p, n in X.probes(len(long))}
        assert index & (looked | {(len(long), i, long[p : p + n]) for i, (p, n) in enumerate(X.cuts(len(long)))})


def plain(docs):
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    parent = {x: x for _, t in rows for x in X.lines(t) if x.split()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = [x for x in parent if len(x.decode()) >= X.LEAST]
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if abs(len(a.decode()) - len(b.decode())) <= 2 and root(a) != root(b) and distance(a.decode(), b.decode()) <= 2:
                parent[root(a)] = root(b)
    size, seen, out = Counter(root(x) for _, t in rows for x in X.lines(t) if x.split()), set(), []
    for i, t in rows:
        gone, linked, every = [], 0, X.lines(t)
        for at, x in enumerate(every):
            if x.split():
                linked += size[root(x)] > 1
                if root(x) in seen:
                    gone.append(at)
                seen.add(root(x))
        out.append((i, sum(1 for x in every if x.split()), linked, gone, b"\n".join(x for at, x in enumerate(every) if at not in gone).decode()))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [2048, 5])
def test_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", block)
    r = random.Random(3)
    stem = bytes(r.choice(b"abcdefgh ") for _ in range(60))
    pool = [edited(r, stem, r.randrange(7), b"xyz").decode() for _ in range(60)] + ["short", "shoxt", "", " ", "é" * 15, "é" * 14 + "e", "日本語の文章を一行に書いたもので、短くない。", "日本語の文章が一行に書いたもので長くない。", "à la carte du café, une fois", "a la carte du cafe, une fois", "à la carté du cafe, un fois"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(40)] + [(None, pool[0] + "\n" + pool[0]), (99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = [(r.doc_id, r.n_lines, r.n_linked, list(r.dropped), r.kept) for r in X.dedup_lines(df).collect()]
    assert sorted(map(str, found)) == plain(docs)


def test_odd_rows(odd, empty):
    rows = X.dedup_lines(odd.withColumnRenamed("lang", "kept").withColumnRenamed("source", "rid")).collect()
    assert len(rows) == odd.count()
    assert {r.n_lines for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert [r.kept for r in rows if r.doc_id == 7] == ["one", "one"]
    assert X.dedup_lines(empty).collect() == []
