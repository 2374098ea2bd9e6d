import random
from itertools import combinations

import numpy as np
import pytest

from spindrift.llm import minhash as M
from spindrift.llm.graph import components


def plain(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(df, width):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_groups(df, width).collect()}


@pytest.mark.parametrize("width", [4, 5])
def test_brute_force(documents, width):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents, width) == plain(rows, width)


def test_chains_and_border_cases(spark, monkeypatch):
    """Copies with few edits each: many are linked with some copies and not with others."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(120), r.randrange(9)):
            words[at] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"q{i}x{k}" for k in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6))]
    rows += [(200, "A  b\tC d"), (201, "a b c d"), (202, "É b c d"), (203, "é b c d"), (204, "a b c"), (205, "A B C")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 4) == plain(rows, 4)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert found(df, 4) == plain(rows, 4)


def test_odd_rows(odd, empty):
    rows = M.near_groups(odd, 5).collect()
    assert len(rows) == odd.count()
    groups = {r.doc_id: r.component_id for r in rows}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == 4 and groups[7] == 7 and groups[None] is None
    assert all(r.kept for r in rows if r.doc_id is None or r.n_shingles == 0)
    clashing = odd.withColumnRenamed("lang", "kept").withColumnRenamed("source", "_gone")
    assert sorted(str(r.doc_id) for r in M.keep_one(clashing).collect()) == sorted("1 4 5 6 7 7 8 9 10 None None".split())
    assert M.near_groups(empty).collect() == [] and M.keep_one(empty).columns == empty.columns


@pytest.mark.parametrize("kind", ["int", "long", "smallint"])
def test_identifiers_of_any_integer_type(spark, kind):
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(50):
        words = list(base)
        words[r.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(words), "a", i, "b", True))
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, _w string, _b int, _word string, hit boolean")
    kept = M.keep_one(df)
    assert kept.schema == df.schema and [x.doc_id for x in kept.collect()] == [0]


def test_estimate():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(40):
            u = np.unique(r.integers(0, 2**64, 1000, dtype=np.uint64))
            n = len(u)
            common = int(share * n)
            a, b = u[r.permutation(n)], None
            b = np.sort(np.concatenate([a[:common], a[common : common + (n - common) // 2]]))
            a = np.sort(np.concatenate([a[:common], a[common + (n - common) // 2 :]]))
            regs = M.densify(np.stack([M.registers(a), M.registers(b)]))
            errors.append(M.estimate(regs[0], regs[1]) - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {v: v for e in edges for v in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
