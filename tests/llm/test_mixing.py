import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from spindrift.llm import mixing as X


@pytest.mark.parametrize("seed", range(40))
def test_schedule_windows_and_deviation(seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.random() ** 3 + 0.001 for i in range(r.randint(1, 30))}
    slots = X.shares(weights, r.choice([37, 100, 500]))
    period, done = sum(slots.values()), Counter()
    assert min(slots.values()) >= 1
    for now, s in enumerate(X.schedule(slots)):
        k = done[s]
        assert k * period // slots[s] <= now < -(-(k + 1) * period // slots[s])
        done[s] += 1
        assert all(abs(done[z] - (now + 1) * slots[z] / period) < 1 for z in slots)


@pytest.mark.parametrize("seed", range(10))
def test_schedule_against_brute_force(seed):
    """Slot by slot, of all released blocks the one that is due first, by exact fractions."""
    r = random.Random(100 + seed)
    slots = X.shares({f"s{i}": r.random() + 0.01 for i in range(r.randint(1, 9))}, 60)
    done, order = dict.fromkeys(slots, 0), []
    for now in range(60):
        released = [s for s in slots if done[s] < slots[s] and Fraction(done[s] * 60, slots[s]) // 1 <= now]
        s = min(released, key=lambda s: (math.ceil(Fraction((done[s] + 1) * 60, slots[s])), s))
        order.append(s)
        done[s] += 1
    assert X.schedule(slots) == order


def test_slots_of_the_query(spark, documents):
    """Each row's slot is where its block's turn comes in the schedule, over and over."""
    rows = X.mix_tempered(documents).collect()
    counts = Counter(r.source for r in documents.collect() if r.source is not None)
    weights = X.tempered(counts, 0.7)
    order = X.schedule(X.shares(weights, X.enough_slots(weights)))
    places = {s: [at for at, x in enumerate(order) if x == s] for s in counts}
    assert Counter(r.source for r in rows) == Counter(r.source for r in documents.collect())
    for s, n in counts.items():
        own = [r for r in rows if r.source == s]
        assert sorted(r.mix_rank for r in own) == list(range(n))
        for r in own:
            turn, k = divmod(r.mix_rank // 8, len(places[s]))
            assert r.mix_slot == turn * len(order) + places[s][k]


def test_too_many_sources():
    with pytest.raises(ValueError):
        X.shares({str(i): 1 for i in range(11)}, 10)


def test_mix(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source", "id AS mix_slot", "'t' AS text")
    weights = {"hot": 1, "s0": 2, "s1": 1, "s2": 1, "s3": 1, "s4": 1}
    out = X.mix(df, weights, block_rows=8, period=70).collect()
    assert len(out) == 4000
    slots = X.shares(weights, 70)
    by_source = {}
    for r in out:
        by_source.setdefault(r.source, []).append(r)
        assert r.mix_release <= r.mix_slot < r.mix_deadline and r.mix_block == r.mix_rank // 8
    for s, rows in by_source.items():
        assert sorted(r.mix_rank for r in rows) == list(range(len(rows)))
    assert max(Counter(r.mix_slot for r in out).values()) == 8 and len({(r.mix_slot, r.source) for r in out}) == len({r.mix_slot for r in out})
    mixed = [r for r in out if r.mix_in]
    end = X.horizon({s: len(x) for s, x in by_source.items()}, slots, 8)
    assert {r.mix_slot for r in mixed} == set(range(end))
    blocks = Counter(s for _, s in {(r.mix_slot, r.source) for r in mixed})
    assert all(abs(blocks[s] - end * slots[s] / 70) < 1 for s in slots)
    ordered = X.in_order(X.mix(df, weights, 8, 70), ["doc_id", "source"]).collect()
    assert [r.doc_id for r in ordered] == [r.doc_id for r in sorted(mixed, key=lambda r: (r.mix_slot, r.mix_rank))]


def test_odd_rows(odd, empty):
    out = X.mix_tempered(odd).collect()
    assert len(out) == odd.count()
    assert all(r.mix_slot is None and not r.mix_in for r in out if r.source is None)
    assert X.mix_tempered(empty).collect() == [] and X.mix(odd, {}).where("mix_in").count() == 0


def test_all_rows_in_order(spark):
    """A source of one row runs dry at once; no row of the others, or without a source, goes."""
    df = spark.range(3001).selectExpr("id AS doc_id", "CASE WHEN id = 0 THEN 'tiny' WHEN id % 50 = 1 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    mixed = X.mix_tempered(df)
    out = mixed.collect()
    last = max(r.mix_slot for r in out if r.source)
    expected = sorted(out, key=lambda r: (last + 1 if r.mix_slot is None else r.mix_slot, r.mix_rank))
    assert [r.doc_id for r in X.all_in_order(mixed, ["doc_id"]).collect()] == [r.doc_id for r in expected]
    assert sorted(r.doc_id for r in out) == list(range(3001))
    cut = {r.source: (r.rows, r.cut) for r in X.cut_rows(mixed).collect()}
    assert cut == {s: (sum(r.source == s for r in out), sum(r.source == s and not r.mix_in for r in out)) for s in {r.source for r in out}}
    assert cut["hot"][1] > 0


def test_more_sources_than_slots(spark):
    """The period grows with the sources, and a hot one keeps its weight among many."""
    df = spark.range(12_200).selectExpr("id AS doc_id", "CASE WHEN id < 200 THEN 'hot' ELSE concat('s', id) END AS source")
    out = X.mix_tempered(df).collect()
    assert sorted(r.doc_id for r in out) == list(range(12_200)) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
    width = {r.source: r.mix_deadline for r in out if r.mix_block == 0}
    # 12 001 sources with ten slots each; shares are counts to the power 0.7
    assert abs(width["hot"] * 200**0.7 / (12_000 + 200**0.7) - 1) < 0.02
    assert all(abs(width[s] / (12_000 + 200**0.7) - 1) < 0.15 for s in width if s != "hot")


def test_small_weights_keep_their_share():
    weights = {"big": 1.0, "tiny": 2e-5}
    slots = X.shares(weights, X.enough_slots(weights))
    assert abs(slots["tiny"] / sum(slots.values()) / 2e-5 - 1) < 0.01
    assert X.enough_slots({"a": 1}) == X.PERIOD and X.enough_slots({}) == X.PERIOD
    assert X.enough_slots({"a": 1, "b": 1e-12}) == X.MOST_SLOTS


def test_clashing_columns_and_ties(spark):
    """Columns by any name; rows of one identifier are ordered by their other columns."""
    rows = [(1 if i % 2 else None, f"t{i}", "a" if i % 3 else "b", i, "x", i) for i in range(300)]
    names = "doc_id int, text string, source string, _slots long, _k string, _at int"
    results = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, names).repartition(parts).withColumnsRenamed({})
        out = X.mix(df, {"a": 2, "b": 1}, 4).collect()
        assert {r._slots for r in out} == set(range(300)) and {r._k for r in out} == {"x"}
        results.append({r.text: (r.mix_rank, r.mix_slot) for r in out})
    assert results[0] == results[1] and len(results[0]) == 300
