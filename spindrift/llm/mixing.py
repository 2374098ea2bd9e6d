"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks of equal size. With weight share w, block k of a source is released at
slot floor(k / w) and due by slot ceil((k + 1) / w). Earliest deadline first among released blocks
fills every slot, and at any slot each source has had less than one block more or less than its
share. Shares are whole numbers of slots in a period, so one period is scheduled on the driver
(SLOTS_EACH slots for each source, or the given length if that is more, and more again where a weight
is small) and any block's slot follows from it by arithmetic. The driver holds one period, so more than MOST_SOURCES sources are refused.

Defined results: sources without a target weight, and null sources, are never scheduled; null
identifiers and repeated rows are rows like any other; an empty table gives an empty result; all
columns are kept, but ``mix_`` columns replace columns of these names. :func:`in_order` returns the
exact mixture and cuts what lies behind it, :func:`all_in_order` returns every row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import own_name

#: Slots of a period: shares are rounded to multiples of 1/PERIOD.
PERIOD = 10_000
#: A period has at least so many slots for each source, so that rounding up to one slot stays rare.
SLOTS_EACH = 10
#: Sources whose period the driver can hold.
MOST_SOURCES = 100_000
#: Slots up to which the period grows for the sake of small weights.
MOST_SLOTS = 250_000


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period, by largest remainder; every positive weight has one."""
    positive = {s: Fraction(w) for s, w in weights.items() if w > 0}
    if len(positive) > period:
        raise ValueError(f"{len(positive)} sources don't fit into a period of {period} slots")
    total, spare = sum(positive.values()), period - len(positive)
    exact = {s: w / total * period for s, w in positive.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    over, names = sum(slots.values()) - period, sorted(slots, reverse=True)
    most = [(exact[s] - slots[s], i) for i, s in enumerate(names) if slots[s] > 1] if over > 0 else []
    heapq.heapify(most)
    for _ in range(over):  # the smallest were rounded up to one
        gap, i = heapq.heappop(most)
        slots[names[i]] -= 1
        if slots[names[i]] > 1:
            heapq.heappush(most, (gap + 1, i))
    over = min(over, 0)
    for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[: -over if spare >= 0 else 0]:
        slots[s] += 1
    return slots


def enough_slots(weights: Mapping[str, float], period: int = PERIOD) -> int:
    """A period of so many slots or more, in which each source has some, and the smallest weight at
    least half a slot before rounding (but for weights below 1 / (2 * MOST_SLOTS))."""
    positive = [w for w in weights.values() if w > 0]
    smallest = math.ceil(sum(positive) / min(positive)) if positive else 0
    return max(period, SLOTS_EACH * len(positive), min(smallest, MOST_SLOTS))


def schedule(slots: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks."""
    period = sum(slots.values())
    release = lambda s, k: k * period // slots[s]
    due = lambda s, k: -(-(k + 1) * period // slots[s])
    waiting = [(0, s, 0) for s in sorted(slots)]
    ready: list[tuple[int, str, int]] = []
    order = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        order.append(s)
        if k + 1 < slots[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return order


def tempered(counts: Mapping[str, int], power: float) -> dict[str, float]:
    """Target weights that favour small sources: counts to a power below one."""
    return {s: float(n) ** power for s, n in counts.items()}


def counted(docs: DataFrame, source: str) -> list[tuple[str, int]]:
    """Rows of each source. A mixture has at most MOST_SOURCES sources, so more are refused."""
    found = docs.groupBy(F.col(f"`{source}`")).count().limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    return [(r[0], r[1]) for r in found]


def numbered(docs: DataFrame, source: str, doc_id: str) -> DataFrame:
    """Adds ``mix_rank``: the row's number within its source, from 0.

    Rows are dealt into chunks by a hash of the whole row; chunks are counted and numbered, then
    rows are numbered within their chunk, by identifier and that hash. Chunks and the rows of one grow
    with the square root of the table alike, so no source or identifier is ever in one task. Only rows
    that are equal in all columns are alike to the order, and may change places.
    """
    chunk, inside, start, name, whole = (own_name(w) for w in ("chunk", "inside", "start", "source", "whole"))
    chunks = max(1, math.isqrt(docs.count()) // 4)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    dealt = docs.withColumn(whole, F.xxhash64(*hashed)).withColumn(chunk, F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(whole)), F.lit(chunks)))
    counts = dealt.groupBy(F.col(f"`{source}`").alias(name), chunk).count()
    before = Window.partitionBy(name).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(name, chunk, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    order = Window.partitionBy(F.col(f"`{source}`"), chunk).orderBy(F.col(f"`{doc_id}`"), whole)
    ranked = dealt.withColumn(inside, F.row_number().over(order) - 1)
    same = ranked[f"`{source}`"].eqNullSafe(starts[name]) & (ranked[chunk] == starts[chunk])
    joined = ranked.join(starts, same).withColumn("mix_rank", (F.col(start) + F.col(inside)).cast("long"))
    return joined.drop(starts[chunk]).drop(start, name, inside, whole, chunk)


def horizon(counts: Mapping[str, int], slots: Mapping[str, int], block_rows: int) -> int:
    """The first slot whose source has no rows left; up to it all target weights hold."""
    period, places = sum(slots.values()), {}
    for at, s in enumerate(schedule(slots)):
        places.setdefault(s, []).append(at)
    blocks = {s: -(-counts.get(s, 0) // block_rows) for s in slots}
    return min((blocks[s] // n * period + places[s][blocks[s] % n] for s, n in slots.items()), default=0)


def mix(docs: DataFrame, weights: Mapping[str, float], block_rows: int = 8, period: int = PERIOD, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All rows with their place in the mixture.

    ``mix_rank`` numbers the rows of a source, ``mix_block`` its blocks; ``mix_slot`` is the slot of
    the block, ``mix_release`` and ``mix_deadline`` are its window; ``mix_in`` says whether the slot
    comes before the first one whose source has run dry, up to which the target weights hold.
    The period is longer than asked for where ``weights`` has many sources or small ones.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    period = enough_slots(weights, period)
    spark, slots = docs.sparkSession, shares(weights, period)
    period = sum(slots.values())
    seen: dict[str, int] = {}
    rows = []
    for at, s in enumerate(schedule(slots) if slots else []):
        rows.append((s, seen.get(s, 0), at, slots[s]))
        seen[s] = seen.get(s, 0) + 1
    # as many rows as slots: the period bounds it
    name, turn, at, width = (own_name(w) for w in ("source", "turn", "at", "width"))
    plan = spark.createDataFrame(rows, f"{name} string, {turn} long, {at} long, {width} long")
    key = F.col(f"`{source}`")
    counts = dict(counted(docs.join(F.broadcast(plan.select(name).distinct()), key == F.col(name), "left_semi"), source))
    end = horizon(counts, slots, block_rows)
    ranked = numbered(docs, source, doc_id).withColumn("mix_block", F.floor(F.col("mix_rank") / block_rows).cast("long"))
    widths = plan.groupBy(name).agg(F.first(width).alias(width))
    known = ranked.join(F.broadcast(widths), key == F.col(name), "left").drop(name)
    mine = own_name("turn")
    known = known.withColumn(mine, F.col("mix_block") % F.col(width))
    placed = known.join(F.broadcast(plan.select(name, turn, at)), (key == F.col(name)) & (F.col(mine) == F.col(turn)), "left").drop(name, turn, mine)
    return (
        placed.withColumn("mix_slot", (F.col("mix_block") / F.col(width)).cast("long") * period + F.col(at))
        .withColumn("mix_release", F.floor(F.col("mix_block") * period / F.col(width)).cast("long"))
        .withColumn("mix_deadline", F.ceil((F.col("mix_block") + 1) * period / F.col(width)).cast("long"))
        .withColumn("mix_in", F.coalesce(F.col("mix_slot") < end, F.lit(False)))
        .drop(at, width)
    )


def mix_tempered(docs: DataFrame, power: float = 0.7, block_rows: int = 8, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """:func:`mix` with target weights that favour small sources: their counts to ``power``."""
    found = counted(docs.where(F.col(f"`{source}`").isNotNull()), source)
    return mix(docs, tempered(dict(found), power), block_rows, source=source, doc_id=doc_id)


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the exact mixture in its order: files and rows within them follow the slots. Rows
    that aren't ``mix_in`` are cut; :func:`cut_rows` counts them."""
    return all_in_order(mixed.where("mix_in"), columns)


def all_in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """All rows in the order of their slots. Once a source has run dry its slots stay empty, and the
    others go on at their weights among themselves. Rows that have no slot come last."""
    order = [F.col("mix_slot").asc_nulls_last(), F.col("mix_rank")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in columns])


def cut_rows(mixed: DataFrame, source: str = "source") -> DataFrame:
    """(source, rows, cut): rows of each source, and those that :func:`in_order` leaves out."""
    return mixed.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("mix_in")).alias("cut"))
