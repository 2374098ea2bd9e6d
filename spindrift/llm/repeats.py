"""Stretches of token streams that occur more than once, by suffix arrays over matching regions.

A stretch of ``length`` tokens is anchored at its smallest hashed gram of ``gram`` tokens (leftmost
on ties). Equal stretches have equal anchors at equal places, so whatever can match shares an
anchor's hash. The streams are read three times, and never move whole:

1. Anchors' hashes are counted; the repeated ones go into a bit filter of bounded size.
2. Each anchor in the filter stands for a run of starts. The run's region is hashed: a region that
   occurs twice is repeated as a whole. Where an anchor has several regions, these are compared.
3. These regions are sorted by anchor into shards. Per shard, a suffix array is built by
   Larsson-Sadakane refinement and common prefixes by Kasai's walk, all in numpy; starts whose
   neighbour agrees over ``length`` tokens are repeated. Before that, regions are left out that share
   no part's content with another one. Anchors with very many regions are first told apart by that
   content; should very many regions share it still, as at a popular passage's ends, their
   stretches, of which each has few, are told apart one by one. So a shard has SHARD_TOKENS and the
   MANY_REGIONS of one key at most, whatever a passage's popularity.

Shards are cut by anchor, so what must be compared is in one shard, and no shard has to be searched
in another: searching each in each takes time quadratic in their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import discard, materialise

#: Tokens that are looked at at a time; more bits than this would not fit beside a hash.
CHUNK = 1_000_000
#: Tokens up to which streams are put together, which spares calls; no more than a chunk.
BATCH = 200_000
#: Tokens of regions per suffix array, and regions of an anchor beyond which it is told apart.
SHARD_TOKENS, MANY_REGIONS = 500_000, 2000
#: Tokens that are compared at once where more than one is alike.
STRIDE = 32
#: Longer content tells starts apart in this many parts.
PARTS = 8
#: Bits of the filters: 16 a member within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1024, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POWERS:
        _POWERS.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    return _POWERS


def power_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the tokens before each place, weighted by powers; up to CHUNK tokens."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + _U(1)) * _tables()[0][: len(x)], out=sums[1:])
    return sums


def negative_powers() -> np.ndarray:
    """What makes a difference of :func:`power_sums` the same wherever its tokens stand."""
    return _tables()[1]


@dataclass(frozen=True)
class Shape:
    """Stretches of ``length`` tokens, anchored by grams of ``gram``; ``width`` bytes a token."""

    length: int
    gram: int
    width: int

    def tokens(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint8 if self.width == 1 else np.uint32)

    @property
    def step(self) -> int:
        return -(-(self.length - self.gram + 1) // PARTS)

    def parts(self, off: int, last: int) -> Iterator[tuple[int, int, int]]:
        """Starts 0 to ``last`` of a region whose anchor is at ``off``, in parts: number, and the
        first and last start that the part has in any region."""
        for t in range((off - last) // self.step, off // self.step + 1):
            yield t, off - t * self.step - self.step + 1, off - t * self.step


def anchors(x: np.ndarray, shape: Shape, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first start, last start and hash of each anchor of up to CHUNK tokens. ``sizes``: of the
    streams that stand one after another in ``x``; no stretch is in two of them."""
    n, length, gram = len(x), shape.length, shape.gram
    if n < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    sums = power_sums(x)
    h = (sums[gram:] - sums[:-gram]) * negative_powers()[: n - gram + 1]
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    g, window, starts = len(h), length - gram + 1, n - length + 1
    value = (h & ~_U((1 << 20) - 1)) | np.arange(g, dtype=np.uint64)
    # smallest of each window: from prefixes and suffixes of blocks of the window's size
    blocks = -(-g // window)
    padded = np.full(blocks * window, ~_U(0), np.uint64)
    padded[:g] = value
    padded = padded.reshape(blocks, window)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[:starts], before[window - 1 : window - 1 + starts]) & _U((1 << 20) - 1)).astype(np.int32)
    if sizes is not None:
        # the last starts of each stream would reach into the next
        ends = np.cumsum(sizes)
        edges = np.zeros(n + 1, np.int8)
        np.add.at(edges, np.maximum(ends - sizes, ends - length + 1)[:-1], 1)
        np.add.at(edges, ends[:-1], -1)
        at[np.cumsum(edges[:starts]) > 0] = -1
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts - 1, [starts - 1]))
    kept = at[first] >= 0
    first, last = first[kept], last[kept]
    place = at[first].astype(np.int64)
    return place, first, last, h[place]


@dataclass
class Anchors:
    """Anchors of several streams: those of ``x`` belong to streams ``own`` of ``sids``, and stand there
    ``shift`` further on."""

    x: np.ndarray
    sids: list[bytes]
    own: np.ndarray
    shift: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    h: np.ndarray

    def at(self, hit: np.ndarray) -> Anchors:
        return Anchors(self.x, self.sids, *(c[hit] for c in (self.own, self.shift, self.place, self.first, self.last, self.h)))


def anchored(streams: Iterable[tuple[bytes, int, np.ndarray]], shape: Shape) -> Iterator[Anchors]:
    """Anchors of streams (sid, salt, tokens), several at a time; salts go into the hashes."""
    held: list[tuple[bytes, int, int, np.ndarray]] = []
    size = 0

    def found() -> Anchors:
        sizes = np.array([len(part) for *_, part in held])
        x = np.concatenate([part for *_, part in held]) if len(held) > 1 else held[0][3]
        place, first, last, h = anchors(x, shape, sizes)
        begins = np.cumsum(sizes) - sizes
        own = np.searchsorted(begins, first, "right") - 1
        salts = np.array([salt & (1 << 64) - 1 for _, salt, *_ in held], np.uint64)
        shift = np.array([start for _, _, start, _ in held]) - begins
        return Anchors(x, [sid for sid, *_ in held], own, shift[own], place, first, last, h ^ salts[own])

    for sid, salt, tokens in streams:
        for start, part in _chunks(tokens, shape):
            if len(part) < shape.length:
                continue
            if held and size + len(part) > BATCH:
                yield found()
                held, size = [], 0
            held.append((sid, salt, start, part))
            size += len(part)
    if held:
        yield found()


def _chunks(x: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces whose starts don't overlap."""
    step = CHUNK - shape.length + 1
    for at in range(0, max(1, len(x) - shape.length + 1), step):
        yield at, x[at : at + CHUNK]


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The suffixes of ``x`` in order.

    Larsson-Sadakane: in each round, only groups that are still tied are sorted, by the ranks of the
    suffixes that begin where the known prefix ends, and where it would end a second time.
    """
    n = len(x)
    if x.max(initial=0) < (1 << 16) - 1:  # four tokens make one number
        y = np.append(x + 1, (0, 0, 0)).astype(np.uint64)
        y, known = y[:n] << _U(48) | y[1 : n + 1] << _U(32) | y[2 : n + 2] << _U(16) | y[3:], 4
    else:
        y, known = x, 1
    order = np.argsort(y)
    ranked = y[order]
    heads = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    place = np.arange(n)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, place, 0))
    tied = np.flatnonzero(~(heads & np.append(heads[1:], True)))
    bits = n.bit_length()
    three = 3 * bits < 64  # ranks make one number
    while len(tied):
        members = order[tied]
        key = rank[members] * (n + 1) + rank[np.minimum(members + known, n)] + 1
        if three:
            key = (key << bits) + rank[np.minimum(members + 2 * known, n)] + 1
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[tied] = members
        heads = np.concatenate(([True], key[1:] != key[:-1]))
        rank[members] = np.maximum.accumulate(np.where(heads, tied, 0))
        tied = tied[~(heads & np.append(heads[1:], True))]
        known *= 3 if three else 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, tokens shared with the one before it in order, up to ``most``.

    Kasai's walk along the text, one region per lane: the next suffix shares at least one token
    less than the last one did.
    """
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.append(x, np.full(STRIDE, -1))
    stride = np.arange(STRIDE)
    lanes, h = np.arange(len(begins)), np.zeros(len(begins), np.int64)
    for step in range(int((ends - begins).max(initial=0))):
        lanes = lanes[begins[lanes] + step < ends[lanes]]
        i = begins[lanes] + step
        j = before[i]
        length = np.where(j >= 0, np.maximum(h[lanes] - 1, 0), 0)
        live = np.flatnonzero((j >= 0) & (length < most))
        # no match goes beyond a region's end, which is unlike any other token; most end at the first
        if step:
            now = length[live]
            live = live[padded[i[live] + now] == padded[j[live] + now]]
            length[live] += 1
            live = live[length[live] < most]
        while len(live):
            a, b = i[live] + length[live], j[live] + length[live]
            unlike = padded[a[:, None] + stride] != padded[b[:, None] + stride]
            ended = unlike.any(axis=1)
            length[live] += np.where(ended, unlike.argmax(axis=1), STRIDE)
            live = live[~ended & (length[live] < most)]
        length = np.minimum(length, most)
        shared[i], h[lanes] = length, length
    return shared


def repeated_starts(regions: list[np.ndarray], owners: list[int], length: int) -> list[np.ndarray]:
    """For each region, which of its starts are stretches that another owner has too."""
    sizes = np.array([len(r) for r in regions])
    top = max(int(r.max(initial=0)) for r in regions) + 1
    # every region ends in a token of its own, so that nothing matches across ends
    x = np.concatenate([np.append(r.astype(np.int64), top + i) for i, r in enumerate(regions)])
    if top >= 1 << 15:  # numbers without gaps are smaller
        x = np.unique(x, return_inverse=True)[1]
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = suffix_array(x)
    shared = common_prefixes(x, order, begins, begins + sizes - length + 1, length)
    # runs of suffixes that agree over the whole length
    joined = shared[order] >= length
    run = np.cumsum(~joined)
    owner = np.repeat(np.asarray(owners), sizes + 1)[order]
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    several = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
    found = np.zeros(len(x), bool)
    found[order] = several[run - run[0]]
    return [found[b : b + s - length + 1] for b, s in zip(begins, sizes)]


def _spans(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    yield from zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())


class Bits:
    """A bit filter of 64-bit hashes as a numpy array; it never misses a member."""

    def __init__(self, members: DataFrame, key: str = "key"):
        n = members.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
        b = F.col(key).bitwiseAND(F.lit(self.bits - 1))
        words = members.select(F.shiftright(b, 6).alias("w"), b.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words.column("w").to_numpy()] = words.column("v").to_numpy()

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & _U(self.bits - 1)
        return (self.words.view(np.uint64)[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def _name(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "big")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def find(streams: DataFrame, shape: Shape, across: bool = False) -> DataFrame:
    """(sid, first, last): distinct token ranges of each stream that repeated stretches cover.

    ``streams(sid binary, salt long, data binary)``. Streams match only under equal ``salt``. Rows
    of one ``sid`` are one stream to others: what only they share with each other isn't repeated,
    unless at another place; with ``across``, not even then. Ranges may touch and overlap. The rows
    are read three times, so they must come from tables.
    """
    spark = streams.sparkSession
    elsewhere = F.min("sid") < F.max("sid")
    twice = (elsewhere if across else elsewhere | (F.min("a") < F.max("a"))).alias("twice")

    def keyed(batches: Iterator[pa.RecordBatch], only: Bits | None = None) -> Iterator[Anchors]:
        def rows() -> Iterator[tuple[bytes, int, np.ndarray]]:
            for batch in batches:
                sids, salts, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
                own = range(batch.num_rows)
                if only is not None:
                    own = np.flatnonzero(only.has(np.array([_name(x) for x in sids], np.uint64))).tolist()
                for i in own:
                    yield sids[i], salts[i], shape.tokens(datas[i].as_py())

        yield from anchored(rows(), shape)

    def marks(x: np.ndarray, a: Anchors) -> list[int]:
        """A hash of each anchor's region and of the anchor's place there."""
        data, w, digest = x.tobytes(), shape.width, xxhash.xxh3_64_intdigest
        return [digest(data[i:j], off) for i, j, off in zip((a.first * w).tolist(), ((a.last + shape.length) * w).tolist(), (a.place - a.first).tolist())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in keyed(batches):
            held.append(found.h)
            size += len(found.h)
            if size > 500_000:
                yield tally(held)
                held, size = [], 0
        if held:
            yield tally(held)

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "c"])

    counted = streams.mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where("c > 1")
    keys = materialise(counted.select("key"), "repeats-keys")
    repeated = spark.sparkContext.broadcast(Bits(keys))
    discard(keys)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in keyed(batches):
            a = found.at(np.flatnonzero(repeated.value.has(found.h)))
            if len(a.h):
                mark = np.array(marks(a.x, a), np.uint64).view(np.int64)
                sids = pa.array(a.sids, pa.binary()).take(pa.array(a.own))
                columns = [pa.array(a.h.view(np.int64)), pa.array(mark), sids, pa.array(a.first + a.shift), pa.array(a.last + a.shift)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "mark", "sid", "a", "b"])

    schema = "key long, mark long, sid binary, a long, b long"
    seen = materialise(streams.mapInArrow(occurrences, schema), "repeats-seen", compression="zstd")
    holders = seen.select("sid").distinct().select(F.expr("conv(hex(substring(sid, 1, 8)), 16, -10)").cast("long").alias("key"))
    regions = materialise(seen.groupBy("key", "mark").agg(twice), "repeats-regions")
    several = regions.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("twice")).alias("lone")).where("n > 1 AND lone > 0")
    several = materialise(several, "repeats-open")
    whole = seen.join(regions.where("twice").select("key", "mark"), ["key", "mark"], "left_semi")

    many = several.where(F.col("n") > MANY_REGIONS)
    opened, crowded, holding = (spark.sparkContext.broadcast(Bits(x)) for x in (several, many, holders))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "mark", "sid", "a", "b", "off", "region"]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        out: list[list] = [[] for _ in names]
        seen: dict[tuple[int, int], tuple[bytes, int] | None] = {}
        size = 0

        def add(key: int, mark: int, sid: bytes, a: int, b: int, off: int, region: bytes | None) -> None:
            for column, v in zip(out, (_signed(key), _signed(mark), sid, a, b, off, region)):
                column.append(v)

        for found in keyed(batches, holding.value):
            hit = found.at(np.flatnonzero(opened.value.has(found.h)))
            if not len(hit.h):
                continue
            x, full = hit.x, crowded.value.has(hit.h).tolist()
            columns = (c.tolist() for c in (hit.own, hit.shift, hit.place, hit.first, hit.last, hit.h))
            for own, shift, q, a, b, key, mark, split in zip(*columns, marks(x, hit), full):
                sid = hit.sids[own]
                if not split:
                    # once a region was seen at two places, which make it repeated as a whole, that will do
                    known, here = seen.get((key, mark), ()), (sid, a + shift)
                    if known is None or known == here:
                        continue
                    again = bool(known) and (known[0] != sid or not across)
                    seen[key, mark] = None if again else here
                    add(key, mark, *here, b + shift, q - a, None if again else x[a : b + shape.length].tobytes())
                    size += (b - a + shape.length) * shape.width
                    continue
                for t, low, high in shape.parts(q - a, b - a):
                    # all stretches of this part hold the tokens between its last start and its first end
                    content = x[a + high : a + low + shape.length].tobytes()
                    low, high = a + max(0, low), a + min(b - a, high)
                    region = x[low : high + shape.length].tobytes()
                    mark = xxhash.xxh3_64_intdigest(region, seed=q - low)
                    add(xxhash.xxh3_64_intdigest(content, seed=key ^ (t & 0xFFFF)), mark, sid, low + shift, high + shift, q - low, region)
                    size += len(region)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                out, size = [[] for _ in names], 0
                if len(seen) > 500_000:
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    held = materialise(streams.mapInArrow(texts, schema + ", off int, region binary"), "repeats-texts", compression="zstd")
    distinct = held.groupBy("key", "mark").agg(F.any_value("region", True).alias("region"), F.min("sid").alias("sid"), twice, F.min("off").alias("off"))
    distinct = distinct.select("key", "mark", "region", "twice", "sid", "off")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by key; a shard has whole keys
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD_TOKENS and row[0] != group[-1][0]:
                    yield shard(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[2]) // shape.width
        if group:
            yield shard(group)

    def shard(group: list[tuple]) -> pa.RecordBatch:
        length, w = shape.length, shape.width
        # a region can only match where it shares a part's content with another one; what is repeated
        # as a whole is only looked at for the sake of others
        contents = [[xxhash.xxh3_64_intdigest(region[high * w : (low + length) * w], seed=key & 0xFFFFFFFF) for _, low, high in shape.parts(off, len(region) // w - length)] for key, _, region, _, _, off in group]
        times = Counter(c for own in contents for c in own)
        asked = {c for g, own in zip(group, contents) if not g[3] for c in own if times[c] > 1}
        left = [g for g, own in zip(group, contents) if not asked.isdisjoint(own)]
        rows = [(g[0], g[1], 0, len(g[2]) // w - length) for g in group if g[3]]
        if left:
            owners = list(range(len(left)))
            if across:  # regions of one stream count once, unless they are repeated as a whole
                names: dict[bytes, int] = {}
                owners = [-1 - i if g[3] else names.setdefault(g[4], i) for i, g in enumerate(left)]
            for g, flags in zip(left, repeated_starts([shape.tokens(g[2]) for g in left], owners, length)):
                if not g[3]:
                    rows.extend((g[0], g[1], lo, hi) for lo, hi in _spans(flags))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 4)], ["key", "mark", "lo", "hi"])

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "key long, mark long, lo long, hi long")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every stretch by itself: there may be any number of regions, but each has few starts
        for batch in batches:
            for i in range(batch.num_rows):
                key, mark, region, twice, sid, _ = (c[i].as_py() for c in batch.columns)
                w, length = shape.width, shape.length
                n = len(region) // w - length + 1
                names = [xxhash.xxh3_128_digest(region[lo * w : (lo + length) * w]) for lo in range(n)]
                columns = [[key] * n, [mark] * n, range(n), names, [twice] * n, [sid] * n]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "mark", "lo", "name", "twice", "sid"])

    scratch = [seen, regions, several, held]
    if many.isEmpty():
        found = materialise(compared(distinct), "repeats-found")
    else:
        distinct = materialise(distinct, "repeats-distinct")
        full = materialise(distinct.groupBy("key").count().where(F.col("count") > MANY_REGIONS).select("key"), "repeats-full")
        single = distinct.join(full, "key", "left_semi").select(distinct.columns)
        single = materialise(single.mapInArrow(stretches, "key long, mark long, lo long, name binary, twice boolean, sid binary"), "repeats-stretches")
        again = F.max("twice") | (elsewhere if across else F.count(F.lit(1)) > 1)
        again = single.groupBy("key", "name").agg(again.alias("again")).where("again").select("key", "name")
        apart = single.join(again, ["key", "name"], "left_semi").select("key", "mark", "lo", F.col("lo").alias("hi"))
        rest = distinct.join(full, "key", "left_anti").select(distinct.columns)
        found = materialise(compared(rest).unionByName(apart), "repeats-found")
        scratch += [distinct, full, single]

    last = shape.length - 1
    parts = held.select("key", "mark", "sid", "a").join(found, ["key", "mark"])
    inside = parts.select("sid", (F.col("a") + F.col("lo")).alias("first"), (F.col("a") + F.col("hi") + last).alias("last"))
    ranges = whole.select("sid", F.col("a").alias("first"), (F.col("b") + last).alias("last")).unionByName(inside).distinct()
    ranges = materialise(ranges, "repeats-ranges")
    for table in (*scratch, found):
        discard(table)
    return ranges
