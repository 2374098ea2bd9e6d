"""Suffix-array dedup: remove every byte that a long repeated string covers.

A string of ``length`` bytes is repeated if it starts anywhere else too, in the same document or in
another; all its occurrences go. :mod:`spindrift.llm.repeats` finds the strings. Equal texts are
one stream there: if there are several and they are long enough, they are covered from end to end.

A passage of many words may be shorter than that. It stays, but ``passage_words`` shows it: the words of
a text in strings of two thirds of ``passage`` words that a different text has too. They are looked
for at anchors of which every window of ``passage`` words has one: each shared passage shows, if not
to its ends, and shorter ones than two thirds never do.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; bytes are
those of UTF-8, and what is left may start within a character; null identifiers are labels like any
other; repeated rows are copies of each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.repeats import CHUNK, Shape, anchored, find, negative_powers, power_sums
from spindrift.llm.shared import MemberFilter, attach
from spindrift.session import discard, materialise

_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\n\v\f\r"]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 32-bit hash of each word; words end at ASCII white space."""
    x = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_BLANK[x].view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # as many words as fit the tables of powers
        base = starts[at]
        stop = int(np.searchsorted(ends, base + CHUNK, "right"))
        if stop == at:
            out[at] = xxhash.xxh3_64_intdigest(data[base : ends[at]])
            at += 1
            continue
        sums = power_sums(x[base : ends[stop - 1]])
        a, z = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[z] - sums[a]) * negative_powers()[a]
        at = stop
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(32)).astype(np.uint32)


def shared_strings(streams: DataFrame, passage: int) -> DataFrame:
    """(sid, first, last): words of each text in strings of two thirds of ``passage`` words that another
    text has too, at the anchors of its windows of ``passage`` words. Every window has an anchor, and
    equal windows have equal ones: so each shared passage shows, and nothing shorter than two thirds."""
    shape = Shape(passage, -(-2 * passage // 3), 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((sid, 0, word_hashes(data)) for batch in batches for sid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for found in anchored(rows, shape):
            sids = pa.array(found.sids, pa.binary()).take(pa.array(found.own))
            yield pa.RecordBatch.from_arrays([pa.array(found.h.view(np.int64)), sids, pa.array((found.place + found.shift).astype(np.int32))], ["key", "sid", "first"])

    # a word and the blank before it take two bytes at least
    long = streams.where(F.length("data") >= 2 * passage - 1).select("sid", "data")
    placed = materialise(long.mapInArrow(run, "key long, sid binary, first int"), "repeats-words", compression="zstd")
    name = F.xxhash64("sid")
    repeated = materialise(placed.groupBy("key").agg((F.min(name) < F.max(name)).alias("several")).where("several").select("key"), "repeats-shared")
    hits = MemberFilter(repeated, "key").keep(placed, "key").join(repeated, "key", "left_semi")
    hits = hits.select("sid", F.col("first").cast("long").alias("first"), (F.col("first") + (shape.gram - 1)).cast("long").alias("last"))
    hits = materialise(hits, "repeats-hits", compression="zstd")
    discard(placed)
    discard(repeated)
    return hits


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted maximal ranges [start, end) of inclusive ranges {first, last}."""
    out: list[tuple[int, int]] = []
    for s in sorted((s["first"], s["last"] + 1) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept, passage_words``: removed ranges [start, end), the bytes that
    are left, and the text's words in long strings that another text has too (0 if ``passage`` is 0)."""
    data = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), data.alias("data"))
    rows = rows.withColumn("sid", F.substring(F.unhex(F.sha2("data", 256)), 1, 16))
    least = min(length, 2 * passage - 1) if passage else length
    # a text with copies goes whole, so its ranges aren't needed; for others one of the copies will do
    copies = rows.where(F.length("data") >= least).groupBy("sid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = once = materialise(copies, "repeats-copies")
    streams = MemberFilter(copies, "sid").mark(rows.where(F.length("data") >= least), "sid")
    again = materialise(streams.where("hit").groupBy("sid").agg(F.first("data").alias("data")), "repeats-copied", compression="zstd")
    streams = streams.where("NOT hit").select("sid", "data").unionByName(again).select("sid", F.lit(0).cast("long").alias("salt"), "data")
    spans = find(streams.where(F.length("data") >= length), Shape(length, length // 2, 1))

    copies = copies.join(again.where(F.length("data") >= length), "sid", "left_semi")
    ranges = F.collect_list(F.struct("first", "last"))
    listed = spans.join(copies, "sid", "left_anti").groupBy("sid").agg(ranges.alias("spans"))
    marks, scratch = listed.unionByName(copies, allowMissingColumns=True), [spans, again, once]
    if passage:
        shared = shared_strings(streams, passage)
        scratch.append(shared)
        marks = marks.unionByName(shared.groupBy("sid").agg(ranges.alias("passages")), allowMissingColumns=True)
    else:
        marks = marks.withColumn("passages", F.lit(None).cast(listed.schema["spans"].dataType))
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    marks = marks.groupBy("sid").agg(one("spans"), one("passages"), one("copies")).join(rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid")
    marks = materialise(marks.select("sid", "spans", "passages", "copies", "n"), "repeats-marks")
    for table in scratch:
        discard(table)
    probed = MemberFilter(marks.select("sid"), "sid").mark(rows, "sid")
    total = max(1, rows.count())
    clean = probed.where("NOT hit")
    touched = attach(probed.where("hit").drop("hit"), marks, "sid", "n", total).select("doc_id", "data", "copies", "spans", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, sizes, shared = [], [], [], []
            for i in range(batch.num_rows):
                data, n = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                ranges = [(0, len(data))] if n and n > 1 else merged(batch.column(3)[i].as_py() or [])
                at, left = 0, []
                for start, end in ranges:
                    left.append(data[at:start])
                    at = end
                left.append(data[at:])
                sizes.append(len(data))
                kept.append(b"".join(left))
                removed.append([{"start": a, "end": z} for a, z in ranges])
                shared.append(sum(z - a for a, z in merged(batch.column(4)[i].as_py() or [])))
            ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, ranges_type), pa.array(kept, pa.binary()), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept", "passage_words"])

    kind = docs.schema[doc_id].dataType.simpleString()
    cut = touched.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, passage_words long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return cut.unionByName(clean.select("doc_id", F.length("data").cast("long").alias("n_bytes"), none.alias("removed"), F.col("data").alias("kept"), F.lit(0).cast("long").alias("passage_words")))
