"""Line dedup: a segment-partition join finds lines within EDITS edits, one line of a class stays.

Lines are compared by code points, so that an edit is one letter of any script. How many edits link two
lines follows from their length: none below LEAST, EDITS from there, where they are a tenth of it or
less. A line of length l is cut into EDITS + 1 segments at fixed
places; two lines within EDITS edits share one of them, at nearly the same place. Each distinct
line puts its own segments into the index and probes the index with those of its substrings that
could be a segment of a line of its length or up to EDITS shorter (windows narrowed from the left
and from the right). Candidates are verified by banded bit-parallel edit distance.

Links make classes: equal lines, and what links connect. As in near dedup of documents, each key's
lines are first held against one of them; only keys whose lines are then in several classes are
compared across, in bounded blocks, and pairs within a class need no comparison. Over the whole
corpus, the first line of a class stays, by doc_id and then by place; the others go.

Defined results: a null text counts as empty and has no lines; blank lines are never dropped; lines
shorter than LEAST are linked with equal ones only; null identifiers come first; rows that
repeat an identifier and a text are treated alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.graph import components
from spindrift.llm.repeats import Bits
from spindrift.llm.shared import MemberFilter, attach
from spindrift.session import discard, materialise

#: Edits that link two lines, and code points from which they do.
EDITS, LEAST = 2, 20
#: Lines of a key that are compared with as many others at a time.
BLOCK = 2048
_U = np.uint64


def cuts(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Place and size of the segments of a line; the last ones take what doesn't divide evenly."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        step = size + (i >= parts - longer)
        out.append((at, step))
        at += step
    return out


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(shorter by, segment, place, size) of the substrings to look up, without the line's own
    segments, which are in the index anyway."""
    out = []
    for less in range(edits + 1):
        for i, (at, size) in enumerate(cuts(length - less, edits)):
            low = max(at - i, at + less - (edits - i), 0)
            high = min(at + i, at + less + (edits - i), length - size)
            out.extend((less, i, place, size) for place in range(low, high + 1) if less or place != at)
    return out


def within(a: bytes | str, b: bytes | str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most ``edits``: banded, one bit per diagonal.

    Row by row, bit d of ``level[e]`` says that diagonal d is reached with e edits. The band has
    2 * edits + 1 diagonals, so a row is a few operations on small integers.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    if a == b:
        return True
    # equal ends cost nothing
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    if low:
        a, b = a[:-low], b[:-low]
    # bit k of a level stands for column j = i + k - edits of row i
    width = 2 * edits + 1
    whole = (1 << width) - 1
    levels = []
    for e in range(edits + 1):
        levels.append(sum(1 << (edits + j) for j in range(e + 1) if j <= len(b)))
    for i in range(1, len(a) + 1):
        match = 0
        c = a[i - 1]
        for k in range(width):
            j = i + k - edits
            if 1 <= j <= len(b) and b[j - 1] == c:
                match |= 1 << k
        inside = whole
        over, under = i + edits - len(b), edits - i
        if over > 0:
            inside &= whole >> over if over <= width else 0
        if under > 0:
            inside &= ~((1 << under) - 1)
        new, below = [], 0
        for e in range(edits + 1):
            reached = levels[e] & match
            if e:
                last = levels[e - 1]
                # substitute (same diagonal), delete from a (one diagonal down), insert (one up, this row)
                reached |= last | last >> 1 | below << 1
            reached &= inside
            new.append(reached)
            below = reached
        levels = new
        if not levels[-1]:
            return False
    return bool(levels[-1] >> (len(b) - len(a) + edits) & 1)


def lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _id(line: bytes) -> int:
    """Signed 64-bit name of a line."""
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >= 1 << 63 else h


def line_keys(line: bytes, plans: dict[int, list[tuple[int, int, int]]]) -> list[int] | None:
    """Hashes of a line's own segments, EDITS + 1 of them, and of the substrings that it looks up; none
    for a short line. ``plans`` remembers what to cut from lines of a length."""
    letters = None if line.isascii() else line.decode()
    n = len(line) if letters is None else len(letters)
    if n < LEAST:
        return None
    plan = plans.get(n)
    if plan is None:
        own = [(at, at + size, n * 4 + i) for i, (at, size) in enumerate(cuts(n))]
        plan = plans[n] = own + [(at, at + size, (n - less) * 4 + i) for less, i, at, size in probes(n)]
    digest = xxhash.xxh3_64_intdigest
    if letters is None:
        return [digest(line[a:z], seed) for a, z, seed in plan]
    return [digest(letters[a:z].encode(), seed) for a, z, seed in plan]


def _segments(rows: DataFrame) -> DataFrame:
    """(key, lid): index rows and probe rows of the distinct long lines of each task. The last bit
    of a key says that it is a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list[tuple[int, int, int]]] = {}
        seen: set[int] = set()
        for batch in batches:
            keys, ids, counts = [], [], []
            texts = batch.column("text")
            for i in range(batch.num_rows):
                for line in lines(texts[i].as_py()):
                    if len(line) < LEAST:
                        continue
                    lid = _id(line)
                    if lid in seen:
                        continue
                    seen.add(lid)
                    found = line_keys(line, plans)
                    if found is None:
                        continue
                    keys.extend(found)
                    ids.append(lid)
                    counts.append(len(found))
                    if len(ids) > 20_000:
                        yield packed(keys, ids, counts)
                        keys, ids, counts = [], [], []
            if ids:
                yield packed(keys, ids, counts)
            if len(seen) > 1_000_000:
                seen.clear()

    def packed(keys: list[int], ids: list[int], counts: list[int]) -> pa.RecordBatch:
        sizes = np.array(counts)
        at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        marked = (np.array(keys, np.uint64) & ~_U(1) | (at > EDITS).astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(marked), pa.array(np.repeat(np.array(ids, np.int64), sizes))], ["key", "lid"])

    return rows.mapInArrow(run, "key long, lid long")


def _met(segments: DataFrame) -> DataFrame:
    """(key, lid, centre): lines that share a key with an index line other than themselves.

    Rows of a key come with its index rows first, so a key's centre is known from its first row and
    nothing has to be held, however many lines share it. Any index line will do as the centre.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marked, ids = (batch.column(i).to_numpy() for i in range(2))
            keys, probe = marked >> 1, (marked & 1).astype(bool)
            heads = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
            at = np.maximum.accumulate(np.where(heads, np.arange(n), -1))
            first, indexed = ids[at], ~probe[at]
            if centre is not None:
                first, indexed = np.where(at < 0, centre[0], first), np.where(at < 0, centre[1], indexed)
            elif at[0] < 0:
                raise AssertionError("a key without a first row")
            key, centre = keys[-1], (first[-1], indexed[-1])
            kept = indexed & (ids != first)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (keys, ids, first)], ["key", "lid", "centre"])

    # one sort column, which Spark sorts by radix
    dealt = segments.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, lid long, centre long").distinct()


def _line_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, line) of the wanted lines and few others."""
    sent = rows.sparkSession.sparkContext.broadcast(Bits(wanted, "lid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, bytes] = {}
            for i in range(batch.num_rows):
                found.update((_id(x), x) for x in lines(batch.column("text")[i].as_py()) if len(x) >= LEAST)
            ids = np.fromiter(found, np.int64, len(found))
            hit = np.flatnonzero(sent.value.has(ids.view(np.uint64)))
            every = list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([every[i] for i in hit], pa.binary())], ["lid", "line"])

    return rows.mapInArrow(run, "lid long, line binary").groupBy("lid").agg(F.any_value("line").alias("line"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.withColumnsRenamed({"lid": "b", "line": "line_b"}), "b").join(texts.withColumnsRenamed({"lid": "a", "line": "line_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(x.decode(), y.decode()) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def _across(open_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between lines of different components under one key; see the module's description.

    A pair is looked at under the first key that it shares, counting those that are a segment of one of
    the two, which any two lines within EDITS edits share.
    """
    plans: dict[int, list[tuple[int, int, int]]] = {}
    sized = open_rows.withColumn("block", F.expr("CAST(pmod(xxhash64(lid), blocks) AS INT)"))
    paired = sized.select("key", "lid", "component", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    paired = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "lid", "component", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, name = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != name:
                    yield compare(name, group)
                    group, name = [], row[:3]
                # keys as in _segments, without their mark
                found = [h >> 1 for h in line_keys(row[6], plans)]
                group.append((*row[3:6], row[6].decode(), set(found[: EDITS + 1]), set(found)))
        yield compare(name, group)

    def compare(name: tuple | None, group: list[tuple]) -> pa.RecordBatch:
        links: tuple[list[int], list[int]] = ([], [])
        members: dict[int, list[int]] = {}
        for at, (_, part, *_) in enumerate(group):
            members.setdefault(part, []).append(at)
        while len(members) > 1:
            # the smallest class is held against all others; what it joins goes on with it
            part = min(members, key=lambda p: (len(members[p]), p))
            own = members.pop(part)
            for other in list(members):
                pair = next(((x, y) for x in own for y in members[other] if meet(name, group[x], group[y]) and within(group[x][3], group[y][3])), None)
                if pair:
                    links[0].append(group[pair[0]][0])
                    links[1].append(group[pair[1]][0])
                    members[other].extend(own)
                    break
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    def meet(name: tuple, x: tuple, y: tuple) -> bool:
        if name[1] != name[2] and x[2] == y[2]:
            return False
        shared = (x[4] & y[5]) | (y[4] & x[5])
        return bool(shared) and min(shared) == name[0] & (1 << 63) - 1

    held = paired.join(texts, "lid").select("key", "i", "j", "lid", "component", "block", "line")
    return held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def line_classes(rows: DataFrame) -> DataFrame:
    """(lid, component) of lines that are linked with a different line; rows have a ``text``."""
    rows = rows.select("text")
    met = materialise(_met(_segments(rows)), "lines-met")
    texts = materialise(_line_texts(rows, met.select(F.explode(F.array("lid", "centre")).alias("lid")).distinct()), "lines-texts")
    stars = met.select(F.least("lid", "centre").alias("a"), F.greatest("lid", "centre").alias("b")).distinct()
    verified = materialise(_verified(stars, texts), "lines-links")
    first = components(verified)
    every = met.select("key", "lid").unionByName(met.select("key", F.col("centre").alias("lid"))).distinct()
    placed = every.join(first.withColumnRenamed("id", "lid"), "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    several = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("open"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    # two lines of a key have been compared already
    open_rows = placed.join(several.where("open AND n > 2"), "key").select("key", "lid", "component", "blocks")
    open_rows = materialise(open_rows, "lines-open")
    links = _across(open_rows, texts).unionByName(first.select(F.col("component").alias("a"), F.col("id").alias("b")))
    classes = components(links).withColumnRenamed("id", "lid")
    for table in (met, texts, verified, open_rows):
        discard(table)
    return classes


def _occurrences(rows: DataFrame) -> DataFrame:
    """(rid, doc, at, lid) of every line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, docs = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            out: tuple[list, ...] = ([], [], [], [])
            for i, (rid, doc) in enumerate(zip(rids, docs)):
                for at, line in enumerate(lines(texts[i].as_py())):
                    if line and not line.isspace():
                        for column, v in zip(out, (rid, doc, at, _id(line))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rid", "doc", "at", "lid"])

    return rows.mapInArrow(run, "rid long, doc long, at long, lid long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, dropped in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist()):
            gone = set(dropped)
            kept.append("\n".join([x for at, x in enumerate((text or "").split("\n")) if at not in gone]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_lines", "n_linked", "dropped")] + [pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_linked", "dropped", "kept"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_linked, dropped, kept``: non-blank lines, those with another line in
    their class, numbers of the lines that go, and the text that stays."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    placed = materialise(_occurrences(rows), "lines-placed")
    each = placed.groupBy("lid").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialise(line_classes(rows), "lines-classes")
    named = each.join(classes, "lid", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "lid"))
    named = materialise(named, "lines-named")
    keep = named.groupBy("component").agg(F.min("first").alias("keep"))
    marks = materialise(named.join(keep, "component").select("lid", "n", "keep"), "lines-marks")

    found = MemberFilter(marks, "lid").keep(placed, "lid")
    judged = attach(found, marks, "lid", "n", max(1, placed.count())).where("n IS NOT NULL")
    gone = F.when(~(F.col("doc").eqNullSafe(F.col("keep.doc")) & F.col("at").eqNullSafe(F.col("keep.at"))), F.col("at"))
    # a row's name is a hash; its identifier goes with it
    touched = materialise(judged.groupBy("rid", F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_set(gone)).alias("dropped"), F.size(F.collect_set("at")).cast("long").alias("n_linked")), "lines-touched")
    for table in (placed, classes, named, marks):
        discard(table)

    n_lines = F.expr(r"CAST(size(filter(split(coalesce(text, ''), '\n'), l -> btrim(l, ' \t\n\u000B\f\r') <> '')) AS BIGINT)")
    marked = MemberFilter(touched, "rid").mark(rows, "rid")
    none = F.array().cast("array<bigint>")
    whole = F.coalesce("text", F.lit(""))
    plain = marked.where("NOT hit").select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_linked"), none.alias("dropped"), whole.alias("kept"))
    maybe = marked.where("hit")
    maybe = maybe.join(touched, (maybe["rid"] == touched["rid"]) & maybe["doc_id"].eqNullSafe(touched["_doc"]), "left").withColumn("dropped", F.coalesce("dropped", none)).withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
    schema = "doc_id long, n_lines long, n_linked long, dropped array<long>, kept string"
    changed = maybe.select("doc_id", "text", n_lines.alias("n_lines"), "n_linked", "dropped").mapInArrow(_cut, schema)
    return plain.unionByName(changed)
