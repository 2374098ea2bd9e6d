"""Near-dedup of whole documents with HyperMinHash signatures.

A document's set are its distinct word shingles. The hash of a shingle picks one of BANDS * ROWS
buckets; a bucket stores the smallest hash it got as a leading-zero count and MANTISSA bits. Empty
buckets borrow from others by fixed random orders, so that short texts band as well as long ones.
Bands of ROWS registers are hashed to keys. A pair of similarity 0.8 shares one of the 40 keys
but for one case in ten million.

Pairs are found without listing all pairs of a group. Equal sets are one class with one
representative. In each key, every class is first paired with the smallest one; what passes the
estimate and the comparison of full sets gives components. Only where a key holds several
components are their members compared across, in blocks of bounded size, by estimate and then on
full sets; links alone leave the task. Pairs within a component need no comparison: they can't change
it.

Defined results: null and blank texts have an empty set and are linked with nothing; rows without
an identifier are linked with nothing; rows that share an identifier are one document with several
sets; an empty table gives an empty result; other columns are ignored by ``near_groups`` and kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.graph import components
from spindrift.llm.shared import MemberFilter, attach, own_name
from spindrift.session import discard, materialise

BANDS, ROWS, MANTISSA = 40, 5, 10
BUCKETS = BANDS * ROWS
#: Chance that two different minima have the same register: zeros agree (1/3), then the mantissa.
COLLIDE = 2.0**-MANTISSA / 3
#: Pairs below this estimate are dropped unverified; it is seven deviations below 0.8.
LEAST_ESTIMATE = 0.6
#: Members of a key that are compared with as many others at a time, and their shingles.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Word hashes that a worker remembers.
REMEMBERED = 300_000

_U = np.uint64
_EMPTY = np.uint16(0xFFFF)
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_PLACES = _odd(1, 64)
_BAND = _odd(2, ROWS)
_BAND_SEED = _odd(3, BANDS)
#: For each bucket, the order in which it asks the others.
_DONORS = np.stack([np.random.default_rng(1000 + i).permutation([j for j in range(BUCKETS) if j != i]) for i in range(BUCKETS)])


def _mix(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> _U(33))) * m
    return h ^ (h >> _U(33))


class Shingler:
    """Sets of hashed word shingles. Words end at ASCII white space; A-Z are lowered, no more."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; fewer words than the width make one shingle."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo, hashes = self.memo, []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        n = min(self.width, len(h))
        total = np.full(len(h) - n + 1, _U(n), np.uint64)
        for k in range(n):
            total += _mix(h[k : len(h) - n + 1 + k] + _PLACES[k]) * _PLACES[k]
        return np.unique(_mix(total))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of one set; 0xFFFF where a bucket got nothing."""
    out = np.full(BUCKETS, _EMPTY, np.uint16)
    if len(shingles):
        # buckets are ranges of the hash, so in sorted order the first of each is its smallest
        high = (shingles >> _U(32)) * _U(BUCKETS) + (((shingles & _U(0xFFFFFFFF)) * _U(BUCKETS)) >> _U(32))
        bucket, first = np.unique(high >> _U(32), return_index=True)
        rest = shingles[first] * _U(BUCKETS) | _U(1)
        exponent = np.minimum(np.log2(rest.astype(np.float64)), 63).astype(np.uint64)
        exponent -= ((_U(1) << exponent) > rest).astype(np.uint64)
        zeros = _U(63) - exponent
        mantissa = ((rest << zeros) << _U(1)) >> _U(64 - MANTISSA)
        out[bucket.astype(np.int64)] = np.minimum(zeros << _U(MANTISSA) | mantissa, 0xFFFE).astype(np.uint16)
    return out


def densify(regs: np.ndarray) -> np.ndarray:
    """Fill empty registers of each row from the first full one in the bucket's own order."""
    full, out = regs != _EMPTY, regs.copy()
    row, at = np.nonzero(~full & full.any(axis=1, keepdims=True))
    for step in range(BUCKETS - 1):
        if not len(row):
            break
        donor = _DONORS[at, step]
        got = full[row, donor]
        out[row[got], at[got]] = regs[row[got], donor[got]]
        row, at = row[~got], at[~got]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = _mix(regs.reshape(-1, BANDS, ROWS).astype(np.uint64) + _BAND) * _BAND
    return _mix(parts.sum(axis=2, dtype=np.uint64) + _BAND_SEED).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for registers that agree by chance."""
    return ((a == b).mean(axis=-1) - COLLIDE) / (1 - COLLIDE)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def signatures(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, digest, regs``: a row per document; the digest names its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            texts = batch.column(1)
            sizes, digests, regs = [], [], []
            for i in range(batch.num_rows):
                found = shingle(texts[i].as_py())
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                regs.append(registers(found))
            if sizes:
                dense = densify(np.stack(regs))
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in dense], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "digest", "regs"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(1)))
                ids = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "regs").mapInArrow(run, "key long, id long")


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers agree enough."""
    regs = classes.select("id", "regs")
    both = pairs.join(regs.withColumnsRenamed({"id": "b", "regs": "regs_b"}), "b").join(regs.withColumnsRenamed({"id": "a", "regs": "regs_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                passed = estimate(_matrix(batch.column(2)), _matrix(batch.column(3))) >= LEAST_ESTIMATE
                yield batch.select(["a", "b"]).filter(pa.array(passed))

    return both.select("a", "b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _across(open_rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components that share a key.

    A key's members are dealt into blocks of bounded size; each pair of blocks is one group. What
    passes the estimate there is compared on full sets at once, so that only links leave the task.
    A pair is looked at in the first key that it shares, and not at all once links of the same
    group have joined its components.
    """
    sized = open_rows.withColumn("block", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
    paired = sized.select("key", "id", "component", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    paired = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block")
    held = paired.join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by group; a group may go on in the next batch
        shingle, left = Shingler(width), None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            marks = np.stack([whole.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            bounds = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()]
            for start, end in zip(bounds, bounds[1:]):
                yield compare(whole.slice(start, end - start), shingle)
            left = whole.slice(bounds[-1])
        if left is not None and left.num_rows:
            yield compare(left, shingle)

    def compare(group: pa.Table, shingle: Shingler) -> pa.RecordBatch:
        ids, parts, blocks = (group.column(c).to_numpy() for c in ("id", "component", "block"))
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        links: tuple[list[int], list[int]] = ([], [])
        if (parts != parts[0]).any():
            roots = parts.copy()
            sets = [shingle(t.as_py()) for t in group.column("text")]
            regs = densify(np.stack([registers(x) for x in sets]))
            keys = band_keys(regs)
            for at in np.flatnonzero(blocks == i):
                others = (roots != roots[at]) & ((ids > ids[at]) if i == j else (blocks == j))
                near = np.flatnonzero(others)
                near = near[estimate(regs[near], regs[at]) >= LEAST_ESTIMATE]
                if len(near):
                    first = (keys[near] == keys[at]).argmax(axis=1)
                    near = near[keys[near, first] == key]
                for other in near:
                    if roots[other] != roots[at] and similar(sets[at], sets[other], percent):
                        links[0].append(int(ids[at]))
                        links[1].append(int(ids[other]))
                        roots[roots == roots[other]] = roots[at]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    dealt = held.select("key", "i", "j", "id", "component", "block", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, needed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text) of the needed identifiers and few others."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return MemberFilter(needed, "id").keep(rows, "id")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs whose full sets are similar; only texts that a pair needs are moved."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), doc_id, text)
    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, held = Shingler(width), None, None
        for batch in batches:
            passed = []
            for i in range(batch.num_rows):
                text_a = batch.column(2)[i].as_py()
                if held is None or text_a != last:
                    last, held = text_a, shingle(text_a)
                passed.append(similar(held, shingle(batch.column(3)[i].as_py()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, class_id``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; a
    component is what links connect. ``class_id`` is the smallest identifier with the same set.
    """
    if percent < 80:
        raise ValueError("bands and estimate are laid out for similarities of 0.8 and more")
    sigs = materialise(signatures(docs, width, doc_id, text), "near-signatures")
    full = sigs.where("n_shingles > 0 AND id IS NOT NULL")
    classes = materialise(
        full.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), F.any_value("regs").alias("regs")),
        "near-classes",
    )
    bands = materialise(_bands(classes), "near-bands")
    centres = bands.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(bands.join(centres, "key"), "near-shared")

    stars = shared.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    tried = materialise(_promising(stars, classes), "near-pairs")
    links = materialise(_verified(tried, docs, width, percent, doc_id, text), "near-links")
    first = components(links)

    placed = shared.where("n > 2").select("key", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(full.groupBy("id").agg(F.max("n_shingles").alias("size")), "id")
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)
    spread = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("open"), F.ceil(size).cast("int").alias("blocks")).where("open")
    open_rows = materialise(placed.join(spread, "key").select("key", "id", "component", "blocks"), "near-open")
    texts = _texts(docs, open_rows.select("id").distinct(), doc_id, text)
    further = _across(open_rows, texts, width, percent)
    # an identifier with several sets links their classes
    several = full.groupBy("id").agg((F.min("digest") < F.max("digest")).alias("several")).where("several").select("id")
    bridges = full.join(several, "id", "left_semi").select(F.col("id").alias("a"), "digest").join(classes.select("digest", F.col("id").alias("b")), "digest").select("a", "b")
    # the first components stand for the first links
    joined = further.unionByName(first.select(F.col("component").alias("a"), F.col("id").alias("b"))).unionByName(bridges)
    parts = components(joined)
    for table in (bands, shared, tried, links, open_rows):
        discard(table)

    labelled = classes.select("digest", "id", "members").join(parts, "id", "left")
    labelled = labelled.select("digest", F.col("id").alias("class_id"), "members", F.coalesce("component", "id").alias("component"))
    rows = sigs.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    total = rows.count()
    out = attach(rows, labelled, "digest", "members", total)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.expr("component IS NULL OR id = component").alias("kept"),
        F.coalesce("class_id", "id").alias("class_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those linked to a smaller identifier, all columns as they were.

    Only rows that may have to go are moved: the others pass a filter where they are.
    """
    gone = near_groups(docs, width, percent, doc_id, text).where("NOT kept").select("doc_id").distinct()
    gone = materialise(gone, "near-gone")
    # identifiers of any integer type are probed and joined as long ones
    mark, key = own_name("gone"), own_name("id")
    marked = MemberFilter(gone, "doc_id").mark(docs.withColumn(key, F.col(f"`{doc_id}`").cast("long")), key, mark)
    maybe = marked.where(mark).join(gone.select(F.col("doc_id").alias(key)), key, "left_anti")
    return marked.where(f"NOT {mark}").unionByName(maybe).select(*[F.col(f"`{c}`") for c in docs.columns])
