"""Language-model scoring by a weighted backoff automaton.

Words and bigrams of the whole training part are counted, none is left out. Words give an add-one
base distribution, with one share for unknown words. Over it stands a bigram model under a Dirichlet
prior of weight PRIOR: p(w | h) = (c(h, w) + PRIOR * base(w)) / (c(h) + PRIOR). As an automaton, each
word is a state, each bigram an arc, and what is left over, PRIOR / (c(h) + PRIOR), is the weight of
the failure arc to the root, whose arcs are the words. The distribution of every state sums to one.

The model is never in one place; it grows with the corpus. Documents are tokenised once, into chunks
of bounded size that are written. Each chunk asks for the counts of its own distinct n-grams:
sorted 64-bit keys, dealt into parts by range, with the chunk's training counts. A part adds up what
the chunks sent and answers in the same order, so that only numbers go back. With its answers a
chunk has exactly the automaton that its own texts can reach, and traverses them left to right.
Keys are hashes, so parts are even however often an n-gram occurs, and a chunk sends each n-gram
once. A part's memory is bounded by their number, which follows from the tokens.

Words are told apart by 64-bit hashes, and so are bigrams: two of 10^8 distinct words share one with
a chance of 0.03 %.

Defined results: a null text counts as empty and has the end token alone; a null identifier is
scored like any other and counts as training; repeated rows are counted and scored each; an empty
training part leaves the unknown share alone, so every token scores 0; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import materialise

#: Weight of the base distribution in each state, in tokens.
PRIOR = 4.0
#: Tokens of a chunk, and of a part: it has as many parts as Spark has shuffle partitions, or more.
CHUNK_TOKENS, PART_TOKENS = 1_500_000, 2_000_000
#: The end token; no word is empty.
END = b""

_U = np.uint64


def words(text: str | bytes | None) -> list[bytes]:
    """Words end at ASCII white space; A-Z are lowered, no more."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.lower().split()


def fold(modulus: int, rest: int) -> Callable[[int | None], bool]:
    """Whether an identifier's crc32, as text, leaves ``rest``."""
    return lambda doc_id: zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == rest


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, low ones first, as many as the largest needs."""
    planes = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def bigram_keys(hashes: np.ndarray, history: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A 64-bit key of each bigram, from its words' hashes."""
    k = hashes[history] * _U(0x9E3779B97F4A7C15) ^ (hashes[symbol] + _U(0xD6E8FEB86659FD93)) * _U(0xC2B2AE3D27D4EB4F)
    k = (k ^ (k >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return k ^ (k >> _U(29))


@dataclass
class Chunk:
    """Tokenised texts: symbols of the chunk's own words, the end token being symbol 0."""

    hashes: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    trained: np.ndarray

    @property
    def histories(self) -> np.ndarray:
        """The symbol before each token; every text ends in symbol 0, which stands before the next."""
        return np.concatenate(([0], self.tokens[:-1]))

    def entries(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the training count of each, and each token's (kind 1) or each
        symbol's (kind 0) place among them."""
        weights = np.repeat(self.trained, self.sizes).astype(np.int64)
        if kind == 0:
            keys, weights = self.hashes, np.bincount(self.tokens, weights, len(self.hashes)).astype(np.int64)
        else:
            keys = bigram_keys(self.hashes, self.histories, self.tokens)
        order = np.argsort(keys)
        ranked = keys[order]
        heads = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(heads) - 1
        return ranked[heads], np.add.reduceat(weights[order], np.flatnonzero(heads)), place


@dataclass
class Automaton:
    """States and root arcs by symbol, arcs by number; all weights are log10 probabilities.

    State ``s`` is the history that ends in symbol s. ``symbols`` and ``arcs`` have the training
    counts of words and bigrams; an arc that training never saw fails to the root.
    """

    symbols: np.ndarray
    arcs: np.ndarray
    tokens: int
    kinds: int

    @property
    def base(self) -> np.ndarray:
        return np.log10((self.symbols + 1) / (self.tokens + self.kinds + 1))

    def failure(self, states: np.ndarray) -> np.ndarray:
        return np.log10(PRIOR / (self.symbols[states] + PRIOR))

    def traverse(self, tokens: np.ndarray, histories: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """The weight of each step from left to right: along its arc if there is one, else along the
        failure arc and the root's arc. The state that a step leads to is that of its symbol."""
        base = self.base[tokens]
        steps = self.failure(histories) + base
        seen = np.flatnonzero(self.arcs[arcs])
        own = PRIOR * 10.0 ** base[seen]
        steps[seen] = np.log10((self.arcs[arcs[seen]] + own) / (self.symbols[histories[seen]] + PRIOR))
        return steps


_RECORD = "chunk long, ids array<long>, sizes binary, trained binary, hashes binary, tokens binary, n long, held_back long"


def chunked(docs: DataFrame, held_out: Callable[[int | None], bool], doc_id: str, text: str) -> DataFrame:
    """The texts as chunks; ``n`` counts all tokens of one, ``held_back`` those not trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        vocabulary: defaultdict[bytes, int] = defaultdict()
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            trained = np.array([not held_out(i) for i in ids])
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
            name = uuid.uuid4().int >> 65  # the chunk is written once, and read under this name
            row = [[name], [ids], [pack(sizes)], [trained.tobytes()], [hashes.tobytes()], [pack(tokens)], [len(tokens)], [int(sizes[~trained].sum())]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], [f.split()[0] for f in _RECORD.split(", ")])

        def begin() -> None:
            vocabulary.clear()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary[END]
            ids.clear()
            parts.clear()

        begin()
        for batch in batches:
            found, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for i, one in enumerate(found):
                own = words(texts[i].as_py())
                own.append(END)
                parts.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
                ids.append(one)
                size += len(own)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    begin()
                    size = 0
        if ids:
            yield flush()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, _RECORD)


def _read(row: dict) -> Chunk:
    trained = np.frombuffer(row["trained"], bool)
    return Chunk(np.frombuffer(row["hashes"], np.uint64), unpack(row["tokens"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64), trained)


def asked(chunks: DataFrame, parts: int) -> DataFrame:
    """``kind, part, chunk, first, steps, counts``: a chunk's sorted keys of one part, as the first one
    and the steps between them, with its training counts. Kind 0 are words, 1 bigrams."""
    bounds = np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("chunk", "sizes", "trained", "hashes", "tokens")}
                chunk = _read(row)
                for kind in (0, 1):
                    keys, counts, _ = chunk.entries(kind)
                    cuts = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
                    out: list[list] = [[] for _ in range(6)]
                    for part, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        if a < z:
                            one = keys[a:z]
                            fields = (kind, part, row["chunk"], int(one[0]) - (1 << 63), pack(np.diff(one, prepend=one[:1])), pack(counts[a:z]))
                            for column, v in zip(out, fields):
                                column.append(v)
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["kind", "part", "chunk", "first", "steps", "counts"])

    return chunks.select("chunk", "sizes", "trained", "hashes", "tokens").mapInArrow(run, "kind int, part int, chunk long, first long, steps binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """``chunk, kind, part, totals, known``: the counts of all chunks together, in the order of each
    chunk's keys; ``known``, on one row of each part, has its keys that training saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by kind and part, which may go on in the next batch
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        name: tuple[int, int] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, part, chunk, first, steps, counts = (c[i].as_py() for c in batch.columns)
                if (kind, part) != name and held:
                    yield add_up(name, held)
                    held = []
                name = kind, part
                held.append((chunk, np.cumsum(unpack(steps)) + _U(first + (1 << 63)), unpack(counts).astype(np.int64)))
        if held:
            yield add_up(name, held)

    def add_up(name: tuple[int, int], held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([h[1] for h in held])
        counts = np.concatenate([h[2] for h in held])
        order = np.argsort(keys)
        ranked = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums = np.add.reduceat(counts[order], heads)
        counts[order] = np.repeat(sums, np.diff(np.append(heads, len(keys))))
        ends = np.cumsum([len(h[1]) for h in held])
        totals = [pack(counts[z - len(h[1]) : z]) for h, z in zip(held, ends)]
        m = len(held)
        columns = [[h[0] for h in held], [name[0]] * m, [name[1]] * m, totals, [int((sums > 0).sum()), *[0] * (m - 1)]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk", "kind", "part", "totals", "known"])

    dealt = questions.repartition("kind", "part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(run, "chunk long, kind int, part int, totals binary, known long")


def score(docs: DataFrame, held_out: Callable[[int | None], bool] = lambda doc_id: False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that aren't held out and score all: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, once_share``. The last is the share of a text's tokens whose
    bigram training saw once at most."""
    spark = docs.sparkSession
    chunks = materialise(chunked(docs, held_out, doc_id, text), "lm-chunks", compression="lz4")
    size = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - F.col("held_back")), F.lit(0)).alias("trained")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // PART_TOKENS))
    answers = materialise(answered(asked(chunks, parts)), "lm-answers", compression="lz4")
    tokens, kinds = size["trained"], answers.where("kind = 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "once_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk's record comes first, then its answers for words and for bigrams, in order of keys
        record, told = None, ([], [])
        for batch in batches:
            for i in range(batch.num_rows):
                kind = batch.column("kind")[i].as_py()
                if kind >= 0:
                    told[kind].append(unpack(batch.column("totals")[i].as_py()))
                    continue
                if record is not None:
                    yield scored(record, *told)
                record, told = {name: batch.column(name)[i].as_py() for name in ("ids", "sizes", "trained", "hashes", "tokens")}, ([], [])
        if record is not None:
            yield scored(record, *told)

    def scored(record: dict, known: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        chunk = _read(record)
        symbols = np.concatenate(known).astype(np.int64)[chunk.entries(0)[2]]
        arcs = chunk.entries(1)[2]
        automaton = Automaton(symbols, np.concatenate(pairs).astype(np.int64), tokens, kinds)
        steps = automaton.traverse(chunk.tokens, chunk.histories, arcs)
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        per_text = lambda values: np.add.reduceat(values, starts)
        once = per_text((automaton.arcs[arcs] <= 1).astype(np.int64)) / chunk.sizes
        n_known = per_text((symbols[chunk.tokens] > 0).astype(np.int64))
        columns = [pa.array(record["ids"], pa.int64()), pa.array(~chunk.trained), pa.array(chunk.sizes), pa.array(n_known), pa.array(np.full(len(starts), tokens, np.int64))]
        columns += [pa.array(v, pa.float64()) for v in (per_text(automaton.base[chunk.tokens]), per_text(steps), once)]
        return pa.RecordBatch.from_arrays(columns, names)

    records = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "ids", "sizes", "trained", "hashes", "tokens")
    both = records.unionByName(answers.select("chunk", "kind", "part", "totals"), allowMissingColumns=True)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "part")
    return dealt.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, once_share double")
