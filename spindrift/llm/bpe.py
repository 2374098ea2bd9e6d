"""BPE encoding and decoding with a priority queue of merge ranks over a linked symbol list.

Vocabularies are files of public tokenizers (JSON, BPE model with an end-of-word suffix), given by
path; the file is read on the driver and travels to executors once, as a broadcast of fixed size.
Texts are normalised (NFC, lower case), split into words, and each
word is encoded on its own; encodings are remembered in bounded tables per worker.

Defined results: a null text counts as empty and has no tokens; white space alone has none either;
strings of special tokens in a text become these tokens; repeated rows are encoded alike; an empty
table gives an empty result; all columns are kept, but ``ids`` and ``decoded`` replace columns of
these names. The tokenizer library's Unicode tables are of other versions than Python's: a text with a
code point that these leave unassigned, or a mark that they order differently, is normalised and
split into words by the library; its words are encoded here like all others.
"""

from __future__ import annotations

import json
import re as stdre
import struct
import sys
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spindrift.session import tune

#: Encodings that a worker remembers: two generations of this many words and runs each.
REMEMBERED = 200_000
#: Longer ones are encoded but not remembered, in characters.
MEMO_CHARS = 48
#: Bytes of results that are handed back at a time.
SLICE_BYTES = 8 << 20
#: Unicode white space; Python's own class has U+001C to U+001F besides.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Memo:
    """Results by string, bounded: when the young generation is full, the old one is forgotten."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= MEMO_CHARS:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[key] = value


class WordBpe:
    """One tokenizer: vocabulary, merge ranks, special tokens and the word pattern."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        #: Left, right and merged symbol by rank, and the rank of each pair of symbols.
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.ranks = {a << 20 | b: rank for rank, (a, b, _) in enumerate(self.merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.utf8 = {i: s.encode() for i, s in self.strings.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        self.spaces = regex.compile(f"[{WHITE}]+")
        self.separators = stdre.compile("[\x1c-\x1f]")
        self.alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in self.alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in self.alphabet]
        self.markers = stdre.compile("|".join(map(stdre.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()
        plain = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}
        self.library = Tokenizer.from_str(json.dumps(spec | plain))
        spans = self._odd()
        self.odd = stdre.compile(self._class(spans))
        # most texts are told by a class of few parts: these, and all code points beyond the first plane
        self.maybe_odd = stdre.compile(self._class([s for s in spans if s[0] < 0x10000] + [[0x10000, sys.maxunicode]]))
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}

    @staticmethod
    def _class(spans: list[list[int]]) -> str:
        return "[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in spans) + "]"

    def _odd(self) -> list[list[int]]:
        """Ranges of the code points whose handling depends on the version of Unicode."""
        spans: list[list[int]] = []
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if unicodedata.category(x) == "Cn" or unicodedata.combining(x) and any(self.library.normalizer.normalize_str(t) != self.normalise(t) for t in (f"e{x}\u0301", f"e\u0327{x}", f"e\u0301{x}")):
                if spans and spans[-1][1] == c - 1:
                    spans[-1][1] = c
                else:
                    spans.append([c, c])
        return spans

    def forget(self) -> None:
        """Give up what is remembered."""
        self.by_word, self.by_run = Memo(), Memo()

    def normalise(self, text: str) -> str:
        """NFC and lower case. White space is left: it parts words and belongs to none."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:  # capital sigma is lowered without regard to its place in a word
                text = text.replace("\u03a3", "\u03c3")
        return text.lower()

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges in order of rank, leftmost first, until none is left.

        Symbols form a doubly linked list; the queue holds a rank and a position in one integer. An
        entry whose pair is no longer at its position is stale and is skipped.
        """
        ranks, n = self.ranks, len(ids)
        queue, a = [], ids[0]
        for i in range(1, n):
            b = ids[i]
            rank = ranks.get(a << 20 | b)
            if rank is not None:
                queue.append(rank << 32 | (i - 1))
            a = b
        if not queue:
            return ids
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ids = [*ids, -1]
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            left, right, whole = self.merges[rank]
            j = after[i]
            if ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(whole << 20 | ids[k])
                if rank is not None:
                    heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(ids[h] << 20 | whole)
                if rank is not None:
                    heappush(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str, raw: bytes | None = None) -> bytes:
        """Little-endian 32-bit ids of one word; symbols outside the vocabulary have none."""
        found = self.by_word.get(word)
        if found is None:
            raw = word.encode() if raw is None else raw
            ids = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
            if None in ids:
                ids = [x for x in ids if x is not None]
            if len(ids) > 1:
                ids = self.merge(ids)
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.by_word.put(word, found)
        return found

    def encode_run(self, run: str) -> bytes:
        """Ids of a run without white space; runs don't affect each other."""
        found = self.by_run.old.get(run)
        if found is None:
            found = b"".join(map(self.encode_word, self.words.findall(run)))
        self.by_run.put(run, found)
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, encode_run, memo = [], self.encode_run, self.by_run
        for piece, special in self._pieces(text or ""):
            if special is not None:
                out.append(struct.pack("<I", special))
                continue
            if not piece.isascii() and self.maybe_odd.search(piece) and self.odd.search(piece):
                out.extend(self.encode_odd(piece))
                continue
            for run in self.runs(self.normalise(piece)):
                ids = memo.young.get(run)
                out.append(encode_run(run) if ids is None else ids)
        return b"".join(out)

    def encode_odd(self, piece: str) -> Iterator[bytes]:
        """Ids of the words that the library finds; it gives each as the characters of its bytes."""
        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)):
            raw = bytes(map(self.bytes_of.__getitem__, word))
            yield self.encode_word(raw.decode(errors="surrogateescape"), raw)

    def runs(self, text: str) -> list[str]:
        # split() would also part words at U+001C to U+001F
        return self.spaces.split(text) if self.separators.search(text) else text.split()

    def _pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.markers.finditer(text) if self.markers else ():
            yield text[at : m.start()], None
            yield "", self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary's strings of the ids, joined by spaces, in UTF-8."""
        return b" ".join(map(self.utf8.__getitem__, unpack(ids)))

    def text_of(self, ids: bytes) -> str:
        """The normalised text that the ids stand for: bytes put back, word ends as spaces."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        out = bytearray()
        for i in unpack(ids):
            t = self.strings[i]
            if t in self.special:
                out += t.encode()
                continue
            ends = bool(self.suffix) and t.endswith(self.suffix)
            out += bytes(back[c] for c in (t[: -len(self.suffix)] if ends else t)) + b" " * ends
        return out.decode(errors="replace").rstrip(" ")


def unpack(ids: bytes) -> array:
    """Packed ids as an array of integers."""
    found = array("I", ids)
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        found.byteswap()
    return found


#: The tokenizer that this worker has at hand, by the broadcast it came with.
_LOADED: dict[str, WordBpe] = {}


def encode_rows(docs: DataFrame, vocabulary: str, text: str = "text", decode: bool = True) -> DataFrame:
    """All rows with ``ids`` (packed 32-bit integers) and, if asked for, ``decoded``.

    ``vocabulary`` is a file that the driver can read.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(json.load(file))
    key = uuid.uuid4().hex
    new = ["ids", "decoded"] if decode else ["ids"]
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decode else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = WordBpe(spec.value)
        bpe = _LOADED[key]
        for batch in batches:
            column, names = batch.column(text), [f.name for f in kept]
            start, ids, decoded, held = 0, [], [], 0
            for i in range(batch.num_rows):
                ids.append(bpe.encode(column[i].as_py()))
                decoded.append(bpe.decode(ids[-1]) if decode else b"")
                held += len(ids[-1]) + len(decoded[-1])
                if held >= SLICE_BYTES or i == batch.num_rows - 1:
                    part = batch.select(names).slice(start, i + 1 - start)
                    columns = [pa.array(ids, pa.binary())] + ([pa.array(decoded, pa.binary()).cast(pa.string())] if decode else [])
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*names, *new])
                    start, ids, decoded, held = i + 1, [], [], 0
        bpe.forget()  # the worker may go on with another job

    return docs.mapInArrow(run, schema)
