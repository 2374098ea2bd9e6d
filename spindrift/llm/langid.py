"""Language identification of mixed texts: script ranges, per-word scores, Viterbi over words.

Training counts letter trigrams per language, over all labelled documents, in a hashed table of
fixed size. A word's scores are its trigrams' log probabilities in each language that uses the
word's script. Viterbi labels the words of a text, at a penalty for each change of language; runs
of equal labels are the text's spans. The text's language is the one with most letters; the score
is their share of all letters.

Defined results: a null text, one without letters, and any text under a model without languages
are ``und`` with score 0 and no spans; ties go to the first language by name; rows with a null
language teach nothing; a null identifier counts as an empty one where folds are dealt; repeated
rows are labelled alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the trigram table per language, and the most languages that a model may have.
BUCKETS, MOST_LANGUAGES = 1 << 16, 256
#: Price of a change of language, in natural logarithms; and of a trigram count that wasn't seen.
SWITCH, PRIOR = 14.0, 0.3
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 1e-3
#: Words whose scores a worker remembers, and cells of Viterbi's tables at a time.
REMEMBERED, CELLS = 300_000, 4_000_000
NONE = "und"

#: First code points of script ranges; ranges go up to the next entry.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "lao"),
    (0x0F00, "tibetan"),
    (0x1000, "burmese"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x1380, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3130, "hangul"),
    (0x3190, "kana"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB13, "other"),
    (0x20000, "han"),
    (0x323B0, "other"),
)
_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def _trigrams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the words, a space at either end; where each word's begin; and
    the script of each word's first letter."""
    joined = np.frombuffer((" " + " ".join(distinct) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inside = joined[1:-1] != 32
    mixed = joined[:-2] * _PRIMES[0] + joined[1:-1] * _PRIMES[1] + joined[2:] * _PRIMES[2]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (mixed >> np.uint64(48)).astype(np.int64)[inside]
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    first = np.fromiter((ord(w[0]) for w in distinct), np.int64, len(distinct))
    return buckets, starts, _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class Model:
    """Log probabilities by bucket and language; and which languages use which script."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray

    def word_scores(self, distinct: list[str]) -> np.ndarray:
        """A row per word, a column per language."""
        buckets, starts, script = _trigrams(distinct)
        found = np.add.reduceat(self.table[buckets], starts, axis=0)
        out = np.where(self.uses[script], found, -1e4)
        return out - out.max(axis=1, keepdims=True)


def counts(rows: DataFrame, held_out: Callable[[int | None], bool]) -> DataFrame:
    """(lang, kind, at, c) of labelled training rows (doc_id, text, lang): trigrams by bucket, and
    letters by script; combined in each task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def add() -> None:
            for lang, counter in seen.items():
                if counter:
                    distinct = list(counter)
                    buckets, starts, script = _trigrams(distinct)
                    times = np.fromiter(counter.values(), np.int64, len(distinct))
                    lengths = np.diff(np.append(starts, len(buckets)))
                    table = tables.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                    np.add.at(table, buckets, np.repeat(times, lengths))
                    np.add.at(table, BUCKETS + script, times * lengths)
            seen.clear()

        for batch in batches:
            ids, texts, langs = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for i, lang in enumerate(langs):
                if lang is not None and not held_out(ids[i]):
                    seen.setdefault(lang, Counter()).update(words(texts[i].as_py()))
                    if i % 1000 == 999:
                        add()
            add()
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(table[at])], ["lang", "at", "c"])

    return rows.mapInArrow(run, "lang string, at long, c long").groupBy("lang", "at").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, held_out: Callable[[int | None], bool] = lambda doc_id: False, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of all labelled documents that aren't held out."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    # never more rows than MOST_LANGUAGES tables have entries
    most = MOST_LANGUAGES * (BUCKETS + len(_NAMES))
    found = counts(rows, held_out).limit(most + 1).toPandas()
    languages = sorted(found["lang"].unique())
    if len(found) > most or len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    dense = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    dense[found["at"].to_numpy(np.int64), np.searchsorted(languages, found["lang"].to_numpy(str)) if languages else []] = found["c"]
    trigrams, scripts = dense[:BUCKETS], dense[BUCKETS:]
    table = np.log((trigrams + PRIOR) / (trigrams.sum(axis=0) + PRIOR * BUCKETS)).astype(np.float32)
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    uses[~uses.any(axis=1)] = True
    return Model(languages, table, uses)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several texts at once; scores: (words, texts, languages), shorter texts padded
    with zeros, which never pay for a change."""
    steps, texts, k = scores.shape
    best = scores[0].copy()
    moved = np.zeros((steps, texts, k), bool)
    came = np.zeros((steps, texts), np.int16)
    for t in range(1, steps):
        top = best.argmax(axis=1)
        other = best[np.arange(texts), top] - switch
        move = best < other[:, None]
        best = np.where(move, other[:, None], best) + scores[t]
        moved[t], came[t] = move, top
    labels = np.empty((steps, texts), np.int16)
    labels[-1] = best.argmax(axis=1)
    each = np.arange(texts)
    for t in range(steps - 1, 0, -1):
        now = labels[t]
        labels[t - 1] = np.where(moved[t, each, now], came[t], now)
    return labels


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every document; spans are runs of words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        place: dict[str, int] = {}
        rows, k = np.empty((0, max(len(known.languages), 1)), np.float32), len(known.languages)
        for batch in batches:
            texts = batch.column(1)
            n = batch.num_rows
            preds, shares, spans = [NONE] * n, [0.0] * n, [[] for _ in range(n)]
            if k:
                tokens = [words(texts[i].as_py()) for i in range(n)]
                if len(place) > REMEMBERED:
                    place, rows = {}, rows[:0]
                new = [w for w in {w for one in tokens for w in one} if w not in place]
                if new:
                    place.update(zip(new, range(len(place), len(place) + len(new))))
                    rows = np.concatenate([rows, known.word_scores(new)])
                order = sorted((i for i in range(n) if tokens[i]), key=lambda i: len(tokens[i]))
                while order:
                    # texts of like length, the longest first; at least one
                    width = max(1, min(256, CELLS // (len(tokens[order[-1]]) * k)))
                    group, order = order[-width:], order[:-width]
                    steps = len(tokens[group[-1]])
                    scores = np.zeros((steps, len(group), k), np.float32)
                    for at, i in enumerate(group):
                        scores[: len(tokens[i]), at] = rows[[place[w] for w in tokens[i]]]
                    labels = viterbi(scores)
                    for at, i in enumerate(group):
                        own = labels[: len(tokens[i]), at]
                        lengths = np.fromiter(map(len, tokens[i]), np.int64, len(own))
                        letters = np.bincount(own, weights=lengths, minlength=k)
                        winner = int(letters.argmax())
                        preds[i], shares[i] = known.languages[winner], float(letters[winner] / letters.sum())
                        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
                        spans[i] = [{"first_word": int(a), "last_word": int(z) - 1, "lang": known.languages[own[a]]} for a, z in zip([0, *cuts], [*cuts, len(own)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, _SPANS)], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,last_word:int,lang:string>>")
