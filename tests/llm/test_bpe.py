import json
import random

import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from spindrift.llm import bpe  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as file:
        return bpe.WordBpe(json.load(file)), Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    known = [c for c in map(chr, range(32, 0x3100))]
    out = ["", " \n", "Hello  World's <|endoftext|> Éİ ß 12 !!!", "ab<|startoftext|>cd<|endoftext|><|x|>", "ΑΣ ΣΑΣ", "x\x1cy \x85z​q", "日本語 ½² 🎉🎉 a_b don't'S", "w" * 3000]
    return out + ["".join(r.choice(known) for _ in range(80)) for _ in range(60)]


def test_same_as_the_library(pair, documents):
    mine, library = pair
    for t in texts() + [r.text for r in documents.collect()]:
        ids = mine.encode(t)
        given = library.encode(t, add_special_tokens=False).ids
        assert list(bpe.unpack(ids)) == given
        assert mine.decode(ids).decode() == library.decode(given, skip_special_tokens=False)


def test_every_code_point(pair):
    """Between letters, alone beside a digit, and as a mark: assigned or not."""
    mine, library = pair
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 400):
        t = "\n".join(f"a{chr(c)}b {chr(c)}1 e{chr(c)}\u0301{chr(c)}" for c in points[i : i + 400])
        assert list(bpe.unpack(mine.encode(t))) == library.encode(t, add_special_tokens=False).ids, hex(points[i])
    # few at a time, so that a text's other code points don't decide how it is read
    r = random.Random(5)
    for c in r.sample(points, 20_000):
        t = f"a{chr(c)}b {chr(c)}1 e{chr(c)}\u0301{chr(c)}"
        assert list(bpe.unpack(mine.encode(t))) == library.encode(t, add_special_tokens=False).ids, hex(c)


def test_forgetting_changes_nothing(pair, documents, monkeypatch):
    mine, _ = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.WordBpe(json.load(open(PATH, encoding="utf-8")))
    for t in texts() + [r.text for r in documents.limit(20).collect()]:
        assert small.encode(t) == mine.encode(t)


def test_round_trip(pair):
    mine, _ = pair
    for t in ("a quick brown fox", "été ça", "日本 語"):
        assert mine.text_of(mine.encode(t)) == mine.normalise(t)


def test_rows(odd, empty, pair):
    mine, _ = pair
    given = odd.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    rows = bpe.encode_rows(given, PATH).collect()
    assert sorted(rows[0].asDict()) == ["decoded", "doc_id", "ids", "n_chars", "text"] and len(rows) == odd.count()
    assert all(bytes(r.ids) == mine.encode(r.text) and r.decoded.encode() == mine.decode(r.ids) for r in rows)
    assert bpe.encode_rows(empty, PATH, decode=False).collect() == []
