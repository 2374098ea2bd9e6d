import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("", ""),
        ("a�b\x00c", "a b c"),
        ("a\x07b\x1fc​d­e", "abcde"),
        ("a \t  b\n\n\nc", "a b\nc"),
        (" 　 a b \u0085\n", "a b"),
        ("a\r\nb", "a\r\nb"),
    ],
)
def test_sanitize(spark, raw, clean):
    assert one(spark, X.sanitize, raw) == clean


@pytest.mark.parametrize("value, bad", [("", True), (chr(0xE000) * 4 + "a" * 6, False), (chr(0xE000) * 41 + "a" * 59, True), ("\n\r\t \n", False), ("\ufffd\x00a", True)])
def test_garbled_is_strict(spark, value, bad):
    assert one(spark, X.is_garbled, value) is bad


def test_words_digits_formula(spark):
    assert [one(spark, X.word_count, t) for t in ("", " a  b　c ", "a")] == [0, 3, 1]
    assert [one(spark, X.has_numbers, t) for t in ("a", "a1", "²", "①", "½", "٣")] == [False, True, True, True, False, True]
    assert [one(spark, X.has_formula, t) for t in ("a", "a=b", "5%", "$")] == [False, True, True, True]


def test_digit_class_is_python_isdigit(spark):
    chars = [chr(c) for c in [*range(0x20, 0x3000), *range(0x1F100, 0x1F110)] if not chr(c).isspace()]
    found = spark.createDataFrame([(c,) for c in chars], "c string").select("c", X.has_numbers(F.col("c")).alias("d")).collect()
    assert [r.c for r in found if r.d != r.c.isdigit()] == []


def test_space_class_is_plain_and_exact(spark):
    """White space is Unicode's to the character, by a class of few parts: one of ranges took most of chunk_table's time."""
    assert len(X.SPACE_CLASS.replace(r"\p{Z}", "Z").replace(r"\x85", "N").replace(r"\s", "S")) <= 3
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c,) for c in chars], "c string").where(X.word_count(F.col("c")) == 0).collect()
    assert {r.c for r in found} == set(X.SPACE)


def test_tokens(spark):
    assert one(spark, X.tokens, "Risk is 5% of the $ budget. (A, bc)") == ["risk", "is", "%", "of", "the", "$", "budget", "bc"]
    assert one(spark, X.tokens, None) == []


def test_prompts_and_guards(spark):
    df = spark.createDataFrame([("q", ["x" * 3000, "y"])], "q string, c array<string>")
    prompt = df.select(X.answer_prompt(F.col("q"), F.col("c")).alias("p")).first()["p"]
    assert prompt == "Answer based on contexts.\n    GLOBAL: \n    LOCAL: " + "x" * 2000 + "\n---\ny\n    Query: q"
    assert [one(spark, X.is_blank, q) for q in (None, "", " 　\n", "a")] == [True, True, True, False]
    pairs = spark.createDataFrame([("", "t"), (None, "t"), ("c", "t")], "w string, t string")
    assert [r[0] for r in pairs.select(X.effective_text(F.col("w"), F.col("t"))).collect()] == ["t", "t", "c"]
    assert one(spark, lambda t: X.wrap_context(F.lit("c"), t), None) == "CONTEXT: c\n\nORIGINAL TEXT:\n"
