"""Text expressions: cleaning, quality, features, tokens, prompts. All are JVM-side columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern, the marks that are tokens on their own, the formula marks.
TOKEN = r"[\p{L}\p{N}_]+|[$%().,]"
LONE_TOKENS = ("$", "%")
FORMULA = "[$%=]"
#: Unicode white space, as a string and inside a character class. Listing ranges
#: in place of the category made counting words up to sixteen times as slow in Java.
SPACE_CLASS = r"\s\x85\p{Z}"
SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@lru_cache
def digit_class() -> str:
    """A character class of what counts as a digit: Nd and digits of other categories (², ①)."""
    other = [c for c in range(0x20000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    spans: list[list[int]] = []
    for c in other:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return r"[\p{Nd}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def sanitize(text: Column) -> Column:
    """Null becomes empty; marks of bad decoding become spaces; control and format characters go;
    runs of blanks and of newlines shrink to one; Unicode white space at the ends goes.

    Each pattern matches only what it changes, and a text's ends are trimmed without one.
    """
    out = F.coalesce(text, F.lit(""))
    for pattern, to in (
        (r"[\x{FFFD}\x00]", " "),
        (r"[\x01-\x08\x0B\x0C\x0E-\x1F\p{Cf}]", ""),
        (r"[ \t]{2,}|\t", " "),
        (r"\n{2,}", "\n"),
    ):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return F.btrim(out, F.lit(SPACE))


def junk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{C}\x{FFFD}&&[^\n\r\t]]"))


def is_garbled(text: Column, threshold: float = 0.40) -> Column:
    """Strictly more junk than the threshold; an empty text is garbled."""
    return F.when(F.length(text) == 0, True).otherwise(junk_count(text) / F.length(text) > threshold)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))


def has_numbers(text: Column) -> Column:
    # the class has many parts; most texts without a digit have no other number either
    return F.rlike(text, F.lit(r"\p{N}")) & F.rlike(text, F.lit(digit_class()))


def has_formula(text: Column) -> Column:
    return F.rlike(text, F.lit(FORMULA))


def chunk_id(pdf_name: Column, page_number: Column) -> Column:
    return F.concat(pdf_name, F.lit("::p"), page_number.cast("string"), F.lit("::i0"))


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two characters and more, and the lone marks."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) | t.isin(*LONE_TOKENS))


def effective_text(with_context: Column, text: Column) -> Column:
    """The enriched text; an empty one counts as missing."""
    return F.coalesce(F.nullif(with_context, F.lit("")), text)


def wrap_context(context: Column, text: Column) -> Column:
    return F.concat(F.lit("CONTEXT: "), context, F.lit("\n\nORIGINAL TEXT:\n"), F.coalesce(text, F.lit("")))


def enrichment_prompt(pdf_name: Column, page_number: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Generate a 2-3 sentence context for this chunk:\nBook: "),
        pdf_name,
        F.lit("\nPage: "),
        page_number.cast("string"),
        F.lit("\nChunk:\n"),
        F.substring(F.coalesce(text, F.lit("")), 1, 1000),
        F.lit(
            "\nContext should explain:\n1. What book/chapter this is from\n2. The main topic being discussed\n"
            "3. Key trading concepts mentioned\nReturn ONLY the context, nothing else."
        ),
    )


def local_context(contexts: Column, max_chars: int = 2000) -> Column:
    """Contexts cut to ``max_chars`` code points each and joined; used in prompts only."""
    return F.array_join(F.transform(contexts, lambda c: F.substring(c, 1, max_chars)), "\n---\n")


def answer_prompt(query: Column, contexts: Column, global_context: Column | None = None, max_chars: int = 2000) -> Column:
    return F.concat(
        F.lit("Answer based on contexts.\n    GLOBAL: "),
        F.lit("") if global_context is None else F.coalesce(global_context, F.lit("")),
        F.lit("\n    LOCAL: "),
        local_context(contexts, max_chars),
        F.lit("\n    Query: "),
        query,
    )


def is_blank(query: Column) -> Column:
    return F.coalesce(F.regexp_count(query, F.lit(r"(?U)\S")), F.lit(0)) == 0


def rrf_term(rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank term of a 0-based rank."""
    return F.lit(1.0) / (rank + (k + 1))


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)
