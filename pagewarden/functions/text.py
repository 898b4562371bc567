"""Text Columns: terms, phrases and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions.numbers import let, lit_array
from pagewarden.functions.urls import strip_space


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column, stopwords: list[str] = C.STOPWORDS) -> Column:
    """Tokens longer than two characters that are no stop words, repeats included."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(stopwords))


def main_keyword(keywords: Column, fallback: Column) -> Column:
    """First keyword that is not blank, else the first five tokens of the fallback text."""
    given = F.filter(F.transform(keywords, strip_space), lambda k: k != "")
    return F.coalesce(
        F.try_element_at(given, F.lit(1)), F.array_join(F.slice(tokens(fallback), 1, 5), " ")
    )


def collapse(text: Column, edge: str = "") -> Column:
    """One blank between words; ``edge`` characters are trimmed as well."""
    words = strip_space(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.regexp_replace(words, rf"^[{edge}]+|[{edge}]+$", "") if edge else words


def distinct_phrases(values: Column, limit: int, edge: str = "") -> Column:
    """Distinct phrases in order, compared without case, first spelling kept."""
    cleaned = F.filter(F.transform(values, lambda v: collapse(v, edge)), lambda v: v != "")

    def first_spellings(phrases: Column) -> Column:
        keys = F.slice(F.array_distinct(F.transform(phrases, F.lower)), 1, limit)
        folded = F.transform(phrases, F.lower)
        return let(
            folded,
            lambda f: F.transform(keys, lambda k: F.element_at(phrases, F.array_position(f, k).cast("int"))),
        )

    return let(F.coalesce(cleaned, lit_array([])), first_spellings)


def snippet(text: Column, width: int = 150) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)
