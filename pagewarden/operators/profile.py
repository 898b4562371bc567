"""Site profile: company name, focus terms, pillars, keywords and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import text as T
from pagewarden.functions import urls as U
from pagewarden.functions.numbers import let, lit_array
from pagewarden.operators.ranking import top_k
from pagewarden.operators.rows import unnest

_EDGE = r" \-|:"


def candidate_phrases(keywords: Column, h1: Column, h2: Column, title: Column, description: Column) -> Column:
    """Phrases in order of trust: keywords, h1, h2, title parts, parts of the description."""
    empty = lit_array([])
    part = lambda a, n: F.slice(F.coalesce(a, empty), 1, n)
    fragments = F.when(
        F.coalesce(description, F.lit("")) != "",
        F.transform(F.slice(F.split(description, "[,.|;]", -1), 1, 3), U.strip_space),
    ).otherwise(empty)
    return F.concat(part(keywords, 5), part(h1, 3), part(h2, 4), U.title_parts(title), fragments)


def common_terms(text: Column, limit: int = 8) -> Column:
    """Most frequent terms of one text in title case, ties by first occurrence."""

    def ranked(all_terms: Column) -> Column:
        entry = lambda t, i: F.struct(
            (-F.size(F.filter(all_terms, lambda x: x == t))).alias("n"), i.alias("pos"), t.alias("term")
        )
        return F.slice(F.array_sort(F.transform(F.array_distinct(all_terms), entry)), 1, limit)

    best = let(T.terms(text, C.PROFILE_STOPWORDS), ranked)
    return F.transform(best, lambda b: U.title_case(b["term"]))


def frequent_terms(texts: DataFrame, key: str, text: str, order: str, limit: int = 8) -> DataFrame:
    """Most frequent terms of each key over all its texts.

    Terms are counted by one combining aggregate; ties go to the earlier text and position.
    """
    exploded = unnest(texts, T.terms(F.col(text), C.PROFILE_STOPWORDS), "term", [key, order], "pos")
    first = F.struct(order, "pos")
    if texts.schema[order].dataType.simpleString() in ("int", "bigint"):
        # text and position as one number, which a hash aggregate can hold
        first = F.col(order).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    counted = exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_first"))
    return top_k(counted, [key], [F.desc("n"), F.col("_first")], limit).drop("_first")


def site_profile(primary: DataFrame) -> DataFrame:
    """Profile of each site from its primary page.

    Needs ``site, url, title, description, headings``; ``keywords`` is used when present.
    """
    keywords = F.col("keywords") if "keywords" in primary.columns else lit_array([])
    title, description = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    phrases = T.distinct_phrases(
        candidate_phrases(keywords, F.col("headings.h1"), F.col("headings.h2"), title, description), 10, _EDGE
    )
    everything = F.concat_ws(" ", title, description, "headings.h1", "headings.h2")
    named = primary.select(
        "site", "url", U.company_name(F.col("url"), title).alias("company_name"),
        title.alias("_title"), description.alias("_description"), phrases.alias("_phrases"),
        everything.alias("_text"),
    ).withColumn(
        "focus_terms", F.when(F.size("_phrases") > 0, F.col("_phrases")).otherwise(common_terms(F.col("_text")))
    )
    some = F.size("focus_terms") > 0
    keywords = F.when(some, F.slice("focus_terms", 1, 8)).otherwise(lit_array(C.DEFAULT_KEYWORDS))
    stated = F.coalesce(
        F.nullif(U.strip_space(F.col("_description")), F.lit("")), F.nullif(U.strip_space(F.col("_title")), F.lit(""))
    )
    return named.withColumn("market_focus_keywords", keywords).select(
        "site", "url", "company_name", F.lit(C.DEFAULT_AUDIENCE).alias("audience_label"), "focus_terms",
        F.when(some, F.slice("focus_terms", 1, 3)).otherwise(lit_array(C.DEFAULT_PILLARS)).alias("core_service_pillars"),
        "market_focus_keywords",
        F.coalesce(
            stated,
            F.format_string("%s works around %s.", "company_name", F.element_at("market_focus_keywords", 1)),
        ).alias("business_summary"),
    )
