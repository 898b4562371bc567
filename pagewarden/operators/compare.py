"""Heading vocabulary against competitors, and market opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import text as T
from pagewarden.functions.urls import strip_space
from pagewarden.operators.ranking import top_k
from pagewarden.operators.rows import unnest


def heading_texts(features: DataFrame) -> DataFrame:
    """h1-h3 texts of every page, one row each."""
    texts = F.concat("headings.h1", "headings.h2", "headings.h3")
    return unnest(features, texts, "heading", ["site"])


def term_flags(texts: DataFrame, key: str, text: str, role: str = "role") -> DataFrame:
    """One row per key and term with flags for the own and the competitor side.

    Both sides are one stream of terms, so a single aggregate replaces the join, and
    repeated terms are combined before the shuffle.
    """
    exploded = unnest(texts, F.array_distinct(T.terms(F.col(text))), "term", [key, role])
    return exploded.groupBy(key, "term").agg(
        F.max(F.col(role) == "own").alias("own"), F.max(F.col(role) == "competitor").alias("competitor")
    )


def shared_terms(flags: DataFrame, key: str) -> DataFrame:
    return flags.filter(F.col("own") & F.col("competitor")).select(key, "term")


def overlap(flags: DataFrame, key: str) -> DataFrame:
    """Share of the competitors' terms that the own side has too, and the gap."""
    counted = flags.groupBy(key).agg(
        F.count_if(F.col("own") & F.col("competitor")).alias("shared"),
        F.count_if("own").alias("own_terms"),
        F.count_if("competitor").alias("competitor_terms"),
    )
    scored = counted.withColumn("overlap_score", N.percent(F.col("shared"), F.col("competitor_terms")))
    return scored.withColumn(
        "content_gap", N.round_half_even(F.greatest(F.lit(100.0) - F.col("overlap_score"), F.lit(0.0)), 1)
    )


def opportunity_priority(given: Column, score: Column) -> Column:
    return (
        F.when(given.isin(C.PRIORITIES), given).when(score >= 8, "High").when(score >= 5, "Medium").otherwise("Low")
    )


def clean_opportunities(raw: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """Scores to 1-10, priorities filled in, blank keywords dropped, best five per key.

    ``raw`` has ``pos, keyword, market_opportunity_score (text), priority``.
    """
    number = F.coalesce(
        F.when(
            F.col("market_opportunity_score").cast("string").rlike(r"^\s*[+-]?\d+\s*$"),
            F.trim(F.col("market_opportunity_score").cast("string")).try_cast("bigint"),
        ),
        F.lit(0),
    )
    score = F.greatest(F.lit(1), F.least(F.lit(10), number)).cast("int")
    cleaned = raw.select(
        key, "pos", strip_space(F.coalesce("keyword", F.lit(""))).alias("keyword"),
        score.alias("market_opportunity_score"), opportunity_priority(F.col("priority"), score).alias("priority"),
    ).filter(F.col("keyword") != "")
    order = [F.desc("market_opportunity_score"), N.priority_rank(F.col("priority"), 9), F.col("pos")]
    return top_k(cleaned, [key], order, limit)


def fallback_opportunities(profiles: DataFrame, key: str) -> DataFrame:
    """Opportunities from the seed keyword, focus keywords and pillars of a profile."""
    default = lambda name, values: F.when(F.size(name) > 0, F.col(name)).otherwise(N.lit_array(values))
    phrases = T.distinct_phrases(
        F.concat(
            F.array("seed_keyword"),
            default("market_focus_keywords", C.DEFAULT_KEYWORDS),
            default("core_service_pillars", C.DEFAULT_PILLARS),
        ),
        5,
    )
    score = F.greatest(F.lit(10) - F.col("i"), F.lit(6))
    return unnest(profiles, phrases, "keyword", [key], "i").select(
        key, (F.col("i") + 1).alias("pos"), "keyword", score.alias("market_opportunity_score"),
        opportunity_priority(F.lit(""), score).alias("priority"),
    )


def compare(flags: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Overlap, gap and the best opportunities of every key, in one row."""
    best = (
        top_k(
            fallback_opportunities(profiles, key), [key],
            [F.desc("market_opportunity_score"), N.priority_rank(F.col("priority"), 9), F.col("pos")], 5,
        )
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "keyword", "market_opportunity_score", "priority"))).alias(
                "market_opportunities"
            )
        )
    )
    scores = overlap(flags, key)
    blank = profiles.select(key).distinct()
    return (
        blank.join(scores, key, "left")
        .select(
            key,
            F.coalesce("overlap_score", F.lit(0.0)).alias("overlap_score"),
            F.coalesce("content_gap", F.lit(100.0)).alias("content_gap"),
        )
        .join(best, key, "left")
        .withColumn("keyword_overlap_score", N.format_percentage(F.col("overlap_score")))
        .withColumn("content_gap_ratio", N.format_percentage(F.col("content_gap")))
    )


def top_competitors(results: DataFrame, key: str, search_host: str, limit: int = 3) -> DataFrame:
    """First distinct web links of a result list, without those of the search host."""
    first = (
        results.filter(F.col("href").contains("http") & ~F.col("href").contains(search_host))
        .groupBy(key, "href").agg(F.min("pos").alias("pos"))
    )
    return top_k(first, [key], [F.col("pos"), F.col("href")], limit)
