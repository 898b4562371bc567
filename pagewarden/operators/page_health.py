"""Further judgements of one page: issue buckets, health, light audit, checklists."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import scores as S
from pagewarden.operators.findings import RuleSet, _text

_KEYS = ["site", "page_id", "url"]


def _list(*items: tuple[Column, Column | str]) -> Column:
    return F.array_compact(
        F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in items])
    )


def page_info(features: DataFrame) -> DataFrame:
    """Display defaults for missing title, description and canonical."""
    shown = lambda name, empty: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(empty))
    return features.select(
        *_KEYS,
        shown("title", "N/A").alias("title"),
        shown("description", "Not Found").alias("meta_description"),
        shown("canonical_url", "Not Found").alias("canonical"),
        F.when(F.coalesce("is_indexable", F.lit(True)), "Indexable").otherwise("Noindex").alias("indexing_status"),
    )


def page_summary(features: DataFrame) -> DataFrame:
    """Load estimate, issue buckets, five-part health and priority action per page.

    ``mobile_score`` and ``desktop_score`` columns replace the estimate when present.
    """
    have = features.columns
    mobile = S.load_estimate(F.col("word_count"), F.col("total_images"), True)
    desktop = S.load_estimate(F.col("word_count"), F.col("total_images"), False)
    extra = ["crawl_issues"] if "crawl_issues" in have else []
    rows = features.select(
        *_KEYS, "page_type", "word_count", "h1_count", "has_viewport_meta", "is_indexable", "total_images",
        "missing_alt_count", "title", "description", "canonical_url", "headings",
        "dofollow_links", "nofollow_links", "page_authority", *extra,
        mobile.alias("mobile"), desktop.alias("desktop"),
        (F.col("mobile_score") if "mobile_score" in have else mobile["score"]).alias("mobile_score"),
        (F.col("desktop_score") if "desktop_score" in have else desktop["score"]).alias("desktop_score"),
    )
    slow = (F.col("mobile_score") < 50) | (F.col("desktop_score") < 50)
    no_meta, no_h1, many_h1 = F.col("description") == "", F.col("h1_count") == 0, F.col("h1_count") > 1
    thin, alt, hidden = F.col("word_count") < C.MIN_WORDS, F.col("missing_alt_count") > 0, ~F.col("is_indexable")
    # fixed values: issue texts, they are keys of the report
    critical = _list((no_meta, "Missing meta description"), (hidden, "Page is marked noindex"))
    high = _list((no_h1, "No H1 heading found"), (slow, "Slow page load performance"))
    medium = _list(
        (many_h1, "Multiple H1 headings detected"),
        (thin, _text("Low word count (", F.col("word_count"), " words)")),
        (alt, _text("Missing alt tags on ", F.col("missing_alt_count"), " images")),
    )
    advice = _list(
        (no_meta, "Write a meta description of 150 to 160 characters."),
        (no_h1, "Add one H1 with the main keyword."),
        (many_h1, "Keep a single H1."),
        (thin, "Write at least 300 words."),
        (alt, _text("Describe ", F.col("missing_alt_count"), " images.")),
        (slow, "Shrink images and load scripts later."),
        (hidden, "Remove noindex if the page should be found."),
    )
    listed = rows.select(
        "*",
        F.struct(
            critical.alias("critical"), high.alias("high"), medium.alias("medium"),
            N.lit_array([]).alias("low"),
        ).alias("issues"),
        advice.alias("recommendations"),
    )
    title_length = F.when(F.col("title") == "", 3).otherwise(F.length("title"))
    clean = F.size("crawl_issues") <= 0 if extra else F.lit(True)
    third = lambda a, b, c: (a + b + c) / F.lit(3.0)
    pick = lambda cond, yes, no: F.when(cond, float(yes)).otherwise(float(no))
    parts = listed.select(
        "*",
        third(
            pick(F.startswith("url", F.lit("https")), 100, 50),
            pick(F.col("has_viewport_meta"), 100, 50),
            pick(clean, 100, 70),
        ).alias("_technical"),
        third(
            pick((F.col("title") != "") & (title_length > 10) & (title_length < 70), 100, 50),
            pick(~no_meta, 100, 0),
            F.when(F.col("h1_count") == 1, 100.0).when(many_h1, 50.0).otherwise(0.0),
        ).alias("_onpage"),
        S.content_points(F.col("word_count")).cast("double").alias("_content"),
        ((F.col("mobile_score") + F.col("desktop_score")) / F.lit(2.0)).alias("_performance"),
        F.greatest(
            F.lit(0),
            F.lit(100)
            - F.size("issues.critical") * 15 - F.size("issues.high") * 10
            - F.size("issues.medium") * 5 - F.size("issues.low") * 2,
        ).cast("double").alias("_issues"),
    )
    health = F.lit(0.0)
    for name, weight in C.HEALTH_WEIGHTS.items():
        health = health + F.col(f"_{name}") * F.lit(weight)
    return parts.select(
        *_KEYS, "page_type", "word_count",
        S.content_tier(F.col("word_count")).alias("content_quality"),
        "h1_count",
        F.coalesce(F.try_element_at("headings.h1", F.lit(1)), F.lit("Missing H1")).alias("h1_content"),
        F.size("headings.h2").alias("h2_count"),
        F.size("headings.h3").alias("h3_count"),
        F.startswith("url", F.lit("https")).alias("https"),
        F.col("has_viewport_meta").alias("mobile_friendly"),
        "mobile", "desktop", "mobile_score", "desktop_score",
        _list(
            (F.col("mobile_score") < 50, "Slow rendering on mobile."),
            (F.col("desktop.load_time") > 3.0, "Desktop load above 3 s."),
        ).alias("performance_issues"),
        N.truncate(F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.rint(health)))).alias("seo_score"),
        F.struct(*[N.truncate(F.col(f"_{n}")).alias(n) for n in C.HEALTH_WEIGHTS]).alias("scores"),
        "issues", "recommendations",
        F.coalesce(
            F.try_element_at("issues.critical", F.lit(1)),
            F.try_element_at("issues.high", F.lit(1)),
            F.try_element_at("issues.medium", F.lit(1)),
            F.lit("None"),
        ).alias("priority_action"),
        "dofollow_links", "nofollow_links", "page_authority",
        "title", "description", "canonical_url", "is_indexable",
    )


def light_audit(features: DataFrame) -> DataFrame:
    """Three quick scores: metadata, amount of content, https."""
    title = N.range_attainment(F.length("title"), C.TITLE_MIN, C.TITLE_MAX)
    description = N.range_attainment(F.length("description"), C.META_MIN, C.META_MAX)
    points = S.content_points(F.col("word_count"), average_includes_bound=False)
    https = F.startswith("url", F.lit("https"))
    return features.select(
        *_KEYS,
        title.alias("title_score"),
        description.alias("description_score"),
        ((title + description) / 2).alias("metadata_health"),
        points.alias("word_count_score"),
        F.when(points < 50, "Low").otherwise("High").alias("quality"),
        https.alias("https"),
        F.col("has_viewport_meta").alias("mobile_friendly"),
        F.when(https, 100).otherwise(50).alias("technical_score"),
    )


@cache
def checklist() -> RuleSet:
    """The eleven-point checklist with severities, as a rule set."""
    c = F.col
    t, m = F.length("title"), F.length("description")
    h1, words, links = c("h1_count"), c("word_count"), c("internal_links_count")
    rules = RuleSet()
    # fixed values: issue texts and severities, they are keys of the report
    for name, category, severity, predicate in [
        (F.lit("Missing Title Tag"), "title", "High", t == 0),
        (_text("Title Too Short (", t, " chars)"), "title", "Medium", (t > 0) & (t < 30)),
        (_text("Title Too Long (", t, " chars)"), "title", "Low", t > 65),
        (F.lit("Missing Meta Description"), "meta", "High", m == 0),
        (_text("Meta Description Too Short (", m, " chars)"), "meta", "Medium", (m > 0) & (m < 80)),
        (_text("Meta Description Too Long (", m, " chars)"), "meta", "Low", m > 165),
        (F.lit("Missing H1 Tag"), "h1", "High", h1 == 0),
        (_text("Multiple H1 Tags (", h1, " found)"), "h1", "Medium", h1 > 1),
        (_text("Very Low Word Count (", words, " words)"), "content", "High", words < 100),
        (_text("Low Word Count (", words, " words)"), "content", "Medium", words.between(100, 299)),
        (F.lit("Missing Canonical Tag"), "canonical", "Medium", ~c("has_canonical")),
        (F.lit("Missing Viewport Meta Tag"), "viewport", "High", ~c("has_viewport_meta")),
        (F.lit("Page Blocked from Indexing (noindex)"), "index", "High", ~c("is_indexable")),
        (
            _text("Images Missing Alt Text (", c("missing_alt_count"), "/", c("total_images"), ")"),
            "images", "Medium", (c("total_images") > 0) & (c("missing_alt_count") > 0),
        ),
        (_text("Very Few Internal Links (", links, ")"), "links", "Medium", links < 3),
        (F.lit("No Structured Data (Schema Markup)"), "schema", "Low", ~c("has_structured_data")),
        (F.lit("Missing Open Graph Tags"), "social", "Low", c("og_title") == ""),
    ]:
        rules.add(category, category, predicate, name, severity=severity)
    return rules


def page_issues(features: DataFrame) -> DataFrame:
    """Checklist issues, one row each."""
    return checklist().apply(features).select(*_KEYS, F.col("message").alias("issue"), "severity", "rule_pos")


@cache
def deduction_score() -> Column:
    """100 less fixed deductions, on the columns of ``page_features``."""
    c = F.col
    t, m, h1, words = F.length("title"), F.length("description"), c("h1_count"), c("word_count")
    images, missing = c("total_images"), c("missing_alt_count")
    deductions = [
        F.when(t == 0, 20).when((t < 30) | (t > 70), 8),
        F.when(m == 0, 15).when((m < 80) | (m > 170), 6),
        F.when(h1 == 0, 15).when(h1 > 1, 7),
        F.when(words < 100, 10).when(words < 300, 5),
        F.when(~c("has_canonical"), 10),
        F.when(~c("has_viewport_meta"), 10),
        F.when(
            (images > 0) & (missing > 0),
            F.least(F.lit(5), F.rint((missing / images) * 5).cast("int")),
        ),
        F.when(c("internal_links_count") < 3, 5),
        F.when(~c("has_structured_data"), 3),
        F.when(c("og_title") == "", 2),
    ]
    score = F.lit(100)
    for d in deductions:
        score = score - d.otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def page_scores(features: DataFrame) -> DataFrame:
    """Deduction score, its label and the number of checklist issues per page."""
    score = deduction_score()
    return features.select(
        *_KEYS,
        score.alias("score"),
        S.score_label(score).alias("label"),
        F.size(checklist().as_array()).alias("issue_count"),
    )
