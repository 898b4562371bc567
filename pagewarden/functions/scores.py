"""Score Columns for pages, speed and text tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N


def _steps(x: Column, steps: list[tuple[float, float]], otherwise: float = 0) -> Column:
    """Points of the first bound that ``x`` exceeds."""
    out = None
    for bound, points in steps:
        out = F.when(x > bound, points) if out is None else out.when(x > bound, points)
    return out.otherwise(otherwise)


def page_authority(
    words: Column, internal: Column, external: Column,
    structured: Column, open_graph: Column, images: Column,
) -> Column:
    """Heuristic 0-100 estimate from on-page signals."""
    score = (
        F.lit(20)
        + _steps(words, [(2000, 30), (1000, 22), (500, 14), (200, 7)])
        + _steps(internal, [(50, 25), (20, 18), (10, 12), (2, 6)])
        + F.when(structured, 6).otherwise(0)
        + F.when(open_graph, 4).otherwise(0)
        + F.when(images > 0, 5).otherwise(0)
        - F.when((external > 50) & (external > internal * 3), 15)
        .when((external > 20) & (external > internal * 2), 7)
        .otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def content_tier(words: Column, average_includes_bound: bool = True) -> Column:
    average = words <= 800 if average_includes_bound else words < 800
    return F.when(words < C.MIN_WORDS, "Low").when(average, "Average").otherwise("High")


def content_points(words: Column, average_includes_bound: bool = True) -> Column:
    tier = content_tier(words, average_includes_bound)
    return F.when(tier == "Low", 40).when(tier == "Average", 70).otherwise(100)


def thin_content_label(words: Column) -> Column:
    return F.when(words >= 300, "Good").when(words >= 100, "Thin").otherwise("Very Thin")


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "Excellent")
        .when(score >= 60, "Good")
        .when(score >= 40, "Needs Attention")
        .otherwise("Poor")
    )


def speed(ttfb: Column, size_kb: Column, mobile: bool) -> Column:
    """Speed score, status and load time from time to first byte (s) and size (KB)."""
    base = (
        F.when(ttfb < 0.4, 98).when(ttfb < 0.7, 90).when(ttfb < 1.1, 75)
        .when(ttfb < 1.8, 55).when(ttfb < 3.0, 30).otherwise(10)
    )
    heavy = F.when(size_kb > 800, 15).when(size_kb > 400, 8).otherwise(0)
    score = F.greatest(F.lit(5), F.least(F.lit(100), base - F.lit(15 if mobile else 0) - heavy))
    return F.struct(
        score.alias("score"),
        F.when(score >= 90, "Fast").when(score >= 70, "Moderate").otherwise("Slow").alias("status"),
        N.round_half_even(ttfb * F.lit(1.8 if mobile else 1.2), 2).alias("load_time"),
    )


def load_estimate(words: Column, images: Column, mobile: bool) -> Column:
    """Load time and score guessed from the amount of content."""
    base = F.lit(0.8) + words / F.lit(2000.0) + images * F.lit(0.1)
    load = N.round_half_even(base * F.lit(1.5 if mobile else 1.0), 2)
    score = N.truncate(N.clamp(F.lit(100) - load * F.lit(10 if mobile else 5)))
    return F.struct(
        load.alias("load_time"),
        score.alias("score"),
        F.when(score >= 90, "Fast").when(score >= 50, "Moderate").otherwise("Slow").alias("status"),
    )


def is_broken(status: Column) -> Column:
    return (status == 0) | (status >= 400)


def fetch_failure(status: Column, error_kind: Column) -> Column:
    """Class of a failed fetch from its status code or kind of error."""
    return (
        F.when(status.isin(401, 403, 405), "blocked")
        .when(status == 404, "missing")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server")
        .when(status.between(400, 499), "client")
        .when(error_kind == "timeout", "timeout")
        .when(error_kind == "too_many_redirects", "redirect_loop")
        .otherwise("network")
    )


def resource_verdict(kind: str, final_url: Column, status: Column, content_type: Column, body: Column) -> Column:
    """Verdict text for a fetched robots.txt or sitemap."""
    from pagewarden.functions.urls import path

    low, mime = F.lower(body), F.lower(F.coalesce(content_type, F.lit("")))
    if kind == "robots":
        typed, shaped = mime.contains("text/plain"), low.rlike("user-agent|disallow|allow")
        shape_text = "Invalid (Missing directives)"
    else:
        typed, shaped = mime.contains("xml"), low.rlike("<urlset|<sitemapindex")
        shape_text = "Invalid (Missing XML structure)"
    return (
        F.when(F.coalesce(status, F.lit(0)) == 0, "Missing")
        .when(path(final_url).isin("", "/"), "Invalid (Redirected to homepage)")
        .when(status != 200, "Missing")
        .when(F.coalesce(body, F.lit("")).rlike(r"^\s*$"), "Invalid (Empty response)")
        .when(mime.contains("text/html") | low.contains("<html"), "Invalid (HTML response)")
        .when(~typed, "Invalid (Wrong Content-Type)")
        .when(~shaped, shape_text)
        .otherwise("Found (Valid)")
    )
