"""Local business: reviews, daily metrics, profile and page audits, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import urls as U
from pagewarden.operators import extract as X
from pagewarden.operators.ranking import first_by
from pagewarden.operators.rows import unnest
from pagewarden.session import stored


def stars(rating: Column) -> Column:
    """ONE..FIVE as a number, anything else 0."""
    out = F.when(rating == C.STARS[0], 1)
    for n, name in enumerate(C.STARS[1:], 2):
        out = out.when(rating == name, n)
    return out.otherwise(0)


def sentiment(n: Column) -> Column:
    return F.when(n >= 4, "positive").when(n == 3, "neutral").otherwise("negative")


def review_summary(reviews: DataFrame, key: str) -> DataFrame:
    """Totals, mean rating, response rate and sentiment counts, in one aggregate.

    ``reviews`` has ``star_rating`` (text) and ``has_reply``.
    """
    n = stars(F.col("star_rating"))
    agg = reviews.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum(n).alias("_stars"),
        F.count_if("has_reply").alias("_replied"),
        *[F.count_if(sentiment(n) == s).alias(s) for s in ("positive", "neutral", "negative")],
    )
    total = F.col("total_reviews")
    return agg.select(
        key, "total_reviews",
        N.round_half_even(F.col("_stars") / total, 1).alias("average_rating"),
        N.percent(F.col("_replied"), total).alias("response_rate"),
        (total - F.col("_replied")).alias("unreplied_count"),
        "positive", "neutral", "negative",
    )


def urgent_reviews(reviews: DataFrame) -> DataFrame:
    """Negative reviews nobody has answered."""
    return reviews.filter((stars(F.col("star_rating")) <= 2) & ~F.col("has_reply"))


def daily_totals(series: DataFrame, key: str, metrics: dict[str, str] = C.DAILY_METRICS) -> DataFrame:
    """Sum of every daily metric in its own column, 0 when a metric has no values."""
    value = F.col("value").cast("decimal(28,4)")
    return series.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("metric") == source, value)), F.lit(0)).cast("double").alias(name)
            for source, name in metrics.items()
        ]
    )


def trailing(series: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``; the date filter reaches the scan."""
    end = F.lit(as_of).cast("date")
    return series.filter(F.col("date").between(F.date_sub(end, days), end))


def _issue(code: str, priority: str, text: str) -> Column:
    return F.struct(F.lit(code).alias("issue"), F.lit(priority).alias("priority"), F.lit(text).alias("recommendation"))


def profile_audit(profiles: DataFrame, key: str) -> DataFrame:
    """Completeness, categories and issues of business profiles."""
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    hours = F.col("regularHours").isNotNull()
    more = F.coalesce(F.size("additionalCategories"), F.lit(0)) > 0
    points = lambda n, *tests: sum((F.when(t, n).otherwise(0) for t in tests), F.lit(0))
    completeness = points(25, filled("profile.description"), hours, filled("phoneNumbers.primaryPhone"), filled("websiteUri"))
    categories = points(50, F.col("primaryCategory").isNotNull(), more)
    media = F.lit(60)
    # fixed values: issue titles and priorities
    issues = F.array_compact(
        F.array(
            F.when(~filled("profile.description"), _issue("Missing Business Description", "High", "Describe the business in up to 750 characters.")),
            F.when(~hours, _issue("Missing Business Hours", "High", "State the opening hours.")),
            F.when(~more, _issue("No Secondary Categories", "Medium", "Add two or three further categories.")),
        )
    )
    return profiles.select(
        key, completeness.alias("completeness_score"), categories.alias("category_optimization_score"),
        media.alias("media_engagement_score"),
        N.round_half_even((completeness + categories + media) / F.lit(3.0), 1).alias("overall_gbp_score"),
        issues.alias("issues"), F.col("websiteUri").alias("website_url"),
    )


def local_page_audit(pages: DataFrame, key: str) -> DataFrame:
    """Contact details, local schema and contact pages of a page.

    Needs ``text, city, structured_data_types, hrefs``.
    """
    found = pages.select(
        key,
        X.phone_numbers(F.col("text")).alias("phones_found"),
        X.mentions_city(F.col("text"), F.col("city")).alias("target_city_mentioned"),
        X.has_local_schema(F.col("structured_data_types")).alias("has_local_business_schema"),
        F.size(X.location_links(F.col("hrefs"))).alias("location_pages_found"),
    )
    nap = F.when(F.size("phones_found") > 0, 50).otherwise(0) + F.when(F.col("target_city_mentioned"), 50).otherwise(0)
    schema = F.when(F.col("has_local_business_schema"), 100).otherwise(0)
    contact = F.when(F.col("location_pages_found") > 0, 100).otherwise(0)
    issues = F.array_compact(
        F.array(
            F.when(schema == 0, _issue("Missing LocalBusiness Schema", "High", "Add LocalBusiness markup.")),
            F.when(nap < 100, _issue("Incomplete NAP Details", "Medium", "Show phone number and address.")),
        )
    )
    return found.select(
        "*", nap.alias("nap_score"), schema.alias("schema_score"), contact.alias("location_page_score"),
        N.round_half_even(nap * 0.4 + schema * 0.4 + contact * 0.2, 1).alias("local_seo_score"),
        issues.alias("issues"),
    )


def _bare_domain(url: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.coalesce(url, F.lit("")), r"https://|http://|www\.", ""), "^/+|/+$", ""
    )


def consistency_score(phone: Column, site_phones: Column, profile_url: Column, site_url: Column) -> Column:
    """100 less 30 for a phone the site does not show, less 40 for another domain."""
    digits = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", "")
    wrong_phone = (digits(phone) != "") & ~F.exists(
        F.coalesce(site_phones, N.lit_array([])), lambda p: digits(p) == digits(phone)
    )
    a, b = _bare_domain(profile_url), _bare_domain(site_url)
    wrong_domain = (a != "") & (b != "") & ~b.startswith(a) & ~a.startswith(b)
    return F.lit(100.0) - F.when(wrong_phone, 30.0).otherwise(0.0) - F.when(wrong_domain, 40.0).otherwise(0.0)


def consistency(profiles: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """Profile against web site: ``phone, website_url`` and ``phones_found, website``."""
    return profiles.join(audits, key).select(
        key,
        consistency_score(
            F.col("phone"), F.col("phones_found"), F.col("website_url"), F.col("website")
        ).alias("consistency_score"),
    )


def competitor_signals(features: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Title, description, first h1, schema flag and city mention of a page; needs ``city, text``."""
    return features.select(
        *keep, "url",
        F.col("title").alias("title_tag"), F.col("description").alias("meta_description"),
        F.coalesce(F.try_element_at("headings.h1", F.lit(1)), F.lit("")).alias("h1"),
        X.has_local_schema(F.col("structured_data_types"), C.COMPETITOR_SCHEMA_TYPES).alias("has_local_schema"),
        X.mentions_city(F.col("text"), F.col("city")).alias("city_mentioned"),
    )


def side_by_side(signals: DataFrame, key: str) -> DataFrame:
    """Own signals next to those of each competitor; ``role`` tells the sides apart."""
    shown = ["url", "title_tag", "meta_description", "h1", "has_local_schema", "city_mentioned"]
    signals = stored(signals, "signals")  # both sides read it
    side = lambda role, prefix: signals.filter(F.col("role") == role).select(
        key, *[F.col(c).alias(f"{prefix}_{c}") for c in shown]
    )
    # one own page per key, so that a key has as many rows as it has competitors
    values = [f"own_{c}" for c in shown]
    own = first_by(side("own", "own"), [key], values, values)
    return own.join(side("competitor", "competitor"), key, "left")


def combined_health(website: Column, profile: Column, reviews: Column, performance: Column) -> Column:
    w = C.LOCAL_HEALTH_WEIGHTS
    return N.round_half_even(
        website * w["website"] + profile * w["profile"] + reviews * w["reviews"] + performance * w["performance"], 1
    )


def top_keywords(keywords: DataFrame, key: str) -> DataFrame:
    """Keyword of highest opportunity score per key, the first listed among equals."""
    return keywords.groupBy(key).agg(
        F.max_by(F.struct("query", "impressions", "opportunity_score"), F.struct(F.col("opportunity_score"), -F.col("pos"))).alias("k")
    ).select(key, "k.*")


def recommendations(
    profile_audits: DataFrame, reviews: DataFrame, page_audits: DataFrame, keywords: DataFrame, key: str
) -> DataFrame:
    """Recommendations from four inputs, one row each."""
    row = lambda order, priority, category, title, impact, effort: [
        F.lit(order).alias("source_pos"), priority.alias("priority"), F.lit(category).alias("category"),
        title.alias("title"), impact.alias("expected_impact"), F.lit(effort).alias("effort"),
    ]
    high = F.lit("High")
    profile_rows = unnest(profile_audits, "issues", "i", [key]).select(
        key, *row(1, F.coalesce("i.priority", F.lit("Medium")), "GBP Optimization", F.col("i.issue"),
                  F.when(F.col("i.priority") == "High", "High").otherwise("Medium"), "Low"),
    )
    review_rows = reviews.filter((F.col("response_rate") < 80) & (F.col("unreplied_count") > 0)).select(
        key, *row(2, high, "Reputation Management", F.lit("Low Review Response Rate"), high, "Medium")
    )
    page_rows = page_audits.filter(F.col("schema_score") < 50).select(
        key, *row(3, F.lit("Critical"), "Website Local SEO", F.lit("Missing LocalBusiness Schema"), high, "Low")
    )
    keyword_rows = top_keywords(keywords, key).select(
        key, *row(4, F.lit("Medium"), "Keyword Opportunity", F.concat(F.lit("Target Keyword: "), F.col("query")), high, "High")
    )
    return profile_rows.unionByName(review_rows).unionByName(page_rows).unionByName(keyword_rows)


def dashboard(page_audits: DataFrame, profile_audits: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Combined local health of every location; the performance part is 100."""
    joined = (
        page_audits.select(key, "local_seo_score")
        .join(profile_audits.select(key, "overall_gbp_score"), key, "full")
        .join(reviews.select(key, "response_rate"), key, "full")
    )
    score = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return joined.select(
        key, score("local_seo_score").alias("website_score"), score("overall_gbp_score").alias("gbp_score"),
        score("response_rate").alias("review_score"),
    ).withColumn(
        "combined_score",
        combined_health(F.col("website_score"), F.col("gbp_score"), F.col("review_score"), F.lit(100.0)),
    )
