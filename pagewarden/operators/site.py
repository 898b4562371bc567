"""Site-level aggregates. All of them combine before the shuffle by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import scores as S
from pagewarden.functions.urls import strip_space
from pagewarden.operators import page_health as PH
from pagewarden.operators.ranking import first_by, numbered, top_k
from pagewarden.operators.rows import unnest


def _tests() -> dict[str, Column]:
    c = F.col
    return {
        "title_coverage": c("title_length").between(C.TITLE_MIN, C.TITLE_MAX),
        "meta_description_coverage": c("meta_description_length").between(C.META_MIN, C.META_MAX),
        "h1_compliance": c("h1_count") == 1,
        "substantive_content_coverage": c("word_count") >= C.MIN_WORDS,
        "canonical_coverage": c("has_canonical"),
        "indexability_coverage": c("is_indexable"),
    }


def title_counts(features: DataFrame) -> DataFrame:
    """Pages of each (site, title) that meet each coverage test. Counts of several batches
    add up."""
    title = strip_space(F.coalesce("title", F.lit("")))
    return features.groupBy("site", title.alias("_title")).agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.count_if(test).alias(key) for key, test in _tests().items()],
    )


def merged_title_counts(parts: DataFrame) -> DataFrame:
    """Title counts of several batches as one."""
    return parts.groupBy("site", "_title").agg(*[F.sum(c).alias(c) for c in ("pages", *_tests())])


def coverage_counts(per_title: DataFrame) -> DataFrame:
    """Pages of each site that meet each coverage test, from its title counts.

    Grouping by (site, title) first makes the count of unique titles a sum, so one pass
    over the pages serves all metrics and a repeated title is combined early.
    """
    return per_title.groupBy("site").agg(
        F.sum("pages").alias("pages"),
        *[F.sum(key).alias(key) for key in _tests()],
        F.count_if((F.col("_title") != "") & (F.col("pages") == 1)).alias("unique_title_coverage"),
    )


def _coverage_rows(counts: DataFrame, metrics: list[tuple[str, str, str, int]], total: Column) -> DataFrame:
    entries = [
        F.struct(
            F.lit(pos).alias("metric_pos"), F.lit(key).alias("metric_key"), F.lit(name).alias("metric"),
            F.lit(category).alias("category"), F.lit(float(minimum)).alias("minimum"),
            F.col(key).alias("matched"),
        )
        for pos, (key, name, category, minimum) in enumerate(metrics, 1)
    ]
    measured = (
        unnest(counts.withColumn("total", total), F.array(*entries), "m", ["site", "total"])
        .select("site", "total", "m.*")
        .withColumn("percentage", N.percent(F.col("matched"), F.col("total")))
    )
    p, minimum = F.col("percentage"), F.col("minimum")
    attained = F.when(p >= minimum, 100.0).otherwise(N.clamp((p / minimum) * 100))
    weak = F.col("metric_key").isin("title_coverage", "meta_description_coverage") & (p < 50)
    scored = measured.withColumn("score", attained).withColumn(
        "score", F.when(weak, F.greatest(F.lit(0.0), F.col("score") - 20)).otherwise(F.col("score"))
    )
    return scored.select(
        "site", "metric_pos", "metric_key", "metric", "category", "matched", "total", "percentage", "score",
        N.status_from_score(F.col("score")).alias("status"),
        N.priority_from_score(F.col("score")).alias("priority"),
    )


def coverage(features: DataFrame) -> DataFrame:
    """Long form of the site coverage findings: one row per site and metric."""
    return coverage_of(title_counts(features))


def coverage_of(per_title: DataFrame) -> DataFrame:
    """The same from title counts."""
    return _coverage_rows(coverage_counts(per_title), C.SITE_METRICS, F.col("pages"))


def optional_coverage(features: DataFrame) -> DataFrame:
    """The four benchmarks that are configured but not part of the site score."""
    meta = strip_space(F.coalesce("description", F.lit("")))
    per_meta = features.groupBy("site", meta.alias("_meta")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("has_structured_data").alias("structured_data_coverage"),
        F.count_if(F.col("has_open_graph") | F.col("has_twitter_card")).alias("social_metadata_coverage"),
        F.sum("total_images").alias("images"),
        F.sum(F.col("total_images") - F.col("missing_alt_count")).alias("alt_text_coverage"),
    )
    counts = per_meta.groupBy("site").agg(
        *[
            F.sum(c).alias(c)
            for c in ("pages", "structured_data_coverage", "social_metadata_coverage", "images", "alt_text_coverage")
        ],
        F.count_if((F.col("_meta") != "") & (F.col("pages") == 1)).alias("unique_meta_coverage"),
    )
    by_page = [m for m in C.OPTIONAL_SITE_METRICS if m[0] != "alt_text_coverage"]
    by_image = [m for m in C.OPTIONAL_SITE_METRICS if m[0] == "alt_text_coverage"]
    return _coverage_rows(counts, by_page, F.col("pages")).unionByName(
        _coverage_rows(counts, by_image, F.col("images"))
    )


def site_scores(features: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Module scores and the weighted score of every site.

    ``broken`` is the broken-link summary per site; a site without one counts as intact.
    """
    scores = {
        key: F.max(F.when(F.col("metric_key") == key, F.col("score"))) for key, *_ in C.SITE_METRICS
    }
    wide = coverage(features).groupBy("site").agg(
        F.max("total").alias("pages"), *[v.alias(k) for k, v in scores.items()]
    )
    if broken is None:
        wide = wide.withColumn("broken_ratio", F.lit(0.0))
    else:
        wide = wide.join(broken.select("site", "broken_ratio"), "site", "left").withColumn(
            "broken_ratio", F.coalesce("broken_ratio", F.lit(0.0))
        )
    c = F.col
    modules = wide.select(
        "site", "pages", "broken_ratio",
        N.round_half_even(
            (c("title_coverage") + c("meta_description_coverage") + c("unique_title_coverage")) / F.lit(3.0), 1
        ).alias("metadata"),
        N.round_half_even((c("h1_compliance") + c("substantive_content_coverage")) / F.lit(2.0), 1).alias("content"),
        N.round_half_even((c("canonical_coverage") + c("indexability_coverage")) / F.lit(2.0), 1).alias("indexation"),
        F.lit(100.0).alias("serp"),
        N.maximum_attainment(c("broken_ratio"), C.BROKEN_RATIO_MAX).alias("integrity"),
    )
    return modules.withColumn(
        "overall_score", N.weighted_score({m: c(m) for m in C.SITE_WEIGHTS}, C.SITE_WEIGHTS)
    ).withColumn("overall_seo_health", N.format_percentage(c("overall_score")))


def domain_authority(features: DataFrame) -> DataFrame:
    raw = F.col("_mean") * 0.75 + F.least(F.lit(15), F.col("pages"))
    return (
        features.groupBy("site")
        .agg(F.sum("page_authority").alias("_sum"), F.count(F.lit(1)).alias("pages"))
        .withColumn("_mean", F.col("_sum") / F.col("pages"))
        .select("site", "pages", N.truncate(N.clamp(raw)).alias("domain_authority"))
    )


def site_summary(features: DataFrame) -> DataFrame:
    """Counts, shares and means of the offline site summary, in one aggregate.

    The two distinct counts expand a row to three; values are combined before the shuffle.
    """
    c, one = F.col, F.lit(1)
    present = lambda name: F.nullif(c(name), F.lit(""))
    agg = features.withColumn("_score", PH.deduction_score()).groupBy("site").agg(
        F.count(one).alias("total_pages"),
        F.sum("_score").alias("_score"),
        F.count(present("title")).alias("titles_present"),
        F.count(present("description")).alias("descs_present"),
        F.count_distinct(present("title")).alias("unique_titles"),
        F.count_distinct(present("description")).alias("unique_descs"),
        F.count_if(c("h1_count") == 1).alias("h1_correct"),
        F.count_if("has_viewport_meta").alias("_viewport"),
        F.count_if("has_canonical").alias("_canonical"),
        F.count_if("is_indexable").alias("_indexable"),
        F.count_if("has_structured_data").alias("_schema"),
        F.count_if(c("og_title") != "").alias("_og"),
        F.sum("word_count").alias("_words"),
        F.sum(F.coalesce("response_ms", F.lit(0))).alias("_ms"),
        F.sum("total_images").alias("total_images"),
        F.sum("missing_alt_count").alias("missing_alt_images"),
    )
    n = c("total_pages")
    share = lambda name: F.rint(c(name) / n * 100).cast("int")
    mean = lambda name: F.rint(c(name) / n).cast("bigint")
    return agg.select(
        "site", "total_pages", mean("_score").alias("avg_score"),
        "titles_present", share("titles_present").alias("titles_pct"),
        "descs_present", share("descs_present").alias("descs_pct"),
        "unique_titles", "unique_descs",
        "h1_correct", share("h1_correct").alias("h1_pct"),
        share("_viewport").alias("viewport_pct"), share("_canonical").alias("canonical_pct"),
        share("_indexable").alias("indexable_pct"), share("_schema").alias("schema_pct"),
        share("_og").alias("og_pct"),
        mean("_words").alias("avg_word_count"), mean("_ms").alias("avg_response_ms"),
        "total_images", "missing_alt_images",
        F.rint(
            (c("total_images") - c("missing_alt_images")) / F.greatest(c("total_images"), one) * 100
        ).cast("int").alias("alt_coverage_pct"),
    )


def severity_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.PRIORITIES]
    )


def issue_matrix(issues: DataFrame) -> DataFrame:
    """Pages per issue and severity, with the place of each by severity, then falling count, then
    name; ``issue_pages`` lists the pages. A site has as many rows as there are kinds of issues."""
    counts = issues.groupBy("site", "issue", "severity").agg(F.count(F.lit(1)).alias("pages"))
    ranked = counts.withColumn("severity_rank", N.priority_rank(F.col("severity"), 3))
    order = Window.partitionBy("site").orderBy("severity_rank", F.desc("pages"), "issue")
    return ranked.withColumn("place", F.row_number().over(order))


def issue_pages(issues: DataFrame) -> DataFrame:
    """Every page of every issue."""
    return issues.select("site", "issue", "severity", "page_id", "url")


def slowest_pages(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Every page with its place by falling response time within its site."""
    return numbered(pages, "site", [F.desc("response_ms"), F.col(page_id)], "place")


def distinct_values(features: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct members of an array column per site, duplicates dropped before the shuffle."""
    return unnest(features, F.array_distinct(column), name, ["site"]).distinct()


def external_domain_report(features: DataFrame, shown: int = 30) -> DataFrame:
    """First domains of each site in order, and how many more there are."""
    domains = distinct_values(features, "external_domains", "domain")
    totals = domains.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    return (
        top_k(domains, ["site"], [F.col("domain")], shown)
        .join(totals, "site")
        .select("site", "rank", "domain", F.greatest(F.col("_n") - shown, F.lit(0)).alias("remaining"))
    )


def site_headings(features: DataFrame) -> DataFrame:
    """Distinct titles and h1-h3 texts of a site, first spelling kept."""
    texts = F.concat(F.array("title"), "headings.h1", "headings.h2", "headings.h3")
    spelled = unnest(features, texts, "text", ["site", "page_id"], "pos").select(
        "site", "page_id", "pos", strip_space(F.regexp_replace("text", r"(?U)\s+", " ")).alias("heading")
    )
    return first_by(
        spelled.filter(F.col("heading") != "").withColumn("heading_key", F.lower("heading")),
        ["site", "heading_key"], ["page_id", "pos"], ["heading", "page_id", "pos"],
    )


def crawl_coverage(features: DataFrame) -> DataFrame:
    """Pages analysed, internal urls discovered and the share analysed, in percent."""
    seen = unnest(features, F.array_append(F.col("internal_links"), F.col("url")), "found", ["site"]).distinct()
    discovered = seen.groupBy("site").agg(F.count(F.lit(1)).alias("discovered_internal_pages"))
    analysed = features.groupBy("site").agg(F.count_distinct("url").alias("analyzed_pages"))
    return analysed.join(discovered, "site").withColumn(
        "sample_coverage_ratio", N.percent(F.col("analyzed_pages"), F.col("discovered_internal_pages"))
    )


def primary_page(features: DataFrame, values: list[str]) -> DataFrame:
    """The page of lowest depth, then lowest id, of each site."""
    return first_by(features, ["site"], ["depth", "page_id"], values)


def speed_averages(pages: DataFrame, key: str = "site") -> DataFrame:
    """Mean mobile and desktop scores; both divide by the pages that have any score."""
    any_score = F.col("mobile_score").isNotNull() | F.col("desktop_score").isNotNull()
    agg = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_crawled"),
        F.count_if(any_score).alias("total_with_performance"),
        F.sum(F.coalesce("mobile_score", F.lit(0))).alias("_m"),
        F.sum(F.coalesce("desktop_score", F.lit(0))).alias("_d"),
    )
    n = F.col("total_with_performance")
    mean = lambda s: F.when(n > 0, N.truncate(F.col(s) / n)).otherwise(0)
    return agg.select(
        key, "total_crawled", "total_with_performance",
        mean("_m").alias("mobile_avg"), mean("_d").alias("desktop_avg"),
        (F.col("total_crawled") - n).alias("missing_data"),
    )


def word_count_table(features: DataFrame) -> DataFrame:
    return features.select(
        "site", "page_id", "url", "word_count", "page_type",
        S.thin_content_label(F.col("word_count")).alias("assessment"),
    )


def summary_table(summary: DataFrame) -> DataFrame:
    """Pass, warning or fail of every metric of ``site_summary``, one row each."""
    c = F.col
    full = lambda x: x == 100
    rows = [
        ("Title Tag Coverage", c("titles_pct"), full(c("titles_pct")), F.lit(False)),
        ("Meta Description Coverage", c("descs_pct"), full(c("descs_pct")), F.lit(False)),
        ("Correct H1 Usage (1 per page)", c("h1_pct"), full(c("h1_pct")), c("h1_pct") >= 50),
        ("Mobile Viewport Tag", c("viewport_pct"), full(c("viewport_pct")), F.lit(False)),
        ("Canonical Tag Coverage", c("canonical_pct"), full(c("canonical_pct")), F.lit(True)),
        ("Indexable Pages", c("indexable_pct"), full(c("indexable_pct")), F.lit(True)),
        ("Image Alt Text Coverage", c("alt_coverage_pct"), c("alt_coverage_pct") >= 90, c("alt_coverage_pct") >= 50),
        ("Structured Data (Schema)", c("schema_pct"), c("schema_pct") >= 50, F.lit(True)),
        ("Open Graph Tags", c("og_pct"), c("og_pct") >= 50, F.lit(True)),
        ("Unique Title Tags", c("unique_titles"), c("unique_titles") == c("titles_present"), F.lit(True)),
        ("Unique Meta Descriptions", c("unique_descs"), c("unique_descs") == c("descs_present"), F.lit(True)),
    ]
    entries = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(name).alias("metric"), value.cast("bigint").alias("value"),
            F.when(ok, "Pass").when(warn, "Warning").otherwise("Fail").alias("result"),
        )
        for i, (name, value, ok, warn) in enumerate(rows, 1)
    ]
    return unnest(summary, F.array(*entries), "r", ["site"]).select("site", "r.*")
