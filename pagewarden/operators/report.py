"""Report data: verdict, roadmap, limitations, notes and the report document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.operators.ranking import first_by, top_k
from pagewarden.operators.rows import unnest


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings with their place after the stable sort by priority (needs ``metric_pos``).

    Only the finding list of one site is numbered, and a site has a fixed number of metrics.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy(N.priority_rank(F.col("priority")), "metric_pos")
    return findings.withColumn("finding_pos", F.row_number().over(w))


def priority_lists(findings: DataFrame) -> DataFrame:
    """High, medium and low findings of each site as whole lists, in the order of their place.

    Needs ``ordered_findings``; a site has a fixed number of findings.
    """
    listed = F.array_sort(F.collect_list(F.struct("finding_pos", "priority", "metric")))
    of = lambda p: F.transform(F.filter("f", lambda x: x["priority"] == p), lambda x: x["metric"]).alias(p.lower())
    return findings.groupBy("site").agg(listed.alias("f")).select("site", *[of(p) for p in ("High", "Medium", "Low")])


def preferred(rows: DataFrame, wanted: Column, order: str, values: list[str], key: str = "site") -> DataFrame:
    """First row that meets ``wanted``, else the first row, of each key."""
    ranked = rows.withColumn("_other", F.when(F.coalesce(wanted, F.lit(False)), 0).otherwise(1))
    return first_by(ranked, [key], ["_other", order], values)


def top_finding(findings: DataFrame, priority: str = "High") -> DataFrame:
    return preferred(
        findings, F.col("priority") == priority, "finding_pos", ["metric", "priority", "score"]
    )


def best_metric(metrics: DataFrame) -> DataFrame:
    return preferred(metrics, F.col("status") == "At Benchmark", "metric_pos", ["metric", "status", "percentage"])


def verdict(score: Column) -> Column:
    return (
        F.when(score >= 85, "Strong foundation with room to grow.")
        .when(score >= 70, "Moderate maturity with clear gaps to close.")
        .otherwise("Performance is at risk; repairs are due.")
    )


def management_summary(
    scores: DataFrame, findings: DataFrame, metrics: DataFrame, opportunities: DataFrame
) -> DataFrame:
    """Verdict, strongest metric, biggest risk and top opportunity of every site.

    ``opportunities`` are ranked rows ``site, rank, keyword``.
    """
    risk = top_finding(findings).select("site", F.col("metric").alias("biggest_risk"))
    asset = best_metric(metrics).select("site", F.col("metric").alias("strongest_asset"))
    growth = opportunities.filter(F.col("rank") == 1).select("site", F.col("keyword").alias("growth_opportunity"))
    return (
        scores.select("site", "overall_score", verdict(F.col("overall_score")).alias("board_verdict"))
        .join(asset, "site", "left").join(risk, "site", "left").join(growth, "site", "left")
        .select(
            "site", "overall_score", "board_verdict",
            F.coalesce("strongest_asset", F.lit("Baseline coverage")).alias("strongest_asset"),
            F.coalesce("biggest_risk", F.lit("Technical discipline")).alias("biggest_risk"),
            F.coalesce("growth_opportunity", F.lit("high-intent topics")).alias("growth_opportunity"),
        )
    )


def roadmap(findings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Three phases per site: two High actions, two Medium actions, then content and measuring.

    A phase without findings of its priority takes places 1-2, or 3-4, of the list.
    """
    lists = findings.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("finding_pos", "priority", "metric"))).alias("f")
    )
    of = lambda p: F.slice(F.filter("f", lambda x: x["priority"] == p), 1, 2)
    names = lambda a: F.transform(a, lambda x: x["metric"])
    pick = lambda p, start: names(F.when(F.size(of(p)) > 0, of(p)).otherwise(F.slice("f", start, 2)))
    growth = opportunities.filter(F.col("rank") == 1).select("site", F.col("keyword").alias("_k"))
    third = F.array(
        F.concat(F.lit("Content on "), F.coalesce("_k", F.lit("the top opportunity"))),
        F.lit("Connect search and visitor statistics"),
        F.lit("Crawl the whole site again"),
    )
    phase = lambda i, span, priority, actions: F.struct(
        F.lit(i).alias("phase"), F.lit(span).alias("timeline"), F.lit(priority).alias("priority"), actions.alias("actions")
    )
    phases = F.array(
        phase(1, "0-30 days", "High", pick("High", 1)),
        phase(2, "31-60 days", "Medium", pick("Medium", 3)),
        phase(3, "61-90 days", "Medium", third),
    )
    return unnest(lists.join(growth, "site", "left"), phases, "p", ["site"]).select("site", "p.*")


def data_limitations(crawl: DataFrame) -> DataFrame:
    """What the audit could not see; needs ``analyzed_pages, sample_coverage_ratio``."""
    # fixed values: names of the data sources
    notes = [
        ("Google Search Console", F.lit("Not connected")),
        ("Analytics and Conversion Data", F.lit("Not connected")),
        ("Core Web Vitals and Speed Testing", F.lit("Not measured in this crawl")),
        ("Backlink and Authority Intelligence", F.lit("Not connected")),
        (
            "Full Site Crawl Coverage",
            F.format_string(
                "%s pages, %s%% of the discovered urls", F.col("analyzed_pages").cast("string"),
                F.col("sample_coverage_ratio").cast("string"),
            ),
        ),
    ]
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("data_source"), s.alias("current_status"))
        for i, (n, s) in enumerate(notes, 1)
    ]
    return unnest(crawl, F.array(*rows), "n", ["site"]).select("site", "n.*")


def evidence_notes(crawl: DataFrame) -> DataFrame:
    """Counters of the crawl as notes, one row per note."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("string")
    notes = [
        F.format_string("robots.txt answered with %s.", c("robots_status")),
        F.format_string("The sitemap answered with %s.", c("sitemap_status")),
        F.format_string("%s of %s checked links are broken.", c("broken_count"), c("checked_count")),
        F.format_string("robots.txt names %s sitemaps.", c("declared_sitemaps")),
        F.format_string("%s of %s discovered urls were analysed.", c("analyzed_pages"), c("discovered_internal_pages")),
    ]
    return unnest(crawl, F.array(*notes), "note", ["site"], "pos")


def first_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` report rows of each site."""
    return top_k(df, ["site"], order, k)


def report_document(
    scores: DataFrame, summary: DataFrame, findings: DataFrame, opportunities: DataFrame,
    crawl: DataFrame, profiles: DataFrame, as_of: str,
) -> DataFrame:
    """One JSON document per site. Page rows are a table of their own, as they may be many."""
    actions = (
        first_rows(findings, [F.col("finding_pos")], 4)
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "priority", "metric"))).alias("priority_actions"))
    )
    all_findings = findings.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("finding_pos", "category", "metric", "score", "status", "priority"))).alias(
            "technical_findings"
        )
    )
    chances = opportunities.filter(F.col("rank") <= 5).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("rank", "keyword", "market_opportunity_score", "priority"))).alias(
            "market_opportunities"
        )
    )
    phases = roadmap(findings, opportunities).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("phase", "timeline", "priority", "actions"))).alias("recommended_roadmap")
    )
    joined = (
        scores.join(summary.select("site", "board_verdict", "strongest_asset", "biggest_risk", "growth_opportunity"), "site", "left")
        .join(actions, "site", "left").join(all_findings, "site", "left").join(chances, "site", "left")
        .join(phases, "site", "left").join(crawl, "site", "left")
        .join(profiles.select("site", "company_name", "business_summary"), "site", "left")
    )
    document = F.struct(
        F.lit("Management SEO Audit Report").alias("report_title"),
        F.concat_ws(" ", F.coalesce("company_name", F.lit(C.DEFAULT_COMPANY)), F.lit(C.DEFAULT_AUDIENCE)).alias("prepared_for"),
        F.col("site").alias("website"), F.lit(as_of).alias("generated_on"),
        F.struct(
            N.format_percentage(F.col("overall_score")).alias("overall_seo_health"),
            N.format_percentage(F.col("metadata")).alias("metadata_health"),
            N.format_percentage(F.col("content")).alias("content_depth"),
        ).alias("hero_metrics"),
        F.struct("analyzed_pages", "discovered_internal_pages", "sample_coverage_ratio").alias("crawl_overview"),
        F.struct("board_verdict", "strongest_asset", "biggest_risk", "growth_opportunity").alias("management_summary"),
        "priority_actions", "technical_findings", "market_opportunities", "recommended_roadmap",
        "company_name", "business_summary",
    )
    return joined.select("site", F.to_json(document).alias("document"))
