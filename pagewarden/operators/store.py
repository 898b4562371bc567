"""Stored audits: split, upsert, list, rebuild, reshape, delete, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions.urls import project_key
from pagewarden.operators.findings import _text
from pagewarden.operators.ranking import first_by, numbered, top_k

TABLES = ["projects", "audit_results", "ai_insights", "seo_data", "crawl_data"]

_CHILD_COLUMNS = {
    "audit_results": ["overall_seo_health", "metric_summary", "findings"],
    "ai_insights": ["executive_summary", "management_summary", "recommended_roadmap", "data_limitations", "insights"],
    "seo_data": ["competitive_intelligence", "keyword_analysis"],
    "crawl_data": ["crawl_overview", "pages", "page_speed", "link_analysis", "content_strategy"],
}


def latest_runs(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last run of every project, as a combining aggregate instead of a sort."""
    values = [c for c in runs.columns if c != key]
    return first_by(runs, [key], order, values, latest=True)


def split_audit(audits: DataFrame) -> dict[str, DataFrame]:
    """One wide audit per project into the five linked tables; absent columns are left out."""
    have = set(audits.columns)
    keyed = audits.withColumn("url", project_key(F.col("url"))).withColumn("project_id", F.sha2(F.col("url"), 256))
    bucket = F.pmod(F.xxhash64("project_id"), F.lit(64)).cast("int").alias("site_bucket")
    project = ["url", "business_type", "seo_score", "report_url", "site_favicon", "updated_at"]
    out = {"projects": keyed.select("project_id", bucket, *[c for c in project if c in have or c == "url"])}
    for table, columns in _CHILD_COLUMNS.items():
        out[table] = keyed.select("project_id", bucket, *[c for c in columns if c in have], "updated_at")
    return out


def upsert_projects(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored projects with the incoming ones merged in by url.

    A known project keeps its id and ``created_at`` and takes the other fields.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    fields = [c for c in incoming.columns if c not in ("url", "project_id", "created_at", "updated_at")]
    joined = s.join(i, F.col("s.url") == F.col("i.url"), "full")
    new = F.col("i.url").isNotNull()
    return joined.select(
        F.coalesce("s.project_id", "i.project_id").alias("project_id"),
        F.coalesce("s.url", "i.url").alias("url"),
        *[F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in fields],
        F.coalesce("s.created_at", "i.updated_at").alias("created_at"),
        F.when(new, F.col("i.updated_at")).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def replace_children(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Child rows of incoming projects replace the stored ones.

    The ids are never broadcast: the size of a compressed file is far below that of its ids,
    and all of them would go through the driver once per table.
    """
    return stored.join(incoming.select("project_id").hint("merge"), "project_id", "left_anti").unionByName(
        incoming, allowMissingColumns=True
    )


def delete_projects(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given projects, whose ids are never broadcast."""
    keys = gone.select("project_id").distinct().hint("merge")
    return {name: table.join(keys, "project_id", "left_anti") for name, table in tables.items()}


def status_points(status: Column) -> Column:
    low = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(low.rlike("good|pass|meets standard|excellent"), 100)
        .when(low.rlike("needs work|improvement|moderate|fair"), 60)
        .otherwise(25)
    )


def score_from_statuses(statuses: Column) -> Column:
    """Mean of the points of an array of status labels, 0 when there are none."""
    total = F.aggregate(F.transform(statuses, status_points), F.lit(0), lambda a, x: a + x)
    n = F.size(statuses)
    return F.when(n > 0, F.rint(total / n).cast("int")).otherwise(0)


def parsed_health(health: Column) -> Column:
    """'62%' or 62 as a whole number, 0 when it is neither."""
    text = F.replace(F.coalesce(health.cast("string"), F.lit("")), F.lit("%"), F.lit(""))
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int")).otherwise(0)


def recovered_score(stored: Column, health: Column, derived: Column) -> Column:
    """Stored score, else the audit's, else the derived one, else 0."""
    zero = F.lit(0)
    return F.coalesce(
        F.nullif(stored.cast("int"), zero), F.nullif(parsed_health(health), zero), derived, zero
    )


def project_list(projects: DataFrame, audits: DataFrame, crawls: DataFrame) -> DataFrame:
    """Projects with scores, counts and crawl status; the newest have the highest ``created_at``.

    ``audits``: ``project_id, overall_seo_health, statuses ARRAY, findings_count``;
    ``crawls``: ``project_id, pages_analyzed, pages_discovered, robots_status, sitemap_status``.
    """
    a = audits.select(
        "project_id", "overall_seo_health", score_from_statuses(F.col("statuses")).alias("_derived"),
        "findings_count", F.size("statuses").alias("metrics_count"),
    )
    joined = projects.join(a, "project_id", "left").join(crawls, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—")).alias(c)
    return joined.select(
        *[c for c in projects.columns if c != "seo_score"],
        recovered_score(F.col("seo_score"), F.col("overall_seo_health"), F.col("_derived")).alias("seo_score"),
        zero("findings_count"), zero("metrics_count"), zero("pages_analyzed"), zero("pages_discovered"),
        dash("robots_status"), dash("sitemap_status"),
    )


def newest_first(projects: DataFrame, id_col: str = "project_id") -> DataFrame:
    """Projects with their place in the list, newest first."""
    one = projects.withColumn("_all", F.lit(0))
    return numbered(one, "_all", [F.desc_nulls_last("created_at"), F.col(id_col)], "place").drop("_all")


def rebuild(tables: dict[str, DataFrame], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Full audits from the five tables; missing children leave defaults."""
    out = tables["projects"]
    for name in TABLES[1:]:
        child = tables[name].drop("updated_at", "site_bucket").withColumn(f"_{name}", F.lit(True))
        out = out.join(child, "project_id", "left")
    filled = {
        "benchmark_reference_year": F.lit(C.BENCHMARK_YEAR),
        "overall_seo_health": F.concat(F.coalesce(F.col("overall_seo_health"), F.col("seo_score"), F.lit(0)).cast("string"), F.lit("%")),
        "seo_health": F.concat(F.coalesce(F.col("seo_score"), F.lit(0)).cast("string"), F.lit("%")),
        "overall_score": F.coalesce(F.col("seo_score"), F.lit(0)),
        "status": F.lit("completed"),
    }
    for name, value in (defaults or {}).items():
        filled[name] = F.coalesce(F.col(name), value)
    return out.withColumns(filled).drop(*[f"_{n}" for n in TABLES[1:]])


_ISSUES = "array<struct<title:string,severity:string,recommended_fix:string>>"


def flat_pages(pages: DataFrame) -> DataFrame:
    """One flat row per stored page, whichever of the two stored shapes it has.

    Needs all of: ``url, title, description, title_length, meta_description_length,
    word_count, is_indexable, canonical_url, seo_health, seo_score, headings
    STRUCT<h1..h6 ARRAY, h1_count..h6_count>, page_info STRUCT<title, meta_description,
    canonical, indexing_status>, content STRUCT<word_count>, has_technical_seo BOOLEAN,
    issues ARRAY<STRING>``, each of them nullable.
    """
    c = F.col
    some = lambda x: F.nullif(x, F.lit(""))
    title = F.coalesce(some(c("page_info.title")), c("title"), F.lit(""))
    meta = F.coalesce(some(c("page_info.meta_description")), c("description"), F.lit(""))
    listed = c("page_info.indexing_status")
    indexable = F.coalesce(
        c("is_indexable"), F.when(F.coalesce(listed, F.lit("")) != "", F.lower(listed) != "noindex"),
        F.when(c("has_technical_seo"), F.lit(True)),
    )
    count = lambda n: F.coalesce(
        F.when(c(f"headings.h{n}").isNotNull(), F.size(c(f"headings.h{n}"))), c(f"headings.h{n}_count"), F.lit(0)
    ).alias(f"h{n}_count")
    shaped = pages.select(
        "url", title.alias("_title"), meta.alias("_meta"),
        F.coalesce(c("title_length"), F.when(~title.isin("", "N/A"), F.length(title))).alias("title_length"),
        F.coalesce(c("meta_description_length"), F.when(~meta.isin("", "Not Found"), F.length(meta))).alias("meta_description_length"),
        F.coalesce(c("word_count"), c("content.word_count")).alias("word_count"),
        *[count(n) for n in range(1, 7)],
        F.coalesce(F.try_element_at("headings.h1", F.lit(1)), F.lit("Missing H1")).alias("h1_content"),
        indexable.alias("is_indexable"),
        F.coalesce(some(listed), F.when(indexable, "Indexable").otherwise("Noindex")).alias("indexing_status"),
        F.coalesce(some(c("seo_health")), F.when(c("seo_score") != 0, _text(c("seo_score"), "%"))).alias("seo_health"),
        F.coalesce(some(c("page_info.canonical")), c("canonical_url")).alias("canonical_url"),
        F.coalesce("issues", N.lit_array([])).alias("_issues"),
    )
    t, m, h1, words = F.length("_title"), F.length("_meta"), c("h1_count"), F.coalesce("word_count", F.lit(0))
    no_title, no_meta = c("_title").isin("", "N/A"), c("_meta").isin("", "Not Found")
    issue = lambda test, title, severity, fix: F.when(
        test,
        F.struct(
            (F.lit(title) if isinstance(title, str) else title).alias("title"),
            F.lit(severity).alias("severity"), F.lit(fix).alias("recommended_fix"),
        ),
    )
    # fixed values: issue titles and severities
    found = F.array_compact(
        F.array(
            issue(no_title, "Missing Page Title", "High", "Write a title of 15 to 60 characters."),
            issue(~no_title & (t < 15), "Title Too Short", "Medium", "Lengthen the title."),
            issue(~no_title & (t > 60), "Title Too Long", "Low", "Shorten the title."),
            issue(no_meta, "Missing Meta Description", "High", "Write a meta description."),
            issue(~no_meta & (m < 50), "Meta Description Too Short", "Medium", "Lengthen the meta description."),
            issue(~no_meta & (m > 160), "Meta Description Too Long", "Low", "Shorten the meta description."),
            issue(h1 == 0, "Missing H1 Tag", "High", "Add one H1."),
            issue(h1 > 1, _text("Multiple H1 Tags (", h1, ")"), "Medium", "Keep one H1."),
            issue(words < 100, _text("Low Word Count (", words, " words)"), "Medium", "Write more."),
            issue(~F.coalesce("is_indexable", F.lit(False)), "Page is Blocked from Indexing", "High", "Remove noindex."),
        )
    ).cast(_ISSUES)
    other = F.filter("_issues", lambda s: (s != "") & ~F.lower(s).rlike("title|meta|h1|word count|noindex"))
    carried = F.transform(
        other, lambda s: F.struct(s.alias("title"), F.lit("Medium").alias("severity"), F.lit("Review this finding.").alias("recommended_fix"))
    )
    return (
        shaped.withColumn("issues", F.concat(found, carried))
        .withColumn(
            "recommendations",
            F.transform(
                "issues",
                lambda i: F.struct(
                    i["severity"].alias("priority"), i["title"].alias("issue"), i["recommended_fix"].alias("recommendation")
                ),
            ),
        )
        .drop("_title", "_meta", "_issues")
    )


def snapshots(history: DataFrame, keys: list[str], limit: int = C.SNAPSHOT_LIMIT, order: str = "timestamp") -> DataFrame:
    """The latest snapshots of each key, newest first."""
    return top_k(history, keys, [F.desc(order)], limit)
