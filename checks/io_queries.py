"""Queries that write the given data in the form of a source or sink and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import oracle as O
from checks import recipes as R
from checks.page_queries import rule_case
from checks.registry import query
from checks.site_queries import COVERAGE, COVERAGE_ROWS
from pagewarden import constants as C
from pagewarden.operators import local, sitemap, store
from pagewarden.session import checkpoint_folder
from pagewarden.sources import sinks, tables
from pagewarden.sources.audit_store import AuditStore
from pagewarden.sources.pages import read_pages, stream_pages
from pagewarden.streaming import progress


def _place(spark, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_json(df, spark, schema: str):
    """Written as JSON lines and read with the reader's own schema."""
    place = _place(spark, "json")
    df.write.json(place)
    return tables.read_table(spark, place, schema, "json")


@query("read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(spark, folder):
    return read_pages(spark, f"{folder}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("read_link_status", f"WITH {O.DOCS} SELECT origin || path AS url, CAST(CASE WHEN q = 0 THEN 404 WHEN x = 1 THEN 0 ELSE 200 END AS INT) AS status_code FROM d WHERE doc_id % 7 <> 3")
def _(spark, folder):
    return _as_json(R.link_status(spark, folder), spark, tables.LINK_STATUS)


def _sitemap_files(spark, folder):
    """An index and two files per site, and one broken file that no one lists."""
    d = R.documents(spark, folder).select("k", "doc_id", "origin", "path")
    site = F.substring("origin", 9, 1000)
    part = (F.col("doc_id") % 2).cast("string")
    entry = F.concat(F.lit("<url><loc> "), F.col("origin"), F.col("path"), F.lit("#x </loc></url>"))
    files = d.groupBy(site.alias("site"), "origin", part.alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    body = F.concat(F.lit("<urlset>"), F.col("body"), F.lit("</urlset>"))
    listed = files.select("site", F.concat("origin", F.lit("/s"), "part", F.lit(".xml")).alias("url"), body.alias("body"))
    broken = files.filter("part = '0'").select("site", F.concat("origin", F.lit("/never.xml")).alias("url"), F.lit("<urlset><url><loc>https://never.example/</loc></url><url>").alias("body"))
    index = d.select(site.alias("site"), "origin").distinct().select(
        "site", F.concat("origin", F.lit("/sitemap.xml")).alias("url"),
        F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), F.col("origin"), F.lit(f"/{n}.xml</loc></sitemap>")) for n in ("s0", "s1", "never", "sitemap")], F.lit("</sitemapindex>")).alias("body"),
    )
    rows = listed.unionByName(broken).unionByName(index)
    return rows.select("site", F.lit("sitemap").alias("kind"), "url", F.lit(200).alias("status_code"), F.lit("text/xml").alias("content_type"), "body")


@query("sitemap_files", f"WITH {O.DOCS} SELECT DISTINCT site, origin || path AS url FROM d")
def _(spark, folder):
    return sitemap.sitemap_urls(_as_json(_sitemap_files(spark, folder), spark, tables.SITE_RESOURCES))


@query(
    "sitemap_xml_files",
    f"""WITH {O.DOCS}, u AS (SELECT DISTINCT site, origin, path, rtrim(lower(path), '/') t FROM d WHERE q >= 0)
    SELECT site, origin || path AS loc, '2026-01-01' AS lastmod, {rule_case(C.SITEMAP_FREQUENCIES, 'daily', 'monthly')} AS changefreq, {rule_case(C.SITEMAP_PRIORITIES, '1.00', '0.50')} AS priority,
      CAST((row_number() OVER (PARTITION BY site ORDER BY origin || path) - 1) // 50 AS VARCHAR) AS part FROM u""",
)
def _(spark, folder):
    place = _place(spark, "xml")
    sinks.write_sitemaps(sitemap.xml_rows(R.sitemap_rows(spark, folder).distinct(), "2026-01-01"), place, 50)
    back = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, changefreq string, priority string, site string, part string").load(place)
    return back.select("site", "loc", "lastmod", "changefreq", "priority", "part")


@query(
    "sitemap_index_files",
    f"""WITH {O.DOCS}, u AS (SELECT site, count(DISTINCT path) AS n FROM d WHERE q >= 0 GROUP BY site)
    SELECT site, CAST(unnest(range(0, (n + 49) // 50)) AS VARCHAR) AS part FROM u""",
)
def _(spark, folder):
    place = _place(spark, "xml")
    sinks.write_sitemaps(sitemap.xml_rows(R.sitemap_rows(spark, folder).distinct(), "2026-01-01"), place, 50)
    index = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, site string").load(place)
    written = sinks.sitemap_folders(spark, place)
    named = index.filter("loc is not null").select("site", F.regexp_extract("loc", "part=([^/]*)/", 1).alias("part"), F.regexp_extract("loc", "[^/]*$", 0).alias("name"))
    return named.join(written, ["site", "part", "name"]).select("site", "part")


def _arrivals(spark, folder: str, run) -> str:
    """Feed the authored pages to a stream in many batches; gives the folder of its results."""
    place = _place(spark, "stream")
    pages = R.authored_pages(spark, folder).select("page_id", "url", "html")
    pages.repartition(10, "page_id").write.parquet(f"{place}/in")
    run(stream_pages(spark, f"{place}/in", files_per_trigger=1), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return f"{place}/out"


@query(
    "page_counters_stream",
    f"""WITH {O.LINKS}, s AS (SELECT site, src_url AS u FROM links UNION SELECT site, url FROM links WHERE internal)
    SELECT a.site, analyzed_pages, discovered_internal_pages FROM (SELECT site, count(*) AS analyzed_pages FROM d GROUP BY site) a
    JOIN (SELECT site, count(DISTINCT u) AS discovered_internal_pages FROM s GROUP BY site) f ON f.site = a.site""",
)
def _(spark, folder):
    return progress.page_counters(spark, _arrivals(spark, folder, progress.count_arrivals))


@query("site_coverage_stream", f"WITH {COVERAGE} {COVERAGE_ROWS}")
def _(spark, folder):
    return progress.site_coverage(spark, _arrivals(spark, folder, progress.audit_arrivals))


_REVIEWS = """rv0 AS (SELECT conv_id AS review_id, 'loc' || (conv_id % 7) AS location, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id)"""


@query(
    "review_documents",
    f"""WITH {_REVIEWS} SELECT location, CAST(review_id AS VARCHAR) AS review_id, ['UNKNOWN', 'ONE', 'TWO', 'THREE', 'FOUR', 'FIVE'][CAST(chars % 6 AS INT) + 1] AS star_rating, answers > 0 AND chars % 4 <> 0 AS has_reply FROM rv0""",
)
def _(spark, folder):
    r = R.reviews(spark, folder)
    reply = F.when(F.col("has_reply"), F.struct(F.lit("Thanks").alias("comment")))
    one = F.struct(F.col("review_id").cast("string").alias("reviewId"), F.col("star_rating").alias("starRating"), reply.alias("reviewReply"))
    documents = r.groupBy("location", (F.col("review_id") % 5).alias("page")).agg(F.collect_list(one).alias("reviews")).drop("page")
    return tables.reviews(_as_json(documents, spark, tables.REVIEWS)).select("location", "review_id", "star_rating", "has_reply")


@query("daily_series_documents", "SELECT 'loc' || user_id AS location, event_type AS metric, CAST(ts AS DATE) AS date, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS value FROM events")
def _(spark, folder):
    e = R.table(spark, folder, "events")
    day = F.struct(*[f(F.to_date("ts")).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))])
    value = F.struct(day.alias("date"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    per = e.groupBy("user_id", "event_type").agg(F.collect_list(value).alias("datedValues"))
    metric = F.struct(F.col("event_type").alias("dailyMetric"), F.struct("datedValues").alias("timeSeries"))
    documents = per.groupBy(F.concat(F.lit("loc"), F.col("user_id").cast("string")).alias("location")).agg(F.collect_list(metric).alias("multiDailyMetricTimeSeries"))
    return tables.daily_series(_as_json(documents, spark, tables.DAILY_SERIES))


@query(
    "keyword_documents",
    "SELECT 'loc' || (p_partkey % 97) AS location, CAST(row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_partkey) - 1 AS INT) AS pos, p_name AS query, CAST(p_size AS BIGINT) AS impressions, CAST(p_size % 50 AS INT) AS opportunity_score FROM part",
)
def _(spark, folder):
    p = R.table(spark, folder, "part")
    one = F.struct("p_partkey", F.col("p_name").alias("query"), F.col("p_size").cast("bigint").alias("impressions"), (F.col("p_size") % 50).cast("int").alias("opportunity_score"))
    per = p.groupBy(F.concat(F.lit("loc"), (F.col("p_partkey") % 97).cast("string")).alias("location")).agg(F.array_sort(F.collect_list(one)).alias("keywords"))
    return tables.search_keywords(_as_json(per, spark, tables.KEYWORDS)).select("location", "pos", "query", "impressions", "opportunity_score")


@query(
    "location_documents",
    """SELECT 'locations/' || s_suppkey AS name, s_name AS "locationName", CASE WHEN s_nationkey % 2 = 0 THEN 'Deep' WHEN s_nationkey % 5 <> 0 THEN 'Flat' END AS category, 'p' || s_suppkey AS phone, 'https://s' || s_suppkey AS "websiteUrl", CAST(s_nationkey AS VARCHAR) AS region FROM supplier""",
)
def _(spark, folder):
    c = F.col
    named = lambda test, text: F.when(test, F.struct(F.lit(text).alias("displayName")))
    documents = R.table(spark, folder, "supplier").select(
        F.concat(F.lit("locations/"), c("s_suppkey").cast("string")).alias("name"), c("s_name").alias("title"),
        named(c("s_nationkey") % 5 != 0, "Flat").alias("primaryCategory"), F.struct(named(c("s_nationkey") % 2 == 0, "Deep").alias("primaryCategory")).alias("categories"),
        F.struct(F.concat(F.lit("p"), c("s_suppkey").cast("string")).alias("primaryPhone")).alias("phoneNumbers"), F.concat(F.lit("https://s"), c("s_suppkey").cast("string")).alias("websiteUri"),
        F.struct(c("s_nationkey").cast("string").alias("regionCode")).alias("storefrontAddress"),
    )
    rows = tables.locations(_as_json(documents, spark, tables.PROFILES))
    return rows.select("name", "locationName", c("primaryCategory.displayName").alias("category"), c("phoneNumbers.primaryPhone").alias("phone"), "websiteUrl", c("address.regionCode").alias("region"))


@query("snapshot_files", "SELECT o_custkey AS project_id, o_orderkey AS run_id, CAST(floor(o_totalprice / 5000) AS INT) AS seo_score FROM orders")
def _(spark, folder):
    place = _place(spark, "snapshots")
    runs = R.runs(spark, folder).select("project_id", "run_id", "seo_score")
    for part in (0, 1):
        sinks.append_snapshot(runs.filter(F.col("run_id") % 2 == part), place)
    return spark.read.schema(runs.schema).parquet(place)


@query("event_line_files", """SELECT '{"job_id":' || user_id || ',"event_id":' || event_id || ',"type":"' || event_type || '"}' AS value FROM events""")
def _(spark, folder):
    place = _place(spark, "lines")
    sinks.write_event_lines(R.jobs(spark, folder).select("job_id", "event_id", "type"), place)
    return spark.read.text(place)


@query(
    "store_round_trip",
    """WITH i AS (SELECT o_custkey AS c, CAST(floor(o_totalprice / 5000) AS INT) AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    s AS (SELECT c_custkey AS c FROM customer WHERE c_acctbal > 0),
    a AS (SELECT coalesce(s.c, i.c) AS c, CASE WHEN i.c IS NULL THEN 'old' ELSE 'new' END AS state, coalesce(i.s, 0) AS score FROM s FULL JOIN i ON i.c = s.c),
    k AS (SELECT sha256('https://c' || c) AS project_id, state, score FROM a WHERE c % 3 <> 0)
    SELECT t AS name, project_id, CASE WHEN t = 'projects' THEN CAST(score AS VARCHAR) ELSE state END AS state FROM k, (VALUES ('projects'), ('audit_results'), ('ai_insights'), ('seo_data'), ('crawl_data')) v(t)""",
)
def _(spark, folder):
    kept = AuditStore(spark, _place(spark, "store"))

    def audits(df, state: str):
        texts = [F.lit(state).alias(n) for n in ("findings", "executive_summary", "keyword_analysis", "pages")]
        return df.select(F.concat(F.lit(" HTTPS://C"), F.col("project_id").cast("string"), F.lit("/ ")).alias("url"), "business_type", "seo_score", "updated_at", *texts)

    customers = R.table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("business_type"), F.lit(0).alias("seo_score"), F.lit("2020-01-01").cast("timestamp").alias("updated_at")
    )
    kept.upsert(audits(customers, "old"))
    kept.upsert(audits(store.latest_runs(R.runs(spark, folder), "project_id", ["updated_at", "run_id"]), "new"))
    ids = kept.tables()["projects"]
    kept.delete(ids.filter(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint") % 3 == 0))
    state = {"projects": F.col("seo_score").cast("string"), "audit_results": "findings", "ai_insights": "executive_summary", "seo_data": "keyword_analysis", "crawl_data": "pages"}
    parts = [t.select(F.lit(n).alias("name"), "project_id", (state[n] if n == "projects" else F.col(state[n])).alias("state")) for n, t in kept.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "stored_audit_tables",
    """WITH i AS (SELECT o_custkey AS c, CAST(floor(o_totalprice / 5000) AS INT) AS s, o_orderpriority AS b FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT sha256('https://c' || c) AS project_id, 'https://c' || c AS url, b AS business_type, s AS seo_score, NULL::VARCHAR AS report_url, 'f' || s AS findings, 's' || s AS executive_summary, NULL::VARCHAR AS insights, 'k' || s AS keyword_analysis, 'p' || s AS pages FROM i""",
)
def _(spark, folder):
    place = _place(spark, "tables")
    last = store.latest_runs(R.runs(spark, folder), "project_id", ["updated_at", "run_id"])
    texts = {c: F.concat(F.lit(x), F.col("seo_score").cast("string")) for c, x in (("findings", "f"), ("executive_summary", "s"), ("keyword_analysis", "k"), ("pages", "p"))}
    audits = last.withColumns({"url": F.concat(F.lit("https://c"), F.col("project_id").cast("string")), **texts}).drop("project_id", "run_id")
    sinks.write_tables(store.split_audit(audits), place)
    back = tables.stored_tables(spark, place)
    out = back["projects"].select("project_id", "url", "business_type", "seo_score", "report_url")
    for name, columns in (("audit_results", ["findings"]), ("ai_insights", ["executive_summary", "insights"]), ("seo_data", ["keyword_analysis"]), ("crawl_data", ["pages"])):
        out = out.join(back[name].select("project_id", *columns), "project_id", "left")
    return out


@query("ordered_projects", "SELECT o_orderkey AS project_id, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def _(spark, folder):
    o = R.table(spark, folder, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return store.newest_first(o).select("project_id", "place")


@query(
    "trailing_daily_values",
    """SELECT 'loc' || user_id AS location, event_type AS metric, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(28, 4))) AS DOUBLE) AS value FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-20' - 10 AND DATE '2024-01-20' GROUP BY ALL""",
)
def _(spark, folder):
    rows = local.trailing(R.daily(spark, folder), "2024-01-20", 10)
    return rows.groupBy("location", "metric", "date").agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"))
