"""Queries on local business data, stored audits, vectors and job events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import oracle as O
from checks import recipes as R
from checks.registry import query
from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.operators import extract, local, page_health, search, store
from pagewarden.operators.ranking import first_by
from pagewarden.operators.rows import unnest
from pagewarden.streaming import progress

# --- reviews and metrics ------------------------------------------------------------
_REVIEWS = """
rv0 AS (SELECT conv_id AS review_id, 'loc' || (conv_id % 7) AS location, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id),
rv AS MATERIALIZED (SELECT review_id, location, chars % 6 AS n, answers > 0 AND chars % 4 <> 0 AS has_reply FROM rv0),
rs AS (SELECT location, count(*) AS total_reviews, sum(n) AS st, count(*) FILTER (WHERE has_reply) AS rep, count(*) FILTER (WHERE n >= 4) AS positive, count(*) FILTER (WHERE n = 3) AS neutral,
  count(*) FILTER (WHERE n < 3) AS negative FROM rv GROUP BY location)"""


@query(
    "review_summary",
    f"""WITH {_REVIEWS} SELECT location, total_reviews, {O.rnd('st::DOUBLE / total_reviews')} AS average_rating, {O.pct('rep', 'total_reviews')} AS response_rate,
      total_reviews - rep AS unreplied_count, positive, neutral, negative FROM rs""",
)
def _(spark, folder):
    return local.review_summary(R.reviews(spark, folder), "location")


@query("urgent_reviews", f"WITH {_REVIEWS} SELECT review_id, location FROM rv WHERE n <= 2 AND NOT has_reply")
def _(spark, folder):
    return local.urgent_reviews(R.reviews(spark, folder)).select("review_id", "location")


@query(
    "daily_metric_totals",
    """SELECT 'loc' || user_id AS location, """
    + ", ".join(
        f"CAST(coalesce(sum(CAST(value AS DECIMAL(28,4))) FILTER (WHERE event_type = '{m}'), 0) AS DOUBLE) AS {m}_total"
        for m in ("view", "click", "error", "signup", "purchase")
    )
    + " FROM events GROUP BY user_id",
)
def _(spark, folder):
    names = {m: f"{m}_total" for m in ("view", "click", "error", "signup", "purchase")}
    return local.daily_totals(R.daily(spark, folder), "location", names)


@query(
    "trailing_daily_metrics",
    """SELECT 'loc' || user_id AS location, event_type AS metric, CAST(ts AS DATE) AS date, count(*) AS n FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-20' - 10 AND DATE '2024-01-20' GROUP BY ALL""",
)
def _(spark, folder):
    rows = local.trailing(R.daily(spark, folder), "2024-01-20", 10)
    return rows.groupBy("location", "metric", "date").agg(F.count(F.lit(1)).alias("n"))


_PROFILE = f"""
pr AS (SELECT 'loc' || s_suppkey AS location, s_suppkey, s_nationkey % 5 <> 0 AS cat, s_nationkey % 3 = 0 AS more, s_acctbal > 3000 AS phone, s_acctbal > 0 AS hours, s_nationkey % 2 = 0 AS about, s_nationkey % 4 <> 0 AS web FROM supplier),
pa0 AS (SELECT *, about::INT * 25 + hours::INT * 25 + phone::INT * 25 + web::INT * 25 AS comp, cat::INT * 50 + more::INT * 50 AS cats FROM pr),
pa AS MATERIALIZED (SELECT *, {O.rnd('(comp + cats + 60)::DOUBLE / 3')} AS overall FROM pa0)"""


@query(
    "profile_audit",
    f"""WITH {_PROFILE} SELECT location, comp AS completeness_score, cats AS category_optimization_score, 60 AS media_engagement_score, overall AS overall_gbp_score,
      array_to_string(list_filter([CASE WHEN NOT about THEN 'Missing Business Description' END, CASE WHEN NOT hours THEN 'Missing Business Hours' END, CASE WHEN NOT more THEN 'No Secondary Categories' END], lambda z: z IS NOT NULL), '|') AS issues FROM pa""",
)
def _(spark, folder):
    rows = local.profile_audit(R.profiles(spark, folder), "location")
    return rows.drop("website_url").withColumn("issues", F.array_join(F.transform("issues", lambda i: i["issue"]), "|"))


_LOCAL_PAGE = f"""
lp0 AS (SELECT doc_id, lang = 'en' AND q = 1 AS sch, regexp_matches(text, '{C.PHONE_PATTERN}') AS ph, contains(lower(text), 'the') AS city,
  len(list_filter([path, {O.path_of('k * k + j // 2')}], lambda z: regexp_matches(lower(z), 'contact|location|about'))) AS n FROM d),
lp AS MATERIALIZED (SELECT doc_id, ph::INT * 50 + city::INT * 50 AS nap, sch::INT * 100 AS sch, (n > 0)::INT * 100 AS con, n FROM lp0),
lpa AS MATERIALIZED (SELECT *, {O.rnd('nap * 0.4::DOUBLE + sch * 0.4::DOUBLE + con * 0.2::DOUBLE')} AS score FROM lp)"""


def _local_pages(spark, folder):
    d = R.documents(spark, folder)
    parent = R._path(F.col("k") * F.col("k") + F.floor(F.col("j") / 2))
    types = F.when((F.col("lang") == "en") & (F.col("q") == 1), F.array(F.lit("LocalBusiness"))).otherwise(F.array(F.lit("Article")))
    return d.select(
        "doc_id", "text", F.lit("THE").alias("city"), types.alias("structured_data_types"), F.array("path", parent).alias("hrefs")
    )


@query(
    "local_page_audit",
    f"""WITH {O.DOCS},{_LOCAL_PAGE} SELECT doc_id, nap AS nap_score, sch AS schema_score, con AS location_page_score, score AS local_seo_score, CAST(n AS INT) AS location_pages_found,
      CAST((sch = 0)::INT + (nap < 100)::INT AS INT) AS issues FROM lpa""",
)
def _(spark, folder):
    rows = local.local_page_audit(_local_pages(spark, folder), "doc_id")
    return rows.select(
        "doc_id", "nap_score", "schema_score", "location_page_score", "local_seo_score", "location_pages_found", F.size("issues").alias("issues")
    )


@query(
    "profile_consistency",
    """SELECT s_suppkey, 100::DOUBLE - CASE WHEN s_acctbal > 3000 AND s_nationkey % 2 = 0 THEN 30 ELSE 0 END - CASE WHEN s_nationkey % 4 <> 0 AND s_nationkey % 3 = 0 THEN 40 ELSE 0 END AS consistency_score FROM supplier""",
)
def _(spark, folder):
    p = R.profiles(spark, folder).select("s_suppkey", "s_nationkey", F.col("phoneNumbers.primaryPhone").alias("phone"), F.col("websiteUri").alias("website_url"))
    shown = F.concat(F.lit("555.010."), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"))
    audits = p.select(
        "s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("111-222-3333"))).otherwise(F.array(shown)).alias("phones_found"),
        F.when(F.col("s_nationkey") % 3 == 0, "http://other.example.com").otherwise(
            F.concat(F.lit("http://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com/home"))
        ).alias("website"),
    )
    return local.consistency(p.drop("s_nationkey"), audits, "s_suppkey")


@query(
    "combined_health",
    f"""SELECT l_orderkey, l_linenumber, {O.rnd('l_quantity * 0.3::DOUBLE + (l_discount * 1000) * 0.3::DOUBLE + (l_tax * 1000) * 0.25::DOUBLE + l_linenumber::DOUBLE * 0.15::DOUBLE')} AS score FROM lineitem""",
)
def _(spark, folder):
    return R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        local.combined_health(F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_tax") * 1000, F.col("l_linenumber").cast("double")).alias("score"),
    )


def _keywords(spark, folder):
    p = R.table(spark, folder, "part")
    return p.select(
        F.concat(F.lit("loc"), (F.col("p_partkey") % 7).cast("string")).alias("location"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("query"),
        F.col("p_size").alias("impressions"), F.col("p_size").alias("opportunity_score"),
    )


@query(
    "top_keywords",
    """SELECT 'loc' || (p_partkey % 7) AS location, p_name AS query, p_size AS opportunity_score FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_size DESC, p_partkey) = 1""",
)
def _(spark, folder):
    return local.top_keywords(_keywords(spark, folder), "location").drop("impressions")


@query(
    "local_recommendations",
    f"""WITH {_REVIEWS},{_PROFILE}, rr AS (SELECT location, {O.pct('rep', 'total_reviews')} AS rate, total_reviews - rep AS un FROM rs)
    SELECT location, 1 AS source_pos, 'High' AS priority, 'Missing Business Description' AS title, 'High' AS expected_impact FROM pa WHERE NOT about
    UNION ALL SELECT location, 1, 'High', 'Missing Business Hours', 'High' FROM pa WHERE NOT hours
    UNION ALL SELECT location, 1, 'Medium', 'No Secondary Categories', 'Medium' FROM pa WHERE NOT more
    UNION ALL SELECT location, 2, 'High', 'Low Review Response Rate', 'High' FROM rr WHERE rate < 80 AND un > 0
    UNION ALL SELECT location, 3, 'Critical', 'Missing LocalBusiness Schema', 'High' FROM pa WHERE NOT web
    UNION ALL SELECT * FROM (SELECT 'loc' || (p_partkey % 7), 4, 'Medium', 'Target Keyword: ' || p_name, 'High' FROM part
      QUALIFY row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_size DESC, p_partkey) = 1)""",
)
def _(spark, folder):
    audits = local.profile_audit(R.profiles(spark, folder), "location")
    pages = R.profiles(spark, folder).select("location", F.when(F.col("websiteUri").isNotNull(), 100).otherwise(0).alias("schema_score"))
    reviews = local.review_summary(R.reviews(spark, folder), "location")
    rows = local.recommendations(audits, reviews, pages, _keywords(spark, folder), "location")
    return rows.drop("category", "effort")


@query(
    "dashboard",
    f"""WITH {_REVIEWS},{_PROFILE}, rr AS (SELECT location, {O.pct('rep', 'total_reviews')} AS rate FROM rs),
    j AS (SELECT coalesce(pa.location, rr.location) AS location, CASE WHEN pa.location IS NULL THEN 0 WHEN web THEN 80 ELSE 20 END::DOUBLE AS w, coalesce(overall, 0)::DOUBLE AS g, coalesce(rate, 0)::DOUBLE AS r FROM pa FULL JOIN rr ON rr.location = pa.location)
    SELECT location, w AS website_score, g AS gbp_score, r AS review_score, {O.rnd('w * 0.3::DOUBLE + g * 0.3::DOUBLE + r * 0.25::DOUBLE + 100::DOUBLE * 0.15::DOUBLE')} AS combined_score FROM j""",
)
def _(spark, folder):
    pages = R.profiles(spark, folder).select("location", F.when(F.col("websiteUri").isNotNull(), 80).otherwise(20).alias("local_seo_score"))
    return local.dashboard(pages, local.profile_audit(R.profiles(spark, folder), "location"), local.review_summary(R.reviews(spark, folder), "location"), "location")


@query(
    "competitor_signals",
    f"""WITH {O.DOCS}, s AS (SELECT k, doc_id, title, CASE lang WHEN 'es' THEN '' ELSE s1 END AS h1, lang = 'en' AND q = 1 AS loc, contains(lower(text), 'the') AS city, doc_id = k * k AS own, description FROM d)
    SELECT o.k, o.title AS own_title_tag, o.h1 AS own_h1, o.city AS own_city_mentioned, c.title AS competitor_title_tag, c.description AS competitor_meta_description, c.loc AS competitor_has_local_schema
    FROM s o LEFT JOIN s c ON c.k = o.k AND NOT c.own WHERE o.own""",
)
def _(spark, folder):
    pages = R.authored_pages(spark, folder).withColumn("k", F.floor(F.sqrt(F.col("page_id").cast("double")))).withColumn("city", F.lit("The"))
    f = extract.page_features(pages, ["k", "city", "text", "is_home"])
    signals = local.competitor_signals(f.withColumn("role", F.when(F.col("is_home"), "own").otherwise("competitor")), ["k", "role"])
    both = local.side_by_side(signals, "k")
    return both.select("k", "own_title_tag", "own_h1", "own_city_mentioned", "competitor_title_tag", "competitor_meta_description", "competitor_has_local_schema")


# --- stored audits -----------------------------------------------------------------------
_LATEST = "lr AS MATERIALIZED (SELECT o_custkey AS project_id, o_orderkey AS run_id, CAST(floor(o_totalprice / 5000) AS INT) AS seo_score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"


@query("latest_runs", f"WITH {_LATEST} SELECT project_id, run_id, seo_score FROM lr")
def _(spark, folder):
    return store.latest_runs(R.runs(spark, folder), "project_id", ["updated_at", "run_id"]).select("project_id", "run_id", "seo_score")


@query(
    "snapshot_history",
    """SELECT o_custkey AS project_id, o_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS rank FROM orders QUALIFY rank <= 12""",
)
def _(spark, folder):
    runs = R.runs(spark, folder).withColumn("order", F.struct("updated_at", "run_id"))
    return store.snapshots(runs, ["project_id"], order="order").select("project_id", "run_id", "rank")


def _stored_and_incoming(spark, folder):
    """Customers with a balance are stored; those with orders come in."""
    stored = R.table(spark, folder, "customer").filter(F.col("c_acctbal") > 0).select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project_id"), F.concat(F.lit("https://c"), F.col("c_custkey").cast("string")).alias("url"),
        F.lit(0).alias("seo_score"), F.col("c_mktsegment").alias("business_type"), F.lit("2020-01-01").cast("timestamp").alias("created_at"),
        F.lit("2020-01-01").cast("timestamp").alias("updated_at"),
    )
    last = store.latest_runs(R.runs(spark, folder), "project_id", ["updated_at", "run_id"])
    incoming = last.select(
        F.concat(F.lit("n"), F.col("project_id").cast("string")).alias("project_id"), F.concat(F.lit("https://c"), F.col("project_id").cast("string")).alias("url"),
        "seo_score", "business_type", "updated_at",
    )
    return stored, incoming


@query(
    "upsert_projects",
    """WITH i AS (SELECT o_custkey AS c, CAST(floor(o_totalprice / 5000) AS INT) AS s, o_orderpriority AS b, o_orderdate AS u FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    s AS (SELECT c_custkey AS c, c_mktsegment AS b FROM customer WHERE c_acctbal > 0)
    SELECT CASE WHEN s.c IS NOT NULL THEN 'p' || s.c ELSE 'n' || i.c END AS project_id, 'https://c' || coalesce(s.c, i.c) AS url, CASE WHEN i.c IS NULL THEN 0 ELSE i.s END AS seo_score,
      CASE WHEN i.c IS NULL THEN s.b ELSE i.b END AS business_type, CASE WHEN s.c IS NULL THEN i.u ELSE TIMESTAMP '2020-01-01' END AS created_at, coalesce(i.u, TIMESTAMP '2020-01-01') AS updated_at
    FROM s FULL JOIN i ON i.c = s.c""",
)
def _(spark, folder):
    return store.upsert_projects(*_stored_and_incoming(spark, folder))


@query(
    "replace_children",
    """WITH i AS (SELECT DISTINCT o_custkey AS c FROM orders) SELECT c_custkey AS project_id, CASE WHEN i.c IS NULL THEN 'old' ELSE 'new' END AS state FROM customer LEFT JOIN i ON i.c = c_custkey
    UNION ALL SELECT i.c, 'new' FROM i WHERE i.c NOT IN (SELECT c_custkey FROM customer)""",
)
def _(spark, folder):
    old = R.table(spark, folder, "customer").select(F.col("c_custkey").alias("project_id"), F.lit("old").alias("state"))
    new = R.runs(spark, folder).select("project_id").distinct().withColumn("state", F.lit("new"))
    return store.replace_children(old, new)


@query(
    "delete_projects",
    """SELECT 'orders' AS name, o_custkey AS project_id, o_orderkey AS row_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def _(spark, folder):
    customers = R.table(spark, folder, "customer").withColumnRenamed("c_custkey", "project_id")
    gone = customers.filter(F.col("c_mktsegment") == "BUILDING")
    left = store.delete_projects({"orders": R.runs(spark, folder), "customer": customers}, gone)
    rows = lambda name, row: left[name].select(F.lit(name).alias("name"), "project_id", F.col(row).cast("bigint").alias("row_id"))
    return rows("orders", "run_id").unionByName(rows("customer", "c_nationkey"))


def _audits(spark, folder):
    """Audit per customer from its orders: health from the status, labels from the priorities."""
    o = R.table(spark, folder, "orders")
    label = F.when(F.col("o_orderpriority").startswith("1"), "Critical Gap").when(F.col("o_orderpriority").startswith("2"), "Needs Improvement").when(
        F.col("o_orderpriority").startswith("3"), "Good").otherwise("Moderate")
    return o.groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.when(F.count_if(F.col("o_orderstatus") == "F") > 5, F.concat(F.count_if(F.col("o_orderstatus") == "F").cast("string"), F.lit("%"))).otherwise("n/a").alias("overall_seo_health"),
        F.collect_list(label).alias("statuses"), F.count_if(F.col("o_totalprice") > 100000).cast("int").alias("findings_count"),
    )


_AUDITS = f"""au AS MATERIALIZED (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS INT) AS fc,
  CAST(sum(CASE o_orderpriority[1] WHEN '1' THEN 25 WHEN '2' THEN 60 WHEN '3' THEN 100 ELSE 60 END) AS BIGINT) AS pts FROM orders GROUP BY o_custkey)"""


@query("status_label_score", f"WITH {_AUDITS} SELECT c AS project_id, CAST({O.rint('pts::DOUBLE / n')} AS INT) AS score FROM au")
def _(spark, folder):
    return _audits(spark, folder).select("project_id", store.score_from_statuses(F.col("statuses")).alias("score"))


@query(
    "project_list",
    f"""WITH {_AUDITS} SELECT c_custkey AS project_id, CAST(c_nationkey AS INT) AS nation,
      CASE WHEN c_nationkey % 2 = 1 THEN c_nationkey WHEN au.c IS NULL THEN 0 WHEN f > 5 THEN f ELSE {O.rint('pts::DOUBLE / n')} END::INT AS seo_score,
      coalesce(fc, 0) AS findings_count, CAST(coalesce(n, 0) AS INT) AS metrics_count, CASE WHEN c_acctbal > 0 THEN c_custkey ELSE 0 END AS pages_analyzed, CASE WHEN c_acctbal > 0 THEN 'Found' ELSE '—' END AS robots_status,
      CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS pages_discovered, '—' AS sitemap_status
    FROM customer LEFT JOIN au ON au.c = c_custkey""",
)
def _(spark, folder):
    c = F.col
    customers = R.table(spark, folder, "customer")
    projects = customers.select(c("c_custkey").alias("project_id"), c("c_nationkey").alias("nation"), (c("c_nationkey") * (c("c_nationkey") % 2)).alias("seo_score"))
    crawls = customers.filter(c("c_acctbal") > 0).select(
        c("c_custkey").alias("project_id"), c("c_custkey").alias("pages_analyzed"), F.lit(1).alias("pages_discovered"), F.lit("Found").alias("robots_status"), F.lit("").alias("sitemap_status")
    )
    return store.project_list(projects, _audits(spark, folder), crawls)


@query(
    "rebuild_audits",
    f"""WITH {_AUDITS} SELECT c_custkey AS project_id, coalesce(au.f, c_nationkey) || '%' AS overall_seo_health, c_nationkey || '%' AS seo_health, 'completed' AS status,
      coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') AS executive_summary, CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE 'none' END AS keyword_analysis,
      CASE WHEN c_custkey % 4 <> 1 THEN 'p' || c_name END AS pages, CAST(CASE WHEN c_custkey % 4 <> 1 THEN c_nationkey ELSE 0 END AS BIGINT) AS page_speed FROM customer LEFT JOIN au ON au.c = c_custkey""",
)
def _(spark, folder):
    c = F.col
    customers = R.table(spark, folder, "customer").withColumnRenamed("c_custkey", "project_id")
    orders = R.table(spark, folder, "orders")
    tables = {
        "projects": customers.select("project_id", c("c_nationkey").alias("seo_score")),
        "audit_results": orders.groupBy(c("o_custkey").alias("project_id")).agg(F.count_if(c("o_orderstatus") == "F").alias("overall_seo_health")),
        "ai_insights": customers.filter(c("c_acctbal") > 0).select("project_id", c("c_mktsegment").alias("executive_summary")),
        "seo_data": customers.filter(c("c_nationkey") % 3 == 0).select("project_id", c("c_name").alias("keyword_analysis")),
        "crawl_data": customers.filter(c("project_id") % 4 != 1).select("project_id", F.concat(F.lit("p"), c("c_name")).alias("pages"), c("c_nationkey").cast("bigint").alias("page_speed")),
    }
    out = store.rebuild(tables, {"executive_summary": F.lit(""), "keyword_analysis": F.lit("none"), "page_speed": F.lit(0)})
    return out.select("project_id", "overall_seo_health", "seo_health", "status", "executive_summary", "keyword_analysis", "pages", "page_speed")


@query(
    "split_audits",
    f"""WITH {_LATEST} SELECT 'https://c' || project_id AS url, sha256('https://c' || project_id) AS project_id, seo_score, unnest(['audit_results', 'ai_insights', 'seo_data', 'crawl_data']) AS child,
      unnest(['f' || seo_score, 's' || seo_score, 'k' || seo_score, 'p' || seo_score]) AS state FROM lr""",
)
def _(spark, folder):
    last = store.latest_runs(R.runs(spark, folder), "project_id", ["updated_at", "run_id"])
    state = {"audit_results": "findings", "ai_insights": "executive_summary", "seo_data": "keyword_analysis", "crawl_data": "pages"}
    letters = {"findings": "f", "executive_summary": "s", "keyword_analysis": "k", "pages": "p"}
    audits = last.withColumns({"url": F.concat(F.lit(" HTTPS://C"), F.col("project_id").cast("string"), F.lit("/ ")), **{c: F.concat(F.lit(x), F.col("seo_score").cast("string")) for c, x in letters.items()}})
    tables = store.split_audit(audits.drop("project_id"))
    kids = [tables[n].select("project_id", F.lit(n).alias("child"), F.col(c).alias("state")) for n, c in state.items()]
    return tables["projects"].select("project_id", "url", "seo_score").join(reduce(DataFrame.unionByName, kids), "project_id", "left")


@query(
    "stored_page_issues",
    f"""WITH {O.FEATURES}, s AS (SELECT *, CASE WHEN q = 1 THEN title ELSE coalesce(nullif(title, ''), 'N/A') END AS t, coalesce(nullif(description, ''), 'Not Found') AS m FROM features),
    i AS (SELECT page_id, unnest(list_filter([CASE WHEN t IN ('', 'N/A') THEN 'High:Missing Page Title' WHEN length(t) < 15 THEN 'Medium:Title Too Short' WHEN length(t) > 60 THEN 'Low:Title Too Long' END,
      CASE WHEN m = 'Not Found' THEN 'High:Missing Meta Description' WHEN length(m) < 50 THEN 'Medium:Meta Description Too Short' WHEN length(m) > 160 THEN 'Low:Meta Description Too Long' END,
      CASE WHEN h1_count = 0 THEN 'High:Missing H1 Tag' WHEN h1_count > 1 THEN 'Medium:Multiple H1 Tags (' || h1_count || ')' END,
      CASE WHEN word_count < 100 THEN 'Medium:Low Word Count (' || word_count || ' words)' END, CASE WHEN NOT is_indexable THEN 'High:Page is Blocked from Indexing' END,
      CASE WHEN missing_alt_count > 0 THEN 'Medium:Missing alt tags on ' || missing_alt_count || ' images' END], lambda z: z IS NOT NULL)) AS v FROM s)
    SELECT page_id, split_part(v, ':', 1) AS severity, substr(v, strpos(v, ':') + 1) AS title FROM i""",
)
def _(spark, folder):
    c = F.col
    rows = page_health.page_summary(R.features(spark, folder))
    pages = rows.select(
        "page_id", "url", c("title"), c("description"), F.lit(None).cast("int").alias("title_length"), F.lit(None).cast("int").alias("meta_description_length"),
        F.when(c("h1_count") == 1, c("word_count")).alias("word_count"), F.lit(None).cast("boolean").alias("is_indexable"), c("canonical_url"),
        F.lit(None).cast("string").alias("seo_health"), c("seo_score"),
        F.struct(
            *[F.lit(None).cast("array<string>").alias(f"h{n}") for n in range(1, 7)], c("h1_count"),
            *[F.lit(None).cast("int").alias(f"h{n}_count") for n in range(2, 7)],
        ).alias("headings"),
        F.struct(
            F.coalesce(F.nullif(c("title"), F.lit("")), F.lit("N/A")).alias("title"), F.coalesce(F.nullif(c("description"), F.lit("")), F.lit("Not Found")).alias("meta_description"),
            c("canonical_url").alias("canonical"), F.when(c("is_indexable"), "Indexable").otherwise("Noindex").alias("indexing_status"),
        ).alias("page_info"),
        F.struct(c("word_count")).alias("content"), F.lit(True).alias("has_technical_seo"),
        F.filter(F.concat("issues.critical", "issues.high", "issues.medium", "issues.low"), lambda s: ~s.contains("load performance")).alias("issues"),
    )
    flat = store.flat_pages(pages.withColumn("url", F.col("page_id").cast("string")))
    return unnest(flat, "issues", "i", ["url"]).select(F.col("url").cast("bigint").alias("page_id"), "i.severity", "i.title")


# --- vectors -----------------------------------------------------------------------------
_NEAREST = """WITH q AS (SELECT label, vec_id AS query_id, embedding AS qe FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
m AS (SELECT e.label, query_id, e.vec_id, {0} AS dist FROM embeddings e JOIN q ON q.label = e.label)
SELECT label, query_id, vec_id, CAST(row_number() OVER (PARTITION BY label, query_id ORDER BY dist, vec_id) AS INT) AS rank FROM m QUALIFY rank <= 5"""


def _vector_queries(spark, folder):
    return first_by(R.table(spark, folder, "embeddings"), ["label"], ["vec_id"], ["vec_id", "embedding"]).select(
        "label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")
    )


@query("nearest_vectors_l2", _NEAREST.format("list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def _(spark, folder):
    return search.nearest(R.table(spark, folder, "embeddings"), _vector_queries(spark, folder), ["label"]).drop("distance")


@query("nearest_vectors_cosine", _NEAREST.format("list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(qe AS DOUBLE[]))"))
def _(spark, folder):
    return search.nearest(
        R.table(spark, folder, "embeddings"), _vector_queries(spark, folder), ["label"], metric="cosine"
    ).drop("distance")


# --- job events ----------------------------------------------------------------------------
@query(
    "recent_job_events",
    """SELECT user_id AS job_id, event_id, event_type AS type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events QUALIFY rank <= 50""",
)
def _(spark, folder):
    return progress.recent(R.jobs(spark, folder)).select("job_id", "event_id", "type", "rank")


@query("latest_job_event", "SELECT user_id AS job_id, event_id, event_type AS type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, folder):
    return progress.latest(R.jobs(spark, folder)).select("job_id", "event_id", "type")


_JOB_SQL = """WITH e AS (SELECT user_id AS job_id, count(*) AS events, min(ts) FILTER (WHERE event_type = 'view') AS started_at, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) AS how,
  max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS finished_at FROM events GROUP BY user_id)
SELECT job_id, events, started_at, finished_at, CASE WHEN how = 'purchase' THEN 'completed' WHEN how = 'error' THEN 'failed' WHEN started_at IS NOT NULL THEN 'running' ELSE 'queued' END AS status FROM e"""


@query("job_status", _JOB_SQL)
def _(spark, folder):
    return progress.job_status(R.jobs(spark, folder), "view", "purchase", "error").drop("created_at")


@query(
    "job_elapsed",
    f"""WITH s AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id)
    SELECT event_id, {O.rnd('(epoch_us(ts) - epoch_us(t0)) / 1e6', 2)} AS elapsed_seconds FROM events JOIN s ON s.user_id = events.user_id""",
)
def _(spark, folder):
    jobs = R.jobs(spark, folder)
    starts = jobs.groupBy("job_id").agg(F.min("ts").alias("started_at"))
    return progress.elapsed(jobs, starts).select("event_id", "elapsed_seconds")


@query("event_json_lines", """SELECT event_id, '{"job_id":' || user_id || ',"type":"' || event_type || '"}' AS value FROM events""")
def _(spark, folder):
    return R.jobs(spark, folder).select("event_id", F.to_json(F.struct("job_id", "type")).alias("value"))
