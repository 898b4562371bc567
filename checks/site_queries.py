"""Queries on sites: coverage, scores, link graph, sitemaps, comparison, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import oracle as O
from checks import recipes as R
from checks.page_queries import CHECKLIST
from checks.registry import query
from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.operators import compare, extract, findings, links, page_health, profile, report, site, sitemap
from pagewarden.operators.ranking import top_k
from pagewarden.session import checkpoint_folder
from pagewarden.sources import sinks

# --- coverage and scores ----------------------------------------------------------
_MATCHED = {
    "title_coverage": "title_length BETWEEN 50 AND 60", "meta_description_coverage": "meta_description_length BETWEEN 140 AND 160",
    "unique_title_coverage": "title <> '' AND same_title = 1", "h1_compliance": "h1_count = 1",
    "substantive_content_coverage": "word_count >= 300", "canonical_coverage": "has_canonical", "indexability_coverage": "is_indexable",
}
COVERAGE = (
    O.FEATURES
    + ", ft AS (SELECT *, count(*) OVER (PARTITION BY site, title) AS same_title FROM features), c0 AS ("
    + " UNION ALL ".join(
        f"SELECT site, {i} AS metric_pos, '{key}' AS metric_key, '{name}' AS metric, '{cat}' AS category, {minimum} AS lowest, "
        f"count(*) FILTER (WHERE {_MATCHED[key]}) AS matched, count(*) AS total FROM ft GROUP BY site"
        for i, (key, name, cat, minimum) in enumerate(C.SITE_METRICS, 1)
    )
    + f"""), c1 AS (SELECT *, {O.pct('matched', 'total')} AS percentage FROM c0),
c2 AS (SELECT *, CASE WHEN percentage >= lowest THEN 100::DOUBLE ELSE (percentage / lowest) * 100 END AS att FROM c1),
coverage AS MATERIALIZED (SELECT *, CASE WHEN metric_pos <= 2 AND percentage < 50 THEN greatest(0, att - 20) ELSE att END::DOUBLE AS score FROM c2)"""
)
COVERAGE_ROWS = f"SELECT site, metric_pos, metric_key, metric, category, matched, total, percentage, score, {O.status('score')} AS status, {O.prio('score')} AS priority FROM coverage"


@query("site_coverage", f"WITH {COVERAGE} {COVERAGE_ROWS}")
def _(spark, folder):
    return site.coverage(R.features(spark, folder))


@query(
    "site_optional_coverage",
    f"""WITH {O.FEATURES}, fm AS (SELECT *, count(*) OVER (PARTITION BY site, description) AS same FROM features),
    o AS (SELECT site, 'structured_data_coverage' AS metric_key, count(*) FILTER (WHERE has_structured_data) m, count(*) t, 50 lowest FROM fm GROUP BY site
      UNION ALL SELECT site, 'social_metadata_coverage', count(*) FILTER (WHERE has_open_graph OR has_twitter_card), count(*), 80 FROM fm GROUP BY site
      UNION ALL SELECT site, 'unique_meta_coverage', count(*) FILTER (WHERE description <> '' AND same = 1), count(*), 100 FROM fm GROUP BY site
      UNION ALL SELECT site, 'alt_text_coverage', CAST(sum(total_images - missing_alt_count) AS BIGINT), CAST(sum(total_images) AS BIGINT), 95 FROM fm GROUP BY site)
    SELECT site, metric_key, m AS matched, t AS total, {O.pct('m', 't')} AS percentage FROM o""",
)
def _(spark, folder):
    return site.optional_coverage(R.stored_features(spark, folder)).select("site", "metric_key", "matched", "total", "percentage")


BROKEN = """
st AS MATERIALIZED (SELECT origin || path AS url, CASE WHEN q = 0 THEN 404 WHEN x = 1 THEN 0 ELSE 200 END AS status_code FROM d WHERE doc_id % 7 <> 3),
tg AS (SELECT site, url, page_id, pos, src_url FROM links WHERE internal QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id, pos) = 1),
checked AS (SELECT tg.site, tg.page_id, tg.pos, tg.src_url, tg.url AS dst_url, CAST(st.status_code AS INT) AS status_code FROM tg LEFT JOIN st ON st.url = tg.url),
broken AS (SELECT site, count(status_code) AS checked_count, count(*) FILTER (WHERE status_code = 0 OR status_code >= 400) AS broken_count, count(*) - count(status_code) AS unknown_count FROM checked GROUP BY site)"""

_SCORES = f""",{BROKEN},
w AS (SELECT site, max(total) AS pages, {', '.join(f"max(score) FILTER (WHERE metric_key = '{m[0]}') AS {m[0]}" for m in C.SITE_METRICS)} FROM coverage GROUP BY site),
wm AS (SELECT w.site, pages, {O.pct('b.broken_count', 'b.checked_count')} AS broken_ratio, {O.rnd('(title_coverage + meta_description_coverage + unique_title_coverage) / 3')} AS metadata,
  {O.rnd('(h1_compliance + substantive_content_coverage) / 2')} AS content, {O.rnd('(canonical_coverage + indexability_coverage) / 2')} AS indexation FROM w JOIN broken b ON b.site = w.site),
wi AS (SELECT *, {O.at_most('broken_ratio', 2)} AS integrity FROM wm),
site_scores AS MATERIALIZED (SELECT *, {O.rnd('(0::DOUBLE + metadata * 30 + content * 20 + indexation * 20 + 100 * 15 + integrity * 15) / 100')} AS overall_score FROM wi)"""
SCORES = COVERAGE + _SCORES


def _scored(spark, folder):
    f = R.stored_features(spark, folder)
    broken = links.broken_summary(links.checked_links(extract.edges(f), R.link_status(spark, folder)))
    return f, site.site_scores(f, broken)


@query(
    "site_scores",
    f"WITH {SCORES} SELECT site, pages, broken_ratio, metadata, content, indexation, integrity, overall_score, {O.fmt('overall_score')} AS overall_seo_health FROM site_scores",
)
def _(spark, folder):
    return _scored(spark, folder)[1].drop("serp")


@query(
    "broken_links_finding",
    f"""WITH {O.LINKS},{BROKEN}, r AS (SELECT site, checked_count, broken_count, {O.pct('broken_count', 'checked_count')} AS ratio FROM broken),
    s AS (SELECT *, {O.at_most('ratio', 2)} AS score FROM r) SELECT site, score, {O.status('score')} AS status, {O.prio('score')} AS priority FROM s""",
)
def _(spark, folder):
    b = links.broken_summary(links.checked_links(R.graph(spark, folder), R.link_status(spark, folder)))
    f = findings.broken_links_finding(F.col("broken_ratio"), F.col("checked_count"), F.col("broken_count"))
    return b.select("site", f.alias("f")).select("site", "f.score", "f.status", "f.priority")


@query(
    "domain_authority",
    f"""WITH {O.FEATURES} SELECT site, count(*) AS pages, CAST(trunc({O.clamp('sum(page_authority)::DOUBLE / count(*) * 0.75::DOUBLE + least(15, count(*))')}) AS INT) AS domain_authority
    FROM features GROUP BY site""",
)
def _(spark, folder):
    return site.domain_authority(R.features(spark, folder))


def _share(test: str) -> str:
    return f"CAST({O.rint(f'count(*) FILTER (WHERE {test})::DOUBLE / count(*) * 100')} AS INT)"


@query(
    "site_summary",
    f"""WITH {CHECKLIST} SELECT site, count(*) AS total_pages, CAST({O.rint('sum(score)::DOUBLE / count(*)')} AS BIGINT) AS avg_score, count(*) FILTER (WHERE title <> '') AS titles_present,
      {_share("title <> ''")} AS titles_pct, count(*) FILTER (WHERE description <> '') AS descs_present, {_share("description <> ''")} AS descs_pct,
      count(DISTINCT nullif(title, '')) AS unique_titles, count(DISTINCT nullif(description, '')) AS unique_descs, count(*) FILTER (WHERE h1_count = 1) AS h1_correct,
      {_share('h1_count = 1')} AS h1_pct, {_share('has_viewport_meta')} AS viewport_pct, {_share('has_canonical')} AS canonical_pct, {_share('is_indexable')} AS indexable_pct,
      {_share('has_structured_data')} AS schema_pct, {_share("og_title <> ''")} AS og_pct, CAST({O.rint('sum(word_count)::DOUBLE / count(*)')} AS BIGINT) AS avg_word_count,
      0::BIGINT AS avg_response_ms, CAST(sum(total_images) AS BIGINT) AS total_images, CAST(sum(missing_alt_count) AS BIGINT) AS missing_alt_images,
      CAST({O.rint('(sum(total_images) - sum(missing_alt_count))::DOUBLE / greatest(sum(total_images), 1) * 100')} AS INT) AS alt_coverage_pct FROM scored GROUP BY site""",
)
def _(spark, folder):
    return site.site_summary(R.features(spark, folder))


@query(
    "site_summary_table",
    f"""WITH {CHECKLIST}, a AS (SELECT site, {_share("title <> ''")} AS t, {_share("description <> ''")} AS m, {_share('h1_count = 1')} AS h, {_share('has_viewport_meta')} AS v, {_share('has_canonical')} AS c,
      {_share('is_indexable')} AS i, CAST({O.rint('(sum(total_images) - sum(missing_alt_count))::DOUBLE / greatest(sum(total_images), 1) * 100')} AS INT) AS g, {_share('has_structured_data')} AS s, {_share("og_title <> ''")} AS o,
      count(*) FILTER (WHERE title <> '') AS nt, count(DISTINCT nullif(title, '')) AS ut, count(*) FILTER (WHERE description <> '') AS nm, count(DISTINCT nullif(description, '')) AS um FROM scored GROUP BY site),
    r AS (SELECT site, unnest([
      {{'pos': 1, 'metric': 'Title Tag Coverage', 'value': t, 'result': CASE WHEN t = 100 THEN 'Pass' ELSE 'Fail' END}},
      {{'pos': 2, 'metric': 'Meta Description Coverage', 'value': m, 'result': CASE WHEN m = 100 THEN 'Pass' ELSE 'Fail' END}},
      {{'pos': 3, 'metric': 'Correct H1 Usage (1 per page)', 'value': h, 'result': CASE WHEN h = 100 THEN 'Pass' WHEN h >= 50 THEN 'Warning' ELSE 'Fail' END}},
      {{'pos': 4, 'metric': 'Mobile Viewport Tag', 'value': v, 'result': CASE WHEN v = 100 THEN 'Pass' ELSE 'Fail' END}},
      {{'pos': 5, 'metric': 'Canonical Tag Coverage', 'value': c, 'result': CASE WHEN c = 100 THEN 'Pass' ELSE 'Warning' END}},
      {{'pos': 6, 'metric': 'Indexable Pages', 'value': i, 'result': CASE WHEN i = 100 THEN 'Pass' ELSE 'Warning' END}},
      {{'pos': 7, 'metric': 'Image Alt Text Coverage', 'value': g, 'result': CASE WHEN g >= 90 THEN 'Pass' WHEN g >= 50 THEN 'Warning' ELSE 'Fail' END}},
      {{'pos': 8, 'metric': 'Structured Data (Schema)', 'value': s, 'result': CASE WHEN s >= 50 THEN 'Pass' ELSE 'Warning' END}},
      {{'pos': 9, 'metric': 'Open Graph Tags', 'value': o, 'result': CASE WHEN o >= 50 THEN 'Pass' ELSE 'Warning' END}},
      {{'pos': 10, 'metric': 'Unique Title Tags', 'value': ut, 'result': CASE WHEN ut = nt THEN 'Pass' ELSE 'Warning' END}},
      {{'pos': 11, 'metric': 'Unique Meta Descriptions', 'value': um, 'result': CASE WHEN um = nm THEN 'Pass' ELSE 'Warning' END}}]) AS x FROM a)
    SELECT site, x.pos AS pos, x.metric AS metric, CAST(x.value AS BIGINT) AS value, x.result AS result FROM r""",
)
def _(spark, folder):
    return site.summary_table(site.site_summary(R.features(spark, folder)))


@query(
    "severity_totals",
    f"""WITH {CHECKLIST} SELECT site, count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE severity = 'Medium') AS medium,
    count(*) FILTER (WHERE severity = 'Low') AS low FROM issues GROUP BY site""",
)
def _(spark, folder):
    return site.severity_totals(page_health.page_issues(R.features(spark, folder)))


@query(
    "issue_matrix",
    f"""WITH {CHECKLIST} SELECT site, issue, severity, count(*) AS pages, CAST({O.rank('severity', 3)} AS INT) AS severity_rank,
      CAST(row_number() OVER (PARTITION BY site ORDER BY {O.rank('severity', 3)}, count(*) DESC, issue) AS INT) AS place FROM issues GROUP BY site, issue, severity""",
)
def _(spark, folder):
    return site.issue_matrix(page_health.page_issues(R.features(spark, folder)))


@query("issue_pages", f"WITH {CHECKLIST} SELECT site, issue, severity, page_id, url FROM issues")
def _(spark, folder):
    return site.issue_pages(page_health.page_issues(R.features(spark, folder)))


@query(
    "schema_types_by_site",
    f"""WITH {O.DOCS}, t AS (SELECT site, unnest(CASE WHEN lang = 'en' AND q = 1 THEN ['LocalBusiness'] WHEN lang IN ('de', 'fr') THEN ['Person', 'article'] WHEN lang = 'es' THEN ['Microdata'] ELSE [] END) AS schema_type FROM d)
    SELECT DISTINCT site, schema_type FROM t""",
)
def _(spark, folder):
    return site.distinct_values(R.features(spark, folder), "structured_data_types", "schema_type")


@query(
    "external_domains_by_site",
    f"""WITH {O.LINKS}, e AS (SELECT DISTINCT site, regexp_extract(url, '//([^/?]*)', 1) AS domain FROM links WHERE NOT internal),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY domain) AS rank, count(*) OVER (PARTITION BY site) AS n FROM e)
    SELECT site, CAST(rank AS INT) AS rank, domain, greatest(n - 30, 0) AS remaining FROM r WHERE rank <= 30""",
)
def _(spark, folder):
    return site.external_domain_report(R.features(spark, folder).select("site", "external_domains"))


@query("all_external_domains", f"WITH {O.LINKS} SELECT DISTINCT site, regexp_extract(url, '//([^/?]*)', 1) AS domain FROM links WHERE NOT internal")
def _(spark, folder):
    return site.distinct_values(R.features(spark, folder), "external_domains", "domain")


@query(
    "site_headings",
    f"""WITH {O.DOCS}, t AS (
      SELECT site, doc_id, 0 AS pos, title AS h FROM d UNION ALL SELECT site, doc_id, 1, s1 FROM d WHERE lang <> 'es' UNION ALL SELECT site, doc_id, 2, s1 FROM d WHERE lang = 'de'
      UNION ALL SELECT site, doc_id, CASE lang WHEN 'de' THEN 3 WHEN 'es' THEN 1 ELSE 2 END, s2 FROM d),
    c AS (SELECT site, doc_id, pos, trim(regexp_replace(h, '\\s+', ' ', 'g')) AS heading FROM t)
    SELECT site, lower(heading) AS heading_key, heading, doc_id AS page_id, CAST(pos AS INT) AS pos FROM c WHERE heading <> ''
    QUALIFY row_number() OVER (PARTITION BY site, lower(heading) ORDER BY doc_id, pos) = 1""",
)
def _(spark, folder):
    return site.site_headings(R.features(spark, folder))


@query(
    "crawl_coverage",
    f"""WITH {O.LINKS}, s AS (SELECT site, src_url AS u FROM links UNION SELECT site, url FROM links WHERE internal),
    a AS (SELECT site, count(*) AS analyzed_pages FROM d GROUP BY site), f AS (SELECT site, count(DISTINCT u) AS discovered_internal_pages FROM s GROUP BY site)
    SELECT a.site, analyzed_pages, discovered_internal_pages, {O.pct('analyzed_pages', 'discovered_internal_pages')} AS sample_coverage_ratio FROM a JOIN f ON f.site = a.site""",
)
def _(spark, folder):
    return site.crawl_coverage(R.features(spark, folder).select("site", "url", "internal_links"))


@query(
    "speed_averages",
    """WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS INT) END AS m, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE CAST(value * 2 AS INT) END AS d FROM events),
    a AS (SELECT user_id, count(*) AS total_crawled, count(*) FILTER (WHERE m IS NOT NULL OR d IS NOT NULL) AS n, sum(m) AS sm, sum(d) AS sd FROM e GROUP BY user_id)
    SELECT user_id, total_crawled, n AS total_with_performance, CAST(CASE WHEN n > 0 THEN trunc(coalesce(sm, 0)::DOUBLE / n) ELSE 0 END AS INT) AS mobile_avg,
      CAST(CASE WHEN n > 0 THEN trunc(coalesce(sd, 0)::DOUBLE / n) ELSE 0 END AS INT) AS desktop_avg, total_crawled - n AS missing_data FROM a""",
)
def _(spark, folder):
    kind, v = F.col("event_type"), F.col("value")
    rows = R.table(spark, folder, "events").select(
        "user_id", F.when(kind != "error", N.round_half_even(v).cast("int")).alias("mobile_score"),
        F.when(~kind.isin("error", "view"), N.round_half_even(v * 2).cast("int")).alias("desktop_score"),
    )
    return site.speed_averages(rows, "user_id")


@query(
    "slowest_pages",
    """SELECT event_id, user_id AS site, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS response_ms,
      row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT) DESC, event_id) AS rank FROM events""",
)
def _(spark, folder):
    rows = R.table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("site"), (F.get_json_object("props", "$.k").cast("bigint") * 10).alias("response_ms")
    )
    return site.slowest_pages(rows, "event_id").withColumnRenamed("place", "rank")


@query(
    "word_count_table",
    f"""WITH {O.FEATURES} SELECT page_id, word_count, CASE WHEN word_count >= 300 THEN 'Good' WHEN word_count >= 100 THEN 'Thin' ELSE 'Very Thin' END AS assessment FROM features""",
)
def _(spark, folder):
    return site.word_count_table(R.features(spark, folder)).select("page_id", "word_count", "assessment")


# --- link graph ---------------------------------------------------------------------
ORPHANS = (
    O.LINKS
    + """,
targets AS (SELECT DISTINCT site, url FROM links WHERE internal),
orphans AS MATERIALIZED (SELECT d.site, d.origin || d.path AS url FROM d LEFT JOIN targets t ON t.site = d.site AND t.url = d.origin || d.path WHERE t.url IS NULL)"""
)


@query("orphan_pages", f"WITH {ORPHANS} SELECT site, url FROM orphans")
def _(spark, folder):
    f = R.features(spark, folder).select("site", "url", "internal_links")
    return links.orphans(f, links.internal_targets(f))


@query(
    "internal_linking",
    f"""WITH {ORPHANS}, t AS (SELECT site, count(*) FILTER (WHERE internal) AS n, count(DISTINCT page_id) AS pages FROM first_links GROUP BY site),
    o AS (SELECT site, count(*) AS c, array_to_string(list_slice(list_sort(list(url)), 1, 5), ' ') AS sample FROM orphans GROUP BY site),
    a AS (SELECT t.site, n, {O.rnd('n::DOUBLE / pages')} AS m, coalesce(c, 0) AS c, coalesce(sample, '') AS sample FROM t LEFT JOIN o ON o.site = t.site)
    SELECT site, n AS total_internal_links, m AS avg_links_per_page, c AS orphan_page_count, sample AS orphan_pages_sample,
      CAST(greatest(0, CASE WHEN n = 0 THEN 0 WHEN m < 3 THEN 35 WHEN m < 8 THEN 70 ELSE 100 END - least(20, c * 3)) AS INT) AS internal_link_score FROM a""",
)
def _(spark, folder):
    f = R.features(spark, folder).select("site", "url", "internal_links", "internal_links_count")
    return links.internal_linking(f).withColumn("orphan_pages_sample", F.array_join("orphan_pages_sample", " "))


@query(
    "outbound_profile",
    f"""WITH {O.LINKS}, e AS (SELECT site, count(*) FILTER (WHERE NOT internal) AS n, count(DISTINCT regexp_extract(url, '//([^/?]*)', 1)) FILTER (WHERE NOT internal) AS c FROM first_links GROUP BY site)
    SELECT site, n AS outbound_link_count, c AS outbound_domain_count, CASE WHEN c < 3 THEN 'Low' WHEN c < 15 THEN 'Medium' ELSE 'High' END AS outbound_domain_diversity FROM e""",
)
def _(spark, folder):
    return links.outbound_profile(R.features(spark, folder).select("site", "external_domains", "external_links_count"))


@query("in_degree", f"WITH {O.LINKS} SELECT site, url AS dst_url, count(DISTINCT src_url) AS in_degree FROM links WHERE internal GROUP BY site, url")
def _(spark, folder):
    return links.in_degree(R.graph(spark, folder))


@query(
    "in_degree_parts",
    """SELECT l_partkey AS dst_url, count(DISTINCT l_orderkey) AS in_degree FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey""",
)
def _(spark, folder):
    g = R.table(spark, folder, "lineitem").select(
        F.lit(1).alias("site"), F.col("l_orderkey").alias("src_url"), F.col("l_partkey").alias("dst_url"), (F.col("l_returnflag") != "R").alias("is_internal")
    )
    return links.in_degree(g).drop("site")


@query(
    "graph_link_score",
    f"""WITH {ORPHANS}, deg AS (SELECT site, count(*) AS incoming FROM (SELECT DISTINCT site, url, src_url FROM links WHERE internal) GROUP BY site),
    p AS (SELECT site, count(*) AS total_pages FROM d GROUP BY site), o AS (SELECT site, count(*) AS c FROM orphans GROUP BY site),
    a AS (SELECT p.site, total_pages, coalesce(c, 0) AS orphans, {O.rnd('coalesce(incoming, 0)::DOUBLE / total_pages')} AS m FROM p LEFT JOIN deg ON deg.site = p.site LEFT JOIN o ON o.site = p.site),
    s AS (SELECT *, CAST(greatest(0, CASE WHEN m < 1 THEN 20 WHEN m < 3 THEN 45 WHEN m < 8 THEN 70 ELSE 100 END - least(25, orphans * 4)) AS INT) AS score FROM a)
    SELECT site, total_pages, orphans, m AS avg_links_per_page, score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Average' ELSE 'Poor' END AS rating FROM s""",
)
def _(spark, folder):
    g = R.graph(spark, folder)
    return links.graph_link_score(g.select("site", F.col("src_url").alias("url")), g)


@query("checked_links", f"WITH {O.LINKS},{BROKEN} SELECT site, page_id, pos, src_url, dst_url, status_code, CASE WHEN status_code IS NULL THEN 'unknown' WHEN status_code = 0 OR status_code >= 400 THEN 'broken' ELSE 'ok' END AS state FROM checked")
def _(spark, folder):
    return links.checked_links(R.graph(spark, folder), R.link_status(spark, folder))


@query(
    "broken_summary",
    f"""WITH {O.LINKS},{BROKEN}, b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id, pos, dst_url) AS n FROM checked WHERE status_code = 0 OR status_code >= 400)
    SELECT br.site, checked_count, broken_count, unknown_count, {O.pct('broken_count', 'checked_count')} AS broken_ratio,
      coalesce((SELECT array_to_string(list(dst_url ORDER BY n), ' ') FROM b WHERE b.site = br.site AND n <= 5), '') AS broken_links FROM broken br""",
)
def _(spark, folder):
    b = links.broken_summary(links.checked_links(R.graph(spark, folder), R.link_status(spark, folder)))
    return b.withColumn("broken_links", F.coalesce(F.array_join(F.transform("broken_links", lambda x: x["dst_url"]), " "), F.lit("")))


@query(
    "reachable_pages",
    f"""WITH RECURSIVE {O.LINKS}, e AS MATERIALIZED (SELECT DISTINCT site, src_url, url FROM links WHERE internal),
    r AS (SELECT DISTINCT site, origin || '/' AS url, 0 AS depth FROM d UNION SELECT e.site, e.url, r.depth + 1 FROM r JOIN e ON e.site = r.site AND e.src_url = r.url WHERE r.depth < 64)
    SELECT site, url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY site, url""",
)
def _(spark, folder):
    return links.reachability(R.home_pages(spark, folder), R.graph(spark, folder))


# --- sitemaps -------------------------------------------------------------------------
SITEMAP = (
    ORPHANS
    + f""",
sm AS MATERIALIZED (SELECT site, origin || path AS url, CASE WHEN q = 1 THEN 2 ELSE 1 END AS n FROM d WHERE q >= 0),
cr AS (SELECT DISTINCT site, url FROM links WHERE internal),
al AS MATERIALIZED (SELECT site, url FROM sm UNION SELECT site, url FROM cr),
st AS (SELECT origin || path AS url, CASE WHEN q = 0 THEN 404 WHEN x = 1 THEN 0 ELSE 200 END AS status_code FROM d WHERE doc_id % 7 <> 3),
br AS (SELECT a.site, count(*) FILTER (WHERE status_code = 0 OR status_code >= 400) AS broken FROM
  al a LEFT JOIN st ON st.url = a.url GROUP BY a.site),
orp AS (SELECT a.site, count(*) AS orphans FROM al a LEFT JOIN targets t ON t.site = a.site AND t.url = a.url WHERE t.url IS NULL GROUP BY a.site),
tot AS (SELECT a.site, count(*) AS total_urls, count(sm.url) AS listed, CAST(coalesce(sum(sm.n - 1), 0) AS BIGINT) AS duplicates FROM al a LEFT JOIN sm ON sm.site = a.site AND sm.url = a.url GROUP BY a.site),
sx AS (SELECT tot.site, total_urls, CASE WHEN listed > 0 THEN listed ELSE total_urls END AS included, coalesce(broken, 0) AS broken, coalesce(orphans, 0) AS orphans, duplicates
  FROM tot LEFT JOIN br ON br.site = tot.site LEFT JOIN orp ON orp.site = tot.site),
metrics AS MATERIALIZED (SELECT *, greatest(0, total_urls - broken) AS crawlable, {O.pct('included', 'total_urls')} AS coverage FROM sx)"""
)


def _sitemap_inputs(spark, folder):
    g = R.graph(spark, folder)
    crawled = links.in_degree(g).select("site", F.col("dst_url").alias("url"))
    return R.sitemap_rows(spark, folder), crawled, g, R.link_status(spark, folder)


@query("sitemap_all_urls", f"WITH {SITEMAP} SELECT site, url FROM al")
def _(spark, folder):
    listed, crawled, _, _ = _sitemap_inputs(spark, folder)
    return sitemap.all_urls(listed, crawled)


@query("sitemap_metrics", f"WITH {SITEMAP} SELECT site, total_urls, included, crawlable, orphans, duplicates, broken, coverage FROM metrics")
def _(spark, folder):
    return sitemap.metrics(*_sitemap_inputs(spark, folder))


@query(
    "sitemap_warnings",
    f"""WITH {SITEMAP}, deg AS (SELECT site, count(*) AS incoming FROM (SELECT DISTINCT site, url, src_url FROM links WHERE internal) GROUP BY site),
    ls AS (SELECT m.*, {O.rnd('coalesce(incoming, 0)::DOUBLE / total_urls')} AS mean FROM metrics m LEFT JOIN deg ON deg.site = m.site),
    w0 AS (SELECT *, greatest(0, CASE WHEN mean < 1 THEN 20 WHEN mean < 3 THEN 45 WHEN mean < 8 THEN 70 ELSE 100 END - least(25, orphans * 4)) AS score,
      CAST(regexp_extract(site, 'site([0-9]+)', 1) AS BIGINT) AS k FROM ls),
    w1 AS (SELECT *, k % 5 NOT IN (1, 2, 3) AS xml, k % 6 NOT IN (1, 2, 3, 4) AS robots FROM w0)
    SELECT site, severity, rule FROM (
      SELECT site, 'Critical' AS severity, 'missing_sitemap' AS rule FROM w1 WHERE NOT xml AND NOT robots
      UNION ALL SELECT site, CASE WHEN coverage < 50 THEN 'Critical' ELSE 'Warning' END, 'low_coverage' FROM w1 WHERE coverage < 80
      UNION ALL SELECT site, 'Warning', 'orphan_pages' FROM w1 WHERE orphans > 0
      UNION ALL SELECT site, 'Critical', 'broken_urls' FROM w1 WHERE broken > 0
      UNION ALL SELECT site, 'Warning', 'low_link_score' FROM w1 WHERE score < 40
      UNION ALL SELECT site, 'Info', 'sitemap_detected' FROM w1 WHERE xml OR robots
      UNION ALL SELECT site, 'Info', 'ai_crawler_access' FROM w1)""",
)
def _(spark, folder):
    found = sitemap.discover(R.resources(spark, folder))
    return sitemap.warnings(sitemap.site_report(*_sitemap_inputs(spark, folder), found)).select("site", "severity", "rule")


@query(
    "sitemap_discovery",
    f"""WITH {O.DOCS}, s AS (SELECT DISTINCT site, origin, k FROM d)
    SELECT site, CASE WHEN k % 5 NOT IN (1, 2, 3) THEN origin || '/sitemap.xml' ELSE origin || '/map.xml' END AS sitemap_url,
      CASE WHEN k % 5 NOT IN (1, 2, 3) THEN 'sitemap.xml' ELSE 'robots.txt' END AS source FROM s WHERE k % 5 NOT IN (1, 2, 3) OR k % 6 NOT IN (1, 2, 3, 4)""",
)
def _(spark, folder):
    return sitemap.discover(R.resources(spark, folder))


@query(
    "resource_verdicts",
    f"""WITH {O.DOCS}, s AS (SELECT DISTINCT site, k FROM d)
    SELECT site, 'robots' AS kind, CASE k % 6 WHEN 1 THEN 'Missing' WHEN 2 THEN 'Invalid (HTML response)' WHEN 3 THEN 'Invalid (Empty response)' WHEN 4 THEN 'Invalid (Missing directives)' ELSE 'Found (Valid)' END AS status_string FROM s
    UNION ALL SELECT site, 'sitemap', CASE k % 5 WHEN 1 THEN 'Missing' WHEN 2 THEN 'Invalid (Wrong Content-Type)' WHEN 3 THEN 'Invalid (Missing XML structure)' ELSE 'Found (Valid)' END FROM s""",
)
def _(spark, folder):
    return sitemap.resource_verdicts(R.resources(spark, folder)).select("site", "kind", "status_string")


@query(
    "resource_labels",
    f"""WITH {O.DOCS}, s AS (SELECT site, k, arg_min(lang, doc_id) AS lang, bool_or(x = 1) AS bad FROM d GROUP BY site, k)
    SELECT site, CASE k % 6 WHEN 1 THEN 'Missing' WHEN 2 THEN 'Invalid (HTML response)' WHEN 3 THEN 'Invalid (Empty response)' WHEN 4 THEN 'Invalid (Missing directives)' ELSE 'Found (Valid)' END AS robots_txt_status,
      CASE WHEN k % 5 IN (1, 2, 3) THEN 'Missing' ELSE 'Found (200)' END AS sitemap_status,
      CASE WHEN lang IN ('en', 'de') THEN 'Found (HTML link tag)' WHEN bad THEN 'Found (/favicon.ico)' ELSE 'Missing' END AS favicon_status FROM s""",
)
def _(spark, folder):
    res = R.resources(spark, folder)
    primary = site.primary_page(R.features(spark, folder), ["favicon"])
    return sitemap.status_labels(primary, sitemap.resource_verdicts(res), sitemap.favicon_verdicts(res))


@query(
    "robots_allowed_urls",
    f"""WITH {O.DOCS} SELECT site, origin || path AS url FROM d
    WHERE NOT (k % 6 <> 1 AND k % 6 <> 3 AND k % 6 <> 4 AND (starts_with(path, '/blog/') OR starts_with(path, '/p/1')))""",
)
def _(spark, folder):
    urls = R.documents(spark, folder).select(F.substring("origin", 9, 1000).alias("site"), F.concat("origin", "path").alias("url"))
    return sitemap.allowed(urls, sitemap.disallowed_rules(R.resources(spark, folder)))


# --- comparison and profile ---------------------------------------------------------------
def _own_and_competitors(spark, folder):
    docs = R.table(spark, folder, "documents")
    role = F.when(F.pmod(F.length("text"), F.lit(2)) == 0, "own").otherwise("competitor")
    return docs.select("source", role.alias("role"), "text")


_TERMS = f"""t AS (SELECT DISTINCT source, length(text) % 2 = 0 AS own, unnest({O.terms('text')}) AS term FROM documents),
g AS MATERIALIZED (SELECT source, term, bool_or(own) AS own, bool_or(NOT own) AS competitor FROM t GROUP BY source, term)"""


@query("shared_terms", f"WITH {_TERMS} SELECT source, term FROM g WHERE own AND competitor")
def _(spark, folder):
    return compare.shared_terms(compare.term_flags(_own_and_competitors(spark, folder), "source", "text"), "source")


@query(
    "term_overlap",
    f"""WITH {_TERMS}, a AS (SELECT source, count(*) FILTER (WHERE own AND competitor) AS shared, count(*) FILTER (WHERE own) AS own_terms, count(*) FILTER (WHERE competitor) AS competitor_terms FROM g GROUP BY source),
    o AS (SELECT *, {O.pct('shared', 'competitor_terms')} AS overlap_score FROM a) SELECT *, {O.rnd('greatest(100 - overlap_score, 0)')} AS content_gap FROM o""",
)
def _(spark, folder):
    return compare.overlap(compare.term_flags(_own_and_competitors(spark, folder), "source", "text"), "source")


_OPPS = """WITH r AS (SELECT o_custkey AS project, o_orderkey AS pos, trim(CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE o_orderpriority END) AS keyword,
  greatest(1, least(10, CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice / 40000) AS BIGINT) ELSE 0 END)) AS s,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'High' WHEN o_orderpriority LIKE '5%' THEN 'Low' END AS p FROM orders),
c AS (SELECT project, pos, keyword, CAST(s AS INT) AS s, coalesce(p, CASE WHEN s >= 8 THEN 'High' WHEN s >= 5 THEN 'Medium' ELSE 'Low' END) AS p FROM r WHERE keyword <> '')"""


@query(
    "clean_opportunities",
    f"""{_OPPS} SELECT project, pos, keyword, s AS market_opportunity_score, p AS priority,
    CAST(row_number() OVER (PARTITION BY project ORDER BY s DESC, {O.rank('p', 9)}, pos) AS INT) AS rank FROM c QUALIFY rank <= 5""",
)
def _(spark, folder):
    c = F.col
    raw = R.table(spark, folder, "orders").select(
        c("o_custkey").alias("project"), c("o_orderkey").alias("pos"), F.when(c("o_orderstatus") == "P", "  ").otherwise(c("o_orderpriority")).alias("keyword"),
        F.when(c("o_orderstatus") == "O", F.floor(c("o_totalprice") / 40000).cast("string")).otherwise("many").alias("market_opportunity_score"),
        F.when(c("o_orderpriority").startswith("1"), "High").when(c("o_orderpriority").startswith("5"), "Low").otherwise("?").alias("priority"),
    )
    return compare.clean_opportunities(raw, "project")


@query(
    "fallback_opportunities",
    f"""WITH {O.DOCS}, c AS (SELECT doc_id, unnest(list_concat([trim(regexp_replace(s1, '\\s+', ' ', 'g'))], CASE WHEN q = 1 THEN [source, lang] ELSE {O.sql_list(C.DEFAULT_KEYWORDS)} END, {O.sql_list(C.DEFAULT_PILLARS)})) AS keyword,
      unnest(range(7)) AS i FROM d),
    f AS (SELECT doc_id, keyword, i FROM c WHERE keyword <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(keyword) ORDER BY i) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM f QUALIFY pos <= 5)
    SELECT doc_id, CAST(pos AS INT) AS pos, keyword, CAST(greatest(10 - pos + 1, 6) AS INT) AS market_opportunity_score, CASE WHEN 10 - pos + 1 >= 8 THEN 'High' ELSE 'Medium' END AS priority FROM n""",
)
def _(spark, folder):
    p = R.documents(spark, folder).select(
        "doc_id", F.col("sentence1").alias("seed_keyword"), F.when(F.col("q") == 1, F.array("source", "lang")).otherwise(N.lit_array([])).alias("market_focus_keywords"),
        N.lit_array([]).alias("core_service_pillars"),
    )
    return compare.fallback_opportunities(p, "doc_id")


@query(
    "competitor_comparison",
    f"""WITH {_TERMS}, a AS (SELECT source, count(*) FILTER (WHERE own AND competitor) AS shared, count(*) FILTER (WHERE competitor) AS n FROM g GROUP BY source),
    o AS (SELECT source, {O.pct('shared', 'n')} AS overlap_score FROM a), b AS (SELECT *, {O.rnd('greatest(100 - overlap_score, 0)')} AS content_gap FROM o)
    SELECT source, {O.fmt('overlap_score')} AS keyword_overlap_score, {O.fmt('content_gap')} AS content_gap_ratio,
      source || '|' || array_to_string({O.sql_list(C.DEFAULT_KEYWORDS)}, '|') || '|' || '{C.DEFAULT_PILLARS[0]}' AS keywords FROM b""",
)
def _(spark, folder):
    texts = _own_and_competitors(spark, folder)
    profiles = texts.select("source").distinct().select(
        "source", F.col("source").alias("seed_keyword"), N.lit_array([]).alias("market_focus_keywords"), N.lit_array([]).alias("core_service_pillars")
    )
    out = compare.compare(compare.term_flags(texts, "source", "text"), profiles, "source")
    return out.select("source", "keyword_overlap_score", "content_gap_ratio", F.array_join(F.transform("market_opportunities", lambda x: x["keyword"]), "|").alias("keywords"))


@query(
    "top_competitors",
    """WITH r AS (SELECT l_orderkey AS query, l_linenumber AS pos, CASE WHEN l_returnflag = 'A' THEN 'https://search.example/r' WHEN l_returnflag = 'R' THEN '/local' ELSE 'https://c' || l_suppkey || '.example/' END AS href FROM lineitem),
    f AS (SELECT query, href, min(pos) AS pos FROM r WHERE href LIKE '%http%' AND href NOT LIKE '%search.example%' GROUP BY query, href)
    SELECT query, href, CAST(row_number() OVER (PARTITION BY query ORDER BY pos, href) AS INT) AS rank FROM f QUALIFY rank <= 3""",
)
def _(spark, folder):
    flag = F.col("l_returnflag")
    href = F.when(flag == "A", "https://search.example/r").when(flag == "R", "/local").otherwise(F.concat(F.lit("https://c"), F.col("l_suppkey").cast("string"), F.lit(".example/")))
    rows = R.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("pos"), href.alias("href"))
    return compare.top_competitors(rows, "query", "search.example").drop("pos")


@query(
    "frequent_terms",
    f"""WITH t AS (SELECT source, doc_id, unnest({O.terms('text', C.PROFILE_STOPWORDS)}) AS term, generate_subscripts({O.terms('text', C.PROFILE_STOPWORDS)}, 1) AS p FROM documents),
    g AS (SELECT source, term, count(*) AS n, min((doc_id, p)) AS f FROM t GROUP BY source, term)
    SELECT source, term, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS INT) AS rank FROM g QUALIFY rank <= 8""",
)
def _(spark, folder):
    return profile.frequent_terms(R.table(spark, folder, "documents"), "source", "text", "doc_id")


@query(
    "site_profiles",
    f"""WITH {O.DOCS}, h AS (SELECT * FROM d WHERE doc_id = k * k),
    parts AS (SELECT site, k, title, description, list_filter(list_transform(string_split_regex(title, '\\s*[|:\\-–—]\\s*'), lambda z: trim(z)), lambda z: z <> '') AS tp,
      list_concat(CASE lang WHEN 'de' THEN [s1, s1] WHEN 'es' THEN [] ELSE [s1] END, [s2]) AS hs,
      CASE WHEN description = '' THEN [] ELSE list_slice(string_split_regex(description, '[,.|;]'), 1, 3) END AS fr FROM h),
    c AS (SELECT site, unnest(list_concat(hs, tp, fr)) AS v, generate_subscripts(list_concat(hs, tp, fr), 1) AS i FROM parts),
    n AS (SELECT site, i, regexp_replace(regexp_replace(trim(regexp_replace(v, '\\s+', ' ', 'g')), '^[ \\-|:]+', ''), '[ \\-|:]+$', '') AS v FROM c),
    f AS (SELECT site, v, i FROM n WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY site, lower(v) ORDER BY i) = 1),
    g AS (SELECT site, list_slice(list(v ORDER BY i), 1, 10) AS terms FROM f GROUP BY site)
    SELECT p.site, coalesce(list_filter(tp, lambda z: contains(regexp_replace(lower(z), '[^a-z0-9]+', '', 'g'), 'example'))[1], list_filter(tp, lambda z: len(string_split_regex(z, '\\s+')) <= 6)[-1], tp[1], 'Example') AS company_name,
      array_to_string(list_slice(g.terms, 1, 3), '|') AS pillars, array_to_string(list_slice(g.terms, 1, 8), '|') AS keywords,
      coalesce(nullif(description, ''), nullif(title, '')) AS business_summary FROM parts p JOIN g ON g.site = p.site WHERE title <> '' OR description <> ''""",
)
def _(spark, folder):
    primary = site.primary_page(R.features(spark, folder), ["url", "title", "description", "headings"])
    p = profile.site_profile(primary.filter((F.col("title") != "") | (F.col("description") != "")))
    return p.select(
        "site", "company_name", F.array_join("core_service_pillars", "|").alias("pillars"), F.array_join("market_focus_keywords", "|").alias("keywords"), "business_summary"
    )


@query(
    "bare_site_profiles",
    f"""WITH {O.DOCS}, h AS (SELECT * FROM d WHERE doc_id = k * k), w AS (SELECT site, k % 2 = 0 AS bare, trim(regexp_replace(s2, '\\s+', ' ', 'g')) AS one FROM h),
    n AS (SELECT *, regexp_replace(regexp_replace(one, '^[ \\-|:]+', ''), '[ \\-|:]+$', '') AS word FROM w)
    SELECT site, 'Example' AS company_name, 'Management Board' AS audience_label, CASE WHEN bare OR word = '' THEN 'Primary service visibility|Commercial search positioning|Market discovery' ELSE word END AS pillars,
      CASE WHEN bare OR word = '' THEN 'primary service|commercial intent|customer demand' ELSE word END AS keywords, 'Example works around ' || CASE WHEN bare OR word = '' THEN 'primary service' ELSE word END || '.' AS business_summary FROM n""",
)
def _(spark, folder):
    """Pages that say nothing: every second one keeps one heading, the others only their url."""
    primary = site.primary_page(R.features(spark, folder), ["url", "title", "description", "headings"])
    number = F.regexp_extract("url", r"site(\d+)\.", 1).cast("bigint")
    h2 = F.when(number % 2 == 1, F.slice(F.reverse(F.col("headings.h2")), 1, 1)).otherwise(N.lit_array([]))
    none = primary.withColumns({"title": F.lit(""), "description": F.lit(None).cast("string"), "headings": F.col("headings").withField("h1", N.lit_array([])).withField("h2", h2)})
    p = profile.site_profile(none)
    return p.select("site", "company_name", "audience_label", F.array_join("core_service_pillars", "|").alias("pillars"), F.array_join("market_focus_keywords", "|").alias("keywords"), "business_summary")


# --- reports ---------------------------------------------------------------------------------
_FOUND = f"""fo AS MATERIALIZED (SELECT *, {O.prio('score')} AS priority, {O.status('score')} AS status, row_number() OVER (PARTITION BY site ORDER BY {O.rank(O.prio('score'))}, metric_pos) AS finding_pos FROM coverage)"""
_FOUND = _FOUND.replace(O.rank(O.prio('score')), f"CASE WHEN score < 40 THEN 0 WHEN score < 80 THEN 1 ELSE 2 END")


def _site_findings(spark, folder):
    return report.ordered_findings(site.coverage(R.features(spark, folder)))


def _opportunities(profiles):
    return top_k(compare.fallback_opportunities(profiles, "site"), ["site"], [F.desc("market_opportunity_score"), F.col("pos")], 5)


def _seeds(df):
    return df.select("site").distinct().select(
        "site", F.col("site").alias("seed_keyword"), N.lit_array([]).alias("market_focus_keywords"), N.lit_array([]).alias("core_service_pillars")
    )


@query("ordered_site_findings", f"WITH {COVERAGE}, {_FOUND} SELECT site, metric, priority, CAST(finding_pos AS INT) AS finding_pos FROM fo")
def _(spark, folder):
    return _site_findings(spark, folder).select("site", "metric", "priority", "finding_pos")


@query(
    "priority_lists",
    f"""WITH {COVERAGE}, {_FOUND} SELECT site, coalesce(string_agg(metric, '|' ORDER BY finding_pos) FILTER (WHERE priority = 'High'), '') AS high,
      coalesce(string_agg(metric, '|' ORDER BY finding_pos) FILTER (WHERE priority = 'Medium'), '') AS medium, coalesce(string_agg(metric, '|' ORDER BY finding_pos) FILTER (WHERE priority = 'Low'), '') AS low FROM fo GROUP BY site""",
)
def _(spark, folder):
    lists = report.priority_lists(_site_findings(spark, folder))
    return lists.select("site", *[F.array_join(c, "|").alias(c) for c in ("high", "medium", "low")])


@query("top_report_actions", f"WITH {COVERAGE}, {_FOUND} SELECT site, metric, priority, CAST(finding_pos AS INT) AS rank FROM fo WHERE finding_pos <= 4")
def _(spark, folder):
    return report.first_rows(_site_findings(spark, folder), [F.col("finding_pos")], 4).select("site", "metric", "priority", "rank")


@query(
    "management_summary",
    f"""WITH {SCORES}, {_FOUND},
    b AS (SELECT site, arg_min(metric, (CASE WHEN status = 'At Benchmark' THEN 0 ELSE 1 END, metric_pos)) AS strongest_asset, arg_min(metric, (CASE WHEN priority = 'High' THEN 0 ELSE 1 END, finding_pos)) AS biggest_risk FROM fo GROUP BY site)
    SELECT s.site, overall_score, CASE WHEN overall_score >= 85 THEN 'Strong foundation with room to grow.' WHEN overall_score >= 70 THEN 'Moderate maturity with clear gaps to close.' ELSE 'Performance is at risk; repairs are due.' END AS board_verdict,
      strongest_asset, biggest_risk, s.site AS growth_opportunity FROM site_scores s JOIN b ON b.site = s.site""",
)
def _(spark, folder):
    f, scores = _scored(spark, folder)
    found = report.ordered_findings(site.coverage(f))
    return report.management_summary(scores, found, found, _opportunities(_seeds(f)))


@query(
    "roadmap",
    f"""WITH {COVERAGE}, {_FOUND},
    l AS (SELECT site, list(metric ORDER BY finding_pos) AS al, list(metric ORDER BY finding_pos) FILTER (WHERE priority = 'High') AS hi, list(metric ORDER BY finding_pos) FILTER (WHERE priority = 'Medium') AS me FROM fo GROUP BY site)
    SELECT site, 1 AS phase, 'High' AS priority, array_to_string(list_slice(CASE WHEN len(hi) > 0 THEN hi ELSE al END, 1, 2), '|') AS actions FROM l
    UNION ALL SELECT site, 2, 'Medium', array_to_string(CASE WHEN len(me) > 0 THEN list_slice(me, 1, 2) ELSE list_slice(al, 3, 4) END, '|') FROM l
    UNION ALL SELECT site, 3, 'Medium', 'Content on ' || site || '|Connect search and visitor statistics|Crawl the whole site again' FROM l""",
)
def _(spark, folder):
    f = _site_findings(spark, folder)
    return report.roadmap(f, _opportunities(_seeds(f))).select("site", "phase", "priority", F.array_join("actions", "|").alias("actions"))


@query(
    "data_limitations",
    f"""WITH {O.LINKS}, s AS (SELECT site, src_url AS u FROM links UNION SELECT site, url FROM links WHERE internal), a AS (SELECT site, count(*) AS n FROM d GROUP BY site),
    f AS (SELECT site, count(DISTINCT u) AS m FROM s GROUP BY site), v AS (SELECT a.site, n, {O.pct('n', 'm')} AS r FROM a JOIN f ON f.site = a.site)
    SELECT site, p AS pos, n0 AS data_source, CASE WHEN p = 5 THEN n || ' pages, ' || printf('%.1f', r) || '% of the discovered urls' WHEN p = 3 THEN 'Not measured in this crawl' ELSE 'Not connected' END AS current_status
    FROM v, (VALUES (1, 'Google Search Console'), (2, 'Analytics and Conversion Data'), (3, 'Core Web Vitals and Speed Testing'), (4, 'Backlink and Authority Intelligence'), (5, 'Full Site Crawl Coverage')) t(p, n0)""",
)
def _(spark, folder):
    return report.data_limitations(site.crawl_coverage(R.features(spark, folder).select("site", "url", "internal_links")))


@query(
    "report_documents",
    f"""WITH {SCORES}, {_FOUND}, b AS (SELECT site, count(*) AS findings, arg_min(metric, finding_pos) AS first_action, arg_min(metric, (CASE WHEN priority = 'High' THEN 0 ELSE 1 END, finding_pos)) AS biggest_risk FROM fo GROUP BY site)
    SELECT s.site, 'Management SEO Audit Report' AS report_title, s.site AS website, {O.fmt('overall_score')} AS overall_seo_health, {O.fmt('metadata')} AS metadata_health, pages AS analyzed_pages, b.biggest_risk,
      CAST(b.findings AS INT) AS findings, CAST(least(4, b.findings) AS INT) AS actions, b.first_action, 3 AS phases FROM site_scores s JOIN b ON b.site = s.site""",
)
def _(spark, folder):
    f, scores = _scored(spark, folder)
    found = report.ordered_findings(site.coverage(f))
    chances = _opportunities(_seeds(f))
    summary = report.management_summary(scores, found, found, chances)
    profiles = profile.site_profile(site.primary_page(f, ["url", "title", "description", "headings"]))
    documents = report.report_document(scores, summary, found, chances, site.crawl_coverage(f), profiles, "2026-01-01")
    place = f"{checkpoint_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    sinks.write_report(documents, place)
    schema = (
        "report_title string, website string, hero_metrics struct<overall_seo_health: string, metadata_health: string>, crawl_overview struct<analyzed_pages: bigint>, "
        "management_summary struct<biggest_risk: string>, technical_findings array<struct<metric: string>>, priority_actions array<struct<metric: string>>, recommended_roadmap array<struct<phase: int>>"
    )
    d = F.col("d")
    return spark.read.schema("site string, document string").json(place).select("site", F.from_json("document", schema).alias("d")).select(
        "site", d["report_title"].alias("report_title"), d["website"].alias("website"), d["hero_metrics"]["overall_seo_health"].alias("overall_seo_health"),
        d["hero_metrics"]["metadata_health"].alias("metadata_health"), d["crawl_overview"]["analyzed_pages"].alias("analyzed_pages"), d["management_summary"]["biggest_risk"].alias("biggest_risk"),
        F.size(d["technical_findings"]).alias("findings"), F.size(d["priority_actions"]).alias("actions"), d["priority_actions"][0]["metric"].alias("first_action"), F.size(d["recommended_roadmap"]).alias("phases"),
    )


@query(
    "evidence_notes",
    f"""WITH {O.LINKS},{BROKEN}, s AS (SELECT site, src_url AS u FROM links UNION SELECT site, url FROM links WHERE internal), a AS (SELECT site, min(k) AS k, count(*) AS n FROM d GROUP BY site),
    f AS (SELECT site, count(DISTINCT u) AS m FROM s GROUP BY site), v AS (SELECT a.*, m, checked_count, broken_count FROM a JOIN f ON f.site = a.site LEFT JOIN broken b ON b.site = a.site)
    SELECT site, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN 'robots.txt answered with ' || CASE WHEN k % 6 = 1 THEN 404 ELSE 200 END || '.' WHEN 1 THEN 'The sitemap answered with ' || CASE WHEN k % 5 = 1 THEN 500 ELSE 200 END || '.'
      WHEN 2 THEN coalesce(broken_count, 0) || ' of ' || coalesce(checked_count, 0) || ' checked links are broken.' WHEN 3 THEN 'robots.txt names 0 sitemaps.' ELSE n || ' of ' || m || ' discovered urls were analysed.' END AS note
    FROM v, (VALUES (0), (1), (2), (3), (4)) t(p)""",
)
def _(spark, folder):
    f = R.stored_features(spark, folder)
    answers = R.resources(spark, folder)
    status = lambda kind: answers.filter(F.col("kind") == kind).select("site", F.col("status_code").alias(f"{kind}_status"))
    broken = links.broken_summary(links.checked_links(extract.edges(f), R.link_status(spark, folder)))
    crawl = site.crawl_coverage(f).join(status("robots"), "site", "left").join(status("sitemap"), "site", "left").join(broken, "site", "left")
    return report.evidence_notes(crawl.withColumn("declared_sitemaps", F.lit(None).cast("int"))).select("site", "pos", "note")
