"""SQL pieces of the oracle queries: expected values in closed form for DuckDB."""

from __future__ import annotations

from checks.recipes import SECTIONS
from pagewarden import constants as C

TOKEN = C.WORD_PATTERN.replace("'", "''")


def rnd(x: str, digits: int = 1) -> str:
    """Rounding of the exact binary value, ties to even, by printing."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def rint(x: str) -> str:
    return f"round_even({x}, 0)"


def pct(m: str, t: str) -> str:
    return f"(CASE WHEN {t} > 0 THEN {rnd(f'(({m})::DOUBLE / ({t})) * 100')} ELSE 0.0::DOUBLE END)"


def clamp(x: str) -> str:
    return f"greatest(0::DOUBLE, least(({x})::DOUBLE, 100::DOUBLE))"


def status(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'Good' WHEN {x} >= 80 THEN 'At Benchmark' WHEN {x} >= 50 THEN 'Needs Improvement' ELSE 'Critical Gap' END"


def prio(x: str, high: float = 40, medium: float = 80) -> str:
    return f"CASE WHEN {x} < {high} THEN 'High' WHEN {x} < {medium} THEN 'Medium' ELSE 'Low' END"


def rank(p: str, other: int = 99) -> str:
    return f"CASE {p} WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE {other} END"


def fmt(x: str) -> str:
    v = clamp(x)
    return f"CASE WHEN {v} = floor({v}) THEN printf('%d%%', CAST({v} AS BIGINT)) ELSE printf('%.1f%%', {v}) END"


def attain(n: str, low: int, high: int) -> str:
    return (
        f"CASE WHEN {n} <= 0 THEN 0::DOUBLE WHEN {n} BETWEEN {low} AND {high} THEN 100::DOUBLE "
        f"WHEN {n} < {low} THEN ({n}::DOUBLE / {low}) * 100 ELSE ({high}::DOUBLE / {n}) * 100 END"
    )


def at_most(x: str, m: float) -> str:
    return f"CASE WHEN {x} <= {m} THEN 100::DOUBLE ELSE {clamp(f'100 - (({x} - {m}) / {m}::DOUBLE) * 100')} END"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def terms(x: str, stop: list[str] = C.STOPWORDS) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN {sql_in(stop)})"


def path_of(doc: str) -> str:
    k = f"CAST(floor(sqrt(({doc})::DOUBLE)) AS BIGINT)"
    return (
        f"CASE WHEN ({doc}) = {k} * {k} THEN '/' ELSE '/' || {sql_list(SECTIONS)}[CAST(({doc}) % {len(SECTIONS)} AS INT) + 1] "
        f"|| CAST(({doc}) AS VARCHAR) END"
    )


# documents with the columns of recipes.documents
DOCS = f"""
d0 AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, coalesce(l.quality, -1) q, coalesce(l.toxic, 0) x,
         CAST(floor(sqrt(d.doc_id::DOUBLE)) AS BIGINT) k,
         trim(regexp_extract(d.text, '^\\s*([^.!?\\n]*)', 1)) s1,
         trim(regexp_extract(d.text, '^\\s*[^.!?\\n]*[.!?\\n]+\\s*([^.!?\\n]*)', 1)) s2
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
d AS MATERIALIZED (
  SELECT *, doc_id - k * k AS j, 'www.site' || k || '.example.org' AS site, 'https://www.site' || k || '.example.org' AS origin,
         {path_of('doc_id')} AS path, CASE WHEN q = 0 AND x = 1 THEN '' ELSE s1 END AS title,
         CASE WHEN lang = 'fr' THEN '' ELSE s2 END AS description
  FROM d0
)"""

# links of the authored pages, in page order, with resolved urls
LINKS = (
    DOCS
    + f""",
links AS MATERIALIZED (
  SELECT * EXCLUDE (nominal), doc_id AS page_id, origin || path AS src_url,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nominal) - 1 AS INT) AS pos FROM (
    SELECT d.*, 0 nominal, origin || '/' url, false nofollow, 'Home page' anchor, true internal FROM d
    UNION ALL SELECT d.*, 1, origin || {path_of('k * k + j // 2')}, false, 'Up', true FROM d
    UNION ALL SELECT d.*, 2, origin || {path_of('k * k + j * 2 + 1')}, false, 'Child one', true FROM d
      WHERE j * 2 + 1 < k * 2 + 1 AND (j * 2 + 1) % 5 <> 4
    UNION ALL SELECT d.*, 3, origin || {path_of('k * k + j * 2 + 2')}, false, 'Child two', true FROM d
      WHERE j * 2 + 2 < k * 2 + 1 AND (j * 2 + 2) % 5 <> 4
    UNION ALL SELECT d.*, 4, origin || {path_of('k * k + j // 2')}, q = 0, 'Again', true FROM d
    UNION ALL SELECT d.*, 5, 'https://ext' || (doc_id % 11) || '.example.net/a?q=1', x = 1, 'Out', false FROM d
    UNION ALL SELECT d.*, 6, 'mailto:', false, 'Mail', false FROM d
    UNION ALL SELECT d.*, 7, 'https://site' || k || '.example.org/shared', false, 'Shared', true FROM d WHERE lang = 'en'
    UNION ALL SELECT d.*, 8, 'http://blog.site' || k || '.example.org/', false, 'Blog', false FROM d WHERE q = 1
  ) QUALIFY url <> 'mailto:'
),
first_links AS MATERIALIZED (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)"""
)

_COUNTS = """
link_counts AS (
  SELECT page_id, CAST(count(*) FILTER (WHERE internal) AS INT) internal_links_count,
         CAST(count(*) FILTER (WHERE NOT internal) AS INT) external_links_count
  FROM first_links GROUP BY page_id
),
follow_counts AS (
  SELECT page_id, CAST(count(*) FILTER (WHERE NOT nofollow) AS INT) dofollow_links,
         CAST(count(*) FILTER (WHERE nofollow) AS INT) nofollow_links,
         CAST(sum(len(string_split(anchor, ' ')) * (CASE WHEN pos = 0 THEN 0 ELSE 1 END)) AS INT) anchor_words
  FROM links GROUP BY page_id
)"""

# scalar features of the authored pages
FEATURES = (
    LINKS
    + ","
    + _COUNTS
    + f""",
f0 AS (
  SELECT d.doc_id AS page_id, d.site, d.origin || d.path AS url, d.*, f.dofollow_links, f.nofollow_links,
         l.internal_links_count, l.external_links_count,
         length(d.title) AS title_length, length(d.description) AS meta_description_length,
         n_chars > 300 AS has_canonical, q = 1 AS has_viewport_meta, x <> 1 AS is_indexable,
         CASE lang WHEN 'de' THEN 2 WHEN 'es' THEN 0 ELSE 1 END AS h1_count,
         CAST({words('d.s1')} * (CASE lang WHEN 'de' THEN 2 WHEN 'es' THEN 0 ELSE 1 END) + {words('d.s2')} + {words('d.text')}
           + f.anchor_words + 4 AS INT) AS word_count,
         CAST(d.doc_id % 6 AS INT) AS total_images, CAST(least(d.doc_id % 3, d.doc_id % 6) AS INT) AS missing_alt_count,
         lang IN ('en', 'de') AS has_open_graph, lang = 'fr' AS has_twitter_card,
         CASE WHEN lang IN ('en', 'de') THEN s1 ELSE '' END AS og_title,
         (lang = 'en' AND q = 1) OR lang IN ('de', 'fr', 'es') AS has_structured_data
  FROM d JOIN follow_counts f ON f.page_id = d.doc_id JOIN link_counts l ON l.page_id = d.doc_id
),
features AS MATERIALIZED (
  SELECT *, CAST(greatest(0, least(100, 20
      + CASE WHEN word_count > 2000 THEN 30 WHEN word_count > 1000 THEN 22 WHEN word_count > 500 THEN 14 WHEN word_count > 200 THEN 7 ELSE 0 END
      + CASE WHEN internal_links_count > 50 THEN 25 WHEN internal_links_count > 20 THEN 18 WHEN internal_links_count > 10 THEN 12 WHEN internal_links_count >= 3 THEN 6 ELSE 0 END
      + CASE WHEN has_structured_data THEN 6 ELSE 0 END + CASE WHEN has_open_graph THEN 4 ELSE 0 END
      + CASE WHEN total_images > 0 THEN 5 ELSE 0 END
      - CASE WHEN external_links_count > 50 AND external_links_count > internal_links_count * 3 THEN 15
             WHEN external_links_count > 20 AND external_links_count > internal_links_count * 2 THEN 7 ELSE 0 END)) AS INT) AS page_authority
  FROM f0
)"""
)

_density = pct("internal_links_count", "internal_links_count + external_links_count")

# the nine findings in long form and the page audit
AUDIT = (
    FEATURES
    + f""",
m AS (
  SELECT *, {attain('title_length', 50, 60)} AS r1, {attain('meta_description_length', 140, 160)} AS r2,
    {_density} AS density, {pct('total_images - missing_alt_count', 'total_images')} AS alt_pct,
    (CASE WHEN dofollow_links + nofollow_links > 0 THEN nofollow_links::DOUBLE / (dofollow_links + nofollow_links) ELSE 0 END)::DOUBLE AS ratio
  FROM features
),
m2 AS (SELECT *, CASE WHEN density >= 65 THEN 100::DOUBLE ELSE {rnd('(density / 65) * 100')} END AS attained FROM m),
s AS MATERIALIZED (
  SELECT *,
    CASE WHEN title_length = 0 THEN 0 WHEN r1 < 50 THEN greatest(0, r1 - 15) ELSE r1 END::DOUBLE AS f1,
    CASE WHEN meta_description_length = 0 THEN 0 WHEN r2 < 60 THEN greatest(0, r2 - 10) ELSE r2 END::DOUBLE AS f2,
    CASE WHEN has_canonical THEN 100 ELSE 0 END::DOUBLE AS f3,
    CASE h1_count WHEN 1 THEN 100 WHEN 0 THEN 0 ELSE greatest(0, 100 - (h1_count - 1) * 30) END::DOUBLE AS f4,
    CASE WHEN has_viewport_meta THEN 100 ELSE 0 END::DOUBLE AS f5,
    page_authority::DOUBLE AS f6,
    CASE WHEN ratio <= 0.5 THEN 100 ELSE greatest(0, 100 - (ratio - 0.5::DOUBLE) * 200) END::DOUBLE AS f7,
    CASE WHEN internal_links_count + external_links_count = 0 THEN 0 WHEN internal_links_count < 5 THEN greatest(0, attained - 50)
         WHEN external_links_count > 100 THEN greatest(0, attained - 20) ELSE attained END::DOUBLE AS f8,
    CASE WHEN total_images <= 0 THEN 100 WHEN alt_pct < 40 THEN greatest(0, alt_pct - 10) ELSE alt_pct END::DOUBLE AS f9
  FROM m2
),
long AS MATERIALIZED (
  SELECT page_id, site, url, 1 metric_pos, 'metadata' AS module, 'Metadata' category, 'Title Optimization' metric, f1 score,
    CASE WHEN title_length = 0 OR r1 < 50 THEN 'High' WHEN r1 < 90 THEN 'Medium' ELSE 'Low' END priority FROM s
  UNION ALL SELECT page_id, site, url, 2, 'metadata', 'Metadata', 'Meta Description', f2,
    CASE WHEN meta_description_length = 0 OR r2 < 60 THEN 'High' WHEN r2 < 90 THEN 'Medium' ELSE 'Low' END FROM s
  UNION ALL SELECT page_id, site, url, 3, 'metadata', 'Technical', 'Canonical Tag', f3, CASE WHEN has_canonical THEN 'Low' ELSE 'High' END FROM s
  UNION ALL SELECT page_id, site, url, 4, 'headings', 'Headings', 'Heading Structure', f4, CASE WHEN h1_count = 1 THEN 'Low' ELSE 'High' END FROM s
  UNION ALL SELECT page_id, site, url, 5, 'technical', 'Technical', 'Mobile-First Readiness', f5, CASE WHEN has_viewport_meta THEN 'Low' ELSE 'High' END FROM s
  UNION ALL SELECT page_id, site, url, 6, 'technical', 'Technical', 'Domain Authority', f6, {prio('f6', 40, 70)} FROM s
  UNION ALL SELECT page_id, site, url, 7, 'links', 'Links', 'Link Type Distribution', f7, {prio('f7', 50, 90)} FROM s
  UNION ALL SELECT page_id, site, url, 8, 'links', 'Links', 'Internal Link Density', f8,
    CASE WHEN internal_links_count + external_links_count = 0 OR internal_links_count < 5 OR external_links_count > 100 OR attained < 50 THEN 'High'
         WHEN attained < 80 THEN 'Medium' ELSE 'Low' END FROM s
  UNION ALL SELECT page_id, site, url, 9, 'accessibility', 'Accessibility', 'Image Accessibility', f9,
    CASE WHEN total_images <= 0 THEN 'Low' WHEN alt_pct < 40 THEN 'High' WHEN alt_pct < 80 THEN 'Medium' ELSE 'Low' END FROM s
),
modules AS (
  SELECT page_id, site, url, {rnd('(f1 + f2 + f3) / 3')} metadata_score, {rnd('f4')} headings_score, {rnd('(f5 + f6) / 2')} technical_score,
    100::DOUBLE performance_score, {rnd('(f7 + f8) / 2')} links_score, {rnd('f9')} accessibility_score FROM s
),
audit AS MATERIALIZED (
  SELECT *, {rnd('(0::DOUBLE + metadata_score * 20 + headings_score * 20 + technical_score * 20 + performance_score * 15 + links_score * 15 + accessibility_score * 10) / 100')} overall_score
  FROM modules
),
breakdown AS MATERIALIZED (
  SELECT v.page_id, v.site, v.url, v.pos, v.module, v.score, coalesce(f.priority, 'Low') impact, coalesce(f.metric, 'No major issues') reason
  FROM (
    SELECT page_id, site, url, 1 pos, 'metadata' AS module, metadata_score score FROM audit
    UNION ALL SELECT page_id, site, url, 2, 'headings', headings_score FROM audit
    UNION ALL SELECT page_id, site, url, 3, 'technical', technical_score FROM audit
    UNION ALL SELECT page_id, site, url, 4, 'performance', performance_score FROM audit
    UNION ALL SELECT page_id, site, url, 5, 'links', links_score FROM audit
    UNION ALL SELECT page_id, site, url, 6, 'accessibility', accessibility_score FROM audit
  ) v LEFT JOIN (
    SELECT page_id, lower(category) c, metric, priority FROM long WHERE score < 80
    QUALIFY row_number() OVER (PARTITION BY page_id, category ORDER BY metric_pos) = 1
  ) f ON f.page_id = v.page_id AND f.c = v.module
)"""
)
