"""Queries on urls, features and rules of single pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as O
from checks import recipes as R
from checks.registry import query
from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import scores as S
from pagewarden.functions import text as T
from pagewarden.functions import urls as U
from pagewarden.operators import extract, findings, inventory, page_health
from pagewarden.operators.rows import unnest
from pagewarden.sources import pages as P

_URL_PARTS = """
u AS (
  SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) s, regexp_extract(url, '^https?://([^/?#]*)', 1) h,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) q FROM pages
)"""


def _pages(spark, folder):
    return R.table(spark, folder, "pages")


@query(
    "url_normalize_crawl",
    f"""WITH {_URL_PARTS} SELECT page_id, s || '://' || lower(h) || CASE WHEN p IN ('', '/') THEN '/' ELSE rtrim(p, '/') END
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normalized FROM u""",
)
def _(spark, folder):
    return _pages(spark, folder).select("page_id", U.normalize_crawl_url(F.col("url")).alias("normalized"))


@query(
    "url_project_key",
    """SELECT page_id, rtrim(lower(trim(url)), '/') AS project_key, 'https://' || regexp_replace(url, '^https?://', '') AS with_scheme FROM pages""",
)
def _(spark, folder):
    bare = F.regexp_replace("url", "^https?://", "")
    return _pages(spark, folder).select(
        "page_id", U.project_key(F.col("url")).alias("project_key"), U.normalize_url(F.concat(F.lit(" "), bare)).alias("with_scheme")
    )


@query(
    "url_resolve",
    f"""WITH {_URL_PARTS}, n AS (SELECT page_id, s || '://' || h AS o, p, regexp_extract(p, '^(.*/)', 1) AS dir FROM u)
    SELECT page_id, o || '/a/b' AS absolute, o || dir || 'x?y=1' AS sibling,
      o || CASE WHEN regexp_matches(p, '^/[^/]*/[^/]*$') THEN '/up' WHEN regexp_matches(p, '^/[^/]*$') THEN '/up'
        ELSE regexp_replace(dir, '[^/]+/$', '') || 'up' END AS parent, 'https://other.example/z' AS other
    FROM n""",
)
def _(spark, folder):
    go = lambda href: U.resolve_url(F.col("url"), F.lit(href))
    return _pages(spark, folder).select(
        "page_id", go("/a/b").alias("absolute"), go("./x?y=1").alias("sibling"), go("../up").alias("parent"),
        go("https://other.example/z").alias("other"),
    )


def _type_case(rules) -> str:
    arms = " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{n}'" for n, w in rules)
    return f"CASE WHEN t = '' THEN 'Homepage' {arms} ELSE 'Other' END"


@query(
    "url_page_type",
    f"""WITH {O.DOCS}, t AS (SELECT doc_id AS page_id, trim(lower(path), '/') t FROM d)
    SELECT page_id, {_type_case(C.PAGE_TYPES)} AS page_type, {_type_case(C.PAGE_TYPES_SHORT)} AS page_type_short FROM t""",
)
def _(spark, folder):
    url = F.concat("origin", "path")
    return R.documents(spark, folder).select(
        F.col("doc_id").alias("page_id"), U.page_type(url).alias("page_type"),
        U.page_type(url, C.PAGE_TYPES_SHORT).alias("page_type_short"),
    )


@query(
    "url_structure",
    f"""WITH {_URL_PARTS}, v AS (
      SELECT page_id, url, p, q FROM u
      UNION ALL SELECT -1 - doc_id, origin || path || CASE WHEN q = 0 THEN '/a/b/c/d/' || lower(replace(s1, ' ', '-')) ELSE '' END,
        path || CASE WHEN q = 0 THEN '/a/b/c/d/' || lower(replace(s1, ' ', '-')) ELSE '' END, '' FROM (WITH {O.DOCS} SELECT * FROM d)
    ), c AS (
      SELECT page_id, length(url) n, q <> '' has_q, regexp_matches(p, '\\p{{Lu}}') upper, contains(p, '_') under,
        length(trim(p, '/')) > 20 AND NOT contains(p, '-') flat, regexp_matches(p, '[^a-zA-Z0-9\\-/.%]') special,
        len(list_filter(string_split(p, '/'), lambda x: x <> '')) depth FROM v
    )
    SELECT page_id, CAST(greatest(0, 100 - CASE WHEN n > 115 THEN 15 WHEN n > 75 THEN 5 ELSE 0 END - CASE WHEN has_q THEN 15 ELSE 0 END
      - CASE WHEN upper THEN 10 ELSE 0 END - CASE WHEN under THEN 5 WHEN flat THEN 5 ELSE 0 END - CASE WHEN special THEN 10 ELSE 0 END
      - CASE WHEN depth > 5 THEN 5 ELSE 0 END) AS INT) AS score, CAST(depth AS INT) AS depth,
      CAST((n > 75)::INT + has_q::INT + upper::INT + (under OR flat)::INT + special::INT + (depth > 5)::INT AS INT) AS issues FROM c""",
)
def _(spark, folder):
    docs = R.documents(spark, folder)
    deep = F.when(F.col("q") == 0, F.concat(F.lit("/a/b/c/d/"), F.lower(F.replace("sentence1", F.lit(" "), F.lit("-"))))).otherwise("")
    urls = _pages(spark, folder).select("page_id", "url").unionByName(
        docs.select((-1 - F.col("doc_id")).alias("page_id"), F.concat("origin", "path", deep).alias("url"))
    )
    return urls.select("page_id", U.url_structure(F.col("url")).alias("s")).select(
        "page_id", "s.score", "s.depth", F.size("s.issues").alias("issues")
    )


def rule_case(rules, first, other) -> str:
    arms = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{v}'" for p, v in rules)
    return f"CASE WHEN t = '' THEN '{first}' {arms} ELSE '{other}' END"


@query(
    "sitemap_rules",
    f"""WITH {O.DOCS}, t AS (SELECT doc_id AS page_id, rtrim(lower(path), '/') t FROM d)
    SELECT page_id, {rule_case(C.SITEMAP_PRIORITIES, '1.00', '0.50')} AS priority,
      {rule_case(C.SITEMAP_FREQUENCIES, 'daily', 'monthly')} AS changefreq FROM t""",
)
def _(spark, folder):
    url = F.concat("origin", "path")
    return R.documents(spark, folder).select(
        F.col("doc_id").alias("page_id"), U.sitemap_priority(url).alias("priority"), U.sitemap_changefreq(url).alias("changefreq")
    )


@query(
    "url_registrable_label",
    f"""WITH {_URL_PARTS}, h AS (
      SELECT page_id, v, list_filter(string_split(string_split(lower(h) || v, ':')[1], '.'), lambda x: x <> '' AND x <> 'www') a
      FROM u, (VALUES (''), ('.co.uk:8080'), (':443')) t(v))
    SELECT page_id, v AS suffix, CASE WHEN len(a) >= 3 AND length(a[-1]) = 2 AND a[-2] IN {O.sql_in(C.COMPOUND_SECOND_LEVELS)} THEN a[-3] ELSE a[-2] END AS label FROM h""",
)
def _(spark, folder):
    suffix = F.explode(F.array(F.lit(""), F.lit(".co.uk:8080"), F.lit(":443")))
    base = _pages(spark, folder).select("page_id", "url", suffix.alias("suffix"))
    return base.select(
        "page_id", "suffix", U.registrable_label(F.concat(F.lit("http://"), U.netloc(F.col("url")), F.col("suffix"), F.lit("/x"))).alias("label")
    )


@query(
    "company_name",
    f"""WITH {O.DOCS}, t AS (
      SELECT doc_id AS page_id, 'site' || k AS label, [trim(s1), trim(s2), CASE WHEN q = 1 THEN 'Site' || k || ' home' ELSE '' END] raw FROM d),
    p AS (SELECT page_id, label, list_filter(flatten(list_transform(raw, lambda r: list_transform(string_split_regex(r, '\\s*[|:\\-–—]\\s*'), lambda z: trim(z)))), lambda z: z <> '') parts FROM t)
    SELECT page_id, coalesce(list_filter(parts, lambda z: contains(regexp_replace(lower(z), '[^a-z0-9]+', '', 'g'), label))[1],
      list_filter(parts, lambda z: len(string_split_regex(z, '\\s+')) <= 6)[-1], parts[1], upper(label[1]) || label[2:]) AS company_name FROM p""",
)
def _(spark, folder):
    title = F.concat_ws(" | ", "sentence1", "sentence2", F.when(F.col("q") == 1, F.concat(F.lit("Site"), F.col("k").cast("string"), F.lit(" home"))))
    return R.documents(spark, folder).select(
        F.col("doc_id").alias("page_id"), U.company_name(F.concat("origin", "path"), title).alias("company_name")
    )


@query(
    "url_same_domain",
    f"""WITH {_URL_PARTS}, b AS (SELECT *, regexp_replace(lower(h), '^[^.]+\\.', '') AS base FROM u)
    SELECT page_id, lower(h) = base OR ends_with(lower(h), '.' || base) OR ends_with(base, '.' || lower(h)) AS parent_domain,
      lower(h) LIKE '%.example.org' OR lower(h) = 'example.org' AS in_example_org FROM b""",
)
def _(spark, folder):
    base = F.regexp_replace(U.host(F.col("url")), r"^[^.]+\.", "")
    return _pages(spark, folder).select(
        "page_id", U.same_domain(base, F.col("url")).alias("parent_domain"),
        U.same_domain(F.lit("Example.org"), F.col("url")).alias("in_example_org"),
    )


@query(
    "url_skipped",
    f"""WITH {_URL_PARTS}, e AS (SELECT page_id, s, p, v FROM u, (VALUES (''), ('.JPG'), ('.woff2'), ('.gzip')) t(v))
    SELECT page_id, v AS suffix, regexp_matches(lower(p || v), '\\.({'|'.join(C.SKIP_EXTENSIONS)})$') AS skipped, true AS skipped_mail FROM e""",
)
def _(spark, folder):
    suffix = F.explode(F.array(F.lit(""), F.lit(".JPG"), F.lit(".woff2"), F.lit(".gzip")))
    rows = _pages(spark, folder).select("page_id", "url", suffix.alias("suffix"))
    long = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.col("suffix"))
    return rows.select(
        "page_id", "suffix", U.is_skipped(long).alias("skipped"), U.is_skipped(F.concat(F.lit("MAILTO:"), F.col("url"))).alias("skipped_mail")
    )


@query(
    "url_valid",
    f"""WITH {_URL_PARTS} SELECT page_id, regexp_matches(h, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z]+$') AS valid,
    contains(split_part(h, '.', 1), '-') = false AND length(h) > 0 AS first_label, false AS number_last FROM u""",
)
def _(spark, folder):
    host = U.netloc(F.col("url"))
    broken = F.concat(F.lit("http://"), F.replace(F.element_at(F.split(host, r"\."), 1), F.lit("-"), F.lit("--_")), F.lit(".example.com:80/x"))
    return _pages(spark, folder).select(
        "page_id", U.is_valid_url(F.col("url")).alias("valid"), U.is_valid_url(broken).alias("first_label"),
        U.is_valid_url(F.concat(host, F.lit(".12"))).alias("number_last"),
    )


# --- numbers ------------------------------------------------------------------
@query(
    "numbers_clamp_divide_format",
    f"""SELECT l_orderkey, l_linenumber, {O.clamp('l_quantity * 3 - 20')} AS clamped,
      CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity / (l_linenumber - 1) END AS divided,
      {O.fmt('l_quantity * 2.5::DOUBLE')} AS formatted,
      CASE WHEN l_linenumber <= 3 THEN '0%' ELSE {O.fmt('(l_quantity / (l_linenumber - 3)) * 100')} END AS ratio FROM lineitem""",
)
def _(spark, folder):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", N.clamp(q * 3 - 20).alias("clamped"), N.safe_divide(q, n - 1).alias("divided"),
        N.format_percentage(q * 2.5).alias("formatted"), N.format_ratio(q, n - 3).alias("ratio"),
    )


@query(
    "numbers_attainment",
    f"""SELECT l_orderkey, l_linenumber, {O.attain('CAST(l_quantity AS INT)', 20, 30)} AS in_range,
      CASE WHEN l_quantity >= 35 THEN 100 ELSE {O.clamp('(l_quantity / 35) * 100')} END AS at_least,
      {O.at_most('l_quantity', 30)} AS at_most FROM lineitem""",
)
def _(spark, folder):
    q = F.col("l_quantity")
    return R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", N.range_attainment(q.cast("int"), 20, 30).alias("in_range"),
        N.minimum_attainment(q, 35).alias("at_least"), N.maximum_attainment(q, 30).alias("at_most"),
    )


@query(
    "numbers_status_priority",
    f"""SELECT l_orderkey, l_linenumber, {O.status('l_quantity * 2')} AS status, {O.prio('l_quantity * 2')} AS priority,
      CASE WHEN l_returnflag = 'R' THEN 'High' ELSE {O.prio('l_quantity * 2')} END AS hard FROM lineitem""",
)
def _(spark, folder):
    score = F.col("l_quantity") * 2
    return R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", N.status_from_score(score).alias("status"), N.priority_from_score(score).alias("priority"),
        N.priority_from_score(score, F.col("l_returnflag") == "R").alias("hard"),
    )


@query(
    "numbers_weighted_score",
    f"""SELECT l_orderkey, l_linenumber, {O.rnd('(0::DOUBLE + l_quantity * 30 + (l_discount * 1000) * 20 + (l_tax * 1000) * 50) / 100')} AS score FROM lineitem""",
)
def _(spark, folder):
    scores = {"a": F.col("l_quantity"), "b": F.col("l_discount") * 1000, "c": F.col("l_tax") * 1000}
    return R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", N.weighted_score(scores, {"a": 30, "b": 20, "c": 50}).alias("score")
    )


@query(
    "numbers_tolerant_count",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS from_text, 0 AS from_junk,
      CAST(len(string_split(event_type, 'i')) AS INT) AS from_list, CAST(greatest(0, trunc(value - 10)) AS INT) AS from_number,
      CAST(event_type = 'click' AS INT) AS from_flag FROM events""",
)
def _(spark, folder):
    return R.table(spark, folder, "events").select(
        "event_id", N.tolerant_count(F.get_json_object("props", "$.k"), "string").alias("from_text"),
        N.tolerant_count(F.col("event_type"), "string").alias("from_junk"),
        N.tolerant_count(F.split("event_type", "i"), "array").alias("from_list"),
        N.tolerant_count(F.col("value") - 10, "number").alias("from_number"),
        N.tolerant_count(F.col("event_type") == "click", "boolean").alias("from_flag"),
    )


# --- text ---------------------------------------------------------------------
@query(
    "text_terms",
    f"""SELECT doc_id, CAST(len({O.terms('text')}) AS INT) AS n_terms, array_to_string(list_sort(list_distinct({O.terms('text')})), ' ') AS terms,
      CAST(len(list_distinct({O.terms('text', C.PROFILE_STOPWORDS)})) AS INT) AS n_profile_terms FROM documents""",
)
def _(spark, folder):
    terms = T.terms(F.col("text"))
    return R.table(spark, folder, "documents").select(
        "doc_id", F.size(terms).alias("n_terms"), F.array_join(F.array_sort(F.array_distinct(terms)), " ").alias("terms"),
        F.size(F.array_distinct(T.terms(F.col("text"), C.PROFILE_STOPWORDS))).alias("n_profile_terms"),
    )


@query(
    "text_main_keyword",
    f"""WITH {O.DOCS} SELECT doc_id, CASE WHEN q = 1 AND s1 <> '' THEN s1 ELSE array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 5), ' ') END AS keyword FROM d""",
)
def _(spark, folder):
    keywords = F.when(F.col("q") == 1, F.array(F.lit("  "), F.col("sentence1"))).otherwise(F.array(F.lit("")))
    return R.documents(spark, folder).select("doc_id", T.main_keyword(keywords, F.col("text")).alias("keyword"))


@query(
    "text_snippet",
    "SELECT doc_id, CASE WHEN length(text) > 150 THEN text[:150] || '...' ELSE text END AS snippet FROM documents",
)
def _(spark, folder):
    return R.table(spark, folder, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


# --- fetch results and speed ---------------------------------------------------
@query(
    "fetch_failure_class",
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) + 400 AS c, event_type FROM events)
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'timeout' WHEN event_type = 'signup' THEN 'redirect_loop' WHEN event_type = 'click' THEN 'network'
      WHEN c IN (401, 403, 405) THEN 'blocked' WHEN c = 404 THEN 'missing' WHEN c = 429 THEN 'rate_limited'
      WHEN c BETWEEN 500 AND 599 THEN 'server' ELSE 'client' END AS failure FROM e""",
)
def _(spark, folder):
    code = F.get_json_object("props", "$.k").cast("int") + 400
    kind = F.when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "signup", "too_many_redirects").when(F.col("event_type") == "click", "dns")
    return R.table(spark, folder, "events").select(
        "event_id", S.fetch_failure(F.when(kind.isNull(), code), kind).alias("failure")
    )


@query(
    "link_status_broken",
    f"""WITH {O.DOCS}, l AS (SELECT origin || path AS url, CASE WHEN q = 0 THEN 404 WHEN x = 1 THEN 0 ELSE 200 END AS status_code FROM d WHERE doc_id % 7 <> 3)
    SELECT url, status_code, status_code = 0 OR status_code >= 400 AS is_broken FROM l""",
)
def _(spark, folder):
    return R.link_status(spark, folder).withColumn("is_broken", S.is_broken(F.col("status_code")))


_SPEED = """
e AS (SELECT event_id, user_id, value / 10 AS t, CAST(json_extract_string(props, '$.k') AS INT) * 10 AS kb FROM events),
b AS (SELECT *, CASE WHEN t < 0.4 THEN 98 WHEN t < 0.7 THEN 90 WHEN t < 1.1 THEN 75 WHEN t < 1.8 THEN 55 WHEN t < 3.0 THEN 30 ELSE 10 END
  - CASE WHEN kb > 800 THEN 15 WHEN kb > 400 THEN 8 ELSE 0 END AS base FROM e),
v AS (SELECT *, CAST(greatest(5, least(100, base - 15)) AS INT) AS mobile, CAST(greatest(5, least(100, base)) AS INT) AS desktop FROM b)"""
_SPEED_STATUS = "CASE WHEN {0} >= 90 THEN 'Fast' WHEN {0} >= 70 THEN 'Moderate' ELSE 'Slow' END"


@query(
    "page_speed_score",
    f"""WITH {_SPEED} SELECT event_id, mobile AS mobile_score, desktop AS desktop_score, {_SPEED_STATUS.format('mobile')} AS mobile_status,
      {_SPEED_STATUS.format('desktop')} AS desktop_status, {O.rnd('t * 1.8::DOUBLE', 2)} AS mobile_load, {O.rnd('t * 1.2::DOUBLE', 2)} AS desktop_load FROM v""",
)
def _(spark, folder):
    rows = R.speed(spark, folder)
    s = rows.select(
        "event_id", S.speed(F.col("ttfb"), F.col("size_kb"), True).alias("m"), S.speed(F.col("ttfb"), F.col("size_kb"), False).alias("d")
    )
    return s.select(
        "event_id", F.col("m.score").alias("mobile_score"), F.col("d.score").alias("desktop_score"), F.col("m.status").alias("mobile_status"),
        F.col("d.status").alias("desktop_status"), F.col("m.load_time").alias("mobile_load"), F.col("d.load_time").alias("desktop_load"),
    )


@query(
    "page_speed_finding",
    f"""WITH {_SPEED} SELECT event_id, mobile::DOUBLE AS score, {O.status('mobile')} AS status, {O.prio('mobile', 50, 90)} AS priority FROM v""",
)
def _(spark, folder):
    rows = R.speed(spark, folder).withColumn("_s", S.speed(F.col("ttfb"), F.col("size_kb"), True)["score"])
    f = findings.page_speed_finding(F.col("_s"), F.col("ttfb"), F.col("size_kb"))
    return rows.select("event_id", f.alias("f")).select("event_id", "f.score", "f.status", "f.priority")


@query(
    "content_tiers",
    f"""WITH w AS (SELECT doc_id, CAST({O.words('text')} AS INT) n FROM documents)
    SELECT doc_id, n AS words, CASE WHEN n < 300 THEN 'Low' WHEN n <= 800 THEN 'Average' ELSE 'High' END AS tier,
      CASE WHEN n < 300 THEN 40 WHEN n < 800 THEN 70 ELSE 100 END AS light_points,
      CASE WHEN n >= 300 THEN 'Good' WHEN n >= 100 THEN 'Thin' ELSE 'Very Thin' END AS thin,
      CASE WHEN n % 100 >= 80 THEN 'Excellent' WHEN n % 100 >= 60 THEN 'Good' WHEN n % 100 >= 40 THEN 'Needs Attention' ELSE 'Poor' END AS label FROM w""",
)
def _(spark, folder):
    from pagewarden.functions.html import count_words

    w = R.table(spark, folder, "documents").select("doc_id", count_words(F.col("text")).alias("words"))
    n = F.col("words")
    return w.select(
        "doc_id", "words", S.content_tier(n).alias("tier"), S.content_points(n, False).alias("light_points"),
        S.thin_content_label(n).alias("thin"), S.score_label(n % 100).alias("label"),
    )


# --- features of the given pages ------------------------------------------------
_ENT = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"


def _plain(x: str) -> str:
    return f"replace({_ENT.format(x)}, '&amp;', '&')"


@query(
    "page_title",
    f"""WITH t AS (SELECT page_id, {_plain("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1))")} AS title FROM pages)
    SELECT page_id, title, length(title) AS title_length FROM t""",
)
def _(spark, folder):
    return R.raw_features(spark, folder).select("page_id", "title", F.col("title_length").cast("bigint").alias("title_length"))


@query(
    "page_headings",
    f"""WITH h AS (SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<h1[^>]*>(.*?)</h1>', 1),
      lambda z: {_plain("trim(regexp_replace(z, '\\s*(<[^>]*>\\s*)+', ' ', 'g'))")}) h1,
      len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<h[2-6][^>]*>.*?</h[2-6]>')) n FROM pages)
    SELECT page_id, array_to_string(h1, ' / ') AS h1, CAST(len(h1) AS INT) AS h1_count, CAST(n AS INT) AS other_headings FROM h""",
)
def _(spark, folder):
    others = sum((F.size(f"headings.h{n}") for n in range(3, 7)), F.size("headings.h2"))
    return R.raw_features(spark, folder).select(
        "page_id", F.array_join("headings.h1", " / ").alias("h1"), "h1_count", others.alias("other_headings")
    )


def _strip_blocks(x: str) -> str:
    for tag in C.EXCLUDED_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    return x


@query(
    "page_word_count",
    f"""WITH t AS (SELECT page_id, {_plain("regexp_replace(" + _strip_blocks("regexp_replace(html, '(?s)<!--.*?(-->|$)', ' ', 'g')") + ", '<[^>]*>', ' ', 'g')")} AS v FROM pages)
    SELECT page_id, CAST({O.words('v')} AS INT) AS word_count FROM t""",
)
def _(spark, folder):
    return R.raw_features(spark, folder).select("page_id", "word_count")


@query(
    "page_links",
    """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages)
    SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || CASE WHEN h = '/' THEN '/' ELSE rtrim(regexp_replace(h, '#.*$', ''), '/') END AS dst_url,
      trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS anchor, true AS is_internal
    FROM (SELECT *, replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') h FROM a)""",
)
def _(spark, folder):
    return extract.edges(R.raw_features(spark, folder)).select("page_id", "pos", "dst_url", "anchor", "is_internal")


# --- features of the authored pages ---------------------------------------------
def _feature_query(name, columns, sql):
    @query(name, f"WITH {O.FEATURES} SELECT page_id, {sql} FROM features")
    def run(spark, folder):
        return R.features(spark, folder).select("page_id", *(columns() if callable(columns) else columns))


_feature_query(
    "meta_tags",
    ["title", "description", "meta_description_length", "has_viewport_meta", "robots_directives", "is_indexable", "og_title", "og_description", "og_image", "twitter_card"],
    """title, description, meta_description_length::INT AS meta_description_length, has_viewport_meta, CASE WHEN x = 1 THEN 'noindex, nofollow' ELSE '' END AS robots_directives,
    is_indexable, og_title, CASE WHEN lang = 'en' THEN s2 ELSE '' END AS og_description, CASE WHEN lang = 'de' THEN '/og' || page_id || '.png' ELSE '' END AS og_image,
    CASE WHEN lang = 'fr' THEN 'summary' ELSE '' END AS twitter_card""",
)
_feature_query(
    "canonical_url", ["url", "canonical_url", "has_canonical"],
    "url, CASE WHEN has_canonical THEN origin || path ELSE '' END AS canonical_url, has_canonical",
)
_feature_query(
    "images",
    lambda: ["total_images", F.array_join("missing_alt_images", " ").alias("missing"), "missing_alt_count"],
    """total_images, array_to_string(list_slice(['inline-image', '/m1.png', '/m2.png'], 1, missing_alt_count), ' ') AS missing, missing_alt_count""",
)
_feature_query("follow_counts", ["dofollow_links", "nofollow_links"], "dofollow_links, nofollow_links")
_feature_query("social_tags", ["has_open_graph", "has_twitter_card"], "has_open_graph, has_twitter_card")
_feature_query(
    "structured_data_types",
    lambda: [F.array_join(F.array_sort("structured_data_types"), " ").alias("types"), "has_structured_data"],
    """CASE WHEN lang = 'en' AND q = 1 THEN 'LocalBusiness' WHEN lang IN ('de', 'fr') THEN 'Person article' WHEN lang = 'es' THEN 'Microdata' ELSE '' END AS types,
    has_structured_data""",
)
_feature_query(
    "favicon",
    lambda: ["favicon.status", F.col("favicon.url").alias("favicon_url")],
    """CASE WHEN lang IN ('en', 'de') THEN 'Present' ELSE 'Missing' END AS status,
    CASE lang WHEN 'en' THEN origin || regexp_replace(path, '[^/]*$', '') || 'i.png' WHEN 'de' THEN origin || '/s.ico' ELSE '' END AS favicon_url""",
)
_feature_query("page_authority", ["word_count", "page_authority"], "word_count, page_authority")


@query(
    "link_lists",
    f"""WITH {O.LINKS} SELECT page_id, array_to_string(list(url ORDER BY pos) FILTER (WHERE internal), ' ') AS internal_links,
      coalesce(array_to_string(list(url ORDER BY pos) FILTER (WHERE NOT internal), ' '), '') AS external_links,
      array_to_string(list_sort(list_distinct(list(anchor) FILTER (WHERE internal))), '|') AS anchors,
      array_to_string(list_sort(list_distinct(list(regexp_extract(url, '//([^/?]*)', 1)) FILTER (WHERE NOT internal))), ' ') AS domains
    FROM first_links GROUP BY page_id""",
)
def _(spark, folder):
    return R.features(spark, folder).select(
        "page_id", F.array_join("internal_links", " ").alias("internal_links"), F.array_join("external_links", " ").alias("external_links"),
        F.array_join(F.array_sort("internal_link_anchors"), "|").alias("anchors"), F.array_join(F.array_sort("external_domains"), " ").alias("domains"),
    )


@query(
    "edges",
    f"WITH {O.LINKS} SELECT page_id, site, CAST(pos AS INT) AS pos, url AS dst_url, nofollow, anchor, internal AS is_internal FROM links",
)
def _(spark, folder):
    return R.graph(spark, folder).drop("src_url")


@query(
    "distinct_edges",
    f"WITH {O.LINKS} SELECT page_id, site, src_url, url AS dst_url, internal AS is_internal, CAST(pos AS INT) AS pos FROM first_links",
)
def _(spark, folder):
    return extract.distinct_edges(R.graph(spark, folder))


@query(
    "phone_numbers",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{C.PHONE_PATTERN}'))), '|') AS phones FROM documents""",
)
def _(spark, folder):
    return R.table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.array_sort(extract.phone_numbers(F.col("text"))), "|").alias("phones")
    )


@query("city_mention", "SELECT doc_id, contains(lower(text), lower('The')) AS mentioned, contains(lower(text), lower('Ément')) AS accented FROM documents")
def _(spark, folder):
    say = lambda c: extract.mentions_city(F.col("text"), F.lit(c))
    return R.table(spark, folder, "documents").select("doc_id", say("The").alias("mentioned"), say("Ément").alias("accented"))


@query("local_schema", f"WITH {O.DOCS} SELECT doc_id AS page_id, lang = 'en' AND q = 1 AS has_local, lang IN ('de', 'fr') AS has_person FROM d")
def _(spark, folder):
    t = F.col("structured_data_types")
    return R.features(spark, folder).select(
        "page_id", extract.has_local_schema(t).alias("has_local"), extract.has_local_schema(t, ["Person"]).alias("has_person")
    )


@query(
    "location_links",
    f"""WITH {O.LINKS} SELECT page_id, CAST(count(*) FILTER (WHERE regexp_matches(lower(url), 'contact|location|about')) AS INT) AS location_links
    FROM first_links WHERE internal GROUP BY page_id""",
)
def _(spark, folder):
    return R.features(spark, folder).select("page_id", F.size(extract.location_links(F.col("internal_links"))).alias("location_links"))


@query(
    "html_pages_only",
    f"WITH {O.DOCS} SELECT doc_id AS page_id, lang FROM d WHERE lang <> 'fr'",
)
def _(spark, folder):
    kind = F.when(F.col("lang") == "fr", "application/pdf").when(F.col("lang") == "de", "TEXT/HTML; charset=utf-8")
    return P.html_only(R.documents(spark, folder).withColumn("content_type", kind)).select(F.col("doc_id").alias("page_id"), "lang")


# --- rules ----------------------------------------------------------------------
def _audited(spark, folder):
    return findings.page_audit(R.features(spark, folder))


@query(
    "page_findings",
    f"WITH {O.AUDIT} SELECT page_id, metric_pos, module, category, metric, score, priority, {O.status('score')} AS status FROM long",
)
def _(spark, folder):
    return findings.findings(_audited(spark, folder)).select(
        "page_id", "metric_pos", "module", "category", "metric", "score", "priority", "status"
    )


@query("failing_findings", f"WITH {O.AUDIT} SELECT page_id, metric, score FROM long WHERE score < 80")
def _(spark, folder):
    return findings.failing(findings.findings(_audited(spark, folder))).select("page_id", "metric", "score")


@query(
    "page_audit",
    f"""WITH {O.AUDIT}, low AS (SELECT * FROM breakdown QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score, pos) = 1)
    SELECT a.page_id, a.site, metadata_score, headings_score, technical_score, links_score, accessibility_score, overall_score,
      {O.fmt('overall_score')} AS overall_seo_health,
      CASE WHEN low.score < 80 THEN upper(low.module[1]) || low.module[2:] || ': ' || low.reason ELSE 'None' END AS key_issue
    FROM audit a JOIN low ON low.page_id = a.page_id""",
)
def _(spark, folder):
    return _audited(spark, folder).select(
        "page_id", "site", "metadata_score", "headings_score", "technical_score", "links_score", "accessibility_score",
        "overall_score", "overall_seo_health", "key_issue",
    )


@query("score_breakdown", f"WITH {O.AUDIT} SELECT page_id, module, score, impact, reason FROM breakdown")
def _(spark, folder):
    return unnest(_audited(spark, folder), "score_breakdown", "b", ["page_id"]).select("page_id", "b.*")


@query(
    "module_issues",
    f"""WITH {O.AUDIT} SELECT b.page_id, b.module, b.score, coalesce(array_to_string(list(l.metric ORDER BY l.metric_pos), '|'), '') AS issues
    FROM breakdown b LEFT JOIN long l ON l.page_id = b.page_id AND l.module = b.module AND l.score < 80 GROUP BY ALL""",
)
def _(spark, folder):
    return findings.module_issues(_audited(spark, folder)).select("page_id", "module", "score", F.array_join("issues", "|").alias("issues"))


@query(
    "page_findings_by_priority",
    f"""WITH {O.AUDIT} SELECT page_id, metric, priority, row_number() OVER (PARTITION BY page_id ORDER BY {O.rank('priority')}, metric_pos) AS place FROM long""",
)
def _(spark, folder):
    order = F.array_sort(
        F.transform("findings", lambda f: F.struct(N.priority_rank(f["priority"]).alias("r"), f["metric_pos"].alias("p"), f["metric"].alias("metric"), f["priority"].alias("priority")))
    )
    return unnest(_audited(spark, folder), order, "f", ["page_id"], "i").select(
        "page_id", "f.metric", "f.priority", (F.col("i") + 1).cast("bigint").alias("place")
    )


@query(
    "evidence",
    f"""WITH {O.FEATURES} SELECT site, page_id, url, 'H1 tags: ' || h1_count AS observation, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank
    FROM features WHERE h1_count <> 1 QUALIFY rank <= 3""",
)
def _(spark, folder):
    rows = findings.evidence(
        R.features(spark, folder), "H1 Compliance", F.col("h1_count") != 1, F.concat(F.lit("H1 tags: "), F.col("h1_count").cast("string"))
    )
    return rows.select("site", "page_id", "url", "observation", F.col("rank").cast("bigint").alias("rank"))


@query(
    "page_info",
    f"""WITH {O.FEATURES} SELECT page_id, coalesce(nullif(title, ''), 'N/A') AS title, coalesce(nullif(description, ''), 'Not Found') AS meta_description,
      CASE WHEN has_canonical THEN origin || path ELSE 'Not Found' END AS canonical, CASE WHEN is_indexable THEN 'Indexable' ELSE 'Noindex' END AS indexing_status FROM features""",
)
def _(spark, folder):
    return page_health.page_info(R.features(spark, folder)).drop("site", "url")


SUMMARY = (
    O.FEATURES
    + f""",
p0 AS (SELECT *, 0.8::DOUBLE + word_count / 2000.0::DOUBLE + total_images * 0.1::DOUBLE AS base FROM features),
p1 AS (SELECT *, {O.rnd('base * 1.5::DOUBLE', 2)} AS mload, {O.rnd('base * 1.0::DOUBLE', 2)} AS dload FROM p0),
p2 AS (SELECT *, CAST(trunc({O.clamp('100 - mload * 10')}) AS INT) AS mobile_score, CAST(trunc({O.clamp('100 - dload * 5')}) AS INT) AS desktop_score FROM p1),
p3 AS (SELECT *,
  list_filter([CASE WHEN description = '' THEN 'Missing meta description' END, CASE WHEN NOT is_indexable THEN 'Page is marked noindex' END], lambda z: z IS NOT NULL) AS critical,
  list_filter([CASE WHEN h1_count = 0 THEN 'No H1 heading found' END, CASE WHEN mobile_score < 50 OR desktop_score < 50 THEN 'Slow page load performance' END], lambda z: z IS NOT NULL) AS high,
  list_filter([CASE WHEN h1_count > 1 THEN 'Multiple H1 headings detected' END, CASE WHEN word_count < 300 THEN 'Low word count (' || word_count || ' words)' END,
    CASE WHEN missing_alt_count > 0 THEN 'Missing alt tags on ' || missing_alt_count || ' images' END], lambda z: z IS NOT NULL) AS medium
  FROM p2),
p4 AS (SELECT *, (100 + CASE WHEN has_viewport_meta THEN 100 ELSE 50 END + 100)::DOUBLE / 3 AS tech,
  (CASE WHEN title <> '' AND title_length > 10 AND title_length < 70 THEN 100 ELSE 50 END + CASE WHEN description <> '' THEN 100 ELSE 0 END
    + CASE h1_count WHEN 1 THEN 100 WHEN 0 THEN 0 ELSE 50 END)::DOUBLE / 3 AS onpage,
  CASE WHEN word_count < 300 THEN 40 WHEN word_count <= 800 THEN 70 ELSE 100 END::DOUBLE AS content,
  (mobile_score + desktop_score) / 2.0::DOUBLE AS perf,
  greatest(0, 100 - len(critical) * 15 - len(high) * 10 - len(medium) * 5)::DOUBLE AS iss FROM p3)"""
)


@query(
    "page_health",
    f"""WITH {SUMMARY} SELECT page_id, CAST(greatest(1, least(100, {O.rint('0::DOUBLE + tech * 0.25::DOUBLE + onpage * 0.2::DOUBLE + content * 0.2::DOUBLE + perf * 0.2::DOUBLE + iss * 0.15::DOUBLE')})) AS INT) AS seo_score,
      CAST(trunc(tech) AS INT) AS technical, CAST(trunc(onpage) AS INT) AS onpage, CAST(trunc(content) AS INT) AS content,
      CAST(trunc(perf) AS INT) AS performance, CAST(trunc(iss) AS INT) AS issues FROM p4""",
)
def _(spark, folder):
    return page_health.page_summary(R.features(spark, folder)).select("page_id", "seo_score", "scores.*")


@query(
    "issue_buckets",
    f"""WITH {SUMMARY} SELECT page_id, array_to_string(critical, '|') AS critical, array_to_string(high, '|') AS high, array_to_string(medium, '|') AS medium,
      coalesce(critical[1], high[1], medium[1], 'None') AS priority_action FROM p4""",
)
def _(spark, folder):
    rows = page_health.page_summary(R.features(spark, folder))
    return rows.select(
        "page_id", *[F.array_join(f"issues.{b}", "|").alias(b) for b in ("critical", "high", "medium")], "priority_action"
    )


@query(
    "load_estimate",
    f"""WITH {SUMMARY} SELECT page_id, mload AS mobile_load, dload AS desktop_load, mobile_score, desktop_score,
      CASE WHEN mobile_score >= 90 THEN 'Fast' WHEN mobile_score >= 50 THEN 'Moderate' ELSE 'Slow' END AS mobile_status FROM p4""",
)
def _(spark, folder):
    rows = page_health.page_summary(R.features(spark, folder))
    return rows.select(
        "page_id", F.col("mobile.load_time").alias("mobile_load"), F.col("desktop.load_time").alias("desktop_load"), "mobile_score", "desktop_score",
        F.col("mobile.status").alias("mobile_status"),
    )


@query(
    "light_audit",
    f"""WITH {O.FEATURES}, a AS (SELECT page_id, {O.attain('title_length', 50, 60)} AS t, {O.attain('meta_description_length', 140, 160)} AS m,
      CASE WHEN word_count < 300 THEN 40 WHEN word_count < 800 THEN 70 ELSE 100 END AS w, has_viewport_meta FROM features)
    SELECT page_id, t AS title_score, m AS description_score, (t + m) / 2 AS metadata_health, w AS word_count_score,
      CASE WHEN w < 50 THEN 'Low' ELSE 'High' END AS quality, true AS https, has_viewport_meta AS mobile_friendly, 100 AS technical_score FROM a""",
)
def _(spark, folder):
    return page_health.light_audit(R.features(spark, folder)).drop("site", "url")


CHECKLIST = (
    O.FEATURES
    + """,
i0 AS (
  SELECT page_id, site, url, unnest([
    CASE WHEN title_length = 0 THEN 'High:Missing Title Tag' WHEN title_length < 30 THEN 'Medium:Title Too Short (' || title_length || ' chars)' WHEN title_length > 65 THEN 'Low:Title Too Long (' || title_length || ' chars)' END,
    CASE WHEN meta_description_length = 0 THEN 'High:Missing Meta Description' WHEN meta_description_length < 80 THEN 'Medium:Meta Description Too Short (' || meta_description_length || ' chars)'
      WHEN meta_description_length > 165 THEN 'Low:Meta Description Too Long (' || meta_description_length || ' chars)' END,
    CASE WHEN h1_count = 0 THEN 'High:Missing H1 Tag' WHEN h1_count > 1 THEN 'Medium:Multiple H1 Tags (' || h1_count || ' found)' END,
    CASE WHEN word_count < 100 THEN 'High:Very Low Word Count (' || word_count || ' words)' WHEN word_count < 300 THEN 'Medium:Low Word Count (' || word_count || ' words)' END,
    CASE WHEN NOT has_canonical THEN 'Medium:Missing Canonical Tag' END, CASE WHEN NOT has_viewport_meta THEN 'High:Missing Viewport Meta Tag' END,
    CASE WHEN NOT is_indexable THEN 'High:Page Blocked from Indexing (noindex)' END,
    CASE WHEN total_images > 0 AND missing_alt_count > 0 THEN 'Medium:Images Missing Alt Text (' || missing_alt_count || '/' || total_images || ')' END,
    CASE WHEN internal_links_count < 3 THEN 'Medium:Very Few Internal Links (' || internal_links_count || ')' END,
    CASE WHEN NOT has_structured_data THEN 'Low:No Structured Data (Schema Markup)' END, CASE WHEN og_title = '' THEN 'Low:Missing Open Graph Tags' END
  ]) AS v FROM features
),
issues AS (SELECT page_id, site, url, split_part(v, ':', 1) AS severity, substr(v, strpos(v, ':') + 1) AS issue FROM i0 WHERE v IS NOT NULL),
scored AS (
  SELECT *, CAST(greatest(0, least(100, 100
    - CASE WHEN title_length = 0 THEN 20 WHEN title_length < 30 OR title_length > 70 THEN 8 ELSE 0 END
    - CASE WHEN meta_description_length = 0 THEN 15 WHEN meta_description_length < 80 OR meta_description_length > 170 THEN 6 ELSE 0 END
    - CASE WHEN h1_count = 0 THEN 15 WHEN h1_count > 1 THEN 7 ELSE 0 END - CASE WHEN word_count < 100 THEN 10 WHEN word_count < 300 THEN 5 ELSE 0 END
    - CASE WHEN has_canonical THEN 0 ELSE 10 END - CASE WHEN has_viewport_meta THEN 0 ELSE 10 END
    - CASE WHEN total_images > 0 AND missing_alt_count > 0 THEN least(5, round_even(missing_alt_count::DOUBLE / total_images * 5, 0)) ELSE 0 END
    - CASE WHEN internal_links_count < 3 THEN 5 ELSE 0 END - CASE WHEN has_structured_data THEN 0 ELSE 3 END - CASE WHEN og_title = '' THEN 2 ELSE 0 END)) AS INT) AS score
  FROM features
)"""
)


@query("checklist_issues", f"WITH {CHECKLIST} SELECT page_id, issue, severity FROM issues")
def _(spark, folder):
    return page_health.page_issues(R.features(spark, folder)).select("page_id", "issue", "severity")


@query(
    "deduction_score",
    f"""WITH {CHECKLIST} SELECT s.page_id, score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Needs Attention' ELSE 'Poor' END AS label,
      CAST(count(i.page_id) AS INT) AS issue_count FROM scored s LEFT JOIN issues i ON i.page_id = s.page_id GROUP BY ALL""",
)
def _(spark, folder):
    return page_health.page_scores(R.features(spark, folder)).drop("site", "url")


INVENTORY = (
    O.FEATURES
    + """,
inv AS (
  SELECT *, title <> '' AND count(*) OVER (PARTITION BY site, title) > 1 AS dup_t, description <> '' AND count(*) OVER (PARTITION BY site, description) > 1 AS dup_m,
    row_number() OVER (PARTITION BY site ORDER BY page_id) AS s_no FROM features
),
inv2 AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN title = '' THEN 'Missing Title' WHEN title_length < 50 THEN 'Title Too Short' WHEN title_length > 60 THEN 'Title Too Long' END,
    CASE WHEN description = '' THEN 'Missing Meta Description' WHEN meta_description_length < 140 THEN 'Meta Too Short' WHEN meta_description_length > 160 THEN 'Meta Too Long' END,
    CASE WHEN dup_t THEN 'Duplicate Title' END, CASE WHEN dup_m THEN 'Duplicate Meta Description' END], lambda z: z IS NOT NULL), ', ') AS st FROM inv
)"""
)


@query(
    "metadata_inventory",
    f"""WITH {INVENTORY} SELECT s_no, site, page_id, coalesce(nullif(title, ''), 'Not Found') AS title, title_length::INT AS title_length,
      meta_description_length::INT AS meta_desc_length, CASE WHEN st = '' THEN 'Good' ELSE st END AS status, st <> '' AS has_issue FROM inv2""",
)
def _(spark, folder):
    return inventory.inventory(R.stored_features(spark, folder)).select(
        "s_no", "site", "page_id", "title", "title_length", "meta_desc_length", "status", "has_issue"
    )


@query(
    "metadata_totals",
    f"""WITH {INVENTORY} SELECT site, count(*) AS total_pages, count(*) FILTER (WHERE title = '') AS missing_titles, count(*) FILTER (WHERE title <> '' AND title_length < 50) AS short_titles,
      count(*) FILTER (WHERE title_length > 60) AS long_titles, count(*) FILTER (WHERE description = '') AS missing_metas,
      count(*) FILTER (WHERE description <> '' AND meta_description_length < 140) AS short_metas, count(*) FILTER (WHERE meta_description_length > 160) AS long_metas,
      count(*) FILTER (WHERE dup_t) AS duplicate_titles, count(*) FILTER (WHERE dup_m) AS duplicate_metas FROM inv2 GROUP BY site""",
)
def _(spark, folder):
    return inventory.inventory_totals(inventory.inventory(R.stored_features(spark, folder)))


@query(
    "user_rules",
    f"""WITH {O.FEATURES} SELECT page_id, 'long_page' AS rule, 'Content' AS category, {O.clamp('word_count / 10.0::DOUBLE')} AS score FROM features WHERE word_count > 500
    UNION ALL SELECT page_id, 'no_image', 'Images', 0::DOUBLE FROM features WHERE total_images = 0""",
)
def _(spark, folder):
    rules = findings.RuleSet()
    rules.add("long_page", "Content", F.col("word_count") > 500, "Long page.", F.col("word_count") / F.lit(10.0))
    rules.add("no_image", "Images", F.col("total_images") == 0, "No image.")
    return rules.apply(R.features(spark, folder)).select("page_id", "rule", "category", "score")
