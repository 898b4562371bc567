"""Numbers, urls and text on hand-made values."""

from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import numbers as N
from pagewarden.functions import scores as S
from pagewarden.functions import text as T
from pagewarden.functions import urls as U
from pagewarden.operators import compare, local, profile


def values(spark, rows, schema, column):
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("v"))
    return [r.v for r in out.orderBy("i").collect()]


def test_round_half_even_is_exact(spark):
    numbers = [86.35, 86.25, 0.15, 2.675, 0.05, 1e-9, 99.95, 33.349999999999994] + [i / 7 * 10 for i in range(200)] + [i / 40 for i in range(400)]
    for digits in (1, 2):
        got = values(spark, [(x,) for x in numbers], "x double", N.round_half_even(F.col("x"), digits))
        assert got == [round(x, digits) for x in numbers]


def test_attainment_and_labels(spark):
    got = values(spark, [(0,), (25,), (50,), (60,), (120,)], "n int", N.range_attainment(F.col("n"), 50, 60))
    assert got == [0.0, 50.0, 100.0, 100.0, 50.0]
    got = values(spark, [(95.0,), (85.0,), (50.0,), (10.0,)], "x double", F.concat_ws("/", N.status_from_score(F.col("x")), N.priority_from_score(F.col("x"))))
    assert got == ["Good/Low", "At Benchmark/Low", "Needs Improvement/Medium", "Critical Gap/High"]
    assert values(spark, [(5.0,), (1.0,), (3.0,)], "x double", N.maximum_attainment(F.col("x"), 2)) == [0.0, 100.0, 50.0]
    assert values(spark, [(62.5,), (62.0,), (140.0,), (-1.0,)], "x double", N.format_percentage(F.col("x"))) == ["62.5%", "62%", "100%", "0%"]


def test_tolerant_count(spark):
    rows = [("7",), ("-3",), ("x",), (None,)]
    assert values(spark, rows, "s string", N.tolerant_count(F.col("s"), "string")) == [7, 0, 0, 0]
    assert values(spark, [(["a", "b"],), (None,)], "a array<string>", N.tolerant_count(F.col("a"), "array")) == [2, 0]


HREFS = [
    "", "x", "./x", "../x", "../../x", "../../../x", "/a/../b", "/a/./b/", "//h.example/p", "http://o.example/x/../y", "?q=1", "#f",
    "a//b", "x/..", "x/.", "..", ".", "a/b/../../c?d=/../e#f", "mailto:a@b.example", "javascript:void(0)", "tel:12", "a:b",
]


@pytest.mark.parametrize("base", ["https://ex.example/a/b/c?z=1", "https://ex.example/", "http://ex.example/dir/"])
def test_resolve_agrees_with_the_standard_library(spark, base):
    got = values(spark, [(base, h) for h in HREFS], "b string, h string", U.resolve_url(F.col("b"), F.col("h")))
    for href, url in zip(HREFS, got):
        assert urldefrag(url).url == urldefrag(urljoin(base, href)).url, (base, href)


def test_normalize_validate_and_classify(spark):
    rows = [("HTTPS://Ex.COM/a/b//?q#f",), ("https://ex.com",), (" https://ex.com/ ",), ("https://ex.com/A?x=1#y",)]
    assert values(spark, rows, "u string", U.normalize_crawl_url(F.col("u"))) == [
        "https://ex.com/a/b?q", "https://ex.com/", "https://ex.com/", "https://ex.com/A?x=1"]
    urls = ["example.com", "https://localhost:80/x", "http://127.0.0.1", "http://[::1]/", "http://[1::2::3]/", "http://a", "http://-a.com", "ftp://a.com",
            "http://a.b.9", "http://256.1.1.1", "", "http://user@ex.com./p", "http://a_b.com"]
    assert values(spark, [(u,) for u in urls], "u string", U.is_valid_url(F.col("u"))) == [
        True, True, True, True, False, False, False, False, False, False, False, True, False]
    urls = ["https://x.com/", "https://x.com/book-a-demo", "https://x.com/Team", "https://x.com/insights/1", "https://x.com/platform", "https://x.com/zz"]
    assert values(spark, [(u,) for u in urls], "u string", U.page_type(F.col("u"))) == [
        "Homepage", "Contact/Conversion", "About/Trust", "Blog/Resource", "Service/Product", "Other"]


def test_domains_and_names(spark):
    rows = [("ex.com", "https://a.ex.com/"), ("www.ex.com", "https://ex.com/"), ("ex.com", "https://notex.com/"), ("ex.com", "https://EX.com")]
    assert values(spark, rows, "b string, u string", U.same_domain(F.col("b"), F.col("u"))) == [True, True, False, True]
    rows = [("https://www.acme-corp.co.uk/", "Home | Acme Corp"), ("https://x.io/", "Some long page title with very many words - Short one"), ("https://my-shop2go.com/", "")]
    assert values(spark, rows, "u string, t string", U.company_name(F.col("u"), F.col("t"))) == ["Acme Corp", "Short one", "My Shop2Go"]


def test_url_structure_points(spark):
    url = "https://ex.com/A_b/c d?x=1"
    s = values(spark, [(url,)], "u string", U.url_structure(F.col("u")))[0]
    assert (s.score, s.issues, s.is_seo_friendly) == (60, ["query", "uppercase", "underscore", "special"], False)


def test_failure_and_speed(spark):
    rows = [(403, None), (404, None), (429, None), (503, None), (418, None), (None, "timeout"), (None, "too_many_redirects"), (None, "x")]
    assert values(spark, rows, "s int, k string", S.fetch_failure(F.col("s"), F.col("k"))) == [
        "blocked", "missing", "rate_limited", "server", "client", "timeout", "redirect_loop", "network"]
    got = values(spark, [(0.3, 900.0), (5.0, 900.0)], "t double, k double", S.speed(F.col("t"), F.col("k"), True))
    assert [(g.score, g.status) for g in got] == [(68, "Slow"), (5, "Slow")]


@pytest.mark.parametrize(
    "kind, url, status, mime, body, want",
    [
        ("robots", "https://x.com/", 200, "text/plain", "User-agent: *", "Invalid (Redirected to homepage)"),
        ("robots", "https://x.com/robots.txt", 404, "text/plain", "x", "Missing"),
        ("robots", "https://x.com/robots.txt", 200, "text/plain", " ", "Invalid (Empty response)"),
        ("robots", "https://x.com/robots.txt", 200, "text/plain", "<HTML>", "Invalid (HTML response)"),
        ("robots", "https://x.com/robots.txt", 200, "application/json", "Disallow:", "Invalid (Wrong Content-Type)"),
        ("robots", "https://x.com/robots.txt", 200, "text/plain", "hello", "Invalid (Missing directives)"),
        ("robots", "https://x.com/robots.txt", 200, "text/plain", "Disallow: /", "Found (Valid)"),
        ("robots", "https://x.com/robots.txt", 0, None, None, "Missing"),
        ("sitemap", "https://x.com/sitemap.xml", 200, "application/xml", "<feed/>", "Invalid (Missing XML structure)"),
        ("sitemap", "https://x.com/sitemap.xml", 200, "text/xml", "<UrlSet></UrlSet>", "Found (Valid)"),
    ],
)
def test_resource_verdict(spark, kind, url, status, mime, body, want):
    row = [(url, status, mime, body)]
    cols = [F.col(c) for c in "usmb"]
    assert values(spark, row, "u string, s int, m string, b string", S.resource_verdict(kind, *cols)) == [want]


def test_phrases_and_terms(spark):
    row = [([" A  b ", "a B", "", "-c |", "d"],)]
    assert values(spark, row, "a array<string>", T.distinct_phrases(F.col("a"), 3)) == [["A b", "-c |", "d"]]
    assert values(spark, row, "a array<string>", T.distinct_phrases(F.col("a"), 3, r" \-|:")) == [["A b", "c", "d"]]
    got = values(spark, [("web web shop the shop web art",)], "t string", profile.common_terms(F.col("t"), 2))
    assert got == [["Web", "Shop"]]


def test_opportunities_and_consistency(spark):
    raw = spark.createDataFrame(
        [("s", 0, "a", "12", "Low"), ("s", 1, " ", "5", ""), ("s", 2, "b", "x", "Odd"), ("s", 3, "c", "8", None)],
        "site string, pos int, keyword string, market_opportunity_score string, priority string",
    )
    got = [(r.keyword, r.market_opportunity_score, r.priority) for r in compare.clean_opportunities(raw, "site").orderBy("rank").collect()]
    assert got == [("a", 10, "Low"), ("c", 8, "High"), ("b", 1, "Low")]
    rows = [("(555) 1", ["5551"], "https://www.a.com/", "a.com/x"), ("1", ["2"], "https://a.com", "b.com"), ("", [], "", "b.com")]
    score = local.consistency_score(F.col("p"), F.col("f"), F.col("u"), F.col("w"))
    assert values(spark, rows, "p string, f array<string>, u string, w string", score) == [100.0, 30.0, 100.0]
