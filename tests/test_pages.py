"""Extraction and rules on hand-made pages."""

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import extract, findings, inventory, links, page_health, site
from pagewarden.operators.ranking import numbered

RICH = """<!DOCTYPE html><html><head><title> A &amp; B &eacute;&#8364;&#x41; </title><META content='Desc > here' NAME=Description>
<meta name="robots" content="NOINDEX"><link rel="Canonical" href="/c/?a=1#f"><link rel="shortcut icon" href="/s.ico"><link rel=icon href=i.png>
<link rel="apple-touch-icon" href="data:x"><script type="application/ld+json">{"@graph":[{"@type":"Article"},{"@type":["Person","article",3]},[{"@graph":[{"@type":"Deep"}]}]]}</script>
<script type="application/ld+json">{bad</script><meta property="og:title" content="OG"></head>
<body itemscope><!-- <h1>no</h1> --><nav>menu item</nav><h1>Hello <b>big</b> world</h1><h1>2</h1><p>It's well-known naïve été<div style="color:red; display: none">hid den</div>.</p>
<img src="a.png" title="x > y"><img alt="x" src=b.png><img alt=" ">
<a href="../x/./y/">One  <b>two</b></a><a href="?q=1" rel="NoFollow">q</a><a href="//other.com">o</a><a href="mailto:a@b">m</a><a href="../x/y#z">again</a>
<a href="">self</a><a name=n>none</a><a href='sub//p'>sp</a><a href="https://sub.ex.com/">sub</a></body></html>"""
THIN = "<html><head><title>Page</title></head><body><nav>only menu words</nav></body></html>"
BROKEN = "<TITLE>t</TITLE><p don't><H1 class=x>Up<h2>two</h2><a href=/p>open <a href='/q'>next<img alt=\"it's\" src=x>"


@pytest.fixture(scope="module")
def features(spark):
    pages = spark.createDataFrame(
        [(1, "https://Ex.com/a/b/page", RICH), (2, "https://ex.com/thin", THIN), (3, "http://ex.com/broken", BROKEN)],
        "page_id bigint, url string, html string",
    )
    return extract.page_features(pages).cache()


@pytest.fixture(scope="module")
def rows(features):
    return {r.page_id: r for r in features.collect()}


def test_rich_page(rows):
    r = rows[1]
    assert r.url == "https://ex.com/a/b/page" and r.site == "ex.com"
    assert r.title == "A & B é€A" and r.description == "Desc > here"
    assert r.canonical_url == "https://ex.com/c?a=1" and r.robots_directives == "noindex" and not r.is_indexable
    assert r.favicon.url == "https://ex.com/a/b/i.png"
    assert r.headings.h1 == ["Hello big world", "2"] and r.word_count == 18
    assert r.missing_alt_images == ["a.png", "inline-image"] and r.total_images == 3
    assert r.internal_links == ["https://ex.com/a/x/y", "https://ex.com/a/b/page?q=1", "https://ex.com/a/b/page", "https://ex.com/a/b/sub/p", "https://sub.ex.com/"]
    assert r.internal_link_anchors == ["One two", "q", "self", "sp", "sub"]
    assert r.external_domains == ["other.com"] and (r.dofollow_links, r.nofollow_links) == (6, 1)
    assert r.structured_data_types == ["Deep", "Person", "article", "Microdata"]
    assert r.has_open_graph and not r.has_twitter_card and not r.has_viewport_meta


def test_thin_and_broken_pages(rows):
    assert rows[2].word_count == 3  # nothing is visible, so the whole body counts
    assert rows[3].title == "t" and rows[3].headings.h1 == ["Up"] and rows[3].headings.h2[0].startswith("two")
    assert rows[3].internal_links == ["http://ex.com/p", "http://ex.com/q"] and rows[3].missing_alt_count == 0


def _one(spark, html):
    return extract.page_features(spark.createDataFrame([(1, "https://s.com/", html)], "page_id bigint, url string, html string")).first()


def test_script_text_is_no_markup(spark):
    r = _one(spark, """<body><script>document.write("<a href='/fake'>x</a><h1>no</h1><img src=q>"); var c = '<!-- start';</script><h1>Yes</h1><a href="/real">go</a><style>/* <h2>no</h2> */</style></body>""")
    assert r.headings.h1 == ["Yes"] and r.headings.h2 == [] and r.total_images == 0 and r.internal_links == ["https://s.com/real"]
    r = _one(spark, "<h1>A</h1><!-- <script> --><h2>B</h2><script>var never = '<h1>ends</h1>'")
    assert (r.headings.h1, r.headings.h2) == (["A"], ["B"])


def test_nested_exclusion_and_open_elements(spark):
    count = lambda html: _one(spark, html).word_count
    assert count("<body><div style='display: none'>a <div>b</div> c</div>seen</body>") == 1
    assert count("<body><nav>a<nav>b</nav>c</nav>seen</body>") == 1
    assert count("<body><div><form>a <p>b</p></div>seen <b>two</b></body>") == 2
    assert count("<body><form>a<br>b</form>seen<footer>x") == 1
    r = _one(spark, "<H1 class=x>Up<p>text</p>")
    assert r.headings.h1 == ["Up text"]


def test_nested_structured_data_keeps_order_and_spelling(spark):
    deep = "[" * 9 + '{"@graph": [' * 9 + '{"@type": "Deep"}' + "]}" * 9 + "]" * 9
    r = _one(spark, f'''<script type="application/ld+json">[{{"@type": "Article"}}, {{"@type": ["Person", "article"]}}, {deep}]</script>''')
    assert r.structured_data_types == ["Deep", "Person", "article"]


def test_broken_markup_takes_linear_time(spark):
    import time

    for part in ("<h1>", "<form>", "<a ", "<title>", '<p a="'):
        took = []
        for n in (8_000, 8_000, 16_000):
            start = time.perf_counter()
            df = extract.page_features(spark.createDataFrame([(1, "https://s.com/", part * n)], "page_id bigint, url string, html string"))
            df.select("headings", "word_count", "title").collect()
            took.append(time.perf_counter() - start)
        assert took[2] < 2 * took[1] + 1.5, (part, took)


def test_page_audit(features):
    audited = findings.page_audit(features)
    r = {x.page_id: x for x in audited.collect()}
    assert [f.metric for f in r[1].findings][:3] == ["Title Optimization", "Meta Description", "Canonical Tag"]
    assert r[1].key_issue.startswith("Technical") or r[1].key_issue.startswith("Metadata")
    assert all(0 <= x.overall_score <= 100 for x in r.values())
    assert findings.findings(audited).count() == 27
    assert {b.module for b in r[2].score_breakdown} == {"metadata", "headings", "technical", "performance", "links", "accessibility"}


def test_external_heavy_page_loses_points(spark):
    internal, external, full = (F.lit(v) for v in (10, 150, 9.6))
    s = spark.range(1).select(findings.density_score(internal, external, full).alias("s")).first().s
    assert s == 0.0


def test_checklist_and_summary(features):
    issues = {r.issue for r in page_health.page_issues(features.filter("page_id = 2")).collect()}
    assert {"Title Too Short (4 chars)", "Missing Meta Description", "Missing H1 Tag", "Very Low Word Count (3 words)", "Missing Viewport Meta Tag"} <= issues
    s = page_health.page_summary(features).filter("page_id = 1").first()
    assert s.priority_action == "Page is marked noindex" and s.scores.technical == 83 and s.h1_content == "Hello big world"


def test_inventory_flags_repeated_titles(spark, features):
    doubled = features.unionByName(features.withColumn("page_id", F.col("page_id") + 10))
    got = {r.page_id: r for r in inventory.inventory(doubled).collect()}
    assert got[12].status == "Title Too Short, Missing Meta Description, Duplicate Title" and got[12].s_no == 5
    total = inventory.inventory_totals(inventory.inventory(doubled)).first()
    assert (total.total_pages, total.duplicate_titles, total.missing_metas) == (6, 6, 4)


def test_numbering_across_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("string").alias("k"), F.xxhash64("id").alias("i"))
    got = numbered(df, "k", ["i"])
    for key in ("true", "false"):
        mine = [r.s_no for r in got.filter(F.col("k") == key).orderBy("i").collect()]
        assert mine == list(range(1, len(mine) + 1))


def test_results_do_not_depend_on_partitions(features):
    one = {r.site: r for r in site.site_scores(features.coalesce(1)).collect()}
    many = {r.site: r for r in site.site_scores(features.repartition(7)).collect()}
    assert one == many


def test_reachability_by_buckets(spark):
    """A chain, a hub with many targets and a ring, far from each other in depth."""
    edges = [("s", f"c{i}", f"c{i + 1}") for i in range(25)] + [("s", "c3", f"leaf{i}") for i in range(300)] + [("s", f"leaf{i}", "c3") for i in range(300)]
    edges += [("t", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("t", "lost", "r0")]
    g = spark.createDataFrame([(s, a, b, True) for s, a, b in edges] + [("s", "c0", "out", False)], "site string, src_url string, dst_url string, is_internal boolean")
    start = spark.createDataFrame([("s", "c0"), ("t", "r2"), ("t", "r2"), ("u", "alone")], "site string, url string")
    found = links.reachability(start, g, buckets=16)
    want = {("s", f"c{i}"): i for i in range(26)} | {("s", f"leaf{i}"): 4 for i in range(300)} | {("t", f"r{(i + 2) % 5}"): i for i in range(5)} | {("u", "alone"): 0}
    got = [(r.site, r.url, r.depth) for r in found.collect()]
    assert {(s, u): d for s, u, d in got} == want and len(got) == len(want)
    runs = {f.rpartition("/")[0] for f in found.inputFiles()}
    assert len(runs) <= 6  # of 26 levels
    assert links.reachability(start.limit(0), g).count() == 0


def test_reachability_stores_a_level_once(spark, monkeypatch):
    """A binary tree with ways back: a level with little to leave out is one stored step."""
    edges = [(f"n{i}", f"n{2 * i + k}") for i in range(1, 64) for k in (0, 1)] + [(f"n{i}", f"n{i // 2}") for i in range(2, 128)] + [("n127", None)]
    g = spark.createDataFrame([("s", a, b, True) for a, b in edges], "site string, src_url string, dst_url string, is_internal boolean")
    start = spark.createDataFrame([("s", "n1"), (None, "n1")], "site string, url string")
    steps, kept = [], links.stored
    monkeypatch.setattr(links, "stored", lambda df, name: (steps.append(name), kept(df, name))[1])

    def found(**how):
        steps.clear()
        return sorted(((r.site, r.url, r.depth) for r in links.reachability(start, g, buckets=16, **how).collect()), key=str)

    want = [("s", f"n{i}", i.bit_length() - 1) for i in range(1, 128)] + [(None, "n1", 0), ("s", None, 7)]
    assert found() == sorted(want, key=str)
    assert steps.count("candidates") == 0 and steps.count("level") == 9 and steps.count("visited") <= 2
    assert found(few=0) == sorted(want, key=str)  # small levels leave out what they do not touch
    assert 0 < steps.count("candidates") < 8
    assert found(max_depth=3) == sorted([w for w in want if w[2] <= 3], key=str)


def test_repeated_flags_with_a_hot_value(spark):
    from pagewarden.operators.ranking import flag_repeated

    rows = [(i, "hot" if i % 2 else f"v{i // 8}", None if i % 50 == 0 else "x") for i in range(2000)] + [(9000, "once", "x"), (9001, None, "x"), (9002, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, title string, other string")
    got = {r.id: r.twice for r in flag_repeated(df, ["title"], "twice", hot_keys=5).collect()}
    assert len(got) == len(rows) and got[1] and got[0] and not got[9000] and not got[9001]
    assert flag_repeated(df.limit(0), ["title"], "twice").count() == 0
    ignored = flag_repeated(df, ["title"], "twice", ignore=F.col("title") == "hot", hot_keys=5)
    assert not {r.id: r.twice for r in ignored.collect()}[1] and ignored.columns == [*df.columns, "twice"]


def test_graph_operators(spark):
    edges = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "a", "b"), ("s", "x", "c"), ("t", "a", "z")]
    g = spark.createDataFrame([(s, i, a, b, 0, True) for i, (s, a, b) in enumerate(edges)], "site string, page_id int, src_url string, dst_url string, pos int, is_internal boolean")
    deg = {(r.site, r.dst_url): r.in_degree for r in links.in_degree(g).collect()}
    assert deg == {("s", "b"): 1, ("s", "c"): 2, ("s", "a"): 1, ("t", "z"): 1}
    start = spark.createDataFrame([("s", "a")], "site string, url string")
    reach = {r.url: r.depth for r in links.reachability(start, g).collect()}
    assert reach == {"a": 0, "b": 1, "c": 2}
    assert {r.url for r in links.reachability(start, g, max_depth=1).collect()} == {"a", "b"}
    assert {r.url for r in links.reachability(start, g, max_pages=2).collect()} == {"a", "b"}
    status = spark.createDataFrame([("b", 200), ("b", 200), ("b", None), ("c", 200), ("c", 404), ("c", 301)], "url string, status_code int")
    b = links.broken_summary(links.checked_links(g, status)).filter("site = 's'").first()
    assert (b.checked_count, b.broken_count, b.unknown_count, b.broken_ratio) == (2, 1, 1, 50.0)
    many = g.sparkSession.range(40).selectExpr("'s' site", "id page_id", "'a' src_url", "concat('t', id) dst_url", "0 pos", "true is_internal")
    late = many.selectExpr("dst_url url", "if(page_id < 20, 200, 404) status_code")
    assert links.broken_summary(links.checked_links(many, late)).first().broken_ratio == 50.0


def test_user_rules_and_evidence(features):
    rules = findings.RuleSet().add("long", "Content", F.col("word_count") > 10, "Long.", 150.0).add("none", "X", F.lit(False), "never")
    got = rules.apply(features).collect()
    assert [(r.page_id, r.rule, r.score) for r in got] == [(1, "long", 100.0)]
    seen = findings.evidence(features, "m", F.col("has_canonical") == False, F.lit("none"), 1).collect()  # noqa: E712
    assert [r.page_id for r in seen] == [2]


def test_extraction_takes_tokens_metas_and_urls_apart_once(spark):
    """A lambda evaluates an expression wherever its body names it; the words have to stay right."""
    from pagewarden.functions import html as H

    page = (
        "<p>don&apos;t it&#39;s a&amp;b &lt;c&gt; &amp;lt; &bogus; < 3 <3 x</p><nav>no <nav>no</nav> no</nav>"
        "<DIV Style='display: none'>no<br>no</DIV>é1 -x- _y<br/><p title='style'>z</nope><form><p>no</div> last"
    )
    df = spark.createDataFrame([(1, "https://ex.com/a", page)], "page_id int, url string, html string")
    words = df.select(H.visible_words(F.col("html")).alias("n"))
    assert words.first().n == 14
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^</?([a-zA-Z][^\s/>]*)") == 1
    metas = df.select(H.tags(F.col("html"), ["meta"]).alias("m")).select(H.parsed_metas(F.col("m")).alias("m"))
    asked = metas.select(*[H.meta_content(F.col("m"), "name", x).alias(x) for x in ("description", "robots", "viewport")])
    assert asked._jdf.queryExecution().optimizedPlan().toString().count(r"/]name\s*=") == 2  # nullif names its value twice
