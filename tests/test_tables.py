"""Sitemaps, stored audits, sources, sinks and streams."""

import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from pagewarden.operators import local, search, sitemap, store
from pagewarden.sources import sinks, tables
from pagewarden.streaming import progress

ROBOTS = "User-agent: bot\nDisallow: /all\nUSER-AGENT: *\nDisallow: /x\n disallow:  /y \nDisallow:\nAllow: /x/ok\nUser-agent: z\nDisallow: /z\nSitemap: ftp://no\nsitemap: https://s.com/i.xml\n"
INDEX = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://s.com/1.xml</loc></sitemap><sitemap><loc> https://s.com/2.xml </loc></sitemap><sitemap><loc>https://s.com/i.xml</loc></sitemap></sitemapindex>'
ONE = "<urlset><url><loc>https://s.com/a/</loc></url><url><loc>https://S.com/a#x</loc></url><url><loc>https://s.com/b</loc></url></urlset>"
BAD = "<urlset><url><loc>https://s.com/never</loc></url><url>"


def _resources(spark):
    rows = [
        ("s", "robots", "https://s.com/robots.txt", 200, "text/plain", ROBOTS), ("s", "sitemap", "https://s.com/i.xml", 200, "text/xml", INDEX),
        ("s", "sitemap", "https://s.com/1.xml", 200, "text/xml", ONE), ("s", "sitemap", "https://s.com/2.xml", 200, "text/xml", BAD),
    ]
    return spark.createDataFrame(rows, tables.SITE_RESOURCES)


def test_robots_and_sitemaps(spark):
    res = _resources(spark)
    assert sitemap.disallowed_rules(res).first().rules == ["/x", "/y"]
    found = sitemap.discover(res).first()
    assert (found.sitemap_url, found.source) == ("https://s.com/i.xml", "robots.txt")
    urls = sitemap.sitemap_urls(res)
    assert sorted(r.url for r in urls.collect()) == ["https://s.com/a", "https://s.com/b"]
    more = spark.createDataFrame([("s", "https://s.com/x1"), ("s", "https://s.com/z"), ("t", "https://t.com/x")], "site string, url string")
    assert sorted(r.url for r in sitemap.allowed(more, sitemap.disallowed_rules(res)).collect()) == ["https://s.com/z", "https://t.com/x"]


def test_sitemap_files_read_back(spark):
    urls = spark.createDataFrame([("s", f"https://s.com/p{i}?a=1&b={i}") for i in range(5)], "site string, url string")
    folder = tempfile.mkdtemp(prefix="pagewarden-") + "/out"
    sinks.write_sitemaps(sitemap.xml_rows(urls, "2026-01-01"), folder, 2)
    back = spark.read.format("xml").option("rowTag", "url").schema("loc string, priority string, site string").load(folder)
    assert {r["loc"] for r in back.collect()} == {r.url for r in urls.collect()} and back.first().priority == "0.50"


def test_split_upsert_and_delete(spark):
    now, old = dt.datetime(2026, 1, 2), dt.datetime(2025, 1, 1)
    audits = spark.createDataFrame([(" HTTPS://A.com/ ", "g", 70, now, "[]"), ("https://b.com", "g", 50, now, "[1]")], "url string, business_type string, seo_score int, updated_at timestamp, findings string")
    split = store.split_audit(audits)
    assert set(split) == set(store.TABLES)
    folder = tempfile.mkdtemp(prefix="pagewarden-")
    sinks.write_tables(split, folder)
    back = tables.stored_tables(spark, folder)
    assert {r.url for r in back["projects"].collect()} == {"https://a.com", "https://b.com"}
    stored = spark.createDataFrame([("p1", "https://a.com", 10, old, old), ("p2", "https://c.com", 20, old, old)], "project_id string, url string, seo_score int, created_at timestamp, updated_at timestamp")
    incoming = back["projects"].select("project_id", "url", "seo_score", "updated_at")
    merged = {r.url: r for r in store.upsert_projects(stored, incoming).collect()}
    assert (merged["https://a.com"].project_id, merged["https://a.com"].seo_score, merged["https://a.com"].created_at, merged["https://a.com"].updated_at) == ("p1", 70, old, now)
    assert merged["https://b.com"].created_at == now and merged["https://c.com"].seo_score == 20
    left = store.delete_projects(back, back["projects"].filter("url = 'https://a.com'"))
    assert all(t.count() == 1 for t in left.values())


def test_store_writes_reads_and_deletes(spark):
    from pagewarden.sources.audit_store import AuditStore

    kept = AuditStore(spark, tempfile.mkdtemp(prefix="pagewarden-") + "/store")
    assert kept.tables() == {}
    day = lambda d: dt.datetime(2026, 1, d)
    schema = "url string, seo_score int, updated_at timestamp, findings string, pages string"
    audits = lambda rows: spark.createDataFrame([(f"https://{u}.com", s, day(d), f"f{s}", f"p{s}") for u, s, d in rows], schema)
    kept.upsert(audits([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]))
    kept.upsert(audits([("b", 20, 2), ("d", 4, 2)]))
    state = lambda: {r.url: (r.seo_score, r.created_at.day, r.updated_at.day) for r in kept.tables()["projects"].collect()}
    assert state() == {"https://a.com": (1, 1, 1), "https://b.com": (20, 1, 2), "https://c.com": (3, 1, 1), "https://d.com": (4, 2, 2)}
    assert sorted(r.findings for r in kept.tables()["audit_results"].collect()) == ["f1", "f20", "f3", "f4"]
    projects = kept.tables()["projects"]
    kept.delete(projects.filter("url in ('https://a.com', 'https://b.com')"))
    assert set(state()) == {"https://c.com", "https://d.com"}
    assert all(t.count() == 2 for t in kept.tables().values()) and len(kept.tables()) == 5
    kept.delete(kept.tables()["projects"])
    assert all(t.count() == 0 for t in kept.tables().values())


def test_flat_pages_from_both_shapes(spark):
    head = ", ".join([f"h{n}: array<string>" for n in range(1, 7)] + [f"h{n}_count: int" for n in range(1, 7)])
    schema = (
        "url string, title string, description string, title_length int, meta_description_length int, word_count int, is_indexable boolean, canonical_url string, "
        f"seo_health string, seo_score int, headings struct<{head}>, page_info struct<title: string, meta_description: string, canonical: string, indexing_status: string>, "
        "content struct<word_count: int>, has_technical_seo boolean, issues array<string>"
    )
    none6 = [None] * 6
    flat = ("u1", "T" * 70, "", 70, 0, 45, False, "c", "40%", None, (["a", "b"], *[None] * 5, *none6), None, None, None, ["Slow page", "Missing title", ""])
    rich = ("u2", None, None, None, None, None, None, None, None, 62, (*none6, 1, 2, None, None, None, None), ("A fitting page title", "m" * 100, "x", "Indexable"), (500,), True, None)
    got = {r.url: r for r in store.flat_pages(spark.createDataFrame([flat, rich], schema)).collect()}
    assert [i.title for i in got["u1"].issues] == ["Title Too Long", "Missing Meta Description", "Multiple H1 Tags (2)", "Low Word Count (45 words)", "Page is Blocked from Indexing", "Slow page"]
    assert (got["u2"].title_length, got["u2"].word_count, got["u2"].h2_count, got["u2"].seo_health, got["u2"].issues) == (20, 500, 2, "62%", [])
    assert [r.priority for r in got["u1"].recommendations][:2] == ["Low", "High"]


def test_local_json_sources(spark):
    folder = tempfile.mkdtemp(prefix="pagewarden-")
    review = lambda i, s, reply: {"reviewId": i, "starRating": s, "reviewReply": reply}
    day = lambda d, v: {"date": {"year": 2026, "month": 1, "day": d}, "value": v}
    docs = {
        "reviews": {"location": "l", "reviews": [review("1", "FIVE", None), review("2", "TWO", {"comment": "x"}), review("3", "ODD", None)]},
        "series": {"location": "l", "multiDailyMetricTimeSeries": [{"dailyMetric": "CALL_CLICKS", "timeSeries": {"datedValues": [day(1, 2), day(2, None), day(20, 5)]}}]},
        "profiles": {"name": "l", "title": "T", "websiteUri": "w", "primaryCategory": {"displayName": "A"}, "phoneNumbers": {"primaryPhone": "1"}},
        "keywords": {"location": "l", "keywords": [{"query": "a", "impressions": 1, "opportunity_score": 9}, {"query": "b", "impressions": 2, "opportunity_score": 9}]},
    }
    for name, doc in docs.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(json.dumps(doc))
    read = lambda n, schema: tables.read_table(spark, f"{folder}/{n}.json", schema, "json")
    reviews = tables.reviews(read("reviews", tables.REVIEWS))
    s = local.review_summary(reviews, "location").first()
    assert (s.total_reviews, s.average_rating, s.response_rate, s.positive, s.negative) == (3, 2.3, 33.3, 1, 2)
    assert [r.review_id for r in local.urgent_reviews(reviews).collect()] == ["3"]
    series = tables.daily_series(read("series", tables.DAILY_SERIES))
    assert local.daily_totals(series, "location").first().call_clicks == 7.0
    assert local.trailing(series, "2026-01-10", 9).count() == 2
    profiles = read("profiles", tables.PROFILES)
    assert tables.locations(profiles).first().locationName == "T"
    audit = local.profile_audit(profiles, "name").first()
    assert (audit.completeness_score, audit.category_optimization_score, audit.overall_gbp_score) == (50, 50, 53.3)
    assert local.top_keywords(tables.search_keywords(read("keywords", tables.KEYWORDS)), "location").first()["query"] == "a"


def test_nearest_is_the_same_with_and_without_broadcast(spark):
    v = spark.createDataFrame([("t", i, [float(i % 17), float(i % 5)]) for i in range(200)] + [("u", 999, [0.0, 0.0])], "tenant string, vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([("t", 1, [3.0, 3.0])], "tenant string, query_id bigint, query array<float>")
    near = [[r.vec_id for r in search.nearest(v, q, ["tenant"], slice_rows=n).orderBy("rank").collect()] for n in (1000, 30)]
    want = sorted(range(200), key=lambda i: ((i % 17 - 3) ** 2 + (i % 5 - 3) ** 2, i))[:5]
    assert near == [want, want]


def test_nearest_in_slices_and_blocks(spark):
    """Every cut of tenants and queries gives what one sort gives: ties, zero and equal vectors, many batches."""
    import random

    rng = random.Random(8)
    point = lambda: [rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(6)]
    rows = [("big" if i % 5 else "small", i, point()) for i in range(400)] + [("big", 1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [("big", 5000, None), ("alone", 1, [1.0] * 6)]
    asked = [(t, i, point()) for i, t in enumerate(["big"] * 9 + ["small"] * 2 + ["none"])] + [("big", 50, [0.0] * 6), ("big", 51, None)]
    v = spark.createDataFrame(rows, "tenant string, vec_id bigint, embedding array<float>")
    q = spark.createDataFrame(asked, "tenant string, query_id bigint, query array<float>")
    f32 = lambda x: [float(r) for r in spark.createDataFrame([(x,)], "x array<float>").first().x]
    stored32 = {(r.tenant, r.vec_id): list(r.embedding) for r in v.filter("embedding is not null").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for metric in ("l2", "cosine"):
            results = [sorted(map(tuple, search.nearest(v, q, ["tenant"], 7, metric, slice_rows=s, query_block=b).select("tenant", "query_id", "vec_id", "rank").collect())) for s, b in ((10**6, 10**6), (50, 3), (1, 1000))]
            assert results[0] == results[1] == results[2]
            for tenant, query_id, query in asked:
                if query is None or tenant == "none" or (metric == "cosine" and not any(query)):
                    continue
                x = f32(query)

                def far(y):
                    if metric == "l2":
                        return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
                    norms = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
                    return 1 - sum(a * b for a, b in zip(x, y, strict=True)) / norms if norms else float("inf")

                best = sorted((round(far(y), 9), i) for (t, i), y in stored32.items() if t == tenant)[:7]
                assert [i for t, n, i, _ in sorted(results[0], key=lambda r: r[3]) if (t, n) == (tenant, query_id)] == [i for _, i in best]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_robots_rules_by_their_beginnings(spark):
    """Thousands of rules, one of them nested, a site's robots twice, and sites without rules."""
    rules = [f"/d{i}/" for i in range(3000)] + ["/a", "/a/b", "/é", "/"[:0]]
    r = spark.createDataFrame([("s", rules), ("s", ["/a", "/only"]), ("free", [])], "site string, rules array<string>")
    paths = ["", "/", "/a", "/A", "/ab", "/d17/x", "/d17", "/é/x", "/only?x", "/d2999/"]
    u = spark.createDataFrame([(n, t, f"https://{t}.com{p}") for n, (t, p) in enumerate((t, p) for t in ("s", "free", "none") for p in paths)], "n bigint, site string, url string")
    got = {(x.site, x.url.split(".com")[1]) for x in sitemap.allowed(u, r).collect()}
    want = {("s", p) for p in paths if not any((p or "/").startswith(x) for x in rules + ["/only"] if x)} | {(t, p) for t in ("free", "none") for p in paths}
    assert got == want and sitemap.allowed(u, r).columns == u.columns


def test_large_sitemap_streams(spark):
    """50,000 urls in one body come in chunks and in order; odd but well-formed files are read, others are not."""
    big = "<?xml version='1.0' encoding='UTF-8'?>\n<s:urlset xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<s:url><s:loc>\n https://s.com/{i}?a=1&amp;b={i} </s:loc><s:lastmod>x</s:lastmod></s:url>" for i in range(50_000)) + "</s:urlset>"
    odd = "\ufeff <urlset><!-- <url><loc>no</loc></url> --><url><loc><![CDATA[https://s.com/é]]></loc><image><loc>no</loc></image></url><url><loc> </loc></url><url/></urlset>"
    bodies = {"big": big, "odd": odd, "cut": big[:-5], "both": "<x><sitemap><loc>c</loc></sitemap><url><loc>p</loc></url></x>", "empty": "", "null": None, "bare": "<urlset/>"}
    res = spark.createDataFrame([("s", "sitemap", k, 200, "text/xml", b) for k, b in bodies.items()], tables.SITE_RESOURCES)
    got = {r.sitemap_url: (r.children, r.pages) for r in sitemap.parse(res).collect()}
    assert set(got) == {"big", "odd", "both", "bare"}
    assert got["big"] == ([], [f"https://s.com/{i}?a=1&b={i}" for i in range(50_000)])
    assert got["odd"] == ([], ["https://s.com/é"]) and got["both"] == (["c"], []) and got["bare"] == ([], [])


def test_sitemap_files_are_cut_by_place(spark):
    place = tempfile.mkdtemp(prefix="pagewarden-") + "/xml"
    rows = spark.createDataFrame([(s, f"https://{s}/p{i:03d}") for s, n in (("a.com", 25), ("b é.com", 10), ("c.com", 1)) for i in range(n)], "site string, url string")
    sinks.write_sitemaps(sitemap.xml_rows(rows, "2026-01-01"), place, per_file=10)
    back = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, changefreq string, priority string, site string, part string").load(place)
    assert {(r.site, r.part): r["count"] for r in back.groupBy("site", "part").count().collect()} == {("a.com", "0"): 10, ("a.com", "1"): 10, ("a.com", "2"): 5, ("b é.com", "0"): 10, ("c.com", "0"): 1}
    assert sorted(r.loc for r in back.filter("site = 'a.com' and part = '1'").collect()) == [f"https://a.com/p{i:03d}" for i in range(10, 20)]
    assert back.filter("changefreq is null or priority is null or lastmod <> '2026-01-01'").isEmpty()
    files = {(r.site, f"part={r.part}/{r.name}") for r in sinks.sitemap_folders(spark, place).collect() if r.part != "index"}
    index = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, site string").load(place)
    assert {(r.site, r.loc) for r in index.filter("loc is not null").collect()} == files and len(files) == 5


def _events(spark):
    t0 = dt.datetime(2026, 1, 1)
    kinds = ["stage"] + ["log"] * 68 + ["result"]
    rows = [(j, t0 + dt.timedelta(seconds=i // 2), j * 1000 + i, k if not (j == 2 and k == "result") else "error", "p") for j in (1, 2, 3) for i, k in enumerate(kinds) if not (j == 3 and i == 69)]
    return spark.createDataFrame(rows, progress.EVENTS)


def test_streams_agree_with_tables(spark):
    events = _events(spark)
    folder = tempfile.mkdtemp(prefix="pagewarden-")
    events.repartition(6).write.mode("overwrite").json(f"{folder}/in")
    stream = progress.stream_events(spark, f"{folder}/in", 2)
    q = progress.recent_state(stream).writeStream.format("memory").queryName("recent").outputMode("update").option("checkpointLocation", f"{folder}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.job_id: r for r in spark.sql("SELECT job_id, max_by(struct(*), seen) AS r FROM recent GROUP BY job_id").select("job_id", "r.seen", "r.recent", "r.latest_event").collect()}
    table = {r.job_id: r.ids for r in progress.recent(events).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]).alias("ids")).collect()}
    assert {j: list(r.recent) for j, r in last.items()} == table and last[1].seen == 70
    status = progress.job_status(progress.stream_events(spark, f"{folder}/in", 2))
    q = status.writeStream.format("memory").queryName("status").outputMode("complete").option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.job_id: r.status for r in spark.table("status").collect()} == {1: "completed", 2: "failed", 3: "running"}
    q = progress.event_lines(stream, f"{folder}/lines", f"{folder}/c3")
    q.awaitTermination()
    assert spark.read.json(f"{folder}/lines").count() == events.count()


def test_stream_state_follows_running_jobs(spark):
    """Finished jobs leave the state when the watermark has passed them; a late batch of a running one goes on."""
    folder = tempfile.mkdtemp(prefix="pagewarden-")
    t0 = dt.datetime(2026, 1, 1)
    hour = lambda h: t0 + dt.timedelta(hours=h)
    batches = [[(j, hour(0), j, "log", "p") for j in range(20)], [(99, hour(5), 1, "log", "p")], [(99, hour(6), 2, "log", "p")], [(99, hour(7), 3, "log", "p")]]
    rows = []
    for batch in batches:
        spark.createDataFrame(batch, progress.EVENTS).coalesce(1).write.mode("append").json(f"{folder}/in")
        recent = progress.recent_state(progress.stream_events(spark, f"{folder}/in", 100), limit=2, watermark="10 minutes", idle_seconds=3600)
        q = recent.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{folder}/out")).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert rows[0] > rows[-1]
    found = spark.read.parquet(f"{folder}/out").filter("job_id = 99").agg(F.max_by("recent", "seen").alias("r"), F.max("seen").alias("n")).first()
    assert (found.r, found.n) == ([3, 2], 3)


def test_elapsed_on_a_stream(spark):
    folder = tempfile.mkdtemp(prefix="pagewarden-")
    events = _events(spark)
    events.repartition(5).write.mode("overwrite").json(f"{folder}/in")
    spent = progress.elapsed_stream(progress.stream_events(spark, f"{folder}/in", 2), watermark="1 day")
    spent.writeStream.format("memory").queryName("spent").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    starts = events.filter("type = 'stage'").select("job_id", F.col("ts").alias("started_at"))
    want = {(r.job_id, r.event_id): r.elapsed_seconds for r in progress.elapsed(events, starts).collect()}
    assert {(r.job_id, r.event_id): r.elapsed_seconds for r in spark.table("spent").collect()} == want


def test_partial_counts_merge_by_levels(spark, monkeypatch):
    """Few parts whatever the batches; batches that run again and merges that die change nothing."""
    from pagewarden.streaming.partials import Partials

    place = tempfile.mkdtemp(prefix="pagewarden-") + "/counts"
    kept = Partials(spark, place, lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), fan=3)
    counts = lambda i: spark.createDataFrame([("all", 1), (f"b{i % 4}", i)], "k string, n bigint")
    state = lambda: {r.k: r.n for r in kept.read().collect()}
    want = lambda n: {"all": n} | {f"b{j}": sum(range(j, n, 4)) for j in range(min(4, n))}
    for i in range(11):
        if i == 8:  # the batch is written, its merge dies, and the batch runs again
            with monkeypatch.context() as m:
                m.setattr(kept, "merge", lambda d: 1 / 0)
                try:
                    kept.add(i, counts(i))
                except ZeroDivisionError:
                    pass
            assert state() == want(9)
        kept.add(i, counts(i))
        if i in (2, 10):
            kept.add(i, counts(i))
        assert state() == want(i + 1)
    assert kept.parts() == [(0, 8), (9, 9), (10, 10)]
    kept.add(4, counts(4))
    assert state() == want(11)


def test_arriving_pages_are_audited_once(spark):
    folder = tempfile.mkdtemp(prefix="pagewarden-")
    page = lambda i: (i, f"https://s.com/p{i}", f"<title>t{i % 2}</title><body><h1>x</h1><a href='/p{i + 1}'>n</a></body>")
    pages = spark.createDataFrame([page(i) for i in range(6)], "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(f"{folder}/in")
    from pagewarden.sources.pages import stream_pages

    q = progress.audit_arrivals(stream_pages(spark, f"{folder}/in", files_per_trigger=1), f"{folder}/out", f"{folder}/c")
    q.awaitTermination()
    assert spark.read.parquet(f"{folder}/out/findings").count() == 54
    h1 = progress.site_coverage(spark, f"{folder}/out").filter("metric_key = 'h1_compliance'").first()
    assert (h1.matched, h1.total) == (6, 6)
    progress.count_arrivals(stream_pages(spark, f"{folder}/in", files_per_trigger=1), f"{folder}/counts", f"{folder}/c4").awaitTermination()
    r = progress.page_counters(spark, f"{folder}/counts").first()
    assert (r.analyzed_pages, r.discovered_internal_pages) == (6, 7)


def test_whole_audit_writes_every_table(spark):
    from pagewarden.plans import site_audit

    folder = tempfile.mkdtemp(prefix="pagewarden-")
    pages = spark.createDataFrame([(i, f"https://s.com/p{i}", f"<title>t</title><h1>x</h1><a href='/p{i + 1}'>n</a>") for i in range(4)], "page_id bigint, url string, html string")
    status = spark.createDataFrame([("https://s.com/p1", 200)], tables.LINK_STATUS)
    out = site_audit.run(pages, status, folder)
    assert out["findings"].count() == 36 and out["site_scores"].first().pages == 4
    assert out["internal_linking"].first().orphan_pages_sample == ["https://s.com/p0"]
    b = out["broken_links"].first()
    assert (b.checked_count, b.broken_count, b.unknown_count) == (1, 0, 3) and out["issue_pages"].count() >= 4


def test_stream_batch_of_one_file_is_extracted_by_many_tasks(spark):
    from pagewarden.sources.pages import stream_pages

    folder = tempfile.mkdtemp(prefix="pagewarden-")
    pages = spark.createDataFrame([(i, f"https://s.com/p{i}", f"<title>t{i}</title><a href='/p{i + 1}'>n</a>") for i in range(40)], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(f"{folder}/in")
    progress.audit_arrivals(stream_pages(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/c").awaitTermination()
    files = spark.read.parquet(f"{folder}/out/features").select("page_id", F.input_file_name().alias("file"))
    assert files.count() == 40 and files.select("file").distinct().count() > spark.sparkContext.defaultParallelism


def test_spread_tasks_follow_the_splits_of_the_scan(spark):
    from checks import recipes

    folder = tempfile.mkdtemp(prefix="pagewarden-")
    spark.range(4000).repartition(12).write.parquet(f"{folder}/in")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = spark.read.parquet(f"{folder}/in")
        splits = rows.rdd.getNumPartitions()
        assert splits > spark.sparkContext.defaultParallelism
        dealt = recipes.spread(rows, "id")
        assert dealt.rdd.getNumPartitions() >= 4 * splits and dealt.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_counted_batch_of_one_file_is_extracted_by_many_tasks(spark, monkeypatch):
    from pagewarden.sources.pages import stream_pages

    folder, tasks, real = tempfile.mkdtemp(prefix="pagewarden-"), [], progress.extract.page_features

    def seen(pages):
        tasks.append(pages.rdd.getNumPartitions())
        return real(pages)

    monkeypatch.setattr(progress.extract, "page_features", seen)
    pages = spark.createDataFrame([(i, f"https://s.com/p{i}", f"<a href='/p{i + 1}'>n</a>") for i in range(40)], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(f"{folder}/in")
    progress.count_arrivals(stream_pages(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/c").awaitTermination()
    r = progress.page_counters(spark, f"{folder}/out").first()
    assert (r.analyzed_pages, r.discovered_internal_pages) == (40, 41) and min(tasks) >= spark.sparkContext.defaultParallelism
