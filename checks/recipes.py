"""Operator inputs made from the given tables, in Spark.

The tables hold no meta tags, images or structured data, so ``authored_pages`` writes
every document as a full HTML page. The expected features follow from the document's
own columns; ``oracle.FEATURES`` states them without looking at the HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.operators import extract
from pagewarden.session import stored

SECTIONS = ["about/a-", "blog/post-", "services/item_", "contact/", "Products/", "p/", "news/"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, in tasks that do not grow with the table: each split of the scan is
    dealt to several. The given files hold one row group each, so a scan of one is a single task,
    and what follows costs far more per byte than reading."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 8 * df.rdd.getNumPartitions()), key)


def _site(doc: Column) -> Column:
    """Number of the site: documents k*k to k*k + 2k form site k."""
    return F.floor(F.sqrt(doc.cast("double")))


def _path(doc: Column) -> Column:
    k = _site(doc)
    section = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), (doc % len(SECTIONS) + 1).cast("int"))
    return F.when(doc == k * k, F.lit("/")).otherwise(F.concat(F.lit("/"), section, doc.cast("string")))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels, site, url, title and description (first two sentences)."""
    docs = spread(table(spark, folder, "documents"), "doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    k = _site(F.col("doc_id"))
    sentence = lambda p: F.trim(F.regexp_extract("text", p, 1))
    return docs.select(
        "*",
        F.coalesce("quality", F.lit(-1)).alias("q"),
        F.coalesce("toxic", F.lit(0)).alias("x"),
        k.alias("k"),
        (F.col("doc_id") - k * k).alias("j"),
        F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".example.org")).alias("origin"),
        _path(F.col("doc_id")).alias("path"),
        sentence(r"^\s*([^.!?\n]*)").alias("sentence1"),
        sentence(r"^\s*[^.!?\n]*[.!?\n]+\s*([^.!?\n]*)").alias("sentence2"),
    )


def _escape(x: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def authored_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    c = F.col
    put = lambda test, *parts: F.when(
        test, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    ).otherwise("")
    one, two = _escape(c("sentence1")), _escape(c("sentence2"))
    first = c("doc_id") == c("k") * c("k")
    parent = c("k") * c("k") + F.floor(c("j") / 2)
    child = lambda n: c("k") * c("k") + c("j") * 2 + n
    linked = lambda n: (c("j") * 2 + n < c("k") * 2 + 1) & ((c("j") * 2 + n) % 5 != 4)
    images = F.array_join(
        F.transform(
            F.slice(F.sequence(F.lit(0), F.lit(5)), F.lit(1), (c("doc_id") % 6).cast("int")),
            lambda i: F.when(
                i < c("doc_id") % 3,
                F.when(i == 0, F.lit('<img class="a > b">')).otherwise(F.concat(F.lit('<IMG SRC="/m'), i.cast("string"), F.lit('.png" ALT=" ">'))),
            ).otherwise(F.concat(F.lit("<img alt='p"), i.cast("string"), F.lit("' src=/i"), i.cast("string"), F.lit(".png>"))),
        ),
        "",
    )
    german, french, spanish, english = (c("lang") == x for x in ("de", "fr", "es", "en"))
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8">'),
        put(~((c("q") == 0) & (c("x") == 1)), "<title> ", one, " </title>"),
        put(~french & (c("sentence2") != "") & (c("doc_id") % 2 == 0), '<meta name="description" content="', two, '">'),
        put(~french & (c("sentence2") != "") & (c("doc_id") % 2 == 1), '<META CONTENT="', two, '" NAME=Description>'),
        put(c("q") == 1, '<meta name="viewport" content="width=device-width">'),
        put(c("x") == 1, '<meta name="robots" content="NOINDEX, nofollow">'),
        put(c("n_chars") > 300, '<link rel="Canonical" href="', c("path"), '#c">'),
        put(english | german, '<meta property="og:title" content="', one, '">'),
        put(english, '<meta property="og:description" content="', two, '">'),
        put(german, '<meta content="/og', c("doc_id").cast("string"), '.png" property="og:image">'),
        put(french, '<meta name="twitter:card" content="summary">'),
        put(english | german, '<link rel="shortcut icon" href="/s.ico">'),
        put(english, "<link rel=icon href=i.png>"),
        put(english & (c("q") == 1), '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "LocalBusiness"}</script>'),
        put(german | french, '<script type="application/ld+json">{"@graph": [{"@type": "Article"}, {"@type": ["Person", "article"]}]}</script>'),
        F.lit("<style>p{margin:0}</style></head>"),
        F.when(spanish, "<body itemscope>").otherwise("<body>"),
        F.lit('<script>document.write("<a href=\'/fake\'>f</a><h1>no</h1><img src=x>"); var c = \'<!-- start\';</script>'),
        F.lit('<nav><nav>inner menu</nav><a href="/">Home page</a></nav><!-- <h1>not shown</h1> <script> -->'),
        put(~spanish, "<h1>", one, "</h1>"),
        put(german, "<h1 class=x>", one, "</h1>"),
        F.lit("<h2>"), two, F.lit("</h2><p>"), _escape(c("text")), F.lit("</p>"), images,
        put(F.lit(True), '<p><a href="..', _path(parent), '">Up</a>'),
        put(linked(1), '<a href="', _path(child(1)), '">Child <b>one</b></a>'),
        put(linked(2), '<a href="', F.replace(c("origin"), F.lit("www"), F.lit("WWW")), _path(child(2)), '#frag">Child two</a>'),
        put(F.lit(True), '<a href="', _path(parent), '#x"', F.when(c("q") == 0, ' rel="nofollow"').otherwise(""), ">Again</a>"),
        put(F.lit(True), '<a href="https://ext', c("doc_id") % 11, '.example.net/a/?q=1"', F.when(c("x") == 1, " rel='NoFollow external'").otherwise(""), ">Out</a>"),
        F.lit('<a href="mailto:a@b.example">Mail</a>'),
        put(english, '<a href="//site', c("k"), '.example.org/shared/">Shared</a>'),
        put(c("q") == 1, '<a href="http://blog.site', c("k"), '.example.org">Blog</a>'),
        F.lit('</p><div style="color: red; display: none">hidden <div>inner</div> words</div><script>var a = "not counted";</script>'),
        F.lit("<footer>small <form>print</footer><h4 class=z>Last <i>words</i><p>seen</body></html>"),
    )
    return d.select(
        c("doc_id").alias("page_id"), F.concat(c("origin"), c("path")).alias("url"), html.alias("html"),
        first.alias("is_home"), "lang", "source", "text", "q", "x", "n_chars",
    )


_STORED: dict[tuple[str, str], DataFrame] = {}


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the authored pages. Extraction is the costly step, so a session stores
    them once as Parquet, as a whole audit does, and its queries read the columns they need."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        _STORED[key] = stored(extract.page_features(authored_pages(spark, folder)), "features")
    return _STORED[key]


def stored_features(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder)


def raw_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the given web pages."""
    return extract.page_features(spread(table(spark, folder, "pages"), "page_id"))


def graph(spark: SparkSession, folder: str) -> DataFrame:
    return extract.edges(features(spark, folder))


def link_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status of the documents' urls: 404 for low quality, 0 for toxic ones, else 200; one in seven is not known."""
    return documents(spark, folder).filter("doc_id % 7 <> 3").select(
        F.concat("origin", "path").alias("url"),
        F.when(F.col("q") == 0, 404).when(F.col("x") == 1, 0).otherwise(200).alias("status_code"),
    )


def home_pages(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).groupBy(F.concat(F.lit("www.site"), F.col("k").cast("string"), F.lit(".example.org")).alias("site")).agg(
        F.first(F.concat("origin", F.lit("/"))).alias("url")
    )


def sitemap_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemap entries: documents of known quality, and each labelled good one twice."""
    d = documents(spark, folder).filter(F.col("q") >= 0)
    copies = F.explode(F.when(F.col("q") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return d.select(F.col("origin"), "path", copies.alias("copy")).select(
        F.substring("origin", 9, 1000).alias("site"), F.concat("origin", "path").alias("url")
    )


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """robots.txt, sitemap and favicon answers of every site, written from its documents."""
    d = documents(spark, folder)
    per_site = d.groupBy("k").agg(F.first("origin").alias("origin"), F.count_if(F.col("x") == 1).alias("bad"), F.count(F.lit(1)).alias("n"))
    c = F.col
    site = F.substring("origin", 9, 1000)
    robots = per_site.select(
        site.alias("site"), F.lit("robots").alias("kind"), F.concat("origin", F.lit("/robots.txt")).alias("url"),
        F.when(c("k") % 6 == 1, 404).otherwise(200).alias("status_code"),
        F.when(c("k") % 6 == 2, "text/html").otherwise("text/plain; charset=utf-8").alias("content_type"),
        F.when(c("k") % 6 == 3, "  \n").when(c("k") % 6 == 4, "nothing here").otherwise(
            F.concat(
                F.lit("User-agent: x\nDisallow: /\n\nUser-Agent: *\nDisallow: /blog/\ndisallow:\nDisallow: /p/1\nSitemap: "),
                c("origin"), F.lit("/map.xml\n"),
            )
        ).alias("body"),
    )
    sitemap = per_site.select(
        site.alias("site"), F.lit("sitemap").alias("kind"), F.concat("origin", F.lit("/sitemap.xml")).alias("url"),
        F.when(c("k") % 5 == 1, 500).otherwise(200).alias("status_code"),
        F.when(c("k") % 5 == 2, "text/plain").otherwise("application/xml").alias("content_type"),
        F.when(c("k") % 5 == 3, "<feed></feed>").otherwise("<urlset></urlset>").alias("body"),
    )
    icon = per_site.select(
        site.alias("site"), F.lit("favicon").alias("kind"), F.concat("origin", F.lit("/favicon.ico")).alias("url"),
        F.lit(200).alias("status_code"), F.when(c("bad") > 0, "image/x-icon").otherwise("text/html").alias("content_type"),
        F.lit("").alias("body"),
    )
    return robots.unionByName(sitemap).unionByName(icon)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One review per conversation: rating by its number, reply when an assistant answered."""
    conv = table(spark, folder, "conversations")
    per = conv.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.length("text")).alias("chars"))
    names = F.array(*[F.lit(s) for s in ("UNKNOWN", "ONE", "TWO", "THREE", "FOUR", "FIVE")])
    return per.select(
        F.col("conv_id").alias("review_id"), F.concat(F.lit("loc"), (F.col("conv_id") % 7).cast("string")).alias("location"),
        F.element_at(names, (F.col("chars") % 6 + 1).cast("int")).alias("star_rating"),
        ((F.col("answers") > 0) & (F.col("chars") % 4 != 0)).alias("has_reply"),
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.concat(F.lit("loc"), F.col("user_id").cast("string")).alias("location"), F.col("event_type").alias("metric"),
        F.to_date("ts").alias("date"), "value",
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("type"), F.col("props").alias("payload"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Audit runs: one per order, the customer is the project."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("seo_score"), F.col("o_orderpriority").alias("business_type"),
    )


def speed(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        "event_id", "user_id", (F.col("value") / 10).alias("ttfb"),
        (F.get_json_object("props", "$.k").cast("int") * 10).alias("size_kb"),
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Business profiles, one per supplier, with parts left out by its numbers."""
    s = table(spark, folder, "supplier")
    c = F.col
    text = lambda test, value: F.when(test, value)
    return s.select(
        F.concat(F.lit("loc"), c("s_suppkey").cast("string")).alias("location"), "s_suppkey", "s_nationkey", "s_acctbal",
        F.when(c("s_nationkey") % 5 != 0, F.struct(F.lit("Agency").alias("displayName"))).alias("primaryCategory"),
        F.when(c("s_nationkey") % 3 == 0, F.array(F.struct(F.lit("More").alias("displayName")))).alias("additionalCategories"),
        F.struct(text(c("s_acctbal") > 3000, F.concat(F.lit("(555) 010-"), F.lpad((c("s_suppkey") % 10000).cast("string"), 4, "0"))).alias("primaryPhone")).alias("phoneNumbers"),
        F.when(c("s_acctbal") > 0, F.struct(F.array(F.lit("MONDAY")).alias("periods"))).alias("regularHours"),
        F.struct(text(c("s_nationkey") % 2 == 0, F.concat(F.lit("About "), c("s_name"))).alias("description")).alias("profile"),
        text(c("s_nationkey") % 4 != 0, F.concat(F.lit("https://www.s"), c("s_suppkey").cast("string"), F.lit(".example.com/"))).alias("websiteUri"),
    )
