"""Sitemaps and robots.txt: parsing, metrics, warnings and XML output.

``resources`` has the columns ``site, kind, url, status_code, content_type, body``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree.ElementTree import ParseError, XMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import scores as S
from pagewarden.functions import urls as U
from pagewarden.functions.urls import strip_space
from pagewarden.operators.links import graph_link_score, in_degree, known_status, orphans
from pagewarden.operators.ranking import first_by, top_k
from pagewarden.session import stored
from pagewarden.operators.rows import unnest

def robots_rules(body: Column) -> Column:
    """Disallowed path prefixes for agent ``*``; only the last agent line before a rule counts.

    The file is cut at its agent lines, so no running state is needed.
    """
    groups = F.split(body, r"(?im)^[ \t]*user-agent:", -1)
    agent = lambda g: F.trim(F.regexp_extract(g, r"^[^\r\n]*", 0))
    for_all = F.filter(groups, lambda g, i: (i > 0) & (agent(g) == "*"))
    rules = F.flatten(
        F.transform(for_all, lambda g: F.regexp_extract_all(g, F.lit(r"(?im)^[ \t]*disallow:([^\r\n]*)"), F.lit(1)))
    )
    return F.array_distinct(F.filter(F.transform(rules, strip_space), lambda r: r != ""))


def declared_sitemaps(body: Column) -> Column:
    """Sitemap lines of a robots.txt that hold an http(s) url, in order."""
    found = F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*sitemap:([^\r\n]*)"), F.lit(1))
    return F.filter(F.transform(found, strip_space), lambda u: u.startswith("http"))


def disallowed_rules(resources: DataFrame) -> DataFrame:
    """One row per site with its rules; a robots.txt bounds the size of the array."""
    ok = resources.filter((F.col("kind") == "robots") & (F.col("status_code") == 200))
    return ok.select("site", robots_rules(F.col("body")).alias("rules"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls that no rule of their site forbids.

    A rule forbids the paths that begin with it, so a path is looked up by its beginnings, of
    the lengths that the site's rules have: a url meets a handful of keys and not each rule,
    and the rules of a site, repeated rows of it too, are rows that no task holds together.
    """
    one = rules.select("site", F.explode("rules").alias("rule")).filter("rule <> ''").distinct()
    lengths = one.groupBy("site").agg(F.collect_set(F.length("rule")).alias("lengths"))
    path = F.when(U.path(F.col("url")) == "", F.lit("/")).otherwise(U.path(F.col("url")))
    tried = urls.select("site", "url", path.alias("path")).distinct().join(lengths, "site")
    starts = unnest(tried, F.filter("lengths", lambda n: n <= F.length("path")), "n", ["site", "url", "path"])
    starts = starts.select("site", "url", F.expr("left(path, n)").alias("rule"))
    forbidden = starts.join(one, ["site", "rule"]).select("site", "url").distinct()
    return urls.join(forbidden, ["site", "url"], "left_anti").select(urls.columns)


def resource_verdicts(resources: DataFrame) -> DataFrame:
    """Status text of every robots.txt and sitemap."""
    args = (F.col("url"), F.col("status_code"), F.col("content_type"), F.col("body"))
    verdict = F.when(F.col("kind") == "robots", S.resource_verdict("robots", *args)).when(
        F.col("kind") == "sitemap", S.resource_verdict("sitemap", *args)
    )
    return resources.filter(F.col("kind").isin("robots", "sitemap")).select(
        "site", "kind", "url", "status_code", verdict.alias("status_string"),
        (verdict == "Found (Valid)").alias("exists"),
    )


def favicon_verdicts(resources: DataFrame) -> DataFrame:
    """Whether /favicon.ico answers with an image."""
    mime = strip_space(F.element_at(F.split(F.lower(F.coalesce("content_type", F.lit(""))), ";"), 1))
    html = F.lower(F.substring(F.ltrim(F.coalesce("body", F.lit(""))), 1, 15)).rlike("^(?:<!doctype|<html)")
    ok = (F.col("status_code") == 200) & mime.contains("image/") & ~html
    return resources.filter(F.col("kind") == "favicon").select(
        "site", F.when(ok, "Present").otherwise("Missing").alias("status"),
        F.when(ok, F.col("url")).otherwise("").alias("url"), F.lit("fallback").alias("source"),
    )


def status_labels(primary: DataFrame, verdicts: DataFrame, icons: DataFrame) -> DataFrame:
    """robots, sitemap and favicon labels of each site; the page's own icon goes first.

    ``primary`` has ``site`` and the ``favicon`` struct of the primary page.
    """
    one = lambda kind: verdicts.filter(F.col("kind") == kind).groupBy("site").agg(
        # of several files one that exists, of equals the first by url: no matter how rows arrive
        F.min_by(F.struct("status_string", "exists", "status_code"), F.struct(~F.col("exists"), "url", "status_string")).alias(kind)
    )
    joined = (
        primary.select("site", "favicon").join(one("robots"), "site", "left").join(one("sitemap"), "site", "left")
        .join(icons.select("site", F.col("status").alias("_icon")), "site", "left")
    )
    return joined.select(
        "site",
        F.coalesce("robots.status_string", F.lit("Missing")).alias("robots_txt_status"),
        F.when(F.col("sitemap.exists"), F.format_string("Found (%d)", "sitemap.status_code"))
        .otherwise("Missing").alias("sitemap_status"),
        F.when(F.col("favicon.status") == "Present", "Found (HTML link tag)")
        .when(F.col("_icon") == "Present", "Found (/favicon.ico)")
        .otherwise("Missing").alias("favicon_status"),
    )


def discover(resources: DataFrame) -> DataFrame:
    """The sitemap to start from: the two usual places, then the first robots.txt entry."""
    mime, low = F.lower(F.coalesce("content_type", F.lit(""))), F.lower("body")
    ok = F.col("status_code") == 200
    usual = resources.filter(
        (F.col("kind") == "sitemap") & ok & mime.contains("xml") & low.rlike("<urlset|<sitemapindex")
        & U.path(F.col("url")).isin(C.SITEMAP_LOCATIONS)
    ).select(
        "site", "url",
        F.when(U.path(F.col("url")) == C.SITEMAP_LOCATIONS[0], 1).otherwise(2).alias("place"),
        F.regexp_replace(U.path(F.col("url")), "^/", "").alias("source"),
    )
    robots = resources.filter((F.col("kind") == "robots") & ok & mime.contains("text/plain")).select(
        "site", F.try_element_at(declared_sitemaps(F.col("body")), F.lit(1)).alias("url"),
        F.lit(3).alias("place"), F.lit("robots.txt").alias("source"),
    ).filter(F.col("url").isNotNull())
    return first_by(usual.unionByName(robots), ["site"], ["place"], ["url", "source"]).withColumnRenamed(
        "url", "sitemap_url"
    )


ENTRIES = "site string, sitemap_url string, kind string, pos bigint, loc string"


class _Locations:
    """What a sitemap parser calls: the ``loc`` texts of the root's ``url`` and ``sitemap`` elements."""

    def __init__(self, out: list[tuple[str, str]] | None):
        self.out, self.path, self.text = out, [], None

    def start(self, tag: str, _: dict) -> None:
        self.path.append(tag.rpartition("}")[2])
        if self.out is not None and len(self.path) == 3 and self.path[2] == "loc" and self.path[1] in ("url", "sitemap"):
            self.text = []

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, _: str) -> None:
        if self.text is not None and len(self.path) == 3:
            self.out.append((self.path[1], "".join(self.text).strip(" \t\n\r\f\v")))
            self.text = None
        self.path.pop()

    def close(self) -> None:
        pass


def _fed(body: str, out: list | None, chunk: int) -> Iterator[None]:
    """Parse a body in chunks; between two of them ``out`` has what was found so far."""
    parser = XMLParser(target=_Locations(out))
    for at in range(0, len(body), chunk):
        parser.feed(body[at : at + chunk])
        yield
    parser.close()
    yield


def _entries(chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["site", "sitemap_url", "kind", "pos", "loc"])

        for batch in batches:
            for site, url, body in zip(*(batch.column(c).to_pylist() for c in ("site", "url", "body")), strict=True):
                body = (body or "").removeprefix("\ufeff").lstrip()
                try:
                    for _ in _fed(body, None, chunk):  # well-formed as a whole, before a row leaves
                        pass
                except (ParseError, ValueError):
                    continue
                yield rows([(site, url, "file", 0, None)])
                found: list[tuple[str, str]] = []
                pos = 0
                for _ in _fed(body, found, chunk):
                    if found:
                        yield rows([(site, url, kind, pos + i, loc) for i, (kind, loc) in enumerate(found, 1) if loc])
                        pos += len(found)
                        found.clear()

    return run


def entries(resources: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Locations of every sitemap file as rows (site, sitemap_url, kind, pos, loc).

    Kinds are ``file`` (one row per well-formed file), ``url`` and ``sitemap``. A body is fed
    to the parser in chunks and its locations leave the task chunk by chunk, so the longest
    file needs no more than its own text; malformed XML gives no rows.
    """
    ready = resources.filter((F.col("kind") == "sitemap") & (F.col("status_code") == 200)).select("site", "url", "body")
    return ready.mapInArrow(_entries(chunk), ENTRIES)


def _listed(found: DataFrame) -> DataFrame:
    """Entries that count: a file that names child sitemaps has no pages."""
    index = found.filter("kind = 'sitemap'").select("site", "sitemap_url").distinct()
    pages = found.filter("kind = 'url'").join(index, ["site", "sitemap_url"], "left_anti")
    return found.filter("kind = 'sitemap'").unionByName(pages)


def parse(resources: DataFrame) -> DataFrame:
    """Page and child-sitemap locations of every sitemap file, in order, as one row per file."""
    found = stored(entries(resources), "sitemap-entries")
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "loc")))), lambda e: e["loc"])
    grouped = _listed(found).unionByName(found.filter("kind = 'file'")).groupBy("site", "sitemap_url")
    return grouped.agg(texts("sitemap").alias("children"), texts("url").alias("pages"))


def sitemap_urls(resources: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Distinct page urls of each site's sitemap, index files followed level by level."""
    found = stored(_listed(stored(entries(resources), "sitemap-entries")), "sitemaps")
    children = found.filter("kind = 'sitemap'")
    starts = discover(resources) if starts is None else starts
    frontier = stored(starts.select("site", "sitemap_url").distinct(), "frontier")
    seen = frontier
    while not frontier.isEmpty():
        step = (
            children.join(frontier, ["site", "sitemap_url"])
            .select("site", F.col("loc").alias("sitemap_url")).distinct()
            .join(seen, ["site", "sitemap_url"], "left_anti")
        )
        frontier = stored(step, "frontier")
        seen = seen.unionByName(frontier)
    pages = found.filter("kind = 'url'").join(seen, ["site", "sitemap_url"], "left_semi")
    return pages.select("site", U.normalize_crawl_url(F.col("loc")).alias("url")).distinct()


def all_urls(sitemap: DataFrame, crawled: DataFrame) -> DataFrame:
    """Sitemap and crawled urls together, distinct."""
    return sitemap.select("site", "url").unionByName(crawled.select("site", "url")).distinct()


def broken_urls(urls: DataFrame, link_status: DataFrame) -> DataFrame:
    """The urls whose known status is a failure; urls without a status are not judged."""
    known = known_status(link_status).filter(S.is_broken(F.col("status_code")))
    return urls.select("site", "url").distinct().join(known, "url")


def metrics(sitemap: DataFrame, crawled: DataFrame, graph: DataFrame, link_status: DataFrame) -> DataFrame:
    """Totals, coverage, orphans, broken and duplicate urls of every site.

    One union with flags and one aggregate give the totals; duplicates are counted on
    the sitemap rows before they are made distinct.
    """
    flags = sitemap.select("site", "url", F.lit(1).alias("listed")).unionByName(
        crawled.select("site", "url", F.lit(0).alias("listed"))
    )
    per_url = flags.groupBy("site", "url").agg(F.sum("listed").alias("listed"))
    totals = per_url.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(F.col("listed") > 0).alias("_listed"),
        F.sum(F.greatest(F.col("listed") - 1, F.lit(0))).alias("duplicates"),
    )
    lost = orphans(per_url, in_degree(graph).withColumnRenamed("dst_url", "url"))
    lost = lost.groupBy("site").agg(F.count(F.lit(1)).alias("orphans"))
    broken = broken_urls(per_url, link_status).groupBy("site").agg(F.count(F.lit(1)).alias("broken"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    included = F.when(F.col("_listed") > 0, F.col("_listed")).otherwise(F.col("total_urls"))
    return (
        totals.join(lost, "site", "left").join(broken, "site", "left")
        .select(
            "site", "total_urls", included.alias("included"),
            F.greatest(F.lit(0), F.col("total_urls") - zero("broken")).alias("crawlable"),
            zero("orphans").alias("orphans"), "duplicates", zero("broken").alias("broken"),
        )
        .withColumn("coverage", N.percent(F.col("included"), F.col("total_urls")))
    )


def warnings(sites: DataFrame) -> DataFrame:
    """Severity-tagged warnings. Needs ``coverage, orphans, broken, link_score, source``;
    ``source`` is NULL for a site without a sitemap."""
    c = F.col
    found = c("source").isNotNull()
    rules = [
        (~found, "Critical", "missing_sitemap", F.lit("No sitemap was found.")),
        (c("coverage") < 50, "Critical", "low_coverage", F.format_string("The sitemap covers only %s%%.", c("coverage").cast("string"))),
        ((c("coverage") >= 50) & (c("coverage") < 80), "Warning", "low_coverage", F.format_string("The sitemap covers %s%%.", c("coverage").cast("string"))),
        (c("orphans") > 0, "Warning", "orphan_pages", F.format_string("%s pages have no incoming link.", c("orphans").cast("string"))),
        (c("broken") > 0, "Critical", "broken_urls", F.format_string("%s urls answer with an error.", c("broken").cast("string"))),
        (c("link_score") < 40, "Warning", "low_link_score", F.format_string("The internal link score is %s.", c("link_score").cast("string"))),
        (found, "Info", "sitemap_detected", F.format_string("A sitemap was found by way of %s.", c("source"))),
        (F.lit(True), "Info", "ai_crawler_access", F.lit("Check that robots.txt admits the crawlers you want.")),
    ]
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    test,
                    F.struct(
                        F.lit(i).alias("pos"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                        message.alias("message"),
                    ),
                )
                for i, (test, severity, rule, message) in enumerate(rules, 1)
            ]
        )
    )
    return unnest(sites, entries, "w", ["site"]).select("site", "w.*")


def site_report(
    sitemap: DataFrame, crawled: DataFrame, graph: DataFrame, link_status: DataFrame, discovered: DataFrame
) -> DataFrame:
    """Metrics, link score and sitemap source of every site: the input of ``warnings``."""
    score = graph_link_score(all_urls(sitemap, crawled), graph).select(
        "site", F.col("score").alias("link_score"), F.col("rating").alias("link_rating"), "avg_links_per_page"
    )
    return (
        metrics(sitemap, crawled, graph, link_status).join(score, "site", "left")
        .join(discovered.select("site", "source"), "site", "left")
    )


def xml_rows(urls: DataFrame, lastmod: str) -> DataFrame:
    """Rows of a sitemap file; ``lastmod`` is a parameter so that a rerun gives the same file."""
    u = F.col("url")
    return urls.select(
        "site", u.alias("loc"), F.lit(lastmod).alias("lastmod"),
        U.sitemap_changefreq(u).alias("changefreq"), U.sitemap_priority(u).alias("priority"),
    )
