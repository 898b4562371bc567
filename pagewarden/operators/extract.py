"""Raw pages to page features and link edges.

``page_features`` is one narrow projection: every feature comes from the page's own
row, so nothing is shuffled and unused features are pruned away. Arrays stay inside
the row; ``edges`` explodes them when the link graph is needed.
"""

from __future__ import annotations

import json
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagewarden import constants as C
from pagewarden.functions import html as H
from pagewarden.functions import urls as U
from pagewarden.functions.numbers import let, lit_array
from pagewarden.functions.scores import page_authority
from pagewarden.operators.rows import unnest

_TAGS = ["meta", "link", "img"]
_ANCHOR = rf"(?is)<a(?=\s){H.INSIDE}>(?:.*?)(?:</a\s*>|(?=<a[\s>])|\z)"
_JSON_LD = rf"(?is)<script(?=\s){H.INSIDE}>(.*?)(?:</script\s*>|\z)"


def _favicon(links: Column) -> Column:
    """Best icon link: apple-touch, plain icon, other, shortcut; first of the best."""

    def entry(tag: Column, i: Column) -> Column:
        rel = F.lower(H.attribute(tag, "rel"))
        href = U.strip_space(H.attribute(tag, "href"))
        rank = (
            F.when(rel.contains("apple-touch-icon"), 1)
            .when(rel.contains("icon") & ~rel.contains("shortcut"), 2)
            .when(rel.contains("shortcut"), 4)
            .otherwise(3)
        )
        usable = rel.contains("icon") & (href != "") & ~href.startswith("data:")
        return F.when(usable, F.struct(rank.alias("rank"), i.alias("pos"), href.alias("href")))

    return F.array_min(F.array_compact(F.transform(links, entry)))["href"]


def _types_below(parsed: object) -> list[str]:
    """``@type`` names of a JSON-LD value: nodes, ``@graph`` lists and lists in lists, the
    last member of a list first."""
    found: list[str] = []
    todo = [parsed]
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo += value
        elif isinstance(value, dict):
            named = value.get("@type")
            found += [t for t in (named if isinstance(named, list) else [named]) if isinstance(t, str)]
            if isinstance(value.get("@graph"), list):
                todo += value["@graph"]
    return found


@F.pandas_udf(ArrayType(StringType()))
def _block_types(blocks: pd.Series) -> pd.Series:
    """Types of a page's JSON-LD blocks. Nesting has no bound, which no Column can follow;
    the batches hold the blocks alone, and malformed ones are skipped."""

    def one(texts: list[str] | None) -> list[str]:
        found: list[str] = []
        for text in texts if texts is not None else ():
            try:
                found += _types_below(json.loads(text))
            except (ValueError, RecursionError):
                continue
        return found

    return blocks.map(one)


def json_ld_blocks(html: Column) -> Column:
    """Texts of the JSON-LD scripts; null for a page that has none."""
    is_json_ld = lambda b: F.lower(
        H.attribute(F.regexp_extract(b, r"(?s)^<[^>]*>", 0), "type")
    ).contains("ld+json")
    scripts = F.filter(F.regexp_extract_all(html, F.lit(_JSON_LD), F.lit(0)), is_json_ld)
    return F.when(html.rlike(r"(?i)ld\+json"), F.transform(scripts, lambda b: F.regexp_extract(b, _JSON_LD, 1)))


def structured_types(blocks: Column, html: Column) -> Column:
    """Distinct ``@type`` values of all JSON-LD blocks, plus ``Microdata``."""
    scoped = F.exists(H.tags(html, ["[a-z][a-z0-9]*"]), lambda t: t.rlike(r"(?i)\sitemscope[\s=/>]"))
    microdata = F.when(html.rlike("(?i)itemscope") & scoped, F.array(F.lit("Microdata")))
    empty = lit_array([])
    return distinct_ignoring_case(F.concat(F.coalesce(_block_types(blocks), empty), F.coalesce(microdata, empty)))


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of every value, blanks dropped."""

    def first_spellings(cleaned: Column) -> Column:
        keys = F.array_distinct(F.transform(cleaned, F.lower))
        return F.transform(
            keys, lambda k: F.try_element_at(F.filter(cleaned, lambda s: F.lower(s) == k), F.lit(1))
        )

    return let(F.filter(F.transform(values, U.strip_space), lambda s: s != ""), first_spellings)


def _links(html: Column) -> Column:
    """http(s) links of a page in order: position, url, nofollow, text, internal."""
    here = [F.col(c) for c in ("_scheme", "_netloc", "_path", "_query")]

    def opened(anchor: Column, i: Column) -> Column:
        tag = F.regexp_extract(anchor, rf"(?s)^<{H.INSIDE}>", 0)
        # an empty href attribute is a link to the page itself
        href = F.coalesce(H.attribute(tag, "href"), F.when(tag.rlike(r"(?i)\shref[\s=>]"), F.lit("")))
        return F.struct(
            i.alias("pos"),
            U.normalize_crawl_url(U.resolve(*here, href)).alias("url"),
            F.coalesce(F.lower(H.attribute(tag, "rel")).contains("nofollow"), F.lit(False)).alias("nofollow"),
            H.text_of(anchor).alias("text"),
        )

    def placed(x: Column) -> Column:
        return F.struct(
            x["pos"].alias("pos"),
            x["url"].alias("url"),
            x["nofollow"].alias("nofollow"),
            x["text"].alias("text"),
            U.same_domain(F.col("site"), x["url"]).alias("internal"),
        )

    anchors = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    web = F.filter(F.transform(anchors, opened), lambda x: x["url"].rlike("^https?:"))
    return F.transform(web, placed)


def _first_of_each_url(links: Column) -> Column:
    """One entry per url, the first, back in page order (sort, compare neighbours, sort)."""
    by_url = F.array_sort(
        F.transform(
            links,
            lambda x: F.struct(
                x["url"].alias("url"), x["pos"].alias("pos"), x["text"].alias("text"), x["internal"].alias("internal")
            ),
        )
    )
    before = F.concat(F.array(F.lit(None).cast("struct<url:string,pos:int,text:string,internal:boolean>")), by_url)
    first = F.zip_with(
        by_url,
        before,
        lambda x, b: F.when(
            x.isNotNull() & ~x["url"].eqNullSafe(b["url"]),
            F.struct(
                x["pos"].alias("pos"), x["url"].alias("url"), x["text"].alias("text"), x["internal"].alias("internal")
            ),
        ),
    )
    return F.array_sort(F.array_compact(first))


_FIRST_KEYS = ["site", "page_id", "url", "depth", "status_code", "response_ms"]


# The column lists below do not depend on the input, so they are built once per process.
@cache
def _url_columns() -> list[Column]:
    url = F.col("url")
    return [
        U.host(url).alias("site"),
        U.scheme(url).alias("_scheme"),
        U.netloc(url).alias("_netloc"),
        U.path(url).alias("_path"),
        U.query(url).alias("_query"),
        H.tags(F.col("_doc"), _TAGS).alias("_tags"),
    ]


@cache
def _tag_columns() -> list[Column]:
    tags = F.col("_tags")
    return [
        H.parsed_metas(F.filter(tags, lambda t: H.has_tag(t, "meta"))).alias("_metas"),
        F.filter(tags, lambda t: H.has_tag(t, "link")).alias("_relations"),
        F.filter(tags, lambda t: H.has_tag(t, "img")).alias("_images"),
        _links(F.col("_doc")).alias("links"),
    ]


@cache
def _feature_columns() -> list[Column]:
    doc, metas, relations = F.col("_doc"), F.col("_metas"), F.col("_relations")
    here = [F.col(c) for c in ("_scheme", "_netloc", "_path", "_query")]

    def resolved(href: Column) -> Column:
        return U.normalize_crawl_url(U.resolve(*here, F.nullif(href, F.lit(""))))

    def any_meta(key: str, prefix: str) -> Column:
        return F.exists(metas, lambda m: F.coalesce(m[key].startswith(prefix), F.lit(False)))

    canonical = F.filter(relations, lambda t: F.lower(H.attribute(t, "rel")).contains("canonical"))
    bare = F.filter(
        F.col("_images"), lambda t: U.strip_space(F.coalesce(H.attribute(t, "alt"), F.lit(""))) == ""
    )
    return [
        H.text_of(F.regexp_extract(doc, r"(?is)<title[^>]*>(.*?)(?:</title|\z)", 1), "").alias("title"),
        H.meta_content(metas, "name", "description").alias("description"),
        (H.meta_content(metas, "name", "viewport") != "").alias("has_viewport_meta"),
        F.lower(H.meta_content(metas, "name", "robots")).alias("robots_directives"),
        F.coalesce(
            resolved(H.attribute(F.try_element_at(canonical, F.lit(1)), "href")), F.lit("")
        ).alias("canonical_url"),
        resolved(_favicon(relations)).alias("favicon_url"),
        H.headings(doc).alias("headings"),
        H.word_count(doc).alias("word_count"),
        F.size("_images").alias("total_images"),
        F.transform(
            bare, lambda t: F.coalesce(F.nullif(H.attribute(t, "src"), F.lit("")), F.lit("inline-image"))
        ).alias("missing_alt_images"),
        _first_of_each_url(F.col("links")).alias("_first"),
        any_meta("property", "og:").alias("has_open_graph"),
        any_meta("name", "twitter:").alias("has_twitter_card"),
        H.meta_content(metas, "property", "og:title").alias("og_title"),
        H.meta_content(metas, "property", "og:description").alias("og_description"),
        H.meta_content(metas, "property", "og:image").alias("og_image"),
        H.meta_content(metas, "name", "twitter:card").alias("twitter_card"),
        structured_types(F.col("_blocks"), doc).alias("structured_data_types"),
        U.page_type(F.col("url")).alias("page_type"),
        U.url_structure(F.col("url")).alias("url_structure"),
    ]


@cache
def _derived_columns() -> list[Column]:
    internal = F.filter("_first", lambda x: x["internal"])
    external = F.filter("_first", lambda x: ~x["internal"])
    nofollow = F.size(F.filter("links", lambda x: x["nofollow"]))
    domains = F.filter(F.transform(external, lambda x: U.netloc(x["url"])), lambda s: s != "")
    anchors = F.filter(F.transform(internal, lambda x: x["text"]), lambda s: s != "")
    return [
        F.col("title"),
        F.length("title").alias("title_length"),
        F.col("description"),
        F.length("description").alias("meta_description_length"),
        F.col("canonical_url"),
        (F.col("canonical_url") != "").alias("has_canonical"),
        F.struct(
            F.when(F.col("favicon_url").isNotNull(), "Present").otherwise("Missing").alias("status"),
            F.coalesce("favicon_url", F.lit("")).alias("url"),
            F.lit("html").alias("source"),
        ).alias("favicon"),
        F.col("has_viewport_meta"),
        F.col("robots_directives"),
        (~F.col("robots_directives").contains("noindex")).alias("is_indexable"),
        F.col("headings"),
        F.size("headings.h1").alias("h1_count"),
        F.col("word_count"),
        F.col("total_images"),
        F.col("missing_alt_images"),
        F.size("missing_alt_images").alias("missing_alt_count"),
        F.transform(internal, lambda x: x["url"]).alias("internal_links"),
        F.size(internal).alias("internal_links_count"),
        F.array_distinct(anchors).alias("internal_link_anchors"),
        F.transform(external, lambda x: x["url"]).alias("external_links"),
        F.size(external).alias("external_links_count"),
        F.array_distinct(domains).alias("external_domains"),
        (F.size("links") - nofollow).alias("dofollow_links"),
        nofollow.alias("nofollow_links"),
        *[F.col(c) for c in ("has_open_graph", "og_title", "og_description", "og_image")],
        F.col("has_twitter_card"),
        F.col("twitter_card"),
        (F.size("structured_data_types") > 0).alias("has_structured_data"),
        F.col("structured_data_types"),
        F.col("page_type"),
        F.col("url_structure"),
        F.col("links"),
    ]


def page_features(pages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Features of every page.

    Needs ``page_id, url, html``; ``status_code``, ``depth``, ``response_ms`` are used
    when present. ``keep`` names further input columns to carry along.
    """
    have = set(pages.columns)
    base = pages.select(
        "page_id",
        U.normalize_crawl_url(F.col("url")).alias("url"),
        H.without_comments(F.col("html")).alias("_full"),
        (F.col("status_code") if "status_code" in have else F.lit(200)).cast("int").alias("status_code"),
        (F.col("depth") if "depth" in have else F.lit(0)).cast("int").alias("depth"),
        (F.col("response_ms") if "response_ms" in have else F.lit(None)).cast("bigint").alias("response_ms"),
        *keep,
    )
    plain = base.select("*", H.decode_uncommon(H.without_raw_text(F.col("_full"))).alias("_doc"))
    located = plain.select("*", *_url_columns(), json_ld_blocks(F.col("_full")).alias("_blocks"))
    split = located.select("*", *_tag_columns())
    features = split.select(*keep, *_FIRST_KEYS, "links", *_feature_columns())
    return features.select(*keep, *_FIRST_KEYS, *_derived_columns()).withColumn(
        "page_authority",
        page_authority(
            F.col("word_count"), F.col("internal_links_count"), F.col("external_links_count"),
            F.col("has_structured_data"), F.col("has_open_graph"), F.col("total_images"),
        ),
    )


def edges(features: DataFrame) -> DataFrame:
    """One row per link occurrence: site, page_id, src_url, pos, dst_url, nofollow, anchor, is_internal."""
    return unnest(features, "links", "l", ["site", "page_id", "url"]).select(
        "site", "page_id", F.col("url").alias("src_url"),
        F.col("l.pos").alias("pos"),
        F.col("l.url").alias("dst_url"),
        F.col("l.nofollow").alias("nofollow"),
        F.col("l.text").alias("anchor"),
        F.col("l.internal").alias("is_internal"),
    )


def distinct_edges(links: DataFrame) -> DataFrame:
    """First occurrence of every (page, target): one combining aggregate, no sort."""
    return links.groupBy("site", "page_id", "src_url", "dst_url", "is_internal").agg(
        F.min("pos").alias("pos")
    )


def phone_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(C.PHONE_PATTERN), F.lit(0)))


def mentions_city(text: Column, city: Column) -> Column:
    return F.contains(F.lower(text), F.lower(city)) & (city != "")


def has_local_schema(types: Column, wanted: list[str] = C.LOCAL_SCHEMA_TYPES) -> Column:
    return F.exists(types, lambda t: t.isin(wanted))


def location_links(hrefs: Column) -> Column:
    words = "|".join(C.LOCATION_WORDS)
    return F.filter(hrefs, lambda h: F.lower(h).rlike(words))
