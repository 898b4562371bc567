"""Link graph: reachability, orphans, in-degree, broken links and link scores.

Graph tables have the columns ``site, src_url, dst_url, pos, is_internal``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.functions import scores as S
from pagewarden.operators.ranking import top_k
from pagewarden.session import stored
from pagewarden.operators.rows import unnest


def internal_targets(features: DataFrame) -> DataFrame:
    """Distinct internal link targets per site, from the link arrays of the pages."""
    return unnest(features, "internal_links", "target", ["site"]).select("site", F.col("target").alias("url")).distinct()


def orphans(known: DataFrame, targets: DataFrame) -> DataFrame:
    """Known urls that are no link target. Both sides are unique, so no key is hot."""
    return known.select("site", "url").distinct().join(targets.select("site", "url"), ["site", "url"], "left_anti")


def in_degree(graph: DataFrame) -> DataFrame:
    """Distinct sources per target; repeated links are combined before they are counted."""
    return (
        graph.filter("is_internal").select("site", "dst_url", "src_url").distinct()
        .groupBy("site", "dst_url").agg(F.count(F.lit(1)).alias("in_degree"))
    )


def _sample(df: DataFrame, column: str, name: str, limit: int = C.SAMPLE_LIMIT) -> DataFrame:
    return (
        top_k(df, ["site"], [F.col(column)], limit)
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(column)).alias(name))
    )


def internal_linking(features: DataFrame) -> DataFrame:
    """Link totals, orphan pages and the tiered score of every site."""
    totals = features.groupBy("site").agg(
        F.count(F.lit(1)).alias("_pages"), F.sum("internal_links_count").alias("total_internal_links")
    )
    lost = stored(orphans(features, internal_targets(features)), "orphans")
    counted = lost.groupBy("site").agg(F.count(F.lit(1)).alias("orphan_page_count"))
    joined = totals.join(counted, "site", "left").join(_sample(lost, "url", "orphan_pages_sample"), "site", "left")
    measured = joined.select(
        "site", "total_internal_links",
        N.round_half_even(F.col("total_internal_links") / F.col("_pages"), 1).alias("avg_links_per_page"),
        F.coalesce("orphan_page_count", F.lit(0)).alias("orphan_page_count"),
        F.coalesce("orphan_pages_sample", N.lit_array([])).alias("orphan_pages_sample"),
    )
    mean = F.col("avg_links_per_page")
    base = (
        F.when(F.col("total_internal_links") == 0, 0).when(mean < 3, 35).when(mean < 8, 70).otherwise(100)
    )
    score = F.greatest(F.lit(0), base - F.least(F.lit(20), F.col("orphan_page_count") * 3)).cast("int")
    return measured.withColumn("internal_link_score", score)


def outbound_profile(features: DataFrame) -> DataFrame:
    """Outbound links, distinct domains and their diversity."""
    domains = (
        unnest(features, "external_domains", "domain", ["site"]).distinct()
        .groupBy("site").agg(F.count(F.lit(1)).alias("outbound_domain_count"))
    )
    n = F.coalesce("outbound_domain_count", F.lit(0))
    return (
        features.groupBy("site").agg(F.sum("external_links_count").alias("outbound_link_count"))
        .join(domains, "site", "left")
        .select(
            "site", "outbound_link_count", n.alias("outbound_domain_count"),
            F.when(n < 3, "Low").when(n < 15, "Medium").otherwise("High").alias("outbound_domain_diversity"),
        )
    )


def link_rating(score: Column) -> Column:
    return (
        F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Average").otherwise("Poor")
    )


def graph_link_score(all_urls: DataFrame, graph: DataFrame) -> DataFrame:
    """Score from mean in-links and orphans; targets outside of the url list count too."""
    degrees = in_degree(graph)
    lost = orphans(all_urls, degrees.withColumnRenamed("dst_url", "url"))
    pages = all_urls.select("site", "url").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("total_pages"))
    incoming = degrees.groupBy("site").agg(F.sum("in_degree").alias("incoming"))
    counted = lost.groupBy("site").agg(F.count(F.lit(1)).alias("orphans"))
    joined = pages.join(incoming, "site", "left").join(counted, "site", "left").select(
        "site", "total_pages",
        F.coalesce("incoming", F.lit(0)).alias("incoming"),
        F.coalesce("orphans", F.lit(0)).alias("orphans"),
    )
    mean = F.col("avg_links_per_page")
    base = F.when(mean < 1, 20).when(mean < 3, 45).when(mean < 8, 70).otherwise(100)
    return (
        joined.withColumn("avg_links_per_page", N.round_half_even(F.col("incoming") / F.col("total_pages"), 1))
        .withColumn("score", F.greatest(F.lit(0), base - F.least(F.lit(25), F.col("orphans") * 4)).cast("int"))
        .withColumn("rating", link_rating(F.col("score")))
        .drop("incoming")
    )


def known_status(link_status: DataFrame) -> DataFrame:
    """One row per url that has a status: of several a failure counts before the others, then the highest."""
    code = F.col("status_code")
    rank = F.max(F.when(S.is_broken(code), F.lit(10_000)).otherwise(0) + code).alias("_rank")
    one = link_status.filter(code.isNotNull()).groupBy("url").agg(rank)
    return one.select("url", (F.col("_rank") % 10_000).cast("int").alias("status_code"))


def checked_links(graph: DataFrame, link_status: DataFrame) -> DataFrame:
    """Every distinct internal target of each site with its first place and its status.

    ``state`` is ``ok``, ``broken`` or, for a target whose status is not known, ``unknown``;
    only known ones are judged.
    """
    first = (
        graph.filter("is_internal").groupBy("site", "dst_url")
        .agg(F.min(F.struct("page_id", "pos", "src_url")).alias("f"))
        .select("site", "dst_url", "f.*")
    )
    known = known_status(link_status).withColumnRenamed("url", "dst_url")
    state = F.when(F.col("status_code").isNull(), "unknown").when(S.is_broken(F.col("status_code")), "broken").otherwise("ok")
    return first.join(known, "dst_url", "left").select(
        "site", "page_id", "pos", "src_url", "dst_url", "status_code", state.alias("state")
    )


def broken_summary(checked: DataFrame, samples: int = C.SAMPLE_LIMIT) -> DataFrame:
    """Judged, broken and unknown links, the broken share of the judged ones, and the first
    broken ones of each site; ``checked`` itself is the full list."""
    state = F.col("state")
    totals = checked.groupBy("site").agg(
        F.count_if(state != "unknown").alias("checked_count"), F.count_if(state == "broken").alias("broken_count"),
        F.count_if(state == "unknown").alias("unknown_count"),
    )
    order = [F.col("page_id"), F.col("pos"), F.col("dst_url")]
    sample = (
        top_k(checked.filter(state == "broken"), ["site"], order, samples)
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "src_url", "dst_url", "status_code"))).alias("broken_links"))
    )
    return totals.join(sample, "site", "left").withColumn(
        "broken_ratio", N.percent(F.col("broken_count"), F.col("checked_count"))
    )


def _dealt(df: DataFrame, name: str) -> DataFrame:
    """Store rows ordered by their ``bucket``, so that a reader of some buckets skips the rest by
    the statistics of files and row groups; a large bucket is split."""
    return stored(df.hint("rebalance", "bucket").sortWithinPartitions("bucket"), name)


def _held(df: DataFrame) -> tuple[list[int], int]:
    """The buckets that have rows, of a fixed number of them, and how many rows there are."""
    r = df.agg(F.collect_set("bucket").alias("buckets"), F.count(F.lit(1)).alias("n")).first()
    return sorted(r.buckets), r.n


class _Visited:
    """Urls found so far, in stored runs of buckets. When there are more than ``keep`` runs, the
    last takes in the one before it while it has half of its size, so there are few runs, a row
    is rewritten a few times, and most levels rewrite nothing."""

    def __init__(self, keep: int = 4):
        self.runs: list[tuple[DataFrame, int]] = []
        self.keep = keep

    def add(self, rows: DataFrame, n: int) -> None:
        self.runs.append((rows, n))
        if len(self.runs) <= self.keep:
            return
        merge = 1
        while merge < len(self.runs) and 2 * sum(n for _, n in self.runs[-merge:]) >= self.runs[-merge - 1][1]:
            merge += 1
        if merge > 1:
            some = self.runs[-merge:]
            del self.runs[-merge:]
            self.runs.append((_dealt(reduce(DataFrame.unionByName, [r for r, _ in some]), "visited"), sum(n for _, n in some)))

    def count(self) -> int:
        return sum(n for _, n in self.runs)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [r for r, _ in self.runs])


def reachability(
    starts: DataFrame, graph: DataFrame, max_depth: int | None = None, max_pages: int | None = None, buckets: int = 256,
    few: int = 100_000,
) -> DataFrame:
    """Lowest depth of every url that can be reached from the start urls of its site.

    One step per level, until a level finds nothing new or ``max_depth`` is reached where
    it is given. Links are stored by buckets of their source and visited urls by the same
    buckets, so a level with a few new urls reads their buckets of the links and the buckets
    of its candidates among the visited, whatever was found before. Where a level has as many
    urls as there are buckets, or few urls were found so far, there is little to leave out, and
    its candidates go on to the visited urls without being stored. All levels are stored in
    the shared folder: lineage does not grow and a lost executor costs one level.
    ``max_pages`` is a crawl limit per site, by depth and url, for callers that want one.
    """
    bucket = lambda url: F.pmod(F.xxhash64("site", url), F.lit(buckets)).cast("int")
    links = graph.filter("is_internal").select("site", "src_url", "dst_url").distinct()
    links = _dealt(links.withColumn("bucket", bucket("src_url")), "links")
    first = starts.select("site", "url").distinct().withColumns({"depth": F.lit(0), "bucket": bucket("url")})
    frontier, visited, depth = _dealt(first, "level"), _Visited(), 0
    held, n = _held(frontier)
    visited.add(frontier, n)
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        at = frontier.select("bucket", "site", F.col("url").alias("src_url"), "depth")
        some = links if len(held) == buckets else links.filter(F.col("bucket").isin(held))
        # the depth comes from the rows: a number in the plan would be new code to compile at every level
        step = at.join(some, ["bucket", "site", "src_url"]).groupBy("site", F.col("dst_url").alias("url"))
        step = step.agg((F.min("depth") + 1).alias("depth")).withColumn("bucket", bucket("url"))
        known = visited.rows()
        if n < buckets and visited.count() > few:
            step = stored(step, "candidates")
            tried, n = _held(step)
            if not n:
                break
            known = known.filter(F.col("bucket").isin(tried))
        # joined by the keys that the step is grouped by: its rows are not shuffled again
        new = step.join(known.select("site", "url"), ["site", "url"], "left_anti")
        frontier = _dealt(new.select("site", "url", "depth", "bucket"), "level")
        held, n = _held(frontier)
        if n:
            visited.add(frontier, n)
    found = visited.rows().select("site", "url", "depth")
    if max_pages:
        found = top_k(found, ["site"], [F.col("depth"), F.col("url")], max_pages).drop("rank")
    return found
