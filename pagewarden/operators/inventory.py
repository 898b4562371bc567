"""Page-wise title and description inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions.urls import strip_space
from pagewarden.operators.ranking import flag_repeated, numbered
from pagewarden.session import stored

_FLAGS = {
    "missing_titles": "Missing Title", "short_titles": "Title Too Short", "long_titles": "Title Too Long",
    "missing_metas": "Missing Meta Description", "short_metas": "Meta Too Short", "long_metas": "Meta Too Long",
    "duplicate_titles": "Duplicate Title", "duplicate_metas": "Duplicate Meta Description",
}


def inventory(features: DataFrame) -> DataFrame:
    """One numbered row per page with its title and description status."""
    pages = features.select(
        "site", "page_id", "url",
        strip_space(F.coalesce("title", F.lit(""))).alias("title"),
        strip_space(F.coalesce("description", F.lit(""))).alias("meta_description"),
    )
    pages = stored(pages, "inventory")  # read once for the rows and once for each duplicate count
    no_title = F.col("title").isin("", "N/A")
    no_meta = F.col("meta_description").isin("", "Not Found")
    pages = flag_repeated(pages, ["site", "title"], "duplicate_titles", no_title)
    pages = flag_repeated(pages, ["site", "meta_description"], "duplicate_metas", no_meta)
    t = F.when(no_title, 0).otherwise(F.length("title"))
    m = F.when(no_meta, 0).otherwise(F.length("meta_description"))
    flagged = pages.select(
        "site", "page_id", "url", "title", "meta_description",
        t.alias("title_length"), m.alias("meta_desc_length"),
        no_title.alias("missing_titles"),
        (~no_title & (t < C.TITLE_MIN)).alias("short_titles"),
        (t > C.TITLE_MAX).alias("long_titles"),
        no_meta.alias("missing_metas"),
        (~no_meta & (m < C.META_MIN)).alias("short_metas"),
        (m > C.META_MAX).alias("long_metas"),
        "duplicate_titles", "duplicate_metas",
    )
    issues = F.array_compact(F.array(*[F.when(F.col(f), F.lit(text)) for f, text in _FLAGS.items()]))
    return numbered(flagged, "site", ["page_id"]).select(
        "s_no", "site", "page_id", "url",
        F.when(F.col("missing_titles"), "Not Found").otherwise(F.col("title")).alias("title"),
        "title_length",
        F.when(F.col("missing_metas"), "Not Found").otherwise(F.col("meta_description")).alias("meta_description"),
        "meta_desc_length",
        F.when(F.size(issues) > 0, F.array_join(issues, ", ")).otherwise("Good").alias("status"),
        (F.size(issues) > 0).alias("has_issue"),
        *_FLAGS,
    )


def inventory_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"), *[F.count_if(F.col(f)).alias(f) for f in _FLAGS]
    )
