"""Schemas and readers of the other inputs: resources, link status, stored audits, local business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden import constants as C

SITE_RESOURCES = "site STRING, kind STRING, url STRING, status_code INT, content_type STRING, body STRING"
LINK_STATUS = "url STRING, status_code INT"
SEARCH_RESULTS = "query STRING, pos INT, href STRING"
REVIEWS = (
    "location STRING, reviews ARRAY<STRUCT<reviewId: STRING, reviewer: STRUCT<displayName: STRING>, "
    "starRating: STRING, comment: STRING, createTime: TIMESTAMP, updateTime: TIMESTAMP, "
    "reviewReply: STRUCT<comment: STRING, updateTime: TIMESTAMP>>>"
)
DAILY_SERIES = (
    "location STRING, multiDailyMetricTimeSeries ARRAY<STRUCT<dailyMetric: STRING, timeSeries: "
    "STRUCT<datedValues: ARRAY<STRUCT<date: STRUCT<year: INT, month: INT, day: INT>, value: DOUBLE>>>>>"
)
KEYWORDS = (
    "location STRING, keywords ARRAY<STRUCT<query: STRING, impressions: BIGINT, "
    "classification: ARRAY<STRING>, opportunity_score: INT>>"
)
PROFILES = (
    "name STRING, title STRING, primaryCategory STRUCT<displayName: STRING, categoryId: STRING>, "
    "additionalCategories ARRAY<STRUCT<displayName: STRING>>, phoneNumbers STRUCT<primaryPhone: STRING>, "
    "storeCode STRING, regularHours STRUCT<periods: ARRAY<STRUCT<openDay: STRING, openTime: STRING, "
    "closeDay: STRING, closeTime: STRING>>>, profile STRUCT<description: STRING>, websiteUri STRING, "
    "storefrontAddress STRUCT<regionCode: STRING, locality: STRING, postalCode: STRING, addressLines: ARRAY<STRING>>, "
    "categories STRUCT<primaryCategory: STRUCT<displayName: STRING, categoryId: STRING>>"
)


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(schema).load(path)


def reviews(raw: DataFrame) -> DataFrame:
    """One row per review; an absent reply is no reply."""
    return raw.select("location", F.explode("reviews").alias("r")).select(
        "location", F.col("r.reviewId").alias("review_id"), F.col("r.starRating").alias("star_rating"),
        F.col("r.comment").alias("comment"), F.col("r.createTime").alias("created_at"),
        F.col("r.reviewReply").isNotNull().alias("has_reply"),
    )


def daily_series(raw: DataFrame) -> DataFrame:
    """Nested series to ``location, metric, date, value``; a missing value is 0."""
    metrics = raw.select("location", F.explode("multiDailyMetricTimeSeries").alias("m"))
    values = metrics.select("location", F.col("m.dailyMetric").alias("metric"), F.explode("m.timeSeries.datedValues").alias("v"))
    return values.select(
        "location", "metric", F.make_date("v.date.year", "v.date.month", "v.date.day").alias("date"),
        F.coalesce("v.value", F.lit(0.0)).alias("value"),
    )


def search_keywords(raw: DataFrame) -> DataFrame:
    return raw.select("location", F.posexplode("keywords").alias("pos", "k")).select("location", "pos", "k.*")


def locations(raw: DataFrame) -> DataFrame:
    """Profiles under the names the location list uses."""
    return raw.select(
        "name", F.col("title").alias("locationName"),
        F.coalesce("categories.primaryCategory", "primaryCategory").alias("primaryCategory"),
        F.col("storefrontAddress").alias("address"), "phoneNumbers", F.col("websiteUri").alias("websiteUrl"),
    )


#: The linked tables of stored audits; documents are kept as their JSON text.
STORED = {
    "projects": "project_id STRING, url STRING, business_type STRING, seo_score INT, report_url STRING, site_favicon STRING, created_at TIMESTAMP, updated_at TIMESTAMP, site_bucket INT",
    "audit_results": "project_id STRING, overall_seo_health STRING, metric_summary STRING, findings STRING, updated_at TIMESTAMP, site_bucket INT",
    "ai_insights": "project_id STRING, executive_summary STRING, management_summary STRING, recommended_roadmap STRING, data_limitations STRING, insights STRING, updated_at TIMESTAMP, site_bucket INT",
    "seo_data": "project_id STRING, competitive_intelligence STRING, keyword_analysis STRING, updated_at TIMESTAMP, site_bucket INT",
    "crawl_data": "project_id STRING, crawl_overview STRING, pages STRING, page_speed STRING, link_analysis STRING, content_strategy STRING, updated_at TIMESTAMP, site_bucket INT",
}


def stored_tables(spark: SparkSession, folder: str, schemas: dict[str, str | T.StructType] = STORED) -> dict[str, DataFrame]:
    """The linked tables as ``sinks.write_tables`` leaves them, by explicit schemas: no file is
    opened to infer one, and a column that a table was written without is null."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.items()}


def metric_names() -> list[str]:
    return list(C.DAILY_METRICS)
