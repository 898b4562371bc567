"""Page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("response_ms", T.LongType()),
        T.StructField("depth", T.IntegerType()),
    ]
)
PAGES = T.StructType(RAW_PAGES.fields[:3])


def read_pages(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType = PAGES) -> DataFrame:
    """Fetched pages with an explicit schema, so nothing is inferred."""
    return spark.read.format(format).schema(schema).load(path)


def stream_pages(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType = PAGES,
    files_per_trigger: int = 1000, name_pattern: str | None = None,
) -> DataFrame:
    """Pages as they arrive; the number of files per batch is the back-pressure."""
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    return reader.load(path)


def html_only(pages: DataFrame) -> DataFrame:
    """Pages that were served as text/html; the test is on a plain column and reaches the scan."""
    return pages.filter(F.lower(F.coalesce("content_type", F.lit("text/html"))).contains("text/html"))
