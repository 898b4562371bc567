"""Sinks: linked tables, snapshots, event lines, sitemap files and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.operators.ranking import numbered


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """The linked tables as a first load, partitioned by bucket. For changes to stored audits,
    deletes above all, use ``audit_store.AuditStore``."""
    for name, table in tables.items():
        writer = table.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        if "site_bucket" in table.columns:
            writer = writer.partitionBy("site_bucket")
        writer.parquet(f"{folder}/{name}")


def append_snapshot(snapshot: DataFrame, folder: str) -> None:
    snapshot.write.mode("append").parquet(folder)


def write_event_lines(events: DataFrame, folder: str, mode: str = "append") -> None:
    """One JSON object per line."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(folder)


def write_sitemaps(rows: DataFrame, folder: str, per_file: int = C.SITEMAP_FILE_LIMIT, buckets: int = 64) -> None:
    """Sitemap XML files and one index per site, below ``bucket=/site=/part=``.

    Urls are numbered within their site, by range partitions, and a file has exactly
    ``per_file`` of them, but for a site's last one; a huge site is written by many tasks.
    Sites are dealt to ``buckets`` folders, so that no folder lists them all. The index of a
    site (``part=index``) names its files as they were written. ``sitemap_folders`` reads
    the names back.
    """
    placed = numbered(rows, "site", ["loc"], "_place").withColumn("part", F.expr(f"(_place - 1) div {per_file}").cast("string"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int"))

    def write(df: DataFrame, root: str, tag: str) -> None:
        (
            df.write.mode("append").format("xml").option("rootTag", f'{root} xmlns="{C.SITEMAP_NAMESPACE}"').option("rowTag", tag)
            .option("compression", "none").partitionBy("bucket", "site", "part").save(folder)
        )

    files = placed.repartition("bucket", "site", "part").sortWithinPartitions("bucket", "site", "part", "_place").drop("_place")
    write(files, "urlset", "url")
    index = sitemap_folders(rows.sparkSession, folder).select("bucket", "site", F.concat("part", F.lit("/"), "name").alias("loc"), "part")
    index = index.repartition("bucket", "site").sortWithinPartitions("bucket", "site", F.col("part").cast("bigint"))
    write(index.withColumn("loc", F.concat(F.lit("part="), "loc")).withColumn("part", F.lit("index")), "sitemapindex", "sitemap")


def sitemap_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, site, part, name) of the files that ``write_sitemaps`` has written; the names are listed by tasks."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder).select("path")
    at = lambda key: F.url_decode(F.regexp_extract("path", f"/{key}=([^/]*)/", 1))
    return listed.select(at("bucket").cast("int").alias("bucket"), at("site").alias("site"), at("part").alias("part"), F.regexp_extract("path", "[^/]*$", 0).alias("name"))


def write_report(documents: DataFrame, folder: str) -> None:
    documents.write.mode("overwrite").json(folder)


def write_report_tables(tables: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").format(format).option("header", True).save(f"{folder}/{name}")
