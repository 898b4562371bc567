"""First-of-key, top-k and numbering helpers that hold up when one key is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.session import stored


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key. Tasks drop their surplus before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[str], values: list[str], latest: bool = False) -> DataFrame:
    """The row with the lowest (or latest) order per key, as a combining aggregate."""
    pick = F.max_by if latest else F.min_by
    row = pick(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def numbered(df: DataFrame, key: str, order: list[str | Column], name: str = "s_no") -> DataFrame:
    """1-based number of every row within its key, in a unique order.

    One sort per key would put a whole hot key in one task. Rows are range-partitioned by
    key and order, which follows the rows and not the values of an id, numbered within
    their partition, and moved on by the counts of the partitions before. The partitioned
    rows are stored, so that all of it speaks of the same partitions.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [key, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
        .drop("_part", "_rn", "_before")
    )


def repeated_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def flag_repeated(df: DataFrame, keys: list[str], name: str, ignore: Column | None = None, hot_keys: int = 1000) -> DataFrame:
    """Flag rows whose key occurs more than once.

    Counting combines before the shuffle. Keys that hold at least one row in ``hot_keys`` of
    all repeated ones are at most that many, whatever the table, so they are broadcast, and
    their rows are dealt by themselves in the join with the other repeated keys, of which
    none is large: no task gets more than its share, with or without adaptive execution.
    """
    counted = df if ignore is None else df.filter(~ignore)
    repeated = stored(repeated_values(counted, keys), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(2, -(-total // hot_keys))
    known = df.join(F.broadcast(repeated.filter(hot).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(1 << 20)) + 1).otherwise(0).cast("bigint")
    cold = repeated.filter(~hot).select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.lit(True).alias(name))
    flagged = known.withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    return flagged.select(*df.columns, F.coalesce("_hot", name, F.lit(False)).alias(name))
