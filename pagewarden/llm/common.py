"""Shared pieces of the corpus operators: column picks, id types, stored intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.session import checkpoint_folder


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; other columns cannot clash later."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: what follows survives lost executors and prunes columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for files that tasks write themselves."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def id_bits(ids: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of ``bits`` bits with the places of the ids (``bit_place``) set.

    Its size is fixed: with more ids it only lets more rows through that were not meant.
    At most ``bits`` / 64 rows reach the driver.
    """
    place = bit_place(F.col(column), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).collect()
    table = np.zeros(bits // 64, np.int64)
    for r in words:
        table[r.at] = r.word
    return table.tobytes()


def hash_bits(rows: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of ``bits`` bits with the places of the hashes in ``column``, modulo ``bits``.

    Of fixed size, as ``id_bits``; the words come to the driver as one Arrow table.
    """
    place = F.pmod(F.col(column), F.lit(bits).cast("bigint"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return table.tobytes()


def bit_place(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits).cast("bigint"))


def bits_set(table: bytes, places: list[int]) -> np.ndarray:
    at = np.array(places, np.int64)
    return (np.frombuffer(table, np.int64)[at >> 6] >> (at & 63)) & 1 == 1


def columns_of(batch: pa.RecordBatch, *names: str) -> tuple[list, ...]:
    return tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def slices(rows: Iterator, size: int) -> Iterator[list]:
    """Rows in lists of ``size``, so that what a task holds does not grow with its partition."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part
