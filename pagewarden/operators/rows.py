"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, name: str, keep: list[str], pos: str | None = None) -> DataFrame:
    """One row per array member, none for an empty array.

    A plain explode makes the optimizer test ``size(array) > 0`` below it, and that
    filter repeats the whole expression behind the array, down to the scan. The outer
    form with a filter on its own output does not.
    """
    made = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())
