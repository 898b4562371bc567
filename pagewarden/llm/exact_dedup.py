"""Exact duplicates by distributed most-significant-digit radix partitioning.

All texts are one group. A level splits every open group by the next bytes of its
texts; a group of one is done, a group whose texts have ended is a class of equal texts,
and the others go on. Levels read 32 bytes, then eight times as many each, so a text of
n bytes is settled after about log8(n) levels. Bytes are compared as they are; no digest
decides. Counts combine before the shuffle, and the join that hands a row its group is
one that adaptive execution can split when one group holds most rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import id_text, stored

OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
HOT_ROWS = 1000  # smaller groups are never dealt over several tasks


def normal_text(text: Column) -> Column:
    """White space runs as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _split(width: int) -> dict[str, Column]:
    return {
        "chunk": F.substring("rest", 1, width),
        "ended": F.octet_length("rest") <= width,
        "rest": F.expr(f"substring(rest, {width + 1})"),
    }


def _level(rows: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """The rows with what this level found: singles and ended groups have no ``group`` any more."""
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *([] if first else [F.min("row").alias("next"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stays")])
    )
    # stored apart from the join: only then can adaptive execution split the rows of a hot
    # group, and a lost executor cannot change which of repeated rows stays
    found = stored(found.filter("n > 1").withColumns({"key": F.xxhash64(*keys)}), "groups")
    rows, found = _salted(rows, found, keys)
    found = found.withColumnsRenamed({k: f"of_{k}" for k in [*keys, "salt"]})
    joined = rows.join(found.hint("merge"), [F.col(k) == F.col(f"of_{k}") for k in [*keys, "salt"]], "left")
    several = F.col("n").isNotNull()
    if first:  # nothing is settled but singles: rows are numbered when this level is stored
        return joined.select(
            "doc_id", "sha", F.when(several, F.monotonically_increasing_id()).alias("row"), F.col("chunk").alias("head"),
            F.when(several, F.when(F.col("ended"), F.lit(b"")).otherwise(F.col("rest"))).alias("rest"),
        )
    ended, goes_on = several & F.col("ended"), several & ~F.col("ended")
    return joined.select(
        "doc_id", "sha", "row", F.when(goes_on, F.col("next")).alias("group"), F.when(goes_on, F.col("rest")).alias("rest"),
        F.when(ended, F.col("stays.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(ended, F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("group_size"),
        (~ended | (F.col("stays.row") == F.col("row"))).alias("kept"),
    )


def _salted(rows: DataFrame, groups: DataFrame, keys: list[str], share: int = 500, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows and groups with a ``salt`` that deals the rows of a hot group over several tasks.

    Hot is a group with one row in ``share`` of all that are in groups, so there are at most
    that many, and their hashes are part of the plan. The group's own row is copied to each
    salt. A hash only says which rows are dealt; keys are still compared as they are.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = [r.key for r in groups.filter(F.col("n") >= max(HOT_ROWS, -(-total // share))).select("key").collect()]
    dealt = F.pmod(F.xxhash64("doc_id", "sha"), F.lit(salts)).cast("int")
    row_salt = F.when(F.xxhash64(*keys).isin(hot), dealt).otherwise(0) if hot else F.lit(0)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    group_salt = F.explode(F.when(F.col("key").isin(hot), every).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    return rows.withColumn("salt", row_salt), groups.withColumn("salt", group_salt).drop("key")


def _done(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = 32, growth: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too.

    Texts are equal when they are identical after each run of white space has become one
    space; null counts as empty. Of equal texts the row with the smallest id stays (null
    ids come last); of rows that repeat that id exactly one stays. The digest is only
    reported. An empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text", normal_text(F.col("text")))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.col("text").cast("binary").alias("rest"))
    width = first_bytes
    level = stored(_level(rows.withColumns(_split(width)), ["chunk", "ended"], True), "radix")
    single = level.filter("row is null").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    done = [_done(single)]
    open_rows = level.filter("row is not null").select("doc_id", "sha", "row", F.col("head").alias("group"), "rest")
    while not open_rows.isEmpty():
        width *= growth
        level = stored(_level(open_rows.withColumns(_split(width)), ["group", "chunk", "ended"], False), "radix")
        done.append(_done(level.filter("`group` is null")))
        open_rows = level.filter("`group` is not null").select("doc_id", "sha", "row", "group", "rest")
    return reduce(DataFrame.unionByName, done).select(*OUT)


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; of rows that repeat the
    id of one that stays, one row."""
    kept = exact_duplicates(docs, id_col=id_col, text_col=text_col).filter("kept").select("doc_id", "text_sha256")
    sha = F.sha2(normal_text(F.coalesce(text_col, F.lit(""))), 256)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    joined = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["sha"] == kept["text_sha256"]), "left_semi")
    return joined.dropDuplicates(["id", "sha"]).select("row.*")
