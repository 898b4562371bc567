"""Order MinHash fingerprints, in DataFrame functions alone.

A k-mer is ``k`` words in a row together with its occurrence number in the text. One
hash of it chooses a bin and its rank there; each bin takes its ``per_bin`` lowest
k-mers, puts them back in text order, and the hash of that tuple is the bin's place in
the signature. A bin that has fewer takes the next ones by bin and rank, round from the
last bin to the first, so that every tuple of a text of any length has its k-mers and
their order. Since tuples depend on order, the share of equal places follows edit
distance and not only the set of k-mers.
All steps are sorts of long arrays and binary searches in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions.numbers import let
from pagewarden.llm.common import id_text

PLACE_BITS = 28  # place of a k-mer in its text
RANK_BITS = 29  # rank of a k-mer in its bin
BIN_SHIFT = PLACE_BITS + RANK_BITS
PLACE = (1 << PLACE_BITS) - 1


def _steps(n: Column) -> Column:
    """Falling powers of two for a binary search among ``n``."""
    return F.transform(F.sequence(F.length(F.bin(n.cast("bigint"))) - 1, F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))


def _search(values: Column, n: Column, steps: Column, test: Callable[[Column], Column]) -> Column:
    """How many leading ``values`` pass ``test``; they pass up to some place and fail after it."""
    step = lambda at, s: F.when((at + s <= n) & test(F.get(values, at + s - 1)), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def signature(text: Column, k: int = 2, bins: int = 64, per_bin: int = 2) -> Column:
    """``bins`` 32-bit tuple hashes. A text of fewer than ``k`` words is one k-mer, the empty
    text too."""
    if not 1 <= bins <= 64:
        raise ValueError("bins must lie between 1 and 64")

    def kmers(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(words) - k)
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint"))
        )

    def numbered(found: Column) -> Column:
        """Bin, rank and place of each k-mer; equal ones stand together in text order, so the
        occurrence number is the distance to the first of them."""

        def one(s: Column, n: Column, steps: Column) -> Column:
            def place(x: Column, i: Column) -> Column:
                kmer = F.shiftright(x, PLACE_BITS)
                again = F.coalesce(F.shiftright(F.get(s, i - 1), PLACE_BITS) == kmer, F.lit(False))
                first = _search(s, n, steps, lambda v: v < F.shiftleft(kmer, PLACE_BITS))
                h = F.xxhash64(kmer, F.when(again, i - first).otherwise(F.lit(0)))
                at_bin = F.shiftleft(F.pmod(h, F.lit(bins).cast("bigint")), BIN_SHIFT)
                rank = F.shiftleft(F.shiftrightunsigned(h, 64 - RANK_BITS), PLACE_BITS)
                return at_bin.bitwiseOR(rank).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))

            return F.transform(s, place)

        return let(found, lambda s: let(F.size(s), lambda n: let(_steps(n), lambda steps: one(s, n, steps))))

    def tuples(v: Column) -> Column:
        def of_bin(s: Column, n: Column, steps: Column, b: Column) -> Column:
            start = _search(s, n, steps, lambda x: F.shiftrightunsigned(x, BIN_SHIFT) < b)
            rest = F.slice(s, start + 1, per_bin)
            lowest = F.concat(rest, F.slice(s, 1, F.lit(per_bin) - F.size(rest)))
            in_order = F.sort_array(F.transform(lowest, lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 64 - PLACE_BITS - 1).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS).bitwiseAND(F.lit((1 << (64 - PLACE_BITS - 1)) - 1)))))
            ids = F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << (64 - PLACE_BITS - 1)) - 1)))
            return F.hash(ids)

        return let(v, lambda s: let(F.size(s), lambda n: let(_steps(n), lambda steps: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: of_bin(s, n, steps, b)))))

    return tuples(F.sort_array(numbered(F.sort_array(let(F.split(text, " "), kmers)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(0))), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(rows: DataFrame, carry: list[str], blocks: int | None = None) -> DataFrame:
    """The columns ``carry`` of the next row by falling doc_id as next_*; after the last row the first.

    Rows are cut into blocks of the id range by quantiles, so that blocks follow the rows
    and not the ids. The first row of each block also visits the block above it, where the
    last row finds it. The table of block heads has at most ``blocks`` + 2 rows.
    """
    spark = rows.sparkSession
    blocks = blocks or min(20_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(F.percentile_approx("doc_id", [(i + 1) / blocks for i in range(blocks - 1)] or [0.5], 10_000).alias("c")).first().c or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array(F.lit(0))
    n = F.lit(len(set(cuts)) or 1)
    block = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_search(bounds, n, _steps(n), lambda v: v <= F.col("doc_id")))
    ids = rows.select("doc_id", block.alias("block"))
    up = Window.orderBy("block")
    heads = ids.groupBy("block").agg(F.max("doc_id").alias("head"))
    heads = heads.select("block", "head", F.coalesce(F.lead("block").over(up), F.first("block").over(up)).alias("above"))
    marked = rows.withColumn("block", block).join(F.broadcast(heads), "block")
    visits = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("block"), F.lit(0).alias("guest")), F.struct(F.col("above").alias("block"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("block"), F.lit(0).alias("guest")))
    )
    spread = marked.select(*rows.columns, F.explode(visits).alias("v")).select(*rows.columns, "v.block", "v.guest")
    order = Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), *carry)
    return spread.select(*rows.columns, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bins: int = 64, per_bin: int = 2) -> DataFrame:
    """doc_id, text and its signature, of every whole text; null text counts as empty."""
    return id_text(docs, id_col, text_col).withColumn("signature", signature(F.col("text"), k, bins, per_bin))


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bins: int = 64, per_bin: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last third replaced by the start of the next document's text
    (by falling id; rows that repeat an id by text; null ids last; after the last row the
    first, so a single row is its own next one). Ids must be numbers. Equal texts have
    equal fingerprints; an empty table gives no rows.
    """
    rows = with_next(fingerprints(docs, id_col=id_col, text_col=text_col, k=k, bins=bins, per_bin=per_bin), ["text", "signature"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "signature", "next_signature", signature(F.col("edited"), k, bins, per_bin).alias("edited_signature"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
