"""A trie of conversation prefixes, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. A row of a conversation names its node by
its depth and a 128-bit exclusive-or over the hashes of (place, role, text) of the turns
up to it: such names combine in any order, so a conversation of any length is named in
blocks of turns, and a node's parent is its name without its last turn. From then on only
numbers are moved.

Totals over subtrees come from tree contraction. A round rakes all leaves into their
parents and takes out every other node of unary chains (compress); each is a join of
stored tables, so a chain of n turns is gone after about log n rounds and a lost executor
costs one round at most. The rounds are then walked backwards: a node taken out of a
chain has the total of the node that was below it and what lay between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import columns_of, stored
from pagewarden.operators.ranking import numbered

OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE = ["depth", "p1", "p2"]


def ordered(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place from 1, role, text), ordered by turn, null first; equal turns by role and text.

    Null roles and texts become empty. Rows without a conversation id belong to none and go.
    """
    empty = F.lit("")
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    return stored(numbered(rows, "conv_id", ["turn", "role", "text", "row"], "place").select("conv_id", "place", "role", "text"), "turns")


def forked(turns: DataFrame, *, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on their family's first one, and the ids of all of them.

    Conversation c starts with the first h turns of c - c % family (fewer if it has fewer),
    h = crc32(c) % longest, and goes on with its own turns after its first h.
    """
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    base, h = F.col("conv_id") - F.col("conv_id") % family, F.crc32(F.col("conv_id").cast("string")) % longest
    convs = sizes.select("conv_id", base.alias("base"), h.alias("h"))
    lenders = turns.filter((F.col("conv_id") % family == 0) & (F.col("place") < longest)).withColumnRenamed("conv_id", "base")
    lent = convs.join(lenders, "base").filter("place <= h").select("conv_id", "place", "role", "text")
    short = convs.join(sizes.toDF("base", "has"), "base", "left").select("conv_id", (F.col("h") - F.coalesce("has", F.lit(0))).alias("lacks")).filter("lacks > 0")
    own = turns.filter(F.col("place") > h).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("lacks", F.lit(0))).alias("place"), "role", "text")
    return lent.unionByName(own), sizes.select("conv_id")


def _paths(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, depth, name (p1, p2) and parent's name (q1, q2) of every turn, and its text's bytes."""
    name = lambda salt: F.xxhash64(F.lit(salt), "place", "role", "text")
    rows = turns.select("conv_id", "place", name(1).alias("x1"), name(2).alias("x2"), F.octet_length("text").cast("bigint").alias("bytes"))
    rows = stored(rows.withColumn("block", F.expr(f"(place - 1) div {block}")), "turn-names")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("conv_id", "block", *[F.bit_xor(f"x{i}").over(before).alias(f"c{i}") for i in (1, 2)]).filter("block > 0")
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"x{i}").over(inside).alias(f"i{i}") for i in (1, 2)]).join(carry, ["conv_id", "block"], "left")
    for i in (1, 2):
        rows = rows.withColumn(f"p{i}", F.col(f"i{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("bigint"))))
        rows = rows.withColumn(f"q{i}", F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")))
    return stored(rows.select("conv_id", F.col("place").alias("depth"), "p1", "p2", "q1", "q2", "bytes"), "paths")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks of ids, comma-joined; the rows come ordered by node and chunk."""
    at, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*columns_of(batch, *NODE, "ids"), strict=True):
            if node == at:
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                yield row()
            at, state = node, hashlib.sha256(ids.encode())
    if at is not None:
        yield row()


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node.

    Up to 256 neighbouring ids are one string before they meet at their node, where the
    digest runs over a stream of strings.
    """
    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    none = F.lit(0).cast("bigint")
    ends = paths.join(last, ["conv_id", "depth"]).select("conv_id", *NODE)
    ends = ends.unionByName(convs.join(last, "conv_id", "left_anti").select("conv_id", none.alias("depth"), none.alias("p1"), none.alias("p2")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = stored(ends.groupBy(*NODE, F.shiftright("conv_id", 8).alias("chunk")).agg(listed.alias("ids")), "ends")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(_digests, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _coin(c: Column, d: Column, turn: int) -> Column:
    """0 or 1 for a node in a round: a bit of its depth, which alternates along a chain, or of a hash."""
    if turn % 3 == 2:
        return F.xxhash64(c, d, F.lit(turn)).bitwiseAND(F.lit(1))
    return F.shiftright(d, (turn - turn // 3) % 40).bitwiseAND(F.lit(1))


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, *values): sums over the subtrees of nodes (c, d, pc, pd, n_children, *values).

    (pc, pd) is the parent, null at the only root. Values are whole numbers.
    """
    zero = F.lit(0).cast("bigint")
    state = stored(nodes.select("c", "d", "pc", "pd", F.col("n_children").alias("k"), *values, *[zero.alias(f"e_{v}") for v in values]), "contracted")
    below, done, records, turn = F.col("pc").isNotNull(), [], [], 0
    open_rows = not state.filter(below).isEmpty()
    while open_rows:
        leaves = state.filter((F.col("k") == 0) & below)
        done.append(leaves.select("c", "d", *values))
        raked = leaves.groupBy("pc", "pd").agg(F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(f"e_{v}")).alias(f"g_{v}") for v in values]).withColumnsRenamed({"pc": "c", "pd": "d"})
        rest = state.filter((F.col("k") > 0) | ~below).join(raked, ["c", "d"], "left")
        rest = rest.withColumns({"k": F.col("k") - F.coalesce("gone", zero), **{v: F.col(v) + F.coalesce(f"g_{v}", zero) for v in values}})
        above = _coin(F.col("pc"), F.col("pd"), turn)
        out = (F.col("k") == 1) & below & (_coin(F.col("c"), F.col("d"), turn) == 1) & (above == 0)
        rest = stored(rest.select("c", "d", "pc", "pd", "k", *values, *[f"e_{v}" for v in values], F.coalesce(out, F.lit(False)).alias("out")), "raked")
        # a node that goes hands its parent and its sum to the one node below it
        gone = rest.filter("out").select(
            F.col("c").alias("vc"), F.col("d").alias("vd"), F.col("pc").alias("v_pc"), F.col("pd").alias("v_pd"),
            *[F.col(v).alias(f"own_{v}") for v in values], *[(F.col(v) + F.col(f"e_{v}")).alias(f"add_{v}") for v in values],
        )
        stays = rest.filter("not out").drop("out")
        may = below & (above == 1) & (F.col("pd") > 0)
        met = stays.filter(may).join(gone, (F.col("pc") == F.col("vc")) & (F.col("pd") == F.col("vd")), "left")
        columns = ["c", "d", F.coalesce("v_pc", "pc").alias("pc"), F.coalesce("v_pd", "pd").alias("pd"), "k", *values]
        columns += [(F.col(f"e_{v}") + F.coalesce(f"add_{v}", zero)).alias(f"e_{v}") for v in values]
        met = met.select(*columns, "vc", "vd", *[(F.col(f"e_{v}") + F.col(f"own_{v}")).alias(f"r_{v}") for v in values])
        null = F.lit(None).cast("bigint")
        past = stays.filter(~may | ~below).select(*stays.columns, null.alias("vc"), null.alias("vd"), *[null.alias(f"r_{v}") for v in values])
        state = stored(met.unionByName(past), "contracted")
        records.append(state.filter("vc is not null").select("c", "d", "vc", "vd", *[f"r_{v}" for v in values]))
        left = state.agg(F.count("pc").alias("open"), F.count("vc").alias("taken")).first()
        open_rows = left.open > 0
        if not left.taken:
            records[-1] = None
        turn += 1
    # the totals that rounds after this one settle, then those of the nodes this round took out
    known = state.filter(~below).select("c", "d", *values)
    for leaves, taken in zip(reversed(done), reversed(records), strict=True):
        if taken is not None:
            back = taken.join(known, ["c", "d"]).select(F.col("vc").alias("c"), F.col("vd").alias("d"), *[(F.col(v) + F.col(f"r_{v}")).alias(v) for v in values])
            known = known.unionByName(stored(back, "expanded"))
        known = known.unionByName(leaves)
    return known


def trie(turns: DataFrame, convs: DataFrame, *, block: int = 8192) -> DataFrame:
    """One row per node of the conversations ``convs`` (conv_id) with ``turns`` (conv_id, place, role, text).

    Places run from 1 without gaps. Columns: conv_id (smallest member), depth (0: the root,
    whose members are all conversations, turnless ones too), parent_conv_id (the parent's
    conv_id, null at the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (over the subtree, bytes of a node's last text for every member
    but one) and ends_sha256 (of the ascending, comma-joined ids of the members that end
    here; of the empty string where none does). No conversations give no rows.
    """
    paths = _paths(turns, block)
    none = F.lit(0).cast("bigint")
    found = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[none.alias(x) for x in NODE], "conv_id", "n_convs", none.alias("bytes"), *[F.lit(None).cast("bigint").alias(q) for q in ("q1", "q2")])
    nodes = stored(found.unionByName(root), "nodes")
    above = nodes.select(F.col("conv_id").alias("pc"), F.col("depth").alias("pd"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    linked = nodes.withColumn("pd", F.col("depth") - 1).join(above, ["pd", "q1", "q2"], "left")
    linked = stored(linked.select("conv_id", *NODE, "pc", F.when(F.col("depth") > 0, F.col("pd")).alias("pd"), "n_convs", "bytes"), "linked")
    kids = linked.filter("pc is not null").groupBy(F.col("pc").alias("conv_id"), F.col("pd").alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = linked.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", none))
    counted = stored(counted, "counted")
    weighed = counted.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), "pc", "pd", "n_children",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"]).withColumnsRenamed({"c": "conv_id", "d": "depth"})
    out = counted.join(totals, ["conv_id", "depth"]).join(_ends(paths, convs), NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.withColumn("parent_conv_id", F.col("pc")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).select(*OUT)
