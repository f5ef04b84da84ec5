"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is cut into blocks of ``BLOCK`` turns, one row per block with a
column per place. ROLLUP over these columns gives the nodes of all prefixes in
one aggregation, and grouping_id tells their depth. The blocks of a longer
conversation are keyed by the node the block before ends at, so all blocks are
rolled up together, however long a conversation is.

A node belongs to its smallest member, so (conv_id, depth) names it. What a
subtree sums is the sum of what its members' own nodes hold, less what the
node's owner holds above it: a second ROLLUP and a running total, no descent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.llm.ranges import running
from lakescribe.operators.skew import lookup
from lakescribe.session import materialized

#: Turns of a block, each a column of the ROLLUP.
BLOCK = 8

#: Conversations of a chunk of member lists: two to this power by id.
CHUNK_BITS = 13

#: Bytes of a turn id: a digest of role and text, and the size of the text.
_DIGEST, _ID = 16, 20


def turn_id() -> Column:
    """Identity of a turn's (role, text), with the text's size in UTF-8 bytes behind it; null counts as empty."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 2 * _DIGEST), F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, id): turns numbered from 1 within their conversation, written.

    Turns are ordered by number, null first; turns of one number follow by
    their digests, and a turn that comes twice counts twice. Rows without a
    conv_id belong to no conversation and are left out.
    """
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id().alias("id")
    )
    placed = running(materialized(turns, "turns"), ["conv_id"], ["turn", "id"], {"place": F.lit(1).cast("long")})
    return materialized(placed.select("conv_id", "place", "id"), "places")


def whole(turns: DataFrame) -> DataFrame:
    """(conv_id, place, id, size) for ``paths`` of conversations as they are."""
    return lookup(turns, turns.groupBy("conv_id").agg(F.count("*").alias("size")), ["conv_id"])


def with_shared_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, place, id, size) of conversations that begin like the first of their family.

    Conversation c takes over the first h turns of conversation c - c % family,
    all if it has fewer, none if there is no such one, and goes on with its own
    turns after its first h; h is crc32(c) % heads. A conversation that is left
    without turns has one row without place and id.
    """
    known = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = known.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    shapes = (
        known.withColumn("first", F.col("conv_id") - F.col("conv_id") % family)
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
        .join(first, "first", "left")
        .withColumn("head", F.least("h", F.coalesce("n_first", F.lit(0).cast("long"))))
        .withColumn("size", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    )
    shapes = materialized(shapes.select("conv_id", "first", "h", "head", "size"), "shapes")
    # A head row meets its own family only, which has 2 * family - 1 members at most.
    borrowed = (
        turns.filter(F.col("place") < heads)
        .withColumnRenamed("conv_id", "first")
        .join(shapes, "first")
        .filter("place <= head")
        .select("conv_id", "place", "id", "size")
    )
    own = (
        lookup(turns, shapes, ["conv_id"], "inner")
        .filter("place > h")
        .select("conv_id", F.expr("place - h + head").alias("place"), "id", "size")
    )
    none = shapes.filter("size = 0").select(
        "conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("id"), "size"
    )
    return borrowed.unionByName(own).unionByName(none)


_TURNS = [f"t{i}" for i in range(BLOCK)]


def _lanes() -> list[Column]:
    """Two 64-bit hashes of a block's turns and its number."""
    return [F.xxhash64(F.lit(seed), "block", *_TURNS).cast("decimal(20,0)") for seed in (1, 2)]


def blocks(paths: DataFrame) -> DataFrame:
    """(conv_id, size, block, t0.., k1, k2): one row per block of a conversation, written.

    k1 and k2 key a block by the node before it: sums of the hashes of all
    earlier blocks, 128 bits, so that no block waits for another's node.
    """
    inside = (F.col("place") - 1) % BLOCK
    cut = paths.groupBy("conv_id", F.expr(f"coalesce((place - 1) div {BLOCK}, 0)").alias("block")).agg(
        F.max("size").alias("size"), *(F.max(F.when(inside == i, F.col("id"))).alias(t) for i, t in enumerate(_TURNS))
    )
    cut = materialized(cut, "blocks")
    one, two = _lanes()
    kind = "decimal(38,0)"
    zero = F.lit(0).cast(kind)
    several = running(cut.filter(F.col("size") > BLOCK), ["conv_id"], ["block"], {"k1": one, "k2": two}).withColumns(
        {"k1": (F.col("k1") - one).cast(kind), "k2": (F.col("k2") - two).cast(kind)}
    )
    single = cut.filter(F.col("size") <= BLOCK).withColumns({"k1": zero, "k2": zero})
    return materialized(single.unionByName(several), "keyed")


def _name(level: Column, ids: Column) -> Column:
    """Name of the node ``level`` turns into its block; a full block has the name that keys the next one."""
    one, two = _lanes()
    kind = "decimal(38,0)"
    full = F.concat_ws("|", F.col("block") + 1, (F.col("k1") + one).cast(kind), (F.col("k2") + two).cast(kind))
    start = F.concat_ws("|", F.col("block"), F.col("k1"), F.col("k2"))
    within = F.concat_ws("|", start, F.hex(F.substring(ids, F.lit(1), (_ID * level).cast("int"))))
    text = F.when(level == BLOCK, full).when(level == 0, start).otherwise(within)
    return F.unhex(F.md5(text.cast("binary")))


def _ids() -> Column:
    return F.concat(*(F.coalesce(t, F.lit(b"")) for t in _TURNS))


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """(block, k1, k2, t0.., level, conv_id, sums): one row per node, by one ROLLUP over the places of all blocks."""
    rolled = rows.sparkSession.sql(
        f"""
        SELECT block, k1, k2, {", ".join(_TURNS)}, {BLOCK} - bit_count(grouping_id()) AS level,
               min(conv_id) AS conv_id, {sums}
        FROM {{rows}} GROUP BY block, k1, k2, ROLLUP ({", ".join(_TURNS)})
        """,
        rows=rows,
    )
    # Places after a conversation's end are no nodes, and a block's start is the node the last one ends at.
    return rolled.withColumn("last", F.get(F.array(*_TURNS), F.col("level") - 1)).filter(
        "last IS NOT NULL OR level = 0 AND block = 0"
    )


def _list_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) from (name, conv_id): SHA-256 of the ids in order, joined by commas.

    Ids are joined in chunks of close ids, of a bounded number each, and the
    chunks of a node hashed one after the other as they stream by in order.
    """
    chunks = ends.groupBy("name", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.expr("array_join(transform(sort_array(collect_list(conv_id)), c -> cast(c AS string)), ',')").alias("ids")
    )

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
            names, done = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(done, pa.string())], ["name", "ends_sha256"])

        name, state, out = None, None, []
        for part in batches:
            for own, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if own == name:
                    state.update(b",")
                else:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256()
                state.update(ids.encode())
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if name is not None:
            out.append((name, state.hexdigest()))
        yield batch(out)

    return (
        chunks.repartition("name").sortWithinPartitions("name", "chunk").mapInArrow(digest, "name binary, ends_sha256 string")
    )


def trie(paths: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``paths`` (conv_id, place from 1, id, size).

    One row per distinct sequence of first turns, from the root of depth 0:
    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes of the subtree, the node
    itself if it has no child), saved_tokens ((n_convs - 1) times the bytes of
    a node's last text, summed over the subtree) and ends_sha256 (of the
    members that end here). A conversation without turns is a member of the
    root. No rows at all give no nodes. Every node of a conversation is a row,
    so the longest conversations need no wider one.
    """
    level = F.col("level")
    rows = blocks(paths)
    size = F.conv(F.hex(F.substring("last", _DIGEST + 1, _ID - _DIGEST)), 16, 10).cast("long")
    nodes = _rolled(rows, "count(*) AS n_convs, max(size) AS deepest").select(
        "conv_id",
        (F.col("block") * BLOCK + level).alias("depth"),
        "n_convs",
        ((F.col("n_convs") - 1) * F.coalesce(size, F.lit(0).cast("long"))).alias("saved"),
        (F.col("deepest") == F.col("block") * BLOCK + level).cast("long").alias("leaf"),
        _name(level, _ids()).alias("name"),
        F.when(level > 0, _name(level - 1, _ids())).alias("parent"),
    )
    nodes = materialized(nodes, "nodes")
    held = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    weighed = lookup(rows, held, ["conv_id"])
    below = _rolled(weighed, "sum(coalesce(saved, 0)) AS saved_all, sum(coalesce(leaves, 0)) AS n_leaves").select(
        "conv_id", (F.col("block") * BLOCK + level).alias("depth"), "saved_all", "n_leaves"
    )
    last = F.greatest(F.col("size") - 1, F.lit(0).cast("long"))
    ends = (
        rows.filter(F.col("block") == F.floor(last / BLOCK))
        .withColumn("level", (F.col("size") - F.col("block") * BLOCK).cast("int"))
        .select(_name(level, _ids()).alias("name"), "conv_id")
    )
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    owners = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    above = running(nodes, ["conv_id"], ["depth"], {"upto": F.col("saved")})
    found = lookup(above, owners, ["parent"])
    return (
        found.join(below, ["conv_id", "depth"])
        .join(children, "name", "left")
        .join(_list_digests(ends), "name", "left")
        .select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves",
            F.expr("saved_all - upto + saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        )
    )
