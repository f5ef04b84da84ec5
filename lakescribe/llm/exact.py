"""Exact duplicates by deterministic block naming, in DataFrame functions alone.

Texts without white space are cut into blocks of fixed size. The distinct
blocks are sorted and named by integers; then the names of adjacent blocks are
paired, the distinct pairs sorted and named, and so on until every document
has one name. Names stand for texts, never for hashes of them, so equal names
mean equal texts. The first block is named, with the length, before the
others: a document whose first name no other has is alone, and needs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.session import materialized

#: Bytes of a block. A document of n blocks takes log2(n) rounds of pairs.
BLOCK_BYTES = 512

#: The white space that texts are compared without (a fixed value).
WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def row_key() -> Column:
    """What a row is found again by: its id, which may be null, and a fingerprint of its text."""
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"))


def named(keys: DataFrame) -> DataFrame:
    """The distinct rows of ``keys`` with an integer ``name`` each, in sorted order.

    They are sorted by range, so no task sees all, and written, so that names stay.
    """
    distinct = keys.distinct().orderBy(*keys.columns)
    return materialized(distinct.withColumn("name", F.monotonically_increasing_id()), "names")


def block_names(bodies: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(row, name): one name per row of ``bodies`` (row, body, blocks), equal where the bodies are.

    Names compare within the rows of equal length. Rows that come twice are
    named once. ``blocks`` is the number of blocks of the binary ``body``, at
    least 1.
    """
    cut = bodies.select(
        "row",
        "blocks",
        F.posexplode(F.expr(f"transform(sequence(0, blocks - 1), i -> substring(body, i * {block} + 1, {block}))")).alias(
            "place", "block"
        ),
    )
    cut = materialized(cut, "blocks")
    level = cut.join(named(cut.select("block")), "block").select("row", "blocks", "place", "name")
    level = materialized(level, "level")
    finished = None
    while True:
        done = level.filter("blocks = 1").select("row", "name").distinct()
        finished = done if finished is None else finished.unionByName(done)
        level = level.filter("blocks > 1")
        if level.isEmpty():
            return finished
        pairs = level.groupBy("row", "blocks", F.expr("place div 2").alias("place")).agg(
            F.max(F.expr("if(place % 2 = 0, name, null)")).alias("left"),
            F.coalesce(F.max(F.expr("if(place % 2 = 1, name, null)")), F.lit(-1)).alias("right"),
        )
        pairs = materialized(pairs, "pairs")
        level = materialized(
            pairs.join(named(pairs.select("left", "right")), ["left", "right"]).select(
                "row", F.expr("(blocks + 1) div 2").alias("blocks"), "place", "name"
            ),
            "level",
        )


def duplicates(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """keep_id, group_size, kept and text_sha256 of every row of ``docs``, dropped ones too.

    ``docs`` needs doc_id and text; other columns are ignored. Texts are equal
    when they are after all white space is taken out; null counts as empty,
    and empty texts are equal. Of equal texts the row with the most code
    points in its original text stays, then that with the smallest id, null
    last. Of rows that are the same in both, one stays. An empty table gives
    no rows.
    """
    size = F.octet_length("body")
    rows = docs.select(row_key().alias("row"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), normalized().alias("body"))
    rows = rows.select(
        "row",
        "points",
        size.alias("size"),
        F.substring(F.col("body").cast("binary"), 1, block).alias("head"),
        F.unhex(F.sha2("body", 256)).alias("sha"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = materialized(rows, "rows")
    heads = named(rows.groupBy("size", "head").count().filter("count > 1").select("size", "head"))
    tied = materialized(
        rows.join(heads, ["size", "head"]).select("row", "number", "points", "size", F.col("name").alias("kin")), "tied"
    )
    # Documents of one block are told apart by their first name already.
    # They are always shuffled to the texts, so that the work is alike at every size.
    longer = tied.filter(F.col("size") > block).select("row").distinct().hint("merge")
    bodies = (
        docs.select(row_key().alias("row"), "text")
        .join(longer, "row", "left_semi")
        .select("row", normalized().cast("binary").alias("body"))
        .withColumn("blocks", F.expr(f"int((octet_length(body) + {block - 1}) div {block})"))
    )
    names = block_names(bodies, block)
    grouped = tied.join(names, "row", "left").select(
        "number", "points", "row.id", "kin", F.coalesce("name", F.lit(-1)).alias("name")
    )
    grouped = materialized(grouped, "grouped")
    best = grouped.groupBy("kin", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col("number"))).alias("best"),
    )
    # Written, so that the rows of a large group are joined by themselves and can be split.
    best = materialized(best.filter("group_size > 1"), "best")
    decided = grouped.join(best, ["kin", "name"]).select(
        "number",
        "group_size",
        F.col("best.id").alias("keep_id"),
        (F.col("number") == F.col("best.number")).alias("kept"),
    )
    return rows.join(decided, "number", "left").select(
        F.col("row.id").alias("doc_id"),
        F.when(F.col("kept").isNull(), F.col("row.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("row.print").alias("print"),
    )
