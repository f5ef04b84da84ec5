"""Sources mixed to target weights by weighted fair queueing, in DataFrame functions alone.

Every source queues its documents in a shuffled order, and again for every
repeat. A document leaves its queue at a virtual finish time: the words its
source has sent by then, divided by the source's target. All queues together
are sorted by that time over the whole cluster and sent until the budget is
spent. At time 1 every source has sent its target; a document in service then
is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.llm.ranges import running
from lakescribe.operators.skew import lookup
from lakescribe.session import materialized

#: Words and the white space around them (fixed values); one match for each word.
_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def words(text: str = "text") -> Column:
    """Number of words of a text, 0 where it is null: words become one letter each, and letters are counted."""
    return (
        F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.char_length(F.regexp_replace(text, _WORD, "x")))
        .otherwise(F.lit(0))
        .cast("long")
    )


def sized(docs: DataFrame) -> DataFrame:
    """number, doc_id, source, apart (no source), size, turn and print of every row, written.

    ``turn`` is the document's place in the shuffled order of its source. It
    hangs on the id, so that reruns agree; rows without one, or with the same
    one, follow by size and by the fingerprint of their text.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("number"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("apart"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        words().alias("size"),
        F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).alias("turn"),
        F.xxhash64("text").alias("print"),
    )
    return materialized(rows, "sizes")


def targets(rows: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> tuple[DataFrame, int]:
    """(apart, source, source_place, source_size, target) per source, and the budget in words.

    The sources, by code point and null last, take ``weights`` in turn and
    share ``percent`` of all words. No target passes ``repeats`` times its
    source's size; what is above is shared by weight among the others until
    none is above. That is one level of words per weight: sources are sorted
    by the level at which they are full, and the first that isn't full at the
    level left by those before it sets the level of all that follow.
    """
    one = F.lit(1).cast("long")
    sources = materialized(rows.groupBy("apart", "source").agg(F.sum("size").alias("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    placed = running(sources, [], ["apart", "source"], {"source_place": one})
    cycle = F.array(*map(F.lit, weights))
    placed = placed.withColumn(
        "weight", F.get(cycle, ((F.col("source_place") - 1) % len(weights)).cast("int")).cast("long")
    ).withColumn("full_at", F.col("source_size") / F.col("weight"))
    placed = materialized(placed, "weights")
    filled = materialized(
        running(placed, [], ["full_at", "source_place"], {"sizes": F.col("source_size"), "weights": F.col("weight"), "rank": one}),
        "levels",
    )
    all_weights = placed.agg(F.sum("weight")).first()[0] or 0
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    left = F.lit(percent * total).cast("decimal(38,0)") - 100 * repeats * (exact("sizes") - exact("source_size"))
    weights_left = F.lit(all_weights).cast("decimal(38,0)") - (exact("weights") - exact("weight"))
    first = (
        filled.filter(100 * repeats * exact("source_size") * weights_left > exact("weight") * left)
        .agg(F.min(F.struct("rank", left.cast("long").alias("left"), weights_left.cast("long").alias("weights"))).alias("at"))
        .first()
        .at
    )
    cap = (repeats * F.col("source_size")).cast("double")
    target = cap
    if first is not None:
        share = (F.col("weight") * F.lit(first.left)).cast("double") / F.lit(float(100 * first.weights))
        target = F.when(F.col("rank") < first.rank, cap).otherwise(share)
    return filled.select("apart", "source", "source_place", "source_size", target.alias("target")), percent * total // 100


def schedule(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2
) -> DataFrame:
    """The mix in the order it is sent: one row per document and time it is taken.

    ``docs`` needs doc_id, text and source; other columns are ignored. Columns:
    number (of the row), doc_id, source (null: none), size, source_size,
    target, again (0 for the first time), finish (virtual finish time), words
    (taken of the document) and sent (words sent before it, over all sources).
    A row of words 0 and again 0 stands for a document that isn't taken. Null
    and blank texts have size 0; a source of such texts has target 0. Rows
    that come twice are documents of their own. An empty table gives no rows.
    """
    rows = sized(docs)
    known, budget = targets(rows, weights, percent, repeats)
    queued = running(rows, ["apart", "source"], ["turn", "doc_id", "size", "print", "number"], {"upto": F.col("size")})
    start = F.col("again") * F.col("source_size") + F.col("upto") - F.col("size")
    left = F.ceil("target").cast("long") - F.col("start")
    packets = (
        lookup(queued, known, ["apart", "source"])
        .withColumn("again", F.explode(F.array(*(F.lit(i).cast("long") for i in range(repeats)))))
        .withColumn("start", start)
        .withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("size", left)))
        .filter("again = 0 OR words > 0")
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("words")) / F.col("target")).otherwise(0.0))
    )
    wanted = ["number", "doc_id", "apart", "source", "source_place", "size", "source_size", "target", "again", "start", "words", "finish"]
    packets = materialized(packets.select(*wanted), "packets")
    sent = running(packets, [], ["finish", "source_place", "start", "number"], {"sent": F.col("words")})
    before = F.col("sent") - F.col("words")
    taken = F.greatest(F.lit(0).cast("long"), F.least("words", F.lit(budget) - before))
    return sent.select(
        "number",
        "doc_id",
        F.when(~F.col("apart"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        "again",
        "finish",
        taken.alias("words"),
        before.alias("sent"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of all its times) and times, one row per row of ``docs``."""
    return (
        schedule(docs, weights, percent, repeats)
        .groupBy("number", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"), F.count_if(F.col("words") > 0).alias("times"))
        .drop("number")
    )
