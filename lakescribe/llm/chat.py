"""Quotation linking: conversations from the passages that messages quote, in DataFrame functions alone.

Lines of a message carry their quote level as leading ``>`` signs. Maximal
runs of lines of one level, cut at empty lines, are passages. A quoted passage
is somebody's own passage at level 0; it is normalised, hashed, and joined to
the first message of its conversation that says it. A message answers the
original of its least deeply quoted passage; following answers upwards gives
the message a conversation begins with and the depth of every reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakescribe.session import materialized

#: A line that announces a quote (a fixed value).
ANNOUNCES = r"(?i)^on .+ wrote:$"


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``own``, the text without quotes, ``passages`` (level, digest) and ``print``.

    Needs conv_id, turn and text; columns of those three names are replaced.
    A level is the number of ``>`` in front of a line, blanks between them
    aside. A line that announces a quote goes with the quote below it. Empty
    lines before and after the own text are taken off. Null counts as empty.
    """
    kept = [c for c in messages.columns if c not in ("own", "passages", "print")]

    def step(df: DataFrame, **columns: str) -> DataFrame:
        # Through a generator, so that arrays are made once and not for every element that is read.
        made = ", ".join(f"{e} as {n}" for n, e in columns.items())
        names = [c for c in df.columns if c not in columns]
        return df.select(*names, F.expr(f"inline(array(struct({made})))"))

    out = messages.select(*kept, F.xxhash64("text").alias("print"))
    out = step(out, lines="split(coalesce(text, ''), '\\r\\n|\\r|\\n')")
    out = step(
        out,
        levels=r"transform(lines, l -> length(replace(regexp_extract(l, '^(?: ?>)*', 0), ' ', '')))",
        bodies=r"transform(lines, l -> regexp_replace(l, '^(?: ?>)+ ?', ''))",
    )
    out = step(
        out,
        said=f"""transform(bodies, (b, i) -> if(b rlike '{ANNOUNCES}' and i + 1 < size(levels)
                 and get(levels, i + 1) > levels[i], '', b))""",
    )
    out = step(
        out,
        starts="""filter(sequence(0, size(said) - 1), i -> trim(said[i]) != '' and (i = 0 or levels[i] != levels[i - 1]
                  or trim(said[i - 1]) = ''))""",
        breaks="""filter(sequence(0, size(said)), i -> i = size(said) or trim(said[i]) = ''
                  or (i > 0 and levels[i] != levels[i - 1]))""",
    )
    # Of every start the end is the first break after it; both ascend, so they pair up after those without a start.
    out = step(
        out,
        ends="filter(breaks, b -> b > 0 and trim(said[b - 1]) != '')",
    )
    passage = r"lower(trim(regexp_replace(array_join(slice(said, s + 1, ends[k] - s), ' '), '\\s+', ' ')))"
    out = step(
        out,
        own=r"regexp_replace(array_join(transform(filter(arrays_zip(said, levels), x -> x.levels = 0), x -> x.said), '\n'), '^\\s*\\n|\\s+$', '')",
        passages=f"transform(starts, (s, k) -> struct(levels[s] as level, unhex(md5({passage})) as digest))",
    )
    return out.select(*kept, "own", "passages", "print")


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, print, parent_turn, n_quotes, n_linked) of messages that quote, from what ``parsed`` gives."""
    passages = messages.select("conv_id", "turn", "print", F.explode("passages").alias("p")).select(
        "conv_id", "turn", "print", "p.level", "p.digest"
    )
    first = passages.filter("level = 0 and turn is not null").groupBy("conv_id", "digest").agg(F.min("turn").alias("original"))
    first = materialized(first, "originals").withColumnRenamed("conv_id", "conv")
    quoted = passages.filter("level > 0").withColumnRenamed("digest", "quote")
    found = quoted.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("quote") == F.col("digest")), "left")
    known = F.col("original") < F.col("turn")
    return found.groupBy("conv_id", "turn", "print").agg(
        F.min(F.when(known, F.struct("level", "original"))).getField("original").alias("parent_turn"),
        F.count("*").alias("n_quotes"),
        F.count(F.when(known, 1)).alias("n_linked"),
    )


def threads(links: DataFrame) -> DataFrame:
    """``links`` with root_turn and depth: where a message's chain of answers ends, and after how many steps.

    Every round doubles the distance that a message looks up its chain. A turn
    that several rows share passes on the answer with the smallest parent.
    """
    up = links.filter("parent_turn is not null")
    at = materialized(up.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("root"), F.lit(1).cast("long").alias("far")), "up")
    going, ended = at, at.limit(0)
    while True:
        above = at.toDF("c", "t", "above", "further")
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t"))
        moved = going.join(above, same, "left").select(
            "conv_id",
            "turn",
            F.coalesce("above", "root").alias("root"),
            (F.col("far") + F.coalesce("further", F.lit(0))).alias("far"),
            F.col("above").isNotNull().alias("moved"),
        )
        moved = materialized(moved, "up")
        # Only those that still moved go on; the others have their root.
        ended = ended.unionByName(moved.filter("not moved").drop("moved"))
        going = moved.filter("moved").drop("moved")
        at = ended.unionByName(going)
        if going.isEmpty():
            break
    above = at.toDF("c", "t", "above", "further")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_turn") == F.col("t"))
    return links.join(above, same, "left").select(
        *links.columns,
        F.when(F.col("parent_turn").isNotNull(), F.coalesce("above", "parent_turn")).alias("root_turn"),
        F.when(F.col("parent_turn").isNotNull(), F.coalesce("further", F.lit(0)) + 1).otherwise(0).alias("depth"),
    )


def conversations(messages: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """Every message without its quotes, with its place in the conversation it belongs to.

    Returns conv_id, turn, ``columns`` (of what ``parsed`` gives; by default
    role and text, the own text), parent_turn, root_turn, depth, n_quotes and
    n_linked. Sorted by conv_id, root_turn, depth and turn, every reply comes
    after what it answers. A message that quotes nothing known is the root of
    its own conversation, at depth 0. Quotes of later messages, or of the
    message itself, are no answers. Null ids are a conversation of their own;
    a message with a null turn answers nothing and is answered by none. Equal
    rows get equal results. An empty table gives no rows.
    """
    columns = columns or {"role": F.col("role"), "text": F.col("own")}
    # Texts are taken apart once; what is written has digests and the wanted columns, no quotes.
    read = parsed(messages).select("conv_id", "turn", "print", "passages", F.struct(*(e.alias(n) for n, e in columns.items())).alias("own"))
    read = materialized(read, "parsed")
    found = materialized(threads(linked(read)), "threads").toDF(
        "c", "t", "p", "parent_turn", "n_quotes", "n_linked", "root_turn", "depth"
    )
    own = read.select("conv_id", "turn", "print", "own.*")
    same = (
        F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("print") == F.col("p"))
    )
    zero = F.lit(0).cast("long")
    return own.join(found, same, "left").select(
        "conv_id",
        "turn",
        *columns,
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", zero).alias("depth"),
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
    )


def with_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` as mail readers write replies: each turn quotes the turn before it, and that one's quote."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    quote = "concat_ws('\\n', regexp_replace(before2, '(?m)^', '>> '), regexp_replace(before1, '(?m)^', '> '), text)"
    return (
        messages.withColumn("before1", F.lag("text", 1).over(order))
        .withColumn("before2", F.lag("text", 2).over(order))
        .withColumn("text", F.expr(quote))
        .drop("before1", "before2")
    )
