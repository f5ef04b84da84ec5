"""Cutting a catalogue or texts into batches of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakescribe.functions import scalars
from lakescribe.operators.ordering import ROWS_PER_RANGE, range_bounds, range_of, running
from lakescribe.operators.search import first_columns
from lakescribe.operators.skew import grown, lookup
from lakescribe.session import materialized

TABLE = ["system_name", "schema_name", "table_name"]

# Limits of a batch of tables, a chunk of statements, a payload and a token
# budget (fixed values).
SMALL_TABLE = 15
SMALL_PER_BATCH = 4
STATEMENTS_PER_CHUNK = 15
COLUMNS_PER_PAYLOAD = 50
TOKEN_LIMIT = 50_000


def adaptive_batches(
    tables: DataFrame,
    widths: DataFrame,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Batch number of every table, from 0 in the order batches are closed.

    Wide tables are batches of their own; small ones go in groups of four in
    catalogue order, and a last group that is not full comes at the end. Running
    counts of wide and small tables give the number directly: a batch closes
    after all wide tables and full groups before its last member.
    """
    sized = (
        tables.select(*TABLE)
        .join(grown(widths), TABLE, "left")
        .withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))
    )
    wide = F.col("n_columns") > SMALL_TABLE
    counted = running(
        sized,
        ["system_name"],
        ["schema_name", "table_name"],
        {
            "_wide": ("sum", wide.cast("bigint")),
            "_small": ("sum", (~wide).cast("bigint")),
        },
        rows_per_range,
    )
    # wide tables get group numbers that no small table has, and no two alike
    group = F.when(~wide, F.floor((F.col("_small") - 1) / SMALL_PER_BATCH)).otherwise(
        -F.col("_wide")
    )
    grouped = counted.withColumns({"_wide_row": wide, "_group": group})
    full = (
        grouped.filter(~F.col("_wide_row"))
        .groupBy("system_name", "_group")
        .agg(F.count("*").alias("_n"), F.max("_wide").alias("_before"))
    )
    totals = grouped.groupBy("system_name").agg(
        F.max("_wide").alias("_all_wide"),
        F.floor(F.max("_small") / SMALL_PER_BATCH).alias("_all_full"),
    )
    small_numbers = lookup(full, totals, ["system_name"], "inner").select(
        "system_name",
        "_group",
        F.when(F.col("_n") == SMALL_PER_BATCH, F.col("_before") + F.col("_group"))
        .otherwise(F.col("_all_wide") + F.col("_all_full"))
        .alias("_number"),
    )
    numbered = grouped.join(grown(small_numbers), ["system_name", "_group"], "left")
    return numbered.select(
        *TABLE,
        "n_columns",
        F.when(
            F.col("_wide_row"), F.col("_wide") - 1 + F.floor(F.col("_small") / SMALL_PER_BATCH)
        )
        .otherwise(F.col("_number"))
        .cast("bigint")
        .alias("batch_no"),
    )


def statement_chunks(statements: DataFrame, size: int = STATEMENTS_PER_CHUNK) -> DataFrame:
    """Statements of each script joined in groups of ``size``.

    ``statements`` holds system_name, path, stmt_idx (from 0) and stmt.
    """
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("stmt_idx", "stmt"))), lambda s: s["stmt"]
    )
    return (
        statements.withColumn("chunk_no", F.floor(F.col("stmt_idx") / size))
        .groupBy("system_name", "path", "chunk_no")
        .agg(
            F.count("*").alias("n_statements"),
            F.concat(F.array_join(lines, ";\n\n"), F.lit(";")).alias("chunk"),
        )
    )


def payloads(batches: DataFrame, columns: DataFrame) -> DataFrame:
    """JSON text per batch and ``part``: tables with keys and fifty of their columns.

    Part 0 has the first fifty columns of every table of the batch; tables with
    more come again in further parts. A batch holds one wide table or up to four
    small ones, so a row is bounded and no column is left out.
    """
    listed = lambda test: F.array_compact(
        F.transform(
            F.sort_array(F.collect_list(F.when(test, F.struct("ordinal", "column_name")))),
            lambda c: c["column_name"],
        )
    )
    keys = columns.groupBy(*TABLE).agg(
        listed(F.col("primary_key")).alias("primary_keys"),
        listed(F.col("foreign_key")).alias("foreign_keys"),
    )
    part = F.greatest(F.floor((F.col("ordinal") - 1) / COLUMNS_PER_PAYLOAD), F.lit(0)).cast("int")
    shape = columns.groupBy(*TABLE, F.coalesce(part, F.lit(0)).alias("part")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type"))),
            lambda c: F.struct(c["column_name"].alias("name"), c["data_type"].alias("type")),
        ).alias("columns"),
    )
    table = F.struct("schema_name", "table_name", "primary_keys", "foreign_keys", "columns")
    return (
        batches.join(grown(keys), TABLE, "left")
        .join(grown(shape), TABLE, "left")
        .groupBy("system_name", "batch_no", F.coalesce("part", F.lit(0)).alias("part"))
        .agg(F.sort_array(F.collect_list(table)).alias("_tables"))
        .select(
            "system_name",
            "batch_no",
            "part",
            F.size("_tables").alias("n_tables"),
            F.to_json(
                F.transform(
                    "_tables",
                    lambda t: F.struct(
                        t["table_name"].alias("table_name"),
                        t["primary_keys"].alias("primary_keys"),
                        t["foreign_keys"].alias("foreign_keys"),
                        t["columns"].alias("columns"),
                    ),
                )
            ).alias("payload"),
        )
    )


# -- token-safe chunks ----------------------------------------------------------
#
# Items are packed in order: an item that would take the open chunk over the
# limit opens the next one, and an item over the limit stands alone. Each choice
# depends on all before it, yet a range of items only needs to know how full the
# open chunk is on entry. Ranges are packed apart for every entry they can meet.
# The summary of neighbours is a summary again, so summaries are put together in
# a tree of bounded width, entries are handed down it, and each range is numbered
# from its entry.

# Summaries that one task puts together.
SUMMARIES_PER_NODE = 64


def _breaks(weights: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for each item the first item of the next chunk if one starts there."""
    sums = np.concatenate([[0], np.cumsum(weights)])
    nxt = np.searchsorted(sums[1:], sums[:-1] + limit, side="right")
    return sums, np.maximum(nxt, np.arange(1, len(weights) + 1))


def _range_summary(weights: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int], int]:
    """How a range leaves the open chunk for every way to enter it.

    Entering with ``s`` tokens the first break falls on item i if ``s`` exceeds
    ``limit - (tokens up to i)``. Returned are these thresholds in falling order
    of items, with the tokens of the chunk open at the end and the chunks opened.
    """
    n = len(weights)
    sums, nxt = _breaks(weights, limit)
    # Doubling: from each item to the start of the last chunk, and the chunks opened on the way.
    jump, last, opened = np.append(nxt, n), np.arange(n + 1), np.append(np.ones(n, dtype=np.int64), 0)
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)
        opened = opened + opened[jump]
        jump = jump[jump]
    left = sums[n] - sums[last[:n]]
    reach = int(np.searchsorted(sums[1:], limit, side="right"))
    end = min(reach + 1, n)
    thresholds, lefts, counts = limit - sums[1 : end + 1], left[:end], opened[:end]
    kept = np.ones(end, dtype=bool)  # the last of equal neighbours
    kept[:-1] = (lefts[:-1] != lefts[1:]) | (counts[:-1] != counts[1:])
    return thresholds[kept].tolist(), lefts[kept].tolist(), counts[kept].tolist(), int(sums[n])


Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def _left_by(fills: np.ndarray, summary: Summary, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the open chunk after a range entered with each of ``fills``, and the chunks opened."""
    thresholds, lefts, counts, total = summary
    piece = np.minimum(np.searchsorted(-thresholds, -fills, side="right"), len(thresholds) - 1)
    fits = fills + total <= limit
    return np.where(fits, fills + total, lefts[piece]), np.where(fits, 0, counts[piece])


def _joined(first: Summary, second: Summary, limit: int) -> Summary:
    """The summary of two neighbours; it has at most ``limit`` + 2 pieces, like any other."""
    lefts, opened = _left_by(first[1], second, limit)
    thresholds = np.concatenate([first[0], second[0] - first[3]])
    lefts = np.concatenate([lefts, second[1]])
    counts = np.concatenate([first[2] + opened, second[2]])
    # no chunk holds less than nothing: the first threshold below 0 is the last that counts
    end = min(len(thresholds), int(np.searchsorted(-thresholds, 0, side="right")) + 1)
    last = np.ones(end, dtype=bool)
    last[:-1] = (lefts[: end - 1] != lefts[1:end]) | (counts[: end - 1] != counts[1:end])
    return thresholds[:end][last], lefts[:end][last], counts[:end][last], first[3] + second[3]


def _summary_of(row) -> Summary:
    return (*(np.asarray(getattr(row, n), dtype=np.int64) for n in ("thresholds", "lefts", "counts")), int(row.total))


def _numbered(weights: np.ndarray, limit: int, chunk: int, fill: int, started: bool) -> np.ndarray:
    """Chunk number of each item of a range entered at ``chunk`` with ``fill`` tokens."""
    n = len(weights)
    sums, nxt = _breaks(weights, limit)
    first = int(np.searchsorted(sums[1:], limit - fill, side="right")) if started else 0
    # Doubling: the items that start a chunk are those reached from the first one.
    starts, jump = np.zeros(n + 1, dtype=bool), np.append(nxt, n)
    starts[first] = True
    while (jump[:n] < n).any():
        starts[jump[starts]] = True
        jump = jump[jump]
    starts[jump[starts]] = True
    return chunk + np.cumsum(starts[:n]) - (0 if started else 1)


def token_chunks(
    df: DataFrame,
    group: list[str],
    order: list[str],
    tokens: Column,
    limit: int = TOKEN_LIMIT,
    rows_per_range: int = ROWS_PER_RANGE,
    fan: int = SUMMARIES_PER_NODE,
) -> DataFrame:
    """(group, order, tokens, chunk_no) with chunks numbered from 0 in each group.

    Only keys and token counts are shuffled, never texts. Groups of any size are
    cut into ranges of the order, so no task holds a whole group, and no task
    sees the summaries of more than ``fan`` ranges. A null group is a group of
    its own, and a null count is 0.
    """
    counted = F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint"))
    narrow = df.select(*group, *order, counted.alias("tokens"))
    keys = [*group, *order]
    bounds = range_bounds(narrow, keys, rows_per_range)
    ranged = narrow.withColumn("_range", range_of(narrow, keys, bounds).cast("int"))
    fields = [narrow.schema[k] for k in keys]
    result = T.StructType([*fields, T.StructField("tokens", T.LongType()), T.StructField("chunk_no", T.LongType())])

    group_fields = [narrow.schema[g] for g in group]
    summary_type = T.StructType(
        [
            *group_fields,
            T.StructField("_range", T.IntegerType()),
            T.StructField("thresholds", T.ArrayType(T.LongType())),
            T.StructField("lefts", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("total", T.LongType()),
        ]
    )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        t, l, c, total = _range_summary(pdf["tokens"].to_numpy(), limit)
        head = pdf.iloc[0]
        return pd.DataFrame(
            [[*[head[g] for g in group], head["_range"], t, l, c, total]],
            columns=[f.name for f in summary_type.fields],
        )

    entry_type = T.StructType(
        [
            *group_fields,
            T.StructField("_range", T.IntegerType()),
            T.StructField("_chunk", T.LongType()),
            T.StructField("_fill", T.LongType()),
            T.StructField("_started", T.BooleanType()),
        ]
    )

    def join_summaries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        head = pdf.iloc[0]
        t, l, c, total = reduce(lambda x, y: _joined(x, y, limit), map(_summary_of, pdf.itertuples(index=False)))
        return pd.DataFrame(
            [[*[head[g] for g in group], head["_parent"], t, l, c, total]],
            columns=[f.name for f in summary_type.fields],
        )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        head = pdf.iloc[0]
        rows, chunk, fill, started = [], int(head["_chunk"]), int(head["_fill"]), bool(head["_started"])
        for values, summary in zip(pdf.to_dict("records"), map(_summary_of, pdf.itertuples(index=False))):
            rows.append([*[values[g] for g in group], values["_range"], chunk, fill, started])
            if not started:
                # an empty chunk takes its first item whatever its size
                fill, opened = int(summary[1][0]), int(summary[2][0]) - 1
            else:
                left, opened = _left_by(np.array([fill]), summary, limit)
                fill, opened = int(left[0]), int(opened[0])
            chunk, started = chunk + opened, True
        return pd.DataFrame(rows, columns=[f.name for f in entry_type.fields])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        head = pdf.iloc[0]
        pdf["chunk_no"] = _numbered(
            pdf["tokens"].to_numpy(), limit, int(head["_chunk"]), int(head["_fill"]), bool(head["_started"])
        )
        return pdf[[*keys, "tokens", "chunk_no"]]

    def entered(rows: DataFrame, entries: DataFrame, place: str) -> DataFrame:
        """``rows`` with the entry whose ``_range`` is their ``place``, in the same group."""
        entries = entries.withColumnsRenamed({k: f"_of_{k}" for k in (*group, "_range")})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in group]
        joined = rows.join(grown(entries), [*same, F.col(place) == F.col("_of__range")])
        return joined.drop(*[f"_of_{k}" for k in (*group, "_range")])

    # Up the tree, then down: every task sees at most ``fan`` summaries.
    part, above = [*group, "_range"], [*group, "_parent"]
    parent = F.expr(f"CAST(_range DIV {fan} AS INT)").alias("_parent")
    summaries = materialized(ranged.groupBy(*part).applyInPandas(summarise, summary_type), "summaries")
    levels, width = [summaries.select("*", parent)], len(bounds) + 1
    while width > fan:
        joined = levels[-1].groupBy(*above).applyInPandas(join_summaries, summary_type)
        levels.append(materialized(joined, "summaries").select("*", parent))
        width = -(-width // fan)
    start = {"_chunk": F.lit(0).cast("bigint"), "_fill": F.lit(0).cast("bigint"), "_started": F.lit(False)}
    entries = levels.pop().withColumns(start).groupBy(*above).applyInPandas(chain, entry_type)
    while levels:
        entries = entered(levels.pop(), entries, "_parent").groupBy(*above).applyInPandas(chain, entry_type)
    return entered(ranged, entries, "_range").groupBy(*part).applyInPandas(number, result)


def text_chunks(
    df: DataFrame, group: list[str], order: list[str], text: Column, limit: int = TOKEN_LIMIT, **options
) -> DataFrame:
    return token_chunks(df, group, order, scalars.token_estimate(text), limit, **options)


def payload_columns(columns: DataFrame, cap: int = COLUMNS_PER_PAYLOAD) -> DataFrame:
    return first_columns(columns, cap)


def describe(
    payload_rows: DataFrame, fn: Callable[[str], str], parallelism: int | None = None
) -> DataFrame:
    """Answers of ``fn(payload_json) -> answer_text`` for every payload row.

    ``parallelism`` is the number of tasks that call ``fn`` at a time, by default
    all cores: payloads are few and small, so without it they might end up in one
    task. A failing call gives a row with the error in ``status``; trying again
    is up to ``fn``, and a lost executor calls it again. Write the result before
    using it twice (``session.materialized``), or every use calls ``fn``.
    """
    tasks = parallelism or payload_rows.sparkSession.sparkContext.defaultParallelism
    result = "system_name string, batch_no bigint, answer string, status string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            answers, states = [], []
            for payload in pdf["payload"]:
                try:
                    answers.append(fn(payload))
                    states.append("ok")
                except Exception as error:  # the caller's code may raise anything
                    answers.append(None)
                    states.append(f"error: {error}")
            yield pdf[["system_name", "batch_no"]].assign(answer=answers, status=states)

    spread = payload_rows.select("system_name", "batch_no", "payload").repartition(
        tasks, "system_name", "batch_no"
    )
    return spread.mapInPandas(run, result)
