"""Profiles computed from the rows of lake tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Sketches of 2^11 registers have a standard error of 2.3 percent. An estimate must
# reach the given share of the row count before a column is counted exactly; the
# gap is more than eight standard errors.
SKETCH_LOG2_REGISTERS = 11
NEAR_UNIQUE = 0.8

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def carrier(kind: T.DataType) -> str:
    """Type in which values of columns of one family are compared."""
    if isinstance(kind, _INTEGERS):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    if isinstance(kind, (T.StringType, T.MapType, T.VariantType)):
        return "string"
    return kind.simpleString()


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def comparable(f: T.StructField) -> str:
    """The column as a value that can be grouped, in its carrier type; texts as ``_short``."""
    value = quoted(f.name)
    if isinstance(f.dataType, (T.MapType, T.VariantType)):
        return _short(f"to_json({value})")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return _short(value)
    return f"CAST({value} AS {carrier(f.dataType)})"


def _short(text: str) -> str:
    """Bytes that are equal where texts or binaries are: their own if fewer than 32, else a digest of 32.

    So a shuffle by value carries no long text.
    """
    return (
        f"CASE WHEN octet_length({text}) < 32 THEN CAST({text} AS binary) ELSE unhex(sha2(CAST({text} AS binary), 256)) END"
    )


def _sketchable(f: T.StructField) -> str:
    """The value as an integer or text, which is what sketches take; nulls stay null."""
    value = quoted(f.name)
    if isinstance(f.dataType, (T.MapType, T.VariantType)):
        return f"to_json({value})"
    if isinstance(f.dataType, _INTEGERS):
        return f"CAST({value} AS bigint)"
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return value
    return f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}) END"


def profile(
    df: DataFrame, table_name: str, log2_registers: int = SKETCH_LOG2_REGISTERS
) -> DataFrame:
    """Rows, nulls and approximate distinct values of every column in one scan.

    Each task folds its rows into one sketch of at most 2 KB per column; only
    sketches and counts are shuffled. An empty table has no distinct counts.
    """
    fields = list(enumerate(df.schema.fields))
    one = df.selectExpr(
        "count(*) AS n",
        *[f"count({quoted(f.name)}) AS n{i}" for i, f in fields],
        *[
            f"hll_sketch_estimate(hll_sketch_agg({_sketchable(f)}, {log2_registers})) AS d{i}"
            for i, f in fields
        ],
    )
    lines = ", ".join(
        f"struct({text_literal(f.name)} AS column_name, {i + 1} AS ordinal, n AS row_count, "
        f"n - n{i} AS null_count, CASE WHEN n > 0 THEN d{i} END AS distinct_count)"
        for i, f in fields
    )
    return one.selectExpr(f"inline(array({lines}))").selectExpr(
        f"{text_literal(table_name)} AS table_name", "*", "true AS is_approx"
    )


def profile_many(
    frames: dict[str, DataFrame], log2_registers: int = SKETCH_LOG2_REGISTERS
) -> DataFrame:
    """``profile`` of many tables: one scan per table, all in one job."""
    return reduce(
        lambda a, b: a.unionByName(b), [profile(df, n, log2_registers) for n, df in frames.items()]
    )


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count); parquet tables answer from their footers."""
    counted = [
        df.selectExpr(f"{text_literal(n)} AS table_name", "count(*) AS row_count")
        for n, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def long_values(
    frames: dict[str, DataFrame], wanted: dict[str, list[str]] | None = None
) -> dict[str, DataFrame]:
    """Values in long form, one DataFrame (table_name, column_name, value) per carrier.

    Columns of one carrier are read in one pruned scan per table and stay in
    their own type, so no value is turned into text to be compared. Texts and
    binaries come as bytes, long ones as digests.
    """
    out: dict[str, list[DataFrame]] = {}
    for table, df in frames.items():
        groups: dict[str, list[T.StructField]] = {}
        for f in df.schema.fields:
            if wanted is None or f.name in wanted.get(table, []):
                groups.setdefault(carrier(f.dataType), []).append(f)
        for kind, fields in groups.items():
            name = f"{text_literal(table)} AS table_name"
            if len(fields) == 1:
                only = fields[0]
                rows = df.selectExpr(
                    name, f"{text_literal(only.name)} AS column_name", f"{comparable(only)} AS value"
                )
            else:
                pairs = ", ".join(
                    f"struct({text_literal(f.name)} AS column_name, {comparable(f)} AS value)"
                    for f in fields
                )
                rows = df.selectExpr(f"inline(array({pairs}))").selectExpr(
                    name, "column_name", "value"
                )
            out.setdefault(kind, []).append(rows)
    return {k: reduce(lambda a, b: a.unionByName(b), v) for k, v in out.items()}


def exact_distinct(
    frames: dict[str, DataFrame], wanted: dict[str, list[str]] | None = None
) -> DataFrame:
    """Exact distinct counts of columns, nulls not counted; 0 for columns of empty tables.

    Grouping by (table, column, value) first lets every map task fold its own
    repeats, so a value that fills a third of a table moves once per task.
    """
    counted = [
        values.groupBy("table_name", "column_name", "value")
        .agg(F.lit(1).alias("_one"))
        .groupBy("table_name", "column_name")
        .agg(F.count("value").alias("distinct_count"))
        for values in long_values(frames, wanted).values()
    ]
    listed = [
        (table, f.name)
        for table, df in frames.items()
        for f in df.schema.fields
        if wanted is None or f.name in wanted.get(table, [])
    ]
    spark = next(iter(frames.values())).sparkSession
    asked = spark.createDataFrame(listed, "table_name string, column_name string")
    found = reduce(lambda a, b: a.unionByName(b), counted)
    return asked.join(found, ["table_name", "column_name"], "left").fillna(0, ["distinct_count"])


def uniqueness(frames: dict[str, DataFrame]) -> DataFrame:
    """Whether each single column is a key of its table: no nulls, no repeats.

    Sketches from one scan rule most columns out; only those that may be unique
    are counted exactly. The profile has one row per column and is read here.
    """
    seen = profile_many(frames).collect()
    maybe: dict[str, list[str]] = {}
    for r in seen:
        if r.row_count > 0 and r.null_count == 0 and r.distinct_count >= NEAR_UNIQUE * r.row_count:
            maybe.setdefault(r.table_name, []).append(r.column_name)
    spark = next(iter(frames.values())).sparkSession
    rows = spark.createDataFrame(
        [(r.table_name, r.column_name, r.ordinal, r.row_count, r.null_count) for r in seen],
        "table_name string, column_name string, ordinal int, row_count bigint, null_count bigint",
    )
    if not maybe:
        return rows.withColumn("unique", F.lit(False))
    exact = exact_distinct({t: frames[t] for t in maybe}, maybe)
    return rows.join(exact, ["table_name", "column_name"], "left").select(
        "table_name",
        "column_name",
        "ordinal",
        "row_count",
        "null_count",
        F.coalesce(F.col("distinct_count") == F.col("row_count"), F.lit(False)).alias("unique"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def is_composite_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of repeated key values and whether ``keys`` is a key."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return grouped.agg(
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.count_if(~complete).alias("incomplete_keys"),
    ).withColumn("is_key", (F.col("repeated_keys") == 0) & (F.col("incomplete_keys") == 0))


def sketch_states(
    df: DataFrame, table_name: str, snapshot: Column | None = None, log2_registers: int = SKETCH_LOG2_REGISTERS
) -> DataFrame:
    """The distinct values of every column as a state that other snapshots are merged with.

    One row per snapshot and column: rows, nulls and a sketch of at most 2 KB,
    from one scan. Without ``snapshot`` all rows are one. Snapshots without
    rows have no state. States are kept in a table; a new part of a lake table
    adds its own, and nothing is read again.
    """
    fields = list(enumerate(df.schema.fields))
    label = F.lit("all") if snapshot is None else snapshot.cast("string")
    one = df.groupBy(label.alias("_snapshot")).agg(
        F.expr("count(*) AS n"),
        *[F.expr(f"count({quoted(f.name)}) AS n{i}") for i, f in fields],
        *[F.expr(f"hll_sketch_agg({_sketchable(f)}, {log2_registers}) AS s{i}") for i, f in fields],
    )
    lines = ", ".join(
        f"struct({text_literal(f.name)} AS column_name, {i + 1} AS ordinal, n AS row_count, "
        f"n - n{i} AS null_count, s{i} AS sketch)"
        for i, f in fields
    )
    return one.selectExpr("_snapshot AS snapshot", f"inline(array({lines}))").selectExpr(
        f"{text_literal(table_name)} AS table_name", "*"
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One row per column over all its snapshots: a value that several of them hold counts once.

    Rows and nulls are added, so snapshots are parts without common rows. A
    snapshot given twice is taken once, the later one of equal names being
    any. Tasks merge sketches before the shuffle.
    """
    key = ["table_name", "column_name"]
    once = states.dropDuplicates([*key, "snapshot"])
    return once.groupBy(*key).agg(
        F.min("ordinal").alias("ordinal"),
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.expr("hll_sketch_estimate(hll_union_agg(sketch, true))").alias("distinct_count"),
    )


def distinct_dump(merged: DataFrame, system_name: str, schema_name: str, upper: bool = False) -> DataFrame:
    """Merged states as the dump ``distinct`` of a dialect that keeps no such statistics; ``upper`` folds names."""
    fold = F.upper if upper else F.col
    return merged.select(
        F.lit(system_name).alias("system_name"),
        F.lit(schema_name.upper() if upper else schema_name).alias("schema_name"),
        fold("table_name").alias("table_name"),
        fold("column_name").alias("column_name"),
        F.col("distinct_count").cast("double").alias("n_distinct"),
    )
