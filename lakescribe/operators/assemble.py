"""Joins that make catalogue rows from the parts of a source, and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakescribe import model
from lakescribe.functions import scalars
from lakescribe.operators.ordering import ROWS_PER_RANGE, row_numbers
from lakescribe.operators.skew import grown, hashed, lookup

KEY, TABLE = model.COLUMN_KEY, model.TABLE_KEY

PREVIEW = 30


def decoded_distinct(n_distinct: Column, row_count: Column) -> Column:
    """A negative statistic is a share of the rows, any other one a count."""
    return F.when(
        n_distinct < 0, F.floor(F.abs(n_distinct) * F.coalesce(row_count, F.lit(0)))
    ).otherwise(n_distinct.cast("bigint"))


def with_primary(columns: DataFrame, primary: DataFrame) -> DataFrame:
    keys = primary.select(*KEY).distinct().withColumn("primary_key", F.lit(True))
    return columns.join(hashed(keys), KEY, "left").fillna(False, ["primary_key"])


def with_unique(columns: DataFrame, unique: DataFrame) -> DataFrame:
    keys = unique.select(*KEY).distinct().withColumn("unique", F.lit(True))
    return columns.join(hashed(keys), KEY, "left").fillna(False, ["unique"])


def with_references(columns: DataFrame, foreign: DataFrame) -> DataFrame:
    """One target per column; of several the first by schema, table and column."""
    target = F.struct(
        F.col("ref_schema").alias("schema"),
        F.col("ref_table").alias("table"),
        F.col("ref_column").alias("column"),
    )
    chosen = foreign.groupBy(*KEY).agg(F.min(target).alias("references"))
    return columns.join(hashed(chosen), KEY, "left").withColumn(
        "foreign_key", F.col("references").isNotNull()
    )


def with_distinct(columns: DataFrame, distinct: DataFrame) -> DataFrame:
    values = distinct.groupBy(*KEY).agg(F.max("n_distinct").alias("n_distinct"))
    return columns.join(grown(values), KEY, "left")


def of_known_tables(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns whose table is listed, with its row count."""
    return lookup(columns, hashed(tables.select(*TABLE, "row_count")), TABLE, "inner")


def with_volumes(tables: DataFrame, volumes: DataFrame) -> DataFrame:
    return tables.join(grown(volumes), TABLE, "left")


def assemble(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, columns and all foreign keys from the parts of a source.

    The four look-ups share one key, so the columns are shuffled once for them.
    Few columns are keys, and a table has many columns: those sides are hashed,
    so that columns aren't sorted for them. Statistics may be as many as columns.
    """
    tables = model.conform(
        parts["tables"].withColumn("size", scalars.format_size("size_bytes")), model.TABLES
    )
    columns = with_primary(parts["columns"], parts["primary"])
    columns = with_unique(columns, parts["unique"])
    columns = with_references(columns, parts["foreign"])
    columns = with_distinct(columns, parts["distinct"])
    columns = of_known_tables(columns, tables).withColumn(
        "distinct_count", decoded_distinct(F.col("n_distinct"), F.col("row_count"))
    )
    return tables, model.conform(columns, model.COLUMNS), parts["foreign"]


def with_known_flags(columns: DataFrame, status: DataFrame) -> DataFrame:
    """Flags of columns only where they are known.

    Where a system's part couldn't be read (``dialects.part_status``), its flag
    is null instead of false, unless a part that was read in pieces has the key.
    """
    flags = {"primary": "primary_key", "unique": "unique", "foreign": "foreign_key"}
    closed = (
        status.filter(F.col("status") == "unreadable")
        .groupBy("system_name")
        .agg(F.collect_set("part").alias("_closed"))  # at most one entry per kind of part
    )
    # one row per system that is closed; a shuffle would gather a system's columns in one task
    joined = lookup(columns, F.broadcast(closed), ["system_name"])
    known = {
        flag: F.when(F.col(flag) | ~F.coalesce(F.array_contains("_closed", part), F.lit(False)), F.col(flag))
        for part, flag in flags.items()
    }
    return joined.withColumns(known).select(*columns.columns)


def table_documents(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per table with its columns nested in ordinal order.

    A table's width is bounded by its database, so a row stays small whatever
    the size of the catalogue.
    """
    fields = [c for c in columns.columns if c not in TABLE]
    nested = columns.groupBy(*TABLE).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", *[f for f in fields if f != "ordinal"]))).alias("columns")
    )
    joined = tables.join(grown(nested), TABLE, "left")
    empty = F.array().cast(nested.schema["columns"].dataType)
    return joined.withColumn("columns", F.coalesce("columns", empty))


def documents(
    tables: DataFrame,
    columns: DataFrame,
    tables_per_part: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Nested documents, one per schema, whose tables are in the order of their names.

    With ``tables_per_part``, a schema of more tables has several documents,
    numbered by ``part``, which bounds the memory that one row takes; no table
    is left out. A whole schema without a bound is one row: for large ones see
    ``document_tables``.
    """
    if tables_per_part is None:
        parted = tables.withColumn("part", F.lit(0))
    else:
        numbered = row_numbers(tables, ["system_name", "schema_name"], ["table_name"], "_n", rows_per_range)
        parted = numbered.withColumn("part", F.floor((F.col("_n") - 1) / tables_per_part).cast("int")).drop("_n")
    rows = table_documents(parted, columns)
    inner = [c for c in rows.columns if c not in ("system_name", "schema_name", "part", "table_name")]
    return rows.groupBy("system_name", "schema_name", "part").agg(
        F.sort_array(F.collect_list(F.struct("table_name", *inner))).alias("tables")
    )


def document_tables(
    tables: DataFrame, columns: DataFrame, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """The tables of whole documents, one row each: (system_name, schema_name, part, place, table).

    ``place`` counts from 1 in the order that ``documents`` has, so that a
    document of any size can be written without ever being one row.
    """
    inner = [c for c in tables.columns if c not in TABLE]
    numbered = row_numbers(tables, ["system_name", "schema_name"], ["table_name", *inner], "place", rows_per_range)
    rows = table_documents(numbered, columns)
    return rows.select(
        "system_name", "schema_name", F.lit(0).alias("part"), "place", F.struct("table_name", *inner, "columns").alias("table")
    )


def summary(tables: DataFrame, columns: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Table and column totals per system and the first names of its tables."""
    totals = tables.groupBy("system_name").agg(F.count("*").alias("total_tables"))
    counted = columns.groupBy("system_name").agg(F.count("*").alias("total_columns"))
    # Spark keeps the first names of each task before the shuffle, as the number is bounded
    by_name = Window.partitionBy("system_name").orderBy("schema_name", "table_name")
    first = (
        tables.select(*TABLE)
        .withColumn("_n", F.row_number().over(by_name))
        .filter(F.col("_n") <= preview)
        .groupBy("system_name")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "table_name"))).alias("_names"))
        .select("system_name", F.col("_names.table_name").alias("table_names_preview"))
    )
    return (
        totals.join(counted, "system_name", "left")
        .fillna(0, ["total_columns"])
        .join(first, "system_name", "left")
    )
