"""Coverage statistics per system and per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakescribe.functions import scalars
from lakescribe.operators.graph import visible
from lakescribe.operators.skew import grown

TABLE = ["system_name", "schema_name", "table_name"]


def table_keys(columns: DataFrame) -> DataFrame:
    """Per table: column and key counts; ``columns`` in the normal form."""
    return columns.groupBy(*TABLE).agg(
        F.count("*").alias("n_columns"),
        F.count_if("is_primary_key").alias("n_pk"),
        F.count_if("is_foreign_key").alias("n_fk"),
        F.bool_or("inferred_pk").alias("any_inferred_pk"),
        F.bool_or("inferred_fk").alias("any_inferred_fk"),
    )


def catalogue_totals(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables, columns, keys and rows per system.

    ``primary_keys`` and ``foreign_key_cols`` count tables, as their consumers
    expect.
    """
    per_table = table_keys(columns)
    average = F.bround(
        F.col("total_columns").cast("decimal(28,6)") / F.col("total_tables"), 1
    ).cast("double")
    return (
        tables.join(grown(per_table), TABLE, "left")
        .groupBy("system_name")
        .agg(
            F.count("*").alias("total_tables"),
            F.count_if(F.col("table_type") == "BASE TABLE").alias("base_tables"),
            F.sum(F.coalesce("n_columns", F.lit(0))).alias("total_columns"),
            F.count_if(F.col("n_pk") > 0).alias("primary_keys"),
            F.count_if((F.col("n_pk") == 0) & F.col("any_inferred_pk")).alias("inferred_pks"),
            F.count_if(F.col("n_fk") > 0).alias("foreign_key_cols"),
            F.count_if((F.col("n_fk") == 0) & F.col("any_inferred_fk")).alias("inferred_fks"),
            F.sum(F.coalesce("row_count", F.lit(0))).alias("total_rows"),
        )
        .withColumn("avg_cols_per_table", average)
        .withColumn("total_rows_fmt", scalars.row_total_text("total_rows"))
    )


def edge_totals(edges: DataFrame) -> DataFrame:
    """Resolved relations per system, given and inferred."""
    return (
        visible(edges)
        .filter(F.col("type") == "FK")
        .groupBy("system_name")
        .agg(
            F.count_if(~F.col("is_inferred")).alias("fk_relations"),
            F.count_if("is_inferred").alias("inferred_fk_rels"),
        )
    )


def stats(tables: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per system: ``catalogue_totals`` with ``edge_totals``."""
    return (
        catalogue_totals(tables, columns)
        .join(edge_totals(edges), "system_name", "left")
        .fillna(0, ["fk_relations", "inferred_fk_rels"])
    )


def tiles(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tile figures of every table at once."""
    return (
        tables.join(grown(table_keys(columns)), TABLE, "left")
        .fillna(0, ["n_columns", "n_pk", "n_fk"])
        .select(
            *TABLE,
            (F.col("table_type") == "BASE TABLE").cast("int").alias("base_tables"),
            F.col("n_columns").alias("total_columns"),
            F.col("n_pk").alias("primary_keys"),
            F.col("n_fk").alias("foreign_key_cols"),
            scalars.row_total_text(F.coalesce("row_count", F.lit(0))).alias("total_rows_fmt"),
        )
    )


def related_tables(edges: DataFrame) -> DataFrame:
    """Tables on the other end of each table's edges, as rows.

    A table that thousands refer to gets thousands of rows, not one huge list.
    """
    shown = visible(edges)
    out = shown.select(
        "system_name",
        F.col("source_schema").alias("schema_name"),
        F.col("source").alias("table_name"),
        F.lit("outbound").alias("direction"),
        F.col("target_schema").alias("related_schema"),
        F.col("target").alias("related_table"),
        "source_column",
    )
    into = shown.select(
        "system_name",
        F.col("target_schema").alias("schema_name"),
        F.col("target").alias("table_name"),
        F.lit("inbound").alias("direction"),
        F.col("source_schema").alias("related_schema"),
        F.col("source").alias("related_table"),
        "source_column",
    )
    return out.unionByName(into)


def table_info(tables: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Info panel of every table: rows, columns, FK columns, in and out degree."""
    listed = F.sort_array(
        F.collect_list(F.when(F.col("is_foreign_key"), F.struct("ordinal", "column_name")))
    )
    per_table = columns.groupBy(*TABLE).agg(
        F.count("*").alias("n_columns"), listed["column_name"].alias("fk_columns")
    )
    degree = related_tables(edges).groupBy(*TABLE).agg(
        F.count_if(F.col("direction") == "outbound").alias("n_outbound"),
        F.count_if(F.col("direction") == "inbound").alias("n_inbound"),
    )
    return (
        tables.join(grown(per_table), TABLE, "left")
        .join(grown(degree), TABLE, "left")
        .fillna(0, ["n_columns", "n_outbound", "n_inbound"])
        .withColumn("description", scalars.shorten("description"))
    )


def by_schema(tables: DataFrame) -> DataFrame:
    """Table count per schema."""
    return tables.groupBy("system_name", "schema_name").agg(F.count("*").alias("n_tables"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges once per (source, target, column)."""
    return edges.dropDuplicates(
        ["system_name", "source_schema", "source", "target_schema", "target", "source_column"]
    )
