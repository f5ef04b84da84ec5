"""Node and link views of a catalogue's edge list.

Table nodes are named ``table`` and column nodes ``table.column``, as in the edge
list; schema columns keep equal names of different schemas apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakescribe.operators.skew import grown, lookup

TABLE = ["system_name", "schema_name", "table_name"]


def visible(edges: DataFrame) -> DataFrame:
    """Edges between two different tables."""
    return edges.filter(
        (F.col("source") != F.col("target")) | (F.col("source_schema") != F.col("target_schema"))
    )


def overview_nodes(tables: DataFrame) -> DataFrame:
    return tables.select(
        "system_name",
        "schema_name",
        F.col("table_name").alias("id"),
        F.coalesce("table_type", F.lit("BASE TABLE")).alias("type"),
        F.lit("TABLE").alias("kind"),
    )


def overview_links(edges: DataFrame) -> DataFrame:
    return visible(edges).select(
        "system_name", "source_schema", "source", "target_schema", "target", "type", "is_inferred"
    )


def _focus(df: DataFrame, schema: str, table: str, at: tuple[str, str, str]):
    system_name, schema_name, table_name = at
    return (
        (F.col("system_name") == system_name)
        & (F.col(schema) == schema_name)
        & (F.col(table) == table_name)
    )


def neighbours(edges: DataFrame, columns: DataFrame, at: tuple[str, str, str]) -> DataFrame:
    """Tables next to the focus table, and whether an edge links them to it.

    Besides edges in both directions, tables named in a reference of the focus
    count, and tables that name the focus in a reference.
    """
    system = F.lit(at[0]).alias("system_name")
    shown = visible(edges)
    out = shown.filter(_focus(edges, "source_schema", "source", at)).select(
        "system_name", F.col("target_schema").alias("schema_name"), F.col("target").alias("table_name"),
        F.lit(True).alias("linked"),
    )
    into = shown.filter(_focus(edges, "target_schema", "target", at)).select(
        "system_name", F.col("source_schema").alias("schema_name"), F.col("source").alias("table_name"),
        F.lit(True).alias("linked"),
    )
    refers = columns.filter(
        _focus(columns, "schema_name", "table_name", at) & F.col("fk_ref_table").isNotNull()
    ).select(
        "system_name",
        F.coalesce("fk_ref_schema", "schema_name").alias("schema_name"),
        F.col("fk_ref_table").alias("table_name"),
        F.lit(False).alias("linked"),
    )
    referred = columns.filter(
        (F.col("system_name") == at[0])
        & (F.col("fk_ref_table") == at[2])
        & (F.coalesce("fk_ref_schema", F.lit(at[1])) == at[1])
    ).select("system_name", "schema_name", "table_name", F.lit(False).alias("linked"))
    self_row = edges.sparkSession.range(1).select(
        system, F.lit(at[1]).alias("schema_name"), F.lit(at[2]).alias("table_name"), F.lit(True).alias("linked")
    )
    return (
        self_row.unionByName(out).unionByName(into).unionByName(refers).unionByName(referred)
        .groupBy(*TABLE)
        .agg(F.bool_or("linked").alias("linked"))
    )


def _touching(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Visible edges with at least one end among the neighbours."""
    shown = visible(edges)
    ends = near.select(*TABLE)
    source = ends.toDF("system_name", "source_schema", "source").withColumn("_src", F.lit(True))
    target = ends.toDF("system_name", "target_schema", "target").withColumn("_tgt", F.lit(True))
    key = ["system_name", "target_schema", "target"]
    # a table has few outgoing edges, but any number of incoming ones
    from_near = shown.join(grown(source), ["system_name", "source_schema", "source"], "left")
    return lookup(from_near, grown(target), key).filter(F.col("_src") | F.col("_tgt"))


def _shown_columns(columns: DataFrame, near: DataFrame, tables: DataFrame) -> DataFrame:
    known = near.select(*TABLE).join(grown(tables.select(*TABLE)), TABLE, "left_semi")
    return columns.join(grown(known), TABLE, "left_semi").filter(F.col("column_name").isNotNull())


def detail_nodes(
    tables: DataFrame, columns: DataFrame, edges: DataFrame, at: tuple[str, str, str]
) -> DataFrame:
    """Tables and columns around the focus table.

    A neighbour known only from a reference is a REF_TABLE. The far end of an
    edge that leaves a neighbour is a node of its table type.
    """
    near = neighbours(edges, columns, at)
    touching = _touching(edges, near)
    # a far table becomes a node only where its link cannot join two columns
    cols = _shown_columns(columns, near, tables).select(*TABLE, "column_name")
    far = (
        _table_links(touching, cols)
        .select(
            "system_name",
            F.inline(
                F.array(
                    F.struct(F.col("source_schema").alias("schema_name"), F.col("source").alias("table_name")),
                    F.struct(F.col("target_schema").alias("schema_name"), F.col("target").alias("table_name")),
                )
            ),
        )
        .join(grown(near), TABLE, "left_anti")
        .distinct()
        .withColumn("linked", F.lit(True))
    )
    table_nodes = (
        near.unionByName(far)
        .join(grown(tables.select(*TABLE, "table_type")), TABLE, "left")
        .select(
            "system_name",
            "schema_name",
            F.col("table_name").alias("id"),
            F.when(F.col("linked"), F.coalesce("table_type", F.lit("BASE TABLE")))
            .otherwise("REF_TABLE")
            .alias("type"),
            F.lit("TABLE").alias("kind"),
            F.col("table_name").alias("table"),
            F.lit(None).cast("string").alias("column"),
        )
    )
    column_nodes = cols.select(
        "system_name",
        "schema_name",
        F.concat_ws(".", "table_name", "column_name").alias("id"),
        F.lit("COLUMN").alias("type"),
        F.lit("COLUMN").alias("kind"),
        F.col("table_name").alias("table"),
        F.col("column_name").alias("column"),
    ).distinct()
    return table_nodes.unionByName(column_nodes)


def _flagged(touching: DataFrame, cols: DataFrame) -> DataFrame:
    """Edges with a flag telling whether both of their columns are nodes."""
    own = cols.distinct()
    source = own.toDF("system_name", "source_schema", "source", "source_column").withColumn("_sc", F.lit(True))
    target = own.toDF("system_name", "target_schema", "target", "target_column").withColumn("_tc", F.lit(True))
    with_source = touching.join(
        grown(source), ["system_name", "source_schema", "source", "source_column"], "left"
    )
    key = ["system_name", "target_schema", "target", "target_column"]
    return lookup(with_source, grown(target), key).withColumn(
        "_both", F.coalesce(F.col("_sc") & F.col("_tc"), F.lit(False))
    )


def _table_links(touching: DataFrame, cols: DataFrame) -> DataFrame:
    return _flagged(touching, cols).filter(~F.col("_both"))


def detail_links(
    tables: DataFrame, columns: DataFrame, edges: DataFrame, at: tuple[str, str, str]
) -> DataFrame:
    """Links of the detail view: COL, FK_REF between columns, else FK."""
    near = neighbours(edges, columns, at)
    cols = _shown_columns(columns, near, tables).select(*TABLE, "column_name")
    flagged = _flagged(_touching(edges, near), cols)

    def end(table: str, column: str):
        return F.when(F.col("_both"), F.concat_ws(".", table, column)).otherwise(F.col(table))

    between = flagged.select(
        "system_name",
        end("source", "source_column").alias("source"),
        end("target", "target_column").alias("target"),
        F.when(F.col("_both"), "FK_REF").otherwise(F.col("type")).alias("type"),
        "is_inferred",
    )
    inside = cols.distinct().select(
        "system_name",
        F.col("table_name").alias("source"),
        F.concat_ws(".", "table_name", "column_name").alias("target"),
        F.lit("COL").alias("type"),
        F.lit(False).alias("is_inferred"),
    )
    return inside.unionByName(between)


def collapsed(edges: DataFrame) -> DataFrame:
    """One link per pair of tables; its first edge tells whether it is inferred."""
    pair = ["system_name", "source_schema", "source", "target_schema", "target"]
    first = F.struct("ordinal", "source_column")
    return visible(edges).groupBy(*pair).agg(
        F.min_by("is_inferred", first).alias("is_inferred"), F.count("*").alias("n_links")
    )
