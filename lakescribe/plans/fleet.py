"""A catalogue derived from the ``part`` table: one described table per part.

The same formula in Spark and in SQL, so operators on catalogues can be checked
at any size. With ``k`` the part key, ``k div 2`` is the parent a table refers to.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakescribe import model

# Table-name prefixes by k modulo 6 (fixed values).
PREFIXES = ("dim_", "fact_", "stg_", "lkp_", "vw_", "")
SUFFIXES = ("_id", "id", "_key")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def table_of(k: Column) -> Column:
    return F.concat(_pick(PREFIXES, k % 6), F.lit("ent"), k.cast("string"))


def schema_of(k: Column) -> Column:
    return F.concat(F.lit("s"), (k % 4).cast("string"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys and what the formulas need of them.

    A part becomes up to fifty columns or a whole script, so a table read in
    fewer pieces than there are cores is spread out while its rows are small.
    """
    read = spark.read.parquet(os.path.join(sf_dir, "part.parquet")).select(
        F.col("p_partkey").alias("k"),
        F.floor(F.col("p_partkey") / 2).alias("parent"),
        "p_size",
        "p_name",
        "p_retailprice",
    )
    cores = spark.sparkContext.defaultParallelism
    return read.repartition(cores, "k") if read.rdd.getNumPartitions() < cores else read


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat tables with the part key ``k`` and the width ``p_size``."""
    k = F.col("k")
    rows = F.when(k % 17 != 0, F.floor(F.col("p_retailprice") * 10).cast("bigint"))
    return parts(spark, sf_dir).select(
        F.lit("fleet").alias("system_name"),
        schema_of(k).alias("schema_name"),
        table_of(k).alias("table_name"),
        F.when(k % 10 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        rows.alias("row_count"),
        (rows * F.col("p_size") * 8).alias("size_bytes"),
        F.when(k % 5 != 0, F.col("p_name")).alias("description"),
        "k",
        "parent",
        "p_size",
    )


def columns(spark: SparkSession, sf_dir: str, annotated: bool = False) -> DataFrame:
    """Flat columns; ``annotated`` adds inferred keys to some of them."""
    k, o, parent = F.col("k"), F.col("ordinal"), F.col("parent")
    refers = (o == 2) & (k >= 2)
    reference = F.struct(
        schema_of(parent).alias("schema"),
        table_of(parent).alias("table"),
        F.concat(F.lit("ent"), parent.cast("string"), F.lit("_id")).alias("column"),
    )
    name = (
        F.when(o == 1, F.concat(F.lit("ent"), k.cast("string"), F.lit("_id")))
        .when(refers, F.concat(F.lit("ent"), parent.cast("string"), _pick(SUFFIXES, k % 3)))
        .otherwise(F.concat(F.lit("c"), o.cast("string")))
    )
    kind = (
        F.when(o <= 2, "BIGINT")
        .when(o % 3 == 0, "STRING")
        .when(o % 3 == 1, "DOUBLE")
        .otherwise("TIMESTAMP")
    )
    base = parts(spark, sf_dir).select(
        F.lit("fleet").alias("system_name"),
        schema_of(k).alias("schema_name"),
        table_of(k).alias("table_name"),
        "k",
        "parent",
        "p_size",
        F.explode(F.sequence(F.lit(1), F.col("p_size").cast("int"))).alias("ordinal"),
    )
    inferred_fk = F.lit(annotated) & refers & (k % 12 == 6)
    full = base.withColumns(
        {
            "column_name": name,
            "data_type": kind,
            "nullable": o != 1,
            "unique": o == 1,
            "primary_key": (o == 1) & (k % 11 != 0),
            "foreign_key": refers & (k % 2 == 0),
            "references": F.when(refers & (k % 4 == 0), reference),
            "inferred_pk": F.when(F.lit(annotated) & (o == 1) & (k % 22 == 0), True),
            "inferred_fk": F.when(inferred_fk, True),
            "inferred_fk_references": F.when(inferred_fk, reference),
        }
    )
    return full


def flat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakescribe.functions.scalars import format_size

    return model.conform(
        tables(spark, sf_dir).withColumn("size", format_size("size_bytes")), model.TABLES
    )


def flat_columns(spark: SparkSession, sf_dir: str, annotated: bool = False) -> DataFrame:
    return model.conform(columns(spark, sf_dir, annotated), model.COLUMNS)


def sql_table_of(k: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIXES))
    return f"(CASE ({k}) % 6 {names} END || 'ent' || ({k}))"


# Common table expressions with the same rows: ``t`` tables, ``c`` columns, ``ca``
# annotated columns.
SQL = f"""
WITH p AS (
  SELECT p_partkey AS k, p_partkey // 2 AS parent, p_size, p_name, p_retailprice FROM part
),
t AS (
  SELECT 'fleet' AS system_name, 's' || (k % 4) AS schema_name, {sql_table_of('k')} AS table_name,
    CASE WHEN k % 10 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
    CASE WHEN k % 17 <> 0 THEN CAST(floor(p_retailprice * 10) AS BIGINT) END AS row_count,
    CASE WHEN k % 17 <> 0 THEN CAST(floor(p_retailprice * 10) AS BIGINT) * p_size * 8 END AS size_bytes,
    CASE WHEN k % 5 <> 0 THEN p_name END AS description, k, parent, p_size
  FROM p
),
e AS (SELECT *, CAST(unnest(generate_series(1, p_size)) AS INTEGER) AS ordinal FROM t),
ca AS (
  SELECT system_name, schema_name, table_name, k, parent, p_size, ordinal,
    CASE WHEN ordinal = 1 THEN 'ent' || k || '_id'
         WHEN ordinal = 2 AND k >= 2 THEN 'ent' || parent || CASE k % 3 WHEN 0 THEN '_id' WHEN 1 THEN 'id' ELSE '_key' END
         ELSE 'c' || ordinal END AS column_name,
    CASE WHEN ordinal <= 2 THEN 'BIGINT' WHEN ordinal % 3 = 0 THEN 'STRING'
         WHEN ordinal % 3 = 1 THEN 'DOUBLE' ELSE 'TIMESTAMP' END AS data_type,
    ordinal <> 1 AS nullable, ordinal = 1 AS is_unique,
    ordinal = 1 AND k % 11 <> 0 AS pk,
    ordinal = 2 AND k >= 2 AND k % 2 = 0 AS fk,
    CASE WHEN ordinal = 2 AND k >= 2 AND k % 4 = 0 THEN 's' || (parent % 4) END AS ref_schema,
    CASE WHEN ordinal = 2 AND k >= 2 AND k % 4 = 0 THEN {sql_table_of('parent')} END AS ref_table,
    CASE WHEN ordinal = 2 AND k >= 2 AND k % 4 = 0 THEN 'ent' || parent || '_id' END AS ref_column,
    ordinal = 1 AND k % 22 = 0 AS inf_pk,
    ordinal = 2 AND k >= 2 AND k % 12 = 6 AS inf_fk,
    CASE WHEN ordinal = 2 AND k >= 2 AND k % 12 = 6 THEN {sql_table_of('parent')} END AS inf_table
  FROM e
),
c AS (SELECT * EXCLUDE (inf_pk, inf_fk, inf_table) FROM ca)
"""
