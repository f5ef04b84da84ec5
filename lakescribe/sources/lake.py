"""The lake itself as a source: names, types and sizes of its tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakescribe import model
from lakescribe.functions import scalars


def frames(spark: SparkSession, directory: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(directory, f"{n}.parquet")) for n in names}


def lake_columns(
    tables: dict[str, DataFrame], system_name: str = "lake", schema_name: str = "lake"
) -> DataFrame:
    """One row per top-level field; only schemas are read, never rows."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (system_name, schema_name, table, i + 1, f.name, f.dataType.simpleString().upper(), f.nullable)
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    listed = spark.createDataFrame(
        rows,
        "system_name string, schema_name string, table_name string, ordinal int, "
        "column_name string, data_type string, nullable boolean",
    )
    return listed.withColumn("type_family", scalars.type_family("data_type"))


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Bytes per table from the file listing; the content is not read."""
    sized = None
    for table, path in paths.items():
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select(F.lit(table).alias("table_name"), "length")
        )
        sized = files if sized is None else sized.unionByName(files)
    return sized.groupBy("table_name").agg(F.sum("length").alias("size_bytes"))


def lake_tables(
    counts: DataFrame,
    sizes: DataFrame | None = None,
    system_name: str = "lake",
    schema_name: str = "lake",
) -> DataFrame:
    """Table rows from (table_name, row_count) and the file sizes."""
    counted = counts.select("table_name", "row_count")
    if sizes is not None:
        counted = counted.join(sizes, "table_name", "left").withColumn(
            "size", scalars.format_size("size_bytes")
        )
    return model.conform(
        counted.withColumns(
            {"system_name": F.lit(system_name), "schema_name": F.lit(schema_name)}
        ),
        model.TABLES,
    )
