"""Saved catalogue documents: nested JSON back to rows.

A document may spell its fields in several ways and hold columns as objects or
as positional arrays, so tables and columns are kept as VARIANT here and brought
into one form by ``operators.normalize``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc VARIANT), one row per file; nothing saved yet gives no rows."""
    try:
        texts = (
            spark.read.option("wholetext", "true")
            .option("recursiveFileLookup", "true")
            .text(path)
            .select(F.col("_metadata.file_path").alias("path"), "value")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, doc variant")
    return texts.select("path", F.try_parse_json("value").alias("doc"))


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc VARIANT) of files with one document per line."""
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    )


def _text(v, path: str):
    return F.try_variant_get(v, path, "string")


def raw_tables(docs: DataFrame) -> DataFrame:
    """One row per table of every document, with its place in the document.

    ``docs`` carries ``system_name`` and ``doc``; the table itself stays VARIANT.
    """
    schemas = docs.select(
        "system_name",
        F.posexplode(F.try_variant_get("doc", "$.schemas", "array<variant>")).alias("schema_seq", "s"),
    )
    return schemas.select(
        "system_name",
        "schema_seq",
        _text("s", "$.schema_name").alias("schema_name"),
        F.posexplode(F.try_variant_get("s", "$.tables", "array<variant>")).alias("table_seq", "raw"),
    )


def raw_columns(tables: DataFrame) -> DataFrame:
    """One row per column of ``raw_tables``; columns keep their place."""
    return tables.select(
        "system_name",
        "schema_name",
        _text("raw", "$.table_name").alias("table_name"),
        F.posexplode(F.try_variant_get("raw", "$.columns", "array<variant>")).alias("seq", "raw"),
    )


def source_fields(docs: DataFrame) -> DataFrame:
    """Header of each document with its defaults."""
    first_schema = _text("doc", "$.schemas[0].schema_name")
    return docs.select(
        "system_name",
        F.coalesce(_text("doc", "$.source.db_type"), F.lit("database")).alias("db_type"),
        F.coalesce(_text("doc", "$.source.database"), F.lit("unknown")).alias("database"),
        F.coalesce(first_schema, _text("doc", "$.source.schema"), F.lit("public")).alias("schema_name"),
        _text("doc", "$.source.extracted_at").alias("extracted_at"),
        F.concat(
            F.coalesce(_text("doc", "$.source.database"), F.lit("Database")), F.lit(" Schema Report")
        ).alias("title"),
    )
