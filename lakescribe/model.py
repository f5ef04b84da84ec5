"""Schemas of the flat working tables, and the projection that enforces them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

REFERENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("schema", "table", "column")]
)

TABLE_KEY = ["system_name", "schema_name", "table_name"]
COLUMN_KEY = TABLE_KEY + ["column_name"]

TABLES = T.StructType(
    [
        T.StructField("system_name", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("table_type", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

COLUMNS = T.StructType(
    [
        T.StructField("system_name", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("unique", T.BooleanType()),
        T.StructField("is_generated", T.BooleanType()),
        T.StructField("primary_key", T.BooleanType()),
        T.StructField("foreign_key", T.BooleanType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("references", REFERENCE),
        T.StructField("description", T.StringType()),
        T.StructField("inferred_pk", T.BooleanType()),
        T.StructField("inferred_fk", T.BooleanType()),
        T.StructField("inferred_fk_references", REFERENCE),
    ]
)

SYSTEMS = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "system_name",
            "owner_name",
            "user_id",
            "source_type",
            "added_at",
            "db_type",
            "database",
            "extracted_at",
            "version",
        )
    ]
)

# Values a field takes when a source does not carry it (fixed values).
DEFAULTS = {
    "table_type": "BASE TABLE",
    "unique": False,
    "is_generated": False,
    "version": "Version_1",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: absent fields become nulls or their default."""

    def field(f: T.StructField) -> Column:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        if f.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]))
        return value.alias(f.name)

    return df.select(*[field(f) for f in schema.fields])
