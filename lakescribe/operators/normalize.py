"""One spelling for tables and columns that come as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe import model
from lakescribe.functions import json_text
from lakescribe.functions.scalars import first_text

# Fields of a column given as an array, by position (fixed values).
POSITIONS = (
    "column_name",
    "data_type",
    "nullable",
    "is_generated",
    "primary_key",
    "foreign_key",
    "foreign_key_reference",
)


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def normalize_tables(raw: DataFrame) -> DataFrame:
    """Rows of the flat ``tables`` form; ``raw`` as made by ``raw_tables``."""
    v = F.col("raw")
    return raw.select(
        "system_name",
        "schema_name",
        _get(v, "$.table_name", "string").alias("table_name"),
        _get(v, "$.table_type", "string").alias("table_type"),
        _get(v, "$.row_count", "bigint").alias("row_count"),
        _get(v, "$.size", "string").alias("size"),
        first_text(
            _get(v, "$.description", "string"), _get(v, "$.ai_description", "string")
        ).alias("description"),
        "schema_seq",
        "table_seq",
    )


def _fields(raw: DataFrame) -> DataFrame:
    """Columns of both shapes as one set of VARIANT fields; other shapes go.

    The shape is read where rows are generated, not in a filter: Spark moves a
    filter below the step that parses the text, and then parses it twice.
    """
    v = F.col("raw")
    items = _get(v, "$", "array<variant>")
    is_object = _get(v, "$", "struct<column_name: variant>").isNotNull()
    shaped = raw.select(
        "*", F.inline(F.when(items.isNotNull() | is_object, F.array(F.struct(items.alias("_items")))))
    )
    is_array = F.col("_items").isNotNull()
    width = F.size("_items")

    def at(i: int) -> Column:
        return F.when(is_array & (width > i), F.get("_items", i))

    def named(name: str) -> Column:
        if name in POSITIONS:
            return F.when(is_array, at(POSITIONS.index(name))).otherwise(_get(v, f"$.{name}"))
        return F.when(~is_array, _get(v, f"$.{name}"))

    eighth_is_count = json_text.variant_kind(at(7)).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    names = (
        "column_name data_type nullable is_nullable is_generated unique primary_key is_primary_key "
        "foreign_key is_foreign_key references ai_description column_description "
        "inferred_pk inferred_fk inferred_fk_references"
    ).split()
    cols = {f"f_{n}": named(n) for n in names}
    cols["f_description"] = F.when(
        is_array, F.when((width >= 9) | ((width == 8) & ~eighth_is_count), at(7))
    ).otherwise(_get(v, "$.description"))
    cols["f_distinct_count"] = F.when(
        is_array, F.when(width >= 9, at(8)).when((width == 8) & eighth_is_count, at(7))
    ).otherwise(_get(v, "$.distinct_count"))
    return shaped.withColumns(cols)


def _native_first(native: Column, alias: Column) -> Column:
    """A native field that is present decides, even when it is a JSON null."""
    return json_text.flag(F.coalesce(native, alias))


def _reference(v: Column, prefix: str) -> list[Column]:
    return [
        _get(v, f"$.{part}", "string").alias(f"{prefix}_{part}") for part in ("table", "column", "schema")
    ]


def normalize_columns(raw: DataFrame) -> DataFrame:
    """``columns_norm``: one name and type for every alias of a column field.

    ``raw`` holds system_name, schema_name, table_name, seq and the column as
    VARIANT ``raw``.
    """
    f = _fields(raw)

    def text(name: str) -> Column:
        return _get(F.col(f"f_{name}"), "$", "string")

    return f.select(
        *model.TABLE_KEY,
        (F.col("seq") + 1).alias("ordinal"),
        text("column_name").alias("column_name"),
        text("data_type").alias("data_type"),
        json_text.nullable_text(F.col("f_is_nullable"), F.col("f_nullable")).alias("is_nullable"),
        json_text.flag(F.col("f_is_generated")).alias("is_generated"),
        json_text.flag(F.col("f_unique")).alias("unique"),
        _native_first(F.col("f_primary_key"), F.col("f_is_primary_key")).alias("is_primary_key"),
        _native_first(F.col("f_foreign_key"), F.col("f_is_foreign_key")).alias("is_foreign_key"),
        *_reference(F.col("f_references"), "fk_ref"),
        first_text(text("ai_description"), text("column_description"), text("description")).alias(
            "description"
        ),
        _get(F.col("f_distinct_count"), "$", "bigint").alias("distinct_count"),
        json_text.present(F.col("f_inferred_pk")).alias("inferred_pk"),
        json_text.present(F.col("f_inferred_fk")).alias("inferred_fk"),
        *_reference(F.col("f_inferred_fk_references"), "inf_ref"),
    )


def normal_form(columns: DataFrame) -> DataFrame:
    """``columns_norm`` straight from the flat typed columns."""
    ref, inf = F.col("references"), F.col("inferred_fk_references")
    return columns.select(
        *model.TABLE_KEY,
        "ordinal",
        "column_name",
        "data_type",
        F.when(F.col("nullable").isNull(), "").when(F.col("nullable"), "YES").otherwise("NO").alias("is_nullable"),
        "is_generated",
        "unique",
        F.coalesce("primary_key", F.lit(False)).alias("is_primary_key"),
        F.coalesce("foreign_key", F.lit(False)).alias("is_foreign_key"),
        *[ref[p].alias(f"fk_ref_{p}") for p in ("table", "column", "schema")],
        F.coalesce("description", F.lit("")).alias("description"),
        "distinct_count",
        F.coalesce("inferred_pk", F.lit(False)).alias("inferred_pk"),
        F.coalesce("inferred_fk", F.lit(False)).alias("inferred_fk"),
        *[inf[p].alias(f"inf_ref_{p}") for p in ("table", "column", "schema")],
    )
