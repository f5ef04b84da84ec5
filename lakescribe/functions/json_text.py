"""JSON inside free text, and truth values of loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ANY_JSON = r"(?s)(\{.*\}|\[.*\])"
_ARRAY_JSON = r"(?s)(\[.*\])"
_FENCES = r"(?s)^\s*```(?:json)?\s*|\s*```\s*$"


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value; inside brackets, anything that
    follows it shows as an error or as a second element.
    """
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.size(F.try_variant_get(held, "$", "array<variant>")) == 1
    return F.when(alone, F.try_variant_get(held, "$[0]", "variant"))


def noisy_json(text: Column) -> Column:
    """VARIANT of an answer: the whole text, else its outermost JSON part."""
    return F.coalesce(strict_json(text), strict_json(F.regexp_extract(text, _ANY_JSON, 1)))


def unfenced(text: Column) -> Column:
    """The text without an opening and a closing code fence."""
    return F.regexp_replace(text, _FENCES, "")


def _array_part(text: Column) -> Column:
    return strict_json(unfenced(F.regexp_extract(text, _ARRAY_JSON, 1)))


def string_array(text: Column) -> Column:
    """The JSON array of strings in an answer; any other shape gives an empty one."""
    v = _array_part(text)
    items = F.try_variant_get(v, "$", "array<variant>")
    clean = F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(
        F.when(clean, F.try_variant_get(v, "$", "array<string>")),
        F.array().cast("array<string>"),
    )


def object_array(text: Column, fields: str) -> Column:
    """The JSON array of objects in an answer, read with ``fields`` (DDL)."""
    v = _array_part(text)
    items = F.try_variant_get(v, "$", "array<variant>")
    clean = F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    kind = f"array<struct<{fields}>>"
    return F.coalesce(
        F.when(clean, F.try_variant_get(v, "$", kind)), F.array().cast(kind)
    )


def variant_kind(v: Column) -> Column:
    """First word of the variant's schema: BOOLEAN, BIGINT, STRING, ARRAY, ..."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def flag(v: Column) -> Column:
    """A key flag: booleans and numbers by value, texts true / yes / 1, else false."""
    kind = variant_kind(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind.isin(*_NUMBERS), F.try_variant_get(v, "$", "double") != 0)
        .when(
            kind == "STRING",
            F.lower(F.trim(F.try_variant_get(v, "$", "string"))).isin("true", "yes", "1"),
        ),
        F.lit(False),
    )


def present(v: Column) -> Column:
    """Whether a value is neither missing, false, zero nor empty."""
    kind = variant_kind(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind.isin(*_NUMBERS), F.try_variant_get(v, "$", "double") != 0)
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.isin("OBJECT", "ARRAY"), ~F.to_json(v).isin("{}", "[]")),
        F.lit(False),
    )


def nullable_text(is_nullable: Column, nullable: Column) -> Column:
    """YES / NO / empty from either spelling of the nullable field."""

    def yes_no(condition: Column) -> Column:
        return F.when(condition, "YES").otherwise("NO")

    kind = variant_kind(nullable)
    from_nullable = (
        F.when(kind == "BOOLEAN", yes_no(F.try_variant_get(nullable, "$", "boolean")))
        .when(
            kind == "STRING",
            yes_no(F.upper(F.try_variant_get(nullable, "$", "string")).isin("YES", "TRUE", "1")),
        )
        .otherwise("")
    )
    from_alias = F.when(
        variant_kind(is_nullable) == "BOOLEAN",
        yes_no(F.try_variant_get(is_nullable, "$", "boolean")),
    ).otherwise(F.try_variant_get(is_nullable, "$", "string"))
    return F.when(is_nullable.isNull(), from_nullable).otherwise(from_alias)
