"""Primary key candidates from names, types and measured uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe import model
from lakescribe.functions import scalars
from lakescribe.operators.skew import grown

KEY, TABLE = model.COLUMN_KEY, model.TABLE_KEY

# Weights of the signals (fixed values). A candidate needs a name signal.
WEIGHTS = {"id": 8, "own_name": 6, "suffix": 4, "type": 2, "unique": 2, "not_null": 1}


def name_signal() -> Column:
    """Weight of the column name: id, the table's own key name, or a key suffix."""
    name = F.regexp_replace(F.lower("column_name"), "^[a-z]{1,2}_", "")
    whole = F.lower("column_name")
    table = F.lower(scalars.bare_table_name("table_name"))
    own = F.array(*[F.concat(table, F.lit(s)) for s in ("_id", "id", "_key", "key")])
    return (
        F.when(whole == "id", WEIGHTS["id"])
        .when(F.array_contains(own, whole) | F.array_contains(own, name), WEIGHTS["own_name"])
        .when(whole.rlike("(_id|_key|[a-z]key)$|^pk_"), WEIGHTS["suffix"])
        .otherwise(0)
    )


def score(columns: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Columns that may be a primary key, with a score.

    With ``measured`` (table_name, column_name, null_count, unique) a candidate
    must be unique and without nulls in the data; without it the catalogue's own
    flags count as signals.
    """
    family = scalars.type_family("data_type")
    if measured is not None:
        facts = measured.select("table_name", "column_name", "null_count", F.col("unique").alias("_u"))
        columns = (
            columns.join(grown(facts), ["table_name", "column_name"])
            .filter(F.col("_u") & (F.col("null_count") == 0))
            .withColumns({"_unique": F.lit(True), "_not_null": F.lit(True)})
        )
    else:
        columns = columns.withColumns(
            {
                "_unique": F.coalesce(F.col("unique"), F.lit(False)),
                "_not_null": ~F.coalesce(F.col("nullable"), F.lit(True)),
            }
        )
    signal = name_signal()
    total = (
        signal
        + F.when(family.isin("INT", "UUID"), WEIGHTS["type"]).otherwise(0)
        + F.when(F.col("_unique"), WEIGHTS["unique"]).otherwise(0)
        + F.when(F.col("_not_null"), WEIGHTS["not_null"]).otherwise(0)
    )
    return columns.filter(signal > 0).select(*KEY, "ordinal", total.alias("score"))


def best_per_table(scored: DataFrame) -> DataFrame:
    """The highest score of each table, the first column among equals."""
    return scored.groupBy(*TABLE).agg(
        F.min_by("column_name", F.struct(-F.col("score"), "ordinal")).alias("column_name"),
        F.max("score").alias("score"),
    )


def without_primary(columns: DataFrame) -> DataFrame:
    """Columns of tables that have no native primary key."""
    keyed = columns.filter("primary_key").select(*TABLE).distinct()
    return columns.join(grown(keyed), TABLE, "left_anti")


def cleared(columns: DataFrame) -> DataFrame:
    """Columns without the annotations of an earlier inference."""
    return columns.withColumns(
        {
            "inferred_pk": F.lit(None).cast("boolean"),
            "inferred_fk": F.lit(None).cast("boolean"),
            "inferred_fk_references": F.lit(None).cast(model.REFERENCE),
        }
    )


def infer_primary(columns: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """One candidate for each table without a native key."""
    return best_per_table(score(without_primary(columns), measured))


def apply_primary(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mark candidates that exist and are not native keys already."""
    marks = candidates.select(*KEY).distinct().withColumn("_mark", F.lit(True))
    return (
        columns.drop("inferred_pk")
        .join(grown(marks), KEY, "left")
        .withColumn("inferred_pk", F.when(F.col("_mark") & ~F.col("primary_key"), True))
        .drop("_mark")
    )


def final_keys() -> Column:
    return F.col("primary_key") | F.coalesce(F.col("inferred_pk"), F.lit(False))


def key_context(columns: DataFrame) -> DataFrame:
    """Row per table: its final keys and its (name, type) list in ordinal order."""
    ordered = F.sort_array(
        F.collect_list(
            F.struct(
                "ordinal",
                F.col("column_name").alias("name"),
                F.col("data_type").alias("type"),
                final_keys().alias("pk"),
                F.col("foreign_key").alias("fk"),
            )
        )
    )
    pick = lambda test: F.transform(F.filter("_all", test), lambda x: x["name"])
    return (
        columns.groupBy(*TABLE)
        .agg(ordered.alias("_all"))
        .select(
            *TABLE,
            pick(lambda x: x["pk"]).alias("primary_keys"),
            pick(lambda x: x["fk"]).alias("foreign_keys"),
            F.transform(
                "_all", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))
            ).alias("columns"),
        )
    )
