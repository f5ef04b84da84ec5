"""Descriptions: answers to rows, their join to the catalogue, and fallbacks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.functions import json_text
from lakescribe.operators.skew import grown

TABLE = ["system_name", "schema_name", "table_name"]

# Texts of descriptions made without a service, and how many column names a table
# text shows (fixed values).
TABLE_TEXT = "Table %s with columns: %s.%s"
KEYS_TEXT = " Primary key(s): %s."
COLUMN_TEXT = "Column %s in table %s."
COMBINED_TABLE_TEXT = "Table %s containing business data."
COMBINED_COLUMN_TEXT = "Details for %s."
NAMES_SHOWN = 10


def parse_answers(answers: DataFrame) -> DataFrame:
    """(system_name, batch_no, table_name, table_description, columns) per answered table.

    ``answers`` holds the answer text of each batch: a JSON object keyed by
    table, with or without other text around it.
    """
    entry = (
        "struct<table_description: string, column_descriptions: "
        "array<struct<columnName: string, column_name: string, description: string>>>"
    )
    by_table = F.try_variant_get(json_text.noisy_json(F.col("answer")), "$", f"map<string, {entry}>")
    return answers.select("system_name", "batch_no", F.explode(by_table).alias("table_name", "e")).select(
        "system_name",
        "batch_no",
        "table_name",
        F.col("e.table_description").alias("table_description"),
        F.col("e.column_descriptions").alias("columns"),
    )


def answered_columns(parsed: DataFrame) -> DataFrame:
    """One row per described column; the last mention of a column counts."""
    rows = parsed.select(
        "system_name", "batch_no", "table_name", F.posexplode("columns").alias("pos", "c")
    ).select(
        "system_name",
        "batch_no",
        "table_name",
        "pos",
        F.coalesce("c.columnName", "c.column_name").alias("column_name"),
        F.col("c.description").alias("description"),
    )
    return rows.groupBy("system_name", "batch_no", "table_name", "column_name").agg(
        F.max_by("description", "pos").alias("description")
    )


def described_tables(tables: DataFrame, batches: DataFrame, parsed: DataFrame) -> DataFrame:
    """Tables with the answered description and a status; unanswered ones keep theirs."""
    answers = parsed.groupBy("system_name", "batch_no", "table_name").agg(
        F.min(F.coalesce("table_description", F.lit(""))).alias("_d")
    )
    return (
        tables.join(grown(batches.select(*TABLE, "batch_no")), TABLE, "left")
        .join(grown(answers), ["system_name", "batch_no", "table_name"], "left")
        .withColumn("status", F.when(F.col("_d").isNull(), "missing").otherwise("described"))
        .withColumn("description", F.coalesce("_d", "description"))
        .drop("_d")
    )


def described_columns(
    columns: DataFrame, batches: DataFrame, parsed: DataFrame
) -> DataFrame:
    """Columns with answered descriptions; an answered table without one gives ""."""
    answered = parsed.select("system_name", "batch_no", "table_name").distinct().withColumn(
        "_table", F.lit(True)
    )
    texts = answered_columns(parsed).withColumnRenamed("description", "_d")
    own = columns.join(grown(batches.select(*TABLE, "batch_no")), TABLE, "left")
    return (
        own.join(grown(texts), ["system_name", "batch_no", "table_name", "column_name"], "left")
        .join(grown(answered), ["system_name", "batch_no", "table_name"], "left")
        .withColumn(
            "description",
            F.when(F.col("_table"), F.coalesce("_d", F.lit(""))).otherwise(F.col("description")),
        )
        .drop("_d", "_table", "batch_no")
    )


def table_text(table: Column, names: Column, keys: Column) -> Column:
    """Plain description of a table from its first column names and its keys."""
    shown = F.array_join(F.slice(names, 1, NAMES_SHOWN), ", ")
    key_part = F.when(
        F.size(keys) > 0, F.format_string(KEYS_TEXT, F.array_join(keys, ", "))
    ).otherwise("")
    return F.format_string(TABLE_TEXT, table, shown, key_part)


def column_text(table: Column, column: Column) -> Column:
    return F.format_string(COLUMN_TEXT, column, table)


def combined_table_text(table: Column) -> Column:
    return F.format_string(COMBINED_TABLE_TEXT, table)


def combined_column_text(column: Column) -> Column:
    return F.format_string(COMBINED_COLUMN_TEXT, column)


def offline_answer(payload: str) -> str:
    """Answer of a batch when no service is at hand: a set text, empty columns."""
    return json.dumps(
        {
            t["table_name"]: {
                "table_description": COMBINED_TABLE_TEXT % t["table_name"],
                "column_descriptions": [
                    {"columnName": c["name"], "description": ""} for c in t["columns"]
                ],
            }
            for t in json.loads(payload)
        }
    )
