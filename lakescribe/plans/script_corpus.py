"""A corpus of SQL scripts derived from ``part``: one script per part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakescribe.plans import fleet

# Declared types of the script columns by the fleet's types (fixed values).
DECLARED = {
    "BIGINT": "BIGINT",
    "STRING": "NVARCHAR(50)",
    "DOUBLE": "DOUBLE   PRECISION",
    "TIMESTAMP": "DATETIME2(7)",
}

# The same rows in SQL: ``sc`` holds the columns the scripts declare.
SQL = (
    fleet.SQL
    + """, sc AS (
  SELECT 's' || (k % 4) AS schema_name, 'ent' || k AS table_name, k, ordinal, column_name,
    CASE data_type WHEN 'STRING' THEN 'NVARCHAR' WHEN 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN 'TIMESTAMP' THEN 'DATETIME2' ELSE data_type END AS data_type,
    ordinal <> 1 AS nullable, ordinal = 1 AND (k % 3 = 0 OR k % 5 = 0) AS is_unique, ordinal = 1 AND k % 7 = 0 AS is_generated,
    pk AS primary_key, fk OR (ordinal = 2 AND k >= 2 AND k % 5 = 1) AS foreign_key,
    CASE WHEN fk THEN 's' || (parent % 4) WHEN ordinal = 2 AND k >= 2 AND k % 5 = 1 THEN 'dbo' END AS ref_schema,
    CASE WHEN fk OR (ordinal = 2 AND k >= 2 AND k % 5 = 1) THEN 'ent' || parent END AS ref_table,
    CASE WHEN fk OR (ordinal = 2 AND k >= 2 AND k % 5 = 1) THEN 'ent' || parent || '_id' END AS ref_column
  FROM ca)
"""
)


def _text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _column(o: Column) -> Column:
    k, parent = F.col("k").cast("string"), F.col("parent").cast("string")
    refers = (o == 2) & (F.col("k") >= 2)
    name = (
        F.when(o == 1, _text("ent", k, "_id"))
        .when(refers, _text("ent", parent, fleet._pick(fleet.SUFFIXES, F.col("k") % 3)))
        .otherwise(_text("c", o.cast("string")))
    )
    kind = (
        F.when(o <= 2, DECLARED["BIGINT"])
        .when(o % 3 == 0, DECLARED["STRING"])
        .when(o % 3 == 1, DECLARED["DOUBLE"])
        .otherwise(DECLARED["TIMESTAMP"])
    )
    flags = F.when(
        o == 1,
        _text(
            " NOT NULL",
            F.when(F.col("k") % 3 == 0, " UNIQUE").otherwise(""),
            F.when(F.col("k") % 7 == 0, " IDENTITY(1,1)").otherwise(""),
        ),
    ).otherwise(
        _text(
            F.when(o % 4 == 0, " DEFAULT 'NOT NULL, (x;'").otherwise(" NULL"),
            F.when(
                refers & (F.col("k") % 5 == 1), _text(" REFERENCES [ent", parent, "]([ent", parent, "_id])")
            ).otherwise(""),
        )
    )
    return _text("  [", name, "] ", kind, flags)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system_name, path, k, script) with one table per script."""
    k, parent = F.col("k").cast("string"), F.col("parent").cast("string")
    schema, table = _text("s", (F.col("k") % 4).cast("string")), _text("ent", k)
    body = F.array_join(
        F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), _column), ",\n"
    )
    script = _text(
        "-- part ", k, "; it's one of the fleet\nUSE [fleet", (F.col("k") % 3).cast("string"), "]\r\nGO\r\n",
        "INSERT INTO log VALUES ('a;b -- c', 'CREATE TABLE x (y INT)');\n/* block; it's ' */\nCREATE TABLE [",
        schema, "].[", table, "] (\n", body,
        F.when(F.col("k") % 11 != 0, _text(",\n  CONSTRAINT [pk_", k, "] PRIMARY KEY CLUSTERED ([ent", k, "_id] ASC)")).otherwise(""),
        F.when(F.col("k") % 5 == 0, _text(",\n  UNIQUE ([ent", k, "_ID])")).otherwise(""),
        ") ON [PRIMARY]\ngo\n",
        F.when(
            (F.col("k") >= 2) & (F.col("k") % 2 == 0) & (F.col("p_size") >= 2),
            _text(
                "ALTER TABLE [", schema, "].[", table, "] WITH CHECK ADD CONSTRAINT [fk_", k, "] FOREIGN KEY([ent", parent,
                fleet._pick(fleet.SUFFIXES, F.col("k") % 3), "]) REFERENCES [s", (F.col("parent") % 4).cast("string"),
                "].[ent", parent, "] ([ent", parent, "_id]);\n",
            ),
        ).otherwise(""),
    )
    return fleet.parts(spark, sf_dir).select(
        F.lit("scripts").alias("system_name"),
        F.lpad(k, 12, "0").alias("path"),
        "k",
        script.alias("script"),
    )


def encoded(found: DataFrame) -> DataFrame:
    """The scripts as bytes in five encodings by the part key."""
    text, which = F.col("script"), F.col("k") % 5
    mark = lambda h: F.unhex(F.lit(h))
    content = (
        F.when(which == 0, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")))
        .when(which == 1, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .when(which == 2, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")))
        .when(which == 3, F.encode(text, "UTF-16LE"))
        .otherwise(F.encode(F.concat(text, F.lit("-- é")), "ISO-8859-1"))
    )
    return found.select("system_name", "path", "k", "script", content.alias("content"))
