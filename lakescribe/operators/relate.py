"""Foreign key edges between the tables of a catalogue.

Every way to find a target is a look-up by name in one dictionary of tables: the
inferred reference, the explicit reference and the name rule, each in the given
schema, the column's own one, or any. A column asks all of them at once, and the
first answer in order of preference is its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakescribe.functions import scalars
from lakescribe.operators.skew import grown, lookup

TABLE = ["system_name", "schema_name", "table_name"]
WORD = ["system_name", "kind", "scope", "token"]

ANY_SCHEMA = "*"
WAYS = ("ai", "explicit", "name")


def _in_schema(schema: Column | str) -> Column:
    return F.concat(F.lit("="), schema)


def first_keys(columns: DataFrame) -> DataFrame:
    """First native primary key column of each table."""
    return (
        columns.filter(F.col("is_primary_key") & (F.col("column_name") != ""))
        .groupBy(*TABLE)
        .agg(F.min_by("column_name", "ordinal").alias("pk_column"))
    )


def candidates(columns: DataFrame, pk_may_reference: bool = False) -> DataFrame:
    """Columns that may refer to another table."""
    name = F.col("column_name")
    may = (F.col("is_foreign_key") | F.col("inferred_fk") | name.endswith("id")) & (name != "")
    if not pk_may_reference:
        may = may & ~F.col("is_primary_key")
    return columns.filter(may)


def keyed_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their first key column."""
    return tables.select(*TABLE).join(grown(first_keys(columns)), TABLE, "left")


def dictionary(keyed: DataFrame) -> DataFrame:
    """Best tables per word: (system_name, kind, scope, token, options).

    A ``given`` word is a full table name, a ``name`` word the full or the bare
    one. Of several tables the full name wins, then the prefixes in the order dim,
    fact, vw, stg, int, lkp, then the lowest name and schema. Only the two best
    are kept, the second for columns of the best table itself, so the look-up
    adds no rows however many tables share a name.
    """
    name = F.col("table_name")
    bare = scalars.bare_table_name(name)

    def word(kind: str, token: Column, rank: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), token.alias("token"), rank.alias("rank"))

    words = F.array_compact(
        F.array(
            word("given", name, F.lit(0)),
            word("name", name, F.lit(0)),
            F.when(bare != name, word("name", bare, scalars.prefix_rank(name))),
        )
    )
    rows = (
        keyed.select("*", F.inline(words))
        .withColumn("scope", F.explode(F.array(_in_schema("schema_name"), F.lit(ANY_SCHEMA))))
        .select(
            *WORD,
            F.struct(
                "rank", F.col("table_name").alias("table"), F.col("schema_name").alias("schema"), "pk_column"
            ).alias("pick"),
        )
    )
    place = F.dense_rank().over(Window.partitionBy(*WORD).orderBy("pick"))
    wanted = F.when(F.col("kind") == "name", 2).otherwise(1)
    kept = rows.withColumn("place", place).filter("place <= 2").filter(F.col("place") <= wanted)
    return kept.groupBy(*WORD).agg(F.sort_array(F.collect_set("pick")).alias("options"))


def _asks(ways: tuple[str, ...]) -> Column:
    """Words a column asks for, in order of preference."""
    out = []
    for way in ways:
        if way == "name":
            token = F.element_at(scalars.entity_names("column_name"), 1)
            scopes, kind, column = [_in_schema("schema_name"), F.lit(ANY_SCHEMA)], "name", F.lit(None)
        else:
            prefix = "inf_ref" if way == "ai" else "fk_ref"
            token, kind = F.col(f"{prefix}_table"), "given"
            scopes = [
                _in_schema(F.col(f"{prefix}_schema")),
                _in_schema("schema_name"),
                F.lit(ANY_SCHEMA),
            ]
            column = F.col(f"{prefix}_column")
        for scope in scopes:
            ask = F.struct(
                F.lit(len(out)).alias("preference"),
                F.lit(way).alias("way"),
                F.lit(kind).alias("kind"),
                scope.alias("scope"),
                token.alias("token"),
                column.cast("string").alias("given"),
            )
            out.append(F.when(token.isNotNull() & scope.isNotNull(), ask))
    return F.array_compact(F.array(*out))


def resolve(asked: DataFrame, keyed: DataFrame, ways: tuple[str, ...] = WAYS) -> DataFrame:
    """Candidates with ``found``: (preference, way, schema, table, pk_column, given) or null.

    The name rule never answers with the column's own table.
    """
    own = asked.select(
        *TABLE, "column_name", "ordinal", "is_foreign_key", "inferred_fk", F.explode_outer(_asks(ways)).alias("ask")
    ).select(*TABLE, "column_name", "ordinal", "is_foreign_key", "inferred_fk", "ask.*")
    answered = lookup(own, grown(dictionary(keyed)), WORD)
    fit = F.filter(
        "options",
        lambda t: (F.col("kind") == "given")
        | (t["table"] != F.col("table_name"))
        | (t["schema"] != F.col("schema_name")),
    )
    pick = F.get(fit, 0)
    found = F.when(
        pick.isNotNull(),
        F.struct(
            "preference",
            "way",
            pick["schema"].alias("schema"),
            pick["table"].alias("table"),
            pick["pk_column"].alias("pk_column"),
            "given",
        ),
    )
    return (
        answered.withColumn("found", found)
        .groupBy(*TABLE, "column_name")
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.bool_or("is_foreign_key").alias("is_foreign_key"),
            F.bool_or("inferred_fk").alias("inferred_fk"),
            F.min("found").alias("found"),
        )
    )


def relate(tables: DataFrame, columns: DataFrame, pk_may_reference: bool = False) -> DataFrame:
    """Edge list of a catalogue; ``columns`` in the normal form.

    An inferred target goes before an explicit one, and that before the name
    rule. Flagged columns without a target are kept as unresolved self edges. A
    column gives one edge, so (source, target, source_column) tells edges apart.
    """
    edges = resolve(candidates(columns, pk_may_reference), keyed_tables(tables, columns))
    target = F.col("found")
    is_self = (target["schema"] == F.col("schema_name")) & (target["table"] == F.col("table_name"))
    is_edge = F.coalesce(target.isNotNull() & ~is_self, F.lit(False))
    return edges.filter(is_edge | F.col("is_foreign_key") | F.col("inferred_fk")).select(
        "system_name",
        F.col("schema_name").alias("source_schema"),
        F.col("table_name").alias("source"),
        F.when(is_edge, target["schema"]).otherwise(F.col("schema_name")).alias("target_schema"),
        F.when(is_edge, target["table"]).otherwise(F.col("table_name")).alias("target"),
        F.lit("FK").alias("type"),
        F.col("column_name").alias("source_column"),
        F.when(
            is_edge, F.coalesce(scalars.blank_to_null(target["given"]), target["pk_column"])
        ).alias("target_column"),
        (~is_edge).alias("unresolved"),
        ((is_edge & F.coalesce(target["way"] == "ai", F.lit(False))) | F.col("inferred_fk")).alias("is_inferred"),
        F.when(is_edge, target["way"]).when(is_self, "self").alias("method"),
        "ordinal",
    )
