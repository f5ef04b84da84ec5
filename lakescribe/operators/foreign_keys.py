"""Foreign key candidates from names and data, their validation and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakescribe import model
from lakescribe.functions import scalars
from lakescribe.operators.inclusion import inclusions
from lakescribe.operators.keys import final_keys
from lakescribe.operators.skew import grown, lookup
from lakescribe.session import materialized

KEY, TABLE = model.COLUMN_KEY, model.TABLE_KEY
SEQUENCE = "sequence"

# Key names that say nothing about the table they belong to (fixed values).
GENERIC = ("id", "key", "pk", "uuid", "guid", "rowid")


def plain_name(name: Column | str) -> Column:
    """Column name in lower case without a one- or two-letter table tag."""
    return F.regexp_replace(F.lower(name), "^[a-z]{1,2}_", "")


def _parents(columns: DataFrame) -> DataFrame:
    """Tables with exactly one final key column, with the names they answer to.

    Rank 0 is the key's own name, rank 1 the table's name with or without a
    plural ending.
    """
    single = (
        columns.filter(final_keys())
        .groupBy(*TABLE)
        .agg(
            F.count("*").alias("n"),
            F.min("column_name").alias("parent_column"),
            F.min("data_type").alias("data_type"),
        )
        .filter("n = 1")
    )
    own = plain_name("parent_column")
    table = F.lower(scalars.bare_table_name("table_name"))

    def entry(rank: int, name: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), name.alias("token"))

    names = F.array_compact(
        F.array(
            F.when(~own.isin(*GENERIC), entry(0, own)),
            entry(1, table),
            F.when(table.endswith("s"), entry(1, F.regexp_replace(table, "s$", ""))),
        )
    )
    return single.select(
        "system_name",
        F.col("schema_name").alias("parent_schema"),
        F.col("table_name").alias("parent_table"),
        "parent_column",
        scalars.type_family("data_type").alias("family"),
        F.inline(names),
    )


def _children(columns: DataFrame) -> DataFrame:
    """Columns that may refer to a key, with the names they ask for."""
    own = plain_name("column_name")
    entity = F.lower(F.element_at(scalars.entity_names("column_name"), 1))

    def entry(rank: int, name: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), name.alias("token"))

    names = F.array_compact(
        F.array(
            F.when(~own.isin(*GENERIC), entry(0, own)),
            F.when((entity != F.lower("column_name")) & (entity != ""), entry(1, entity)),
        )
    )
    return columns.select(
        *KEY, "ordinal", scalars.type_family("data_type").alias("family"), F.inline(names)
    )


def name_pairs(columns: DataFrame) -> DataFrame:
    """Every (child, parent) pair of a lake whose names and type family agree.

    A name that k tables share gives k * k pairs: ``best_parents`` keeps one
    parent per child, and ``confirmed`` asks the values before the names.
    """
    parents = _parents(columns)
    own = (F.col("parent_schema") == F.col("schema_name")) & (
        F.col("parent_table") == F.col("table_name")
    )
    return (
        _children(columns)
        .join(grown(parents), ["system_name", "family", "rank", "token"])
        .filter(~own)
        .select(*KEY, "parent_schema", "parent_table", "parent_column")
        .distinct()
    )


def best_parents(columns: DataFrame) -> DataFrame:
    """One parent per child column: same schema first, then the lowest schema.

    Parents are folded to the two first ones per name before the join, two
    because the first may be the child's own table. So the join never yields
    more rows than there are children, however many tables share a key name.
    """
    parents = _parents(columns)
    parent = F.struct("parent_schema", "parent_table", "parent_column")
    wide = ["system_name", "family", "rank", "token"]

    def two_first(keys: list[str], name: str) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(parent))
        kept = parents.withColumn("_place", place).filter("_place <= 2")
        return kept.groupBy(*keys).agg(F.sort_array(F.collect_set(parent)).alias(name))

    asked = _children(columns).withColumn("parent_schema", F.col("schema_name"))
    near = lookup(asked, grown(two_first([*wide, "parent_schema"], "_near")), [*wide, "parent_schema"])
    found = lookup(near.drop("parent_schema"), grown(two_first(wide, "_far")), wide)
    options = F.filter(
        F.concat(
            F.coalesce("_near", F.array().cast(found.schema["_near"].dataType)),
            F.coalesce("_far", F.array().cast(found.schema["_far"].dataType)),
        ),
        lambda p: p.isNotNull()
        & ~((p["parent_schema"] == F.col("schema_name")) & (p["parent_table"] == F.col("table_name"))),
    )
    picked = found.withColumn("_p", F.get(options, 0)).filter(F.col("_p").isNotNull())
    return (
        picked.groupBy(*KEY)
        .agg(F.min_by("_p", "rank").alias("_p"))
        .select(*KEY, "_p.parent_schema", "_p.parent_table", "_p.parent_column")
    )


def confirmed(columns: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Foreign keys of a lake: child columns whose values all lie in a key that their name asks for.

    Names choose the columns to read, those that ask for any key and the keys
    asked for; the driver holds one entry per such column, never a pair. The
    values then find the pairs, and names are compared only for pairs whose
    values agree: a key name that k tables share gives 2 * k columns, not k * k
    pairs. Columns are child_table, child_column, parent_table, parent_column,
    n_child and n_parent (distinct values). A child without values has no key.
    """
    columns = materialized(columns, "columns")  # asked several times, and often just measured
    named = ["system_name", "family", "rank", "token"]
    children, parents = _children(columns), _parents(columns)
    asking = children.join(grown(parents.select(*named).distinct()), named, "left_semi")
    asked = parents.join(grown(children.select(*named).distinct()), named, "left_semi")
    parent = [F.col("parent_table").alias("t"), F.col("parent_column").alias("c")]
    wanted = asking.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"), F.lit(True).alias("child")).unionByName(
        asked.select(*parent, F.lit(False).alias("child"))
    )
    listed = [r for r in wanted.distinct().collect() if r.t in frames and r.c in frames[r.t].columns]
    found = inclusions(frames, [(r.t, r.c) for r in listed if r.child], [(r.t, r.c) for r in listed if not r.child])
    child_names = asking.select(F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"), *named)
    parent_names = asked.select("parent_table", "parent_column", *named)
    return (
        found.join(grown(child_names), ["child_table", "child_column"])
        .join(grown(parent_names), ["parent_table", "parent_column", *named], "left_semi")
        .select(*found.columns)
        .distinct()
    )


def complete(answers: DataFrame) -> DataFrame:
    """Answers in which no name is missing or blank."""
    needed = ("source_table", "source_column", "target_table", "target_column")
    test = F.lit(True)
    for n in needed:
        test = test & F.col(n).isNotNull() & (F.col(n) != "")
    return answers.filter(test)


def validate(answers: DataFrame, columns: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """Answers with the real names found, or the reason they are rejected.

    Names match in any letter case; of several tables of one name the lowest
    schema counts. ``reject_reason`` is null for valid answers. A column
    ``sequence``, the place of an answer among all, is kept.
    """
    lowered = F.lower("table_name")
    tables = columns.groupBy("system_name", lowered.alias("_t")).agg(
        F.min(F.struct("schema_name", "table_name")).alias("_table")
    )
    keys = columns.groupBy(
        "system_name", "schema_name", "table_name", F.lower("column_name").alias("_c")
    ).agg(F.min("column_name").alias("_name"), F.bool_or(final_keys()).alias("_pk"))

    answers = complete(answers)

    def side(df: DataFrame, role: str) -> DataFrame:
        """Find table and column of one role, once per distinct pair of names."""
        names = ["system_name", f"_{role}_t", f"_{role}_c"]
        lowered = {
            f"_{role}_t": F.lower(f"{role}_table"),
            f"_{role}_c": F.lower(f"{role}_column"),
        }
        asked = answers.withColumns(lowered).select(*names)
        found = (
            asked.distinct()
            .join(grown(tables.toDF("system_name", f"_{role}_t", f"_{role}")), names[:2], "left")
            .withColumns(
                {
                    "schema_name": F.col(f"_{role}.schema_name"),
                    "table_name": F.col(f"_{role}.table_name"),
                    "_c": F.col(f"_{role}_c"),
                }
            )
            .join(grown(keys), ["system_name", "schema_name", "table_name", "_c"], "left")
            .select(
                *names,
                f"_{role}",
                F.col("_name").alias(f"_{role}_column"),
                F.col("_pk").alias(f"_{role}_pk"),
            )
        )
        return lookup(df.withColumns(lowered), grown(found), names)

    checked = side(side(answers, "source"), "target")
    reason = (
        F.when(F.col("_source").isNull(), "source table not found")
        .when(F.col("_target").isNull(), "target table not found")
        .when(F.col("_source_column").isNull(), "source column not found")
        .when(~F.coalesce(F.col("_target_pk"), F.lit(False)), "target column is not a key")
    )
    return checked.select(
        "system_name",
        F.col("_source.schema_name").alias("schema_name"),
        F.col("_source.table_name").alias("table_name"),
        F.col("_source_column").alias("column_name"),
        F.coalesce(scalars.blank_to_null("target_schema"), F.lit(default_schema)).alias("target_schema"),
        "target_table",
        "target_column",
        reason.alias("reject_reason"),
        *(c for c in answers.columns if c == SEQUENCE),
    )


def apply_foreign(columns: DataFrame, valid: DataFrame) -> DataFrame:
    """Set the inferred reference on columns that are not native foreign keys.

    Of several valid answers the last in ``sequence`` counts; without such a
    column, and among equals, the highest by name.
    """
    target = F.struct(
        F.col("target_schema").alias("schema"),
        F.col("target_table").alias("table"),
        F.col("target_column").alias("column"),
    )
    last = F.struct(*(c for c in valid.columns if c == SEQUENCE), target)
    chosen = (
        valid.filter(F.col("reject_reason").isNull()).groupBy(*KEY).agg(F.max_by(target, last).alias("_ref"))
    )
    free = ~F.col("foreign_key") & F.col("_ref").isNotNull()
    return (
        columns.drop("inferred_fk", "inferred_fk_references")
        .join(grown(chosen), KEY, "left")
        .withColumns(
            {
                "inferred_fk": F.when(free, True),
                "inferred_fk_references": F.when(free, F.col("_ref")),
            }
        )
        .drop("_ref")
    )
