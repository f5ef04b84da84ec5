"""A corpus of SQL scripts to catalogue rows.

Every step is a DataFrame: files, statements, definitions, items, keys. Keys meet
their columns by joins, and the order of statements over a whole corpus is the
pair (path, stmt_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe import model
from lakescribe.functions import ddl_text as D
from lakescribe.operators.ordering import range_bounds, running
from lakescribe.operators.skew import grown, lookup
from lakescribe.session import materialized

SEQ = ["path", "stmt_idx"]
TABLE = model.TABLE_KEY

# Field names listed with a catalogue made from scripts (fixed values).
COLUMN_DEFINITION = (
    "column_name",
    "data_type",
    "nullable",
    "unique",
    "is_generated",
    "primary_key",
    "foreign_key",
    "references",
)


def statements(scripts: DataFrame) -> DataFrame:
    """(system_name, path, stmt_idx, stmt, bare, kind, is_ddl) of decoded scripts.

    ``bare`` is the statement on one line with empty literals; all keywords are
    looked for there, so nothing inside a literal is taken for SQL.
    """
    pieces = D.statements_of(D.batch_separators(D.masked_script(F.col("text"))))
    return (
        scripts.select("system_name", "path", F.posexplode(pieces).alias("stmt_idx", "_m"))
        .withColumn("bare", D.without_literals(F.col("_m")))
        .select(
            "system_name",
            "path",
            "stmt_idx",
            D.unmasked(F.col("_m")).alias("stmt"),
            "bare",
            D.statement_kind(F.col("bare")).alias("kind"),
            D.is_ddl(F.col("bare")).alias("is_ddl"),
        )
    )


def written(stmts: DataFrame) -> DataFrame:
    """The statements from a table in the shared folder instead of from the scripts."""
    return materialized(stmts.select("system_name", *SEQ, "stmt", "bare", "kind", "is_ddl"), "statements")


def reduction(scripts: DataFrame, stmts: DataFrame) -> DataFrame:
    """Per file: characters of the script and of its DDL, and the share saved."""
    # the kept statements are joined by ";\n\n" and end with ";"
    kept = (
        stmts.filter("is_ddl")
        .groupBy("system_name", "path")
        .agg((F.sum(F.length("stmt") + 3) - 2).alias("ddl_chars"))
    )
    share = (F.col("script_chars") - F.col("ddl_chars")) / F.col("script_chars") * 100
    return (
        scripts.select("system_name", "path", F.length("text").alias("script_chars"))
        .join(grown(kept), ["system_name", "path"], "left")
        .fillna(0, ["ddl_chars"])
        .withColumn("reduction", F.when(F.col("script_chars") > 0, share).otherwise(0.0))
    )


def databases(stmts: DataFrame, given: str = "") -> DataFrame:
    """Database per system: the given name, else the first USE of the corpus."""
    found = (
        stmts.withColumn("database", D.used_database(F.col("bare")))
        .filter(F.col("database").isNotNull())
        .groupBy("system_name")
        .agg(F.min_by("database", F.struct(*SEQ)).alias("_used"))
    )
    return (
        stmts.select("system_name")
        .distinct()
        .join(found, "system_name", "left")
        .select("system_name", F.coalesce(F.nullif(F.lit(given), F.lit("")), "_used", F.lit("")).alias("database"))
    )


def creates(stmts: DataFrame, default_schema: str) -> DataFrame:
    """CREATE TABLE statements with schema and table."""
    bare = F.col("bare")
    schema = D.clean_name(D.part(bare, D.CREATE_TABLE, 1))
    return (
        stmts.filter(F.col("kind") == "create")
        .withColumn("table_name", D.clean_name(D.part(bare, D.CREATE_TABLE, 2)))
        .filter(F.col("table_name").isNotNull())
        .select(
            "system_name",
            *SEQ,
            F.coalesce(schema, F.lit(default_schema)).alias("schema_name"),
            "table_name",
            "bare",
        )
    )


def last_creates(found: DataFrame) -> DataFrame:
    """The last CREATE of each table, which replaces the earlier ones."""
    last = found.groupBy(*TABLE).agg(F.max(F.struct(*SEQ)).alias("_s")).select(
        *TABLE, F.col("_s.path").alias("path"), F.col("_s.stmt_idx").alias("stmt_idx")
    )
    return found.join(grown(last), [*TABLE, *SEQ], "left_semi")


def _items(latest: DataFrame) -> DataFrame:
    items = D.body_items(D.create_body(F.col("bare")))
    return (
        latest.select(*TABLE, *SEQ, F.posexplode(items).alias("pos", "item"))
        .withColumn("item", D.column_item(F.col("item")))
        .withColumn("is_constraint", D.is_constraint(F.col("item")))
        .withColumn("_rest", D.column_rest(F.col("item")))
    )


def _is_column() -> Column:
    quoted = F.col("item").rlike(r'^[\["`]')
    return ~F.col("is_constraint") & (quoted | (F.col("_rest") != ""))


def _columns(items: DataFrame, default_schema: str) -> DataFrame:
    rest = F.col("_rest")
    has = lambda words: rest.rlike(rf"(?i)\b{words}\b")
    return items.filter(_is_column()).select(
        *TABLE,
        *SEQ,
        "pos",
        D.column_name(F.col("item")).alias("column_name"),
        D.base_type(rest).alias("data_type"),
        (~has(r"NOT\s+NULL")).alias("nullable"),
        has("UNIQUE").alias("unique"),
        has("IDENTITY").alias("is_generated"),
        has(r"PRIMARY\s+KEY").alias("primary_key"),
        D.inline_reference(rest, default_schema).alias("references"),
    )


def _alters(stmts: DataFrame, found: DataFrame, default_schema: str) -> DataFrame:
    """ALTER TABLE statements with the table they apply to.

    A table of that schema created before goes first; else the schema seen first
    in the corpus among those that had such a table by then. An ALTER before the
    last CREATE of its table has no effect.
    """
    bare = F.col("bare")
    seq = F.struct(*SEQ)
    asked = materialized(
        stmts.filter(F.col("kind") == "alter")
        .withColumn("table_name", D.clean_name(D.part(bare, D.ALTER_TABLE, 2)))
        .filter(F.col("table_name").isNotNull())
        .select(
            "system_name",
            F.coalesce(D.clean_name(D.part(bare, D.ALTER_TABLE, 1)), F.lit(default_schema)).alias(
                "schema_name"
            ),
            "table_name",
            *SEQ,
            F.regexp_replace(bare, D.ALTER_TABLE, "").alias("rest"),
        ),
        "alters",
    )
    spans = found.groupBy(*TABLE).agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"))
    exact = lookup(asked, grown(spans), TABLE)
    here = exact.filter(F.col("_first") < seq).filter(F.col("_last") < seq).drop("_first", "_last")

    elsewhere = exact.filter(F.col("_first").isNull() | ~(F.col("_first") < seq)).drop("_first", "_last")
    age = found.groupBy("system_name", "schema_name").agg(F.min(seq).alias("_age"))
    events = (
        lookup(spans, age, ["system_name", "schema_name"])
        .select(
            "system_name",
            "table_name",
            F.col("_first.path").alias("path"),
            F.col("_first.stmt_idx").alias("stmt_idx"),
            F.struct("_age", "schema_name").alias("_oldest"),
            F.lit(None).cast("string").alias("schema_name"),
            F.lit(None).cast("string").alias("rest"),
        )
        .unionByName(
            elsewhere.select(
                "system_name",
                "table_name",
                *SEQ,
                F.lit(None).cast("struct<_age: struct<path: string, stmt_idx: int>, schema_name: string>").alias("_oldest"),
                "schema_name",
                "rest",
            )
        )
    )
    by_name = ["system_name", "table_name"]
    placed = running(
        events,
        by_name,
        SEQ,
        {"_seen": ("min", F.col("_oldest"))},
        bounds=range_bounds(
            found.select(*by_name, *SEQ).unionByName(asked.select(*by_name, *SEQ)), [*by_name, *SEQ]
        ),
    ).filter(F.col("rest").isNotNull() & F.col("_seen").isNotNull())
    moved = (
        placed.select(
            "system_name", F.col("_seen.schema_name").alias("schema_name"), "table_name", *SEQ, "rest"
        )
        .join(grown(spans), TABLE)
        .filter(F.col("_last") < seq)
    )
    return here.unionByName(moved.drop("_first", "_last"))


def _keys(rows: DataFrame, text: str, in_alter: bool, default_schema: str) -> DataFrame:
    """One row per (key kind, column); foreign keys pair by position, the shorter list counts."""
    parts = rows.select(
        *TABLE, *SEQ, "pos", F.inline(D.key_parts(F.col(text), in_alter))
    )
    single = parts.filter(F.col("kind") != "FK").select(
        *TABLE, *SEQ, "pos", "kind", F.explode("columns").alias("column_name"),
        F.lit(None).cast(model.REFERENCE).alias("references"),
    )
    paired = (
        parts.filter(F.col("kind") == "FK")
        .select(
            *TABLE, *SEQ, "pos", "kind", "ref_schema", "ref_table",
            F.inline(F.arrays_zip(F.col("columns").alias("c"), F.col("ref_columns").alias("r"))),
        )
        .filter(F.col("c").isNotNull() & F.col("r").isNotNull())
        .select(
            *TABLE,
            *SEQ,
            "pos",
            "kind",
            F.col("c").alias("column_name"),
            F.struct(
                F.coalesce("ref_schema", F.lit(default_schema)).alias("schema"),
                F.col("ref_table").alias("table"),
                F.col("r").alias("column"),
            ).alias("references"),
        )
    )
    return single.unionByName(paired)


def written_items(stmts: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """Items of all table bodies, taken apart once and kept in the shared folder."""
    return materialized(_items(last_creates(creates(stmts, default_schema))), "items")


def key_rows(
    stmts: DataFrame, default_schema: str = "dbo", items: DataFrame | None = None
) -> DataFrame:
    """All table-level keys of a corpus, from CREATE bodies and later ALTERs."""
    found = creates(stmts, default_schema)
    items = _items(last_creates(found)) if items is None else items
    inside = _keys(items.filter(~_is_column()), "item", False, default_schema)
    # which table a statement makes is asked five times, and read from its text once
    heads = materialized(found.drop("bare"), "creates")
    alters = _alters(stmts, heads, default_schema).select(
        *TABLE, *SEQ, F.posexplode(D.added_items(F.col("rest"))).alias("pos", "item")
    )
    return inside.unionByName(_keys(alters, "item", True, default_schema))


def catalog(
    stmts: DataFrame, default_schema: str = "dbo", items: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tables and columns of a corpus, keys applied.

    The statements are used several times: hand in ``written(statements(...))``
    so that scripts are decoded and split once, and ``written_items`` of them so
    that table bodies are, too.
    """
    latest = last_creates(creates(stmts, default_schema))
    tables = model.conform(latest, model.TABLES)
    items = _items(latest) if items is None else items
    cols = _columns(items, default_schema).withColumn("_c", F.lower("column_name"))
    keys = (
        key_rows(stmts, default_schema, items)
        .groupBy(*TABLE, F.lower("column_name").alias("_c"))
        .agg(
            F.bool_or(F.col("kind") == "PK").alias("_pk"),
            F.bool_or(F.col("kind") == "UQ").alias("_uq"),
            F.max_by(
                "references",
                F.when(F.col("references").isNotNull(), F.struct(*SEQ, "pos")),
            ).alias("_ref"),
        )
    )
    flag = lambda own, added: F.col(own) | F.coalesce(F.col(added), F.lit(False))
    joined = cols.join(grown(keys), [*TABLE, "_c"], "left")
    ordinal = F.col("pos") + 1
    columns = joined.withColumns(
        {
            "ordinal": ordinal,
            "primary_key": flag("primary_key", "_pk"),
            "unique": flag("unique", "_uq"),
            "references": F.coalesce("_ref", "references"),
        }
    ).withColumn("foreign_key", F.col("references").isNotNull())
    return tables, model.conform(columns, model.COLUMNS)


def unparsed(scripts: DataFrame, stmts: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """Files that gave no table, and files with a table body that cannot be read."""
    found = creates(stmts, default_schema).select(
        "system_name", "path", D.create_body(F.col("bare")).isNotNull().alias("readable")
    )
    per_file = found.groupBy("system_name", "path").agg(
        F.bool_or("readable").alias("_any"), F.bool_and("readable").alias("_all")
    )
    with_ddl = stmts.filter("is_ddl").select("system_name", "path").distinct().withColumn("_ddl", F.lit(True))
    reason = (
        F.when(F.col("_any") & ~F.col("_all"), "a table body is not readable")
        .when(F.col("_any"), None)
        .when(F.col("_ddl"), "ddl without a readable table")
        .otherwise("no ddl")
    )
    return (
        scripts.select("system_name", "path")
        .join(grown(per_file), ["system_name", "path"], "left")
        .join(grown(with_ddl), ["system_name", "path"], "left")
        .select("system_name", "path", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def primary_schema(stmts: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """Per system the schema of the first table in the corpus."""
    return (
        creates(stmts, default_schema)
        .groupBy("system_name")
        .agg(F.min_by("schema_name", F.struct(*SEQ)).alias("primary_schema"))
    )
