"""Dictionary dumps of five SQL dialects to one model.

A dump is a DataFrame with the columns of a dictionary view, in any letter case.
A ``system_name`` column makes a fleet of dumps: every join below carries it, so
one call normalises one system or ten thousand. Each dialect yields the same
named parts; ``operators.assemble`` joins them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.functions.scalars import is_yes
from lakescribe.operators.skew import grown, lookup

Dumps = dict[str, DataFrame]

KEY_SCHEMA = "system_name string, schema_name string, table_name string, column_name string"
FOREIGN_SCHEMA = KEY_SCHEMA + ", ref_schema string, ref_table string, ref_column string"
DISTINCT_SCHEMA = KEY_SCHEMA + ", n_distinct double"


def _lowered(df: DataFrame) -> DataFrame:
    df = df.toDF(*[c.lower() for c in df.columns])
    return df if "system_name" in df.columns else df.withColumn("system_name", F.lit("system"))


def _within(schema_col: str, schema: str | None, fold: Callable[[str], str] = str) -> Column:
    return F.lit(True) if not schema else F.col(schema_col) == fold(schema)


def _listed(table_col: str, tables: list[str] | None, fold: Callable[[str], str] = str) -> Column:
    return F.lit(True) if not tables else F.col(table_col).isin([fold(t) for t in tables])


def _keys(constraints: DataFrame, usage: DataFrame, kind: str) -> DataFrame:
    """Columns of one constraint kind, matched by name, schema and table."""
    named = constraints.filter(F.col("constraint_type") == kind).select(
        "system_name", "constraint_name", F.col("table_schema"), "table_name"
    )
    return (
        usage.join(grown(named), ["system_name", "constraint_name", "table_schema", "table_name"], "left_semi")
        .select("system_name", F.col("table_schema").alias("schema_name"), "table_name", "column_name")
        .distinct()
    )


def _paired(usage: DataFrame, links: DataFrame) -> DataFrame:
    """Foreign key columns paired with the target key's columns by position.

    ``links`` holds (system_name, constraint_name, table_schema, target_name,
    target_schema) of each foreign key.
    """
    child = usage.join(grown(links), ["system_name", "constraint_name", "table_schema"]).select(
        "system_name",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "column_name",
        "target_name",
        "target_schema",
        F.coalesce("position_in_unique_constraint", "ordinal_position").alias("position"),
    )
    target = usage.select(
        "system_name",
        F.col("constraint_name").alias("target_name"),
        F.col("table_schema").alias("target_schema"),
        F.col("ordinal_position").alias("position"),
        F.col("table_schema").alias("ref_schema"),
        F.col("table_name").alias("ref_table"),
        F.col("column_name").alias("ref_column"),
    )
    # thousands of foreign keys may share one target key
    key = ["system_name", "target_name", "target_schema", "position"]
    return lookup(child, grown(target), key, "inner").select(
        "system_name", "schema_name", "table_name", "column_name", "ref_schema", "ref_table", "ref_column"
    )


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def postgres(d: Dumps, schema: str | None = None, tables=None, include_views=False) -> Dumps:
    kinds = ["r", "v", "m"] if include_views else ["r"]
    rel = (
        d["pg_class"]
        .filter(F.col("relkind").isin(kinds) & (F.col("relpersistence") != "t"))
        .filter(_listed("relname", tables))
    )
    spaces = d["pg_namespace"].select("system_name", F.col("oid").alias("relnamespace"), "nspname")
    base = (
        lookup(rel, spaces, ["system_name", "relnamespace"], "inner")
        .filter(_within("nspname", schema))
        .select(
            "system_name",
            F.col("nspname").alias("schema_name"),
            F.col("relname").alias("table_name"),
            F.when(F.col("relkind") == "r", "BASE TABLE").otherwise("VIEW").alias("table_type"),
            F.greatest(F.col("reltuples").cast("bigint"), F.lit(0)).alias("row_count"),
            F.col("total_bytes").cast("bigint").alias("size_bytes"),
        )
    )
    cols = (
        d["columns"]
        .filter(_within("table_schema", schema) & _listed("table_name", tables))
        .select(
            "system_name",
            F.col("table_schema").alias("schema_name"),
            "table_name",
            F.col("ordinal_position").cast("int").alias("ordinal"),
            "column_name",
            F.upper("udt_name").alias("data_type"),
            is_yes("is_nullable").alias("nullable"),
            (F.col("is_generated") != "NEVER").alias("is_generated"),
        )
    )
    links = (
        d["table_constraints"]
        .filter(F.col("constraint_type") == "FOREIGN KEY")
        .filter(_within("table_schema", schema))
        .select("system_name", "constraint_name", "table_schema")
        .distinct()
        .join(
            grown(d["referential_constraints"].select(
                "system_name",
                "constraint_name",
                F.col("constraint_schema").alias("table_schema"),
                F.col("unique_constraint_name").alias("target_name"),
                F.col("unique_constraint_schema").alias("target_schema"),
            )),
            ["system_name", "constraint_name", "table_schema"],
        )
    )
    stats = d["pg_stats"].select(
        "system_name",
        F.col("schemaname").alias("schema_name"),
        F.col("tablename").alias("table_name"),
        F.col("attname").alias("column_name"),
        F.col("n_distinct").cast("double").alias("n_distinct"),
    )
    return {
        "tables": base,
        "columns": cols,
        "primary": _keys(d["table_constraints"], d["key_column_usage"], "PRIMARY KEY"),
        "unique": _keys(d["table_constraints"], d["key_column_usage"], "UNIQUE"),
        "foreign": _paired(d["key_column_usage"], links),
        "distinct": stats,
    }


def bigquery(d: Dumps, schema: str | None = None, tables=None) -> Dumps:
    """Constraint and distinct dumps may be missing on some editions.

    The schema of a target key is the one given with the foreign key, else that
    of ``constraint_column_usage``, else the own one.
    """
    base = (
        d["tables"]
        .filter((F.col("table_type") == "TABLE") & _listed("table_id", tables))
        .filter(_within("dataset_id", schema))
        .select(
            "system_name",
            F.col("dataset_id").alias("schema_name"),
            F.col("table_id").alias("table_name"),
            F.lit("BASE TABLE").alias("table_type"),
            F.col("num_rows").cast("bigint").alias("row_count"),
            F.col("num_bytes").cast("bigint").alias("size_bytes"),
        )
    )
    cols = d["fields"].filter(_within("dataset_id", schema)).select(
        "system_name",
        F.col("dataset_id").alias("schema_name"),
        F.col("table_id").alias("table_name"),
        F.col("position").cast("int").alias("ordinal"),
        F.col("name").alias("column_name"),
        F.col("field_type").alias("data_type"),
        (F.col("mode") == "NULLABLE").alias("nullable"),
        F.lit(False).alias("is_generated"),
    )
    any_df = d["tables"]
    if "table_constraints" in d and "key_column_usage" in d:
        tc, kcu = d["table_constraints"], d["key_column_usage"]
        primary, unique = _keys(tc, kcu, "PRIMARY KEY"), _keys(tc, kcu, "UNIQUE")
        if "unique_constraint_name" in tc.columns:
            given = F.col("unique_constraint_schema") if "unique_constraint_schema" in tc.columns else F.lit(None).cast("string")
            links = tc.filter(F.col("constraint_type") == "FOREIGN KEY").select(
                "system_name",
                "constraint_name",
                "table_schema",
                F.col("unique_constraint_name").alias("target_name"),
                given.alias("target_schema"),
            )
            if "constraint_column_usage" in d:
                # the table of the target key, which may be in another dataset
                used = d["constraint_column_usage"].groupBy("system_name", F.col("constraint_name").alias("target_name"))
                links = lookup(links, grown(used.agg(F.min("table_schema").alias("_used"))), ["system_name", "target_name"])
                links = links.withColumn("target_schema", F.coalesce("target_schema", "_used")).drop("_used")
            links = links.withColumn("target_schema", F.coalesce("target_schema", "table_schema"))
            foreign = _paired(kcu, links)
        else:
            foreign = _empty(any_df, FOREIGN_SCHEMA)
    else:
        primary, unique = _empty(any_df, KEY_SCHEMA), _empty(any_df, KEY_SCHEMA)
        foreign = _empty(any_df, FOREIGN_SCHEMA)
    return {
        "tables": base,
        "columns": cols,
        "primary": primary,
        "unique": unique,
        "foreign": foreign,
        "distinct": d.get("distinct", _empty(any_df, DISTINCT_SCHEMA)),
    }


def oracle(d: Dumps, schema: str | None = None, tables=None) -> Dumps:
    # a table has one segment per partition: sum them before the join
    segments = d["dba_segments"].groupBy(
        "system_name", "owner", F.col("segment_name").alias("table_name")
    ).agg(F.sum("bytes").cast("bigint").alias("size_bytes"))
    base = (
        d["all_tables"]
        .filter((F.col("temporary") == "N") & _within("owner", schema, str.upper))
        .filter(_listed("table_name", tables, str.upper))
        .join(grown(segments), ["system_name", "owner", "table_name"], "left")
        .select(
            "system_name",
            F.col("owner").alias("schema_name"),
            "table_name",
            F.lit("BASE TABLE").alias("table_type"),
            F.col("num_rows").cast("bigint").alias("row_count"),
            "size_bytes",
        )
    )
    cols = (
        d["all_tab_cols"]
        .filter((F.col("hidden_column") == "NO") & _within("owner", schema, str.upper))
        .filter(_listed("table_name", tables, str.upper))
        .select(
            "system_name",
            F.col("owner").alias("schema_name"),
            "table_name",
            F.col("column_id").cast("int").alias("ordinal"),
            "column_name",
            "data_type",
            is_yes("nullable").alias("nullable"),
            is_yes("virtual_column").alias("is_generated"),
        )
    )
    constraints = d["all_constraints"].filter(_within("owner", schema, str.upper))
    members = d["all_cons_columns"]

    def keys(kind: str) -> DataFrame:
        named = constraints.filter(F.col("constraint_type") == kind)
        return (
            members.join(grown(named.select("system_name", "owner", "constraint_name")),
                         ["system_name", "owner", "constraint_name"], "left_semi")
            .select("system_name", F.col("owner").alias("schema_name"), "table_name", "column_name")
            .distinct()
        )

    usage = members.select(
        "system_name",
        "constraint_name",
        F.col("owner").alias("table_schema"),
        "table_name",
        "column_name",
        F.col("position").alias("ordinal_position"),
        F.lit(None).cast("int").alias("position_in_unique_constraint"),
    )
    links = constraints.filter(F.col("constraint_type") == "R").select(
        "system_name",
        "constraint_name",
        F.col("owner").alias("table_schema"),
        F.col("r_constraint_name").alias("target_name"),
        F.col("r_owner").alias("target_schema"),
    )
    stats = d["all_tab_col_statistics"].select(
        "system_name",
        F.col("owner").alias("schema_name"),
        "table_name",
        "column_name",
        F.col("num_distinct").cast("double").alias("n_distinct"),
    )
    return {
        "tables": base,
        "columns": cols,
        "primary": keys("P"),
        "unique": keys("U"),
        "foreign": _paired(usage, links),
        "distinct": stats,
    }


def snowflake(d: Dumps, schema: str | None = None, tables=None) -> Dumps:
    """Key listings may be missing; a target without schema means the own one."""
    here = _within("table_schema", schema, str.upper)
    listed = _listed("table_name", tables, str.upper)
    base = d["tables"].filter(here & listed & (F.col("table_type") == "BASE TABLE")).select(
        "system_name",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "table_type",
        F.col("row_count").cast("bigint").alias("row_count"),
        F.col("bytes").cast("bigint").alias("size_bytes"),
    )
    cols = d["columns"].filter(here & listed).select(
        "system_name",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        F.col("ordinal_position").cast("int").alias("ordinal"),
        "column_name",
        "data_type",
        is_yes("is_nullable").alias("nullable"),
        F.lit(False).alias("is_generated"),
    )

    def keys(name: str) -> DataFrame:
        if name not in d:
            return _empty(d["tables"], KEY_SCHEMA)
        return d[name].select("system_name", "schema_name", "table_name", "column_name").distinct()

    foreign = _empty(d["tables"], FOREIGN_SCHEMA)
    if "imported_keys" in d:
        foreign = d["imported_keys"].select(
            "system_name",
            F.col("fk_schema_name").alias("schema_name"),
            F.col("fk_table_name").alias("table_name"),
            F.col("fk_column_name").alias("column_name"),
            F.coalesce("pk_schema_name", "fk_schema_name").alias("ref_schema"),
            F.col("pk_table_name").alias("ref_table"),
            F.col("pk_column_name").alias("ref_column"),
        )
    return {
        "tables": base,
        "columns": cols,
        "primary": keys("primary_keys"),
        "unique": keys("unique_keys"),
        "foreign": foreign,
        "distinct": d.get("distinct", _empty(d["tables"], DISTINCT_SCHEMA)),
    }


def _named_objects(d: Dumps) -> DataFrame:
    """(system_name, object_id, schema_name, table_name) of all tables."""
    tables = d["sys_tables"].select(
        "system_name", "object_id", "schema_id", F.col("name").alias("table_name")
    )
    schemas = d["sys_schemas"].select(
        "system_name", "schema_id", F.col("name").alias("schema_name")
    )
    return lookup(tables, schemas, ["system_name", "schema_id"], "inner").drop("schema_id")


def sqlserver_volumes(d: Dumps) -> DataFrame:
    """Rows and bytes per table from its heap or clustered index.

    Rows are summed over partitions and pages over allocation units, apart, so a
    partition with several units counts its rows once.
    """
    index = d["sys_indexes"].filter(F.col("index_id") <= 1).select("system_name", "object_id", "index_id")
    parts = d["sys_partitions"].join(grown(index), ["system_name", "object_id", "index_id"])
    rows = parts.groupBy("system_name", "object_id").agg(F.sum("rows").cast("bigint").alias("row_count"))
    pages = (
        d["sys_allocation_units"]
        .withColumnRenamed("container_id", "partition_id")
        .join(grown(parts.select("system_name", "partition_id", "object_id")), ["system_name", "partition_id"])
        .groupBy("system_name", "object_id")
        .agg((F.sum("total_pages") * 8192).cast("bigint").alias("size_bytes"))
    )
    named = _named_objects(d)
    return (
        named.join(grown(rows), ["system_name", "object_id"], "left")
        .join(grown(pages), ["system_name", "object_id"], "left")
        .select("system_name", "schema_name", "table_name", "row_count", "size_bytes")
    )


def sqlserver_leading_statistics(d: Dumps) -> DataFrame:
    """Columns that lead a statistics object, with the rows it was built on."""
    lead = d["sys_stats_columns"].filter(F.col("stats_column_id") == 1)
    return (
        d["sys_stats"]
        .join(grown(d["sys_stats_properties"]), ["system_name", "object_id", "stats_id"])
        .join(grown(lead.select("system_name", "object_id", "stats_id", "column_id")),
              ["system_name", "object_id", "stats_id"])
        .join(grown(d["sys_columns"].select("system_name", "object_id", "column_id",
                                      F.col("name").alias("column_name"))),
              ["system_name", "object_id", "column_id"])
        .join(grown(_named_objects(d)), ["system_name", "object_id"])
        .groupBy("system_name", "schema_name", "table_name", "column_name")
        .agg(F.max("rows").cast("bigint").alias("stat_rows"))
    )


def sqlserver(d: Dumps, schema: str | None = "dbo", tables=None) -> Dumps:
    here, listed = _within("table_schema", schema), _listed("table_name", tables)
    base = (
        d["tables"]
        .filter(here & listed & (F.col("table_type") == "BASE TABLE"))
        .filter((F.col("table_name") != "sysdiagrams") & ~F.col("table_name").startswith("#"))
        .select("system_name", F.col("table_schema").alias("schema_name"), "table_name", "table_type")
        .join(grown(sqlserver_volumes(d)), ["system_name", "schema_name", "table_name"], "left")
    )
    cols = d["columns"].filter(here & listed).select(
        "system_name",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        F.col("ordinal_position").cast("int").alias("ordinal"),
        "column_name",
        F.upper("data_type").alias("data_type"),
        is_yes("is_nullable").alias("nullable"),
        F.lit(False).alias("is_generated"),
    )
    constraints = d["table_constraints"].filter(here)
    usage = d["key_column_usage"]
    if "position_in_unique_constraint" not in usage.columns:
        usage = usage.withColumn("position_in_unique_constraint", F.lit(None).cast("int"))
    links = (
        constraints.filter(F.col("constraint_type") == "FOREIGN KEY")
        .select("system_name", "constraint_name", "table_schema")
        .join(
            grown(d["referential_constraints"].select(
                "system_name",
                "constraint_name",
                F.col("constraint_schema").alias("table_schema"),
                F.col("unique_constraint_name").alias("target_name"),
                F.col("unique_constraint_schema").alias("target_schema"),
            )),
            ["system_name", "constraint_name", "table_schema"],
        )
    )
    return {
        "tables": base,
        "columns": cols,
        "primary": _keys(constraints, usage.filter(listed), "PRIMARY KEY"),
        "unique": _keys(constraints, usage.filter(listed), "UNIQUE"),
        "foreign": _paired(usage, links),
        "distinct": d.get("distinct", _empty(d["tables"], DISTINCT_SCHEMA)),
    }


DIALECTS: dict[str, Callable[..., Dumps]] = {
    "postgres": postgres,
    "postgresql": postgres,
    "bigquery": bigquery,
    "oracle": oracle,
    "snowflake": snowflake,
    "sqlserver": sqlserver,
}

# The dumps each part is made of, by dialect (fixed values).
_CONSTRAINTS = ["table_constraints", "key_column_usage"]
NEEDS: dict[str, dict[str, list[str]]] = {
    "postgres": {
        "tables": ["pg_class", "pg_namespace"], "columns": ["columns"], "primary": _CONSTRAINTS, "unique": _CONSTRAINTS,
        "foreign": [*_CONSTRAINTS, "referential_constraints"], "distinct": ["pg_stats"],
    },
    "bigquery": {
        "tables": ["tables"], "columns": ["fields"], "primary": _CONSTRAINTS, "unique": _CONSTRAINTS,
        "foreign": _CONSTRAINTS, "distinct": ["distinct"],
    },
    "oracle": {
        "tables": ["all_tables", "dba_segments"], "columns": ["all_tab_cols"], "primary": ["all_constraints", "all_cons_columns"],
        "unique": ["all_constraints", "all_cons_columns"], "foreign": ["all_constraints", "all_cons_columns"],
        "distinct": ["all_tab_col_statistics"],
    },
    "snowflake": {
        "tables": ["tables"], "columns": ["columns"], "primary": ["primary_keys"], "unique": ["unique_keys"],
        "foreign": ["imported_keys"], "distinct": ["distinct"],
    },
    "sqlserver": {
        "tables": ["tables"], "columns": ["columns"], "primary": _CONSTRAINTS, "unique": _CONSTRAINTS,
        "foreign": [*_CONSTRAINTS, "referential_constraints"], "distinct": ["distinct"],
    },
}
NEEDS["postgresql"] = NEEDS["postgres"]


def part_status(db_type: str, dumps: Dumps, parts: Dumps, unreadable: DataFrame | None = None) -> DataFrame:
    """(system_name, part, status, n_rows, message) of every system and part.

    ``status`` is ``read``, ``empty`` (readable, but without rows) or
    ``unreadable``: a dump that the part needs wasn't given, or ``unreadable``
    (system_name, dump, message) says that the system didn't let it be read.
    Parts that were partly read keep their rows; ``n_rows`` counts them.
    """
    needs = NEEDS[db_type]
    given = {name.lower(): _lowered(df) for name, df in dumps.items()}
    absent = {p: [f"no dump {n}" for n in names if n not in given] for p, names in needs.items()}
    listed = F.array(
        *[F.struct(F.lit(p).alias("part"), F.lit(m[0] if m else None).cast("string").alias("_absent")) for p, m in absent.items()]
    )
    systems = given[needs["tables"][0]].select("system_name").distinct()
    rows = systems.select("system_name", F.inline(listed))
    counted = reduce(
        lambda a, b: a.unionByName(b),
        [parts[p].groupBy("system_name", F.lit(p).alias("part")).agg(F.count("*").alias("n_rows")) for p in needs],
    )
    found = rows.join(counted, ["system_name", "part"], "left")
    message = F.col("_absent")
    if unreadable is not None:
        users = F.create_map(
            *[x for n in sorted({n for names in needs.values() for n in names})
              for x in (F.lit(n), F.array(*[F.lit(p) for p in needs if n in needs[p]]))]
        )
        told = _lowered(unreadable).select(
            "system_name", "dump", "message", F.explode(F.element_at(users, F.lower("dump"))).alias("part")
        )
        told = told.groupBy("system_name", "part").agg(
            F.min(F.concat_ws(": ", F.lower("dump"), "message")).alias("_told")
        )
        found = found.join(told, ["system_name", "part"], "left")
        message = F.coalesce("_told", "_absent")
    n = F.coalesce("n_rows", F.lit(0))
    status = F.when(message.isNotNull(), "unreadable").when(n == 0, "empty").otherwise("read")
    return found.select("system_name", "part", status.alias("status"), n.alias("n_rows"), message.alias("message"))


# Schema taken when the request names none (fixed values).
DEFAULT_SCHEMAS = {"postgres": "public", "sqlserver": "dbo"}


def request_arguments(request: dict) -> dict:
    """Source arguments from a request; absent and null fields mean the default."""
    db_type = (request.get("db_type") or "").lower()
    db_type = "postgres" if db_type == "postgresql" else db_type
    if db_type not in DIALECTS:
        raise ValueError(f"unsupported db_type: {request.get('db_type')!r}")
    schema = request.get("schema_name") or request.get("schema")
    if not schema and db_type == "oracle":
        schema = request.get("username") or request.get("user")
    return {
        "db_type": db_type,
        "database": request.get("database_name") or request.get("database") or request.get("project_id"),
        "schema": schema or DEFAULT_SCHEMAS.get(db_type),
        "tables": request.get("tables") or None,
    }


def dialect_parts(db_type: str, dumps: Dumps, schema=None, tables=None, **options) -> Dumps:
    """Parts of one dialect; an unknown ``db_type`` is an error."""
    reader = DIALECTS.get(db_type)
    if reader is None:
        raise ValueError(f"unsupported db_type: {db_type!r}")
    lowered = {name.lower(): _lowered(df) for name, df in dumps.items()}
    return reader(lowered, schema=schema, tables=tables, **options)


def merge_parts(parts: list[Dumps]) -> Dumps:
    """Parts of several sources as one."""
    names = parts[0].keys()
    return {n: reduce(lambda a, b: a.unionByName(b), [p[n] for p in parts]) for n in names}
