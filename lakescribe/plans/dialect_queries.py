"""Dictionary dumps of five dialects derived from the fleet, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.operators import assemble
from lakescribe.plans import fleet
from lakescribe.plans.fleet_queries import sql
from lakescribe.plans.registry import query
from lakescribe.sources import dialects

# A statistic per column: all rows, half of them, a count, or none.
STATISTIC = (
    "CASE WHEN ordinal = 1 THEN -1.0D WHEN ordinal = 2 THEN -0.5D "
    "WHEN ordinal % 7 <> 0 THEN CAST(ordinal AS DOUBLE) END"
)


def _yes(c: Column, yes="YES", no="NO") -> Column:
    return F.when(c, yes).otherwise(no)


def _source(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = fleet.tables(spark, sf_dir)
    c = fleet.columns(spark, sf_dir).withColumns(
        {
            "ref_schema": F.col("references.schema"),
            "ref_table": F.col("references.table"),
            "ref_column": F.col("references.column"),
        }
    )
    return t, c


def _constraints(c: DataFrame) -> DataFrame:
    """(constraint_name, table_schema, table_name, constraint_type, column_name, positions, target).

    Constraint names repeat over tables of other schemas, as they may. Keys that
    refer name the unique constraint of the parent.
    """
    base = [F.col("schema_name").alias("table_schema"), "table_name", "column_name"]
    none = F.lit(None).cast("string")
    no_position = F.lit(None).cast("int")

    def rows(test, name, kind, target=none, schema=none, position=no_position):
        return c.filter(test).select(
            F.lit("fleet").alias("system_name"),
            F.concat(F.lit(name), "table_name").alias("constraint_name"),
            *base,
            F.lit(kind).alias("constraint_type"),
            F.lit(1).alias("ordinal_position"),
            position.alias("position_in_unique_constraint"),
            target.alias("unique_constraint_name"),
            schema.alias("unique_constraint_schema"),
        )

    return (
        rows("primary_key", "pk_", "PRIMARY KEY")
        .unionByName(rows("unique", "uq_", "UNIQUE"))
        .unionByName(
            rows(
                "ref_table IS NOT NULL",
                "fk_",
                "FOREIGN KEY",
                F.concat(F.lit("uq_"), "ref_table"),
                F.col("ref_schema"),
                F.lit(1),
            )
        )
    )


def _information_schema(c: DataFrame) -> dict[str, DataFrame]:
    k = _constraints(c)
    return {
        "table_constraints": k.select(
            "system_name", "constraint_name", "table_schema", "table_name", "constraint_type",
            "unique_constraint_name", "unique_constraint_schema",
        ),
        "key_column_usage": k.select(
            "system_name", "constraint_name", "table_schema", "table_name", "column_name",
            "ordinal_position", "position_in_unique_constraint",
        ),
        "referential_constraints": k.filter("constraint_type = 'FOREIGN KEY'").select(
            "system_name", "constraint_name", F.col("table_schema").alias("constraint_schema"),
            "unique_constraint_name", "unique_constraint_schema",
        ),
    }


def postgres_dumps(spark, sf_dir):
    t, c = _source(spark, sf_dir)
    spaces = spark.range(4).select(F.col("id").alias("oid"), F.concat(F.lit("s"), "id").alias("nspname"))
    return {
        "pg_class": t.select(
            "system_name",
            F.col("k").alias("oid"),
            F.col("table_name").alias("relname"),
            F.when(F.col("table_type") == "VIEW", "v").otherwise("r").alias("relkind"),
            (F.col("k") % 4).alias("relnamespace"),
            F.when(F.col("k") % 13 == 0, "t").otherwise("p").alias("relpersistence"),
            F.coalesce("row_count", F.lit(-1)).cast("double").alias("reltuples"),
            F.col("size_bytes").alias("total_bytes"),
        ),
        "pg_namespace": spaces.withColumn("system_name", F.lit("fleet")),
        "columns": c.select(
            "system_name",
            F.col("schema_name").alias("table_schema"),
            "table_name",
            "column_name",
            F.lower("data_type").alias("udt_name"),
            _yes(F.col("nullable")).alias("is_nullable"),
            F.when(F.col("ordinal") % 5 == 0, "ALWAYS").otherwise("NEVER").alias("is_generated"),
            F.col("ordinal").alias("ordinal_position"),
        ),
        "pg_stats": c.select(
            "system_name",
            F.col("schema_name").alias("schemaname"),
            F.col("table_name").alias("tablename"),
            F.col("column_name").alias("attname"),
            F.expr(STATISTIC).alias("n_distinct"),
        ),
        **_information_schema(c),
    }


def bigquery_dumps(spark, sf_dir):
    t, c = _source(spark, sf_dir)
    return {
        "tables": t.select(
            "system_name",
            F.col("schema_name").alias("dataset_id"),
            F.col("table_name").alias("table_id"),
            F.when(F.col("table_type") == "VIEW", "VIEW").otherwise("TABLE").alias("table_type"),
            F.col("row_count").alias("num_rows"),
            F.col("size_bytes").alias("num_bytes"),
        ),
        "fields": c.select(
            "system_name",
            F.col("schema_name").alias("dataset_id"),
            F.col("table_name").alias("table_id"),
            F.col("column_name").alias("name"),
            F.col("data_type").alias("field_type"),
            F.when(F.col("nullable"), "NULLABLE").otherwise("REQUIRED").alias("mode"),
            F.col("ordinal").alias("position"),
        ),
        **_information_schema(c),
    }


def oracle_dumps(spark, sf_dir):
    t, c = _source(spark, sf_dir)
    up = lambda n: F.upper(n)
    k = _constraints(c)
    kind = (
        F.when(F.col("constraint_type") == "PRIMARY KEY", "P")
        .when(F.col("constraint_type") == "UNIQUE", "U")
        .otherwise("R")
    )
    return {
        "ALL_TABLES": t.select(
            "system_name",
            up("schema_name").alias("OWNER"),
            up("table_name").alias("TABLE_NAME"),
            F.col("row_count").alias("NUM_ROWS"),
            F.when(F.col("k") % 13 == 0, "Y").otherwise("N").alias("TEMPORARY"),
        ),
        "DBA_SEGMENTS": t.filter("size_bytes IS NOT NULL")
        .withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .select(
            "system_name",
            up("schema_name").alias("OWNER"),
            up("table_name").alias("SEGMENT_NAME"),
            (F.col("size_bytes") * F.col("part")).alias("BYTES"),
        ),
        "ALL_TAB_COLS": c.select(
            "system_name",
            up("schema_name").alias("OWNER"),
            up("table_name").alias("TABLE_NAME"),
            up("column_name").alias("COLUMN_NAME"),
            F.col("data_type").alias("DATA_TYPE"),
            _yes(F.col("nullable"), "Y", "N").alias("NULLABLE"),
            _yes(F.col("ordinal") % 5 == 0).alias("VIRTUAL_COLUMN"),
            _yes(F.col("ordinal") % 17 == 0).alias("HIDDEN_COLUMN"),
            F.col("ordinal").alias("COLUMN_ID"),
        ),
        "ALL_CONSTRAINTS": k.select(
            "system_name",
            up("table_schema").alias("OWNER"),
            up("constraint_name").alias("CONSTRAINT_NAME"),
            kind.alias("CONSTRAINT_TYPE"),
            up("table_name").alias("TABLE_NAME"),
            up("unique_constraint_schema").alias("R_OWNER"),
            up("unique_constraint_name").alias("R_CONSTRAINT_NAME"),
        ),
        "ALL_CONS_COLUMNS": k.select(
            "system_name",
            up("table_schema").alias("OWNER"),
            up("constraint_name").alias("CONSTRAINT_NAME"),
            up("table_name").alias("TABLE_NAME"),
            up("column_name").alias("COLUMN_NAME"),
            F.col("ordinal_position").alias("POSITION"),
        ),
        "ALL_TAB_COL_STATISTICS": c.select(
            "system_name",
            up("schema_name").alias("OWNER"),
            up("table_name").alias("TABLE_NAME"),
            up("column_name").alias("COLUMN_NAME"),
            (F.col("ordinal") * 10).alias("NUM_DISTINCT"),
        ),
    }


def snowflake_dumps(spark, sf_dir):
    t, c = _source(spark, sf_dir)
    schema = F.upper("schema_name")

    def keys(test):
        return c.filter(test).select(
            "system_name", schema.alias("schema_name"), F.upper("table_name").alias("table_name"),
            F.upper("column_name").alias("column_name"),
        )

    return {
        "TABLES": t.select(
            "system_name",
            schema.alias("TABLE_SCHEMA"),
            F.upper("table_name").alias("TABLE_NAME"),
            F.col("table_type").alias("TABLE_TYPE"),
            F.col("row_count").alias("ROW_COUNT"),
            F.col("size_bytes").alias("BYTES"),
        ),
        "COLUMNS": c.select(
            "system_name",
            schema.alias("TABLE_SCHEMA"),
            F.upper("table_name").alias("TABLE_NAME"),
            F.upper("column_name").alias("COLUMN_NAME"),
            F.col("data_type").alias("DATA_TYPE"),
            _yes(F.col("nullable")).alias("IS_NULLABLE"),
            F.col("ordinal").alias("ORDINAL_POSITION"),
        ),
        "PRIMARY_KEYS": keys("primary_key"),
        "UNIQUE_KEYS": keys("unique"),
        "IMPORTED_KEYS": c.filter("ref_table IS NOT NULL").select(
            "system_name",
            schema.alias("fk_schema_name"),
            F.upper("table_name").alias("fk_table_name"),
            F.upper("column_name").alias("fk_column_name"),
            F.when(F.col("ref_schema") != F.col("schema_name"), F.upper("ref_schema")).alias("pk_schema_name"),
            F.upper("ref_table").alias("pk_table_name"),
            F.upper("ref_column").alias("pk_column_name"),
        ),
    }


def sqlserver_dumps(spark, sf_dir):
    t, c = _source(spark, sf_dir)
    k = F.col("k")
    rows = F.coalesce("row_count", F.lit(0))
    parted = t.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(2))))
    part_id = (k * 10 + F.col("part")).alias("partition_id")
    return {
        "tables": t.select(
            "system_name",
            F.col("schema_name").alias("table_schema"),
            F.when(k % 19 == 0, F.concat(F.lit("#"), "table_name")).otherwise(F.col("table_name")).alias("table_name"),
            "table_type",
        ),
        "columns": c.select(
            "system_name",
            F.col("schema_name").alias("table_schema"),
            "table_name",
            "column_name",
            F.lower("data_type").alias("data_type"),
            _yes(F.col("nullable")).alias("is_nullable"),
            F.col("ordinal").alias("ordinal_position"),
        ),
        **_information_schema(c),
        "sys_tables": t.select(
            "system_name", k.alias("object_id"), (k % 4).alias("schema_id"), F.col("table_name").alias("name")
        ),
        "sys_schemas": spark.range(4).select(
            F.lit("fleet").alias("system_name"), F.col("id").alias("schema_id"),
            F.concat(F.lit("s"), "id").alias("name"),
        ),
        "sys_indexes": t.select(
            "system_name", k.alias("object_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("index_id")
        ),
        "sys_partitions": parted.select(
            "system_name", part_id, k.alias("object_id"), F.lit(1).alias("index_id"), (rows * F.col("part")).alias("rows")
        ).unionByName(
            t.select("system_name", (k * 10 + 9).alias("partition_id"), k.alias("object_id"),
                     F.lit(2).alias("index_id"), rows.alias("rows"))
        ),
        # two allocation units per partition
        "sys_allocation_units": parted.withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(2)))).select(
            "system_name", part_id.alias("container_id"), (F.col("p_size") * F.col("unit")).alias("total_pages")
        ),
        "sys_columns": c.select(
            "system_name", k.alias("object_id"), F.col("ordinal").alias("column_id"), F.col("column_name").alias("name")
        ),
        "sys_stats": c.select("system_name", k.alias("object_id"), F.col("ordinal").alias("stats_id")),
        "sys_stats_properties": c.select(
            "system_name", k.alias("object_id"), F.col("ordinal").alias("stats_id"),
            (F.col("p_size") * 100).alias("rows"),
        ),
        # a second column follows the leading one in some
        "sys_stats_columns": c.select(
            "system_name", k.alias("object_id"), F.col("ordinal").alias("stats_id"),
            F.col("ordinal").alias("column_id"), F.lit(1).alias("stats_column_id"),
        ).unionByName(
            c.filter("ordinal <= 2 AND p_size >= 3").select(
                "system_name", k.alias("object_id"), F.col("ordinal").alias("stats_id"),
                F.lit(3).alias("column_id"), F.lit(2).alias("stats_column_id"),
            )
        ),
    }


DUMPS = {
    "postgres": postgres_dumps,
    "bigquery": bigquery_dumps,
    "oracle": oracle_dumps,
    "snowflake": snowflake_dumps,
    "sqlserver": sqlserver_dumps,
}


def part(name: str, db_type: str, key: str, cols: list[str], text: str, schema: str | None = None) -> None:
    """Register one part of one dialect."""

    @query(name, sql(text))
    def run(spark, sf_dir):
        parts = dialects.dialect_parts(db_type, DUMPS[db_type](spark, sf_dir), schema=schema)
        return parts[key].select(*cols)


TABLE_COLS = ["schema_name", "table_name", "table_type", "row_count", "size_bytes"]
COLUMN_COLS = ["table_name", "ordinal", "column_name", "data_type", "nullable", "is_generated"]
KEY_COLS = ["schema_name", "table_name", "column_name"]
FK_COLS = KEY_COLS + ["ref_schema", "ref_table", "ref_column"]
PK_SQL = "SELECT schema_name, table_name, column_name FROM c WHERE pk"
UQ_SQL = "SELECT schema_name, table_name, column_name FROM c WHERE is_unique"
FK_SQL = "SELECT schema_name, table_name, column_name, ref_schema, ref_table, ref_column FROM c WHERE ref_table IS NOT NULL"


def _upper(text: str, cols: list[str]) -> str:
    return "SELECT " + ", ".join(f"upper({c}) AS {c}" for c in cols) + f" FROM ({text})"


part("a3_postgres_tables", "postgres", "tables", TABLE_COLS,
     "SELECT schema_name, table_name, 'BASE TABLE' AS table_type, greatest(coalesce(row_count, -1), 0) AS row_count, size_bytes "
     "FROM t WHERE table_type <> 'VIEW' AND k % 13 <> 0")
part("a4_postgres_columns", "postgres", "columns", COLUMN_COLS,
     "SELECT table_name, ordinal, column_name, data_type, nullable, ordinal % 5 = 0 AS is_generated FROM c WHERE schema_name = 's1'",
     schema="s1")
part("a5_postgres_primary", "postgres", "primary", KEY_COLS, PK_SQL)
part("a6_postgres_unique", "postgres", "unique", KEY_COLS, UQ_SQL)
part("a7_postgres_foreign", "postgres", "foreign", FK_COLS, FK_SQL)
part("a8_postgres_statistics", "postgres", "distinct", ["table_name", "column_name", "n_distinct"],
     "SELECT table_name, column_name, CAST(CASE WHEN ordinal = 1 THEN -1 WHEN ordinal = 2 THEN -0.5 WHEN ordinal % 7 <> 0 THEN ordinal END AS DOUBLE) AS n_distinct FROM c")
part("a9_bigquery_tables", "bigquery", "tables", TABLE_COLS,
     "SELECT schema_name, table_name, 'BASE TABLE' AS table_type, row_count, size_bytes FROM t WHERE table_type <> 'VIEW'")
part("a10_bigquery_columns", "bigquery", "columns", COLUMN_COLS,
     "SELECT table_name, ordinal, column_name, data_type, nullable, false AS is_generated FROM c")
part("a11_bigquery_primary", "bigquery", "primary", KEY_COLS, PK_SQL)
part("a11_bigquery_unique", "bigquery", "unique", KEY_COLS, UQ_SQL)
part("a12_bigquery_foreign", "bigquery", "foreign", FK_COLS, FK_SQL)
part("a13_oracle_tables", "oracle", "tables", TABLE_COLS,
     "SELECT upper(schema_name) AS schema_name, upper(table_name) AS table_name, 'BASE TABLE' AS table_type, row_count, "
     "size_bytes * 6 AS size_bytes FROM t WHERE k % 13 <> 0 AND schema_name = 's2'", schema="s2")
part("a14_oracle_columns", "oracle", "columns", COLUMN_COLS,
     "SELECT upper(table_name) AS table_name, ordinal, upper(column_name) AS column_name, data_type, nullable, "
     "ordinal % 5 = 0 AS is_generated FROM c WHERE ordinal % 17 <> 0")
part("a15_oracle_primary", "oracle", "primary", KEY_COLS, _upper(PK_SQL, KEY_COLS))
part("a15_oracle_unique", "oracle", "unique", KEY_COLS, _upper(UQ_SQL, KEY_COLS))
part("a16_oracle_foreign", "oracle", "foreign", FK_COLS, _upper(FK_SQL, FK_COLS))
part("a17_oracle_statistics", "oracle", "distinct", ["table_name", "column_name", "n_distinct"],
     "SELECT upper(table_name) AS table_name, upper(column_name) AS column_name, CAST(ordinal * 10 AS DOUBLE) AS n_distinct FROM c")
part("a18_snowflake_tables", "snowflake", "tables", TABLE_COLS,
     "SELECT upper(schema_name) AS schema_name, upper(table_name) AS table_name, table_type, row_count, size_bytes FROM t "
     "WHERE table_type = 'BASE TABLE' AND schema_name = 's3'", schema="s3")
part("a18_snowflake_columns", "snowflake", "columns", COLUMN_COLS,
     "SELECT upper(table_name) AS table_name, ordinal, upper(column_name) AS column_name, data_type, nullable, false AS is_generated FROM c")
part("a19_snowflake_primary", "snowflake", "primary", KEY_COLS, _upper(PK_SQL, KEY_COLS))
part("a19_snowflake_unique", "snowflake", "unique", KEY_COLS, _upper(UQ_SQL, KEY_COLS))
part("a19_snowflake_foreign", "snowflake", "foreign", FK_COLS, _upper(FK_SQL, FK_COLS))
part("a20_sqlserver_tables", "sqlserver", "tables", ["schema_name", "table_name", "table_type"],
     "SELECT schema_name, table_name, table_type FROM t WHERE table_type = 'BASE TABLE' AND k % 19 <> 0")
part("a21_sqlserver_columns", "sqlserver", "columns", COLUMN_COLS,
     "SELECT table_name, ordinal, column_name, data_type, nullable, false AS is_generated FROM c")
part("a22_sqlserver_primary", "sqlserver", "primary", KEY_COLS, PK_SQL)
part("a22_sqlserver_unique", "sqlserver", "unique", KEY_COLS, UQ_SQL)
part("a23_sqlserver_foreign", "sqlserver", "foreign", FK_COLS, FK_SQL)


@query(
    "a24_sqlserver_volumes",
    sql("SELECT schema_name, table_name, coalesce(row_count, 0) * 3 AS row_count, CAST(p_size * 6 * 8192 AS BIGINT) AS size_bytes FROM t"),
)
def sqlserver_volumes(spark, sf_dir):
    lowered = {n: df.toDF(*[c.lower() for c in df.columns]) for n, df in sqlserver_dumps(spark, sf_dir).items()}
    return dialects.sqlserver_volumes(lowered).select("schema_name", "table_name", "row_count", "size_bytes")


@query(
    "a25_sqlserver_statistics",
    sql("SELECT schema_name, table_name, column_name, CAST(p_size * 100 AS BIGINT) AS stat_rows FROM c"),
)
def sqlserver_statistics(spark, sf_dir):
    return dialects.sqlserver_leading_statistics(sqlserver_dumps(spark, sf_dir)).select(
        "schema_name", "table_name", "column_name", "stat_rows"
    )


@query(
    "a1_all_dialects",
    sql(
        """SELECT d AS system_name, count(*) AS n_tables, CAST(sum(CASE d WHEN 'postgres' THEN coalesce(row_count, 0)
    WHEN 'sqlserver' THEN 3 * coalesce(row_count, 0) ELSE row_count END) AS BIGINT) AS total_rows
FROM t CROSS JOIN (VALUES ('postgres'), ('bigquery'), ('oracle'), ('snowflake'), ('sqlserver')) v(d)
WHERE CASE d WHEN 'oracle' THEN k % 13 <> 0 WHEN 'postgres' THEN k % 13 <> 0 AND table_type = 'BASE TABLE'
  WHEN 'sqlserver' THEN k % 19 <> 0 AND table_type = 'BASE TABLE' ELSE table_type = 'BASE TABLE' END GROUP BY d"""
    ),
)
def all_dialects(spark, sf_dir):
    """Every dialect by its name, merged into one fleet of five systems."""
    found = []
    for db_type, dumps in DUMPS.items():
        parts = dialects.dialect_parts(db_type, dumps(spark, sf_dir), schema=None)
        found.append({"tables": parts["tables"].withColumn("system_name", F.lit(db_type))})
    merged = dialects.merge_parts(found)["tables"]
    return merged.groupBy("system_name").agg(
        F.count("*").alias("n_tables"), F.sum("row_count").alias("total_rows")
    )


REQUESTS = [
    {"db_type": "PostgreSQL", "schema_name": "s1", "schema": "s0"},
    {"db_type": "BIGQUERY"},
    {"db_type": "oracle", "username": "s2"},
    {"db_type": "sqlserver", "schema": "s3"},
]


@query(
    "a2_requests",
    sql(
        """SELECT d AS system_name, CASE d WHEN 'oracle' THEN upper(schema_name) ELSE schema_name END AS schema_name, count(*) AS n_tables
FROM t CROSS JOIN (VALUES ('postgres', 's1'), ('bigquery', NULL), ('oracle', 's2'), ('sqlserver', 's3')) v(d, s)
WHERE (s IS NULL OR schema_name = s) AND CASE d WHEN 'oracle' THEN k % 13 <> 0
  WHEN 'postgres' THEN k % 13 <> 0 AND table_type = 'BASE TABLE'
  WHEN 'sqlserver' THEN k % 19 <> 0 AND table_type = 'BASE TABLE' ELSE table_type = 'BASE TABLE' END GROUP BY ALL"""
    ),
)
def requests(spark, sf_dir):
    """Requests with names and schemas given in every way, each to its dialect."""
    found = []
    for request in REQUESTS:
        asked = dialects.request_arguments(request)
        dumps = DUMPS[asked["db_type"]](spark, sf_dir)
        tables = dialects.dialect_parts(asked["db_type"], dumps, asked["schema"], asked["tables"])["tables"]
        found.append({"tables": tables.withColumn("system_name", F.lit(asked["db_type"]))})
    merged = dialects.merge_parts(found)["tables"]
    return merged.groupBy("system_name", "schema_name").agg(F.count("*").alias("n_tables"))


@query(
    "j4_assembled_columns",
    sql(
        """SELECT c.table_name, c.ordinal, pk AS primary_key, is_unique, ref_table IS NOT NULL AS foreign_key, ref_column,
  CAST(CASE WHEN ordinal = 1 THEN coalesce(row_count, 0) WHEN ordinal = 2 THEN CAST(floor(0.5 * coalesce(row_count, 0)) AS BIGINT)
       WHEN ordinal % 7 <> 0 THEN ordinal END AS BIGINT) AS distinct_count
FROM c JOIN t USING (table_name) WHERE t.k % 13 <> 0 AND table_type <> 'VIEW'"""
    ),
)
def assembled_columns(spark, sf_dir):
    """A PostgreSQL catalogue put together from its dumps."""
    _, cols, _ = assemble.assemble(dialects.dialect_parts("postgres", postgres_dumps(spark, sf_dir)))
    return cols.select(
        "table_name", "ordinal", "primary_key", F.col("unique").alias("is_unique"), "foreign_key",
        F.col("references.column").alias("ref_column"), "distinct_count",
    )


# Three systems with the same tables: one shows its keys, one has none, one doesn't let them be read.
SYSTEMS_SQL = "(VALUES ('open'), ('bare'), ('closed')) s(system_name)"


def _three_systems(dumps: dict[str, DataFrame], keys: list[str]) -> dict[str, DataFrame]:
    names = F.explode(F.array(*[F.lit(n) for n in ("open", "bare", "closed")]))
    return {
        n: df.withColumn("system_name", F.lit("open") if n.lower() in keys else names) for n, df in dumps.items()
    }


def _closed_views(spark, views: list[str]) -> DataFrame:
    return spark.createDataFrame([("closed", v, "access denied") for v in views], "system_name string, dump string, message string")


_KEY_COUNTS = "".join(
    f" UNION ALL SELECT '{part}', (SELECT count(*) FROM c WHERE {test})"
    for part, test in (("primary", "pk"), ("unique", "is_unique"), ("foreign", "ref_table IS NOT NULL"))
)


@query(
    "a11_missing_views",
    sql(
        "SELECT system_name, part, CASE WHEN part = 'distinct' OR system_name = 'closed' AND keyed THEN 'unreadable' "
        "WHEN keyed AND system_name = 'bare' THEN 'empty' ELSE 'read' END AS status, "
        "CASE WHEN part = 'distinct' THEN 'no dump distinct' WHEN system_name = 'closed' AND keyed THEN 'table_constraints: access denied' END AS message, "
        "CASE WHEN keyed AND system_name <> 'open' THEN 0 ELSE n END AS n_rows FROM (SELECT *, part IN ('primary', 'unique', 'foreign') AS keyed "
        f"FROM {SYSTEMS_SQL} CROSS JOIN (SELECT 'tables' AS part, (SELECT count(*) FROM t WHERE table_type <> 'VIEW') AS n UNION ALL "
        f"SELECT 'columns', (SELECT count(*) FROM c) UNION ALL SELECT 'distinct', 0{_KEY_COUNTS}))"
    ),
)
def missing_views(spark, sf_dir):
    """What could be read of three BigQuery systems, part by part."""
    views = ["table_constraints", "key_column_usage"]
    dumps = _three_systems(bigquery_dumps(spark, sf_dir), [*views, "constraint_column_usage"])
    parts = dialects.dialect_parts("bigquery", dumps)
    return dialects.part_status("bigquery", dumps, parts, _closed_views(spark, views[:1]))


@query(
    "a19_unknown_keys",
    sql(
        "SELECT system_name, table_name, count(*) FILTER (system_name = 'open' AND pk) AS n_primary, "
        "count(*) FILTER (system_name = 'closed') AS n_unknown, count(*) FILTER (system_name = 'open' AND is_unique) AS n_unique "
        f"FROM (SELECT upper(c.table_name) AS table_name, pk, is_unique FROM c JOIN t USING (table_name) WHERE table_type = 'BASE TABLE') CROSS JOIN {SYSTEMS_SQL} GROUP BY ALL"
    ),
)
def unknown_keys(spark, sf_dir):
    """Keys of three Snowflake systems; those that couldn't be read are unknown, not absent."""
    views = ["primary_keys", "unique_keys", "imported_keys"]
    dumps = _three_systems(snowflake_dumps(spark, sf_dir), views)
    parts = dialects.dialect_parts("snowflake", dumps)
    status = dialects.part_status("snowflake", dumps, parts, _closed_views(spark, views[:1]))
    _, cols, _ = assemble.assemble(parts)
    known = assemble.with_known_flags(cols, status)
    return known.groupBy("system_name", "table_name").agg(
        F.count_if("primary_key").alias("n_primary"),
        F.count_if(F.col("primary_key").isNull()).alias("n_unknown"),
        F.count_if("unique").alias("n_unique"),
    )
