"""Queries over the derived fleet catalogue: search, joins, relations, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lakescribe import model
from lakescribe.functions import scalars
from lakescribe.operators import assemble, graph, normalize, ordering, relate, search, stats
from lakescribe.plans import fleet
from lakescribe.plans.registry import query
from lakescribe.session import materialized, shared_dir

KEY = ["system_name", "schema_name", "table_name"]


def flat(spark, sf_dir, annotated=False):
    return fleet.flat_tables(spark, sf_dir), fleet.flat_columns(spark, sf_dir, annotated)


def norm(spark, sf_dir, annotated=True):
    t, c = flat(spark, sf_dir, annotated)
    return t, normalize.normal_form(c)


def sql(body: str) -> str:
    return fleet.SQL + body


# -- filters and search ---------------------------------------------------------


@query("f2_table_name", sql("SELECT schema_name, table_name FROM t WHERE contains(lower(table_name), 'm_ent1')"))
def table_name(spark, sf_dir):
    """``_`` is a plain character here."""
    return search.by_table_name(fleet.flat_tables(spark, sf_dir), "M_ENT1").select("schema_name", "table_name")


@query(
    "f3_field_name",
    sql(
        "SELECT schema_name, table_name, row_count FROM t WHERE table_name IN "
        "(SELECT table_name FROM c WHERE contains(column_name, '_key'))"
    ),
)
def field_name(spark, sf_dir):
    return search.by_field_name(*flat(spark, sf_dir), "_KEY").select("schema_name", "table_name", "row_count")


@query(
    "f4_free_text",
    sql(
        "SELECT table_name FROM t WHERE contains(lower(table_name), 'red') OR "
        "contains(lower(coalesce(description, '')), 'red') OR table_name IN "
        "(SELECT table_name FROM c WHERE contains(lower(column_name), 'red'))"
    ),
)
def free_text(spark, sf_dir):
    return search.by_text(*flat(spark, sf_dir), "red").select("table_name")


@query("f5_table_type", sql("SELECT schema_name, table_name FROM t WHERE table_type = 'VIEW'"))
def table_type(spark, sf_dir):
    return search.by_type(fleet.flat_tables(spark, sf_dir), "VIEW").select("schema_name", "table_name")


@query(
    "f6_allow_list",
    sql("SELECT table_name, ordinal, column_name FROM c WHERE table_name IN ('fact_ent1', 'dim_ent6', 'ent11')"),
)
def allow_list(spark, sf_dir):
    return search.allowed(fleet.flat_columns(spark, sf_dir), ["fact_ent1", "dim_ent6", "ent11", "none"]).select(
        "table_name", "ordinal", "column_name"
    )


@query(
    "f7_key_lists",
    sql(
        "SELECT table_name, coalesce(string_agg(CASE WHEN pk THEN column_name END, ',' ORDER BY ordinal), '') AS pks, "
        "coalesce(string_agg(CASE WHEN fk THEN column_name END, ',' ORDER BY ordinal), '') AS fks, "
        "string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal) AS cols FROM c GROUP BY ALL"
    ),
)
def key_lists(spark, sf_dir):
    from lakescribe.operators.keys import key_context

    joined = key_context(fleet.flat_columns(spark, sf_dir))
    return joined.select(
        "table_name",
        F.array_join("primary_keys", ",").alias("pks"),
        F.array_join("foreign_keys", ",").alias("fks"),
        F.array_join(
            F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ","
        ).alias("cols"),
    )


@query(
    "f8_clear_inferred",
    sql("SELECT table_name, ordinal, pk AS primary_key, CAST(NULL AS BOOLEAN) AS inferred_pk, CAST(NULL AS BOOLEAN) AS inferred_fk FROM c"),
)
def clear_inferred(spark, sf_dir):
    from lakescribe.operators.keys import cleared

    return cleared(fleet.flat_columns(spark, sf_dir, True)).select(
        "table_name", "ordinal", "primary_key", "inferred_pk", "inferred_fk"
    )


@query(
    "f9_field_defaults",
    sql(
        "SELECT table_name, ordinal, false AS is_unique, false AS is_generated, CAST(NULL AS BIGINT) AS distinct_count, "
        "CAST(NULL AS VARCHAR) AS description FROM c"
    ),
)
def field_defaults(spark, sf_dir):
    bare = fleet.columns(spark, sf_dir).select(*KEY, "ordinal", "column_name", "data_type")
    return model.conform(bare, model.COLUMNS).select(
        "table_name", "ordinal", F.col("unique").alias("is_unique"), "is_generated", "distinct_count", "description"
    )


@query("f11_one_table", sql("SELECT schema_name, table_name, table_type, row_count FROM t WHERE table_name = 'stg_ent8'"))
def one_table(spark, sf_dir):
    return search.one_table(fleet.flat_tables(spark, sf_dir), "stg_ent8").select(
        "schema_name", "table_name", "table_type", "row_count"
    )


@query(
    "l1_catalogue_order",
    sql(
        "SELECT table_name, ordinal, row_number() OVER (ORDER BY schema_name, table_name, ordinal) AS position FROM c"
    ),
)
def catalogue_order(spark, sf_dir):
    """Position of every column in catalogue order, numbered range by range."""
    cols = fleet.flat_columns(spark, sf_dir).select(*KEY, "ordinal")
    return ordering.row_numbers(cols, ["system_name"], ["schema_name", "table_name", "ordinal"]).select(
        "table_name", "ordinal", "position"
    )


@query(
    "l2_page",
    sql(
        "SELECT schema_name, table_name FROM t WHERE contains(table_name, 'ent1') "
        "ORDER BY schema_name, table_name LIMIT 20 OFFSET 20"
    ),
)
def page(spark, sf_dir):
    found = search.search(*flat(spark, sf_dir), table_name="ent1")
    return search.page(found, 2, 20).select("schema_name", "table_name")


@query(
    "l2_page_totals",
    sql(
        "SELECT count(*) AS total_matches, CAST(ceil(count(*) / 20) AS INTEGER) AS total_pages "
        "FROM t WHERE contains(table_name, 'ent1')"
    ),
)
def page_totals(spark, sf_dir):
    return search.page_totals(search.search(*flat(spark, sf_dir), table_name="ent1"), 20)


@query(
    "l2_all_pages",
    sql(
        "SELECT table_name, CAST(ceil(row_number() OVER (ORDER BY schema_name, table_name) / 20) AS INTEGER) AS page FROM t"
    ),
)
def all_pages(spark, sf_dir):
    tables = fleet.flat_tables(spark, sf_dir)
    return search.numbered_pages(tables, ["system_name"], ["schema_name", "table_name"], 20).select(
        "table_name", "page"
    )


# First, middle and deep pages of the columns, and one behind the last (fixed values).
_INDEXED = (1, 137, 1501, 10_000_000)


@query(
    "l2_indexed_pages",
    sql(
        "SELECT page, schema_name, table_name, ordinal, column_name FROM (SELECT *, CAST(ceil(row_number() OVER (ORDER BY schema_name, table_name, ordinal) / 10) AS INTEGER) AS page FROM c) "
        f"WHERE page IN {_INDEXED}"
    ),
)
def indexed_pages(spark, sf_dir):
    """Pages of all columns from a stored index, each from the ranges that it touches."""
    order = ["schema_name", "table_name", "ordinal"]
    path = shared_dir(spark, "pages")
    search.write_page_index(fleet.flat_columns(spark, sf_dir), path, order, rows_per_range=5000)
    pages = [
        search.indexed_page(spark, path, n, 10, order).select(F.lit(n).alias("page"), *order, "column_name") for n in _INDEXED
    ]
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("l3_preview", sql("SELECT table_name FROM t ORDER BY schema_name, table_name LIMIT 30"))
def preview(spark, sf_dir):
    rows = assemble.summary(*flat(spark, sf_dir))
    return rows.select(F.explode("table_names_preview").alias("table_name"))


@query("l4_column_cap", sql("SELECT table_name, column_name FROM c WHERE ordinal <= 10"))
def column_cap(spark, sf_dir):
    return search.first_columns(fleet.flat_columns(spark, sf_dir), 10).select("table_name", "column_name")


@query(
    "u1_union_of_schemas",
    sql("SELECT schema_name, table_name FROM t"),
)
def union_of_schemas(spark, sf_dir):
    tables = fleet.flat_tables(spark, sf_dir)
    found = None
    for name in ("s0", "s1", "s2", "s3"):
        one = tables.filter(F.col("schema_name") == name)
        found = one if found is None else found.unionByName(one)
    return found.select("schema_name", "table_name")


# -- joins of the assembly ------------------------------------------------------


def parts(spark, sf_dir):
    """The fleet taken apart as a source would give it."""
    cols = fleet.columns(spark, sf_dir)
    key = [*KEY, "column_name"]
    plain = cols.select(
        *KEY, "ordinal", "column_name", "data_type", "nullable", F.lit(False).alias("is_generated"), "k"
    )
    foreign = cols.filter(F.col("references").isNotNull()).select(
        *key,
        F.col("references.schema").alias("ref_schema"),
        F.col("references.table").alias("ref_table"),
        F.col("references.column").alias("ref_column"),
    )
    statistic = F.when(F.col("ordinal") == 1, -1.0).when(F.col("ordinal") == 2, -0.5).when(
        F.col("ordinal") % 7 != 0, F.col("ordinal") * 1.0
    )
    return {
        "tables": fleet.tables(spark, sf_dir).filter("k % 13 != 0"),
        "columns": plain,
        "primary": cols.filter("primary_key").select(*key),
        "unique": cols.filter("unique").select(*key),
        "foreign": foreign,
        "distinct": cols.select(*key, statistic.alias("n_distinct")),
    }


@query("j1_primary_key", sql("SELECT table_name, ordinal, pk AS primary_key FROM c"))
def with_primary(spark, sf_dir):
    p = parts(spark, sf_dir)
    return assemble.with_primary(p["columns"], p["primary"]).select("table_name", "ordinal", "primary_key")


@query("j2_unique", sql("SELECT table_name, ordinal, is_unique FROM c"))
def with_unique(spark, sf_dir):
    p = parts(spark, sf_dir)
    return assemble.with_unique(p["columns"], p["unique"]).select(
        "table_name", "ordinal", F.col("unique").alias("is_unique")
    )


@query(
    "j3_references",
    sql("SELECT table_name, ordinal, ref_table IS NOT NULL AS foreign_key, ref_schema, ref_table, ref_column FROM c"),
)
def with_references(spark, sf_dir):
    p = parts(spark, sf_dir)
    return assemble.with_references(p["columns"], p["foreign"]).select(
        "table_name",
        "ordinal",
        "foreign_key",
        F.col("references.schema").alias("ref_schema"),
        F.col("references.table").alias("ref_table"),
        F.col("references.column").alias("ref_column"),
    )


@query(
    "j5_known_tables",
    sql("SELECT table_name, ordinal, row_count FROM c JOIN t USING (table_name) WHERE t.k % 13 <> 0"),
)
def known_tables(spark, sf_dir):
    p = parts(spark, sf_dir)
    return assemble.of_known_tables(p["columns"], p["tables"]).select("table_name", "ordinal", "row_count")


@query("j6_volumes", sql("SELECT table_name, row_count, size_bytes FROM t"))
def volumes(spark, sf_dir):
    t = fleet.tables(spark, sf_dir)
    return assemble.with_volumes(t.select(*KEY), t.select(*KEY, "row_count", "size_bytes")).select(
        "table_name", "row_count", "size_bytes"
    )


DISTINCT_SQL = (
    "CASE WHEN ordinal = 1 THEN coalesce(row_count, 0) "
    "WHEN ordinal = 2 THEN CAST(floor(0.5 * coalesce(row_count, 0)) AS BIGINT) "
    "WHEN ordinal % 7 <> 0 THEN ordinal END"
)


@query(
    "p5_decode_distinct",
    sql(f"SELECT table_name, ordinal, CAST({DISTINCT_SQL} AS BIGINT) AS distinct_count FROM c JOIN t USING (table_name) WHERE t.k % 13 <> 0"),
)
def decode_distinct(spark, sf_dir):
    _, cols, _ = assemble.assemble(parts(spark, sf_dir))
    return cols.select("table_name", "ordinal", "distinct_count")


@query(
    "p10_type_family",
    sql(
        "SELECT table_name, ordinal, CASE data_type WHEN 'BIGINT' THEN 'INT' WHEN 'DOUBLE' THEN 'FLOAT' ELSE data_type END "
        "AS type_family FROM c"
    ),
)
def type_family(spark, sf_dir):
    return fleet.flat_columns(spark, sf_dir).select(
        "table_name", "ordinal", scalars.type_family("data_type").alias("type_family")
    )


# -- relations ------------------------------------------------------------------

# Targets by the name rule and by given names, and the edge list, in SQL.
RELATE_SQL = """,
fk1 AS (SELECT schema_name, table_name, arg_min(column_name, ordinal) AS pk_column FROM ca WHERE pk GROUP BY ALL),
tk AS (SELECT t.schema_name, t.table_name, pk_column,
         regexp_replace(t.table_name, '^(dim_|fact_|vw_|stg_|int_|lkp_)', '') AS bare
       FROM t LEFT JOIN fk1 USING (schema_name, table_name)),
cand AS (SELECT *, CASE WHEN ends_with(column_name, '_id') THEN column_name[:-4]
                        WHEN ends_with(column_name, 'id') AND length(column_name) > 2 THEN column_name[:-3]
                        WHEN ends_with(column_name, '_key') THEN column_name[:-5]
                        ELSE column_name END AS entity
         FROM ca WHERE NOT pk AND (fk OR inf_fk OR ends_with(column_name, 'id'))),
named AS (SELECT cand.*, x.schema_name AS n_schema, x.table_name AS n_table, x.pk_column AS n_pk,
           row_number() OVER (PARTITION BY cand.table_name, cand.ordinal ORDER BY
             x.schema_name IS NULL, x.schema_name <> cand.schema_name, x.table_name <> cand.entity, x.table_name) AS rn
          FROM cand LEFT JOIN tk x ON (x.table_name = cand.entity OR x.bare = cand.entity) AND x.table_name <> cand.table_name),
res AS (SELECT n.*, i.schema_name AS i_schema, i.table_name AS i_table, g.schema_name AS g_schema, g.table_name AS g_table
        FROM named n LEFT JOIN tk i ON i.table_name = n.inf_table LEFT JOIN tk g ON g.table_name = n.ref_table WHERE rn = 1),
edges AS (SELECT system_name, schema_name AS source_schema, table_name AS source,
   coalesce(i_schema, g_schema, n_schema, schema_name) AS target_schema,
   coalesce(i_table, g_table, n_table, table_name) AS target, 'FK' AS type, column_name AS source_column,
   CASE WHEN i_table IS NOT NULL OR g_table IS NOT NULL THEN 'ent' || parent || '_id' ELSE n_pk END AS target_column,
   coalesce(i_table, g_table, n_table) IS NULL AS unresolved, inf_fk AS is_inferred,
   CASE WHEN i_table IS NOT NULL THEN 'ai' WHEN g_table IS NOT NULL THEN 'explicit' WHEN n_table IS NOT NULL THEN 'name' END AS method,
   ordinal
  FROM res WHERE coalesce(i_table, g_table, n_table) IS NOT NULL OR fk OR inf_fk)
"""


def rsql(body: str) -> str:
    return sql(RELATE_SQL + body)


def edges(spark, sf_dir):
    return relate.relate(*norm(spark, sf_dir))


def stored_edges(spark, sf_dir):
    """The edge list as a saved table, for views that read it several times."""
    return materialized(edges(spark, sf_dir), "edges")


@query("r1_candidates", rsql("SELECT table_name, column_name FROM cand"))
def candidates(spark, sf_dir):
    return relate.candidates(norm(spark, sf_dir)[1]).select("table_name", "column_name")


def _found(spark, sf_dir, way):
    t, c = norm(spark, sf_dir)
    return relate.resolve(relate.candidates(c), relate.keyed_tables(t, c), (way,))


@query("r2_inferred_targets", rsql("SELECT table_name, column_name, i_schema AS schema_found, i_table AS table_found FROM res"))
def inferred_targets(spark, sf_dir):
    return _found(spark, sf_dir, "ai").select(
        "table_name", "column_name", F.col("found.schema").alias("schema_found"), F.col("found.table").alias("table_found")
    )


@query("r3_explicit_targets", rsql("SELECT table_name, column_name, g_schema AS schema_found, g_table AS table_found FROM res"))
def explicit_targets(spark, sf_dir):
    return _found(spark, sf_dir, "explicit").select(
        "table_name", "column_name", F.col("found.schema").alias("schema_found"), F.col("found.table").alias("table_found")
    )


@query("r4_name_targets", rsql("SELECT table_name, column_name, n_table AS table_found, n_pk AS key_found FROM res"))
def name_targets(spark, sf_dir):
    return _found(spark, sf_dir, "name").select(
        "table_name", "column_name", F.col("found.table").alias("table_found"), F.col("found.pk_column").alias("key_found")
    )


@query(
    "r5_edges",
    rsql(
        "SELECT source_schema, source, target_schema, target, type, source_column, target_column, unresolved, "
        "is_inferred, method FROM edges"
    ),
)
def all_edges(spark, sf_dir):
    return edges(spark, sf_dir).drop("ordinal", "system_name")


@query("f10_visible_edges", rsql("SELECT source, target, source_column FROM edges WHERE source <> target"))
def visible_edges(spark, sf_dir):
    return graph.visible(edges(spark, sf_dir)).select("source", "target", "source_column")


@query("r6_overview_nodes", sql("SELECT schema_name, table_name AS id, table_type AS type, 'TABLE' AS kind FROM t"))
def overview_nodes(spark, sf_dir):
    return graph.overview_nodes(fleet.flat_tables(spark, sf_dir)).drop("system_name")


@query(
    "r6_overview_links",
    rsql("SELECT source, target, type, is_inferred FROM edges WHERE source <> target"),
)
def overview_links(spark, sf_dir):
    return graph.overview_links(edges(spark, sf_dir)).select("source", "target", "type", "is_inferred")


FOCUS = ("fleet", "s2", fleet.PREFIXES[0] + "ent6")
FOCUS_SQL = """,
vis AS (SELECT * FROM edges WHERE source <> target),
near AS (SELECT n AS table_name, bool_or(linked) AS linked FROM (
   SELECT 'dim_ent6' AS n, true AS linked
   UNION ALL SELECT target, true FROM vis WHERE source = 'dim_ent6'
   UNION ALL SELECT source, true FROM vis WHERE target = 'dim_ent6'
   UNION ALL SELECT ref_table, false FROM ca WHERE table_name = 'dim_ent6' AND ref_table IS NOT NULL
   UNION ALL SELECT table_name, false FROM ca WHERE ref_table = 'dim_ent6') GROUP BY ALL),
tou AS (SELECT * FROM vis WHERE source IN (SELECT table_name FROM near) OR target IN (SELECT table_name FROM near)),
cols AS (SELECT ca.table_name, column_name FROM ca JOIN near USING (table_name)),
fl AS (SELECT tou.*, EXISTS (SELECT 1 FROM cols x WHERE x.table_name = source AND x.column_name = source_column)
                 AND EXISTS (SELECT 1 FROM cols x WHERE x.table_name = target AND x.column_name = target_column) AS both_ends FROM tou)
"""


@query(
    "r7_detail_nodes",
    rsql(
        FOCUS_SQL
        + """SELECT n.table_name AS id, CASE WHEN linked THEN coalesce(table_type, 'BASE TABLE') ELSE 'REF_TABLE' END AS type
FROM (SELECT * FROM near UNION ALL
      SELECT DISTINCT x, true FROM (SELECT source AS x FROM fl WHERE NOT both_ends UNION SELECT target FROM fl WHERE NOT both_ends)
      WHERE x NOT IN (SELECT table_name FROM near)) n LEFT JOIN t USING (table_name)
UNION ALL SELECT table_name || '.' || column_name, 'COLUMN' FROM cols"""
    ),
)
def detail_nodes(spark, sf_dir):
    t, c = norm(spark, sf_dir)
    return graph.detail_nodes(t, c, stored_edges(spark, sf_dir), FOCUS).select("id", "type")


@query(
    "r7_detail_links",
    rsql(
        FOCUS_SQL
        + """SELECT CASE WHEN both_ends THEN source || '.' || source_column ELSE source END AS source,
  CASE WHEN both_ends THEN target || '.' || target_column ELSE target END AS target,
  CASE WHEN both_ends THEN 'FK_REF' ELSE type END AS type, is_inferred FROM fl
UNION ALL SELECT table_name, table_name || '.' || column_name, 'COL', false FROM cols"""
    ),
)
def detail_links(spark, sf_dir):
    t, c = norm(spark, sf_dir)
    return graph.detail_links(t, c, stored_edges(spark, sf_dir), FOCUS).drop("system_name")


@query(
    "r8_collapsed_links",
    rsql(
        "SELECT source, target, arg_min(is_inferred, ordinal) AS is_inferred, count(*) AS n_links FROM edges "
        "WHERE source <> target GROUP BY source, target"
    ),
)
def collapsed_links(spark, sf_dir):
    return graph.collapsed(edges(spark, sf_dir)).select("source", "target", "is_inferred", "n_links")


@query("w3_first_keys", sql("SELECT table_name, arg_min(column_name, ordinal) AS pk_column FROM c WHERE pk GROUP BY ALL"))
def first_keys(spark, sf_dir):
    return relate.first_keys(norm(spark, sf_dir)[1]).select("table_name", "pk_column")


# Tables in families: six prefixes per entity, spread over the schemas, so that
# every name has several tables to choose from.
FAMILY_SQL = f"""
WITH p AS (SELECT p_partkey AS k FROM part),
ft AS (SELECT k, 's' || ((k // 5) % 3) AS schema_name, CASE k % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(fleet.PREFIXES))} END
  || 'e' || (k // 6) AS table_name, 'e' || (k // 6) AS bare FROM p),
ch AS (SELECT k, schema_name, table_name, 'e' || (k // 12) || CASE k % 3 WHEN 0 THEN '_id' WHEN 1 THEN 'id' ELSE '_key' END AS column_name,
  'e' || (k // 12) AS entity FROM ft),
m AS (SELECT ch.*, x.schema_name AS target_schema, x.table_name AS target, row_number() OVER (PARTITION BY ch.k ORDER BY
    x.schema_name <> ch.schema_name, CASE WHEN x.table_name = entity THEN 0 WHEN x.table_name LIKE 'dim%' THEN 1
      WHEN x.table_name LIKE 'fact%' THEN 2 WHEN x.table_name LIKE 'vw%' THEN 3 WHEN x.table_name LIKE 'stg%' THEN 4 ELSE 6 END,
    x.table_name, x.schema_name) AS rn
  FROM ch JOIN ft x ON x.bare = ch.entity AND NOT (x.table_name = ch.table_name AND x.schema_name = ch.schema_name))
SELECT table_name, column_name, target_schema, target FROM m WHERE rn = 1
"""


@query("w5_best_match", FAMILY_SQL)
def best_match(spark, sf_dir):
    """Among several tables of a name: own schema, exact name, prefix order, name."""
    k = F.col("k")
    number = F.floor(k / 6).cast("string")
    t = fleet.parts(spark, sf_dir).select(
        "k",
        F.lit("fleet").alias("system_name"),
        F.concat(F.lit("s"), (F.floor(k / 5) % 3).cast("string")).alias("schema_name"),
        F.concat(fleet._pick(fleet.PREFIXES, k % 6), F.lit("e"), number).alias("table_name"),
        F.lit(None).cast("string").alias("pk_column"),
    )
    asked = t.withColumn(
        "column_name",
        F.concat(F.lit("e"), F.floor(k / 12).cast("string"), fleet._pick(fleet.SUFFIXES, k % 3)),
    ).withColumns({"ordinal": F.lit(1), "is_foreign_key": F.lit(False), "inferred_fk": F.lit(False)})
    found = relate.resolve(asked, t.drop("k"), ("name",)).filter(F.col("found").isNotNull())
    return found.select(
        "table_name",
        "column_name",
        F.col("found.schema").alias("target_schema"),
        F.col("found.table").alias("target"),
    )


# -- statistics -----------------------------------------------------------------


def _stats(spark, sf_dir):
    t, c = norm(spark, sf_dir)
    return stats.stats(t, c, relate.relate(t, c))


@query(
    "g1_totals",
    sql(
        "SELECT (SELECT count(*) FROM t) AS total_tables, (SELECT count(*) FROM t WHERE table_type = 'BASE TABLE') AS base_tables, "
        "(SELECT count(*) FROM c) AS total_columns, (SELECT CAST(sum(row_count) AS BIGINT) FROM t) AS total_rows"
    ),
)
def totals(spark, sf_dir):
    return stats.catalogue_totals(*norm(spark, sf_dir)).select("total_tables", "base_tables", "total_columns", "total_rows")


@query(
    "g2_average_width",
    sql("SELECT CAST(round_even(CAST((SELECT count(*) FROM c) AS DECIMAL(18,6)) / (SELECT count(*) FROM t), 1) AS DOUBLE) AS avg_cols_per_table"),
)
def average_width(spark, sf_dir):
    return stats.catalogue_totals(*norm(spark, sf_dir)).select("avg_cols_per_table")


@query(
    "g3_primary_key_tables",
    sql(
        "SELECT count(*) FILTER (a) AS primary_keys, count(*) FILTER (NOT a AND i) AS inferred_pks FROM "
        "(SELECT table_name, bool_or(pk) AS a, bool_or(inf_pk) AS i FROM ca GROUP BY ALL)"
    ),
)
def primary_key_tables(spark, sf_dir):
    return stats.catalogue_totals(*norm(spark, sf_dir)).select("primary_keys", "inferred_pks")


@query(
    "g4_foreign_key_tables",
    sql(
        "SELECT count(*) FILTER (a) AS foreign_key_cols, count(*) FILTER (NOT a AND i) AS inferred_fks FROM "
        "(SELECT table_name, bool_or(fk) AS a, bool_or(inf_fk) AS i FROM ca GROUP BY ALL)"
    ),
)
def foreign_key_tables(spark, sf_dir):
    return stats.catalogue_totals(*norm(spark, sf_dir)).select("foreign_key_cols", "inferred_fks")


@query(
    "g5_resolved_edges",
    rsql(
        "SELECT count(*) FILTER (NOT is_inferred) AS fk_relations, count(*) FILTER (is_inferred) AS inferred_fk_rels "
        "FROM edges WHERE source <> target"
    ),
)
def resolved_edges(spark, sf_dir):
    return _stats(spark, sf_dir).select("fk_relations", "inferred_fk_rels")


ROWS_TEXT = (
    "CASE WHEN {0} >= 1000000 THEN (({0} + 5000) // 10000) // 100 || '.' || "
    "lpad(CAST((({0} + 5000) // 10000) % 100 AS VARCHAR), 2, '0') || 'M' ELSE format('{{:,}}', {0}) END"
)


@query(
    "g6_tiles",
    sql(
        "SELECT t.table_name, CAST(table_type = 'BASE TABLE' AS INTEGER) AS base_tables, count(*) AS total_columns, "
        "count(*) FILTER (pk) AS primary_keys, count(*) FILTER (fk) AS foreign_key_cols, "
        f"{ROWS_TEXT.format('coalesce(row_count, 0)')} AS total_rows_fmt FROM t JOIN c USING (table_name) GROUP BY ALL"
    ),
)
def tiles(spark, sf_dir):
    return stats.tiles(*norm(spark, sf_dir)).drop("system_name", "schema_name")


@query(
    "g7_related_tables",
    rsql(
        "SELECT source AS table_name, 'outbound' AS direction, target AS related_table, source_column FROM edges WHERE source <> target "
        "UNION ALL SELECT target, 'inbound', source, source_column FROM edges WHERE source <> target"
    ),
)
def related_tables(spark, sf_dir):
    return stats.related_tables(stored_edges(spark, sf_dir)).select(
        "table_name", "direction", "related_table", "source_column"
    )


@query(
    "g7_table_info",
    rsql(
        """SELECT t.table_name, t.row_count, n_columns, coalesce(fk_columns, '') AS fk_columns,
  (SELECT count(*) FROM edges WHERE source = t.table_name AND source <> target) AS n_outbound,
  (SELECT count(*) FROM edges WHERE target = t.table_name AND source <> target) AS n_inbound
FROM t JOIN (SELECT table_name, count(*) AS n_columns, string_agg(CASE WHEN fk THEN column_name END, ',' ORDER BY ordinal) AS fk_columns
             FROM ca GROUP BY ALL) USING (table_name)"""
    ),
)
def table_info(spark, sf_dir):
    t, c = norm(spark, sf_dir)
    return stats.table_info(t, c, stored_edges(spark, sf_dir)).select(
        "table_name", "row_count", "n_columns", F.array_join("fk_columns", ",").alias("fk_columns"),
        "n_outbound", "n_inbound",
    )


@query("g8_tables_by_schema", sql("SELECT schema_name, count(*) AS n_tables FROM t GROUP BY ALL"))
def tables_by_schema(spark, sf_dir):
    return stats.by_schema(fleet.flat_tables(spark, sf_dir)).select("schema_name", "n_tables")


@query("g9_distinct_edges", rsql("SELECT DISTINCT source, target, source_column FROM edges"))
def distinct_edges(spark, sf_dir):
    doubled = stored_edges(spark, sf_dir)
    return stats.distinct_edges(doubled.unionByName(doubled)).select("source", "target", "source_column")


# -- scalar functions on catalogue fields ----------------------------------------


# The size of ``t`` in words: two digits at most, without zeros at their end.
_UNIT = "CASE WHEN size_bytes < 1024 THEN 0 WHEN size_bytes < 1048576 THEN 1 WHEN size_bytes < 1073741824 THEN 2 ELSE 3 END"
SIZE_SQL = (
    f"CASE WHEN size_bytes IS NULL THEN '0B' ELSE regexp_replace(printf('%.2f', size_bytes / pow(1024, {_UNIT})), "
    f"'\\.?0+$', '') || list_extract(['B', 'KB', 'MB', 'GB'], {_UNIT} + 1) END"
)


@query(
    "x1_format_size",
    sql(f"SELECT table_name, {SIZE_SQL} AS size FROM t"),
)
def format_size(spark, sf_dir):
    return fleet.flat_tables(spark, sf_dir).select("table_name", "size")


@query(
    "x2_utc_stamp",
    sql("SELECT table_name, strftime(make_timestamp((1000000000 + k * 86399) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM t"),
)
def utc_stamp(spark, sf_dir):
    """The stamp of a moment per table."""
    at = F.timestamp_seconds(F.lit(1_000_000_000) + F.col("k") * 86_399)
    return fleet.tables(spark, sf_dir).select("table_name", scalars.utc_stamp(at).alias("stamp"))


@query("x3_row_totals", sql(f"SELECT table_name, {ROWS_TEXT.format('size_bytes')} AS total FROM t WHERE size_bytes IS NOT NULL"))
def row_totals(spark, sf_dir):
    return (
        fleet.flat_tables(spark, sf_dir)
        .filter("size_bytes IS NOT NULL")
        .select("table_name", scalars.row_total_text("size_bytes").alias("total"))
    )


@query("x6_case_folding", sql("SELECT table_name, upper(table_name) AS up, lower(upper(column_name)) AS low FROM c"))
def case_folding(spark, sf_dir):
    return fleet.flat_columns(spark, sf_dir).select(
        "table_name", F.upper("table_name").alias("up"), F.lower(F.upper("column_name")).alias("low")
    )


@query("x7_bare_names", sql("SELECT table_name, 'ent' || k AS bare FROM t"))
def bare_names(spark, sf_dir):
    return fleet.flat_tables(spark, sf_dir).select(
        "table_name", scalars.bare_table_name("table_name").alias("bare")
    )


@query(
    "x8_entity_names",
    sql(
        "SELECT table_name, ordinal, CASE WHEN ordinal = 1 THEN 'ent' || k WHEN ordinal = 2 AND k >= 2 THEN 'ent' || parent "
        "ELSE column_name END AS entity, 1 AS n FROM c"
    ),
)
def entity_names(spark, sf_dir):
    found = scalars.entity_names("column_name")
    return fleet.flat_columns(spark, sf_dir).select(
        "table_name", "ordinal", F.element_at(found, 1).alias("entity"), F.size(found).alias("n")
    )


@query("x10_pages", sql("SELECT schema_name, CAST(ceil(count(*) / 20) AS INTEGER) AS pages FROM t GROUP BY ALL"))
def pages(spark, sf_dir):
    return stats.by_schema(fleet.flat_tables(spark, sf_dir)).select(
        "schema_name", scalars.pages("n_tables", 20).alias("pages")
    )


@query("x11_yes_no", sql("SELECT table_name, ordinal, nullable AS flag FROM c"))
def yes_no(spark, sf_dir):
    words = F.when(F.col("nullable"), F.when(F.col("k") % 2 == 0, "YES").otherwise("Y")).otherwise("NO")
    return fleet.columns(spark, sf_dir).select(
        "table_name", "ordinal", scalars.is_yes(words).alias("flag")
    )


@query(
    "x12_source_label",
    sql("SELECT table_name, CASE WHEN k % 3 = 0 THEN schema_name WHEN k % 3 = 1 THEN table_name ELSE 'postgres' END AS label FROM t"),
)
def source_label(spark, sf_dir):
    k = F.col("k")
    return fleet.tables(spark, sf_dir).select(
        "table_name",
        scalars.source_label(
            F.when(k % 3 == 0, F.col("schema_name")).otherwise(""),
            F.when(k % 3 == 1, F.col("table_name")),
            F.lit("postgres"),
        ).alias("label"),
    )


@query(
    "x13_reference_label",
    sql(
        "SELECT table_name, ordinal, coalesce(ref_table, inf_table) || '.' || CASE WHEN ref_table IS NOT NULL OR inf_table IS NOT NULL "
        "THEN 'ent' || parent || '_id' END || CASE WHEN inf_table IS NOT NULL THEN ' (AI)' ELSE '' END AS label FROM ca"
    ),
)
def reference_label(spark, sf_dir):
    return norm(spark, sf_dir)[1].select(
        "table_name",
        "ordinal",
        scalars.reference_label("fk_ref_table", "fk_ref_column", "inf_ref_table", "inf_ref_column").alias("label"),
    )
