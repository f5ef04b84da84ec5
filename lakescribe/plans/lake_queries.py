"""Queries over the lake tables themselves: profiles, keys, inclusion."""

from __future__ import annotations

import os
from functools import partial, reduce

from pyspark.sql import functions as F

from lakescribe.operators import assemble, foreign_keys, inclusion, keys, profile
from lakescribe.plans.registry import query
from lakescribe.session import materialized
from lakescribe.sources import dialects, lake

# The lake's tables and their columns with carrier family (fixed values).
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

COLUMNS = {
    "region": "r_regionkey:INT r_name:STRING",
    "nation": "n_nationkey:INT n_name:STRING n_regionkey:INT",
    "customer": "c_custkey:BIGINT c_name:STRING c_nationkey:INT c_acctbal:DOUBLE c_mktsegment:STRING",
    "supplier": "s_suppkey:BIGINT s_name:STRING s_nationkey:INT s_acctbal:DOUBLE",
    "part": "p_partkey:BIGINT p_name:STRING p_brand:STRING p_type:STRING p_size:INT p_retailprice:DOUBLE",
    "orders": "o_orderkey:BIGINT o_custkey:BIGINT o_orderstatus:STRING o_totalprice:DOUBLE "
    "o_orderdate:TIMESTAMP_NTZ o_orderpriority:STRING",
    "lineitem": "l_orderkey:BIGINT l_partkey:BIGINT l_suppkey:BIGINT l_linenumber:INT l_quantity:DOUBLE "
    "l_extendedprice:DOUBLE l_discount:DOUBLE l_tax:DOUBLE l_returnflag:STRING l_linestatus:STRING "
    "l_shipdate:TIMESTAMP_NTZ",
    "events": "event_id:BIGINT ts:TIMESTAMP_NTZ user_id:BIGINT event_type:STRING value:DOUBLE props:STRING",
    "documents": "doc_id:BIGINT text:STRING lang:STRING source:STRING n_chars:BIGINT",
    "embeddings": "vec_id:BIGINT embedding:ARRAY<FLOAT> label:INT",
    "pages": "page_id:BIGINT url:STRING html:STRING",
    "benchmark": "item_id:BIGINT text:STRING",
    "labels": "doc_id:BIGINT quality:INT toxic:INT",
    "conversations": "conv_id:BIGINT turn:BIGINT role:STRING text:STRING",
}


def listed() -> list[tuple[str, int, str, str]]:
    return [
        (t, i + 1, *item.split(":"))
        for t in TABLES
        for i, item in enumerate(COLUMNS[t].split())
    ]


def frames(spark, sf_dir):
    return lake.frames(spark, sf_dir, TABLES)


def _union(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


def _family(data_type: str) -> str:
    return {"BIGINT": "INT", "TIMESTAMP_NTZ": "TIMESTAMP", "DOUBLE": "FLOAT", "ARRAY<FLOAT>": "NESTED"}.get(
        data_type, data_type
    )


LISTED_SQL = "SELECT * FROM (VALUES " + ",".join(
    f"('{t}', {i}, '{c}', '{k}', '{_family(k)}')" for t, i, c, k in listed()
) + ") AS v(table_name, ordinal, column_name, data_type, type_family)"

COUNTS_SQL = _union(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, count(*) AS row_count, "
        f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {t}"
        for t, i, c, _ in listed()
    ]
)


@query("a26_lake_source", LISTED_SQL)
def lake_source(spark, sf_dir):
    return lake.lake_columns(frames(spark, sf_dir)).select(
        "table_name", "ordinal", "column_name", "data_type", "type_family"
    )


@query("p1_row_counts", _union([f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES]))
def row_counts(spark, sf_dir):
    return lake.lake_tables(profile.row_counts(frames(spark, sf_dir))).select("table_name", "row_count")


@query("p2_table_sizes")
def table_sizes(spark, sf_dir):
    paths = {t: os.path.join(sf_dir, f"{t}.parquet") for t in TABLES}
    sizes = lake.table_sizes(spark, paths)
    return lake.lake_tables(profile.row_counts(frames(spark, sf_dir)), sizes).select(
        "table_name", "row_count", "size_bytes", "size"
    )


@query("p2_sized_tables", _union([f"SELECT '{t}' AS table_name, count(*) AS row_count, true AS has_size FROM {t}" for t in TABLES]))
def sized_tables(spark, sf_dir):
    """Every table has a size; what it is depends on the files, which SQL can't see."""
    return table_sizes(spark, sf_dir).select(
        "table_name", "row_count", ((F.col("size_bytes") > 0) & F.col("size").isNotNull()).alias("has_size")
    )


@query(
    "p3_approx_profile",
    f"SELECT table_name, column_name, row_count, null_count, true AS within_tolerance FROM ({COUNTS_SQL})",
)
def approx_profile(spark, sf_dir):
    """Sketches against exact counts of the same columns."""
    data = frames(spark, sf_dir)
    exact = profile.exact_distinct(data).withColumnRenamed("distinct_count", "exact")
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    return profile.profile_many(data).join(exact, ["table_name", "column_name"]).select(
        "table_name",
        "column_name",
        "row_count",
        "null_count",
        (off <= F.greatest(F.col("exact") * 0.1, F.lit(2))).alias("within_tolerance"),
    )


@query("p4_exact_distinct", f"SELECT table_name, column_name, distinct_count FROM ({COUNTS_SQL})")
def exact_distinct(spark, sf_dir):
    return profile.exact_distinct(frames(spark, sf_dir))


# Nulls exist in no lake table, so some values are nulled by the same rule on both sides.
_NULLED = "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END"


@query(
    "p6_nullability",
    _union(
        [
            f"SELECT '{c}' AS column_name, count(*) - count({e}) AS null_count, "
            f"count(*) - count({e}) > 0 AS nullable FROM orders"
            for c, e in (
                ("o_orderkey", "o_orderkey"),
                ("o_custkey", _NULLED),
                ("o_orderstatus", "nullif(o_orderstatus, 'F')"),
                ("o_totalprice", "o_totalprice"),
                ("o_orderdate", "o_orderdate"),
                ("o_orderpriority", "o_orderpriority"),
            )
        ]
    ),
)
def nullability(spark, sf_dir):
    orders = lake.frames(spark, sf_dir, ["orders"])["orders"].withColumns(
        {"o_custkey": F.expr(_NULLED), "o_orderstatus": F.nullif("o_orderstatus", F.lit("F"))}
    )
    return profile.profile(orders, "orders").select(
        "column_name", "null_count", (F.col("null_count") > 0).alias("nullable")
    )


UNIQUE_SQL = (
    "SELECT table_name, column_name, ordinal, row_count, null_count, "
    f"null_count = 0 AND distinct_count = row_count AS is_unique FROM ({COUNTS_SQL})"
)


@query("p7_uniqueness", f"SELECT table_name, column_name, null_count, is_unique FROM ({UNIQUE_SQL})")
def uniqueness(spark, sf_dir):
    return profile.uniqueness(frames(spark, sf_dir)).select(
        "table_name", "column_name", "null_count", F.col("unique").alias("is_unique")
    )


def _composite_sql(table: str, cols: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, count(*) FILTER (n > 1) AS repeated_keys, "
        f"count(*) FILTER (n > 1) = 0 AS is_key FROM (SELECT {cols}, count(*) AS n FROM {table} GROUP BY {cols})"
    )


@query(
    "p8_composite_key",
    _composite_sql("lineitem", "l_orderkey, l_linenumber")
    + " UNION ALL "
    + _composite_sql("conversations", "conv_id, turn"),
)
def composite_key(spark, sf_dir):
    data = lake.frames(spark, sf_dir, ["lineitem", "conversations"])
    checks = [("lineitem", ["l_orderkey", "l_linenumber"]), ("conversations", ["conv_id", "turn"])]
    done = [
        profile.is_composite_key(data[t], k).select(F.lit(t).alias("table_name"), "repeated_keys", "is_key")
        for t, k in checks
    ]
    return done[0].unionByName(done[1])


@query(
    "p8_repeated_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem "
    "GROUP BY ALL HAVING count(*) > 1",
)
def repeated_keys(spark, sf_dir):
    lineitem = lake.frames(spark, sf_dir, ["lineitem"])["lineitem"]
    return profile.repeated_keys(lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "p9_empty_tables",
    "SELECT table_name, column_name, CASE WHEN row_count > 0 THEN distinct_count END AS distinct_count FROM ("
    + _union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, "
            f"count(DISTINCT {c}) AS distinct_count FROM (SELECT * FROM orders WHERE {w})"
            for t, w in (("none", "o_totalprice < 0"), ("some", "o_orderstatus = 'F'"))
            for c in ("o_orderstatus", "o_orderpriority")
        ]
    )
    + ")",
)
def empty_tables(spark, sf_dir):
    """No distinct count for a table without rows."""
    orders = lake.frames(spark, sf_dir, ["orders"])["orders"].select(
        "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    data = {
        "none": orders.filter("o_totalprice < 0").drop("o_totalprice"),
        "some": orders.filter("o_orderstatus = 'F'").drop("o_totalprice"),
    }
    return profile.profile_many(data).select("table_name", "column_name", "distinct_count")


INT_COLUMNS = [(t, c) for t, _, c, k in listed() if _family(k) == "INT"]
STRING_COLUMNS = [(t, c) for t, _, c, k in listed() if _family(k) == "STRING"]


def _values_sql(cols, kind: str) -> str:
    return _union(
        [f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS {kind}) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in cols]
    )


def _inclusions_sql(cols, kind: str) -> str:
    return f"""
WITH d AS ({_values_sql(cols, kind)}),
n AS (SELECT t, c, count(*) AS n FROM d GROUP BY ALL),
r AS ({_union([f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in sorted({t for t, _ in cols})])}),
u AS (SELECT n.t, n.c, n.n FROM n JOIN r ON n.t = r.t AND n.n = r.n),
x AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n
      FROM d a JOIN d b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column,
  n.n AS n_child, u.n AS n_parent
FROM x JOIN n ON n.t = ct AND n.c = cc AND n.n = x.n JOIN u ON u.t = pt AND u.c = pc"""


def _unique_columns(data, cols):
    wanted = {}
    for t, c in cols:
        wanted.setdefault(t, []).append(c)
    pruned = {t: data[t].select(*cs) for t, cs in wanted.items()}
    found = profile.uniqueness(pruned).filter("unique").select("table_name", "column_name").collect()
    return [(r.table_name, r.column_name) for r in found]


# Keys of orders as exact and floating numbers of other types, some beyond what doubles can tell apart.
_LARGE = "CAST(o_orderkey + 9007199254740992 AS bigint)"
_TYPED = {
    "typed": {
        "wide": "CAST(o_orderkey AS decimal(38,0))",
        "scaled": "CAST(o_orderkey AS decimal(20,2))",
        "floating": "CAST(o_custkey AS double)",
        "halves": "CAST(o_orderkey + 0.5 AS decimal(20,2))",
        "large": _LARGE,
    },
    "rounded": {"large": f"CAST({_LARGE} AS double)", "halves": "CAST(o_orderkey + 0.5 AS double)"},
}
TYPED_COLUMNS = [(t, c) for t, columns in _TYPED.items() for c in columns]
_TYPED_SQL = "WITH " + ", ".join(
    f"{t} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM orders)" for t, columns in _TYPED.items()
).replace(f"CAST({_LARGE} AS double)", f"CAST(CAST({_LARGE} AS double) AS hugeint)")


def _with_typed(data):
    return data | {t: data["orders"].selectExpr(*(f"{e} AS {c}" for c, e in columns.items())) for t, columns in _TYPED.items()}


# DuckDB tells all these numbers apart as decimals of one digit after the point.
@query(
    "i7_all_inclusions",
    _TYPED_SQL + ", " + _inclusions_sql(INT_COLUMNS + TYPED_COLUMNS, "DECIMAL(38,1)").strip().removeprefix("WITH "),
)
def all_inclusions(spark, sf_dir):
    """Every integer column, and keys as decimals and floating numbers, against every unique one of other tables."""
    data = _with_typed(frames(spark, sf_dir))
    columns = INT_COLUMNS + TYPED_COLUMNS
    return inclusion.inclusions(data, columns, _unique_columns(data, columns))


FLOAT_COLUMNS = [(t, c) for t, _, c, k in listed() if _family(k) == "FLOAT"]
TIME_COLUMNS = [(t, c) for t, _, c, k in listed() if _family(k) == "TIMESTAMP"]


def _all_inclusions_sql(cols, kind: str) -> str:
    """Inclusions with every column as a parent."""
    unique = "u AS (SELECT n.t, n.c, n.n FROM n JOIN r ON n.t = r.t AND n.n = r.n)"
    return _inclusions_sql(cols, kind).replace(unique, "u AS (SELECT * FROM n)")


@query(
    "i7_other_inclusions",
    f"SELECT * FROM ({_all_inclusions_sql(FLOAT_COLUMNS, 'DOUBLE')}) UNION ALL "
    f"SELECT * FROM ({_all_inclusions_sql(TIME_COLUMNS, 'TIMESTAMP')})",
)
def other_inclusions(spark, sf_dir):
    """Every floating number and every time against all others of other tables."""
    columns = FLOAT_COLUMNS + TIME_COLUMNS
    return inclusion.inclusions(frames(spark, sf_dir), columns, columns)


@query("i7_text_inclusions", _inclusions_sql(STRING_COLUMNS, "VARCHAR"))
def text_inclusions(spark, sf_dir):
    data = frames(spark, sf_dir)
    return inclusion.inclusions(data, STRING_COLUMNS, _unique_columns(data, STRING_COLUMNS))


_J9 = [
    (("orders", "o_custkey"), ("customer", "c_custkey")),
    (("lineitem", "l_orderkey"), ("orders", "o_orderkey")),
    (("documents", "doc_id"), ("labels", "doc_id")),
    (("labels", "doc_id"), ("documents", "doc_id")),
    (("events", "user_id"), ("customer", "c_custkey")),
    (("part", "p_brand"), ("part", "p_type")),
    (("orders", "o_totalprice"), ("customer", "c_acctbal")),
    (("part", "p_size"), ("lineitem", "l_quantity")),
    (("lineitem", "l_discount"), ("nation", "n_nationkey")),
    (("none", "o_orderkey"), ("orders", "o_orderkey")),
]
_J9_APART = (("part", "p_name"), ("orders", "o_orderkey"))  # texts and numbers


def _missing_sql(pairs) -> str:
    return _union(
        [
            f"SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column, "
            f"count(*) AS n_child, count(*) FILTER (p IS NULL) AS n_missing FROM "
            f"(SELECT DISTINCT {cc} AS v FROM {ct} WHERE {cc} IS NOT NULL) x "
            f"LEFT JOIN (SELECT DISTINCT {pc} AS p FROM {pt}) y ON x.v = y.p"
            for (ct, cc), (pt, pc) in pairs
        ]
    )


_J9_TYPED = [
    (("typed", "large"), ("rounded", "large")),
    (("rounded", "large"), ("typed", "large")),
    (("typed", "halves"), ("rounded", "halves")),
    (("typed", "scaled"), ("typed", "wide")),
    (("typed", "wide"), ("typed", "halves")),
]


@query(
    "j9_inclusion",
    _TYPED_SQL + ", none AS (SELECT * FROM orders WHERE o_totalprice < 0) SELECT *, CAST(NULL AS VARCHAR) AS reason FROM ("
    + _missing_sql(_J9 + _J9_TYPED)
    + ") UNION ALL SELECT 'part', 'p_name', 'orders', 'o_orderkey', NULL, NULL, 'types cannot be compared'",
)
def missing(spark, sf_dir):
    """Pairs of equal and of different types, one with an empty child, and one that can't be compared."""
    data = _with_typed(frames(spark, sf_dir))
    data["none"] = data["orders"].filter("o_totalprice < 0")
    return inclusion.missing_counts(data, [*_J9, *_J9_TYPED, _J9_APART])


@query("j9_one_pair", _missing_sql(_J9[2:3]).replace("SELECT 'documents' AS child_table, 'doc_id' AS child_column, 'labels' AS parent_table, 'doc_id' AS parent_column, ", "SELECT "))
def one_pair(spark, sf_dir):
    data = lake.frames(spark, sf_dir, ["documents", "labels"])
    return inclusion.inclusion(data["documents"], "doc_id", data["labels"], "doc_id")


# The name rule of ``keys.name_signal`` in SQL.
_SIGNAL = """
  CASE WHEN column_name = 'id' THEN 8
       WHEN column_name IN (table_name || '_id', table_name || 'id', table_name || '_key', table_name || 'key')
         OR regexp_replace(column_name, '^[a-z]{1,2}_', '')
            IN (table_name || '_id', table_name || 'id', table_name || '_key', table_name || 'key') THEN 6
       WHEN regexp_matches(column_name, '(_id|_key|[a-z]key)$|^pk_') THEN 4 ELSE 0 END"""

SCORED_SQL = f"""
  SELECT u.table_name, u.column_name, u.ordinal,
    {_SIGNAL.replace('column_name', 'u.column_name').replace('table_name', 'u.table_name')}
      + CASE WHEN l.type_family = 'INT' THEN 2 ELSE 0 END + 3 AS score
  FROM ({UNIQUE_SQL}) u JOIN ({LISTED_SQL}) l ON l.table_name = u.table_name AND l.column_name = u.column_name
  WHERE is_unique AND {_SIGNAL.replace('column_name', 'u.column_name').replace('table_name', 'u.table_name')} > 0"""


def _typed_columns(spark, sf_dir):
    flags = {n: F.lit(False) for n in ("primary_key", "foreign_key")}
    return lake.lake_columns(frames(spark, sf_dir)).withColumns(flags)


@query("i2_key_scores", f"SELECT table_name, column_name, score FROM ({SCORED_SQL})")
def key_scores(spark, sf_dir):
    measured = profile.uniqueness(frames(spark, sf_dir))
    return keys.score(_typed_columns(spark, sf_dir), measured).select("table_name", "column_name", "score")


KEYS_SQL = (
    "SELECT table_name, column_name FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY table_name ORDER BY score DESC, ordinal) AS rn FROM ({SCORED_SQL})) WHERE rn = 1"
)


@query("i3_primary_keys", KEYS_SQL)
def primary_keys(spark, sf_dir):
    """The primary key found for each lake table from names and data."""
    measured = profile.uniqueness(frames(spark, sf_dir))
    return keys.infer_primary(_typed_columns(spark, sf_dir), measured).select("table_name", "column_name")


def _with_keys(spark, sf_dir):
    cols = _typed_columns(spark, sf_dir)
    measured = profile.uniqueness(frames(spark, sf_dir))
    return keys.apply_primary(cols, keys.infer_primary(cols, measured))


_NAME = "regexp_replace({}, '^[a-z]{{1,2}}_', '')"
NAME_PAIRS_SQL = f"""
WITH l AS ({LISTED_SQL}), k AS ({KEYS_SQL}),
par AS (SELECT l.* FROM l JOIN k ON l.table_name = k.table_name AND l.column_name = k.column_name)
SELECT a.table_name AS child_table, a.column_name AS child_column,
  b.table_name AS parent_table, b.column_name AS parent_column
FROM l a JOIN par b ON a.type_family = b.type_family AND a.table_name <> b.table_name
  AND {_NAME.format('a.column_name')} = {_NAME.format('b.column_name')}"""


@query("i6_name_pairs", NAME_PAIRS_SQL)
def name_pairs(spark, sf_dir):
    return foreign_keys.name_pairs(_with_keys(spark, sf_dir)).select(
        F.col("table_name").alias("child_table"),
        F.col("column_name").alias("child_column"),
        "parent_table",
        "parent_column",
    )


# The eight foreign keys meant by the data set (fixed values).
MEANT = (
    "nation.n_regionkey=region.r_regionkey customer.c_nationkey=nation.n_nationkey "
    "supplier.s_nationkey=nation.n_nationkey orders.o_custkey=customer.c_custkey "
    "lineitem.l_orderkey=orders.o_orderkey lineitem.l_partkey=part.p_partkey "
    "lineitem.l_suppkey=supplier.s_suppkey labels.doc_id=documents.doc_id"
).split()


@query(
    "i6_foreign_keys",
    "SELECT child_table, child_column, parent_table, parent_column, n_child FROM ("
    + _missing_sql([tuple(tuple(s.split(".")) for s in m.split("=")) for m in MEANT])
    + ") WHERE n_missing = 0",
)
def found_foreign_keys(spark, sf_dir):
    """Foreign keys of the lake: names agree and no child value is missing."""
    return foreign_keys.confirmed(_with_keys(spark, sf_dir), frames(spark, sf_dir)).drop("n_parent")


@query("j4_distinct_counts", f"SELECT l.table_name, l.column_name, l.data_type, distinct_count, null_count > 0 AS nullable FROM ({LISTED_SQL}) l JOIN ({COUNTS_SQL}) n ON l.table_name = n.table_name AND l.column_name = n.column_name")
def column_catalogue(spark, sf_dir):
    """Columns of the lake with exact distinct counts and measured nullability."""
    data = frames(spark, sf_dir)
    measured = profile.profile_many(data).select("table_name", "column_name", "null_count")
    return (
        lake.lake_columns(data)
        .join(measured, ["table_name", "column_name"], "left")
        .join(profile.exact_distinct(data), ["table_name", "column_name"], "left")
        .select(
            "table_name", "column_name", "data_type", "distinct_count", (F.col("null_count") > 0).alias("nullable")
        )
    )


# Distinct counts up to this are exact in a sketch; larger ones are compared within a tenth.
_SMALL = 150


def _lake_dumps(db_type: str, listed, merged) -> dict:
    """The lake as a dialect without statistics of its own; distinct counts come from merged states."""
    volumes = merged.groupBy("table_name").agg(F.max("row_count").alias("n"))
    if db_type == "bigquery":
        return {
            "tables": volumes.selectExpr("'lake' AS system_name", "'lake' AS dataset_id", "table_name AS table_id", "'TABLE' AS table_type", "n AS num_rows", "CAST(NULL AS bigint) AS num_bytes"),
            "fields": listed.selectExpr("system_name", "schema_name AS dataset_id", "table_name AS table_id", "ordinal AS position", "column_name AS name", "data_type AS field_type", "'NULLABLE' AS mode"),
            "distinct": profile.distinct_dump(merged, "lake", "lake"),
        }
    return {
        "tables": volumes.selectExpr("'lake' AS system_name", "'LAKE' AS table_schema", "upper(table_name) AS table_name", "'BASE TABLE' AS table_type", "n AS row_count", "CAST(NULL AS bigint) AS bytes"),
        "columns": listed.selectExpr("system_name", "'LAKE' AS table_schema", "upper(table_name) AS table_name", "ordinal AS ordinal_position", "upper(column_name) AS column_name", "data_type", "'YES' AS is_nullable"),
        "distinct": profile.distinct_dump(merged, "lake", "lake", upper=True),
    }


def _snapshot_columns(spark, sf_dir, db_type: str):
    """Columns put together from two snapshots of every table, each row in one of them."""
    data = frames(spark, sf_dir)
    half = {t: F.pmod(F.xxhash64(F.col(profile.quoted(df.columns[0]))), F.lit(2)) for t, df in data.items()}
    states = reduce(
        lambda a, b: a.unionByName(b), [profile.sketch_states(df, t, half[t]) for t, df in data.items()]
    )
    merged = materialized(profile.merged_states(states), "states")
    dumps = _lake_dumps(db_type, lake.lake_columns(data), merged)
    _, cols, _ = assemble.assemble(dialects.dialect_parts(db_type, dumps))
    exact = profile.exact_distinct(data).select(
        F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), F.col("distinct_count").alias("exact")
    )
    names = cols.withColumns({"table_name": F.lower("table_name"), "column_name": F.lower("column_name")})
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    return names.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "ordinal", "data_type",
        F.when(F.col("exact") <= _SMALL, F.col("distinct_count")).alias("small_count"),
        F.when(off <= F.col("exact") * 0.1, F.col("exact")).alias("near_count"),
    )


for _db in ("bigquery", "snowflake"):
    query(
        f"j4_{_db}_columns",
        f"SELECT l.table_name, l.column_name, l.ordinal, l.data_type, CASE WHEN distinct_count <= {_SMALL} THEN distinct_count END AS small_count, "
        f"distinct_count AS near_count FROM ({LISTED_SQL}) l JOIN ({COUNTS_SQL}) n ON l.table_name = n.table_name AND l.column_name = n.column_name",
    )(partial(_snapshot_columns, db_type=_db))
