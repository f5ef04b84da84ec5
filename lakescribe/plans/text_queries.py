"""Queries on texts, documents, answers, batches and the store."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lakescribe import model
from lakescribe.functions import json_text, scalars
from lakescribe.operators import (
    assemble,
    batches,
    enrich,
    foreign_keys,
    keys,
    normalize,
    store,
)
from lakescribe.operators.skew import grown
from lakescribe.plans import fleet
from lakescribe.plans.fleet_queries import SIZE_SQL, flat, sql
from lakescribe.plans.registry import query
from lakescribe.session import materialized, shared_dir
from lakescribe.sources import documents as document_source

KEY = model.TABLE_KEY


def read(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# -- scalar functions on texts ---------------------------------------------------


@query("t2_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalars.token_estimate("text").alias("tokens"))


@query("t7_plain_text", "SELECT doc_id, regexp_replace(text || ' **x** `y`', '[*`]+', '', 'g') AS plain FROM documents")
def plain_text(spark, sf_dir):
    marked = F.concat("text", F.lit(" **x** `y`"))
    return read(spark, sf_dir, "documents").select("doc_id", scalars.plain_text(marked).alias("plain"))


@query("x4_minute_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS at FROM events")
def minute_text(spark, sf_dir):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+05:30"))
    return read(spark, sf_dir, "events").select("event_id", scalars.minute_text(iso).alias("at"))


@query(
    "x5_shorten",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS short FROM documents",
)
def shorten(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalars.shorten("text").alias("short"))


@query(
    "x9_collapse_spaces",
    r"SELECT conv_id, turn, trim(regexp_replace(text || chr(10) || ' x ', '[\s\x0b\x85\p{Z}]+', ' ', 'g')) AS flat FROM conversations",
)
def collapse_spaces(spark, sf_dir):
    text = F.concat("text", F.lit("\n x "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.collapse_spaces(text).alias("flat"))


@query("f2_page_text", "SELECT page_id FROM pages WHERE contains(lower(html), 'class=')")
def page_text(spark, sf_dir):
    from lakescribe.operators.search import holds

    return read(spark, sf_dir, "pages").filter(holds("html", "CLASS=")).select("page_id")


# -- batches ---------------------------------------------------------------------


def _widths(columns):
    return columns.groupBy(*KEY).agg(F.count("*").alias("n_columns"))


BATCH_SQL = """,
b0 AS (SELECT *, p_size > 15 AS wide FROM t),
b1 AS (SELECT *, sum(wide::INT) OVER o AS w, sum((NOT wide)::INT) OVER o AS s FROM b0
       WINDOW o AS (ORDER BY schema_name, table_name ROWS UNBOUNDED PRECEDING)),
b2 AS (SELECT *, CASE WHEN NOT wide THEN (s - 1) // 4 END AS g FROM b1),
b3 AS (SELECT g, count(*) AS n, max(w) AS before FROM b2 WHERE NOT wide GROUP BY g),
bt AS (SELECT b2.*, CAST(CASE WHEN wide THEN w - 1 + s // 4 WHEN n = 4 THEN before + b2.g
         ELSE (SELECT max(w) + max(s) // 4 FROM b2) END AS BIGINT) AS batch_no FROM b2 LEFT JOIN b3 USING (g))
"""


def bsql(body: str) -> str:
    return sql(BATCH_SQL + body)


def _batches(spark, sf_dir):
    t, c = flat(spark, sf_dir)
    return t, c, batches.adaptive_batches(t, _widths(c))


@query("w1_adaptive_batches", bsql("SELECT table_name, p_size AS n_columns, batch_no FROM bt"))
def adaptive_batches(spark, sf_dir):
    return _batches(spark, sf_dir)[2].select("table_name", F.col("n_columns").cast("int").alias("n_columns"), "batch_no")


@query(
    "t1_payloads",
    bsql(
        "SELECT batch_no, table_name, CAST(least(p_size, 50) AS INTEGER) AS n_columns, CASE WHEN k % 11 <> 0 THEN 'ent' || k || '_id' ELSE '' END AS pks, "
        "'ent' || k || '_id:BIGINT' AS first_column FROM bt"
    ),
)
def payloads(spark, sf_dir):
    _, c, b = _batches(spark, sf_dir)
    shape = (
        "array<struct<table_name: string, primary_keys: array<string>, foreign_keys: array<string>, "
        "columns: array<struct<name: string, type: string>>>>"
    )
    rows = batches.payloads(b, c).select("batch_no", F.inline(F.from_json("payload", shape)))
    first = F.get("columns", 0)
    return rows.select(
        "batch_no",
        "table_name",
        F.size("columns").alias("n_columns"),
        F.array_join("primary_keys", ",").alias("pks"),
        F.concat(first["name"], F.lit(":"), first["type"]).alias("first_column"),
    )


_PACK = """
WITH RECURSIVE d AS (
  SELECT lang, source, doc_id, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents),
r AS (
  SELECT lang, source, doc_id, tokens, rn, tokens AS fill, CAST(0 AS BIGINT) AS chunk_no FROM d WHERE rn = 1
  UNION ALL
  SELECT d.lang, d.source, d.doc_id, d.tokens, d.rn, CASE WHEN r.fill + d.tokens > {0} THEN d.tokens ELSE r.fill + d.tokens END,
    CASE WHEN r.fill + d.tokens > {0} THEN r.chunk_no + 1 ELSE r.chunk_no END
  FROM r JOIN d ON d.lang = r.lang AND d.source = r.source AND d.rn = r.rn + 1)
SELECT lang, source, doc_id, tokens, chunk_no FROM r"""


@query("t3_token_chunks", _PACK.format(2000))
def token_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return batches.text_chunks(docs, ["lang", "source"], ["doc_id"], F.col("text"), 2000)


@query("y2_large_chunks", _PACK.format(50000))
def large_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return batches.text_chunks(docs, ["lang", "source"], ["doc_id"], F.col("text"))


# -- answers ---------------------------------------------------------------------


@query("t4_noisy_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def noisy_json(spark, sf_dir):
    """JSON found in plain, fenced and chatty answers."""
    text = (
        F.when(F.col("event_id") % 3 == 0, F.col("props"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .otherwise(F.concat(F.lit("Sure, here it is: "), "props", F.lit(" - hope it helps")))
    )
    return read(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(json_text.noisy_json(text), "$.k", "bigint").alias("k")
    )


@query(
    "t5_json_arrays",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 3 THEN '' ELSE event_type || ',' || user_id END AS items, "
    "CASE WHEN event_id % 4 = 3 THEN event_type END AS named FROM events",
)
def json_arrays(spark, sf_dir):
    """Arrays of texts and of objects; a wrong shape gives an empty array."""
    which = F.col("event_id") % 4
    pair = F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    text = (
        F.when(which == 0, F.concat(F.lit("no list: "), F.lit("[1, 2")))
        .when(which == 1, pair)
        .when(which == 2, F.concat(F.lit("```json\n"), pair, F.lit("\n```")))
        .otherwise(F.concat(F.lit('Found [{"source_table": "'), "event_type", F.lit('"}] only')))
    )
    found = json_text.object_array(text, "source_table: string")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.array_join(json_text.string_array(text), ",").alias("items"),
        F.get(found, 0)["source_table"].alias("named"),
    )


def _answers(spark, sf_dir):
    """Answers for two of three tables, with a description for the first column."""
    t, c = flat(spark, sf_dir)
    b = batches.adaptive_batches(t, _widths(c))
    k = F.regexp_extract("table_name", r"(\d+)$", 1)
    entry = F.concat(
        F.lit('"'), "table_name", F.lit('": {"table_description": "About '), k,
        F.lit('", "column_descriptions": [{"'), F.when(k.cast("int") % 2 == 0, "columnName").otherwise("column_name"),
        F.lit('": "ent'), k, F.lit('_id", "description": "Key of '), k, F.lit('"}]}'),
    )
    told = F.array_sort(F.collect_list(F.when(k.cast("int") % 3 != 0, entry)))
    answers = b.groupBy("system_name", "batch_no").agg(
        F.concat(F.lit("Here: {"), F.array_join(told, ", "), F.lit("}")).alias("answer")
    )
    return t, c, b, enrich.parse_answers(answers)


@query(
    "t6_answer_rows",
    sql("SELECT table_name, 'ent' || k || '_id' AS column_name, 'Key of ' || k AS description FROM t WHERE k % 3 <> 0"),
)
def answer_rows(spark, sf_dir):
    parsed = _answers(spark, sf_dir)[3]
    return enrich.answered_columns(parsed).select("table_name", "column_name", "description")


@query(
    "t11_description_status",
    sql(
        "SELECT table_name, CASE WHEN k % 3 <> 0 THEN 'About ' || k ELSE description END AS description, "
        "CASE WHEN k % 3 <> 0 THEN 'described' ELSE 'missing' END AS status FROM t"
    ),
)
def description_status(spark, sf_dir):
    t, _, b, parsed = _answers(spark, sf_dir)
    return enrich.described_tables(t, b, parsed).select("table_name", "description", "status")


@query(
    "j7_column_descriptions",
    sql("SELECT table_name, ordinal, CASE WHEN k % 3 <> 0 THEN CASE WHEN ordinal = 1 THEN 'Key of ' || k ELSE '' END END AS description FROM c"),
)
def column_descriptions(spark, sf_dir):
    _, c, b, parsed = _answers(spark, sf_dir)
    return enrich.described_columns(c, b, parsed).select("table_name", "ordinal", "description")


@query(
    "t8_table_texts",
    sql(
        "SELECT table_name, 'Table ' || table_name || ' with columns: ' || string_agg(column_name, ', ' ORDER BY ordinal) FILTER (ordinal <= 10) || '.' || "
        "CASE WHEN bool_or(pk) THEN ' Primary key(s): ent' || k || '_id.' ELSE '' END AS description FROM c GROUP BY table_name, k"
    ),
)
def table_texts(spark, sf_dir):
    ctx = keys.key_context(fleet.flat_columns(spark, sf_dir))
    names = F.transform("columns", lambda c: c["name"])
    return ctx.select(
        "table_name", enrich.table_text(F.col("table_name"), names, F.col("primary_keys")).alias("description")
    )


@query(
    "t9_column_texts",
    sql("SELECT table_name, ordinal, 'Column ' || column_name || ' in table ' || table_name || '.' AS description FROM c"),
)
def column_texts(spark, sf_dir):
    return fleet.flat_columns(spark, sf_dir).select(
        "table_name", "ordinal", enrich.column_text(F.col("table_name"), F.col("column_name")).alias("description")
    )


@query(
    "t10_combined_texts",
    sql(
        "SELECT table_name, ordinal, 'Table ' || table_name || ' containing business data.' AS of_table, "
        "'Details for ' || column_name || '.' AS of_column FROM c"
    ),
)
def combined_texts(spark, sf_dir):
    return fleet.flat_columns(spark, sf_dir).select(
        "table_name",
        "ordinal",
        enrich.combined_table_text(F.col("table_name")).alias("of_table"),
        enrich.combined_column_text(F.col("column_name")).alias("of_column"),
    )


@query(
    "y1_describe",
    bsql(
        "SELECT batch_no, table_name, 'Table ' || table_name || ' containing business data.' AS description, "
        "CAST(least(p_size, 50) AS INTEGER) AS n_columns, 'ok' AS status FROM bt"
    ),
)
def describe(spark, sf_dir):
    """A user function on every payload, in parallel; here the offline answer."""
    _, c, b = _batches(spark, sf_dir)
    answers = materialized(batches.describe(batches.payloads(b, c), enrich.offline_answer), "answers")
    parsed = enrich.parse_answers(answers)
    state = answers.select("batch_no", "status")
    return parsed.join(grown(state), "batch_no").select(
        "batch_no",
        "table_name",
        F.col("table_description").alias("description"),
        F.size("columns").alias("n_columns"),
        "status",
    )


# -- key inference on the catalogue -------------------------------------------------


@query("i1_tables_without_key", sql("SELECT table_name, ordinal FROM c WHERE k % 11 = 0"))
def tables_without_key(spark, sf_dir):
    return keys.without_primary(fleet.flat_columns(spark, sf_dir)).select("table_name", "ordinal")


def _inferred(spark, sf_dir):
    cols = keys.cleared(fleet.flat_columns(spark, sf_dir))
    return keys.apply_primary(cols, keys.infer_primary(cols))


@query(
    "i4_applied_keys",
    sql("SELECT table_name, ordinal, pk AS primary_key, CASE WHEN k % 11 = 0 AND ordinal = 1 THEN true END AS inferred_pk FROM c"),
)
def applied_keys(spark, sf_dir):
    return _inferred(spark, sf_dir).select("table_name", "ordinal", "primary_key", "inferred_pk")


@query(
    "i5_key_context",
    sql(
        "SELECT table_name, 'ent' || k || '_id' AS keys, count(*) AS n_columns FROM c GROUP BY table_name, k"
    ),
)
def key_context(spark, sf_dir):
    return keys.key_context(_inferred(spark, sf_dir)).select(
        "table_name", F.array_join("primary_keys", ",").alias("keys"), F.size("columns").cast("bigint").alias("n_columns")
    )


@query(
    "i6_best_parents",
    sql(
        f"SELECT table_name, column_name, {fleet.sql_table_of('parent')} AS parent_table, 'ent' || parent || '_id' AS parent_column "
        "FROM c WHERE ordinal = 2 AND k >= 2"
    ),
)
def best_parents(spark, sf_dir):
    """One parent per column from names alone."""
    return foreign_keys.best_parents(_inferred(spark, sf_dir)).select(
        "table_name", "column_name", "parent_table", "parent_column"
    )


def _fk_answers(spark, sf_dir):
    """Proposed foreign keys, some with a missing or unknown name."""
    k = F.col("k")
    target = F.when(k % 5 == 0, "nowhere").otherwise(F.upper(fleet.table_of(F.col("parent"))))
    column = F.when(k % 7 == 0, "c3").otherwise(F.concat(F.lit("ent"), F.col("parent").cast("string"), F.lit("_ID")))
    return fleet.columns(spark, sf_dir).filter("ordinal = 2 AND k >= 2").select(
        "system_name",
        F.upper("table_name").alias("source_table"),
        F.when(k % 13 == 0, "").when(k % 11 == 0, "none_such").otherwise(F.upper("column_name")).alias("source_column"),
        F.when(k % 3 == 0, F.concat(F.lit("s"), (F.col("parent") % 4).cast("string"))).alias("target_schema"),
        target.alias("target_table"),
        column.alias("target_column"),
    )


ANSWER_SQL = """,
a AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'target table not found' WHEN k % 11 = 0 THEN 'source column not found'
        WHEN k % 7 = 0 THEN 'target column is not a key' END AS reason FROM c WHERE ordinal = 2 AND k >= 2 AND k % 13 <> 0)
"""


@query("i8_complete_answers", sql(ANSWER_SQL + "SELECT upper(table_name) AS source_table FROM a"))
def complete_answers(spark, sf_dir):
    return foreign_keys.complete(_fk_answers(spark, sf_dir)).select("source_table")


@query(
    "i9_validated_answers",
    sql(
        ANSWER_SQL
        + "SELECT table_name, CASE WHEN k % 11 <> 0 THEN column_name END AS column_name, "
        "CASE WHEN k % 3 = 0 THEN 's' || (parent % 4) ELSE 'dbo' END AS target_schema, reason AS reject_reason FROM a"
    ),
)
def validated_answers(spark, sf_dir):
    checked = foreign_keys.validate(_fk_answers(spark, sf_dir), _inferred(spark, sf_dir))
    return checked.select("table_name", "column_name", "target_schema", "reject_reason")


@query(
    "j8_found_tables",
    sql(ANSWER_SQL + "SELECT table_name, schema_name FROM a"),
)
def found_tables(spark, sf_dir):
    checked = foreign_keys.validate(_fk_answers(spark, sf_dir), _inferred(spark, sf_dir))
    return checked.select("table_name", "schema_name")


@query(
    "i10_applied_answers",
    sql(
        ANSWER_SQL
        + f"SELECT table_name, ordinal, fk AS foreign_key, CASE WHEN ok THEN true END AS inferred_fk, "
        f"CASE WHEN ok THEN upper({fleet.sql_table_of('parent')}) END AS target_table FROM "
        "(SELECT c.*, NOT c.fk AND a.table_name IS NOT NULL AND a.reason IS NULL AS ok FROM c "
        "LEFT JOIN a ON a.table_name = c.table_name AND a.ordinal = c.ordinal)"
    ),
)
def applied_answers(spark, sf_dir):
    cols = _inferred(spark, sf_dir)
    valid = foreign_keys.validate(_fk_answers(spark, sf_dir), cols)
    return foreign_keys.apply_foreign(cols, valid).select(
        "table_name", "ordinal", "foreign_key", "inferred_fk", F.col("inferred_fk_references.table").alias("target_table")
    )


# -- loosely typed columns ------------------------------------------------------------


def _raw(spark, sf_dir):
    """Fleet columns as JSON of three shapes: native names, arrays, aliases."""
    c = fleet.columns(spark, sf_dir, annotated=True)
    text = lambda col: F.to_json(F.struct(col.alias("x")))
    quote = lambda col: F.regexp_extract(text(col), r'^\{"x":(.*)\}$', 1)
    flag = lambda col: F.when(F.col(col), "true").otherwise("false")
    name, kind = quote(F.col("column_name")), quote(F.col("data_type"))
    ref = F.when(
        F.col("references").isNotNull(), F.to_json("references")
    ).otherwise("null")
    inferred = F.when(
        F.col("inferred_fk_references").isNotNull(), F.to_json("inferred_fk_references")
    ).otherwise("null")
    native = F.concat(
        F.lit('{"column_name":'), name, F.lit(',"data_type":'), kind, F.lit(',"nullable":'), flag("nullable"),
        F.lit(',"primary_key":'), F.when(F.col("primary_key"), "1").otherwise("null"),
        F.lit(',"is_primary_key":true,"foreign_key":'), F.when(F.col("foreign_key"), '" Yes "').otherwise('"no"'),
        F.lit(',"references":'), ref, F.lit(',"inferred_fk":'), F.coalesce(F.col("inferred_fk"), F.lit(False)).cast("string"),
        F.lit(',"inferred_fk_references":'), inferred,
        F.lit(',"ai_description":"","column_description":"about","description":"other"}'),
    )
    last = F.when(F.col("ordinal") % 3 == 0, '"plain"').when(F.col("ordinal") % 3 == 1, "7").otherwise('"text",9')
    positional = F.concat(
        F.lit("["), name, F.lit(","), kind, F.lit(","), F.when(F.col("nullable"), '"YES"').otherwise('"x"'),
        F.lit(",false,"), flag("primary_key"), F.lit(","), F.when(F.col("foreign_key"), "1").otherwise("0"),
        F.lit(",null,"), last, F.lit("]"),
    )
    alias = F.concat(
        F.lit('{"column_name":'), name, F.lit(',"data_type":'), kind, F.lit(',"is_nullable":'),
        F.when(F.col("nullable"), '"YES"').otherwise("false"), F.lit(',"is_primary_key":'), flag("primary_key"),
        F.lit(',"is_foreign_key":'), flag("foreign_key"), F.lit(',"distinct_count":'), F.col("ordinal").cast("string"),
        F.lit(',"inferred_pk":'), F.when(F.col("inferred_pk"), '"y"').otherwise('""'), F.lit("}"),
    )
    shape = F.col("k") % 3
    json = F.when(shape == 0, native).when(shape == 1, positional).otherwise(alias)
    return c.select(
        *KEY, "k", (F.col("ordinal") - 1).alias("seq"), json.alias("json"), F.parse_json(json).alias("raw")
    )


def _norm(spark, sf_dir):
    return normalize.normalize_columns(_raw(spark, sf_dir))


@query(
    "n1_table_descriptions",
    sql("SELECT table_name, CASE WHEN k % 5 <> 0 THEN description WHEN k % 2 = 0 THEN 'by hand' ELSE '' END AS description, row_count FROM t"),
)
def table_descriptions(spark, sf_dir):
    t = fleet.tables(spark, sf_dir)
    raw = F.to_json(
        F.struct(
            "table_name", "table_type", "row_count",
            F.coalesce("description", F.lit("")).alias("description"),
            F.when(F.col("k") % 2 == 0, "by hand").alias("ai_description"),
        )
    )
    rows = t.select(
        "system_name", "schema_name", F.lit(0).alias("schema_seq"), F.lit(0).alias("table_seq"), F.parse_json(raw).alias("raw")
    )
    return normalize.normalize_tables(rows).select("table_name", "description", "row_count")


@query("n2_column_shapes", sql("SELECT table_name, ordinal, column_name, data_type FROM c"))
def column_shapes(spark, sf_dir):
    return _norm(spark, sf_dir).select("table_name", "ordinal", "column_name", "data_type")


@query("n3_key_flags", sql("SELECT table_name, ordinal, pk AS is_primary_key, fk AS is_foreign_key FROM c"))
def key_flags(spark, sf_dir):
    return _norm(spark, sf_dir).select("table_name", "ordinal", "is_primary_key", "is_foreign_key")


@query(
    "n4_reference_fields",
    sql(
        "SELECT table_name, ordinal, CASE WHEN k % 3 = 0 THEN ref_schema END AS fk_ref_schema, "
        "CASE WHEN k % 3 = 0 THEN ref_table END AS fk_ref_table, CASE WHEN k % 3 = 0 THEN ref_column END AS fk_ref_column FROM c"
    ),
)
def reference_fields(spark, sf_dir):
    return _norm(spark, sf_dir).select("table_name", "ordinal", "fk_ref_schema", "fk_ref_table", "fk_ref_column")


@query("n5_nullable_text", sql("SELECT table_name, ordinal, CASE WHEN nullable THEN 'YES' ELSE 'NO' END AS is_nullable FROM c"))
def nullable_text(spark, sf_dir):
    return _norm(spark, sf_dir).select("table_name", "ordinal", "is_nullable")


@query(
    "n6_column_descriptions",
    sql(
        "SELECT table_name, ordinal, CASE k % 3 WHEN 0 THEN 'about' WHEN 1 THEN CASE ordinal % 3 WHEN 0 THEN 'plain' WHEN 1 THEN '' ELSE 'text' END ELSE '' END AS description, "
        "CAST(CASE k % 3 WHEN 1 THEN CASE ordinal % 3 WHEN 1 THEN 7 WHEN 2 THEN 9 END WHEN 2 THEN ordinal END AS BIGINT) AS distinct_count FROM c"
    ),
)
def norm_descriptions(spark, sf_dir):
    return _norm(spark, sf_dir).select("table_name", "ordinal", "description", "distinct_count")


@query(
    "n7_inferred_fields",
    sql(
        "SELECT table_name, ordinal, k % 3 = 2 AND inf_pk AS inferred_pk, k % 3 = 0 AND inf_fk AS inferred_fk, "
        "CASE WHEN k % 3 = 0 THEN inf_table END AS inf_ref_table FROM ca"
    ),
)
def inferred_fields(spark, sf_dir):
    return _norm(spark, sf_dir).select("table_name", "ordinal", "inferred_pk", "inferred_fk", "inf_ref_table")


# -- documents and the store ------------------------------------------------------------


def _systems(spark):
    return spark.range(1).select(
        F.lit("fleet").alias("system_name"),
        F.lit("derived").alias("db_type"),
        F.lit("parts").alias("database"),
        F.lit("2024-05-06T07:08:09Z").alias("extracted_at"),
    )


# Tables of a document that is read as one row again; schemas of more have several documents.
TABLES_PER_PART = 500


def _saved(spark, sf_dir) -> str:
    t, c = flat(spark, sf_dir, True)
    docs = store.document_json(assemble.documents(t, c, TABLES_PER_PART), _systems(spark))
    return store.save_documents(docs, shared_dir(spark, "documents"), "fleet")


def _loaded(spark, sf_dir):
    docs = document_source.document_lines(spark, _saved(spark, sf_dir))
    return docs.withColumn("system_name", F.lit("fleet"))


@query(
    "k1_nested_tables",
    sql(
        "SELECT table_name, row_count, string_agg(column_name, ',' ORDER BY ordinal) AS columns FROM c JOIN t USING (table_name) GROUP BY ALL"
    ),
)
def nested_tables(spark, sf_dir):
    nested = assemble.table_documents(*flat(spark, sf_dir))
    names = F.transform("columns", lambda c: c["column_name"])
    return nested.select("table_name", "row_count", F.array_join(names, ",").alias("columns"))


@query("k1_documents", sql("SELECT schema_name, count(*) AS n_tables, min(table_name) AS first_table FROM t GROUP BY ALL"))
def documents(spark, sf_dir):
    docs = assemble.documents(*flat(spark, sf_dir), TABLES_PER_PART)
    first = F.get("tables", 0)["table_name"]
    return docs.groupBy("schema_name").agg(
        F.sum(F.size("tables")).alias("n_tables"), F.min(first).alias("first_table")
    )


# Documents as JSON text, one per schema, made of the same fields in the same order.
_DOCUMENT_SQL = f"""
, nested AS (
  SELECT system_name, schema_name, table_name, list({{'ordinal': ordinal, 'column_name': column_name, 'data_type': data_type,
    'nullable': nullable, 'unique': is_unique, 'is_generated': false, 'primary_key': pk, 'foreign_key': fk, 'distinct_count': NULL,
    'references': CASE WHEN ref_table IS NOT NULL THEN {{'schema': ref_schema, 'table': ref_table, 'column': ref_column}} END,
    'description': NULL, 'inferred_pk': CASE WHEN inf_pk THEN true END, 'inferred_fk': CASE WHEN inf_fk THEN true END,
    'inferred_fk_references': CASE WHEN inf_fk THEN {{'schema': 's' || (parent % 4), 'table': inf_table, 'column': 'ent' || parent || '_id'}} END
  }} ORDER BY ordinal) AS columns FROM ca GROUP BY ALL
),
listed AS (
  SELECT schema_name, list({{'table_name': table_name, 'table_type': table_type, 'row_count': row_count, 'size_bytes': size_bytes,
    'size': {SIZE_SQL}, 'description': description, 'columns': coalesce(columns, [])}} ORDER BY table_name) AS tables
  FROM t LEFT JOIN nested USING (system_name, schema_name, table_name) GROUP BY ALL
),
written AS (
  SELECT schema_name, to_json({{'source': {{'db_type': 'derived', 'database': 'parts', 'schema': schema_name,
    'extracted_at': '2024-05-06T07:08:09Z'}}, 'schemas': [{{'schema_name': schema_name, 'tables': tables}}]}})::VARCHAR AS doc FROM listed
)
"""


@query("k1_document_texts", sql(_DOCUMENT_SQL + "SELECT schema_name, sha256(doc) AS doc_sha256 FROM written"))
def document_texts(spark, sf_dir):
    """The whole text of every document, by digest."""
    pieces = store.document_pieces(assemble.document_tables(*flat(spark, sf_dir, True)), _systems(spark))
    return store.document_digests(pieces).select("schema_name", "doc_sha256")


@query(
    "k2_saved_documents",
    sql(_DOCUMENT_SQL + "SELECT schema_name, 1 AS n_files, strlen(doc) + 1 AS size_bytes FROM written"),
)
def saved_documents(spark, sf_dir):
    """A file per document, its size as the folder lists it: the text and one line end."""
    pieces = store.document_pieces(assemble.document_tables(*flat(spark, sf_dir, True)), _systems(spark))
    path = store.save_each_document_in_pieces(pieces, shared_dir(spark, "documents"), "fleet")
    schema = F.regexp_extract("saved_to", "/schema_name=([^/]+)/", 1).alias("schema_name")
    return store.saved_files(spark, path).groupBy(schema).agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes")
    )


@query("k2_saved_files")
def saved_files(spark, sf_dir):
    return store.saved_files(spark, _saved(spark, sf_dir)).select("filename", "size_bytes")


@query(
    "k3_summary",
    sql(
        "SELECT 'fleet' AS system_name, (SELECT count(*) FROM t) AS total_tables, (SELECT count(*) FROM c) AS total_columns, "
        "(SELECT string_agg(table_name, ',' ORDER BY schema_name, table_name) FROM "
        "(SELECT schema_name, table_name FROM t ORDER BY schema_name, table_name LIMIT 30)) AS preview"
    ),
)
def summary(spark, sf_dir):
    return assemble.summary(*flat(spark, sf_dir)).select(
        "system_name", "total_tables", "total_columns", F.array_join("table_names_preview", ",").alias("preview")
    )


@query("a27_read_documents", sql("SELECT schema_name, table_name, ordinal, column_name, pk AS is_primary_key FROM c"))
def read_documents(spark, sf_dir):
    """Saved documents read back and brought to the normal form."""
    raw = document_source.raw_tables(_loaded(spark, sf_dir))
    return normalize.normalize_columns(document_source.raw_columns(raw)).select(
        "schema_name", "table_name", "ordinal", "column_name", "is_primary_key"
    )


@query("f1_flatten_documents", sql("SELECT schema_name, table_name, table_type, row_count, coalesce(description, '') AS description FROM t"))
def flatten_documents(spark, sf_dir):
    raw = document_source.raw_tables(_loaded(spark, sf_dir))
    return normalize.normalize_tables(raw).select(
        "schema_name", "table_name", "table_type", "row_count", "description"
    )


@query(
    "k6_export_normalised",
    sql("SELECT table_name, count(*) AS n_columns, count(*) FILTER (pk) AS n_pk FROM ca GROUP BY ALL"),
)
def export_normalised(spark, sf_dir):
    """The normal form written as a document and read again."""
    t, c = flat(spark, sf_dir, True)
    docs = store.document_json(assemble.documents(t, normalize.normal_form(c), TABLES_PER_PART), _systems(spark))
    path = store.save_documents(docs, shared_dir(spark, "export"), "fleet", "gzip")
    found = document_source.document_lines(spark, path).withColumn("system_name", F.lit("fleet"))
    cols = normalize.normalize_columns(document_source.raw_columns(document_source.raw_tables(found)))
    return cols.groupBy("table_name").agg(
        F.count("*").alias("n_columns"), F.count_if("is_primary_key").alias("n_pk")
    )


def _store(spark, sf_dir, new: bool):
    """Systems derived from customers: all of them, or the refreshed and added ones."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    if new:
        c = c.filter("c_custkey % 2 = 0")
        key = F.when(key % 4 == 0, key + 1_000_000).otherwise(key)
    tag = "new" if new else "old"
    return c.select(
        F.concat(F.lit("sys"), key.cast("string")).alias("system_name"),
        F.concat(F.lit(f"{tag} "), "c_name").alias("owner_name"),
        F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("user_id"),
        F.col("c_mktsegment").alias("source_type"),
        F.lit("2024-02-01" if new else "2024-01-01").alias("added_at"),
        F.when(F.lit(new) | (F.col("c_custkey") % 3 != 0), F.concat(F.lit(tag), key.cast("string"))).alias("metadata"),
    )


STORE_SQL = """
WITH o AS (SELECT 'sys' || c_custkey AS system_name, 'old ' || c_name AS owner_name, 'u' || c_nationkey AS user_id, c_mktsegment AS source_type,
  '2024-01-01' AS added_at, CASE WHEN c_custkey % 3 <> 0 THEN 'old' || c_custkey END AS metadata FROM customer),
n0 AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS key FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT 'sys' || key AS system_name, 'new ' || c_name AS owner_name, 'u' || c_nationkey AS user_id, c_mktsegment AS source_type,
  '2024-02-01' AS added_at, 'new' || key AS metadata FROM n0),
s AS (SELECT coalesce(o.system_name, n.system_name) AS system_name, coalesce(o.owner_name, n.owner_name) AS owner_name,
  coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.source_type, n.source_type) AS source_type,
  coalesce(n.added_at, o.added_at) AS added_at, CASE WHEN n.system_name IS NOT NULL THEN n.metadata ELSE o.metadata END AS metadata
  FROM o FULL JOIN n ON o.system_name = n.system_name)
"""


@query("k4_upsert", STORE_SQL + "SELECT * FROM s")
def upsert(spark, sf_dir):
    return store.upsert(_store(spark, sf_dir, False), _store(spark, sf_dir, True))


@query("a28_read_store", STORE_SQL + "SELECT * FROM s")
def read_store(spark, sf_dir):
    """Two versions written one after the other; the newest is read."""
    directory = shared_dir(spark, "store")
    for fresh in (False, True):
        store.upsert_store(spark, directory, _store(spark, sf_dir, fresh))
    return store.read_store(spark, directory)


@query("k5_find_system", STORE_SQL + "SELECT * FROM o WHERE system_name = 'sys7'")
def find_system(spark, sf_dir):
    return store.find(_store(spark, sf_dir, False), "sys7")


@query(
    "k7_request_status",
    STORE_SQL
    + "SELECT DISTINCT 'sys' || (o_custkey * 2) AS system_name, CASE WHEN o.system_name IS NULL THEN 'not found' "
    "WHEN o.metadata IS NULL THEN 'no metadata' ELSE 'ok' END AS status FROM orders LEFT JOIN o ON o.system_name = 'sys' || (o_custkey * 2)",
)
def request_status(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("sys"), (F.col("o_custkey") * 2).cast("string")).alias("system_name")
    )
    return store.request_status(asked, _store(spark, sf_dir, False))
