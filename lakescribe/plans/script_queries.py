"""Queries over the derived script corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescribe.functions import ddl_text as D
from lakescribe.operators import batches, ddl
from lakescribe.operators.ordering import row_numbers
from lakescribe.operators.skew import grown
from lakescribe.plans import script_corpus
from lakescribe.plans.registry import query
from lakescribe.session import shared_dir
from lakescribe.sources import lake, scripts as script_source


def sql(body: str) -> str:
    return script_corpus.SQL + body


def texts(spark, sf_dir):
    found = script_corpus.encoded(script_corpus.scripts(spark, sf_dir))
    return script_source.decode_scripts(found)


def stmts(spark, sf_dir):
    return ddl.statements(texts(spark, sf_dir))


def stored(spark, sf_dir):
    return ddl.written(stmts(spark, sf_dir))


_K = "lpad(CAST(k AS VARCHAR), 12, '0')"
_HAS_FK = "(k >= 2 AND k % 2 = 0 AND p_size >= 2)"


@query("d1_decode", sql(f"SELECT {_K} AS path, true AS same FROM t"))
def decode(spark, sf_dir):
    """Five encodings give the text they were made from."""
    found = script_corpus.encoded(script_corpus.scripts(spark, sf_dir))
    original = found.select(
        "path",
        F.when(F.col("k") % 5 == 4, F.concat("script", F.lit("-- é"))).otherwise(F.col("script")).alias("script"),
    )
    return (
        script_source.decode_scripts(found)
        .join(grown(original), "path")
        .select("path", (F.col("text") == D.unix_lines(F.col("script"))).alias("same"))
    )


@query("d2_line_ends", sql(f"SELECT {_K} AS path, false AS has_cr, true AS has_lf FROM t"))
def line_ends(spark, sf_dir):
    text = D.unix_lines(F.col("script"))
    return script_corpus.scripts(spark, sf_dir).select(
        "path", text.contains("\r").alias("has_cr"), text.contains("\n").alias("has_lf")
    )


@query(
    "d3_comments",
    sql(f"SELECT {_K} AS path, false AS has_line, false AS has_block, true AS keeps_literal FROM t"),
)
def comments(spark, sf_dir):
    text = D.strip_comments(F.col("text"))
    return texts(spark, sf_dir).select(
        "path",
        text.contains("it's one").alias("has_line"),
        text.contains("block").alias("has_block"),
        text.contains("'a;b -- c'").alias("keeps_literal"),
    )


@query("d4_batch_lines", sql(f"SELECT {_K} AS path, 2 AS n_batches FROM t"))
def batch_lines(spark, sf_dir):
    changed = D.batch_separators(F.col("text"))
    return texts(spark, sf_dir).select(
        "path",
        (F.regexp_count("text", F.lit("(?im)^go$")) - F.regexp_count(changed, F.lit("(?im)^go$"))).alias("n_batches"),
    )


# Scripts made of the documents, so that every row has a text of its own to get right.


def _documents(spark, sf_dir):
    return lake.frames(spark, sf_dir, ["documents"])["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _told(text) -> list:
    return ["doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256")]


def _told_sql(text: str) -> str:
    return f"SELECT doc_id, CAST(length({text}) AS BIGINT) AS n_chars, sha256({text}) AS text_sha256 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)"


@query("d1_decoded_texts", _told_sql(r"regexp_replace('-- ' || doc_id || chr(10) || x, '\r\n?', chr(10), 'g')"))
def decoded_texts(spark, sf_dir):
    """Documents as scripts in UTF-16 with and without a mark, UTF-8 with and without one."""
    which, text = F.col("doc_id") % 4, F.concat(F.lit("-- "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    content = (
        F.when(which == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(which == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(which == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    made = _documents(spark, sf_dir).withColumns(
        {"system_name": F.lit("x"), "path": F.col("doc_id").cast("string"), "content": content}
    )
    found = script_source.decode_scripts(made.select("system_name", "path", "content"))
    return found.withColumn("doc_id", F.col("path").cast("long")).select(*_told(F.col("text")))


@query("d2_line_end_texts", _told_sql("replace(replace(x, chr(13), chr(10)), '.', '.' || chr(10)) || chr(10) || doc_id"))
def line_end_texts(spark, sf_dir):
    """Sentences end in a pair of line ends, and the text in a single old one."""
    given = F.concat(F.replace("text", F.lit("."), F.lit(".\r\n")), F.lit("\r"), F.col("doc_id").cast("string"))
    return _documents(spark, sf_dir).select(*_told(D.unix_lines(given)))


_LITERAL_SQL = "replace(x, chr(39), chr(39) || chr(39))"


@query(
    "d3_stripped_texts",
    _told_sql(f"'SELECT ' || chr(39) || {_LITERAL_SQL} || ' -- /* ' || chr(39) || ', ' || doc_id || ' ' || chr(10) || ' AS n '"),
)
def stripped_texts(spark, sf_dir):
    """Documents as literals with what looks like comments, followed by comments with what looks like literals."""
    number = F.col("doc_id").cast("string")
    given = F.concat(
        F.lit("SELECT '"), F.replace("text", F.lit("'"), F.lit("''")), F.lit(" -- /* ', "), number, F.lit(" -- it's "), number,
        F.lit("\n/* 'one' -- "), number, F.lit(" */AS n "),
    )
    return _documents(spark, sf_dir).select(*_told(D.strip_comments(given)))


@query(
    "d4_batched_texts",
    _told_sql("replace(x, chr(10), ' ') || chr(10) || ';' || chr(10) || doc_id || ' go' || chr(10) || ';' || chr(10) || 'gone'"),
)
def batched_texts(spark, sf_dir):
    """Lines that hold nothing but GO, and others with more."""
    given = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nGO\n"), F.col("doc_id").cast("string"), F.lit(" go\n \tgo \ngone"))
    return _documents(spark, sf_dir).select(*_told(D.batch_separators(given)))


@query("d5_statements", sql(f"SELECT {_K} AS path, 3 + CAST({_HAS_FK} AS INTEGER) AS n_statements, true AS insert_whole FROM t"))
def statements(spark, sf_dir):
    return (
        stmts(spark, sf_dir)
        .groupBy("path")
        .agg(
            F.count("*").cast("int").alias("n_statements"),
            F.bool_or(F.col("stmt") == "INSERT INTO log VALUES ('a;b -- c', 'CREATE TABLE x (y INT)')").alias("insert_whole"),
        )
    )


@query(
    "d6_ddl_filter",
    sql(f"SELECT {_K} AS path, 1 AS n_create, CAST({_HAS_FK} AS INTEGER) AS n_alter, 1 + CAST({_HAS_FK} AS INTEGER) AS n_ddl FROM t"),
)
def ddl_filter(spark, sf_dir):
    kind = F.col("kind")
    return (
        stmts(spark, sf_dir)
        .groupBy("path")
        .agg(
            F.count_if(kind == "create").cast("int").alias("n_create"),
            F.count_if(kind == "alter").cast("int").alias("n_alter"),
            F.count_if("is_ddl").cast("int").alias("n_ddl"),
        )
    )


@query("d7_reduction", sql(f"SELECT {_K} AS path, true AS smaller FROM t"))
def reduction(spark, sf_dir):
    found = texts(spark, sf_dir)
    return ddl.reduction(found, ddl.statements(found)).select(
        "path", ((F.col("reduction") > 0) & (F.col("ddl_chars") < F.col("script_chars"))).alias("smaller")
    )


@query("d8_database", sql(f"SELECT {_K} AS path, 'fleet' || (k % 3) AS database FROM t"))
def database(spark, sf_dir):
    per_file = stmts(spark, sf_dir).withColumn("system_name", F.col("path"))
    return ddl.databases(per_file).select(F.col("system_name").alias("path"), "database")


@query("d9_table_names", sql("SELECT DISTINCT schema_name, table_name FROM sc"))
def table_names(spark, sf_dir):
    return ddl.creates(stmts(spark, sf_dir), "dbo").select("schema_name", "table_name")


@query("d10_bodies", sql("SELECT table_name, true AS whole FROM (SELECT DISTINCT table_name FROM sc)"))
def bodies(spark, sf_dir):
    body = D.create_body(F.col("bare"))
    return ddl.creates(stmts(spark, sf_dir), "dbo").select(
        "table_name", (body.startswith(" [ent") | body.startswith("[ent")).alias("whole")
    )


_ITEMS = "count(*) + CAST(k % 11 <> 0 AS INTEGER) + CAST(k % 5 = 0 AS INTEGER)"


@query("d11_items", sql(f"SELECT table_name, CAST({_ITEMS} AS INTEGER) AS n_items FROM sc GROUP BY table_name, k"))
def items(spark, sf_dir):
    return ddl.creates(stmts(spark, sf_dir), "dbo").select(
        "table_name", F.size(D.body_items(D.create_body(F.col("bare")))).alias("n_items")
    )


@query("d12_constraint_items", sql("SELECT table_name, CAST(k % 11 <> 0 AS INTEGER) + CAST(k % 5 = 0 AS INTEGER) AS n_constraints FROM sc GROUP BY table_name, k"))
def constraint_items(spark, sf_dir):
    found = F.filter(D.body_items(D.create_body(F.col("bare"))), lambda i: D.is_constraint(i))
    return ddl.creates(stmts(spark, sf_dir), "dbo").select("table_name", F.size(found).alias("n_constraints"))


def _catalog(spark, sf_dir):
    found = stored(spark, sf_dir)
    return ddl.catalog(found, "dbo", ddl.written_items(found))[1]


@query("d13_names", sql("SELECT table_name, ordinal, column_name FROM sc"))
def names(spark, sf_dir):
    return _catalog(spark, sf_dir).select("table_name", "ordinal", "column_name")


@query("d14_types", sql("SELECT table_name, ordinal, data_type FROM sc"))
def types(spark, sf_dir):
    return _catalog(spark, sf_dir).select("table_name", "ordinal", "data_type")


@query("d15_flags", sql("SELECT table_name, ordinal, nullable, is_generated FROM sc"))
def flags(spark, sf_dir):
    return _catalog(spark, sf_dir).select("table_name", "ordinal", "nullable", "is_generated")


@query(
    "d16_inline_references",
    sql("SELECT table_name, column_name, ref_schema, ref_table, ref_column FROM sc WHERE ref_schema = 'dbo'"),
)
def inline_references(spark, sf_dir):
    ref = F.col("references")
    return (
        _catalog(spark, sf_dir)
        .filter(ref["schema"] == "dbo")
        .select("table_name", "column_name", ref["schema"].alias("ref_schema"), ref["table"].alias("ref_table"),
                ref["column"].alias("ref_column"))
    )


@query("d17_table_keys", sql("SELECT table_name, ordinal, primary_key, is_unique FROM sc"))
def table_keys(spark, sf_dir):
    return _catalog(spark, sf_dir).select("table_name", "ordinal", "primary_key", F.col("unique").alias("is_unique"))


@query("d19_altered_keys", sql("SELECT table_name, ordinal, foreign_key, ref_schema, ref_table, ref_column FROM sc"))
def altered_keys(spark, sf_dir):
    ref = F.col("references")
    return _catalog(spark, sf_dir).select(
        "table_name", "ordinal", "foreign_key", ref["schema"].alias("ref_schema"), ref["table"].alias("ref_table"),
        ref["column"].alias("ref_column"),
    )


@query(
    "d18_paired_keys",
    sql("SELECT 't' || k || '.' || v.c AS child, 's' || (k % 4) || '.p' || k || '.' || v.p AS parent FROM t CROSS JOIN (VALUES ('a', 'x'), ('b', 'y')) v(c, p)"),
)
def paired_keys(spark, sf_dir):
    """Composite keys pair by position; the third child column has no partner."""
    k = F.col("k").cast("string")
    schema = F.concat(F.lit("s"), (F.col("k") % 4).cast("string"))
    made = script_corpus.scripts(spark, sf_dir).select(
        "system_name",
        "path",
        F.concat(
            F.lit("CREATE TABLE t"), k, F.lit(" (a INT, b INT, c INT, FOREIGN KEY (a, [b], c) REFERENCES "),
            schema, F.lit(".p"), k, F.lit(" (x, y))"),
        ).alias("text"),
    )
    keys = ddl.key_rows(ddl.written(ddl.statements(made)))
    ref = F.col("references")
    return keys.select(
        F.concat_ws(".", "table_name", "column_name").alias("child"),
        F.concat_ws(".", ref["schema"], ref["table"], ref["column"]).alias("parent"),
    )


@query(
    "d19_several_keys",
    sql(
        "SELECT 't' || k AS table_name, v.kind, v.c AS child, 's' || (k % 4) || v.p AS parent FROM t CROSS JOIN (VALUES "
        "('FK', 'a', '.p.x'), ('FK', 'b', '.q.y'), ('FK', 'c', '.q.z'), ('UQ', 'd', NULL), ('PK', 'e', NULL)) v(kind, c, p)"
    ),
)
def several_keys(spark, sf_dir):
    """One ALTER adds five keys in four constraints, and drops a column between them."""
    k, schema = F.col("k").cast("string"), F.concat(F.lit("s"), (F.col("k") % 4).cast("string"))
    made = script_corpus.scripts(spark, sf_dir).select(
        "system_name",
        "path",
        F.concat(
            F.lit("CREATE TABLE t"), k, F.lit(" (a INT, b INT, c INT, d INT, e INT); ALTER TABLE t"), k,
            F.lit(" ADD CONSTRAINT f1 FOREIGN KEY (a) REFERENCES "), schema,
            F.lit(".p (x), CONSTRAINT f2 FOREIGN KEY (b, [c]) REFERENCES "), schema,
            F.lit(".q (y, z), UNIQUE (d), DROP COLUMN old, ADD PRIMARY KEY (e)"),
        ).alias("text"),
    )
    ref = F.col("references")
    return ddl.key_rows(ddl.written(ddl.statements(made))).select(
        "table_name",
        "kind",
        F.col("column_name").alias("child"),
        F.when(ref.isNotNull(), F.concat_ws(".", ref["schema"], ref["table"], ref["column"])).alias("parent"),
    )


@query(
    "d20_catalogue",
    sql("SELECT schema_name, table_name, count(*) AS n_columns, count(*) FILTER (primary_key) AS n_pk, count(*) FILTER (foreign_key) AS n_fk FROM sc GROUP BY ALL"),
)
def catalogue(spark, sf_dir):
    found = stored(spark, sf_dir)
    tables, columns = ddl.catalog(found, "dbo", ddl.written_items(found))
    per_table = columns.groupBy("schema_name", "table_name").agg(
        F.count("*").alias("n_columns"), F.count_if("primary_key").alias("n_pk"), F.count_if("foreign_key").alias("n_fk")
    )
    return tables.select("schema_name", "table_name").join(grown(per_table), ["schema_name", "table_name"])


@query(
    "d21_unparsed",
    sql(f"SELECT {_K} AS path, CASE WHEN k % 3 = 0 THEN 'no ddl' ELSE 'ddl without a readable table' END AS reason FROM t WHERE k % 3 <> 1"),
)
def unparsed(spark, sf_dir):
    """Some scripts hold no DDL, some a statement that is not readable."""
    k = F.col("k")
    made = script_corpus.scripts(spark, sf_dir).select(
        "system_name",
        "path",
        F.when(k % 3 == 0, F.lit("SELECT 1; GRANT x TO y"))
        .when(k % 3 == 2, F.lit("CREATE TABLE AS SELECT 1"))
        .otherwise(F.col("script"))
        .alias("text"),
    )
    return ddl.unparsed(made, ddl.statements(made)).select("path", "reason")


@query("g8_primary_schema", sql("SELECT 's' || (min(k) % 4) AS primary_schema FROM t"))
def primary_schema(spark, sf_dir):
    return ddl.primary_schema(stmts(spark, sf_dir)).select("primary_schema")


@query(
    "w4_last_create",
    sql(
        "SELECT 'ent' || (k // 3) AS table_name, 'v' || max(k) AS column_name, CAST(max(k) % 2 = 0 AS BOOLEAN) AS primary_key "
        "FROM t GROUP BY k // 3"
    ),
)
def last_create(spark, sf_dir):
    """Three scripts create each table; the last counts, and only its ALTER applies."""
    k = F.col("k")
    name = F.concat(F.lit("ent"), F.floor(k / 3).cast("string"))
    column = F.concat(F.lit("v"), k.cast("string"))
    made = script_corpus.scripts(spark, sf_dir).select(
        "system_name",
        "path",
        F.concat(
            F.lit("CREATE TABLE "), name, F.lit(" ("), column, F.lit(" INT);"),
            F.when(k % 2 == 0, F.concat(F.lit("ALTER TABLE dbo."), name, F.lit(" ADD PRIMARY KEY ("), column, F.lit(")"))).otherwise(""),
        ).alias("text"),
    )
    _, columns = ddl.catalog(ddl.written(ddl.statements(made)))
    return columns.select("table_name", "column_name", "primary_key")


@query(
    "w2_statement_chunks",
    sql(
        "SELECT 'f' || (k % 7) AS path, rn // 15 AS chunk_no, count(*) AS n_statements FROM "
        f"(SELECT k, row_number() OVER (PARTITION BY k % 7 ORDER BY k, s) - 1 AS rn FROM t, unnest(range(1 + CAST({_HAS_FK} AS INTEGER))) u(s)) GROUP BY ALL"
    ),
)
def statement_chunks(spark, sf_dir):
    """DDL of seven large files in chunks of fifteen."""
    # written first: rows are numbered over several passes
    kept = stored(spark, sf_dir).filter("is_ddl").select(
        "system_name",
        F.concat(F.lit("f"), (F.col("path").cast("bigint") % 7).cast("string")).alias("path"),
        F.col("path").alias("script"),
        "stmt_idx",
        "stmt",
    )
    numbered = row_numbers(kept, ["system_name", "path"], ["script", "stmt_idx"], "_n").withColumn(
        "stmt_idx", F.col("_n") - 1
    )
    return batches.statement_chunks(numbered).select("path", "chunk_no", "n_statements")


@query("u3_merged_chunks", sql("SELECT DISTINCT schema_name, table_name FROM sc"))
def merged_chunks(spark, sf_dir):
    found = stmts(spark, sf_dir)
    halves = [ddl.creates(found.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == h), "dbo") for h in (0, 1)]
    return halves[0].unionByName(halves[1]).select("schema_name", "table_name")


def _files(spark, sf_dir) -> str:
    """The corpus as files, 64 scripts or so in each."""
    path = shared_dir(spark, "scripts")
    made = script_corpus.scripts(spark, sf_dir)
    n = F.concat(F.lit("f"), F.floor(F.col("k") / 64).cast("string"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("k", "script"))), lambda s: s["script"])
    made.groupBy(n.alias("f")).agg(F.array_join(lines, "\n").alias("value")).select("value").write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    return path


@query("a29_script_files", sql("SELECT schema_name, table_name, count(*) AS n_columns FROM sc GROUP BY ALL"))
def script_files(spark, sf_dir):
    found = ddl.written(ddl.statements(script_source.read_scripts(spark, _files(spark, sf_dir))))
    return ddl.catalog(found, "dbo", ddl.written_items(found))[1].groupBy("schema_name", "table_name").agg(F.count("*").alias("n_columns"))


@query("u2_merged_files", sql("SELECT table_name, ordinal, ref_table FROM sc WHERE foreign_key"))
def merged_files(spark, sf_dir):
    """All files count as one corpus: keys may come from other files."""
    found = ddl.written(ddl.statements(script_source.read_scripts(spark, _files(spark, sf_dir))))
    return ddl.catalog(found, "dbo", ddl.written_items(found))[1].filter("foreign_key").select(
        "table_name", "ordinal", F.col("references.table").alias("ref_table")
    )
