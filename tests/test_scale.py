"""What must not grow with the catalogue: broadcasts, rows of documents, work per script."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lakescribe.functions import ddl_text as D
from lakescribe.operators import assemble, ddl, normalize, search, store
from lakescribe.plans import QUERIES, fleet, script_queries, text_queries


@pytest.fixture(scope="module")
def fleet_dir(spark, tmp_path_factory):
    """A fleet of forty tables; its file is small, as are those of much larger fleets."""
    path = str(tmp_path_factory.mktemp("fleet"))
    key = F.col("id")
    spark.range(40).select(
        key.alias("p_partkey"), (key % 7 + 1).cast("int").alias("p_size"), F.concat(F.lit("part "), key).alias("p_name"),
        (key * 1.5).alias("p_retailprice"),
    ).write.parquet(os.path.join(path, "part.parquet"))
    return path


@pytest.mark.parametrize(
    "name",
    "a25_sqlserver_statistics d1_decode p5_decode_distinct y1_describe i9_validated_answers j4_assembled_columns "
    "i10_applied_answers t1_payloads w5_best_match j8_found_tables".split(),
)
def test_no_catalogue_passes_through_the_driver(spark, fleet_dir, name):
    plan = QUERIES[name](spark, fleet_dir)._jdf.queryExecution().executedPlan().toString()
    # lists of schemas may be broadcast, nothing else
    sent = [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "schema_id" not in line and "relnamespace" not in line]
    assert "SortMergeJoin" in plan and not sent


def _texts(tables, columns, systems):
    docs = store.document_json(assemble.documents(tables, columns), systems)
    return {(r.system_name, r.schema_name): r.doc for r in docs.collect()}


def test_documents_in_pieces_are_the_whole_texts(spark, fleet_dir):
    t = fleet.flat_tables(spark, fleet_dir)
    t = t.unionByName(t.filter("table_name like '%7'"))  # tables of one name
    c, systems = fleet.flat_columns(spark, fleet_dir, True), text_queries._systems(spark)
    whole = _texts(t, c, systems)
    pieces = store.document_pieces(assemble.document_tables(t, c, rows_per_range=7), systems)
    longest = pieces.agg(F.max(F.length("piece"))).first()[0]
    assert longest < min(map(len, whole.values())) / 2  # a row is a table, whatever the schema
    got = {(r.system_name, r.schema_name): r.doc_sha256 for r in store.document_digests(pieces.repartition(5, "piece")).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in whole.items()}


def test_files_of_documents_in_pieces(spark, fleet_dir, tmp_path):
    """Files have the whole texts, also of schemas without a name, though no row does."""
    t, c = fleet.flat_tables(spark, fleet_dir), fleet.flat_columns(spark, fleet_dir, True)
    for schema, name in (("s1", None), ("s2", "")):
        t, c = [df.withColumn("schema_name", F.when(F.col("schema_name") == schema, name).otherwise(F.col("schema_name"))) for df in (t, c)]
    systems = text_queries._systems(spark)
    rows = assemble.document_tables(t, c, rows_per_range=7)
    pieces = store.document_pieces(rows, systems).repartition(5, "piece")
    path = store.save_each_document_in_pieces(pieces, str(tmp_path), "run")
    files = {r.saved_to: r.size_bytes for r in store.saved_files(spark, path).collect()}
    got = sorted(r.value for r in spark.read.text(path).collect() if r.value)
    expected = [r.doc for r in store.document_pieces(rows, systems).groupBy("schema_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("doc")).collect()]
    assert got == sorted(expected) and len(got) == 4 and len(files) == 3
    assert sum(files.values()) == sum(len(text.encode()) + 1 for text in got)


def test_saved_documents_have_bounded_rows(spark, fleet_dir, monkeypatch):
    monkeypatch.setattr(text_queries, "TABLES_PER_PART", 3)
    read = spark.read.text(text_queries._saved(spark, fleet_dir))
    assert read.count() == 16  # four schemas of ten tables
    assert QUERIES["f1_flatten_documents"](spark, fleet_dir).count() == 40
    n = QUERIES["k1_documents"](spark, fleet_dir).collect()
    assert sorted((r.schema_name, r.n_tables) for r in n) == [(f"s{i}", 10) for i in range(4)]


def test_bodies_of_any_nesting(spark):
    """Flat bodies take a short way; it gives what the count of parentheses gives."""
    bodies = ["a INT, b DECIMAL(10, 2), CHECK ((a) > (b))", "a INT, CHECK (((a, (b))), c INT), d", "a INT, (b, c", "", " ,a,, b ,", "a) , b"]
    rest = {"a) , b": "a"}
    rows = spark.createDataFrame([(i, f"CREATE TABLE t ({b}) ON [x](y)") for i, b in enumerate(bodies)], "i int, bare string")
    got = {r.i: r.items for r in rows.select("i", D.body_items(D.create_body(F.col("bare"))).alias("items")).collect()}
    expected = {}
    for i, body in enumerate(bodies):
        text, depth, items, one = f"{rest.get(body, body)}) ON [x](y)", 0, [], ""
        for x in text:
            depth += (x == "(") - (x == ")")
            if depth < 0:
                break
            if x == "," and depth == 0:
                items.append(one)
                one = ""
            else:
                one += x
        expected[i] = [x.strip() for x in [*items, one] if x.strip()] if body else None
    assert got == expected
    plan = rows.select(D.body_items(D.create_body(F.col("bare"))).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CREATE") == 1  # the statement is searched once


def test_an_export_is_whole_and_compressed(spark, fleet_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(text_queries, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(text_queries, "TABLES_PER_PART", 1)
    monkeypatch.setattr(store, "DOCUMENTS_PER_FILE", 4, raising=False)
    found = {r.table_name: (r.n_columns, r.n_pk) for r in QUERIES["k6_export_normalised"](spark, fleet_dir).collect()}
    expected = fleet.flat_columns(spark, fleet_dir).groupBy("table_name").agg(F.count("*").alias("n"), F.count_if("primary_key").alias("p"))
    assert found == {r.table_name: (r.n, r.p) for r in expected.collect()} and len(found) == 40
    (path,) = (tmp_path / "export").iterdir()
    lines = spark.read.text(str(path))
    assert lines.count() == 40  # a document per table here
    files = store.saved_files(spark, str(path)).collect()
    assert len(files) >= 10 and sum(r.size_bytes for r in files) < lines.agg(F.sum(F.octet_length("value"))).first()[0] / 2


def test_a_page_lists_only_the_ranges_it_touches(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    search.write_page_index(df, str(tmp_path / "i"), ["id"], rows_per_range=10)
    page = search.indexed_page(spark, str(tmp_path / "i"), 7, 5, ["id"])
    assert [tuple(r) for r in page.collect()] == [(i, 2 * i) for i in range(30, 35)]
    assert len(page.inputFiles()) <= 2
    folders = {os.path.basename(os.path.dirname(f)) for f in page.inputFiles()}
    relation = page._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation()
    assert folders and relation.location().rootPaths().size() == len(folders)


def test_an_index_has_few_files_of_many_ranges(spark, tmp_path, monkeypatch):
    """Files don't grow with the ranges, and of a file only the pages of the ranges touched are read."""
    df = spark.range(3000).select(F.when(F.col("id") != 5, (F.col("id") * 7919) % 3000).alias("id"), F.lit("x").alias("v"))
    search.write_page_index(df, str(tmp_path / "one"), ["id"], rows_per_range=50)
    monkeypatch.setattr(search, "ROWS_PER_FILE", 500, raising=False)
    search.write_page_index(df, str(tmp_path / "some"), ["id"], rows_per_range=50)
    written = {n: [f for _, _, fs in os.walk(tmp_path / n / "rows") for f in fs if f.endswith(".parquet")] for n in ("one", "some")}
    assert len(written["one"]) == 1 and 2 <= len(written["some"]) <= 6
    expected = sorted(((r.id, r.v) for r in df.collect()), key=lambda r: -1 if r[0] is None else r[0])
    for name in written:
        for number, size in [(1, 10), (7, 60), (43, 70), (2, 2000), (9, 500)]:
            page = search.indexed_page(spark, str(tmp_path / name), number, size, ["id"])
            assert [tuple(r) for r in page.collect()] == expected[(number - 1) * size : number * size]
            scan = page._jdf.queryExecution().executedPlan().collectLeaves().head()
            assert scan.metrics().apply("numOutputRows").value() <= size + 100


def test_facts_of_statements_are_read_once(spark, fleet_dir):
    """Keys, columns and chunks come from written tables, not from scripts or statements parsed again."""
    found = script_queries.stored(spark, fleet_dir)
    _, columns = ddl.catalog(found, "dbo", ddl.written_items(found))
    plan = columns._jdf.queryExecution().optimizedPlan().toString()
    assert "CREATE" not in plan and "^ALTER" not in plan
    chunks = QUERIES["w2_statement_chunks"](spark, fleet_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in chunks.lower() and "p_partkey" not in chunks


def test_patterns_stay_cheap(spark):
    """No class of all characters over a whole body, and what is rare is looked for before it is matched."""
    row = spark.createDataFrame([("CREATE TABLE a (b INT)", "INT REFERENCES [x].[y] (z)")], "bare string, rest string")
    plan = row.select(D.create_body(F.col("bare")))._jdf.queryExecution().analyzed().toString()
    assert r"[\s\S]*+" not in plan
    got = row.select(D.inline_reference(F.col("rest"), "dbo").alias("r")).first().r
    assert tuple(got) == ("x", "y", "z")


def test_white_space_of_unicode(spark):
    """Blanks of any kind are trimmed and made one, in texts with and without other characters beyond ASCII."""
    white = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    rows = [(0, f"{white}a {white} b{white};;{white}"), (1, "\ta\r\n  b \x1cc\n"), (2, "é\u200b a")]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: (r.s, r.b) for r in df.select("i", D.statements_of(F.col("text")).alias("s"), D.without_literals(F.col("text")).alias("b")).collect()}
    assert got[0] == ([f"a {white} b"], "a b ;;")
    assert got[1] == (["a\r\n  b \x1cc"], "a b \x1cc")
    assert got[2] == (["é\u200b a"], "é\u200b a")


def test_loose_columns_are_parsed_once(spark, fleet_dir):
    """Rows of other shapes go without a filter that Spark would move below the parser."""
    for name in ("n2_column_shapes", "n4_reference_fields"):
        plan = QUERIES[name](spark, fleet_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and "SchemaOfVariant" not in plan
    texts = ['{"column_name":"a"}', "{}", '["b","INT"]', "[]", '"[1]"', "7", "true", "null", None]
    rows = spark.createDataFrame([("s", "x", "t", i, v) for i, v in enumerate(texts)], "system_name string, schema_name string, table_name string, seq int, j string")
    got = normalize.normalize_columns(rows.withColumn("raw", F.parse_json("j")).drop("j")).select("ordinal", "column_name", "data_type")
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, None, None), (3, "b", "INT"), (4, None, None)]


def test_columns_are_not_sorted_for_their_keys(spark, fleet_dir):
    """Keys and tables are hashed, and the few systems sent along: no task sorts columns or gathers those of a system."""
    plan = QUERIES["a19_unknown_keys"](spark, fleet_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    joins = [line.lstrip(" :+-") for line in plan if "Join [" in line]
    assert joins[0].startswith("BroadcastHashJoin [system_name")
    assert len(joins[1:5]) == 4 and all(j.startswith("ShuffledHashJoin") and "BuildRight" in j for j in joins[1:5])
