import json
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe import model
from lakescribe.functions import scalars
from lakescribe.operators import (
    assemble, batches, ddl, enrich, foreign_keys, graph, inclusion, keys, normalize, ordering, profile, relate, search, skew, stats, store,
)
from lakescribe.session import materialized
from lakescribe.sources import dialects, documents

KEY = model.TABLE_KEY


def test_running_totals_over_ranges(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") * 7919 % 4001).alias("o"),
    )
    totals = {"n": ("sum", F.lit(1)), "low": ("min", F.struct((F.col("o") % 97).alias("a"), "o"))}
    whole = sorted(ordering.running(df, ["g"], ["o"], totals).collect())
    cut = sorted(ordering.running(df, ["g"], ["o"], totals, rows_per_range=150).collect())
    assert cut == whole


def test_lookup_equals_join(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k49", 3), ("none", 4)], "k string, v int")
    for how in ("left", "inner", "left_semi"):
        expected = sorted(map(str, left.join(right, "k", how).select("id", "k").collect()))
        assert sorted(map(str, skew.lookup(left, right, ["k"], how).select("id", "k").collect())) == expected


def test_hot_key_is_split(spark):
    """One key on half of the rows: adaptive execution cuts its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    left = spark.range(0, 60000, 1, 8).select(
        "id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k")
    )
    right = spark.range(0, 60000, 1, 8).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = skew.lookup(left, right, ["k"])
        assert sum(r.v for r in found.collect()) == 30000 + sum(range(2, 60001, 2))
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_payloads_hold_every_column(spark):
    columns = spark.range(1, 121).selectExpr(
        "'s' AS system_name", "'a' AS schema_name", "'wide' AS table_name", "concat('c', id) AS column_name", "'INT' AS data_type",
        "CAST(id AS int) AS ordinal", "id = 1 AS primary_key", "id = 2 AS foreign_key",
    )
    narrow = columns.filter("ordinal <= 2").withColumn("table_name", F.lit("narrow"))
    both = columns.unionByName(narrow)
    batch = spark.createDataFrame(
        [("s", "a", "wide", 0), ("s", "a", "narrow", 0), ("s", "a", "bare", 0)],
        "system_name string, schema_name string, table_name string, batch_no bigint",
    )
    rows = sorted(batches.payloads(batch, both).collect(), key=lambda r: r.part)
    assert [(r.part, r.n_tables) for r in rows] == [(0, 3), (1, 1), (2, 1)]
    names = [c["name"] for r in rows for t in json.loads(r.payload) if t["table_name"] == "wide" for c in t["columns"]]
    assert names == [f"c{i}" for i in range(1, 121)]


def pack(weights, limit):
    chunk, fill, out, started = 0, 0, [], False
    for w in weights:
        if started and fill + w > limit:
            chunk, fill = chunk + 1, w
        else:
            fill += w
        started = True
        out.append(chunk)
    return out


@pytest.mark.parametrize("limit", [10, 50, 1000])
def test_token_chunks_over_ranges(spark, limit):
    rng = random.Random(limit)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}", i, rng.choice([0, 0, 1, 3, 7, 9, 10, 11, 40, 60])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    expected = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        expected.update({(g, r[1]): c for r, c in zip(mine, pack([r[2] for r in mine], limit))})
    for size, fan in ((10**6, 64), (60, 64), (60, 3)):
        got = batches.token_chunks(df, ["g"], ["o"], F.col("w"), limit, rows_per_range=size, fan=fan).collect()
        assert {(r.g, r.o): r.chunk_no for r in got} == expected


def test_adaptive_batches_over_ranges(spark):
    rng = random.Random(5)
    names = [f"t{i:04d}" for i in range(700)]
    widths = {n: rng.choice([0, 3, 15, 16, 40]) for n in names}
    tables = spark.createDataFrame([("x", "s", n) for n in names], ", ".join(f"{k} string" for k in KEY))
    counted = spark.createDataFrame([("x", "s", n, w) for n, w in widths.items() if w], ", ".join(f"{k} string" for k in KEY) + ", n_columns bigint")
    closed, small = [], []
    for n in names:
        if widths[n] > 15:
            closed.append([n])
        else:
            small.append(n)
            if len(small) == 4:
                closed.append(small)
                small = []
    if small:
        closed.append(small)
    expected = {n: i for i, b in enumerate(closed) for n in b}
    for size in (10**6, 50):
        got = batches.adaptive_batches(tables, counted, rows_per_range=size).collect()
        assert {r.table_name: r.batch_no for r in got} == expected


def test_documents_in_parts_hold_all_tables(spark):
    t = model.conform(spark.range(25).select(F.lit("x").alias("system_name"), F.lit("s").alias("schema_name"), F.concat(F.lit("t"), "id").alias("table_name")), model.TABLES)
    c = model.conform(t.select(*KEY).withColumns({"ordinal": F.explode(F.array(F.lit(2), F.lit(1))), "column_name": F.lit("a")}), model.COLUMNS)
    docs = assemble.documents(t, c, tables_per_part=10, rows_per_range=6)
    assert sorted(r.n for r in docs.select(F.size("tables").alias("n")).collect()) == [5, 10, 10]
    first = docs.select(F.explode("tables").alias("t")).select(F.col("t.columns.ordinal").alias("o")).distinct().collect()
    assert [r.o for r in first] == [[1, 2]]
    whole = assemble.documents(t, c).collect()
    assert [(r.part, [x.table_name for x in r.tables]) for r in whole] == [(0, sorted(f"t{i}" for i in range(25)))]


def test_every_document_has_a_file(spark, tmp_path):
    rows = [("a", "s", 0, '{"x":1}'), ("a", "s", 1, '{"x":"é"}'), ("a/b c", "s=1", 0, "{}")]
    docs = spark.createDataFrame(rows, "system_name string, schema_name string, part int, doc string").repartition(2)
    path = store.save_each_document(docs, str(tmp_path), "run")
    files = store.saved_files(spark, path).collect()
    assert sorted(r.size_bytes for r in files) == sorted(len(r[3].encode()) + 1 for r in rows)
    assert len({r.saved_to for r in files}) == 3
    again = spark.read.text(path)
    assert sorted(tuple(r) for r in again.select("system_name", "schema_name", "part", "value").collect()) == sorted(rows)


def test_stamp_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            at = scalars.utc_stamp(F.timestamp_seconds(F.lit(1_700_000_000)))
            assert spark.range(1).select(at).first()[0] == "2023-11-14T22:13:20Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_inclusion_against_brute_force(spark):
    rng = random.Random(3)
    data = {f"t{i}": {f"c{j}": [rng.choice([None, *range(rng.choice([2, 4, 9]))]) for _ in range(12)] for j in range(9)} for i in range(9)}
    frames = {
        t: spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} int" for c in cols)) for t, cols in data.items()
    }
    names = [(t, c) for t, cols in data.items() for c in cols]
    values = {(t, c): {v for v in data[t][c] if v is not None} for t, c in names}
    expected = {(c, p) for c in names for p in names if c[0] != p[0] and values[c] and values[c] <= values[p]}
    got = inclusion.inclusions(frames, names, names).collect()
    assert {((r.child_table, r.child_column), (r.parent_table, r.parent_column)) for r in got} == expected
    assert all(r.n_child == len(values[(r.child_table, r.child_column)]) for r in got)
    pairs = [(names[i], names[-1 - i]) for i in range(30)]
    counted = inclusion.missing_counts(frames, pairs).collect()
    assert {((r.child_table, r.child_column), r.n_missing) for r in counted} == {
        (c, len(values[c] - values[p])) for c, p in pairs
    }


def test_inclusion_of_unlike_types(spark):
    a = spark.sql("SELECT CAST(v AS bigint) AS i, CAST(v AS decimal(20,2)) AS m, CAST(v AS double) AS d, CAST(v AS string) AS s, "
                  "CAST(null AS int) AS none FROM VALUES (1), (2), (3), (3) AS t(v)")
    b = spark.sql("SELECT CAST(v AS decimal(38,0)) AS big, CAST(v AS decimal(9,1)) AS m, CAST(v AS int) AS i FROM VALUES (1.5), (2.0), (4.0) AS t(v)")
    # big is 2 (rounded from 1.5), 2 and 4, and i is 1, 2 and 4
    asked = {("i", "m"): (3, 2), ("m", "i"): (3, 1), ("d", "m"): (3, 2), ("i", "big"): (3, 2), ("none", "i"): (0, 0),
             ("s", "i"): (None, None), ("m", "big"): (3, 2), ("gone", "i"): (None, None)}
    pairs = [(("a", c), ("b", p)) for c, p in asked]
    got = {(r.child_column, r.parent_column): r for r in inclusion.missing_counts({"a": a, "b": b}, pairs).collect()}
    assert {k: (r.n_child, r.n_missing) for k, r in got.items()} == asked
    assert {k: r.reason for k, r in got.items() if r.reason} == {
        ("s", "i"): "types cannot be compared", ("gone", "i"): "no such column"
    }


def plain_number(v):
    """Plain digits of a number, or digits and a power of ten below a millionth, by Python's own decimals."""
    if isinstance(v, float) and not abs(v) < 1e38:
        return "NaN" if v != v else ("-" if v < 0 else "") + {float("inf"): "Infinity"}.get(abs(v)) if abs(v) == float("inf") else repr(v).replace("e+", ".0E")
    exact = Decimal(repr(v)) if isinstance(v, float) and v != int(v) else Decimal(v)
    if exact and abs(exact) < Decimal("0.000001"):
        sign, digits, exponent = exact.as_tuple()
        text = "".join(map(str, digits)).lstrip("0")
        short = text.rstrip("0")
        return f"{'-' if sign else ''}{short}e{exponent + len(text) - len(short)}"
    text = format(exact, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if exact == 0 else text


NUMBERS = {
    "bigint": [0, 1, -1, 10, 100, -9223372036854775808, 9223372036854775807, 9007199254740993, 9007199254740992, 120],
    "decimal(38,0)": [Decimal(x) for x in ("0", "1", "10", "9007199254740993", "9" * 38, "-1" + "0" * 37, "9223372036854775808")],
    "decimal(38,37)": [Decimal(x) for x in ("0", "1", "0.5", "-0.1", "1e-37", "-9.9999999999999999999999999999999999999")],
    "decimal(20,2)": [Decimal(x) for x in ("1.00", "1.50", "-0.10", "100.00", "0.05", "999999999999999999.99")],
    "double": [0.0, -0.0, 1.0, 0.5, 0.1, -0.1, 1e22, 1e23, 1e37, 1e38, 12345678.9012345, 0.00012345678901234567, 9007199254740992.0, 9007199254740994.0, 1e-7, 2.5e-300, 1e-37,
               9223372036854775808.0, -9223372036854775808.0, 4611686018427387904.0, 1.5e16, 123456789.125, 0.05, 120.0, float("nan"), float("inf"), float("-inf")],
    "float": [0.0, 0.5, 0.25, 100.0, 16777216.0],
}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_one_form_of_equal_numbers(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for kind, values in NUMBERS.items():
            df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
            form = F.expr(inclusion.number_form("v", df.schema["v"].dataType))
            assert [r.f for r in df.select(form.alias("f")).collect()] == [plain_number(v) for v in values], kind
            assert df.limit(0).select(form).count() == 0
            assert spark.createDataFrame([(None,)], f"v {kind}").select(form.alias("f")).first().f is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_numbers_of_all_types_meet_exactly(spark):
    frames = {f"t{i}": spark.createDataFrame([(v,) for v in values], f"v {kind}") for i, (kind, values) in enumerate(NUMBERS.items())}
    frames |= {"one": spark.sql("SELECT 1 AS v, 9007199254740993L AS large"), "many": spark.sql("SELECT CAST(1 AS decimal(5,1)) AS v, 9007199254740992D AS large")}
    names = [(t, f) for t, df in frames.items() for f in df.columns]
    values = {f"t{i}": set(map(plain_number, v)) for i, v in enumerate(NUMBERS.values())}
    values = {(t, c): values.get(t) or {"v": {"1"}, "large": {"9007199254740993" if t == "one" else "9007199254740992"}}[c] for t, c in names}
    expected = {(c, p) for c in names for p in names if c[0] != p[0] and values[c] <= values[p]}
    got = inclusion.inclusions(frames, names, names).collect()
    assert {((r.child_table, r.child_column), (r.parent_table, r.parent_column)) for r in got} == expected
    found = inclusion.missing_counts(frames, [(c, p) for c in names for p in names if c[0] != p[0]]).collect()
    assert {((r.child_table, r.child_column), (r.parent_table, r.parent_column)) for r in found if r.n_missing == 0} == expected


def test_masks_carry_their_own_columns_only(spark):
    """10,000 columns: a value's row has the words of the columns it is in, and the answer is that of full sets."""
    rng = random.Random(8)
    n = 10_000
    held = {i: {rng.randrange(40_000) for _ in range(rng.choice([1, 2, 3, 8]))} for i in range(n)}
    for i in range(0, n, 50):
        held[i] = set(rng.sample(sorted(held[rng.randrange(n)]), 1))
    for i in range(0, n, 400):
        held[i] = {0, 1}
    rows = [(i, v) for i, values in held.items() for v in values]
    found = materialized(inclusion.masks(spark.createDataFrame(rows, "i int, value int")), "test")
    assert found.agg(F.sum("n")).first()[0] == len({v for _, v in rows})
    owners = {}
    for i, v in rows:
        owners.setdefault(v, set()).add(i)
    widest = max(len({i // inclusion.WORD for i in own}) for own in owners.values())
    assert found.agg(F.max(F.size("mask"))).first()[0] == widest
    tables = {i: f"t{i % 100}" for i in range(n)}
    listed = spark.createDataFrame([(i, tables[i], True, i % 3 != 0) for i in range(n)], "i int, t string, is_child boolean, is_parent boolean")
    got = {(r.child, r.parent, r.n_child, r.n_parent) for r in inclusion._included(found, listed).collect()}
    expected = set()
    for i, own in held.items():
        for p in set.intersection(*(owners[v] for v in own)):
            if tables[i] != tables[p] and p % 3:
                expected.add((i, p, len(own), len(held[p])))
    assert got == expected


def test_profile_of_odd_types(spark):
    df = spark.sql("SELECT * FROM VALUES (map('a',1), array(1,2), named_struct('x',1), 0.0D), (map('a',1), array(1,2), null, -0.0D), (null, array(2,1), null, double('NaN')) AS t(`m x`, a, s, d)")
    got = {r.column_name: (r.null_count, r.distinct_count) for r in profile.profile(df, "t").collect()}
    assert got == {"m x": (1, 1), "a": (0, 2), "s": (2, 1), "d": (0, 2)}
    exact = {r.column_name: r.distinct_count for r in profile.exact_distinct({"t": df}).collect()}
    assert exact == {"m x": 1, "a": 2, "s": 1, "d": 2}


def column_rows(spark, rows):
    """(schema, table, ordinal, name, pk, fk, ref, inferred ref) to normal form."""
    df = spark.createDataFrame(
        [("x", s, t, o, n, "INT", pk, fk, ref, inf, True if inf else None) for s, t, o, n, pk, fk, ref, inf in rows],
        "system_name string, schema_name string, table_name string, ordinal int, column_name string, data_type string, "
        "primary_key boolean, foreign_key boolean, references struct<schema: string, table: string, column: string>, "
        "inferred_fk_references struct<schema: string, table: string, column: string>, inferred_fk boolean",
    )
    flat = model.conform(df, model.COLUMNS)
    return flat.select(*KEY).distinct().withColumns({"table_type": F.lit("BASE TABLE"), "row_count": F.lit(1).cast("bigint"), "description": F.lit("")}), normalize.normal_form(flat)


def test_relations(spark):
    t, c = column_rows(spark, [
        ("a", "orders", 1, "id", True, False, None, None),
        ("a", "orders", 2, "customer_id", False, False, None, None),
        ("a", "orders", 3, "parent", False, True, ("a", "orders", "id"), None),
        ("a", "orders", 4, "lost", False, True, ("a", "gone", "id"), None),
        ("a", "orders", 5, "paid", False, False, None, None),
        ("a", "orders", 6, "who", False, False, None, ("b", "person", None)),
        ("a", "orders", 7, "brand_key", False, True, None, None),
        ("a", "orders", 8, "item_key", False, False, None, None),
        ("a", "dim_customer", 1, "cid", True, False, None, None),
        ("a", "fact_customer", 1, "cid", True, False, None, None),
        ("b", "customer", 1, "cid", True, False, None, None),
        ("b", "person", 1, "pid", True, False, None, None),
        ("a", "person", 1, "pid", True, False, None, None),
        ("a", "brand", 1, "brand_name", False, False, None, None),
        ("a", "item", 1, "item_id", False, False, None, None),
    ])
    edges = {(r.source, r.source_column): r for r in relate.relate(t, c).collect()}
    found = {k: (r.target_schema, r.target, r.target_column, r.method, r.is_inferred, r.unresolved) for k, r in edges.items()}
    assert found == {
        ("orders", "customer_id"): ("a", "dim_customer", "cid", "name", False, False),
        ("orders", "parent"): ("a", "orders", None, "self", False, True),
        ("orders", "lost"): ("a", "orders", None, None, False, True),
        ("orders", "who"): ("b", "person", "pid", "ai", True, False),
        ("orders", "brand_key"): ("a", "brand", None, "name", False, False),
    }
    row = stats.stats(t, c, relate.relate(t, c)).collect()[0]
    assert (row.total_tables, row.fk_relations, row.inferred_fk_rels, row.primary_keys) == (8, 2, 1, 6)
    pairs = graph.collapsed(relate.relate(t, c)).collect()
    assert {(r.source, r.target) for r in pairs} == {("orders", "dim_customer"), ("orders", "person"), ("orders", "brand")}


def test_keys_of_a_junction_table_on_request(spark):
    t, c = column_rows(spark, [
        ("a", "link", 1, "user_id", True, True, None, None),
        ("a", "user", 1, "id", True, False, None, None),
    ])
    assert relate.relate(t, c).count() == 0
    assert [r.target for r in relate.relate(t, c, pk_may_reference=True).collect()] == ["user"]


def scripts(spark, *texts):
    return spark.createDataFrame([("x", f"f{i}", s) for i, s in enumerate(texts)], "system_name string, path string, text string")


def catalogue(spark, *texts):
    _, cols = ddl.catalog(ddl.statements(scripts(spark, *texts)))
    return {(r.schema_name, r.table_name, r.column_name): r for r in cols.collect()}


def test_create_again_and_alter_order(spark):
    got = catalogue(
        spark,
        "ALTER TABLE t ADD PRIMARY KEY (a); CREATE TABLE t (a INT, z INT); ALTER TABLE t ADD PRIMARY KEY (z)",
        "CREATE TABLE t (a INT, b INT); ALTER TABLE t ADD CONSTRAINT u UNIQUE (b)",
    )
    assert set(got) == {("dbo", "t", "a"), ("dbo", "t", "b")}
    assert not got["dbo", "t", "a"].primary_key and got["dbo", "t", "b"].unique


def test_alter_finds_the_first_schema(spark):
    got = catalogue(
        spark,
        "CREATE TABLE s2.other (a INT); CREATE TABLE s1.t (a INT); CREATE TABLE s2.t (a INT);"
        "ALTER TABLE t ADD PRIMARY KEY (A); CREATE TABLE s3.q (a INT)",
    )
    assert got["s2", "t", "a"].primary_key and not got["s1", "t", "a"].primary_key


def test_names_literals_and_lists(spark):
    got = catalogue(
        spark,
        'CREATE TABLE IF NOT EXISTS [db].[s x].[t y] ("a b" INT DEFAULT \'x, (;\', IndexValue INTERVAL, `c` VARCHAR2(9) NOT NULL, '
        "FOREIGN KEY (\"a b\", IndexValue) REFERENCES p (k)); INSERT INTO z VALUES ('CREATE TABLE no (a INT)')",
    )
    assert {k: v.data_type for k, v in got.items()} == {
        ("s x", "t y", "a b"): "INT", ("s x", "t y", "IndexValue"): "INTERVAL", ("s x", "t y", "c"): "VARCHAR2"
    }
    assert tuple(got["s x", "t y", "a b"].references) == ("dbo", "p", "k")
    assert not got["s x", "t y", "IndexValue"].foreign_key and not got["s x", "t y", "c"].nullable


def test_database_and_unparsed(spark):
    files = scripts(spark, "/* USE no */ -- USE nope\nUSE [shop]\nGO\nSELECT 'USE x'", "CREATE TABLE (x)", "CREATE TABLE t (a INT)",
                    "CREATE TABLE d (a INT CHECK " + "(" * 40 + "1" + ")" * 40 + "); CREATE TABLE e (a INT)",
                    "CREATE TABLE d (); CREATE TABLE e (a INT)")
    found = ddl.statements(files)
    assert ddl.databases(found).collect()[0].database == "shop"
    assert ddl.databases(found, "given").collect()[0].database == "given"
    assert {(r.path, r.reason) for r in ddl.unparsed(files, found).collect()} == {
        ("f0", "no ddl"), ("f1", "ddl without a readable table"), ("f4", "a table body is not readable")
    }


def raw(spark, *jsons):
    df = spark.createDataFrame([("x", "s", "t", i, j) for i, j in enumerate(jsons)], "system_name string, schema_name string, table_name string, seq int, j string")
    return normalize.normalize_columns(df.withColumn("raw", F.parse_json("j"))).orderBy("ordinal").collect()


def test_normal_form_of_odd_columns(spark):
    rows = raw(
        spark,
        '{"column_name": "a", "primary_key": null, "is_primary_key": true, "nullable": 3}',
        '{"column_name": "b", "is_primary_key": "TRUE", "is_nullable": "maybe", "nullable": true}',
        '["c", "INT", true]',
        '["d", "INT", false, null, "1", 0, null, 5]',
        '["e", "INT", "true", null, 0, "yes", null, "text", 6]',
        '"skipped"',
        '{"column_name": "f", "references": "none", "inferred_fk": 1, "nullable": "x"}',
    )
    assert [(r.column_name, r.is_primary_key, r.is_foreign_key, r.is_nullable, r.description, r.distinct_count) for r in rows] == [
        ("a", False, False, "", "", None),
        ("b", True, False, "maybe", "", None),
        ("c", False, False, "YES", "", None),
        ("d", True, False, "NO", "", 5),
        ("e", False, True, "YES", "text", 6),
        ("f", False, False, "NO", "", None),
    ]
    assert rows[-1].inferred_fk and rows[-1].fk_ref_table is None


def test_requests():
    args = dialects.request_arguments({"db_type": "postgresql", "schema_name": None, "database": "d", "port": None})
    assert args == {"db_type": "postgres", "database": "d", "schema": "public", "tables": None}
    assert dialects.request_arguments({"db_type": "oracle", "username": "scott"})["schema"] == "scott"
    with pytest.raises(ValueError):
        dialects.request_arguments({"db_type": "db2"})
    with pytest.raises(ValueError):
        dialects.dialect_parts("db2", {})


def test_composite_keys_pair_by_position(spark):
    usage = "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"
    dumps = {
        "tables": spark.createDataFrame([("d", "p", "TABLE", 1, 1), ("d", "c", "TABLE", 1, 1), ("d", "v", "VIEW", 1, 1)], "dataset_id string, table_id string, table_type string, num_rows int, num_bytes int"),
        "fields": spark.createDataFrame([("d", t, n, "INT64", "NULLABLE", i) for t in "pc" for i, n in ((1, "a"), (2, "b"))], "dataset_id string, table_id string, name string, field_type string, mode string, position int"),
        "table_constraints": spark.createDataFrame([("pk", "d", "p", "PRIMARY KEY", None, None), ("fk", "d", "c", "FOREIGN KEY", "pk", None)], "constraint_name string, table_schema string, table_name string, constraint_type string, unique_constraint_name string, unique_constraint_schema string"),
        "key_column_usage": spark.createDataFrame([("pk", "d", "p", "a", 1, None), ("pk", "d", "p", "b", 2, None), ("fk", "d", "c", "b", 1, 1), ("fk", "d", "c", "a", 2, 2)], usage),
    }
    tables, cols, fks = assemble.assemble(dialects.dialect_parts("bigquery", dumps))
    assert {(r.column_name, r.ref_column) for r in fks.collect()} == {("b", "a"), ("a", "b")}
    assert tables.count() == 2
    bare = dialects.dialect_parts("bigquery", {k: dumps[k] for k in ("tables", "fields")})
    assert not any(r.primary_key or r.foreign_key for r in assemble.assemble(bare)[1].collect())


def test_paging_limits(spark):
    df = spark.range(45)
    assert search.page(df, 3, 20, ["id"]).count() == 5
    assert search.page(df, 9, 20, ["id"]).count() == 0
    deep = spark.range(200_007).repartition(5)
    assert sorted(r.id for r in search.page(deep, 10_001, 20, ["id"]).collect()) == list(range(200_000, 200_007))
    for number, size in ((0, 20), (1, 0)):
        with pytest.raises(ValueError):
            search.page(df, number, size, ["id"])


def test_foreign_answers(spark):
    _, c = column_rows(spark, [("a", "T", 1, "ID", True, False, None, None), ("a", "U", 1, "t_id", False, False, None, None), ("a", "U", 2, "x", False, False, None, None)])
    flat = c.withColumnsRenamed({"is_primary_key": "primary_key", "is_foreign_key": "foreign_key"})
    answers = spark.createDataFrame(
        [("x", "u", "T_ID", None, "t", "id"), ("x", "u", "x", "", "T", "nope"), ("x", "w", "x", "a", "T", "ID"), ("x", "u", "", "a", "T", "ID")],
        "system_name string, source_table string, source_column string, target_schema string, target_table string, target_column string",
    )
    checked = foreign_keys.validate(answers, flat, "main")
    assert {(r.column_name, r.target_schema, r.reject_reason) for r in checked.collect()} == {
        ("t_id", "main", None), ("x", "main", "target column is not a key"), (None, "a", "source table not found")
    }
    applied = foreign_keys.apply_foreign(flat, checked)
    assert [(r.column_name, tuple(r.inferred_fk_references)) for r in applied.collect() if r.inferred_fk] == [("t_id", ("main", "t", "id"))]


def test_last_answer_counts(spark):
    _, c = column_rows(spark, [("a", "z", 1, "id", True, False, None, None), ("a", "b", 1, "id", True, False, None, None), ("a", "u", 1, "r", False, False, None, None)])
    flat = c.withColumnsRenamed({"is_primary_key": "primary_key", "is_foreign_key": "foreign_key"})
    for order, last in (((1, 2), "b"), ((2, 1), "z")):
        answers = spark.createDataFrame(
            [("x", "u", "r", "a", "z", "id", order[0]), ("x", "u", "r", "a", "b", "id", order[1])],
            "system_name string, source_table string, source_column string, target_schema string, target_table string, target_column string, sequence int",
        )
        applied = foreign_keys.apply_foreign(flat, foreign_keys.validate(answers, flat))
        assert [r.inferred_fk_references.table for r in applied.collect() if r.inferred_fk] == [last]


def test_parents_prefer_the_own_schema(spark):
    rows = [(s, t, 1, "id", True, False, None, None) for s in ("a", "b") for t in ("users", "user")]
    _, c = column_rows(spark, [*rows, ("b", "log", 1, "user_id", False, False, None, None), ("c", "log", 1, "user_id", False, False, None, None)])
    flat = c.withColumnsRenamed({"is_primary_key": "primary_key", "is_foreign_key": "foreign_key"})
    got = {(r.schema_name, r.parent_schema, r.parent_table) for r in foreign_keys.best_parents(flat).collect()}
    assert got == {("b", "b", "user"), ("c", "a", "user")}


def test_describe_keeps_errors(spark):
    rows = spark.createDataFrame([("x", 0, "good"), ("x", 1, "bad")], "system_name string, batch_no bigint, payload string")

    def fn(payload):
        if payload == "bad":
            raise RuntimeError("no answer")
        return "{}"

    got = {r.batch_no: (r.answer, r.status) for r in batches.describe(rows, fn).collect()}
    assert got == {0: ("{}", "ok"), 1: (None, "error: no answer")}


def test_answers_of_odd_shape(spark):
    rows = spark.createDataFrame(
        [("x", 0, 'ok {"t": {"table_description": "d", "column_descriptions": [{"column_name": "a", "description": "1"}, {"columnName": "a", "description": "2"}]}}'),
         ("x", 1, "nothing"), ("x", 2, "[1, 2]")],
        "system_name string, batch_no bigint, answer string",
    )
    parsed = enrich.parse_answers(rows)
    assert [(r.table_name, r.table_description) for r in parsed.collect()] == [("t", "d")]
    assert [(r.column_name, r.description) for r in enrich.answered_columns(parsed).collect()] == [("a", "2")]


def test_store_without_versions_is_empty(spark, tmp_path):
    assert store.read_store(spark, str(tmp_path / "none")).count() == 0
    assert documents.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_a_whole_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"source": {"db_type": "postgres", "database": "shop"}, "schemas": [{"schema_name": "public", "tables": '
        '[{"table_name": "t", "row_count": 5, "ai_description": "x", "columns": [{"column_name": "id", "primary_key": true}, ["n", "TEXT"]]}]}]}'
    )
    docs = documents.read_documents(spark, str(tmp_path)).withColumn("system_name", F.lit("x"))
    raw_tables = documents.raw_tables(docs)
    assert [(r.table_name, r.description, r.row_count) for r in normalize.normalize_tables(raw_tables).collect()] == [("t", "x", 5)]
    cols = normalize.normalize_columns(documents.raw_columns(raw_tables)).orderBy("ordinal").collect()
    assert [(r.column_name, r.is_primary_key) for r in cols] == [("id", True), ("n", False)]
    head = documents.source_fields(docs).collect()[0]
    assert (head.db_type, head.schema_name, head.title) == ("postgres", "public", "shop Schema Report")


def test_best_key(spark):
    _, c = column_rows(spark, [("a", "dim_user", 1, "name", False, False, None, None), ("a", "dim_user", 2, "user_id", False, False, None, None), ("a", "dim_user", 3, "other_id", False, False, None, None)])
    flat = c.withColumnsRenamed({"is_primary_key": "primary_key", "is_foreign_key": "foreign_key"}).withColumn("nullable", F.lit(False))
    assert [r.column_name for r in keys.infer_primary(flat).collect()] == ["user_id"]


def test_written_tables_go_to_the_named_folder(spark):
    from lakescribe.session import materialized

    kept = materialized(spark.range(7), "numbers")
    assert kept.count() == 7
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert named.removeprefix("file:").rstrip("/") + "/numbers-" in kept.inputFiles()[0]


@pytest.mark.parametrize("rows_per_range", [50, 500_000])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_token_chunks_with_null_groups_and_counts(spark, rows_per_range, kind):
    rows = [(None if i % 3 == 0 else str(i % 2), i, None if i % 7 == 0 else 10 + i % 90) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i bigint, n bigint").withColumn("g", F.col("g").cast(kind))
    found = batches.token_chunks(df, ["g"], ["i"], F.col("n"), 150, rows_per_range).collect()
    chunk, fill, expected = {}, {}, {}
    for g, i, n in rows:
        n = n or 0
        if g in chunk and fill[g] + n > 150:
            chunk[g], fill[g] = chunk[g] + 1, 0
        chunk.setdefault(g, 0)
        fill[g] = fill.get(g, 0) + n
        expected[i] = (g, n, chunk[g])
    assert {r.i: (None if r.g is None else str(r.g), r.tokens, r.chunk_no) for r in found} == expected


def test_long_lists_of_names_keep_the_columns(spark):
    df = spark.createDataFrame([("s", "t1", 1), ("s", "other", 2)], "schema_name string, table_name string, v int")
    found = search.allowed(df, [f"t{i}" for i in range(1001)])
    assert found.columns == df.columns and [tuple(r) for r in found.collect()] == [("s", "t1", 1)]


def test_deep_pages_are_sorted(spark):
    df = spark.range(0, 100_200).selectExpr("'a' as system_name", "'b' as schema_name", "format_string('%07d', 100199 - id) as table_name")
    found = [r.table_name for r in search.page(df, 5006, 20).collect()]
    assert found == [f"{i:07d}" for i in range(100_100, 100_120)]


def test_exact_distinct_of_empty_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    full = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    found = {(r.table_name, r.column_name): r.distinct_count for r in profile.exact_distinct({"e": empty, "f": full}).collect()}
    assert found == {("e", "a"): 0, ("e", "b"): 0, ("f", "a"): 1, ("f", "b"): 0}


def test_bigquery_target_in_another_dataset(spark):
    usage = "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"
    dumps = {
        "tables": spark.createDataFrame([("d", "c", "TABLE", 3, 9), ("e", "p", "TABLE", 3, 9)], "dataset_id string, table_id string, table_type string, num_rows long, num_bytes long"),
        "fields": spark.createDataFrame([("d", "c", 1, "p_id", "INT64", "NULLABLE"), ("e", "p", 1, "id", "INT64", "NULLABLE")], "dataset_id string, table_id string, position int, name string, field_type string, mode string"),
        "table_constraints": spark.createDataFrame([("pk", "e", "p", "PRIMARY KEY", None), ("fk", "d", "c", "FOREIGN KEY", "pk")], "constraint_name string, table_schema string, table_name string, constraint_type string, unique_constraint_name string"),
        "key_column_usage": spark.createDataFrame([("pk", "e", "p", "id", 1, None), ("fk", "d", "c", "p_id", 1, 1)], usage),
        "constraint_column_usage": spark.createDataFrame([("pk", "e", "p", "id")], "CONSTRAINT_NAME string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string"),
    }
    found = assemble.assemble(dialects.dialect_parts("bigquery", dumps))[2].collect()
    assert [(r.table_name, r.column_name, r.ref_schema, r.ref_table, r.ref_column) for r in found] == [("c", "p_id", "e", "p", "id")]


def stored_row(spark, name, metadata):
    return spark.createDataFrame([(name, "o", "u", "s", "2024", metadata)], store.STORE)


def test_two_writers_of_a_store(spark, tmp_path):
    directory = str(tmp_path / "store")
    store.upsert_store(spark, directory, stored_row(spark, "a", "1"))
    met = []

    def slow(old):
        """Another writer is done between this one's reading and its writing, twice."""
        if len(met) < 2:
            met.append(1)
            store.upsert_store(spark, directory, stored_row(spark, f"other{len(met)}", "x"))
        return store.upsert(old, stored_row(spark, "b", "2"))

    store.update_store(spark, directory, slow)
    assert {r.system_name for r in store.read_store(spark, directory).collect()} == {"a", "b", "other1", "other2"}
    assert len(store.versions(spark, directory)) == 4
    folders = [p for p in (tmp_path / "store").iterdir() if p.is_dir()]
    assert len(folders) == 4  # what lost its number is gone
    assert not store._claim(spark, directory, 4, "data-x")

    def always_late(old):
        store._claim(spark, directory, 5, "data-z")
        return old

    with pytest.raises(RuntimeError):
        store.update_store(spark, directory, always_late, attempts=1)


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    directory = str(tmp_path / "store")
    names = [f"s{i}" for i in range(5)]
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda n: store.upsert_store(spark, directory, stored_row(spark, n, n)), names))
    assert {r.system_name for r in store.read_store(spark, directory).collect()} == set(names)


def test_keys_of_one_alter(spark):
    texts = [
        "CREATE TABLE t (a INT, b INT, c INT, d INT); ALTER TABLE t ADD CONSTRAINT f1 FOREIGN KEY (a) REFERENCES p (x), "
        "CONSTRAINT f2 FOREIGN KEY (b, c) REFERENCES s.q (y, z), UNIQUE (d), DROP CONSTRAINT old, ADD PRIMARY KEY (d)",
        "CREATE TABLE u (a INT, b INT); ALTER TABLE u ADD (CONSTRAINT k PRIMARY KEY (a), CONSTRAINT f FOREIGN KEY (b) REFERENCES p (x))",
        "CREATE TABLE v (a INT, b INT); ALTER TABLE v WITH CHECK ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES p (x); "
        "ALTER TABLE v DROP CONSTRAINT PRIMARY KEY (b), FOREIGN KEY (b) REFERENCES p (x)",
    ]
    made = spark.createDataFrame([("x", f"{i}.sql", t) for i, t in enumerate(texts)], "system_name string, path string, text string")
    got = ddl.key_rows(ddl.written(ddl.statements(made)))
    ref = F.col("references")
    found = {tuple(r) for r in got.select("table_name", "kind", "column_name", F.concat_ws(".", ref["schema"], ref["table"], ref["column"])).collect()}
    assert found == {
        ("t", "FK", "a", "dbo.p.x"), ("t", "FK", "b", "s.q.y"), ("t", "FK", "c", "s.q.z"), ("t", "UQ", "d", ""), ("t", "PK", "d", ""),
        ("u", "PK", "a", ""), ("u", "FK", "b", "dbo.p.x"), ("v", "FK", "a", "dbo.p.x"),
    }


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_ranges_summed_up_like_a_loop(limit):
    rng = random.Random(limit)
    for n in (1, 2, 5, 300):
        weights = np.array([rng.choice([0, 1, 3, 9, 60]) for _ in range(n)], dtype=np.int64)

        def walk(fill, started):
            chunk, numbers = 0, []
            for w in weights:
                if started and fill + w > limit:
                    chunk, fill = chunk + 1, 0
                fill, started = fill + w, True
                numbers.append(chunk)
            return numbers, fill, chunk

        thresholds, lefts, counts, total = batches._range_summary(weights, limit)
        summary = np.array(thresholds), np.array(lefts), np.array(counts), total
        for fill in range(0, min(limit, 70) + 1):
            numbers, left, opened = walk(fill, True)
            assert tuple(int(x[0]) for x in batches._left_by(np.array([fill]), summary, limit)) == (left, opened)
            assert batches._numbered(weights, limit, 0, fill, True).tolist() == numbers
        assert batches._numbered(weights, limit, 5, 0, False).tolist() == [c + 5 for c in walk(0, False)[0]]


def test_a_key_name_that_many_tables_share(spark):
    """40 tables whose keys are all called ``shared``: the values say which of the 1,560 pairs are foreign keys."""
    frames, rows, held = {}, [], {}
    for i in range(40):
        own = range(i, i + 10) if i % 4 else range(0, 60)
        held[f"t{i}"] = set(own)
        frames[f"t{i}"] = spark.createDataFrame([(v, v) for v in own], "shared int, other_no int")
        rows += [("x", "s", f"t{i}", c, o, "INTEGER", c == "shared") for o, c in enumerate(("shared", "other_no"), 1)]
    columns = model.conform(
        spark.createDataFrame(rows, "system_name string, schema_name string, table_name string, column_name string, ordinal int, data_type string, is_primary_key boolean"),
        model.COLUMNS,
    ).withColumn("primary_key", F.col("column_name") == "shared")
    got = foreign_keys.confirmed(columns, frames)
    expected = {(c, p) for c in held for p in held if c != p and held[c] <= held[p]}
    assert {(r.child_table, r.parent_table) for r in got.collect()} == expected
    assert {(r.child_column, r.parent_column) for r in got.collect()} == {("shared", "shared")}


def test_snapshots_are_merged(spark):
    first = spark.createDataFrame([(i, None if i % 4 else "x", {"k": i}) for i in range(100)], "a long, b string, m map<string, int>")
    later = spark.createDataFrame([(i, "y", None) for i in range(60, 160)], "a long, b string, m map<string, int>")
    states = profile.sketch_states(first, "t", F.lit("one")).unionByName(profile.sketch_states(later, "t", F.lit("two")))
    again = states.unionByName(profile.sketch_states(later, "t", F.lit("two")))
    nothing = profile.sketch_states(first.limit(0), "t", F.lit("three"))
    for kept in (states, again, states.unionByName(nothing)):
        found = {r.column_name: (r.ordinal, r.row_count, r.null_count, r.distinct_count) for r in profile.merged_states(kept).collect()}
        assert found == {"a": (1, 200, 0, 160), "b": (2, 200, 75, 2), "m": (3, 200, 100, 100)}
    # the same from one scan, a state per part of the table
    both = profile.sketch_states(first.unionByName(later), "t", F.col("a") < 60)
    assert {r.row_count for r in both.collect()} == {60, 140}
    assert {r.column_name: r.distinct_count for r in profile.merged_states(both).collect()} == {"a": 160, "b": 2, "m": 100}
    assert nothing.count() == profile.merged_states(nothing).count() == 0


def test_unreadable_parts_are_not_absent_keys(spark):
    dumps = {
        "TABLES": spark.createDataFrame([(s, "D", "T", "BASE TABLE", 3, 9) for s in ("a", "b")], "system_name string, table_schema string, table_name string, table_type string, row_count long, bytes long"),
        "COLUMNS": spark.createDataFrame([(s, "D", "T", "C", "INT", "YES", 1) for s in ("a", "b")], "system_name string, table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"),
        "PRIMARY_KEYS": spark.createDataFrame([], dialects.KEY_SCHEMA),
        "UNIQUE_KEYS": spark.createDataFrame([("a", "D", "T", "C")], dialects.KEY_SCHEMA),
    }
    told = spark.createDataFrame([("b", "Primary_Keys", "denied"), ("b", "unique_keys", None)], "system_name string, dump string, message string")
    parts = dialects.dialect_parts("snowflake", dumps)
    status = dialects.part_status("snowflake", dumps, parts, told)
    found = {(r.system_name, r.part): (r.status, r.n_rows, r.message) for r in status.collect()}
    assert found == {
        ("a", "tables"): ("read", 1, None), ("a", "columns"): ("read", 1, None), ("a", "primary"): ("empty", 0, None),
        ("a", "unique"): ("read", 1, None), ("a", "foreign"): ("unreadable", 0, "no dump imported_keys"),
        ("a", "distinct"): ("unreadable", 0, "no dump distinct"),
        ("b", "tables"): ("read", 1, None), ("b", "columns"): ("read", 1, None), ("b", "primary"): ("unreadable", 0, "primary_keys: denied"),
        ("b", "unique"): ("unreadable", 0, "unique_keys"), ("b", "foreign"): ("unreadable", 0, "no dump imported_keys"),
        ("b", "distinct"): ("unreadable", 0, "no dump distinct"),
    }
    cols = assemble.with_known_flags(assemble.assemble(parts)[1], status)
    flags = {r.system_name: (r.primary_key, r.unique, r.foreign_key) for r in cols.collect()}
    assert flags == {"a": (False, True, None), "b": (None, None, None)}


@pytest.mark.parametrize("rows_per_range", [7, 1000])
def test_pages_of_a_stored_index(spark, tmp_path, rows_per_range):
    rows = [(None if i == 40 else f"s{i % 3}", f"t{i // 2:03d}", i) for i in range(101)]
    df = spark.createDataFrame(rows, "schema_name string, table_name string, v int")
    order = ["schema_name", "table_name", "v"]
    search.write_page_index(df, str(tmp_path / "i"), order, rows_per_range)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    for number, size in [(1, 10), (3, 7), (11, 10), (12, 10), (1, 500), (101, 1)]:
        found = search.indexed_page(spark, str(tmp_path / "i"), number, size, order)
        assert found.columns == df.columns
        assert [tuple(r) for r in found.collect()] == expected[(number - 1) * size : number * size]
    with pytest.raises(ValueError):
        search.indexed_page(spark, str(tmp_path / "i"), 0)


def test_index_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "system_name string, schema_name string, table_name string")
    search.write_page_index(empty, str(tmp_path / "i"))
    assert search.indexed_page(spark, str(tmp_path / "i")).collect() == []
