import time

import pytest
from pyspark.sql import functions as F

from lakescribe.functions import ddl_text as D, json_text, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "size, text",
    [
        (None, "0B"), (0, "0B"), (1, "1B"), (1023, "1023B"), (1024, "1KB"), (1536, "1.5KB"), (1152, "1.12KB"),
        (1048576, "1MB"), (1300234, "1.24MB"), (1024**5, "1PB"), (2 * 1024**5, "2PB"), (5000 * 1024**5, "5000PB"),
    ],
)
def test_format_size(spark, size, text):
    assert one(spark, scalars.format_size(F.lit(size).cast("bigint"))) == text


@pytest.mark.parametrize(
    "name, entity",
    [("customer_id", "customer"), ("customerid", "customer"), ("id", "id"), ("paid", "pa"), ("brand_key", "brand"), ("customer", "customer")],
)
def test_entity_names(spark, name, entity):
    assert one(spark, scalars.entity_names(F.lit(name))) == [entity]


def test_prefixes(spark):
    assert one(spark, scalars.bare_table_name(F.lit("dim_fact_x"))) == "fact_x"
    assert [one(spark, scalars.prefix_rank(F.lit(n))) for n in ("x", "dim_x", "vw_x", "lkp_x")] == [0, 1, 3, 6]


def test_times_and_totals(spark):
    assert one(spark, scalars.minute_text(F.lit("2026-02-26T23:12:06Z"))) == "2026-02-26 23:12 UTC"
    assert one(spark, scalars.minute_text(F.lit("2026-02-26T23:12:06+05:30"))) == "2026-02-26 23:12 UTC"
    assert one(spark, scalars.minute_text(F.lit("yesterday"))) == "yesterday"
    assert one(spark, scalars.row_total_text(F.lit(17878649))) == "17.88M"
    assert one(spark, scalars.row_total_text(F.lit(12345))) == "12,345"


@pytest.mark.parametrize(
    "declared, family",
    [
        ("INT", "INT"), ("INTERVAL DAY", "INTERVAL"), ("VARCHAR2(5)", "STRING"), ("DECIMAL(10,2)", "DECIMAL"), ("NUMBER", "DECIMAL"),
        ("TIMESTAMP_NTZ", "TIMESTAMP"), ("DATE", "DATE"), ("DATETIME2", "TIMESTAMP"), ("ARRAY<INT>", "NESTED"), ("BIT", "BOOL"), ("UUID", "UUID"),
    ],
)
def test_type_family(spark, declared, family):
    assert one(spark, scalars.type_family(F.lit(declared))) == family


@pytest.mark.parametrize(
    "text, expected",
    [
        ('["id"]', ["id"]), ('sure:\n```json\n["id", "b"]\n```', ["id", "b"]), ("[1, 2]", []), ("[] and [", []),
        ('[{"a": 1}]', []), ("", []), ("nothing", []), ('["a"] or ["b"]', []),
    ],
)
def test_string_array(spark, text, expected):
    assert one(spark, json_text.string_array(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [('{"a": 1}', 1), ('```json\n{"a": 2}\n```', 2), ('well {"a": 3} yes', 3), ("{broken", None), ('{"a": 1} and {"a": 2}', None), ("", None), ('x [1] {"a": 4}', None)],
)
def test_noisy_json(spark, text, expected):
    assert one(spark, F.try_variant_get(json_text.noisy_json(F.lit(text)), "$.a", "int")) == expected


@pytest.mark.parametrize(
    "json, expected",
    [("true", True), ("1", True), ("0", False), ('"Yes"', True), ('" true "', True), ('"no"', False), ("null", False), ("0.5", True), ("[1]", False)],
)
def test_flag(spark, json, expected):
    assert one(spark, json_text.flag(F.parse_json(F.lit(json)))) is expected


@pytest.mark.parametrize(
    "raw, text",
    [
        (b"", ""), (b"\xff\xfe" + "aé".encode("utf-16-le"), "aé"), (b"\xfe\xff" + "ab".encode("utf-16-be"), "ab"),
        ("abc".encode("utf-16-le"), "abc"), (b"\xef\xbb\xbfab", "ab"), ("é中".encode(), "é中"),
        (b"caf\xe9", "café"), (b"\xef\xbb\xbfa\xffb", "a�b"), (b"\xff\xfea\x00b", "a�"),
    ],
)
def test_decode(spark, raw, text):
    from lakescribe.sources.scripts import decode_scripts

    files = spark.createDataFrame([("s", "p", bytearray(raw))], "system_name string, path string, content binary")
    assert decode_scripts(files).collect()[0].text == text


@pytest.mark.parametrize(
    "sql, plain",
    [
        ("a -- b\nc", "a \nc"), ("a /* x\ny */ b", "a   b"), ("'--x' -- y", "'--x' "), ("'it''s /* */' z", "'it''s /* */' z"),
        ("a /* open", "a "), ("a - b / c", "a - b / c"), ("/*/ x */b", " b"), ("x 'open -- y", "x 'open -- y"),
    ],
)
def test_strip_comments(spark, sql, plain):
    assert one(spark, D.strip_comments(F.lit(sql))) == plain


def test_long_script_needs_no_stack(spark):
    body = ", ".join(f"c{i} DECIMAL(10,2) CHECK ((c{i}) > ((0)))" for i in range(4000))
    bare = F.lit(f"CREATE TABLE t ({body})")
    assert one(spark, F.size(D.body_items(D.create_body(bare)))) == 4000
    assert one(spark, F.length(D.strip_comments(F.lit("'x' " * 100_000)))) == 400_000


@pytest.mark.parametrize("depth", [1, 2, 5, 12, 40, 500])
def test_nested_parentheses(spark, depth):
    item = "a INT CHECK " + "(" * depth + "1, 2" + ")" * depth
    assert one(spark, D.body_items(D.create_body(F.lit(f"CREATE TABLE t ({item}, b INT)")))) == [item, "b INT"]


@pytest.mark.parametrize(
    "statement, body",
    [
        ("CREATE TABLE t (a INT) ON [x] (y)", "a INT"), ("CREATE TABLE t (a INT, b DECIMAL(1,2)", "a INT, b DECIMAL(1,2)"),
        ("CREATE TABLE t (a DECIMAL(1,2", "a DECIMAL(1,2"), ("CREATE TABLE t ()", None), ("CREATE TABLE t (", None), ("SELECT (1)", None),
        ("CREATE TABLE t ((a)) (", "(a)"),
    ],
)
def test_create_body(spark, statement, body):
    assert one(spark, D.create_body(F.lit(statement))) == body


@pytest.mark.parametrize(
    "rest, kind",
    [
        ("VARCHAR2(50)", "VARCHAR2"), ("CHARACTER VARYING(5) NULL", "CHARACTER VARYING"), ("JSONB", "JSONB"), ("INTERVAL", "INTERVAL"),
        ("double   precision", "DOUBLE PRECISION"), ("[int] NOT NULL", "INT"), ("timestamp with time zone", "TIMESTAMP WITH TIME ZONE"),
        ("", "UNKNOWN"), ("DECIMAL (10, 2)", "DECIMAL"),
    ],
)
def test_base_type(spark, rest, kind):
    assert one(spark, D.base_type(F.lit(rest))) == kind


@pytest.mark.parametrize(
    "item, constraint",
    [
        ("IndexValue INT", False), ("CONSTRAINT x CHECK (a > 1)", True), ("UNIQUE (a)", True), ("checked BIT", False), ("CHECK (a>1)", True),
        ("PRIMARY KEY (a)", True), ("KEY ix (a)", True), ("keyword TEXT", False), ("[unique] INT", False), ("constraint_kind INT", False),
    ],
)
def test_is_constraint(spark, item, constraint):
    assert one(spark, D.is_constraint(F.lit(item))) is constraint


@pytest.mark.parametrize(
    "name, clean",
    [("[a b]", "a b"), ('"x"', "x"), ("`y`", "y"), (" id ASC ", "id"), ("[id] DESC", "id"), ("plain", "plain")],
)
def test_clean_name(spark, name, clean):
    assert one(spark, D.clean_name(F.lit(name))) == clean


def test_many_items_are_cut_in_linear_time(spark):
    body = ", ".join(f"c{i} DECIMAL(10, {i % 9}) DEFAULT (f(a, b))" for i in range(40_000))
    df = spark.createDataFrame([(body,), ("a INT",), ("",), (None,), ("a (1, 2, b",), ("a), b, c",), (",,a,,(,),",), ("a (b, (c, (d, (e, f), g)), h), i, j (k",)], "body string").repartition(1)
    items = df.select(D.body_items(F.col("body")).alias("i"))
    items.filter(F.size("i") > 3).count()
    start = time.perf_counter()
    found = [r.i for r in items.collect()]
    assert time.perf_counter() - start < 2
    assert found[0] == body.split(", c")[0:1] + [f"c{x}" for x in body.split(", c")[1:]]
    assert found[1:] == [["a INT"], [], None, ["a (1, 2, b"], ["a), b, c"], ["a", "(,)"], ["a (b, (c, (d, (e, f), g)), h)", "i", "j (k"]]


def test_items_an_alter_adds(spark):
    for text, items in {
        " ADD PRIMARY KEY (a)": ["ADD PRIMARY KEY (a)"],
        "WITH NOCHECK ADD CONSTRAINT x UNIQUE (a, b), FOREIGN KEY (c) REFERENCES d (e)": [
            "ADD CONSTRAINT x UNIQUE (a, b)", "ADD FOREIGN KEY (c) REFERENCES d (e)"],
        "DROP COLUMN a, b, ADD c INT, UNIQUE (c), ALTER COLUMN d INT, e": ["ADD c INT", "ADD UNIQUE (c)"],
        "ADD (a INT, CHECK (a > 0), UNIQUE (a))": ["ADD a INT", "ADD CHECK (a > 0)", "ADD UNIQUE (a)"],
        "": [],
    }.items():
        assert one(spark, D.added_items(F.lit(text))) == items, text
