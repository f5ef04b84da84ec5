"""Inclusion between columns, found from the values themselves.

Every column has a number. Grouping all values once tells in which columns each
occurs: a sparse mask, the list of (word, bits) of the columns that hold it, so
a value carries no more than its own columns however many there are. Values
with the same mask are then counted as one, and all that follows works on
distinct masks. A child lies in a parent if the parent's bit is set in every
mask of the child: the child's rarest mask names the parents that can be, and
an ``and`` over all its masks leaves those that are. No pair of rows or of
columns of a group is ever built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakescribe.operators.profile import carrier, comparable, quoted
from lakescribe.operators.skew import lookup
from lakescribe.session import materialized

WORD = 63

#: Numbers of different types are compared by their exact decimal digits.
NUMBER = "number"

Named = tuple[str, str]


# -- types -----------------------------------------------------------------------


def _is_number(kind: T.DataType) -> bool:
    return carrier(kind) in ("bigint", "double") or isinstance(kind, T.DecimalType)


def _tiny_form(text: str) -> str:
    """Sign, digits without outer zeros, and the power of ten behind them, from a number as it is printed."""
    mantissa = f"substring_index(ltrim('-', {text}), 'E', 1)"
    digits = f"ltrim('0', replace({mantissa}, '.', ''))"
    power = f"coalesce(try_cast(if(instr({text}, 'E') > 0, substring_index({text}, 'E', -1), '0') AS int), 0)"
    behind = f"if(instr({mantissa}, '.') > 0, length({mantissa}) - instr({mantissa}, '.'), 0)"
    return (
        f"concat(if(startswith({text}, '-'), '-', ''), rtrim('0', {digits}), 'e', "
        f"{power} - {behind} + length({digits}) - length(rtrim('0', {digits})))"
    )


def number_form(value: str, kind: T.DataType) -> str:
    """SQL of a number as text: its plain decimal digits, without zeros that end a fraction.

    Equal numbers have one form in whatever type they come, at any size. A
    floating number with a fraction stands for the decimal it is printed as,
    which reads back as it; one without for its exact value. Numbers nearer to
    0 than a millionth are written as digits and a power of ten; all zeros are
    ``0``; floating numbers from 10**38 on, infinities and NaN, which no exact
    number equals, are as they are printed.
    """
    trimmed = "rtrim('.', rtrim('0', CAST({} AS string)))".format
    if isinstance(kind, T.DecimalType) and kind.scale:
        text = f"CAST({value} AS string)"
        return (
            f"CASE WHEN CAST({value} AS double) = 0D THEN '0' "
            f"WHEN instr({text}, 'E') > 0 OR startswith(ltrim('-', {text}), '0.000000') THEN {_tiny_form(text)} "
            f"ELSE {trimmed(value)} END"
        )
    if carrier(kind) != "double":
        return f"CAST({value} AS string)"
    x = f"CAST({value} AS double)"
    text = f"CAST({x} AS string)"
    # Two exact halves of 63 bits hold the whole numbers that a bigint doesn't.
    high = f"floor({x} / 9223372036854775808D)"
    halves = (
        f"CAST({high} AS decimal(19,0)) * 9223372036854775808BD "
        f"+ CAST(CAST({x} - {high} * 9223372036854775808D AS bigint) AS decimal(20,0))"
    )
    return (
        f"CASE WHEN abs({x}) < 9223372036854775808D AND {x} = floor({x}) THEN CAST(CAST({x} AS bigint) AS string) "
        f"WHEN NOT abs({x}) < 1e38D THEN {text} "
        f"WHEN abs({x}) >= 9223372036854775808D THEN CAST({halves} AS string) "
        f"WHEN abs({x}) >= 1e7D THEN {trimmed(f'CAST({text} AS decimal(38,18))')} "
        f"WHEN abs({x}) >= 0.001D THEN {text} "
        f"WHEN abs({x}) >= 0.000001D THEN {trimmed(f'CAST({text} AS decimal(38,30))')} "
        f"ELSE {_tiny_form(text)} END"
    )


def common_carrier(a: T.DataType, b: T.DataType) -> str | None:
    """Type in which values of two types are compared; null where they can't be.

    Numbers of different types meet in ``NUMBER``, dates and times as times.
    """
    kinds = {carrier(a), carrier(b)}
    if len(kinds) == 1:
        return kinds.pop()
    if _is_number(a) and _is_number(b):
        return NUMBER
    if kinds <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp"
    return None


def _carriers(types: dict[Named, T.DataType]) -> dict[str, list[Named]]:
    """Columns by the type in which they are compared: numbers of several types all in ``NUMBER``."""
    out: dict[str, list[Named]] = {}
    for column in sorted(types):
        out.setdefault(carrier(types[column]), []).append(column)
    numbers = [k for k, columns in out.items() if _is_number(types[columns[0]])]
    if len(numbers) > 1:
        out[NUMBER] = sorted(c for k in numbers for c in out.pop(k))
    return out


def _types(frames: dict[str, DataFrame]) -> dict[Named, T.DataType]:
    return {(t, f.name): f.dataType for t, df in frames.items() for f in df.schema.fields}


# -- masks -----------------------------------------------------------------------


def _together(parts: list[DataFrame]) -> DataFrame:
    """Union in a tree, so that the plan of thousands of parts isn't thousands deep."""
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a.unionByName(b), parts[i : i + 8]) for i in range(0, len(parts), 8)]
    return parts[0]


def _values(frames: dict[str, DataFrame], columns: list[tuple[int, Named]], kind: str) -> DataFrame:
    """(i, value): values of the numbered columns, in one scan per table; nulls left out."""
    by_table: dict[str, list[str]] = {}
    for i, (table, column) in columns:
        field = frames[table].schema[column]
        value = comparable(field)
        if kind == NUMBER:
            value = number_form(quoted(column), field.dataType)
        elif carrier(field.dataType) != kind:
            value = f"CAST({quoted(column)} AS {kind})"
        by_table.setdefault(table, []).append(f"struct({i} AS i, {value} AS value)")
    parts = [frames[t].selectExpr(f"inline(array({', '.join(items)}))") for t, items in by_table.items()]
    return _together(parts).filter("value IS NOT NULL")


def masks(values: DataFrame, one_word: bool = False) -> DataFrame:
    """(mask, n): the distinct masks of ``values`` (i, value) and the number of values that have them.

    A mask is the sorted list of the words that aren't empty. Repeats fold
    before either shuffle; a value's row has as many words as its columns fill.
    """
    words = values.groupBy("value", F.expr(f"i DIV {WORD}").cast("int").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, i % {WORD}))").alias("b")
    )
    one = F.struct("w", "b")
    if one_word:  # all columns are in the same one, so there is nothing to put together
        per_value = words.select(F.array(one).alias("mask"))
    else:
        per_value = words.groupBy("value").agg(F.array_sort(F.collect_list(one)).alias("mask")).select("mask")
    return per_value.groupBy("mask").agg(F.count("*").alias("n"))


def _all_masks(frames: dict[str, DataFrame], columns: list[tuple[str, Named]]) -> DataFrame:
    """Masks over columns (carrier, name), numbered by their place; values of different carriers never meet."""
    by_kind: dict[str, list[tuple[int, Named]]] = {}
    for i, (kind, column) in enumerate(columns):
        by_kind.setdefault(kind, []).append((i, column))
    return _together(
        [
            masks(_values(frames, own, kind), len({i // WORD for i, _ in own}) == 1)
            for kind, own in by_kind.items()
        ]
    )


def _bits(mask: str) -> str:
    """SQL array of the numbers of the columns in a mask."""
    return (
        f"flatten(transform({mask}, m -> transform(filter(sequence(0, {WORD - 1}), k -> getbit(m.b, k) = 1), "
        f"k -> m.w * {WORD} + k)))"
    )


def _word(mask: str, w: str) -> str:
    return f"coalesce(get(filter({mask}, m -> m.w = {w}), 0).b, 0L)"


def _members(found: DataFrame) -> DataFrame:
    """(child, mask, n) with one row per distinct mask and column in it."""
    return found.selectExpr(f"explode({_bits('mask')}) AS child", "mask", "n")


# -- answers ---------------------------------------------------------------------

_PAIRS = (
    "child_table string, child_column string, parent_table string, parent_column string, n_child bigint, n_parent bigint"
)


def _included(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs (child, parent) of numbers from ``listed`` (i, t, is_child, is_parent) with their distinct values."""
    members = _members(found)
    spread = F.expr("aggregate(mask, 0L, (s, m) -> s + bit_count(m.b))")
    known = members.groupBy("child").agg(
        F.sum("n").alias("n"), F.min(F.struct(spread.alias("size"), "mask")).alias("rarest")
    )
    asked = lookup(known, listed.select(F.col("i").alias("child"), "t", "is_child"), ["child"]).filter("is_child")
    sizes = lookup(known.select(F.col("child").alias("i"), F.col("n").alias("n_parent")), listed, ["i"]).filter("is_parent")
    parents = sizes.select(F.col("i").alias("parent"), F.col("t").alias("parent_t"), "n_parent")
    may = (
        asked.selectExpr("child", "t", "n AS n_child", f"explode({_bits('rarest.mask')}) AS parent")
        .join(parents, "parent")
        .filter("t <> parent_t AND n_parent >= n_child")
        .select("child", "parent", "n_child", "n_parent")
    )
    words = may.groupBy("child", F.expr(f"parent DIV {WORD}").cast("int").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, parent % {WORD}))").alias("b")
    )
    open_words = words.groupBy("child").agg(F.collect_list(F.struct("w", "b")).alias("open"))
    left = (
        members.join(open_words, "child")
        .selectExpr("child", f"inline(transform(open, o -> struct(o.w AS w, o.b & {_word('mask', 'o.w')} AS b)))")
        .groupBy("child", "w")
        .agg(F.expr("bit_and(b)").alias("b"))
        .filter("b <> 0")
        .selectExpr("child", f"explode({_bits('array(struct(w, b))')}) AS parent")
    )
    return may.join(left, ["child", "parent"])


def inclusions(
    frames: dict[str, DataFrame], children: list[Named], parents: list[Named]
) -> DataFrame:
    """All pairs (child, parent) of different tables with every child value in the parent.

    ``children`` and ``parents`` name (table, column). Columns are compared
    within their carrier type; numbers of all types are compared with each
    other, exactly. A child without values is included in nothing.
    """
    spark = next(iter(frames.values())).sparkSession
    known = _types(frames)
    is_child, is_parent = set(children), set(parents)
    columns = [
        (kind, c)
        for kind, own in _carriers({c: known[c] for c in is_child | is_parent}).items()
        if is_child.intersection(own) and is_parent.intersection(own)
        for c in own
    ]
    if not columns:
        return spark.createDataFrame([], _PAIRS)
    rows = [(i, *c, c in is_child, c in is_parent) for i, (_, c) in enumerate(columns)]
    listed = spark.createDataFrame(rows, "i int, t string, c string, is_child boolean, is_parent boolean")
    pairs = _included(materialized(_all_masks(frames, columns), "masks"), listed)
    named = {role: listed.selectExpr(f"i AS {role}", f"t AS {role}_table", f"c AS {role}_column") for role in ("child", "parent")}
    return lookup(lookup(pairs, named["child"], ["child"]), named["parent"], ["parent"]).select(
        "child_table", "child_column", "parent_table", "parent_column", "n_child", "n_parent"
    )


def _answered(spark: SparkSession, found: DataFrame, asked: list[tuple[int, int, int]]) -> DataFrame:
    """(pair, n_child, n_missing) of the asked (pair, child, parent), children with values only."""
    pairs = spark.createDataFrame(asked, "pair int, child int, parent int")
    by_child = pairs.groupBy("child").agg(F.collect_list(F.struct("pair", "parent")).alias("asked"))
    held = f"shiftrightunsigned({_word('mask', f'parent DIV {WORD}')}, parent % {WORD}) & 1L"
    return (
        _members(found)
        .join(by_child, "child")
        .selectExpr("mask", "n", "inline(asked)")
        .selectExpr("pair", "n", f"{held} = 0 AS missing")
        .groupBy("pair")
        .agg(F.sum("n").alias("n_child"), F.sum(F.expr("if(missing, n, 0L)")).alias("n_missing"))
    )


def missing_counts(frames: dict[str, DataFrame], pairs: list[tuple[Named, Named]]) -> DataFrame:
    """Distinct child values of each given pair, and how many the parent lacks.

    One row per pair, also for children without values (0 and 0). Columns of
    different types are compared in ``common_carrier``; where there is none, or
    a column is not there, the counts are null and ``reason`` says why. All
    pairs of a carrier are answered by one grouping of the values.
    """
    spark = next(iter(frames.values())).sparkSession
    types = _types(frames)
    asked: list[tuple[int, int, int]] = []
    index: dict[tuple[str, Named], int] = {}
    rows = []
    for i, (c, p) in enumerate(pairs):
        kind = common_carrier(types[c], types[p]) if c in types and p in types else None
        reason = None if kind else "types cannot be compared" if c in types and p in types else "no such column"
        rows.append((i, *c, *p, reason))
        if kind:
            asked.append((i, *(index.setdefault((kind, column), len(index)) for column in (c, p))))
    named = spark.createDataFrame(
        rows,
        "pair int, child_table string, child_column string, parent_table string, parent_column string, reason string",
    )
    if asked:
        counted = _answered(spark, _all_masks(frames, list(index)), asked)
    else:
        counted = spark.createDataFrame([], "pair int, n_child bigint, n_missing bigint")
    known = lambda n: F.when(F.col("reason").isNull(), F.coalesce(n, F.lit(0))).alias(n)
    return named.join(counted, "pair", "left").select(
        "child_table", "child_column", "parent_table", "parent_column", known("n_child"), known("n_missing"), "reason"
    )


def inclusion(
    child: DataFrame, child_column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """One row for one pair: distinct child values and those the parent lacks."""
    return missing_counts(
        {"child": child, "parent": parent}, [(("child", child_column), ("parent", parent_column))]
    ).select("n_child", "n_missing")
