"""Search and paging over the flat catalogue."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lakescribe.operators.ordering import ROWS_PER_RANGE, row_numbers
from lakescribe.operators.skew import grown

TABLE = ["system_name", "schema_name", "table_name"]
ORDER = TABLE
DEEP_PAGE = 100_000
#: Rows of a file of a page index, about; a file holds several ranges.
ROWS_PER_FILE = 100_000
#: The column of a page index that names a row's range.
RANGE = "range_of_index"


def holds(c: Column | str, q: str) -> Column:
    """Literal, case-insensitive containment: ``%`` and ``_`` are plain characters."""
    return F.lower(c).contains(q.lower())


def by_table_name(tables: DataFrame, q: str) -> DataFrame:
    return tables.filter(holds("table_name", q)) if q else tables


def by_field_name(tables: DataFrame, columns: DataFrame, q: str) -> DataFrame:
    """Tables with any column whose name contains ``q``."""
    if not q:
        return tables
    hits = columns.filter(holds("column_name", q)).select(*TABLE).distinct()
    return tables.join(grown(hits), TABLE, "left_semi")


def by_text(tables: DataFrame, columns: DataFrame, q: str) -> DataFrame:
    """Tables whose name, description, column names or column descriptions hold ``q``."""
    if not q:
        return tables
    in_columns = (
        columns.filter(holds("column_name", q) | holds(F.coalesce("description", F.lit("")), q))
        .select(*TABLE)
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    own = holds("table_name", q) | holds(F.coalesce("description", F.lit("")), q)
    return tables.join(grown(in_columns), TABLE, "left").filter(own | F.col("_hit")).drop("_hit")


def by_type(tables: DataFrame, table_type: str) -> DataFrame:
    return tables if table_type == "ALL" else tables.filter(F.col("table_type") == table_type)


def allowed(df: DataFrame, names: Iterable[str], upper: bool = False) -> DataFrame:
    """Rows of the listed tables, with the columns in their order, however long the list."""
    wanted = sorted({n.upper() if upper else n for n in names})
    listed = df.sparkSession.createDataFrame([(n,) for n in wanted], "table_name string")
    return df.join(listed, "table_name", "left_semi").select(*df.columns)


def one_table(tables: DataFrame, name: str) -> DataFrame:
    return tables.filter(F.col("table_name") == name)


def page(df: DataFrame, number: int = 1, size: int = 20, order: list[str] = ORDER) -> DataFrame:
    """Rows of one page, sorted in catalogue order.

    Taking the first rows of a sort is cheap for the pages people look at; a deep
    page is found by row numbers that are made range by range.
    """
    if size < 1 or number < 1:
        raise ValueError("page number and page size must be at least 1")
    if number * size > DEEP_PAGE:
        found = numbered_pages(df, [], order, size).filter(F.col("page") == number)
        return found.orderBy(*order).select(*df.columns)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def numbered_pages(df: DataFrame, group: list[str], order: list[str], size: int = 20) -> DataFrame:
    """Every row with its page number, for many or deep pages."""
    numbered = row_numbers(df, group, order, "position")
    return numbered.withColumn("page", F.ceil(F.col("position") / size).cast("int"))


def write_page_index(
    df: DataFrame, path: str, order: list[str] = ORDER, rows_per_range: int = ROWS_PER_RANGE
) -> None:
    """Store ``df`` in ranges of ``order``, with the place of each range's first row.

    ``path`` must not exist. The keys in ``order`` must tell rows apart. Rows
    are sorted into files of about ``ROWS_PER_FILE``, or ``rows_per_range`` if
    that is more, each written by one task; so no task holds more however large
    the catalogue. Every ``rows_per_range`` rows of a file are a range, which
    has pages of its own in the file, and readers find them by their numbers.
    """
    files = max(1, -(-df.count() // max(rows_per_range, ROWS_PER_FILE)))
    # the row's place, with the partition's number above the lowest 33 bits
    place = df.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn(RANGE, F.monotonically_increasing_id())
    in_file = F.col(RANGE).bitwiseAND(F.lit((1 << 33) - 1))
    ranged = place.withColumn(RANGE, F.col(RANGE) - in_file + F.floor(in_file / rows_per_range))
    rows = os.path.join(path, "rows")
    ranged.write.option("parquet.page.row.count.limit", min(rows_per_range, 20_000)).parquet(rows)
    df.withColumn(RANGE, F.lit(0).cast("long")).limit(0).write.parquet(os.path.join(path, "shape"))  # an empty catalogue has pages too, without rows
    counted = (
        df.sparkSession.read.schema(ranged.schema).parquet(rows)
        .groupBy(RANGE, F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    )
    before = Window.orderBy(RANGE, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(os.path.join(path, "ranges"))


def indexed_page(
    spark: SparkSession, path: str, number: int = 1, size: int = 20, order: list[str] = ORDER
) -> DataFrame:
    """One page of a stored index, sorted; only the ranges that it touches are read, however deep it is.

    The driver reads the numbers of those ranges, at most one per row of the
    page. A page behind the last has no rows.
    """
    if size < 1 or number < 1:
        raise ValueError("page number and page size must be at least 1")
    start = (number - 1) * size
    touched = (
        spark.read.parquet(os.path.join(path, "ranges"))
        .filter((F.col("before") < start + size) & (F.col("before") + F.col("n") > start))
        .select(RANGE, "file", "before")
        .collect()
    )
    shape = spark.read.parquet(os.path.join(path, "shape")).schema
    # files by name: reading the whole folder would list them all
    files = sorted({os.path.join(path, "rows", r["file"]) for r in touched}) or [os.path.join(path, "shape")]
    numbers = [r[RANGE] for r in touched]
    first, last = min(numbers, default=0), max(numbers, default=0)
    found = spark.read.schema(shape).parquet(*files).filter(F.col(RANGE).between(first, last)).drop(RANGE)
    skipped = start - min((r["before"] for r in touched), default=start)
    return found.orderBy(*order).offset(skipped).limit(size)


def page_totals(df: DataFrame, size: int = 20) -> DataFrame:
    """One row: number of matches and of pages."""
    if size < 1:
        raise ValueError("page size must be at least 1")
    return df.agg(F.count("*").alias("total_matches")).withColumn(
        "total_pages", F.ceil(F.col("total_matches") / size).cast("int")
    )


def search(
    tables: DataFrame,
    columns: DataFrame,
    table_name: str = "",
    field_name: str = "",
    text: str = "",
    table_type: str = "ALL",
) -> DataFrame:
    """All filters together; empty texts filter nothing."""
    found = by_type(by_table_name(tables, table_name), table_type)
    return by_text(by_field_name(found, columns, field_name), columns, text)


def first_columns(columns: DataFrame, cap: int = 50) -> DataFrame:
    """The columns a payload shows; wide tables show their first ``cap``."""
    return columns.filter(F.col("ordinal") <= cap)
