"""Scalar functions on names, sizes, times and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Table-name prefixes that carry no meaning of their own, in order of preference
# when several tables match one column name (fixed values).
TABLE_PREFIXES = ("dim_", "fact_", "vw_", "stg_", "int_", "lkp_")

# Size units in steps of 1024 (fixed values).
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_as_col(c), F.lit(""))


def first_text(*candidates: Column | str) -> Column:
    """The first candidate that is neither null nor empty, else an empty text."""
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(""))


def format_size(size_bytes: Column | str) -> Column:
    """Bytes as text: ``1300234`` -> ``1.24MB``; null -> ``0B``.

    The two decimals come from whole-number arithmetic with ties to the even
    digit, so no binary fraction can tip the last digit.
    """
    b = _as_col(size_bytes).cast("decimal(38,0)")

    def text(power: int) -> Column:
        unit = F.lit(1024**power).cast("decimal(38,0)")
        hundredths = F.floor(b * 100 / unit).cast("decimal(38,0)")
        hundredths = F.when(hundredths * unit > b * 100, hundredths - 1).otherwise(
            hundredths
        )
        rest = b * 100 - hundredths * unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (hundredths % 2 == 1))
        rounded = (hundredths + F.when(up, 1).otherwise(0)).cast("decimal(38,0)")
        whole = F.floor(rounded / 100).cast("bigint")
        part = F.lpad((rounded % 100).cast("int").cast("string"), 2, "0")
        number = F.regexp_replace(
            F.concat(whole.cast("string"), F.lit("."), part), r"\.?0+$", ""
        )
        return F.concat(number, F.lit(SIZE_UNITS[power]))

    ladder = F.when(b.isNull(), F.lit("0B"))
    for power in range(len(SIZE_UNITS) - 1):
        ladder = ladder.when(b < F.lit(1024 ** (power + 1)).cast("decimal(38,0)"), text(power))
    return ladder.otherwise(text(len(SIZE_UNITS) - 1))


def utc_stamp(at: Column | None = None) -> Column:
    """A moment, or the start of the job, in UTC as ``YYYY-MM-DDTHH:MM:SSZ``."""
    utc = F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def row_total_text(rows: Column | str) -> Column:
    """``17878649`` -> ``17.88M``; below a million with thousands commas."""
    n = _as_col(rows).cast("bigint")
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / F.lit(1e6))).otherwise(
        F.format_number(n, 0)
    )


def minute_text(iso: Column | str) -> Column:
    """ISO time to ``YYYY-MM-DD HH:MM UTC`` on its own clock; else unchanged."""
    raw = _as_col(iso)
    clock = F.regexp_replace(raw, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    # words such as "yesterday" are times to the parser, but not ISO times
    is_iso = clock.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ][\d:.,]+)?$")
    parsed = F.when(is_iso, clock.try_cast("timestamp_ntz")).cast("string")
    return F.coalesce(F.concat(F.substring(parsed, 1, 16), F.lit(" UTC")), raw)


def shorten(text: Column | str, limit: int = 200) -> Column:
    t = _as_col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def bare_table_name(name: Column | str) -> Column:
    """The table name without one leading known prefix."""
    return F.regexp_replace(_as_col(name), f"^(?:{'|'.join(TABLE_PREFIXES)})", "")


def prefix_rank(name: Column | str) -> Column:
    """Preference among matching tables: unprefixed first, then by prefix order."""
    n = _as_col(name)
    ladder = None
    for i, prefix in enumerate(TABLE_PREFIXES):
        hit = n.startswith(prefix)
        ladder = F.when(hit, i + 1) if ladder is None else ladder.when(hit, i + 1)
    return ladder.otherwise(0)


def entity_names(column_name: Column | str) -> Column:
    """Names of tables a column may point to, from its id / key suffix."""
    c = _as_col(column_name)
    found = F.array_compact(
        F.array(
            F.when(c.endswith("_id"), F.substr(c, F.lit(1), F.length(c) - 3)).when(
                c.endswith("id") & (F.length(c) > 2), F.substr(c, F.lit(1), F.length(c) - 2)
            ),
            F.when(c.endswith("_key"), F.substr(c, F.lit(1), F.length(c) - 4)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def collapse_spaces(text: Column | str) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(_as_col(text), r"(?U)\s+", " "))


def pages(total: Column | str, page_size: int) -> Column:
    """How many pages of ``page_size`` hold ``total`` rows."""
    return F.ceil(_as_col(total) / F.lit(page_size)).cast("int")


def is_yes(c: Column | str) -> Column:
    """``YES`` / ``Y`` dictionary flags to boolean."""
    return F.coalesce(_as_col(c).isin("YES", "Y"), F.lit(False))


def token_estimate(text: Column | str) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(_as_col(text)) / 4)


def plain_text(text: Column | str) -> Column:
    """Text without runs of ``*`` and backticks."""
    return F.regexp_replace(_as_col(text), "[*`]+", "")


def type_family(data_type: Column | str) -> Column:
    """Coarse family of a declared type, used to compare keys."""
    t = F.upper(_as_col(data_type))
    return (
        F.when(t.rlike(r"^(ARRAY|MAP|STRUCT|VARIANT|OBJECT|JSON|RECORD)"), "NESTED")
        .when(t.rlike(r"^(INTERVAL)"), "INTERVAL")
        .when(t.rlike(r"^((TINY|SMALL|MEDIUM|BIG)?INT(EGER)?[248]?|SERIAL|BIGSERIAL|LONG|INT64)\b"), "INT")
        .when(t.rlike(r"^(DECIMAL|NUMERIC|NUMBER|MONEY|SMALLMONEY|BIGNUMERIC)\b"), "DECIMAL")
        .when(t.rlike(r"^(FLOAT|DOUBLE|REAL)"), "FLOAT")
        .when(t.rlike(r"^(BOOL|BIT\b)"), "BOOL")
        .when(t.rlike(r"^(DATETIME|TIMESTAMP|SMALLDATETIME|TIME)"), "TIMESTAMP")
        .when(t.rlike(r"^DATE\b"), "DATE")
        .when(t.rlike(r"^(UUID|UNIQUEIDENTIFIER)\b"), "UUID")
        .when(t.rlike(r"^(BINARY|VARBINARY|BYTEA|BLOB|IMAGE|RAW|BYTES)\b"), "BINARY")
        .otherwise("STRING")
    )


def source_label(project_id: Column, database: Column, db_type: Column) -> Column:
    """Name of a saved extract: project, else database, else source type."""
    return F.coalesce(blank_to_null(project_id), blank_to_null(database), db_type)


def reference_label(fk_table, fk_column, inf_table, inf_column) -> Column:
    """``table.column`` of a reference; native first, mark when inferred."""
    table = F.coalesce(blank_to_null(fk_table), blank_to_null(inf_table))
    column = F.coalesce(blank_to_null(fk_column), blank_to_null(inf_column), F.lit("PK"))
    mark = F.when(blank_to_null(inf_table).isNotNull(), F.lit(" (AI)")).otherwise("")
    return F.when(table.isNotNull(), F.concat(table, F.lit("."), column, mark))
