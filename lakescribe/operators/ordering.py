"""Running totals over groups of any size.

A plain window puts a whole group into one task. Here the rows are cut into
ranges of the ordering key, totals run inside each range, and the totals of the
earlier ranges are added: a group is as wide as the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

ROWS_PER_RANGE = 500_000
MAX_RANGES = 65_536
SAMPLE_PER_RANGE = 8


def range_bounds(
    df: DataFrame, keys: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> list[str]:
    """Sorted key values, as JSON, that cut ``df`` into ranges of about equal size.

    They come from a sample of a few keys per range and only steer the balance; any bounds give
    the same results. Small inputs get none.
    """
    total = df.count()
    ranges = min(MAX_RANGES, math.ceil(total / rows_per_range))
    if ranges <= 1:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / total)
    picked = (
        df.select(*keys)
        .sample(share, seed=11)
        .orderBy(*keys)
        .select(F.to_json(F.struct(*keys)).alias("key"))
        .collect()
    )
    step = max(1, len(picked) // ranges)
    return list(dict.fromkeys(r.key for r in picked[step::step]))


def range_of(df: DataFrame, keys: list[str], bounds: list[str]) -> Column:
    """Number of bounds not above the row's key, by a search on two levels."""
    if not bounds:
        return F.lit(0)
    key_type = T.StructType([df.schema[k] for k in keys])
    width = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def constant(items: list[str], kind: T.DataType) -> Column:
        return F.from_json(F.lit(f"[{','.join(items)}]"), kind)

    heads = constant([g[0] for g in groups], T.ArrayType(key_type))
    bodies = constant(
        [f"[{','.join(g)}]" for g in groups], T.ArrayType(T.ArrayType(key_type))
    )
    key = F.struct(*[F.col(k).alias(k) for k in keys])
    group = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.get(bodies, group - 1), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    rows_per_range: int = ROWS_PER_RANGE,
    bounds: list[str] | None = None,
) -> DataFrame:
    """Add running totals from the start of each group up to the row itself.

    ``totals`` maps a new name to ``("sum" | "min", expression)``. The keys in
    ``group + order`` must tell rows apart. ``bounds`` may come from
    ``range_bounds`` of rows that are cheaper to read and spread alike.
    """
    combine = {"sum": F.sum, "min": F.min}
    valued = df.withColumns({f"_v_{n}": e for n, (_, e) in totals.items()})
    if bounds is None:
        bounds = range_bounds(df, group + order, rows_per_range)
    if not bounds:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return valued.withColumns(
            {n: combine[k](f"_v_{n}").over(upto) for n, (k, _) in totals.items()}
        ).drop(*[f"_v_{n}" for n in totals])

    ranged = valued.withColumn("_range", range_of(df, group + order, bounds))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        ranged.groupBy(*group, "_range")
        .agg(*[combine[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in totals.items()])
        .select(
            *[F.col(g).alias(f"_g_{g}") for g in group],
            F.col("_range").alias("_g_range"),
            *[combine[k](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in totals.items()],
        )
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = ranged.withColumns(
        {f"_l_{n}": combine[k](f"_v_{n}").over(inside) for n, (k, _) in totals.items()}
    )
    match = F.col("_range") == F.col("_g_range")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(carried, match, "left")
    added = {
        n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_l_{n}")
        if kind == "sum"
        else F.least(F.col(f"_c_{n}"), F.col(f"_l_{n}"))
        for n, (kind, _) in totals.items()
    }
    return joined.withColumns(added).select(*df.columns, *totals)


def row_numbers(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "position",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Row number from 1 within each group."""
    return running(df, group, order, {name: ("sum", F.lit(1).cast("bigint"))}, rows_per_range)
