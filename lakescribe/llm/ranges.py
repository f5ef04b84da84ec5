"""Running totals in a global order, over groups of any size, in DataFrame functions.

Rows are dealt to ranges of (group, order) by Spark's range partitioning and
written. Totals then run inside each range, and the totals of the group's
earlier ranges are added, so that no task sees more than a range and the list
of a group's ranges. Bounds stay with Spark; nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakescribe.session import materialized


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a running sum per entry of ``sums``, from the start of the row's group up to itself.

    ``df`` is read twice, so it should be a written table. Nulls of ``order``
    come first. Rows of equal (group, order) are summed one after the other;
    which comes first is open. An empty group list makes one global order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    own = {f"own of {n}": e for n, e in sums.items()}
    dealt = df.withColumns(own).repartitionByRange(parts, *keys).withColumn("part of all", F.spark_partition_id())
    dealt = materialized(dealt, "ranges")
    place = [*group, "part of all"]
    earlier = Window.partitionBy(*group).orderBy("part of all").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*place)
        .agg(*(F.sum(c).alias(c) for c in own))
        .select(*place, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before {c}") for c in own))
    )
    upto = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumns({f"upto {c}": F.sum(c).over(upto) for c in own})
    same = F.lit(True)
    for c in place:
        same = same & inside[c].eqNullSafe(before[c])
    return inside.join(before, same).select(
        *(inside[c] for c in df.columns),
        *((F.col(f"before {c}") + F.col(f"upto {c}")).alias(n) for n, c in zip(sums, own)),
    )
