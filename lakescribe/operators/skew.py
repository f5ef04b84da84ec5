"""Look-ups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the catalogue: sorted and merged, never broadcast.

    Spark estimates the size of derived rows from the files that they come
    from, and knows nothing of lists that are exploded or texts that are put
    together. Such an estimate may call millions of rows small enough to pass
    whole through the driver.
    """
    return df.hint("merge")


def hashed(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join with few rows for each of the other side's many: never broadcast, and hashed.

    A task holds its share of ``df`` in memory, and rows of the other side
    pass by; a merge would sort them, which takes memory for them all.
    """
    return df.hint("shuffle_hash")


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, which holds at most one row per key.

    As no key of ``right`` repeats, the join never adds rows, and only ``left``
    can have a hot key, null among them. The partitions of ``left`` that such a
    key makes large are split by adaptive execution, which reads the one row
    it needs of ``right`` with each part; counting the keys first would read
    the input twice. A ``right`` that grows with the catalogue is handed in as
    ``grown(right)``.
    """
    return left.join(right, on, how)
