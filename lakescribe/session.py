"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Setting that removes the shuffle files of a query when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "8", name: str = "lakescribe") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the checkpoint folder the cluster names.

    Only where the session names none, as in tests, a local folder is made and
    set; on a cluster the setting exists and every executor sees the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="lakescribe-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    What was shuffled for it is of no use any more and goes at once, not when
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    kept = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if kept is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, kept)
    return spark.read.schema(df.schema).parquet(path)
