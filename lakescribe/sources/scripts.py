"""A corpus of SQL script files as a source."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakescribe.functions import ddl_text


@contextmanager
def replacing_bad_bytes(spark: SparkSession):
    """Expressions built inside replace malformed UTF-16 instead of failing."""
    name = "spark.sql.legacy.codingErrorAction"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def decode_scripts(files: DataFrame) -> DataFrame:
    """(system_name, path, content) to (system_name, path, text) with unix lines."""
    with replacing_bad_bytes(files.sparkSession):
        text: Column = ddl_text.unix_lines(ddl_text.decode_script(F.col("content")))
        return files.select("system_name", "path", text.alias("text"))


def read_scripts(spark: SparkSession, path: str, system_name: str = "scripts") -> DataFrame:
    """All files under ``path``, one row each, decoded."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.lit(system_name).alias("system_name"), "path", "content")
    )
    return decode_scripts(files)
