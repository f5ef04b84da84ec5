"""A corpus pipeline of five stages, each one of the operators in lakescribe.llm.

Every stage takes the documents its predecessor kept, as Parquet, and returns
the documents it keeps; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakescribe.llm import decontaminate, exact, language, near, packing
from lakescribe.llm.registry import table
from lakescribe.session import materialized


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages learned: texts without a letter and those no mixture of languages explains go."""
    known = language.train(docs.filter(~language.held_out()))
    # columns named like those of the answer come through under another name
    own = {c: f"{c} of documents" for c in docs.columns if c in language.ANSWER}
    found = language.identify(docs.withColumnsRenamed(own), *known)
    kept = found.filter("explained")
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the row key, and the key's name, which no column of theirs has."""
    name = "row"
    while name in map(str.lower, docs.columns):
        name += "_"
    return docs.withColumn(name, exact.row_key()), name


def _keep(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row key is that of a row of ``found`` (doc_id, print), one of each."""
    keyed, name = _rows(docs)
    keys = found.select(F.struct(F.col("doc_id").alias("id"), "print").alias(name))
    return keyed.join(keys, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _keep(docs, exact.duplicates(docs).filter("kept"))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id."""
    return _keep(docs, near.near_duplicates(docs).filter("stays"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"))
    keyed, name = _rows(docs)
    keys = found.select(F.struct(F.col("doc_id").alias("id"), "print").alias(name)).distinct()
    return keyed.join(keys, name, "left_anti").select(*docs.columns)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, 1024)


STAGES = [
    ("language", stage_language),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("decontamination", stage_decontaminate),
    ("packing", stage_pack),
]

#: Language models, MinHash and token ids can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialized(docs, name)
    return docs
