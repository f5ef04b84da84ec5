"""Saved catalogues: documents, the store of systems, and look-ups."""

from __future__ import annotations

import hashlib
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakescribe.operators.skew import grown
from lakescribe.session import materialized

# Fields a system that is already stored takes from the new extract; the others
# keep their first value (fixed values).
REFRESHED = ("metadata", "added_at")
KEPT = ("owner_name", "user_id", "source_type")

# Documents of a compressed file, so that readers have files enough to share.
DOCUMENTS_PER_FILE = 16

# What tells documents apart.
DOCUMENT = ("system_name", "schema_name", "part")

STORE = (
    "system_name string, owner_name string, user_id string, source_type string, "
    "added_at string, metadata string"
)


def run_name(label: str, now: datetime | None = None) -> str:
    """``label_YYYYmmdd_HHMMSS_hex6``, new for every run."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return f"{label}_{stamp}_{uuid.uuid4().hex[:6]}"


def document_json(docs: DataFrame, systems: DataFrame) -> DataFrame:
    """(system_name, schema_name, part, doc) with the document as JSON text.

    ``systems`` holds system_name, db_type, database and extracted_at.
    """
    head = F.struct(
        "db_type", "database", F.col("schema_name").alias("schema"), "extracted_at"
    ).alias("source")
    body = F.array(F.struct("schema_name", "tables")).alias("schemas")
    return docs.join(systems, "system_name", "left").select(
        "system_name",
        "schema_name",
        "part",
        F.to_json(F.struct(head, body), {"ignoreNullFields": "false"}).alias("doc"),
    )


def document_pieces(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """(system_name, schema_name, part, place, piece): the texts of ``document_json`` in pieces.

    ``rows`` are those of ``assemble.document_tables``. A document is its
    pieces in the order of ``place``: every table is one, the first has the
    document's head before it, and the tail comes last.
    """
    whole = {"ignoreNullFields": "false"}
    unclosed = lambda text: F.substr(text, F.lit(1), F.length(text) - 1)
    source = F.struct("db_type", "database", F.col("schema_name").alias("schema"), "extracted_at").alias("source")
    head = F.concat(
        unclosed(F.to_json(F.struct(source), whole)), F.lit(',"schemas":['),
        unclosed(F.to_json(F.struct("schema_name"), whole)), F.lit(',"tables":['),
    )
    table = F.to_json("table", whole)
    entry = lambda place, text: F.struct(place.alias("place"), text.alias("piece"))
    pieces = F.when(
        F.col("place") == 1,
        F.array(entry(F.col("place"), F.concat(head, table)), entry(F.lit(2**63 - 1), F.lit("]}]}"))),
    ).otherwise(F.array(entry(F.col("place"), F.concat(F.lit(","), table))))
    return rows.join(systems, "system_name", "left").select(*DOCUMENT, F.inline(pieces))


def _in_order(pieces: DataFrame) -> DataFrame:
    """Pieces with those of a document one after the other, sorted on disk where they are many."""
    return pieces.repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "place")


def document_digests(pieces: DataFrame) -> DataFrame:
    """(system_name, schema_name, part, doc_sha256) of documents in pieces.

    A digest takes a text from its start to its end, so one task reads a
    document, piece by piece; it holds a batch of pieces at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for pdf in batches:
            done = []
            for *own, piece in pdf.itertuples(index=False, name=None):
                own = [None if pd.isna(x) else x for x in own]
                if own != key:
                    if digest is not None:
                        done.append([*key, digest.hexdigest()])
                    key, digest = own, hashlib.sha256()
                digest.update(piece.encode())
            yield pd.DataFrame(done, columns=[*DOCUMENT, "doc_sha256"])
        if digest is not None:
            yield pd.DataFrame([[*key, digest.hexdigest()]], columns=[*DOCUMENT, "doc_sha256"])

    kinds = "system_name string, schema_name string, part int, doc_sha256 string"
    return _in_order(pieces).select(*DOCUMENT, "piece").mapInPandas(run, kinds)


def save_documents(docs: DataFrame, directory: str, label: str, compression: str = "none") -> str:
    """Write one document per line into a new folder and return its path.

    A compressed file is read by one task from its start to its end, so it
    holds ``DOCUMENTS_PER_FILE`` at most.
    """
    path = os.path.join(directory, run_name(label))
    lines = docs.select(F.col("doc").alias("value")).write.option("compression", compression)
    if compression != "none":
        lines = lines.option("maxRecordsPerFile", DOCUMENTS_PER_FILE)
    lines.text(path)
    return path


def save_each_document(docs: DataFrame, directory: str, label: str) -> str:
    """Write every document into a file of its own and return the path of the run.

    The file lies in a folder named after its system, schema and part, so tasks
    write apart from each other and a reader finds one document by its path.
    """
    path = os.path.join(directory, run_name(label))
    docs.select("system_name", "schema_name", "part", F.col("doc").alias("value")).write.partitionBy(
        "system_name", "schema_name", "part"
    ).text(path)
    return path


def save_each_document_in_pieces(pieces: DataFrame, directory: str, label: str) -> str:
    """``save_each_document`` of the rows of ``document_pieces``: a file per document, which is never one row.

    One task writes a file, piece by piece, in the order of ``place``; pieces
    that don't fit its memory are sorted on disk. Spark's writer ends every row
    with a separator, so the closing brace that ends every piece is the
    separator. A line end would need a row of its own, so it stands before the
    text instead of behind it: the size is that of the text and one line end.
    """
    path = os.path.join(directory, run_name(label))
    # Spark's writer sorts anew, without the places, where a folder's name may be null or is known to be a constant
    stored = materialized(pieces.select(*DOCUMENT, "place", "piece"), "pieces")
    named = stored.withColumns({f"_no_{c}": F.col(c).isNull() for c in DOCUMENT[:2]}).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in DOCUMENT[:2]}
    )
    ordered = named.repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, *[f"_no_{c}" for c in DOCUMENT[:2]], "place")
    unclosed = F.substr("piece", F.lit(1), F.length("piece") - 1)
    line_end = F.when(F.col("place") == 1, "\n").otherwise("")
    ordered.select(*DOCUMENT, F.concat(line_end, unclosed).alias("value")).write.partitionBy(*DOCUMENT).option(
        "lineSep", "}"
    ).text(path)
    return path


def saved_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of every file of a run, from the listing alone."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("saved_to"), F.regexp_extract("path", "[^/]+$", 0).alias("filename"),
                F.col("length").alias("size_bytes"))
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store after an extract: known systems refreshed, others added.

    Both sides hold one row per system. The result is a new version; the old one
    is not touched.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(grown(n), F.col("o.system_name") == F.col("n.system_name"), "full_outer")
    known = F.col("o.system_name").isNotNull()
    out = [F.coalesce("o.system_name", "n.system_name").alias("system_name")]
    for name in KEPT:
        out.append(F.when(known, F.col(f"o.{name}")).otherwise(F.col(f"n.{name}")).alias(name))
    for name in reversed(REFRESHED):
        fresh = F.col("n.system_name").isNotNull()
        out.append(F.when(fresh, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
    return joined.select(*out)


def _hadoop(spark: SparkSession, directory: str):
    """(file system, maker of paths) for a folder in whatever store Spark knows."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _claims(spark: SparkSession, directory: str) -> list[tuple[int, str]]:
    """(number, path) of all version files, oldest first, finished or not."""
    fs, make = _hadoop(spark, directory)
    if not fs.exists(make(directory)):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(make(directory))]
    return sorted((int(n[1:9]), p) for n, p in names if re.fullmatch(r"v\d{8}\.version", n))


def _folder(spark: SparkSession, directory: str, claim: str) -> str | None:
    """Folder that a version file names; None while its writer hasn't written the name."""
    fs, make = _hadoop(spark, directory)
    held = fs.open(make(claim))
    try:
        name = bytes(held.readAllBytes()).decode()
    finally:
        held.close()
    return os.path.join(directory, name.strip()) if name.endswith("\n") else None


def versions(spark: SparkSession, directory: str) -> list[str]:
    """Folders of complete store versions, oldest first."""
    found = [_folder(spark, directory, claim) for _, claim in _claims(spark, directory)]
    return [f for f in found if f is not None]


def read_store(spark: SparkSession, directory: str) -> DataFrame:
    """The newest version of the store; a store never written is empty."""
    found = versions(spark, directory)
    return spark.read.schema(STORE).parquet(found[-1]) if found else spark.createDataFrame([], STORE)


def _claim(spark: SparkSession, directory: str, number: int, folder: str) -> bool:
    """Make ``folder`` version ``number``; False where another writer has that number.

    The file that names a version is created only if it is absent, which the
    store decides: of two writers one gets the number. A local file system
    decides it by a link, as Hadoop's client there looks first and creates then.
    """
    fs, make = _hadoop(spark, directory)
    target = make(os.path.join(directory, f"v{number:08d}.version"))
    if fs.getScheme() == "file":
        path = target.toUri().getPath()
        written = os.path.join(os.path.dirname(path), f".{folder}")
        with open(written, "w") as out:
            out.write(f"{folder}\n")
        try:
            os.link(written, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(written)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    return True


def update_store(
    spark: SparkSession, directory: str, change: Callable[[DataFrame], DataFrame], attempts: int = 20
) -> str:
    """Write ``change(newest store)`` as the next version; its folder.

    The rows are written first, into a folder of their own, and become a
    version only if no other has come since the one they were made from.
    Else ``change`` is applied again, to the newer store, so that no update is
    lost; after ``attempts`` the update fails. Versions that writers left
    without a name are passed over once they are a minute old.
    """
    fs, make = _hadoop(spark, directory)
    for attempt in range(attempts):
        claims = _claims(spark, directory)
        newest = _folder(spark, directory, claims[-1][1]) if claims else None
        if claims and newest is None:
            age = time.time() - fs.getFileStatus(make(claims[-1][1])).getModificationTime() / 1000
            if age < 60:  # its writer is about to name it
                time.sleep(min(5, 0.1 * 2**attempt))
                continue
        base = spark.read.schema(STORE).parquet(newest) if newest else read_store(spark, directory)
        folder = f"data-{uuid.uuid4().hex}"
        change(base).write.parquet(os.path.join(directory, folder))
        if _claim(spark, directory, claims[-1][0] + 1 if claims else 1, folder):
            return os.path.join(directory, folder)
        fs.delete(make(os.path.join(directory, folder)), True)
    raise RuntimeError(f"{directory}: other writers took the next version {attempts} times")


def upsert_store(spark: SparkSession, directory: str, new: DataFrame) -> str:
    """Extracted systems into the store as its next version, whatever other writers add meanwhile."""
    return update_store(spark, directory, lambda old: upsert(old, new))


def find(
    store: DataFrame, system_name: str, user_id: str | None = None, owner_name: str | None = None
) -> DataFrame:
    """The entry of a system, optionally of one user and owner."""
    found = store.filter(F.col("system_name") == system_name)
    if user_id:
        found = found.filter(F.col("user_id") == user_id)
    if owner_name:
        found = found.filter(F.col("owner_name") == owner_name)
    return found.orderBy("added_at").limit(1)


def request_status(requested: DataFrame, store: DataFrame) -> DataFrame:
    """ok / not found / no metadata for every requested system."""
    known = store.groupBy("system_name").agg(
        F.bool_or(F.coalesce(F.col("metadata"), F.lit("")) != "").alias("_has")
    )
    return (
        requested.select("system_name")
        .distinct()
        .join(known, "system_name", "left")
        .select(
            "system_name",
            F.when(F.col("_has").isNull(), "not found")
            .when(~F.col("_has"), "no metadata")
            .otherwise("ok")
            .alias("status"),
        )
    )
