"""Benchmark items inside documents, by shingle containment.

Items are partitioned by size. An item with n shingles that is contained to
the share t misses at most (1 - t) n of them, so of any (1 - t) n + 1 of its
shingles one at least is in the document. The MinHash sketch of an item is
its smallest shingle hashes, as many as the largest size of its class calls
for; a document that holds one of them is a candidate, and no contained item
is missed, however long the document. Candidates are decided on the shingles
themselves.

Items are a table and stay one: tasks hold a filter of fixed size over the
hashes of all item shingles, read every document once, and pass on only the
shingles that the filter lets through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakescribe.llm import text as tx
from lakescribe.session import materialized

#: Bits of the filter: two to this power (8 MB).
FILTER_BITS = 26

#: All ASCII but letters and digits separates words; all other characters belong to words.
SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

ROW = "doc_id long, print long, item_id long, n_shared long, n_shingles long, containment double"


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, places: np.ndarray) -> list[bytes]:
    """The shingles of k words that begin at ``places``, lower-cased, words joined by a blank."""
    lowered = tx.LOWER[data].tobytes()
    return [b" ".join(lowered[starts[j] : ends[j]] for j in range(i, i + k)) for i in places.tolist()]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k words in a row."""
    return tx.gram_hash(words, k) if k else np.empty(0, np.uint64)


def sketch_size(n: int, share: float) -> int:
    """Smallest hashes that the size class of n (a power of two and up to the next) calls for."""
    largest = (1 << n.bit_length()) - 1
    return largest - math.ceil(largest * share - 1e-9) + 1


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_shingles(items: DataFrame, k: int, share: float) -> DataFrame:
    """(number, item_id, width, n, shingle, bit, sketch): the distinct shingles of every item, written; bits from 1.

    An item of fewer than ``k`` words is one shingle of all of them. ``sketch``
    marks the smallest hashes of the item, as many as its size class calls for.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "item_id", "width", "n", "shingle", "bit", "sketch"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
        for batch in batches:
            for row, data, starts, ends, words in tx.document_words(batch.column(2), SEPARATOR, tx.LOWER):
                width = min(k, len(words))
                hashes, places = np.unique(shingle_hashes(words, width), return_index=True)
                if not len(hashes):
                    continue
                shingles = _texts(data, starts, ends, width, places)
                n = len(hashes)
                sketch = np.arange(n) < sketch_size(n, share)
                number, item = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                columns = [[number] * n, [item] * n, [width] * n, [n] * n, shingles, _bit(hashes) + 1, sketch]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = items.select(
        F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long").alias("item_id"), "text"
    ).filter("text IS NOT NULL")
    schema = "number long, item_id long, width int, n long, shingle binary, bit long, sketch boolean"
    return materialized(rows.mapInArrow(cut, schema), "items")


def _filter(shingles: DataFrame) -> np.ndarray:
    """Bits of all item shingles: 2**FILTER_BITS bits, however many items there are."""
    parts = (
        shingles.groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    # Buckets of 4096 bytes are numbered from 1, as the bits are; in a byte they stand from the lowest up.
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def met_shingles(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(doc, doc_id, print, shingle): the distinct shingles of documents that the filter lets through, written."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        names, kinds = ["doc", "doc_id", "print", "shingle"], [pa.int64()] * 3 + [pa.binary()]
        columns: list[list] = [[] for _ in names]

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            own = [batch.column(i) for i in range(3)]
            for row, data, starts, ends, words in tx.document_words(batch.column(3), SEPARATOR, tx.LOWER):
                found: set[bytes] = set()
                for width in widths:
                    hashes = shingle_hashes(words, width)
                    at = _bit(hashes)
                    places = np.flatnonzero((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    if len(places):
                        _, first = np.unique(hashes[places], return_index=True)
                        found.update(_texts(data, starts, ends, width, places[first]))
                for column, value in zip(columns, own):
                    column += [value[row].as_py()] * len(found)
                columns[-1] += found
                if len(columns[0]) > 10_000:
                    yield passed()
                    columns = [[] for _ in names]
        yield passed()

    rows = docs.select(
        F.monotonically_increasing_id().alias("doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("print"),
        "text",
    )
    return materialized(rows.mapInArrow(search, "doc long, doc_id long, print long, shingle binary"), "met")


def contained(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """A row for every document and item with at least ``share`` of the item's shingles in the document.

    Rows hold doc_id, ``print``, the fingerprint of the document's text, item_id,
    n_shared, n_shingles and containment.
    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns
    are ignored. Words are runs of anything but ASCII punctuation and white
    space, with A-Z as a-z. Items without words, or null, are in nothing. An
    item of fewer than ``k`` words is one shingle, found wherever a document
    has its words in a row. Equal rows on either side give a row each; null
    ids are kept. An empty side gives no rows. Documents are read once,
    whatever the number of items.
    """
    shingles = item_shingles(items, k, share)
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())  # 1 to k, so k values at most
    met = met_shingles(docs, _filter(shingles), widths)
    candidates = (
        met.select("doc", "doc_id", "print", "shingle")
        .join(shingles.filter("sketch").select("number", "item_id", "n", "shingle"), "shingle")
        .select("doc", "doc_id", "print", "number", "item_id", "n")
        .distinct()
    )
    wanted = shingles.select("number", "shingle")
    found = (
        candidates.join(met.select("doc", "shingle"), "doc")
        .join(wanted, ["number", "shingle"])
        .groupBy("doc", "doc_id", "print", "number", "item_id", "n")
        .agg(F.count("*").alias("n_shared"))
        .filter(F.col("n_shared") >= share * F.col("n") - 1e-9)
    )
    return found.select(
        "doc_id", "print", "item_id", "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment")
    )
