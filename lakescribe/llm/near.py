"""Near duplicates: banded MinHash, odd sketches, and a check on the full sets.

A document is the set of its word shingles. Documents of the same words form
one class, and classes are compared. MinHash samples are cut into bands, and
classes that agree in a band meet in its bucket. Odd sketches fold the samples
into a parity bitmap; the bits in which two bitmaps differ estimate the
similarity of a pair, and pairs that may be similar are decided on their full
sets of shingles.

Every class is first paired with one other only: of all classes in its
buckets the one that meets most others, which among edited copies is their
original. Pairs inside a component found that way can add nothing; what is left
are pairs of a bucket's classes in different components, and these are all
compared by their sketches. Two classes that were paired with the same one are
decided there too, exactly, by the shingles in which they differ from it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.llm import text as tx
from lakescribe.llm.seeds import keyed
from lakescribe.session import materialized

#: Samples of a signature; how many of them go into bands, and into each band:
#: at a similarity of 0.8, 32 bands of 4 miss a pair with probability 5e-8.
SAMPLES, BANDED, BAND = 256, 128, 4
#: Bits of an odd sketch of all samples, and how far an estimate may be below
#: the threshold: 4.5 of its standard deviations.
SKETCH_BITS, MARGIN = 1024, 0.12

_FACTORS = tx.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = tx.mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64))
_BAND_FACTORS = tx.mix(np.arange(2001, BAND + 2001, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words; fewer words are one shingle, none are none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(tx.gram_hash(words, min(k, len(words))) + np.uint64(min(k, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``SAMPLES`` hash functions."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        values = shingles[None, a : a + 512] * _FACTORS[:, None] + _TERMS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(samples: np.ndarray) -> np.ndarray:
    """One number per band; bands of different places never agree but by chance."""
    rows = samples[:BANDED].reshape(-1, BAND)
    return tx.mix((rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of the samples that fall on each bit, as 64-bit words."""
    at = tx.mix(samples ^ tx.mix(np.arange(5001, len(samples) + 5001, dtype=np.uint64))) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing(similarity: float) -> int:
    """Bits in which the sketches of two sets of that similarity differ on average."""
    differing = 2 * SAMPLES * (1 - similarity)
    return math.floor(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def _signed(texts: DataFrame, k: int) -> DataFrame:
    """A row per document; signature columns are null where the task has signed the same words before."""
    names = ["doc_id", "slot", "print", "class", "n_shingles", "bands", "sketch"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), longs, longs]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2)]
            rows = []
            for row, data, starts, ends, words in tx.document_words(batch.column(3), fold=tx.LOWER):
                own = [c[row] for c in columns]
                if not len(words):
                    rows.append((*own, None, 0, None, None))
                    continue
                low = tx.LOWER[data].tobytes()
                name = hashlib.blake2b(b" ".join(low[s:e] for s, e in zip(starts.tolist(), ends.tolist())), digest_size=16).digest()
                if name in known:
                    rows.append((*own, name, known[name], None, None))
                    continue
                shingles = shingle_set(words, k)
                if len(known) < 1_000_000:
                    known[name] = len(shingles)
                samples = signature(shingles)
                rows.append((*own, name, len(shingles), bands(samples), odd_sketch(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return texts.select("doc_id", "slot", "print", "text").mapInArrow(
        sign,
        "doc_id long, slot long, print long, class binary, n_shingles long, bands array<long>, sketch array<long>",
    )


def _may_be_similar(left: str, right: str, percent: int) -> Column:
    """Whether sizes and sketches of two classes, in structs, allow the similarity."""
    n = [F.col(f"{side}.n_shingles") for side in (left, right)]
    words = SKETCH_BITS // 64
    differing = sum(
        F.bit_count(F.col(f"{left}.sketch")[i].bitwiseXOR(F.col(f"{right}.sketch")[i])) for i in range(words)
    )
    return (100 * F.least(*n) >= percent * F.greatest(*n)) & (
        differing <= most_differing(max(0.0, percent / 100 - MARGIN))
    )


def _compared(likely: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class numbers, with their sizes n_a and n_b, compared on their full sets.

    Adds ``similar``, and the shingles of a that b lacks (``less``) and those
    of b that a lacks (``more``).
    """
    wanted = likely.select("a").union(likely.select("b")).distinct().toDF("number")
    rows = classes.join(wanted, "number").select("number", "slot", "print")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = set()
            numbers = batch.column(0).to_pylist()
            found = []
            for row, _, _, _, words in tx.document_words(batch.column(1), fold=tx.LOWER):
                if numbers[row] not in done:
                    done.add(numbers[row])
                    found.append((numbers[row], shingle_set(words, k).view(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                    ["number", "shingles"],
                )

    full = texts.join(rows.hint("merge"), ["slot", "print"]).select("number", "text").mapInArrow(sets, "number long, shingles array<long>")
    full = materialized(full, "sets")
    found = likely.join(full.toDF("b", "set_b"), "b").join(full.toDF("a", "set_a"), "a")
    found = found.withColumn("less", F.array_except("set_a", "set_b")).withColumn("more", F.array_except("set_b", "set_a"))
    return found.select(
        "a",
        "b",
        "n_a",
        _alike(F.col("n_a") - F.size("less"), F.col("n_a"), F.col("n_b"), percent).alias("similar"),
        "less",
        "more",
    )


def _alike(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def components(links: DataFrame) -> DataFrame:
    """(number, root) of all numbers in ``links`` (a, b): the smallest number that can be reached.

    Each round takes the smallest root among neighbours and then the root's
    root, so long chains halve.
    """
    edges = materialized(links.union(links.select("b", "a")).distinct(), "edges")
    roots = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("number"), F.least("a", "b").alias("root"))
    roots = materialized(roots, "roots")
    while True:
        near = edges.join(roots.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = roots.join(near, roots.number == near.a).select("number", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        lower = materialized(lower, "lower")
        jump = lower.select(F.col("number").alias("at"), F.col("new").alias("root"))
        moved = lower.join(jump, lower.new == jump.at).select("number", "root", (F.col("root") != F.col("old")).alias("moved"))
        moved = materialized(moved, "roots")
        roots = moved.select("number", "root")
        if moved.filter("moved").isEmpty():
            return roots


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``, ``print``, the row's fingerprint, and stays.

    ``docs`` needs doc_id and text; other columns are ignored. Words are runs
    of anything but space and tab to carriage return, with A-Z as a-z. Two
    documents are linked where 100 * shared shingles >= percent * shingles of
    both. ``component_id`` is the smallest id that links lead to; a document
    without words, or with null text, is linked with nothing. Null ids come
    after all others; the component of null ids alone is null and its rows are
    kept. ``stays`` holds for one text of each component, also where its ids
    are null or repeated. Rows with equal texts are linked. An empty table gives no rows.
    """
    texts = keyed(docs)
    signed = materialized(_signed(texts, k), "signed")
    earliest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "slot", "print"))
    classes = (
        signed.filter("class is not null")
        .groupBy("class")
        .agg(
            earliest.alias("first"),
            F.max("n_shingles").alias("n_shingles"),
            F.first("bands", ignorenulls=True).alias("bands"),
            F.first("sketch", ignorenulls=True).alias("sketch"),
        )
        .select("class", "first.doc_id", "first.slot", "first.print", "n_shingles", "bands", "sketch")
        .withColumn("number", F.monotonically_increasing_id())
    )
    classes = materialized(classes, "classes")
    met = classes.select("number", F.explode("bands").alias("bucket"))
    full = met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialized(met.join(materialized(full, "buckets"), "bucket"), "members")
    # The more rows a class shares buckets with, the better a centre it is; ties go to the smaller number.
    meets = members.groupBy("number").agg(F.sum("n").alias("meets"))
    meets = materialized(meets.select("number", F.struct("meets", -F.col("number")).alias("rank")), "meets")
    ranked = members.join(meets, "number").select("bucket", "number", "rank")
    best = materialized(ranked.groupBy("bucket").agg(F.max("rank").alias("best")), "best")
    own = classes.select("number", F.struct("n_shingles", "sketch", "bands").alias("about"))
    pairs = ranked.join(best, "bucket").groupBy("number").agg(F.max("best").alias("best"), F.max("rank").alias("rank"))
    pairs = pairs.filter("best != rank").select("number", (-F.col("best.col2")).alias("a"))
    pairs = pairs.toDF("b", "a").join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b")
    likely = pairs.filter(_may_be_similar("left", "right", percent)).selectExpr(
        "a", "b", "left.n_shingles as n_a", "right.n_shingles as n_b"
    )
    first = materialized(_compared(materialized(likely, "likely"), classes, texts, k, percent), "compared")
    links = materialized(first.filter("similar").select("a", "b").distinct(), "links")
    roots = components(links)

    # Classes of a bucket outside its largest component, against all others of the bucket.
    placed = members.join(roots, "number", "left").select("bucket", "number", F.coalesce("root", "number").alias("root"))
    placed = materialized(placed, "placed")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    largest = materialized(largest.filter("roots > 1").select("bucket", F.col("top.root").alias("top")), "largest")
    differs = first.groupBy("b").agg(F.first(F.struct("a", "n_a", "less", "more")).alias("from"))
    about = own.join(differs.withColumnRenamed("b", "number"), "number", "left")
    about = about.selectExpr("number", "named_struct('number', number, 'n_shingles', about.n_shingles, 'sketch', about.sketch, 'bands', about.bands, 'from', from) as about")
    about = materialized(about, "about")
    mixed = materialized(placed.join(largest, "bucket").join(about, "number"), "mixed")
    minor = mixed.filter("root != top").select(F.col("bucket").alias("place"), F.col("root").alias("its"), F.col("about").alias("x"))
    other = mixed.select("bucket", "root", F.col("about").alias("y"))
    same = F.col("x.from.a") == F.col("y.from.a")
    shared = (
        F.col("x.from.n_a")
        - F.size("x.from.less")
        - F.size("y.from.less")
        + F.size(F.array_intersect("x.from.less", "y.from.less"))
        + F.size(F.array_intersect("x.from.more", "y.from.more"))
    )
    paired = F.col("x.from.a").eqNullSafe(F.col("y.number")) | F.col("y.from.a").eqNullSafe(F.col("x.number"))
    # Classes that meet in several buckets are compared in the first of them.
    bands_of = [(F.col("x.bands")[i], F.col("y.bands")[i]) for i in range(BANDED // BAND)]
    here = F.coalesce(*(F.when(mine == its, mine) for mine, its in bands_of)) == F.col("bucket")
    open_ = ~paired & here & _may_be_similar("x", "y", percent)
    exact = _alike(shared, F.col("x.n_shingles"), F.col("y.n_shingles"), percent)
    across = (
        minor.join(
            other,
            (F.col("place") == F.col("bucket"))
            & (F.col("its") != F.col("root"))
            & open_
            & F.when(same, exact).otherwise(True),
        )
        .selectExpr(
            "least(x.number, y.number) as a",
            "greatest(x.number, y.number) as b",
            "if(x.number < y.number, x, y).n_shingles as n_a",
            "if(x.number < y.number, y, x).n_shingles as n_b",
        )
        .distinct()
    )
    across = materialized(across, "across")
    if not across.isEmpty():
        more = _compared(across, classes, texts, k, percent).filter("similar").select("a", "b")
        roots = components(materialized(links.union(more).distinct(), "links"))

    about_row = F.struct(F.col("doc_id").isNull(), "doc_id", "slot", "print")
    named = classes.join(roots, "number", "left").select("class", about_row.alias("first"), F.coalesce("root", "number").alias("root"))
    named = materialized(named, "named")
    smallest = materialized(named.groupBy("root").agg(F.min("first").alias("first")), "components")
    final = materialized(named.drop("first").join(smallest, "root").select("class", "first"), "final")
    linked = signed.filter("class is not null").join(final, "class")
    linked = linked.select(
        "doc_id", "print", "n_shingles", F.col("first.doc_id").alias("component_id"), (about_row == F.col("first")).alias("stays")
    )
    alone = signed.filter("class is null")
    alone = alone.select("doc_id", "print", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
