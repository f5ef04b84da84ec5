"""Repeats of a fixed length across documents, found from seeds that equal windows share.

A window is ``window`` consecutive units (bytes or words) of one document. Its
seed is the ``seed`` consecutive units in it with the smallest hash, leftmost
of equals, so equal windows have equal seeds at equal places. The work is:

1. ``shared_seeds``: seeds that two documents have. Tasks send hashes packed
   per bucket; a hash that a task meets in several documents is sent once.
2. ``segments``: runs of windows with one shared seed, sent to that seed's
   bucket. A run that a task meets again in a document with a larger id is
   decided there and then, so copies aren't sent.
3. A resolver, the part in which the operators differ, finds for every window
   of a segment whether a document with a smaller id has it.
4. ``marked``: the windows found are laid over their documents.

Seeds that very many documents share are frequent: segments around them may
all differ, and no task sees such a seed's segments together. They are dealt
out anew, by seeds with half of the window's other units (``narrowed``). Where
these are frequent too, windows are grouped one by one by Spark instead, with
partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lakescribe.llm import text as tx
from lakescribe.session import materialized

#: Seeds, and bytes of segments, that a task holds before it sends them on.
HELD_SEEDS, HELD_BYTES = 2_000_000, 12 << 20
#: Buckets over which a task spreads segments that belong to none.
SPREAD_BUCKETS = 16
#: Units of a long document that are looked at together.
PART_UNITS = 1 << 20
#: Bytes of short texts that are looked at together; their arrays stay in the processor's cache.
SLICE_BYTES = 1 << 17
#: Segments that a resolver takes at once, at least; all of one seed go together.
RESOLVED_ROWS = 40_000
#: Windows of a run at most, so that a mask holds a bit for each; longer runs become several.
RUN_WINDOWS = 62
#: Bytes of texts per bucket of seeds, and buckets that a task answers.
BUCKET_BYTES, TASK_BUCKETS = 16 << 20, 4

SEGMENT = "key long, place int, segment binary, ord long, slot long, segment_id long, mask long, often boolean"
_SEGMENT = [f.split()[0] for f in SEGMENT.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.bool_()]

#: Segments of one bucket as they are sent: what they say, what else there is of them, and their ids; all or none are of frequent seeds.
PACKED = "bucket int, n int, content binary, facts binary, ids binary, often boolean"
_FACTS = np.dtype([("key", "<u4"), ("place", "<i4"), ("length", "<i4"), ("slot", "<i8"), ("n", "u1"), ("flags", "u1")])
_OFTEN, _NO_ID, _DECIDED = 1, 2, 4
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Windows:
    """What is compared: ``unit`` is bytes or words; ``seed`` of ``window`` units."""

    unit: str
    window: int
    seed: int

    @property
    def width(self) -> int:
        return self.window - self.seed + 1


@dataclass
class Texts:
    """Some texts of a column, one behind the other: their bytes, and where and which their units are."""

    row: int
    data: np.ndarray
    bounds: np.ndarray  # the first unit of every text, and the end
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    words: np.ndarray | None = None

    def units(self, a: int, b: int) -> np.ndarray:
        return tx.byte_values(self.data[a:b]) if self.words is None else self.words[a:b]

    def content(self, a: int, b: int) -> bytes:
        """Units a to b, words joined by one blank."""
        if self.words is None:
            return self.data[a:b].tobytes()
        start = self.starts[a]
        raw = self.data[start : self.ends[b - 1]].tobytes()
        return b" ".join([raw[s - start : e - start] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())])

    def left(self, text: int, spans: np.ndarray) -> bytes:
        """A text without the units of ``spans``, words joined by one blank."""
        a, b = self.bounds[text], self.bounds[text + 1]
        keep = np.ones(b - a, bool)
        for first, end in spans:
            keep[first:end] = False
        if self.words is None:
            return self.data[a:b][keep].tobytes()
        starts, ends = self.starts[a:b][keep], self.ends[a:b][keep]
        if not len(starts):
            return b""
        # every word with the byte behind it, which becomes the blank
        raw = np.append(self.data[starts[0] : ends[-1]], np.uint8(32))
        step = np.zeros(len(raw) + 1, np.int8)
        step[starts - starts[0]] += 1
        step[ends - starts[0] + 1] -= 1
        raw[ends - starts[0]] = 32
        return raw[np.cumsum(step[:-1], dtype=np.int8) > 0][:-1].tobytes()


def texts_of(column: pa.Array, plan: Windows) -> Iterator[Texts]:
    for row, data, offsets in tx.slices(column, SLICE_BYTES):
        if plan.unit == "bytes":
            yield Texts(row, data, offsets)
        else:
            starts, ends, counts = tx.word_bounds(data, offsets)
            yield Texts(row, data, counts, starts, ends, tx.word_hashes(data, starts, ends))


def windows(texts: Texts, plan: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """(hashes of units, seed hashes, windows, the text of each, the place of each one's seed) of parts of some texts.

    Places count from the part's first unit, which comes last.
    """
    total = int(texts.bounds[-1])
    room = np.maximum(texts.bounds[1:] - plan.window + 1, texts.bounds[:-1])  # where a text's windows end
    for a in range(0, max(0, total - plan.window + 1), PART_UNITS):
        units = texts.units(a, min(total, a + PART_UNITS + plan.window - 1))
        grams = tx.gram_hash(units, plan.seed)
        place = tx.window_minima(grams, plan.width)
        at = np.arange(a, a + len(place))
        text = np.searchsorted(texts.bounds, at, "right") - 1
        inside = np.flatnonzero(at < room[text])
        yield units, grams, inside, text[inside], place[inside], a


def runs(texts: Texts, plan: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one seed: (text, seed hash, first window, last window, seed place, id of the run).

    A run of more than ``RUN_WINDOWS`` windows comes as several, one after the other, each with the seed.
    """
    for units, grams, at, text, place, a in windows(texts, plan):
        if not len(at):
            continue
        new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
        begin = np.flatnonzero(new)
        first, seed = at[begin], place[begin]
        last = at[np.r_[begin[1:], len(at)] - 1]
        if plan.width > RUN_WINDOWS:
            pieces = (last - first) // RUN_WINDOWS + 1
            which = np.repeat(np.arange(len(begin)), pieces)
            nth = np.arange(len(which)) - (np.cumsum(pieces) - pieces)[which]
            begin, seed = begin[which], seed[which]
            first = first[which] + nth * RUN_WINDOWS
            last = np.minimum(last[which], first + RUN_WINDOWS - 1)
        content = tx.run_hash(tx.prefix_sums(units), first, last + plan.window)
        shape = ((last - first) * plan.window + (seed - first)).astype(np.uint64)
        ids = tx.mix(content + tx.mix(shape + np.uint64(1))).view(np.int64)
        yield text[begin], grams[seed], first + a, last + a, seed + a, ids


def own_ids(ids: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Ids of runs as ids within their documents, which fingerprints tell apart."""
    return tx.mix(ids.view(np.uint64) ^ prints.view(np.uint64)).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """Columns of every document that the steps need.

    ``slot`` is what rows are brought together by: the id, or a hash of the
    text where it is null. ``print`` tells apart rows with equal slots.
    """
    content = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"))
    mark = F.xxhash64("text")
    return own.select("doc_id", "text", F.coalesce("doc_id", mark).alias("slot"), mark.alias("print"))


#: What orders documents: the id, null last.
ORD = "coalesce(doc_id, 9223372036854775807) as ord"


def copies(texts: DataFrame, plan: Windows) -> DataFrame:
    """(slot, print) of documents whose whole text a document with a smaller id has too."""
    own = texts.selectExpr("slot", "print", ORD, "unhex(sha2(text, 256)) as digest")
    first = own.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last")
    return own.join(materialized(first, "copies"), "digest").filter("ord > first").select("slot", "print").distinct()


def _bucket_of(upper: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the upper half of a hash. Seeds have small hashes, so they are spread first."""
    spread = (upper * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return (spread * np.uint64(buckets)) >> np.uint64(32)


def _seed_ids(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the lower half of a hash, in one number."""
    bucket = _bucket_of(keys >> np.uint64(32), buckets)
    return ((bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))).view(np.int64)


def bucket_count(texts: DataFrame) -> int:
    """Buckets for the seeds of ``texts``, so many that a task holds those of some MB however large the table."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(TASK_BUCKETS * partitions, -(-size // BUCKET_BYTES))


def shared_seeds(texts: DataFrame, plan: Windows, frequent_documents: int, buckets: int) -> DataFrame:
    """(slot, seed, seen): the seeds that each document shares with another.

    Rows with a null slot count documents: with a seed, of one that more than
    ``frequent_documents`` have; without, of all shared seeds of a bucket.
    """
    names = ["bucket", "lower", "slots", "times", "shared", "owners"]

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held)
            slots = np.repeat(np.array(owners, np.int64), [len(k) for k in held])
            ids = _seed_ids(keys, buckets)
            order = np.argsort(ids, kind="stable")
            ids, slots = ids[order], slots[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            times = np.diff(np.r_[first, len(ids)])
            many = np.repeat(times > 1, times)
            rows: list[tuple] = []
            bucket = ids >> 32
            for single in (True, False):
                chosen = first[(times == 1) == single]
                edges = np.searchsorted(bucket[chosen], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = chosen[edges[b] : edges[b + 1]]
                    lower = ids[at].astype(np.uint32).tobytes()
                    if single:
                        rows.append((b, lower, slots[at].tobytes(), None, None, None))
                    else:
                        count = times[(times > 1)][edges[b] : edges[b + 1]]
                        rows.append((b, lower, None, count.astype(np.uint32).tobytes(), None, None))
            if many.any():  # these need no answer
                b = TaskContext.get().partitionId() % buckets
                rows.append((b, None, None, None, ids[many].tobytes(), slots[many].tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        size = 0
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for texts in texts_of(batch.column(1), plan):
                found: dict[int, list[np.ndarray]] = {}
                for _, grams, at, text, place, _ in windows(texts, plan):
                    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])][: len(at)])
                    keys, text = grams[place[new]], text[new]
                    edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][: len(text)])
                    for i, own in zip(text[edges].tolist(), np.split(keys, edges[1:])):
                        found.setdefault(i, []).append(own)
                for i, own in found.items():
                    held.append(np.unique(np.concatenate(own)))
                    owners.append(slots[texts.row + i])
                    size += len(held[-1])
                if size >= HELD_SEEDS:
                    yield flush()
                    held, owners, size = [], [], 0
        if held:
            yield flush()

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(slots, seeds, seen) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int64()), pa.array(seeds, pa.int64()), pa.array(seen, pa.int64())], ["slot", "seed", "seen"]
            )

        def decide(bucket: int, lower: list, slots: list, times: list) -> Iterator[pa.RecordBatch]:
            if not lower:
                return
            keys, own, seen = np.concatenate(lower), np.concatenate(slots), np.concatenate(times)
            order = np.argsort(keys, kind="stable")
            keys, own, seen = keys[order], own[order], seen[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            entries = np.diff(np.r_[first, len(keys)])
            total = np.add.reduceat(seen, first)
            seeds = keys.astype(np.int64) | (bucket << 32)
            known = np.repeat(entries > 1, entries) & (seen == 1)
            yield rows(own[known], seeds[known], np.ones(known.sum(), np.int64))
            often = total > frequent_documents
            yield rows([None] * int(often.sum()), seeds[first[often]], total[often])
            yield rows([None], [None], [int(total[total > 1].sum())])

        current, lower, slots, times = None, [], [], []
        for batch in batches:
            for bucket, low, slot, count, shared, owner in zip(*(batch.column(i) for i in range(6))):
                if bucket.as_py() != current:
                    if current is not None:
                        yield from decide(current, lower, slots, times)
                    current, lower, slots, times = bucket.as_py(), [], [], []
                if shared.is_valid:
                    seeds = np.frombuffer(shared.as_buffer(), np.int64)
                    yield rows(np.frombuffer(owner.as_buffer(), np.int64), seeds, np.ones(len(seeds), np.int64))
                    continue
                part = np.frombuffer(low.as_buffer(), np.uint32)
                lower.append(part)
                slots.append(np.frombuffer(slot.as_buffer(), np.int64) if slot.is_valid else np.zeros(len(part), np.int64))
                times.append(
                    np.frombuffer(count.as_buffer(), np.uint32).astype(np.int64) if count.is_valid else np.ones(len(part), np.int64)
                )
        if current is not None:
            yield from decide(current, lower, slots, times)

    schema = "bucket int, lower binary, slots binary, times binary, shared binary, owners binary"
    packed = texts.select("slot", "text").mapInArrow(send, schema)
    return packed.repartition(-(-buckets // TASK_BUCKETS), "bucket").sortWithinPartitions("bucket").mapInArrow(
        answer, "slot long, seed long, seen long"
    )


def packed(rows: list[tuple], buckets: int, spread: int) -> Iterator[tuple]:
    """Rows of ``PACKED`` from (key, place, content, ord, slot, segment id, number of windows, often).

    Rows whose place is -1 are decided; they and those of frequent seeds
    belong to no bucket and go to some that ``spread`` tells.
    """
    keys, places, contents, ords, slots, ids, sizes, often = zip(*rows)
    facts = np.zeros(len(rows), _FACTS)
    facts["key"] = np.array(keys, np.int64).astype(np.uint32)
    places, often = np.array(places), np.array(often, bool)
    decided = places < 0
    facts["place"] = np.where(decided, 0, places)
    facts["length"] = np.fromiter(map(len, contents), np.int64, len(rows))
    facts["slot"] = slots
    facts["n"] = sizes
    facts["flags"] = often * _OFTEN + (np.array(ords, np.int64) != facts["slot"]) * _NO_ID + decided * _DECIDED
    ids = np.array(ids, np.int64)
    bucket = _bucket_of(facts["key"].astype(np.uint64), buckets)
    anywhere = (spread + (ids & (SPREAD_BUCKETS - 1)) * max(1, buckets // SPREAD_BUCKETS)) % buckets
    bucket = np.where(often | decided, anywhere, bucket.astype(np.int64))
    block = 2 * bucket + often
    order = np.lexsort((facts["key"], block))
    facts, ids, block = facts[order], ids[order], block[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    codec = pa.Codec("zstd", 3)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        # byte by byte of all rows, as the upper bytes are much alike; keys as steps to the next
        own = facts[a:b].copy()
        own["key"] = np.diff(own["key"], prepend=np.uint32(0))
        planes = own.view(np.uint8).reshape(b - a, -1).T.tobytes()
        said = b"".join([contents[i] for i in order[a:b].tolist()])
        said, planes = (codec.compress(x, asbytes=True) for x in (said, planes))
        yield int(block[a] >> 1), b - a, said, planes, ids[a:b].tobytes(), bool(block[a] & 1)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(bucket, its segments as rows of ``SEGMENT``) of rows of ``PACKED``."""
    codec = pa.Codec("zstd")
    for bucket, n, content, planes, ids in zip(*(batch.column(i) for i in range(5))):
        n = n.as_py()
        raw = np.frombuffer(codec.decompress(planes.as_buffer(), n * _FACTS.itemsize), np.uint8)
        facts = np.ascontiguousarray(raw.reshape(_FACTS.itemsize, n).T).view(_FACTS).ravel()
        ends = np.r_[0, np.cumsum(facts["length"])].astype(np.int32)
        decided = (facts["flags"] & _DECIDED) > 0
        said = pa.py_buffer(codec.decompress(content.as_buffer(), int(ends[-1]), asbytes=True))
        segment = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), said])
        size = facts["n"].astype(np.int64)
        columns = [
            np.cumsum(facts["key"], dtype=np.uint32).astype(np.int64),
            facts["place"],
            pc.if_else(pa.array(decided), pa.scalar(None, pa.binary()), segment),
            np.where(facts["flags"] & _NO_ID, _LAST, facts["slot"]),
            facts["slot"],
            np.frombuffer(ids.as_buffer(), np.int64),
            np.where(decided, (np.int64(1) << size) - 1, size),
            (facts["flags"] & _OFTEN) > 0,
        ]
        arrays = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, _KINDS)]
        yield bucket.as_py(), pa.RecordBatch.from_arrays(arrays, _SEGMENT)


def segments(joined: DataFrame, plan: Windows, frequent: frozenset[int], buckets: int) -> DataFrame:
    """Segments around shared seeds, in rows of ``PACKED`` dealt out by bucket; ``often`` says that the seed is frequent.

    Rows with a null segment are decided: ``mask`` has a bit for each of their
    windows. In the others it is the number of windows. Segments of one seed
    have its key, which others may have too, and so its bucket, but those of
    frequent seeds are spread.
    """
    spread = joined.sparkSession.sparkContext.broadcast(np.array(sorted(frequent), np.int64))
    names = [f.split()[0] for f in PACKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.bool_()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = spread.value
        held: dict[tuple[int, bytes], list[tuple]] = {}
        size = flushed = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flushed
            rows = []
            for (place, content), found in held.items():
                least = min(found)[0]
                for o, slot, segment_id, n, key, often in found:
                    if o == least:
                        rows.append((key, place, content, o, slot, segment_id, n, often))
                    else:
                        rows.append((0, -1, b"", o, slot, segment_id, n, False))
            if not rows:
                return
            flushed += 1
            blocks: list[tuple] = []
            for block in packed(rows, buckets, TaskContext.get().partitionId() * 31 + flushed * 7):
                blocks.append(block)
                if sum(len(b[2]) for b in blocks) > 8 << 20 or len(blocks) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names)
                    blocks = []
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names)

        for batch in batches:
            ords, slots, prints = (batch.column(i).to_numpy() for i in range(3))
            seeds = batch.column(4)
            limits, wanted = seeds.offsets.to_numpy(), seeds.values.to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column(3), plan):
                here = wanted[limits[texts.row] : limits[texts.row + len(texts.bounds) - 1]]
                seen = set()
                for text, keys, first, last, at, ids in runs(texts, plan):
                    own = _seed_ids(keys, buckets)
                    chosen = np.flatnonzero(np.isin(own, here))
                    often = np.isin(own[chosen], usual).tolist()
                    keys, places = (keys[chosen] >> np.uint64(32)).tolist(), (at - first)[chosen].tolist()
                    rows = text[chosen] + texts.row
                    ids = own_ids(ids[chosen], prints[rows])
                    parts = zip(
                        rows.tolist(), keys, places, first[chosen].tolist(), last[chosen].tolist(), ids.tolist(), often
                    )
                    for row, key, place, a, b, segment_id, usually in parts:
                        if (row, segment_id) in seen:  # the same run again in this document
                            continue
                        seen.add((row, segment_id))
                        content = texts.content(a, b + plan.window)
                        one = (int(ords[row]), int(slots[row]), segment_id, b - a + 1, key, usually)
                        held.setdefault((place, content), []).append(one)
                        size += len(content) + 100
                if size >= HELD_BYTES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    cut_up = joined.selectExpr(ORD, "slot", "print", "text", "seeds").mapInArrow(cut, PACKED)
    return cut_up.repartition(-(-buckets // TASK_BUCKETS), "bucket")


def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of packed rows that come bucket by bucket, each bucket's in the order of their keys."""
    current, held = None, []

    def whole() -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        order = np.argsort(found["key"].to_numpy(), kind="stable")
        for a in range(0, len(order), 10_000):
            yield found.take(pa.array(order[a : a + 10_000])).combine_chunks().to_batches()[0]

    for batch in batches:
        for bucket, rows in unpacked(batch.filter(pc.invert(batch.column(5)))):
            done = rows.filter(rows.column(2).is_null())
            if done.num_rows:
                yield done
            rows = rows.filter(rows.column(2).is_valid())
            if bucket != current and held:
                yield from whole()
            current = bucket
            if rows.num_rows:
                held.append(rows)
    if held:
        yield from whole()


def first_owners(
    ords: np.ndarray, places: np.ndarray, sizes: np.ndarray, plan: Windows, left: Callable, right: Callable
) -> np.ndarray:
    """For distinct segments, a bit for each window that a segment of a smaller document has.

    ``left(n)`` and ``right(n)`` number the segments so that equal numbers
    mean equal n units before, or from, the seed of the same group.
    """
    masks = np.zeros(len(ords), np.int64)
    by_ord = np.argsort(ords, kind="stable")
    place, size, own = places[by_ord], sizes[by_ord], ords[by_ord]
    for before in range(plan.width):  # units of the window before the seed
        at = np.flatnonzero((place >= before) & (place - size < before))
        ahead = right(plan.window - before)[by_ord]
        alike = np.bincount(ahead[at], minlength=1)[ahead[at]] > 1
        at = at[alike]
        if len(at) < 2:
            continue
        same = ahead[at] * (len(ords) + 1) + left(before)[by_ord[at]]
        order = np.argsort(same, kind="stable")  # within equals by id still
        same, at = same[order], at[order]
        new = np.r_[True, same[1:] != same[:-1]]
        least = own[at][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        hit = at[least < own[at]]
        masks[by_ord[hit]] |= np.int64(1) << (place[hit] - before).astype(np.int64)
    return masks


Classes = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[Callable, Callable]]


def resolved(found: DataFrame, plan: Windows, classes: Classes, opened: Callable | None = None) -> DataFrame:
    """(slot, segment_id, mask): windows of segments that a smaller document has.

    ``found`` is dealt out and sorted by key, or so once ``opened`` took its
    rows apart. ``classes`` gets distinct segments, the places of their seeds (in units)
    and their groups, in order, and returns ``left`` and ``right`` of
    ``first_owners``.
    """

    def decide(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        places, ords, sizes = (rows[n].to_numpy() for n in ("place", "ord", "mask"))
        content = rows["segment"].combine_chunks().dictionary_encode()
        # the place and the content are what a segment is; it may come with two keys
        seeds, key = np.unique(rows["key"].to_numpy(), return_inverse=True)
        name = (content.indices.to_numpy().astype(np.int64) * plan.window + places) * len(seeds) + key
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ords)
        # only segments whose seed has others are compared
        group = key[first]
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        several = several[np.argsort(group[several], kind="stable")]
        masks = np.zeros(len(first), np.int64)
        if len(several):
            chosen = first[several]
            said = content.dictionary.take(content.indices.take(pa.array(chosen))).to_pylist()
            left, right = classes(said, places[chosen], group[several])
            masks[several] = first_owners(least[several], places[chosen], sizes[chosen], plan, left, right)
        mask = np.where(ords > least[which], (np.int64(1) << sizes) - 1, masks[which])
        hit = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays(
            [*(rows[n].combine_chunks().take(pa.array(hit)) for n in ("slot", "segment_id")), pa.array(mask[hit])],
            ["slot", "segment_id", "mask"],
        )

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in opened(batches) if opened else batches:
            decided = batch.filter(batch.column(2).is_null())
            if decided.num_rows:
                yield decided.select(["slot", "segment_id", "mask"])
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < RESOLVED_ROWS:
                continue
            keys = batch.column(0).to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if end == 0 and all(b.column(0)[0].as_py() == keys[-1] for b in held):
                continue
            if end == 0:  # the last key began in an earlier batch
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = whole.column(0).to_numpy()
                held, batch, end = [whole], whole, int(np.searchsorted(keys, keys[-1]))
            yield from decide(pa.Table.from_batches([*held[:-1], batch.slice(0, end)]))
            held = [batch.slice(end)]
            size = held[0].num_rows
        if size:
            yield from decide(pa.Table.from_batches(held))

    return found.mapInArrow(stream, "slot long, segment_id long, mask long")


def _said(plan: Windows, first: str, n: str) -> Column:
    """``n`` units of a segment from ``first`` on, as binary or text."""
    if plan.unit == "bytes":
        return F.expr(f"substring(segment, int({first}) + 1, int({n}))")
    return F.expr(f"array_join(slice(split(cast(segment as string), ' '), int({first}) + 1, int({n})), ' ')")


def narrowed(found: DataFrame, plan: Windows, frequent_documents: int) -> tuple[DataFrame, DataFrame]:
    """Segments of frequent seeds by longer seeds: those whose longer seed is not frequent, and the others.

    A window reaches about half of its other units to the left of its seed or
    else to the right of it. With these the seed is longer, and equal windows
    still have equal ones. A segment has windows of one or both kinds; its
    windows ``i0`` to before ``i1`` have the seed that ``key`` tells.
    """

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # not a filter of Spark's, which would go below the exchange and have all segments made again
        for batch in batches:
            for _, rows in unpacked(batch.filter(batch.column(5))):
                yield rows

    rest = plan.window - plan.seed
    left = (rest + 1) // 2
    sides = F.expr(
        f"array(struct(0 as side, place - {left} as a, {plan.seed + left} as length, 0L as i0, least(mask, place - {left} + 1L) as i1),"
        f" struct(1 as side, place as a, {plan.seed + rest - left + 1} as length, greatest(0L, place - {left} + 1L) as i0, mask as i1))"
    )
    rows = (
        found.mapInArrow(frequent, SEGMENT)
        .select("place", "segment", "ord", "slot", "segment_id", "mask", F.inline(F.filter(sides, lambda s: s["i0"] < s["i1"])))
        .withColumn("key", F.xxhash64("side", _said(plan, "a", "length")))
        .select("key", "place", "segment", "ord", "slot", "segment_id", "mask", "i0", "i1")
    )
    many = rows.groupBy("key").count().filter(F.col("count") > frequent_documents).hint("merge")
    return rows.join(many, "key", "left_anti"), rows.join(many, "key", "left_semi")


def grouped(found: DataFrame, plan: Windows) -> DataFrame:
    """The same for segments of seeds that are frequent at any length: their windows are grouped by what they say."""
    window = found.withColumn("i", F.explode(F.expr("sequence(i0, i1 - 1)"))).select(
        "slot", "segment_id", "ord", F.col("i").cast("int").alias("i"), _said(plan, "i", str(plan.window)).alias("window")
    )
    first = window.groupBy("window").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last")
    return (
        window.join(first.drop("last"), "window")
        .filter("first < ord")
        .groupBy("slot", "segment_id")
        .agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    )


def covered(first: int, mask: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the units under the windows of a run that a mask tells."""
    while mask:
        low = (mask & -mask).bit_length() - 1
        ones = mask >> low
        n = (~ones & (ones + 1)).bit_length() - 1
        yield first + low, first + low + n - 1 + window
        mask ^= ((1 << n) - 1) << low


def spans(found: list[tuple[int, int]]) -> np.ndarray:
    """(start, end) of the maximal runs that these cover together."""
    if not found:
        return np.empty((0, 2), np.int64)
    both = np.array(sorted(found))
    reach = np.maximum.accumulate(both[:, 1])
    new = np.flatnonzero(np.r_[True, both[1:, 0] > reach[:-1]])
    return np.column_stack([both[new, 0], reach[np.r_[new[1:], len(both)] - 1]])


def without_repeats(docs: DataFrame, plan: Windows, classes: Classes, frequent_documents: int = 4096) -> DataFrame:
    """(doc_id, n_units, spans, kept) of every row of ``docs``.

    ``spans`` are the maximal runs of units covered by windows that a document
    with a smaller id has too; ``kept`` is what is left. Windows are judged on
    the texts as they came. A seed is frequent if more than
    ``frequent_documents`` documents and more than one in 100,000 of the
    shared seeds' occurrences have it, so the tasks know 100,000 at most.
    """
    texts = keyed(docs)
    whole = copies(texts, plan)
    buckets = bucket_count(texts)
    found = materialized(shared_seeds(texts, plan, frequent_documents, buckets), "seeds")
    counts = found.filter("slot is null")
    total = counts.filter("seed is null").agg(F.sum("seen")).first()[0] or 0
    usual = counts.filter(F.col("seen") > max(frequent_documents, total // 100_000)).select("seed").dropna().collect()
    frequent = frozenset(r.seed for r in usual)
    seeds = (
        found.filter("slot is not null").select("slot", "seed", F.lit(None).cast("long").alias("copy"))
        .unionByName(whole.select("slot", F.lit(None).cast("long").alias("seed"), F.col("print").alias("copy")))
        .groupBy("slot")
        .agg(F.collect_list("seed").alias("seeds"), F.collect_set("copy").alias("copies"))
    )
    joined = texts.join(seeds.hint("merge"), "slot").filter(~F.array_contains("copies", F.col("print")))
    found = segments(joined, plan, frequent, buckets)
    marks = resolved(found.sortWithinPartitions("bucket"), plan, classes, by_key)
    if frequent:
        rare, often = narrowed(found, plan, frequent_documents)
        rare = rare.select(*_SEGMENT[:-1], F.lit(False).alias("often")).repartition(-(-buckets // TASK_BUCKETS), "key").sortWithinPartitions("key")
        marks = marks.unionByName(resolved(rare, plan, classes)).unionByName(grouped(often, plan))
    marks = (
        marks.unionByName(whole.selectExpr("slot", "print as segment_id", "-1L as mask"))
        .groupBy("slot")
        .agg(F.collect_list(F.struct("segment_id", "mask")).alias("marks"))
    )

    def lay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string() if plan.unit == "words" else pa.binary()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), span, text]
        names = ["doc_id", "n_units", "spans", "kept"]

        def told(marks: pa.Scalar) -> dict[int, int]:
            """Masks by id of the run; -1, for the whole text, by its fingerprint."""
            masks: dict[int, int] = {}
            if marks.is_valid:
                for i, bits in zip(*(f.to_pylist() for f in marks.values.flatten())):
                    masks[i] = masks.get(i, 0) | bits
            return masks

        for batch in batches:
            ids, prints, marks = batch.column(0), batch.column(1).to_numpy(), batch.column(3)
            rows, size = [], 0
            for texts in texts_of(batch.column(2), plan):
                rows_here = range(texts.row, texts.row + len(texts.bounds) - 1)
                masks = [told(marks[row]) for row in rows_here]
                found: list[list[tuple[int, int]]] = [[] for _ in masks]
                if any(masks):
                    for text, _, first, _, _, run_ids in runs(texts, plan):
                        run_ids = own_ids(run_ids, prints[text + texts.row])
                        begin = first - texts.bounds[text]
                        for i, a, run_id in zip(text.tolist(), begin.tolist(), run_ids.tolist()):
                            if run_id in masks[i]:
                                found[i] += covered(a, masks[i][run_id], plan.window)
                for i, row in enumerate(rows_here):
                    n = int(texts.bounds[i + 1] - texts.bounds[i])
                    whole = masks[i].get(int(prints[row])) == -1 and n >= plan.window
                    over = np.array([[0, n]]) if whole else spans(found[i])
                    kept = texts.left(i, over)
                    size += len(kept)
                    listed = [{"start": a, "end": b} for a, b in over.tolist()]
                    rows.append((ids[row].as_py(), n, listed, kept.decode() if plan.unit == "words" else kept))
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kind = "string" if plan.unit == "words" else "binary"
    return texts.join(marks.hint("merge"), "slot", "left").select("doc_id", "print", "text", "marks").mapInArrow(
        lay, f"doc_id long, n_units long, spans array<struct<start: long, end: long>>, kept {kind}"
    )
