"""Collocations from a weighted de Bruijn graph of words.

The graph's nodes are runs of four words, its edges runs of five with the
number of times they occur. Edges are aggregated once over all texts. A node's
count is the flow out of it and what ends there: the edges that leave it, and
the pieces that stop with it. The counts of three and two words follow in the
same way from the nodes. Edges of equal weight that follow each other without
a branch are compacted to one path.

Four scans of the texts: the first counts words, and pairs of neighbours in a
table of buckets of fixed size; the second counts triples of possibly frequent
pairs in the same way, the third runs of four; the last makes edges only where
all of these can be frequent, and ends a run of words where they can't. A
bucket counts at least what each of its members does, so no frequent phrase is
lost, and the counts of frequent phrases are exact at every size.

A phrase can't score more than 1000 * words / count of its first or last word,
so phrases that begin or end with a common word are out of reach of the best.
Two and three words that are all common are counted only for languages whose
best turn out not to be that good, by a scan of their texts alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakescribe.llm import text as T
from lakescribe.operators.skew import lookup
from lakescribe.session import materialized

#: Words of an edge, and of the longest candidates.
LONGEST = 5

#: Buckets of pairs, and of triples: two to this power, as many bits in the filter that every task gets (8 MB).
BUCKET_BITS = 26
#: Buckets that travel in one row: two to this power.
RANGE_BITS = 12

#: Distinct words or phrases, and buckets, that a task holds before it passes its counts on.
HELD, HELD_BUCKETS = 300_000, 1_000_000

#: Times ``least``: words that occur up to so often are looked at first.
RARE = 20

#: Parts of a language that are ranked by themselves before the best of all are.
SALTS = 256

#: What ends a piece, what stands between words, and both (fixed values).
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = np.zeros(256, bool)
_BREAK[list(_PIECE_ENDS)] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
#: A-Z in lower case, piece ends as line feeds, words kept apart by white space.
_FOLD = bytes(ord("\n") if c in _PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_lang().alias("lang"), F.col("text").cast("string").alias("text"))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column(0).dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pc.equal(langs.indices, i))


def _words(data: np.ndarray, offsets: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words, and whether each is followed by another in its piece."""
    starts, ends, counts = T.word_bounds(data, offsets, _APART)
    breaks = np.flatnonzero(_BREAK[data])
    follows = np.zeros(len(starts), bool)
    follows[:-1] = np.searchsorted(breaks, starts[1:]) == np.searchsorted(breaks, ends[:-1])
    last = counts[1:] - 1
    follows[last[last >= 0]] = False
    code = np.frombuffer(lang.encode() or b"\0", np.uint8)
    own = T.word_hashes(code, np.array([0]), np.array([len(code)]))
    return starts, ends, T.word_hashes(data, starts, ends, T.LOWER) + own, follows


def _buckets(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Buckets of the m words from each place of ``at``."""
    value = hashes[at]
    for i in range(1, m):
        value = value * np.uint64(T.BASE) + hashes[at + i]
    return (T.mix(value) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _possible(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bits[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1 == 1


def _pairs(hashes: np.ndarray, follows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each word and the next may be a frequent pair."""
    out = follows.copy()
    out[follows] = _possible(bits, _buckets(hashes, np.flatnonzero(follows), 2))
    return out


def _triples(pairs: np.ndarray) -> np.ndarray:
    """Places of three words that are two possibly frequent pairs."""
    return np.flatnonzero(pairs[:-1] & pairs[1:])


def _frequent(hashes: np.ndarray, at: np.ndarray, m: int, bits: np.ndarray) -> np.ndarray:
    """Whether m possibly frequent words begin at a word; of the places ``at`` alone."""
    out = np.zeros(len(hashes) + 2, bool)
    out[at[_possible(bits, _buckets(hashes, at, m))]] = True
    return out


def _fours(triples: np.ndarray) -> np.ndarray:
    """Places of four words that are two possibly frequent triples."""
    return np.flatnonzero(triples[:-1] & triples[1:])


def _counted(lang: str, held: Counter) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64()),
         pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
        _SCANNED,
    )


def _packed(buckets: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    """One row per range of buckets: their places in it and counts, as bytes."""
    ranges = buckets >> RANGE_BITS
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    edges = np.append(first, len(buckets))
    places = (buckets & ((1 << RANGE_BITS) - 1)).astype(np.uint16).tobytes()
    counts = seen.astype(np.uint32).tobytes()
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(ranges[first], pa.int32()),
         pa.array([places[2 * a : 2 * b] for a, b in zip(edges, edges[1:])], pa.binary()),
         pa.array([counts[4 * a : 4 * b] for a, b in zip(edges, edges[1:])], pa.binary())],
        _SCANNED,
    )


_SCANNED = ["lang", "word", "n", "range", "places", "counts"]
_SCHEMA = "lang string, word binary, n long, range int, places binary, counts binary"


class _Held:
    """Counts of buckets within a task, passed on when there are many."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.buckets, self.seen = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(buckets)
        if sum(map(len, self.waiting)) > HELD_BUCKETS:
            self.fold()
            if len(self.buckets) > 2 * HELD_BUCKETS:
                yield self.out()

    def fold(self) -> None:
        if self.waiting:
            new, seen = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.waiting.clear()
            both, place = np.unique(np.concatenate([self.buckets, new]), return_inverse=True)
            self.seen = np.bincount(place, np.concatenate([self.seen, seen]), len(both)).astype(np.int64)
            self.buckets = both

    def out(self) -> pa.RecordBatch:
        self.fold()
        batch = _packed(self.buckets, self.seen)
        self.buckets, self.seen = np.empty(0, np.int64), np.empty(0, np.int64)
        return batch


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of pairs by bucket, of one task."""
    words: dict[str, Counter] = {}
    pairs = _Held()
    for batch in batches:
        for lang, column in _by_lang(batch):
            held = words.setdefault(lang, Counter())
            for _, data, offsets in T.slices(column, 1 << 20):
                for a, b in zip(offsets, offsets[1:]):
                    held.update(data[a:b].tobytes().translate(_FOLD).split())
                _, _, hashes, follows = _words(data, offsets, lang)
                yield from pairs.add(_buckets(hashes, np.flatnonzero(follows), 2))
                if len(held) > HELD:
                    yield _counted(lang, held)
                    held.clear()
    for lang, held in words.items():
        yield _counted(lang, held)
    yield pairs.out()


def triples(docs: DataFrame, pair_bits: np.ndarray) -> DataFrame:
    """Counts of triples by bucket, where both pairs may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(pair_bits)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for lang, column in _by_lang(batch):
                for _, data, offsets in T.slices(column, 1 << 20):
                    _, _, hashes, follows = _words(data, offsets, lang)
                    yield from held.add(_buckets(hashes, _triples(_pairs(hashes, follows, shared.value)), 3))
        yield held.out()

    return _texts(docs).mapInArrow(scan, _SCHEMA)


def fours(docs: DataFrame, pair_bits: np.ndarray, triple_bits: np.ndarray) -> DataFrame:
    """Counts of runs of four words by bucket, where both triples may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast((pair_bits, triple_bits))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for lang, column in _by_lang(batch):
                for _, data, offsets in T.slices(column, 1 << 20):
                    _, _, hashes, follows = _words(data, offsets, lang)
                    three = _frequent(hashes, _triples(_pairs(hashes, follows, shared.value[0])), 3, shared.value[1])
                    yield from held.add(_buckets(hashes, _fours(three), 4))
        yield held.out()

    return _texts(docs).mapInArrow(scan, _SCHEMA)


def _word_buckets(words: DataFrame) -> np.ndarray:
    """Bits of the buckets of the words (lang, phrase)."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for lang, column in _by_lang(batch):
                for _, data, offsets in T.slices(column, 1 << 20):
                    hashes = _words(data, offsets, lang)[2]
                    yield from held.add(_buckets(hashes, np.arange(len(hashes)), 1))
        yield held.out()

    return _frequent_buckets(words.select("lang", "phrase").mapInArrow(mark, _SCHEMA), 1)


def all_buckets() -> np.ndarray:
    """The filter that holds nothing back."""
    return np.full((1 << BUCKET_BITS) // 8, 255, np.uint8)


def _frequent_buckets(scanned: DataFrame, least: int) -> np.ndarray:
    """Bits of the buckets that count ``least`` or more: 2**BUCKET_BITS bits, whatever the size of the corpus."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds the ranges dealt to it: all tasks together 2**BUCKET_BITS counts of 4 bytes.
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for own, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own not in held:
                    held[own] = np.zeros(1 << RANGE_BITS, np.uint32)
                total = held[own]
                at = np.frombuffer(places, np.uint16)
                more = total[at].astype(np.int64) + np.frombuffer(counts, np.uint32)
                total[at] = np.minimum(more, 0xFFFFFFFF).astype(np.uint32)
        bits = [np.packbits(total >= least).tobytes() for total in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], ["range", "bits"])

    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        scanned.filter("range IS NOT NULL")
        .select("range", "places", "counts")
        .repartition(parts, "range")
        .mapInArrow(add, "range int, bits binary")
        .collect()
    )
    out = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    step = (1 << RANGE_BITS) // 8
    for r in rows:
        out[r.range * step : (r.range + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def _runs(
    data: np.ndarray,
    offsets: np.ndarray,
    lang: str,
    pair_bits: np.ndarray,
    triple_bits: np.ndarray,
    four_bits: np.ndarray | None,
    rare_bits: np.ndarray | None,
) -> Iterator[list[bytes]]:
    """For every run of possibly frequent pairs the longest phrases from each of its words that may be frequent.

    Two or three words of which none is rare are left out.
    """
    starts, ends, hashes, follows = _words(data, offsets, lang)
    pairs = _pairs(hashes, follows, pair_bits)
    n = len(pairs)
    three = _frequent(hashes, _triples(pairs), 3, triple_bits)
    at = _fours(three)
    four = np.zeros(n + 2, bool)
    four[at] = True
    if four_bits is not None:
        four = _frequent(hashes, at, 4, four_bits)
    reach = 2 + three[:n] + four[:n] + (four[:n] & four[1 : n + 1])
    if rare_bits is not None:
        within = pairs.copy()
        within[1:] |= pairs[:-1]
        within = np.flatnonzero(within)
        rare = np.zeros(n + 2, bool)
        rare[within] = _possible(rare_bits, _buckets(hashes, within, 1))
        reach[~(rare[:n] | rare[1 : n + 1] | (reach == 3) & rare[2:] | (reach > 3))] = 0
    edge = np.diff(np.concatenate([[False], pairs, [False]]).astype(np.int8))
    text = data.tobytes().translate(_FOLD)
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if reach[a:b].any():
            words = text[starts[a] : ends[b]].split()
            yield [b" ".join(words[i : i + n]) for i, n in enumerate(reach[a:b].tolist()) if n]


def grams(
    docs: DataFrame,
    pair_bits: np.ndarray,
    triple_bits: np.ndarray,
    four_bits: np.ndarray | None = None,
    rare_bits: np.ndarray | None = None,
) -> DataFrame:
    """(lang, phrase, m, n): the edges of five words, and the two to four words that end a run, with their counts.

    With ``rare_bits``, runs of two and three words need one whose bucket is set;
    the counts of phrases that hold such a word, and of four and five words, are whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pair_bits, triple_bits, four_bits, rare_bits))
    names = ["lang", "phrase", "m", "n"]

    def batch(lang: str, held: Counter) -> pa.RecordBatch:
        sizes = [p.count(b" ") + 1 for p in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.binary()).cast(pa.string()),
             pa.array(sizes, pa.int32()), pa.array(list(held.values()), pa.int64())],
            names,
        )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for part in batches:
            for lang, column in _by_lang(part):
                held = found.setdefault(lang, Counter())
                for _, data, offsets in T.slices(column, 1 << 20):
                    for found_here in _runs(data, offsets, lang, *shared.value):
                        held.update(found_here)
                    if len(held) > HELD:
                        yield batch(lang, held)
                        held.clear()
        for lang, held in found.items():
            yield batch(lang, held)

    cut_up = _texts(docs).mapInArrow(cut, "lang string, phrase string, m int, n long")
    return cut_up.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n"))


def _rest(phrase: str) -> Column:
    """The phrase without its first word."""
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def flows(edges: DataFrame) -> dict[int, DataFrame]:
    """(lang, phrase, n) of all phrases of 5, 4, 3 and 2 words on the graph, written, one level from the one above.

    What m words count is the sum over the m + 1 words that begin with them,
    and the pieces that end with them.
    """
    levels = {LONGEST: materialized(edges.filter(F.col("m") == LONGEST).select("lang", "phrase", "n"), "level")}
    for m in range(LONGEST - 1, 1, -1):
        out = levels[m + 1].select("lang", F.substring_index("phrase", " ", m).alias("phrase"), "n")
        ending = edges.filter(F.col("m") == m).select("lang", "phrase", "n")
        both = out.unionByName(ending).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels[m] = materialized(both, "level")
    return levels


def paths(levels: dict[int, DataFrame], least: int) -> DataFrame:
    """(lang, phrase, path, place, path_words): every frequent edge with the unary path it lies on, written.

    An edge goes on into the next where every occurrence of it does, and every
    occurrence of the next comes from it: both weigh what the node between
    them counts. Such links are followed by doubling: ``path`` is the path's
    first edge, ``place`` the edge's distance from it, ``path_words`` the
    words of the whole path. A path can't close, as every piece has an end.
    """
    edges = levels[LONGEST].filter(F.col("n") >= least)
    nodes = levels[LONGEST - 1].filter(F.col("n") >= least)
    tail = edges.select("lang", "n", F.col("phrase").alias("before"), _rest("phrase").alias("node"))
    head = edges.select("lang", "n", "phrase", F.substring_index("phrase", " ", LONGEST - 1).alias("node"))
    between = nodes.withColumnRenamed("phrase", "node")
    links = tail.join(between, ["lang", "node", "n"]).join(head, ["lang", "node", "n"]).select("lang", "phrase", "before")
    state = lookup(edges.select("lang", "phrase"), links, ["lang", "phrase"]).select(
        "lang", "phrase", F.coalesce("before", "phrase").alias("path"), F.col("before").isNotNull().cast("long").alias("place")
    )
    state = materialized(state, "path")
    while True:
        jump = state.select("lang", F.col("phrase").alias("path"), F.col("path").alias("further"), F.col("place").alias("more"))
        step = materialized(
            lookup(state, jump, ["lang", "path"]).select(
                "lang", "phrase", F.col("further").alias("path"), (F.col("place") + F.col("more")).alias("place"), "more"
            ),
            "path",
        )
        state = step.drop("more")
        if step.filter("more > 0").isEmpty():
            break
    long = state.groupBy("lang", "path").agg((F.max("place") + LONGEST).alias("path_words"))
    return materialized(lookup(state, long, ["lang", "path"]), "path")


def path_texts(found: DataFrame) -> DataFrame:
    """(lang, phrase, path_words): each path as one phrase, the collocations of any length.

    A path lies in a piece of every document that has it, so it is no longer than a document.
    """
    ordered = F.expr("array_sort(collect_list(struct(place, substring_index(phrase, ' ', -1) AS word)))")
    return (
        found.groupBy("lang", "path", "path_words")
        .agg(ordered.alias("words"))
        .select(
            "lang",
            F.concat_ws(" ", F.substring_index("path", " ", LONGEST - 1), F.array_join("words.word", " ")).alias("phrase"),
            "path_words",
        )
    )


def score() -> Column:
    """1000 * a * n div (l * r) without rounding: the products have 38 digits."""
    return F.expr(
        "cast(1000 * a AS decimal(19,0)) * cast(n AS decimal(18,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0)))"
    )


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, best: int = 2000) -> DataFrame:
    """The best phrases of two to five words of every language.

    ``docs`` needs text and lang; other columns are ignored. A-Z count as a-z;
    texts end pieces at ``.,;:!?`` and line ends, and words at blanks and
    tabs; phrases lie within a piece. A null lang is ``und``, a null text
    empty; rows that come twice count twice. Candidates occur ``least`` times
    or more. A phrase of count a, cut after its first k words, scores 1000 * a * n
    div (l * r): n words in all, l and r counts of its two parts; the lowest
    cut counts, the smallest k of equals. A candidate within a longer one of at
    least ``percent`` of its count is dropped. Columns: lang, rank (by score,
    then a, both falling, then phrase), phrase, a, l, r, n, score, and
    path_words: words of the unary path of a phrase of five words, else null.
    An empty table gives no rows.

    Phrases between words that occur up to ``RARE * least`` times are ranked
    first. Where the last of the best scores more than any other phrase could,
    that is the result; a language whose last doesn't, or that has fewer, is
    ranked again with all words that can matter then.
    """
    scanned = materialized(_texts(docs).mapInArrow(_scan, _SCHEMA), "scan")
    words = materialized(
        scanned.filter("range IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("n")).select(
            "lang", F.col("word").cast("string").alias("phrase"), "n"
        ),
        "words",
    )
    pair_bits = _frequent_buckets(scanned, least)
    triple_bits = _frequent_buckets(triples(docs, pair_bits), least)
    four_bits = _frequent_buckets(fours(docs, pair_bits, triple_bits), least)
    bits = pair_bits, triple_bits, four_bits
    totals = words.groupBy("lang").agg(F.sum("n").alias("all_words"), F.max("n").alias("top"))
    totals = materialized(totals.withColumn("most", F.lit(RARE * least).cast("long")), "totals")
    found = materialized(_ranked(docs, words, totals, bits, least, percent, best), "found")
    # Of n words, a phrase whose first or last word occurs c times scores 1000 * n / c at most.
    lowest = found.filter(F.col("rank") == best).select("lang", "score")
    reached = lookup(totals, lowest, ["lang"]).withColumn("needed", F.expr("1000 * all_words div nullif(score, 0)"))
    again = materialized(
        reached.filter("top > most AND (needed IS NULL OR needed > most)")
        .select("lang", "all_words", F.col("needed").alias("most")),
        "totals",
    )
    if again.isEmpty():
        return found
    own = F.broadcast(again.select("lang"))
    more = _ranked(_texts(docs).join(own, "lang", "left_semi"), words, again, bits, least, percent, best)
    return found.join(own, "lang", "left_anti").unionByName(more)


def _ranked(
    docs: DataFrame,
    words: DataFrame,
    totals: DataFrame,
    bits: tuple[np.ndarray, np.ndarray, np.ndarray],
    least: int,
    percent: int,
    best: int,
) -> DataFrame:
    """The best of the phrases whose first and last words occur ``most`` times or less, null for any.

    ``totals`` has a row (lang, all_words, most) for every language of ``docs``.
    Parts of such a phrase, and what is longer by a word, hold its first or last
    word, so they are counted whole; other phrases of two and three words may not be.
    """
    known = words.filter(F.col("n") >= least)
    rare = known.join(F.broadcast(totals.select("lang", "most")), "lang").filter("most IS NULL OR n <= most")
    rare = materialized(rare.select("lang", "phrase"), "words")
    edges = materialized(grams(docs, *bits, _word_buckets(rare)), "edges")
    levels = flows(edges)
    on_paths = paths(levels, least)
    frequent = {m: levels[m].filter(F.col("n") >= least) for m in levels}
    # A longer phrase counts no more than any of its parts, so the phrases longer by one word decide.
    told = []
    for m in range(2, LONGEST + 1):
        own = frequent[m].select("lang", "phrase", F.col("n").alias("a"), F.lit(None).cast("long").alias("longer"))
        if m < LONGEST:
            parts = F.explode(F.array(F.substring_index("phrase", " ", m), _rest("phrase")))
            inside = frequent[m + 1].select("lang", parts.alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("n").alias("longer"))
            own = own.unionByName(inside)
        told.append(own.withColumn("m", F.lit(m)))
    candidates = (
        told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])
        .groupBy("lang", "phrase", "m")
        .agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
        .select("lang", "phrase", "m", "a")
    )
    for place in (1, -1):
        candidates = candidates.withColumn("end", F.substring_index("phrase", " ", place))
        candidates = lookup(candidates, rare.select("lang", F.col("phrase").alias("end")), ["lang", "end"], "left_semi")
    cuts = candidates.drop("end").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumns(
        {
            "head": F.expr("substring_index(phrase, ' ', k)"),
            "rest": F.expr("substring_index(phrase, ' ', k - m)"),
        }
    )
    for m in range(2, LONGEST):
        known = known.unionByName(frequent[m])
    known = materialized(known, "counts")
    cuts = lookup(cuts, known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = lookup(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = lookup(cuts, totals.select("lang", F.col("all_words").alias("n")), ["lang"])
    scored = (
        cuts.withColumn("score", score())
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
        .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= best).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return lookup(
        ranked.filter(F.col("rank") <= best), on_paths.select("lang", "phrase", "path_words"), ["lang", "phrase"]
    ).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
