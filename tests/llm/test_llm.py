"""Operators of lakescribe.llm against plain versions, and on awkward rows."""

import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from compare import connection, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lakescribe.llm import (
    chat,
    decontaminate,
    exact,
    language,
    near,
    packing,
    repeats,
    seeds,
    suffixes,
    token_counts,
    tokens,
    warc,
)
from lakescribe.llm import text as tx
from lakescribe.llm.queries import ORACLES, QUERIES
from lakescribe.session import materialized

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def made(seed=7, n=60):
    """Texts that share passages, are copied, edited, empty, null, repeated or without an id."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "a", "naïve", "stone", "river", "x", "…", "long", "light"] + [
        "".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(150)
    ]

    def prose(k):
        return " ".join(rng.choices(vocabulary, k=k))

    shared = [prose(25) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            text = f"{prose(rng.randint(0, 40))} {rng.choice(shared)}  {prose(rng.randint(0, 40))}\n"
        elif kind < 0.45 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif kind < 0.55 and rows:
            text = rng.choice(rows)[1]
        else:
            text = prose(rng.randint(0, 120))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "ab"), (903, "ab"), (904, "a" * 700), (905, "a" * 300)]
    return rows + [(None, rows[0][1]), (None, prose(60)), (3, rows[3][1]), (5, prose(50)), (906, "AB  the end")]


ROWS = made()


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("often", [4096, 2])
@pytest.mark.parametrize("window", [13, 4, 80])
def test_repeated_words(docs, window, often):
    found = repeats.remove_repeats(docs(ROWS), window, often)
    expected = [(d, n, gone, spans, " ".join(kept)) for d, n, gone, spans, kept in brute.repeats(ROWS, window, brute.WORD.findall)]
    assert got(found, "doc_id", "n_units", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.size("spans"), "kept") == sorted(expected, key=repr)


@pytest.mark.parametrize("often", [4096, 2])
@pytest.mark.parametrize("window", [50, 100, 300])
def test_repeated_bytes(docs, window, often):
    found = suffixes.remove_repeats(docs(ROWS), window, often)
    rows = [(r.doc_id, r.n_units, sum(s.end - s.start for s in r.spans), len(r.spans), tuple(r.kept)) for r in found.collect()]
    assert sorted(rows, key=repr) == brute.repeats(ROWS, window, lambda t: list(t.encode()))


def test_windows_of_frequent_seeds_in_unlike_texts(docs, monkeypatch):
    """Only windows around long frequent strings become rows, not those that share a frequent seed and no more."""
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    # the string of a seed's length with the smallest hash is the seed of all windows that hold it
    seed = min((own(16) for _ in range(5000)), key=lambda x: tx.gram_hash(tx.byte_values(np.frombuffer(x.encode(), np.uint8)), 16)[0])
    around = own(30), own(30)
    grouped, asked = seeds.grouped, []
    monkeypatch.setattr(seeds, "grouped", lambda found, plan: asked.append(found.count()) or grouped(found, plan))
    for left, right, some in (("", "", False), (*around, True)):
        rows = [(i, own(60) + left + seed + right + own(60)) for i in range(40)] + [(50, own(60) + around[0] + seed + own(20))]
        found = suffixes.remove_repeats(docs(rows), 50, 8)
        result = [(r.doc_id, r.n_units, sum(s.end - s.start for s in r.spans), len(r.spans), tuple(r.kept)) for r in found.collect()]
        assert sorted(result, key=repr) == brute.repeats(rows, 50, lambda t: list(t.encode()))
        assert (asked.pop() > 0) == some


def test_packed_segments_come_back_whole():
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        place, n = rng.choice([(-1, 62), (rng.randint(0, 34), rng.randint(1, 35))])
        content = b"" if place < 0 else bytes(rng.choices(b"etaoin", k=n + 49))
        slot = rng.randint(-(2**63), 2**63 - 1)
        key = 0 if place < 0 else rng.randint(0, 2**32 - 1)
        rows.append((key, place, content, rng.choice([slot, 2**63 - 1]), slot, rng.randint(-(2**63), 2**63 - 1), n, place >= 0 and rng.random() < 0.2))
    blocks = list(seeds.packed(rows, 40, 7))
    assert len({(b[0], b[5]) for b in blocks}) == len(blocks) and {b[0] for b in blocks} == set(range(40))
    names = [f.split()[0] for f in seeds.PACKED.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.bool_()])], names)
    back = [(bucket, r) for bucket, found in seeds.unpacked(batch) for r in found.to_pylist()]
    expected = [
        (k, 0, None, o, s, i, (1 << n) - 1, False) if place < 0 else (k, place, c, o, s, i, n, often) for k, place, c, o, s, i, n, often in rows
    ]
    assert sorted((tuple(r.values()) for _, r in back), key=repr) == sorted(expected, key=repr)
    # a key has one bucket, and those of a bucket are in order, but for rows that belong to none
    usual = [(b, r["key"]) for b, r in back if r["segment"] is not None and not r["often"]]
    assert usual == sorted(usual) and len({k for _, k in usual}) == len(set(usual))
    # small keys, as seeds have them, are spread as well
    low = [(i * 1000, 0, b"x" * 50, i, i, i, 1, False) for i in range(4000)]
    assert max(n for _, n, *_ in seeds.packed(low, 40, 0)) < 300
    assert sum(len(b[2]) + len(b[3]) + len(b[4]) for b in blocks) < sum(found.nbytes for _, found in seeds.unpacked(batch)) / 2


def test_shuffles_go_with_what_was_made_of_them(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if "shuffle_" in str(f)}
    before = files()
    found = materialized(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 3).alias("k")).count(), "cleaned")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(r["count"] for r in found.collect()) == [333, 333, 334]


def test_long_runs_in_long_texts(docs, monkeypatch):
    # one passage of 900 words inside texts that differ, over the edges of parts and buckets
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(900)]
    rows = []
    for i in range(8):
        own = [f"d{i}w{rng.randint(0, 3000)}" for _ in range(2000)]
        at, a = rng.randint(0, 2000), rng.randint(0, 300)
        rows.append((i, " ".join(own[:at] + passage[a : a + 500 + 20 * i] + own[at:])))
    monkeypatch.setattr(seeds, "BUCKET_BYTES", 1000)
    found = repeats.remove_repeats(docs(rows), 200)
    expected = [(d, n, gone, spans, " ".join(kept)) for d, n, gone, spans, kept in brute.repeats(rows, 200, brute.WORD.findall)]
    assert sum(e[2] for e in expected) > 3000
    assert got(found, "doc_id", "n_units", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.size("spans"), "kept") == sorted(expected, key=repr)


def test_suffix_order():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(400)]
    group = np.sort(np.array([rng.randint(0, 20) for _ in strings]))
    order = suffixes.mergesort(suffixes.Suffixes(strings), group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))


def test_suffix_order_when_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(suffixes.tx, "run_hash", lambda sums, start, end: np.zeros(len(start), np.uint64))
    number = suffixes.numbered([b"ab", b"ac", b"ab", b"b"], np.zeros(4, np.int64))
    assert [len(set(number(n))) for n in (0, 1, 2)] == [1, 2, 3]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    found = near.near_duplicates(docs(ROWS), k, 80)
    assert got(found, "doc_id", "n_shingles", "component_id") == brute.near(ROWS, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_estimate_of_odd_sketches():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    other = np.concatenate([base[:890], rng.integers(0, 1 << 62, 110).astype(np.uint64)])
    differing = np.unpackbits((near.odd_sketch(near.signature(base)) ^ near.odd_sketch(near.signature(other))).view(np.uint8)).sum()
    assert abs(int(differing) - near.most_differing(890 / 1110)) < 40


def test_exact_duplicates(docs):
    def key(t):
        return "".join(c for c in t or "" if c not in " \t\n\v\f\r")

    groups = defaultdict(list)
    for i, (d, t) in enumerate(ROWS):
        groups[key(t)].append((-len(t or ""), brute.order(d), i))
    found = exact.duplicates(docs(ROWS), block=8).collect()
    assert len(found) == len(ROWS)
    assert sum(r.kept for r in found) == len(groups)
    expected = []
    for d, t in ROWS:
        best = min(groups[key(t)])
        expected.append((d, ROWS[best[2]][0], len(groups[key(t)])))
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=repr) == sorted(expected, key=repr)


def test_language(spark, docs):
    texts = {"en": "the other thing that we wanted", "de": "der andere und die schule nicht", "fr": "les autres choses que nous voulons"}
    labelled = spark.createDataFrame([(t, lang) for lang, t in texts.items()], "text string, lang string")
    known = language.train(labelled)
    mixed = " ".join([texts["de"]] * 8 + [texts["fr"]] * 5)
    rows = [(1, texts["fr"]), (2, None), (3, "12 .. 34"), (4, mixed), (None, texts["de"]), (6, "")]
    found = {r.doc_id: r for r in language.identify(docs(rows), *known).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, None, 6)] == ["fr", "und", "und", "de", "de", "und"]
    assert found[4].languages == ["de", "fr"] and abs(found[4].shares[0] - 8 / 13) < 0.1
    assert found[2].score == 0 and 0 < found[1].score <= 1
    nothing = language.train(labelled.limit(0))
    assert {r.lang_pred for r in language.identify(docs(rows), *nothing).collect()} == {"und"}


def test_trigrams_of_long_texts(monkeypatch):
    rng = random.Random(5)
    texts = ["some words of a rather long text " * 50, "", " ", "a", *("".join(rng.choices("abcé  .12\n中", k=300)) for _ in range(20))]
    whole = [language.trigram_counts(t) for t in texts]
    for chars in (1, 2, 7, 100):
        monkeypatch.setattr(language, "PART_CHARS", chars)
        assert all((language.trigram_counts(t) == w).all() for t, w in zip(texts, whole))


def test_cut_texts_have_the_same_ids():
    library = Tokenizer.from_file(JSON)
    text = "It's 3½ naïve  <|endoftext|> words\n\n  and 中文 ünd  more " * 40
    whole = library.encode(text, add_special_tokens=False).ids
    parts = [i for p in tokens.cuts(text, 50) for i in library.encode(p, add_special_tokens=False).ids]
    assert whole == parts == tokens.ids(text, JSON, RANKS).tolist()
    plain = "It's 3½ naïve  <|endoftext|> words\n\n  and ünd \x1c\x85 more '' 's !!" * 40
    assert library.encode(plain, add_special_tokens=False).ids == tokens.ids(plain, JSON, RANKS).tolist()


def test_token_counts(docs):
    library = Tokenizer.from_file(JSON)
    rows = ROWS + [(950, "中文 <|endoftext|> ½ ’s \x85 it's")]
    for frequent in (1 << 20, 30):  # all pre-tokens known to the tasks, or most of them joined
        found = token_counts.count_tokens(docs(rows), JSON, frequent)
        expected = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
        assert got(found, "doc_id", "n_bytes", "n_tokens") == sorted(expected, key=repr)


@pytest.mark.parametrize("capacity", [1024, 100, 7])
def test_packing(docs, capacity):
    found = packing.pack(docs(ROWS).repartition(3), capacity).collect()
    library = Tokenizer.from_file(JSON)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    alone = {d: t for d, t in ROWS if sum(d == x for x, _ in ROWS) == 1}
    for d, t in alone.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        at = 0
        for start, length, crc, total in sorted(pieces[d]):
            assert (start, crc, total) == (at, zlib.crc32(ids[at : at + length].tobytes()), len(ids))
            at += length
        assert at == len(ids)
    filled = sum(r.length for r in found)
    assert filled >= 0.93 * capacity * (len(sequences) - 4)


@pytest.mark.parametrize("longest, whole", [(1024, 0.95), (300, 0.95), (40_000, 1.0)])
def test_packing_keeps_documents_whole(longest, whole):
    rng = random.Random(longest)
    texts = [np.arange(rng.randint(1, longest), dtype=np.uint32) for _ in range(3000)]
    worker = packing._Worker(1024, 0)
    for i, ids in enumerate(texts):
        worker.add(i, ids)
        assert len(worker.waiting) <= 2 * packing.WAITING + 1
        assert worker.reserved < (packing.RESERVE + 1) * 1024
    worker.finish()
    pieces, filled = defaultdict(list), defaultdict(int)
    for doc_id, start, length, _, total, sequence, offset, _ in worker.rows:
        assert offset == filled[sequence] and total == len(texts[doc_id])
        filled[sequence] += length
        pieces[doc_id].append((start, length))
    for i, ids in enumerate(texts):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length
            at += length
        assert at == len(ids)
    fit = [i for i, ids in enumerate(texts) if len(ids) <= 1024]
    assert sum(len(pieces[i]) == 1 for i in fit) >= whole * len(fit)
    assert max(filled.values()) <= 1024 and sum(filled.values()) >= 0.98 * 1024 * len(filled)


def test_packing_of_the_documents(spark, sf_dir):
    found = QUERIES["op2_packing"](spark, sf_dir).cache()
    fit = found.filter("doc_tokens <= 1024").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert fit.agg(F.avg((F.col("n") == 1).cast("double"))).first()[0] >= 0.9
    n, filled = found.agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert filled >= 0.97 * 1024 * n


def test_ids_of_both_libraries(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    library = Tokenizer.from_file(JSON)
    for text, own in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.array_equal(tokens.ids(text, JSON, RANKS), np.array(own.ids, np.uint32))


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7} {'x' * (i % 7)}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "a\r\nb", ""), (None, "u", rows[0][2]), (3, "again", rows[3][2]), (102, "big", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives = warc.write(pages, str(tmp_path / "w"))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        to = first[h or ""] if first[h or ""] != i else None
        data = (h or "").encode()
        expected.append((i, len(data), warc.payload_digest(data), "response" if to is None else "revisit", to))
    assert sorted(map(tuple, warc.read(archives).collect()), key=repr) == sorted(expected, key=repr)
    assert sum(r.records for r in archives.collect()) == len(rows)
    limit = {r.record_type for r in warc.read(warc.write(pages, str(tmp_path / "v"), 1 << 30)).collect()}
    assert limit == {"response"}


@pytest.mark.parametrize("n", [1, 3, 300])
def test_warc_dictionary_comes_first(tmp_path, n):
    path = tmp_path / "a.warc.zst"
    records = [warc.record(i, "u", f"<html><body>some page of words {i}".encode() * 40, None, "d") for i in range(n)]
    assert warc.write_archive(str(path), records) == path.stat().st_size
    assert path.read_bytes()[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    assert list(warc.read_archive(str(path))) == records


def test_warc_records_are_read_by_themselves(spark, tmp_path):
    """Files as they lie on disk: the dictionary first, then frames that zstandard alone opens at their places."""
    rows = [(i, f"http://h/{i}", f"<p>page {i} {'words of it ' * (i % 50)}</p>") for i in range(90)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    pages = {}
    for archive in archives.collect():
        with open(archive.path, "rb") as file:
            data = file.read()
        assert len(data) == archive.bytes and data[:4] == bytes.fromhex("5d2a4d18")
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        places, at = [], 8 + size
        while at < len(data):
            places.append(at)
            frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            frame.decompress(data[at:])
            at = len(data) - len(frame.unused_data)
        assert len(places) == archive.records
        for at in reversed(places):  # in any order, each by itself
            one = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[at:])
            fields, http, payload = warc.parse(one)
            pages[int(fields["WARC-Record-ID"].split(":")[-1].rstrip(">"))] = payload.decode()
    assert pages == {i: h for i, _, h in rows}


def test_contained_items(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "a b"), (3, None), (4, ""), (1, item)], "item_id long, text string").withColumn("k", F.lit(1))
    near_enough = item.replace("twelve", "dozen")  # 7 of 8 shingles
    too_far = item.replace("six", "6")
    rows = [(1, f"w {item.upper()}! {'more ' * 500}"), (2, near_enough), (3, too_far), (4, "a, B."), (5, "x a b y z v"), (6, None), (7, "")]
    found = got(decontaminate.contained(docs(rows), items), "doc_id", "item_id", "n_shared", "n_shingles")
    assert found == [(1, 1, 8, 8)] * 2 + [(2, 1, 7, 8)] * 2 + [(4, 2, 1, 1), (5, 2, 1, 1)]


@pytest.mark.parametrize("share", [0.8, 0.5])
def test_items_of_all_sizes_in_long_documents(spark, docs, share):
    """Every item of 1 to 40 words, whole or in part, in documents of up to 30,000 words, as plain sets say."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [(n, " ".join(rng.choices(words, k=n))) for n in [*range(1, 9), 15, 16, 31, 40]] + [(90, "what is gravity"), (90, "naïve é")]
    rows = []
    for i in range(25):
        text = rng.choices([f"v{j}" for j in range(500)], k=rng.choice([0, 3, 50, 2000]))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            cut = rng.choice([0, 0, 1, len(part) // 4])
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in part[cut:]]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    rows += [(50, "v " * 30_000 + items[-3][1] + " v" * 5), (51, "What IS gravity?" + " x" * 800), rows[0], (None, rows[1][1])]
    expected = []
    for doc, text in rows:
        own = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
        for item, wanted in items:
            gram = wanted.split()
            k = min(5, len(gram))
            sought = {tuple(gram[i : i + k]) for i in range(len(gram) - k + 1)}
            shared = len(sought & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)})
            if shared >= share * len(sought):
                expected.append((doc, item, shared, len(sought)))
    found = decontaminate.contained(docs(rows), spark.createDataFrame(items, "item_id long, text string"), 5, share)
    assert got(found, "doc_id", "item_id", "n_shared", "n_shingles") == sorted(expected, key=repr)
    assert {90, 1, 40} <= {e[1] for e in expected}


def test_sketch_never_misses():
    for n in range(1, 200):
        lost = n - int(np.ceil(0.8 * n - 1e-9))
        assert min(n, decontaminate.sketch_size(n, 0.8)) > lost


def test_quotes(spark):
    rows = [
        (1, 0, "Hello there,\nhow are you?\n\nSecond thought."),
        (1, 1, f"On Monday, {'A ' * 400}wrote:\n> Hello there, how\n> are you?\n\nFine."),
        (1, 2, "> > second   Thought.\n> fine.\nGood\n>> unknown words"),
        (1, 3, "> later words"),
        (1, 4, "later words"),
        (1, 5, None),
        (1, 6, ""),
        (2, 0, "> Good\nother conversation"),
        (None, None, "> Good"),
    ]
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in chat.conversations(messages.withColumn("own", F.lit(1))).collect()}
    assert len(found) == len(rows)
    assert [(found[1, i].parent_turn, found[1, i].root_turn, found[1, i].depth) for i in range(7)] == [
        (None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0), (None, 4, 0), (None, 5, 0), (None, 6, 0),
    ]
    assert found[1, 1].text == "Fine." and found[1, 2].text == "Good" and found[1, 2].n_quotes == 3
    assert found[1, 2].n_linked == 2 and found[1, 3].n_linked == 0 and found[2, 0].parent_turn is None
    assert found[None, None].depth == 0


def test_empty_tables(spark, docs):
    none = docs([(1, "x")]).filter("doc_id < 0")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    results = [
        language.identify(none, *language.train(none)), packing.pack(none), token_counts.count_tokens(none),
        exact.duplicates(none), near.near_duplicates(none), repeats.remove_repeats(none), suffixes.remove_repeats(none),
        decontaminate.contained(none, items), decontaminate.contained(docs(ROWS), items),
        warc.read(warc.write(pages)), chat.conversations(messages),
    ]
    assert [r.count() for r in results] == [0] * len(results)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name]) is None


def test_languages_explain_texts(spark, sf_dir, docs):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = language.train(labelled.filter(~language.held_out()))
    # every document in a learned language is explained, also those held out
    assert language.identify(labelled, *known).filter("not explained and length(text) > 0").count() == 0
    rng = random.Random(3)
    strange = ["Съешь ещё этих мягких французских булок да выпей чаю", "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま",
               "".join(rng.choices("bcdfghjkmpqvwxyz    ", k=3000)), "12 34", "", None]
    rows = list(enumerate(strange)) + [(10, "Von."), (None, "la")]
    found = {r.doc_id: r.explained for r in language.identify(docs(rows), *known).collect()}
    assert [found[i] for i in (*range(6), 10, None)] == [False] * 6 + [True] * 2
    nothing = language.train(labelled.limit(0))
    found = language.identify(docs([(1, "la"), (2, "12"), (3, None)]), *nothing)
    assert got(found, "doc_id", "lang_pred", "explained") == [(1, "und", True), (2, "und", False), (3, "und", False)]


def plain_mixture(model, seen, chosen, rounds=400):
    """Proportions by loops over trigrams and languages, and the log likelihood."""
    share = [1 / len(chosen)] * len(chosen)
    for _ in range(rounds):
        new = [0.0] * len(chosen)
        for bucket, n in seen:
            parts = [s * model[bucket, c] for s, c in zip(share, chosen)]
            for i, part in enumerate(parts):
                new[i] += n * part / sum(parts)
        share = [x / sum(n for _, n in seen) for x in new]
    fit = sum(n * math.log(sum(s * model[bucket, c] for s, c in zip(share, chosen))) for bucket, n in seen)
    return share, fit


def test_language_sets_against_all_subsets(spark, sf_dir):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and length(text) between 40 and 700")
    names, model = language.train(labelled)
    texts = [r.text for r in labelled.orderBy("doc_id").limit(16).collect()]
    texts += [a[:200] + " " + b[:200] for a, b in zip(texts[:8], texts[8:])]
    for text in texts:
        counts = language.trigram_counts(text)
        seen = [(int(b), int(counts[b])) for b in np.flatnonzero(counts)]
        price = 4.0 * math.log(sum(n for _, n in seen))
        best = {}
        for size in range(1, len(names) + 1):
            for chosen in itertools.combinations(range(len(names)), size):
                share, fit = plain_mixture(model, seen, chosen, 60)
                best[chosen] = fit - price * size, share
        chosen, share, fit = language.infer(model, counts, 0.02, 4.0)
        wanted = max(best, key=lambda c: best[c][0])
        # the greedy choice reaches the best set of all
        assert tuple(chosen) == wanted
        assert np.abs(share - best[wanted][1]).max() < 0.02
        assert abs(fit - price * len(chosen) - best[wanted][0]) < 0.5


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language"](spark, sf_dir).join(docs, "doc_id").filter("held_out and lang is not null")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.95


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialized(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns and docs.count() <= before.count()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len({"".join((t or "").split()) for _, t in texts}) == len(texts)
    assert len({c for _, _, c in brute.near(texts, 5, 80)}) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_pipeline_on_awkward_rows(spark, sf_dir, docs):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first().text
    clean = ["".join(random.Random(i).choices("abcdefgh ", k=400)) for i in range(3)]
    rows = [
        (None, clean[0]), (None, f"{clean[1]} {item} {clean[1]}"), (7, clean[2]), (7, f"w {item}"),
        (8, None), (9, ""), (10, clean[2] + " "), (None, clean[0]), (None, None), (11, "12 34"), (None, clean[0] + " end"),
    ]
    kept = docs(rows).withColumns({"row": F.lit("r"), "score": F.lit("s")})
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialized(stage(spark, kept, sf_dir), "test")
        assert kept.columns == columns
    found = got(kept, "doc_id", "row", "score", F.expr("replace(trim(text), ' end')"))
    assert found == sorted([(None, "r", "s", clean[0].strip()), (10, "r", "s", clean[2].strip())], key=repr)
    nothing = docs(rows).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
