"""Prefix tries, source mixes and collocations against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakescribe.llm import mixing, phrases, ranges, trie
from lakescribe.session import materialized

TURNS = "conv_id long, turn long, role string, text string, block int, size string, t0 string, level int, k1 string, first int"
SOURCED = "doc_id long, text string, source string, lang string, size string, target int, number int, again string, `part of all` int"


def plain_digest(role, text):
    role, text = role or "", text or ""
    size = len(text.encode())
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + size.to_bytes(4, "big"), size


def plain_paths(rows, family=None, heads=None):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, *plain_digest(role, text)))
    own = {c: [(d, n) for *_, d, n in sorted(turns)] for c, turns in own.items()}
    if family is None:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    return out


def plain_trie(paths):
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    below = defaultdict(lambda: [0, 0])
    for p, own in members.items():
        saved = (len(own) - 1) * (p[-1][1] if p else 0)
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += saved
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), children[p], *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made_turns(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 1000, 20_000, 20_005]:
        base = rng.choice([0, 1, 2])
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 40])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.03 else "user", f"turn {base} {t} é"))
    rows += [(50, None, "user", "first"), (50, None, None, None), (50, 0, "user", "second"), (50, 0, "user", "second")]
    rows += [(51, 5, "", "first"), (52, 5, "user", "x" * 300_000), (None, 0, "user", "alone"), (53, 0, None, "")]
    rows += [(c, t, "user", "same") for c in range(60, 90) for t in range(9)]
    rng.shuffle(rows)
    return rows


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "x", 2, "k", 3) for r in rows], TURNS)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_trie_of_conversations_as_they_are(spark):
    rows = made_turns()
    got = found(trie.trie(trie.whole(trie.numbered(turns(spark, rows)))))
    assert got == plain_trie(plain_paths(rows))


@pytest.mark.parametrize("heads", [9, 3])
def test_trie_of_shared_heads(spark, heads):
    rows = made_turns(5)
    got = found(trie.trie(trie.with_shared_heads(trie.numbered(turns(spark, rows)), 5, heads)))
    assert got == plain_trie(plain_paths(rows, 5, heads))


def test_trie_of_one_long_conversation(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in (1, 2) for t in range(300 - c)]
    got = found(trie.trie(trie.whole(trie.numbered(turns(spark, rows)))))
    assert got == plain_trie(plain_paths(rows))


def test_no_conversations(spark):
    none = turns(spark, [(1, 1, "a", "b")]).limit(0)
    assert trie.trie(trie.with_shared_heads(trie.numbered(none))).count() == 0
    without = turns(spark, [(None, 1, "a", "b")])
    assert trie.trie(trie.whole(trie.numbered(without))).count() == 0


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", ""]), rng.choice([None, 1, 2, 3, 4, 5]), i, rng.randint(0, 9)) for i in range(500)]
    df = materialized(spark.createDataFrame(rows, "g string, o int, i int, v long"), "test")
    for group in (["g"], []):
        got = ranges.running(df, group, ["o", "i"], {"total": F.col("v"), "place": F.lit(1)})
        totals, places, expected = Counter(), Counter(), []
        for g, o, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            key = g if group else ""
            totals[key] += v
            places[key] += 1
            expected.append((g, o, i, v, totals[key], places[key]))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def plain_targets(sizes, weights, percent, repeats):
    """Targets by the rule itself: share, stop at the cap, share what is above again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: repeats * sizes[s] for s in order}
    target = dict.fromkeys(order, 0.0)
    left, free = percent * sum(sizes.values()) / 100, [s for s in order if cap[s] > 0]
    while left > 1e-6 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - cap[s]) for s in free)
        for s in free:
            target[s] = min(target[s], cap[s])
        free = [s for s in free if target[s] < cap[s]]
    return target


def sourced(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, 2, "a", 3) for r in rows], SOURCED)


def made_sources(seed=2):
    rng = random.Random(seed)
    names = ["hot"] * 8 + ["b", "ä", "a", "Z", None, "", "tiny", "\U0001f600", "￮"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(names)) for i in range(400)]
    rows += [(500, None, "b"), (501, " \t\n", "b"), (None, "one two", "a"), (None, "three", "a"), (3, rows[3][1], rows[3][2])]
    rows += [(600, "w " * 5000, "huge"), (601, None, "void"), (602, "", "void"), (603, "\x0bx\x0cy z ", "ws")]
    return rows


@pytest.mark.parametrize("weights, percent, repeats", [((5, 2, 1), 150, 2), ((1, 9), 40, 1), ((3,), 450, 4), ((2, 1), 500, 3)])
def test_mix(spark, weights, percent, repeats):
    rows = made_sources()
    sizes, order = Counter(), {}
    for doc, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    got = mixing.mixed(sourced(spark, rows).withColumn("own", F.col("source")), weights, percent, repeats).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted(
        (d or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in rows
    )
    target = plain_targets(sizes, weights, percent, repeats)
    taken = Counter()
    source_of = {(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for d, t, s in rows}
    for r in got:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and math.isclose(r.target, target[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= repeats * r.size and -(-r.taken // max(r.size, 1)) == r.times
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= len(sizes), source
    assert sum(taken.values()) == min(percent * sum(sizes.values()) // 100, repeats * sum(sizes.values()))


def test_mix_again_and_in_order(spark):
    rows = made_sources(4)
    first = mixing.schedule(sourced(spark, rows)).filter("words > 0").collect()
    rows.reverse()
    second = mixing.mixed(sourced(spark, rows).repartition(5)).collect()
    by_doc = Counter()
    for r in first:
        by_doc[r.doc_id, r.size] += r.words
    again = Counter()
    for r in second:
        again[r.doc_id, r.size] += r.taken
    assert by_doc == +again
    ordered = sorted(first, key=lambda r: r.sent)
    upto = 0
    for r in ordered:
        assert r.sent == upto
        upto += r.words
    assert all(a.finish <= b.finish for a, b in zip(ordered, ordered[1:]))


def test_mix_of_nothing(spark):
    assert mixing.mixed(sourced(spark, [(1, "a", "b")]).limit(0)).count() == 0
    blank = mixing.mixed(sourced(spark, [(1, None, None), (2, "", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_words(spark):
    texts = ["", " ", "a", " a", "a ", "a b", " ", "a b", "x\x0by", "\n\na\t\tb  c\r", None, "é" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [r.n for r in df.select(mixing.words().alias("n")).collect()] == expected


def plain_phrases(rows, least, percent, best):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    dropped = set()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = lang, words[i : i + m]
                if 100 * a >= percent * f[inner]:
                    dropped.add(inner)
    scored = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) in dropped:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, own in scored.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made_prose(seed=6):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "Ünder", "naïve", "stone", "river", "x", "…", "İ", "and"]
    idioms = ["kick the bucket", "by and large stone", "a b c d e f g h i j", "x x x x x x x", "one two three four five six"]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.randint(0, 25)):
            words.append(rng.choice(idioms) if rng.random() < 0.25 else rng.choice(vocabulary))
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "!?"]))
        rows.append(("".join(words), rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t", "de"), (".,;", "de"), rows[0], rows[0]]
    return rows


def prose(spark, rows):
    full = [(i, t, "s", g, "x", 1, 2, "y", 3) for i, (t, g) in enumerate(rows)]
    return spark.createDataFrame(full, SOURCED)


@pytest.mark.parametrize("least, percent, best", [(4, 100, 2000), (10, 80, 5), (1, 100, 40)])
def test_collocations(spark, least, percent, best):
    rows = made_prose()
    got = phrases.collocations(prose(spark, rows), least, percent, best)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_phrases(rows, least, percent, best)


def test_collocations_of_a_long_text(spark):
    rows = [(" ".join(["alpha beta gamma"] * 100_000), "en"), ("delta " * 200_000, "en")]
    got = phrases.collocations(prose(spark, rows), 100, 100, 2000)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_phrases(rows, 100, 100, 2000)


@pytest.mark.parametrize("times", [1, 3, 1000])
def test_collocations_ranked_again(spark, monkeypatch, times):
    # 1: no language is settled by its rarest words alone; 3: some are; 1000: all are
    monkeypatch.setattr(phrases, "RARE", times)
    rows = made_prose(7)
    got = phrases.collocations(prose(spark, rows), 10, 100, 8)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_phrases(rows, 10, 100, 8)


def test_pairs_of_common_words_are_not_handed_on(spark, monkeypatch):
    """Words that meet by chance make frequent pairs by the square of their number; none can be among the best."""
    rng = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    rows = [(" ".join(rng.choices(common, k=75)), "en") for _ in range(100)]
    rows += [(f"r{i}a r{i}b", "en") for i in range(10) for _ in range(6)]
    handed, grams = [], phrases.grams
    monkeypatch.setattr(phrases, "grams", lambda *a: handed.append(grams(*a)) or handed[-1])
    got = phrases.collocations(prose(spark, rows), 3, 100, 5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_phrases(rows, 3, 100, 5)
    assert [h.count() < 100 for h in handed] == [True]


def test_paths_of_phrases(spark):
    text = "p one two three four five six seven q. z one two three four five six seven y."
    rows = [(text, "en")] * 3 + [("one two three four five other", "en"), ("five six seven u v w t. five six seven u v w t", "de")]
    docs = prose(spark, rows)
    edges = materialized(phrases.grams(docs, phrases.all_buckets(), phrases.all_buckets()), "test")
    on = phrases.paths(phrases.flows(edges), 2)
    texts = {(r.lang, r.phrase, r.path_words) for r in phrases.path_texts(on).collect()}
    assert texts == {
        ("de", "five six seven u v w t", 7),
        ("en", "one two three four five", 5),
        ("en", "two three four five six seven", 6),
        ("en", "p one two three four", 5),
        ("en", "z one two three four", 5),
        ("en", "four five six seven q", 5),
        ("en", "four five six seven y", 5),
    }


def test_big_counts_stay_exact(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 70_000_000_000_000, 5_000_000_000_001, 4_000_000_000_003)], "a long, n long, l long, r long")
    a, n, left, right = row.first()
    assert row.select(phrases.score().alias("s")).first().s == 1000 * a * n // (left * right)


def test_no_phrases(spark):
    assert phrases.collocations(prose(spark, [("a b", "en")]).limit(0)).count() == 0
    assert phrases.collocations(prose(spark, [(None, None), ("a b", "en")])).count() == 0
