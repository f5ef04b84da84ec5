"""Registered queries of the operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lakescribe.llm import (
    chat,
    decontaminate,
    exact,
    language,
    mixing,
    near,
    packing,
    phrases,
    repeats,
    suffixes,
    token_counts,
    trie,
    warc,
)
from lakescribe.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_language")
def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = language.train(docs.filter(~language.held_out() & F.col("doc_id").isNotNull()))
    found = language.identify(docs.select("doc_id", "text"), *known)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), 1024)


@query(
    "op3_decontamination",
    r"""
    WITH cut AS (
      SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents
      UNION ALL
      SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') FROM benchmark
    ), widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM cut WHERE side = 'i' AND len(w) > 0),
    sh AS (
      SELECT DISTINCT side, id, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT side, id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM cut, widths
            WHERE side = 'd' OR k = least(len(w), 5))
    ), size AS (SELECT id, count(*) AS n FROM sh WHERE side = 'i' GROUP BY id)
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n) AS n_shingles,
           count(*) / any_value(n) AS containment
    FROM sh d JOIN sh i ON d.side = 'd' AND i.side = 'i' AND d.s = i.s JOIN size ON size.id = i.id
    GROUP BY d.id, i.id HAVING count(*) * 10 >= any_value(n) * 8
    """,
)
def op3_decontamination(spark, sf_dir):
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 0.8).drop("print")


@query(
    "op4_exact_duplicates",
    r"""
    WITH n AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
    ), k AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size FROM n
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
    """,
)
def op4_exact_duplicates(spark, sf_dir):
    return exact.duplicates(table(spark, sf_dir, "documents")).drop("print")


@query("op5_warc")
def op5_warc(spark, sf_dir):
    return warc.read(warc.write(table(spark, sf_dir, "pages"), least_bytes=0))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return found.select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_near_duplicates")
def op7_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), 4, 80).drop("print", "stays")


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query(
    "op9_quotation_links",
    r"""
    WITH RECURSIVE m AS (
      SELECT conv_id, turn, role, text, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS norm,
             lag(text) OVER w AS before1, lag(text, 2) OVER w AS before2
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ), o AS (SELECT conv_id, norm, min(turn) AS original FROM m WHERE norm <> '' GROUP BY conv_id, norm),
    q AS (
      SELECT m.conv_id, m.turn, level, o.original
      FROM (SELECT conv_id, turn, 1 AS level, before1 AS quote FROM m UNION ALL SELECT conv_id, turn, 2, before2 FROM m) m
      JOIN o ON o.conv_id = m.conv_id AND o.norm = trim(lower(regexp_replace(m.quote, '\s+', ' ', 'g')))
      WHERE m.quote IS NOT NULL
    ), p AS (
      SELECT conv_id, turn, arg_min(original, level) FILTER (WHERE original < turn) AS parent_turn,
             count(*) AS n_quotes, count(*) FILTER (WHERE original < turn) AS n_linked
      FROM q GROUP BY conv_id, turn
    ), up AS (
      SELECT m.conv_id, m.turn, m.turn AS root_turn, 0 AS depth FROM m LEFT JOIN p USING (conv_id, turn)
      WHERE parent_turn IS NULL
      UNION ALL
      SELECT p.conv_id, p.turn, up.root_turn, up.depth + 1
      FROM up JOIN p ON p.conv_id = up.conv_id AND p.parent_turn = up.turn
    )
    SELECT m.conv_id, m.turn, m.role, sha256(m.text) AS text_sha256, p.parent_turn, up.root_turn,
           up.depth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
    FROM m JOIN up ON up.conv_id = m.conv_id AND up.turn = m.turn
    LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn
    """,
)
def op9_quotation_links(spark, sf_dir):
    replies = chat.with_quotes(table(spark, sf_dir, "conversations"))
    return chat.conversations(replies, {"role": F.col("role"), "text_sha256": F.sha2("own", 256)})


@query("op10_repeated_passages")
def op10_repeated_passages(spark, sf_dir):
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), 13)
    return found.select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op12_source_mix",
    r"""
    WITH d AS (
      SELECT doc_id, source IS NULL AS apart, coalesce(source, '') AS source, md5(CAST(doc_id AS VARCHAR)) AS turn,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
    ), s AS (
      SELECT *, row_number() OVER (ORDER BY apart, source) AS place, [5, 2, 1][1 + (place - 1) % 3] AS w
      FROM (SELECT apart, source, CAST(sum(size) AS HUGEINT) AS size FROM d GROUP BY apart, source)
    ), f AS (
      SELECT *, row_number() OVER o AS rank, 150 * sum(size) OVER () - 200 * (sum(size) OVER o - size) AS rest,
             sum(w) OVER () - sum(w) OVER o + w AS ws
      FROM s WINDOW o AS (ORDER BY size / w, place ROWS UNBOUNDED PRECEDING)
    ), l AS (SELECT min(rank) AS rank, arg_min(rest, rank) AS rest, arg_min(ws, rank) AS ws FROM f WHERE 200 * size * ws > w * rest),
    t AS (
      SELECT apart, source, place, CAST(size AS BIGINT) AS source_size,
             CASE WHEN f.rank >= l.rank THEN CAST(w * l.rest AS DOUBLE) / CAST(100 * l.ws AS DOUBLE)
                  ELSE CAST(2 * size AS DOUBLE) END AS target
      FROM f, l
    ), q AS (
      SELECT d.*, place, source_size, target, CAST(sum(size) OVER (PARTITION BY apart, source ORDER BY turn, doc_id, size) AS BIGINT) - size AS start
      FROM d JOIN t USING (apart, source)
    ), p AS (
      SELECT *, again * source_size + start AS begins,
             greatest(0, least(size, CAST(ceil(target) AS BIGINT) - (again * source_size + start))) AS words
      FROM q, (VALUES (0), (1)) r(again)
    ), g AS (
      SELECT *, sum(words) OVER (ORDER BY CASE WHEN target > 0 THEN (begins + words) / target ELSE 0 END, place, begins, size
                                 ROWS UNBOUNDED PRECEDING) - words AS sent,
             (SELECT sum(size) * 150 // 100 FROM d) AS budget
      FROM p
    )
    SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(words, budget - sent))) AS BIGINT) AS taken,
           count(*) FILTER (WHERE least(words, budget - sent) > 0) AS times
    FROM g GROUP BY doc_id, size, source_size, target
    """,
)
def op12_source_mix(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"), (5, 2, 1), 150, 2)


@query(
    "op11_prefix_trie",
    r"""
    WITH crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
    ), c AS (
      SELECT conv_id, n, conv_id - conv_id % 5 AS first, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) % 9 AS h
      FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id), crc
    ), o AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p, id, bytes FROM (
        SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
               sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
        FROM conversations WHERE conv_id IS NOT NULL)
    ), r AS (
      SELECT c.conv_id, p, id, bytes FROM c JOIN o ON o.conv_id = c.first AND p <= h
      UNION ALL
      SELECT c.conv_id, p - c.h + least(c.h, coalesce(f.n, 0)), id, bytes
      FROM c JOIN o ON o.conv_id = c.conv_id AND p > c.h LEFT JOIN c f ON f.conv_id = c.first
    ), l AS (
      SELECT conv_id, coalesce(list(id ORDER BY p) FILTER (p IS NOT NULL), []) AS ids,
             list(bytes ORDER BY p) FILTER (p IS NOT NULL) AS sizes
      FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id
    ), m AS (
      SELECT conv_id, d, len(ids) AS size, array_to_string(ids[1 : d], '') AS path,
             CASE WHEN d > 0 THEN array_to_string(ids[1 : d - 1], '') END AS up,
             CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes
      FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM l)
    ), n AS (
      SELECT path, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = d AS leaf,
             (count(*) - 1) * any_value(bytes) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
      FROM m GROUP BY path, d
    ), s AS (
      SELECT a.path, CAST(count(*) FILTER (b.leaf) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens
      FROM n a JOIN n b ON starts_with(b.path, a.path) GROUP BY a.path
    )
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, count(k.path) AS n_children,
           any_value(n_leaves) AS n_leaves, any_value(saved_tokens) AS saved_tokens, any_value(n.ends_sha256) AS ends_sha256
    FROM n JOIN s USING (path) LEFT JOIN n p ON p.path = n.up LEFT JOIN n k ON k.up = n.path
    GROUP BY n.conv_id, n.d, p.conv_id, n.n_convs
    """,
)
def op11_prefix_trie(spark, sf_dir):
    return trie.trie(trie.with_shared_heads(trie.numbered(table(spark, sf_dir, "conversations")), 5, 9))


@query(
    "op13_collocations",
    r"""
    WITH t AS (
      SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
    ), g AS (
      SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM t, (SELECT unnest(range(1, 6)) AS m))
    ), f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
    n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM t GROUP BY lang),
    dropped AS (
      SELECT DISTINCT x.lang, inner_phrase AS phrase FROM (
        SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS inner_phrase FROM (
          SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i
          FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2))) x
      JOIN f y ON y.lang = x.lang AND y.phrase = x.inner_phrase WHERE 100 * x.a >= 100 * y.a
    ), c AS (
      SELECT f.lang, f.phrase, f.a, n.n, k, l.a AS l, r.a AS r, (1000 * f.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) f JOIN n USING (lang)
      JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1 : k], ' ')
      JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1 : f.m], ' ')
      WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = f.lang AND d.phrase = f.phrase)
    ), low AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM low WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY row_number() OVER o <= 2000
    """,
)
def op13_collocations(spark, sf_dir):
    # the length of a phrase's path depends on the graph alone and is tested apart
    return phrases.collocations(table(spark, sf_dir, "documents"), 100, 100, 2000).drop("path_words")
