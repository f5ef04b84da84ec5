"""Token counts without ids: every distinct pre-token is counted once.

Three steps: a dictionary of all distinct pre-tokens with their piece counts;
the frequencies of pre-tokens per document; a join of the two, summed per
document. Pre-tokens that make up at least one in ``frequent`` of all
occurrences, so at most ``frequent`` of them, are known to every task and
never enter the join: no key of the join has more than that share. Real
texts have far fewer such pre-tokens than the bound allows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from operator import mul

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakescribe.llm import tokens
from lakescribe.session import materialized

#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 300_000


def _counted(pieces: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], ["piece", "seen"]
    )


def dictionary(docs: DataFrame, json_path: str) -> DataFrame:
    """(piece, seen, n_tokens): every distinct pre-token of all texts, encoded once."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for found in tokens.pre_tokens(text.as_py() or "", json_path):
                    held.update(found)
                    if len(held) > HELD:
                        yield _counted(held)
                        held = Counter()
        yield _counted(held)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokens.tokenizer(json_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                done = library.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
                counts = pa.array([len(x.ids) for x in done], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], ["piece", "seen", "n_tokens"])

    pieces = docs.select("text").mapInArrow(split, "piece string, seen long")
    return (
        pieces.groupBy("piece")
        .agg(F.sum("seen").alias("seen"))
        .mapInArrow(encode, "piece string, seen long, n_tokens long")
    )


def count_tokens(docs: DataFrame, json_path: str | None = None, frequent: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty
    text has 0 tokens, a null doc_id is kept. Equal rows are counted once and
    returned as often as they came. An empty table gives no rows.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    known = materialized(dictionary(docs, json_path), "pieces")
    total = known.agg(F.sum("seen")).first()[0] or 0
    hot = {r.piece: r.n_tokens for r in known.filter(F.col("seen") * frequent >= F.lit(total)).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        names = ["doc_id", "print", "piece", "n", "n_bytes"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, mark, text in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py() or ""
                own: Counter = Counter()
                for found in tokens.pre_tokens(text, json_path):
                    own.update(found)
                rare = [piece for piece in own if piece not in counts]
                known_tokens = sum(map(mul, map(counts.get, own, repeat(0)), own.values()))
                rows = len(rare) + 1
                columns[0] += [doc_id.as_py()] * rows
                columns[1] += [mark.as_py()] * rows
                columns[2] += [*rare, None]
                columns[3] += [*map(own.__getitem__, rare), known_tokens]
                columns[4] += [*repeat(None, rows - 1), len(text.encode())]
                if len(columns[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                    columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    seen = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) print", "text").mapInArrow(
        frequencies, "doc_id long, print long, piece string, n long, n_bytes long"
    )
    rare = (
        seen.filter("piece is not null")
        .join(known.select("piece", "n_tokens"), "piece")
        .select("doc_id", "print", (F.col("n") * F.col("n_tokens")).alias("n"), F.lit(None).cast("long").alias("n_bytes"))
    )
    whole = seen.filter("piece is null").select("doc_id", "print", "n", "n_bytes")
    # A document's own row has its bytes; equal rows come several times, and so do their pieces.
    return (
        whole.unionByName(rare)
        .groupBy("doc_id", "print")
        .agg(F.sum("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("times"))
        .select(
            "doc_id",
            "n_bytes",
            F.expr("n div times").alias("n_tokens"),
            F.explode(F.expr("array_repeat(0, int(times))")).alias("again"),
        )
        .drop("again")
    )
