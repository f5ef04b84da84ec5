"""Language identification by mixture inference.

Every language is a distribution over hashed character trigrams. A document's
trigrams are taken as drawn from a mixture of languages; expectation
maximisation finds the proportions, and the set of languages is the one with
the largest penalised likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from lakescribe.llm.text import mix

#: Hashed trigrams a language is described by; the model has so many numbers per language.
BUCKETS = 1 << 15
#: Characters that are turned into trigrams at once.
PART_CHARS = 1 << 18
UNKNOWN = "und"
#: The columns of an answer.
ANSWER = ("lang_pred", "score", "languages", "shares", "explained")

_OTHER = re.compile(r"[\W\d_]+")


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams of a whole text; only letters count, other runs are one blank."""
    counts = np.zeros(BUCKETS, np.int64)
    text = text or ""
    carried = " "
    for start in range(0, len(text), PART_CHARS):
        part = _OTHER.sub(" ", text[start : start + PART_CHARS].lower())
        if start + PART_CHARS >= len(text):
            part += " "
        if carried.endswith(" "):  # a run of other characters may go on over the cut
            part = part.removeprefix(" ")
        part = carried + part
        # the last two characters begin trigrams that the next part ends
        carried = part[-2:]
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(chars) >= 3:
            grams = (chars[:-2] << np.uint64(42)) ^ (chars[1:-1] << np.uint64(21)) ^ chars[2:]
            grams = grams[grams != np.uint64((32 << 42) ^ (32 << 21) ^ 32)]
            counts += np.bincount((mix(grams) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return counts


def train(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and the probability of every trigram bucket under each.

    ``labelled`` needs text and lang; rows without either teach nothing. All
    rows count. Driver and tasks hold ``BUCKETS`` numbers per language.
    """

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[lang] = held.get(lang, 0) + trigram_counts(text.as_py())
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"]
            )

    counted = (
        labelled.filter("lang is not null and text is not null")
        .select("lang", "text")
        .mapInArrow(gather, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counted["lang"].unique())
    seen = np.zeros((len(languages), BUCKETS))
    seen[np.searchsorted(languages, counted["lang"].to_numpy(str)) if len(counted) else [], counted["bucket"].astype(int)] = counted["n"]
    seen += smoothing
    return languages, np.ascontiguousarray((seen / seen.sum(axis=1, keepdims=True)).T)


def proportions(likelihood: np.ndarray, counts: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation maximisation, and the log likelihood.

    ``likelihood`` has a row per trigram and a column per language.
    """
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    if len(share) == 1:
        return share, float(counts @ np.log(likelihood[:, 0]))
    total = counts.sum()
    for _ in range(rounds):
        new = share * (likelihood.T @ (counts / (likelihood @ share))) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(counts @ np.log(likelihood @ share))


def infer(model: np.ndarray, counts: np.ndarray, least: float, penalty: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(languages of the best set, their proportions, the log likelihood); the penalty holds per language and log of trigrams."""
    at = np.flatnonzero(counts)
    seen, likelihood = counts[at].astype(float), model[at]
    price = penalty * np.log(seen.sum())
    chosen, best = np.arange(model.shape[1]), None
    while True:
        share, fit = proportions(likelihood[:, chosen], seen)
        fit -= price * len(chosen)
        if best is None or fit >= best[0]:
            best = fit, chosen, share
        if len(chosen) == 1:
            return best[1], best[2], best[0] + price * len(best[1])
        # the languages with hardly a share go together, else the one with the smallest
        keep = share >= max(least, share.min() * (1 + 1e-9))
        chosen = chosen[keep] if keep.any() else chosen[[share.argmax()]]


def explained(counts: np.ndarray, fit: float, penalty: float) -> bool:
    """Whether languages of log likelihood ``fit`` tell a text's trigrams as well as even chances do.

    Even chances of all buckets are a language of which nothing is known; to be
    preferred, it has to pay the penalty of a language, so that a short text
    isn't rejected for a few rare trigrams.
    """
    total = counts.sum()
    return bool(fit + total * np.log(BUCKETS) + penalty * np.log(total) >= 0)


def identify(
    docs: DataFrame, languages: list[str], model: np.ndarray, least: float = 0.02, penalty: float = 4.0
) -> DataFrame:
    """``docs`` with lang_pred, score, languages, shares and explained.

    Only text is read for a prediction. Texts that are null or have no letter
    get ``und``, score 0 and empty lists, and so does everything where the
    model knows no language. ``explained`` is false for texts without a letter
    and for those that even chances tell better than the languages, such as
    other scripts and random letters; where no language is known, nothing
    speaks against a text with letters. Columns of ``docs`` with those five
    names are replaced. Ties go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ANSWER]

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")):
                text = text.as_py() or ""
                letters = any(map(str.isalpha, text))
                if not languages or not letters:
                    rows.append((UNKNOWN, 0.0, [], [], letters))
                    continue
                counts = trigram_counts(text)
                chosen, share, fit = infer(known, counts, least, penalty)
                order = np.argsort(-share, kind="stable")
                names = [languages[i] for i in chosen[order]]
                rows.append((names[0], float(min(1.0, share.max())), names, share[order].tolist(),
                             explained(counts, fit, penalty)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                [*kept, *ANSWER],
            )

    added = StructType().add("lang_pred", "string").add("score", "double")
    added = added.add("languages", ArrayType(StringType())).add("shares", ArrayType(DoubleType())).add("explained", "boolean")
    own = docs.select(*kept)
    return own.mapInArrow(predict, StructType(own.schema.fields + added.fields))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text modulo 3 is 1; a null id is not."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))
