"""Harmonic packing of documents into token sequences.

A document of n tokens that fits a sequence belongs to class k = capacity div n
and stays whole; a sequence of class k takes exactly k documents of its class.
The room that is left, less than 1 / (k + 1) of a sequence, is topped off with
tokens of documents longer than a sequence, which have to be cut anyway, and
what no room needs of those becomes full sequences. Where long documents are
scarce, sequences wait for a document that fits their room whole, and one that
doesn't is cut only when too many wait.

Every task fills its own sequences, so nothing is shuffled, and holds a bounded
number of tokens. At its end, the sequences that are open take each other's
documents until no sequence can be saved: their rooms together are less than one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lakescribe.llm import tokens

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, pieces_per_sequence long"
)
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]

#: Sequences' worth of long documents that a task keeps to top off others, the
#: number of sequences that may wait for more tokens, and the part of a
#: sequence that may stay empty when twice as many wait.
RESERVE, WAITING, SLACK = 64, 256, 64


class _Worker:
    """The open sequences of one task; a piece is (doc_id, start, ids, document's tokens)."""

    def __init__(self, capacity: int, task: int):
        self.capacity = capacity
        self.next_id = task << 32
        self.open: dict[int, list] = {}
        #: (room, serial, pieces, class) of sequences that have their documents, by room
        self.waiting: list[tuple[int, int, list, int]] = []
        self.serial = 0
        self.reserve: deque = deque()
        self.reserved = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list, per_sequence: int) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids)
            self.rows.append((doc_id, start, len(ids), crc, total, self.next_id, offset, per_sequence))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        piece = (doc_id, 0, ids, len(ids))
        if len(ids) > self.capacity:
            self.keep(piece)
        elif len(self.waiting) <= WAITING or not self.top_off(piece):
            if len(self.waiting) > 2 * WAITING:
                if self.waiting[0][0] <= self.capacity // SLACK:
                    _, _, pieces, per_sequence = self.waiting.pop(0)
                    self.close(pieces, per_sequence)
                else:
                    self.keep(piece)
                    return
            per_sequence = self.capacity // len(ids)
            filled = self.open.setdefault(per_sequence, [])
            filled.append(piece)
            if len(filled) == per_sequence:
                self.wait(self.open.pop(per_sequence), per_sequence)
                self.fill()

    def wait(self, pieces: list, per_sequence: int) -> None:
        """Close a sequence that is full, else let it wait for tokens."""
        room = self.capacity - sum(len(p[2]) for p in pieces)
        if room:
            self.serial += 1
            insort(self.waiting, (room, self.serial, pieces, per_sequence))
        else:
            self.close(pieces, per_sequence)

    def top_off(self, piece: tuple) -> bool:
        """Put a whole piece into the smallest room that takes it, if there is one."""
        at = bisect_left(self.waiting, (len(piece[2]),))
        if at == len(self.waiting):
            return False
        _, _, pieces, per_sequence = self.waiting.pop(at)
        self.wait([*pieces, piece], per_sequence)
        return True

    def keep(self, piece: tuple) -> None:
        """Put a piece into the reserve, which tops off what waits; what is too much for it becomes sequences."""
        self.reserve.append(piece)
        self.reserved += len(piece[2])
        self.fill()
        while self.reserved >= (RESERVE + 1) * self.capacity:
            self.close(self.cut(self.capacity), 1)
        if self.reserve:
            # a copy, so that a rest doesn't keep its whole document in memory
            doc_id, start, ids, total = self.reserve[0]
            self.reserve[0] = doc_id, start, ids.copy() if start else ids, total

    def cut(self, wanted: int) -> list[tuple]:
        """The first ``wanted`` tokens of the reserve."""
        pieces = []
        self.reserved -= wanted
        while wanted:
            doc_id, start, ids, total = self.reserve.popleft()
            part, rest = ids[:wanted], ids[wanted:]
            pieces.append((doc_id, start, part, total))
            wanted -= len(part)
            if len(rest):
                self.reserve.appendleft((doc_id, start + len(part), rest, total))
        return pieces

    def fill(self) -> None:
        """Fill what waits, as far as the reserve fills rooms completely."""
        while self.waiting and self.reserved >= self.waiting[0][0]:
            room, _, pieces, per_sequence = self.waiting.pop(0)
            self.close(pieces + self.cut(room), per_sequence)

    def finish(self) -> None:
        left = [p for filled in self.open.values() for p in filled]
        self.open = {}
        self.place(left)
        while self.waiting:
            room, _, pieces, _ = self.waiting[-1]
            if self.capacity - room > sum(w[0] for w in self.waiting[:-1]):
                break
            # the emptiest sequence is taken apart, as the others have room for all of it
            self.waiting.pop()
            self.place(pieces)
        for _, _, pieces, per_sequence in self.waiting:
            self.close(pieces, per_sequence)
        self.waiting = []

    def place(self, pieces: list) -> None:
        """Put pieces into rooms, whole where they fit, and the reserve after them."""
        for piece in sorted(pieces, key=lambda p: -len(p[2])):
            if not self.top_off(piece):
                if len(self.waiting) and sum(w[0] for w in self.waiting) >= len(piece[2]) + self.reserved:
                    self.keep(piece)
                else:
                    self.wait([piece], 0)
        self.fill()
        while self.reserved >= self.capacity:
            self.close(self.cut(self.capacity), 1)
        if self.reserved:
            rest = self.cut(self.reserved)
            if self.waiting:  # every room is larger than the rest
                _, _, own, per_sequence = self.waiting.pop(0)
                rest = own + rest
            else:
                per_sequence = 0
            self.wait(rest, per_sequence)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FIELDS)


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 0,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece of every document, with its sequence and place there.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is
    empty and gives one piece with the end id alone. A null doc_id is kept as
    null. Rows with equal ids are packed as separate documents. An empty table
    gives no rows. A text of any length is cut whole into pieces.
    ``pieces_per_sequence`` is the class, which is the number of documents
    that a sequence held before it was topped off: 1 for those that long
    documents fill alone, 0 for those begun at the end of a task.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(capacity, TaskContext.get().partitionId())
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.ids(text.as_py() or "", json_path, ranks_path)
                worker.add(doc_id, np.concatenate([ids, end]))
                if len(worker.rows) >= 20_000:
                    yield worker.take()
        worker.finish()
        yield worker.take()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(fill, SCHEMA)
