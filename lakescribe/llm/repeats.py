"""Repeated passages of words: seed and extend.

Documents are joined on winnowed anchors, the seeds of ``lakescribe.llm.seeds``.
The segments of one anchor are extended together: word by word to the right
and to the left, those that go on alike stay in one class. A window repeats
where a segment of a smaller document is in the same class on both sides;
overlapping windows make up the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from lakescribe.llm.seeds import Windows, without_repeats

#: Words of an anchor.
ANCHOR_WORDS = 5


def extended(words: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Classes after 0, 1, 2, ... words: equal where the group and all words so far are; -1 is no word."""
    out = [group]
    for column in words.T:
        _, number = np.unique(out[-1] * (words.max() + 2) + column + 1, return_inverse=True)
        out.append(number)
    return out


def extend(window: int, anchor: int) -> Callable:
    """Classes of segments by their words from the anchor on, and before it, backwards."""

    def classes(contents: list[bytes], places: np.ndarray, group: np.ndarray):
        number: dict[bytes, int] = {}
        ahead = np.full((len(contents), window), -1, np.int64)
        behind = np.full((len(contents), window - anchor), -1, np.int64)
        for i, (content, place) in enumerate(zip(contents, places.tolist())):
            words = [number.setdefault(w, len(number)) for w in content.split(b" ")]
            after, before = words[place : place + window], words[:place][::-1]
            ahead[i, : len(after)] = after
            behind[i, : len(before)] = before
        right, left = extended(ahead, group), extended(behind, group)
        return left.__getitem__, right.__getitem__

    return classes


def remove_repeats(docs: DataFrame, window: int = 13, frequent_documents: int = 4096) -> DataFrame:
    """doc_id, n_units, spans and kept of every row of ``docs``: words that windows of smaller documents cover go.

    ``docs`` needs doc_id and text; other columns are ignored. Words are runs
    of anything but space and tab to carriage return, compared as they are. A
    window is ``window`` consecutive words of one document; a word goes if a
    window over it also starts in a document with a smaller id. ``spans`` are
    the maximal runs of such words, ``kept`` the others joined by one blank.
    Null and empty texts have no words. A null id is larger than all others;
    rows with equal ids take nothing from each other. An empty table gives no
    rows.
    """
    anchor = min(ANCHOR_WORDS, window)
    return without_repeats(docs, Windows("words", window, anchor), extend(window, anchor), frequent_documents)
