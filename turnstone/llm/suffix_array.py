"""Removal of byte strings that a document of a smaller key holds too, by depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``window`` bytes only, by passes of the most significant digit first; a
digit is eight bytes. After each pass suffixes without an equal neighbour are out. Groups that are equal
after the last pass are exactly the repeated windows. ``repeats`` says which suffixes are sorted and where.

Null text is empty. Matches never cross documents. Rows that share a key are one document to each other: none is
smaller. Rows without a key come behind all others; a key that isn't a number has no order here and is an error. Repeated rows
share their key. Very long texts are worked on in one piece of their own. Empty tables give empty results. Further columns are left
out but for those of ``carry``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from turnstone.llm.repeats import Search, repeated_spans

DIGIT = 8


def radix_groups(first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Numbers of the rows of a byte table: equal numbers for equal rows with equal ``first``."""
    n, width = windows.shape
    out = np.empty(n, np.int64)
    made = 0
    rows = np.arange(n)
    group = first.astype(np.int64)
    for at in [-1, *range(0, width, DIGIT)]:
        if at >= 0:
            digit = np.zeros((len(rows), DIGIT), np.uint8)
            size = min(DIGIT, width - at)
            digit[:, :size] = windows[rows, at : at + size]
            digit = digit.view(">u8").ravel()
            order = np.lexsort((digit, group))
            rows, group, digit = rows[order], group[order], digit[order].astype(np.uint64)
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(rows) else np.zeros(0, bool)
        else:
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            new = np.concatenate([[True], group[1:] != group[:-1]]) if len(rows) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        number = np.diff(np.append(start, len(rows)))
        alone = np.repeat(number == 1, number)
        single = rows[alone]
        out[single] = made + np.arange(len(single))
        made += len(single)
        group = (np.cumsum(new) - 1)[~alone]
        rows = rows[~alone]
        if not len(rows):
            return out
    out[rows] = made + group
    return out


def later_copies(group: np.ndarray, suffixes: np.ndarray, lengths: np.ndarray, before: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bytes): suffixes whose first ``window`` bytes a document of a lesser rank holds too."""
    same = radix_groups(group, suffixes[:, :window])
    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, rank)
    rows = np.flatnonzero(rank > least[same])
    return rows, np.full(len(rows), window)


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 20, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), hot: int | None = None) -> DataFrame:
    """key, text, rest (the carried columns), n_tokens (bytes), n_removed, spans (byte ranges), kept (remaining bytes) of every document."""
    return repeated_spans(docs, Search(window, gram, words=False, other_document=True, find=later_copies), key, text, carry, hot=hot)
