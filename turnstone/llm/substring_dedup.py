"""Removal of word passages that occur more than once, by prefix-partitioned suffix trees.

Suffixes are split by prefixes of variable length until a group is small enough for memory. In each group a suffix
tree is built from the sorted suffixes and the lengths of the prefixes that neighbours share: an inner node of
depth d is a longest run of suffixes whose neighbours share d words or more. Inner nodes of ``window`` words and more are
repeats; one with different words in front of its leaves is a maximal repeat, for it can be made longer on neither side. The
places of maximal repeats are what is removed. Suffixes begin where ``repeats`` found that a prefix of ``gram`` words occurs again
within a window's reach, and are followed through that reach.

Null text has no words. Empty tables give empty results. Repeated rows, rows that share a key and rows without a key are places like any other;
the key may be of any type. Very long texts are worked on in one piece of their own. Further columns are left out but for those of ``carry``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from turnstone.llm.arrays import ranges
from turnstone.llm.repeats import Search, repeated_spans

#: Suffixes of a group whose tree is built at once.
GROUP_ROWS = 1 << 12


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def prefix_groups(first: np.ndarray, suffixes: np.ndarray, most: int = GROUP_ROWS) -> list[tuple[np.ndarray, int]]:
    """(rows, length of their common prefix): groups by ``first``, and by as many words as make them small.

    Small groups share a list entry with their neighbours (prefix 0); the tree parts them by ``first``.
    """
    order = np.argsort(first, kind="stable")
    borders = np.append(_runs(first[order]), len(order)) if len(order) else np.zeros(1, np.int64)
    out, small, held = [], [], 0
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a > most:
            todo = [(order[a:b], 0)]
            while todo:
                rows, depth = todo.pop()
                if len(rows) <= most or depth == suffixes.shape[1]:
                    out.append((rows, depth))
                    continue
                by = np.argsort(suffixes[rows, depth], kind="stable")
                cuts = _runs(suffixes[rows[by], depth])[1:]
                todo += [(part, depth + 1) for part in np.split(rows[by], cuts)]
        else:
            small.append(order[a:b])
            held += b - a
            if held >= most:
                out.append((np.concatenate(small), 0))
                small, held = [], 0
    if small:
        out.append((np.concatenate(small), 0))
    return out


def sorted_suffixes(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes (rows of words) and how many words each shares with the one before it."""
    rows = np.ascontiguousarray(suffixes)
    if not rows.shape[1]:
        return np.arange(len(rows)), np.zeros(len(rows), np.int64)
    order = np.argsort(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel())
    rows = rows[order]
    alike = rows[1:] == rows[:-1]
    shared = np.where(alike.all(1), rows.shape[1], alike.argmin(1))
    return order, np.concatenate([[0], shared])


def inner_nodes(shared: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, first leaves, last leaves) of the tree's inner nodes of ``least`` words or more, the shallow ones first."""
    out = []
    for depth in np.unique(shared[shared >= least]).tolist():
        deep = np.concatenate([[False], shared >= depth, [False]])
        begins, ends = np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(deep[:-1] & ~deep[1:])  # runs shared[begin:end]
        is_node = np.minimum.reduceat(np.append(shared, 0), np.stack([begins, ends], 1).ravel())[::2] == depth
        out.append((depth, begins[is_node] - 1, ends[is_node] - 1))
    return out


def maximal_repeats(order: np.ndarray, shared: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the words of the longest maximal repeat that begins it, 0 where there is none of ``least`` words.

    ``before``: the word in front of each suffix; 0 is not known, and differs from all.
    """
    word = before[order]
    changes = np.concatenate([[0], np.cumsum((word[1:] != word[:-1]) | (word[1:] == 0) | (word[:-1] == 0))])
    depth_of = np.zeros(len(order), np.int64)
    for depth, low, high in inner_nodes(shared, least):
        diverse = changes[high] > changes[low]
        low, high = low[diverse], high[diverse]
        depth_of[ranges(low, high - low + 1)] = depth
    out = np.empty(len(order), np.int64)
    out[order] = depth_of
    return out


def tree_repeats(group: np.ndarray, suffixes: np.ndarray, lengths: np.ndarray, before: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, words): suffixes that a maximal repeat of ``window`` words or more begins, and its words."""
    found = np.zeros(len(group), np.int64)
    for rows, depth in prefix_groups(group, suffixes, GROUP_ROWS):
        if len(rows) < 2:
            continue
        # The words of the prefix are the same in the whole group; ``group`` is like a word in front where there is no prefix.
        own = suffixes[rows, depth:] if depth else np.concatenate([group[rows].astype(np.uint64)[:, None], suffixes[rows]], 1)
        order, shared = sorted_suffixes(own)
        shared = shared + depth if depth else np.maximum(shared - 1, 0)
        shared[0] = 0
        size = lengths[rows[order]]
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
        found[rows] = maximal_repeats(order, shared, before[rows], window)
    at = np.flatnonzero(found)
    return at, found[at]


def remove_passages(docs: DataFrame, window: int = 35, gram: int = 14, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), hot: int | None = None) -> DataFrame:
    """key, text, rest (the carried columns), n_tokens (words), n_removed, spans (word ranges), kept (other words joined by a blank) of every document."""
    return repeated_spans(docs, Search(window, gram, words=True, other_document=False, find=tree_repeats), key, text, carry, hot=hot)
