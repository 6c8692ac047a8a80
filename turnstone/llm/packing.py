"""Best-fit-decreasing packing of token sequences, exact over the whole table.

Best fit decreasing looks at nothing but lengths, and lengths are integers up to the capacity. So the
pieces of one length are placed together: a segment tree over remaining capacities finds the tightest
open bins in logarithmic time, and a run of equal bins takes a run of equal pieces in one step. The result
is what placing one piece after another gives. The driver sees one count for each length (at most
``capacity`` numbers, whatever the size of the table) and makes a plan of runs; every piece finds its
place from its rank among the pieces of its length.

Null text is empty; an empty document is its end token alone. Only documents longer than the capacity are
cut, into full pieces behind a first one that holds the rest. Repeated rows are packed each; the
order among pieces of one length is that of the input's partitions. Very long texts are encoded whole, in one step of their own. An empty table
gives an empty result; further columns of the input are left out.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.arrays import buffer_of, ranges
from turnstone.llm.bpe import HashCache
from turnstone.llm.common import only, packed, sliced, unpacked, written
from turnstone.llm.pretokens import special_cuts, with_hashes


class CapacityTree:
    """Which remaining capacities have open bins; the least of them that is at least a given one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = bytearray(2 * self.size)

    def mark(self, at: int, full: bool) -> None:
        at += self.size
        self.full[at] = full
        while at > 1:
            at //= 2
            now = self.full[2 * at] | self.full[2 * at + 1]
            if self.full[at] == now:
                break
            self.full[at] = now

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.full[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit decreasing of ``counts[length]`` pieces.

    For each length: runs (first rank, first bin, pieces a bin, offset in the bin). A run's bins follow one another.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> runs of bins (first, number)
    made = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def keep(left: int, first: int, number: int) -> None:
        if number and left:
            open_bins[left].append((first, number))
            tree.mark(left, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        rank, rest, out = 0, counts[length], runs.setdefault(length, [])
        while rest:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, made, -(-rest // (capacity // length))
                made += number
            else:
                first, number = open_bins[room].pop()
                if not open_bins[room]:
                    tree.mark(room, False)
            each = room // length
            whole = min(number, rest // each)
            if whole:
                out.append((rank, first, each, capacity - room))
                rank, rest = rank + whole * each, rest - whole * each
                keep(room - each * length, first, whole)
            if whole < number:
                if rest and rest < each:
                    out.append((rank, first + whole, rest, capacity - room))
                    keep(room - rest * length, first + whole, 1)
                    rank, rest, whole = rank + rest, 0, whole + 1
                keep(room, first + whole, number - whole)
    return runs


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    return whole, special, HashCache(20), [np.zeros(1 << 20, np.uint32), 0]


def token_ids(column: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a column, ``end`` behind each text, and the offsets of each text's ids.

    The library encodes each distinct pre-token once while a cache of fixed size holds it.
    """
    whole, special, cache, pool = _library(path)
    (mark, mark_id), *more = special.items()
    if more:
        raise ValueError("a vocabulary with one special string is expected")
    data, offsets = buffer_of(column)
    n = len(offsets) - 1
    cuts, owner, is_special = special_cuts(data, offsets, mark.encode())
    starts, ends, segment, hashes = with_hashes(data, cuts)
    inside = is_special[segment]
    first = np.zeros(len(starts), bool)
    first[np.searchsorted(starts, cuts[:-1][is_special])] = True
    keep = ~inside | first  # of a special string, one entry
    starts, ends, segment, hashes, inside = starts[keep], ends[keep], segment[keep], hashes[keep], inside[keep]
    plain = ~inside
    first_byte, last_byte = starts[plain], ends[plain]

    def make(at: np.ndarray) -> np.ndarray:
        raw = memoryview(data)
        words = [bytes(raw[a:b]).decode() for a, b in zip(first_byte[at].tolist(), last_byte[at].tolist(), strict=True)]
        ids = []
        for i in range(0, len(words), 2048):  # the library's results take a KB and more for each word
            ids += [e.ids for e in whole.encode_batch(words[i : i + 2048], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, used = int(sizes.sum()), pool[1]
        while used + total > len(pool[0]):
            pool[0] = np.concatenate([pool[0], np.zeros(len(pool[0]), np.uint32)])
        pool[0][used : used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        pool[1] = used + total
        return (used + np.cumsum(sizes) - sizes) << 24 | sizes

    if pool[1] > 8 << 20:  # entries whose keys have gone stay in the pool: begin anew
        cache.keys[:] = 0
        pool[0], pool[1] = np.zeros(1 << 20, np.uint32), 0
    where = np.zeros(len(starts), np.int64)
    where[plain] = cache.look_up(hashes[plain], make)
    sizes = np.where(inside, 1, where & 0xFFFFFF)
    doc = owner[segment]
    out_sizes = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64) + 1
    out_offsets = np.concatenate([[0], np.cumsum(out_sizes)])
    ids = np.empty(int(out_offsets[-1]), np.uint32)
    is_end = np.zeros(len(ids), bool)
    is_end[out_offsets[1:] - 1] = True
    ids[is_end] = end
    flat = pool[0][ranges(where >> 24, sizes)] if len(sizes) else np.zeros(0, np.uint32)
    if inside.any():
        flat[(np.cumsum(sizes) - sizes)[inside]] = mark_id
    ids[~is_end] = flat
    return ids, out_offsets


def cut(offsets: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of each piece of documents with these offsets."""
    total = np.diff(offsets)
    number = np.maximum(1, -(-total // capacity))
    doc = np.repeat(np.arange(len(total)), number)
    piece = ranges(np.zeros(len(number), np.int64), number)
    head = total - (number - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in sliced(batches, text):
            ids, offsets = token_ids(batch.column(1), vocabulary, end)
            doc, piece, start, length = cut(offsets, capacity)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = seen[ordered] + np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
            seen += np.bincount(length, minlength=capacity + 1)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (4 * np.append(offsets[doc] + start, offsets[-1])).tolist()  # pieces lie one behind the other
            values = pa.array([packed(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), values, pa.array(np.full(len(doc), part)), pa.array(rank)],
                names=[key, "piece", "start", "length", "ids", "part", "rank"],
            )

    rows = only(docs, key, text)
    kind = rows.schema[key].dataType.simpleString()
    cuts = written(rows.mapInArrow(pieces, f"`{key}` {kind}, piece int, start long, length long, ids binary, part long, rank long"), "pieces")
    counts = cuts.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = {length: tuple(np.array(x, np.int64) for x in zip(*of, strict=True)) for length, of in plan(total, capacity).items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: Spark broadcasts it up to its threshold and joins by sorting beyond that.
    base = written(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    ranked = cuts.join(base, ["part", "length"]).select(key, "piece", "start", "length", "ids", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            borders = np.append(np.flatnonzero(np.diff(length[order], prepend=-1)), len(order))
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                rows_ = order[a:b]
                size = int(length[rows_[0]])
                first, bin_, each, at = runs[size]
                run = np.searchsorted(first, rank[rows_], "right") - 1
                nth = rank[rows_] - first[run]
                sequence[rows_] = bin_[run] + nth // each[run]
                offset[rows_] = at[run] + nth % each[run] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([unpacked(x.as_py()) for x in batch.column(4)], pa.binary()), pa.array(sequence), pa.array(offset)], names=[key, "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def bins_of(counts: dict[int, int], capacity: int) -> int:
    """How many bins the plan opens; for tests and reports."""
    last = 0
    for length, runs in plan(counts, capacity).items():
        ranks = [r[0] for r in runs] + [counts[length]]
        for i, (_, first, each, _) in enumerate(runs):
            last = max(last, first + -(-(ranks[i + 1] - ranks[i]) // each))
    return last


def place_of(runs: list[tuple[int, int, int, int]], rank: int, length: int) -> tuple[int, int]:
    """Bin and offset of one piece; the plain form of what ``pack`` does with arrays."""
    first, bin_, each, at = runs[bisect_right([r[0] for r in runs], rank) - 1]
    return bin_ + (rank - first) // each, at + (rank - first) % each * length
