"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Words are runs of letters and digits, A-Z folded. A match of an item of n words is a stretch of a document
within floor(n * edits) word edits of it. The CGK walk reads a word sequence with a random bit for each step and
word that says whether to go on or to read the word again; sequences a few edits apart give strings of
small Hamming distance. Windows of the items' sizes are embedded by several walks, and tables of sampled
places of the strings retrieve items; what a table retrieves is held against the item by exact edit distance.
The number of tables follows from the target recall.

Only windows that can match are embedded: of an item's three-word grams at least n - 2 - 3 * floor(n * edits) stand
unchanged around any match, and grams of no item count nothing. That loses no match.

Items come in blocks of bounded size, each held against all documents in one pass without a shuffle; a
benchmark of any size is more passes. Items of fewer than ``least_words`` words are searched for without embeddings: of an
item cut into floor(n * edits) + 1 pieces one stands unchanged in any match, so the places of all pieces are
looked up and held against the item; none is missed.

Ids of items may be of any type that can be ordered. Items without an id are searched for too (item_id null); items of one id and several texts
each on their own. Null texts and texts without words, of documents and items, match nothing. Empty tables, of documents or items, give
an empty result (``clean``: all documents). Repeated rows give repeated results, repeated items one; very long texts are worked on in one piece of their own;
further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from turnstone.llm.arrays import SPACE, U64, buffer_of, fold_ascii, mix, rolling, span_hashes
from turnstone.llm.common import only, sliced

GRAM = 3
STRETCH = 3  # steps of a walk for each word
#: Items of one block: a few thousand of some dozens of words are a few MB in each worker.
BLOCK_ITEMS = 4096

_SEPARATOR = SPACE.copy()
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the number of words before each text."""
    data, offsets = buffer_of(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & np.concatenate([[True], ~inside[:-1]])
    first |= inside & edge[:-1]
    last = inside & np.concatenate([~inside[1:], [True]])
    last |= inside & edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(fold_ascii(data), starts, ends), np.searchsorted(starts, offsets)


def cgk(words: np.ndarray, starts: np.ndarray, n: int, walk: int, steps: int) -> np.ndarray:
    """The strings of one walk over windows words[s : s + n]: a row for each start, ``steps`` places, 0 behind the end."""
    out = np.zeros((len(starts), steps), np.uint64)
    at = np.zeros(len(starts), np.int64)
    for j in range(steps):
        inside = at < n
        word = words[np.minimum(starts + np.minimum(at, n - 1), len(words) - 1)]
        out[inside, j] = word[inside]
        at += (mix(word + U64((walk << 20) + j + 1)) & U64(1)).astype(np.int64)
    return out


def edit_match(item: np.ndarray, stretch: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Least edits between the item and any part of the stretch, with the part's start and end; None beyond ``most``."""
    m = len(stretch)
    cost = np.zeros(m + 1, np.int64)  # a match may start anywhere
    origin = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, word in enumerate(item.tolist(), 1):
        change = cost[:-1] + (stretch != U64(word))
        drop_ = cost[1:] + 1
        best = np.concatenate([[i], np.minimum(change, drop_)])
        came = np.concatenate([[0], np.where(change <= drop_, origin[:-1], origin[1:])])
        # Insertions: the least of best[j] + distance, from the left.
        reach = best - steps
        run = np.minimum.accumulate(reach)
        where = np.maximum.accumulate(np.where(reach == run, steps, 0))
        cost, origin = run + steps, came[where]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(origin[end]), end) if cost[end] <= most else None


def least_edits(item: np.ndarray, stretches: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Least edits between the item and any part of each stretch (a row of words; ``inside``: which of them count)."""
    cost = np.zeros((len(stretches), stretches.shape[1] + 1), np.int64)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(cost)
        new[:, 0] = i
        change = cost[:, :-1] + ((stretches != U64(word)) | ~inside)
        for j in range(1, cost.shape[1]):
            new[:, j] = np.minimum(np.minimum(change[:, j - 1], cost[:, j] + 1), new[:, j - 1] + 1)
        cost = new
    return cost.min(1)


@dataclass
class Tables:
    """Items of a block and their LSH tables, by number of words."""

    ids: list
    items: list[np.ndarray]
    edits: float = 0.2
    recall: float = 0.99
    sample: int = 3
    walks: int = 10
    agreement: float = 0.35
    seed: int = 29
    least_words: int = 8
    pieces: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    places: dict[int, list[tuple[int, np.ndarray]]] = field(default_factory=dict)
    tables: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    gram_at: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))

    def most(self, n: int) -> int:
        return int(n * self.edits)

    def number_of_tables(self) -> int:
        """Tables so that strings which agree in ``agreement`` of their places meet with the target recall."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agreement**self.sample))

    def build(self) -> Tables:
        rng = np.random.default_rng(self.seed)
        by_size: dict[int, list[int]] = {}
        for i, words in enumerate(self.items):
            if len(words) >= max(GRAM, self.least_words):
                by_size.setdefault(len(words), []).append(i)
                continue
            cuts = np.linspace(0, len(words), self.most(len(words)) + 2).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    self.pieces.setdefault(b - a, {}).setdefault(int(rolling(words[a:b], b - a)[0]), []).append((i, a))
        grams, at = [], []
        for n, members in by_size.items():
            flat = np.concatenate([self.items[i] for i in members])
            starts = np.arange(len(members)) * n
            self.places[n] = [(t % self.walks, np.sort(rng.choice(min(STRETCH * n, 2 * n), self.sample, replace=False))) for t in range(self.number_of_tables())]
            self.tables[n] = []
            for key in self.keys(flat, starts, n):
                table: dict[int, list[int]] = {}
                for i, k in zip(members, key.tolist(), strict=True):
                    table.setdefault(k, []).append(i)
                self.tables[n].append(table)
            for i in members:
                grams.append(rolling(self.items[i], GRAM))
                at.append(np.stack([np.full(n - GRAM + 1, n), np.arange(n - GRAM + 1)], 1))
        if grams:
            flat, where = np.concatenate(grams), np.concatenate(at)
            order = np.lexsort((where[:, 1], where[:, 0], flat))
            flat, where = flat[order], where[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (where[1:] != where[:-1]).any(1)
            self.grams, self.gram_at = flat[new], where[new]
        return self

    def keys(self, words: np.ndarray, starts: np.ndarray, n: int) -> list[np.ndarray]:
        """The key of each window in each table."""
        strings = [cgk(words, starts, n, w, 2 * n) for w in range(self.walks)]
        out = []
        for walk, places in self.places[n]:
            key = np.zeros(len(starts), np.uint64)
            for p in places.tolist():
                key = mix(key * U64(31) + strings[walk][:, p])
            out.append(key)
        return out

    def matches(self, words: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best match of each item in each text."""
        return sorted(self.short_matches(words, borders) + self.long_matches(words, borders))

    def short_matches(self, words: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Those of the items of fewer than ``least_words`` words."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for size, known in self.pieces.items():
            if len(words) < size:
                continue
            hashes = rolling(words, size)
            keys = np.array(sorted(known), np.uint64)
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == hashes)
            text = np.searchsorted(borders[1:], hit, "right")
            whole = hit + size <= borders[text + 1]
            hit, text, place = hit[whole], text[whole], place[hit[whole]]
            order = np.argsort(place, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                for i, offset in known[int(keys[place[part[0]]])] if len(part) else ():
                    item, most = self.items[i], self.most(len(self.items[i]))
                    t = text[part]
                    first = np.maximum(hit[part] - offset - most, borders[t])
                    last = np.minimum(hit[part] - offset + len(item) + most, borders[t + 1])
                    for a in range(0, len(part), 1 << 16):
                        t_, low, high = t[a : a + (1 << 16)], first[a : a + (1 << 16)], last[a : a + (1 << 16)]
                        at = low[:, None] + np.arange(len(item) + 2 * most)
                        edits = least_edits(item, words[np.minimum(at, len(words) - 1)], at < high[:, None])
                        ranked = np.lexsort((low, edits, t_))
                        best = ranked[np.unique(t_[ranked], return_index=True)[1]]
                        for x in best[edits[best] <= most].tolist():
                            got, to = (int(edits[x]), int(low[x]), int(high[x])), (int(t_[x]), i)
                            found[to] = min(found.get(to, got), got)
        out = []
        for (t, i), (_, low, high) in found.items():
            edits, start, end = edit_match(self.items[i], words[low:high], self.most(len(self.items[i])))
            out.append((t, i, edits, low - int(borders[t]) + start, low - int(borders[t]) + end))
        return out

    def long_matches(self, words: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        if not len(self.grams):
            return []
        hashes = rolling(words, GRAM)
        if not len(hashes):
            return []
        sieve = np.zeros(1 << 22, bool)
        sieve[(self.grams >> U64(42)).astype(np.int64)] = True
        hit = np.flatnonzero(sieve[(hashes >> U64(42)).astype(np.int64)])
        at = np.searchsorted(self.grams, hashes[hit])
        hit = hit[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == hashes[hit])]
        doc = np.searchsorted(borders[1:], hit, "right")
        inside = hit + GRAM <= borders[doc + 1]
        hit, doc = hit[inside], doc[inside]
        if not len(hit):
            return []
        low, high = np.searchsorted(self.grams, hashes[hit]), np.searchsorted(self.grams, hashes[hit], "right")
        number = high - low
        which = np.repeat(np.arange(len(hit)), number)
        entry = self.gram_at[np.repeat(low - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))]
        size, start, text = entry[:, 0], hit[which] - entry[:, 1], doc[which]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in np.unique(size).tolist():
            chosen = size == n
            s, t = start[chosen], text[chosen]
            pair = np.unique(np.stack([t, s], 1), axis=0)
            t, s = pair[:, 0], pair[:, 1]
            most = self.most(n)
            first, last = np.maximum(s - most, borders[t]), np.minimum(s + n + most, borders[t + 1])
            around = np.searchsorted(hit, last - GRAM + 1) - np.searchsorted(hit, first)
            able = around >= max(1, n - GRAM + 1 - GRAM * most)
            t, s, first, last = t[able], s[able], first[able], last[able]
            # A window that a border cuts is moved inside where the text is long enough.
            s = np.maximum(np.minimum(s, borders[t + 1] - n), borders[t])
            fits = borders[t + 1] - borders[t] >= n - most
            t, s, first, last = t[fits], s[fits], first[fits], last[fits]
            for a in range(0, len(s), 1 << 16):
                part = slice(a, a + (1 << 16))
                windows = s[part]
                seen: set[tuple[int, int]] = set()
                for table, key in zip(self.tables[n], self.keys(words, windows, n), strict=True):
                    for x, k in enumerate(key.tolist()):
                        for i in table.get(k, ()):
                            seen.add((a + x, i))
                for x, i in sorted(seen):
                    to = (int(t[x]), i)
                    have = found.get(to)
                    if have is not None and have[0] == 0:
                        continue
                    got = edit_match(self.items[i], words[first[x] : last[x]], most)
                    if got is not None and (have is None or got[0] < have[0]):
                        base = int(first[x]) - int(borders[t[x]])
                        found[to] = (got[0], base + got[1], base + got[2])
        return [(t, i, *x) for (t, i), x in sorted(found.items())]


def item_blocks(benchmark: DataFrame, least_words: int, edits: float, recall: float, key: str, text: str) -> Iterator[Tables]:
    """Blocks of at most BLOCK_ITEMS items, in the order of their ids (none first) and texts; only one block is on the driver at a time."""
    rows = only(benchmark, key, text).filter(F.col(f"`{text}`").isNotNull()).distinct()
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    last = None
    while True:
        if last is None:
            rest = rows
        elif last[0] is None:
            rest = rows.filter(k.isNotNull() | (t > F.lit(last[1])))
        else:
            rest = rows.filter((k > F.lit(last[0])) | ((k == F.lit(last[0])) & (t > F.lit(last[1]))))
        block = rest.orderBy(k, t).limit(BLOCK_ITEMS).collect()
        if not block:
            return
        words, borders = words_of(pa.array([r[1] for r in block], pa.string()))
        items = [(r[0], words[borders[i] : borders[i + 1]]) for i, r in enumerate(block)]
        items = [(i, w) for i, w in items if len(w)]
        yield Tables([i for i, _ in items], [w for _, w in items], edits, recall, least_words=least_words).build()
        if len(block) < BLOCK_ITEMS:
            return
        last = block[-1]


def contamination(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, recall: float = 0.99, least_words: int = 8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, edits, item_words, start_word, end_word): the best match of each item in each document that has one."""
    rows = only(docs, key, text)
    kind, item_kind = rows.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType
    schema = f"`{key}` {kind}, item_id {item_kind.simpleString()}, edits int, item_words int, start_word long, end_word long"
    id_kind, out = to_arrow_type(item_kind), None
    for tables in item_blocks(benchmark, least_words, edits, recall, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], tables: Tables = tables) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, text):
                words, borders = words_of(batch.column(1))
                found = tables.matches(words, borders)
                t, i, e, a, b = ([x[c] for x in found] for c in range(5))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t, pa.int64())), pa.array([tables.ids[x] for x in i], id_kind), pa.array(e, pa.int32()), pa.array([len(tables.items[x]) for x in i], pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    names=[key, "item_id", "edits", "item_words", "start_word", "end_word"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, recall: float = 0.99, least_words: int = 8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that match no item. One pass for each block of items, no shuffle."""
    at = docs.columns.index(text)
    out = docs
    for tables in item_blocks(benchmark, least_words, edits, recall, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], tables: Tables = tables) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, text):
                words, borders = words_of(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in tables.matches(words, borders)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
