"""Where windows of W tokens occur again: the search shared by the two operators on repeated passages.

Sending every suffix of a corpus through a shuffle would multiply the corpus by W. Instead:

1. Anchors. In each run of W - k + 1 neighbouring grams (k tokens) the grams of the least hash are anchors, so every
   window of W tokens contains one, at the same place in each of its copies. Anchors are dealt into
   buckets by hash as sorted, packed arrays; an anchor whose gram is nowhere else is done. A gram that a block of
   texts holds more than once is known to be common there and sends one entry with its count, however many texts hold it.
2. Contexts. Every anchor that is left sends the W - k tokens around its gram to the bucket of its hash. Equal
   contexts are one record with the least document and the number of places. The suffixes that begin at one distance in front
   of one gram are a group; the operator's own method (``Search.find``) says which of them repeat, and how far.
3. Grams that more than ``hot`` places hold would make one bucket large. Each of their windows goes to a bucket of its own, by two
   64-bit hashes of the whole window; what repeats within a block is told there, and one entry a block is sent. ``hot`` is what makes 32 MB of
   contexts, and grows with the input beyond some TB, so that by counting the list of such grams has about 2^22 entries (32 MB) at most.
4. Spans of windows that occur elsewhere return to their documents.

Equal texts are found first, by digest (SHA-256); one of them takes part in 2 for all. Words, and contexts that are made one, are told
apart by 64-bit hashes. No step holds more than a block of texts or a bucket, whose sizes are parameters; what one gram's
copies send grows with the number of blocks in steps 1 and 3, and up to ``hot`` with the copies themselves in step 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.arrays import BYTE_VALUE, SPACE, U64, buffer_of, mix, ranges, rolling, sliding, span_hashes, word_spans
from turnstone.llm.common import buckets_for, drop, packed, release, size_of, sliced, unpacked, written

_TOP = U64(0xFFFFFFFFFFFFFFFF)
_PIECE = 1 << 18


@dataclass
class Tokens:
    """Tokens of a batch of texts: borders[i] is the number of tokens before text i."""

    borders: np.ndarray
    data: np.ndarray
    starts: np.ndarray | None = None  # of words; None: the tokens are bytes
    ends: np.ndarray | None = None
    hashes: np.ndarray | None = None

    @classmethod
    def of(cls, column: pa.Array, words: bool) -> Tokens:
        data, offsets = buffer_of(column)
        if not words:
            return cls(offsets, data)
        starts, ends, first = word_spans(data, offsets)
        return cls(first, data, starts, ends, span_hashes(data, starts, ends))

    def __len__(self) -> int:
        return int(self.borders[-1])

    def values(self, a: int, b: int) -> np.ndarray:
        return BYTE_VALUE[self.data[a:b]] if self.hashes is None else self.hashes[a:b]


@dataclass(frozen=True)
class Search:
    """window: W; gram: k; words: tokens are words, else bytes; other_document: copies count only in documents of lesser keys.

    ``find(group, suffixes, lengths, before, rank, window)`` gives (rows, depths): which rows of ``suffixes`` are to go, and how many
    of their tokens. Rows of different ``group`` are never equal; beyond its length a row is nought; ``before``: the token in front
    (nought: not known).
    """

    window: int
    gram: int
    words: bool
    other_document: bool
    find: Callable[..., tuple[np.ndarray, np.ndarray]]

    @property
    def side(self) -> int:
        return self.window - self.gram

    @property
    def width(self) -> int:
        return self.window + self.side


def anchors(tokens: Tokens, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token positions, gram hashes and text numbers of all anchors of texts that have a window."""
    n, k, w = len(tokens), search.gram, search.side + 1
    sizes = np.diff(tokens.borders)
    at, hashes = [], []
    ends = tokens.borders[1:][sizes > 0]
    for a in range(0, n, _PIECE):
        b = min(n, a + _PIECE)
        low, high = max(0, a - w + 1), min(n, b + w - 1 + k - 1)
        h = rolling(tokens.values(low, high), k)
        if len(h) < w:
            continue
        near = ends[np.searchsorted(ends, low + 1) : np.searchsorted(ends, high + k)]
        outside = (near[:, None] - np.arange(1, k)).ravel() - low if k > 1 else np.zeros(0, np.int64)
        h[outside[(outside >= 0) & (outside < len(h))]] = _TOP  # grams that a border cuts
        least = np.concatenate([np.zeros(w - 1, np.uint64), sliding(h, w), np.zeros(w - 1, np.uint64)])
        chosen = np.flatnonzero((sliding(least, w, least=False) == h) & (h != _TOP))
        chosen = chosen[(chosen + low >= a) & (chosen + low < b)]
        at.append(chosen + low)
        hashes.append(h[chosen])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place, hashes = np.concatenate(at), np.concatenate(hashes)
    doc = np.searchsorted(tokens.borders[1:], place, "right")
    long = sizes[doc] >= search.window
    return place[long], hashes[long], doc[long]


def _mark(uid: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for a gram in a document; a wrong match merely sends a context more."""
    return mix(uid.view(np.uint64) + hashes)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    borders = np.flatnonzero(np.diff(bucket, prepend=-1, append=n + 1))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each behind its size, compressed together."""
    return packed(b"".join(x for a in arrays for x in (np.int64(a.nbytes).tobytes(), np.ascontiguousarray(a).tobytes())))


def _arrays(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = unpacked(blob), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


_ROWS = "at long, kind int, payload binary"
_COMMON, _COPY, _FULL, _SPAN, _HOT, _DEEP = 0, 1, 2, 3, 4, 5


def _rows(rows: list[tuple[int, int, bytes]]) -> dict[str, pa.Array]:
    at, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return {"at": pa.array(at, pa.int64()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())}


def send_anchors(search: Search, buckets: int, groups: int) -> Callable:
    """Rows for the buckets (at >= 0), and marks known to be common at once for the documents' groups (at < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            tokens = Tokens.of(batch.column(1), search.words)
            uid = batch.column(0).to_numpy()
            _, hashes, doc = anchors(tokens, search)
            order = np.argsort(hashes, kind="stable")  # places ascend, so documents do in each gram
            hashes, doc = hashes[order], doc[order]
            if search.other_document:  # a gram once for each document
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                hashes, doc = hashes[new], doc[new]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            number = np.diff(np.append(first, len(hashes)))
            several = np.repeat(number > 1, number)
            out = []
            marks, group = _mark(uid[doc[several]], hashes[several]), np.mod(uid[doc[several]], groups)
            by = np.argsort(group, kind="stable")
            for g, rows in _by_bucket(group[by], groups):
                out.append((-1 - g, _COMMON, _blob(np.unique(marks[by][rows]))))
            kept = hashes[first]
            owner = np.where(number > 1, len(uid), doc[first]).astype(np.uint32)
            for b, rows in _by_bucket(_bucket_of(kept, buckets), buckets):
                used, index = np.unique(owner[rows], return_inverse=True)
                table = np.append(uid, 0)[used]
                out.append((b, _COMMON, _blob(np.diff(kept[rows], prepend=U64(0)), index.astype(np.uint32), table, (used == len(uid)).astype(np.uint8), number[rows].astype(np.uint32))))
            yield pa.RecordBatch.from_pydict(_rows(out))

    return run


def find_common(search: Search, groups: int, hot: int) -> Callable:
    """Marks of grams that a bucket holds more than once, for the groups of their documents; and grams of more than ``hot`` places (at -1)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = key[0].as_py()
        if at < 0:
            return pa.table({"at": pa.array(np.full(rows.num_rows, -1 - at), pa.int64()), "kind": rows["kind"], "payload": rows["payload"]})
        hashes, uid, several, places = [], [], [], []
        for blob in rows["payload"]:
            h, index, table, shared, number = _arrays(blob.as_py(), np.uint64, np.uint32, np.int64, np.uint8, np.uint32)
            hashes.append(np.cumsum(h, dtype=np.uint64))
            uid.append(table[index])
            several.append(shared[index])
            places.append(number)
        hashes, uid, several, places = map(np.concatenate, (hashes, uid, several, places))
        order = np.argsort(hashes, kind="stable")
        hashes, uid, several = hashes[order], uid[order], several[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        number = np.diff(np.append(first, len(hashes)))
        common = (number > 1) | (np.maximum.reduceat(several, first) > 0)
        chosen = np.repeat(common, number) & (several == 0)
        marks, group = _mark(uid[chosen], hashes[chosen]), np.mod(uid[chosen], groups)
        by = np.argsort(group, kind="stable")
        out = [(g, _COMMON, _blob(np.sort(marks[by][x]))) for g, x in _by_bucket(group[by], groups)]
        many = hashes[first][np.add.reduceat(places[order].astype(np.int64), first) > hot]
        return pa.table(_rows([*out, (-1, _HOT, _blob(many))] if len(many) else out))

    return run


def _joined(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one behind the other, words with a blank behind each, and where each token begins."""
    if tokens.starts is None:
        return tokens.data, np.arange(len(tokens.data) + 1)
    sizes = tokens.ends - tokens.starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at[1:] - 1] = False
    joined[inside] = tokens.data[ranges(tokens.starts, tokens.ends - tokens.starts)]
    return joined, at


def _window_hashes(tokens: Tokens, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at these (sorted) places, made piece by piece."""
    one, two = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    for a in range(0, len(tokens), _PIECE):
        low, high = np.searchsorted(start, (a, a + _PIECE))
        if high > low:
            values = tokens.values(a, min(len(tokens), a + _PIECE + window - 1))
            one[low:high], two[low:high] = rolling(values, window)[start[low:high] - a], rolling(mix(values), window)[start[low:high] - a]
    return one, two


def _deep_entries(search: Search, tokens: Tokens, place: np.ndarray, doc: np.ndarray, uid: np.ndarray, rank: np.ndarray, buckets: int, groups: int) -> list[tuple[int, int, bytes]]:
    """The windows around anchors of hot grams, one entry each where a block holds one several times, and what is known to repeat at once."""
    first = np.maximum(place - search.side, tokens.borders[doc])
    last = np.minimum(place, tokens.borders[doc + 1] - search.window)
    start = np.unique(ranges(first, np.maximum(0, last - first + 1)))
    if not len(start):
        return []
    doc = np.searchsorted(tokens.borders[1:], start, "right")
    one, two = _window_hashes(tokens, start, search.window)
    order = np.lexsort((start, rank[doc], two, one))
    one, two, start, doc = one[order], two[order], start[order], doc[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    at = np.flatnonzero(new)
    number = np.diff(np.append(at, len(one)))
    if search.other_document:  # what isn't in the block's least document goes; that document's places are sent
        known = rank[doc] > np.repeat(rank[doc[at]], number)
        sent = np.flatnonzero(~known)
        several = np.zeros(len(sent), np.uint8)
    else:  # all places go where there are two, and one entry says so
        known = np.repeat(number > 1, number)
        sent, several = at, (number > 1).astype(np.uint8)
    out = []
    place = start - tokens.borders[doc]
    u, s, e = _merge(uid[doc[known]], place[known], place[known] + search.window)
    group = np.mod(u, groups)
    by = np.argsort(group, kind="stable")
    for g, x in _by_bucket(group[by], groups):
        out.append((-1 - g, _SPAN, _blob(u[by][x], s[by][x], e[by][x])))
    for b, x in _by_bucket(_bucket_of(one[sent], buckets), buckets):
        chosen = sent[x]
        used, index = np.unique(doc[chosen], return_inverse=True)
        out.append((b, _DEEP, _blob(one[chosen], two[chosen], index.astype(np.uint32), uid[used], rank[used], place[chosen], several[x])))
    return out


def send_contexts(search: Search, buckets: int, groups: int, hot: np.ndarray) -> Callable:
    """For a group of documents and the marks of their common grams: contexts for the buckets, windows of hot grams apart."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, rows: pa.Table) -> pa.Table:
        kinds, payloads = rows["kind"].to_pylist(), rows["payload"].to_pylist()
        marks = [_arrays(p, np.uint64)[0] for kind, p in zip(kinds, payloads, strict=True) if kind == _COMMON]
        if not marks or not docs.num_rows:
            return pa.table(_rows([]))
        marks = np.unique(np.concatenate(marks))
        copies = [_arrays(p, np.int64)[0] for kind, p in zip(kinds, payloads, strict=True) if kind == _COPY]
        if copies:
            docs = docs.filter(pa.array(~np.isin(docs["uid"].to_numpy(), np.concatenate(copies))))
        out = []
        for batch in sliced(iter(docs.to_batches())):
            tokens = Tokens.of(batch.column(batch.schema.get_field_index("text")), search.words)
            uid = batch.column(batch.schema.get_field_index("uid")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            place, hashes, doc = anchors(tokens, search)
            mark = _mark(uid[doc], hashes)
            at = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
            common = marks[at] == mark
            place, hashes, doc = place[common], hashes[common], doc[common]
            if len(hot):
                deep = np.isin(hashes, hot)
                out += _deep_entries(search, tokens, place[deep], doc[deep], uid, rank, buckets, groups)
                place, hashes, doc = place[~deep], hashes[~deep], doc[~deep]
            bucket = _bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")
            place, hashes, doc, bucket = place[order], hashes[order], doc[order], bucket[order]
            joined, begins = _joined(tokens)
            left = np.minimum(search.side, place - tokens.borders[doc]).astype(np.uint8)
            right = np.minimum(search.side, tokens.borders[doc + 1] - place - search.gram).astype(np.uint8)
            for b, rows_ in _by_bucket(bucket, buckets):
                p, d = place[rows_], doc[rows_]
                low, high = begins[p - left[rows_]], begins[p + search.gram + right[rows_]]
                data, sizes = joined[ranges(low, high - low)], high - low
                used, index = np.unique(d, return_inverse=True)
                out.append((b, _SPAN, _blob(hashes[rows_], index.astype(np.uint32), uid[used], rank[used], p - tokens.borders[d], left[rows_], right[rows_], sizes.astype(np.uint32), data)))
        return pa.table(_rows(out))

    return run


def _table(search: Search, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Contexts as rows of ``width`` tokens, the gram in the same columns of each; nought beyond a text's borders."""
    n = len(left)
    total = left.astype(np.int64) + right + search.gram
    columns = ranges(search.side - left.astype(np.int64), total)
    out = np.zeros((n, search.width), np.uint64 if search.words else np.uint8)
    if search.words:
        offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        starts, ends, _ = word_spans(data, offsets)
        data = span_hashes(data, starts, ends)
    out[np.repeat(np.arange(n), total), columns] = data
    return out


_COEFFICIENTS = mix(np.arange(1, 513, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _row_hash(table: np.ndarray, seed: int = 0) -> np.ndarray:
    out = np.zeros(len(table), np.uint64)
    for j in range(table.shape[1]):
        out += mix(table[:, j].astype(np.uint64) + U64(j + 1 + 1000 * seed)) * _COEFFICIENTS[j]
    return mix(out)


def _merge(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each document, as sorted spans that don't touch."""
    if not len(uid):
        return uid, start, end
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    # Ends so far, document by document: shift each document beyond all positions of the one before.
    step = int(end.max()) + 1
    group = np.cumsum(np.concatenate([[0], uid[1:] != uid[:-1]])).astype(np.int64)
    reach = np.maximum.accumulate(end + group * step)
    new = np.ones(len(uid), bool)
    new[1:] = (start[1:] + group[1:] * step) > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(uid)) - 1
    return uid[at], start[at], reach[last] - group[last] * step


#: Suffixes that are held against one another at once, unless one gram has more.
PART_ROWS = 1 << 13


def _of_contexts(search: Search, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (uid, start, end) of windows that occur elsewhere, from the contexts of a bucket."""
    parts: list[list[np.ndarray]] = []
    while payloads:
        h, index, uid, rank, place, left, right, sizes, data = _arrays(payloads.pop(), np.uint64, np.uint32, np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint32, np.uint8)
        parts.append([h, uid[index], rank[index], place, left, right, _table(search, left, right, sizes, data)])
    h, uid, rank, place, left, right, table = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    left, right = left.astype(np.int64), right.astype(np.int64)
    low, high = np.maximum(0, search.side - right), np.minimum(search.side, left)  # of offsets of windows
    context = _row_hash(table) + mix((left * 256 + right).view(np.uint64))
    order = np.lexsort((rank, context, h))
    h, uid, rank, place, low, high, right, context = (x[order] for x in (h, uid, rank, place, low, high, right, context))
    new_gram = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    cls = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(h)))
    least = rank[first]
    gram_of = (np.cumsum(new_gram) - 1)[first]
    variants = np.bincount(gram_of)[gram_of]
    whole = rank > least[cls] if search.other_document else (number > 1)[cls]
    whole &= high >= low
    spans = [(uid[whole], place[whole] - high[whole], place[whole] - low[whole] + search.window)]
    # Of grams with several contexts: the suffixes of one record for each context, one distance to the gram after the other.
    chosen = np.flatnonzero((variants > 1) & (high[first] >= low[first]))
    at_least = _least_run(rank, first, number) if search.other_document else np.ones(len(first), np.int64)
    for part in _bounded(gram_of[chosen], PART_ROWS):
        c = chosen[part]
        rows = table[order[first[c]]]
        for offset in range(search.side + 1):
            has = np.flatnonzero((low[first[c]] <= offset) & (offset <= high[first[c]]))
            if len(has) < 2:
                continue
            f = first[c[has]]
            begin = search.side - offset
            before = rows[has, begin - 1] if begin else np.zeros(len(has), rows.dtype)
            found, depth = search.find(gram_of[c[has]], rows[has, begin:], offset + search.gram + right[f], before, least[c[has]], search.window)
            if len(found):
                # All places of a record's least document have what the record has.
                several = at_least[c[has[found]]]
                rec, depth = ranges(f[found], several), np.repeat(depth, several)
                spans.append((uid[rec], place[rec] - offset, place[rec] - offset + depth))
    return _merge(*(np.concatenate(x) for x in zip(*spans, strict=True)))


def _of_windows(search: Search, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that occur elsewhere, from the windows of hot grams."""
    parts = []
    while payloads:
        one, two, index, uid, rank, place, several = _arrays(payloads.pop(), np.uint64, np.uint64, np.uint32, np.int64, np.int64, np.int64, np.uint8)
        parts.append([one, two, uid[index], rank[index], place, several])
    one, two, uid, rank, place, several = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((rank, two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    number = np.diff(np.append(first, len(one)))
    if search.other_document:
        again = rank[order] > np.repeat(rank[order][first], number)
    else:
        again = np.repeat((number > 1) | (np.maximum.reduceat(several[order], first) > 0), number)
    which = order[again]
    return _merge(uid[which], place[which], place[which] + search.window)


def find_spans(search: Search, groups: int) -> Callable:
    """Spans covered by windows that occur elsewhere, from the contexts and windows of a bucket; spans found before pass through."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = key[0].as_py()
        if at < 0:
            return pa.table({"at": pa.array(np.full(rows.num_rows, -1 - at), pa.int64()), "kind": rows["kind"], "payload": rows["payload"]})
        spans = []
        for kind, of in ((_SPAN, _of_contexts), (_DEEP, _of_windows)):
            payloads = [p.as_py() for k, p in zip(rows["kind"].to_pylist(), rows["payload"], strict=True) if k == kind]
            if payloads:
                spans.append(of(search, payloads))
        u, s, e = _merge(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        group = np.mod(u, groups)
        by = np.argsort(group, kind="stable")
        return pa.table(_rows([(g, _SPAN, _blob(u[by][x], s[by][x], e[by][x])) for g, x in _by_bucket(group[by], groups)]))

    return run


def _least_run(rank: np.ndarray, first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How many records at the start of each class have the class's least rank."""
    is_least = rank == np.repeat(rank[first], number)
    return np.add.reduceat(is_least.astype(np.int64), first)


def _bounded(gram: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of a sorted array that don't part equal values, of about ``most`` entries."""
    at, n = 0, len(gram)
    while at < n:
        to = min(n, at + most)
        if to < n:
            to = max(int(np.searchsorted(gram, gram[to], "left")), at)
            if to == at:  # one gram alone is more
                to = int(np.searchsorted(gram, gram[at], "right"))
        yield slice(at, to)
        at = to


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_spans(search: Search) -> Callable:
    """Documents of a group without what their spans cover."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, rows: pa.Table) -> pa.Table:
        kinds, payloads = rows["kind"].to_pylist(), rows["payload"].to_pylist()
        spans = [_arrays(p, np.int64, np.int64, np.int64) for kind, p in zip(kinds, payloads, strict=True) if kind == _SPAN]
        uid, start, end = _merge(*(np.concatenate(x) for x in zip(*spans, strict=True))) if spans else (np.zeros(0, np.int64),) * 3
        full = [_arrays(p, np.int64)[0] for kind, p in zip(kinds, payloads, strict=True) if kind == _FULL]
        full = set(np.concatenate(full).tolist()) if full else set()
        out = []
        for batch in sliced(iter(docs.to_batches())):
            tokens = Tokens.of(batch.column(batch.schema.get_field_index("text")), search.words)
            own = batch.column(batch.schema.get_field_index("uid")).to_numpy()
            sizes = np.diff(tokens.borders)
            a, b = np.searchsorted(uid, own), np.searchsorted(uid, own, "right")
            removed, kept, lists = [], [], []
            for i, u in enumerate(own.tolist()):
                n, base = int(sizes[i]), int(tokens.borders[i])
                cuts = [(0, n)] if u in full and n >= search.window else list(zip(start[a[i] : b[i]].tolist(), end[a[i] : b[i]].tolist(), strict=True))
                removed.append(sum(e - s for s, e in cuts))
                lists.append([{"start": s, "end": e} for s, e in cuts])
                kept.append(_without(tokens, base, n, cuts))
            out.append(
                pa.table({
                    **{c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names if c not in ("uid", "rank", "at", "text")},
                    "text": batch.column(batch.schema.get_field_index("text")),
                    "n_tokens": pa.array(sizes),
                    "n_removed": pa.array(removed, pa.int64()),
                    "spans": pa.array(lists, _SPANS),
                    "kept": pa.array(kept, pa.binary()),
                })
            )
        if out:
            return pa.concat_tables(out)
        kinds = {c: docs.schema.field(c).type for c in ("key", "rest", "text")} | {"n_tokens": pa.int64(), "n_removed": pa.int64(), "spans": _SPANS, "kept": pa.binary()}
        return pa.table({c: pa.array([], k) for c, k in kinds.items()})

    return run


def _without(tokens: Tokens, base: int, n: int, cuts: list[tuple[int, int]]) -> bytes:
    """The tokens outside the cuts: bytes as they are, words joined by one blank."""
    keep, at = [], 0
    for s, e in [*cuts, (n, n)]:
        if s > at:
            keep.append((base + at, base + s))
        at = e
    if tokens.starts is None:
        return b"".join(tokens.data[a:b].tobytes() for a, b in keep)
    if not keep:
        return b""
    parts = []
    for a, b in keep:
        raw = tokens.data[tokens.starts[a] : tokens.ends[b - 1]]
        parts.append(b" ".join(_words(raw)))
    return b" ".join(parts)


_BLANKS = bytes(b for b in range(256) if SPACE[b])
_TO_BLANK = bytes(0x20 if SPACE[b] else b for b in range(256))


def _words(raw: np.ndarray) -> list[bytes]:
    return [w for w in raw.tobytes().translate(_TO_BLANK).split(b" ") if w]


def usual_hot(search: Search, file_bytes: int) -> int:
    """Places from which a gram counts as hot, for texts of about three times the files' size."""
    anchors = 3 * file_bytes // ((6 if search.words else 1) * (search.side + 2) // 2)
    return max((32 << 20) // (search.width * (8 if search.words else 1)), anchors >> 22)


def repeated_spans(docs: DataFrame, search: Search, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), bucket_bytes: int = 2 << 20, hot: int | None = None) -> DataFrame:
    """key, text, rest (a struct of the carried columns), n_tokens, n_removed, spans (of tokens, merged), kept (bytes outside the spans) of every document.

    The key decides which document is smaller, so it must be a number or null where that counts; other keys are an error there.
    """
    spark = docs.sparkSession
    groups = buckets = buckets_for(docs, bucket_bytes, least=256)
    hot = usual_hot(search, size_of(docs)) if hot is None else hot
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), rest.alias("rest"))
    # Rows without a key come behind all others.
    rank = F.coalesce(F.col("key").cast("long"), F.lit((1 << 63) - 1)) if search.other_document else F.lit(0).cast("long")
    rows = rows.select("key", "text", "rest", F.xxhash64("key", "text").alias("uid"), rank.alias("rank"))
    rows = rows.withColumn("at", F.pmod(F.col("uid"), F.lit(groups)))

    common = rows.select("uid", "text").mapInArrow(send_anchors(search, buckets, groups), _ROWS)
    common = written(common.groupBy("at").applyInArrow(find_common(search, groups, hot), _ROWS), "common")
    release(spark)
    many = [_arrays(bytes(r["payload"]), np.uint64)[0] for r in common.filter(F.col("kind") == _HOT).select("payload").collect()]  # about 2^22 numbers at most, see above
    many = np.unique(np.concatenate(many)) if many else np.zeros(0, np.uint64)

    same = rows.filter("text is not null").select("uid", "rank", F.sha2("text", 256).alias("digest"))
    # Written, so that the join below is between two shuffles that Spark can split where one text is a large part of all rows.
    classes = written(same.groupBy("digest").agg(F.min(F.struct("rank", "uid")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "digests")
    members = same.join(classes, "digest").select("uid", F.col("rank") > F.col("first.rank"), F.col("uid") != F.col("first.uid")).toDF("uid", "later", "other")
    copies = members.filter("other").select("uid", F.lit(_COPY).alias("kind"))
    full = members.filter("later" if search.other_document else "true").select("uid", F.lit(_FULL).alias("kind"))
    lists = copies.union(full).distinct().withColumn("at", F.pmod(F.col("uid"), F.lit(groups)))

    def pack(key: tuple[pa.Scalar, ...], rows_: pa.Table) -> pa.Table:
        return pa.table(_rows([(key[0].as_py(), key[1].as_py(), _blob(rows_["uid"].to_numpy()))]))

    lists = written(lists.groupBy("at", "kind").applyInArrow(pack, _ROWS), "copies")

    marks = common.filter(F.col("kind") == _COMMON).unionByName(lists.filter(F.col("kind") == _COPY))
    contexts = rows.select("at", "uid", "rank", "text").groupBy("at").cogroup(marks.groupBy("at")).applyInArrow(send_contexts(search, buckets, groups, many), _ROWS)
    spans = written(contexts.groupBy("at").applyInArrow(find_spans(search, groups), _ROWS), "spans")
    drop(common)
    release(spark)
    verdicts = spans.unionByName(lists.filter(F.col("kind") == _FULL))
    kind = rows.schema["key"].dataType.simpleString()
    rest_kind = rows.schema["rest"].dataType.simpleString()
    return rows.select("at", "key", "uid", "rank", "text", "rest").groupBy("at").cogroup(verdicts.groupBy("at")).applyInArrow(remove_spans(search), f"key {kind}, text string, rest {rest_kind}, n_tokens long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
