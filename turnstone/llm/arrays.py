"""Vectorised kernels over Arrow text columns: no per-row Python, no per-word Python.

Everything here works on one batch of texts at a time: a flat ``uint8`` buffer that holds
the UTF-8 bytes of all texts of the batch, and ``int64`` offsets that cut it into documents.
Null texts are empty texts. Slicing into pieces of bounded size is the caller's business.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (nulls: empty), without a copy where Arrow has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    first = int(offsets[0])
    if data is None or offsets[-1] == first:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[first : int(offsets[-1])], offsets - first


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers that looks random."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random-looking 64-bit value for each byte, so that sums of powers don't see the alphabet's structure.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        np.multiply(out[:take], U64(pow(base, done, 1 << 64)), out=out[done : done + take])
        done += take
    return out


_POWER_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWER_CACHE.get(base)
    if have is None or len(have) < n:
        have = _POWER_CACHE[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions in ``data``) of all words, and the number of words before each document's first."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of about 2^16 bytes stay in the cache; the powers start anew in each
        low = int(starts[at])
        to = max(int(np.searchsorted(starts, low + (1 << 16))), at + 1)
        high = int(ends[to - 1])
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[data[low:high]] * powers(_BASE, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * powers(_INVERSE, high - low)[s] + (e - s).astype(np.uint64) * _MULT
        at = to
    return mix(out)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values (uint64): entry i covers values[i : i + k]; length n - k + 1."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, have, done, base = None, values, 0, 1
    bit = 1
    rest = k
    power = values  # hash of runs of `bit` values
    while rest:
        if rest & 1:
            part = power[done : done + n]
            total = part.copy() if total is None else total * U64(pow(_BASE, bit, 1 << 64)) + part
            done += bit
        rest >>= 1
        if rest:
            m = len(power) - bit
            power = power[:m] * U64(pow(_BASE, bit, 1 << 64)) + power[bit : bit + m]
            bit *= 2
    return mix(total)


def sliding(values: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Least (or greatest) of each run of w values; length n - w + 1, by doubling."""
    f = np.minimum if least else np.maximum
    have, size = values, 1
    while size * 2 <= w:
        have = f(have[:-size], have[size:])
        size *= 2
    if size < w:
        n = len(values) - w + 1
        have = f(have[:n], have[w - size : w - size + n])
    return have


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)
