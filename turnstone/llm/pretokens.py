"""Pre-tokens of byte-level BPE, found with array operations over a whole batch.

The rule is the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

applied within each segment; a segment is a text, or what lies between special strings of a text.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from tokenizers.pre_tokenizers import ByteLevel

from turnstone.llm.arrays import span_hashes

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    global _CLASSES
    if _CLASSES is None:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[WHITE_SPACE] = BLANK
        # The library's Unicode tables are newer than Python's: it says itself what the points unknown here are.
        unknown = [c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]
        for kind_of, probe in ((LETTER, "a"), (NUMBER, "1")):
            text = "".join(f"\n{probe}{chr(c)}" for c in unknown)
            whole = {piece[1] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text) if len(piece := text[a:b]) == 2}
            table[[ord(c) for c in whole]] = kind_of
        _CLASSES = table
    return _CLASSES


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each UTF-8 byte belongs to."""
    table = classes()
    ascii_table = np.zeros(256, np.uint8)
    ascii_table[:128] = table[:128]
    out = ascii_table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
        kind = table[point]
        out[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def special_cuts(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments: their offsets, the document of each, and whether a segment is the special string itself."""
    docs = np.arange(len(offsets) - 1)
    raw = data.tobytes()
    found, at = [], raw.find(special)
    while at >= 0:
        d = int(np.searchsorted(offsets, at, "right")) - 1
        if at + len(special) <= offsets[d + 1]:
            found.append(at)
            at = raw.find(special, at + len(special))
        else:
            at = raw.find(special, at + 1)
    if not found:
        return offsets, docs, np.zeros(len(docs), bool)
    starts = np.array(found, np.int64)
    bounds = np.concatenate([offsets[:-1], starts, starts + len(special)])
    is_special = np.concatenate([np.zeros(len(docs), bool), np.ones(len(starts), bool), np.zeros(len(starts), bool)])
    owner = np.concatenate([docs, np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, starts, "right") - 1])
    # At one place an empty segment comes before the special string that starts there.
    order = np.lexsort((np.concatenate([np.zeros(len(docs), int), np.full(len(starts), 2), np.ones(len(starts), int)]), bounds, owner))
    return np.append(bounds[order], offsets[-1]), owner[order], is_special[order]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pre-tokens and the segment of each; a pre-token ends where the next starts (or the data end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = byte_classes(data)
    begins = (data & 0xC0) != 0x80  # first bytes of characters
    edge = np.zeros(n + 1, bool)  # segment borders
    edge[offsets] = True
    run = np.empty(n, bool)  # first byte of a run of one class
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= edge[:n]
    start = run.copy()
    run_at = np.flatnonzero(run)
    run_end = np.append(run_at[1:], n)
    run_kind = kind[run_at]
    blank = np.flatnonzero(run_kind == BLANK)
    if len(blank):
        at, end = run_at[blank], run_end[blank]
        inner = ~edge[end]  # something that isn't white space follows in the segment
        at, end = at[inner], end[inner]
        last = end - 1
        while True:  # to the first byte of the run's last character
            back = ~begins[last]
            if not back.any():
                break
            last[back] -= 1
        start[last] = True
        joined = data[last] == 0x20
        start[end[joined]] = False
    quote = run_at[(data[run_at] == 0x27) & (run_end - run_at == 1)]
    quote = quote[start[quote]]
    if len(quote):
        room = np.searchsorted(offsets, quote, "right")
        room = offsets[room] - quote  # bytes left in the segment
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room >= 2)
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & (room >= 3)
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            after = q + size
            start[after[after < n]] = True
        # What follows a contraction starts anew, but white space that lies there keeps its own starts.
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(offsets, starts, "right") - 1


def with_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, segments and 64-bit hashes of all pre-tokens."""
    starts, segment = pretokens(data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, segment, span_hashes(data, starts, ends)
