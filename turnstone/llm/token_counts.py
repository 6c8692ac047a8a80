"""Token counts by heap-and-linked-list byte-pair merging.

Pre-tokens are found with array operations; each distinct one is merged once for every worker while it
stays in a cache of fixed size. Only counts leave the operator, never identifiers.

Null text counts as empty: 0 bytes and 0 tokens. Texts of any length are taken whole. Repeated rows give
repeated rows; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.arrays import buffer_of
from turnstone.llm.bpe import HashCache, MergeTable
from turnstone.llm.common import only, sliced
from turnstone.llm.pretokens import special_cuts, with_hashes


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[MergeTable, HashCache]:
    return MergeTable(path), HashCache(21)


def count_tokens(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of an Arrow column. Special strings in a text are one token each."""
    table, cache = _tables(path)
    data, offsets = buffer_of(column)
    if len(table.special) != 1:
        raise ValueError("a vocabulary with one special string is expected")
    cuts, owner, is_special = special_cuts(data, offsets, table.special[0])
    starts, ends, segment, hashes = with_hashes(data, cuts)
    keep = ~is_special[segment]
    starts, ends, segment, hashes = starts[keep], ends[keep], segment[keep], hashes[keep]

    def make(at: np.ndarray) -> list[int]:
        raw, count = memoryview(data), table.count
        return [count(bytes(raw[a:b])) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

    n = len(offsets) - 1
    tokens = np.bincount(owner[segment], weights=cache.look_up(hashes, make), minlength=n).astype(np.int64)
    return np.diff(offsets), tokens + np.bincount(owner[is_special], minlength=n)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every document; ``vocabulary``: path of a byte-level BPE .json file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            n_bytes, n_tokens = count_tokens(batch.column(1), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=[key, "n_bytes", "n_tokens"])

    rows = only(docs, key, text)
    counted = rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
