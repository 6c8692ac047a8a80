"""Two-pass external shuffle into shards of equal numbers of rows.

First pass: every record goes to one of many buckets by a seeded hash of its key and of its place in the
input, so copies of one record or one key spread like all others. A bucket fits into memory. Second
pass: each bucket is put into a fixed order, shuffled by Fisher-Yates with a generator seeded by the
bucket's number, and written. The buckets, one behind the other, are one random order of all
records; shard s is the s-th part of it, and parts differ by one row at most.

The input must be a table that gives the same rows each time it's read, as files do; the counts of what
was written are held against those of the first pass. Null keys and texts are kept as they are, repeated rows
stay repeated, an empty table gives no rows; other columns of the input are left out. Rows of one key are told apart by their place. A very long text
is a row like any other: it makes its bucket larger, not its shard shorter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import buckets_for, new_folder, only

#: Bytes of input files that one bucket takes.
BUCKET_BYTES = 8 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n)."""
    order = list(range(n))
    picks = rng.integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shard(docs: DataFrame, shards: int = 16, seed: int = 17, key: str = "doc_id", text: str = "text", path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the records into ``path``/shard=s and return the table: key, text, slot, shard.

    Slots are gapless from 0 in each shard and give the shuffled order; files hold rows in that order.
    """
    spark = docs.sparkSession
    n_buckets = buckets_for(docs, bucket_bytes, most=1 << 22)
    rows = only(docs, key, text).withColumn("_place", F.monotonically_increasing_id())
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col("_place")), F.lit(n_buckets)).cast("int"))
    counts = np.zeros(n_buckets, np.int64)
    for r in rows.groupBy("_bucket").count().collect():  # one number for each bucket: at most 2^22
        counts[r["_bucket"]] = r["count"]
    total = int(counts.sum())
    bases = np.cumsum(counts) - counts
    least, more = divmod(total, shards)
    starts = np.arange(shards, dtype=np.int64) * least + np.minimum(np.arange(shards), more)

    def shuffle(keys: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        b = keys[0].as_py()
        bucket = bucket.sort_by("_place")
        bucket = bucket.take(pa.array(fisher_yates(bucket.num_rows, np.random.default_rng([seed, b]))))
        rank = int(bases[b]) + np.arange(bucket.num_rows)
        at = np.searchsorted(starts, rank, "right") - 1
        return pa.table({key: bucket[key], text: bucket[text], "slot": rank - starts[at], "shard": at.astype(np.int32)})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, text))
    path = path or new_folder(spark, "shards")
    out = rows.groupBy("_bucket").applyInArrow(shuffle, f"{kinds}, slot long, shard int").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    table = spark.read.schema(out.schema).parquet(path)
    found = {r["shard"]: (r["n"], r["top"]) for r in table.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top")).collect()}
    for s in range(shards):
        size = least + (s < more)
        if found.get(s, (0, -1)) != (size, size - 1):
            raise RuntimeError(f"shard {s} has {found.get(s)} for {size} rows: the input changed between the two passes")
    return table
