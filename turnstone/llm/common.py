"""What the operators share: slices of bounded size, tables in the shared folder, estimates of size."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _give_back() -> None:
    """Let freed arrays go back to the system: a worker process lives on through many stages, and each leaves its largest step behind otherwise."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD, which otherwise grows with what is freed
    except (OSError, AttributeError):  # another C library: nothing to set
        pass
    pa.set_memory_pool(pa.system_memory_pool())


_give_back()

#: Bytes of text that one step of an Arrow function works on at once.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    jsc = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and jsc.getCheckpointDir().isDefined():
        at = jsc.getCheckpointDir().get()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="turnstone-")
        spark.sparkContext.setCheckpointDir(at)
        at = jsc.getCheckpointDir().get()
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application wrote; a folder that is gone already is no error."""
    _delete(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/turnstone-{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)

    atexit.register(forget)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and a lost executor loses nothing.

    The shuffle files behind it are of no more use; a collection on the driver lets Spark delete them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnstone_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(table: DataFrame) -> None:
    """Delete a table of ``written`` that no later step reads."""
    drop_folder(table.sparkSession, table._turnstone_path)


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of a frame: for file scans, of their files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int, least: int = 64, most: int = 1 << 20) -> int:
    """How many buckets the data of a frame are dealt into so that each holds about ``bytes_each`` of files.

    Beyond ``most`` (2 TB at 2 MB each) buckets grow, to 95 MB of files at 100 TB: more of them would make
    the entries that each block sends to each bucket a number apiece.
    """
    return max(least, min(most, -(-size_of(df) // bytes_each)))


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with at most ``most`` bytes of text each, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total + size > most and i > at:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        yield batch.slice(at)


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, by exact name; further columns, whatever their names, stay out of the way."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
