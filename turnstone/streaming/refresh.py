"""A stream over a folder of logs that refreshes an index when files arrive.

A file stream sees each path once, and session logs grow in place; so the stream is only the signal, and each
micro-batch refreshes by the manifest, which sees grown files too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from turnstone.plans.index import Index


def follow(index: Index, folder: str, checkpoint: str, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Start the stream; ``available_now``: handle what is there and end."""

    def batch(files: DataFrame, _: int) -> None:
        index.refresh(folder)

    arrivals = index.spark.readStream.format("binaryFile").option("pathGlobFilter", "*.jsonl").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "length")
    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
