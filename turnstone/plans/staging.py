"""Tables written once and read by several plans, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnstone-"))
            given = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = given.get()
    return at.rstrip("/")


class Staging:
    """Writes a frame below a folder of its own and reads it again; the folder goes when the application ends, or by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/turnstone-stage-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None and self.spark.sparkContext._jsc is not None:
            at = jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
