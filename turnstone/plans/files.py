"""Small files, folders and pointers on whatever file system a path names, through the one that Spark's tables go to."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Reads, writes, lists and deletes below one folder with Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._at("").getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}" if name else self.folder

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def read(self, name: str) -> str | None:
        """The text of a file; None where there is none."""
        at = self._at(name)
        if not self._system.exists(at):
            return None
        stream = self._system.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file; False where one is there already."""
        try:
            stream = self._system.create(self._at(name), False)
        except Exception as e:
            if self._system.exists(self._at(name)):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str, by: str) -> None:
        """Write a file under the name ``by`` and move it over ``name`` in one step: a reader sees the old text or the new one."""
        self.create(by, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(name).toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(self._system.makeQualified(self._at(by)), self._system.makeQualified(self._at(name)), how)

    def age(self, name: str) -> float | None:
        """Seconds since a file was written; None where there is none."""
        at = self._at(name)
        if not self._system.exists(at):
            return None
        return max(0.0, (self._jvm.System.currentTimeMillis() - self._system.getFileStatus(at).getModificationTime()) / 1000)

    def names(self) -> list[str]:
        """What the folder holds, by name; nothing where there is no folder."""
        at = self._at("")
        return sorted(s.getPath().getName() for s in self._system.listStatus(at)) if self._system.exists(at) else []

    def delete(self, name: str) -> bool:
        """Delete a file or a folder with all it holds; False where there is none."""
        return self._system.delete(self._at(name), True)
