"""Session logs as tables: JSON Lines files of one project, and a table of conversations.

Files are read whole (``binaryFile``), so path, size, time and content come from one listing. A file whose header names
another project, has no id or comes behind entries is left out as a whole. Lines that aren't JSON objects, or
have no id, are counted; a last line without its line feed is still being written and is left out.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: files larger than this aren't read.
MAX_FILE_BYTES = 50 << 20

CALL = "array<struct<sub: int, tool_call_id: string, tool_name: string, arguments: map<string,string>>>"


@dataclass(frozen=True)
class Project:
    project_id: str
    root: str


def project_of(folder: str) -> Project:
    """A project by its real path in composed form; a path that doesn't exist stays as it is."""
    real = os.path.realpath(folder) if os.path.exists(folder) else folder
    root = unicodedata.normalize("NFC", real)
    return Project(hashlib.sha256(root.encode()).hexdigest(), root)


def folder_name(root: str) -> str:
    """The folder that holds a project's logs, by name: a hint only, different roots may share one."""
    return "--" + re.sub(r"[/\\:]", "-", re.sub(r"^[/\\]", "", root)) + "--"


def session_id_of(path: Column) -> Column:
    return F.regexp_extract(path, r"_([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.jsonl$", 1)


def is_active(path: Column, active_id: str | None) -> Column:
    return F.contains(path, F.lit(active_id)) if active_id else F.lit(False)


def fingerprint(path: Column, mtime_ns: Column, size: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, mtime_ns.cast("string"), size.cast("string")), 256)


def list_files(spark: SparkSession, folder: str, by_content: bool = False) -> DataFrame:
    """source_path, mtime_ns, size_bytes, fingerprint of the .jsonl files of a folder; a missing folder has none.

    Fingerprints are of path, time and size, so a listing reads no file. ``by_content`` reads them all, and sees a file
    that was replaced by another of the same size and time.
    """
    return _files(spark, folder, by_content).drop("content")


def _files(spark: SparkSession, folder: str, by_content: bool = False) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], "source_path string, mtime_ns string, size_bytes bigint, fingerprint string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    mtime = (F.unix_micros("modificationTime") * 1000).cast("string")
    mark = fingerprint(F.col("path"), mtime, F.col("length"))
    if by_content:
        mark = F.sha2(F.concat_ws("|", mark, F.sha2("content", 256)), 256)
    return files.select(F.col("path").alias("source_path"), mtime.alias("mtime_ns"), F.col("length").alias("size_bytes"), mark.alias("fingerprint"), "content")


def _text(value: str) -> Column:
    """Visible text of a message: a string as it is; of parts those of type text, toolResult and image."""
    parts = F.try_variant_get(F.col(value), "$.message.content", "array<variant>")
    kinds = lambda p: F.try_variant_get(p, "$.type", "string").isin("text", "toolResult", "image") & (F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING")
    joined = F.array_join(F.transform(F.filter(parts, kinds), lambda p: F.try_variant_get(p, "$.text", "string")), "\n")
    # A user's message without visible text is what its text parts say, whatever their kind of value.
    told = F.array_join(F.transform(F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "\n")
    joined = F.when((joined == "") & (F.try_variant_get(F.col(value), "$.message.role", "string") == "user"), told).otherwise(joined)
    content = F.try_variant_get(F.col(value), "$.message.content", "variant")
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(F.col(value), "$.message.content", "string")).otherwise(F.coalesce(joined, F.lit("")))


def _calls(value: str) -> Column:
    parts = F.coalesce(F.try_variant_get(F.col(value), "$.message.content", "array<variant>"), F.array().cast("array<variant>"))

    def strings(p: Column) -> Column:
        given = F.map_filter(F.try_variant_get(p, "$.arguments", "map<string,variant>"), lambda _, v: F.schema_of_variant(v) == "STRING")
        return F.coalesce(F.transform_values(given, lambda _, v: v.cast("string")), F.create_map().cast("map<string,string>"))

    every = F.transform(
        parts,
        lambda p, i: F.struct(i.cast("int").alias("sub"), F.try_variant_get(p, "$.id", "string").alias("tool_call_id"), F.try_variant_get(p, "$.name", "string").alias("tool_name"), strings(p).alias("arguments"), F.try_variant_get(p, "$.type", "string").alias("type")),
    )
    calls = F.filter(every, lambda c: (c["type"] == "toolCall") & (c["tool_call_id"] != "") & (c["tool_name"] != ""))
    return F.transform(calls, lambda c: F.struct(c["sub"], c["tool_call_id"], c["tool_name"], c["arguments"]))


def lines(files: DataFrame) -> DataFrame:
    """One row for each whole line that isn't blank: its place, its JSON value (null: none) and whether the file ended within a line."""
    text = F.decode("content", "UTF-8")
    cut = F.split(text, "\n")
    partial = ~F.endswith(text, F.lit("\n")) & (F.length(text) > 0)
    whole = F.when(F.endswith(text, F.lit("\n")) | partial, F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    rows = files.filter(F.col("size_bytes") <= MAX_FILE_BYTES).select("source_path", "mtime_ns", "size_bytes", "fingerprint", partial.alias("incomplete_trailing"), F.posexplode(whole).alias("line_no", "line"))
    return rows.filter(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).drop("line")


def read_sessions(spark: SparkSession, folder: str, project: Project, active_id: str | None = None, by_content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions, entries) of the files of a folder that belong to the project."""
    return sessions_of(_files(spark, folder, by_content), project, active_id)


def sessions_of(files: DataFrame, project: Project, active_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of files given as rows: source_path, mtime_ns, size_bytes, fingerprint, content."""
    rows = lines(files)
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    kind, key = F.try_variant_get("v", "$.type", "string"), F.try_variant_get("v", "$.id", "string")
    key = F.when(F.schema_of_variant(F.try_variant_get("v", "$.id", "variant")) == "STRING", key)
    rows = rows.select("*", is_object.alias("ok"), F.when(is_object, kind).alias("kind"), F.when(is_object, key).alias("key"))
    header = F.col("kind") == "session"
    entry = F.col("ok") & ~F.coalesce(header, F.lit(False))
    valid = entry & (F.col("key") != "")
    custom = valid & F.col("kind").isin("custom", "custom_message") & F.try_variant_get("v", "$.customType", "string").isNotNull() & F.try_variant_get("v", "$.data.source", "string").isNotNull()
    cwd = F.try_variant_get("v", "$.cwd", "string")
    gate = rows.groupBy("source_path").agg(
        F.bool_or("incomplete_trailing").alias("partial"),
        F.min_by("key", F.when(header, F.col("line_no"))).alias("session_id"),
        F.min_by(cwd, F.when(header, F.col("line_no"))).alias("header_cwd"),
        F.min_by(F.try_variant_get("v", "$.version", "int"), F.when(header, F.col("line_no"))).alias("format_version"),
        F.min(F.when(header, F.col("line_no"))).alias("header_line"),
        F.min(F.when(entry, F.col("line_no"))).alias("entry_line"),
        F.bool_and(F.when(header, F.coalesce(cwd == project.root, F.lit(False)))).alias("own"),
        F.count_if(~F.col("ok") | (entry & ~F.coalesce(F.col("key") != "", F.lit(False)))).alias("malformed"),
        F.bool_or(F.col("v").isNull()).alias("unparsed"),
        F.count_if(valid).alias("entries"),
        F.min_by(F.concat_ws(":", F.try_variant_get("v", "$.customType", "string"), F.try_variant_get("v", "$.data.source", "string")), F.when(custom, F.col("line_no"))).alias("source_identity"),
    )
    # Files without a line, and those too large to be read, are sessions that are left out, not unknown ones.
    gate = files.drop("content").join(gate, "source_path", "left").na.fill(False, ["partial", "unparsed"]).na.fill(0, ["malformed", "entries"])
    reason = (
        F.when(F.col("size_bytes") > MAX_FILE_BYTES, "too large")
        .when(F.col("header_line").isNull(), "no header")
        .when(F.col("entry_line") < F.col("header_line"), "entries before the header")
        .when(~F.coalesce(F.col("own"), F.lit(False)), "another project")
        .when(F.coalesce(F.col("session_id") == "", F.lit(True)), "no session id")
        .when((F.col("malformed") > 0) & (F.col("entries") == 0), "nothing but malformed lines")
    )
    sessions = gate.select(
        "session_id",
        "source_path",
        "header_cwd",
        "format_version",
        "mtime_ns",
        "size_bytes",
        "fingerprint",
        "source_identity",
        is_active(F.col("source_path"), active_id).alias("is_active"),
        (F.col("partial") | F.col("unparsed")).alias("incomplete_trailing"),
        "malformed",
        reason.alias("rejected"),
    )
    # Two files of one session: the later one stands.
    latest = Window.partitionBy("session_id").orderBy(F.col("mtime_ns").cast("decimal(38,0)").desc(), "source_path")
    kept = sessions.filter("rejected is null").withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    at = F.try_variant_get("v", "$.timestamp", "string")
    result_id = F.coalesce(F.try_variant_get("v", "$.message.toolCallId", "string"), F.try_element_at(F.filter(F.transform(F.try_variant_get("v", "$.message.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.toolCallId", "string")), lambda x: x.isNotNull()), F.lit(1)))
    content = F.try_variant_get("v", "$.content", "variant")
    entries = (
        rows.filter(valid)
        .join(kept.select("session_id", "source_path"), "source_path")
        .select(
            "session_id",
            F.col("line_no").alias("ordinal"),
            F.col("key").alias("entry_id"),
            F.try_variant_get("v", "$.parentId", "string").alias("parent_id"),
            F.col("kind").alias("type"),
            F.coalesce(F.unix_millis(F.try_to_timestamp(at)), F.lit(0).cast("long")).alias("ts_ms"),
            F.when(F.col("kind") == "message", F.try_variant_get("v", "$.message.role", "string")).alias("role"),
            F.when(F.col("kind") == "message", _text("v")).alias("text"),
            F.when(F.try_variant_get("v", "$.message.role", "string") == "assistant", _calls("v")).otherwise(F.array().cast(CALL)).alias("calls"),
            result_id.alias("tool_call_id"),
            F.coalesce(F.try_variant_get("v", "$.message.isError", "boolean"), F.lit(False)).alias("is_error"),
            F.when(F.col("kind") == "compaction", F.coalesce(F.try_variant_get("v", "$.summary", "string"), F.substring(F.to_json("v"), 1, 2000))).otherwise(F.try_variant_get("v", "$.summary", "string")).alias("summary"),
            F.try_variant_get("v", "$.customType", "string").alias("custom_type"),
            F.when(F.schema_of_variant(content) == "STRING", content.cast("string")).alias("content"),
        )
    )
    return sessions, entries


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as entries: each turn follows the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("int").alias("ordinal"),
        name(F.col("turn")).alias("entry_id"),
        F.when(F.lag("turn").over(order).isNotNull(), name(F.lag("turn").over(order))).alias("parent_id"),
        F.lit("message").alias("type"),
        (F.col("turn") * 1000).cast("long").alias("ts_ms"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.array().cast(CALL).alias("calls"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.lit(False).alias("is_error"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("custom_type"),
        F.lit(None).cast("string").alias("content"),
    )
