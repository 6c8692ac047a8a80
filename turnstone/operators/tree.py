"""Sessions are trees: entries name their parents. Every path from a root to a leaf is one branch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import patterns as P
from turnstone.functions.batches import stretches

#: Fixed value: entries of sessions that are walked at once, if there are several.
MOST_ENTRIES = 16_384


def leaves(entries: DataFrame) -> DataFrame:
    """Entries that no entry of their session names as parent."""
    parents = entries.filter(F.col("parent_id").isNotNull()).select("session_id", F.col("parent_id").alias("entry_id")).distinct()
    return entries.join(parents, ["session_id", "entry_id"], "left_anti")


def leaf_paths(entries: DataFrame) -> DataFrame:
    """session_id, leaf_id, path (root to leaf), path_len, leaf_ts, leaf_ord of every branch.

    A path ends at a parent that doesn't exist, and where it would come back to itself; a pure cycle has no leaf.
    Of entries of one id the last one counts. Sessions are bounded files, and one is walked in one task.
    """

    def walked(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {c: [] for c in ("session_id", "leaf_id", "path", "path_len", "leaf_ts", "leaf_ord")}
        lists = batch.column(1)
        first, begins, flat = lists.offsets[0].as_py(), lists.offsets.to_pylist(), lists.flatten()
        keys, parents, times, places = (flat.field(c).to_pylist() for c in ("entry_id", "parent_id", "ts_ms", "ordinal"))
        for session, a, b in zip(batch.column(0).to_pylist(), begins[:-1], begins[1:], strict=True):
            a, b = a - first, b - first
            parent = dict(zip(keys[a:b], parents[a:b], strict=True))
            named = set(parents[a:b])
            for i in range(a, b):
                if keys[i] in named:
                    continue
                path, seen, at = [], set(), keys[i]
                while at in parent and at not in seen:
                    seen.add(at)
                    path.append(at)
                    at = parent[at]
                for c, v in zip(out, (session, keys[i], path[::-1], len(path), times[i], places[i]), strict=True):
                    out[c].append(v)
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in stretches(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), MOST_ENTRIES):
                yield walked(batch.slice(at, n))

    entry = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "entry_id", "parent_id", F.col("ts_ms").cast("long").alias("ts_ms"))
    rows = entries.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.mapInArrow(walk, "session_id string, leaf_id string, path array<string>, path_len int, leaf_ts long, leaf_ord int")


def ranked_paths(paths: DataFrame, active_leaf: str | None = None) -> DataFrame:
    """Paths with ``path_rank``: the active leaf's, then those that hold it, then the longer, the later, the earlier written."""
    first = [F.desc(F.col("leaf_id") == active_leaf), F.desc(F.array_contains("path", active_leaf))] if active_leaf else []
    order = Window.partitionBy("session_id").orderBy(*first, F.desc("path_len"), F.desc("leaf_ts"), "leaf_ord")
    return paths.withColumn("path_rank", F.row_number().over(order))


def turns(ranked: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each entry of each turn of each path: session_id, leaf_id, path_rank, turn_no, pos and the entry's columns.

    A turn begins at a user's message; what comes before the first belongs to none.
    """
    last = Window.partitionBy("session_id", "entry_id").orderBy(F.desc("ordinal"))
    known = entries.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    placed = ranked.select("session_id", "leaf_id", "path_rank", F.posexplode("path").alias("pos", "entry_id")).join(known, ["session_id", "entry_id"])
    order = Window.partitionBy("session_id", "leaf_id").orderBy("pos")
    is_user = (F.col("type") == "message") & (F.col("role") == "user")
    return placed.withColumn("turn_no", F.sum(F.when(is_user, 1).otherwise(0)).over(order)).filter("turn_no >= 1")


def hash_ids(ids: Column) -> Column:
    return F.substring(F.sha2(F.array_join(ids, "|"), 256), 1, 16)


def chunk_id(project_id: Column, session_id: Column, user_entry_id: Column, variant_hash: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", project_id, session_id, user_entry_id, variant_hash), 256), 1, 32)


def variants(placed: DataFrame) -> DataFrame:
    """One row for each turn of each path, with raw_entry_ids, user_entry_id, variant_hash, end_entry_id, is_last turn and closed."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry_id"))), lambda x: x["entry_id"])
    by_end = lambda c: F.max_by(c, "pos")
    counts = F.col("role").isin("assistant", "toolResult", "user") & (F.col("type") == "message")
    decides = F.when(counts, F.col("pos"))
    made = placed.groupBy("session_id", "leaf_id", "path_rank", "turn_no").agg(
        ids.alias("raw_entry_ids"),
        F.min_by("ts_ms", "pos").alias("start_ts"),
        by_end("ts_ms").alias("last_ts"),
        F.max_by("role", decides).alias("last_role"),
        F.max_by(F.size("calls"), decides).alias("last_calls"),
    )
    last = F.max("turn_no").over(Window.partitionBy("session_id", "leaf_id"))
    made = made.withColumn("user_entry_id", F.element_at("raw_entry_ids", 1)).withColumn("end_entry_id", F.element_at("raw_entry_ids", -1)).withColumn("variant_hash", hash_ids(F.col("raw_entry_ids")))
    closed = F.coalesce((F.col("last_role") == "toolResult") | ((F.col("last_role") == "assistant") & (F.col("last_calls") == 0)), F.lit(False))
    return made.withColumn("is_last", F.col("turn_no") == last).withColumn("closed", closed).drop("last_role", "last_calls")


def first_variants(made: DataFrame) -> DataFrame:
    """Of turns with the same entries on several paths that of the first path."""
    order = Window.partitionBy("session_id", "user_entry_id", "variant_hash").orderBy("path_rank", "turn_no")
    return made.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def variant_limits(distinct: DataFrame, per_user: int = P.MAX_VARIANTS, per_session: int = P.MAX_CHUNKS) -> DataFrame:
    """Sessions beyond a limit: none of their chunks may be built, and an earlier build of them stays."""
    users = distinct.groupBy("session_id", "user_entry_id").agg(F.count(F.lit(1)).alias("n"))
    found = users.groupBy("session_id").agg(
        F.sum("n").alias("chunk_count"),
        F.max("n").alias("most_variants"),
        F.array_sort(F.collect_list(F.when(F.col("n") > per_user, F.col("user_entry_id")))).alias("limited_user_entry_ids"),
    )
    return found.withColumn("variant_limit_hit", F.col("most_variants") > per_user).withColumn("chunk_limit_hit", F.col("chunk_count") > per_session).filter("variant_limit_hit or chunk_limit_hit")


def said(messages: DataFrame, within: str, place: str = "ord", name: str = "assistant") -> DataFrame:
    """(within, name): the texts of each group, in order, a line each; blank ones are left out."""
    told = messages.filter("text <> ''").groupBy(within)
    return told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "text"))), lambda x: x["text"]), "\n").alias(name))
