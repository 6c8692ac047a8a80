"""What changed since the last build, and whether a build is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(known: DataFrame, listed: DataFrame, key: str = "source_path", mark: str = "fingerprint") -> DataFrame:
    """(key, change): unchanged, added, modified or deleted."""
    a, b = known.select(key, F.col(mark).alias("_was")), listed.select(key, F.col(mark).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_was") == F.col("_is"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def gone(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Keys that are known and were not seen."""
    return known.select(key).join(seen.select(key), key, "left_anti").distinct()


def counts(rows: DataFrame, session: str, place: str) -> DataFrame:
    """One row: entries, sessions and the last place."""
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct(session).alias("sessions"), F.max(place).alias("last_turn"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("unchanged", "added", "modified", "deleted")])


def upsert(rows: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with those of ``new`` in place of rows of their keys; of several new rows of a key the last by ``version``."""
    latest = Window.partitionBy(key).orderBy(F.desc("version"))
    new = new.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    return rows.join(new, key, "left_anti").select(new.columns).unionByName(new)


def orphans(children: DataFrame, parents: DataFrame, child_key: str = "chunk_id", parent_key: str = "chunk_id") -> DataFrame:
    """Rows whose parent doesn't exist."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def without(parents: DataFrame, children: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Parents that have no child."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def of_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is among ``parents``."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def last_id(rows: DataFrame, name: str) -> DataFrame:
    """One row: the greatest id that is taken, 0 before the first."""
    return rows.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("last"))


def numbered(new: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``new`` with ids beyond all that are known, ascending by place; ids grow from build to build and may leave gaps."""
    last = last_id(known, name).first()["last"]
    return new.withColumn(name, F.lit(last) + 1 + F.monotonically_increasing_id())
