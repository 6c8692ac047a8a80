"""An index on any file system: generations of Parquet tables, and one pointer to the present one.

A refresh compares the listing with the manifest, builds what changed, keeps the rest, checks that the result is whole and
moves the pointer. Sessions beyond the limits keep their earlier rows. A build can be thrown away and made
again with the same result. Pointer, lock and deletions go through the file system that the tables are on, so all drivers see one
index. A generation holds postings by token, and what a search needs of all of them (lengths are in the postings, document
frequencies and means in tables of their own), so a search reads the postings of its words only.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import manifest as M
from turnstone.plans import build as B
from turnstone.plans import lease as L
from turnstone.plans.files import Files
from turnstone.plans.settings import Settings
from turnstone.plans.staging import Staging
from turnstone.sources import sessions as S

VERSIONS = {"schema_version": "1", "extractor_version": "1", "redaction_version": "1"}
#: Fixed value: how often files that change meanwhile are read.
READS = 3
BY_SESSION = {"chunks": "session_id", "evidence": "session_id"}


class IndexMismatch(RuntimeError):
    """The index belongs to another project, or a build isn't whole."""


@dataclass
class Refresh:
    """What a refresh did."""

    busy: bool = False
    unchanged: int = 0
    added: int = 0
    modified: int = 0
    deleted: int = 0
    rejected: int = 0
    limited: int = 0
    too_large: int = 0
    chunks: int = 0
    seconds: float = 0.0


class Index:
    def __init__(self, spark: SparkSession, path: str, project: S.Project, by_content: bool = False):
        self.spark, self.path, self.project, self.by_content = spark, str(path), project, by_content
        self.files = Files(spark, self.path)
        meta = self.meta()
        if meta:
            for key, own in (("project_id", project.project_id), ("root", project.root)):
                if meta.get(key) != own:
                    raise IndexMismatch(f"the index at {path} has another {key}")
            if any(meta.get(k) != v for k, v in VERSIONS.items()):
                self.clear()

    def meta(self) -> dict:
        return json.loads(self.files.read("current.json") or "{}")

    def tables(self) -> dict[str, DataFrame] | None:
        """The present tables; None before the first build."""
        at = self.meta().get("generation")
        return {t: self.spark.read.parquet(self.files.path(f"{at}/{t}")) for t in (*B.TABLES, *B.STATISTICS, "sessions")} if at else None

    def clear(self) -> list[str]:
        """Delete pointer and generations; the names of what went."""
        gone = [n for n in self.files.names() if n == "current.json" or n.startswith("gen-")]
        for name in sorted(gone):  # the pointer first
            self.files.delete(name)
        return gone

    def rebuild(self, folder: str, active_id: str | None = None) -> Refresh:
        self.clear()
        return self.refresh(folder, active_id)

    def refresh(self, folder: str, active_id: str | None = None) -> Refresh:
        """Bring the index up to the files of the folder."""
        lease = L.acquire(self.files)
        if lease is None:
            return Refresh(busy=True)
        began = time.time()
        try:
            out = self._refresh(folder, active_id)
            # Files that changed while they were read are read again, but for the active session, which goes on changing.
            for _ in range(READS - 1):
                if not self._changed(folder):
                    break
                again = self._refresh(folder, active_id)
                out = replace(again, **{c: getattr(out, c) + getattr(again, c) for c in ("added", "modified", "deleted")})
        finally:
            lease.release()
        out.seconds = time.time() - began
        return out

    def _changed(self, folder: str) -> bool:
        tables = self.tables()
        if tables is None:
            return False
        diff = M.manifest_diff(tables["sessions"], S.list_files(self.spark, folder, self.by_content)).filter("change <> 'unchanged'")
        return not diff.join(tables["sessions"].filter("is_active").select("source_path"), "source_path", "left_anti").isEmpty()

    def _refresh(self, folder: str, active_id: str | None) -> Refresh:
        old = self.tables()
        listed = S.list_files(self.spark, folder, self.by_content)
        if old is None:
            counts = {"added": listed.count(), "unchanged": 0, "modified": 0, "deleted": 0}
        else:
            counts = M.diff_counts(M.manifest_diff(old["sessions"], listed)).first().asDict()
            if not counts["added"] + counts["modified"] + counts["deleted"] and self.meta().get("active") == active_id:
                return Refresh(**counts, chunks=old["chunks"].count())
        sessions, entries = S.read_sessions(self.spark, folder, self.project, active_id, self.by_content)
        if old is not None:
            diff = M.manifest_diff(old["sessions"], listed)
            # A session that is or was active is read again: its last turn's status depends on that.
            stir = old["sessions"].filter("is_active").select("source_path").unionByName(sessions.filter("is_active").select("source_path"))
            changed = diff.filter("change in ('added', 'modified')").select("source_path").unionByName(stir).distinct()
            fresh = sessions.join(changed, "source_path", "left_semi")
            entries = entries.join(fresh.filter("rejected is null").select("session_id"), "session_id", "left_semi")
        stage = Staging(self.spark)
        entries, sessions = stage(entries, "entries"), stage(sessions, "sessions")
        active = sessions.filter("is_active and rejected is null").select("session_id")
        new = B.build(entries, self.project, active, stage=stage)
        generation = f"gen-{uuid.uuid4().hex}"
        at = lambda name: self.files.path(f"{generation}/{name}")
        limited = new.pop("limited").select("session_id")
        over = limited.count()
        sessions.write.parquet(at("sessions"))
        if old is not None:
            # Rows of sessions that still exist and weren't built anew stay; so do those of sessions beyond the limits.
            built = entries.select("session_id").distinct().join(limited, "session_id", "left_anti")
            known = self.spark.read.parquet(at("sessions")).filter("rejected is null").select("session_id")
            kept = old["chunks"].join(known, "session_id", "left_semi").join(built, "session_id", "left_anti").select("session_id", "chunk_id")
            for name in B.TABLES:
                key = BY_SESSION.get(name, "chunk_id")
                new[name] = new[name].unionByName(old[name].join(kept.select(key).distinct(), key, "left_semi").select(new[name].columns))
        try:
            for name in B.TABLES:
                (B.by_token(new[name]) if name == "postings" else new[name]).write.parquet(at(name))
            made = {t: self.spark.read.parquet(at(t)) for t in (*B.TABLES, "sessions")}
            for name, rows in B.statistics(made).items():
                rows.write.parquet(at(name))
            broken = {k: n for k, n in check(made).items() if n}
            if broken:
                raise IndexMismatch(f"the new generation isn't whole: {broken}")
        except Exception:
            self.files.delete(generation)
            raise
        before = self.meta().get("generation")
        out = Refresh(**counts, limited=over, chunks=made["chunks"].count(), **numbers(made["sessions"]))
        pointer = {"generation": generation, "project_id": self.project.project_id, "root": self.project.root, "active": active_id, **VERSIONS, "last": asdict(out)}
        self.files.replace("current.json", json.dumps(pointer), f"current-{uuid.uuid4().hex}")
        stage.drop()
        if before:
            self.files.delete(before)
        return out

    def status(self, settings: Settings | None = None) -> DataFrame:
        """One row: project, settings, whether it's on, the figures of the last refresh, and the rows of all tables."""
        settings = settings or Settings()
        said = {"project_id": self.project.project_id, "root": self.project.root, "index_path": self.path, **asdict(settings)}
        kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
        tables = self.tables() if settings.enabled else None
        out = self.spark.createDataFrame([tuple(float(v) if isinstance(v, int) and c.endswith("days") else v for c, v in said.items())], ", ".join(f"{c} {'double' if c.endswith('days') else kinds[type(v)]}" for c, v in said.items()))
        figures = {**diagnostics(tables["sessions"], self.meta()), "chunks": 0} if tables else dict.fromkeys([*DIAGNOSTICS, "chunks"], 0)
        if tables:
            for name, t in tables.items():
                if name not in B.STATISTICS:
                    figures["chunks" if name == "chunks" else f"{name}_rows"] = t.count()
            figures["indexed_chunks"] = figures["chunks"]
        return out.withColumns({c: F.lit(n).cast("long") for c, n in figures.items()})


#: What a status tells of sessions and refreshes.
DIAGNOSTICS = ("skipped_missing_cwd", "skipped_foreign", "skipped_malformed", "skipped_too_large", "skipped_branch_limit", "dirty_sessions", "indexed_sessions", "indexed_chunks", "skipped_lease_busy", "hard_isolation_errors")


def numbers(sessions: DataFrame) -> dict[str, int]:
    found = {r["rejected"]: r["count"] for r in sessions.groupBy("rejected").count().collect()}  # one row for each reason
    return {"rejected": sum(n for k, n in found.items() if k is not None), "too_large": found.get("too large", 0)}


def diagnostics(sessions: DataFrame, meta: dict) -> dict[str, int]:
    found = {r["rejected"]: r["count"] for r in sessions.groupBy("rejected").count().collect()}
    last = meta.get("last", {})
    out = dict.fromkeys(DIAGNOSTICS, 0)
    out["skipped_missing_cwd"] = sessions.filter("rejected = 'another project' and header_cwd is null").count()
    out["skipped_foreign"] = found.get("another project", 0) - out["skipped_missing_cwd"]
    out["skipped_malformed"] = sum(n for k, n in found.items() if k not in (None, "another project", "too large"))
    out["skipped_too_large"] = found.get("too large", 0)
    out["skipped_branch_limit"] = last.get("limited", 0)
    out["dirty_sessions"] = last.get("added", 0) + last.get("modified", 0)
    out["indexed_sessions"] = found.get(None, 0)
    return out


def has_words():
    """Whether a chunk's own texts hold anything that the full-text index takes for a word."""
    return F.concat_ws(" ", "user_text", "assistant_text", "evidence_text").rlike("[A-Za-z0-9]")


def check(tables: dict[str, DataFrame]) -> dict[str, int]:
    """How many rows break each rule; all noughts in a whole index."""
    chunks = tables["chunks"]
    return {
        "orphan_rows": sum(M.orphans(tables[t].filter("chunk_id is not null"), chunks).count() for t in B.TABLES if t != "chunks"),
        "double_chunks": chunks.groupBy("chunk_id").count().filter("count > 1").count(),
        "chunks_without_session": M.orphans(chunks, tables["sessions"], "session_id", "session_id").count(),
        "chunks_without_postings": M.without(chunks.filter("status = 'complete'").filter(has_words()), tables["postings"].filter("source = 'latin'")).count(),
    }


def index_path(root: str, home: str) -> str:
    """Where a project's index goes: below the project where that can be written to, else below the user's folder by the project's id."""
    own = os.path.join(root, ".turnstone")
    try:
        os.makedirs(own, exist_ok=True)
    except OSError:
        return os.path.join(home, ".turnstone", S.project_of(root).project_id)
    return os.path.join(own, "index") if os.access(own, os.W_OK) else os.path.join(home, ".turnstone", S.project_of(root).project_id)
