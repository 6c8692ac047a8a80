"""From entries to the tables of an index: chunks, entities, constraints, steps, evidence, postings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import patterns as P
from turnstone.functions import text as X
from turnstone.operators import evidence as EV
from turnstone.operators import extract as E
from turnstone.operators import postings as I
from turnstone.operators import tools as TL
from turnstone.operators import tree as T
from turnstone.plans.staging import Staging
from turnstone.sources.sessions import Project

TABLES = ("chunks", "entities", "constraints", "trace_steps", "evidence", "postings")
#: Made of the whole tables, for searches.
STATISTICS = ("terms", "corpus")


def _ordered(rows: DataFrame, *by: str) -> DataFrame:
    """``seq`` within a chunk by the given columns, which then go."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*by))).drop(*[c for c in by if c not in ("step_order",)])


def statistics(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Document frequencies of all tokens, and number and mean length of each source's rows."""
    sources = tables["chunks"].select(F.lit("latin").alias("source"), "chunk_id").unionByName(tables["postings"].filter("source = 'cjk'").select("source", "chunk_id").distinct())
    return {"terms": I.document_frequency(tables["postings"]).sortWithinPartitions("source", "token"), "corpus": I.corpus(sources, tables["postings"])}


def by_token(postings: DataFrame) -> DataFrame:
    """Postings in ranges of tokens, in order, so that a search for a word reads the files and row groups that have it. Common words fill ranges of their own."""
    return postings.repartitionByRange("source", "token", "chunk_id").sortWithinPartitions("source", "token", "chunk_id")


def build(entries: DataFrame, project: Project, active_sessions: DataFrame | None = None, own_markers: tuple[str, ...] = ("turnstone",), stage: Callable[[DataFrame, str], DataFrame] = None, full_text: bool = True) -> dict[str, DataFrame]:
    """All tables of an index over the entries, and ``limited``: the sessions beyond the limits on variants and chunks, of which nothing is built.

    ``active_sessions`` (session_id): sessions whose last turn may be open. ``stage(frame, name)`` writes what several tables are made from (by default below the shared folder).
    Without ``full_text`` there are no postings, which only searches read.
    """
    stage = stage or Staging(entries.sparkSession)
    root = F.lit(project.root)
    placed = stage(T.turns(T.ranked_paths(T.leaf_paths(entries)), entries), "placed")
    distinct = stage(T.first_variants(T.variants(placed)), "variants")
    limited = T.variant_limits(distinct)
    distinct = distinct.join(limited, "session_id", "left_anti")
    distinct = distinct.withColumn("chunk_id", T.chunk_id(F.lit(project.project_id), F.col("session_id"), F.col("user_entry_id"), F.col("variant_hash")))
    distinct = stage(distinct, "chunk_ids")
    member = stage(placed.join(distinct.select("chunk_id", "session_id", "leaf_id", "turn_no"), ["session_id", "leaf_id", "turn_no"]), "members")
    message = member.filter("type = 'message'").withColumn("ord", F.col("pos"))
    said, got = message.filter("role = 'assistant'"), message.filter("role = 'toolResult' and tool_call_id <> ''")

    user = message.filter("role = 'user'").groupBy("chunk_id").agg(F.max_by("text", "ord").alias("user"))
    told = T.said(said, "chunk_id")
    calls = said.select("chunk_id", "ord", "entry_id", F.explode("calls").alias("c")).select("chunk_id", "ord", "entry_id", "c.*")
    paired = TL.pair_results(calls, got.select("chunk_id", "ord", "entry_id", "tool_call_id", "text", "is_error"))
    paired = stage(paired, "paired")
    numbers = paired.groupBy("chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tool_call_count"), F.sum("results").cast("int").alias("paired_result_count"))

    found = EV.evidence(member.select("chunk_id", "session_id", "entry_id", "pos", "type", "summary", "custom_type", "content"), own_markers)
    own = found.filter("evidence_scope = 'chunk'").groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("evidence_text"))

    status = F.when(F.col("is_last") & ~F.col("closed") & F.col("_active"), "open").otherwise("complete")
    active = active_sessions.select("session_id").distinct().withColumn("_active", F.lit(True)) if active_sessions is not None else None
    chunks = distinct.join(active, "session_id", "left").withColumn("_active", F.coalesce("_active", F.lit(False))) if active is not None else distinct.withColumn("_active", F.lit(False))
    for part in (user, told, numbers, own):
        chunks = chunks.join(part, "chunk_id", "left")
    # Step by step, so that no text is masked twice.
    for name, source in (("_user", "user"), ("_assistant", "assistant")):
        chunks = chunks.withColumn(name, X.mask_secrets(F.coalesce(source, F.lit(""))))
    chunks = chunks.withColumns({n: X.cut(n, 12_000) for n in ("_user", "_assistant")})
    chunks = chunks.select(
        "chunk_id",
        F.lit(project.project_id).alias("project_id"),
        "session_id",
        "user_entry_id",
        F.col("leaf_id").alias("branch_leaf_id"),
        "variant_hash",
        F.col("user_entry_id").alias("start_entry_id"),
        "end_entry_id",
        "start_ts",
        F.when(F.col("last_ts") != 0, F.col("last_ts")).otherwise(F.col("start_ts")).alias("end_ts"),
        status.alias("status"),
        X.clip("_user", P.MAX_USER_TEXT).alias("user_text"),
        X.clip("_assistant", P.MAX_ASSISTANT_TEXT).alias("assistant_text"),
        F.coalesce("tool_call_count", F.lit(0)).alias("tool_call_count"),
        F.coalesce("paired_result_count", F.lit(0)).alias("paired_result_count"),
        "raw_entry_ids",
        F.coalesce("evidence_text", F.lit("")).alias("evidence_text"),
    )

    def rows(of: DataFrame, phase: int, array) -> DataFrame:
        sub = F.col("sub") if "sub" in of.columns else F.lit(0)
        return of.select("chunk_id", F.col("entry_id").alias("source_entry_id"), F.lit(phase).alias("_phase"), F.col("ord").alias("_ord"), sub.alias("_sub"), F.posexplode(array).alias("_i", "e")).select("chunk_id", "source_entry_id", "_phase", "_ord", "_sub", "_i", "e.*")

    found_in = lambda of: of.withColumns({"_paths": E.find_paths("text"), "_symbols": E.find_symbols("text")})
    fails = F.col("is_error") | F.col("text").rlike("(?i)error|fail|exception")
    none = F.array().cast("array<struct<entity_type: string, value: string, normalized_value: string, context: string, confidence: double>>")
    entities = reduce(
        DataFrame.unionByName,
        [
            rows(found_in(said), 0, F.concat(E.path_entities("_paths", root, 0.55), E.symbol_entities("_symbols", 0.5))),
            rows(found_in(got), 0, F.concat(F.when(fails, E.error_entities("text", 0.85)).otherwise(none), E.path_entities("_paths", root, 0.4), E.symbol_entities("_symbols", 0.35))),
            rows(TL.with_found(paired), 1, TL.call_entities(F.col("tool_name"), F.col("arguments"), root)),
        ],
    )
    entities = entities.withColumn("normalized_value", X.nfc("normalized_value"))
    entities = stage(E.dedupe_entities(_ordered(entities, "_phase", "_ord", "_sub", "_i")), "entities")
    chunks = stage(chunks, "chunks")
    stated = rows(said, 0, E.constraints("text")).withColumn("normalized_text", X.nfc("normalized_text"))
    constraints = E.dedupe_constraints(_ordered(stated, "_phase", "_ord", "_sub", "_i"))

    excluded = rows(said, 0, E.exclusions("text")).select(
        "chunk_id",
        "source_entry_id",
        *[F.lit(None).cast("string").alias(c) for c in ("result_entry_id", "tool_call_id", "tool_name", "arguments_json")],
        F.lit("exclusion").alias("step_type"),
        "target",
        "normalized_target",
        "outcome",
        F.lit("unknown").alias("status"),
        "step_order",
        F.lit(0).alias("_phase"),
        F.col("_ord").alias("_at"),
    )
    steps = TL.trace_steps(paired, root).withColumn("_phase", F.lit(1)).withColumn("_at", F.lit(0))
    steps = _ordered(excluded.unionByName(steps), "_phase", "_at", "step_order")

    found = found.select(F.when(F.col("evidence_scope") == "chunk", F.col("chunk_id")).alias("chunk_id"), "session_id", F.col("entry_id").alias("source_entry_id"), "evidence_type", "evidence_scope", "text", "confidence").distinct()
    return {"chunks": chunks, "entities": entities, "constraints": constraints, "trace_steps": steps, "evidence": found, **({"postings": index_texts(chunks, entities, stage)} if full_text else {}), "limited": limited}


def index_texts(chunks: DataFrame, entities: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Postings of both full-text sources: folded words with stems, and CJK grams."""
    values = entities.groupBy("chunk_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), " ")).alias("names"))
    fields = ("user_text", "assistant_text", "evidence_text")
    texts = chunks.select("chunk_id", *[X.nfc(c).alias(c) for c in fields]).join(values, "chunk_id", "left")
    texts = stage(texts, "texts")  # composed once for both sources
    latin = texts.select("chunk_id", X.latin_fold("user_text").alias("user"), X.latin_fold("assistant_text").alias("assistant"), F.concat_ws(" ", X.latin_fold("evidence_text"), F.coalesce("names", F.lit(""))).alias("evidence"))
    grams = texts.select("chunk_id", F.array_join(X.cjk_grams(*fields), " ").alias("grams"))  # a text without grams gives no postings
    return I.postings(latin, "latin", ["user", "assistant", "evidence"], I.stemmed).unionByName(I.postings(grams, "cjk", ["grams"], I.grams))
