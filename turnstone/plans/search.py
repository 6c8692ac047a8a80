"""Search: one plan for one query or for many, keyed by ``qid``.

Queries are a table of the caller's; whether it's broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import patterns as P
from turnstone.functions import text as X
from turnstone.operators import postings as I
from turnstone.operators import ranking as R
from turnstone.plans import build as B
from turnstone.plans.staging import Staging

#: How many results, and the least scores.
DEFAULT_RESULTS, MOST_RESULTS, MIN_RELEVANCE, MIN_CONFIDENCE = 5, 20, 40, 30


@dataclass(frozen=True)
class Options:
    now_ms: int
    max_results: int = DEFAULT_RESULTS
    min_relevance: int = MIN_RELEVANCE
    min_confidence: int = MIN_CONFIDENCE
    exclude_open: bool = True
    exclude_session: str | None = None
    group_siblings: bool = True
    high_days: float = 7
    medium_days: float = 30
    stem: bool = field(default=True)

    @property
    def most(self) -> int:
        return min(MOST_RESULTS, max(1, self.max_results))


def _fold(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_./:@+-]+", " ", text).strip().lower()


def query_words(text: str) -> list[str]:
    return [t for t in _fold(text).split(" ") if len(t) >= 2][: P.MAX_QUERY_TOKENS]


def query_entities(text: str) -> dict[str, list[str]]:
    """Paths, symbols and words of a query, in lower case."""
    text = unicodedata.normalize("NFC", text)[: P.MAX_QUERY_CHARS]
    symbols = [(a or b).strip().lower() for a, b in re.findall(P.QUERY_SYMBOL, text, re.ASCII)]
    return {"paths": [m.lower() for m in re.findall(P.QUERY_PATH, text, re.ASCII)], "symbols": [s for s in symbols if s], "terms": query_words(text)}


def query_terms(text: str) -> list[tuple[str, int, str]]:
    """(source, phrase_no, term) of a query: words for the Latin index, grams for the CJK one, without operators."""
    text = unicodedata.normalize("NFC", text).strip()[: P.MAX_QUERY_CHARS]
    grams: dict[str, None] = {}
    cjk = "[぀-ヿ㐀-䶿一-鿿豈-﫿]+"
    for span in re.findall(cjk, text):
        if len(span) == 1:
            grams[span] = None
        for i in range(len(span) - 1):
            grams[span[i : i + 2]] = None
            if i + 2 < len(span):
                grams[span[i : i + 3]] = None
    out = []
    for source, terms in (("latin", query_words(text)), ("cjk", list(grams)[: P.MAX_QUERY_TOKENS])):
        clean = [re.sub(r'["*^():]', "", t).strip()[:64] for t in terms]
        out += [(source, i, t) for i, t in enumerate(clean) if t]
    return out


def query_tables(spark: SparkSession, queries: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(qid, paths, symbols, terms) and (qid, source, phrase_no, term) of queries by id: as many rows as the caller gave."""
    parts = [(q, *query_entities(t).values()) for q, t in queries.items()]
    terms = [(q, *x) for q, t in queries.items() for x in query_terms(t)]
    return (
        spark.createDataFrame(parts, "qid string, paths array<string>, symbols array<string>, terms array<string>"),
        spark.createDataFrame(terms, "qid string, source string, phrase_no int, term string"),
    )


def full_text(index: dict[str, DataFrame], terms: DataFrame, most: int = P.FTS_LIMIT, stage: Staging | None = None) -> DataFrame:
    """(qid, source, chunk_id, score, rank) of the best hits in both sources; none for an index without its full-text tables."""
    if "postings" not in index:
        return terms.sparkSession.createDataFrame([], "qid string, source string, chunk_id string, score double, rank int")
    latin = I.phrases(terms.filter("source = 'latin'"), I.stemmed)
    wanted = latin.unionByName(I.phrases(terms.filter("source = 'cjk'"), I.grams))
    stored = index if "terms" in index else index | B.statistics(index)
    order = index["chunks"].select("chunk_id", F.concat_ws(" ", F.lpad(F.col("start_ts").cast("string"), 20, "0"), "chunk_id").alias("doc_seq"))
    return I.best(I.bm25(index["postings"], wanted, stored["corpus"], stored["terms"], stage or Staging(terms.sparkSession)), order, most)


def search(index: dict[str, DataFrame], queries: dict[str, str], options: Options, project_id: str) -> DataFrame:
    """Ranked chunks of the project for each query, with what a reader wants to see of them.

    Full-text hits, candidates and results are each a few dozen rows a query; they are written as they're found, so that features and
    details are made of the chunks in question only, not of all.
    """
    spark = index["chunks"].sparkSession
    index = index | {"chunks": index["chunks"].filter(F.col("project_id") == project_id)}
    parts, terms = query_tables(spark, queries)
    work, kept = Staging(spark), Staging(spark)
    fts = work(full_text(index, terms, stage=work), "hits")
    tried = {n: [w for t in queries.values() for w in query_entities(t)[n]] for n in ("paths", "symbols", "terms")}
    tried["terms"] = [t for t in tried["terms"] if len(t) >= 3]
    found = work(R.candidates(fts, parts, index["entities"], index["constraints"], index["trace_steps"], tried), "candidates")
    ranks = fts.groupBy("qid", "chunk_id").agg(*[F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank") for s in ("latin", "cjk")])
    in_question = found.select("chunk_id").distinct()
    of = lambda name: index[name].join(in_question, "chunk_id", "left_semi")
    chunks = of("chunks")
    if options.exclude_open:
        chunks = chunks.filter("status <> 'open'")
    if options.exclude_session:
        chunks = chunks.filter(F.col("session_id") != options.exclude_session)
    pairs = found.join(parts, "qid")
    steps = of("trace_steps")
    constraints = of("constraints").groupBy("chunk_id").agg(F.least(F.lit(12), F.count(F.lit(1))).alias("constraint_count"))
    rows = (
        found.join(chunks, "chunk_id")
        .join(ranks, ["qid", "chunk_id"], "left")
        .join(R.entity_hits(pairs, index["entities"]), ["qid", "chunk_id"], "left")
        .join(R.trace_hits(pairs, steps), ["qid", "chunk_id"], "left")
        .join(constraints, "chunk_id", "left")
        .join(R.step_features(steps), "chunk_id", "left")
        .na.fill(0, ["latin_rank", "cjk_rank", "entity_hits", "trace_hits", "constraint_count", "error_count"])
        .na.fill(False, ["has_verification", "has_terminal_write", "success_after_error"])
    )
    c = F.col
    scored = rows.select(
        "qid",
        "chunk_id",
        "session_id",
        "user_entry_id",
        "end_ts",
        R.relevance(c("latin_rank"), c("cjk_rank"), c("entity_hits"), c("constraint_count"), c("trace_hits")).alias("relevance"),
        R.confidence(
            c("tool_call_count"), c("paired_result_count"), (c("entity_hits") > 0) & (c("trace_hits") > 0), c("has_terminal_write"), c("constraint_count"), c("status") == "open", c("error_count"), c("success_after_error")
        ).alias("confidence"),
        R.freshness(c("end_ts"), options.now_ms, options.high_days, options.medium_days).alias("freshness"),
        X.clip("user_text", 400).alias("user_text"),
        X.clip("assistant_text", 300).alias("assistant_snippet"),
        "error_count",
        "has_verification",
    )
    scored = work(R.good_enough(scored, options.min_relevance, options.min_confidence), "scored")
    anchors = index["chunks"].join(scored.select("session_id", "user_entry_id").distinct(), ["session_id", "user_entry_id"], "left_semi")
    scored = scored.join(R.siblings(anchors), "chunk_id", "left")
    top = R.collapse(scored, options.most) if options.group_siblings else R.first(scored, options.most, "qid", *R.result_order())
    top = kept(top, "results")
    work.drop()
    shown = top.select("chunk_id").distinct()
    parts_of = {name: index[name].join(shown, "chunk_id", "left_semi") for name in ("entities", "constraints", "trace_steps")}
    return with_details(top, parts_of).orderBy("qid", "place")


def first_values(rows: DataFrame, value, name: str, most: int = 12) -> DataFrame:
    """The first values of each chunk by ``seq``: at most ``most``."""
    from pyspark.sql import Window

    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("seq"))).filter(F.col("_r") <= most)
    return near.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value.alias("v")))), lambda x: x["v"]).alias(name))


def with_details(top: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Files, symbols, constraints and exclusions of the chunks that are shown: the first twelve of each, then once each."""
    c = F.col
    said = lambda column: F.struct(X.clip(column, 200).alias("text"), c("source_entry_id"))
    parts = [
        first_values(index["entities"].filter("entity_type = 'file_path'"), c("value"), "files"),
        first_values(index["entities"].filter("entity_type in ('symbol', 'module')"), c("value"), "symbols"),
        first_values(index["constraints"], said("text"), "constraints"),
        first_values(index["trace_steps"].filter("step_type = 'exclusion'"), said("target"), "exclusions"),
    ]
    for p in parts:
        top = top.join(p, "chunk_id", "left")
    return top.withColumn("files", F.array_distinct("files")).withColumn("symbols", F.array_distinct("symbols"))


def chunk_detail(index: dict[str, DataFrame], chunk_id: str, project_id: str) -> DataFrame:
    """One chunk of the project with its session's file, entities (surest first), constraints, steps (in order) and evidence."""
    one = index["chunks"].filter((F.col("chunk_id") == chunk_id) & (F.col("project_id") == project_id))
    if "sessions" in index:
        one = one.join(index["sessions"].filter("rejected is null").select("session_id", "source_path"), "session_id", "left")
    part = lambda name, order, cols: index[name].filter(F.col("chunk_id") == chunk_id).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias(name))
    one = one.join(part("entities", [(-F.col("confidence")).alias("by"), "seq"], ["entity_type", "value", "normalized_value", "context", "confidence", "source_entry_id"]), "chunk_id", "left")
    one = one.join(part("constraints", ["seq"], ["text", "trigger_word", "confidence", "source_entry_id"]), "chunk_id", "left")
    one = one.join(part("trace_steps", ["step_order", "seq"], ["step_type", "target", "outcome", "status", "tool_name", "tool_call_id", "arguments_json", "source_entry_id", "result_entry_id"]), "chunk_id", "left")
    return one.join(part("evidence", ["source_entry_id"], ["evidence_type", "evidence_scope", "text", "confidence"]), "chunk_id", "left")


def _shortened(text: str | None, most: int) -> str:
    text = text or ""
    return text if len(text) <= most else text[:most] + "…"


#: How much of a chunk is shown.
SHOWN_USER, SHOWN_ASSISTANT, SHOWN_OUTCOME, SHOWN_ENTITIES = 2000, 3000, 180, 30


def render_detail(chunk) -> str:
    """One chunk (a row of ``chunk_detail``) as text for a reader, without the paths of files."""
    steps = []
    for i, s in enumerate(chunk["trace_steps"] or [], 1):
        outcome = _shortened(s["outcome"], SHOWN_OUTCOME).replace("\n", " ")
        steps.append(f"  {i}. [{s['step_type']}/{s['status']}] {s['target']}" + (f" → {outcome}" if outcome else ""))
    parts = {
        "user": [_shortened(chunk["user_text"], SHOWN_USER)],
        "assistant": [_shortened(chunk["assistant_text"], SHOWN_ASSISTANT)],
        "steps": steps,
        "entities": [f"  {e['entity_type']}: {e['value']}" for e in (chunk["entities"] or [])[:SHOWN_ENTITIES]],
        "constraints": [f"  ({c['trigger_word']}) {c['text']}" for c in chunk["constraints"] or []],
    }
    head = f"chunk {chunk['chunk_id']}, {chunk['status']}, {chunk['tool_call_count']} calls, {chunk['paired_result_count']} with results"
    said = [f"{name}:\n" + ("\n".join(lines) or "  none") for name, lines in parts.items()]
    return "\n\n".join([head, *said, "Hold this against the present code: history tells what was, not what is."])


def render(rows: list) -> str:
    """Results as text for a reader: as many as a search returns."""
    if not rows:
        return "No related history found."
    out = []
    for r in rows:
        out.append(f"{r['place']}. [{r['chunk_id']}] relevance {r['relevance']} · confidence {r['confidence']} · freshness {r['freshness']}")
        out.append(f"   user: {r['user_text']}")
        if r["assistant_snippet"]:
            out.append(f"   assistant: {r['assistant_snippet']}")
        for name, most in (("files", 8), ("symbols", 8)):
            if r[name]:
                out.append(f"   {name}: {', '.join(r[name][:most])}")
        for name, most in (("constraints", 3), ("exclusions", 3)):
            out += [f"   {name[:-1]}: {x['text']} ({x['source_entry_id']})" for x in (r[name] or [])[:most]]
        if r["sibling_ids"]:
            out.append(f"   siblings: {', '.join(r['sibling_ids'][:4])}")
    return "\n".join(out)
