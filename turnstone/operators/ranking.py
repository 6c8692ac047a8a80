"""Candidates, features, the three scores, and groups of siblings. Everything is keyed by a query's ``qid``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import patterns as P

#: Weights of the sources in reciprocal rank fusion, and its constant.
WEIGHTS = {"latin": 1.0, "cjk": 1.0, "entity": 1.4, "constraint": 1.1, "trace": 1.2}
RRF_K = 60


def some(values: Column, test) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), test)


def _limited(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("qid", "pattern").orderBy("chunk_id")
    return found.select("qid", "pattern", "chunk_id").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select("qid", "chunk_id")


#: Characters of the grams by which patterns find values.
GRAM = 3


#: Patterns that are looked for in each value before its grams are made.
MOST_TRIED = 1000


def contained(rows: DataFrame, value: str, patterns: DataFrame, most: int, tried: list[str] | None = None) -> DataFrame:
    """(qid, chunk_id): for each pattern (qid, pattern) up to ``most`` chunks with a value that holds it, the least ids first.

    A pattern meets the values that hold its first gram (three characters, or as many as it has), by a join on that gram,
    and is then looked for. Values are taken once each, however many rows have them. An empty pattern asks for nothing.
    Patterns are what queries ask for and go to every executor. Spark must not choose the side: it takes values with their
    grams for as small as the values alone, where each stands as often as it has grams. ``rows`` are read twice.
    ``tried``: all patterns, where the caller knows them; values that hold none of them need no grams while they are few.
    """
    distinct = rows.select(F.col(value).alias("_v")).filter("_v <> ''").distinct()
    asked = patterns.select("pattern").filter("pattern <> ''").distinct().withColumn("_g", F.substring("pattern", 1, GRAM))
    if tried is not None and len(set(tried)) <= MOST_TRIED:
        distinct = distinct.filter(F.exists(F.lit(sorted(set(tried)) or [""]), lambda p: (p != "") & F.contains(F.col("_v"), p)))
    places = F.sequence(F.lit(1), F.char_length("_v"))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("_v"), i, n)))))
    found = distinct.withColumn("_g", F.explode(grams)).join(F.broadcast(asked), "_g").filter(F.contains("_v", "pattern")).select("pattern", "_v")
    pairs = found.join(rows.select("chunk_id", F.col(value).alias("_v")), "_v").select("pattern", "chunk_id").distinct()
    return _limited(pairs.join(patterns, "pattern"), most)


def candidates(fts: DataFrame, queries: DataFrame, entities: DataFrame, constraints: DataFrame, steps: DataFrame, tried: dict[str, list[str]] | None = None) -> DataFrame:
    """(qid, chunk_id) of full-text hits, and of chunks whose entities, constraints or steps hold a part of the query.

    ``tried``: all paths, symbols and terms of the queries by name, where the caller knows them.
    """
    known = lambda *names: [w for n in names for w in tried[n]] if tried is not None else None
    of = lambda values: queries.select("qid", F.explode(values).alias("pattern"))
    long = F.filter("terms", lambda t: F.char_length(t) >= 3)
    found = fts.select("qid", "chunk_id")
    found = found.unionByName(contained(entities, "normalized_value", of(F.concat("paths", "symbols")), P.ENTITY_LIMIT, known("paths", "symbols")))
    found = found.unionByName(contained(constraints, "normalized_text", of(long), P.CONSTRAINT_LIMIT, known("terms")))
    return found.unionByName(contained(steps, "normalized_target", of(F.col("paths")), P.TRACE_LIMIT, known("paths"))).distinct()


def step_features(steps: DataFrame) -> DataFrame:
    """Per chunk: error_count, has_verification, has_terminal_write, success_after_error."""
    kind = F.col("step_type")
    made = steps.groupBy("chunk_id").agg(
        F.count_if(kind == "error").alias("error_count"),
        F.bool_or(kind == "verification").alias("has_verification"),
        F.bool_or(kind.isin("edit", "write", "verification")).alias("has_terminal_write"),
        F.bool_or((kind == "verification") & (F.col("status") == "success")).alias("_verified"),
    )
    return made.withColumn("success_after_error", (F.col("error_count") > 0) & F.col("_verified")).drop("_verified")


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def entity_hits(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, chunk_id, entity_hits): paths count 1 (either way round), symbols 1, each term of three characters or more one half."""
    value = F.col("normalized_value")
    points = (
        F.when(some(F.col("paths"), lambda p: F.contains(value, p) | F.contains(p, value)), 1.0).otherwise(0.0)
        + F.when(some(F.col("symbols"), lambda s: F.contains(value, s)), 1.0).otherwise(0.0)
        + 0.5 * F.size(F.filter("terms", lambda t: (F.char_length(t) >= 3) & F.contains(value, t)))
    )
    return pairs.join(entities.select("chunk_id", "normalized_value"), "chunk_id").groupBy("qid", "chunk_id").agg(js_round(F.sum(points)).cast("int").alias("entity_hits"))


def trace_hits(pairs: DataFrame, steps: DataFrame, most: int = 40) -> DataFrame:
    """(qid, chunk_id, trace_hits) over a chunk's first 40 steps: a path counts 1, any term one half."""
    first = Window.partitionBy("chunk_id").orderBy("seq")
    near = steps.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).select("chunk_id", "normalized_target")
    value = F.col("normalized_target")
    points = F.when(some(F.col("paths"), lambda p: F.contains(value, p)), 1.0).otherwise(0.0) + F.when(
        some(F.col("terms"), lambda t: (F.char_length(t) >= 3) & F.contains(value, t)), 0.5
    ).otherwise(0.0)
    return pairs.join(near, "chunk_id").groupBy("qid", "chunk_id").agg(js_round(F.sum(points)).cast("int").alias("trace_hits"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def relevance(latin_rank: Column, cjk_rank: Column, entities: Column, constraints: Column, traces: Column) -> Column:
    """Weighted reciprocal rank fusion over the sources that take part, plus up to 25 for direct hits."""
    present = {"latin": latin_rank > 0, "cjk": cjk_rank > 0, "entity": entities > 0, "constraint": constraints > 0, "trace": traces > 0}
    rank = {"latin": latin_rank, "cjk": cjk_rank}
    total, most = F.lit(0.0), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.when(present[name], F.lit(weight) / (RRF_K + rank.get(name, F.lit(1)))).otherwise(0.0)
        most = most + F.when(present[name], F.lit(weight / (RRF_K + 1))).otherwise(0.0)
    norm = F.when(most > 0, 100 * total / most).otherwise(0.0)
    bonus = F.least(F.lit(25), entities * 5 + traces * 3)
    return clamp(js_round(0.75 * norm + bonus)).cast("int")


def confidence(calls: Column, paired: Column, both: Column, terminal: Column, constraints: Column, is_open: Column, errors: Column, recovered: Column) -> Column:
    add = lambda test, n: F.when(test, n).otherwise(0)
    whole = (calls > 0) & (paired >= calls)
    points = F.lit(40) + add(whole, 30) + add((calls > 0) & (paired == 0), -20) + add(both, 10) + add(terminal, 10) + add(constraints > 0, 10) + add(is_open, -30) + add((errors > 0) & ~recovered, -10)
    return clamp(points).cast("int")


def freshness(end_ts: Column, now: Column | int, high_days: float = 7, medium_days: float = 30) -> Column:
    days = (F.lit(now) - end_ts) / 86_400_000.0
    return F.when(F.coalesce(end_ts, F.lit(0)) == 0, "Low").when(days <= high_days, "High").when(days <= medium_days, "Medium").otherwise("Low")


ORDER = ("relevance", "confidence", "end_ts")


def result_order() -> list[Column]:
    return [*[F.desc(c) for c in ORDER], F.asc("chunk_id")]


def first(rows: DataFrame, most: int, by: str, *order: Column) -> DataFrame:
    """The first ``most`` rows of each value of ``by`` with ``place`` from 1; each partition keeps its own first before they meet."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)


def good_enough(rows: DataFrame, min_relevance: int, min_confidence: int) -> DataFrame:
    return rows.filter((F.col("relevance") >= min_relevance) & (F.col("confidence") >= min_confidence))


def siblings(chunks: DataFrame, most: int = 8) -> DataFrame:
    """(chunk_id, sibling_ids): other complete chunks of the same user entry, the first eight by id."""
    other = chunks.filter("status = 'complete'").select("session_id", "user_entry_id", F.col("chunk_id").alias("sibling"))
    pairs = chunks.select("chunk_id", "session_id", "user_entry_id").join(other, ["session_id", "user_entry_id"]).filter("sibling <> chunk_id")
    order = Window.partitionBy("chunk_id").orderBy("sibling")
    near = pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    return near.groupBy("chunk_id").agg(F.array_sort(F.collect_list("sibling")).alias("sibling_ids"))


def collapse(results: DataFrame, most: int) -> DataFrame:
    """The best result of each user entry with the ids of its siblings, known and ranked; then the first ``most`` of each query."""
    none = F.array().cast("array<string>")
    anchor = Window.partitionBy("qid", "session_id", "user_entry_id")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id")).over(anchor)), lambda x: x["chunk_id"])
    order = Window.partitionBy("qid").orderBy(*result_order())
    placed = results.withColumn("place", F.row_number().over(order)).withColumn("_ranked", ranked).withColumn("_r", F.row_number().over(anchor.orderBy("place")))
    top = placed.filter("_r = 1").withColumn("sibling_ids", F.array_except(F.array_union(F.coalesce("sibling_ids", none), "_ranked"), F.array("chunk_id")))
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    return top.filter(F.col("place") <= most).drop("_ranked", "_r")
