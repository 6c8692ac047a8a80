"""Entities, constraints and exclusions from texts.

Entities carry the text around their place, and Spark's regular expressions tell no places: those
extractors are Python functions. All else is Column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import patterns as P
from turnstone.functions import text as X
from turnstone.functions.batches import by_value

FOUND = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("context", T.StringType())]))


def _around(text: str, at: int, radius: int = 80) -> str:
    return re.sub(r"\s+", " ", text[max(0, at - radius) : at + radius])


def _finder(rules: list[str], keep):
    compiled = [re.compile(r, re.ASCII) for r in rules]

    def find(text):
        seen: dict[str, dict] = {}
        for rule in compiled:
            for m in rule.finditer(text or ""):
                value = m.group(1)
                if keep(value) and (key := value.lower()) not in seen:  # ASCII alone, so it is composed already
                    seen[key] = {"value": value, "place": m.start(), "context": _around(text, m.start())}
        return list(seen.values())

    return by_value(FOUND, find)


#: What the texts hold, as columns of their own: Spark wants no UDF below a lambda.
find_paths = _finder([P.PATH], lambda v: True)
find_symbols = _finder([P.BACKTICKED, P.SYMBOL], lambda v: len(v) >= 3 and not ("/" in v and "." in v))


def _entities(kind: str, found: Column, value: Column | None, root: Column, confidence: float) -> Column:
    def shape(e: Column) -> Column:
        shown = X.display_path(e["value"], root) if kind == "file_path" else e["value"]
        return F.struct(
            F.lit(kind).alias("entity_type"),
            shown.alias("value"),
            F.lower(X.strip(shown)).alias("normalized_value"),
            X.mask_secrets(e["context"]).alias("context"),
            F.lit(confidence).alias("confidence"),
        )

    return F.transform(found, shape)


def path_entities(found: Column | str, root: Column, confidence: float = 0.7) -> Column:
    """File paths of a text (``find_paths``) without those that may hold secrets. Paths written in two ways may show alike: ``dedupe_entities`` keeps the first."""
    found = F.filter(X.col(found), lambda e: ~X.is_sensitive(e["value"]))
    return _entities("file_path", found, None, root, confidence)


def symbol_entities(found: Column | str, confidence: float = 0.6) -> Column:
    """Names in backticks, then names that begin with a capital and names with an arity (``find_symbols``)."""
    return _entities("symbol", X.col(found), None, F.lit(""), confidence)


def error_entities(text: Column | str, confidence: float = 0.8) -> Column:
    """Error messages of a text: from the keyword to the end of the line, redacted, once each."""
    whole = F.regexp_extract_all(F.coalesce(X.col(text), F.lit("")), F.lit(P.ERROR.replace(r"\b", P.EDGE).replace(r"\d", "[0-9]")), F.lit(0))
    lines = F.filter(F.transform(whole, lambda m: X.redact(X.strip(m), 240)), lambda m: F.char_length(m) >= 8)
    once = F.filter(lines, lambda m, i: F.array_position(F.transform(lines, F.lower), F.lower(m)) == (i + 1).cast("long"))
    return F.transform(
        once,
        lambda m: F.struct(F.lit("error").alias("entity_type"), m.alias("value"), F.lower(X.strip(m)).alias("normalized_value"), F.lit("").alias("context"), F.lit(confidence).alias("confidence")),
    )


def path_argument(path: Column, root: Column, confidence: float = 0.95) -> Column:
    """The entity of a path given as an argument; none for a blank or sensitive one."""
    shown = X.display_path(path, root)
    entity = F.struct(F.lit("file_path").alias("entity_type"), shown.alias("value"), F.lower(X.strip(shown)).alias("normalized_value"), F.lit("").alias("context"), F.lit(confidence).alias("confidence"))
    return F.when(path.isNotNull() & (path != "") & ~X.is_sensitive(path), F.array(entity)).otherwise(F.array().cast("array<struct<entity_type: string, value: string, normalized_value: string, context: string, confidence: double>>"))


def module_entity(name: Column, confidence: float = 0.75) -> Column:
    return F.struct(F.lit("module").alias("entity_type"), name.alias("value"), F.lower(X.strip(name)).alias("normalized_value"), F.lit("").alias("context"), F.lit(confidence).alias("confidence"))


def constraints(text: Column | str) -> Column:
    """Sentences that state a constraint: text, normalized_text, trigger_word, confidence."""

    def trigger(s: Column) -> Column:
        english = F.regexp_extract(s, P.CONSTRAINT_EN, 1)
        return F.when(english != "", english).otherwise(F.regexp_extract(s, P.CONSTRAINT_ZH, 1))

    def stands(s: Column) -> Column:
        n = F.char_length(s)
        return (n >= 8) & (n <= 400) & ~s.rlike(P.QUOTED_ONLY) & ~s.rlike(P.NO_CONSTRAINT) & (trigger(s) != "")

    def shape(s: Column) -> Column:
        clean = X.redact(X.squeeze(s), P.MAX_CONTEXT)
        return F.struct(clean.alias("text"), F.lower(clean).alias("normalized_text"), F.lower(trigger(s)).alias("trigger_word"), F.lit(0.55).alias("confidence"))

    return F.transform(F.filter(X.sentences(text), stands), shape)


def exclusions(text: Column | str) -> Column:
    """What a text says was ruled out: target, outcome (the reason, else the whole match), step_order from 10,000."""
    text = F.coalesce(X.col(text), F.lit(""))

    def of(pattern: str) -> Column:
        whole, target, reason = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(3))
        return F.arrays_zip(whole.alias("whole"), F.transform(target, X.strip).alias("target"), F.transform(reason, X.strip).alias("reason"))

    found = F.filter(F.concat(of(P.EXCLUSION_EN), of(P.EXCLUSION_ZH)), lambda e: e["target"] != "")
    return F.transform(
        found,
        lambda e, i: F.struct(
            X.mask_secrets(e["target"]).alias("target"),
            F.lower(X.mask_secrets(e["target"])).alias("normalized_target"),
            F.when(e["reason"] != "", X.redact(e["reason"], P.MAX_OUTCOME)).otherwise(X.mask_secrets(e["whole"])).alias("outcome"),
            (F.lit(P.EXCLUSION_FROM) + i).cast("int").alias("step_order"),
        ),
    )


def dedupe_entities(entities: DataFrame, within: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Of entities alike in type, normalised value and source entry the surest, at the place of the first (``seq``)."""
    of = [*within, "entity_type", "normalized_value", "source_entry_id"]
    best = Window.partitionBy(*of).orderBy(F.desc("confidence"), "seq")
    ranked = entities.withColumn("_first", F.min("seq").over(Window.partitionBy(*of))).withColumn("_rank", F.row_number().over(best))
    return ranked.filter("_rank = 1").withColumn("seq", F.col("_first")).drop("_rank", "_first")


def dedupe_constraints(found: DataFrame, within: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Of constraints alike in normalised text and source entry the first."""
    first = Window.partitionBy(*within, "normalized_text", "source_entry_id").orderBy("seq")
    return found.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
