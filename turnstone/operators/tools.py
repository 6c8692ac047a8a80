"""Tool calls: their kind, their results, and the steps of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import patterns as P
from turnstone.functions import text as X
from turnstone.operators import extract as E

#: Names under which tools take paths, patterns and commands.
PATH_NAMES = ("path", "filePath", "file", "filename", "target")
PATTERN_NAMES = ("pattern", "query", "glob", "regex")
COMMAND_NAMES = ("command", "cmd")


def shell_kind(command: Column | str) -> Column:
    """What a shell command does, by the first rule that fits."""
    c = X.strip(command)
    return F.when(c.rlike(P.SHELL_GREP), "grep").when(c.rlike(P.SHELL_FIND), "find").when(c.rlike(P.SHELL_LIST), "list").when(c.rlike(P.SHELL_TEST), "verification").otherwise("bash")


def with_given(calls: DataFrame) -> DataFrame:
    """Calls with given_path, given_pattern and given_command from their arguments, as columns that are made once."""
    names = {"given_path": PATH_NAMES, "given_pattern": PATTERN_NAMES, "given_command": COMMAND_NAMES}
    return calls.withColumns({c: X.first_of("arguments", n) for c, n in names.items()}).withColumn("is_hidden", X.is_sensitive("given_path"))


def step_type(name: Column, command: Column, is_error: Column) -> Column:
    lower = F.lower(name)
    shell = shell_kind(F.coalesce(command, F.lit("")))
    return F.when(lower.isin("read", "grep", "find", "edit", "write"), lower).when(lower == "ls", "list").when(lower.isin("bash", "shell"), shell).when(is_error, "error").otherwise("tool")


def target(name: Column, root: Column) -> Column:
    """What a call ``with_given`` works on; a sensitive path is named as such only. Secrets are still to be masked."""
    lower = F.lower(name)
    path, pattern, command, hidden = (F.col(c) for c in ("given_path", "given_pattern", "given_command", "is_hidden"))
    plain = F.when(hidden, F.lit("[SENSITIVE_PATH]")).otherwise(path)
    shown = F.when(hidden, F.lit("[SENSITIVE_PATH]")).otherwise(X.display_path(path, root))
    both = F.coalesce(F.nullif(F.concat_ws(" in ", pattern, plain), F.lit("")), lower)
    made = F.when(lower.isin("read", "edit", "write"), F.coalesce(shown, lower)).when(lower.isin("grep", "find"), both).when(lower == "ls", F.coalesce(shown, F.lit(".")))
    return made.when(lower.isin("bash", "shell"), F.coalesce(F.nullif(X.clip(command, 240), F.lit("")), F.lit("bash"))).otherwise(F.coalesce(plain, pattern, name))


def with_found(calls: DataFrame) -> DataFrame:
    """Calls ``with_given`` and what their pattern and command hold: columns pattern_symbols, command_paths, command_symbols."""
    found = {"pattern_symbols": E.find_symbols("given_pattern"), "command_paths": E.find_paths("given_command"), "command_symbols": E.find_symbols("given_command")}
    return with_given(calls).withColumns(found)


def call_entities(name: Column, arguments: Column, root: Column) -> Column:
    """Entities that a call's arguments name, in order; for calls ``with_found``."""
    lower = F.lower(name)
    path = F.col("given_path")
    by_path = E.path_argument(path, root)
    other = F.filter(F.map_entries(arguments), lambda e: F.contains(F.lower(e["key"]), F.lit("path")) | F.contains(e["value"], F.lit("/")))
    others = F.flatten(F.transform(other, lambda e: E.path_argument(e["value"], root)))
    shell = F.concat(E.path_entities("command_paths", root, 0.8), E.symbol_entities("command_symbols", 0.5))
    return (
        F.when(lower.isin("read", "find", "edit", "write"), by_path)
        .when(lower == "grep", F.concat(by_path, E.symbol_entities("pattern_symbols", 0.7)))
        .when(lower == "ls", E.path_argument(F.coalesce(path, F.lit(".")), root))
        .when(lower.isin("bash", "shell"), shell)
        .otherwise(others)
    )


def safe_arguments(arguments: Column) -> Column:
    """Arguments as JSON with secrets replaced in each value, cut to the budget."""
    clean = F.transform_values(arguments, lambda k, v: F.when(X.is_sensitive(v), F.lit("[SENSITIVE_PATH]")).when(k.rlike("(?i)^(api[_-]?key|token|password|secret)$"), F.lit("[REDACTED_CREDENTIAL]")).otherwise(X.mask_secrets(v)))
    raw = F.coalesce(F.to_json(clean), F.lit("{}"))
    return F.when(F.char_length(raw) > P.MAX_ARGS, F.concat(F.substring(raw, 1, P.MAX_ARGS), F.lit('"}"…[truncated]"'))).otherwise(raw)


def pair_results(calls: DataFrame, results: DataFrame, within: str = "chunk_id") -> DataFrame:
    """Calls with their results: (within, ord, sub, ...) plus result_entry_id, result_text, is_error, results.

    A result belongs to the latest earlier call of its id; of several results of a call the last one counts.
    calls: within, ord, sub, entry_id, tool_call_id, tool_name, arguments. results: within, ord, entry_id, tool_call_id, text, is_error.
    """
    c = calls.select(within, F.col("ord").alias("c_ord"), F.col("sub").alias("c_sub"), "tool_call_id")
    met = results.join(c, [within, "tool_call_id"]).filter(F.col("ord") > F.col("c_ord"))
    latest = Window.partitionBy(within, "tool_call_id", "ord").orderBy(F.desc("c_ord"), F.desc("c_sub"))
    met = met.withColumn("_r", F.row_number().over(latest)).filter("_r = 1")
    per_call = met.groupBy(within, "c_ord", "c_sub").agg(F.max(F.struct("ord", "entry_id", "text", "is_error")).alias("last"), F.count(F.lit(1)).alias("results"))
    joined = calls.join(per_call.withColumnsRenamed({"c_ord": "ord", "c_sub": "sub"}), [within, "ord", "sub"], "left")
    return joined.select(
        *calls.columns,
        F.col("last.entry_id").alias("result_entry_id"),
        F.coalesce("last.text", F.lit("")).alias("result_text"),
        F.coalesce("last.is_error", F.lit(False)).alias("is_error"),
        F.coalesce("results", F.lit(0)).alias("results"),
    )


def trace_steps(paired: DataFrame, root: Column, within: str = "chunk_id") -> DataFrame:
    """One step for each call and a further one, of type error, behind a call that failed; step_order from 1."""
    given = with_given(paired).withColumn("target", target(F.col("tool_name"), root))
    given = given.withColumns({"target": X.mask_secrets("target"), "outcome": X.mask_secrets("result_text"), "arguments_json": safe_arguments(F.col("arguments"))})
    given = given.withColumn("outcome", X.cut("outcome", P.MAX_OUTCOME))
    made = given.select(
        within,
        "ord",
        "sub",
        "entry_id",
        "result_entry_id",
        "tool_call_id",
        "tool_name",
        "is_error",
        "arguments_json",
        step_type(F.col("tool_name"), F.col("given_command"), F.col("is_error")).alias("step_type"),
        "target",
        X.clip("outcome", P.MAX_OUTCOME).alias("outcome"),
        F.when(F.col("is_error"), "error").when(F.col("result_entry_id").isNotNull(), "success").otherwise("unknown").alias("status"),
    )
    step = F.struct(F.lit(0).alias("extra"), F.col("entry_id").alias("source_entry_id"), F.col("step_type").alias("kind"), F.col("arguments_json").alias("given"))
    failed = F.struct(F.lit(1).alias("extra"), F.coalesce("result_entry_id", "entry_id").alias("source_entry_id"), F.lit("error").alias("kind"), F.lit(None).cast("string").alias("given"))
    steps = made.withColumn("x", F.explode(F.when(F.col("is_error"), F.array(step, failed)).otherwise(F.array(step))))
    order = Window.partitionBy(within).orderBy("ord", "sub", "x.extra")
    return steps.select(
        within,
        F.col("x.source_entry_id").alias("source_entry_id"),
        "result_entry_id",
        "tool_call_id",
        "tool_name",
        F.col("x.given").alias("arguments_json"),
        F.col("x.kind").alias("step_type"),
        "target",
        F.lower("target").alias("normalized_target"),
        "outcome",
        "status",
        F.row_number().over(order).alias("step_order"),
    )
