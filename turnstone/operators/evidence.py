"""Evidence: summaries and messages that extensions wrote into a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How sure each kind of evidence is.
CONFIDENCE = {"compaction": 0.5, "branch_summary": 0.55, "custom_message": 0.45}


def evidence(placed: DataFrame, own_markers: tuple[str, ...] = ("turnstone",)) -> DataFrame:
    """Rows of ``placed`` that are evidence, with evidence_type, evidence_scope, text and confidence.

    Compactions and foreign custom messages belong to the chunk; a branch's summary only to its session. What this
    library itself wrote (custom types that begin with a marker) is none.
    """
    own = F.lit(False)
    for m in own_markers:
        own = own | F.startswith(F.coalesce("custom_type", F.lit("")), F.lit(m))
    text = (
        F.when(F.col("type") == "compaction", F.col("summary"))
        .when((F.col("type") == "branch_summary") & (F.col("summary") != ""), F.col("summary"))
        .when((F.col("type") == "custom_message") & ~own, F.col("content"))
    )
    level = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("type"))
    return (
        placed.filter(F.col("type").isin(*CONFIDENCE))
        .withColumn("_text", text)
        .filter(F.coalesce(F.col("_text") != "", F.lit(False)))
        .select(
            *[c for c in placed.columns if c not in ("text", "type", "summary", "content", "custom_type")],
            F.col("type").alias("evidence_type"),
            F.when(F.col("type") == "branch_summary", "session").otherwise("chunk").alias("evidence_scope"),
            F.col("_text").alias("text"),
            level.alias("confidence"),
        )
    )
