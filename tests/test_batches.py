"""Arrow functions hold a stretch of a batch as Python values, never all of it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnstone.functions import batches as A
from turnstone.operators import extract as E


def test_stretches_are_bounded():
    assert list(A.stretches(np.array([3, 3, 3, 9, 0, 1]), 6)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(A.stretches(np.zeros(5), 6, 2)) == [(0, 2), (2, 2), (4, 1)]
    assert list(A.stretches(np.array([]))) == []


@pytest.mark.parametrize("find", [E.find_paths, E.find_symbols])
def test_finders_see_a_stretch_at_a_time(find, monkeypatch):
    seen, stretches = [], A.stretches
    monkeypatch.setattr(A, "stretches", lambda sizes: (seen.append(x) or x for x in stretches(sizes)))
    texts = pa.array([f"see a/b{i}.ts or `Name{i}` " + "x" * 2000 for i in range(3000)] + [None])
    found = find.func(texts)
    assert len(found) == 3001 and len(found[7]) == 1 and found[3000].as_py() == []
    assert sum(n for _, n in seen) == 3001 and max(n for _, n in seen) * 2000 <= A.STRETCH_BYTES


def test_finders_through_spark(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("see src/f"), "id", F.lit(".ts")).alias("t"))
    found = rows.select("id", E.find_paths("t").alias("p")).select("id", F.explode("p.value").alias("v"))
    assert found.filter(F.col("v") == F.concat(F.lit("src/f"), "id", F.lit(".ts"))).count() == found.count() == 5000


def test_only_what_may_compose_is_sent_to_python(spark):
    import unicodedata

    from turnstone.functions import text as X

    assert all(unicodedata.is_normalized("NFC", chr(i)) for i in range(0x300))
    texts = ["plain", "é composed ÿ", "é å", "Å", "하", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.nfc("t").alias("n"))
    assert {r["t"]: r["n"] for r in frame.collect()} == {t: t and unicodedata.normalize("NFC", t) for t in texts}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan


def test_postings_are_made_where_the_row_is(spark, monkeypatch):
    from turnstone.operators import postings as I

    monkeypatch.setattr(I, "MOST_TOKENS", 3)
    rows = spark.createDataFrame([("a", "x y x", "y"), ("b", None, "x"), ("c", "", None), ("d", "z", "z z")], "chunk_id string, one string, two string").repartition(1)
    found = I.postings(rows, "s", ["one", "two"], I.words)
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    far = 1 << 32
    assert sorted(tuple(r) for r in found.collect()) == [("s", "x", "a", 2, 4, [0, 2]), ("s", "x", "b", 1, 1, [far]), ("s", "y", "a", 2, 4, [1, far]), ("s", "z", "d", 3, 3, [0, far, far + 1])]


def test_sessions_are_walked_a_stretch_at_a_time(spark, monkeypatch):
    from turnstone.operators import tree

    monkeypatch.setattr(tree, "MOST_ENTRIES", 4)
    rows = [(f"s{s}", i, f"{s}:{i}", f"{s}:{i - 1}" if i else None, i) for s in range(9) for i in range(3)]
    entries = spark.createDataFrame(rows, "session_id string, ordinal int, entry_id string, parent_id string, ts_ms long")
    found = {r["session_id"]: (r["leaf_id"], r["path"], r["path_len"], r["leaf_ord"]) for r in tree.leaf_paths(entries.repartition(1)).collect()}
    assert found == {f"s{s}": (f"{s}:2", [f"{s}:0", f"{s}:1", f"{s}:2"], 3, 2) for s in range(9)}
