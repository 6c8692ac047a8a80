"""Scalar rules on single values."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from turnstone.functions import stem
from turnstone.functions import text as X
from turnstone.operators import extract as E
from turnstone.operators import postings as I
from turnstone.operators import ranking as R
from turnstone.operators import tools as TL
from turnstone.plans import search as Q
from turnstone.plans.staging import Staging
from turnstone.sources import sessions as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("rotate key sk-abcdefghijklmnopqrstuvwxyz123456 and password=supersecretvalue99", "rotate key [REDACTED_API_KEY] and [REDACTED_CREDENTIAL]"),
        ("Received Bearer eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.aa.bb and ghp_abcdefghijklmnopqrstuv", "Received Bearer [REDACTED] and [REDACTED_TOKEN]"),
        ("token=sk-abcdefghijklmnopqrstuvwxyz123456", "[REDACTED_CREDENTIAL]"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
        ("xoxb-1234567890ab", "[REDACTED_TOKEN]"),
        ("a" * 45, "[REDACTED_BLOB]"),
        (None, ""),
    ],
)
def test_redact(spark, given, want):
    assert one(spark, given, X.redact) == want


def test_cuts(spark):
    assert one(spark, "abcdef", lambda c: X.clip(c, 3)) == "abc…"
    assert one(spark, "abcdef", lambda c: X.redact(c, 4)) == "abcd\n…[truncated 2 chars]"


@pytest.mark.parametrize(("path", "want"), [(".env", True), ("secrets/credentials.json", True), ("src/order.ts", False), ("a\\b\\id_rsa", True)])
def test_sensitive(spark, path, want):
    assert one(spark, path, X.is_sensitive) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [("src/order/delivery_rule.ts: export", ["src/order/delivery_rule.ts"]), ("Will edit delivery_rule.ts. Also", []), ("a.ts b.ts", ["a.ts", "b.ts"]), ("v 3.14 a@b.com", ["3.14", "a@b.com"])],
)
def test_paths(spark, text, want):
    found = spark.createDataFrame([(text,)], "x string").select(E.find_paths("x").alias("p")).select(E.path_entities("p", F.lit("/w")).alias("y")).first()["y"]
    assert [e["value"] for e in found] == want


def test_errors(spark):
    values = lambda t: [e["value"] for e in one(spark, t, E.error_entities)]
    assert values("fatal: bad ref") == [] and values("TypeError: x is bad") == ["Error: x is bad"]


def test_grams(spark):
    assert one(spark, "货期规则", X.cjk_grams) == ["货期", "货期规", "期规", "期规则", "规则"]
    assert one(spark, "a 字 b", X.cjk_grams) == ["字"] and one(spark, None, X.cjk_grams) == []


def test_word_borders_are_ascii(spark):
    assert [c["trigger_word"] for c in one(spark, "cela été must naïve indeed", E.constraints)] == ["must"]


@pytest.mark.parametrize(("latin", "constraints", "want"), [(1, 0, 75), (50, 0, 42), (50, 1, 59)])
def test_relevance(spark, latin, constraints, want):
    args = [F.lit(v) for v in (latin, 0, 0, constraints, 0)]
    assert spark.range(1).select(R.relevance(*args).alias("y")).first()["y"] == want


def test_freshness(spark):
    day = 86_400_000
    row = spark.range(1).select(*[R.freshness(F.lit(100 * day - d * day), 100 * day).alias(str(d)) for d in (2, 7, 14, 30, 60)], R.freshness(F.lit(0), 1).alias("none")).first()
    assert list(row) == ["High", "High", "Medium", "Medium", "Low", "Low"]


def test_first_argument_of_several_names(spark):
    rows = spark.createDataFrame([({"PATH": "b", "file": " "},), ({"path": "a", "Path": "c"},), ({},)], "a map<string,string>")
    assert [r[0] for r in rows.select(X.first_of("a", TL.PATH_NAMES)).collect()] == ["b", "a", None]


def test_query_terms():
    assert Q.query_terms("src/order/x.ts 货期 a (b)c!") == [("latin", 0, "src/order/x.ts"), ("cjk", 0, "货期")]
    assert Q.query_terms("  ") == [] and Q.query_terms("!!") == []
    assert Q.query_entities("fix `applyRule` in src/a.ts for Order") == {"paths": ["src/a.ts"], "symbols": ["applyrule", "order"], "terms": ["fix", "applyrule", "in", "src/a.ts", "for", "order"]}


def test_projects(tmp_path):
    assert S.project_of("/Users/box/dev-code/sample").root == "/Users/box/dev-code/sample"
    assert S.folder_name("/Users/box/a") == "--Users-box-a--"


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"), ("oscillators", "oscil"), ("middleware", "middlewar"), ("agreed", "agre")],
)
def test_porter(word, want):
    assert stem.porter(word) == want


def test_bm25_equals_a_full_text_index(spark):
    texts = ["the delivery rules of the order", "order dates and delivery", "nothing here", "rules rules rules order", "a delivery rule about delivered orders", "src order x ts"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(body, tokenize='porter unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(texts)))
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, body string")
    post = I.postings(rows, "latin", ["body"], I.stemmed)
    stats = I.corpus(rows.select(F.lit("latin").alias("source"), "chunk_id"), post)
    for terms in (["delivery"], ["rules", "order"], ["order/x.ts", "nothing"], ["delivery", "delivery"]):
        wanted = I.phrases(spark.createDataFrame([("q", "latin", i, t) for i, t in enumerate(terms)], "qid string, source string, phrase_no int, term string"), I.stemmed)
        got = {r["chunk_id"]: round(r["score"], 9) for r in I.bm25(post, wanted, stats).collect()}
        match = " OR ".join(f'"{t}"' for t in terms)
        assert got == {str(i): round(s, 9) for i, s in db.execute("select rowid, rank from t where t match ?", (match,))}


def test_contained_equals_a_plain_search(spark):
    import random

    rng = random.Random(7)
    values = ["".join(rng.choice("abc/é") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    patterns = ["a", "é", "ab", "/c", "abc", "ca/b", "bbbb", "", "abc/éabcd", "zz"]
    rows = spark.createDataFrame([(f"c{i % 120:03}", v) for i, v in enumerate(values)] + [("c999", None)], "chunk_id string, v string")
    asked = spark.createDataFrame([(f"q{i % 3}", p) for i, p in enumerate(patterns)], "qid string, pattern string")
    for most in (4, 1000):
        want = set()
        for i, p in enumerate(patterns):
            hits = sorted({f"c{k % 120:03}" for k, v in enumerate(values) if p and p in v})[:most]
            want |= {(f"q{i % 3}", c) for c in hits}
        for tried in (None, patterns):
            assert {tuple(r) for r in R.contained(rows, "v", asked, most, tried).collect()} == want


def test_gram_tokens_are_those_of_any_text(spark):
    texts = ["货期 货期规", "がぎ カ゛ ヴァ", "ア・イ 豈", "", "ゝ々 ー"]
    assert [one(spark, t, I.grams) for t in texts] == [stem.tokens(t, False) for t in texts]


def test_values_with_their_grams_are_not_broadcast(spark):
    """Spark takes them for as small as the values, and a driver would have to hold each value as often as it has grams."""
    rows = spark.createDataFrame([("c", "x" * 400)], "chunk_id string, v string")
    patterns = spark.createDataFrame([("q", "xxxx")], "qid string, pattern string")
    found = R.contained(rows, "v", patterns, 5)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "_g" in x]
    assert joins and all("rightHint=(strategy=broadcast)" in x for x in joins)
    assert [tuple(r) for r in found.collect()] == [("q", "c")]


def test_scores_are_not_dealt_out_by_query(spark):
    """Of a chunk's postings all scores are summed up where the chunk is: no exchange by query and chunk."""
    rows = spark.createDataFrame([(str(i), "a b a" if i % 3 else "b c") for i in range(30)], "chunk_id string, t string")
    post = I.postings(rows, "latin", ["t"], I.words)
    terms = spark.createDataFrame([("p", "latin", 0, "a b"), ("q", "latin", 0, "a"), ("q", "latin", 1, "c")], "qid string, source string, phrase_no int, term string")
    scores = I.bm25(post, I.phrases(terms, I.words), I.corpus(rows.select(F.lit("latin").alias("source"), "chunk_id"), post), stage=Staging(spark))
    assert "hashpartitioning(qid" not in scores._jdf.queryExecution().executedPlan().toString()
    assert {r["qid"] for r in scores.collect()} == {"p", "q"} and scores.filter("qid = 'q'").count() == 30
