"""The registered queries themselves: their columns, types and rows against plain versions, SQL where there is some."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from turnstone.llm import decontamination, licenses, packing, quality, queries, toxicity

from test_operators import SCHEMA, made, plain_counts, raw, sentence

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"

TYPES = {
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def texts():
    rng = random.Random(12)
    rows = {i: t for i, t, *_ in made() if i is not None and i != 500}
    for i in range(600, 640):
        rows[i] = sentence(rng, 40)
    rows[640] = f"a {END} b"
    rows[641] = f"{END}{END} c {sentence(rng, 900)} {END}"
    rows[642] = sentence(rng, 1500)
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng, rows = random.Random(1), texts()
    docs = [(i, t, ("en", "de")[i % 2], "web" if i % 3 else "news", len(t or "")) for i, t in rows.items()]
    docs += [(2000 + i, " ".join([*sentence(rng, 30).split(), *(["foulword"] if i % 3 == 0 else [])]), "en", "web", 1) for i in range(200)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    long = [t for t in rows.values() if t and len(t.split()) > 40][:3]
    items = [(1, " ".join(long[0].split()[3:25])), (2, " ".join(long[1].split()[1:12])), (3, None), (4, "never seen words of an item in any document here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    marks = [(2000 + i, 1, int(i % 3 == 0)) for i in range(200)] + [(i, 1, 0) for i in rows]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, {i: t for i, t, *_ in docs}


def rows_of(spark, sf, name):
    found = queries.QUERIES[name](spark, sf[0])
    types = dict(found.dtypes)
    assert {c: types[c] for c in TYPES.get(name, {})} == TYPES.get(name, {})
    return found.collect()


def test_sharding_query(spark, sf):
    got = rows_of(spark, sf, "op2_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(sf[1])
    shards = {}
    for r in got:
        t = sf[1][r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw(t)) + 1, zlib.crc32(raw(t)), "rows", None)
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_token_counts_query(spark, sf):
    lib = library()
    for r in rows_of(spark, sf, "op3_token_counts"):
        n = len(lib.encode(sf[1][r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(raw(sf[1][r["doc_id"]])), n, n > 512)


def test_packing_query(spark, sf):
    lib, pieces, bins = library(), {}, {}
    for r in rows_of(spark, sf, "op4_best_fit_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(sf[1])
    for i, t in sf[1].items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and len(pieces[i]) == -(-len(ids) // 1024)
    for b in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(b)))
        assert [at for at, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_packing_with_a_cold_cache():
    import pyarrow as pa

    lib, rng = library(), random.Random(2)
    words = [f"word{i}" for i in range(3000)]
    for _ in range(6):
        packing._library.cache_clear()
        batch = [f"a {END} b", f"{END} {rng.choice(words)} {END}{END}x", None, *[" ".join(rng.choices(words, k=30)) for _ in range(20)]]
        rng.shuffle(batch)
        plain = [" ".join(rng.choices(words, k=30)) for _ in range(50)]
        for column in (batch, plain):
            ids, offsets = packing.token_ids(pa.array(column, pa.string()), VOCABULARY, 2)
            for t, a, b in zip(column, offsets[:-1], offsets[1:], strict=True):
                assert ids[a:b].tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_tells_the_rows(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf[0]}/{t}.parquet/*.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = rows_of(spark, sf, name)
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def test_quality_query(spark, sf):
    got = rows_of(spark, sf, "op6_quality_rules")
    assert sorted(r["doc_id"] for r in got) == sorted(sf[1])
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(sf[1][r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["distance2"] <= 25.744832)


def plain_mcd(x, share=0.75, starts=300):
    """Minimum covariance determinant over all rows at once, reweighted."""
    rng, (n, p) = np.random.default_rng(3), x.shape
    h = math.ceil(share * n)
    factor = lambda q: q / quality.chi_square(quality.chi_square_quantile(q), 2)
    far = lambda mean, cov: ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
    best = (math.inf, None, None)
    for _ in range(starts):
        few = x[rng.permutation(n)[: p + 1]]
        mean, cov, was = few.mean(0), np.cov(few.T, bias=True) + quality.LEAST, math.inf
        while True:
            inner = x[np.argsort(far(mean, cov))[:h]]
            mean, cov = inner.mean(0), np.cov(inner.T, bias=True) * factor(share) + quality.LEAST
            now = np.linalg.det(cov)
            if now >= was * (1 - 1e-12):
                break
            was = now
        if now < best[0]:
            best = (now, mean, cov)
    inner = x[far(*best[1:]) <= quality.chi_square_quantile(0.975)]
    return far(inner.mean(0), np.cov(inner.T, bias=True) * factor(0.975) + quality.LEAST)


def test_distances_are_those_of_a_plain_estimate(spark):
    rng = random.Random(21)
    rows = []
    for i in range(900):
        t = sentence(rng, rng.randrange(30, 300)).split()
        if i % 5 == 0:  # a fifth are of another kind
            t = [w + "#" * rng.randrange(0, 4) for w in t[:40]]
        rows.append((i, " ".join(t) + ("\n" + " ".join(t[:3])) * rng.randrange(0, 2), "en", "s"))
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    features = []
    for i, t, *_ in rows:
        n, chars, symbols, dup, rep = plain_counts(t)
        features.append([math.log(1 + n), chars / n, symbols / chars, dup / sum(bool(x.strip()) for x in t.split("\n")), rep / n])
    judged = [i for i in got if not got[i]["base_failed"]]
    want = plain_mcd(np.array(features)[judged])
    mine = np.array([got[i]["distance2"] for i in judged])
    assert np.abs(np.sqrt(mine) - np.sqrt(want)).max() <= 0.05 * np.sqrt(want).max() and np.median(np.abs(mine - want) / want) < 0.03


def test_small_groups_lean_on_their_language(spark):
    rng = random.Random(22)
    rows = [(i, sentence(rng, rng.randrange(60, 200)), "en", "big") for i in range(400)]
    rows += [(1000 + i, sentence(rng, 90), "en", f"rare{i}") for i in range(20)]
    rows += [(2000 + i, " ".join(w + "####" for w in sentence(rng, 90).split()), "en", f"odd{i}") for i in range(20)]
    rows += [(3000, sentence(rng, 90), None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] == (not 2000 <= i < 3000) for i in got)


def naive(lexicon, folded):
    total = 0.0
    for at in range(len(folded)):
        here = [w for e, w in lexicon.weights.items() if folded.startswith(e, at)]
        if here and not any(p in lexicon.exceptions for p in toxicity.phrases(folded, at)):
            total += max(here)
    words = len(folded.split())
    return total / (1 + 0.25 * math.log1p(words / 100))


def test_toxicity_query(spark, sf):
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op10_toxicity")}
    assert set(got) == set(sf[1])
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if i >= 2000:
            assert r["predicted"] == ((i - 2000) % 3 == 0)


def test_matches_are_those_of_a_naive_search():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({" ab": 2.0, " abc ": 3.5, " abcd": 1.0, " b ": 0.5, " ca": 1.5}, {" abc b ", " b ca "}, -1.0, 2.0)
    for n in (0, 1, 3, 30, 3000):
        for _ in range(20 if n < 1000 else 2):
            folded = toxicity.fold(" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(n)))
            assert lexicon.measure(folded) == pytest.approx(naive(lexicon, folded))
    short, long = toxicity.fold("abc"), toxicity.fold("abc" + " x" * 5000)
    assert lexicon.score(lexicon.measure(short)) > lexicon.score(lexicon.measure(long)) > lexicon.score(0.0)


def test_exceptions_come_from_whole_texts(spark):
    rows = [(i, "grim reaper and trash can" if i % 2 else "grim " * 70 + "trash x", i % 2) for i in range(400)]
    rows = [(i, t if i % 2 else "trash x grim " * 40 + "trash can", 1 - i % 2) for i, t, _ in rows]
    lexicon = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert " trash can " not in lexicon.exceptions  # toxic rows have it behind a hundred other matches


def test_decontamination_query(spark, sf):
    got = {(r["doc_id"], r["item_id"]): r for r in rows_of(spark, sf, "op1_decontamination")}
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf[0]}/benchmark.parquet").collect()}

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for a, x in enumerate(item, 1):
            new = [a]
            for b, y in enumerate(text, 1):
                new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (x != y)))
            row = new
        return min(row)

    want = {(d, i): e for d, t in sf[1].items() for i, w in items.items() if w and (e := distance(w, words(t)[:3000])) <= len(w) // 5}
    assert {k: r["edits"] for k, r in got.items()} == want and len(want) >= 2


def test_items_with_names_for_ids_and_many_of_one_id(spark):
    rng = random.Random(31)
    items = [("same", sentence(rng, 15)) for _ in range(30)] + [(None, sentence(rng, 15)), ("b", "")]
    docs = [(i, f"x y {t} z") for i, (_, t) in enumerate(items)]
    was, decontamination.BLOCK_ITEMS = decontamination.BLOCK_ITEMS, 7
    try:
        frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
        got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.contamination(frame, bench).collect())
        clean = [r["doc_id"] for r in decontamination.clean(frame, bench).collect()]
    finally:
        decontamination.BLOCK_ITEMS = was
    assert got == [(i, items[i][0]) for i in range(31)] and clean == [31]


def test_recall_at_the_full_number_of_edits():
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(4000)]
    missed = total = 0
    for n in (8, 10, 15, 25, 45):
        most = n // 5
        items = [rng.choices(vocabulary, k=n) for _ in range(60)]
        texts = []
        for kind in ("sub", "del", "ins", "mix"):
            for item in items:
                w = list(item)
                for _ in range(most):
                    k = kind if kind != "mix" else rng.choice(["sub", "del", "ins"])
                    at = rng.randrange(len(w))
                    w[at : at + 1] = {"sub": [rng.choice(vocabulary)], "del": [], "ins": [w[at], rng.choice(vocabulary)]}[k]
                texts.append(" ".join([*rng.choices(vocabulary, k=40), *w, *rng.choices(vocabulary, k=40)]))
        import pyarrow as pa

        of = lambda ts: decontamination.words_of(pa.array(ts))
        flat, at = of([" ".join(i) for i in items])
        tables = decontamination.Tables(list(range(60)), [flat[at[k] : at[k + 1]] for k in range(60)]).build()
        found = {(t, i) for t, i, *_ in tables.matches(*of(texts))}
        hit = sum((t, t % 60) in found for t in range(240))
        missed, total = missed + 240 - hit, total + 240
        assert hit >= 0.98 * 240
    assert missed <= 0.01 * total


def test_license_query(spark, sf):
    rng = random.Random(40)
    rows = [(i, f"{sentence(rng, 20)} {licenses.TEMPLATES[n]} {sentence(rng, 20)}") for i, n in enumerate(sorted(licenses.TEMPLATES))]
    rows.append((900, " ".join(sentence(rng, 300) + " " + licenses.TEMPLATES["MIT"] for _ in range(20))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS key", "1 AS row", "'x' AS license", "'y' AS shingles", "'z' AS words")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame).collect()}
    assert {(i, n) for i, n in enumerate(sorted(licenses.TEMPLATES))} | {(900, "MIT")} <= got
    assert rows_of(spark, sf, "op9_license_scan") == []
