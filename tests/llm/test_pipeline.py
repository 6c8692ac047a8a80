"""The pipeline's stages over a small table: what each must drop, cut and keep."""

import random

import corpus_pipeline

WORDS = "river stone house garden little mountain window letter summer winter paper silver".split()


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))
    passage, item = say(70), say(30)
    docs, labels = [], []
    for i in range(120):
        t = say(60)
        if i % 3 == 0:
            t += " foulword " + say(3)
        docs.append((i, t))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(200, docs[1][1]), (201, docs[1][1] + " more"), (202, f"{say(20)} {passage} {say(30)}"), (203, f"{say(25)} {passage}"), (204, f"{say(40)} {item} {say(10)}"), (205, None), (206, ""), (None, say(30)), (207, say(3000))]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
        if name != "packing":
            assert now.columns == frame.columns
            seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(seen["toxicity"]) == {d for d, _ in docs} - set(range(0, 120, 3))
    assert set(seen["near_duplicates"]) == set(seen["toxicity"]) - {200, 201}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["near_duplicates"])
    assert passage[:40] not in cut[202] and passage[:40] not in cut[203] and len(cut[202].split()) == 50
    assert all(cut[d] == t for d, t in docs if d in cut and d not in (202, 203))
    assert set(seen["decontamination"]) == set(cut) - {204}
    assert {r["doc_id"] for r in now.collect()} == set(seen["decontamination"])
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(now.columns)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == now.count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
