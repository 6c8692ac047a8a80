"""Each operator against a plain version of what it computes, over small tables with every odd row there is."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnstone.llm import decontamination, licenses, near_duplicates, packing, quality, sharding, substring_dedup, suffix_array, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
WORDS = "the of and reason thing river stone übung élan señor 货期 x9 don't mountain little house garden".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", "s"]) + str(rng.randrange(40)) for _ in range(n))


def made():
    rng = random.Random(5)
    rows = []
    base = [sentence(rng, rng.randrange(30, 160)) for _ in range(14)]
    passage, long = sentence(rng, 60), sentence(rng, 6000)
    for i, b in enumerate(base):
        rows.append(b)
        words = b.split(" ")
        near = list(words)
        near[len(near) // 2] = "changed"
        rows.append(" ".join(near))
        if i % 3 == 0:
            rows.append(b)  # an exact copy
        if i % 4 == 0:
            rows.append(" ".join(words[:9]) + "\n" + passage + "\t" + " ".join(words[-9:]))
        rows.append(" ".join(words[: len(words) // 2]) + " " + sentence(rng, 20))
    rows += [long, long + " tail", None, "", "   \n\t", "one", "one two three", "A B c d", "a b C D", "<|endoftext|> x<|endoftext|>", "z" * 400, "aaaa " * 300, "emoji 😀 end", " nbsp　wide"]
    out = [(i, t, ("en", "fr", None)[i % 3], "src%d" % (i % 2), None if t is None else len(t)) for i, t in enumerate(rows)]
    out += [(500, rows[0], "en", "src0", 1), (500, rows[0], "en", "src0", 1), (None, rows[2], "en", None, 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "d")
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("shard", "slot", "key", "rest", "uid", "rank", "kept", "spans", "sketch", "words", "score", "length", "_place"):
        frame = frame.withColumn(name, F.lit("clash"))  # further columns with names that operators use
    frame.repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def raw(t):
    return (t or "").encode()


def test_token_counts(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, VOCABULARY, limit=50).collect())
    want = sorted((i if i is not None else -1, len(raw(t)), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, *_ in rows)
    assert got == want
    assert token_counts.token_counts(empty, VOCABULARY).collect() == []


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(docs, VOCABULARY, capacity=64, end=2).collect()
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        if i in (None, 500):
            continue
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(texts[i], key=lambda r: r["piece"])
        joined = b"".join(bytes(r["ids"]) for r in pieces)
        assert [int.from_bytes(joined[k : k + 4], "little") for k in range(0, len(joined), 4)] == ids
        assert [r["start"] for r in pieces] == list(itertools.accumulate([0] + [r["length"] for r in pieces][:-1]))
        assert all(r["length"] == 64 for r in pieces[1:]) and 0 < pieces[0]["length"] <= 64
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == one_by_one([r["length"] for r in got], 64)
    assert packing.pack(empty, VOCABULARY).collect() == []


def one_by_one(lengths, capacity):
    """Best fit decreasing, one piece after another."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randrange(1, 60)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        assert packing.bins_of(counts, capacity) == one_by_one(lengths, capacity)
        used = {}
        for n, runs in packing.plan(counts, capacity).items():
            for rank in range(counts[n]):
                b, at = packing.place_of(runs, rank, n)
                used.setdefault(b, []).append((at, n))
        for b in used.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity


def test_sharding(spark, docs, empty, rows):
    got = sharding.shard(docs, shards=7, seed=1).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((i or -1, t or "") for i, t, *_ in rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(sizes) == 7 and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    again = sharding.shard(docs, shards=7, seed=1).collect()
    key = lambda rs: sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in rs)
    assert key(got) == key(again) != key(sharding.shard(docs, shards=7, seed=2).collect())
    assert sharding.shard(empty, shards=7).collect() == []


def shingles(t):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(t)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, empty, rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])
    kept = [r["doc_id"] for r in near_duplicates.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(i for i in sets if root(i) == i)
    assert kept.count(None) == 2
    assert near_duplicates.near_duplicates(empty).collect() == []


def test_texts_of_one_key_are_kept_apart(spark):
    rng = random.Random(19)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(5, None, {"m": 1}), (5, a, {"m": 2}), (5, a, {"m": 3}), (5, b, None), (9, b, None), (9, c, None), (10, c + " end", None), (None, a, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    got = [(r["doc_id"], r["text"]) for r in near_duplicates.keep_one(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, None), (5, a), (5, b), (9, c), (None, a)]))


def test_large_clusters_are_compared_in_blocks(spark):
    rng = random.Random(9)
    base = sentence(rng, 60).split(" ")
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"w{i}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near_duplicates.BLOCK_ROWS, was = 20, near_duplicates.BLOCK_ROWS
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame).collect()}
    finally:
        near_duplicates.BLOCK_ROWS = was
    sets = [shingles(t) for t in texts]
    up = list(range(90))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(90), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {i: root(i) for i in range(90)}


def test_suffix_array(docs, empty, rows):
    rank = lambda i: i if i is not None else 1 << 62
    first = {}
    for i, t, *_ in rows:
        b = raw(t)
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, 1 << 63), rank(i))
    want = []
    for i, t, *_ in rows:
        b = raw(t)
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < rank(i):
                cover[p : p + 50] = b"\1" * 50
        want.append((str(i), len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    got = [(str(r["key"]), r["n_tokens"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_array.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_array.remove_repeats(empty).collect() == []


def test_substring_dedup(docs, empty, rows):
    count = {}
    lists = [(i, WORD.findall(raw(t))) for i, t, *_ in rows]
    for _, w in lists:
        for p in range(len(w) - 34):
            k = tuple(w[p : p + 35])
            count[k] = count.get(k, 0) + 1
    want = []
    for i, w in lists:
        cover = bytearray(len(w))
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                cover[p : p + 35] = b"\1" * 35
        want.append((str(i), len(w), sum(cover), b" ".join(x for x, c in zip(w, cover, strict=True) if not c)))
    found = substring_dedup.remove_passages(docs, carry=("lang", "key")).collect()
    assert sorted((str(r["key"]), r["n_tokens"], r["n_removed"], bytes(r["kept"])) for r in found) == sorted(want)
    assert {r["rest"]["key"] for r in found} == {"clash"}
    assert substring_dedup.remove_passages(empty).collect() == []


def test_hot_grams_take_another_way(docs, rows):
    for of in (suffix_array.remove_repeats, substring_dedup.remove_passages):
        usual = sorted((str(r["key"]), r["n_removed"], bytes(r["kept"])) for r in of(docs).collect())
        for hot in (2,):  # grams of more than two places: some windows go the one way, some the other, some both
            assert sorted((str(r["key"]), r["n_removed"], bytes(r["kept"])) for r in of(docs, hot=hot).collect()) == usual


def test_trees_and_passes_of_digits():
    import numpy as np

    rng = np.random.default_rng(2)
    table = rng.integers(1, 3, (400, 9)).astype(np.uint64)
    lengths = rng.integers(4, 10, 400)
    table[np.arange(9)[None, :] >= lengths[:, None]] = 0
    group, before, rank = rng.integers(0, 4, 400), rng.integers(0, 3, 400).astype(np.uint64), rng.integers(0, 9, 400)
    was = substring_dedup.GROUP_ROWS
    for most in (16, 10_000):
        substring_dedup.GROUP_ROWS = most
        assert sorted(np.concatenate([g for g, _ in substring_dedup.prefix_groups(group, table, most)]).tolist()) == list(range(400))
        try:
            at, depth = substring_dedup.tree_repeats(group, table, lengths, before, rank, 4)
        finally:
            substring_dedup.GROUP_ROWS = was
        want = {}
        for i in range(400):
            for n in range(4, int(lengths[i]) + 1):
                same = [j for j in range(400) if group[j] == group[i] and lengths[j] >= n and (table[j, :n] == table[i, :n]).all()]
                ends = len({table[j, n] if n < lengths[j] else -j for j in same}) > 1 if n < 9 else True
                words = {before[j] if before[j] else -j for j in same}
                if len(same) > 1 and ends and len(words) > 1:
                    want[i] = n
        assert dict(zip(at.tolist(), depth.tolist(), strict=True)) == want
    at, depth = suffix_array.later_copies(group, table.astype(np.uint8), lengths, before, rank, 4)
    assert set(at.tolist()) == {i for i in range(400) if any(group[j] == group[i] and (table[j, :4] == table[i, :4]).all() and rank[j] < rank[i] for j in range(400))}
    assert set(depth.tolist()) == {4}


def plain_counts(t):
    words = WORD.findall(raw(t))
    lines = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
    windows = {}
    for p in range(len(words) - 7):
        windows.setdefault(tuple(words[p : p + 8]), []).append(p)
    cover = set()
    for places in windows.values():
        if len(places) > 1:
            cover.update(q for p in places for q in range(p, p + 8))
    return len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, empty, rows):
    got = quality.quality(docs).collect()
    want = sorted((str(i), *plain_counts(t)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty).collect() == []
    tricky = ["a b\na b\n\na b", "\n\n", "x\n x\nx", "#*$ %&|<> é#", "w " * 30]
    more = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(tricky)], "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r)[:1] + (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.statistics(more).collect())
    assert got == [(i, *plain_counts(t)) for i, t in enumerate(tricky)]


def test_outliers_are_found_and_others_kept(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randrange(60, 200)), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in sentence(rng, 80).split()), "en", "a") for i in range(30)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(not r["kept"] for r in got if r["doc_id"] >= 1000)
    assert all(r["kept"] for r in got if r["doc_id"] < 1000)


def test_texts_with_many_symbols_are_outliers(spark):
    rng = random.Random(14)
    rows = [(i, sentence(rng, rng.randrange(60, 200)), "en", "a") for i in range(300)]
    for i in range(10):
        t = sentence(rng, 120)
        marks = round(0.095 * len(t.replace(" ", "")))  # a share of about 0.087 of the characters
        words = [w + "#" * (k < marks) for k, w in enumerate(t.split())]
        rows.append((1000 + i, " ".join(words), "en", "a"))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in got)


def test_toxicity(spark, tmp_path, docs, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        t = sentence(rng, rng.randrange(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(["foulword", "F0ulword!", "grimness", "grіmness"]))
        elif i % 4 == 1:
            t.insert(2, "ash tray")
        rows.append((i, " ".join(t)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (None, "foulword")]
    labels += [(None, 1), (0, 0), (99999, 1), (4, None)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(frame, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, lexicon).collect()}
    assert len(got) == 504 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got[1000] == got[1001] < 0.5 <= got[None]
    kept = {r["doc_id"] for r in toxicity.keep_clean(frame, lexicon).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert toxicity.learn(frame, marks.limit(0)).score(0.0) == 0.0
    assert toxicity.score(empty, lexicon).collect() == []
    assert toxicity.score(docs, lexicon).count() == docs.count()  # with further columns of clashing names
    assert toxicity.keep_clean(docs, lexicon).columns == docs.columns


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" trash": 3.0}, {" trash can "}, 0.0, 1.0)
    assert lexicon.measure(toxicity.fold("the trash can")) == 0.0
    assert lexicon.measure(toxicity.fold("Tr4sh, can")) == 0.0
    assert lexicon.measure(toxicity.fold("you trаsh")) > 0


def test_decontamination(spark, docs, empty, rows):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(rng.randrange(12, 50)))) for i in range(25)] + [(90, None), (91, ""), (92, "the of"), (None, "x " * 20)]
    texts = []
    for i, t in items[:25]:
        w = t.split()
        n, most = len(w), len(w) // 5
        edited = list(w)
        for _ in range(most // 2):
            k = rng.randrange(len(edited))
            edited[k] = "other"
        del edited[rng.randrange(len(edited))]
        texts += [(i, f"{sentence(rng, 30)} {t.upper()}! {sentence(rng, 20)}"), (100 + i, f"{sentence(rng, 9)} {' '.join(edited)}"), (200 + i, f"{sentence(rng, 20)} {' '.join(w[: n // 2])} {sentence(rng, 20)}")]
    texts += [(300, None), (301, ""), (302, "of the"), (None, items[0][1])]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contamination(frame, bench).collect()}

    def plain(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for a, x in enumerate(item, 1):
            new = [a]
            for b, y in enumerate(text, 1):
                new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (x != y)))
            row = new
        return min(row)

    want = {}
    for d, t in texts:
        for i, x in items:
            w = plain(x)
            if i is not None and len(w) >= 8 and (e := distance(w, plain(t))) <= len(w) // 5:
                want[d, i] = e
    assert got == want
    assert len(want) >= 40
    clean = {r["doc_id"] for r in decontamination.clean(frame, bench).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _ in want}
    assert decontamination.contamination(empty, bench).collect() == []
    assert decontamination.contamination(frame, bench.limit(0)).collect() == []
    assert decontamination.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_by_short_items(spark):
    rng = random.Random(16)
    items = [(n, [f"w{rng.randrange(6)}" for _ in range(n)]) for n in range(1, 8)] + [(10 + n, [f"v{n}x{k}" for k in range(n)]) for n in range(1, 8)]
    texts = [(i, [f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 25))]) for i in range(150)]
    for n, w in items:
        texts += [(1000 + 10 * n, w), (1001 + 10 * n, ["a", *w, "b"]), (1002 + 10 * n, ["a", *w[:-1]]), (1003 + 10 * n, [*w[: n % 10 // 2], "z", *w[n % 10 // 2 :]]), (1004 + 10 * n, ["q", *w[1:], "q"])]

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for a, x in enumerate(item, 1):
            new = [a]
            for b, y in enumerate(text, 1):
                new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (x != y)))
            row = new
        return min(row)

    want = {(d, i): e for d, t in texts for i, w in items if (e := distance(w, t)) <= len(w) // 5}
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontamination.contamination(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(got) == len(want)
    said = dict(texts)
    assert all(said[r["doc_id"]][r["start_word"] : r["end_word"]] == dict(items)[r["item_id"]] for r in got if r["edits"] == 0)
    assert {r["doc_id"] for r in decontamination.clean(frame, bench).collect()} == said.keys() - {d for d, _ in want}


def test_blocks_of_items_lose_none(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    items = [(i, " ".join(f"{'abcd'[j]}{i}x{k}" for k in range(10))) for i in (None, 1, 2, 3) for j in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(items)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(frame, bench).collect()}
    assert got == {(n, i) for n, (i, _) in enumerate(items)}
    assert decontamination.clean(frame, bench).count() == 0


def test_licenses(spark, empty):
    rng = random.Random(7)
    names = sorted(licenses.TEMPLATES)
    texts = [(i, f"{sentence(rng, rng.randrange(0, 60))}\n{licenses.TEMPLATES[n].upper() if i % 2 else licenses.TEMPLATES[n]} {sentence(rng, rng.randrange(0, 60))}") for i, n in enumerate(names)]
    texts += [(100 + i, sentence(rng, 200)) for i in range(10)] + [(200, None), (201, ""), (202, "MIT"), (203, "license " * 500), (None, licenses.TEMPLATES["MIT-line"])]
    frame = spark.createDataFrame(texts, "doc_id long, text string")

    def plain(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return [tuple(w[k : k + 3]) for k in range(len(w) - 2)]

    want = set()
    for d, t in texts:
        own = set(plain(t))
        for n in names:
            p = set(plain(licenses.TEMPLATES[n]))
            if len(p & own) >= 0.8 * len(p):
                want.add((d, n))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame).collect()}
    assert got == want
    assert {d for d, _ in got} == {*range(len(names)), None}
    assert licenses.scan(empty).collect() == []


def test_short_license_line(spark):
    rng = random.Random(9)
    line = "All rights reserved."
    texts = [(i, f"{sentence(rng, 3 * i)}\n{line if i % 2 else line.upper()}\n{sentence(rng, 120 - i)}") for i in range(60)]
    texts += [(100, line), (101, "all rights are reserved"), (102, "rights reserved")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got.keys() == {*range(60), 100}
    assert all(r["license"] == "all-rights-reserved-line" and r["containment"] == 1 for r in got.values())
    assert all(got[i]["first_word"] == len(re.findall(r"[^\W_]+", texts[i][1].split("\n")[0])) for i in range(60))


def test_short_licenses_at_every_place(spark):
    rng = random.Random(10)
    names = [n for n, t in sorted(licenses.TEMPLATES.items()) if len(re.findall(r"[^\W_]+", t)) <= 18]
    assert len(names) >= 7
    texts, want = [], set()
    for n in names:
        for i in range(400):
            words = licenses.TEMPLATES[n].split()
            texts.append((len(texts), f"{sentence(rng, 16 + i % 16)} {' '.join(words)} {sentence(rng, 24)}"))
            want.add((texts[-1][0], n))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame).collect()}
    assert want <= got
