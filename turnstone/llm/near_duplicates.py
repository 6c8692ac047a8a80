"""Near duplicates by bottom-k sketches from one hash function.

A document's set: distinct hashes of 5-word shingles; its sketch: the least ``k`` of them. Documents of equal
sets are one class from the start. Of a pair with the threshold's similarity at least ``need(sketch)`` retained
values are shared (all but one pair in about a million at the threshold itself, and fewer above it; sets that fit
into their sketch are exact). So a pair that far alike shares one of the first ``size - need + 1``
retained values of each, rarest first: only these enter the inverted lists, and values that very many documents hold enter
none unless the rest of a document is as common. Lists join documents into clusters: an edge from each
member to the list's most central one, never all pairs. A cluster is dealt into blocks of bounded size, and
each pair of blocks is one group: there, the inverted lists of all retained values give overlaps, the sketch of the union estimates
the similarity, and pairs that may reach the threshold and aren't connected yet are compared on their full sets.
Confirmed links make components, found by alternating large-star and small-star steps on tables.

Null and empty texts have the empty set and stand alone. Rows without a key stand alone too (component null,
kept). Rows that share a key are one document to ``near_duplicates``; ``keep_one`` drops of them what is equal or alike only. Repeated
rows are repeated in the result. Very long texts are worked on in one piece of their own. An empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.arrays import U64, buffer_of, fold_ascii, mix, rolling, span_hashes, word_spans
from turnstone.llm.common import drop, only, release, sliced, written

SHINGLE = 5


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text behind the other, and the offsets of the texts.

    Words are folded in A-Z. A text of fewer words than ``size`` has its whole sequence as one shingle, a
    text without words has none.
    """
    data, offsets = buffer_of(column)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = span_hashes(fold_ascii(data), starts, ends)
    total = np.diff(first)
    hashes = rolling(words, size)
    doc = np.searchsorted(first[1:], np.arange(len(hashes)), "right")
    whole = np.arange(len(hashes)) + size <= first[doc + 1] if len(hashes) else np.zeros(0, bool)
    hashes, doc = hashes[whole], doc[whole]
    short = np.flatnonzero((total > 0) & (total < size))
    if len(short):
        extra = np.array([_sequence(words[first[d] : first[d + 1]]) for d in short.tolist()], np.uint64)
        hashes, doc = np.concatenate([hashes, extra]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(n + 1))


def _sequence(words: np.ndarray) -> int:
    h = U64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(np.array([h * U64(31) + w], np.uint64))[0]
    return int(h)


def need(size: int, k: int, similarity: float) -> int:
    """Retained values that two documents as alike as ``similarity`` share, for a sketch of ``size`` values.

    In a full sketch the number is binomial over k values; five standard deviations are taken off.
    """
    full = math.floor(k * similarity - 5.0 * math.sqrt(k * similarity * (1 - similarity)))
    return max(1, min(full, math.ceil(similarity * size)))


def sketches(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """key, n_shingles, f1 and f2 (fingerprint of the set), sketch (the least k hashes, ascending as unsigned numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            hashes, offsets = shingle_sets(batch.column(1))
            sizes = np.diff(offsets)
            f1, f2 = (np.zeros(len(hashes) + 1, np.uint64) for _ in range(2))
            np.cumsum(mix(hashes), out=f1[1:])
            np.cumsum(mix(hashes ^ U64(0xD6E8FEB86659FD93)), out=f2[1:])
            f1, f2 = (f[offsets[1:]] - f[offsets[:-1]] for f in (f1, f2))
            short = np.minimum(sizes, k)
            at = np.concatenate([[0], np.cumsum(short)])
            where = np.repeat(offsets[:-1] - at[:-1], short) + np.arange(at[-1])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes[where].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=[key, "n_shingles", "f1", "f2", "sketch"])

    rows = only(docs, key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_shingles long, f1 long, f2 long, sketch array<long>")


def candidate_lists(of: DataFrame, k: int, similarity: float) -> DataFrame:
    """(value, doc, weight): the rarest shared retained values of documents that share enough of them; weight: how common the sketch is."""
    entries = of.select("doc", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    least = F.array(*[F.lit(need(s, k, similarity)) for s in range(k + 1)])
    found = entries.join(shared, "value").groupBy("doc", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))  # at most k each
    found = found.withColumn("need", F.element_at(least, F.col("size") + 1)).filter("size(found) >= need")
    found = found.withColumn("weight", F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["df"]))
    return found.select("doc", "weight", F.explode(F.slice("found", 1, F.expr("size(found) - need + 1"))).alias("x")).select(F.col("x.value").alias("value"), "doc", "weight")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(doc, component) of all ends of the edges (a, b); component: the least document reachable."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join below is with a table of known size: broadcast while it's small, and between two shuffles that Spark
        # can split beyond that, for the centre of a star has as many edges as its component has documents.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = written(small, name)
        drop(edges)
        drop(least)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, counted along the inverted list of each value that two sets at least hold."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(begins, len(values)))
    out = np.zeros(n * n, np.int32)
    for size in np.unique(sizes[sizes > 1]).tolist():  # lists of one length are a table
        lists = owner[begins[sizes == size][:, None] + np.arange(size)]
        step = max(1, (1 << 18) // (size * size))
        for a in range(0, len(lists), step):
            part = lists[a : a + step]
            out += np.bincount((part[:, :, None] * n + part[:, None, :]).ravel(), minlength=n * n).astype(np.int32)
    return out.reshape(n, n)


def links_within(sets: list[np.ndarray], across: np.ndarray | None, k: int, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links between sorted sets: pairs whose similarity is at least ``percent`` hundredths.

    ``across``: block (0 or 1) of each set, if only pairs of two blocks count.
    """
    short = [s[:k] for s in sets]
    overlap = _overlaps(short)
    sizes = np.array([len(s) for s in short])
    least = np.array([need(s, k, percent / 100) for s in range(k + 1)])[sizes]
    likely = overlap >= np.maximum(least[:, None], least[None, :])
    likely &= np.triu(np.ones_like(likely), 1)
    if across is not None:
        likely &= across[:, None] != across[None, :]
    a, b = np.nonzero(likely)
    forest, out = Forest(len(sets)), []
    margin = 5.0 * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    for x in np.argsort(-overlap[a, b], kind="stable").tolist():
        i, j = int(a[x]), int(b[x])
        if forest.root(i) == forest.root(j):
            continue
        union = np.union1d(short[i], short[j])[:k]
        both = np.intersect1d(np.intersect1d(union, short[i], assume_unique=True), short[j], assume_unique=True)
        if len(both) < (percent / 100 - margin) * len(union):
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            forest.join(i, j)
            out.append((i, j))
    return out


#: Documents of one block of a cluster; a group has two blocks at most. Clusters of one block share groups of about twice as many documents.
BLOCK_ROWS = 256


def confirmed_links(docs: DataFrame, clusters: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): links that connect what similarities on full sets connect, within the clusters (doc, component)."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    # A cluster is told by a hash of its name: two that share one are compared together, which changes nothing but the work.
    members = clusters.join(sizes, "component").select("doc", F.xxhash64("component").alias("component"), blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            hashes, offsets = shingle_sets(batch.column(1))
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != 1), lists], names=["doc", "component", "blocks", "block", "shingles"])

    rows = only(docs, key, text).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    # The members grow with the corpus: the join is by sorting at every size, never a broadcast that a larger table loses.
    sets = rows.join(members.hint("merge"), "doc").mapInArrow(run, f"doc {kind}, component long, blocks int, block int, shingles array<long>")
    # A cluster of one block goes to one of many common groups, so that groups are many rows each, at every size of the corpus.
    common = max(64, clusters.count() // (2 * BLOCK_ROWS))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    )
    spread = sets.withColumn("x", F.explode(pairs)).select("doc", "component", "block", "shingles", "x.i", "x.j").withColumn("at", F.when(F.col("i") < 0, F.pmod(F.col("component"), F.lit(common)).cast("string")).otherwise(F.concat_ws("/", F.col("component").cast("string"), "i", "j")))

    def compare(group: pa.Table) -> pa.Table:
        a, b = [], []
        doc = group["doc"].to_pylist()
        component, block = group["component"].to_numpy(), group["block"].to_numpy()
        shingles = group["shingles"].combine_chunks()
        flat, at = shingles.flatten().to_numpy().view(np.uint64), shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
        two_blocks = group["i"][0].as_py() != group["j"][0].as_py() and group["i"][0].as_py() >= 0
        order = np.argsort(component, kind="stable")
        for rows_ in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            if len(rows_) > 1:
                own = [flat[at[r] : at[r + 1]] for r in rows_.tolist()]
                for i, j in links_within(own, block[rows_] if two_blocks else None, k, percent):
                    a.append(doc[rows_[i]])
                    b.append(doc[rows_[j]])
        return pa.table({"a": pa.array(a, group["doc"].type), "b": pa.array(b, group["doc"].type)})

    return spread.groupBy("at").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 96, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the least key reachable over links) and kept of every document."""
    spark = docs.sparkSession
    all_rows = written(sketches(docs, k, key, text), "sketches")
    keyed = all_rows.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    classes = written(keyed.groupBy("n_shingles", "f1", "f2").agg(F.min(key).alias("doc")), "classes")
    of = keyed.join(classes.select(F.col("doc").alias(key), "n_shingles", "f1", "f2"), [key, "n_shingles", "f1", "f2"], "left_semi").select(F.col(key).alias("doc"), "sketch")
    lists = written(candidate_lists(of, k, percent / 100), "lists")
    release(spark)
    centre = lists.groupBy("value").agg(F.max(F.struct("weight", (-F.xxhash64("doc")).alias("h"), "doc")).alias("c")).select("value", F.col("c.doc").alias("centre"))
    clusters = components(lists.join(centre, "value").select(F.col("doc").alias("a"), F.col("centre").alias("b")), "clusters")
    links = written(confirmed_links(docs, clusters, k, percent, key, text), "links")
    release(spark)
    # Documents of one key are one; their classes are linked through it.
    found = components(links.unionByName(_same_key(keyed, classes, key)), "components")
    classes = classes.join(found, "doc", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "doc").alias("component_id"))
    out = all_rows.select(key, "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col(key).isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(key)))


def _same_key(keyed: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Links between the classes of texts that share a key: none, where keys are unique."""
    several = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    rows = keyed.select(key, "n_shingles", "f1", "f2").join(several, key).join(classes, ["n_shingles", "f1", "f2"])
    return rows.select(F.col(key).alias("a"), F.col("doc").alias("b"))


def keep_one(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that are the least of their component.

    Of rows that share a key, each with another text is a document of its own (the texts' order by hash decides which is less), and
    equal rows are one; what differs in other columns only is one of them.
    """
    several = written(docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "several")
    if several.isEmpty():
        rejected = written(near_duplicates(docs, percent, key=key, text=text).filter("not kept").select(key).distinct(), "rejected")
        return docs.join(rejected.hint("merge"), key, "left_anti").select(docs.columns)
    own = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text")))
    marked = docs.select(own.alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    found = written(near_duplicates(marked, percent, key="_id", text="_text").filter("kept and _id is not null").select("_id").distinct(), "kept")
    once = marked.join(found.hint("merge"), "_id", "left_semi").groupBy("_id").agg(F.first("_row").alias("_row"))
    return once.select("_row.*").unionByName(marked.filter("_id is null").select("_row.*"))
