"""Quality rules: counts of every text, base rules, and robust multivariate outliers by group.

For each language and source the minimum-covariance-determinant estimate of location and scatter of the
transformed counts is found as by the fast algorithm of Rousseeuw and Van Driessen: many starts of a few rows each on a
bounded sample of the group (``start_rows`` rows by a hash), from which the ``finalists`` of least determinant go on; then concentration steps over all
rows of the group until no determinant falls any more; the least determinant wins; and one step of reweighting with all rows
within the 0.975 quantile. In a concentration step over all rows distances fall into fixed bins of a 64th of an octave: the h rows of least
distance are the bins up to the h-th row, of the last bin the share that is wanted. So a step is one aggregation by (group, bin), and a group that
holds a third of all rows is summed where its rows are.

A statistic that is nought almost everywhere has no scatter within the inner rows; so a small variance of its own (the square of
the figure in ``FEATURES``) is added to each, as in the regularised form of the estimate. Languages and the whole table have estimates of their own, made alike; those of a group are drawn to those of its
language, and these to those of all rows, by the weight of ``prior_rows`` rows: groups of any size have one, the small ones nearly their language's. Documents
whose squared Mahalanobis distance exceeds the ``quantile`` of chi-square with 5 degrees of freedom are rejected.

Null text counts as empty (no words: fails the base rules). Null languages and sources form groups of their own.
Repeated rows give repeated rows, an empty table none; very long texts are worked on in one piece of their own; the key may be null; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.arrays import SPACE, buffer_of, rolling, span_hashes, word_spans
from turnstone.llm.common import only, sliced, written

#: The characters that count as symbols, and the words of a repeated window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Transformed statistics and the least standard deviation each is given, so that statistics that are nought almost everywhere don't reject at the first count.
FEATURES = {
    "f_words": ("ln(1 + n_words)", 0.4),
    "f_length": ("word_chars / n_words", 0.4),
    "f_symbols": ("n_symbols / word_chars", 0.016),
    "f_lines": ("n_dup_lines / n_lines", 0.12),
    "f_repeats": ("n_repeat_words / n_words", 0.08),
}
NAMES = list(FEATURES)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi_square(x: float, more: int = 0) -> float:
    """Distribution function of chi-square with P + ``more`` degrees of freedom (odd)."""
    tail, term = 0.0, math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for n in range(1, P + more, 2):
        tail += term
        term *= x / (n + 2)
    return math.erf(math.sqrt(x / 2)) - tail


def chi_square_quantile(share: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the scatter of the inner share of normal rows is multiplied by to be that of all."""
    return share / chi_square(chi_square_quantile(share), 2)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column."""
    data, offsets = buffer_of(column)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    out = {"n_words": np.diff(first)}

    def per_document(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    out["word_chars"] = per_document(((data & 0xC0) != 0x80) & ~SPACE[data])
    out["n_symbols"] = per_document(is_symbol[data])

    # Lines: cut at line feeds and at the borders of texts.
    feeds = np.flatnonzero(data == 0x0A)
    line_at = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    line_doc = np.searchsorted(offsets[1:], line_at, "right")
    inside = line_doc < n
    line_at, line_doc = line_at[inside], line_doc[inside]
    line_end = np.minimum(np.append(line_at[1:], len(data)), offsets[line_doc + 1])
    fed = np.zeros(len(line_at), bool)
    if len(feeds) and len(line_at):
        fed = (line_end > line_at) & (data[np.maximum(line_end - 1, 0)] == 0x0A)
    line_end = line_end - fed
    words_to = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_at)
    has_word = words_to > 0
    line_at, line_end, line_doc = line_at[has_word], line_end[has_word], line_doc[has_word]
    hashes = span_hashes(data, line_at, line_end)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    order = np.lexsort((hashes, line_doc))
    again = (np.diff(line_doc[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])
    out["n_dup_lines"] = np.bincount(line_doc[order][1:][again], minlength=n)

    # Windows of words found twice or more in one text.
    repeated = np.zeros(n, np.int64)
    windows = rolling(span_hashes(data, starts, ends), WINDOW)
    if len(windows):
        doc = np.searchsorted(first[1:], np.arange(len(windows)), "right")
        whole = np.flatnonzero(np.arange(len(windows)) + WINDOW <= first[doc + 1])
        keys, doc = windows[whole], doc[whole]
        order = np.lexsort((keys, doc))
        same = (keys[order][1:] == keys[order][:-1]) & (np.diff(doc[order]) == 0)
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = whole[twice]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        repeated = covered[first[1:]] - covered[first[:-1]]
    out["n_repeat_words"] = repeated
    return out


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """key, the group columns and the counts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=[key, *by, *COUNTS])

    rows = only(docs, key, text, *by)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *by)]
    return rows.mapInArrow(run, ", ".join([*kinds, *[f"{c} long" for c in COUNTS]]))


#: The variances that are added to the statistics' own.
LEAST = np.diag([FEATURES[f][1] ** 2 for f in NAMES])


def concentrated(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray, h: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """One concentration step: location and scatter of the h rows nearest by the present ones."""
    off = x - mean
    near = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off), kind="stable")[:h]
    inner = x[near]
    return inner.mean(0), np.cov(inner, rowvar=False, bias=True).reshape(P, P) * factor + LEAST


def candidates(x: np.ndarray, share: float, starts: int, finalists: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Estimates of least determinant from many starts of P + 1 rows: two steps each, the ten best on to the end, the ``finalists`` that differ."""
    n = len(x)
    h, factor = max(1, math.ceil(share * n)), consistency(share)
    tried = []
    for _ in range(starts):
        few = x[rng.choice(n, min(n, P + 1), replace=False)]
        mean, scatter = few.mean(0), np.cov(few, rowvar=False, bias=True).reshape(P, P) + LEAST if len(few) > 1 else LEAST
        for _ in range(2):
            mean, scatter = concentrated(x, mean, scatter, h, factor)
        tried.append((np.linalg.slogdet(scatter)[1], mean, scatter))
    best = []
    for size, mean, scatter in sorted(tried, key=lambda t: t[0])[:10]:
        for _ in range(50):
            mean, scatter = concentrated(x, mean, scatter, h, factor)
            was, size = size, np.linalg.slogdet(scatter)[1]
            if was - size < 1e-9:
                break
        best.append((size, mean, scatter))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, mean, scatter in sorted(best, key=lambda t: t[0]):
        if len(out) < finalists and not any(np.allclose(mean, m) and np.allclose(scatter, s) for m, s in out):
            out.append((mean, scatter))
    return out


_SUMS = [*[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS]]
_ESTIMATE = [*[f"c{i}" for i in range(P)], *[f"v{i}_{j}" for i, j in PAIRS]]
_INVERSE = [f"a{i}_{j}" for i, j in PAIRS]


def _moments(n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and scatters (without factor) from numbers, sums and sums of products: a row for each estimate."""
    mean = sums[:, :P] / n[:, None]
    scatter = np.zeros((len(n), P, P))
    for k, (i, j) in enumerate(PAIRS):
        scatter[:, i, j] = scatter[:, j, i] = sums[:, P + k] / n - mean[:, i] * mean[:, j]
    return mean, scatter


def _row(mean: np.ndarray, scatter: np.ndarray) -> list[float]:
    return [*mean.tolist(), *[float(scatter[i, j]) for i, j in PAIRS]]


def _matrices(rows: pd.DataFrame, prefix: str = "v") -> np.ndarray:
    out = np.zeros((len(rows), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = rows[f"{prefix}{i}_{j}"].to_numpy(np.float64)
    return out


#: Cells whose estimates are broadcast.
MOST_BROADCAST = 50_000


def robust_outliers(stats: DataFrame, key: str = "doc_id", by: tuple[str, ...] = ("lang", "source"), share: float = 0.75, starts: int = 60, start_rows: int = 600, finalists: int = 2, most_steps: int = 20, prior_rows: int = 50) -> DataFrame:
    """``stats`` (rows with words) with ``distance2``: squared robust Mahalanobis distance in the group."""
    features = stats
    for name, (expression, _) in FEATURES.items():
        features = features.withColumn(name, F.expr(expression).cast("double"))
    language, source = by
    group = F.to_json(F.struct(F.col(language).alias("a"), F.col(source).alias("b")))
    features = written(features.withColumns({"_group": group, "_language": F.to_json(F.struct(F.col(language).alias("a")))}), "features")
    # A cell is a group, a language or all rows; each row takes part in one of each kind.
    cells = lambda *more: features.select(F.explode(F.array("_group", "_language", F.lit("all"))).alias("_cell"), *more, *NAMES)
    sizes = written(cells().groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    # A row for each cell, of at most some hundred bytes: broadcast while that is 20 MB or less, so that no cell's rows are dealt to one task.
    few = sizes.count() <= MOST_BROADCAST
    side = lambda rows: F.broadcast(rows) if few else rows

    def begin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(NAMES)[NAMES].to_numpy(np.float64)
        found = candidates(x, share, starts, finalists, np.random.default_rng(len(x)))
        return pd.DataFrame([[key[0], k, 0.0, math.inf, *_row(m, s)] for k, (m, s) in enumerate(found)], columns=["_cell", "nth", "size", "was", *_ESTIMATE])

    def step(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy(np.float64)
        h = max(1.0, math.ceil(share * n.sum()))
        upto = np.cumsum(n)
        part = np.clip((h - (upto - n)) / n, 0.0, 1.0)  # of each bin
        mean, scatter = _moments(np.array([h]), (bins[_SUMS].to_numpy(np.float64) * part[:, None]).sum(0)[None])
        scatter = scatter[0] * consistency(share) + LEAST
        return pd.DataFrame([[key[0], key[1], np.linalg.slogdet(scatter)[1], float(bins["size"].iloc[0]), *_row(mean[0], scatter)]], columns=["_cell", "nth", "size", "was", *_ESTIMATE])

    def inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            inverse = np.linalg.inv(_matrices(rows)) if len(rows) else np.zeros((0, P, P))
            yield rows.assign(**{f"a{i}_{j}": inverse[:, i, j] for i, j in PAIRS})

    estimate_type = ", ".join(["_cell string", "nth int", "size double", "was double", *[f"{c} double" for c in _ESTIMATE]])
    inverse_type = ", ".join([estimate_type, *[f"{c} double" for c in _INVERSE]])
    offset = [F.col(f) - F.col(f"c{i}") for i, f in enumerate(NAMES)]
    distance = sum(((1 if i == j else 2) * F.col(f"a{i}_{j}") * offset[i] * offset[j] for i, j in PAIRS), F.lit(0.0))
    sums = [*[F.sum(f).alias(f"s{i}") for i, f in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}_{j}") for i, j in PAIRS]]

    # Cells of at most ``start_rows`` rows are taken whole here, larger ones by a hash of key and counts.
    chance = F.pmod(F.xxhash64(key, *COUNTS), F.lit(1 << 30)) / float(1 << 30)
    sample = cells(chance.alias("_chance")).join(side(sizes), "_cell").filter(F.col("_chance") * F.col("_n") < start_rows).select("_cell", *NAMES)
    params = written(sample.groupBy("_cell").applyInPandas(begin, estimate_type).mapInPandas(inverted, inverse_type), "estimates")
    for _ in range(most_steps):
        binned = cells().join(side(params), "_cell").withColumn("bin", F.floor(F.log2(F.greatest(distance, F.lit(1e-12))) * 64).cast("int"))
        found = binned.groupBy("_cell", "nth", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), *sums)
        params = written(found.groupBy("_cell", "nth").applyInPandas(step, estimate_type).mapInPandas(inverted, inverse_type), "estimates")
        if not params.filter("was = 0 or abs(was - size) > 1e-3").limit(1).count():
            break
    best = params.groupBy("_cell").agg(F.min_by(F.struct(*[c for c in params.columns if c != "_cell"]), "size").alias("p")).select("_cell", "p.*")

    # Reweighted: all rows within the 0.975 quantile. Then groups are drawn to their language, and languages to all.
    near = written(cells().join(side(best), "_cell").filter(distance <= chi_square_quantile(0.975)).groupBy("_cell").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "reweighted")
    of = lambda cell, prefix: near.select(F.col("_cell").alias(cell), *[F.col(c).alias(f"{prefix}{c}") for c in ("n", *_SUMS)])
    levels = features.select("_group", "_language", F.lit("all").alias("_all")).distinct().join(of("_group", ""), "_group").join(of("_language", "l_"), "_language").join(of("_all", "t_"), "_all")

    def shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = consistency(0.975)
        for rows in batches:
            mean = scatter = None
            for prefix in ("t_", "l_", ""):
                n = rows[f"{prefix}n"].to_numpy(np.float64)
                m, s = _moments(n, rows[[f"{prefix}{c}" for c in _SUMS]].to_numpy(np.float64))
                s = s * factor
                if mean is not None:
                    own = (n / (n + prior_rows))[:, None]
                    m, s = own * m + (1 - own) * mean, own[:, :, None] * s + (1 - own[:, :, None]) * scatter
                mean, scatter = m, s
            inverse = np.linalg.inv(scatter + LEAST) if len(rows) else np.zeros((0, P, P))
            yield pd.DataFrame({"_group": rows["_group"], **{f"c{i}": mean[:, i] for i in range(P)}, **{f"a{i}_{j}": inverse[:, i, j] for i, j in PAIRS}})

    final = written(levels.mapInPandas(shrunk, ", ".join(["_group string", *[f"c{i} double" for i in range(P)], *[f"{c} double" for c in _INVERSE]])), "estimates")
    return features.join(side(final), "_group", "left").withColumn("distance2", distance).drop("_group", "_language", *NAMES, *[f"c{i}" for i in range(P)], *_INVERSE)


def quality(docs: DataFrame, quantile: float = 0.9999, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """key, the counts, base_failed, distance2 and kept of every document."""
    all_rows = written(statistics(docs, key, text, by).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "counts")
    judged = robust_outliers(all_rows.filter("not base_failed"), key, by)
    failed = all_rows.filter("base_failed").withColumn("distance2", F.lit(None).cast("double"))
    out = judged.unionByName(failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= chi_square_quantile(quantile)))
