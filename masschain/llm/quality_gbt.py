"""Op 9: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics come from the text alone. Features are cut into at most BINS bins at quantiles
of the training rows; trees grow level by level on bin histograms of gradients, under
logistic loss. A fitted model is a few arrays (feature, threshold, value per node, heaps of
equal depth), so scoring walks all rows through all trees by array look-ups.

Training takes labelled rows outside the held-out split, at most `most_rows` of them
(those of the smallest seeded hash of their id): a documented bound, and the only sample.

Defined results: null and empty texts have statistics of 0 and get the score that goes
with these; labels that are null, not 0 or 1, or of no document are ignored; a label that
repeats counts each time; without labels, or with one kind only, the score is the smoothed
share of label 1; rows that repeat are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_WEIGHT = 64, 60, 4, 0.2, 4.0
THRESHOLD = 0.7

_CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 symbol, 7 beyond ASCII
for _i, _chars in enumerate((common.LOWER, common.UPPER, "0123456789", " \t\r\x0b\x0c", "\n", ".,;:!?'\"-()", "#*$%&|<>@=+/\\_~^`{}[]")):
    _CLASS[[ord(c) for c in _chars]] = _i
FEATURES = [
    "log_words", "mean_word", "long_words", "lower", "upper", "digit", "line_end", "sentence_mark", "symbol", "beyond",
    "distinct_words", "top_word", "repeat_next", "lines_per_word", "repeated_lines", "pipes", "hashes_stars", "exclaims", "words_with_digit", "upper_words", "symbol_words", "short_words",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a buffer."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(rows), sizes)
    out = np.zeros((rows, len(FEATURES)))
    per_char = np.maximum(sizes, 1)
    kinds = _CLASS[data]
    counts = np.bincount(owner * 8 + kinds, minlength=rows * 8).reshape(rows, 8)
    start, end, row = common.word_spans(data, offsets)
    n = np.bincount(row, minlength=rows)
    per_word = np.maximum(n, 1)
    length = end - start
    share = lambda mask, of=None: np.bincount(row if of is None else of, weights=mask, minlength=rows) / per_word
    out[:, 0] = np.log1p(n)
    out[:, 1] = share(length)
    out[:, 2] = share(length > 15)
    for i, k in enumerate((0, 1, 2, 4, 5, 6, 7)):
        out[:, 3 + i] = counts[:, k] / per_char
    if len(start):
        hashes = common.span_hash(common.prefix_hash(data), start, end)
        order = np.lexsort((hashes, row))
        new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1]))
        first = np.flatnonzero(new)
        runs, of = np.diff(np.append(first, len(order))), row[order][first]
        out[:, 10] = np.bincount(of, minlength=rows) / per_word
        top = np.zeros(rows)
        np.maximum.at(top, of, runs)
        out[:, 11] = top / per_word
        out[:, 12] = share((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), row[1:])
        has = lambda k: np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[np.stack([start, end])], axis=0)[0]
        out[:, 18] = share(has(2) > 0)
        out[:, 19] = share(has(1) * 2 > length)
        out[:, 20] = share(has(6) > 0)
        out[:, 21] = share(length <= 2)
    # lines, as spans between line ends
    ends = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([offsets[:-1], ends + 1]))
    cut = cut[cut < len(data)]
    if len(cut):
        stop = np.minimum(np.append(cut[1:], len(data)), offsets[np.searchsorted(offsets, cut, "right")])
        of = np.searchsorted(offsets, cut, "right") - 1
        lines = common.span_hash(common.prefix_hash(data), cut, stop)
        order = np.lexsort((lines, of))
        same = (lines[order][1:] == lines[order][:-1]) & (of[order][1:] == of[order][:-1]) & ((stop - cut)[order][1:] > 5)
        n_lines = np.bincount(of, minlength=rows)
        out[:, 13] = n_lines / per_word
        out[:, 14] = np.bincount(of[order][1:][same], minlength=rows) / np.maximum(n_lines, 1)
    for i, marks in enumerate((b"|", b"#*", b"!")):
        out[:, 15 + i] = np.bincount(owner, weights=np.isin(data, list(marks)), minlength=rows) / per_char
    return out


@dataclass
class Model:
    """start: log-odds before any tree; feature, threshold: (trees, 2^depth - 1); value: (trees, 2^depth)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model:
    inner = 2**depth - 1
    p = (y.sum() + 1) / (len(y) + 2)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    model = Model(math.log(p / (1 - p)), feature, threshold, value)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    total = np.full(len(y), model.start)
    n_features = x.shape[1]
    for t in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)  # in its level
        for level in range(depth):
            width = 2**level
            cell = ((node[:, None] * n_features + np.arange(n_features)) * BINS + binned).reshape(-1)
            shape = (width, n_features, BINS)
            g = np.bincount(cell, weights=np.repeat(grad, n_features), minlength=np.prod(shape)).reshape(shape).cumsum(2)
            h = np.bincount(cell, weights=np.repeat(hess, n_features), minlength=np.prod(shape)).reshape(shape).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
            gain[(h < LEAST_WEIGHT) | (ht - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // BINS, best % BINS
            at = np.arange(width) + width - 1
            feature[t, at] = f
            threshold[t, at] = [edges[j][k] if u and k < len(edges[j]) else np.inf for j, k, u in zip(f, b, useful, strict=True)]
            node = 2 * node + (x[np.arange(len(y)), f[node]] > threshold[t, at][node])
        g, h = np.bincount(node, weights=grad, minlength=inner + 1), np.bincount(node, weights=hess, minlength=inner + 1)
        value[t] = rate * g / (h + 1)
        total += value[t][node]
    return model


def _statistics(batches):
    for batch in common.slices(batches, "text"):
        x = statistics(*common.utf8_buffer(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "rank")), lists], names=["doc_id", "quality", "rank", "x"])


def training_rows(docs: DataFrame, labels: DataFrame, held_out, most_rows: int) -> DataFrame:
    """quality and x of at most `most_rows` labelled documents outside the held-out split.

    Where ids repeat and there are more rows, one document of each id and label comes
    first, then others by a seeded hash, rows that repeat one another last.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out)
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "quality").limit(most_rows)
    )
    # most_rows ids at most, but any number of documents
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    ranked = rows.select("doc_id", "text", "quality", F.xxhash64("doc_id", "text", "quality", F.lit(5)).alias("rank"))
    found = ranked.mapInArrow(_statistics, "doc_id long, quality int, rank long, x array<double>")
    # rows that repeat are one row with their number, so that no task holds all rows of an id
    equal = common.checkpointed(found.groupBy("doc_id", "quality", "rank").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")))
    first = equal.groupBy("doc_id", "quality").agg(F.min("rank").alias("first"))
    copies = equal.join(F.broadcast(first), ["doc_id", "quality"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(most_rows)).cast("int"))))
    later = ((F.col("rank") != F.col("first")) | (F.col("copy") > 1)).cast("int")
    return copies.orderBy(later, "copy", "rank", "doc_id", "quality").limit(most_rows).select("quality", "x")


def trained(docs: DataFrame, labels: DataFrame, held_out, most_rows: int = MOST_ROWS) -> Model:
    """A model from at most `most_rows` labelled documents outside the held-out split."""
    found = training_rows(docs, labels, held_out, most_rows).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    y = found["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the sums do not depend on the rows' order then
    return fit(x[order], y[order])


def _scores(model):
    def scores(batches):
        for batch in common.slices(batches, "text"):
            p = model.value.score(statistics(*common.utf8_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"])

    return scores


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.remainder(F.col("doc_id"), 4) == 2
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    scored = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
