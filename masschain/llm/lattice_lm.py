"""Op 1: language-model scores by subword lattice likelihood.

A word's probability is the sum, over all its segmentations into pieces of an existing
vocabulary, of the product of piece probabilities, by a forward recursion in log space.
A text is its lower-cased words, each led by the word mark, then one end; its probability
is the product. Pieces never hold white space beyond the leading mark, so the lattice of
a text splits at words.

Piece probabilities start from the vocabulary's own scores (taken as ranks, weight
1/(rank+10)) and are fitted by one round of expected counts over the training texts'
words, kept at PRIOR of the old ones. The pieces stay as they are.

Spark's part: texts are dealt to blocks of about BLOCK_BYTES; a block sends each of its
distinct words once, so no word is hot. Words are counted and scored once in the whole
corpus, joined back to the blocks that hold them, and met there with the texts. What
goes to the driver is bounded by the vocabulary.

Defined results: null and empty texts have no words and score their end alone; a null id
counts as the empty text in the split (and so trains); repeated rows count each; with
no training texts all counts are 0; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, trie

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 12 << 20
MOST_WORDS = 200_000  # distinct words that a task holds before it sends them on
PRIOR = 1e-3
CODE_POINTS = 0x110000


def _count_words(batches):
    """(block, word, training count) for the distinct words of each block in this partition."""

    def out(counts):
        for block, (train, all_) in counts.items():
            words = list(all_)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block, np.int32)), pa.array(part, pa.binary()), pa.array([train.get(w, 0) for w in part], pa.int64())],
                    names=["block", "word", "n"],
                )

    counts: dict[int, tuple[Counter, dict]] = {}
    for batch in common.slices(batches, "text"):
        for text, block, held in zip(batch.column("text").to_pylist(), batch.column("block").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            words = (text or "").encode().lower().split()
            train, all_ = counts.setdefault(block, (Counter(), {}))
            if not held:
                train.update(words)
            all_.update(dict.fromkeys(words))
        if sum(len(a) for _, a in counts.values()) > MOST_WORDS:
            yield from out(counts)
            counts = {}
    yield from out(counts)


def _word_matrices(column):
    """The words of a column as matrices, each led by a space."""
    cells, at = trie.led_by_space(*common.utf8_buffer(column))
    return trie.by_length(cells, at[:-1], np.diff(at))


def _expected(lattice):
    def expected(batches):
        total = np.zeros(len(lattice.value.scores))
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            for own, rows, lengths in _word_matrices(batch.column("word")):
                total += lattice.value.expected(rows, lengths, n[own])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    return expected


def _marginals(lattice):
    def marginals(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for own, rows, lengths in _word_matrices(batch.column("word")):
                score[own] = lattice.value.marginal(rows, lengths)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(score / math.log(10))], names=["word", "n", "score"])

    return marginals


def _score_block(unit: float, end_count: int, end_score: float):
    """unit: log10 of the base model's denominator."""

    def score_block(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        place = {w: i for i, w in enumerate(words["word"])}
        n = words["n"].to_numpy(np.int64)
        base, score, known = np.log10(n + 1.0) - unit, words["score"].to_numpy(float), n > 0
        rows = []
        for text in docs["text"]:
            at = np.fromiter(map(place.__getitem__, (text or "").encode().lower().split()), np.int64)
            rows.append((len(at) + 1, int(known[at].sum()) + (end_count > 0), float(base[at].sum() + math.log10(end_count + 1) - unit), float(score[at].sum() + end_score)))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score"], index=docs.index)
        return pd.concat([docs[["doc_id", "held_out"]], out], axis=1)

    return score_block


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    held_out = common.remainder(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    size, n_train = marked.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    n_blocks = max(1, -(-int(size or 0) // BLOCK_BYTES))
    blocks = marked.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    # the texts move once here and once to meet their words, each time to as many tasks as there are blocks or fewer
    held = common.scratch_table(blocks.repartition(max(n_blocks, 2), "block").mapInArrow(_count_words, "block int, word binary, n long"), "words")
    totals = common.scratch_table(held.groupBy("word").agg(F.sum("n").alias("n")), "totals")
    n_words, distinct = totals.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    train_tokens, distinct = int(n_words or 0) + n_train, distinct + (n_train > 0)

    v = trie.load_vocabulary(vocabulary)
    weight = 1 / (10 - np.minimum(v.scores, 0))
    prior = np.zeros(len(v.pieces) + 2)  # the last two: characters without a piece, and the end
    prior[v.normal] = weight[v.normal]
    prior[-2:] = prior.max(), prior.sum() / 100
    prior /= prior.sum()
    lattice = spark.sparkContext.broadcast(_lattice(v, prior))  # the size of the vocabulary
    counts = np.zeros(len(prior))
    fitted = totals.filter("n > 0").mapInArrow(_expected(lattice), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    for r in fitted.collect():  # a row for each piece at most
        counts[r["piece"]] = r["n"]
    counts[-1] = n_train
    total = counts.sum()
    fitted_p = (counts + PRIOR * max(total, 1) * prior) / (total + PRIOR * max(total, 1))
    lattice = spark.sparkContext.broadcast(_lattice(v, fitted_p))
    scored = totals.mapInArrow(_marginals(lattice), "word binary, n long, score double")
    known = held.select("block", "word").distinct().join(scored, "word").select("block", "word", "n", "score")
    unit = math.log10(train_tokens + distinct + 1)
    met = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        _score_block(unit, n_train, math.log10(fitted_p[-1])),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return met.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _lattice(v: trie.Vocabulary, p: np.ndarray) -> trie.Lattice:
    with np.errstate(divide="ignore"):
        return trie.Lattice(v, np.log(p[:-2]), math.log(p[-2]) - math.log(CODE_POINTS))


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(common.documents(spark, sf_dir))
