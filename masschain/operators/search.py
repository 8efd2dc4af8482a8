"""Exact nearest neighbours of a stated set of query vectors, in one pass over the table for many queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 512  # query vectors that a task holds against ROWS rows at once, so that its memory follows neither the table nor the batches
ROWS = 1024
PASS = 32_768  # query vectors that one pass over the table serves; they go out as a broadcast of so many rows at most
SAMPLE = 20_000  # rows, about, that give each query a first bound on its k-th similarity
QUERY_EVERY = 50


def _unit(vectors) -> np.ndarray:
    rows = np.array(list(vectors), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _nearest(shared, k: int):
    """Per task, the k nearest rows it has seen for each query, but those below the query's bound."""

    def nearest(batches):
        ids, vectors, bound = shared.value
        best = [(np.zeros((min(BLOCK, len(ids) - at), 0)), np.zeros((min(BLOCK, len(ids) - at), 0), np.int64)) for at in range(0, len(ids), BLOCK)]
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf[at : at + ROWS]
                rows, own = _unit(some["embedding"]), some["vec_id"].to_numpy()
                for i, (score_so_far, id_so_far) in enumerate(best):
                    part = slice(i * BLOCK, (i + 1) * BLOCK)
                    score = np.round(vectors[part] @ rows.T, 6)
                    score[ids[part][:, None] == own[None, :]] = -np.inf
                    least = bound[part] if score_so_far.shape[1] < k else np.maximum(bound[part], score_so_far[:, -1])
                    score[score < least[:, None]] = -np.inf
                    met = np.flatnonzero(np.isfinite(score).any(axis=0))  # rows that are near to no query of the block are not sorted
                    if not len(met) and score_so_far.shape[1] == k:
                        continue
                    score, named = np.hstack([score_so_far, score[:, met]]), np.hstack([id_so_far, np.broadcast_to(own[met], (len(score), len(met)))])
                    order = np.lexsort((named, -score), axis=1)[:, :k]
                    best[i] = np.take_along_axis(score, order, 1), np.take_along_axis(named, order, 1)
        for i, (score, named) in enumerate(best):
            if score.shape[1]:
                out = pd.DataFrame({"query_id": np.repeat(ids[i * BLOCK : i * BLOCK + len(score)], score.shape[1]), "vec_id": named.reshape(-1), "similarity": score.reshape(-1)})
                yield out[np.isfinite(out["similarity"])]

    return nearest


_FOUND = "query_id long, vec_id long, similarity double"


def nearest_k(vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, place (1 to k), vec_id, similarity (cosine, 6 digits) for every row whose id is divisible by
    QUERY_EVERY, against all other rows. k lies in 1..50.

    PASS queries go out at a time, whatever their number. A sample of rows bounds each query's k-th
    similarity from below first, so that tasks send on few rows beyond the k that count; the result
    is exact. Defined results: rows with a null id or vector take no part; a vector of zeros
    has similarity 0 to all; equal similarities go by id; rows that repeat an id count each.
    """
    if not 1 <= k <= 50:
        raise ValueError("k lies in 1..50")
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    queries = rows.filter(F.col("vec_id") % QUERY_EVERY == 0)
    total, n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % QUERY_EVERY == 0, 1))).first()
    passes = max(1, -(-n // PASS))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, total // SAMPLE))) == 0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    found = None
    for number in range(passes):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).toPandas()
        ids, unit, bound = part["vec_id"].to_numpy(np.int64), _unit(part["embedding"]), np.full(len(part), -np.inf)
        if total > SAMPLE:
            first = sample.mapInPandas(_nearest(spark.sparkContext.broadcast((ids, unit, bound)), k), _FOUND).withColumn("place", place).filter(F.col("place") == k)
            known = dict(first.select("query_id", "similarity").collect())  # a row for each query of the pass at most
            bound = np.array([known.get(i, -np.inf) for i in ids.tolist()])
        near = rows.mapInPandas(_nearest(spark.sparkContext.broadcast((ids, unit, bound)), k), _FOUND)
        found = near if found is None else found.unionByName(near)
    return found.withColumn("place", place).filter(F.col("place") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"nearest_k": query}
ORACLE = {
    "nearest_k": """SELECT query_id, CAST(place AS INT) AS place, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
        SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id) s) p WHERE place <= 10"""
}
