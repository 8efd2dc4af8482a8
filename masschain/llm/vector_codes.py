"""Op 13: vector code compression, with a lexicographic trie over distinct parts.

A vector's components become integers and are cut into equal consecutive parts; each part
position has a codebook of entries, and a vector's code names the nearest entry of each
part. Within a task the distinct parts of a position stand in lexicographic order, which is
a trie: a node is a run of parts with a common prefix, and its children are the runs one
dimension longer. The walk goes depth first and carries, for the node, the distances so
far to all entries of the codebook; every part below shares them. Subtrees of few leaves are
finished level by level over arrays. Leaves take the nearest entry, and their sums, weighted
by how often the part occurs, move the entries.

Parts are never shuffled: each round is one pass over the vectors that sends `entries` small
sums a position and task. Codebooks (parts * entries * width numbers) are all that the driver sees.

Defined results: vectors that are null or hold null or non-finite components are dropped; so
are components that as integers leave a long, and vectors of another length than the most
common one (of equally common ones the longer). The length has to be a multiple of the number of
parts, else ValueError. With fewer rows than entries, codebooks are as small. Rows of equal id
follow each other by their vector, null ids come last; rows that repeat are coded each; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAVES = 4096  # subtrees of at most so many distinct parts are finished over arrays
ROWS = 1 << 15  # vectors in one trie
MOST_HOT = 1000  # labels that hold over 1 / MOST_HOT of all rows: fewer than so many


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of each of the lexicographically sorted parts.

    Ties go to the lower index. int64 (or object, if the numbers are too large for it) throughout.
    """
    n, width = parts.shape
    code, distance = np.zeros(n, np.int64), np.zeros(n, parts.dtype)
    # starts[k]: where the prefixes of k + 1 dimensions begin
    fresh, starts = np.zeros(n, bool), []
    fresh[:1] = True
    for k in range(width):
        fresh[1:] |= parts[1:, k] != parts[:-1, k]
        starts.append(np.flatnonzero(fresh))
    stack = [(0, n, 0, np.zeros(len(entries), parts.dtype))]
    while stack:
        low, high, depth, so_far = stack.pop()
        if high - low <= LEAVES or depth == width:
            sums, above = so_far[None, :], np.array([low])
            for k in range(depth, width):
                begin, end = np.searchsorted(starts[k], (low, high))
                nodes = starts[k][begin:end]
                parent = np.searchsorted(above, nodes, "right") - 1
                step = parts[nodes, k][:, None] - entries[None, :, k]
                sums, above = sums[parent] + step * step, nodes
            best = np.argmin(sums, axis=1)
            lengths = np.diff(np.append(above, high))
            code[low:high] = np.repeat(best, lengths)
            distance[low:high] = np.repeat(sums[np.arange(len(best)), best], lengths)
            continue
        begin, end = np.searchsorted(starts[depth], (low, high))
        nodes = np.append(starts[depth][begin:end], high)
        for a, b in zip(nodes[:-1][::-1], nodes[1:][::-1]):
            step = parts[a, depth] - entries[:, depth]
            stack.append((int(a), int(b), depth + 1, so_far + step * step))
    return code, distance


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and how often each occurs."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ranked = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    return ranked[first], place, np.diff(np.append(first, len(parts)))


def _wide(x: np.ndarray, books: np.ndarray) -> bool:
    """Whether distances or sums of a block could leave int64."""
    top = max((int(abs(int(v))) for a in (x, books) if a.size for v in (a.min(), a.max())), default=0)
    return (2 * top) ** 2 * max(x.shape[1], 1) >= 1 << 62 or top * max(len(x), 1) >= 1 << 62


def vectors(batches, column: str = "x", rows: int = ROWS):
    """Tables of about `rows` rows of a stream of record batches, and their vectors as a matrix."""
    held, count = [], 0

    def out():
        table = pa.Table.from_batches(held)
        lists = table.column(column).combine_chunks()
        return table, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield out()
            held, count = [], 0
    if held:
        yield out()
    common.give_back()


def _blocks(batches, books: np.ndarray):
    for table, x in vectors(batches):
        wide = _wide(x, books)
        shape = (len(x), len(books), x.shape[1] // len(books))
        yield table, (x.astype(object) if wide else x).reshape(shape), books.astype(object) if wide else books


def entry_sums(books: np.ndarray):
    """mapInArrow function: count and component sums of the parts that each entry is nearest to."""

    def run(batches):
        parts, size, width = books.shape
        total = np.zeros((parts, size, width), object)
        count = np.zeros((parts, size), np.int64)
        for _, x, entries in _blocks(batches, books):
            for p in range(parts):
                leaves, _, weight = distinct_parts(x[:, p, :])
                code, _ = nearest(leaves, entries[p])
                count[p] += np.bincount(code, weight, size).astype(np.int64)
                weighted = leaves * weight[:, None]
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                total[p, used] += np.add.reduceat(weighted[order], first, axis=0)
        p, e = np.nonzero(count)
        if len(p):
            sums = [[str(v) for v in total[i, j]] for i, j in zip(p, e)]
            yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "count": count[p, e], "sums": sums})

    return run


def codes(books: np.ndarray):
    """mapInArrow function: the code of each row and its error."""

    def run(batches):
        for table, x, entries in _blocks(batches, books):
            code, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), object)
            for p in range(len(books)):
                leaves, place, _ = distinct_parts(x[:, p, :])
                best, distance = nearest(leaves, entries[p])
                code[:, p] = best[place]
                error += distance[place]
            texts = code.tobytes().hex()
            step = 2 * code.shape[1]
            out = {"vec_id": table.column("vec_id"), "label": table.column("label"),
                   "code": [texts[i : i + step] for i in range(0, len(texts), step)], "error": pa.array([int(v) for v in error], pa.int64())}
            yield from pa.table(out).to_batches()

    return run


def integers(rows: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """rows with x, the floors of scale * component as array<bigint>, of those that have a vector of the common length."""
    scaled = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    # comparisons are null for null; NaN is above every number
    whole = F.coalesce(F.forall(F.col(vector), lambda c: F.abs(c.cast("double") * scale) < 2.0**62), F.lit(False))
    kept = rows.filter(whole)
    lengths = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return kept.filter(F.size(vector) == d).withColumn("x", scaled)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """[part, entry, position]: the parts of the rows of smallest ids."""
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    x = np.array([r["x"] for r in first], np.int64)
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components cannot be cut into {parts} equal parts")
    return x.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after so many rounds of assigning all rows' parts and taking floors of means."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        sent = rows.select("x").mapInArrow(entry_sums(books), "part int, entry int, count bigint, sums array<string>")
        each = sent.select("part", "entry", "count", F.posexplode("sums").alias("at", "sum"))
        moved = each.groupBy("part", "entry", "at").agg(F.sum("count").alias("count"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
        books = books.copy()
        for r in moved.collect():  # parts * entries * width rows at most
            books[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["count"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the errors summed over its label. Labels that hold many rows are few, and go to the rows; the others are joined by label."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("value"))
    coded = coded.withColumn("key", key)
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    rows = coded.count()
    hot = F.col("n") * MOST_HOT > rows  # fewer than MOST_HOT labels, whatever the table
    few = F.broadcast(sums.filter(hot).select("key", F.col("label_error").alias("of_hot")))
    near = coded.join(few, "key", "left")
    done = near.filter(F.col("of_hot").isNotNull()).withColumn("label_error", F.col("of_hot"))
    rest = near.filter(F.col("of_hot").isNull()).join(sums.filter(~hot).select("key", "label_error"), "key")
    return done.unionByName(rest.select(done.columns)).drop("key", "of_hot")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Code and errors of each row that has a vector; see the module for what is defined."""
    label = F.col("label").cast("long") if "label" in rows.columns else F.lit(None).cast("long")
    kept = integers(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding"), scale).drop("embedding")
    books = fit(kept, parts, entries, rounds)
    schema = "vec_id bigint, label bigint, code string, error bigint"
    if not books.shape[1]:
        coded = kept.sparkSession.createDataFrame([], schema)
    else:
        coded = common.scratch_table(kept.mapInArrow(codes(books), schema), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
