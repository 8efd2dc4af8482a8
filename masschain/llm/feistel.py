"""Op 3: sharding by a Feistel permutation of global row numbers.

Rows get gapless global numbers 0..n-1 without a global sort: a row falls into a
bucket by a hash of its whole content, buckets are numbered by a prefix sum over their
counts, and rows within a bucket by a window. The permutation works on an a x b grid
with a*b just above n: a number is a pair (high, low), each round adds a keyed hash of
one half to the other, modulo its side. A result of n or more is permuted again (cycle
walking) until it is below n, which keeps the map a bijection of 0..n-1. Shard and slot
follow from the permuted number by one division, so they can be computed for any row
number alone.

Defined results: a null text counts as empty; null ids are numbered like others; repeated
rows get one place each; an empty table gives an empty result; other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ROUNDS = 6
ROWS_PER_BUCKET, MOST_BUCKETS = 20_000, 1 << 16


def permute_once(x: Column, high: Column, low: Column, seed: Column) -> Column:
    """One pass of the network over numbers below high*low."""
    pair = F.struct((x / low).cast("long").alias("l"), (x % low).alias("r"))
    for k in range(ROUNDS):
        pair = _round(pair, k, high, low, seed)
    return F.element_at(F.transform(F.array(pair), lambda p: p["l"] * low + p["r"]), 1)


def _round(pair: Column, k: int, high: Column, low: Column, seed: Column) -> Column:
    def step(p: Column) -> Column:
        left, right = p["l"], p["r"]
        if k % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(left, seed, F.lit(k)), low), low)
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(right, seed, F.lit(k)), high), high)
        return F.struct(left.alias("l"), right.alias("r"))

    # transform over one element binds the pair to a variable, so that it is evaluated once
    return F.element_at(F.transform(F.array(pair), step), 1)


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """The place of number x < n in a seeded permutation of 0..n-1.

    Outside [0, n) lie at most 2*sqrt(n)+1 of the grid's numbers, so a walk has at most
    so many steps; for large n, 40 steps leave a chance below 1e-60 a row, and a
    walk not ended by then raises an error rather than give a wrong place.
    """
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    low = F.ceil(n / high).cast("long")
    first = permute_once(x, high, low, seed)
    steps = F.least(high * low - n + F.lit(1), F.lit(40)).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(1), steps), first,
        lambda at, _: F.when(at < n, at).otherwise(permute_once(at, high, low, seed)),
    )
    walked = F.transform(
        F.array(first), lambda p: F.when(p < n, p).otherwise(walk)
    )
    return F.element_at(F.transform(walked, lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))), 1)


def row_numbers(df: DataFrame, content: list[Column], order: list[Column]) -> tuple[DataFrame, int]:
    """df with column row_no, 0 to n-1, and n. The numbers depend on content alone."""
    n = df.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(*content), F.lit(buckets)).cast("int"))
    # at most MOST_BUCKETS rows
    offsets = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).select(
        "__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__offset")
    )
    within = Window.partitionBy("__bucket").orderBy(*order)
    numbered = keyed.withColumn("__at", F.row_number().over(within))
    return (
        numbered.join(F.broadcast(offsets), "__bucket")
        .withColumn("row_no", F.col("__offset") + F.col("__at") - 1)
        .drop("__bucket", "__offset", "__at"),
        n,
    )


def shard_rows(df: DataFrame, content: list[str], n_shards: int = 8, seed: int = 17) -> DataFrame:
    """df with row_no, shard (0 to n_shards-1) and slot (gapless in its shard).

    Counts of shards differ by one at most.
    """
    cols = [F.col(f"`{c}`") for c in content]
    numbered, n = row_numbers(df.drop("row_no", "shard", "slot"), cols, [F.xxhash64(*cols), *cols])
    place = permuted(F.col("row_no"), F.lit(max(n, 1)).cast("long"), F.lit(seed).cast("long"))
    return (
        numbered.withColumn("__place", place)
        .withColumn("shard", (F.col("__place") % n_shards).cast("int"))
        .withColumn("slot", F.floor(F.col("__place") / n_shards).cast("long"))
        .drop("__place")
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    )
    return shard_rows(narrow, ["doc_id", "content"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
