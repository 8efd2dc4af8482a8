"""Op 8: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents stand in a seeded order on a line of tokens, cut into blocks of
equal size, which are dealt to shards in turn. The mix is a number of blocks. They go to
sources one by one by the highest quotient target / (2 * blocks so far + 1), at most three
times a source's own blocks; the count of quotients above a level gives all but the last
few at once. A source's blocks go to its shards by the same rule, with its blocks in each
shard as the targets. A shard's quota of a source is so many whole passes over the
source's blocks in it and, of one more pass, those that come first in a seeded Feistel
permutation.

A document's place on the line comes from sums over buckets of its seeded hash (at most
BUCKETS a source) and a window within a bucket, so that a source with a third of all rows
is dealt over many tasks. Tables by source have a row for each source.

Defined results: null is a source of its own, last in order; a null or empty text has
size 0 and is taken 0 times; rows that repeat are each a document, in the order of their
content; a source of size 0 has target 0; an empty table gives an empty result; columns
named like the results are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, feistel

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
BLOCKS_OF_LEAST = 400  # blocks in the smallest target
SMALLEST_BLOCK = 8
BUCKETS = 1024
SHARDS = 8


def source_key(source: Column) -> Column:
    """The source as a key that keeps null apart and last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (key, source_size) with weight and target.

    Shares that exceed MOST_PASSES times a source's size stop there and the rest goes to
    the others by weight, until none does: in the order of size / weight, a source is
    capped if its cap is below its share of what the sources before it leave.
    """
    by_key, everything = Window.orderBy("key"), Window.orderBy("ratio", "key")
    after = everything.rowsBetween(0, Window.unboundedFollowing)
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_key) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    cap = F.col("source_size") * float(MOST_PASSES)
    shared = (
        sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
    )
    # the level of the first source that is not capped holds for all that are not
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "key", "level"))).over(all_rows)["level"]
    return shared.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).select("key", "source_size", "weight", "target")


def apportioned(shares: DataFrame, group: list[str], target: Column, seats: Column, most: Column) -> DataFrame:
    """shares (with the columns of group and `key`) with quota: the group's seats by the highest quotients target / (2 * seats so far + 1).

    With n rows, the last seat's quotient lies within a part n / (2 * seats) of the level
    total / seats, so a row surely gets all but a few of its share; the seats left go to the
    highest of the next quotients, of which there are a few for each row. Ties go by key; no
    row gets more than `most`.
    """
    here = Window.partitionBy(*group)
    own = shares.select("*", target.cast("double").alias("__target"), seats.cast("long").alias("__seats"), most.cast("long").alias("__most"))
    own = own.select("*", F.sum("__target").over(here).alias("__total"), F.count(F.lit(1)).over(here).alias("__n"))
    own = own.select("*", (F.col("__target") * F.col("__seats") / F.greatest("__total", F.lit(1e-9))).alias("__share"), (F.col("__n") / F.greatest("__seats", F.lit(1))).alias("__part"))
    sure = F.least(F.greatest(F.floor(F.col("__share") * (1 - F.col("__part") / 2) - 0.5), F.lit(0)), F.col("__most"))
    given = own.select("*", sure.cast("long").alias("__sure"))
    given = given.select("*", (F.col("__seats") - F.sum("__sure").over(here)).alias("__left"))
    # capped rows leave less than two seats each, which the factor of 3 allows for
    next_ = F.explode(F.sequence(F.lit(0), F.ceil(F.col("__share") * F.col("__part") * 3).cast("int") + 3))
    asked = given.withColumn("__more", next_).filter((F.col("__sure") + F.col("__more") < F.col("__most")) & (F.col("__target") > 0))
    quotient = F.col("__target") / (2 * (F.col("__sure") + F.col("__more")) + 1)
    ranked = asked.withColumn("__place", F.row_number().over(here.orderBy(quotient.desc(), "key")))
    more = ranked.filter(F.col("__place") <= F.col("__left")).groupBy(*group, "key").agg(F.count(F.lit(1)).alias("__got"))
    return given.join(more, [*group, "key"], "left").withColumn("quota", F.col("__sure") + F.coalesce("__got", F.lit(0))).select(*shares.columns, "quota")


def quotas(aimed: DataFrame) -> DataFrame:
    """aimed (key, source_size, target) with block (tokens), blocks (of the source's line) and quota (blocks to take)."""
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_rows)
    cut = (
        aimed.withColumn("block", F.greatest(F.floor(F.coalesce(least, F.lit(0.0)) / BLOCKS_OF_LEAST), F.lit(SMALLEST_BLOCK)).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("seats", F.round(F.sum("target").over(all_rows) / F.col("block")).cast("long")).withColumn("all", F.lit(0))
    )
    most = F.floor(F.col("source_size") * MOST_PASSES / F.col("block"))
    return apportioned(cut, ["all"], F.col("target"), F.col("seats"), most).select("key", "source_size", "target", "block", "blocks", "quota")


def shard_quotas(quota: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """quota (source, blocks, quota) as (source, key: the shard, shard_blocks, quota): each source's blocks by shard."""
    dealt = quota.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumnRenamed("quota", "seats").withColumn(
        "shard_blocks", F.greatest(F.floor((F.col("blocks") - F.col("key") + (n_shards - 1)) / n_shards), F.lit(0)).cast("long")
    )
    return apportioned(dealt, ["source"], F.col("shard_blocks"), F.col("seats"), MOST_PASSES * F.col("shard_blocks")).select("source", "key", "shard_blocks", "quota")


RESULTS = ("size", "source_size", "target", "taken")


def _on_line(docs: DataFrame, seed: int) -> tuple[DataFrame, list[str]]:
    """docs with __at (the place of its first word on its source's line), size and its source's quotas; the columns kept."""
    kept = [c for c in docs.columns if c not in RESULTS]
    own = docs.select(*(F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(kept)), "doc_id", "text", source_key(F.col("source")).alias("key"))
    text_hash = F.xxhash64("text")
    sized = own.withColumn("size", F.size(common.words_of(F.col("text"))).cast("long")).withColumn("text_hash", text_hash).drop("text")
    sized = sized.withColumn("spread", F.xxhash64("doc_id", F.lit(seed), "text_hash")).withColumn("bucket", F.pmod(F.col("spread"), F.lit(BUCKETS)))
    per_bucket = common.scratch_table(sized.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    by_source = common.checkpointed(quotas(targets(per_bucket.groupBy("key").agg(F.sum("bucket_size").alias("source_size")))))
    by_shard = shard_quotas(by_source.withColumnRenamed("key", "source")).groupBy(F.col("source").alias("key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", "quota"))), lambda x: x["quota"]).alias("quotas")
    )
    line = Window.partitionBy("key").orderBy("bucket")
    aimed = common.checkpointed(by_source.join(by_shard, "key"))
    offsets = per_bucket.withColumn("offset", F.sum("bucket_size").over(line) - F.col("bucket_size")).join(aimed, "key").drop("bucket_size")
    within = Window.partitionBy("key", "bucket").orderBy("spread", "doc_id", "text_hash")
    placed = sized.withColumn("within", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(offsets, ["key", "bucket"]).withColumn("at", F.col("offset") + F.col("within")), kept


def _back(met: DataFrame, kept: list[str], *results: str) -> DataFrame:
    return met.select(*(F.col(f"__own{i}").alias(c) for i, c in enumerate(kept) if c not in results), *results)


def mixed(docs: DataFrame, seed: int = 23) -> DataFrame:
    """docs with size, source_size, target (its source's) and taken (words the mix takes)."""
    met, kept = _on_line(docs, seed)
    first, last = F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block"))

    def part(b: Column) -> Column:
        """Of block b of the line: its number in its shard, how many the source has there, the shard's quota, and the document's words in it."""
        shard = F.pmod(b, F.lit(SHARDS))
        return F.struct(
            F.floor(b / SHARDS).cast("long").alias("j"), F.greatest(F.floor((F.col("blocks") - shard + (SHARDS - 1)) / SHARDS), F.lit(1)).cast("long").alias("n"),
            F.get("quotas", shard.cast("int")).alias("quota"), F.xxhash64("key", F.lit(seed), shard).alias("seed"),
            (F.least((b + 1) * F.col("block"), F.col("at") + F.col("size")) - F.greatest(b * F.col("block"), F.col("at"))).alias("words"),
        )

    def taken_of(p: Column) -> Column:
        more = F.when(p["quota"] % p["n"] == 0, F.lit(0)).otherwise((feistel.permuted(p["j"], p["n"], p["seed"]) < p["quota"] % p["n"]).cast("int"))
        return (F.floor(p["quota"] / p["n"]) + more) * p["words"]

    met = met.withColumn("parts", F.transform(F.sequence(first, last), part))
    chosen = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + taken_of(p))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(chosen)
    return _back(met.withColumn("taken", taken.cast("long")), kept, *RESULTS)


def whole_documents(docs: DataFrame, seed: int = 23) -> DataFrame:
    """docs with size, source_size, target and times (how often the mix takes the document as a whole).

    A source's quota in words is so many whole passes over its line and, of one more
    pass, the documents from the line's start whose middle lies within the rest. A source
    so differs from its quota by half a document at most.
    """
    met, kept = _on_line(docs, seed)
    quota = F.col("quota") * F.col("block")
    size = F.greatest("source_size", F.lit(1))
    more = (2 * F.col("at") + F.col("size") <= 2 * (quota % size)).cast("long")
    times = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(quota / size) + more)
    return _back(met.withColumn("times", times.cast("int")), kept, "size", "source_size", "target", "times")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
