"""Op 7: document fingerprints by threshold-scaled sketches.

A sketch keeps the hashes of word shingles below a fixed fraction of the hash range, and
nothing else, so that the union of two sketches is the sketch of both texts' shingles, and
what is kept of a short text is kept of a long one that holds it. Likeness is the share of common hashes in
the union of two sketches, containment that in the smaller one.

Short texts may keep no hash. The smallest hash of a text stands beside its sketch for that:
two texts that keep none compare by it (1 if equal, 0 if not; two texts without words are alike). The
fingerprint lists the kept hashes, or that one after a `+`.

The next document in ascending order of ids is found without a global sort in one task:
narrow rows (id, length, hash of the text) are range-partitioned and written, each
partition takes its rows' neighbours by a window, and partitions meet through one row
each. A text goes to its predecessor only as the prefix that is needed there, and its
sketch.

Defined results: a null text counts as empty, with an empty fingerprint; null ids come
last; rows of equal id follow each other by the hash of their text; a single row follows
itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
FRACTION = 8  # one hash of so many is kept
ROWS_PER_RANGE = 100_000


def sketch(text: Column, k: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """struct(kept: sorted array<bigint> of the hashes below the threshold, least: the smallest hash of all).

    Of fewer than k words, the whole sequence is one shingle; without words least is null.
    """

    def hashes(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, whole).otherwise(each)

    below = -(1 << 63) + (1 << 64) // fraction
    bound = F.transform(F.array(common.words_of(text)), hashes)
    kept = lambda h: F.array_sort(F.array_distinct(F.filter(h, lambda x: x < below)))
    return F.element_at(F.transform(bound, lambda h: F.struct(kept(h).alias("kept"), F.array_min(h).alias("least"))), 1)


def _by_least(a: Column, b: Column) -> Column:
    return a["least"].eqNullSafe(b["least"]).cast("double")


def merged(a: Column, b: Column) -> Column:
    """The sketch of all shingles of two texts."""
    return F.struct(F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"), F.least(a["least"], b["least"]).alias("least"))


def likeness(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sketches."""
    union = F.size(F.array_union(a["kept"], b["kept"]))
    return F.when(union == 0, _by_least(a, b)).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / union)


def containment(a: Column, b: Column) -> Column:
    """|a and b| / the smaller of |a| and |b|; where that keeps nothing, 1 if the smallest hashes agree, else null: unknown."""
    smaller = F.least(F.size(a["kept"]), F.size(b["kept"]))
    return F.when(smaller == 0, F.when(a["least"].eqNullSafe(b["least"]), F.lit(1.0))).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / smaller)


def as_text(sketch_: Column) -> Column:
    listed = F.array_join(F.transform(sketch_["kept"], lambda h: F.hex(h)), ",")
    return F.when(F.size(sketch_["kept"]) > 0, listed).otherwise(F.coalesce(F.concat(F.lit("+"), F.hex(sketch_["least"])), F.lit("")))


def followers(narrow: DataFrame) -> DataFrame:
    """narrow (id, row_hash, n_chars), rows distinct in the first two, with the key and length of the
    row before and after each in order. The order is a circle."""
    n = narrow.count()
    ranges = max(1, -(-n // ROWS_PER_RANGE))
    placed = narrow.repartitionByRange(ranges, "id", "row_hash").withColumn("part", F.spark_partition_id())
    placed = common.scratch_table(placed, "order")  # so that parts do not change
    key = F.struct("id", "row_hash", "n_chars")
    within = Window.partitionBy("part").orderBy("id", "row_hash")
    # one row for each part
    edge = placed.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    circle = Window.orderBy("part")
    everything = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.select(
        "part",
        F.coalesce(F.lag("last").over(circle), F.last("last").over(everything)).alias("part_before"),
        F.coalesce(F.lead("first").over(circle), F.first("first").over(everything)).alias("part_after"),
    )
    near = placed.select("*", F.lag(key).over(within).alias("b"), F.lead(key).over(within).alias("a"))
    return near.join(edge, "part").select(*narrow.columns, F.coalesce("b", "part_before").alias("before"), F.coalesce("a", "part_after").alias("after"))


def fingerprints(docs: DataFrame, k: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and likeness and containment to the latter and to the next row."""
    last_id = F.lit((1 << 63) - 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    # a null id takes the last number and a hash of its own, apart from a document that has that number
    row_hash = F.when(F.col("doc_id").isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(text, F.lit("unnamed")))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), last_id).alias("id"), row_hash.alias("row_hash"), text.alias("text"))
    narrow = keyed.select("id", "row_hash", F.length("text").alias("n_chars")).groupBy("id", "row_hash").agg(
        F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("times")
    )
    near = followers(narrow)
    unique = keyed.dropDuplicates(["id", "row_hash"])  # with the same columns on both sides below, so that texts are exchanged once
    named = (F.col("id") != last_id) | (F.col("row_hash") == F.xxhash64("text"))
    sent = unique.join(near, ["id", "row_hash"]).select(
        F.col("before.id").alias("id"), F.col("before.row_hash").alias("row_hash"),
        F.substring("text", F.lit(1), F.floor(F.col("before.n_chars") / 4).cast("int")).alias("prefix"),
        sketch(F.col("text"), k, fraction).alias("sketch"),
    )
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    own = unique.join(near.select("id", "row_hash", "n_chars", "times"), ["id", "row_hash"]).withColumn("s", sketch(F.col("text"), k, fraction))
    # of rows that repeat an id and a text, all but the last are followed by the same text
    last = F.struct("prefix", "sketch", F.lit(1).alias("n"))
    earlier = F.struct(F.substring("text", F.lit(1), quarter).alias("prefix"), F.col("s").alias("sketch"), (F.col("times") - 1).cast("int").alias("n"))
    met = own.join(sent, ["id", "row_hash"]).withColumn("after", F.explode(F.when(F.col("times") > 1, F.array(last, earlier)).otherwise(F.array(last))))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.col("after.prefix"))
    both = met.select(
        F.when(named, F.col("id")).alias("doc_id"), "n_chars", F.col("after.sketch").alias("next_sketch"), "s", edited.alias("edited"), F.col("after.n").alias("n")
    ).withColumn("e", sketch(F.col("edited"), k, fraction))
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    return both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("s"), F.col("e")).alias("contained_edited"), containment(F.col("s"), F.col("next_sketch")).alias("contained_next"),
    )


def op7_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
