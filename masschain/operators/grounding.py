"""Which numbers of an answer come from no result: not from a single number, a message's sum, the total of all sums or a product of two numbers.

Numbers agree if they differ by no more than `rtol` of the larger, so their logarithms differ by at most w = -ln(1 - rtol).
Numbers of a case are cut into bins of log width w and each bin keeps its least and greatest number; bins are few
whatever the number of rows, and are made with partial results before the shuffle.

* One number: of the bin of x and its two neighbours, the least or greatest is the nearest to x, so no other need be looked at.
* A product of two: products of bins i and j lie between lo_i * lo_j and hi_i * hi_j, which are themselves products, less than 2w apart.
  What agrees with x is 2w wide, so if any product of the two bins agrees with x, one of these two does. Each x meets each bin of its case
  once, which names the few bins that can complete it: numbers asked times bins, never all pairs of numbers. Cases are dealt by ranges of bins too.

Compared by absolute values. Null and zero numbers are not asked, as they claim nothing; NaN and infinite ones agree with nothing. Results that are null,
zero, NaN or infinite are left out. A case without results has no row. Null cases and messages are ones of their own; repeated rows count in sums and are answered each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import shared, tables

RTOL = 2e-3
#: Parts that a case's bins are dealt into.
PARTS = 16


def _bins(numbers: DataFrame, width: float) -> DataFrame:
    """(key, bin, lo, hi) of numbers (key, v)."""
    return numbers.groupBy("key", F.floor(F.ln("v") / width).alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def _agree(x: Column, c: Column, rtol: float) -> Column:
    return F.abs(x - c) <= rtol * F.greatest(x, c)


def ungrounded(asked: DataFrame, results: DataFrame, rtol: float = RTOL) -> DataFrame:
    """The rows of asked (case, value, and any others) that nothing of results (case, message, value) accounts for."""
    if not 0 < rtol < 0.5:
        raise ValueError(f"rtol: {rtol}")
    shared.checkpoint_folder(asked.sparkSession)
    width = -math.log1p(-rtol) * 0.999  # a little less, so that rounding of logarithms is covered by one more neighbour
    key = F.coalesce(F.concat(F.lit("="), F.col("case").cast("string")), F.lit("")).alias("key")
    size = F.abs(F.col("value").cast("double"))
    found = results.select(key, "message", size.alias("v")).filter("v > 0 AND v < double('inf')")
    sums = found.groupBy("key", "message").agg(F.sum("v").alias("v")).select("key", "v").checkpoint()
    bins = _bins(found, width).checkpoint()
    totals = sums.unionByName(sums.groupBy("key").agg(F.sum("v").alias("v"))).filter("v < double('inf')")
    single = bins.unionByName(_bins(totals, width)).groupBy("key", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    rows = asked.withColumn("_key", key).withColumn("_x", size).filter("_x > 0")
    numbers = rows.select(F.col("_key").alias("key"), F.col("_x").alias("x")).distinct()
    numbers = numbers.join(sums.select("key").distinct(), "key", "left_semi").withColumn("k", F.floor(F.ln("x") / width)).checkpoint()
    near = numbers.filter("x < double('inf')").withColumn("bin", F.explode(F.sequence(F.col("k") - 2, F.col("k") + 2)))
    hit = near.join(single, ["key", "bin"]).filter(_agree(F.col("x"), F.col("lo"), rtol) | _agree(F.col("x"), F.col("hi"), rtol))
    open_ = numbers.join(hit.select("key", "x"), ["key", "x"], "left_anti").checkpoint()

    one = bins.select("key", F.col("bin").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.pmod("bin", F.lit(PARTS)).alias("part"))
    spread = open_.filter("x < double('inf')").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    # ln(a * b) is in [(i + j) * width, (i + j + 2) * width) and at most some 1.002 * width from ln(x), which is in [k * width, (k + 1) * width)
    pairs = spread.join(one, ["key", "part"]).withColumn("bin", F.explode(F.sequence(F.col("k") - F.col("i") - 3, F.col("k") - F.col("i") + 2))).filter("i <= bin")
    product = pairs.join(bins, ["key", "bin"]).filter(_agree(F.col("x"), F.col("lo_i") * F.col("lo"), rtol) | _agree(F.col("x"), F.col("hi_i") * F.col("hi"), rtol))
    left = open_.join(product.select("key", "x"), ["key", "x"], "left_anti").select(F.col("key").alias("_key"), F.col("x").alias("_x"))
    return rows.join(left, ["_key", "_x"], "left_semi").drop("_key", "_x")


def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user that come from none of the user's other events; each type of event is a message."""
    events = tables.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("case"), F.col("event_type").alias("message"), "value")
    bought = F.col("message").eqNullSafe("purchase")
    return ungrounded(events.filter(bought), events.filter(~bought)).select("event_id", F.col("case").alias("user_id"), "value")


QUERIES = {"ungrounded_numbers": ungrounded_numbers}
#: By all pairs of each user's numbers.
ORACLE = {
    "ungrounded_numbers": f"""WITH found AS (SELECT user_id, event_type, abs(value) AS v FROM events WHERE event_type IS DISTINCT FROM 'purchase' AND value <> 0), sums AS (SELECT user_id, event_type, SUM(v) AS v FROM found GROUP BY user_id, event_type),
        candidates AS (SELECT user_id, v FROM found UNION SELECT user_id, v FROM sums UNION SELECT user_id, SUM(v) FROM sums GROUP BY user_id UNION SELECT a.user_id, a.v * b.v FROM found a JOIN found b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.v <= b.v)
        SELECT e.event_id, e.user_id, e.value FROM events e WHERE e.event_type = 'purchase' AND e.value <> 0 AND EXISTS (SELECT 1 FROM found f WHERE f.user_id IS NOT DISTINCT FROM e.user_id)
        AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.user_id IS NOT DISTINCT FROM e.user_id AND abs(abs(e.value) - c.v) <= {RTOL} * greatest(abs(e.value), c.v))""",
}
