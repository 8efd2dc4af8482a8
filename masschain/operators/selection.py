"""Exact quantiles by distributed selection: a histogram of each key's values, then of the bins that hold the ranks.

A round cuts a range at approximate quantiles of what it holds, counts the values of each bin exactly and follows
each wanted rank into its bin; a bin of one value ends there. Bins hold about equal numbers whatever the values look like, so
each round leaves about one BINS-th, and few rounds are needed. Rows are only sketched and counted, with partial results before the
shuffle, so no key is hot and no task holds a key's values.

Nulls, NaN and infinite values are left out; a key without others has no row. Null keys are keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masschain.plans import shared, tables

BINS = 64
MOST_ROUNDS = 64


def ranked_values(df: DataFrame, key: str, value: str, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(key, rank, value) for each row of wanted (key, rank): the value of that rank, from 0, among the key's finite values."""
    shared.checkpoint_folder(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter(F.abs("v") < float("inf"))
    ends = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranges = wanted.join(ends, wanted["key"].eqNullSafe(ends["key"])).select(wanted["key"], F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("at"), "lo", "hi").checkpoint()
    done = ranges.filter("lo = hi").select("key", "rank", F.col("lo").alias("value"))
    if bins < 4:
        raise ValueError(f"bins: {bins}")
    cuts = [i / bins for i in range(1, bins)]
    for _ in range(MOST_ROUNDS):
        ranges = ranges.filter("lo < hi")
        if ranges.isEmpty():
            return done
        inside = lambda spans: rows.join(spans, F.col("key").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
        spans = ranges.select("key", "lo", "hi").distinct().withColumnRenamed("key", "k")
        # the upper end is a cut as well: its values part from the others in any case
        cut = inside(spans).groupBy("k", "lo", "hi").agg(F.array_append(F.percentile_approx("v", cuts, 16 * bins), F.col("hi")).alias("cuts")).checkpoint()
        # a cut's own value, which may be most of the range, has a bin for itself
        bin_ = F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.size(F.filter("cuts", lambda c: c <= F.col("v")))
        counted = inside(cut).groupBy("k", "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "lo", "hi").orderBy("bin")))  # at most 2 * bins rows each
        same = ranges["key"].eqNullSafe(upto["k"]) & (ranges["lo"] == upto["lo"]) & (ranges["hi"] == upto["hi"])
        hit = ranges.join(upto, same & (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
        ranges = hit.select("key", "rank", (F.col("at") - (F.col("upto") - F.col("n"))).alias("at"), F.col("least").alias("lo"), F.col("most").alias("hi")).checkpoint()
        done = done.unionByName(ranges.filter("lo = hi").select("key", "rank", F.col("lo").alias("value")))
    raise RuntimeError(f"ranks not found in {MOST_ROUNDS} rounds")


def quantiles(df: DataFrame, key: str, value: str, probabilities: Sequence[float], bins: int = BINS) -> DataFrame:
    """(key, quantiles: array in the order of probabilities): linear between the two ranks beside (n - 1) * p."""
    finite = df.filter(F.abs(F.col(value).cast("double")) < float("inf"))
    sizes = finite.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities))))
    placed = sizes.select("key", "n", place.alias("q")).withColumn("at", (F.col("n") - 1) * F.col("q.p")).withColumn("low", F.floor("at")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1)).checkpoint()
    wanted = placed.select("key", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = ranked_values(df, key, value, wanted, bins).checkpoint()
    side = lambda name: found.select(F.col("key").alias(f"key_{name}"), F.col("rank").alias(f"rank_{name}"), F.col("value").alias(name))
    met = placed
    for name in ("low", "high"):
        met = met.withColumnRenamed(name, f"at_{name}").join(side(name), F.col("key").eqNullSafe(F.col(f"key_{name}")) & (F.col(f"at_{name}") == F.col(f"rank_{name}")))
    one = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.col("at_low"))
    listed = met.select("key", "q.i", one.alias("value")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("all"))
    return listed.select("key", F.transform("all", lambda x: x["value"]).alias("quantiles"))


def percentile_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.checkpoint_folder(spark)
    found = quantiles(tables.sql_query("SELECT product_parent, mass FROM prod")(spark, sf_dir).checkpoint(), "product_parent", "mass", (0.5, 0.95))
    return found.select(F.col("key").alias("product_parent"), F.get("quantiles", 0).alias("p50"), F.get("quantiles", 1).alias("p95"))


def median_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.checkpoint_folder(spark)
    found = quantiles(tables.read(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", (0.25, 0.5, 0.75))
    return found.select(F.col("key").alias("event_type"), F.get("quantiles", 1).alias("median"), (F.get("quantiles", 2) - F.get("quantiles", 0)).alias("iqr"))


QUERIES = {"percentile_interp": percentile_interp, "median_iqr": median_iqr}
ORACLE = {
    "percentile_interp": "SELECT product_parent, quantile_cont(mass, 0.5) AS p50, quantile_cont(mass, 0.95) AS p95 FROM prod GROUP BY 1",
    "median_iqr": "SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1",
}
