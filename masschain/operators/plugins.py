"""Extension points: parts of the view, axes and rulesets as functions and data that a caller swaps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import tables
from masschain.plans.ruleset import DEFAULT, Ruleset

Part = Callable[[SparkSession, str], DataFrame]


def projected(spark: SparkSession, sf_dir: str, parts: dict[str, Part], key: list[str]) -> DataFrame:
    """The union of view parts, each marked with its name; rows of one key stand once, from the part named first."""
    order = {name: i for i, name in enumerate(parts)}
    rows = reduce(DataFrame.unionByName, (part(spark, sf_dir).withColumn("part", F.lit(name)) for name, part in parts.items()))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("part"))
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), rank).alias("row"))
    return first.select(*key, *(F.col(f"row.{c}").alias(c) for c in others))


def sliced(products: DataFrame, axis: str, member: Column, value: Column) -> DataFrame:
    """products with the class of their slice on an axis: `<value>_<class>` for those that the axis covers."""
    return products.withColumn("axis", F.lit(axis)).withColumn("slice", F.when(member, F.concat_ws("_", value.cast("string"), "product_class")).otherwise(F.col("product_class")))


def projection_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "elements": tables.sql_query("SELECT product_class AS subject, yr, element_class AS constituent, round(amount, 9) AS amount FROM leaf_mean"),
        "components": tables.sql_query("SELECT product_class AS subject, yr, component_class AS constituent, round(share, 9) AS amount FROM component_share"),
        "balance": tables.sql_query("SELECT product_class AS subject, yr, 'unknownElement' AS constituent, round(1 - SUM(amount), 9) AS amount FROM leaf_mean GROUP BY product_class, yr"),
    }
    return projected(spark, sf_dir, parts, ["subject", "yr", "constituent"])


def axis_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year slices, then slices of the value axis over them, for the regions of the north; masses by slice."""
    products = tables.sql_query("SELECT ord, product_class, yr, axis_value, mass FROM prod")(spark, sf_dir)
    by_year = sliced(products, "year", F.col("yr").isNotNull(), F.concat(F.lit("Y"), F.col("yr").cast("string")))
    by_value = sliced(by_year.withColumn("product_class", F.col("slice")), "region", F.col("axis_value").isin("EUROPE", "AMERICA"), F.col("axis_value"))
    return by_value.groupBy("axis", "slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mass"), 6).alias("mass"))


#: Another ruleset: wider limits, Integrity in full, uncertainties that compound.
STRICT = Ruleset(limit_bands=((0.0, 8.0, 0.2), (8.0, 12.0, 0.4), (12.0, 99.0, 0.6)), weights=(("timeliness", 2.0),), compounds=True)


def uncertainty(rules: Ruleset) -> str:
    times = 2 if rules.compounds else 1
    return f"SELECT product_class, element_class, round(sqrt(SUM(power(f, 2) * {times} * power(sigma_rel, 2))) / SUM(f), 9) AS rel, round(MAX(mean_dq), 9) AS worst_mean FROM ppath GROUP BY product_class, element_class"


def ruleset_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same amounts under two rulesets."""
    parts = [tables.sql_query(uncertainty(r), r)(spark, sf_dir).withColumn("ruleset", F.lit(name)) for name, r in (("default", DEFAULT), ("strict", STRICT))]
    return parts[0].unionByName(parts[1])


_ELEMENTS = "SELECT product_class AS subject, yr, element_class AS constituent, round(amount, 9) AS amount, 'elements' AS part FROM leaf_mean"
QUERIES = {"projection_plugin": projection_plugin, "axis_plugin": axis_plugin, "ruleset_as_data": ruleset_as_data}
ORACLE = {
    "projection_plugin": _ELEMENTS + " UNION ALL SELECT product_class, yr, component_class, round(share, 9), 'components' FROM component_share UNION ALL SELECT product_class, yr, 'unknownElement', round(1 - SUM(amount), 9), 'balance' FROM leaf_mean GROUP BY product_class, yr",
    "axis_plugin": "SELECT 'region' AS axis, CASE WHEN axis_value IN ('EUROPE', 'AMERICA') THEN concat(axis_value, '_Y', CAST(yr AS STRING), '_', product_class) ELSE concat('Y', CAST(yr AS STRING), '_', product_class) END AS slice, COUNT(*) AS n, round(AVG(mass), 6) AS mass FROM prod GROUP BY 1, 2",
}
#: Checks whose tables come from another ruleset than the default one.
FULL_ORACLE = {"ruleset_as_data": " UNION ALL ".join(f"SELECT *, '{name}' AS ruleset FROM ({tables.with_ctes(uncertainty(r), tables.check_ctes(r))}) x" for name, r in (("default", DEFAULT), ("strict", STRICT)))}
