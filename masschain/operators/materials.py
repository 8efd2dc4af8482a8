"""One make-up for each class of materials, split by context where a class stands in several.

An observation is (node, cls, context, element, fraction): a material of a class, the class of the component that it is in
(null: none), and how much of an element it holds; a material that nobody measured has one row with a null element.
A class in two or more contexts becomes one class a context, `<class>_in_<context>`; materials of such a class
without a context form `<class>_in_<class>`. The make-up of a class is the mean over its measured materials, where
an element that one of them lacks counts as 0. A class without measured materials inherits: from the
class that it was split from, else from its nearest ancestor that has measured materials at or below it (of
equally near ones the smaller name).

Work on single materials ends with two aggregations; what follows is as large as the classes and their elements.

Defined results: rows with a null node or class are left out; several rows of a node and element add up; null fractions
count as 0; ancestors on cycles are met once; a class with no one to inherit from has a row without element. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import shared
from masschain.plans.tables import sql_query

from .graph import closure_with_depth

BAND = 0.005


def _named(contexts: Column) -> Column:
    return F.when(contexts > 1, F.concat("cls", F.lit("_in_"), F.coalesce("context", "cls"))).otherwise(F.col("cls"))


def targets(observed: DataFrame) -> DataFrame:
    """(cls, context, target, n_nodes, n_measured) of each class and context."""
    nodes = observed.filter("node IS NOT NULL AND cls IS NOT NULL").groupBy("cls", "context", "node").agg(F.max(F.col("element").isNotNull().cast("int")).alias("measured"))
    groups = nodes.groupBy("cls", "context").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("measured").alias("n_measured"))
    return groups.join(groups.groupBy("cls").agg(F.count("context").alias("contexts")), "cls").select("cls", "context", _named(F.col("contexts")).alias("target"), "n_nodes", "n_measured")


def _mean(sums: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    total = sums.groupBy(by, "element").agg(F.sum("total").alias("total"))
    n = counts.groupBy(by).agg(F.sum("n_measured").alias("n"))
    return total.join(n, by).select(by, "element", (F.col("total") / F.col("n")).alias("share"))


def canonical(observed: DataFrame, taxonomy: DataFrame, band: float = BAND) -> DataFrame:
    """(target, cls, n_nodes, donor, element, share, lo, hi); taxonomy is (child, parent). donor: whose mean it is."""
    shared.checkpoint_folder(observed.sparkSession)
    named = targets(observed).checkpoint()
    sums = observed.filter("node IS NOT NULL AND cls IS NOT NULL AND element IS NOT NULL").groupBy("cls", "context", "element").agg(F.sum(F.coalesce("fraction", F.lit(0.0))).alias("total"))
    sums = sums.join(named.withColumnRenamed("cls", "c").withColumnRenamed("context", "x"), (F.col("cls") == F.col("c")) & F.col("context").eqNullSafe(F.col("x"))).select("cls", "target", "element", "total").checkpoint()
    each = named.groupBy("target", "cls").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_measured").alias("n_measured"))
    own = each.filter("n_measured > 0").select("target", "cls", "n_nodes", F.col("target").alias("donor")).join(_mean(sums, named, "target"), "target")

    # a class stands for what is at or below it
    classes = named.select("cls").distinct()
    above = classes.select("cls", F.col("cls").alias("donor"), F.lit(0).alias("depth")).unionByName(closure_with_depth(taxonomy).select(F.col("descendant").alias("cls"), F.col("ancestor").alias("donor"), "depth").join(classes, "cls", "left_semi")).checkpoint()
    means = _mean(sums.join(above, "cls").select("donor", "element", "total"), named.join(above, "cls").select("donor", "n_measured"), "donor")
    able = named.filter("n_measured > 0").select("cls").distinct().join(above, "cls").select("donor").distinct()
    needy = each.filter("n_measured = 0").join(above.join(able, "donor"), "cls", "left")
    nearest = needy.groupBy("target", "cls", "n_nodes").agg(F.min(F.when(F.col("donor").isNotNull(), F.struct("depth", "donor")))["donor"].alias("donor"))
    inherited = nearest.join(means, "donor", "left")
    out = own.unionByName(inherited.select(*own.columns))
    return out.withColumn("lo", F.greatest(F.lit(0.0), F.col("share") - band)).withColumn("hi", F.least(F.lit(1.0), F.col("share") + band)).withColumn("lo", F.when(F.col("share").isNotNull(), F.col("lo"))).withColumn("hi", F.when(F.col("share").isNotNull(), F.col("hi")))


def restated(observed: DataFrame, taxonomy: DataFrame, band: float = BAND) -> DataFrame:
    """Each material with the make-up of its class: (node, target, element, share, lo, hi), measured or not."""
    named = targets(observed).select(F.col("cls").alias("c"), F.col("context").alias("x"), "target")
    nodes = observed.filter("node IS NOT NULL AND cls IS NOT NULL").select("node", "cls", "context").distinct()
    placed = nodes.join(named, (F.col("cls") == F.col("c")) & F.col("context").eqNullSafe(F.col("x"))).select("node", "target")
    return placed.join(canonical(observed, taxonomy, band).select("target", "element", "share", "lo", "hi"), "target").select("node", "target", "element", "share", "lo", "hi")


_OBSERVED = "SELECT struct(ord, sup, prt) AS node, material_class AS cls, component_class AS context, element_class AS element, elem_best AS fraction FROM mat"


def material_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical(sql_query(_OBSERVED)(spark, sf_dir), sql_query("SELECT child, parent FROM taxonomy")(spark, sf_dir))
    near = lambda c: F.round(F.col(c) + 1e-12, 9).alias(c)
    return found.select(F.col("target").alias("canonical_class"), F.col("cls").alias("material_class"), "n_nodes", "donor", F.col("element").alias("element_class"), near("share"), near("lo"), near("hi"))


QUERIES = {"material_canonicalize": material_canonicalize}
#: All materials of the given tables are measured and stand in a component.
ORACLE = {
    "material_canonicalize": """WITH named AS (SELECT m.*, CASE WHEN n.contexts > 1 THEN concat(m.material_class, '_in_', m.component_class) ELSE m.material_class END AS target FROM mat m
        JOIN (SELECT material_class, COUNT(DISTINCT component_class) AS contexts FROM mat GROUP BY material_class) n ON m.material_class = n.material_class),
    sized AS (SELECT target, COUNT(*) AS n FROM named GROUP BY target), mean AS (SELECT target, material_class, element_class, SUM(elem_best) AS total FROM named GROUP BY target, material_class, element_class)
    SELECT m.target AS canonical_class, m.material_class, s.n AS n_nodes, m.target AS donor, m.element_class, round(m.total / s.n + 1.0E-12, 9) AS share,
        round(greatest(0.0E0, m.total / s.n - 0.005E0) + 1.0E-12, 9) AS lo, round(least(1.0E0, m.total / s.n + 0.005E0) + 1.0E-12, 9) AS hi FROM mean m JOIN sized s ON m.target = s.target""",
}
