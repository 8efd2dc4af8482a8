"""Roll-ups of class tables up a gated class hierarchy of any depth: one aggregate for each height.

A class with values of its own is a leaf. Any other class is the equal mean of those of its gated
subclasses that have an aggregate; it waits until all of them are done, so its height is one more than
the greatest of theirs. Heights come first, from the edges alone, and cut their lineage in the shared
checkpoint folder; then each height is one join of the values below with its edges and one
aggregation by parent and key. A class that is a leaf and a parent counts with its own values in its parents, and
has an aggregate besides. Classes on a cycle, and those that only such classes lead to, have none.

Values are (class, key, best) with any of rel, mean_dq, dqs. A parent's
* best is the mean over the subclasses that have the key (`over="having"`) or over all gated ones (`over="all"`),
* rel (relative uncertainty) is the root of the summed squares of best * rel, over all gated subclasses, over its best,
* mean_dq is weighted by best, and dqs is the worst.
Nulls are left out of sums; where no subclass has a measure, it is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import shared, tables, view

MOST_HEIGHTS = 256
ROUNDS = 32


def reachable(classes: DataFrame, edges: DataFrame, most: int = MOST_HEIGHTS) -> DataFrame:
    """The edges (parent, child) that lead up from the classes (child)."""
    frontier = met = classes
    for _ in range(most):
        up = edges.join(frontier, "child").select(F.col("parent").alias("child")).distinct()
        frontier = up.join(met, "child", "left_anti").checkpoint()
        if frontier.isEmpty():
            return edges.join(met, "child", "left_semi").select("parent", "child")
        met = met.union(frontier)
    raise RuntimeError(f"a hierarchy of more than {most} heights")


def _relaxed(own: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(parent, child, height): heights as longest paths, raised until none changes; None if that takes over ROUNDS rounds."""
    rise = lambda at: edges.join(at, "child").groupBy(F.col("parent").alias("child")).agg((F.max("height") + 1).alias("height"))
    start = own.withColumn("height", F.lit(0))
    at, state = start, None
    for k in range(ROUNDS):
        before, state = state, at.agg(F.count(F.lit(1)), F.sum("height")).first()
        if state == before:
            heights = rise(at).select(F.col("child").alias("parent"), "height")
            return edges.join(at.select("child"), "child", "left_semi").join(heights, "parent").select("parent", "child", "height").checkpoint()
        at = start.unionByName(rise(at).join(own, "child", "left_anti"))
        if k % 4 == 3:
            at = at.checkpoint()
    return None


def _peeled(own: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The same for deep hierarchies and for cycles: parents are taken off whose subclasses are all done. What hangs on a cycle never is."""
    open_ = reachable(own, edges, most).checkpoint()
    out = []
    for height in range(1, most + 1):
        parents = open_.select(F.col("parent").alias("child")).distinct()
        waiting = open_.join(parents, "child", "left_semi").join(own, "child", "left_anti").select("parent").distinct()
        ready = open_.join(waiting, "parent", "left_anti").withColumn("height", F.lit(height)).checkpoint()
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, out, open_.limit(0).withColumn("height", F.lit(0)))
        out.append(ready)
        open_ = open_.join(ready, ["parent", "child"], "left_anti").checkpoint()
    raise RuntimeError(f"a hierarchy of more than {most} heights")


def with_heights(classes: DataFrame, edges: DataFrame, most: int = MOST_HEIGHTS) -> list[DataFrame]:
    """For each height from 1: its edges (parent, child, n_subclasses), of the parents whose subclasses are all lower."""
    shared.checkpoint_folder(edges.sparkSession)
    edges = edges.select("parent", "child").filter("parent <> child").distinct().checkpoint()
    own = classes.select(F.col("class").alias("child")).distinct().checkpoint()
    found = _relaxed(own, edges)
    if found is None:
        found = _peeled(own, edges, most).checkpoint()
    subclasses = found.groupBy("parent").agg(F.count(F.lit(1)).alias("n_subclasses"))
    top = found.agg(F.max("height")).first()[0] or 0
    return [found.filter(F.col("height") == h).drop("height").join(subclasses, "parent") for h in range(1, top + 1)]


def _measures(columns: list[str], over: str) -> list[Column]:
    n = F.first("n_subclasses")
    best = F.avg("best") if over == "having" else F.sum("best") / n
    out = [best.alias("best"), F.count("best").alias("n_children")]
    if "rel" in columns:
        sigma = F.sqrt(F.sum(F.pow(F.col("best") * F.col("rel"), 2))) / n
        out.append((sigma / F.nullif(best, F.lit(0.0))).alias("rel"))
    if "mean_dq" in columns:
        weight = F.when(F.col("mean_dq").isNotNull(), F.col("best"))
        out.append((F.sum(weight * F.col("mean_dq")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("mean_dq"))
    if "dqs" in columns:
        out.append(F.max("dqs").alias("dqs"))
    return out


def roll_up(values: DataFrame, edges: DataFrame, key: list[str], over: str = "having", most: int = MOST_HEIGHTS) -> DataFrame:
    """The aggregates of all classes above values' classes: (class, *key, best, n_children, ...) by gated edges (parent, child)."""
    if over not in ("having", "all"):
        raise ValueError(f"over: {over}")
    measures = [c for c in ("rel", "mean_dq", "dqs") if c in values.columns]
    values = values.select("class", *key, "best", *measures)
    levels = with_heights(values.select("class"), edges, most)
    own = values.select("class").distinct()
    known, above = values, []
    for level in levels:  # each reads what is written below it
        below = known.withColumnRenamed("class", "child")
        made = level.join(below, "child").groupBy(F.col("parent").alias("class"), *key).agg(*_measures(measures, over)).checkpoint()
        above.append(made)
        known = known.unionByName(made.join(own, "class", "left_anti").select(known.columns))
    empty = values.select("class", *key, "best", F.lit(0).cast("long").alias("n_children"), *measures).limit(0)
    return reduce(DataFrame.unionByName, above, empty)


# --- over the given tables ------------------------------------------------------

_SLICE = "(product_class || '_Y' || CAST(yr AS STRING)) AS class"


def gate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child): what each class may average, by scopes and strategies."""
    return view.above_leaves(spark, sf_dir, "SELECT parent, child FROM gate")


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount, uncertainty and quality of each class above the slices that are measured, by element class."""
    leaves = view.above_leaves(spark, sf_dir, f"SELECT {_SLICE}, element_class, amount AS best, rel, mean_dq, dqs FROM leaf_mean WHERE amount > 0")
    return roll_up(leaves, gate_edges(spark, sf_dir), ["element_class"]).withColumnRenamed("best", "amount")


def class_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = view.above_leaves(spark, sf_dir, f"SELECT {_SLICE}, mass AS best FROM item_mass")
    return roll_up(leaves, gate_edges(spark, sf_dir), []).withColumnRenamed("best", "mass")


def _shares(body: str, key: str):
    """Shares of parts in slices of products and, by roll-up over all gated subclasses, in the classes above."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        leaves = tables.sql_query(body)(spark, sf_dir).filter("best > 1e-12").checkpoint()
        above = roll_up(leaves, gate_edges(spark, sf_dir), [key], "all")
        every = leaves.select("class", key, "best", F.lit(0).cast("long").alias("n_children")).unionByName(above)
        return every.select("class", key, F.round("best", 9).alias("share"), "n_children")

    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared.checkpoint_folder(spark)
        return query(spark, sf_dir)

    return prepared


COMPONENT_IN_PRODUCT = f"""SELECT {_SLICE}, component_class, SUM(f1_) / MIN(n) AS best FROM (SELECT p.product_class, p.yr, e.component_class, e.best AS f1_, n.n FROM pc e JOIN placed p ON e.ord = p.ord
    JOIN n_products n ON p.product_class = n.product_class AND p.yr = n.yr) x GROUP BY product_class, yr, component_class"""
MATERIAL_IN_PRODUCT = f"""SELECT {_SLICE}, material_class, SUM(f12) / MIN(n) AS best FROM (SELECT t.product_class, t.yr, t.material_class, t.f1 * t.f2 AS f12, n.n FROM ppath t
    JOIN n_products n ON t.product_class = n.product_class AND t.yr = n.yr) x GROUP BY product_class, yr, material_class"""
#: Of the instances of a component class: content, its uncertainty and quality.
COMPONENT_CONTENT = """SELECT component_class AS class, element_class, SUM(v) AS best, sqrt(SUM(power(v * sigma_rel, 2))) / nullif(SUM(v), 0.0E0) AS rel, SUM(v * mean_dq) / nullif(SUM(v), 0.0E0) AS mean_dq, MAX(dqs) AS dqs
    FROM (SELECT t.component_class, t.element_class, t.f2 * t.f3 / n.n AS v, t.sigma_rel, t.mean_dq, t.dqs FROM path t JOIN n_components n ON t.component_class = n.component_class) x GROUP BY component_class, element_class"""
MATERIAL_IN_COMPONENT = """SELECT c.component_class AS class, c.material_class, SUM(c.best) / MIN(n.n) AS best FROM cm c JOIN n_components n ON c.component_class = n.component_class GROUP BY c.component_class, c.material_class"""
#: Component classes are not scoped in time: each family averages all its members.
COMPONENT_EDGES = "SELECT DISTINCT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey"


def component_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.checkpoint_folder(spark)
    leaves = tables.sql_query(COMPONENT_CONTENT)(spark, sf_dir).checkpoint()
    made = roll_up(leaves, tables.sql_query(COMPONENT_EDGES)(spark, sf_dir), ["element_class"], "all")
    return made.select(F.col("class").alias("component_parent"), "element_class", *(F.round(c, 9).alias(a) for c, a in (("best", "amount"), ("rel", "rel"), ("mean_dq", "mean_dq"))), "dqs", "n_children")


def material_in_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.checkpoint_folder(spark)
    leaves = tables.sql_query(MATERIAL_IN_COMPONENT)(spark, sf_dir).checkpoint()
    made = roll_up(leaves, tables.sql_query(COMPONENT_EDGES)(spark, sf_dir), ["material_class"], "all")
    every = leaves.select("class", "material_class", "best", F.lit(0).cast("long").alias("n_children")).unionByName(made)
    return every.select(F.col("class").alias("component_class"), "material_class", F.round("best", 9).alias("share"), "n_children")


def class_ancestor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_means(spark, sf_dir).select("class", "element_class", F.round("amount", 9).alias("amount"), "n_children")


def item_mass_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_masses(spark, sf_dir).select("class", F.round("mass", 6).alias("mass"), "n_children")


def _leaf_and_above(spark: SparkSession, sf_dir: str, *measures: str) -> DataFrame:
    leaves = view.above_leaves(spark, sf_dir, f"SELECT {_SLICE}, element_class, CAST(0 AS BIGINT) AS n_children, {', '.join(measures)} FROM leaf_mean WHERE amount > 0")
    above = view.served(spark, sf_dir, "gated_mean").filter("n_children > 0").select(leaves.columns)
    return leaves.unionByName(above)


def class_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_and_above(spark, sf_dir, "rel").select("class", "element_class", F.round("rel", 9).alias("rel"), "n_children")


def class_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_and_above(spark, sf_dir, "mean_dq", "dqs").select("class", "element_class", F.round("mean_dq", 9).alias("mean_dq"), "dqs", "n_children")


QUERIES = {
    "class_ancestor_mean": class_ancestor_mean, "item_mass_mean": item_mass_mean, "class_uncertainty": class_uncertainty, "class_dq": class_dq,
    "component_in_product": _shares(COMPONENT_IN_PRODUCT, "component_class"), "material_in_product": _shares(MATERIAL_IN_PRODUCT, "material_class"),
    "component_rollup": component_rollup, "material_in_component": material_in_component,
}


# --- for the comparison: the two heights of the given tables, written out ----------


def _two_heights(leaves: str, key: str) -> str:
    """Leaf slices, classes and parents' slices above them, and classes above those; by sums over all gated subclasses."""
    step = lambda below: f"""SELECT g.parent AS class, m.{key}, SUM(m.best) / MIN(n.n) AS best, COUNT(*) AS n_children FROM {below} m JOIN gate g ON m.class = g.child
        JOIN (SELECT g.parent, COUNT(*) AS n FROM gate g WHERE g.child IN (SELECT class FROM {below}) GROUP BY g.parent) n ON n.parent = g.parent GROUP BY g.parent, m.{key}"""  # noqa: E731
    return f"""WITH h0 AS (SELECT * FROM ({leaves}) l WHERE best > 1.0E-12), h1 AS ({step('h0')}), h2 AS ({step('h1')})
        SELECT class, {key}, round(best, 9) AS share, n_children FROM (SELECT class, {key}, best, 0 AS n_children FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) a"""


#: Means, uncertainties and qualities of two heights.
_QUALITY = """WITH h0 AS (SELECT (product_class || '_Y' || CAST(yr AS STRING)) AS class, element_class, amount AS best, rel, mean_dq, dqs FROM leaf_mean WHERE amount > 0),
    h1 AS (SELECT g.parent AS class, m.element_class, AVG(m.best) AS best, sqrt(SUM(power(m.best * m.rel, 2))) / MIN(n.n) / AVG(m.best) AS rel, SUM(m.best * m.mean_dq) / SUM(m.best) AS mean_dq, MAX(m.dqs) AS dqs, COUNT(*) AS n_children
        FROM h0 m JOIN gate g ON m.class = g.child JOIN (SELECT parent, COUNT(*) AS n FROM gate WHERE child IN (SELECT class FROM h0) GROUP BY parent) n ON n.parent = g.parent GROUP BY g.parent, m.element_class),
    h2 AS (SELECT g.parent AS class, m.element_class, AVG(m.best) AS best, sqrt(SUM(power(m.best * m.rel, 2))) / MIN(n.n) / AVG(m.best) AS rel, SUM(m.best * m.mean_dq) / SUM(m.best) AS mean_dq, MAX(m.dqs) AS dqs, COUNT(*) AS n_children
        FROM h1 m JOIN gate g ON m.class = g.child JOIN (SELECT parent, COUNT(*) AS n FROM gate WHERE child IN (SELECT class FROM h1) GROUP BY parent) n ON n.parent = g.parent GROUP BY g.parent, m.element_class),
    every AS (SELECT class, element_class, rel, mean_dq, dqs, 0 AS n_children FROM h0 UNION ALL SELECT class, element_class, rel, mean_dq, dqs, n_children FROM h1 UNION ALL SELECT class, element_class, rel, mean_dq, dqs, n_children FROM h2)"""
ORACLE = {
    "class_ancestor_mean": "SELECT class, element_class, round(amount, 9) AS amount, n_children FROM gated_mean",
    "item_mass_mean": "SELECT class, round(mass, 6) AS mass, n_children FROM gated_mass",
    "class_uncertainty": f"{_QUALITY} SELECT class, element_class, round(rel, 9) AS rel, n_children FROM every",
    "class_dq": f"{_QUALITY} SELECT class, element_class, round(mean_dq, 9) AS mean_dq, dqs, n_children FROM every",
    "component_in_product": _two_heights(COMPONENT_IN_PRODUCT, "component_class"),
    "material_in_product": _two_heights(MATERIAL_IN_PRODUCT, "material_class"),
    "component_rollup": f"""SELECT e.parent AS component_parent, c.element_class, round(SUM(c.best) / MIN(k.n), 9) AS amount, round(sqrt(SUM(power(c.best * c.rel, 2))) / SUM(c.best), 9) AS rel, round(SUM(c.best * c.mean_dq) / SUM(c.best), 9) AS mean_dq, MAX(c.dqs) AS dqs, COUNT(*) AS n_children
        FROM ({COMPONENT_CONTENT}) c JOIN ({COMPONENT_EDGES}) e ON c.class = e.child JOIN (SELECT e.parent, COUNT(*) AS n FROM ({COMPONENT_EDGES}) e WHERE e.child IN (SELECT component_class FROM comp) GROUP BY e.parent) k ON k.parent = e.parent GROUP BY e.parent, c.element_class""",
    "material_in_component": f"""SELECT class AS component_class, material_class, round(best, 9) AS share, 0 AS n_children FROM ({MATERIAL_IN_COMPONENT}) m UNION ALL SELECT e.parent, m.material_class, round(SUM(m.best) / MIN(k.n), 9), COUNT(*)
        FROM ({MATERIAL_IN_COMPONENT}) m JOIN ({COMPONENT_EDGES}) e ON m.class = e.child JOIN (SELECT e.parent, COUNT(*) AS n FROM ({COMPONENT_EDGES}) e WHERE e.child IN (SELECT component_class FROM comp) GROUP BY e.parent) k ON k.parent = e.parent GROUP BY e.parent, m.material_class""",
}
