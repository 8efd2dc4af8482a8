"""Plans of unknown content: what coarse statements say beyond the paths that are known, each amount counted once.

A coarse statement of a part bounds it at its whole. Under one top, all wholes that bound a part are projected
to the top (statement times path fraction) and stand in order, deepest first. The first holds what exceeds the known paths,
each further one what exceeds the one before it. Amounts of 1e-12 and less are none.

Defined results: of wholes of one rank the smaller name comes first; a whole under several tops is projected to each;
one that its top reaches by several paths takes the largest; a null fraction counts as 0 and makes its paths null,
which count as 0 too. Repeated statements count once; loops end paths; nodes whose parents all lead into a loop have no top and no plan.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masschain.plans.tables import sql_query

from . import fixpoint, graph

LEAST = 1e-12


def telescoped(bounders: DataFrame, least: float = LEAST) -> DataFrame:
    """Bounders (top, part, whole, rank, projection, known: the known amount of the part in the top) with the amount that each adds."""
    deepest_first = Window.partitionBy("top", "part").orderBy(F.desc("rank"), "whole")
    before = F.coalesce(F.lag("projection").over(deepest_first), "known")
    return bounders.withColumn("amount", F.col("projection") - before).filter(F.col("amount") > least)


def plans(nodes: DataFrame, statements: DataFrame, levels: tuple[str, ...] = fixpoint.LEVELS, least: float = LEAST) -> DataFrame:
    """(top, part, whole, rank, amount, fillers) over nodes (node, cls, rank) and statements (id, whole, part, fraction).

    fillers are the levels strictly between whole and part on the deepest known path, else those of the ranks between.
    """
    stated = fixpoint.ranked(nodes, statements).withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    step = F.col("part_rank") - F.col("whole_rank")
    fine, coarse = stated.filter(step.isin(0, 1)), stated.filter(step >= 2)
    paths = graph.granular_reach(fine.select("whole", "part", F.col("fraction").alias("best"), "whole_rank", "part_rank"))
    ends = paths.groupBy(F.col("whole").alias("from"), F.col("part").alias("to")).agg(F.sum("fraction").alias("total"), F.max("fraction").alias("most"), F.max(F.struct(F.size("levels"), "levels"))["levels"].alias("levels"))
    tops = graph.roots_of(fine.select(F.col("part").alias("child"), F.col("whole").alias("parent"))).select(F.col("node").alias("whole"), F.col("root").alias("top"))
    own = coarse.select("whole").distinct().join(fine.select(F.col("part").alias("whole")), "whole", "left_anti").select("whole", F.col("whole").alias("top"))
    placed = coarse.groupBy("whole", "part", "whole_rank", "part_rank").agg(F.max("fraction").alias("fraction")).join(tops.unionByName(own), "whole")
    between = lambda a, b, *values: ends.select(F.col("from").alias(a), F.col("to").alias(b), *values)
    met = placed.join(between("top", "whole", F.col("most").alias("down")), ["top", "whole"], "left").join(between("top", "part", F.col("total").alias("known")), ["top", "part"], "left")
    met = met.join(between("whole", "part", "levels"), ["whole", "part"], "left")
    down = F.when(F.col("whole") == F.col("top"), F.lit(1.0)).otherwise(F.coalesce("down", F.lit(0.0)))
    names = F.array(*map(F.lit, levels))
    ranks = F.coalesce(F.slice("levels", F.lit(1), F.size("levels") - 1), F.sequence(F.col("whole_rank") + 1, F.col("part_rank") - 1))
    found = met.select("top", "part", "whole", F.col("whole_rank").alias("rank"), (F.col("fraction") * down).alias("projection"), F.coalesce("known", F.lit(0.0)).alias("known"), F.transform(ranks, lambda r: F.get(names, r)).alias("fillers"))
    return telescoped(found, least).select("top", "part", "whole", "rank", "amount", "fillers")


#: Products and components state their elements; one pass over the paths gives statements, projections and what is known.
_BOUNDERS = """SELECT ord AS top, element_class AS part, CASE WHEN sup IS NULL THEN concat('P', CAST(ord AS STRING)) ELSE concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)) END AS whole, CAST(sup IS NOT NULL AS INT) AS rank, projection,
    MAX(CASE WHEN sup IS NULL THEN known END) OVER (PARTITION BY ord, element_class) AS known
    FROM (SELECT ord, sup, element_class, SUM(kg_taxed * elem_best) / MIN(pmass) AS projection, SUM(f) AS known FROM path GROUP BY GROUPING SETS ((ord, element_class), (ord, sup, element_class))) g"""
_FILLERS = "CASE WHEN level_rank = 0 THEN 'Component/Material' ELSE 'Material' END"


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telescoped(sql_query(_BOUNDERS)(spark, sf_dir)).withColumnRenamed("rank", "level_rank")
    return found.select(F.col("top").alias("ord"), F.col("part").alias("element_class"), "whole", "level_rank", "amount", F.expr(_FILLERS).alias("fillers"))


def unknown_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plans; what lies midway between two roundings goes up."""
    return _planned(spark, sf_dir).withColumn("amount", F.round(F.col("amount") + LEAST, 9))


def inferred_unknown_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned amounts a product of each class, by the first unknown level, those after it, and the part."""
    placed = sql_query("SELECT ord, product_class FROM placed")(spark, sf_dir)
    n = sql_query("SELECT product_class, SUM(n) AS n FROM v_item_mass GROUP BY product_class")(spark, sf_dir)
    split = _planned(spark, sf_dir).withColumn("levels", F.split("fillers", "/"))
    each = split.join(placed, "ord").groupBy("product_class", F.get("levels", F.lit(0)).alias("first_level"), F.array_join(F.slice("levels", 2, 9), "/").alias("tail"), "element_class").agg(F.sum("amount").alias("total"))
    return each.join(n, "product_class").select("product_class", "first_level", "tail", "element_class", F.round(F.col("total") / F.col("n") + LEAST, 9).alias("unknown"))


_PLAN = f"""(SELECT ord, element_class, whole, level_rank, amount, {_FILLERS} AS fillers FROM (SELECT b.*, b.projection - coalesce(lag(b.projection) OVER (PARTITION BY b.ord, b.element_class ORDER BY b.level_rank DESC, b.whole), r.amount) AS amount
    FROM (SELECT ord, element_class, concat('P', CAST(ord AS STRING)) AS whole, 0 AS level_rank, lo AS projection FROM coarse
        UNION ALL SELECT m.ord, m.element_class, concat('C', CAST(m.ord AS STRING), '_', CAST(m.sup AS STRING)), 1, SUM(m.kg_taxed * m.elem_best) / MIN(pc.part_mass) * MIN(pc.best) FROM mat m JOIN pc ON m.ord = pc.ord AND m.sup = pc.sup GROUP BY m.ord, m.sup, m.element_class) b
    JOIN reach r ON b.ord = r.ord AND b.element_class = r.element_class) t WHERE amount > 1.0E-12) u"""

QUERIES = {"unknown_plan": unknown_plan, "inferred_unknown_content": inferred_unknown_content}
ORACLE = {
    "unknown_plan": f"SELECT ord, element_class, whole, level_rank, round(amount + 1.0E-12, 9) AS amount, fillers FROM {_PLAN}",
    "inferred_unknown_content": f"""SELECT p.product_class, CASE WHEN level_rank = 0 THEN 'Component' ELSE 'Material' END AS first_level, CASE WHEN level_rank = 0 THEN 'Material' ELSE '' END AS tail, u.element_class, round(SUM(u.amount) / MIN(n.n) + 1.0E-12, 9) AS unknown
        FROM {_PLAN} JOIN placed p ON u.ord = p.ord JOIN (SELECT product_class, COUNT(*) AS n FROM prod GROUP BY product_class) n ON p.product_class = n.product_class GROUP BY 1, 2, 3, 4""",
}
