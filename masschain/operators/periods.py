"""Periods of validity: consecutive years of one composition collapse into one.

A fact is (product, year, key, v, quality, meta): what stands at a key of the product's composition in a
year, with any number of values. Two years agree if they have the same keys and each key agrees in its values
(within TOLERANCE, relative above 1), its quality and its meta. A run starts at a year and takes the years after it without a
gap while they agree with its first year, not with their neighbour, so slow drift ends it.

Each key of a product finds by itself, for every year, the first later year at which it differs; the
least over the keys is where a run from that year breaks. So the work is dealt by (product, key), and what
meets for a product is one number a year, along which runs are walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import tables

TOLERANCE = 1e-9


def _differs(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two structs (v, quality, meta), null if the year has not the key, differ."""
    near = lambda x, y: x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
    values = (F.size(a["v"]) == F.size(b["v"])) & F.forall(F.zip_with(a["v"], b["v"], near), lambda x: x)
    same = values & a["quality"].eqNullSafe(b["quality"]) & a["meta"].eqNullSafe(b["meta"])
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(~F.coalesce(same, F.lit(False)))


def breaks(facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(product, year, breaks): the first later year of the product that does not agree with the year; null if all do."""
    cell = F.struct("v", "quality", "meta")
    by_key = facts.groupBy("product", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", cell)))).alias("cells"))
    years = facts.groupBy("product").agg(F.array_sort(F.collect_set("year")).alias("years"))
    met = by_key.join(years, "product")
    at = lambda y: F.try_element_at("cells", y)
    first = F.transform("years", lambda s: F.struct(s.alias("year"), F.array_min(F.filter("years", lambda y: (y > s) & _differs(at(s), at(y), tolerance))).alias("breaks")))
    each = met.select("product", F.inline(first))
    return each.groupBy("product", "year").agg(F.min("breaks").alias("breaks"))


def runs(facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(product, y0, y1): the periods of each product. Years of one (product, year, key) must not repeat; null products and years are left out."""
    facts = facts.filter("product IS NOT NULL AND year IS NOT NULL")
    by_product = breaks(facts, tolerance).groupBy("product").agg(F.array_sort(F.collect_list(F.struct("year", "breaks"))).alias("years"))
    nothing = F.lit(None).cast("struct<y0: int, y1: int, breaks: int>")
    start = F.struct(F.array().cast("array<struct<y0: int, y1: int>>").alias("done"), nothing.alias("run"))

    def step(state: Column, at: Column) -> Column:
        run = state["run"]
        goes_on = run.isNotNull() & (at["year"] == run["y1"] + 1) & (run["breaks"].isNull() | (at["year"] < run["breaks"]))
        closed = F.when(run.isNull(), state["done"]).otherwise(F.array_append(state["done"], F.struct(run["y0"].alias("y0"), run["y1"].alias("y1"))))
        longer = F.struct(run["y0"].alias("y0"), at["year"].alias("y1"), run["breaks"].alias("breaks"))
        fresh = F.struct(at["year"].alias("y0"), at["year"].alias("y1"), at["breaks"].alias("breaks"))
        return F.when(goes_on, F.struct(state["done"].alias("done"), longer.alias("run"))).otherwise(F.struct(closed.alias("done"), fresh.alias("run")))

    last = lambda s: F.array_append(s["done"], F.struct(s["run"]["y0"].alias("y0"), s["run"]["y1"].alias("y1")))
    return by_product.select("product", F.inline(F.aggregate("years", start, step, last)))


def fingerprints(facts: DataFrame) -> DataFrame:
    """(product, year, n, fingerprint): the ordered keys of a year with their values to nine digits, quality and meta, as a digest."""
    shown = F.array_join(F.transform("v", lambda x: F.coalesce(F.format_number(x, 9), F.lit("-"))), "|")
    cell = F.concat_ws(":", "key", shown, F.coalesce(F.col("quality").cast("string"), F.lit("-")), F.coalesce(F.col("meta").cast("string"), F.lit("-")))
    return facts.groupBy("product", "year").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(cell)), ";")).alias("fingerprint"))


# --- over the given tables: material classes, whose elements are those of the parts that a year sells ------

#: One row for each part that a year sells.
_SOLD = "SELECT DISTINCT m.material_class, p.yr, m.prt, m.element_class, m.elem_best, m.lo, m.hi, m.dqs FROM stmt m JOIN placed p ON m.ord = p.ord"
FACTS = f"""SELECT material_class AS product, yr AS year, element_class AS key, AVG(elem_best) AS best, AVG(lo) AS lo, AVG(hi) AS hi, MAX(dqs) AS quality, COUNT(*) AS meta FROM ({_SOLD}) s GROUP BY material_class, yr, element_class"""


def material_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sql_query(FACTS)(spark, sf_dir).select("product", "year", "key", F.array("best", "lo", "hi").alias("v"), "quality", "meta")


def year_run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(material_facts(spark, sf_dir))
    return found.select(F.col("product").alias("material_class"), "y0", "y1", (F.col("y1") - F.col("y0") + 1).alias("n"))


def composition_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = tables.sql_query(f"SELECT material_class AS product, yr AS year, element_class AS key, CAST(SUM(CAST(round(elem_best * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS v, MAX(dqs) AS quality, COUNT(*) AS meta FROM ({_SOLD}) s GROUP BY material_class, yr, element_class")
    facts = exact(spark, sf_dir).withColumn("v", F.array(F.floor(F.col("v") * 1024) / 1024))
    return fingerprints(facts).select(F.col("product").alias("material_class"), F.col("year").alias("yr"), "n", "fingerprint")


QUERIES = {"year_run_islands": year_run_islands, "composition_fingerprint": composition_fingerprint}
ORACLE = {
    # all pairs of years of a class, by full outer comparison; then runs year by year
    "year_run_islands": f"""WITH RECURSIVE f AS ({FACTS}), y AS (SELECT DISTINCT product, year FROM f), pairs AS (SELECT a.product, a.year AS s, b.year AS t FROM y a JOIN y b ON a.product = b.product AND a.year < b.year),
        k AS (SELECT p.product, p.s, p.t, x.key FROM pairs p JOIN f x ON x.product = p.product AND x.year = p.s UNION SELECT p.product, p.s, p.t, x.key FROM pairs p JOIN f x ON x.product = p.product AND x.year = p.t),
        bad AS (SELECT DISTINCT k.product, k.s, k.t FROM k LEFT JOIN f a ON a.product = k.product AND a.year = k.s AND a.key = k.key LEFT JOIN f b ON b.product = k.product AND b.year = k.t AND b.key = k.key
            WHERE a.key IS NULL OR b.key IS NULL OR abs(a.best - b.best) > 1.0E-9 OR abs(a.lo - b.lo) > 1.0E-9 OR abs(a.hi - b.hi) > 1.0E-9 OR a.quality <> b.quality OR a.meta <> b.meta),
        r AS (SELECT product, MIN(year) AS s, MIN(year) AS t FROM y GROUP BY product UNION ALL
            SELECT r.product, CASE WHEN n.year = r.t + 1 AND b.s IS NULL THEN r.s ELSE n.year END, n.year FROM r JOIN (SELECT product, year, lag(year) OVER (PARTITION BY product ORDER BY year) AS before FROM y) n ON n.product = r.product AND n.before = r.t
            LEFT JOIN bad b ON b.product = r.product AND b.s = r.s AND b.t = n.year)
        SELECT product AS material_class, s AS y0, MAX(t) AS y1, MAX(t) - s + 1 AS n FROM r GROUP BY product, s""",
    "composition_fingerprint": f"""SELECT material_class, yr, COUNT(*) AS n, md5(string_agg(concat(element_class, ':', printf('%.9f', floor(v * 1024) / 1024), ':', CAST(quality AS VARCHAR), ':', CAST(meta AS VARCHAR)), ';' ORDER BY concat(element_class, ':'))) AS fingerprint
        FROM (SELECT material_class, yr, element_class, CAST(SUM(CAST(round(elem_best * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS v, MAX(dqs) AS quality, COUNT(*) AS meta FROM ({_SOLD}) s GROUP BY material_class, yr, element_class) c GROUP BY material_class, yr""",
}
