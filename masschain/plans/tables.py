"""The composition projection of the base tables, as common table expressions.

Products are orders, components are (order, supplier), materials are (order, supplier,
part) and elements are part types within a material. Every edge's key starts with the
order, so line items are dealt by order once: grouping, the masses of components and
products (windows) and all paths follow in that one exchange, without self-joins.

`CTES` is what Spark runs. `CHECK_CTES` derives the same tables by plain joins between
base tables and edge tables, for the comparison with another engine: the two share no
derivation above the columns of single line items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import shared
from .ruleset import DEFAULT, DIMENSIONS, Ruleset

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations", "benchmark")

#: Six scores in 1..3, the base-3 digits of the part key.
_SCORES = ", ".join(f"1 + CAST(floor(prt / {3**i}.0E0) AS BIGINT) % 3 AS q_{d}" for i, d in enumerate(DIMENSIONS))
_MASSES = "SUM(l_quantity) AS kg, SUM(l_quantity * (1 + l_tax)) AS kg_taxed, MIN(l_returnflag) AS source_id, MIN(l_linestatus) AS status, COUNT(*) AS n_rows"
_MAT = f"""SELECT ord, sup, prt, kg, kg_taxed, source_id, status, n_rows, material_class, substr(material_class, 1, 7) AS material_parent, element_class, p_size / 100.0E0 AS elem_best,
    component_class, component_parent, {_SCORES} FROM"""
#: Where orders stand: their class, year and axis value.
_PLACED = """SELECT o_orderkey AS ord, concat(c_mktsegment, '/', n_name) AS product_class, c_mktsegment AS product_parent, CAST(year(o_orderdate) AS INT) AS yr, r_name AS axis_value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_TAXONOMY = """SELECT DISTINCT concat(c_mktsegment, '/', n_name) AS child, c_mktsegment AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT DISTINCT c_mktsegment, 'Product' FROM customer UNION SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT DISTINCT r_name, 'Component' FROM region UNION SELECT DISTINCT p_brand, substr(p_brand, 1, 7) FROM part WHERE p_brand <> substr(p_brand, 1, 7) UNION SELECT DISTINCT substr(p_brand, 1, 7), 'Material' FROM part
    UNION SELECT DISTINCT p_type, 'Element' FROM part"""
#: A year slice of a class, its scope, and what it is averaged into: the slice of the parent class, and the class itself.
_SLICES = {
    "class_time": (("scopes",), """SELECT (product_class || '_Y' || CAST(yr AS STRING)) AS class, yr AS y0, yr AS y1 FROM scopes
        UNION SELECT (product_parent || '_Y' || CAST(yr AS STRING)), yr, yr FROM scopes"""),
    "slices": (("scopes",), """SELECT (product_class || '_Y' || CAST(yr AS STRING)) AS class, product_class AS parent, 'year' AS axis FROM scopes
        UNION SELECT (product_parent || '_Y' || CAST(yr AS STRING)), product_parent, 'year' FROM scopes"""),
    "subclass": (("scopes",), """SELECT (product_class || '_Y' || CAST(yr AS STRING)) AS child, (product_parent || '_Y' || CAST(yr AS STRING)) AS parent FROM scopes
        UNION SELECT (product_class || '_Y' || CAST(yr AS STRING)), product_class FROM scopes UNION SELECT (product_parent || '_Y' || CAST(yr AS STRING)), product_parent FROM scopes
        UNION SELECT product_class, product_parent FROM scopes"""),
    "strategy": (("scopes",), "SELECT DISTINCT (product_parent || '_Y' || CAST(yr AS STRING)) AS class, 'equal-subclass-mean' AS strategy FROM scopes UNION SELECT DISTINCT product_parent, 'year-slice-mean' FROM scopes"),
    # a scoped parent takes scoped children inside its span; one that is a mean of slices, declared or sliced, takes scoped children; any other takes none
    "gate": (("subclass", "class_time", "strategy", "slices"), """SELECT e.parent, e.child FROM subclass e JOIN class_time c ON e.child = c.class LEFT JOIN class_time p ON e.parent = p.class
        LEFT JOIN strategy s ON e.parent = s.class LEFT JOIN (SELECT DISTINCT parent AS sliced FROM slices) l ON e.parent = l.sliced
        WHERE CASE WHEN p.class IS NOT NULL THEN p.y0 <= c.y0 AND c.y1 <= p.y1 ELSE s.strategy = 'year-slice-mean' OR (s.strategy IS NULL AND l.sliced IS NOT NULL) END"""),
    "slice_mean": (("leaf_mean",), "SELECT (product_class || '_Y' || CAST(yr AS STRING)) AS class, element_class, amount FROM leaf_mean WHERE amount > 0"),
    # by height: slices of parents and classes from leaf slices, then parents from their slices
    "mean_1": (("slice_mean", "gate"), "SELECT g.parent AS class, m.element_class, AVG(m.amount) AS amount, COUNT(*) AS n_children FROM slice_mean m JOIN gate g ON m.class = g.child GROUP BY g.parent, m.element_class"),
    "mean_2": (("mean_1", "gate"), "SELECT g.parent AS class, m.element_class, AVG(m.amount) AS amount, COUNT(*) AS n_children FROM mean_1 m JOIN gate g ON m.class = g.child GROUP BY g.parent, m.element_class"),
    "gated_mean": (("mean_1", "mean_2"), "SELECT * FROM mean_1 UNION ALL SELECT * FROM mean_2"),
    "slice_mass": (("item_mass",), "SELECT (product_class || '_Y' || CAST(yr AS STRING)) AS class, mass FROM item_mass"),
    "mass_1": (("slice_mass", "gate"), "SELECT g.parent AS class, AVG(m.mass) AS mass, COUNT(*) AS n_children FROM slice_mass m JOIN gate g ON m.class = g.child GROUP BY g.parent"),
    "mass_2": (("mass_1", "gate"), "SELECT g.parent AS class, AVG(m.mass) AS mass, COUNT(*) AS n_children FROM mass_1 m JOIN gate g ON m.class = g.child GROUP BY g.parent"),
    "gated_mass": (("mass_1", "mass_2"), "SELECT * FROM mass_1 UNION ALL SELECT * FROM mass_2"),
}
#: What is written once and looked up: see view.py.
SERVED = ("leaf_mean", "item_mass", "gated_mean", "gated_mass", "closure", "component_share", "material_share", "scope_amount")
#: Small tables of classes that many queries read: Spark takes them from the view under their own names.
SERVED_CLASSES = ("closure", "scopes", "gate")
_SHARES = {
    "component_share": (("pc", "placed", "n_products"), """SELECT p.product_class, p.product_parent, p.yr, e.component_class, SUM(e.best) / MIN(n.n) AS share, AVG(e.best) AS mean_share, COUNT(*) AS n FROM pc e JOIN placed p ON e.ord = p.ord
        JOIN n_products n ON p.product_class = n.product_class AND p.yr = n.yr GROUP BY p.product_class, p.product_parent, p.yr, e.component_class"""),
    "material_share": (("cm", "n_components"), """SELECT c.component_class, c.material_class, SUM(c.best) / MIN(n.n) AS share, AVG(c.best) AS mean_share FROM cm c
        JOIN n_components n ON c.component_class = n.component_class GROUP BY c.component_class, c.material_class"""),
    "scope_amount": (("ppath",), """SELECT product_parent, product_class, component_class, element_class, SUM(f2 * f3 * cmass) / SUM(f2 * cmass) AS amount, AVG(f2 * f3) AS mean_amount, SUM(f2 * f3) AS total, COUNT(*) AS n FROM ppath
        GROUP BY product_parent, product_class, component_class, element_class"""),
}
#: Served tables that are sums over paths: their keys among those of `path_sums`, and what they make of its sums.
PATH_SUMS = {
    "leaf_mean": (("product_class", "product_parent", "yr", "element_class"), """SELECT product_class, product_parent, yr, element_class, total / SUM(products) OVER (PARTITION BY product_class, yr) AS amount,
        sqrt(variance) / nullif(total, 0.0E0) AS rel, quality / nullif(total, 0.0E0) AS mean_dq, dqs FROM sums WHERE product_class IS NOT NULL"""),
    "component_share": (("product_class", "product_parent", "yr", "component_class"), """SELECT s.product_class, s.product_parent, s.yr, s.component_class, s.component_best / n.n AS share, s.component_mean AS mean_share, s.components AS n
        FROM sums s JOIN n_products n ON s.product_class = n.product_class AND s.yr = n.yr"""),
    "material_share": (("component_class", "material_class"), "SELECT component_class, material_class, material_best / SUM(components) OVER (PARTITION BY component_class) AS share, material_mean AS mean_share FROM sums"),
    "scope_amount": (("product_parent", "product_class", "component_class", "element_class"), """SELECT product_parent, product_class, component_class, element_class, weighted / weight AS amount, content_mean AS mean_amount, content AS total, n
        FROM sums WHERE product_class IS NOT NULL"""),
}


def path_sums(names: Sequence[str]) -> str:
    """Sums over all paths by the keys of each of the tables named, of one pass over the line items; of_table says whose a row is."""
    every = sorted({k for name in names for k in PATH_SUMS[name][0]})
    marks = {sum((k not in PATH_SUMS[name][0]) << i for i, k in enumerate(reversed(every))): name for name in names}
    whose = " ".join(f"WHEN {mark} THEN '{name}'" for mark, name in marks.items())
    return f"""SELECT CASE grouping_id({', '.join(every)}) {whose} END AS of_table, {', '.join(every)}, SUM(f) AS total, SUM(variance) AS variance, SUM(f * mean_dq) AS quality, MAX(dqs) AS dqs, SUM(CAST(of_product AS INT)) AS products,
        SUM(component_part) AS component_best, AVG(component_part) AS component_mean, SUM(CAST(of_component AS INT)) AS components, SUM(f2) AS material_best, AVG(f2) AS material_mean,
        SUM(content * cmass) AS weighted, SUM(f2 * cmass) AS weight, SUM(content) AS content, AVG(content) AS content_mean, COUNT(*) AS n
        FROM (SELECT t.*, p.product_class, p.product_parent, p.yr, power(f * sigma_rel, 2) AS variance, CASE WHEN of_component THEN f1 END AS component_part, f2 * f3 AS content FROM marked t LEFT JOIN placed p ON t.ord = p.ord) x
        GROUP BY {', '.join(every)} GROUPING SETS ({', '.join('(' + ', '.join(PATH_SUMS[name][0]) + ')' for name in names)})"""


def ctes(rules: Ruleset = DEFAULT) -> dict[str, tuple[tuple[str, ...], str]]:
    """name -> (names that it reads, text), for Spark."""
    stated = lambda quality: f"""SELECT *, lim / sqrt(3.0E0) AS sigma_rel, CASE WHEN status = 'F' THEN 'gkg' ELSE 'kgkg' END AS unit, elem_best * (1 - lim) AS lo, elem_best * (1 + lim) AS hi
            FROM (SELECT *, {rules.score_of('mean_dq')} AS dqs, {rules.limit_of('weighted')} AS lim FROM (SELECT *, {quality} FROM mat))"""  # noqa: E731
    return {
        # measured mass by (order, supplier, part); line items repeat that key
        "facts": ((), f"""SELECT ord, sup, prt, {_MASSES} FROM (SELECT /*+ REPARTITION(ord) */ l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, l_quantity, l_tax, l_returnflag, l_linestatus FROM lineitem) GROUP BY ord, sup, prt"""),
        "mat": ((), f"""{_MAT} (SELECT ord, sup, prt, {_MASSES}, MIN(p_size) AS p_size, MIN(p_brand) AS material_class, MIN(p_type) AS element_class, MIN(n_name) AS component_class, MIN(r_name) AS component_parent
            FROM (SELECT /*+ REPARTITION(ord), BROADCAST(part), BROADCAST(supplier) */ l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, l_quantity, l_tax, l_returnflag, l_linestatus, p_size, p_brand, p_type, n_name, r_name
            FROM lineitem JOIN part AS part ON l_partkey = p_partkey JOIN supplier AS supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ord, sup, prt)"""),
        # with quality, limit, interval and masses of the wholes
        "stmt": (("mat",), stated(f"{rules.mean_quality()} AS mean_dq, {rules.weighted_quality()} AS weighted")),
        # for filters on limits: they do not pass an inline, while in stmt they would hold the whole sum of scores for every comparison
        "stmt_filtered": (("mat",), stated(f"inline(array(named_struct('mean_dq', {rules.mean_quality()}, 'weighted', {rules.weighted_quality()})))")),
        "dq": (("stmt",), "SELECT * FROM stmt"),
        "path": (("stmt",), """SELECT *, cmass / pmass AS f1, kg / cmass AS f2, elem_best AS f3, cmass / pmass * (kg / cmass) * elem_best AS f
            FROM (SELECT *, SUM(kg) OVER (PARTITION BY ord) AS pmass FROM (SELECT *, SUM(kg) OVER (PARTITION BY ord, sup) AS cmass FROM stmt))"""),
        # paths with a mark on one path of each component and one of each product
        "marked": (("stmt",), """SELECT *, cmass / pmass AS f1, kg / cmass AS f2, elem_best AS f3, cmass / pmass * (kg / cmass) * elem_best AS f, prt = head AS of_component, prt = head AND sup = first_sup AS of_product
            FROM (SELECT *, SUM(kg) OVER (PARTITION BY ord) AS pmass, MIN(sup) OVER (PARTITION BY ord) AS first_sup FROM (SELECT *, SUM(kg) OVER (PARTITION BY ord, sup) AS cmass, MIN(prt) OVER (PARTITION BY ord, sup) AS head FROM stmt))"""),
        "comp": (("mat",), "SELECT ord, sup, MIN(component_class) AS component_class, MIN(component_parent) AS component_parent, SUM(kg) AS mass FROM mat GROUP BY ord, sup"),
        "pc": (("comp",), "SELECT ord, sup, component_class, component_parent, mass AS part_mass, pmass, mass / pmass AS best FROM (SELECT *, SUM(mass) OVER (PARTITION BY ord) AS pmass FROM comp)"),
        "cm": (("mat",), "SELECT ord, sup, prt, component_class, material_class, material_parent, kg / cmass AS best FROM (SELECT *, SUM(kg) OVER (PARTITION BY ord, sup) AS cmass FROM mat)"),
        "me": (("mat",), "SELECT ord, sup, prt, element_class, elem_best AS best FROM mat"),
        "prod_mass": ((), "SELECT l_orderkey AS ord, SUM(l_quantity) AS mass FROM lineitem GROUP BY l_orderkey"),
        "placed": ((), _PLACED),
        "prod": (("prod_mass", "placed"), "SELECT m.ord, m.mass, p.product_class, p.product_parent, p.yr, p.axis_value FROM prod_mass m JOIN placed p ON m.ord = p.ord"),
        "ppath": (("path", "placed"), "SELECT t.*, p.product_class, p.product_parent, p.yr, p.axis_value FROM path t JOIN placed p ON t.ord = p.ord"),
        "reach": (("path",), "SELECT ord, element_class, SUM(f) AS amount FROM path GROUP BY ord, element_class"),
        "coarse": (("path",), "SELECT ord, element_class, SUM(kg_taxed * elem_best) / MIN(pmass) AS lo FROM path GROUP BY ord, element_class"),
        # fine and coarse sums of one pass, and of one element of each product a mark
        "levels": (("path",), """SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY element_class) = 1 AS INT) AS first
            FROM (SELECT ord, element_class, SUM(f) AS amount, SUM(kg_taxed * elem_best) / MIN(pmass) AS lo, MIN(pmass) AS pmass, SUM(power(f * sigma_rel, 2)) AS variance, SUM(f * mean_dq) AS quality, MAX(dqs) AS dqs FROM path GROUP BY ord, element_class)"""),
        "leaf_mean": (("levels", "placed"), """SELECT product_class, product_parent, yr, element_class, total / SUM(firsts) OVER (PARTITION BY product_class, yr) AS amount, rel, mean_dq, dqs
            FROM (SELECT p.product_class, p.product_parent, p.yr, r.element_class, SUM(r.amount) AS total, SUM(r.first) AS firsts, sqrt(SUM(r.variance)) / nullif(SUM(r.amount), 0.0E0) AS rel, SUM(r.quality) / nullif(SUM(r.amount), 0.0E0) AS mean_dq, MAX(r.dqs) AS dqs FROM levels r JOIN placed p ON r.ord = p.ord GROUP BY p.product_class, p.product_parent, p.yr, r.element_class)"""),
        "item_mass": (("prod",), "SELECT product_class, product_parent, yr, AVG(mass) AS mass, COUNT(*) AS n FROM prod GROUP BY product_class, product_parent, yr"),
        "ancestor_mean": (("leaf_mean",), "SELECT product_parent, yr, element_class, AVG(amount) AS amount, COUNT(*) AS n_children FROM leaf_mean GROUP BY product_parent, yr, element_class"),
        "scopes": (("placed",), "SELECT DISTINCT product_class, product_parent, yr FROM placed WHERE ord IN (SELECT l_orderkey FROM lineitem)"),
        "n_products": (("item_mass",), "SELECT product_class, yr, n FROM item_mass"),
        "n_components": (("comp",), "SELECT component_class, COUNT(*) AS n FROM comp GROUP BY component_class"),
        "dqs_band": ((), rules.score_table()), "limit_band": ((), rules.limit_table()),
        "taxonomy": ((), _TAXONOMY), **_SLICES, **_SHARES,
    }


def check_ctes(rules: Ruleset = DEFAULT) -> dict[str, tuple[tuple[str, ...], str]]:
    """The same tables by plain joins, for another engine."""
    return {
        "facts": ((), f"SELECT l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, {_MASSES} FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey"),
        "mat": (("facts",), f"""{_MAT} (SELECT f.*, p_size, p_brand AS material_class, p_type AS element_class, n_name AS component_class, r_name AS component_parent FROM facts f
            JOIN part ON f.prt = p_partkey JOIN supplier ON f.sup = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) f"""),
        "comp": (("mat",), "SELECT ord, sup, component_class, component_parent, SUM(kg) AS mass FROM mat GROUP BY ord, sup, component_class, component_parent"),
        "prod_mass": (("facts",), "SELECT ord, SUM(kg) AS mass FROM facts GROUP BY ord"),
        "placed": ((), _PLACED),
        "prod": (("prod_mass", "placed"), "SELECT m.ord, m.mass, p.product_class, p.product_parent, p.yr, p.axis_value FROM prod_mass m JOIN placed p ON m.ord = p.ord"),
        "pc": (("comp", "prod_mass"), "SELECT c.ord, c.sup, c.component_class, c.component_parent, c.mass AS part_mass, p.mass AS pmass, c.mass / p.mass AS best FROM comp c JOIN prod_mass p ON c.ord = p.ord"),
        "cm": (("mat", "comp"), "SELECT m.ord, m.sup, m.prt, m.component_class, m.material_class, m.material_parent, m.kg / c.mass AS best FROM mat m JOIN comp c ON m.ord = c.ord AND m.sup = c.sup"),
        "me": (("mat",), "SELECT ord, sup, prt, element_class, elem_best AS best FROM mat"),
        "dqs_band": ((), rules.score_table()), "limit_band": ((), rules.limit_table()),
        "dq": (("mat",), f"SELECT *, {rules.mean_quality()} AS mean_dq, {rules.weighted_quality()} AS weighted FROM mat"),
        "stmt": (("dq", "limit_band", "dqs_band"), """SELECT d.*, b.dqs, l.lim, l.lim / sqrt(3.0E0) AS sigma_rel, CASE WHEN status = 'F' THEN 'gkg' ELSE 'kgkg' END AS unit, elem_best * (1 - lim) AS lo, elem_best * (1 + lim) AS hi
            FROM dq d LEFT JOIN limit_band l ON d.weighted >= l.lo AND d.weighted < l.hi LEFT JOIN dqs_band b ON d.mean_dq >= b.lo AND d.mean_dq < coalesce(b.hi, 1.0E300)"""),
        "path": (("pc", "cm", "me", "stmt"), """SELECT s.*, pc.pmass, pc.part_mass AS cmass, pc.best AS f1, cm.best AS f2, me.best AS f3, pc.best * cm.best * me.best AS f FROM pc JOIN cm ON pc.ord = cm.ord AND pc.sup = cm.sup
            JOIN me ON cm.ord = me.ord AND cm.sup = me.sup AND cm.prt = me.prt JOIN stmt s ON me.ord = s.ord AND me.sup = s.sup AND me.prt = s.prt"""),
        "ppath": (("path", "prod"), "SELECT t.*, p.product_class, p.product_parent, p.yr, p.axis_value FROM path t JOIN prod p ON t.ord = p.ord"),
        "reach": (("path",), "SELECT ord, element_class, SUM(f) AS amount FROM path GROUP BY ord, element_class"),
        "coarse": (("mat", "prod_mass"), "SELECT m.ord, m.element_class, SUM(m.kg_taxed * m.elem_best) / MIN(p.mass) AS lo FROM mat m JOIN prod_mass p ON m.ord = p.ord GROUP BY m.ord, m.element_class"),
        "levels": (("reach", "coarse", "prod_mass"), "SELECT r.ord, r.element_class, r.amount, c.lo, p.mass AS pmass FROM reach r JOIN coarse c ON r.ord = c.ord AND r.element_class = c.element_class JOIN prod_mass p ON r.ord = p.ord"),
        "n_products": (("prod",), "SELECT product_class, yr, COUNT(*) AS n FROM prod GROUP BY product_class, yr"),
        "n_components": (("comp",), "SELECT component_class, COUNT(*) AS n FROM comp GROUP BY component_class"),
        "leaf_amount": (("reach", "prod", "n_products"), """SELECT p.product_class, p.product_parent, p.yr, r.element_class, SUM(r.amount) / MIN(n.n) AS amount FROM reach r JOIN prod p ON r.ord = p.ord
            JOIN n_products n ON p.product_class = n.product_class AND p.yr = n.yr GROUP BY p.product_class, p.product_parent, p.yr, r.element_class"""),
        "leaf_quality": (("ppath",), """SELECT product_class, yr, element_class, sqrt(SUM(power(f * sigma_rel, 2))) / SUM(f) AS rel, SUM(f * mean_dq) / SUM(f) AS mean_dq, MAX(dqs) AS dqs FROM ppath GROUP BY product_class, yr, element_class"""),
        "leaf_mean": (("leaf_amount", "leaf_quality"), """SELECT a.*, q.rel, q.mean_dq, q.dqs FROM leaf_amount a JOIN leaf_quality q ON a.product_class = q.product_class AND a.yr = q.yr AND a.element_class = q.element_class"""),
        "item_mass": (("prod",), "SELECT product_class, product_parent, yr, SUM(mass) / COUNT(*) AS mass, COUNT(*) AS n FROM prod GROUP BY product_class, product_parent, yr"),
        "ancestor_mean": (("leaf_mean",), "SELECT product_parent, yr, element_class, SUM(amount) / COUNT(*) AS amount, COUNT(*) AS n_children FROM leaf_mean GROUP BY product_parent, yr, element_class"),
        "scopes": (("prod",), "SELECT DISTINCT product_class, product_parent, yr FROM prod"),
        "taxonomy": ((), _TAXONOMY),
        # hierarchies of the given tables end two levels below their roots
        "closure": (("taxonomy",), "SELECT child AS descendant, parent AS ancestor, 1 AS depth FROM taxonomy UNION SELECT a.child, b.parent, 2 FROM taxonomy a JOIN taxonomy b ON a.parent = b.child"),
        **_SLICES, **_SHARES,
    } | {f"v_{name}": ((name,), f"SELECT * FROM {name}") for name in SERVED}


CTES, CHECK_CTES = ctes(), check_ctes()


def with_ctes(body: str, known: dict | None = None) -> str:
    """The body behind the tables that it needs, in order."""
    known = CTES if known is None else known
    needed: list[str] = []

    def visit(name: str) -> None:
        for other in known[name][0]:
            if other in known:
                visit(other)
        if name not in needed:
            needed.append(name)

    for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", body):
        if name in known:
            visit(name)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    heads = ", ".join(f"{n} AS ({known[n][1]})" for n in needed)
    if own:
        rest = body[own.end() :]
        return f"WITH {own[1] or ''}{heads + ', ' if heads else ''}{rest}"
    return f"WITH {heads} {body}" if heads else body


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items are dealt by order over partitions of so many bytes of their file, some 200,000 rows, whatever the number of shuffle partitions.
DEALT_BYTES = 4_000_000
#: Parts and suppliers are sent to all line items up to so many bytes of their file. Larger ones are hashed in each partition, where line items pass unsorted.
SENT_BYTES = 16_000_000


def dealt(spark: SparkSession, sf_dir: str, text: str) -> str:
    """The text with as many partitions of line items as their size asks for, and joins by the size of what line items meet.

    Without a number, partitions are put together at run time up to some 64 MB packed, a million line items and more to one task; that is left to sizes
    that ask for fewer partitions than there are cores.
    """
    if "REPARTITION(ord)" not in text:
        return text
    for name in ("part", "supplier"):
        if f"BROADCAST({name})" in text and shared.size_of(spark, f"{sf_dir}/{name}.parquet") > SENT_BYTES:
            text = text.replace(f"BROADCAST({name})", f"SHUFFLE_HASH({name})")
    wanted = -(-shared.size_of(spark, f"{sf_dir}/lineitem.parquet") // DEALT_BYTES)
    return text.replace("REPARTITION(ord)", f"REPARTITION({wanted}, ord)") if wanted > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else text


def run(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over the base tables of a folder and the frames given. No view of the session is made or replaced."""
    text = dealt(spark, sf_dir, text)
    named = frames | {t: read(spark, sf_dir, t) for t in BASE_TABLES if t not in frames and re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)}
    bound = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in named else m[0], text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(bound, **{n: f for n, f in named.items() if f"{{{n}}}" in bound}) if named else spark.sql(text)


def sql_query(body: str, rules: Ruleset | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the base tables, the projection and the served view (v_ names)."""
    known = CTES if rules is None else ctes(rules)
    text = with_ctes(body, {k: v for k, v in known.items() if k not in SERVED_CLASSES})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import view

        view.prepare(spark, sf_dir, [t for t in PATH_SUMS if re.search(rf"(?:FROM|JOIN)\s+v_{t}\b", text)])
        served = {f"v_{t}": view.served(spark, sf_dir, t) for t in SERVED if re.search(rf"(?:FROM|JOIN)\s+v_{t}\b", text)}
        served |= {t: view.served(spark, sf_dir, t) for t in SERVED_CLASSES if re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)}
        return run(spark, sf_dir, text, **served)

    return query
