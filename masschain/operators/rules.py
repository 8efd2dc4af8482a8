"""Data-quality rules: each gives its violations, and no row where the tables conform."""

_LEVELS = "('Product', 'Component', 'Material', 'Element')"
_DIMS = ("validity", "accuracy", "consistency", "integrity", "timeliness", "completeness")
_OUT_OF_RANGE = " OR ".join(f"q_{d} < 0 OR q_{d} > 3" for d in _DIMS)
#: Edges between classes with the ranks of their levels.
_CLASS_EDGES = """SELECT DISTINCT w.class AS whole, p.class AS part, w.rank AS whole_rank, p.rank AS part_rank FROM (
    SELECT DISTINCT p.product_class AS whole, e.component_class AS part FROM pc e JOIN placed p ON e.ord = p.ord UNION SELECT DISTINCT component_class, material_class FROM mat UNION SELECT DISTINCT material_class, element_class FROM mat) e
    JOIN ranked w ON e.whole = w.class JOIN ranked p ON e.part = p.class"""
_RANKED = """WITH ranked AS (SELECT DISTINCT descendant AS class, CASE ancestor WHEN 'Product' THEN 0 WHEN 'Component' THEN 1 WHEN 'Material' THEN 2 ELSE 3 END AS rank FROM closure WHERE ancestor IN ('Product', 'Component', 'Material', 'Element')) """
#: Classes without scope or strategy; Spark looks the classes of all facts up in one table of distinct ones, as an OR of columns would hold each class against each fact.
_DIAG = """SELECT 'T' AS rule, t.child FROM taxonomy t WHERE NOT EXISTS (SELECT 1 FROM class_time c WHERE c.class = t.child) AND NOT EXISTS (SELECT 1 FROM subclass s JOIN class_time c ON s.child = c.class WHERE s.parent = t.child)
        AND EXISTS (SELECT 1 FROM closure k WHERE k.descendant = t.child AND k.ancestor IN ('Product', 'Component'))
        UNION ALL SELECT 'S', t.child FROM taxonomy t WHERE NOT EXISTS (SELECT 1 FROM strategy s WHERE s.class = t.child) AND NOT EXISTS ({})"""
_PARAMS = "SELECT 'distribution' AS rule, ord, sup, prt FROM {} WHERE lim IS NULL OR lo <= 0 OR hi <= 0 OR lo > elem_best OR hi < elem_best"

SQL = {
    "rule_edge_required": "SELECT 'edge_required' AS rule, l_orderkey AS ord, l_partkey AS prt FROM lineitem WHERE l_partkey IS NULL OR l_quantity IS NULL OR l_shipdate IS NULL",
    "rule_edge_unit": "SELECT 'edge_unit' AS rule, ord, sup, prt FROM facts WHERE status IS NULL OR status NOT IN ('F', 'O')",
    "rule_six_dq": "SELECT 'six_dq' AS rule, l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt FROM lineitem WHERE l_partkey IS NULL",
    "rule_dq_range": f"SELECT 'dq_range' AS rule, ord, sup, prt FROM mat WHERE {_OUT_OF_RANGE}",
    "rule_statement_meta": "SELECT 'statement_meta' AS rule, o_orderkey AS ord FROM orders o WHERE o_orderdate IS NULL OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey) OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag IS NOT NULL)",
    "rule_distribution_params": (_PARAMS.format("stmt_filtered"), _PARAMS.format("stmt")),
    "rule_quantity": "SELECT 'quantity' AS rule, l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey HAVING COUNT(*) > 1",
    "rule_quantity_value": "SELECT 'value' AS rule, l_orderkey AS ord, l_linenumber AS line FROM lineitem WHERE l_quantity IS NULL OR l_quantity <= 0 OR l_linestatus IS NULL OR l_linestatus NOT IN ('F', 'O')",
    "rule_element_leaf": "SELECT 'element_leaf' AS rule, t.child FROM taxonomy t JOIN taxonomy e ON t.parent = e.child WHERE e.parent = 'Element'",
    "rule_mass_conserved": """SELECT 'one_level' AS rule, ord, round(SUM(best), 6) AS total FROM pc GROUP BY ord HAVING SUM(best) > 1 + 1.0E-6
        UNION ALL SELECT 'across_levels', ord, round(SUM(amount), 6) FROM levels WHERE amount > lo + 1.0E-6 GROUP BY ord""",
    "rule_class_adjacency": f"{_RANKED}SELECT 'adjacency' AS rule, whole, part FROM ({_CLASS_EDGES}) e WHERE abs(part_rank - whole_rank) > 1",
    "rule_interval": "SELECT 'interval' AS rule, o_orderkey AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate IS NULL GROUP BY o_orderkey HAVING MAX(l_shipdate) IS NULL",
    "rule_item_mass": "SELECT 'item_mass' AS rule, ord FROM prod_mass WHERE mass IS NULL OR mass <= 0",
    "rule_s1_time_scope": "SELECT 'S1' AS rule, product_class, COUNT(*) AS instances FROM prod WHERE yr IS NULL GROUP BY product_class",
    "rule_s2_statement_or_strategy": "SELECT 'S2' AS rule, o_orderkey AS ord FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AND NOT EXISTS (SELECT 1 FROM placed p JOIN strategy s ON s.class = p.product_class WHERE p.ord = o.o_orderkey)",
    # a strategy in use must name all its facets: what is averaged, weighted by, within what, and over which axis
    "rule_s3_strategy_facets": """SELECT 'S3' AS rule, s.class FROM strategy s LEFT JOIN (SELECT * FROM (VALUES ('equal-subclass-mean', 'amount', 'equal', 'subclass', 'class', 'mean', 'span', 'yes'), ('year-slice-mean', 'amount', 'equal', 'slice', 'year', 'mean', 'span', 'yes'))
        AS t(strategy, measure, weight, member, axis, statistic, gate, nested)) f ON s.strategy = f.strategy WHERE f.measure IS NULL OR f.weight IS NULL OR f.member IS NULL OR f.axis IS NULL OR f.statistic IS NULL OR f.gate IS NULL OR f.nested IS NULL OR s.class IS NULL""",
    "rule_s5_strategy_if_empty": "SELECT 'S5' AS rule, c.class FROM class_time c WHERE NOT EXISTS (SELECT 1 FROM slice_mean m WHERE m.class = c.class) AND NOT EXISTS (SELECT 1 FROM strategy s WHERE s.class = c.class)",
    "rule_amount": "SELECT 'amount' AS rule, product_class, yr, element_class FROM leaf_mean WHERE amount IS NULL OR amount < 0 OR amount > 1 UNION ALL SELECT 'twice', product_class, yr, element_class FROM leaf_mean GROUP BY product_class, yr, element_class HAVING COUNT(*) > 1",
    "rule_one_level": f"SELECT 'one_level' AS rule, descendant, COUNT(DISTINCT ancestor) AS n FROM closure WHERE ancestor IN {_LEVELS} GROUP BY descendant HAVING COUNT(DISTINCT ancestor) <> 1",
    "rule_subject_is_class": "SELECT DISTINCT 'subject' AS rule, l.product_class FROM leaf_mean l WHERE NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.child = l.product_class)",
    "rule_s6_served_scope": "SELECT DISTINCT 'S6' AS rule, m.product_class FROM item_mass m LEFT JOIN class_time c ON c.class = (m.product_class || '_Y' || CAST(m.yr AS STRING)) WHERE c.class IS NULL OR c.y0 > c.y1",
    "rule_label": "SELECT 'label' AS rule, p_partkey FROM part WHERE p_name IS NULL OR trim(p_name) = ''",
    "rule_t_s_diag": (_DIAG.format("SELECT 1 FROM (SELECT explode(array(component_class, material_class, element_class)) AS class FROM (SELECT DISTINCT component_class, material_class, element_class FROM mat) d) m WHERE m.class = t.child"),
        _DIAG.format("SELECT 1 FROM mat m WHERE m.component_class = t.child OR m.material_class = t.child OR m.element_class = t.child")),
    "audit_taxonomy": f"""SELECT 'multi_root' AS rule, COUNT(*) AS n FROM (SELECT descendant FROM closure WHERE ancestor IN {_LEVELS} GROUP BY descendant HAVING COUNT(DISTINCT ancestor) > 1) m
        UNION ALL SELECT 'unreachable', COUNT(*) FROM taxonomy t WHERE NOT EXISTS (SELECT 1 FROM closure c WHERE c.descendant = t.child AND c.ancestor IN {_LEVELS})
        UNION ALL SELECT 'undefined', COUNT(*) FROM (SELECT DISTINCT p_brand FROM part) p WHERE NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.child = p.p_brand)
        UNION ALL SELECT 'no_scope', COUNT(*) FROM (SELECT DISTINCT descendant AS class FROM closure WHERE ancestor IN ('Product', 'Component')) k WHERE NOT EXISTS (SELECT 1 FROM subclass s JOIN class_time c ON s.child = c.class WHERE s.parent = k.class)
        UNION ALL SELECT 'no_strategy', COUNT(*) FROM (SELECT DISTINCT descendant AS class FROM closure WHERE ancestor = 'Product') k WHERE NOT EXISTS (SELECT 1 FROM strategy s WHERE s.class = k.class)""",
    "check_time_complete": "SELECT DISTINCT product_class FROM prod WHERE yr IS NULL",
    "scope_conflict": "SELECT class, COUNT(*) AS n FROM (SELECT DISTINCT class, y0, y1 FROM class_time) c GROUP BY class HAVING COUNT(*) > 1",
    # classes that have slices of single years and are given a period of several years besides
    "duplicate_scope_kinds": "SELECT product_class, MIN(yr) AS y0, MAX(yr) AS y1 FROM prod GROUP BY product_class HAVING MIN(yr) <> MAX(yr)",
    "undefined_classes": "SELECT DISTINCT f.prt FROM facts f WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = f.prt)",
    "statement_conflicts": "SELECT l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, COUNT(DISTINCT l_quantity) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey HAVING COUNT(DISTINCT l_quantity) > 1",
    "conflict_classes": "SELECT class FROM (SELECT DISTINCT p.p_brand AS class FROM (SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey HAVING COUNT(DISTINCT l_quantity) > 1) c JOIN part p ON c.l_partkey = p.p_partkey) d ORDER BY class LIMIT 8",
}
