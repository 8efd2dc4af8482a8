"""Joins over the composition tables: paths, lookups, bands, scopes and set operations."""

SQL = {
    "edge_node_join": "SELECT e.ord, e.sup, p.product_class, c.component_class, round(e.best, 9) AS best FROM pc e JOIN prod p ON e.ord = p.ord JOIN comp c ON e.ord = c.ord AND e.sup = c.sup",
    "hop3_composition": "SELECT t.product_class, t.element_class, round(SUM(t.f * t.pmass), 4) AS kg, COUNT(DISTINCT t.ord) AS n_products FROM ppath t GROUP BY 1, 2",
    "hop2_material": "SELECT p.product_class, m.material_class, round(SUM(pc.best * cm.best * p.mass), 4) AS kg FROM pc JOIN cm ON pc.ord = cm.ord AND pc.sup = cm.sup JOIN mat m ON cm.ord = m.ord AND cm.sup = m.sup AND cm.prt = m.prt JOIN prod p ON pc.ord = p.ord GROUP BY 1, 2",
    "optional_bounds": "SELECT m.ord, m.sup, m.prt, round(coalesce(s.lo, m.elem_best), 9) AS lower_bound FROM mat m LEFT JOIN (SELECT ord, sup, prt, lo FROM stmt WHERE status = 'O') s ON m.ord = s.ord AND m.sup = s.sup AND m.prt = s.prt",
    "band_range_join": "SELECT d.ord, d.sup, d.prt, b.dqs, b.rel FROM dq d JOIN dqs_band b ON d.mean_dq >= b.lo AND d.mean_dq < coalesce(b.hi, 1.0E300)",
    "time_containment_join": "SELECT p.product_parent, p.y0, p.y1, c.product_class, c.yr FROM (SELECT product_parent, MIN(yr) AS y0, MAX(yr) - 1 AS y1 FROM prod GROUP BY 1) p JOIN (SELECT DISTINCT product_parent, product_class, yr FROM prod) c ON p.product_parent = c.product_parent AND p.y0 <= c.yr AND c.yr <= p.y1",
    "statement_scope_check": """SELECT p.ord, p.product_class, s.first_year, s.last_year, c.y0, c.y1 FROM placed p JOIN (SELECT l_orderkey AS ord, CAST(MIN(year(l_shipdate)) AS INT) AS first_year, CAST(MAX(year(l_shipdate)) AS INT) AS last_year FROM lineitem GROUP BY l_orderkey) s ON p.ord = s.ord
        JOIN class_time c ON c.class = concat(p.product_class, '_Y', CAST(p.yr AS STRING)) WHERE s.first_year < c.y0 OR s.first_year > c.y1""",
    "direct_subclass_breakdown": "SELECT t.child AS class, l.element_class, round(AVG(l.amount), 9) AS amount FROM taxonomy t JOIN leaf_mean l ON l.product_class = t.child WHERE t.parent = 'MACHINERY' GROUP BY 1, 2",
    "family_members_semi": "SELECT m.ord, m.sup, m.prt, m.material_class FROM mat m WHERE m.material_class IN (SELECT descendant FROM closure WHERE ancestor = 'Brand#1')",
    "direct_child_anti": "SELECT c.descendant, c.ancestor FROM closure c WHERE NOT EXISTS (SELECT 1 FROM closure a JOIN closure b ON a.ancestor = b.descendant WHERE a.descendant = c.descendant AND b.ancestor = c.ancestor)",
    "most_specific_class": "SELECT t.ord, t.class FROM (SELECT ord, product_class AS class FROM prod UNION ALL SELECT ord, product_parent FROM prod) t WHERE NOT EXISTS (SELECT 1 FROM prod p JOIN closure c ON c.descendant = p.product_class WHERE p.ord = t.ord AND c.ancestor = t.class)",
    "recovery_routes_element": "SELECT DISTINCT m.component_class, r.process FROM mat m JOIN (SELECT * FROM (VALUES ('PROMO', 'smelting', 'target'), ('LARGE', 'leaching', 'main'), ('SMALL', 'none', 'lost')) AS k(element, process, effectiveness)) r ON m.element_class = r.element WHERE r.effectiveness IN ('target', 'main')",
    "recovery_copresent": "SELECT a.ord, a.sup, COUNT(*) AS routes FROM (SELECT DISTINCT ord, sup, element_class FROM mat) a JOIN (SELECT DISTINCT ord, sup, element_class FROM mat) b ON a.ord = b.ord AND a.sup = b.sup JOIN (SELECT * FROM (VALUES ('PROMO', 'LARGE'), ('SMALL', 'PROMO'), ('ECONOMY', 'STANDARD')) AS k(element, base)) r ON a.element_class = r.element AND b.element_class = r.base GROUP BY 1, 2",
    "recovery_full_table": "SELECT a.element_class, b.element_class AS base_metal, COUNT(*) AS n FROM (SELECT DISTINCT ord, element_class FROM mat) a JOIN (SELECT DISTINCT ord, element_class FROM mat) b ON a.ord = b.ord WHERE a.element_class <> b.element_class GROUP BY 1, 2",
    "recovery_copresent_material": "SELECT a.material_class, a.element_class, b.element_class AS base FROM (SELECT DISTINCT material_class, element_class FROM mat) a JOIN (SELECT DISTINCT material_class, element_class FROM mat) b ON a.material_class = b.material_class WHERE a.element_class < b.element_class",
    "coarse_vs_granular": ("SELECT ord, element_class, round(lo, 9) AS coarse, round(CASE WHEN element_class IS NULL THEN 0 ELSE coalesce(amount, 0) END, 9) AS granular FROM levels WHERE ord IS NOT NULL", "SELECT c.ord, c.element_class, round(c.lo, 9) AS coarse, round(coalesce(r.amount, 0), 9) AS granular FROM coarse c LEFT JOIN reach r ON c.ord = r.ord AND c.element_class = r.element_class"),
    "class_lift": "SELECT DISTINCT p.product_class, c.component_class FROM pc e JOIN prod p ON e.ord = p.ord JOIN comp c ON e.ord = c.ord AND e.sup = c.sup",
    "inverse_edges": "SELECT sup AS part, ord AS whole, round(best, 9) AS best FROM pc",
    "scope_members": "SELECT c.component_class, p.product_class, COUNT(*) AS n FROM comp c JOIN prod p ON c.ord = p.ord GROUP BY 1, 2",
    "dangling_pointers": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "disjoint_elements": "SELECT material_class, COUNT(DISTINCT element_class) AS n FROM mat GROUP BY 1 HAVING COUNT(DISTINCT element_class) > 1",
    "union_sources": "SELECT source_id, ord, sup, prt, MAX(kg) AS kg FROM (SELECT source_id, ord, sup, prt, kg FROM facts WHERE source_id = 'R' UNION ALL SELECT source_id, ord, sup, prt, kg FROM facts WHERE source_id <> 'A') u GROUP BY 1, 2, 3, 4",
    "union_branches": "SELECT ord, 'component' AS branch, COUNT(*) AS n FROM pc GROUP BY ord UNION ALL SELECT ord, 'material', COUNT(*) FROM cm GROUP BY ord",
    "union_plugin_outputs": "SELECT DISTINCT subject, constituent FROM (SELECT product_class AS subject, element_class AS constituent FROM leaf_mean UNION ALL SELECT product_parent, element_class FROM ancestor_mean) u",
    "new_rows_except": "SELECT ord, sup, prt FROM facts EXCEPT SELECT ord, sup, prt FROM facts WHERE source_id = 'N'",
    "set_overlap": "SELECT DISTINCT a.product_class FROM prod a WHERE a.yr = 1995 INTERSECT SELECT DISTINCT b.product_class FROM prod b WHERE b.yr = 1996",
    "table_diff": "SELECT coalesce(a.ord, b.ord) AS ord, coalesce(a.element_class, b.element_class) AS element_class, CASE WHEN a.ord IS NULL THEN 'unexpected' WHEN b.ord IS NULL THEN 'missing' WHEN abs(a.amount - b.lo) > 1.0E-9 * abs(a.amount) + 1.0E-12 THEN 'drifted' ELSE 'same' END AS status FROM reach a FULL OUTER JOIN coarse b ON a.ord = b.ord AND a.element_class = b.element_class",
    "order_desc": "SELECT product_class, element_class, yr, round(amount, 9) AS amount FROM leaf_mean ORDER BY amount DESC, product_class, element_class, yr",
    "order_two_keys": "SELECT component_parent, component_class, COUNT(*) AS n FROM mat GROUP BY 1, 2 ORDER BY component_parent, component_class",
    "limit_rows": "SELECT ord, mass FROM prod_mass ORDER BY mass DESC, ord LIMIT 50",
    "sum_check_levels": "SELECT ord, round(SUM(best), 6) AS total FROM pc GROUP BY ord",
}
