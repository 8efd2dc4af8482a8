"""Roll-ups over classes, uncertainty, data quality, reconciliation and unknown remainders."""

SQL = {
    "element_reach": "SELECT ord, element_class, round(amount, 9) AS amount FROM reach",
    "element_reach_by_class": "SELECT component_class, element_class, round(SUM(f2 * f3), 6) AS amount FROM path GROUP BY 1, 2",
    "element_in_whole": "SELECT ord, round(amount, 9) AS amount FROM reach WHERE element_class = 'PROMO'",
    "reach_uncertainty": "SELECT t.ord, t.element_class, round(SUM(t.f), 9) AS amount, round(sqrt(SUM(power(t.f * t.sigma_rel, 2))) / SUM(t.f), 9) AS rel FROM path t GROUP BY 1, 2",
    "reach_uncertainty_full": "SELECT ord, element_class, round(sqrt(SUM(power(f, 2) * (power(sigma_rel, 2) + power(sigma_rel, 2)))) / SUM(f), 9) AS rel FROM path GROUP BY ord, element_class",
    "reach_dq": "SELECT t.ord, t.element_class, round(SUM(t.f * t.mean_dq) / SUM(t.f), 9) AS mean_dq, MAX(t.dqs) AS dqs FROM path t GROUP BY 1, 2",
    "material_reach_uncertainty": ('SELECT ord, material_class, round(SUM(f1 * f2), 9) AS amount, round(sqrt(SUM(power(f1 * f2 * sigma_rel, 2))) / SUM(f1 * f2), 9) AS rel FROM path GROUP BY ord, material_class', "SELECT pc.ord, cm.material_class, round(SUM(pc.best * cm.best), 9) AS amount, round(sqrt(SUM(power(pc.best * cm.best * s.sigma_rel, 2))) / SUM(pc.best * cm.best), 9) AS rel FROM pc JOIN cm ON pc.ord = cm.ord AND pc.sup = cm.sup JOIN stmt s ON cm.ord = s.ord AND cm.sup = s.sup AND cm.prt = s.prt GROUP BY 1, 2"),
    "constituent_total": ('SELECT ord, material_class, round(SUM(f1 * f2), 9) AS amount FROM path GROUP BY ord, material_class', "SELECT pc.ord, cm.material_class, round(SUM(pc.best * cm.best), 9) AS amount FROM pc JOIN cm ON pc.ord = cm.ord AND pc.sup = cm.sup GROUP BY 1, 2"),
    "granular_sum": "SELECT ord, sup, element_class, round(SUM(f1 * f2 * CASE WHEN status = 'F' THEN lo ELSE elem_best END), 9) AS amount FROM path GROUP BY ord, sup, element_class",
    "path_fraction": "SELECT ord, element_class, round(MAX(f), 9) AS best_path FROM path GROUP BY 1, 2",
    "level_rollup_check": ('SELECT ord, element_class, abs(SUM(total) - SUM(f1 * inner_sum)) < 1.0E-9 AS equal FROM (SELECT ord, sup, element_class, MIN(f1) AS f1, SUM(f2 * f3) AS inner_sum, SUM(f) AS total FROM path GROUP BY ord, sup, element_class) c GROUP BY ord, element_class', "SELECT r.ord, r.element_class, abs(r.amount - c.amount) < 1.0E-9 AS equal FROM reach r JOIN (SELECT pc.ord, k.element_class, SUM(pc.best * k.amount) AS amount FROM pc JOIN (SELECT cm.ord, cm.sup, me.element_class, SUM(cm.best * me.best) AS amount FROM cm JOIN me ON cm.ord = me.ord AND cm.sup = me.sup AND cm.prt = me.prt GROUP BY 1, 2, 3) k ON pc.ord = k.ord AND pc.sup = k.sup GROUP BY 1, 2) c ON r.ord = c.ord AND r.element_class = c.element_class"),
    "class_leaf_mean": "SELECT product_class, yr, element_class, round(amount, 9) AS amount FROM leaf_mean",
    "parent_gate": "SELECT parent, child FROM gate",
    "rss_combine": "SELECT s.material_class, round(sqrt(SUM(power(s.elem_best * s.sigma_rel, 2))) / nullif(SUM(s.elem_best), 0), 9) AS rel FROM stmt s GROUP BY 1",
    "nodes_uncertainty_mean": "SELECT component_class, round(sqrt(SUM(power(elem_best * sigma_rel, 2))) / COUNT(*) / (SUM(elem_best) / COUNT(*)), 9) AS rel FROM stmt GROUP BY component_class",
    "nodes_uncertainty_weighted": "SELECT component_class, round(sqrt(SUM(power(elem * sigma * kg, 2))) / SUM(elem * kg), 9) AS rel FROM (SELECT s.component_class, s.sigma_rel AS sigma, s.elem_best AS elem, s.kg FROM stmt s) t GROUP BY 1",
    "nodes_material_uncertainty": "SELECT s.component_class, s.material_class, round(sqrt(SUM(power(s.kg * s.sigma_rel, 2))) / SUM(s.kg), 9) AS rel FROM stmt s GROUP BY 1, 2",
    "nodes_dq": "SELECT s.component_class, round(SUM(s.kg * s.mean_dq) / SUM(s.kg), 9) AS mean_dq, MAX(s.dqs) AS worst FROM stmt s GROUP BY 1",
    "dq_mean": "SELECT ord, sup, prt, round(mean_dq, 9) AS mean_dq FROM dq",
    "dq_limit": "SELECT ord, sup, prt, lim FROM stmt",
    "dq_limit_query": "SELECT ord, sup, prt, CASE WHEN weighted < 7 THEN 0.1E0 WHEN weighted < 9 THEN 0.15E0 WHEN weighted < 10 THEN 0.2E0 WHEN weighted < 14 THEN 0.25E0 WHEN weighted < 15 THEN 0.3E0 ELSE 0.35E0 END AS lim FROM dq",
    "statement_uncertainty": "SELECT ord, sup, prt, round(mean_dq, 9) AS mean_dq, dqs, round(sigma_rel, 9) AS sigma_rel FROM stmt",
    "amount_uncertainty_direct": "SELECT component_class, material_class, round(sqrt(SUM(power(sigma_rel, 2))) / COUNT(*), 9) AS rel, round(AVG(mean_dq), 9) AS mean_dq FROM stmt GROUP BY 1, 2",
    "amount_uncertainty_indirect": """SELECT t.product_class, t.element_class, round(sqrt(SUM(power(t.f * t.sigma_rel, 2))) / SUM(t.f), 9) AS rel FROM ppath t WHERE NOT EXISTS (SELECT 1 FROM (SELECT p.product_class, c.element_class FROM coarse c JOIN placed p ON c.ord = p.ord WHERE c.lo > 0.35 GROUP BY p.product_class, c.element_class) d
        WHERE d.product_class = t.product_class AND d.element_class = t.element_class) GROUP BY t.product_class, t.element_class""",
    "component_totals": "SELECT component_class, element_class, round(SUM(f2 * f3) / MIN(n), 9) AS amount FROM (SELECT t.component_class, t.element_class, t.f2, t.f3, n.n FROM path t JOIN (SELECT component_class, COUNT(*) AS n FROM comp GROUP BY 1) n ON t.component_class = n.component_class) x GROUP BY 1, 2",
    "scope_component_in_product": ("SELECT concat(component_class, '_in_', product_class) AS scope_id, element_class, round(SUM(f2 * f3 * cmass) / SUM(cmass * f2), 9) AS amount FROM ppath GROUP BY 1, 2", "SELECT concat(t.component_class, '_in_', p.product_class) AS scope_id, t.element_class, round(SUM(t.f2 * t.f3 * pc.part_mass) / SUM(pc.part_mass * t.f2), 9) AS amount FROM path t JOIN pc ON t.ord = pc.ord AND t.sup = pc.sup JOIN prod p ON t.ord = p.ord GROUP BY 1, 2"),
    "scope_group_in_product": "SELECT c.component_parent, p.product_class, round(SUM(c.mass), 4) AS mass FROM comp c JOIN prod p ON c.ord = p.ord GROUP BY 1, 2",
    "material_family_mass_weighted": "SELECT material_parent, element_class, round(SUM(kg * elem_best) / SUM(kg), 9) AS best, round(SUM(kg * lo) / SUM(kg), 9) AS lo, round(SUM(kg * hi) / SUM(kg), 9) AS hi FROM stmt GROUP BY material_parent, element_class",
    "mass_conservation": """SELECT level, whole, round(total, 9) AS total, total > 1 + 1.0E-6 AS overshoot FROM (SELECT 'Product' AS level, CAST(ord AS STRING) AS whole, SUM(best) AS total FROM pc GROUP BY ord
        UNION ALL SELECT 'Component', concat(CAST(ord AS STRING), '_', CAST(sup AS STRING)), SUM(kg * (1 - lim)) / SUM(kg) FROM stmt GROUP BY ord, sup UNION ALL SELECT 'Material', concat(CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), SUM(lo) FROM stmt GROUP BY ord, sup, prt) c""",
    "conservation_bounds": "SELECT ord, sup, round(SUM(f2 * (1 - lim)), 9) AS min_sum, round(SUM(f2 * (1 + lim)), 9) AS max_sum, SUM(f2 * (1 - lim)) > 1 + 1.0E-6 AS overshoot FROM path GROUP BY ord, sup",
    "reconcile_residual": "SELECT ord, element_class, round(greatest(lo - amount, 0), 9) AS unknown, amount <= lo + 1.0E-6 AS conserved FROM levels",
    "balance_level": "SELECT ord, sup, prt, 'Unknown' AS element_class, round(1 - SUM(best), 9) AS amount FROM me GROUP BY 1, 2, 3 HAVING 1 - SUM(best) > 1.0E-9",
    "decompose_unknown": """SELECT ord, level, holder, part, round(fraction + 1.0E-12, 9) AS fraction FROM (WITH u AS (SELECT ord, element_class, greatest(lo - amount, 0) AS unknown FROM levels), h AS (SELECT ord, SUM(unknown) AS unknown FROM u GROUP BY ord HAVING SUM(unknown) > 1.0E-9)
        SELECT ord, 'Component' AS level, 'product' AS holder, 'unknownComponent' AS part, unknown AS fraction FROM h UNION ALL SELECT ord, 'Material', 'unknownComponent', 'unknownMaterial', 1.0E0 FROM h
        UNION ALL SELECT u.ord, 'Element', 'unknownMaterial', u.element_class, u.unknown / h.unknown FROM u JOIN h ON u.ord = h.ord WHERE u.unknown > 0) d""",
    "remainder_projection": "SELECT product_class, yr, 'Unknown' AS element_class, round(1 - SUM(amount), 9) AS amount FROM leaf_mean GROUP BY 1, 2 HAVING 1 - SUM(amount) > 1.0E-9",
    "total_unknown_at_level": "SELECT p.product_class, round(SUM(1 - t.total), 6) AS unknown FROM (SELECT ord, SUM(amount) AS total FROM reach GROUP BY ord) t JOIN prod p ON t.ord = p.ord GROUP BY 1",
    "total_and_rss": "SELECT round(SUM(kg), 3) AS kg, round(sqrt(SUM(power(sig, 2))), 6) AS sigma FROM (SELECT t.f * t.pmass AS kg, t.f * t.pmass * t.sigma_rel AS sig FROM ppath t WHERE t.element_class = 'PROMO') x",
    "total_distinct_rss": "SELECT round(SUM(kg), 3) AS kg FROM (SELECT DISTINCT ord, element_class, round(amount, 9) AS kg FROM reach WHERE element_class IN ('PROMO', 'LARGE')) d",
    "group_total_rss": "SELECT t.product_parent, t.element_class, round(SUM(t.f * t.pmass), 3) AS kg, round(sqrt(SUM(power(t.f * t.pmass * t.sigma_rel, 2))), 6) AS sigma FROM ppath t GROUP BY 1, 2",
    "slices_per_parent": "SELECT product_parent, 'year' AS axis, COUNT(DISTINCT concat(product_class, CAST(yr AS STRING))) AS n FROM prod GROUP BY 1",
    "parts_per_whole": "SELECT ord, COUNT(*) AS n FROM pc GROUP BY ord",
    "shared_bases": "SELECT product_class, COUNT(DISTINCT yr) AS n_values FROM prod GROUP BY 1 HAVING COUNT(DISTINCT yr) >= 2",
    "store_stats": "SELECT COUNT(*) AS instances, COUNT(DISTINCT product_class) AS classes FROM prod",
    "dataset_counts": "SELECT (SELECT COUNT(*) FROM facts) AS statements, (SELECT COUNT(*) FROM leaf_mean) AS amounts, (SELECT COUNT(*) FROM prod) AS products",
    "dataset_profile": """SELECT level, property, kind, n FROM (SELECT 'Product' AS level, 'class' AS property, 'string' AS kind, COUNT(DISTINCT product_class) AS n FROM prod UNION ALL SELECT 'Product', 'item mass', 'double', COUNT(DISTINCT mass) FROM prod UNION ALL SELECT 'Product', 'scope', 'int', COUNT(DISTINCT yr) FROM prod
        UNION ALL SELECT 'Component', 'class', 'string', COUNT(DISTINCT component_class) FROM mat UNION ALL SELECT 'Material', 'class', 'string', COUNT(DISTINCT material_class) FROM mat UNION ALL SELECT 'Element', 'class', 'string', COUNT(DISTINCT element_class) FROM mat
        UNION ALL SELECT 'Statement', 'unit', 'string', COUNT(DISTINCT status) FROM facts UNION ALL SELECT 'Statement', 'source', 'string', COUNT(DISTINCT source_id) FROM facts) p""",
    "navigation_facts": "SELECT COUNT(*) > 0 AS typed, bool_or(product_class LIKE '%/%') AS labelled, bool_and(product_parent IS NOT NULL) AS taxonomy_present FROM prod",
    "fanout_check": "SELECT ord, COUNT(*) AS n FROM pc GROUP BY ord HAVING COUNT(*) < 2",
    "material_consistency": "SELECT material_class, COUNT(DISTINCT concat(element_class, CAST(CAST(round(elem_best * 100, 0) AS INT) AS STRING))) AS makeups FROM mat GROUP BY 1 HAVING COUNT(DISTINCT concat(element_class, CAST(CAST(round(elem_best * 100, 0) AS INT) AS STRING))) > 1",
    "remainder_dedup": """SELECT subject, kind, round(amount, 9) AS amount, origin FROM (SELECT *, row_number() OVER (PARTITION BY subject, kind ORDER BY round(amount, 9) DESC, origin) AS k FROM (
        SELECT product_class AS subject, 'unknownElement' AS kind, 1 - SUM(amount) AS amount, 'balance' AS origin FROM leaf_mean WHERE yr = 1996 GROUP BY product_class
        UNION ALL SELECT p.product_class, 'unknownElement', AVG(u.unknown), 'coarse' FROM (SELECT ord, SUM(greatest(lo - amount, 0)) AS unknown FROM levels GROUP BY ord) u JOIN placed p ON u.ord = p.ord GROUP BY p.product_class) r) d
        WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM item_mass m WHERE m.product_class = d.subject AND m.yr = 1992 AND m.n > 5)""",
    "slice_span": "SELECT product_class, MIN(yr) AS y0, MAX(yr) AS y1 FROM prod GROUP BY 1",
    "rank_check": "SELECT product_class, yr, bool_and(ok) AS ordered FROM (SELECT product_class, yr, coalesce(lag(mass) OVER (PARTITION BY product_class, yr ORDER BY mass DESC, ord), 1.0E300) >= mass AS ok FROM prod) t GROUP BY product_class, yr",
}
