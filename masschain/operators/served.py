"""Slices, the served view, rules, lookups, questions and incremental steps."""

SQL = {
    "taxonomy_closure": "SELECT descendant, ancestor, depth FROM closure WHERE ancestor NOT IN ('Product', 'Component', 'Material', 'Element')",
    "infer_level": "SELECT DISTINCT descendant AS class, ancestor AS level FROM closure WHERE ancestor IN ('Product', 'Component', 'Material', 'Element')",
    "type_closure": "SELECT p.ord, c.ancestor AS class FROM prod p JOIN closure c ON p.product_class = c.descendant",
    "rdfs_closure": "SELECT c.ancestor AS level, COUNT(*) AS n FROM comp p JOIN closure c ON p.component_class = c.descendant GROUP BY 1",
    "descendant_leaves": "SELECT c.ancestor, c.descendant AS leaf FROM closure c WHERE NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.parent = c.descendant)",
    "top_instances": """SELECT DISTINCT e.whole FROM (SELECT concat('P', CAST(ord AS STRING)) AS whole, concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)) AS part, best, 0 AS whole_rank, 1 AS part_rank FROM pc
        UNION ALL SELECT concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)), concat('M', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), best, 1, 2 FROM cm
        UNION ALL SELECT concat('M', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), concat('E', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), best, 2, 3 FROM me) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT concat('P', CAST(ord AS STRING)) AS whole, concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)) AS part, best, 0 AS whole_rank, 1 AS part_rank FROM pc
        UNION ALL SELECT concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)), concat('M', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), best, 1, 2 FROM cm
        UNION ALL SELECT concat('M', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), concat('E', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)), best, 2, 3 FROM me) x WHERE x.part = e.whole)""",
    "fill_skipped_levels": """SELECT c.whole, concat('filler_', c.whole, '_', l.level, '_', c.element_class) AS filler, l.level, c.element_class FROM (SELECT concat('P', CAST(ord AS STRING)) AS whole, element_class, 0 AS whole_rank, 3 AS part_rank FROM coarse WHERE lo > 0
        UNION ALL SELECT concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)), element_class, 1, 3 FROM mat GROUP BY ord, sup, element_class) c JOIN (SELECT * FROM (VALUES ('Component', 1), ('Material', 2)) AS t(level, rank)) l ON l.rank > c.whole_rank AND l.rank < c.part_rank""",
    "taxonomy_served": """WITH served AS (SELECT DISTINCT product_class AS class FROM v_leaf_mean), up AS (SELECT class FROM served UNION SELECT c.ancestor FROM served s JOIN closure c ON c.descendant = s.class)
        SELECT DISTINCT t.child, t.parent FROM taxonomy t JOIN up u ON u.class = t.child WHERE t.parent NOT IN ('Product', 'Component', 'Material', 'Element')""",
    "component_layers": """SELECT c.descendant AS component_class, CASE c.depth WHEN 1 THEN 'main' WHEN 2 THEN 'sub' WHEN 3 THEN 'subsub' ELSE 'subsubsub' END AS layer, COUNT(k.ord) AS n FROM closure c LEFT JOIN comp k ON k.component_class = c.descendant WHERE c.ancestor = 'Component' GROUP BY c.descendant, c.depth""",
    "year_slice_leaves": "SELECT ord, concat(product_class, '_Y', CAST(yr AS STRING)) AS slice FROM prod",
    "year_slice_ancestors": "SELECT DISTINCT concat(product_parent, '_Y', CAST(yr AS STRING)) AS slice, product_parent AS base, 'EqualSubclassMean' AS strategy FROM prod",
    "doc_slice_ancestors": """SELECT a.parent AS slice, COUNT(DISTINCT c.y0) AS scopes, COUNT(DISTINCT c.y0) > 1 AS collides FROM subclass a JOIN class_time c ON a.child = c.class WHERE EXISTS (SELECT 1 FROM class_time p WHERE p.class = a.parent) GROUP BY a.parent""",
    "value_axis_values": "SELECT DISTINCT axis_value FROM prod",
    "value_axis_retype": "SELECT ord, concat(axis_value, '_', product_class, '_Y', CAST(yr AS STRING)) AS class FROM prod",
    "attach_axis_strategy": """WITH axis AS (SELECT product_parent AS class FROM placed GROUP BY product_parent HAVING COUNT(DISTINCT axis_value) >= 2) SELECT s.class, s.strategy FROM strategy s WHERE NOT EXISTS (SELECT 1 FROM axis a WHERE a.class = s.class) UNION ALL SELECT class, 'drivetrain-mean' FROM axis""",
    "slicer_compose": "SELECT concat(axis_value, '_', product_class, '_Y', CAST(yr AS STRING)) AS class, COUNT(*) AS n, round(AVG(mass), 6) AS mass FROM prod GROUP BY 1",
    "axis_selector": "SELECT DISTINCT product_class FROM prod WHERE axis_value = 'ASIA'",
    "axis_projection": "SELECT product_class, MIN(yr) AS y0, MAX(yr) AS y1, COUNT(DISTINCT axis_value) AS n_axis FROM prod GROUP BY 1",
    "strategy_of_class": """SELECT t.class, coalesce(e.strategy, d.strategy, 'none') AS strategy FROM (SELECT class FROM class_time UNION SELECT child FROM taxonomy) t LEFT JOIN (SELECT s.class, s.strategy FROM strategy s JOIN class_time c ON s.class = c.class) e ON e.class = t.class LEFT JOIN strategy d ON d.class = t.class""",
    "enrich_strategies": """SELECT t.child AS class, CASE r.root WHEN 'Product' THEN 'year-slice-mean' WHEN 'Component' THEN 'equal-subclass-mean' ELSE 'mass-weighted-rollup' END AS strategy FROM (SELECT DISTINCT child FROM taxonomy) t
        JOIN (SELECT descendant, MIN(ancestor) AS root FROM closure WHERE ancestor IN ('Product', 'Component', 'Material', 'Element') GROUP BY descendant HAVING COUNT(DISTINCT ancestor) = 1) r ON r.descendant = t.child WHERE NOT EXISTS (SELECT 1 FROM strategy s WHERE s.class = t.child)""",
    "mc_pointers": """SELECT parent AS aggregate, child AS pointer, 'subclass' AS kind, CAST(0 AS BIGINT) AS n FROM gate UNION ALL SELECT p.product_parent, p.product_class, 'leaf statements', COUNT(*) FROM facts f JOIN placed p ON f.ord = p.ord GROUP BY p.product_parent, p.product_class""",
    "element_projection": "SELECT product_class, yr, element_class, round(amount, 9) AS amount FROM leaf_mean UNION ALL SELECT product_class, yr, 'Unknown', round(1 - SUM(amount), 9) FROM leaf_mean GROUP BY 1, 2 HAVING 1 - SUM(amount) > 1.0E-9",
    "item_mass_projection": "SELECT product_class, yr, round(mass, 6) AS mass FROM item_mass",
    "unknown_remainder_rows": "SELECT product_class, yr, round(1 - SUM(amount), 9) AS unknown FROM leaf_mean GROUP BY 1, 2",
    "direct_constituents": "SELECT ord, sup, round(best, 9) AS best, 'kgkg' AS unit, CAST(row_number() OVER (PARTITION BY ord ORDER BY round(best, 9) DESC, sup) AS BIGINT) AS place FROM pc",
    "amount_with_unit": "SELECT ord, sup, prt, CASE WHEN status = 'F' THEN 'gkg' ELSE 'kgkg' END AS unit, round(CASE WHEN status = 'F' THEN elem_best * 1000 ELSE elem_best END, 6) AS amount FROM mat",
    "amount_with_interval": "SELECT m.ord, m.sup, m.prt, m.elem_best AS best, CASE WHEN m.status = 'O' THEN round(m.elem_best * (1 - s.lim), 9) END AS lo FROM mat m LEFT JOIN stmt s ON m.ord = s.ord AND m.sup = s.sup AND m.prt = s.prt",
    "item_mass_of_instance": "SELECT ord, mass FROM prod_mass WHERE mass > 50",
    "quality_of_edge": "SELECT ord, sup, prt, 'Validity' AS dim, q_validity AS score FROM mat UNION ALL SELECT ord, sup, prt, 'Accuracy', q_accuracy FROM mat",
    "class_label": """SELECT c.class, coalesce(src.label, sl.label, ag.label, concat('class ', c.class)) AS label FROM (SELECT child AS class FROM taxonomy UNION SELECT class FROM class_time) c
        LEFT JOIN (SELECT DISTINCT p_type AS class, concat('element ', lower(p_type)) AS label FROM part) src ON src.class = c.class
        LEFT JOIN (SELECT s.class, MIN(concat(s.parent, ', ', CAST(t.y0 AS STRING), ' production year')) AS label FROM slices s JOIN class_time t ON s.class = t.class GROUP BY s.class) sl ON sl.class = c.class
        LEFT JOIN (SELECT parent AS class, concat('mean of ', CAST(COUNT(*) AS STRING), ' classes') AS label FROM gate GROUP BY parent) ag ON ag.class = c.class""",
    "class_comment": """SELECT c.class, concat(coalesce(s.strategy, 'measured'), '; ', CAST(coalesce(g.n, 0) AS STRING), ' parts averaged; ', CAST(coalesce(k.n, 0) AS STRING), ' slices', CASE WHEN x.class IS NULL THEN '' ELSE '; a slice' END) AS comment FROM (SELECT child AS class FROM taxonomy UNION SELECT class FROM class_time) c
        LEFT JOIN strategy s ON s.class = c.class LEFT JOIN (SELECT parent, COUNT(*) AS n FROM gate GROUP BY parent) g ON g.parent = c.class LEFT JOIN (SELECT parent, COUNT(*) AS n FROM slices GROUP BY parent) k ON k.parent = c.class LEFT JOIN (SELECT DISTINCT class FROM slices) x ON x.class = c.class""",
    "humanise_name": ("""SELECT DISTINCT name, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '^elv', ''), '([a-z])([A-Z])', '$1 $2'), '([A-Za-z])([0-9])', '$1 $2'))) AS label FROM (SELECT concat('elv', initcap(lower(p_type)), 'Part', CAST(p_size AS STRING)) AS name FROM part) n""", """SELECT DISTINCT name, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '^elv', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'))) AS label FROM (SELECT concat('elv', upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), 'Part', CAST(p_size AS VARCHAR)) AS name FROM part) n"""),
    "common_prefix_label": ("""SELECT parent, regexp_replace(substr(lo, 1, size(filter(sequence(1, least(length(lo), length(hi))), i -> substr(lo, 1, i) = substr(hi, 1, i)))), '[/_#]?[A-Z0-9]*$', '') AS label FROM (SELECT parent, MIN(child) AS lo, MAX(child) AS hi FROM taxonomy GROUP BY parent) m""", """SELECT parent, regexp_replace(substr(lo, 1, len(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: substr(lo, 1, i) = substr(hi, 1, i)))), '[/_#]?[A-Z0-9]*$', '') AS label FROM (SELECT parent, MIN(child) AS lo, MAX(child) AS hi FROM taxonomy GROUP BY parent) m"""),
    "scrub_examples": ("""SELECT doc_id, regexp_replace(regexp_replace(note, ' ?[(]e[.]g[.][^)]*[)]', ''), '~[0-9.]+ ?[a-z]+', '') AS note FROM (SELECT doc_id, concat(substr(coalesce(text, ''), 1, 60), ' (e.g. ', coalesce(lang, '-'), ') ~', CAST(n_chars AS STRING), ' chars') AS note FROM documents) d""", """SELECT doc_id, regexp_replace(regexp_replace(note, ' ?[(]e[.]g[.][^)]*[)]', '', 'g'), '~[0-9.]+ ?[a-z]+', '', 'g') AS note FROM (SELECT doc_id, concat(substr(coalesce(text, ''), 1, 60), ' (e.g. ', coalesce(lang, '-'), ') ~', CAST(n_chars AS VARCHAR), ' chars') AS note FROM documents) d"""),
}
