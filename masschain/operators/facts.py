"""Reading, cleaning and turning facts into fractions: filters, projections and ETL aggregates."""

SQL = {
    "level_of_code": "SELECT c.code, l.whole_level, l.part_level, c.n FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 'c-p' WHEN l_returnflag = 'R' THEN 'm-c' WHEN l_returnflag = 'A' THEN 'e-m' ELSE 'x' END AS code, COUNT(*) AS n FROM lineitem GROUP BY 1) c JOIN (SELECT * FROM (VALUES ('c-p', 'Product', 'Component'), ('m-c', 'Component', 'Material'), ('e-m', 'Material', 'Element')) AS t(code, whole_level, part_level)) l ON c.code = l.code",
    "year_of_date": "SELECT CAST(year(o_orderdate) AS INT) AS yr, COUNT(*) AS n FROM orders GROUP BY 1",
    "clamp_window": "SELECT o_orderkey, least(greatest(CAST(year(o_orderdate) AS INT), 1993), 1996) AS yr FROM orders WHERE CAST(year(o_orderdate) AS INT) BETWEEN 1992 AND 1998",
    "bucket_of_year": "SELECT CAST(floor(yr / 5.0E0) AS INT) * 5 AS bucket_lo, CAST(floor(yr / 5.0E0) AS INT) * 5 + 4 AS bucket_hi, COUNT(*) AS n FROM prod GROUP BY 1, 2",
    "unit_to_fraction": "SELECT ord, sup, prt, CASE WHEN status = 'F' THEN 'gkg' ELSE 'kgkg' END AS unit, round((CASE WHEN status = 'F' THEN elem_best * 1000 ELSE elem_best END) * (CASE WHEN status = 'F' THEN 0.001E0 ELSE 1.0E0 END), 9) AS best FROM mat",
    "default_endpoints": "SELECT ord, sup, prt, elem_best AS best, round(lo, 9) AS lo, round(hi, 9) AS hi FROM stmt",
    "floor_value": "SELECT ord, sup, prt, round(CASE WHEN status = 'F' THEN lo ELSE elem_best END, 9) AS floor_kgkg FROM stmt",
    "split_coarse_step": "SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN abs(rank_part - rank_whole) > 1 THEN 'coarse' ELSE 'step' END AS kind FROM (SELECT 0 AS rank_whole, 1 AS rank_part FROM pc UNION ALL SELECT 1, 2 FROM cm UNION ALL SELECT 2, 3 FROM me UNION ALL SELECT 0, 3 FROM coarse) e) k GROUP BY kind",
    "drop_zero_edges": "SELECT ord, sup, round(best, 9) AS best FROM pc WHERE part_mass > 0 AND best > 0",
    "kind_filter": "SELECT DISTINCT c.descendant AS class, c.ancestor AS level FROM closure c WHERE c.ancestor = 'Material'",
    "projected_scope": "SELECT l.product_class, l.yr, l.element_class, round(l.amount, 9) AS amount FROM leaf_mean l WHERE l.product_class IN (SELECT child FROM taxonomy WHERE parent = 'BUILDING')",
    "exclude_remainder": """WITH rest AS (SELECT ord, element_class, amount FROM reach UNION ALL SELECT ord, 'unknownElement', 1 - SUM(amount) FROM reach GROUP BY ord) SELECT r.ord, r.element_class, round(r.amount, 9) AS amount FROM rest r
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM (VALUES ('unknownElement', 'unknownElement'), ('otherElement', 'unknownElement')) AS t(child, parent)) u WHERE u.child = r.element_class)""",
    "namespace_sources": "SELECT concat(source_id, '_', CAST(ord AS STRING), '_', CAST(sup AS STRING)) AS node_id, source_id, COUNT(*) AS n FROM facts GROUP BY 1, 2",
    "absolute_mass": "SELECT r.ord, r.element_class, round(r.amount * p.mass, 6) AS kg FROM reach r JOIN prod_mass p ON r.ord = p.ord",
    "dup_row_mean": "SELECT l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, AVG(l_quantity) AS mean_kg, MIN(l_tax) AS first_quality FROM lineitem GROUP BY 1, 2, 3",
    "collect_facts": "SELECT 'c-p' AS code, COUNT(*) AS n, SUM(mass) AS kg FROM comp UNION ALL SELECT 'm-c', COUNT(*), SUM(kg) FROM mat UNION ALL SELECT 'e-m', COUNT(*), round(SUM(kg * elem_best), 4) FROM mat",
    "component_mass": "SELECT c.ord, SUM(c.mass) AS product_mass, COUNT(*) AS n_components FROM comp c GROUP BY c.ord",
    "layer_fractions": "SELECT 'pc' AS layer, ord, sup, CAST(NULL AS BIGINT) AS prt, round(best, 9) AS best FROM pc UNION ALL SELECT 'cm', ord, sup, prt, round(best, 9) FROM cm UNION ALL SELECT 'me', ord, sup, prt, round(best, 9) FROM me",
    "cp_cross_check": "SELECT c.ord, c.sup, c.mass, t.taxed FROM comp c JOIN (SELECT ord, sup, SUM(kg_taxed) AS taxed FROM facts GROUP BY ord, sup) t ON c.ord = t.ord AND c.sup = t.sup WHERE abs(c.mass - t.taxed) / c.mass > 0.05",
    "year_invariant_chemistry": "SELECT product_parent, material_class, element_class, round(AVG(share), 9) AS mean_share, round((MAX(share) - MIN(share)) / MAX(share), 6) AS spread, MAX(share) - MIN(share) > 0.01 * MAX(share) AS refused FROM (SELECT p.product_parent, p.yr, m.material_class, m.element_class, SUM(m.kg * m.elem_best) / SUM(m.kg) AS share FROM mat m JOIN prod p ON m.ord = p.ord GROUP BY 1, 2, 3, 4) s GROUP BY 1, 2, 3",
    "honest_material_class": """SELECT ord, sup, named_class, round(CASE WHEN total > 1 THEN total ELSE 1 END, 9) AS overshoot, round(top / total, 9) AS top_share FROM (SELECT ord, sup, SUM(f2 * f3) AS total, MAX(f2 * f3) AS top,
        CASE WHEN SUM(CASE WHEN element_class = 'PROMO' THEN f2 * f3 ELSE 0 END) >= 0.5 * SUM(f2 * f3) THEN 'promo alloy' WHEN SUM(CASE WHEN element_class IN ('LARGE', 'SMALL') THEN f2 * f3 ELSE 0 END) >= 0.5 * SUM(f2 * f3) THEN 'size alloy'
        WHEN MAX(f2 * f3) >= 0.9 * SUM(f2 * f3) THEN 'pure' ELSE 'mixed' END AS named_class FROM path GROUP BY ord, sup) c""",
    "material_comps": "SELECT material_class, element_class, round(SUM(kg * elem_best), 4) AS kg FROM mat GROUP BY 1, 2",
    "slice_name": """SELECT DISTINCT concat(product_class, '_Y', CAST(yr AS STRING)) AS slice, product_class FROM prod UNION SELECT concat(product_class, '_Y', CAST(MIN(yr) AS STRING), '_', CAST(MAX(yr) AS STRING)), product_class FROM prod GROUP BY product_class HAVING MIN(yr) < MAX(yr)""",
    "instance_names": "SELECT concat('P', CAST(ord AS STRING)) AS product, concat('C', CAST(ord AS STRING), '_', CAST(sup AS STRING)) AS component, concat('M', CAST(ord AS STRING), '_', CAST(sup AS STRING), '_', CAST(prt AS STRING)) AS material FROM facts",
    "statement_id": "SELECT concat('stmt_', sha1(concat_ws('|', source_id, CAST(ord AS STRING), CAST(sup AS STRING), CAST(prt AS STRING), CAST(CAST(round(kg * 1000, 0) AS BIGINT) AS STRING)))) AS statement_id, ord, sup, prt FROM facts",
    "amount_id": "SELECT concat_ws('_', CAST(ord AS STRING), element_class) AS amount_id, round(amount, 9) AS amount FROM reach",
    "content_hash": "SELECT ord, sup, prt, sha1(concat_ws('|', source_id, CAST(ord AS STRING), CAST(sup AS STRING), CAST(prt AS STRING), CAST(CAST(round(kg * 1000, 0) AS BIGINT) AS STRING), CAST(CAST(round(lo * 1000000, 0) AS BIGINT) AS STRING), CAST(CAST(round(hi * 1000000, 0) AS BIGINT) AS STRING), unit)) AS content_hash FROM stmt",
    "product_label": """SELECT DISTINCT product_class, concat_ws(' — ', k.text, concat('nation ', substr(product_class, position('_' IN product_class) + 1))) AS label FROM placed p
        JOIN (SELECT * FROM (VALUES ('AUTOMOBILE', 'cars'), ('BUILDING', 'buildings'), ('FURNITURE', 'furniture'), ('HOUSEHOLD', 'household goods'), ('MACHINERY', 'machines')) AS t(code, text)) k ON k.code = p.product_parent""",
    "scope_phrase": """SELECT DISTINCT y0, y1, CASE WHEN y0 = y1 THEN concat(CAST(y0 AS STRING), ' production year') ELSE concat(CAST(y0 AS STRING), '–', CAST(y1 AS STRING), ' production period') END AS phrase
        FROM (SELECT y0, y1 FROM class_time UNION SELECT MIN(yr), MAX(yr) FROM prod GROUP BY product_class) s""",
    "local_name": ("SELECT DISTINCT product_class, regexp_extract(concat('x#', product_class), '[^#/]+$', 0) AS local_name FROM prod", "SELECT DISTINCT product_class, regexp_extract(concat('x#', product_class), '[^#/]+$') AS local_name FROM prod"),
    "unit_canonical": "SELECT u.unit, u.kind, u.scale, COUNT(*) AS n FROM facts f JOIN (SELECT * FROM (VALUES ('F', 'gkg', 'fraction', 0.001E0), ('O', 'kgkg', 'fraction', 1.0E0)) AS t(status, unit, kind, scale)) u ON f.status = u.status GROUP BY 1, 2, 3",
    "edge_rel_uncertainty": "SELECT s.ord, s.sup, s.prt, round(CASE WHEN s.elem_best > 0 THEN ((s.elem_best * (1 + s.lim) - s.elem_best) / s.elem_best) / sqrt(3.0E0) ELSE 0 END, 9) AS rel FROM stmt s",
    "round9": "SELECT ord, sup, round(best, 9) AS best FROM pc",
    "load_subset": "SELECT ord, mass, product_class FROM prod WHERE yr IN (1995, 1996) AND product_parent = 'BUILDING'",
    "distinct_units": "SELECT DISTINCT CASE WHEN status = 'F' THEN 'gkg' ELSE 'kgkg' END AS unit FROM facts",
}
