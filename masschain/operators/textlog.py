"""Text and run-log jobs over documents, events and conversations."""

_NUMBERS = ("SELECT doc_id, explode(regexp_extract_all(text, '[0-9]+([.][0-9]+)?', 0)) AS number FROM documents", "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+([.][0-9]+)?', 0)) AS number FROM documents")


def _pair(text: str) -> tuple[str, str]:
    """A text for Spark and the check, with what differs between them filled in."""
    return tuple(text.replace("{numbers}", n) for n in _NUMBERS)


#: Answers of one year against expected ones of another, matched at 2 % or at the precision stated (two digits); a band of 20 % for uncertainty.
_SCORED = """SELECT coalesce(e.product_class, a.product_class) AS case_id, coalesce(e.element_class, a.element_class) AS label, CASE WHEN a.amount IS NULL THEN 'missing' WHEN e.amount IS NULL THEN 'extra' WHEN abs(a.amount - e.amount) <= 0.02 * abs(e.amount) OR round(a.amount, 2) = round(e.amount, 2) THEN 'match'
    WHEN abs(a.amount * 1000 - e.amount) <= 0.02 * abs(e.amount) OR abs(a.amount - e.amount * 1000) <= 20 * abs(e.amount) THEN 'unit' WHEN abs(a.amount - e.amount) <= 0.2 * abs(e.amount) THEN 'band' ELSE 'off' END AS status
    FROM (SELECT product_class, element_class, amount FROM leaf_mean WHERE yr = 1995) e FULL OUTER JOIN (SELECT product_class, element_class, amount FROM leaf_mean WHERE yr = 1996) a ON e.product_class = a.product_class AND e.element_class = a.element_class"""

SQL = {
    "vocabulary_harvest": "SELECT DISTINCT lower(p_name) AS phrase FROM part WHERE length(p_name) - length(replace(p_name, ' ', '')) >= 1 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM (VALUES ('old'), ('hot')) AS t(stop)) s WHERE lower(p_name) LIKE concat(stop, ' %'))",
    "result_kind": "SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN lower(text) LIKE '%error%' OR lower(text) LIKE '%failed%' OR lower(text) LIKE '%exception%' THEN 'error' WHEN text LIKE '%{%' OR text LIKE '%: %' OR text LIKE '%|%' OR length(text) > length(translate(text, '0123456789', '')) THEN 'data' ELSE 'other' END AS kind FROM conversations",
    "call_pairing": "SELECT c.conv_id, c.turn, r.turn AS answer_turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') c LEFT JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') r ON c.conv_id = r.conv_id AND c.k = r.k",
    "run_timeline": "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS step, CASE WHEN role = 'user' THEN lead(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN lower(text) LIKE '%error%' THEN 'error' ELSE 'data' END) OVER (PARTITION BY conv_id ORDER BY turn) END AS result_kind FROM conversations",
    "behaviour_flags": """SELECT c.conv_id, COUNT(*) AS turns, SUM(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) = 0 AS unanswered, MAX(coalesce(d.n, 0)) >= 4 AS repeats, SUM(CASE WHEN role = 'user' AND lower(text) LIKE '%doc_%' THEN 1 ELSE 0 END) > 0 AS listed_ids,
        SUM(CASE WHEN text IS NULL OR trim(text) = '' THEN 0 ELSE 1 END) = 0 AS all_empty FROM conversations c LEFT JOIN (SELECT conv_id, MAX(k) AS n FROM (SELECT conv_id, lower(trim(text)) AS t, COUNT(*) AS k FROM conversations GROUP BY conv_id, lower(trim(text))) x GROUP BY conv_id) d ON c.conv_id = d.conv_id GROUP BY c.conv_id""",
    "flag_frequency": """SELECT flag, COUNT(*) AS n, COUNT(CASE WHEN failed THEN 1 END) AS n_failed FROM (SELECT conv_id, CASE WHEN lower(text) LIKE '%error%' THEN 'error text' WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) > 500 THEN 'long' ELSE 'plain' END AS flag, conv_id % 7 = 0 AS failed FROM conversations WHERE role = 'assistant') f GROUP BY flag""",
    "quality_table": "SELECT event_type, COUNT(CASE WHEN value > 50 THEN 1 END) AS high, COUNT(CASE WHEN value <= 50 THEN 1 END) AS low FROM events GROUP BY 1",
    "effort_table": "SELECT user_id, COUNT(*) AS n, round(AVG(value), 6) AS mean_value FROM events GROUP BY 1",
    "rerun_overlay": "SELECT user_id, event_type, event_id, value FROM (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) t WHERE k = 1",
    "error_category": f"SELECT case_id, CASE WHEN SUM(CASE WHEN status = 'missing' THEN 1 ELSE 0 END) > 0 THEN 'missing' WHEN SUM(CASE WHEN status = 'extra' THEN 1 ELSE 0 END) > 0 THEN 'extra' WHEN SUM(CASE WHEN status = 'unit' THEN 1 ELSE 0 END) > 0 THEN 'unit' WHEN SUM(CASE WHEN status = 'off' THEN 1 ELSE 0 END) > 0 THEN 'value' ELSE 'near' END AS category FROM ({_SCORED}) s GROUP BY case_id HAVING SUM(CASE WHEN status <> 'match' THEN 1 ELSE 0 END) > 0",
    "failed_case_subset": "SELECT DISTINCT user_id FROM events WHERE value < 2",
    "answer_score": f"SELECT case_id, label, status, status = 'match' AS correct FROM ({_SCORED}) s",
    "member_set_check": """SELECT p.product_parent, COUNT(*) AS expected, COUNT(CASE WHEN r.element_class IS NULL THEN 1 END) AS missing FROM (SELECT DISTINCT p.product_parent, x.p_type FROM (SELECT DISTINCT product_parent FROM placed) p JOIN (SELECT DISTINCT p_type FROM part) x ON p.product_parent <> x.p_type) p
        LEFT JOIN (SELECT DISTINCT product_parent, element_class FROM leaf_mean WHERE yr = 1995) r ON p.product_parent = r.product_parent AND p.p_type = r.element_class GROUP BY p.product_parent""",
    "golden_rows_check": """WITH golden AS (SELECT p.product_class, p.yr, m.element_class, SUM(m.kg * m.elem_best / w.mass) AS total FROM mat m JOIN prod_mass w ON m.ord = w.ord JOIN placed p ON m.ord = p.ord GROUP BY p.product_class, p.yr, m.element_class)
        SELECT coalesce(l.product_class, g.product_class) AS product_class, coalesce(l.yr, g.yr) AS yr, COUNT(*) AS n, COUNT(CASE WHEN abs(l.amount * i.n - g.total) <= 0.02 * g.total THEN 1 END) AS near, COUNT(CASE WHEN g.total IS NULL THEN 1 END) AS extra FROM leaf_mean l
        FULL OUTER JOIN golden g ON l.product_class = g.product_class AND l.yr = g.yr AND l.element_class = g.element_class LEFT JOIN item_mass i ON i.product_class = g.product_class AND i.yr = g.yr GROUP BY 1, 2""",
    "golden_value_scan": _pair("SELECT n.doc_id, n.number, COUNT(*) AS n FROM ({numbers}) n JOIN (SELECT DISTINCT CAST(p_size AS STRING) AS golden FROM part WHERE p_size >= 10) g ON n.number = g.golden GROUP BY n.doc_id, n.number"),
}
