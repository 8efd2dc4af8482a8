"""Raw cells of fact rows: absent tokens, catch-alls, symbols and classes, and the corrections beside them.

`raw` shows line items as the rows of a fact file, all cells text: some keys are absent in
the ways that files write that, some are catch-alls, elements come as symbols or compounds.
"""

_ABSENT = "('', 'n/a', 'na', 'none', 'nan', 'null', '-')"
#: Symbols of elements.
SYMBOLS = {"EC": "ECONOMY", "LA": "LARGE", "ME": "MEDIUM", "PR": "PROMO", "SM": "SMALL", "ST": "STANDARD"}
_SYMBOLS = ", ".join(f"('{s}', '{e}')" for s, e in SYMBOLS.items())
RAW = """(SELECT l_orderkey AS ord, l_suppkey AS sup, l_partkey AS prt, l_linenumber AS line, CASE WHEN l_partkey % 23 = 0 THEN ' ' ELSE concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), ' ') END AS value_cell,
    CASE CAST(l_suppkey % 7 AS INT) WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' ELSE r_name END AS component0, CASE CAST(l_suppkey % 11 AS INT) WHEN 0 THEN 'otherOrUndefinedPart' WHEN 1 THEN 'unknownPart' WHEN 2 THEN 'elvRest' WHEN 3 THEN 'nan' ELSE n_name END AS component1,
    CASE CAST(l_partkey % 13 AS INT) WHEN 0 THEN 'None' WHEN 1 THEN '' ELSE substr(p_brand, 1, 7) END AS material0, CASE CAST(l_partkey % 17 AS INT) WHEN 0 THEN 'null' WHEN 1 THEN 'Rest of alloys' ELSE p_brand END AS material1,
    CASE CAST(l_partkey % 19 AS INT) WHEN 0 THEN concat(substr(p_type, 1, 2), '_O') WHEN 1 THEN 'Others' ELSE substr(p_type, 1, 2) END AS element, CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE concat(CAST(year(l_shipdate) AS STRING), '.0') END AS year_cell
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) raw"""


def _present(cell: str) -> str:
    return f"CASE WHEN {cell} IS NULL OR lower(trim({cell})) IN {_ABSENT} THEN NULL ELSE {cell} END"


_PATH = [_present(f"component{i}") for i in range(2)]
_CATCHALL = " OR ".join(f"lower({{0}}) LIKE '%{t}%'" for t in ("other", "undefined", "unknown", "rest"))
_OMIT = "{0} LIKE 'otherOrUndefined%' OR {0} LIKE 'unknown%' OR {0} = 'elvRest'"

SQL = {
    "parse_numeric": f"SELECT ord, line, try_cast(nullif(trim(value_cell), '') AS DOUBLE) AS parsed FROM {RAW}",
    "null_tokens": f"SELECT ord, line, {_present('component0')} AS component0, {_present('component1')} AS component1, {_present('material0')} AS material0, {_present('material1')} AS material1 FROM {RAW}",
    "key_path": f"SELECT ord, line, concat_ws('/', {', '.join(_PATH)}) AS component_path, coalesce({_PATH[1]}, {_PATH[0]}) AS component_leaf, concat_ws('/', {_present('material0')}, {_present('material1')}) AS material_path, coalesce({_present('material1')}, {_present('material0')}) AS material_leaf FROM {RAW}",
    "catchall_filter": f"SELECT ord, line, component1, material1 FROM {RAW} WHERE {_CATCHALL.format('component1')} OR {_CATCHALL.format('material1')}",
    # a remainder class goes with the edges that it is an end of
    "omit_remainder_class": f"SELECT ord, line, component1, material1 FROM {RAW} WHERE NOT ({_OMIT.format('component1')}) AND NOT ({_OMIT.format('material1')})",
    "year_of_row": f"SELECT ord, line, coalesce(CAST(try_cast(nullif(trim(year_cell), '') AS DOUBLE) AS INT), 0) AS yr FROM {RAW}",
    # the first part of a compound is looked up; a known symbol wins over a catch-all, and what is neither is refused
    "element_symbol": f"SELECT r.ord, r.line, CASE WHEN k.element_class IS NOT NULL THEN k.element_class WHEN {_CATCHALL.format('r.element')} THEN 'CatchAll' END AS element_class, k.element_class IS NULL AND NOT ({_CATCHALL.format('r.element')}) AS refused FROM (SELECT ord, line, element, CASE WHEN position('_' IN element) > 0 THEN substr(element, 1, position('_' IN element) - 1) ELSE element END AS symbol FROM {RAW}) r LEFT JOIN (SELECT * FROM (VALUES {_SYMBOLS}) AS t(symbol, element_class)) k ON upper(r.symbol) = k.symbol",
    # alias, forced catch-all, declared, catch-all, refusal, in that order
    "resolve_class": f"""SELECT r.ord, r.line, coalesce(a.class, CASE WHEN {_OMIT.format('r.key')} THEN 'CatchAll' END, t.child, CASE WHEN {_CATCHALL.format('r.key')} THEN 'CatchAll' END, 'refused') AS class
        FROM (SELECT ord, line, coalesce({_present('material1')}, {_present('material0')}, 'missing') AS key FROM {RAW}) r LEFT JOIN (SELECT * FROM (VALUES ('Brand#2', 'Brand#21'), ('Brand#25', 'Brand#24')) AS t(key, class)) a ON r.key = a.key
        LEFT JOIN (SELECT DISTINCT child FROM taxonomy WHERE child LIKE 'Brand%') t ON r.key = t.child""",
    # corrections of one dimension, by the exact components, material and all six scores
    "corrections_lookup": """SELECT m.ord, m.sup, m.prt, CASE WHEN c.dim = 'accuracy' THEN c.score ELSE m.q_accuracy END AS q_accuracy, CASE WHEN c.dim = 'timeliness' THEN c.score ELSE m.q_timeliness END AS q_timeliness FROM mat m LEFT JOIN (
        SELECT component_class, material_class, q_validity, q_accuracy, q_consistency, q_integrity, q_timeliness, q_completeness, CASE WHEN MIN(prt) % 2 = 0 THEN 'accuracy' ELSE 'timeliness' END AS dim, 1 AS score FROM mat WHERE q_validity = 1 AND q_integrity = 2 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8) c
        ON m.component_class = c.component_class AND m.material_class = c.material_class AND m.q_validity = c.q_validity AND m.q_accuracy = c.q_accuracy AND m.q_consistency = c.q_consistency AND m.q_integrity = c.q_integrity AND m.q_timeliness = c.q_timeliness AND m.q_completeness = c.q_completeness""",
    # a score of 3 in the last dimension counts as missing here, so that defaults are met
    "fill_quality": "SELECT ord, sup, prt, q_validity, q_accuracy, coalesce(nullif(q_consistency, 3), 3) AS q_consistency, coalesce(nullif(q_timeliness, 1), 3) AS q_timeliness, coalesce(CASE WHEN prt % 5 > 0 THEN q_completeness END, 2) AS q_completeness FROM mat",
}
