"""Registered queries against the same questions asked of DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from masschain.plans import registry

DATA = "/root/testdata/sf0.001"
#: One or more of each kind; the driver compares all of them.
CHECKED = [
    "hop3_composition", "hop2_material", "layer_fractions", "default_endpoints", "class_leaf_mean", "class_ancestor_mean", "class_uncertainty",
    "class_dq", "reconcile_residual", "mass_conservation", "balance_level", "unknown_plan", "inferred_unknown_content", "material_canonicalize", "year_run_islands", "taxonomy_closure", "table_diff",
    "direct_child_anti", "percentile_interp", "term_leak_scan", "rerun_overlay", "level_rollup_check",
    "element_symbol", "resolve_class", "corrections_lookup", "parent_gate", "decompose_unknown", "remainder_dedup", "median_iqr", "question_cu_distribution", "component_context_lookup", "routed_query", "root_of", "granular_reach",
    "materialize_rules", "refresh_view", "affected_classes", "add_source", "scan_facts_csv", "scan_corrections", "scan_corpus", "catalog_incremental", "sink_view", "sample_edge", "mc_band_segment", "projection_plugin", "ruleset_as_data", "golden_value_scan", "nearest_k", "ungrounded_numbers",
]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    return f"{float(value):.7g}" if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    mine = registry.QUERIES[name](spark, DATA)
    theirs = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=key)


def test_levels_sum_to_one(spark):
    assert {r["total"] for r in registry.QUERIES["sum_check_levels"](spark, DATA).collect()} == {1.0}


def test_roll_up_of_levels_equals_path_sum(spark):
    assert {r["equal"] for r in registry.QUERIES["level_rollup_check"](spark, DATA).collect()} == {True}
