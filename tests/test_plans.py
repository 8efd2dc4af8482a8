"""What plans read and move: one pass over line items for all paths, and lookups that read a part of a written view."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from masschain.operators import lookups
from masschain.plans import registry, shared, tables, view

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["hop3_composition", "total_and_rss", "group_total_rss", "reconcile_residual", "class_leaf_mean", "coarse_vs_granular"])
def test_line_items_are_read_once(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, DATA))
    assert len(re.findall(r"Location: .*lineitem\.parquet", plan)) == 1
    assert "l_extendedprice" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lookups_read_the_view_with_their_filter(spark):
    df = tables.sql_query(lookups.view_lookup("BUILDING/NATION_3"))(spark, DATA)
    plan = plan_of(df)
    assert "lineitem" not in plan and "views/leaf_mean-" in plan and "EqualTo(product_class,BUILDING/NATION_3)" in plan


def test_a_view_follows_its_files_and_is_dropped(spark, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        tables.read(spark, DATA, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = str(tmp_path)
    count = lambda: view.served(spark, folder, "item_mass").agg(F.sum("n")).first()[0]
    before = count()
    first = view.path_of(spark, folder, "item_mass")
    assert before == tables.read(spark, folder, "lineitem").select("l_orderkey").distinct().count() == count()
    other = spark.newSession()
    assert view.served(other, folder, "item_mass").inputFiles() == view.served(spark, folder, "item_mass").inputFiles()
    tables.read(spark, DATA, "lineitem").filter("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    assert count() < before
    second = view.path_of(spark, folder, "item_mass")
    assert first != second and shared.exists(spark, first) and shared.exists(spark, second)
    view.drop_views(spark)
    assert not shared.exists(spark, first) and not shared.exists(spark, second)


def test_parameters_are_literals(spark):
    assert lookups.lit("O'Brien") == "'O''Brien'"
    assert tables.sql_query(lookups.item_mass_of_class("no such ' class"))(spark, DATA).count() == 0


def test_line_items_are_dealt_by_their_size(spark, monkeypatch):
    from masschain.plans import shared, tables

    folder, text = "/root/testdata/sf0.001", tables.with_ctes("SELECT * FROM facts")
    assert tables.dealt(spark, folder, text) == text
    monkeypatch.setattr(tables, "DEALT_BYTES", shared.size_of(spark, f"{folder}/lineitem.parquet") // 20)
    dealt = tables.run(spark, folder, text)
    assert 20 <= dealt.rdd.getNumPartitions() <= 21 and tables.dealt(spark, "/nowhere", text) == text


def test_line_items_meet_large_tables_unsorted(spark, monkeypatch):
    text = tables.with_ctes("SELECT * FROM path")
    sent = plan_of(tables.run(spark, DATA, text))
    monkeypatch.setattr(tables, "SENT_BYTES", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hashed = plan_of(tables.run(spark, DATA, text))
        want = sorted(map(str, tables.run(spark, DATA, text).select("ord", "sup", "prt", "f").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = lambda plan, kind: len(re.findall(rf"^\(\d+\) {kind}", plan, re.M))
    assert joins(sent, "BroadcastHashJoin") >= 2 and joins(sent, "ShuffledHashJoin") == joins(sent, "SortMergeJoin") == 0
    assert joins(hashed, "ShuffledHashJoin") == 2  # only nations and regions, which are small at any size, are left to Spark
    monkeypatch.undo()
    assert want == sorted(map(str, tables.run(spark, DATA, text).select("ord", "sup", "prt", "f").collect()))


def test_line_items_are_dealt_by_their_size_below_the_number_of_shuffle_partitions(spark, monkeypatch):
    text = tables.with_ctes("SELECT * FROM facts")
    monkeypatch.setattr(tables, "DEALT_BYTES", shared.size_of(spark, f"{DATA}/lineitem.parquet") // 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert 20 <= tables.run(spark, DATA, text).rdd.getNumPartitions() <= 21
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sums_over_paths_come_from_one_pass(spark, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        kept = {"orders": "o_orderkey % 5 <> 0", "part": "p_partkey % 7 <> 0"}.get(name, "true")  # some products have no place, some line items no material
        tables.read(spark, DATA, name).filter(kept).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = str(tmp_path)
    plan = plan_of(tables.run(spark, folder, tables.with_ctes(tables.path_sums(list(tables.PATH_SUMS)))))
    assert len(re.findall(r"Location: .*lineitem\.parquet", plan)) == 1
    tables.sql_query(lookups.slice_view("FURNITURE"))(spark, folder)
    there = {name for name in tables.PATH_SUMS if shared.exists(spark, view.path_of(spark, folder, name))}
    assert there == {"leaf_mean", "scope_amount"}
    for name in tables.PATH_SUMS:
        want = tables.run(spark, folder, tables.with_ctes(f"SELECT * FROM {name}"))
        keys = list(tables.PATH_SUMS[name][0])
        got = {tuple(r[k] for k in keys): r.asDict() for r in view.served(spark, folder, name).collect()}
        want = {tuple(r[k] for k in keys): r.asDict() for r in want.collect()}
        assert want and got.keys() == want.keys()
        for k, row in want.items():
            assert all(got[k][c] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v) for c, v in row.items()), (name, k)


def test_the_whole_view_takes_one_pass_over_paths(spark, monkeypatch):
    from masschain.sources import files

    view.drop_views(spark)
    passes, path_sums = [], tables.path_sums
    monkeypatch.setattr(tables, "path_sums", lambda names: passes.append(sorted(names)) or path_sums(names))
    files.sink_view(spark, DATA)
    assert passes == [sorted(tables.PATH_SUMS)]
