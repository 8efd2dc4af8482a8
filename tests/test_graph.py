"""Closures, roots and paths over edges of any depth, against plain Python."""

import pytest
from pyspark.sql import functions as F

from masschain.operators import graph, search


def above(edges):
    """Shortest numbers of steps from each node to each other one that its edges lead to."""
    out, nodes = {}, {x for e in edges for x in e}
    for start in nodes:
        seen, frontier, depth = {start: 0}, {start}, 0
        while frontier:
            depth += 1
            frontier = {p for c, p in edges if c in frontier and p not in seen}
            seen |= dict.fromkeys(frontier, depth)
        out |= {(start, x): d for x, d in seen.items() if x != start}
    return out


@pytest.mark.parametrize("edges", [
    [("leaf", "sub"), ("sub", "class"), ("class", "family"), ("family", "Root"), ("other", "family"), ("leaf", "family")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")],
    [(f"n{i}", f"n{i + 1}") for i in range(19)],
    [("x", "x"), ("x", "y")],
])
def test_closure_of_deep_and_cyclic_edges(spark, edges):
    found = graph.closure_with_depth(spark.createDataFrame(edges, "child string, parent string")).collect()
    assert {(r["descendant"], r["ancestor"]): r["depth"] for r in found} == above(edges) and len(found) == len(above(edges))


def test_closure_of_no_edges(spark):
    none = spark.createDataFrame([], "child string, parent string")
    assert graph.closure_with_depth(none).count() == 0


def test_roots_over_several_depths(spark):
    edges = [("e", "m"), ("m", "c"), ("c", "p"), ("m2", "c"), ("c2", "q"), ("e", "c2")]
    found = {(r["node"], r["root"]) for r in graph.roots_of(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert found == {("e", "p"), ("e", "q"), ("m", "p"), ("m2", "p"), ("c", "p"), ("c2", "q")}


def test_roots_of_a_long_chain_and_beside_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(1000)]
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("both", "a"), ("both", "n3"), ("c", "c"), ("leaf", "top"), ("b", "top")]
    found = {(r["node"], r["root"]) for r in graph.roots_of(spark.createDataFrame(chain + cycle * 2, "child string, parent string")).collect()}
    expected = {(f"n{i}", "n1000") for i in range(1000)} | {("both", "n1000"), ("leaf", "top")} | {(x, "top") for x in ("a", "b", "c", "into", "both")}
    assert found == expected
    only = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string")
    assert graph.roots_of(only).count() == 0 and graph.roots_of(only.limit(0)).count() == 0


def test_paths_of_many_edges(spark):
    edges = [(f"d{i}", f"d{i + 1}", 1.0, 1, 1) for i in range(70)]
    found = graph.granular_reach(spark.createDataFrame(edges, "whole string, part string, best double, whole_rank int, part_rank int"))
    assert found.count() == 70 * 71 // 2 and found.agg(F.max("depth")).first()[0] == 70


def test_paths_skip_coarse_edges_and_end_at_loops(spark):
    edges = [("p", "c", 0.5, 0, 1), ("c", "d", 0.4, 1, 1), ("d", "c", 0.9, 1, 1), ("d", "m", 0.5, 1, 2), ("p", "m", 0.3, 0, 2)]
    found = graph.granular_reach(spark.createDataFrame(edges, "whole string, part string, best double, whole_rank int, part_rank int")).collect()
    paths = {(r["whole"], r["part"]): round(r["fraction"], 9) for r in found}
    assert paths == {("p", "c"): 0.5, ("c", "d"): 0.4, ("d", "c"): 0.9, ("d", "m"): 0.5, ("p", "d"): 0.2, ("c", "m"): 0.2, ("p", "m"): 0.1}


def test_nearest_neighbours_against_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "PASS", 3)
    monkeypatch.setattr(search, "SAMPLE", 60)
    vectors = np.random.default_rng(1).normal(size=(400, 6)).round(2)
    vectors[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1.0] * 6), (401, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1, keepdims=True) > 0, np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    expected = {}
    for q in range(0, 400, 50):
        score = np.round(unit @ unit[q], 6)
        expected[q] = [int(i) for i in np.lexsort((np.arange(400), -score)) if i != q][:4]
    got = {}
    for r in search.nearest_k(table, 4).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == expected
    with pytest.raises(ValueError, match="1..50"):
        search.nearest_k(table, 51)
    assert search.nearest_k(table.filter(F.lit(False)), 3).count() == 0


def test_a_task_of_nearest_neighbours_holds_small_blocks():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    vectors, ids = np.random.default_rng(2).normal(size=(6000, 4)), np.arange(6000)
    queries = SimpleNamespace(value=(ids[:1500], search._unit(vectors[:1500]), np.full(1500, -np.inf)))
    tracemalloc.start()
    found = pd.concat(search._nearest(queries, 5)(iter([pd.DataFrame({"vec_id": ids, "embedding": list(vectors)})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    score = np.round(search._unit(vectors) @ search._unit(vectors[:3]).T, 6)
    for q in range(3):
        assert found[found["query_id"] == q]["vec_id"].tolist() == [i for i in np.lexsort((ids, -score[:, q])) if i != q][:5]


GROUPED = "g long, whole string, part string, best double, whole_rank int, part_rank int, cls string"


def _layers(group, width):
    """Edges of three full layers of nodes, or of one loop of equal ranks beside them."""
    at = lambda r, i: f"{group}.{r}.{i}"
    return [(group, at(r, i), at(r + 1, j), 0.5 + i / 8, r, r + 1, f"k{r}") for r in range(3) for i in range(width) for j in range(width)]


def test_paths_and_roots_by_group_are_those_of_the_loops(spark):
    loop = [(7, "7.a", "7.b", 0.5, 1, 1, "x"), (7, "7.b", "7.a", 0.5, 1, 1, "x"), (7, "7.b", "7.c", 0.5, 1, 2, "y"), (7, "7.t", "7.b", 1.0, 0, 1, "z")]
    rows = _layers(1, 1) + _layers(2, 4) + _layers(3, 5) + loop + _layers(None, 2) + [(9, "9.a", "9.b", 1.0, 0, 2, "far"), (9, "9.c", None, 1.0, 0, 1, "none")]
    edges = spark.createDataFrame(rows, GROUPED)  # group 3 is larger than GROUP, 7 does not step by one
    show = lambda df: sorted((r["whole"], r["part"], round(r["fraction"], 9), r["depth"], tuple(r["levels"])) for r in df.collect())
    by_group = graph.granular_reach(edges, "g", ["cls"])
    assert show(by_group) == show(graph.granular_reach(edges)) and by_group.columns[0] == "g"
    assert {r["cls"] for r in by_group.filter("part LIKE '2.3.%'").collect()} == {"k2"}
    up = edges.select("g", F.col("part").alias("child"), F.col("whole").alias("parent"))
    pairs = lambda df: sorted((r["node"], r["root"]) for r in df.collect())
    assert pairs(graph.roots_of(up, within="g")) == pairs(graph.roots_of(up))
    chain = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(graph.GROUP)], "g long, child string, parent string")
    assert pairs(graph.roots_of(chain, within="g")) == sorted((f"n{i}", f"n{graph.GROUP}") for i in range(graph.GROUP))
