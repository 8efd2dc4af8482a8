"""Roll-ups over hierarchies of several heights, against plain recursion."""

import math
from collections import defaultdict

import pytest
from masschain.operators import heights
from masschain.plans import tables

DATA = "/root/testdata/sf0.001"
EDGES = "parent string, child string"
VALUES = "class string, element_class string, best double, rel double, mean_dq double, dqs int"


def recursed(values, edges, over):
    """Each class by its definition, from its subclasses; classes on or above a cycle are left out."""
    own = defaultdict(dict)
    for c, k, *rest in values:
        own[c][k] = rest
    subclasses = defaultdict(set)
    for p, c in edges:
        if p != c:
            subclasses[p].add(c)
    done = {}

    def of(c, trail):
        if c in trail:
            raise RecursionError
        if c in own:
            return own[c]
        return aggregate(c, trail)

    def aggregate(p, trail=()):
        if p not in done:
            done[p] = None
            subs = {}
            try:
                for c in subclasses[p]:
                    below = of(c, (*trail, p))
                    if below is None and c in subclasses and reaches(c):
                        raise RecursionError
                    if below is not None:
                        subs[c] = below
            except RecursionError:
                return None
            if not subs:
                return None
            out = {}
            for k in {k for v in subs.values() for k in v}:
                have = [v[k] for v in subs.values() if k in v]
                best = sum(v[0] for v in have) / (len(have) if over == "having" else len(subs))
                rels = [v[0] * v[1] for v in have if v[1] is not None]
                dqs = [(v[0], v[2]) for v in have if v[2] is not None]
                worst = [v[3] for v in have if v[3] is not None]
                out[k] = [best, math.sqrt(sum(s * s for s in rels)) / len(subs) / best if rels else None,
                          sum(b * q for b, q in dqs) / sum(b for b, _ in dqs) if dqs else None, max(worst, default=None), len(have)]
            done[p] = out
        return done[p]

    def reaches(c, seen=()):
        return c in own or any(reaches(x, (*seen, c)) for x in subclasses[c] if x not in seen)

    for p in list(subclasses):
        aggregate(p)
    return {(p, k): v for p, out in done.items() if out for k, v in out.items()}


def five_levels():
    values, edges = [], []
    for i in range(24):
        leaf = f"leaf{i}"
        for k in range(i % 4):
            values.append((leaf, f"e{k}", 0.1 + i / 50 + k, None if i % 5 == 0 else 0.1 + i / 100, None if i % 7 == 0 else 1.0 + k, 1 + (i + k) % 4))
        edges += [(f"a{i // 3}", leaf), (f"b{i // 8}", leaf if i % 11 == 0 else f"a{i // 3}")]
    edges += [("c0", "b0"), ("c0", "b1"), ("c1", "b2"), ("d", "c0"), ("d", "c1"), ("root", "d"), ("root", "leaf9"), ("other", "nothing"), ("a1", "a1")]
    return values, edges


@pytest.mark.parametrize("over", ["having", "all"])
@pytest.mark.parametrize("rounds", [32, 2])
def test_five_heights_against_recursion(spark, over, rounds, monkeypatch):
    monkeypatch.setattr(heights, "ROUNDS", rounds)
    values, edges = five_levels()
    got = heights.roll_up(spark.createDataFrame(values, VALUES), spark.createDataFrame(edges * 2, EDGES), ["element_class"], over).collect()
    found = {(r["class"], r["element_class"]): [r["best"], r["rel"], r["mean_dq"], r["dqs"], r["n_children"]] for r in got}
    want = recursed(values, edges, over)
    assert len(got) == len(found) and found.keys() == want.keys() and ("root", "e2") in found
    for key, row in want.items():
        assert found[key] == [None if v is None else pytest.approx(v, rel=1e-12) for v in row], key


def test_classes_on_cycles_have_no_aggregate_and_the_others_do(spark):
    values = [("x", "e", 1.0, 0.1, 2.0, 1), ("y", "e", 3.0, None, None, None)]
    edges = [("p", "x"), ("p", "y"), ("q", "p"), ("loop1", "x"), ("loop1", "loop2"), ("loop2", "loop1"), ("above", "loop2"), ("above", "x"), ("x", "y")]
    got = heights.roll_up(spark.createDataFrame(values, VALUES), spark.createDataFrame(edges, EDGES), ["element_class"]).collect()
    assert {(r["class"], r["best"], r["n_children"]) for r in got} == {("p", 2.0, 2), ("q", 2.0, 1), ("x", 3.0, 1)}


def test_a_chain_longer_than_the_rounds(spark):
    values = [("n0", "e", 2.0, 0.5, 1.0, 3)]
    edges = [(f"n{i + 1}", f"n{i}") for i in range(9)]
    heights_before, heights.ROUNDS = heights.ROUNDS, 3
    try:
        got = heights.roll_up(spark.createDataFrame(values, VALUES), spark.createDataFrame(edges, EDGES), ["element_class"]).collect()
    finally:
        heights.ROUNDS = heights_before
    assert {(r["class"], r["best"], r["rel"], r["dqs"]) for r in got} == {(f"n{i}", 2.0, 0.5, 3) for i in range(1, 10)}


def test_no_values_no_edges_and_nulls(spark):
    none, edges = spark.createDataFrame([], VALUES), spark.createDataFrame([("p", "x")], EDGES)
    assert heights.roll_up(none, edges, ["element_class"]).count() == 0
    assert heights.roll_up(spark.createDataFrame([("x", "e", 1.0, 0.1, 1.0, 1)], VALUES), edges.limit(0), ["element_class"]).count() == 0
    odd = spark.createDataFrame([("x", "e", None, None, None, None), (None, "e", 1.0, 1.0, 1.0, 1), ("y", None, 0.0, 0.5, 1.0, 2)], VALUES)
    got = heights.roll_up(odd, spark.createDataFrame([("p", "x"), ("p", "y"), (None, "x"), ("p", None)], EDGES), ["element_class"]).collect()
    assert {(r["class"], r["element_class"], r["best"], r["rel"]) for r in got} == {("p", "e", None, None), ("p", None, 0.0, None)}
    with pytest.raises(ValueError):
        heights.roll_up(odd, edges, ["element_class"], "some")


def test_the_gate_over_several_scopes(spark):
    """Scoped parents take what lies inside their span; a mean of slices takes scoped ones; others take none."""
    subclass = [("y95", "p9x"), ("y96", "p9x"), ("y05", "p9x"), ("y95", "base"), ("plain", "base"), ("y96", "mean"), ("plain", "mean"), ("y95", "free")]
    frames = {
        "subclass": spark.createDataFrame(subclass, "child string, parent string"),
        "class_time": spark.createDataFrame([("y95", 1995, 1995), ("y96", 1996, 1996), ("y05", 2005, 2005), ("p9x", 1990, 1999)], "class string, y0 int, y1 int"),
        "strategy": spark.createDataFrame([("mean", "year-slice-mean"), ("free", "equal-subclass-mean")], "class string, strategy string"),
        "slices": spark.createDataFrame([("y95", "base", "year")], "class string, parent string, axis string"),
    }
    got = tables.run(spark, DATA, tables.CTES["gate"][1], **frames).collect()
    assert {tuple(r) for r in got} == {("p9x", "y95"), ("p9x", "y96"), ("base", "y95"), ("mean", "y96")}
