"""Rules that feed each other, over statements that skip levels, against plain Python."""

import itertools
import random

import pytest

from masschain.operators import fixpoint

NODES = "node string, cls string, rank int"
STATED = "id string, whole string, part string, fraction double"
TAXONOMY = "child string, parent string"
LEVELS = fixpoint.LEVELS


def expected(nodes, stated, taxonomy):
    node = {n: (c, r) for n, c, r in nodes if r is not None}
    stated = [s for s in dict.fromkeys(stated) if s[0] is not None and s[1] in node and s[2] in node and s[1] != s[2]]
    gap = lambda s: node[s[2]][1] - node[s[1]][1]
    out, edges = set(), []
    for s in stated:
        if gap(s) < 2:
            continue
        between = [f"{s[0]}-unknown{LEVELS[r]}" for r in range(node[s[1]][1] + 1, node[s[2]][1])]
        for r, n in zip(range(node[s[1]][1] + 1, node[s[2]][1]), between):
            node[n] = (f"unknown{LEVELS[r]}", r)
        chain = [s[1], *between, s[2]]
        out |= {("fillers", a, b, s[0], None, None) for a, b in itertools.pairwise(chain)}
        edges += [(f"{s[0]}-{b}", a, b, None, True, a == s[1]) for a, b in itertools.pairwise(chain)]
    above = {}
    for child, parent in taxonomy:
        above.setdefault(child, set()).add(parent)

    def up(c):
        seen, todo = {c}, [c]
        while todo:
            todo = [p for x in todo for p in above.get(x, ()) if p not in seen]
            seen |= set(todo)
        return seen

    fine = [(s[0], s[1], s[2], s[3], False, True) for s in stated if gap(s) in (0, 1)]
    steps = set()
    for e in [(*s, False, True) for s in stated] + edges:
        if node[e[2]][1] - node[e[1]][1] == 1:
            steps |= set(itertools.product(up(node[e[1]][0]), up(node[e[2]][0])))
    out |= {("lift", w, p, None, None, None) for w, p in steps}
    reach = set(steps)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in steps if b == c}
        if more == reach:
            break
        reach = more
    out |= {("class_reach", w, p, None, None, None) for w, p in reach}
    sums = {}

    def walk(root, at, met, fraction, filled):
        for e in fine + edges:
            if e[1] != at or e[0] in met or (not met and not e[5]):
                continue
            f = None if fraction is None or e[3] is None else fraction * e[3]
            out.add(("propagate", root, e[2], "|".join([*met, e[0]]), None if f is None else round(f, 9), None))
            if not filled and not e[4]:
                sums[root, e[2]] = sums.get((root, e[2]), 0.0) + (f or 0.0)
            walk(root, e[2], [*met, e[0]], f, filled or e[4])

    for n in list(node):
        walk(n, n, [], 1.0, False)
    totals = {}
    for s in stated:
        if gap(s) >= 2:
            beyond = (s[3] or 0.0) - sums.get((s[1], s[2]), 0.0)
            out.add(("reconcile", s[1], s[2], s[0], round(beyond, 9) if beyond > 1e-9 else 0.0, beyond >= -1e-9))
        if abs(gap(s)) <= 1:
            totals[s[1]] = totals.get(s[1], 0.0) + (s[3] or 0.0)
    return out | {("conservation", w, None, None, round(t, 9), False) for w, t in totals.items() if t > 1 + 1e-9}


def found(spark, nodes, stated, taxonomy):
    rows = fixpoint.materialized(spark.createDataFrame(nodes, NODES), spark.createDataFrame(stated, STATED), spark.createDataFrame(taxonomy, TAXONOMY)).collect()
    out = [(r[0], r[1], r[2], r[3], None if r[4] is None else round(r[4], 9), r[5]) for r in rows]
    assert len(out) == len(set(out))
    return set(out)


PLANTED = (
    [("p", "Phone", 0), ("c", "Board", 1), ("c2", "Chip", 1), ("m", "Alloy", 2), ("e", "Cu", 3), ("e2", "unknownish", 3), ("lost", "X", None)],
    [("s1", "p", "c", 0.5), ("s2", "c", "c2", 0.5), ("s3", "c2", "m", 0.4), ("s4", "m", "e", 0.9), ("s5", "p", "e", 0.2), ("s6", "c", "e", 0.1), ("s7", "p", "m", 0.05),
     ("s8", "m", "e2", 0.2), ("s9", "c2", "c", 0.1), ("s10", "p", "lost", 0.3), ("s11", "m", "m", 0.3), ("s12", "p", "c", None), (None, "p", "c2", 0.1), ("s5", "p", "e", 0.2), ("s13", "p", "e2", None)],
    [("Phone", "Product"), ("Board", "Part"), ("Part", "Component"), ("Component", "Part"), ("Alloy", "Material")],
)


def test_planted_rules(spark):
    rows = found(spark, *PLANTED)
    assert rows == expected(*PLANTED)
    # fillers reach the lift, both reach propagation, and propagation reaches reconciliation
    assert ("lift", "Phone", "unknownComponent", None, None, None) in rows and ("class_reach", "Product", "Cu", None, None, None) in rows
    assert any(r[0] == "propagate" and r[1:3] == ("p", "s5-unknownMaterial") for r in rows)
    assert {r[2]: r[5] for r in rows if r[0] == "reconcile" and r[1] == "p"} == {"e": True, "m": False, "e2": False}


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i}", f"k{rng.randrange(6)}", rng.randrange(4)) for i in range(12)]
    stated = [(f"s{i}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", round(rng.random(), 3)) for i in range(16)]
    taxonomy = [(f"k{rng.randrange(6)}", f"k{rng.randrange(6)}") for _ in range(5)]
    assert found(spark, nodes, stated, taxonomy) == expected(nodes, stated, taxonomy)


def test_no_rows(spark):
    assert found(spark, [], [], []) == set()


def test_groups_in_a_row_have_the_rules_of_joins(spark):
    """Small groups that step down, one that stays in its rank and a large one, each with nodes of its own."""
    rng = random.Random(11)
    nodes, stated, groups = [], [], {}
    for g in range(9):
        own = [(f"g{g}n{i}", f"k{rng.randrange(6)}", i % 4) for i in range(26 if g == 8 else 8)]
        nodes += own
        down = [(a, b) for a in own for b in own if a[2] < b[2] or (g == 7 and a[2] == b[2] and a[0] < b[0])]
        for a, b in down if g == 8 else rng.sample(down, 9):
            stated.append((f"s{len(stated)}", a[0], b[0], rng.choice([None, round(rng.random(), 3)])))
            groups[stated[-1][0]] = g
    taxonomy = [(f"k{rng.randrange(6)}", f"k{rng.randrange(6)}") for _ in range(5)]
    assert sum(g == 8 for g in groups.values()) > 64
    within = spark.createDataFrame(list(groups.items()), "id string, at long")
    met = fixpoint.ranked(spark.createDataFrame(nodes, NODES), spark.createDataFrame(stated, STATED)).join(within, "id")
    rows = fixpoint.materialized_ranked(met, spark.createDataFrame(taxonomy, TAXONOMY), within="at").collect()
    out = [(r[0], r[1], r[2], r[3], None if r[4] is None else round(r[4], 9), r[5]) for r in rows]
    assert len(out) == len(set(out)) and set(out) == expected(nodes, stated, taxonomy)


def test_line_items_are_dealt_once_for_all_rules(spark):
    from masschain.plans import registry

    plan = registry.QUERIES["materialize_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ord") == 2 and "Exchange hashpartitioning(whole" not in plan


def test_orders_of_larger_files_are_dealt_once_and_written_as_rows(spark, monkeypatch):
    """What deals line items a second time for kinds and for large orders doubles the disk that the rules need."""
    from pyspark.sql import functions as F

    data = "/root/testdata/sf0.001"
    plain = fixpoint.materialize_rules(spark, data)
    monkeypatch.setattr(fixpoint, "PACKED_BYTES", 0)
    monkeypatch.setattr(fixpoint, "AT_ONCE", 100)
    monkeypatch.setattr(fixpoint, "_PACKED", fixpoint._PACKED.replace("<= 64", "<= 20").replace("> 64", "> 20"))  # some orders go by joins
    packed = fixpoint.materialize_rules(spark, data)
    assert "Exchange hashpartitioning(ord" not in packed._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in packed.select("rule").distinct().collect()} == {"fillers", "propagate", "reconcile", "lift", "class_reach"}
    rows = lambda df: df.withColumn("value", F.round("value", 8))
    assert plain.count() == packed.count() and rows(plain).exceptAll(rows(packed)).isEmpty()
