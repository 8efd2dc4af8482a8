"""Canonical make-ups: split by context, mean over measured materials, inheritance from the nearest ancestor."""

import random

import pytest

from masschain.operators import materials

SEEN = "node string, cls string, context string, element string, fraction double"
TAXONOMY = "child string, parent string"


def expected(seen, taxonomy):
    nodes, makeup, contexts = {}, {}, {}
    for node, cls, context, element, fraction in seen:
        if node is None or cls is None:
            continue
        nodes[node] = (cls, context)
        makeup.setdefault(node, {})
        if element is not None:
            makeup[node][element] = makeup[node].get(element, 0.0) + (fraction or 0.0)
        if context is not None:
            contexts.setdefault(cls, set()).add(context)
    mean = lambda group: {e: sum(makeup[n].get(e, 0.0) for n in group) / len(group) for n in group for e in makeup[n]}
    groups = {}
    for node, (cls, context) in nodes.items():
        split = len(contexts.get(cls, ())) > 1
        groups.setdefault((f"{cls}_in_{cls if context is None else context}" if split else cls, cls), []).append(node)
    levels = {}
    for cls in {c for c, _ in nodes.values()}:
        levels[cls], seen_, depth, now = {cls: 0}, {cls}, 0, {cls}
        while now:
            depth += 1
            now = {p for c, p in taxonomy if c in now and p not in seen_}
            seen_ |= now
            levels[cls] |= dict.fromkeys(now, depth)
    out = set()
    for (target, cls), group in groups.items():
        measured, donor = [n for n in group if makeup[n]], target
        for _, above in sorted((d, a) for a, d in levels[cls].items()):
            if not measured:
                measured, donor = [n for n, (c, _) in nodes.items() if above in levels[c] and makeup[n]], above
        if not measured:
            out.add((target, cls, len(group), None, None, None, None, None))
        for element, share in mean(measured).items() if measured else ():
            out.add((target, cls, len(group), donor, element, round(share, 9), round(max(0.0, share - 0.005), 9), round(min(1.0, share + 0.005), 9)))
    return out


def found(spark, seen, taxonomy):
    rows = materials.canonical(spark.createDataFrame(seen, SEEN), spark.createDataFrame(taxonomy, TAXONOMY)).select("target", "cls", "n_nodes", "donor", "element", "share", "lo", "hi").collect()
    assert len(rows) == len(set(rows))
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows}


SPLIT = [
    ("m1", "Steel", "Hull", "Fe", 0.9), ("m1", "Steel", "Hull", "C", 0.1), ("m2", "Steel", "Hull", "Fe", 1.0), ("m3", "Steel", "Bolt", None, None), ("m4", "Steel", None, "Fe", 0.5),
    ("m5", "Brass", "Bolt", "Cu", 0.6), ("m6", "Brass", None, "Cu", 0.8), ("m7", "Inox", "Hull", None, None), ("m8", "Ghost", "Hull", None, None), ("m9", "Foil", "Hull", "Al", 1.0), ("m9", "Foil", "Hull", "Zn", None),
    (None, "Steel", "Deck", "Fe", 0.1), ("m0", None, "Hull", "Fe", 0.2),
]
UP = [("Inox", "Steel"), ("Steel", "Metal"), ("Metal", "Top"), ("Top", "Metal"), ("Ghost", "Nowhere"), ("Foil", "Metal")]


def test_split_and_inheritance(spark):
    rows = found(spark, SPLIT, UP)
    assert rows == expected(SPLIT, UP)
    assert {(r[0], r[3], r[4], r[5]) for r in rows if r[1] == "Steel"} == {("Steel_in_Hull", "Steel_in_Hull", "Fe", 0.95), ("Steel_in_Hull", "Steel_in_Hull", "C", 0.05), ("Steel_in_Steel", "Steel_in_Steel", "Fe", 0.5), ("Steel_in_Bolt", "Steel", "Fe", 0.8), ("Steel_in_Bolt", "Steel", "C", round(0.1 / 3, 9))}
    assert ("Brass", "Brass", 2, "Brass", "Cu", 0.7, 0.695, 0.705) in rows and {r[3] for r in rows if r[0] == "Inox"} == {"Steel"}


def test_every_material_is_restated(spark):
    rows = materials.restated(spark.createDataFrame(SPLIT, SEEN), spark.createDataFrame(UP, TAXONOMY)).collect()
    assert {r["node"] for r in rows} == {f"m{i}" for i in range(1, 10)}
    assert {(r["target"], r["element"]) for r in rows if r["node"] == "m3"} == {("Steel_in_Bolt", "Fe"), ("Steel_in_Bolt", "C")}


@pytest.mark.parametrize("seed", range(2))
def test_random_materials(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i}", f"k{rng.randrange(5)}", rng.choice([None, "x", "y"])) for i in range(14)]
    seen = [(*n, None, None) if rng.random() < 0.5 else (*n, rng.choice("abc"), round(rng.random(), 2)) for n in nodes for _ in range(2)]
    up = [(f"k{rng.randrange(5)}", f"k{rng.randrange(8)}") for _ in range(6)]
    up = [e for e in up if e[0] != e[1]]
    assert found(spark, seen, up) == expected(seen, up)


def test_no_materials(spark):
    assert found(spark, [], UP) == set() and found(spark, [], []) == set()
