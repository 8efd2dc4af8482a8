"""Plans of unknown content over statements at several depths, against plain Python."""

import random

import pytest

from masschain.operators import fixpoint, unknowns

NODES = "node string, cls string, rank int"
STATED = "id string, whole string, part string, fraction double"


def expected(nodes, stated):
    rank = {n: r for n, _, r in nodes}
    stated = [s for s in dict.fromkeys(stated) if s[1] != s[2]]
    fine = [s for s in stated if rank[s[2]] - rank[s[1]] in (0, 1)]
    paths = {}

    def walk(root, at, met, fraction, levels):
        for _, w, p, f in fine:
            if w == at and p not in met:
                paths.setdefault((root, p), []).append((fraction * f, [*levels, rank[p]]))
                walk(root, p, [*met, p], fraction * f, [*levels, rank[p]])

    for n in rank:
        walk(n, n, [n], 1.0, [])
    parts = {s[2] for s in fine}
    tops = {n: {t for t in rank if t not in parts and ((t, n) in paths or t == n)} for n in rank}
    by_top = {}
    for _, w, p, f in stated:
        if rank[p] - rank[w] >= 2:
            for t in tops[w]:
                by_top.setdefault((t, p), []).append((-rank[w], w, f * (1.0 if w == t else max(x[0] for x in paths[t, w]))))
    out = set()
    for (t, p), found in by_top.items():
        before = sum(x[0] for x in paths.get((t, p), []))
        for r, w, projection in sorted(found):
            if projection - before > 1e-12:
                deepest = max((x[1] for x in paths.get((w, p), [])), key=lambda v: (len(v), v), default=None)
                levels = deepest[:-1] if deepest else range(rank[w] + 1, rank[p])
                out.add((t, p, w, -r, round(projection - before, 9), tuple(fixpoint.LEVELS[x] for x in levels)))
            before = projection
    return out


def found(spark, nodes, stated):
    rows = unknowns.plans(spark.createDataFrame(nodes, NODES), spark.createDataFrame(stated, STATED)).collect()
    return {(r["top"], r["part"], r["whole"], r["rank"], round(r["amount"], 9), tuple(r["fillers"])) for r in rows}


CHAIN = [("p", "P", 0), ("q", "P", 0), ("c", "C", 1), ("d", "C", 1), ("m", "M", 2), ("e", "E", 3), ("g", "E", 3)]


def test_three_bounders_of_one_part(spark):
    stated = [("1", "p", "c", 0.5), ("2", "c", "m", 0.5), ("3", "m", "e", 0.2), ("4", "c", "d", 0.4), ("5", "p", "e", 0.3), ("6", "c", "e", 0.2), ("7", "d", "e", 0.9), ("8", "p", "g", 0.1), ("8", "p", "g", 0.1), ("9", "q", "e", 0.7), ("10", "p", "m", 0.2)]
    rows = found(spark, CHAIN, stated)
    assert rows == expected(CHAIN, stated)
    # known 0.05; c projects to 0.1, d to 0.18, the product states 0.3
    assert {(r[2], r[4]) for r in rows if r[:2] == ("p", "e")} == {("c", 0.05), ("d", 0.08), ("p", 0.12)}
    assert ("q", "e", "q", 0, 0.7, ("Component", "Material")) in rows and not any(r[1] == "m" for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_plans(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i:02}", "k", min(i // 3, 3)) for i in range(14)]
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(30)})
    stated = [(f"s{i}", f"n{a:02}", f"n{b:02}", round(rng.uniform(0.05, 1), 3)) for i, (a, b) in enumerate(pairs)]
    assert found(spark, nodes, stated) == expected(nodes, stated)


def test_no_statements(spark):
    assert found(spark, CHAIN, []) == set()
