"""Numbers of answers against all single results, sums and pairs in plain Python."""

import math
import random
from collections import defaultdict

import pytest

from masschain.operators import grounding

SCHEMA = "case string, message long, value double"


def brute(asked, results, rtol):
    pool, sums = defaultdict(set), defaultdict(lambda: defaultdict(float))
    for case, message, v in results:
        if v and math.isfinite(v):
            pool[case].add(abs(v))
            sums[case][message] += abs(v)
    out = []
    for row in asked:
        case, _, x = row
        if not x or not pool[case]:
            continue
        x = abs(x)
        by_sum = list(sums[case].values())
        candidates = [*pool[case], *by_sum, sum(by_sum), *(a * b for a in pool[case] for b in pool[case])]
        if not any(abs(x - c) <= rtol * max(x, c) for c in candidates if math.isfinite(x)):
            out.append(row)
    return sorted(out, key=str)


@pytest.mark.parametrize("rtol", [2e-3, 1e-6, 0.1])
def test_as_all_pairs_say(spark, rtol):
    rng = random.Random(5)
    results, asked = [], []
    for case in ("a", "b", None, "dense"):
        values = [10 ** rng.uniform(-6, 6) * rng.choice((1, -1)) for _ in range(25)] if case != "dense" else [1 + rng.random() * 3 * rtol for _ in range(200)]
        results += [(case, rng.randrange(4) or None, v) for v in values]
        for _ in range(60):  # at the edges of what agrees, on both sides
            a, b = rng.choice(values), rng.choice(values)
            edge = 1 + rng.choice((-1, 1)) * rtol * rng.choice((0, 0.5, 0.999, 1.001, 1.5, 3))
            asked += [(case, 0, abs(a * b) * edge), (case, 0, -abs(a) * edge), (case, 0, 10 ** rng.uniform(-12, 12))]
        by = defaultdict(float)
        for c, m, v in results:
            if c == case:
                by[m] += abs(v)
        asked += [(case, 0, s * 1.0000001) for s in by.values()] + [(case, 0, sum(by.values()))]
    results += [("a", 1, v) for v in (None, 0.0, math.inf, math.nan)] + [("zero", 1, 0.0)]
    asked += [("a", 0, v) for v in (None, 0.0, -0.0, math.inf, 7.7e300, 7.7e300, 5e-324)] + [("zero", 0, 4.0), ("none", 0, 4.0)]
    got = grounding.ungrounded(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(results, SCHEMA), rtol)
    want = brute(asked, results, rtol)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert 20 < len(want) < len(asked) - 100 and want.count(("a", 0, 7.7e300)) == 2


def test_planted_product_and_stranger(spark):
    results = [("q", 1, 0.0371), ("q", 2, 1843.0)] + [("q", 3, 100000.0 + 7 * i) for i in range(300)]
    asked = [("q", 0, 0.0371 * 1843.0), ("q", 0, 0.0371 + 1843.0 * 3)]
    got = grounding.ungrounded(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(results, SCHEMA)).collect()
    assert [r["value"] for r in got] == [asked[1][2]]


def test_nothing_asked_or_found(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, 2.0)], SCHEMA)
    assert grounding.ungrounded(empty, some).count() == 0 and grounding.ungrounded(some, empty).count() == 0
    with pytest.raises(ValueError):
        grounding.ungrounded(some, some, 0.7)
