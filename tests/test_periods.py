"""Periods of one composition against a walk over the years in plain Python."""

import random

import pytest

from masschain.operators import periods

FACTS = "product string, year int, key string, v array<double>, quality int, meta string"


def walked(facts, tolerance=1e-9):
    prints, years = {}, {}
    for product, year, key, v, quality, meta in facts:
        if product is not None and year is not None:
            prints.setdefault((product, year), {})[key] = (v, quality, meta)
            years.setdefault(product, set()).add(year)

    def agree(a, b):
        near = lambda x, y: x == y or None not in (x, y) and abs(x - y) <= tolerance * max(1, abs(x), abs(y))
        return a.keys() == b.keys() and all(
            len(a[k][0]) == len(b[k][0]) and all(map(near, a[k][0], b[k][0])) and a[k][1:] == b[k][1:] for k in a)

    out = set()
    for product, all_years in years.items():
        left = sorted(all_years)
        while left:
            first = last = left.pop(0)
            while left and left[0] == last + 1 and agree(prints[product, first], prints[product, left[0]]):
                last = left.pop(0)
            out.add((product, first, last))
    return out


def found(spark, facts):
    rows = periods.runs(spark.createDataFrame(facts, FACTS)).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_equal_years_collapse_and_others_stay_apart(spark):
    base = lambda y, v=1.0, q=2, m="kg": ("car", y, "steel", [v, 0.5], q, m)
    cases = [
        [base(2000), base(2001), base(2002)],
        [base(2000), base(2001, 1 + 1e-6), base(2002, 1 + 1e-6)],  # values that differ by more than the tolerance
        [base(2000), base(2001, 1 + 1e-12)],
        [base(2000), base(2002)],  # a gap
        [base(2000), base(2001, q=3), base(2002, q=3)],
        [base(2000), base(2001, m="g")],
        [base(2000), base(2001), ("car", 2001, "zinc", [0.1], 1, None), base(2002), ("car", 2002, "zinc", [0.1], 1, None)],  # a key more
        [base(2000 + i, 1 + i * 0.6e-9) for i in range(6)],  # drift: each is like its neighbour, not like the first
        [base(2000, 5e6), base(2001, 5e6 + 1e-4)],  # relative above 1
        [("car", 2000, "steel", [None], None, None), ("car", 2001, "steel", [None], None, None), ("car", 2002, "steel", [0.0], None, None), (None, 2000, "x", [1.0], 1, "m"), ("van", None, "x", [1.0], 1, "m")],
        [base(2000), ("car", 2001, "steel", [1.0], 2, "kg")],  # fewer values
    ]
    expected = [{("car", 2000, 2002)}, {("car", 2000, 2000), ("car", 2001, 2002)}, {("car", 2000, 2001)}, {("car", 2000, 2000), ("car", 2002, 2002)}]
    for i, facts in enumerate(cases):
        got = found(spark, facts)
        assert got == walked(facts), i
        assert i >= len(expected) or got == expected[i]
    assert walked(cases[7]) == {("car", 2000, 2001), ("car", 2002, 2003), ("car", 2004, 2005)}


def test_random_compositions(spark):
    rng = random.Random(3)
    facts = []
    for p in range(30):
        for y in range(1990, 2010):
            if rng.random() < 0.9:
                for k in range(3):
                    if rng.random() < 0.97:
                        facts.append((f"p{p}", y, f"k{k}", [float(rng.random() < 0.05)], 1 + (rng.random() < 0.02), "m"))
    got = found(spark, facts)
    assert got == walked(facts) and any(b - a > 2 for _, a, b in got)
    assert periods.runs(spark.createDataFrame([], FACTS)).count() == 0


@pytest.mark.parametrize("change", [("car", 2001, "steel", [1.0 + 1e-6], 2, "kg"), ("car", 2001, "steel", [1.0], 3, "kg"), ("car", 2001, "iron", [1.0], 2, "kg"), ("car", 2001, "steel", [1.0], 2, None)])
def test_fingerprints_tell_compositions_apart(spark, change):
    facts = [("car", 2000, "steel", [1.0], 2, "kg"), ("car", 2000, "zinc", [0.5], 1, "kg"), ("van", 2000, "zinc", [0.5], 1, "kg"), ("van", 2000, "steel", [1.0], 2, "kg"), change, ("car", 2001, "zinc", [0.5], 1, "kg")]
    got = {(r["product"], r["year"]): (r["n"], r["fingerprint"]) for r in periods.fingerprints(spark.createDataFrame(facts, FACTS)).collect()}
    assert got["car", 2000] == got["van", 2000] != got["car", 2001] and got["car", 2000][0] == 2
