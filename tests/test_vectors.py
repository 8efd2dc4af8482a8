"""Sampled bands against a walk over the paths with the same draws, and draws against their distributions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from masschain.operators import heights, vectors

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", vectors.KINDS)
def test_draws_keep_mean_and_spread(kind):
    v = vectors.draws("e", kind, 0.3, 0.2, 0.4, 40_000)
    assert v.mean() == pytest.approx(0.3, rel=5e-3) and (v >= 0).all() and 0.035 < v.std() < 0.065
    assert (v == vectors.draws("e", kind, 0.3, 0.2, 0.4, 40_000)).all() and (v != vectors.draws("f", kind, 0.3, 0.2, 0.4, 40_000)).any()
    if kind in ("normal", "lognormal", "weibull", "gamma"):
        assert v.std() == pytest.approx(0.2 / np.sqrt(12), rel=0.05)
    for best, lo, hi, value in ((0.3, 0.3, 0.3, 0.3), (0.3, None, None, 0.3), (None, 0.1, 0.2, 0.0), (-1.0, None, 1.0, 0.0)):
        assert (vectors.draws("e", kind, best, lo, hi, 5) == value).all()
    assert np.isfinite(vectors.draws("e", kind, 0.0, -0.1, 0.1, 50)).all()


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_bands_as_a_walk_gives(spark, most):
    rng = random.Random(3)
    edge = lambda name: (name, rng.choice(vectors.KINDS), *(lambda b: (b, b * 0.8, b * 1.3))(rng.random()))
    rows, sizes = [], {"a_1": 3, "a_2": 2, "b_1": 1}
    for c in sizes:
        for i in range(12):
            top = edge(f"{c}{i // 4}")
            for key in ("Cu", "Al") if c != "b_1" else ("Cu",):
                rows.append((c, key, *top, *edge(f"m{c}{i}"), *edge(f"e{c}{i}{key}")))
    rows += [rows[0], ("a_1", "Zn", "x", None, 1.0, None, None, "y", "beta", 0.5, 0.5, 0.5, "z", "gamma", 0.5, 0.2, None)]
    samples, total = 23, defaultdict(lambda: np.zeros(23))
    for c, key, *e in rows:
        total[c, key] += np.prod([vectors.draws(*e[i : i + 5], samples, 9) for i in (0, 5, 10)], axis=0) / sizes[c]
    for parent, children in (("a", ("a_1", "a_2")), ("top", ("a", "b_1"))):
        for key in ("Cu", "Al", "Zn"):
            have = [total[c, key] for c in children if (c, key) in total]
            total[parent, key] = np.mean(have, axis=0)
    types = ", ".join(f"{e}_{c} {'string' if c in ('name', 'kind') else 'double'}" for e in ("above", "between", "below") for c in ("name", "kind", "best", "lo", "hi"))
    paths = spark.createDataFrame(rows, f"class string, key string, {types}")
    leaves = vectors.slice_vectors(paths, spark.createDataFrame(list(sizes.items()), "class string, n long"), samples, 9, most, 5)
    edges = spark.createDataFrame([("a", "a_1"), ("a", "a_2"), ("top", "a"), ("top", "b_1")], "parent string, child string")
    got = {(r["class"], r["key"]): r for r in vectors.bands(vectors.class_vectors(leaves, edges), (0.05, 0.5, 0.95)).collect()}
    assert got.keys() == total.keys() and len(got) == 12
    for k, v in total.items():
        assert got[k]["n_samples"] == samples and got[k]["mean"] == pytest.approx(v.mean())
        assert got[k]["quantiles"] == pytest.approx(list(np.quantile(v, (0.05, 0.5, 0.95)))), k


def test_no_paths(spark):
    paths = vectors.store_paths(spark, DATA).limit(0)
    assert vectors.slice_vectors(paths, spark.createDataFrame([], "class string, n long"), 5).count() == 0


def test_store_bands_hold_the_means_without_draws(spark):
    means = {(r["class"], r["element_class"]): r["amount"] for r in heights.class_ancestor_mean(spark, DATA).collect()}
    got = vectors.mc_band(spark, DATA, 400).collect()
    above = [r for r in got if (r["class"], r["element_class"]) in means]
    assert {"BUILDING"} < {r["class"] for r in above} and all(r["mean"] == pytest.approx(means[r["class"], r["element_class"]], rel=0.05) for r in above)
    assert all(r["p5"] <= r["p50"] <= r["p95"] for r in got)


@pytest.mark.parametrize("kind", ["triangular", "normal", "lognormal", "weibull", "gamma", "beta"])
@pytest.mark.parametrize("width", [0.05, 0.5, 0.9])
def test_draws_follow_numpys_distributions(kind, width):
    n, best, lo, hi = 100_000, 0.3, 0.3 * (1 - width), 0.3 * (1 + width)
    rng, spread = np.random.default_rng(7), 0.3 * width / np.sqrt(3)
    ratio = spread / best
    wide = np.log1p(ratio**2)
    want = {
        "triangular": lambda: rng.triangular(lo, best, hi, n), "normal": lambda: rng.normal(best, spread, n), "lognormal": lambda: rng.lognormal(np.log(best) - wide / 2, np.sqrt(wide), n),
        "weibull": lambda: rng.weibull(ratio**-1.086, n) * best / vectors.math.gamma(1 + ratio**1.086), "gamma": lambda: rng.gamma(ratio**-2, best * ratio**2, n), "beta": lambda: lo + (hi - lo) * rng.beta(2, 2, n),
    }[kind]()
    got, want = np.sort(vectors.draws("e", kind, best, lo, hi, n)), np.sort(np.maximum(want, 0))
    at = np.concatenate([got, want])
    apart = np.abs(np.searchsorted(got, at, "right") - np.searchsorted(want, at, "right")).max() / n
    assert apart < 1.95 * np.sqrt(2 / n)


def test_draws_do_not_make_generators(monkeypatch):
    """A generator for each edge cost more time than the draws of an evenly spread one."""
    monkeypatch.setattr(np.random, "Generator", None)
    monkeypatch.setattr(np.random, "Philox", None)
    one, other = (vectors.draws("a", k, 0.3, 0.2, 0.4, 1000) for k in ("uniform", "beta"))
    assert (one == vectors.draws("a", "uniform", 0.3, 0.2, 0.4, 1000)).all() and (one != other).any()
    pairs = [vectors.draws(f"e{i}", "normal", 0.3, 0.2, 0.4, 1000) for i in range(40)]
    assert np.abs(np.corrcoef(pairs) - np.eye(40)).max() < 0.16


def test_draws_of_most_kinds_are_made_of_integers_at_once(monkeypatch):
    """One call of a distribution's routine a value took a third more time; 7 digits are kept, and edges without spread are exact."""
    monkeypatch.setattr(vectors, "_RNG", None)
    for kind in ("uniform", "rectangular", "triangular", "normal", "lognormal", "weibull", "beta"):
        for n in (1, 2, 7, 1000):
            v = vectors.draws("e", kind, 0.3, 0.2, 0.4, n)
            assert v.dtype == np.float32 and v.shape == (n,) and np.isfinite(v).all() and (v >= 0).all() and len(set(v.tolist())) == n
        assert vectors.draws("e", kind, 0.1, 0.1, 0.1, 3).tolist() == [0.1] * 3 and (vectors.draws("e", kind, 0.1, 0.0, 0.2, 1000) >= 0).all()
    halves = vectors.draws("e", "normal", 0.3, 0.2, 0.4, 10_000).reshape(2, -1)
    assert abs(np.corrcoef(halves)[0, 1]) < 0.06
