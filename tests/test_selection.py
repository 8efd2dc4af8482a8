"""Exact quantiles by narrowing histograms, and phrases of any length, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from masschain.operators import phrases, selection


@pytest.mark.parametrize("bins", [8, 64])
def test_quantiles_of_many_shapes(spark, bins):
    rng = random.Random(7)
    keys = {
        "one": [5.0], "two": [1.0, 2.0], "equal": [3.5] * 50, "spread": [rng.gauss(0, 1) for _ in range(501)], None: [float(i % 7) for i in range(100)],
        "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(60)] + [-1.7e308, 1.7e308], "near": [1.0 + i * 2**-52 for i in range(9)], "mostly": [0.0] * 400 + [rng.random() for _ in range(20)],
    }
    rows = [(k, v) for k, vs in keys.items() for v in vs] + [("one", None), ("two", math.nan), ("equal", math.inf), ("none", None), ("none", -math.inf)]
    probabilities = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r["key"]: r["quantiles"] for r in selection.quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", probabilities, bins).collect()}
    assert got.keys() == keys.keys()
    for k, vs in keys.items():
        ranked = sorted(vs)
        for p, q in zip(probabilities, got[k]):
            at = (len(vs) - 1) * p
            low, high = ranked[math.floor(at)], ranked[min(math.floor(at) + 1, len(vs) - 1)]
            assert q == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12), (k, p)
    assert np.percentile(keys["spread"], 95) == pytest.approx(got["spread"][3])


def test_quantiles_of_nothing(spark):
    assert selection.quantiles(spark.createDataFrame([], "k string, v double"), "k", "v", (0.5,)).count() == 0


def test_phrases_of_any_length_with_lists(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = [(1, f"Intro. {passage.upper()}; the end"), (2, " ".join(passage.split()[:29]) + " other"), (3, "tin-can TIN can tin"), (3, "copper"), (4, None), (5, "..."), (None, "a copper a copper a"),
            (6, "copper LICENSE"), (7, "coppers co pper copper_x"), (8, f"{passage} {passage}")]
    terms = [("banned", passage), ("class", "copper"), ("label", "tin can tin"), ("label", "Tin Can"), ("label", "a copper a"), ("domain", "license"), ("class", "tin"), ("class", ""), ("class", "??"), ("other", "copper")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    words = lambda t: [w for w in re.split(phrases.SPLIT, (t or "").lower()) if w]
    want = Counter()
    for i, text in docs:
        w = words(text)
        for kind, term in {(k, " ".join(words(t))) for k, t in terms if words(t)}:
            n = len(term.split())
            want[i, kind, term] += sum(w[j : j + n] == term.split() for j in range(len(w)))
    free = {(6, "domain"), (None, "other")}
    want = {k: v for k, v in want.items() if v and k[2] != "tin" and (k[0], k[1]) not in free}
    args = frame(docs, "doc_id long, text string"), frame(terms, "kind string, term string"), frame([("TIN",)], "term string"), frame(list(free), "doc_id long, kind string")
    got = {(r["doc_id"], r["kind"], r["term"]): r["n"] for r in phrases.found(*args).collect()}
    assert got == want and got[1, "banned", passage] == 1 and got[8, "banned", passage] == 2 and got[None, "label", "a copper a"] == 2
    assert not any(i == 2 for i, *_ in got)
    assert phrases.found(args[0].limit(0), args[1]).count() == 0 and phrases.found(args[0], args[1].limit(0)).count() == 0
