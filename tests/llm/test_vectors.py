"""Ops 11 to 13 against plain Python: codes and trie, exact polynomials and whitening, compressed languages."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from masschain.llm import lang_id, queries, vector_codes, whitening
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def usable(rows, scale):
    kept = [(r["vec_id"], r["label"], r["embedding"]) for r in rows if r["embedding"] is not None]
    return [(i, lab, [math.floor(scale * c) for c in v]) for i, lab, v in kept if all(c is not None and math.isfinite(c) for c in v)]


# --- op 13 ----------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    kept = sorted(usable(rows, scale), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for *_, x in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(v) // len(members[k]) for v in zip(*members[k])) if members[k] else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for (i, lab, _), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[lab] += error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), error))
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted((str(i), code, error, by_label[lab], sha) for i, lab, code, error in out)


def as_rows(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def faulty(spark, n=150, d=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(0, 0.02, d)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(7, rows[0][1], None)] * 40 + [(None, rows[5][1], 1), (500, None, 1), (501, [1.0] * (d - 1) + [None], 1), (502, [math.nan] + [0.0] * (d - 1), 2)]
    rows += [(503, [math.inf] * d, 2), (504, [1e30] * d, 2), (505, [0.5] * (d + 1), 0), (506, [-3000.25] * d, None), (507, [], 1)]
    return spark.createDataFrame(rows, VECTORS)


def test_codes_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    assert as_rows(queries.QUERIES["op13_vector_codes"](spark, SMALL)) == plain_codes(rows, 16, 64, 2, 256)


@pytest.mark.parametrize("leaves", [1, 8, 4096])
def test_codes_with_faulty_rows_ties_and_repeats(spark, leaves, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    df = faulty(spark)
    good = [r for r in df.collect() if r["vec_id"] not in (504, 505, 507)]
    got = vector_codes.compress(df.withColumn("code", F.lit("x")).withColumn("x", F.lit(1)).withColumn("key", F.lit(2)), 4, 16, 2)
    assert as_rows(got) == plain_codes(good, 4, 16, 2, 256)


def test_trie_walk_takes_the_nearest_entry_and_the_lower_of_equal_ones():
    rng = np.random.default_rng(0)
    for spread, width in ((2, 3), (50, 2), (1 << 40, 3)):
        parts = rng.integers(-spread, spread, (3000, width))
        entries = rng.integers(-spread, spread, (20, width))
        entries[7] = entries[3]
        if spread > 1000:
            parts, entries = parts.astype(object), entries.astype(object)
        leaves, place, weight = vector_codes.distinct_parts(parts)
        assert weight.sum() == 3000 and (leaves[place] == parts).all()
        for most in (1, 50, 4096):
            vector_codes.LEAVES, before = most, vector_codes.LEAVES
            code, distance = vector_codes.nearest(leaves, entries)
            vector_codes.LEAVES = before
            all_ = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
            assert (code == np.argmin(all_, axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_codes_of_empty_tables_and_lengths_that_cannot_be_cut(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 10, 1)], VECTORS))


def test_label_errors_when_labels_are_hot_and_cold(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_HOT", 4)
    rows = [(i, None if i % 3 == 0 else 0 if i % 3 == 1 else i, "00", i) for i in range(300)]
    got = vector_codes.with_label_error(spark.createDataFrame(rows, "vec_id bigint, label bigint, code string, error bigint")).collect()
    sums = defaultdict(int)
    for _, lab, _, e in rows:
        sums[lab] += e
    assert len(got) == 300 and all(r["label_error"] == sums[r["label"]] for r in got)


# --- op 12 ----------------------------------------------------------------------


def exact_polynomial(m):
    """Faddeev and LeVerrier over integers."""
    d = len(m)
    a, one = np.array(m, object), np.eye(d, dtype=int).astype(object)
    c, b = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        b = a.dot(b) + c[-1] * one
        c.append(-sum(a.dot(b)[i, i] for i in range(d)) // k)
    return c


def scatter_of(x):
    n, s = len(x), x.sum(axis=0)
    return [[int(v) for v in row] for row in n * (x.T @ x) - np.outer(s, s)]


def test_characteristic_polynomials_are_exact(spark):
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 7, 12):
        x = rng.integers(-9, 9, (40, d))
        if d == 7:
            x[:, 6], x[:, 5] = x[:, 2], 3
        m = scatter_of(x)
        c = whitening.characteristic_polynomial(spark, m)
        assert c == exact_polynomial(m) and max(map(abs, c)) <= whitening.coefficient_bound(m)
    assert whitening.primes_below(30, 4) == [29, 23, 19, 17]


def test_roots_are_counted_and_sharpened_with_their_multiplicities():
    poly = [1]
    for root in (9, 5, 5, 5, 2, 0, 0):
        poly = [a - root * b for a, b in zip([*poly, 0], [0, *poly])]
    assert [whitening.beyond(poly, a) for a in (0, 1, 2, 4, 5, 9)] == [5, 5, 4, 4, 1, 0]
    assert [(round(r / 2**s, 9), m) for r, s, m in whitening.largest_roots(poly, 9)] == [(9, 1), (5, 3), (2, 1)]
    (r, s, m), (r2, s2, _) = whitening.largest_roots([1, -4, 2], 2)  # 2 +- sqrt 2
    assert m == 1 and abs((Fraction(r, 2**s) - 2) ** 2 - 2) < Fraction(1, 2**150) and abs(r2 / 2**s2 - (2 - 2**0.5)) < 1e-15


def check_whitening(spark, df, x_by_id, d, rank):
    got = whitening.whiten(df).collect()
    u = np.unique(np.array([x for xs in x_by_id.values() for x in xs]), axis=0)
    n, sums = len(u), u.sum(axis=0)
    k = min(16, rank)
    assert len(got) == k * sum(map(len, x_by_id.values())) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-9
    m = np.array(scatter_of(u), float)
    values = np.sort(np.linalg.eigvalsh(m))[::-1]
    cells = defaultdict(list)
    for r in got:
        cells[r["vec_id"], r["component"]].append(r)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    for i, xs in x_by_id.items():
        want = sorted(sum(int(n * v - s) ** 2 for v, s in zip(x, sums)) for x in xs)
        assert sorted(r["deviation"] for r in cells[i, 1]) == want
        for x in xs:  # lengths in the whitened space do not depend on signs or on the choice within equal variances
            if rank <= 16:
                y = (n * np.array(x) - sums) / n
                far = float(y @ np.linalg.pinv(m / n**2, hermitian=True) @ y)
                by_row = sum(cells[i, c][0]["whitened"] ** 2 for c in range(1, k + 1))
                assert len(xs) > 1 or by_row == pytest.approx(far, rel=1e-6, abs=1e-9)


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    x = {i: [np.array(v) + 1_000_000] for i, _, v in usable(rows.collect(), 64)}
    check_whitening(spark, rows, x, 64, 64)
    got = queries.QUERIES["op12_exact_whitening"](spark, SMALL).toPandas().pivot_table(index="vec_id", columns="component", values="whitened")
    u = np.unique(np.array([v[0] for v in x.values()]), axis=0)
    values, vectors = np.linalg.eigh(np.cov((u - u.mean(axis=0)).T, bias=True))
    want = (np.array([x[i][0] for i in got.index]) - u.mean(axis=0)) @ vectors[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    assert np.abs(got.to_numpy() * np.sign((got.to_numpy() * want).sum(axis=0)) - want).max() < 1e-8


def test_whitening_with_faulty_rows_equal_variances_and_low_rank(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-60, 60, (60, 4))
    x = np.hstack([base, base[:, :2], np.full((60, 1), 2000)])  # rank 4 of 7
    corners = [(s * a, s * b, s * c) for s in (1, -1) for a, b, c in ((40, 0, 0), (0, 40, 0), (0, 0, 40))]  # three equal variances
    for table, rank in ((x, 4), (np.array(corners), 3)):
        d = table.shape[1]
        rows = [(i, [v / 64 + 0.001 for v in row], 0) for i, row in enumerate(table.tolist())]
        rows += [rows[0]] * 20 + [(900, None, 0), (901, [math.nan] * d, 0), (902, [None] * d, 0), (903, [1.0] * (d + 2), 0), (904, [1e30] * d, 0)]
        df = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit(1)).withColumn("n", F.lit("n"))
        by_id = {i: [np.array(row) + 1_000_000] * (21 if i == 0 else 1) for i, row in enumerate(table)}
        check_whitening(spark, df, by_id, d, rank)


def test_whitening_of_tables_without_variance_and_of_large_entries(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0)] * 3, VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0)] * 3, VECTORS)).count() == 0
    large = spark.createDataFrame([(i, [2.0**30 * i, 3.0 + i % 2], 0) for i in range(6)], VECTORS)
    got = whitening.whiten(large).collect()
    assert len(got) == 12 and got[0]["identity_error"] < 1e-9 and {r["deviation"] for r in got} == {None}


# --- op 11 ----------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op11_compressed_languages"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    sure = [r for r in held if not r["rejected"]]
    assert len(sure) > 0.9 * len(held) and all(r["lang_accepted"] == r["lang_pred"] for r in sure)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_predictions_do_not_see_labels_and_follow_the_sizes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    train = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "text", "lang")
    pieces = lang_id.training_pieces(train)
    encoders = lang_id.Encoders(pieces)
    got = {r["doc_id"]: r for r in lang_id.identify(docs.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1)), pieces).collect()}
    for r in docs.collect():
        *sizes, plain = encoders.sizes(r["text"])
        best = min(sizes)
        assert got[r["doc_id"]]["lang_pred"] == encoders.languages[sizes.index(best)]
        assert got[r["doc_id"]]["score"] == pytest.approx(min((sorted(sizes)[1] - best) / (plain - best), 1.0) if plain > best else 0.0)


def test_texts_without_letters_long_texts_and_tables_without_labels(spark):
    words = {"aa": "lorem ipsum dolor sit amet consectetur ", "bb": "quick brown fox jumps over lazy dogs "}
    rows = [(i, words[lang] * (1 + i % 3), lang) for i in range(60) for lang in words]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... \n", "bb"), (None, words["aa"], None), (1003, words["bb"] * 60_000, None), (1003, words["bb"], "aa")]
    schema = "doc_id bigint, text string, lang string"
    got = lang_id.languages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert all(by_id[i][0]["lang_pred"] == "und" and by_id[i][0]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[None][0]["lang_pred"] == "aa" and [r["lang_pred"] for r in by_id[1003]] == ["bb", "bb"]
    none = lang_id.languages(spark.createDataFrame([(1, "abc def", None), (2, None, None)], schema)).collect()
    assert [r["lang_pred"] for r in none] == ["und", "und"]
    assert lang_id.languages(spark.createDataFrame([], schema)).count() == 0
    one = lang_id.languages(spark.createDataFrame([(i, "abc def ghi jkl mno pqr", "zz") for i in range(9)], schema)).collect()
    assert {r["lang_pred"] for r in one} == {"zz"}
