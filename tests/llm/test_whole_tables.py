"""Operators over whole given tables against plain Python, and against DuckDB where SQL says what they do."""

import collections
import math
import os
import re
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from masschain.llm import common, feistel, fingerprints, quality_gbt, quality_rules, queries

DATA = "/root/testdata/sf0.001"
SIGN = 1 << 63


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def hash64(*values, seed=42):
    """What xxhash64 gives for texts, longs and (as tuples of one) ints, as an unsigned number."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def signed(h):
    return h - 2 * SIGN if h >= SIGN else h


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def permuted(x, n, seed):
    high = math.ceil(math.sqrt(n))
    low = math.ceil(n / high)
    while True:
        left, right = x // low, x % low
        for k in range(feistel.ROUNDS):
            if k % 2:
                right = (right + signed(hash64(left, seed, (k,))) % low) % low
            else:
                left = (left + signed(hash64(right, seed, (k,))) % high) % high
        x = left * low + right
        if x < n:
            return x


def test_shards_match_plain_python(spark, given):
    rows = [(r["doc_id"], r["text"] or "") for r in given.collect()]
    order = sorted(rows, key=lambda r: (signed(hash64(r[0], signed(hash64(r[1])))), r[0]))
    place = {r: permuted(i, len(rows), 17) for i, r in enumerate(order)}
    found = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in feistel.op3_feistel_shards(spark, DATA).collect()}
    assert found == {r[0]: (len(r[1].encode()) + 1, zlib.crc32(r[1].encode()), "rows", place[r] % 8, place[r] // 8, None) for r in rows}


def sketch_of(text, k=fingerprints.SHINGLE, fraction=fingerprints.FRACTION):
    words = words_of(text)
    hashes = [hash64(*words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [hash64(" ".join(words))] if words else []
    own = {signed(h) for h in hashes}
    return {h for h in own if h < -SIGN + 2 * SIGN // fraction}, min(own, default=None)


def alike(a, b):
    return len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] | b[0] else float(a[1] == b[1])


def contained(a, b):
    smaller = min(len(a[0]), len(b[0]))
    return len(a[0] & b[0]) / smaller if smaller else 1.0 if a[1] == b[1] else None


def shown(s):
    return ",".join(f"{h % (2 * SIGN):X}" for h in sorted(s[0])) or (f"+{s[1] % (2 * SIGN):X}" if s[1] is not None else "")


def test_fingerprints_match_plain_python(spark, given):
    rows = sorted((r["doc_id"], r["text"] or "") for r in given.collect())
    expected = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        part = len(text) // 4
        edited = sketch_of(text[: len(text) - part] + following[:part])
        own = sketch_of(text)
        after = sketch_of(following)
        expected[i] = (shown(own), shown(edited), alike(own, edited), alike(own, after), contained(own, edited), contained(own, after))
    found = {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"], r["contained_edited"], r["contained_next"]) for r in fingerprints.fingerprints(given).collect()}
    assert found == {i: (a, b, *(v if v is None else pytest.approx(v) for v in rest)) for i, (a, b, *rest) in expected.items()}


def test_sketches_merge_by_union_and_show_texts_inside_others(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    pairs = []
    for _ in range(30):
        short, long_ = words(40), words(3000)
        at = rng.randrange(len(long_))
        pairs.append((" ".join(short), " ".join(long_[:at] + short + long_[at:]), " ".join(words(60))))
    a, b, c = (fingerprints.sketch(F.col(x)) for x in "abc")
    df = spark.createDataFrame(pairs, "a string, b string, c string").select(
        fingerprints.containment(a, b).alias("inside"), F.size(a["kept"]).alias("n"), a.alias("a"), c.alias("c"), fingerprints.merged(a, c).alias("both")
    )
    rows = df.collect()
    assert sum(r["n"] > 0 for r in rows) > 20 and all(r["inside"] == 1.0 for r in rows if r["n"]) and all(r["inside"] is None for r in rows if not r["n"])
    for r in rows:
        assert r["both"]["kept"] == sorted({*r["a"]["kept"], *r["c"]["kept"]}) and r["both"]["least"] == min(r["a"]["least"], r["c"]["least"])


def test_fingerprint_of_the_largest_id_beside_a_null_one(spark):
    docs = spark.createDataFrame([(SIGN - 1, "a b c d"), (None, "a b c d"), (3, "x y z")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in fingerprints.fingerprints(docs).collect()) == sorted([str(SIGN - 1), "None", "3"])


def shares_of(text, lang):
    text = text or ""
    words = words_of(text)
    counts = [len(re.findall(f"[{c}]", text)) for c in quality_rules.CHAR_CLASSES] + [len(text) - sum(map(len, words))]
    chars = [c / len(text) for c in [*counts, len(text) - sum(counts)]] if text else [0.0] * (len(counts) + 1)
    listed = quality_rules.COMMON_WORDS.get(lang, quality_rules.OTHER_WORDS)
    common_words = [words.count(w) / max(len(words), 1) for w in listed]
    return chars, [*common_words, 1 - sum(common_words)], len(words), sum(map(len, words))


def distance(p, q):
    term = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    if not any(x > 0 for x in p) or not any(x > 0 for x in q):
        return 0.0
    return math.sqrt(max(sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2, 0))


def test_divergences_match_plain_python(spark, given):
    rows = [(r["doc_id"], r["lang"] if r["lang"] in quality_rules.COMMON_WORDS else "other", *shares_of(r["text"], r["lang"])) for r in given.collect()]
    held = collections.defaultdict(list)
    for _, lang, chars, listed, n, _ in rows:
        if n >= quality_rules.MIN_WORDS:
            held[lang].append((chars, listed))
    reference = {k: [np.mean([x[i] for x in v], axis=0).round(9) for i in (0, 1)] for k, v in held.items()}
    found = {r["doc_id"]: r for r in quality_rules.with_verdicts(given.withColumn("__w", F.lit("own"))).collect()}
    for i, lang, chars, listed, n, n_chars in rows:
        far = distance(chars, reference[lang][0]) if n_chars >= quality_rules.MIN_CHARS and lang in reference else 0.0
        off = distance(listed, reference[lang][1]) if n >= quality_rules.MIN_WORDS and lang in reference else 0.0
        r = found[i]
        assert (r["char_distance"], r["word_distance"]) == (pytest.approx(far, abs=1e-6), pytest.approx(off, abs=1e-6)) and r["__w"] == "own"
        assert r["kept"] == (not r["base_failed"] and r["char_distance"] <= quality_rules.MOST_CHAR_DISTANCE and r["word_distance"] <= quality_rules.MOST_WORD_DISTANCE)
    assert sum(r["kept"] for r in found.values()) > len(found) / 2


def test_trees_match_a_walk_by_hand():
    rng = np.random.default_rng(4)
    x = rng.random((300, 5)).round(1)  # with ties
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    model = quality_gbt.fit(x, y, trees=12, depth=3)
    for row, score in zip(x, model.score(x), strict=True):
        total = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    one_kind = quality_gbt.fit(x, np.ones(300))
    assert one_kind.score(x) == pytest.approx(301 / 302) and quality_gbt.fit(x[:0], y[:0]).score(x[:2]) == pytest.approx(0.5)


def test_statistics_match_plain_python(given):
    texts = [r["text"] for r in given.limit(60).collect()] + [None, "", " \n\n", "A A a 12 x9", "line one\nline one\nline two"]
    import pyarrow as pa

    found = quality_gbt.statistics(*common.utf8_buffer(pa.array(texts, pa.string())))
    at = {name: i for i, name in enumerate(quality_gbt.FEATURES)}
    for text, row in zip(texts, found, strict=True):
        raw, words = (text or "").encode(), [w.encode() for w in words_of(text)]
        n = max(len(words), 1)
        assert row[at["log_words"]] == pytest.approx(math.log1p(len(words)))
        assert row[at["mean_word"]] == pytest.approx(sum(map(len, words)) / n)
        assert row[at["digit"]] == pytest.approx(sum(48 <= b < 58 for b in raw) / max(len(raw), 1))
        assert row[at["distinct_words"]] == pytest.approx(len(set(words)) / n)
        assert row[at["top_word"]] == pytest.approx(max(collections.Counter(words).values(), default=0) / n)
        assert row[at["repeat_next"]] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n)


def test_quality_scores_of_odd_rows(spark, tmp_path):
    rows = [(1, "good words here " * 20), (2, None), (3, ""), (None, "good words here " * 20), (1, "good words here " * 20), (5, "### $$$ " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(3)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 1), (3, 7), (99, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = quality_gbt.op9_quality_trees(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (2, 3)}) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    mine, theirs = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert sorted(tuple(r[c] for c in theirs.columns) for r in mine.collect()) == sorted(map(tuple, theirs.fetchall()))
