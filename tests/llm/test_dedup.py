"""Near-duplicates and repeated strings against brute force on small and given tables."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from masschain.llm import near_dup, suffix_dedup

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def groups(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def given(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, given, k):
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, k).collect()}
    assert got == groups(given, k)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, "a b"), (3, "A  b"), (7, None), (8, ""), (None, "a b"), (None, "alone here now too"), (9, long), (9, long), (2, long + " end"), (11, " \t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted(
        [(5, 3, False), (3, 3, True), (7, 7, True), (8, 8, True), (None, 3, False), (None, None, True), (9, 2, False), (9, 2, False), (2, 2, True), (11, 11, True)], key=str
    )
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_within_a_large_template(spark):
    """More than DENSE texts share a template at 0.794; pairs far apart by id reach 0.8125."""
    template = " ".join(f"t{i}" for i in range(81))
    n, pairs = 900, 12
    own = {i: [f"o{i}_{j}" for j in range(10)] for i in range(n)}
    for i in range(pairs):
        own[n - pairs + i][0] = own[i][0]
    rows = [(i, f"{template} {' '.join(own[i])}") for i in range(n)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {i: (87, i - n + pairs if i >= n - pairs else i) for i in range(n)}


def test_near_duplicates_of_an_id_with_several_texts(spark):
    """Each text of an id links with its own copies."""
    texts = [" ".join(f"x{t}_{i}" for i in range(100)) for t in range(6)]
    rows = [(1, t) for t in texts] + [(10 + i, t + " more") for i, t in enumerate(texts)] + [(99, "of its own")]
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {(1, 1), (99, 99)} | {(10 + i, 1) for i in range(6)}


def cut(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 700])
def test_repeated_strings_match_brute_force(spark, given, monkeypatch, shard_bytes):
    """With a small shard size, keys are dealt over several shards and merged."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    odd = ["a" * 500, "b" * 199, "c" * 200, "c" * 200, None, "", "xyz" * 300, "xy" * 100 + "q", "xy" * 101, "é" * 300, "d" * 201]
    texts = odd + ([t for _, t in given[:80]] if shard_bytes > 1000 else [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept_bytes"])).hexdigest()) for r in found] == cut(texts)


def test_repeated_strings_found_in_a_shard_and_across_shards(spark, monkeypatch):
    """Passages of 300 bytes in some texts of which others hold one window of 200 bytes only, over small shards."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 700)
    word = lambda seed: hashlib.sha512(seed.encode()).hexdigest()
    texts = []
    for p in range(5):
        passage = (word(f"p{p}") + word(f"q{p}") + word(f"r{p}"))[:300]
        for c in range(5):
            shown = passage if c < 2 else passage[:200]
            texts.append(f"{word(f'l{p}.{c}')}{chr(65 + c)}{shown}{chr(75 + c)}{word(f'm{p}.{c}')}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept_bytes"])).hexdigest()) for r in found] == cut(texts)


def test_repeated_strings_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "x" * 150 + "y" * 100), (1, "x" * 150 + "y" * 100), (None, "z" * 10)], "doc_id long, text string").withColumn("n_removed", F.lit(5))
    assert sorted(r["n_removed"] for r in suffix_dedup.without_repeats(docs).collect()) == [0, 250, 250]
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0
