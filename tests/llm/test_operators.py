"""The other operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from masschain.llm import common, feistel, fingerprints, lattice_lm, licenses, mixing, pieces, quality_gbt, quality_rules, trie

DATA = "/root/testdata/sf0.001"
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, " \t\n", "xx", "s"), (None, "one two three", "de", None), (5, "a  b\r\nc", "fr", "t"), (5, "a  b\r\nc", "fr", "t"),
       (7, "日本語 😀 é" * 3, None, "s"), (8, "wort " * 3000, "de", "s"), (9, "x" * 3000, "en", "t")]


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.withColumn("kept", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("size", F.lit(1)).withColumn("score", F.lit(0)).withColumn("n_words", F.lit(0))


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 50, 1000):
        places = spark.range(n).select(feistel.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("p")).collect()
        assert sorted(r["p"] for r in places) == list(range(n))


def test_shards_are_even_and_gapless(spark, odd):
    for rows in (feistel.op3_feistel_shards(spark, DATA).collect(), feistel.shard_rows(odd, ["doc_id", "text"]).collect()):
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(s) for s in slots.values()] + [0] * (8 - len(slots))
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert feistel.shard_rows(odd.limit(0), ["doc_id"]).count() == 0


def test_quality_counts(spark, given, odd):
    for docs in (given, odd):
        found = quality_rules.with_verdicts(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert len(found) == docs.count()
        for r in found:
            text, words = r["text"] or "", words_of(r["text"])
            windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
            covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            lines = [x for x in text.split("\n") if words_of(x)]
            expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
            assert tuple(r[1:6]) == expected
            assert r["base_failed"] == (len(words) < 50 or 2 * len(covered) > len(words))
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.with_verdicts(odd.limit(0)).count() == 0


def test_base_scores(spark, given, odd):
    for docs in (given, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        counts = collections.Counter()
        for i, t in rows:
            if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
                counts.update((t or "").encode().lower().split() + [None])
        total, distinct = sum(counts.values()), len(counts)
        expected = sorted(
            (len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in [*w, None]), 5))
            for w in ((t or "").encode().lower().split() for _, t in rows)
        )
        got = lattice_lm.lattice_scores(docs).collect()
        assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == expected
        assert all(r["score"] < 0 for r in got)
    assert lattice_lm.lattice_scores(odd.limit(0)).count() == 0


def test_lattice_sums_all_segmentations():
    vocabulary = trie.Vocabulary(["a", "b", "ab", "ba", "aba"], None, None, None)
    import numpy as np

    vocabulary.scores, vocabulary.normal = np.log([0.3, 0.2, 0.2, 0.2, 0.1]), np.arange(5)
    lattice = trie.Lattice(vocabulary, vocabulary.scores, -20.0)
    p = dict(zip(vocabulary.pieces, (0.3, 0.2, 0.2, 0.2, 0.1), strict=True))

    def brute(s):
        return 1.0 if not s else sum(p[q] * brute(s[len(q) :]) for q in p if s.startswith(q))

    for text in ("a", "ab", "aba", "ababab", "bbaab"):
        rows = np.frombuffer(text.encode(), np.uint8).reshape(1, -1)
        assert math.exp(lattice.marginal(rows, np.array([len(text)]))[0]) == pytest.approx(brute(text))
        counts = lattice.expected(rows, np.array([len(text)]), np.ones(1))
        assert sum(c * len(q) for c, q in zip(counts, vocabulary.pieces, strict=False)) == pytest.approx(len(text))


def test_few_rows_go_edge_by_edge_to_the_same_results():
    import numpy as np

    rng = np.random.default_rng(3)
    v = trie.load_vocabulary(pieces.VOCABULARY)
    lattice = trie.Lattice(v, trie.log_weights(v), -25.0)
    words = [("ab the der é日Z9"[i % 7 :] * 9)[: int(k)].encode() for i, k in enumerate(rng.integers(1, 90, 64))]
    lengths = np.array([len(w) for w in words])
    rows = np.stack([np.frombuffer(w.ljust(lengths.max(), b"\0"), np.uint8) for w in words])
    weights = rng.random(len(words))
    many = lattice.marginal(rows, lengths), lattice.expected(rows, lengths, weights), lattice.best(rows, lengths)
    alone = [(rows[i : i + 1], lengths[i : i + 1]) for i in range(len(words))]
    assert many[0] == pytest.approx([lattice.marginal(*a)[0] for a in alone])
    assert many[1] == pytest.approx(sum(lattice.expected(*a, weights[i : i + 1]) for i, a in enumerate(alone)))
    for i, a in enumerate(alone):
        total, _, begin, end, piece = lattice.best(*a)
        own = many[2][1] == i
        assert total[0] == pytest.approx(many[2][0][i]) and [x.tolist() for x in (begin, end, piece)] == [x[own].tolist() for x in many[2][2:]]


def test_words_of_a_megabyte(spark):
    import time

    word = "QmFzZTY0" * (1 << 17)
    began = time.perf_counter()
    docs = spark.createDataFrame([(1, word), (2, "a b"), (3, "\u65e5" * 300_000)], "doc_id long, text string")
    encoded = pieces.encoded(docs).select("doc_id", "round_trip", F.size("piece_ids").alias("n")).collect()
    assert all(r["round_trip"] and r["n"] > 0 for r in encoded)
    scored = {r["doc_id"]: r["score"] for r in lattice_lm.lattice_scores(docs).collect()}
    assert -1e7 < scored[1] < -1e4 and math.isfinite(scored[3])
    assert time.perf_counter() - began < 120


def test_pieces_round_trip_and_best_score(spark, given, odd):
    encoder = pieces.Encoder(pieces.VOCABULARY)
    weights = trie.log_weights(encoder.v)
    assert sum(math.exp(weights[i]) for i in encoder.v.normal) == pytest.approx(1)
    scores = {encoder.v.pieces[i]: weights[i] for i in encoder.v.normal}

    def best(text):
        marked = f" {text}".replace(" ", trie.MARK)
        table = [0.0] + [-math.inf] * len(marked)
        for i, c in enumerate(marked):
            for j in range(i + 1, min(len(marked), i + 16) + 1):
                if marked[i:j] in scores:
                    table[j] = max(table[j], table[i] + scores[marked[i:j]])
            if c not in scores:
                table[i + 1] = max(table[i + 1], table[i] + encoder.unknown)
        return table[-1]

    for docs in (given.limit(40), odd):
        for r in pieces.encoded(docs).collect():
            assert r["round_trip"] and encoder.decode(r["piece_ids"]) == (r["text"] or "")
            assert r["piece_score"] == pytest.approx(best(r["text"]) if r["text"] else 0.0)


def test_fingerprints(spark, given, odd):
    for docs in (given, odd):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else math.inf, r["text"] or "") for r in docs.collect()), key=lambda r: r[0])
        found = fingerprints.fingerprints(docs).collect()
        expected = collections.Counter()
        for (_, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            part = len(text) // 4
            expected[hashlib.sha256((text[: len(text) - part] + following[:part]).encode()).hexdigest()] += 1
        assert collections.Counter(r["edited_sha256"] for r in found) == expected
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_mix_meets_targets(spark, given, odd):
    for docs in (given, odd):
        rows = mixing.mixed(docs).collect()
        assert len(rows) == docs.count()
        by = collections.defaultdict(lambda: [0, 0, 0.0])
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(words_of(r["text"]))
            own = by[(r["source"] is None, r["source"])]
            own[0], own[1], own[2] = own[0] + r["size"], own[1] + r["taken"], r["target"]
        keys = sorted(by, key=str)
        total = sum(v[0] for v in by.values())
        assert sum(v[2] for v in by.values()) == pytest.approx(total)
        capped = set()
        while True:
            left, weight = total - sum(3 * by[k][0] for k in capped), {k: i % 3 + 1 for i, k in enumerate(keys) if k not in capped}
            aim = {k: left * w / sum(weight.values()) for k, w in weight.items()}
            if not (over := {k for k in aim if aim[k] > 3 * by[k][0]}):
                break
            capped |= over
        for k, (size, taken, target) in by.items():
            assert target == pytest.approx(3 * size if k in capped else aim[k])
            assert abs(taken - target) <= max(0.05 * target, 40)
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_quality_trees_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality_gbt.op9_quality_trees(spark, folder).filter("held_out").select("doc_id", "predicted")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    right = scored.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


def test_licenses(spark, odd):
    finder = licenses.automaton()
    assert licenses.scan("MIT License, mit-LICENSE", finder)[:6] == (4, 2, 0, 2, "mit", "mit")
    assert licenses.scan("GNU General\nPublic License", finder)[:6] == (4, 1, 1, 1, "gpl", "gpl")
    assert licenses.scan("GNU Lesser General Public License", finder)[1:] == (1, 2, 2, "gpl", "gpl,lgpl", 0.6)
    assert licenses.scan("SPDX-License-Identifier: MIT OR GPL-2.0 AND Apache-2.0", finder)[5:] == ("apache,gpl,mit", 1.0)
    assert licenses.scan("SPDX-License-Identifier: (MIT OR GPL-2.0) AND CC-BY-NC-4.0", finder)[6] == 0.1
    assert licenses.scan("SPDX-License-Identifier: MIT is what we use", finder)[5:] == ("mit", 1.0)
    assert licenses.evaluate("gpl-2.0 with classpath-exception-2.0")[0] == pytest.approx(0.7)
    for malformed, labels in (("mit or and gpl-2.0", {"mit", "gpl"}), ("mit or", {"mit"}), ("(mit", {"mit"}), ("mit and (gpl-2.0 or", {"mit", "gpl"})):
        assert licenses.evaluate(malformed) == (0.0, labels | {"unknown"})
    assert licenses.evaluate("") is None and licenses.evaluate("or mit") is None and licenses.evaluate("see below") is None
    assert licenses.scan(None, finder) == (0, 0, None, None, "", "", 0.0)
    assert licenses.scanned(odd).count() == len(ODD)
    assert licenses.scanned(odd.limit(0)).count() == 0


def value_of(expression):
    """A licence expression by recursive descent; its tokens are in order."""
    tokens = re.findall(r"\(|\)|[a-z0-9.+-]+", expression)

    def term(level):
        if level == 3:
            token = tokens.pop(0)
            if token == "(":
                inner = term(0)
                assert tokens.pop(0) == ")"
                return inner
            return licenses.FREEDOM.get(licenses.label_of(token), 0.0)
        value = term(level + 1)
        while tokens and tokens[0] == ("or", "and", "with")[level]:
            tokens.pop(0)
            value = (max, min, lambda a, _: (a + 1) / 2)[level](value, term(level + 1))
        return value

    return term(0)


def test_license_expressions_match_recursive_descent():
    import random

    rng = random.Random(5)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["mit", "gpl-2.0", "apache-2.0", "cc-by-nc-4.0", "lgpl-3.0", "own-1.0", "mpl-2.0"])
        if kind < 0.5:
            return f"({made(depth - 1)})"
        return f"{made(depth - 1)} {rng.choice(['or', 'and', 'with'])} {made(depth - 1)}"

    for _ in range(300):
        expression = made(4)
        found = licenses.evaluate(expression)
        assert (found is None and not any(licenses.label_of(t) for t in re.findall(r"[a-z0-9.+-]+", expression))) or found[0] == pytest.approx(value_of(expression))


def test_license_places_match_brute_force(spark, given):
    phrases = {tuple(p.split()): label for p, label in licenses.BASE_PHRASES.items()}
    more = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    long = "the mit license of x " * 60_000  # beyond a slice, and many places
    docs = given.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, long), (-2, "Apache LICENSE\n" * 3), (None, "mit  license")], "doc_id long, text string"))
    assert docs.count() > 100
    for r in licenses.scanned(docs).collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        at = {p: [i for i in range(len(words) - len(p) + 1) if words[i] == p[0] and tuple(words[i : i + len(p)]) == p] for p in (*phrases, *more)}
        base = sorted(i for p in phrases for i in at[p])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min(base, default=None), max(base, default=None))
        assert r["base_labels"] == ",".join(sorted({phrases[p] for p in phrases if at[p]}))
        if "spdx" not in words:
            assert r["labels"] == ",".join(sorted({(phrases | more)[p] for p in at if at[p]}))
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_pipeline_keeps_columns_and_clean_documents(spark, given, tmp_path):
    import corpus_pipeline

    docs = given.withColumn("extra", F.lit(1))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
    assert docs.filter("NOT round_trip").count() == 0 and docs.count() > 0
    common.drop_scratch_tables(spark)
