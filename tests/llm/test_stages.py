"""Stages of the pipeline against the whole job on small tables."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from masschain.llm import common, mixing, quality_gbt

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """rows (doc_id, text, source) as documents."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("tiny", [0, 200])
def test_mix_stage_meets_targets_with_whole_documents(spark, tiny):
    """Documents of many blocks, as small tables or one tiny source make them."""
    sizes = {"a": [400 + i for i in range(60)], "b": [300] * 40, "c": [90, 700] * 10, None: [250] * 30}
    if tiny:
        sizes["z"] = [tiny]
    rows = [(n, f"w{n} " * size, s) for n, (s, size) in enumerate((s, x) for s, all_ in sizes.items() for x in all_)]
    docs = table(spark, rows)
    target = {r["source"]: r["target"] for r in mixing.mixed(docs).select("source", "target").distinct().collect()}
    words, copies = collections.Counter(), collections.Counter()
    given = {i: t for i, t, _ in rows}
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        assert r["text"] == given[r["doc_id"]]
        words[r["source"]] += len(r["text"].split())
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3
    for source, aim in target.items():
        assert abs(words[source] - aim) <= max(sizes[source]) / 2 + 0.005 * aim + 8, source
    assert corpus_pipeline.mixed(spark, docs.limit(0), "").count() == 0
    common.drop_scratch_tables(spark)


def test_near_duplicate_stage_keeps_unlike_texts_of_one_id(spark):
    """A hot id with unlike texts, groups that meet only through it, nulls and repeated rows."""
    text = {t: " ".join(f"{t}{i}" for i in range(100)) for t in "abcdefgh"}
    rows = [(7, text[t], "s") for t in "abcdef"] + [(3, text["a"] + " more", "s"), (9, text["b"] + " more", "s"), (None, text["g"], "s"), (None, text["g"] + " more", "s")]
    rows += [(None, text["c"] + " more", "s"), (8, text["h"], "s"), (8, text["h"], "s"), (4, None, "s"), (5, "", "s"), (5, "", "s")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, table(spark, rows), "").collect())
    null_id = {x for x in got if x[0] is None}
    assert len(null_id) == 1 and next(iter(null_id))[1].startswith(text["g"])
    assert {x: n for x, n in got.items() if x[0] is not None} == {
        (3, text["a"] + " more"): 1, **{(7, text[t]): 1 for t in "bcdef"}, (8, text["h"]): 1, (4, None): 1, (5, ""): 1
    }
    common.drop_scratch_tables(spark)


def test_training_rows_of_a_hot_id_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"hot text {i % 150}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 22)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1)] + [(i, i % 2) for i in range(2, 22)], "doc_id long, quality int")
    seen = []
    fit, quality_gbt.fit = quality_gbt.fit, lambda x, y, *rest: seen.append((len(y), int((y == 0).sum())))
    try:
        quality_gbt.trained(docs, labels, F.lit(False), 40)
        quality_gbt.trained(docs, labels, F.lit(False), 1000)
    finally:
        quality_gbt.fit = fit
    # all ten rows of label 0 stay beside the hot id; without a cut all rows count
    assert seen == [(40, 10), (620, 10)]


def highest_quotients(targets, seats, most):
    """Seat by seat, to the highest target / (2 * seats so far + 1)."""
    got = dict.fromkeys(targets, 0)
    for _ in range(seats):
        able = [k for k in targets if targets[k] > 0 and got[k] < most[k]]
        if not able:
            break
        got[min(able, key=lambda k: (-targets[k] / (2 * got[k] + 1), k))] += 1
    return got


@pytest.mark.parametrize("seed", range(6))
def test_quotas_are_those_of_highest_quotients(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = {f"0s{i:02}": rng.choice([rng.randrange(60, 300), rng.randrange(2000, 9000), 40]) for i in range(rng.choice([1, 3, 17, 40]))}
    aimed = mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long"))
    rows = {r["key"]: r for r in mixing.quotas(aimed).collect()}
    block = next(iter(rows.values()))["block"]
    target = {k: r["target"] for k, r in rows.items()}
    assert {k: r["quota"] for k, r in rows.items()} == highest_quotients(target, int(sum(target.values()) / block + 0.5), {k: 3 * s // block for k, s in sizes.items()})
    by_shard = collections.defaultdict(dict)
    own = mixing.quotas(aimed).withColumnRenamed("key", "source")
    for r in mixing.shard_quotas(own).collect():
        by_shard[r["source"]][r["key"]] = (r["shard_blocks"], r["quota"])
    for key, found in by_shard.items():
        blocks = {s: sum(b % 8 == s for b in range(rows[key]["blocks"])) for s in range(8)}
        assert {s: b for s, (b, _) in found.items()} == blocks
        assert {s: q for s, (_, q) in found.items()} == highest_quotients(blocks, rows[key]["quota"], {s: 3 * b for s, b in blocks.items()})


def test_mix_takes_each_shard_quota_of_blocks(spark):
    """The words taken are those of as many whole blocks of each shard as its quota says; clashing columns pass through."""
    rows = [(i, f"w{i} " * 8, "ab"[i % 2]) for i in range(400)]
    docs = table(spark, rows).withColumns({c: F.lit("own") for c in ("key", "bucket", "quota", "at", "block", "spread")})
    found = mixing.mixed(docs).collect()
    assert all(r[c] == "own" for r in found for c in ("key", "bucket", "quota", "at", "block", "spread"))
    sizes = spark.createDataFrame([("0a", 1600), ("0b", 1600)], "key string, source_size long")
    quota = {r["key"][1:]: r["quota"] for r in mixing.quotas(mixing.targets(sizes)).collect()}
    for source in "ab":
        own = [r for r in found if r["source"] == source]
        # blocks of 8 words are documents here
        assert all(r["taken"] % 8 == 0 for r in own) and sum(r["taken"] for r in own) == 8 * quota[source]
