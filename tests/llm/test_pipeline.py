"""run() of the pipeline against its five rules in plain Python, on a whole given table."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from masschain.llm import mixing, pieces, quality_rules
from test_dedup import groups
from test_stages import highest_quotients
from test_whole_tables import DATA, distance, hash64, shares_of, signed, words_of


def kept_by_quality(rows):
    featured = []
    for r in rows:
        lang = r["lang"] if r["lang"] in quality_rules.COMMON_WORDS else "other"
        words = words_of(r["text"])
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        featured.append((lang, *shares_of(r["text"], r["lang"]), len(words) < 50 or 2 * len(covered) > len(words)))
    held = collections.defaultdict(list)
    for lang, chars, listed, n, _, _ in featured:
        if n >= quality_rules.MIN_WORDS:
            held[lang].append((chars, listed))
    reference = {k: [np.mean([x[i] for x in v], axis=0).round(9) for i in (0, 1)] for k, v in held.items()}
    out = []
    for r, (lang, chars, listed, n, n_chars, failed) in zip(rows, featured, strict=True):
        far = distance(chars, reference[lang][0]) if n_chars >= quality_rules.MIN_CHARS and lang in reference else 0
        off = distance(listed, reference[lang][1]) if n >= quality_rules.MIN_WORDS and lang in reference else 0
        if not failed and far <= quality_rules.MOST_CHAR_DISTANCE and off <= quality_rules.MOST_WORD_DISTANCE:
            out.append(r)
    return out


def without_repeats(rows, length=200):
    raw = [r["text"].encode() for r in rows]
    count = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(r | {"text": bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "replace")})
    return out


def mix(spark, rows, seed=23):
    key = lambda r: "1" if r["source"] is None else "0" + r["source"]
    sizes = collections.Counter()
    for r in rows:
        sizes[key(r)] += len(words_of(r["text"]))
    aimed = {r["key"]: r for r in mixing.quotas(mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long"))).collect()}
    block = next(iter(aimed.values()))["block"]
    target = {k: r["target"] for k, r in aimed.items()}
    quota = highest_quotients(target, int(sum(target.values()) / block + 0.5), {k: 3 * s // block for k, s in sizes.items()})
    line, out = collections.defaultdict(list), []
    for r in rows:
        spread = signed(hash64(r["doc_id"], (seed,), signed(hash64(r["text"]))))
        line[key(r)].append((spread % mixing.BUCKETS, spread, r["doc_id"], r))
    for k, docs in line.items():
        at = 0
        for *_, r in sorted(docs, key=lambda x: x[:3]):
            size = len(words_of(r["text"]))
            words = quota[k] * block
            times = words // sizes[k] + (2 * at + size <= 2 * (words % sizes[k])) if size else 0
            out += [r] * times
            at += size
    return out


def test_run_matches_plain_python(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    kept = kept_by_quality(rows)
    assert len(rows) / 2 < len(kept) < len(rows)
    component = groups([(r["doc_id"], r["text"]) for r in kept], 5)
    alone = [r for r in kept if component[r["doc_id"]][1] == r["doc_id"]]
    assert len(alone) < len(kept)
    mixed = mix(spark, without_repeats(alone))
    encoder = pieces.Encoder(pieces.VOCABULARY)
    expected = collections.Counter((r["doc_id"], r["text"], tuple(e[0])) for r, e in zip(mixed, encoder.encode_texts([r["text"] for r in mixed]), strict=True))
    found = corpus_pipeline.run(spark, DATA).collect()
    assert collections.Counter((r["doc_id"], r["text"], tuple(r["piece_ids"])) for r in found) == expected
    assert all(r["round_trip"] for r in found)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_stages_on_empty_and_null_rows(spark, rows):
    """Nothing of it passes the quality rules; later stages take such rows as they are."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = {name: stage(spark, docs, "").count() for name, stage in corpus_pipeline.STAGES}
    assert counts == {"quality rules": 0, "near-duplicates": 0 if not rows else counts["near-duplicates"], "repeated strings": len(rows), "source mix": 0, "pieces": len(rows)}
