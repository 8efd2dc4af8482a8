"""Hashes of spans, and operators on strings that collide under polynomials modulo a power of two."""

import numpy as np
import pytest

from masschain.llm import common, near_dup, pieces, suffix_dedup

#: The Thue-Morse string and its complement collide modulo 2^64 for every odd base and all byte values.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def by_definition(data, base):
    p = int(common.PRIME)
    return sum((b + 1) * pow(base, i, p) for i, b in enumerate(data.tolist())) % p


@pytest.mark.parametrize("second", [False, True])
def test_hashes_are_polynomials_wherever_the_bytes_stand(second):
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    data[3000:3050] = data[100:150]
    sums = common.prefix_hash(data, second)
    assert {base for base, _ in sums}.isdisjoint({base for base, _ in common.prefix_hash(data, not second)})
    got = common.span_hash(sums, np.array([100, 3000, 100, 7, 0]), np.array([150, 3050, 151, 7, 4000]))
    assert got[0] == got[1] != got[2]
    want = [(by_definition(data[a:b], sums[0][0]) << 32) | by_definition(data[a:b], sums[1][0]) for a, b in ((100, 150), (7, 7), (0, 4000))]
    assert (got[[0, 3, 4]] == common.mix64(np.array(want, np.uint64))).all()


def test_long_buffers_do_not_overflow():
    data = np.full(3_000_000, 255, np.uint8)
    got = common.span_hash(common.prefix_hash(data), np.array([0, 1_000_000, 5]), np.array([2_000_000, 3_000_000, 2_000_006]))
    assert got[0] == got[1] != got[2]


def test_strings_that_used_to_collide():
    both = np.frombuffer((MORSE + OTHER).encode(), np.uint8)
    n = len(MORSE)
    for second in (False, True):
        one, two = common.span_hash(common.prefix_hash(both, second), np.array([0, n]), np.array([n, 2 * n]))
        assert one != two


def test_unlike_words_are_not_near_duplicates(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER), (3, MORSE.upper()), (4, f"{MORSE} x y z"), (5, f"{OTHER} x y z")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 4, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_unlike_segments_are_encoded_by_themselves():
    encoder = pieces.Encoder(pieces.VOCABULARY)
    for texts in ([MORSE, OTHER], [f"{OTHER} {MORSE}", OTHER]):
        for (ids, _, _), text in zip(encoder.encode_texts(texts), texts, strict=True):
            assert encoder.decode(ids) == text


def test_segments_of_one_hash_are_solved_again(monkeypatch):
    encoder, plain = pieces.Encoder(pieces.VOCABULARY), pieces.Encoder(pieces.VOCABULARY)
    texts = ["alpha beta gamma", "delta epsilon", "", "alpha zeta"]
    want = plain.encode_texts(texts)
    monkeypatch.setattr(pieces.common, "span_hash", lambda sums, start, end: np.full(len(start), 7, np.uint64))
    assert encoder.encode_texts(texts) == want


def test_unlike_windows_are_not_repeats(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER)], "doc_id long, text string")
    data, offsets = np.frombuffer((MORSE + OTHER).encode(), np.uint8), np.array([0, len(MORSE), 2 * len(MORSE)])
    row, begin, count, key, whole, _ = suffix_dedup.window_runs(data, offsets, 200, 32)
    by_bytes = {}
    for r, b, c, w in zip(row, begin, count, whole):
        text = (MORSE if r == 0 else OTHER)[b : b + c - 1 + 200]
        assert by_bytes.setdefault(int(w), text) == text
    assert docs.count() == 2
