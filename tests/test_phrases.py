"""Terms in documents: where runs of words are met by terms."""

import random
from collections import Counter

from masschain.operators import phrases


def test_runs_stay_where_they_are_unless_terms_are_many(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the red box and the red box of a big old red wooden box"), (2, None), (3, "Red Box")], "doc_id long, text string")
    terms = spark.createDataFrame([("k", "red box"), ("k", "a big old red wooden"), ("k", "box of"), ("k", "none")], "kind string, term string")
    expected = {(1, "red box", 2), (1, "a big old red wooden", 1), (1, "box of", 1), (3, "red box", 1)}
    rows = lambda: {(r["doc_id"], r["term"], r["n"]) for r in phrases.found(docs, terms).collect()}
    plan = phrases.found(docs, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and rows() == expected
    monkeypatch.setattr(phrases, "MOST_TERMS", 3)
    assert rows() == expected


def test_documents_are_read_once_and_long_terms_stand_where_all_pieces_do(spark):
    """A second pass for long terms sorted all documents, and runs cut from whole arrays cost the square of a document's words."""
    rng = random.Random(5)
    texts = [(i % 37, None if i == 4 else " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(40)] + [(50, "a b c d a b c d a b c d a"), (50, "a b c d a b c d a b c d a"), (51, " ".join("ab" * 20_000))]
    terms = {" ".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 4, 5, 5, 6, 7, 8, 9, 12, 13)} | {"a b c d a b c d a", "c d a b c", "a b c d e", "a " * 9 + "b"}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = phrases.found(docs, spark.createDataFrame([("k", t) for t in terms], "kind string, term string"))
    expected = Counter()
    for i, text in texts:
        words = (text or "").split()
        for sought in (t.split() for t in terms):
            n = sum(words[p : p + len(sought)] == sought for p in range(len(words) - len(sought) + 1))
            if n:
                expected[i, " ".join(sought)] += n
    assert {(r["doc_id"], r["term"]): r["n"] for r in found.collect()} == expected and max(len(t.split()) for _, t in expected) > 8
    assert found._jdf.queryExecution().optimizedPlan().toString().count("text IS NOT NULL") + found._jdf.queryExecution().optimizedPlan().toString().count("isnotnull(text") == 1
