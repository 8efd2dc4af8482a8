"""Vocabulary that leaks into documents: terms and phrases of any length, as whole words, less what is allowed.

Words are runs of letters, digits and `_`, lower-cased. A term is cut into pieces of RUN words, the last one ending with the term; a
shorter term is one piece. Where a word of a document begins a piece, the run of as many words is looked up among the pieces in one join by the
phrase itself, so work is linear in the words of a document. A term stands where all of its pieces do, at their
offsets. Allowed terms are not sought; an exempt document is not searched for the kinds that it is exempt from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import tables

RUN = 4
MOST_TERMS = 500_000  # pieces of terms that are sent to all executors; with more, runs are dealt by their words
SPLIT = "[^a-z_0-9]+"


def words_of(text):
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def found(docs: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, term, n) of docs (doc_id, text) and terms (kind, term): how often each term stands in each document, overlaps included.

    allowed: (term); exempt: (doc_id, kind). Terms of equal words are one; null texts hold nothing; rows that repeat an id count together.
    """
    own = terms.select("kind", words_of("term").alias("sought")).filter(F.size("sought") > 0)
    own = own.withColumns({"term": F.array_join("sought", " "), "length": F.size("sought")}).dropDuplicates(["kind", "term"])
    if allowed is not None:
        own = own.join(allowed.select(F.array_join(words_of("term"), " ").alias("term")).distinct(), "term", "left_anti")
    offsets = F.when(F.col("length") <= RUN, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(F.col("length") / RUN).cast("int") - 1), lambda i: F.least(i * RUN, F.col("length") - RUN))))
    own = own.select("kind", "term", "sought", F.size(offsets).alias("pieces"), F.explode(offsets).alias("offset")).withColumn("words", F.slice("sought", F.col("offset") + 1, RUN))
    own = own.select("kind", "term", "pieces", "offset", F.array_join("words", " ").alias("run"), F.get("words", 0).alias("first"), F.size("words").alias("k"))
    begun = own.select("first", "k").distinct()
    sent = lambda df: F.broadcast(df) if df.count() <= MOST_TERMS else df
    # numbered, as ids may repeat or be null; a word with the next ones, null behind the last
    texts = docs.filter("text IS NOT NULL").select("doc_id", F.monotonically_increasing_id().alias("row"), words_of("text").alias("w")).filter(F.size("w") > 0)
    behind = [F.col("w"), *(F.slice("w", n + 1, F.size("w")) for n in range(1, RUN))]
    words = texts.select("doc_id", "row", F.inline(F.arrays_zip(F.sequence(F.lit(1), F.size("w")).alias("at"), *(b.alias(f"w{n}") for n, b in enumerate(behind, 1)))))
    run = F.col("w1")
    for n in range(2, RUN + 1):  # a run past the last word is null
        run = F.when(F.col("k") == n, F.concat(*(c for m in range(1, n + 1) for c in (F.lit(" "), F.col(f"w{m}"))[m == 1 :]))).otherwise(run)
    runs = words.join(sent(begun), F.col("w1") == F.col("first")).select("doc_id", "row", "at", run.alias("run"))
    # runs outnumber terms, so they stay where they are if the terms can go to them
    hit = runs.join(sent(own.drop("first", "k")), "run")
    long_ = F.col("pieces") > 1
    place = [F.when(long_, F.col("row")).alias("row"), F.when(long_, F.col("at") - F.col("offset")).alias("start")]
    whole = hit.groupBy("doc_id", "kind", "term", "pieces", *place).agg(F.count(F.lit(1)).alias("met")).filter(~long_ | (F.col("met") == F.col("pieces")))
    out = whole.groupBy("doc_id", "kind", "term").agg(F.coalesce(F.sum(F.when(long_, F.lit(1)).otherwise(F.col("met"))), F.lit(0)).alias("n"))
    if exempt is not None:
        free = exempt.select(F.col("doc_id").alias("free_id"), F.col("kind").alias("free_kind")).distinct()
        out = out.join(free, F.col("doc_id").eqNullSafe(F.col("free_id")) & (F.col("kind") == F.col("free_kind")), "left_anti")
    return out


#: Classes, phrases of labels, axis words, words of the domain, and passages that no document may hold.
TERMS = """SELECT 'class' AS kind, p_type AS term FROM part UNION SELECT 'class', n_name FROM nation UNION SELECT 'label', p_name FROM part UNION SELECT 'axis', replace(r_name, ' ', '_') FROM region
    UNION SELECT 'domain', 'license' FROM region UNION SELECT 'domain', 'copyright' FROM region UNION SELECT 'banned', text FROM benchmark"""
#: Classes that are words of plain prose.
ALLOWED = "SELECT * FROM (VALUES ('small'), ('large'), ('medium'), ('standard'), ('promo'), ('economy')) AS t(term)"
#: Documents that carry a licence tag may name licences.
EXEMPT = "SELECT doc_id, 'domain' AS kind FROM documents WHERE position('spdx-license-identifier' IN lower(text)) > 0"


def term_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda text: tables.run(spark, sf_dir, text)
    return found(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), of(TERMS), of(ALLOWED), of(EXEMPT))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z_0-9]+'), lambda x: x <> '')"
QUERIES = {"term_leak_scan": term_leak_scan}
#: Each term in each document that holds it as a string between spaces, and its places by comparing runs of words.
ORACLE = {
    "term_leak_scan": f"""WITH t AS (SELECT DISTINCT kind, {_WORDS.format('term')} AS s FROM ({TERMS}) v), u AS (SELECT kind, s, array_to_string(s, ' ') AS term FROM t WHERE len(s) > 0 AND array_to_string(s, ' ') NOT IN (SELECT term FROM ({ALLOWED}) a)),
        d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, w, concat(' ', array_to_string(w, ' '), ' ') AS flat FROM d),
        h AS (SELECT e.doc_id, u.kind, u.term, len(list_filter(range(1, len(e.w) - len(u.s) + 2), lambda i: e.w[i] = u.s[1] AND e.w[i:i + len(u.s) - 1] = u.s)) AS n FROM e JOIN u ON contains(e.flat, concat(' ', u.term, ' ')))
        SELECT doc_id, kind, term, n FROM h WHERE NOT EXISTS (SELECT 1 FROM ({EXEMPT}) x WHERE x.doc_id = h.doc_id AND x.kind = h.kind)""",
}
