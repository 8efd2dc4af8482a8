"""Op 2: quality rules by distribution divergence.

Each text gives two histograms: character classes, and how often each common word of
its language stands in it (all other words in one bin). A language's reference is the
mean of these, as shares, over its texts of MIN_WORDS words or more. A text is rejected
when its Jensen-Shannon distance (base 2, 0 to 1) to its language's reference exceeds a
limit, or when the base rules fail. Length guards: the character test needs MIN_CHARS
characters in words, the word test MIN_WORDS words; shorter texts pass that test.

Languages outside COMMON_WORDS, and null, share one reference of their own with the
joint list, so there are len(COMMON_WORDS) + 1 references whatever the input's size.

Defined results: a null text has no words and fails the base rules, as does an empty
one; repeated rows and ids are judged each on its own; an empty table gives an empty
result; other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "at", "this", "by", "from", "an"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "est", "que", "dans", "qui", "par", "pour", "au", "sur", "ce", "pas"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
OTHER = "other"
OTHER_WORDS = ["the", "of", "and", "de", "la", "le", "que", "en", "der", "die", "und", "in", "el", "y", "los", "se", "les", "des", "to", "is"]
MIN_CHARS, MIN_WORDS = 200, 80
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.45


def language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


#: Upper-case letters, digits, punctuation, other ASCII symbols, and characters beyond ASCII.
CHAR_CLASSES = ("A-Z", "0-9", ".,;:'\"!?()\\-", "@#*$%&|<>+=/\\\\_~^`{}\\[\\]", "^\\x00-\\x7F")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a text lie in a regular expression's class; runs of others go at once."""
    others = chars[1:] if chars[0] == "^" else f"^{chars}"
    return F.length(F.regexp_replace(text, f"[{others}]+", ""))


def char_shares(n_chars: Column, counts: list[Column]) -> Column:
    """The classes' shares of all characters, and (last) that of the rest, mostly lower-case ASCII."""
    rest = reduce(lambda a, c: a - c, counts, n_chars)
    return F.array(*(F.when(n_chars > 0, c / n_chars).otherwise(F.lit(0.0)) for c in [*counts, rest]))


def word_shares(words: Column, lang: Column) -> Column:
    """The share of each common word of the language among the words, and (last) of all others."""

    def counted(listed: list[str]) -> Column:
        found = F.filter(words, lambda w: w.isin(*listed))
        # bound once: the words found, each between two spaces of its own, and their number
        pair = F.array(F.struct(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")).alias("s"), F.size(words).alias("n")))
        counts = F.transform(pair, lambda p: F.transform(
            F.array(*map(F.lit, listed)),
            lambda w: (F.length(p["s"]) - F.length(F.replace(p["s"], F.concat(F.lit(" "), w, F.lit(" "))))) / (F.length(w) + 2) / F.greatest(p["n"], F.lit(1)),
        ))
        return F.element_at(F.transform(counts, lambda c: F.concat(c, F.array(F.aggregate(c, F.lit(1.0), lambda a, x: a - x)))), 1)

    return reduce(lambda rest, l: F.when(lang == l, counted(COMMON_WORDS[l])).otherwise(rest), COMMON_WORDS, counted(OTHER_WORDS))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two lists of shares; 0 if either is all zero."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    empty = ~F.exists(p, lambda x: x > 0) | ~F.exists(q, lambda x: x > 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, c: a + c) / 2, F.lit(0.0))))


#: Words that lie in a 3-word window whose words stand twice or more in the text; w: the words.
#: Each window is packed as hash bits above its position (b bits); after a sort of plain longs,
#: equal windows are neighbours. Neighbours with equal hash bits are compared word by word, so a
#: collision makes no repeat. Each repeated window adds the words that the one before has not.
_REPEATS = """
CASE WHEN size(w) < 4 THEN 0L ELSE
aggregate(
  transform(array(CAST(ceil(log2(size(w) + 2.0D)) AS INT)), b ->
    transform(array(sort_array(transform(sequence(0, size(w) - 3),
        i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b) | i))), s ->
      array_sort(array_distinct(flatten(transform(filter(transform(
        filter(sequence(1, size(s) - 1), k -> shiftrightunsigned(get(s, k) ^ get(s, k - 1), b) = 0L),
        k -> array(CAST(get(s, k - 1) & (shiftleft(1L, b) - 1) AS INT), CAST(get(s, k) & (shiftleft(1L, b) - 1) AS INT))),
        p -> get(w, p[0]) = get(w, p[1]) AND get(w, p[0] + 1) = get(w, p[1] + 1) AND get(w, p[0] + 2) = get(w, p[1] + 2)),
        p -> p)))))[0])[0],
  named_struct('last', -3, 'n', 0L),
  (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)),
  a -> a.n) END
"""


def with_features(df: DataFrame) -> DataFrame:
    """df with the base counts and both histograms (as shares) of each text; columns start with `__`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda l: F.btrim(l, F.lit(" \t\x0b\x0c\r")) != "")
    return (
        df.withColumn("__text", text)
        .withColumn("__w", common.words_of(F.col("__text")))
        .withColumn("__lang", language(F.col("lang")))
        .withColumn("__n_words", F.size("__w").cast("long"))
        .withColumn("__word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("__n_symbols", count_of(F.col("__text"), "#*$%&|<>").cast("long"))
        .withColumn("__lines", lines)
        .withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__n_repeat_words", F.expr(_REPEATS.replace("(w", "(__w").replace("size(w)", "size(__w)")))
        .withColumns({f"__c{i}": count_of(F.col("__text"), c) for i, c in enumerate(CHAR_CLASSES)})
        .withColumn("__n_chars", F.length("__text"))
        .withColumn("__chars", char_shares(F.col("__n_chars"), [*(F.col(f"__c{i}") for i in range(len(CHAR_CLASSES))), F.col("__n_chars") - F.col("__word_chars")]))
        .withColumn("__words", word_shares(F.col("__w"), F.col("__lang")))
    )


def references(df: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language, the mean of both histograms over all its texts of MIN_WORDS words or more.

    Each text counts by its shares, so that long texts do not outweigh others. The
    result has len(COMMON_WORDS) + 1 rows at most.
    """
    featured = with_features(df).filter(F.col("__n_words") >= MIN_WORDS)
    bins = [("__chars", len(CHAR_CLASSES) + 2), ("__words", len(OTHER_WORDS) + 1)]
    means = [F.round(F.avg(F.element_at(c, i + 1)), 9).alias(f"{c}{i}") for c, k in bins for i in range(k)]
    return {r["__lang"]: tuple([float(r[f"{c}{i}"]) for i in range(k)] for c, k in bins) for r in featured.groupBy("__lang").agg(*means).collect()}


def with_verdicts(df: DataFrame) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance and kept."""
    known = references(df)

    def reference(i: int) -> Column:
        return reduce(
            lambda rest, l: F.when(F.col("__lang") == l, F.array(*map(F.lit, known[l][i]))).otherwise(rest),
            known, F.array().cast("array<double>"),
        )

    # helper columns start with `__`; an input column that does too goes under another name meanwhile
    held = {c: f"own{i}:{c}" for i, c in enumerate(df.columns) if c.startswith("__")}
    df = df.withColumnsRenamed(held)
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [c for c in df.columns if c not in (*results, "base_failed", "char_distance", "word_distance", "kept")]
    featured = with_features(df)
    judged = featured.select(
        *(f"`{c}`" for c in own), *(F.col(f"__{c}").alias(c) for c in results),
        F.when(F.col("__word_chars") >= MIN_CHARS, F.round(js_distance(F.col("__chars"), reference(0)), 9)).otherwise(0.0).alias("char_distance"),
        F.when(F.col("__n_words") >= MIN_WORDS, F.round(js_distance(F.col("__words"), reference(1)), 9)).otherwise(0.0).alias("word_distance"),
        # a filter on the verdict must not move below this projection: it would evaluate every feature many times over
        F.monotonically_increasing_id().alias("__row"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", (F.col("__row") >= 0) & ~F.col("base_failed") & (F.col("char_distance") <= MOST_CHAR_DISTANCE) & (F.col("word_distance") <= MOST_WORD_DISTANCE)
    ).drop("__row").withColumnsRenamed({v: k for k, v in held.items()})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return with_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
