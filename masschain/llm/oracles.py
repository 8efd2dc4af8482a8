"""SQL for another engine (DuckDB) that computes what some operators here return, by definition and without their methods."""

from __future__ import annotations

from . import quality_rules as rules
from . import vector_codes as codes

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = r"[ \t\n\x0b\f\r]+"

#: Links by the sizes of shared and whole sets of 4-word shingles, over all pairs that share one; components by reachability.
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_BLANKS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON a.doc_id = x.doc_id JOIN n y ON b.doc_id = y.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 80 * (x.n + y.n - COUNT(*))),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, MIN(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, coalesce(c.least, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Every window of 200 bytes as hexadecimal text, those that occur twice, and the runs that they cover.
REPEATED_STRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 400) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d) x),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY g) AS k FROM w) x WHERE k > 1),
m AS (SELECT doc_id, i, SUM(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p) x),
s AS (SELECT doc_id, island, MIN(i) AS lo, MAX(i) + 200 AS hi FROM m GROUP BY doc_id, island),
k AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM s UNION ALL SELECT s.doc_id, MAX(s.hi), MAX(length(d.h) // 2) FROM s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id),
t AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (k.b - k.a)), '' ORDER BY k.a) AS h FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id),
c AS (SELECT doc_id, SUM(hi - lo) AS removed, COUNT(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(words: list[str]) -> str:
    return f"[{', '.join(map(_text, words))}]"


def quality() -> str:
    """Counts of words, lines and windows, shares of character classes and common words, references as means by language, and distances to them."""
    counts = [f"length(regexp_replace(t, {_text('[' + (c[1:] if c[0] == '^' else '^' + c) + ']+')}, '', 'g'))" for c in rules.CHAR_CLASSES]
    arms = " ".join(f"WHEN {_text(lang)} THEN {_listed(words)}" for lang, words in rules.COMMON_WORDS.items())
    blank = "concat(' ', chr(9), chr(11), chr(12), chr(13))"
    far = lambda kind: f"""SELECT f.doc_id, sqrt(greatest(SUM(CASE WHEN f.v > 0 THEN f.v * log2(f.v / ((f.v + r.v) / 2)) ELSE 0 END + CASE WHEN r.v > 0 THEN r.v * log2(r.v / ((f.v + r.v) / 2)) ELSE 0 END) / 2, 0)) AS far
        FROM bins f JOIN means r ON f.lang = r.lang AND f.kind = r.kind AND f.k = r.k WHERE f.kind = '{kind}' GROUP BY f.doc_id HAVING MAX(f.v) > 0 AND MAX(r.v) > 0"""  # noqa: E731
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(map(_text, rules.COMMON_WORDS))}) THEN lang ELSE '{rules.OTHER}' END AS lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANKS}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {blank}) <> '') AS lines FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w WHERE len(w) > 2) x),
rep AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) x WHERE k > 1) y GROUP BY doc_id),
base AS (SELECT w.doc_id, w.lang, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(t) AS n_chars, [{', '.join(counts)}, length(t) - length(array_to_string(w.w, ''))] AS counts, list_transform(CASE w.lang {arms} ELSE {_listed(rules.OTHER_WORDS)} END, lambda c: len(list_filter(w.w, lambda x: x = c)) / greatest(len(w.w), 1)) AS listed FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
full_ AS (SELECT *, list_transform(list_append(counts, n_chars - list_sum(counts)), lambda c: CASE WHEN n_chars > 0 THEN c / n_chars ELSE 0.0 END) AS chars, list_append(listed, 1 - list_sum(listed)) AS words FROM base),
bins AS (SELECT doc_id, lang, n_words, 'chars' AS kind, unnest(range(1, len(chars) + 1)) AS k, unnest(chars) AS v FROM full_ UNION ALL SELECT doc_id, lang, n_words, 'words', unnest(range(1, len(words) + 1)), unnest(words) FROM full_),
means AS (SELECT lang, kind, k, round(AVG(v), 9) AS v FROM bins WHERE n_words >= {rules.MIN_WORDS} GROUP BY lang, kind, k),
far AS (SELECT f.*, CASE WHEN word_chars >= {rules.MIN_CHARS} THEN round(coalesce(c.far, 0), 9) ELSE 0.0 END AS char_distance, CASE WHEN n_words >= {rules.MIN_WORDS} THEN round(coalesce(o.far, 0), 9) ELSE 0.0 END AS word_distance,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM full_ f LEFT JOIN ({far('chars')}) c ON c.doc_id = f.doc_id LEFT JOIN ({far('words')}) o ON o.doc_id = f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND char_distance <= {rules.MOST_CHAR_DISTANCE} AND word_distance <= {rules.MOST_WORD_DISTANCE} AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM far"""


def vector_codes_sql() -> str:
    """Integer parts, squared distances to all entries, floors of means, twice; then codes and errors."""
    parts, entries = codes.PARTS, codes.ENTRIES
    distance = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    near = lambda k: f"""n{k} AS (SELECT p.r, p.p, any_value(p.v) AS v, MIN([CAST({distance} AS BIGINT), b.e]) AS m FROM p JOIN b{k} b ON p.p = b.p GROUP BY p.r, p.p)"""
    books = lambda k: f"""s{k} AS (SELECT p, e, i, CAST(floor(CAST(SUM(x) AS DOUBLE) / COUNT(*)) AS BIGINT) AS x FROM (SELECT p, m[2] AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM n{k - 1}) y GROUP BY p, e, i),
b{k} AS (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{k - 1} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM s{k} GROUP BY p, e) s ON b.p = s.p AND b.e = s.e)"""  # noqa: E731
    rounds = "".join(f"{books(k)},\n{near(k)},\n" for k in range(1, codes.ROUNDS + 1))
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {codes.SCALE}) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS v FROM (SELECT r, x, unnest(range({parts})) AS p FROM k) y),
b0 AS (SELECT p, r - 1 AS e, v FROM p WHERE r <= {entries}),
{near(0)},
{rounds}
c AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(SUM(m[1]) AS BIGINT) AS error FROM n{codes.ROUNDS} n JOIN k ON n.r = k.r GROUP BY k.r, k.vec_id, k.label),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM b{codes.ROUNDS}) y)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c, h"""


ORACLE_SQL = {"op13_vector_codes": vector_codes_sql(), "op2_quality_rules": quality(), "op4_repeated_strings": REPEATED_STRINGS, "op5_near_duplicates": NEAR_DUPLICATES}
