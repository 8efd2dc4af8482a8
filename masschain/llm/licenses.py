"""Op 10: licence scans.

One Aho-Corasick automaton finds the notice phrases and identifier names among a text's
words, joined by single spaces; words are runs of letters and digits, lower-cased. After
an identifier tag, the licence expression is read from the text itself by a shunting-yard
parser, with `with` binding before `and`, and `and` before `or`.

Score, from 0 (no licence) to 1 (permissive): a label has a fixed value; `or` takes the
better of both sides, `and` the worse, `with` the mean of its licence and 1; a text's
score is the least over all its findings, but for a phrase inside a longer one (such as
the general public license in the lesser). An expression ends before a word that cannot
go on with it, so prose may follow. A malformed one (two operators, one without its
second licence, an open bracket) grants nothing: its licences keep their labels, with
`unknown`, and it scores 0.

Defined results: null and empty texts have no words and score 0; rows stand each for
itself, repeated ones and null ids included; columns named like the results are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Notice phrases (as words) and their labels. The first three are the base.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
PHRASES = {
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by 4": "cc-by", "cc by 3": "cc-by", "cc0": "cc0",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "isc license": "isc", "public domain": "public-domain", "all rights reserved": "reserved",
    "creative commons attribution": "cc-by", "eclipse public license": "epl", "unlicense": "public-domain",
}
#: Start of an identifier in an expression, and its label.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "epl": "epl",
    "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "unlicense": "public-domain",
}
#: How free a label leaves its users.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.05,
}
TAG = "spdx license identifier"

_UPPER = str.maketrans(common.UPPER, common.LOWER)
_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKENS = re.compile(r"\(|\)|[a-z0-9.+\-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str | None:
    """The label of the longest known start of an identifier."""
    for i in range(len(identifier), 1, -1):
        if identifier[:i] in IDENTIFIERS and (i == len(identifier) or not identifier[i].isalpha()):
            return IDENTIFIERS[identifier[:i]]
    return None


def evaluate(expression: str) -> tuple[float, set[str]] | None:
    """Score and labels of the licence expression that a (lower-case) text starts with; None if there is none."""
    values: list[tuple[float, set[str]]] = []
    operators: list[str] = []
    named: set[str] = set()

    def reduce_top() -> None:
        op = operators.pop()
        (b, right), (a, left) = values.pop(), values.pop()
        values.append(({"or": max(a, b), "and": min(a, b), "with": (a + 1) / 2}[op], left | right))

    operand_next = True
    for token in _TOKENS.findall(expression):
        if token in _BINDS:
            if operand_next:
                break
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[token]:
                reduce_top()
            operators.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            operators.append(token)
        elif token == ")":
            if operand_next or "(" not in operators:
                break
            while operators[-1] != "(":
                reduce_top()
            operators.pop()
        elif operand_next:
            label = label_of(token.rstrip(".,;"))
            named |= {label} if label else set()
            values.append((FREEDOM[label], {label}) if label else (0.0, set()))
            operand_next = False
        else:
            break
    if not named:
        return None
    if operand_next or "(" in operators:
        # what is left of it is read for its names alone
        later = (label_of(t.rstrip(".,;")) for t in _TOKENS.findall(expression) if t not in _BINDS and t not in "()")
        return 0.0, {x for x in later if x} | {"unknown"}
    while operators:
        reduce_top()
    return values[0]


def automaton() -> ahocorasick.Automaton:
    """Finds all phrases as whole words in ' word word ' text."""
    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | PHRASES).items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.add_word(f" {TAG} ", (TAG, None))
    found.make_automaton()
    return found


def scan(text: str | None, finder) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    lowered = (text or "").translate(_UPPER) if not (text or "").isascii() else (text or "").lower()
    words = _WORDS.findall(lowered)
    joined = f" {' '.join(words)} "
    starts, base, labels, scores, spans = [], set(), set(), [], []
    tagged = False
    counted = words_before = 0  # spaces of the text up to there
    for end, (phrase, label) in finder.iter(joined):
        begin = end - len(phrase) - 1
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE_PHRASES:
            words_before += joined.count(" ", counted, begin) if begin >= counted else -joined.count(" ", begin, counted)
            counted = begin
            starts.append(words_before)
            base.add(label)
        labels.add(label)
        spans.append((begin, -end, label))
    furthest = -1
    for _, end, label in sorted(spans):
        if -end > furthest:
            scores.append(FREEDOM[label])
            furthest = -end
    if tagged:
        for expression in _TAGGED.findall(lowered):
            if (value := evaluate(expression)) is not None:
                scores.append(value[0])
                labels |= value[1]
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0),
    )


def _scan(batches):
    finder = automaton()
    results = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    for batch in common.slices(batches, "text"):
        found = list(zip(*(scan(t, finder) for t in batch.column("text").to_pylist()), strict=True)) or [[]] * 7
        names = [*batch.schema.names, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, t) for f, t in zip(found, results, strict=True))], names=names)


def scanned(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scan, f"{fields}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
