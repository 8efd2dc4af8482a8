"""Op 11: language identification by compression with per-language zstandard dictionaries.

Each learned language has a raw-content dictionary: pieces of its training texts. A text is
encoded with every dictionary, in blocks of BLOCK bytes of its lower-cased words so that the dictionary counts in all
of a long text, and the language of the fewest bytes is predicted. The score is the part of what
that dictionary saves against none that the runner-up does not save: 0 for a tie. A
prediction whose margin is narrow is rejected: `lang_accepted` is then `und`, while lang_pred still names the best.

Dictionaries are learned from a bounded sample, and this is the only sample: at most MOST_LANGUAGES
languages, those of the most training rows; of each about MOST_ROWS training rows, by a hash of the id; of those the PIECES distinct pieces
of the smallest hashes, wherever they stand in the text. All texts are predicted whole.

Defined results: a text that is null or holds no letter is `und`, score 0, rejected; languages tie to the one with more
training rows, then by name; with one language learned the text without a dictionary is the runner-up; with none
all texts are `und`; texts without words are not learned from; rows that repeat and null ids are predicted each;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MOST_LANGUAGES, MOST_ROWS = 64, 4000
PIECES, PIECE = 256, 256  # of so many characters
BLOCK, LEVEL = 4096, 6
NARROW, FEW_BYTES = 0.01, 3  # a margin below this share of the size, or of fewer bytes, is narrow
UNKNOWN = "und"
HELD_OUT = 2


def training_pieces(train: DataFrame) -> list[tuple[str, list[str]]]:
    """(language, pieces) of rows (doc_id, text, lang), by falling number of rows."""
    with_words = train.filter(F.col("lang").isNotNull() & (F.trim(F.col("text")) != ""))
    counted = with_words.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counted:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(v) for r in counted for v in (r["lang"], MOST_ROWS / r["count"])))
    sample = with_words.filter(draw < share[F.col("lang")])
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(PIECE))
    cut = sample.select("lang", F.explode(F.transform(starts, lambda i: F.substring("text", i, F.lit(PIECE)))).alias("piece"))
    each = cut.groupBy("lang", "piece").agg(F.xxhash64("piece").alias("h")).filter(F.trim("piece") != "")
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).filter(F.col("rank") <= PIECES)
    found: dict[str, list[tuple[int, str]]] = {r["lang"]: [] for r in counted}
    for r in first.collect():  # MOST_LANGUAGES * PIECES short pieces at most
        found[r["lang"]].append((r["rank"], r["piece"]))
    return [(lang, [piece for _, piece in sorted(pieces)]) for lang, pieces in found.items() if pieces]


def plain_bytes(text: str) -> bytes:
    """What is compressed: lower-cased words with single spaces."""
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


class Encoders:
    """Compressed sizes of a text under each dictionary and, last, under none."""

    def __init__(self, pieces: list[tuple[str, list[str]]], level: int = LEVEL):
        self.languages = [lang for lang, _ in pieces]
        shape = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
        parameters = zstandard.ZstdCompressionParameters.from_level(level, **shape)
        self.encoders = []
        for _, texts in pieces:
            content = b" ".join(map(plain_bytes, texts))
            dictionary = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        self.encoders.append(zstandard.ZstdCompressor(compression_params=parameters))

    def sizes(self, text: str) -> list[int]:
        data = plain_bytes(text)
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(encoder.compress(block)) for block in blocks) for encoder in self.encoders]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is narrow."""
        *sizes, plain = self.sizes(text)
        ranked = sorted(range(len(sizes)), key=sizes.__getitem__)  # stable: ties to the earlier language
        best = sizes[ranked[0]]
        second = sizes[ranked[1]] if len(sizes) > 1 else plain
        margin = max(second - best, 0)
        score = min(margin / (plain - best), 1.0) if plain > best else 0.0
        return self.languages[ranked[0]], score, margin < max(FEW_BYTES, NARROW * best)


def identify(docs: DataFrame, pieces: list[tuple[str, list[str]]]) -> DataFrame:
    """Prediction for each row (doc_id, text) under the dictionaries of these pieces."""
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, lang_accepted string, rejected boolean"

    def run(batches):
        encoders = Encoders(pieces)
        for batch in common.slices(batches, "text"):
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
            known = (encoders.predict(t) if some and encoders.languages else (UNKNOWN, 0.0, True) for t, some in zip(text.to_pylist(), lettered))
            language, score, narrow = zip(*known)
            accepted = [UNKNOWN if far else lang for lang, far in zip(language, narrow)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(language, pa.string()),
                 "score": pa.array(score, pa.float64()), "lang_accepted": pa.array(accepted, pa.string()), "rejected": pa.array(narrow, pa.bool_())}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.remainder(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """Language of each document, learned from those of the other splits; see the module for what is defined."""
    train = docs.filter(common.remainder(F.col("doc_id"), 4) != HELD_OUT).select("doc_id", "text", "lang")
    return identify(docs, training_pieces(train))


def op11_compressed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(common.documents(spark, sf_dir))
