"""From raw documents to encoded training text, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller writes that as
Parquet and hands it, read again, to the next stage. The pipeline's scratch tables are
dropped when the next stage starts, as its result is written by then; those of operators
called elsewhere stay.

All stages but the last return the columns of documents. Columns of another name that
docs may have are dropped by the first stage. Nulls in any column, empty texts, repeated
rows and empty tables have the results that each operator's docstring gives.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.llm import common, mixing, near_dup, pieces, quality_rules, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(stage):
    """The stage with scratch tables of the pipeline's own, which end with the stage after it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_scratch_tables(spark, "pipeline")
        with common.scratch_scope("pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.with_verdicts(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


@staged
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near-duplicate texts (five words, 0.8).

    Texts that share an id are not of one group for that. Rows with a null id stay if
    their group has no other id; of rows that repeat an id and text one stays. Texts
    without words are groups of their own for each id.
    """
    found = near_dup.linked_rows(docs.select("doc_id", "text"), k=5, threshold=80)
    key = F.struct(F.coalesce("doc_id", F.lit(near_dup.UNNAMED)).alias("id"), "row_hash")
    alone = F.when(F.col("comp").isNull(), key)
    rows = found.select("comp", alone.alias("alone"), key.alias("key")).groupBy("comp", "alone", "key").agg(F.count(F.lit(1)).alias("n"))
    kept = common.scratch_table(rows.groupBy("comp", "alone").agg(F.min(F.struct("key", "n")).alias("least")).select("least.key.id", "least.key.row_hash", "least.n"), "kept")
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(near_dup.UNNAMED)).alias("id"), F.xxhash64("text").alias("row_hash"))
    named = keyed.join(kept.filter("n = 1"), ["id", "row_hash"], "left_semi").select(*COLUMNS)
    if kept.filter("n > 1").isEmpty():
        return named
    repeated = keyed.join(kept.filter("n > 1"), ["id", "row_hash"], "left_semi").groupBy("id", "row_hash")
    return named.unionByName(repeated.agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("row")).select("row.*"))


@staged
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings of 200 bytes; a character cut in two becomes U+FFFD."""
    cut = suffix_dedup.without_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNull(), F.lit(None)).when(F.col("n_removed") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept_bytes").cast("string")))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's quota takes it as a whole."""
    copies = mixing.whole_documents(docs.select(*COLUMNS)).filter("times > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


@staged
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return pieces.encoded(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", one_of_each_group),
    ("repeated strings", without_repeats),
    ("source mix", mixed),
    ("pieces", encoded),
]

#: Seeded hashes and piece scores have no DuckDB form; tests hold run() against the five rules in plain Python on a table with planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with common.scratch_scope(f"stage {i}"):
                docs = common.scratch_table(docs, f"stage{i}")
            common.drop_scratch_tables(spark, f"stage {i - 1}")
    return docs
