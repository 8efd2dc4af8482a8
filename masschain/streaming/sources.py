"""Sources that arrive one by one, as a stream of files into a keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import shared

from .store import Change, Store

KEY = ("source_id", "ord", "sup", "prt", "line", "kg")


def store_at(root: str, lines: DataFrame, buckets: int = 64) -> Store:
    kinds = {f.name: f.dataType.simpleString() for f in _statements(lines).schema}
    return Store(root, KEY, ", ".join(f"{k} {v}" for k, v in kinds.items()), buckets)


def _statements(lines: DataFrame) -> DataFrame:
    names = dict(zip(("l_returnflag", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity"), KEY, strict=True))
    return lines.select(*(F.col(c).alias(k) for c, k in names.items()))


def add_source(batch: DataFrame, store: Store, batch_id: str | None = None) -> Change:
    """Adds the batch's statements that the store does not hold yet. Adding one again changes nothing, with null keys as well."""
    return store.add(_statements(batch), batch_id)


def add_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and mass by source after all files of line items have streamed in, a file a batch."""
    path = f"{sf_dir}/lineitem.parquet"
    lines = spark.read.parquet(path)
    store = store_at(shared.new_path(spark, "sources"), lines)
    # as a pattern, since a stream's plain path must be a folder, and the table may be one file
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{path[:-1]}[{path[-1]}]")
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: add_source(batch, store, f"batch {n}"))
        .option("checkpointLocation", shared.new_path(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return store.read(spark).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("kg").alias("kg"))


QUERIES = {"add_sources": add_sources}
ORACLE = {
    "add_sources": "SELECT source_id, COUNT(*) AS n, SUM(kg) AS kg FROM (SELECT DISTINCT l_returnflag AS source_id, l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity AS kg FROM lineitem) d GROUP BY source_id"
}
