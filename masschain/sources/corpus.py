"""A corpus of fact files with a catalog that says which files a query needs.

The catalog has a row for each file: rows, the span of its years, and the set of classes that it holds,
with everything above them in the taxonomy, since a query for a class also asks for what is below. A query is routed by
years and classes on that table alone, and only the files found are opened. A file without years answers for any.

The catalog follows its files: those of the same size and digest keep their row, others are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.operators import graph
from masschain.plans import shared, tables

from . import files

ROWS = "source_id string, bucket_lo int, ord long, sup long, prt long, kg double, yr int, class string"
CATALOG = "file_path string, size long, digest string, n long, y0 int, y1 int, classes array<string>"


def write(facts: DataFrame, path: str, width: int = files.BUCKET_YEARS) -> None:
    """facts (source_id, yr, class, ...) in a folder for each source and bucket of years; rows of one class of them stand in one file."""
    placed = facts.withColumn("bucket_lo", (F.floor(F.col("yr") / width) * width).cast("int"))
    placed.repartition("source_id", "bucket_lo", "class").sortWithinPartitions("source_id", "bucket_lo", "class").write.partitionBy("source_id", "bucket_lo").parquet(path)


def digest(spark: SparkSession, path: str, above: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The catalog of the files under path. above: (descendant, ancestor) of the taxonomy; known: an earlier catalog, whose unchanged files are not read."""
    found = files.catalog(spark, path, known)
    fresh = found if known is None else found.filter("NOT reused")
    paths = [r["file_path"] for r in fresh.select("file_path").collect()]  # names of files, which the reader lists anyway
    # files' names are plain in the list and encoded as in URIs beside rows
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = _read(spark, path, paths).select(named.alias("file_path"), "yr", "class")
    by_class = rows.groupBy("file_path", "class").agg(F.count(F.lit(1)).alias("n"), F.min("yr").alias("y0"), F.max("yr").alias("y1")).filter("n > 0")
    ends = by_class.join(above.select(F.col("descendant").alias("class"), "ancestor"), "class", "left").withColumn("ends", F.coalesce("ancestor", "class"))
    classes = ends.groupBy("file_path").agg(F.array_sort(F.array_union(F.collect_set("class"), F.collect_set("ends"))).alias("classes"))
    spans = by_class.groupBy("file_path").agg(F.sum("n").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    same_name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    made = spans.join(classes, "file_path").withColumn("file_path", same_name("file_path"))
    sized = fresh.withColumn("file_path", same_name("file_path")).select("file_path", "size", "digest")
    out = sized.join(made, "file_path", "left").select("file_path", "size", "digest", F.coalesce("n", F.lit(0)).alias("n"), "y0", "y1", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))
    if known is None:
        return out
    kept = found.filter("reused").withColumn("file_path", same_name("file_path")).select("file_path", "size", "digest")
    return out.unionByName(known.join(kept, ["file_path", "size", "digest"], "left_semi").select(out.columns))


def _read(spark: SparkSession, path: str, paths: list[str]) -> DataFrame:
    reader = spark.read.schema(ROWS).option("basePath", path)
    return reader.parquet(*paths) if paths else reader.parquet(path).limit(0)


def routed(catalog: DataFrame, years: list[int] | None = None, classes: list[str] | None = None) -> DataFrame:
    """The rows of the catalog whose files may answer: any of the years in their span (or none known), and any of the classes. None: no condition."""
    if years is not None:
        hit = F.exists(F.array(*map(F.lit, years)) if years else F.array().cast("array<int>"), lambda y: y.between(F.col("y0"), F.col("y1")))
        catalog = catalog.filter(F.col("y0").isNull() | hit)
    if classes is not None:
        catalog = catalog.filter(F.arrays_overlap("classes", F.array(*map(F.lit, classes)).cast("array<string>")))
    return catalog


def query(spark: SparkSession, path: str, catalog: DataFrame, years: list[int] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Rows of the corpus for these years and classes (or what is below them); other files are not opened."""
    paths = [r["file_path"] for r in routed(catalog, years, classes).select("file_path").collect()]
    return _read(spark, path, paths)


# --- registered jobs --------------------------------------------------------------

_FACTS = "SELECT f.source_id, f.ord, f.sup, f.prt, CAST(f.kg AS DOUBLE) AS kg, CASE WHEN f.ord % 31 = 0 THEN NULL ELSE p.yr END AS yr, p.product_class AS class FROM facts f JOIN placed p ON f.ord = p.ord"
YEARS, CLASS = (1995, 1996), "BUILDING"


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """A corpus of the given tables in the shared folder, its catalog, and the taxonomy's closure."""
    from masschain.plans import view

    path = shared.new_path(spark, "corpus-files")
    write(tables.sql_query(_FACTS)(spark, sf_dir), path)
    above = view.served(spark, sf_dir, "closure")
    kept = shared.new_path(spark, "corpus-catalog")
    digest(spark, path, above).write.parquet(kept)
    return path, spark.read.schema(CATALOG).parquet(kept), above


def _of_path(name: str, cast: str = "string"):
    found = F.regexp_extract("file_path", f"{name}=([^/]*)/", 1)
    return F.when(~found.startswith("__HIVE"), found).cast(cast).alias(name)


def catalog_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and bucket: rows, span of years and classes with all above them."""
    _, catalog, _ = _corpus(spark, sf_dir)
    rows = catalog.select(_of_path("source_id"), _of_path("bucket_lo", "int"), "n", "y0", "y1", F.explode("classes").alias("class"), "file_path")
    classes = rows.groupBy("source_id", "bucket_lo").agg(F.array_join(F.array_sort(F.collect_set("class")), "|").alias("classes"))
    spans = rows.dropDuplicates(["file_path"]).groupBy("source_id", "bucket_lo").agg(F.sum("n").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    same = [spans[c].eqNullSafe(classes[c]) for c in ("source_id", "bucket_lo")]
    return spans.join(classes, same[0] & same[1]).select(spans["source_id"], spans["bucket_lo"], "n", "y0", "y1", "classes")


def catalog_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and buckets with a file that may hold a class of these years."""
    _, catalog, _ = _corpus(spark, sf_dir)
    return routed(catalog, list(YEARS), [CLASS]).select(_of_path("source_id"), _of_path("bucket_lo", "int")).distinct()


def routed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass by source of all below a class in these years, from routed files."""
    path, catalog, above = _corpus(spark, sf_dir)
    below = above.filter(F.col("ancestor") == CLASS).select(F.col("descendant").alias("class"))
    rows = query(spark, path, catalog, list(YEARS), [CLASS]).filter(F.col("yr").isin(*YEARS))
    return rows.join(below, "class", "left_semi").groupBy("source_id").agg(F.sum("kg").alias("kg"), F.count(F.lit(1)).alias("n"))


_BUCKETS = f"SELECT source_id, class, yr, CAST(floor(yr / {files.BUCKET_YEARS}.0E0) AS INT) * {files.BUCKET_YEARS} AS bucket_lo FROM ({_FACTS}) f"
QUERIES = {"catalog_digest": catalog_digest, "catalog_route": catalog_route, "routed_query": routed_query}
ORACLE = {
    "catalog_digest": f"""SELECT r.source_id, r.bucket_lo, r.n, r.y0, r.y1, c.classes FROM (SELECT source_id, bucket_lo, COUNT(*) AS n, MIN(yr) AS y0, MAX(yr) AS y1 FROM ({_BUCKETS}) b GROUP BY source_id, bucket_lo) r
        JOIN (SELECT source_id, bucket_lo, string_agg(class, '|' ORDER BY class) AS classes FROM (SELECT source_id, bucket_lo, class FROM ({_BUCKETS}) b UNION SELECT b.source_id, b.bucket_lo, t.ancestor FROM ({_BUCKETS}) b JOIN closure t ON t.descendant = b.class) u GROUP BY source_id, bucket_lo) c
        ON r.source_id = c.source_id AND r.bucket_lo IS NOT DISTINCT FROM c.bucket_lo""",
    "catalog_route": f"SELECT DISTINCT source_id, bucket_lo FROM ({_BUCKETS}) b WHERE class LIKE '{CLASS}/%' AND (bucket_lo IS NULL OR bucket_lo <= {YEARS[1]} AND bucket_lo + {files.BUCKET_YEARS} > {YEARS[0]})",
    "routed_query": f"SELECT source_id, SUM(kg) AS kg, COUNT(*) AS n FROM ({_FACTS}) f WHERE yr BETWEEN {YEARS[0]} AND {YEARS[1]} AND class LIKE '{CLASS}/%' GROUP BY source_id",
}
