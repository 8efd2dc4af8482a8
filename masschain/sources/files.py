"""Files of facts, corrections, sources and run results: scans with fixed schemas, sinks by bucket and source, and a catalog.

Scans take paths; the registered queries write the given tables in these formats to the
session's shared folder first (cells as text, as such files have them), scan that, and
delete it with the session's other scratch folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masschain.plans import shared, tables, view

FACT_COLUMNS = ["parameterCode", "productKeyLevel1", "productKeyLevel2", "componentKeyLevel1", "materialKeyLevel1", "element", "productionYear", "value", "reference"]
FACTS = T.StructType([T.StructField(c, T.StringType()) for c in FACT_COLUMNS])
CORRECTION_COLUMNS = ["comp_key", "mat_key", "dq_validity", "dq_accuracy", "dq_consistency", "dq_integrity", "dq_timeliness", "dq_completeness", "override_dim", "override_value"]
CORRECTIONS = T.StructType([T.StructField(c, T.StringType()) for c in CORRECTION_COLUMNS])
RUNS = "case_id long, status string, conversation array<struct<attempt: int, messages: array<struct<turn: long, role: string, content: string>>>>"
SIDECAR = "corrections"  # files of this token are no facts
RESERVED = ("catalog", "readme")
BUCKET_YEARS = 2


# --- scans ---------------------------------------------------------------------


def scan_facts(spark: SparkSession, path: str, token: str | None = None) -> DataFrame:
    """Rows of all fact files under a path, all cells text, with file_path; a byte order mark before the header is no cell.

    token: only files that have it in their path. Sidecars never count: files whose own name has the
    token, and the files of a table so called. Folders above them may have any name.
    """
    rows = spark.read.schema(FACTS).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).option("recursiveFileLookup", True).csv(path)
    steps = F.split(F.col("_metadata.file_path"), "/")
    own = F.element_at(steps, -1).contains(SIDECAR) | (F.element_at(steps, -2) == SIDECAR)
    rows = rows.withColumn("file_path", F.col("_metadata.file_path")).filter(~own)
    return rows.filter(F.col("file_path").contains(token)) if token else rows


def typed_facts(rows: DataFrame) -> DataFrame:
    """Fact rows with year (0 if absent) and value (null if absent or no number)."""
    number = lambda c: F.expr(f"try_cast(nullif(trim({c}), '') AS DOUBLE)")
    return rows.withColumn("year", F.coalesce(number("productionYear").cast("int"), F.lit(0))).withColumn("kg", number("value"))


def scan_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The key of eight fields and a map {dimension: value}; comment lines and rows with bad numbers are dropped."""
    rows = spark.read.schema(CORRECTIONS).option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    scores = [c for c in CORRECTION_COLUMNS if c.startswith("dq_")]
    numbers = {c: F.expr(f"try_cast({c} AS INT)") for c in (*scores, "override_value")}
    good = rows.withColumns(numbers)
    for c in (*CORRECTION_COLUMNS[:2], *scores, "override_dim", "override_value"):
        good = good.filter(F.col(c).isNotNull())
    key = CORRECTION_COLUMNS[:8]
    # of several values for a dimension the largest counts
    by_dim = good.groupBy(*key, "override_dim").agg(F.max("override_value").alias("value"))
    return by_dim.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("override_dim", "value")))).alias("overrides"))


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (source_id, ord, prt, kg) of every source under a folder; rows of a `shared` file join all sources beside it.

    A source's id is its path below the folder with `_` for `/`. Reserved names are skipped.
    """
    rows = spark.read.schema("ord long, prt long, kg double").option("recursiveFileLookup", True).option("header", True).csv(folder)
    # both are URIs, the folder's without a trailing slash; a local one may have one slash or three after its scheme
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    below = F.substring(plain(F.col("_metadata.file_path")), F.length(plain(F.lit(shared.qualified(spark, folder)))) + 2, F.lit(1 << 30))
    rows = rows.select("ord", "prt", "kg", F.regexp_replace(below, "/[^/]*$", "").alias("place"))
    rows = rows.filter(~F.element_at(F.split("place", "/"), -1).isin(*RESERVED))
    parent = F.regexp_replace("place", "/?[^/]*$", "")
    is_shared = F.element_at(F.split("place", "/"), -1) == "shared"
    own = rows.filter(~is_shared).select(F.translate("place", "/", "_").alias("source_id"), parent.alias("parent"), "ord", "prt", "kg")
    common = rows.filter(is_shared).select(parent.alias("parent"), "ord", "prt", "kg")
    layered = own.select("source_id", "parent").distinct().join(common, "parent").select("source_id", "ord", "prt", "kg")
    return own.select("source_id", "ord", "prt", "kg").unionByName(layered)


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """Messages (case_id, attempt, turn, role, content) of finished runs from nested JSON results."""
    runs = spark.read.schema(RUNS).json(path).filter("status <> 'running' AND conversation IS NOT NULL")
    attempts = runs.select("case_id", F.explode("conversation").alias("c"))
    return attempts.select("case_id", "c.attempt", F.explode("c.messages").alias("m")).select("case_id", "attempt", "m.turn", "m.role", "m.content")


# --- sinks ----------------------------------------------------------------------


def sink_year_buckets(facts: DataFrame, invariant: DataFrame, path: str, width: int = BUCKET_YEARS, years: tuple[int, int] = (1980, 2050)) -> None:
    """Facts (with yr) in one partition for each bucket of years, those outside the window not at all; the invariant layer once, beside them."""
    inside = facts.filter(F.col("yr").between(*years)).withColumn("bucket_lo", (F.floor(F.col("yr") / width) * width).cast("int"))
    inside.repartition("bucket_lo", F.pmod(F.xxhash64("ord"), F.lit(16))).write.mode("overwrite").partitionBy("bucket_lo").parquet(f"{path}/buckets")
    invariant.write.mode("overwrite").parquet(f"{path}/invariant")


def catalog(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(file_path, size, digest, reused): every file under a path; what `known` has with the same size and digest is marked as reused.

    Contents pass through executors one file at a time; a file holds less than 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.sha1("content").alias("digest"))
    if known is None:
        return found.withColumn("reused", F.lit(False))
    same = known.select("file_path", "size", "digest").withColumn("held", F.lit(True))
    return found.join(same, ["file_path", "size", "digest"], "left").select("file_path", "size", "digest", F.coalesce("held", F.lit(False)).alias("reused"))


# --- registered jobs ---------------------------------------------------------------

_CELLS = """SELECT 'm-c' AS parameterCode, p.product_parent AS productKeyLevel1, p.product_class AS productKeyLevel2, concat('sup', CAST(f.sup AS STRING)) AS componentKeyLevel1, concat('part', CAST(f.prt AS STRING)) AS materialKeyLevel1, '' AS element,
    CASE WHEN f.ord % 31 = 0 THEN '' ELSE concat(CAST(p.yr AS STRING), '.0') END AS productionYear, CASE WHEN f.prt % 37 = 0 THEN 'n/a' ELSE CAST(CAST(f.kg AS INT) AS STRING) END AS value, f.source_id AS reference FROM facts f JOIN placed p ON f.ord = p.ord"""


def _fact_files(spark: SparkSession, sf_dir: str) -> str:
    """Fact files by source, a folder for each, and a sidecar beside them."""
    path = shared.new_path(spark, "fact-files")
    cells = tables.sql_query(_CELLS)(spark, sf_dir)
    marked = cells.withColumnRenamed(FACT_COLUMNS[0], f"\ufeff{FACT_COLUMNS[0]}").withColumn("source", F.concat(F.lit("elv_"), "reference"))
    marked.write.option("header", True).option("emptyValue", "").partitionBy("source").csv(f"{path}/facts")
    return path


_CORRECTIONS = """SELECT concat('sup', CAST(sup AS STRING)) AS comp_key, material_class AS mat_key, CAST(q_validity AS STRING) AS dq_validity, CAST(q_accuracy AS STRING) AS dq_accuracy, CAST(q_consistency AS STRING) AS dq_consistency, CAST(q_integrity AS STRING) AS dq_integrity,
    CAST(q_timeliness AS STRING) AS dq_timeliness, CASE WHEN prt % 41 = 0 THEN 'bad' ELSE CAST(q_completeness AS STRING) END AS dq_completeness, CASE WHEN prt % 2 = 0 THEN 'Accuracy' ELSE 'Timeliness' END AS override_dim, CAST(1 + prt % 3 AS STRING) AS override_value FROM mat WHERE q_validity = 1"""


def scan_facts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed_facts(scan_facts(spark, f"{_fact_files(spark, sf_dir)}/facts"))
    return rows.groupBy("parameterCode", "productKeyLevel1", "year").agg(F.count(F.lit(1)).alias("n"), F.count("kg").alias("n_values"), F.sum("kg").alias("kg"))


def scan_facts_by_file_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed_facts(scan_facts(spark, f"{_fact_files(spark, sf_dir)}/facts", "elv_R"))
    return rows.groupBy("reference", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("kg").alias("kg"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared.new_path(spark, 'sidecar')}/{SIDECAR}"
    rows = tables.sql_query(_CORRECTIONS)(spark, sf_dir)
    notes = rows.limit(5).select(F.lit("# a comment").alias("comp_key"), *(F.lit("").alias(c) for c in CORRECTION_COLUMNS[1:]))
    rows.unionByName(notes).write.option("header", True).csv(path)
    found = scan_corrections(spark, path)
    text = F.array_join(F.transform(F.map_entries("overrides"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select(*CORRECTION_COLUMNS[:8], text.alias("overrides"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared.new_path(spark, 'corpus')}/sources"
    facts = tables.sql_query("SELECT ord, prt, kg, source_id FROM facts")(spark, sf_dir)
    for source in "ANR":
        facts.filter(F.col("source_id") == source).drop("source_id").write.option("header", True).csv(f"{path}/region{'12'[source == 'R']}/{source}")
    facts.filter("prt % 10 = 0").drop("source_id").write.option("header", True).csv(f"{path}/region1/shared")
    facts.filter("prt % 10 = 1").drop("source_id").write.option("header", True).csv(f"{path}/region2/readme")
    return scan_corpus(spark, path).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("kg").alias("kg"))


def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "runs")
    turns = tables.read(spark, sf_dir, "conversations")
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    runs = turns.groupBy(F.col("conv_id").alias("case_id")).agg(messages.alias("messages")).select(
        "case_id", F.when(F.col("case_id") % 9 == 0, "running").otherwise("done").alias("status"), F.array(F.struct(F.lit(1).alias("attempt"), "messages")).alias("conversation")
    )
    runs.write.json(path)
    return scan_runs(spark, path).groupBy("case_id", "attempt").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("content")).alias("chars"))


def year_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "buckets")
    facts = tables.sql_query("SELECT f.ord, f.sup, f.prt, f.kg, p.yr FROM facts f JOIN placed p ON f.ord = p.ord")(spark, sf_dir)
    invariant = tables.sql_query("SELECT DISTINCT prt, element_class, elem_best FROM mat")(spark, sf_dir)
    sink_year_buckets(facts, invariant, path, years=(1993, 1997))
    buckets = spark.read.parquet(f"{path}/buckets").groupBy(F.col("bucket_lo").cast("string").alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.sum("kg").alias("total"))
    return buckets.unionByName(spark.read.parquet(f"{path}/invariant").agg(F.lit("invariant").alias("layer"), F.count(F.lit(1)).alias("n"), F.round(F.sum("elem_best"), 4).alias("total")))


def split_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural edges and chemistry written apart, and read again."""
    path = shared.new_path(spark, "layers")
    edges = {"structural": "SELECT ord, sup, CAST(0 AS BIGINT) AS prt, best FROM pc UNION ALL SELECT ord, sup, prt, best FROM cm", "chemistry": "SELECT ord, sup, prt, best FROM me"}
    parts = []
    for layer, text in edges.items():
        tables.sql_query(text)(spark, sf_dir).write.parquet(f"{path}/{layer}")
        parts.append(spark.read.parquet(f"{path}/{layer}").agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n"), F.round(F.sum("best"), 4).alias("total")))
    return parts[0].unionByName(parts[1])


def sink_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole served view written, and the number of rows of each table."""
    view.prepare(spark, sf_dir, list(tables.PATH_SUMS))
    counts = [view.served(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in tables.SERVED]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def per_file_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view for each source file alone: the source leads every key of the derive, and the result is written by source."""
    path = shared.new_path(spark, "views-by-source")
    body = """SELECT source_id, product_class, yr, element_class, SUM(amount) / MIN(n) AS amount FROM (SELECT r.source_id, p.product_class, p.yr, r.element_class, r.amount, COUNT(*) OVER (PARTITION BY r.source_id, p.product_class, p.yr, r.element_class) AS k,
        SUM(r.first) OVER (PARTITION BY r.source_id, p.product_class, p.yr) AS n FROM (SELECT source_id, ord, element_class, SUM(kg * elem_best) / MIN(own) AS amount, CAST(row_number() OVER (PARTITION BY source_id, ord ORDER BY element_class) = 1 AS INT) AS first
        FROM (SELECT source_id, ord, element_class, kg, elem_best, SUM(kg) OVER (PARTITION BY ord, source_id) AS own FROM mat) s GROUP BY source_id, ord, element_class) r JOIN placed p ON r.ord = p.ord) v GROUP BY source_id, product_class, yr, element_class"""
    tables.sql_query(body)(spark, sf_dir).repartition("source_id", "product_class").write.partitionBy("source_id").parquet(path)
    return spark.read.parquet(path).select("source_id", "product_class", "yr", "element_class", F.round("amount", 9).alias("amount"))


def catalog_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by source after one source was written anew: which of them the catalog reuses."""
    path = shared.new_path(spark, "catalog")
    facts = tables.sql_query("SELECT ord, prt, kg, source_id FROM facts")(spark, sf_dir)
    write = lambda df, source: df.filter(F.col("source_id") == source).drop("source_id").write.mode("overwrite").option("header", True).csv(f"{path}/source_{source}")
    for source in "ANR":
        write(facts, source)
    before = _kept(spark, catalog(spark, path))
    write(facts.filter("kg > 1"), "R")
    return catalog(spark, path, before).groupBy(F.regexp_extract("file_path", "source_([A-Z])", 1).alias("source_id")).agg(F.bool_and("reused").alias("reused"))


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = shared.new_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.parquet(path)


_YEAR = "CASE WHEN f.ord % 31 = 0 THEN 0 ELSE p.yr END"
_KG = "CASE WHEN f.prt % 37 = 0 THEN NULL ELSE floor(f.kg) END"
QUERIES = {
    "scan_facts_csv": scan_facts_csv, "scan_facts_by_file_token": scan_facts_by_file_token, "scan_corrections": corrections, "scan_corpus": corpus, "scan_run_json": run_json,
    "sink_year_buckets": year_buckets, "sink_split_layers": split_layers, "sink_view": sink_view, "sink_per_file_view": per_file_view, "catalog_incremental": catalog_incremental,
}
ORACLE = {
    "scan_facts_csv": f"SELECT 'm-c' AS parameterCode, p.product_parent AS productKeyLevel1, {_YEAR} AS year, COUNT(*) AS n, COUNT({_KG}) AS n_values, SUM({_KG}) AS kg FROM facts f JOIN placed p ON f.ord = p.ord GROUP BY p.product_parent, {_YEAR}",
    "scan_facts_by_file_token": f"SELECT f.source_id AS reference, {_YEAR} AS year, COUNT(*) AS n, SUM({_KG}) AS kg FROM facts f JOIN placed p ON f.ord = p.ord WHERE f.source_id = 'R' GROUP BY f.source_id, {_YEAR}",
    "scan_corrections": """SELECT comp_key, mat_key, dq_validity, dq_accuracy, dq_consistency, dq_integrity, dq_timeliness, dq_completeness, string_agg(concat(dim, '=', CAST(value AS VARCHAR)), ',' ORDER BY dim) AS overrides FROM (
        SELECT concat('sup', CAST(sup AS VARCHAR)) AS comp_key, material_class AS mat_key, q_validity AS dq_validity, q_accuracy AS dq_accuracy, q_consistency AS dq_consistency, q_integrity AS dq_integrity, q_timeliness AS dq_timeliness, q_completeness AS dq_completeness,
        CASE WHEN prt % 2 = 0 THEN 'Accuracy' ELSE 'Timeliness' END AS dim, MAX(1 + prt % 3) AS value FROM mat WHERE q_validity = 1 AND prt % 41 <> 0 GROUP BY ALL) c GROUP BY ALL""",
    "scan_corpus": """SELECT source_id, COUNT(*) AS n, SUM(kg) AS kg FROM (SELECT concat(CASE WHEN source_id = 'R' THEN 'region2_' ELSE 'region1_' END, source_id) AS source_id, kg FROM facts
        UNION ALL SELECT s.id, f.kg FROM facts f JOIN (SELECT * FROM (VALUES ('region1_A'), ('region1_N')) AS t(id)) s ON f.prt % 10 = 0) u GROUP BY source_id""",
    "scan_run_json": "SELECT conv_id AS case_id, 1 AS attempt, COUNT(*) AS messages, SUM(length(text)) AS chars FROM conversations WHERE conv_id % 9 <> 0 GROUP BY conv_id",
    "sink_year_buckets": """SELECT CAST(CAST(floor(p.yr / 2.0E0) AS INT) * 2 AS STRING) AS layer, COUNT(*) AS n, SUM(f.kg) AS total FROM facts f JOIN placed p ON f.ord = p.ord WHERE p.yr BETWEEN 1993 AND 1997 GROUP BY 1
        UNION ALL SELECT 'invariant', COUNT(*), round(SUM(elem_best), 4) FROM (SELECT DISTINCT prt, element_class, elem_best FROM mat) m""",
    "sink_split_layers": "SELECT 'structural' AS layer, COUNT(*) AS n, round(SUM(best), 4) AS total FROM (SELECT best FROM pc UNION ALL SELECT best FROM cm) s UNION ALL SELECT 'chemistry', COUNT(*), round(SUM(best), 4) FROM me",
    "sink_view": " UNION ALL ".join(f"SELECT '{name}' AS name, COUNT(*) AS n FROM {name}" for name in tables.SERVED),
    "sink_per_file_view": """SELECT s.source_id, s.product_class, s.yr, s.element_class, round(SUM(s.amount) / MIN(n.n), 9) AS amount FROM (SELECT m.source_id, p.product_class, p.yr, m.element_class, m.ord, SUM(m.kg * m.elem_best / w.mass) AS amount FROM mat m
        JOIN (SELECT source_id, ord, SUM(kg) AS mass FROM facts GROUP BY source_id, ord) w ON m.source_id = w.source_id AND m.ord = w.ord JOIN placed p ON m.ord = p.ord GROUP BY m.source_id, p.product_class, p.yr, m.element_class, m.ord) s
        JOIN (SELECT f.source_id, p.product_class, p.yr, COUNT(DISTINCT f.ord) AS n FROM facts f JOIN placed p ON f.ord = p.ord GROUP BY f.source_id, p.product_class, p.yr) n ON s.source_id = n.source_id AND s.product_class = n.product_class AND s.yr = n.yr GROUP BY s.source_id, s.product_class, s.yr, s.element_class""",
    "catalog_incremental": "SELECT DISTINCT source_id, source_id <> 'R' AS reused FROM facts",
}
