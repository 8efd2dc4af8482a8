"""Adding a source to a served view: what is new, which classes it touches, and a refresh of those alone.

Statements (line items) and the view (leaf_mean over them) are keyed stores in buckets (store.py). Adding keeps
statements that the store does not hold yet, finds the slices of their wholes, derives these from the
store's orders in them alone (a semi-join below the path), and replaces their rows in the view's buckets; other
buckets of either store are not read or written. The outcome is the view of a full derive, which the
registered check computes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.operators import graph
from masschain.plans import shared, tables

from .store import Store

STATEMENT = ["l_returnflag", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"]
LATE = "l_shipdate >= TIMESTAMP '2001-04-01 00:00:00'"  # the registered source: statements shipped late
SLICE = ["product_class", "yr"]
_VIEW = "SELECT product_class, product_parent, yr, element_class, amount FROM leaf_mean"


def view_of(spark: SparkSession, sf_dir: str, lineitem: DataFrame) -> DataFrame:
    """leaf_mean over the line items given."""
    return tables.run(spark, sf_dir, tables.with_ctes(_VIEW), lineitem=lineitem)


def new_statements(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of batch that store does not hold; equal rows of one batch count once. Nulls are equal to nulls."""
    held = store.select(*(F.col(c).alias(f"held_{c}") for c in STATEMENT))
    same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in STATEMENT]
    return batch.dropDuplicates(STATEMENT).join(held, same, "left_anti")


def changed_slices(spark: SparkSession, sf_dir: str, new: DataFrame) -> DataFrame:
    """The leaf slices (product_class, product_parent, yr) of the wholes of new statements; computed once, a row for each."""
    shared.checkpoint_folder(spark)
    return tables.run(spark, sf_dir, tables.with_ctes("SELECT DISTINCT p.product_class, p.product_parent, p.yr FROM placed p JOIN added a ON p.ord = a.l_orderkey"), added=new.select("l_orderkey").distinct()).checkpoint()


def affected(changed: DataFrame, subclass: DataFrame) -> DataFrame:
    """changed classes (class) and all that are averaged from them over subclass edges (child, parent), of any depth."""
    above = graph.closure_with_depth(subclass.select("child", "parent"))
    return changed.union(above.join(changed, F.col("descendant") == F.col("class"), "left_semi").select("ancestor")).distinct()


def derived_slices(spark: SparkSession, sf_dir: str, store: DataFrame, changed: DataFrame) -> DataFrame:
    """leaf_mean of the changed slices, from the orders in them alone."""
    inside = tables.run(spark, sf_dir, tables.with_ctes("SELECT p.ord FROM placed p JOIN changed c ON p.product_class = c.product_class AND p.yr = c.yr"), changed=changed)
    return view_of(spark, sf_dir, store.join(inside, store["l_orderkey"] == inside["ord"], "left_semi"))


VIEW_SCHEMA = "product_class string, product_parent string, yr int, element_class string, amount double"


def statements_at(root: str, lines: DataFrame, buckets: int = 64) -> Store:
    return Store(root, tuple(STATEMENT), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema), buckets)


def view_at(root: str, buckets: int = 64) -> Store:
    return Store(root, tuple(SLICE), VIEW_SCHEMA, buckets)


def add(spark: SparkSession, sf_dir: str, statements: Store, view: Store, batch: DataFrame, batch_id: str | None = None) -> dict:
    """Adds a source's statements to both stores; what is new, its conflicts, the slices changed, and the buckets read and written.

    A conflict is another quantity for a known whole and part. A batch whose id is recorded changes nothing; one that was
    interrupted between the stores changes the view when it comes again.
    """
    shared.checkpoint_folder(spark)
    before = statements.version(spark)
    added = statements.add(batch, batch_id)
    # a batch that the statements hold and the view does not was interrupted: its slices are derived again
    new = added.new if added.new is not None else batch.filter(F.lit(not view.holds(spark, batch_id)))
    changed = changed_slices(spark, sf_dir, new)
    pair = ["l_orderkey", "l_suppkey", "l_partkey"]
    held = statements.read(spark, before).select(*pair, F.col("l_quantity").alias("held"))
    conflicts = new.select(*pair, "l_quantity").join(held, pair).filter("l_quantity <> held").select(*pair).distinct().count() if before else 0
    spliced = view.replace(changed, derived_slices(spark, sf_dir, statements.read(spark), changed).checkpoint(), batch_id)
    return {"new": added.rows, "conflicts": conflicts, "changed": changed, "statements": added, "view": spliced}


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = tables.read(spark, sf_dir, "lineitem")
    late = F.coalesce(F.expr(LATE), F.lit(False))
    return lines.filter(~late), lines.filter(late)


def _rounded(view: DataFrame) -> DataFrame:
    return view.select("product_class", "yr", "element_class", F.round("amount", 9).alias("amount"))


def _added(spark: SparkSession, sf_dir: str) -> tuple[Store, Store, dict]:
    """Both stores after the early statements and then the late ones were added."""
    early, late = _split(spark, sf_dir)
    statements, view = statements_at(shared.new_path(spark, "statements"), early, 16), view_at(shared.new_path(spark, "view-store"), 16)
    add(spark, sf_dir, statements, view, early, "early")
    return statements, view, add(spark, sf_dir, statements, view, late, "late")


def refresh_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, view, _ = _added(spark, sf_dir)
    return _rounded(view.read(spark))


def derive_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batch = _split(spark, sf_dir)
    new = new_statements(store, batch)
    return _rounded(derived_slices(spark, sf_dir, store.unionByName(new), changed_slices(spark, sf_dir, new)))


def changed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batch = _split(spark, sf_dir)
    return changed_slices(spark, sf_dir, new_statements(store, batch)).select("product_class", "yr")


def affected_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batch = _split(spark, sf_dir)
    changed = changed_slices(spark, sf_dir, new_statements(store, batch)).select(F.concat("product_class", F.lit("_Y"), F.col("yr").cast("string")).alias("class"))
    return affected(changed, tables.run(spark, sf_dir, tables.with_ctes("SELECT child, parent FROM subclass")))


def readd_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by source after a source has been added twice, under two names."""
    early, late = _split(spark, sf_dir)
    statements = statements_at(shared.new_path(spark, "statements"), early, 16)
    for name, batch in (("early", early), ("late", late), ("late again", late), ("late", late)):
        statements.add(batch, name)
    return statements.read(spark).groupBy(F.col("l_returnflag").alias("source_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("kg"))


def add_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view after adding, which of its slices changed, and how many statements were new and in conflict."""
    _, view, done = _added(spark, sf_dir)
    changed = done["changed"].select(*SLICE).withColumn("hit", F.lit(True))
    return _rounded(view.read(spark)).join(changed, SLICE, "left").select("product_class", "yr", "element_class", "amount", F.coalesce("hit", F.lit(False)).alias("changed"), F.lit(done["new"]).cast("long").alias("n_new"), F.lit(done["conflicts"]).cast("long").alias("n_conflicts"))


def layered_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product masses as the base has them, with an edit layer over it (late statements count double), and with that layer dropped again."""
    lines = tables.read(spark, sf_dir, "lineitem").withColumn("layer", F.lit("base"))
    edits = lines.filter(LATE).withColumn("layer", F.lit("edit"))
    layers = lines.unionByName(edits)
    mass = lambda name, df: df.groupBy(F.col("l_orderkey").alias("ord")).agg(F.sum("l_quantity").alias("mass"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("state"), "ord", "mass", "n")
    return mass("edited", layers).unionByName(mass("reverted", layers.filter("layer <> 'edit'")))


_NEW = f"SELECT DISTINCT p.product_class, p.yr FROM lineitem l JOIN placed p ON l.l_orderkey = p.ord WHERE {LATE}"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "refresh_view": refresh_view, "derive_affected": derive_affected, "changed_classes": changed_classes, "affected_classes": affected_classes,
    "readd_idempotent": readd_idempotent, "add_source": add_source, "layered_edits": layered_edits,
}
ORACLE = {
    "refresh_view": "SELECT product_class, yr, element_class, round(amount, 9) AS amount FROM leaf_mean",
    "derive_affected": f"SELECT m.product_class, m.yr, m.element_class, round(m.amount, 9) AS amount FROM leaf_mean m JOIN ({_NEW}) n ON m.product_class = n.product_class AND m.yr = n.yr",
    "changed_classes": _NEW,
    "affected_classes": f"""WITH RECURSIVE up AS (SELECT concat(product_class, '_Y', CAST(yr AS STRING)) AS class FROM ({_NEW}) n UNION SELECT s.parent FROM up JOIN subclass s ON s.child = up.class) SELECT class FROM up""",
    "readd_idempotent": f"SELECT l_returnflag AS source_id, COUNT(*) AS n, SUM(l_quantity) AS kg FROM (SELECT DISTINCT {', '.join(STATEMENT)} FROM lineitem) d GROUP BY l_returnflag",
    "add_source": f"""SELECT m.product_class, m.yr, m.element_class, round(m.amount, 9) AS amount, n.yr IS NOT NULL AS changed, (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(STATEMENT)} FROM lineitem WHERE {LATE}) d) AS n_new,
        (SELECT COUNT(*) FROM (SELECT DISTINCT a.l_orderkey, a.l_suppkey, a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND a.l_quantity <> b.l_quantity WHERE a.{LATE} AND NOT b.{LATE}) c) AS n_conflicts
        FROM leaf_mean m LEFT JOIN ({_NEW}) n ON m.product_class = n.product_class AND m.yr = n.yr""",
    "layered_edits": f"""SELECT 'edited' AS state, l_orderkey AS ord, SUM(CASE WHEN {LATE} THEN 2 * l_quantity ELSE l_quantity END) AS mass, COUNT(*) + COUNT(CASE WHEN {LATE} THEN 1 END) AS n FROM lineitem GROUP BY l_orderkey
        UNION ALL SELECT 'reverted', l_orderkey, SUM(l_quantity), COUNT(*) FROM lineitem GROUP BY l_orderkey""",
}
