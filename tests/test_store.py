"""A keyed store: what changes read and write, versions, repeats, nulls; and a view that follows its statements."""

import pytest
from pyspark.sql import functions as F

from masschain.plans import shared, tables
from masschain.streaming import incremental, sources
from masschain.streaming.store import MOST_PARTS, Store

DATA = "/root/testdata/sf0.001"
SCHEMA = "k string, j int, v double"


@pytest.fixture()
def store(tmp_path):
    return Store(str(tmp_path / "store"), ("k", "j"), SCHEMA, 16)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_adds_keep_what_is_new_once_with_null_keys(spark, store):
    first = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), (None, 1, 3.0), (None, None, 4.0), ("b", None, 5.0)], SCHEMA)
    one = store.add(first)
    assert (one.version, one.rows, one.read) == (1, 4, [])
    again = store.add(first)
    assert again.rows == 0 and again.written == [] and store.read(spark).count() == 4
    more = store.add(spark.createDataFrame([(None, 1, 9.0), ("c", 1, 6.0)], SCHEMA))
    assert more.rows == 1 and store.read(spark).filter("k IS NULL AND j = 1").first()["v"] == 3.0


def test_changes_read_touched_buckets_only(spark, store):
    store.add(spark.createDataFrame([(f"k{i}", i, float(i)) for i in range(400)], SCHEMA))
    before = store.manifest(spark)
    assert len(before) == 16
    one = spark.createDataFrame([("k7", 7, 7.0), ("new", 1, 1.0)], SCHEMA)
    buckets = {r[0] for r in one.select(store.bucket()).collect()}
    done = store.add(one)
    new = spark.createDataFrame([("new", 1, 1.0)], SCHEMA).select(store.bucket()).first()[0]
    assert set(done.read) == buckets and done.written == [new]
    after = store.manifest(spark)
    assert {b for b in before if before[b] != after[b]} == {new} and before[new] == after[new][:-1]
    swapped = store.replace(one.filter("k = 'k7'").select("k", "j"), spark.createDataFrame([("k7", 7, -1.0), ("k7", 7, -2.0)], SCHEMA))
    assert len(swapped.read) == 1 and len(swapped.written) == 1
    assert sorted(r["v"] for r in store.read(spark).filter("k = 'k7'").collect()) == [-2.0, -1.0] and store.read(spark).count() == 402
    last = store.manifest(spark)
    assert all(last[b] == after[b] for b in after if b not in swapped.read)


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = Store(str(tmp_path / "one"), ("k", "j"), SCHEMA, 1)
        rows = [(f"k{i}", i, float(i)) for i in range(400)]
        assert one.add(spark.createDataFrame(rows + rows, SCHEMA)).rows == 400
        assert len(one.read(spark).inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_versions_stay_readable_until_they_are_cleared(spark, store):
    for i in range(3):
        store.add(spark.createDataFrame([("a", i, float(i))], SCHEMA))
    store.replace(store.read(spark).select("k", "j"), spark.createDataFrame([("z", 1, 1.0)], SCHEMA))
    assert [store.read(spark, n).count() for n in (0, 1, 2, 3, 4)] == [0, 1, 2, 3, 1]
    gone = store.vacuum(spark, keep=1)
    assert len(gone) == 3 and store.read(spark).count() == 1 and store.version(spark) == 4
    assert not any(shared.exists(spark, p) for p in gone)


def test_recorded_batches_change_nothing_and_writers_do_not_overwrite_each_other(spark, store, monkeypatch):
    batch = spark.createDataFrame([("a", 1, 1.0)], SCHEMA)
    assert store.add(batch, "one").version == 1 and store.add(batch.withColumn("k", F.lit("b")), "one").version == 1
    assert store.read(spark).count() == 1
    plain = Store.version
    monkeypatch.setattr(Store, "version", lambda self, s: 0)  # a writer that started before the first version was there
    with pytest.raises(RuntimeError, match="another change"):
        store.add(batch.withColumn("k", F.lit("c")))
    monkeypatch.setattr(Store, "version", plain)
    assert store.read(spark).count() == 1


def test_buckets_of_many_parts_are_merged(spark, tmp_path):
    store = Store(str(tmp_path / "store"), ("k", "j"), SCHEMA, 1)
    for i in range(MOST_PARTS + 2):
        store.add(spark.createDataFrame([("a", i, float(i))], SCHEMA))
    assert len(store.manifest(spark)[0]) <= MOST_PARTS and store.read(spark).count() == MOST_PARTS + 2


def test_empty_batches_and_empty_stores(spark, store):
    none = spark.createDataFrame([], SCHEMA)
    assert store.read(spark).count() == 0 and store.add(none).rows == 0 and store.read(spark).count() == 0
    assert store.replace(none.select("k", "j"), none).written == []


def test_statements_with_null_keys_are_added_once(spark, tmp_path):
    lines = tables.read(spark, DATA, "lineitem").limit(20).withColumn("l_suppkey", F.lit(None).cast("long"))
    store = sources.store_at(str(tmp_path / "sources"), lines)
    assert [sources.add_source(lines, store).rows for _ in range(3)] == [lines.select("l_returnflag", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").distinct().count(), 0, 0]


def test_the_view_after_adds_is_that_of_a_full_derive(spark, tmp_path):
    lines = tables.read(spark, DATA, "lineitem")
    parts = [lines.filter("l_orderkey % 10 < 8"), lines.filter("l_orderkey % 10 = 8 AND l_orderkey < 200"), lines.filter("l_orderkey % 10 >= 7")]
    statements, view = incremental.statements_at(str(tmp_path / "s"), lines), incremental.view_at(str(tmp_path / "v"))
    done = [incremental.add(spark, DATA, statements, view, p, str(i)) for i, p in enumerate(parts)]
    plain = lambda df: sorted((r["product_class"], r["yr"], r["element_class"], round(r["amount"], 9)) for r in df.collect())
    whole = incremental.view_of(spark, DATA, parts[0].union(parts[1]).union(parts[2]).distinct())
    assert plain(view.read(spark)) == plain(whole) and statements.read(spark).count() == lines.distinct().count()
    assert 0 < len(done[1]["view"].written) < 64 and 0 < done[1]["changed"].count() <= 40
    slices = done[1]["changed"].select("product_class", "yr").collect()
    untouched = {b for b, p in view.manifest(spark, 1).items() if view.manifest(spark, 2)[b] == p}
    assert len(untouched) >= 64 - len(slices) - 5
    again = incremental.add(spark, DATA, statements, view, parts[1], "1")
    assert again["new"] == 0 and view.version(spark) == 3
    # interrupted after the statements were added: the batch comes again and the view follows
    extra = lines.filter("l_orderkey = 1").withColumn("l_linenumber", F.col("l_linenumber") + 90)
    statements.add(extra, "cut off")
    assert incremental.add(spark, DATA, statements, view, extra, "cut off")["new"] == 0
    assert plain(view.read(spark)) == plain(incremental.view_of(spark, DATA, statements.read(spark)))
