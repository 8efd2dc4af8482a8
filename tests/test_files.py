"""Fact files, sidecars, ids of sources, and a catalog that keeps files unread."""

import contextlib
import io
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from masschain.sources import corpus, files

FACTS = "source_id string, ord long, sup long, prt long, kg double, yr int, class string"
ABOVE = [("car/small", "car"), ("car/small", "Product"), ("car/big", "car"), ("car/big", "Product"), ("van/any", "van"), ("van/any", "Product")]


@pytest.fixture(scope="module")
def above(spark):
    return spark.createDataFrame(ABOVE, "descendant string, ancestor string")


@pytest.fixture()
def written(spark, tmp_path):
    rows = [("A", i, 1, 1, 1.0 + i, 1990 + i % 6, ("car/small", "car/big", "van/any")[i % 3]) for i in range(60)]
    rows += [("B", i, 1, 1, 0.5, None, "car/small") for i in range(4)] + [("C", 1, 1, 1, 2.0, 2001, None), (None, 2, 1, 1, 3.0, 1991, "boat")]
    path = str(tmp_path / "corpus+of files")
    corpus.write(spark.createDataFrame(rows, FACTS), path)
    return path, rows


def opened(df) -> list[str]:
    return sorted(df.inputFiles())


def test_queries_open_routed_files_only(spark, written, above):
    path, rows = written
    catalog = corpus.digest(spark, path, above).cache()
    every = catalog.collect()
    assert sum(r["n"] for r in every) == len(rows) == corpus.query(spark, path, catalog).count()
    of = {r["file_path"]: r for r in every}
    assert all("Product" in r["classes"] for r in every if {"car/small", "car/big", "van/any"} & set(r["classes"]))
    for years, classes in (([1992], ["car"]), (None, ["van"]), ([1990, 1995], None), ([1991], ["boat"]), ([2001], ["Product"]), (None, None), ([], None), (None, [])):
        want = sorted(p for p, r in of.items() if (years is None or r["y0"] is None or any(r["y0"] <= y <= r["y1"] for y in years)) and (classes is None or set(classes) & set(r["classes"])))
        got = corpus.query(spark, path, catalog, years, classes)
        if want:
            assert [re.sub("^file:/+", "/", unquote(p)) for p in opened(got)] == [re.sub("^file:/+", "/", p) for p in want]
        assert got.count() == sum(of[p]["n"] for p in want)
    assert len(opened(corpus.query(spark, path, catalog, [1992], ["car"]))) < len(every)
    narrow = corpus.query(spark, path, catalog, [1992], ["car"]).filter("yr = 1992 AND class LIKE 'car/%'")
    assert narrow.count() == sum(r[5] == 1992 and r[6] is not None and r[6].startswith("car/") for r in rows)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        narrow.explain("formatted")
    assert "bucket_lo=2000" not in out.getvalue()


def test_the_catalog_reads_changed_files_again_only(spark, written, above, tmp_path, monkeypatch):
    path, rows = written
    kept = str(tmp_path / "kept")
    corpus.digest(spark, path, above).write.parquet(kept)
    known = spark.read.schema(corpus.CATALOG).parquet(kept)
    corpus.write(spark.createDataFrame([("D", 1, 1, 1, 9.0, 1999, "van/any")], FACTS), str(tmp_path / "more"))
    (tmp_path / "more" / "source_id=D").rename(tmp_path / "corpus+of files" / "source_id=D")
    read = []
    plain = corpus._read
    monkeypatch.setattr(corpus, "_read", lambda s, p, paths: read.append(paths) or plain(s, p, paths))
    now = corpus.digest(spark, path, above, known)
    assert now.count() == known.count() + 1 and now.agg(F.sum("n")).first()[0] == len(rows) + 1
    assert len(read) == 1 and len(read[0]) == 1 and "source_id=D" in read[0][0]
    again = str(tmp_path / "again")
    now.write.parquet(again)
    read.clear()
    assert corpus.digest(spark, path, above, spark.read.schema(corpus.CATALOG).parquet(again)).count() == now.count() and read == [[]]


def test_folders_above_facts_may_be_called_after_sidecars(spark, tmp_path):
    root = tmp_path / "after_corrections" / "facts"
    root.mkdir(parents=True)
    header, row = ",".join(files.FACT_COLUMNS), "m-c,a,b,c,d,,1999,5,r"
    for name in ("one.csv", "one_corrections.csv", "corrections.csv"):
        (root / name).write_text(f"{header}\n{row}\n")
    (root / "corrections").mkdir()
    (root / "corrections" / "part-0.csv").write_text(f"{header}\n{row}\n")
    got = files.scan_facts(spark, str(tmp_path / "after_corrections")).collect()
    assert len(got) == 1 and got[0]["file_path"].endswith("/one.csv") and got[0]["value"] == "5"


@pytest.mark.parametrize("name", ["sources", "a+b", "in (brackets)", "50%"])
def test_ids_of_sources_are_their_paths_below_the_folder(spark, tmp_path, name):
    root = tmp_path / name
    for place in (f"x/{name}", "x/shared", "y", f"x/{name.replace('%', '')}2", "z/readme"):
        (root / place).mkdir(parents=True)
        (root / place / "p.csv").write_text("ord,prt,kg\n1,2,3.5\n")
    got = sorted(r["source_id"] for r in files.scan_corpus(spark, str(root)).collect())
    assert len(got) == 5 and got.count("y") == 1 and len([g for g in got if g.startswith("x_")]) == 4 and not any("/" in g for g in got)
