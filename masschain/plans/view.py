"""The served view: what lookups need, derived once and written as tables.

A view belongs to a folder, the state of its files (size and time of each) and the text that
derives it: the first lookup derives the table that it needs, and later ones, of other sessions too,
find it by these in the shared folder (spark.checkpoint.dir) and read it. Rows are ranged and sorted by class, so that a
lookup's filter reaches the files' statistics and reads a part of one. Tables are written aside and
renamed, so what is found is whole. They stay until drop_views().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tables

#: table -> its order; the first column is the one that lookups filter by
ORDER = {
    "leaf_mean": ("product_class", "yr", "element_class"), "item_mass": ("product_class", "yr"), "gated_mean": ("class", "element_class"), "gated_mass": ("class",),
    "closure": ("ancestor", "descendant"), "component_share": ("component_class", "product_class", "yr"), "material_share": ("component_class", "material_class"),
    "scope_amount": ("component_class", "product_class", "element_class"), "scopes": ("product_class", "yr"), "gate": ("parent", "child"),
}

#: The projection above leaf slices, which it takes as given.
ABOVE_LEAVES = {k: v for k, v in tables.CTES.items() if k not in ("leaf_mean", "item_mass", *tables.SERVED_CLASSES)}


def above_leaves(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A query over means above leaf slices, from the served tables of these."""
    text = tables.with_ctes(body, ABOVE_LEAVES)
    names = [t for t in ("leaf_mean", "item_mass", "scopes", "gate") if re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)]
    return tables.run(spark, sf_dir, text, **{t: served(spark, sf_dir, t) for t in names})


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the view, not yet written."""
    if name == "closure":
        from masschain.operators import graph

        return graph.closure_with_depth(tables.run(spark, sf_dir, tables.CTES["taxonomy"][1]))
    if name == "scopes":
        return above_leaves(spark, sf_dir, "SELECT DISTINCT product_class, product_parent, yr FROM item_mass")
    if name == "gate":
        return above_leaves(spark, sf_dir, tables.CTES["gate"][1])
    if name in ("gated_mean", "gated_mass"):
        from masschain.operators import heights

        return (heights.class_means if name == "gated_mean" else heights.class_masses)(spark, sf_dir)
    return tables.run(spark, sf_dir, tables.with_ctes(f"SELECT * FROM {name}"))


def prepare(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> None:
    """Derives and writes those of the tables of tables.PATH_SUMS that are not there yet, from the sums of one pass over the line items."""
    missing = [name for name in names if not shared.exists(spark, f"{path_of(spark, sf_dir, name)}/_SUCCESS")]
    if not missing:
        return
    scratch = shared.new_path(spark, "path-sums")
    every = tables.run(spark, sf_dir, tables.with_ctes(tables.path_sums(missing)))
    every.write.partitionBy("of_table").parquet(scratch)
    for name in missing:
        text = tables.PATH_SUMS[name][1]
        sums = spark.read.schema(every.schema).parquet(scratch).filter(F.col("of_table") == name)
        known = {"n_products": served(spark, sf_dir, "item_mass").select("product_class", "yr", "n")} if "n_products" in text else {}
        _keep(spark, sf_dir, name, tables.run(spark, sf_dir, text, sums=sums, **known))
    shared.delete(spark, scratch)


def write(df: DataFrame, path: str, name: str) -> None:
    first, *rest = ORDER[name]
    df.repartitionByRange(first, *rest).sortWithinPartitions(first, *rest).write.mode("overwrite").parquet(path)


def path_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where the table of the folder as it stands belongs."""
    text = repr(sorted(tables.CTES.items())) + repr(tables.PATH_SUMS) + repr(ORDER[name])
    mark = hashlib.md5("\n".join((shared.qualified(spark, sf_dir), shared.state_of(spark, sf_dir), text)).encode()).hexdigest()
    return f"{shared.root_of(spark)}/views/{name}-{mark}"


def served(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the view; it is derived and written if none is there for the folder's files as they are."""
    path = path_of(spark, sf_dir, name)
    if not shared.exists(spark, f"{path}/_SUCCESS"):
        if name in tables.PATH_SUMS:
            prepare(spark, sf_dir, [name])
        else:
            _keep(spark, sf_dir, name, derived(spark, sf_dir, name))
    return spark.read.parquet(path)


def _keep(spark: SparkSession, sf_dir: str, name: str, made: DataFrame) -> None:
    aside = shared.new_path(spark, f"view-{name}")
    write(made, aside, name)
    if not shared.rename(spark, aside, path_of(spark, sf_dir, name)):  # another session was first
        shared.delete(spark, aside)


def drop_views(spark: SparkSession) -> None:
    """Deletes all views in the shared folder."""
    shared.delete(spark, f"{shared.root_of(spark)}/views")
