"""A keyed store in buckets with a manifest for each version: changes read and write the buckets that they touch.

Rows are hashed into buckets by their keys (nulls are equal to nulls). Data files are never changed: a
version's manifest lists the folders that make up each bucket, and the next version lists others for the buckets that
changed. A manifest is written aside and renamed, so a version is there as a whole or not at all, readers keep the one that they
opened, and of two writers of one version the second fails. Each version records the batch that made
it; a batch that comes again, as after a restart of a stream, changes nothing.

The driver sees the manifest (a row for each folder of a bucket) and the numbers of touched buckets; the former
is bounded by buckets * MOST_PARTS, as a bucket of more folders is written anew as one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.plans import shared

MOST_PARTS = 8
_MANIFEST = "kind string, bucket int, path string, batch string"


@dataclass
class Change:
    """What a change did."""

    version: int
    rows: int = 0
    read: list[int] = field(default_factory=list)
    written: list[int] = field(default_factory=list)
    new: DataFrame | None = None  # the rows that an add put in


@dataclass(frozen=True)
class Store:
    root: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    # --- versions ---

    def version(self, spark: SparkSession) -> int:
        """The newest version; 0 before the first change."""
        return max((int(name.removeprefix("v")) for name in shared.names(spark, f"{self.root}/manifest") if name.startswith("v")), default=0)

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict[int, list[str]]:
        """bucket -> its folders."""
        out: dict[int, list[str]] = {}
        for kind, bucket, path, _ in self._manifest(spark, version):
            if kind == "bucket":
                out.setdefault(bucket, []).append(path)
        return out

    def _manifest(self, spark: SparkSession, version: int | None) -> list:
        version = self.version(spark) if version is None else version
        return [tuple(r) for r in spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v{version}").collect()] if version else []

    def holds(self, spark: SparkSession, batch_id: str | None) -> bool:
        """Whether a version records the batch."""
        return batch_id is not None and batch_id in self._batches(spark)

    def _batches(self, spark: SparkSession) -> set[str]:
        return {batch for kind, _, _, batch in self._manifest(spark, None) if kind == "batch"}

    def _commit(self, spark: SparkSession, version: int, folders: dict[int, list[str]], batches: set[str]) -> None:
        rows = [("bucket", b, p, None) for b, paths in sorted(folders.items()) for p in paths] + [("batch", None, None, b) for b in sorted(batches)]
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(aside)
        if not shared.rename(spark, aside, f"{self.root}/manifest/v{version}"):
            shared.delete(spark, aside)
            raise RuntimeError(f"version {version} was written by another change")

    # --- rows ---

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _open(self, spark: SparkSession, folders: dict[int, list[str]], buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, own in folders.items() if buckets is None or b in buckets for p in own]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self._open(spark, self.manifest(spark, version))

    def _write(self, rows: DataFrame, dealt: bool = False) -> tuple[dict[int, str], int]:
        """Rows written by bucket: folders of the buckets that have some, and their number. Rows that are dealt by key already are written from where they are."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        marked = rows.withColumn("bucket", self.bucket())
        (marked if dealt else marked.repartition("bucket")).write.partitionBy("bucket").parquet(path)
        written = {int(name.removeprefix("bucket=")): f"{path}/{name}" for name in shared.names(rows.sparkSession, path) if name.startswith("bucket=")}
        n = self._open(rows.sparkSession, {b: [p] for b, p in written.items()}).count() if written else 0
        return written, n

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most self.buckets

    def _apart(self, rows: DataFrame, from_: DataFrame) -> DataFrame:
        """rows without those whose keys are among from_'s."""
        held = from_.select(*(F.col(k).alias(f"held_{i}") for i, k in enumerate(self.keys))).withColumn("held_hash", F.xxhash64(*(f"held_{i}" for i in range(len(self.keys)))))
        same = F.xxhash64(*self.keys) == F.col("held_hash")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"held_{i}"))
        return rows.join(held, same, "left_anti")

    # --- changes ---

    def add(self, batch: DataFrame, batch_id: str | None = None) -> Change:
        """Adds the rows whose keys the store does not hold; of rows of equal keys in the batch, one. Only touched buckets are read."""
        spark = batch.sparkSession
        version, done = self.version(spark), self._batches(spark)
        if batch_id is not None and batch_id in done:
            return Change(version)
        folders = self.manifest(spark, version)
        columns = spark.createDataFrame([], self.schema).columns
        rows = batch.select(columns).dropDuplicates(list(self.keys))
        held = [b for b in self._touched(rows) if b in folders]
        written, n = self._write(self._apart(rows, self._open(spark, folders, held)) if held else rows, dealt=True)
        new = self._open(spark, {b: [p] for b, p in written.items()})
        folders = {b: [*folders.get(b, []), *([written[b]] if b in written else [])] for b in {*folders, *written}}
        full = [b for b in written if len(folders[b]) > MOST_PARTS]
        if full:
            merged, _ = self._write(self._open(spark, folders, full))
            folders |= {b: [merged[b]] for b in full}
        self._commit(spark, version + 1, folders, done | ({batch_id} if batch_id is not None else set()))
        return Change(version + 1, n, held, sorted(written), new)

    def replace(self, gone: DataFrame, rows: DataFrame, batch_id: str | None = None) -> Change:
        """Takes out all rows with keys in gone and puts in rows. Buckets that neither touches keep their files."""
        spark = rows.sparkSession
        version, done = self.version(spark), self._batches(spark)
        if batch_id is not None and batch_id in done:
            return Change(version)
        folders = self.manifest(spark, version)
        keys = gone.select(*self.keys).distinct()
        columns = spark.createDataFrame([], self.schema).columns
        touched = self._touched(keys.unionByName(rows.select(*self.keys)))
        held = [b for b in touched if b in folders]
        left = self._apart(self._open(spark, folders, held), keys) if held else spark.createDataFrame([], self.schema)
        written, _ = self._write(left.unionByName(rows.select(columns)))
        kept = {b: paths for b, paths in folders.items() if b not in touched}
        self._commit(spark, version + 1, kept | {b: [p] for b, p in written.items()}, done | ({batch_id} if batch_id is not None else set()))
        return Change(version + 1, 0, held, sorted(written))

    def vacuum(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Deletes versions but the newest `keep`, and data that none of these lists."""
        newest = self.version(spark)
        live: set[str] = set()
        for name in shared.names(spark, f"{self.root}/manifest"):
            n = int(name.removeprefix("v"))
            if n <= newest - keep:
                shared.delete(spark, f"{self.root}/manifest/{name}")
            else:
                live |= {p for paths in self.manifest(spark, n).values() for p in paths}
        gone = []
        for load in shared.names(spark, f"{self.root}/data"):
            for name in shared.names(spark, f"{self.root}/data/{load}"):
                path = f"{self.root}/data/{load}/{name}"
                if name.startswith("bucket=") and path not in live:
                    shared.delete(spark, path)
                    gone.append(path)
        return gone
