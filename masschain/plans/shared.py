"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def root_of(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; local sessions without one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="masschain-"))
    return _own[0]


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoints go to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root_of(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{root_of(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of a folder's files and of the files of tables in it, as one text."""
    path, system = _path(spark, folder)
    seen = []
    for status in system.listStatus(path):
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        seen += [f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in inner]
    return ",".join(sorted(seen))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder; 0 if there is none."""
    found, system = _path(spark, path)
    return system.getContentSummary(found).getLength() if system.exists(found) else 0


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.delete(found, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the URI that files below it start with."""
    found, system = _path(spark, path)
    return system.makeQualified(found).toUri().toString().rstrip("/")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    found, system = _path(spark, path)
    return [status.getPath().getName() for status in system.listStatus(found)] if system.exists(found) else []


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder to a new name; False, and no change, if that is taken."""
    (found, system), (target, _) = _path(spark, path), _path(spark, to)
    if system.exists(target):
        return False
    system.mkdirs(target.getParent())
    return system.rename(found, target)
