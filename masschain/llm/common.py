"""What the training-data operators share: words, byte buffers, hashes and shared scratch tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections import defaultdict
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; this splits between words.
SPLIT = "[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_root: list[str] = []
_open_tables: dict[tuple[str, str], list[str]] = defaultdict(list)  # by session and scope
_scopes = ["operators"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without the setting (as in tests) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="masschain-"))
        spark.sparkContext.setCheckpointDir(_own_root[0])
    return _own_root[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder; survives the loss of executors."""
    shared_root(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch_scope(name: str):
    """Scratch tables written inside belong to this scope."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; it stays until its scope's tables are dropped."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _open_tables[spark.sparkContext.applicationId, _scopes[-1]].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch_tables(spark: SparkSession, scope: str = "operators") -> None:
    """Deletes the scratch tables of this session and scope; for callers that hold no lazy result over them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _open_tables.pop((spark.sparkContext.applicationId, scope), [])
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; empty for null.

    Plain replacements and a split at one character need no regular expressions, which
    are several times slower once a projection holds more than one of them.
    """
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(spaced, " "), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


# --- numpy helpers for tasks -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Spans are hashed by polynomials modulo this prime, at two places chosen at random for each hash.
PRIME = np.uint64((1 << 31) - 1)
_BASES = [int(v) for v in np.random.default_rng(20240817).integers(1 << 20, (1 << 31) - 2, 4)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME but for a multiple of it; below 2^34 for any x, and about 2^31 for x below 2^62."""
    return (x & PRIME) + (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo PRIME for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, int(PRIME))):
            out = np.ones(size, np.uint64)
            known = 1
            while known < size:
                out[known : 2 * known] = out[:known] * np.uint64(pow(b, known, int(PRIME))) % PRIME
                known *= 2
            both.append(out)
        _powers[base] = tuple(both)
    up, down = _powers[base]
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray, second: bool = False) -> list[tuple[int, np.ndarray]]:
    """For span_hash: (base, S) with S[j] - S[i] = the sum of byte values times base^place over data[i:j]. second: another hash, of other bases."""
    values = data.astype(np.uint64) + np.uint64(1)
    out = []
    for base in _BASES[2:] if second else _BASES[:2]:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_folded(values * powers(base, len(data))[0]), out=sums[1:])
        out.append((base, sums))
    return out


def span_hash(sums: list[tuple[int, np.ndarray]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), the same wherever the bytes stand.

    Two unlike spans of n bytes agree at both places with a chance of (n / 2^31)^2 at most, whatever they hold.
    """
    packed = np.zeros(len(start), np.uint64)
    for base, s in sums:
        value = _folded(s[end] - s[start]) % PRIME * powers(base, len(s))[1][start] % PRIME
        packed = (packed << np.uint64(32)) | value
    return mix64(packed)


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(large), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on beside the stages that follow."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column: str, most: int = 1 << 19):
    """Record batches cut so that each holds about `most` bytes of text, one row at least.

    Arrays over a slice take some hundred times its bytes, so small slices bound a task's memory.
    """
    for batch in batches:
        _, offsets = utf8_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer and the row that it belongs to."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
