"""Op 4: removal of repeated byte strings by suffix arrays.

A byte goes when it lies in a string of `length` bytes that also starts anywhere else, in
the same text or another. Strings are judged on the input.

1. Every window of `length` bytes is keyed by the smallest hash among its GRAM-byte
   grams. Equal windows have equal keys, and consecutive windows mostly share one, so a
   text becomes few runs of windows: (key, place, hash of the run's bytes).
2. A run can hold a repeated window only if its key occurs in two runs, or if the
   smallest gram changes place within it. All other runs end here, which is an exact
   filter: what is left are the places around repeats.
3. Runs of equal bytes (copies) collapse to one with a count. A key whose runs are all
   copies of one is settled by that: all of it is repeated. Of the others, the bytes of
   each distinct run are fetched once and dealt to shards by key; a key with more than
   SHARD_BYTES of distinct bytes is dealt over several shards.
4. Each shard sorts its suffixes by Larsson-Sadakane refinement in numpy, gets common
   prefixes by Kasai's method, and finds windows with an equal neighbour.
5. For keys dealt over several shards, each shard sends the sorted digests (128 bits) of
   its distinct windows to a merge by ranges of digest, packed in one row a range, so that
   no window is hot: each shard names it once. There each shard's list is looked up in
   the sorted lists of all by binary search.
6. Ranges found go back to all runs, and to one row per text.

Defined results: a null text counts as empty and stays so; rows that repeat an id or a
whole text each count as a place of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 20
RANGE_WINDOWS = 1 << 19  # about so many windows meet in a task of the merge
FIRST_CODES = 7  # codes, of 9 bits each, that the first sort takes at once
_PLACE_BITS = 26  # of the packed (hash, place) values; chunks are cut below 2^26 bytes unless one text is longer


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by running minima from both ends of blocks of w."""
    n = len(values) - w + 1
    padded = np.full(-(-len(values) // w) * w, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one key: row, first window in the row, windows, key, hash of the bytes, and whether the smallest gram moves."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    n = len(data) - length + 1
    if n <= 0:
        return none
    sums = common.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = common.span_hash(sums, at, at + gram)
    bits = np.uint64(max(_PLACE_BITS, int(len(data)).bit_length()))
    packed = (hashes >> bits << bits) | at.astype(np.uint64)
    place = (sliding_min(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = start + length <= offsets[row + 1]
    start, row, place = start[inside], row[inside], place[inside]
    if not len(start):
        return none
    key = hashes[place]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    moves = np.zeros(len(start), bool)
    moves[1:] = ~new[1:] & (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    whole = common.span_hash(sums, begin, begin + count - 1 + length)
    return row[first], begin - offsets[row[first]], count, key[first], whole, np.logical_or.reduceat(moves, first)


def _runs(length: int, gram: int):
    def runs(batches):
        for batch in common.slices(batches, "text"):
            row, begin, count, key, whole, moves = window_runs(*common.utf8_buffer(batch.column("text")), length, gram)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("row_hash").take(take), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(moves)],
                names=["id", "row_hash", "begin", "windows", "key", "run_hash", "moves"],
            )

    return runs


# --- suffix arrays -----------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of an integer string sorted by their first `depth` codes at least, and their ranks.

    Larsson-Sadakane refinement: suffixes are sorted by their first codes, packed into
    one number, then, while groups of equal rank remain, only those groups are sorted by
    the rank of the suffix that starts h further on, with h doubling. A group's rank is
    its last place. Codes lie below 511.
    """
    n = len(codes)
    padded = np.zeros(n + FIRST_CODES - 1, np.uint64)
    padded[:n] = codes + 1
    packed = np.zeros(n, np.uint64)
    for i in range(FIRST_CODES):
        packed = (packed << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(packed)  # those of one group in any order
    ranked = packed[order]
    last = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]), n - 1)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, np.diff(np.append(-1, last)))
    del packed, padded, ranked
    h = FIRST_CODES
    while h < depth:
        group = rank[order]
        size_one = np.ones(n, bool)
        size_one[1:] &= group[1:] != group[:-1]
        size_one[:-1] &= group[1:] != group[:-1]
        open_ = np.flatnonzero(~size_one)
        if not len(open_):
            break
        suffix, own = order[open_], group[open_]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1)
        # groups lie one after another, so one sort by (group, follower) sorts within each
        resorted = np.argsort(own * (n + 1) + follow + 1)
        suffix, follow = suffix[resorted], follow[resorted]
        order[open_] = suffix
        ends = np.append((own[1:] != own[:-1]) | (follow[1:] != follow[:-1]), True)
        stops = np.flatnonzero(ends)
        rank[suffix] = np.repeat(open_[stops], np.diff(np.append(-1, stops)))
        h *= 2
    # suffixes that are equal so far go by place, so that repeats keep one distance along the text
    same = np.flatnonzero(rank[order][1:] == rank[order][:-1])
    tied = np.union1d(same, same + 1)
    order[tied] = np.sort(rank[order[tied]] * n + order[tied]) % n
    return order, rank


def common_prefixes(codes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of what each suffix in the order shares with the one before.

    Kasai's rule, that the value drops by one at most from a suffix to the next in the
    text, is used for all suffixes at once: the shared length of the suffix at i is the
    furthest end of a match, along the text, that covers i. Candidates are extended in
    doubling steps by comparing the codes.
    """
    n = len(codes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[np.maximum(place - 1, 0)], -1)
    shift = before - np.arange(n)  # along a run of equal shifts, the match is one and the same
    # a match of no length ends at once, and another of the same shift may begin after it
    apart = (before < 0) | (codes != codes[np.maximum(before, 0)])
    new = np.append(True, (shift[1:] != shift[:-1]) | apart[:-1])
    head = np.flatnonzero(new)
    shared = np.zeros(n, np.int64)
    live = before[head] >= 0
    heads, partners = head[live], before[head][live]
    length = np.zeros(len(heads), np.int64)
    going = np.arange(len(heads))
    # a run of r suffixes with one shift needs `most` codes beyond its last suffix only
    bound = np.diff(np.append(head, n))[live] + most
    step = 16
    at = np.arange(step)
    while len(going):
        still = []
        for part in np.array_split(going, -(-len(going) // (1 << 15))):
            a, b = heads[part] + length[part], partners[part] + length[part]
            ok = (a < n) & (b < n) & (length[part] < bound[part])
            part, a, b = part[ok], a[ok][:, None] + at, b[ok][:, None] + at
            equal = (a < n) & (b < n)
            equal &= codes[np.minimum(a, n - 1)] == codes[np.minimum(b, n - 1)]
            run = np.where(equal.all(axis=1), step, equal.argmin(axis=1))
            length[part] += run
            still.append(part[run == step])
        going = np.concatenate(still)
    total = np.zeros(len(head), np.int64)
    total[live] = length
    inside = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    shared[:] = np.minimum(np.maximum(np.repeat(total, np.diff(np.append(head, n))) - inside, 0), most)
    return shared[order]


def repeated_windows(blocks: list[bytes], many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each block, which of its windows occur twice or more in all blocks. many: 1 for blocks that stand for several places."""
    sizes = np.array([len(b) for b in blocks])
    body = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int32) + 1
    ends = np.cumsum(sizes)
    codes = np.zeros(len(body) + len(blocks), np.int32)
    at = np.arange(len(body)) + np.repeat(np.arange(len(blocks)), sizes)
    codes[at] = body
    order, _ = suffix_order(codes, length)
    shared = common_prefixes(codes, order, length)
    starts = ends - sizes + np.arange(len(blocks))
    block = np.repeat(np.arange(len(blocks)), sizes + 1)[order]
    valid = order + length <= starts[block] + sizes[block]
    new_class = np.append(shared[1:] < length, True)  # does a class end here
    klass = np.concatenate([[0], np.cumsum(new_class)[:-1]])
    held = np.bincount(klass[valid], weights=1.0 + many[block[valid]], minlength=klass[-1] + 1 if len(klass) else 0)
    twice = np.empty(len(codes), bool)
    twice[order] = valid & (held[klass] >= 2)
    return [twice[s : s + max(z - length + 1, 0)] for s, z in zip(starts, sizes, strict=True)]


def window_digests(blocks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted, distinct digests (16 bytes) of the windows of all blocks, and the block and place where each first stands."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    data = np.frombuffer(b"".join(blocks), np.uint8)
    many = np.maximum(sizes - length + 1, 0)
    block = np.repeat(np.arange(len(blocks)), many)
    place = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    start = (np.cumsum(sizes) - sizes)[block] + place
    pair = np.empty((len(start), 2), ">u8")
    for i, second in enumerate((False, True)):
        pair[:, i] = common.span_hash(common.prefix_hash(data, second), start, start + length)
    digest, first = np.unique(pair.reshape(-1).view("S16"), return_index=True)
    return digest, block[first], place[first]


def ranges(windows: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Byte ranges covered by the windows set in a mask."""
    at = np.flatnonzero(windows)
    if not len(at):
        return [], []
    gap = np.flatnonzero(at[1:] > at[:-1] + length)
    return at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + length).tolist()


_FOUND = "key long, run_hash long, windows int, starts array<int>, stops array<int>, shard long, block int, range int, digests binary, places binary"


def _shard(length: int, bits: int):
    """Ranges found in a shard, a row for each block; and its distinct windows' digests, a row for each of 2^bits ranges, if keys go on elsewhere."""

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [bytes(b) for b in pdf["bytes"]]
        twice = repeated_windows(blocks, (pdf["copies"].to_numpy() > 1).astype(float), length)
        found = [ranges(t, length) for t in twice]
        out = pd.DataFrame({
            "key": pdf["key"].to_numpy(), "run_hash": pdf["run_hash"].to_numpy(), "windows": pdf["windows"].to_numpy(),
            "starts": [f[0] for f in found], "stops": [f[1] for f in found], "shard": key[0], "block": np.arange(len(blocks), dtype=np.int32),
            "range": pd.array([None] * len(blocks), "Int32"), "digests": None, "places": None,
        })
        common.give_back()
        parted = np.flatnonzero(pdf["parts"].to_numpy() > 1)
        if not len(parted):
            return out
        digest, block, place = window_digests([blocks[i] for i in parted], length)
        block = parted[block]
        settled = np.concatenate([twice[i] for i in parted])
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in twice])])[block] if len(parted) == len(blocks) else None
        if offsets is None:
            size = np.zeros(len(blocks) + 1, np.int64)
            size[parted + 1] = [len(twice[i]) for i in parted]
            offsets = np.cumsum(size)[block]
        place = np.where(settled[offsets + place], -1, place)  # what the shard has found already needs no answer
        cell = (digest.view(">u8")[::2].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(digest), np.int64)
        cuts = np.searchsorted(cell, np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(cuts))
        both = np.stack([block, place], 1).astype(np.int32)
        sent = pd.DataFrame({
            "key": np.int64(0), "run_hash": np.int64(0), "windows": np.int32(0), "starts": None, "stops": None, "shard": key[0], "block": np.int32(-1),
            "range": pd.array(full, "Int32"), "digests": [digest[cuts[i] : cuts[i + 1]].tobytes() for i in full], "places": [both[cuts[i] : cuts[i + 1]].tobytes() for i in full],
        })
        return pd.concat([out, sent], ignore_index=True)

    return shard


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of one range of digests that stand in another shard as well, by binary search of each shard's list in the sorted lists of all."""
    lists = [np.frombuffer(d, "S16") for d in pdf["digests"]]
    pooled = np.sort(np.concatenate(lists))
    out = []
    for shard, own, places in zip(pdf["shard"], lists, pdf["places"], strict=True):
        elsewhere = np.searchsorted(pooled, own, "right") - np.searchsorted(pooled, own, "left") > 1
        block, at = np.frombuffer(places, np.int32).reshape(-1, 2)[elsewhere].T
        asked = at >= 0
        out.append(pd.DataFrame({"shard": np.int64(shard), "block": block[asked], "at": at[asked]}))
    return pd.concat(out, ignore_index=True)


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """docs keyed by (__id, __row_hash), and for each key the ranges to remove, unmerged."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("__row_hash", F.xxhash64(text))
    source = keyed.select(F.col("__id").alias("id"), F.col("__row_hash").alias("row_hash"), text.alias("text"))
    runs = common.scratch_table(
        source.mapInArrow(_runs(length, gram), "id long, row_hash long, begin int, windows int, key long, run_hash long, moves boolean"), "runs"
    )
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("moves").alias("m")).filter("n > 1 OR m").select("key")
    places = common.scratch_table(runs.join(keys, "key", "left_semi"), "places")
    place = F.struct("id", "row_hash", "begin")
    distinct = places.groupBy("key", "run_hash", "windows").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("p"))
    weight = distinct.groupBy("key").agg(F.sum(F.col("windows") + (length - 1)).alias("key_bytes"), F.count(F.lit(1)).alias("runs"))
    parts = F.ceil(F.col("key_bytes") / SHARD_BYTES).cast("int")
    wanted = common.scratch_table(
        distinct.join(weight, "key").select(
            "key", "run_hash", "windows", "copies", parts.alias("parts"), ((F.col("runs") == 1) & (F.col("copies") > 1)).alias("settled"),
            F.col("p.id").alias("id"), F.col("p.row_hash").alias("row_hash"), F.col("p.begin").alias("begin"),
        ), "wanted"
    )
    to_sort = wanted.filter("NOT settled")
    total, parted = to_sort.agg(F.sum(F.col("windows") + (length - 1)), F.sum(F.when(F.col("parts") > 1, F.col("windows")))).first()
    shards = max(spark.sparkContext.defaultParallelism, -(-int(total or 0) // (SHARD_BYTES // 2)))
    bits = (int(parted or 0) // RANGE_WINDOWS).bit_length()
    salt = F.pmod(F.xxhash64("run_hash"), F.col("parts"))
    # rows that repeat an id and text hold the same bytes: one of them is enough
    body = F.substring(F.col("text").cast("binary"), F.col("begin") + 1, F.col("windows") + (length - 1))
    blocks = to_sort.join(source, ["id", "row_hash"]).select(
        "key", "run_hash", "windows", "copies", "parts", body.alias("bytes"),
        F.pmod(F.when(F.col("parts") > 1, F.xxhash64("key", salt)).otherwise(F.xxhash64("key")), F.lit(shards)).alias("shard"),
    ).dropDuplicates(["key", "run_hash", "windows"])
    found = common.scratch_table(blocks.groupBy("shard").applyInPandas(_shard(length, bits), _FOUND), "found")
    sorted_ = found.filter("range IS NULL")
    settled = wanted.filter("settled").select("key", "run_hash", "windows", F.array(F.lit(0)).alias("starts"), F.array(F.col("windows") + (length - 1)).alias("stops"))
    ranges_ = sorted_.filter(F.size("starts") > 0).select("key", "run_hash", "windows", "starts", "stops").unionByName(settled)
    if parted:
        merged = found.filter("range IS NOT NULL").select("range", "shard", "digests", "places").groupBy("range").applyInPandas(_merge, "shard long, block int, at int")
        across = merged.join(sorted_.select("shard", "block", "key", "run_hash", "windows"), ["shard", "block"])
        across = across.groupBy("key", "run_hash", "windows").agg(F.collect_set("at").alias("starts"))
        ranges_ = ranges_.unionByName(across.withColumn("stops", F.transform("starts", lambda s: s + length)))
    shift = lambda c: F.transform(c, lambda x: x + F.col("begin"))
    back = places.join(ranges_, ["key", "run_hash", "windows"]).select("id", "row_hash", shift("starts").alias("starts"), shift("stops").alias("stops"))
    # starts and stops stay together: one may be equal between two finds of a run while the other differs
    finds = back.groupBy("id", "row_hash").agg(F.collect_set(F.struct("starts", "stops")).alias("finds"))
    spans = finds.select(F.col("id").alias("__id"), F.col("row_hash").alias("__row_hash"), F.flatten("finds.starts").alias("__starts"), F.flatten("finds.stops").alias("__stops"))
    return keyed, spans


def _cut(batches):
    for batch in common.slices(batches, "text"):
        data, offsets = common.utf8_buffer(batch.column("text"))
        sizes = np.diff(offsets)
        change = np.zeros(len(data) + 1, np.int32)
        for name, step in (("__starts", 1), ("__stops", -1)):
            column = batch.column(name).fill_null([])
            count = column.value_lengths().to_numpy(zero_copy_only=False)
            np.add.at(change, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(offsets[:-1], count), step)
        gone = np.cumsum(change[:-1]) > 0
        first = gone.copy()  # of a run of removed bytes in its row
        inner = np.ones(len(data), bool)
        inner[offsets[:-1][sizes > 0]] = False
        first[1:] &= ~(gone[:-1] & inner[1:])
        removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, first))
        kept = pa.py_buffer(data[~gone].tobytes())
        ends = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
        rest = [c for c in batch.schema.names if c not in ("__starts", "__stops")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(sizes), pa.array(removed), pa.array(spans), pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), kept])],
            names=[*rest, "n_bytes", "n_removed", "n_spans", "kept_bytes"],
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_bytes (binary)."""
    keyed, spans = removed_ranges(docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes"), length, gram)
    joined = keyed.join(spans, ["__id", "__row_hash"], "left").drop("__id", "__row_hash")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("__starts", "__stops"))
    return joined.mapInArrow(_cut, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
