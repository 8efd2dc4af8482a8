"""Op 5: near-duplicate groups by a MinHash LSH forest.

1. Tasks turn each text into its set of word shingles (64-bit hashes), a digest of the
   set, and 64 minimum hashes, dealt to 16 trees as orders of depth 4.
2. Documents with equal sets collapse to one node by the digest, before anything else.
3. Per tree, nodes that share a prefix of depth 2 form a region. All nodes of a region are
   paired with its smallest one (a star, found by an aggregate and a join), which is linear
   in the nodes: first in FIRST_TREES trees, then in the others across components.
4. Pairs are confirmed on the full sets, and links joined to components.
5. Regions that still hold several components adapt their depth: one of more than DENSE
   nodes is cut at depth 3 or, where that is too many still, at 4. Nodes are sorted by
   signature, and each is paired with its nearest neighbours there, those of longest
   common prefix, that are of another component and agree with it in enough hashes.
6. What is left of regions of depth 2 with several components is settled exactly: nodes are
   joined on the rarest shingles of their full sets, as many as any pair above the
   threshold must share one of (a prefix-filter join), with bounds from sizes and places;
   popular shingles are dealt over many tasks.

A pair of likeness 0.8 shares depth 2 in one of 16 trees at least but for a chance of
(1 - 0.8^2)^16 = 8e-8; within a region none is missed. Sets are compared by 64-bit hashes of their shingles.

Defined results: null ids belong to no real id: they may join a group, never name it,
and stay if their group has no real id; null, empty and blank texts have no shingles
and link with nothing; rows that repeat an id count as one document, whose component is
that of any of its texts; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TREES, DEPTH = 16, 4
DENSE = 256
NEIGHBOURS = 4
FIRST_TREES = 2
LEAST_AGREEMENT = 38  # of 64 minimum hashes; a pair of likeness 0.8 has fewer with a chance of 1e-5
POSTING = 512  # nodes of one shingle that one task holds against others at a time
UNNAMED = 1 << 62  # ids from here on stand for groups without a real id

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the offsets of the rows in them."""
    data = common.lower_bytes(data)
    rows = len(offsets) - 1
    start, end, row = common.word_spans(data, offsets)
    word = common.span_hash(common.prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
    n_words = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n_words)])
    # a row of fewer than k words has one shingle, its whole sequence
    size = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    owner = np.repeat(np.arange(rows), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    shingle = np.zeros(len(owner), np.uint64)
    last = first[owner + 1]
    for i in range(k):
        there = at + i < last
        step = np.where(there, word[np.minimum(at + i, max(len(word) - 1, 0))], np.uint64(0)) if len(word) else shingle
        shingle = np.where(there, common.mix64(shingle * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(i + 1)), shingle)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    return shingle, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def _sketch(k: int):
    def sketch(batches):
        for batch in common.slices(batches, "text"):
            data, offsets = common.utf8_buffer(batch.column("text"))
            sets, at = shingle_sets(data, offsets, k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            starts = at[:-1][full]
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            signature = np.zeros((len(n), TREES * DEPTH), np.int32)
            if len(full):
                d1[full] = np.add.reduceat(common.mix64(sets), starts)
                d2[full] = np.bitwise_xor.reduceat(common.mix64(sets + np.uint64(0x1234567)), starts)
                for j in range(TREES * DEPTH):
                    hashed = (sets * _MULTIPLIERS[j] + _ADDENDS[j]) >> np.uint64(32)
                    signature[full, j] = np.minimum.reduceat(hashed, starts).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES * DEPTH, pa.int32()), pa.array(signature.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists],
                names=["doc_id", "row_hash", "n_shingles", "d1", "d2", "signature"],
            )

    return sketch


def _confirm(k: int, threshold: int):
    def confirm(batches):
        for batch in common.slices(batches, "text_a"):
            sizes, keys = [], []
            for side in ("text_a", "text_b"):
                sets, at = shingle_sets(*common.utf8_buffer(batch.column(side)), k)
                sizes.append(np.diff(at))
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                keys.append(np.stack([owner.astype(np.uint64), sets]))
            both = np.concatenate(keys, axis=1)
            order = np.lexsort((both[1], both[0]))
            both = both[:, order]
            twice = (both[:, 1:] == both[:, :-1]).all(axis=0)
            shared = np.bincount(both[0, 1:][twice].astype(np.int64), minlength=batch.num_rows)
            linked = 100 * shared >= threshold * (sizes[0] + sizes[1] - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(linked)), batch.column("b").filter(pa.array(linked))], names=["a", "b"])

    return confirm


def _agreeing(batches):
    """Pairs of nodes of one region and different components whose signatures agree enough.

    Rows come sorted by region and signature; each is held against the NEIGHBOURS rows before
    it, all rows of a batch at once for each distance.
    """
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("deep", "node", "comp")]
        signature = batch.column("signature").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        fresh = 0
        if held is not None:
            fresh = len(held[0])
            now, signature = [np.concatenate([h, x]) for h, x in zip(held[:3], now, strict=True)], np.concatenate([held[3], signature])
        deep, node, comp = now
        a, b = [], []
        for j in range(1, NEIGHBOURS + 1):
            to = np.arange(max(fresh, j), len(deep))
            same = deep[to] == deep[to - j]
            if not same.any():
                break
            to = to[same & (comp[to] != comp[to - j])]
            to = to[(signature[to] == signature[to - j]).sum(axis=1) >= LEAST_AGREEMENT]
            a.append(np.minimum(node[to], node[to - j]))
            b.append(np.maximum(node[to], node[to - j]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        held = [x[-NEIGHBOURS:] for x in (*now, signature)]


def _near_in_region(rows: DataFrame) -> DataFrame:
    """_agreeing over rows (deep, order, node, comp, signature), whose regions may span batches but not tasks."""
    together = rows.select("deep", "order", "node", "comp", "signature").repartition("deep").sortWithinPartitions("deep", "order", "node")
    return together.select("deep", "node", "comp", "signature").mapInArrow(_agreeing, "a long, b long").distinct()


def _shingles(k: int):
    def shingles(batches):
        for batch in common.slices(batches, "text"):
            sets, at = shingle_sets(*common.utf8_buffer(batch.column("text")), k)
            n = np.diff(at)
            owner = np.repeat(np.arange(batch.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(owner)), pa.array(n[owner].astype(np.int32)), pa.array(sets.view(np.int64))], names=["node", "size", "shingle"]
            )

    return shingles


def _exact_pairs(here: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """All pairs (a, b) of nodes of different components in here (node, comp) that may reach the threshold.

    Each set is ordered by rarity within here. Two sets above the threshold share a
    shingle among the first size - ceil(threshold * size) + 1 of each, and the first
    that they share has enough shingles after it in both. Nodes of a shingle's largest
    component are not paired with one another.
    """
    sets = common.scratch_table(texts.join(here.select("node"), "node", "left_semi").mapInArrow(_shingles(k), "node long, size int, shingle long"), "sets")
    often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ordered = Window.partitionBy("node").orderBy("n", "shingle")
    prefix = (
        sets.join(often, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("at", F.row_number().over(ordered) - 1)
        .filter(F.col("at") <= F.col("size") - F.floor((F.col("size") * threshold + 99) / 100)).filter("n > 1").drop("n")
    )
    prefix = common.scratch_table(prefix.join(here, "node"), "prefixes")
    by_comp = prefix.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = by_comp.groupBy("shingle").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    posted = prefix.join(several.select("shingle", "top", F.ceil(F.col("n") / POSTING).cast("int").alias("parts")), "shingle")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("node", "comp", "size", "at")]
    every = posted.select("shingle", part.alias("part"), *side("a"))
    others = posted.filter("comp != top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = others.select("shingle", "part", *side("b"))
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = (100 + threshold) * rest >= threshold * (F.col("size_a") + F.col("size_b"))
    met = every.join(others, ["shingle", "part"]).filter("comp_a != comp_b").filter(enough)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def linked_labels(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that have links (a, b): the smallest node that each reaches.

    Each round takes the least label of all neighbours, then that label's own label, so
    the number of rounds follows the logarithm of the longest chain. Only a count goes
    to the driver.
    """
    both = common.checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = common.checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "heard").alias("comp"), F.col("comp").alias("was"))
        nearer = common.checkpointed(nearer)
        jumped = nearer.alias("n").join(
            nearer.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp"
        ).select("node", F.least("comp", "further").alias("comp"), "was")
        jumped = common.checkpointed(jumped)
        if not jumped.filter("comp != was").limit(1).count():
            break
        labels = jumped.drop("was")
    return labels


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) after links (a, b) more. Only components that a link joins take part in the rounds."""
    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = links.join(side("a"), "a").join(side("b"), "b").filter("comp_a != comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
    tops = linked_labels(common.checkpointed(between)).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return common.checkpointed(comps.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


def linked_rows(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, row_hash (of the text), n_shingles, node and comp for each row of docs (doc_id, text).

    Texts are linked when 100 * shared >= threshold * union over sets of k-word
    shingles; comp is null for a text without any. Ids link nothing here.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_hash", F.xxhash64("text"))
    sketch = common.scratch_table(
        source.mapInArrow(_sketch(k), "doc_id long, row_hash long, n_shingles long, d1 long, d2 long, signature array<int>"), "sketches"
    )
    # one node for each set, by the digest; its text is that of the smallest row that has it
    row = F.struct(F.coalesce("doc_id", F.lit(UNNAMED)).alias("id"), "row_hash")
    groups = sketch.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(row).alias("row"), F.first("signature").alias("signature"))
    # an id that is the smallest of several sets names the first of them
    named = groups.filter(F.col("row.id") < UNNAMED).groupBy("row.id").agg(F.min("row.row_hash").alias("first")).withColumnRenamed("id", "named")
    own_name = F.col("row.row_hash") == F.col("first")
    nodes = common.scratch_table(
        groups.join(named, F.col("row.id") == F.col("named"), "left")
        .withColumn("node", F.when(own_name, F.col("named")).otherwise(F.lit(UNNAMED) + F.col("d1").bitwiseAND(F.lit(UNNAMED - 1)))).drop("named", "first"), "nodes"
    )
    trees = nodes.select(
        "node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("signature", t * DEPTH + 1, DEPTH))).alias("tree", "order")
    ).withColumns({f"region{d}": F.xxhash64("tree", F.slice("order", 1, d)) for d in (2, 3, 4)})
    # sizes of regions by their deepest prefix, summed up to the shallower ones; a region of one node ends here
    sizes = trees.groupBy("tree", "region2", "region3", "region4").agg(F.count(F.lit(1)).alias("n4"), F.min("node").alias("pivot"))
    by2, by3 = Window.partitionBy("tree", "region2"), Window.partitionBy("tree", "region2", "region3")
    sizes = sizes.select("*", F.sum("n4").over(by3).alias("n3")).select("*", F.sum("n4").over(by2).alias("n2"), F.min("pivot").over(by2).alias("least")).filter("n2 > 1")
    deep = F.when(F.col("n2") <= DENSE, F.col("region2")).when(F.col("n3") <= DENSE, F.col("region3")).otherwise(F.col("region4"))
    regions = sizes.select("tree", "region2", "region4", deep.alias("deep"), F.col("least").alias("pivot"))
    placed = common.scratch_table(
        trees.join(regions, ["tree", "region2", "region4"]).select("tree", F.col("region2").alias("region"), "deep", "pivot", "order", "node"), "placed"
    )
    # texts of the nodes that share a region with another: one row for each, kept for every confirmation
    involved = nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.col("row.id").alias("id"), F.col("row.row_hash").alias("row_hash"))
    holding = source.select(F.coalesce("doc_id", F.lit(UNNAMED)).alias("id"), "row_hash", "text")
    texts = common.scratch_table(involved.join(holding, ["id", "row_hash"]).select("node", "text").dropDuplicates(["node"]), "texts")

    # stars: first in a few trees, which settles most groups, then in the others where components differ
    stars = placed.filter("node != pivot").select("tree", F.col("pivot").alias("a"), F.col("node").alias("b"))
    tried = common.scratch_table(stars.filter(F.col("tree") < FIRST_TREES).select("a", "b").distinct(), "pairs")
    links = common.scratch_table(_confirmed(tried, texts, k, threshold), "links")
    comps = joined_components(nodes.select("node", F.col("node").alias("comp")), links)

    def grown(pairs: DataFrame) -> bool:
        """Confirms pairs not tried before; whether that added a link."""
        nonlocal tried, comps
        fresh = common.scratch_table(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = common.scratch_table(_confirmed(fresh, texts, k, threshold), "links")
        tried = tried.unionByName(fresh)
        if more.isEmpty():
            return False
        comps = joined_components(comps, more)
        return True

    def apart(pairs: DataFrame) -> DataFrame:
        side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter("comp_a != comp_b").select("a", "b")

    grown(apart(stars.filter(F.col("tree") >= FIRST_TREES).select("a", "b").distinct()))

    def mixed(region: str) -> DataFrame:
        """Rows of regions that hold several components."""
        here = placed.select(region, "node", "order").join(comps, "node")
        several = here.groupBy(region).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
        return here.join(several.select(region), region, "left_semi")

    grown(_near_in_region(mixed("deep").join(nodes.select("node", "signature"), "node")))
    # neighbours do not see all pairs: the rest, exactly
    unsettled = common.scratch_table(mixed("region").select("node", "comp").distinct(), "unsettled")
    grown(_exact_pairs(unsettled, texts, k, threshold))

    labels = nodes.select("d1", "d2", "node").join(comps, "node")
    return sketch.join(labels, ["d1", "d2"], "left").select("doc_id", "row_hash", "n_shingles", "node", "comp")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text), by linked_rows."""
    by_row = linked_rows(docs, k, threshold)
    # rows of one id with different sets meet through their id
    of_id = by_row.filter("doc_id IS NOT NULL AND comp IS NOT NULL").groupBy("doc_id").agg(F.min("comp").alias("a"), F.collect_set("comp").alias("all"))
    same = of_id.filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    if not same.isEmpty():
        tops = linked_labels(same.select("a", "b")).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        by_row = by_row.join(tops, "comp", "left").withColumn("comp", F.coalesce("top", "comp"))
    component = F.when(F.col("comp") < UNNAMED, F.col("comp")).when(F.col("comp").isNull(), F.col("doc_id"))
    return by_row.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.when(component.isNull(), F.col("doc_id").isNull()).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"),
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(k, threshold), "a long, b long")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), k=4, threshold=80)
