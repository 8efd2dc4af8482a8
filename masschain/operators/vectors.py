"""Sampled bands from sample vectors: every edge of every path is drawn, thousands of times, and vectors rise through the classes index by index.

An edge's draws come from a generator that is keyed by the seed and the edge's name, so an edge that several paths share has the
same draws in all of them, and nothing depends on partitions or reruns. Distributions have any parameters; most are made of 32-bit integers for
all samples at once, in single precision (7 digits): those that are symmetric as sums or medians of evenly spread values, normal ones by pairs. Sums are of double precision.

Paths are dealt by slice, element class and a part of some `PATHS` paths, and sorted; a task reads them as a stream, with one vector to add to, and gives it
away when the next part begins. Vectors are cut into blocks of `BLOCK` samples: parts of a slice meet by `MEET` first, and subclasses of a class after that,
block by block. Only sums of paths leave a task, never draws.

Slices are divided by their number of products, and a class is the mean of the gated subclasses that have the element class. Bands are exact quantiles, linear
between ranks. Paths with a null best have the draw 0; without interval, parameters or spread, an edge is its best value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masschain.operators import heights
from masschain.plans import shared, tables

SAMPLES, SEED, BLOCK = 10_000, 42, 2_500
#: Paths in a part of a slice, parts that meet at once, and partitions at most.
PATHS, MEET, MOST_TASKS = 8_000, 64, 20_000
PERCENTILES = (0.05, 0.5, 0.95)
KINDS = ("uniform", "triangular", "rectangular", "normal", "lognormal", "weibull", "gamma", "beta")
_WIDE = np.sqrt(3.0)
#: Parameters that differ by so little, from rounding, are those of the middle.
_SAME = 1e-9
#: A lower end above this part of the upper one stays above 0 in single precision.
_SINGLE = 1e-6
_POSITIVE = ("normal", "lognormal", "weibull", "gamma")
_BITS = np.random.SFC64(0)
_RNG = np.random.Generator(_BITS)
_EDGES = ("above", "between", "below")
_PATHS = ["class", "key", *(f"{e}_{c}" for e in _EDGES for c in ("name", "kind", "best", "lo", "hi"))]


def draws(name: str, kind: str, best: float, lo: float, hi: float, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """Draws of an edge around best, not below 0; its interval [lo, hi] is that of an evenly spread value, so its deviation is (hi - lo) / sqrt(12).

    Normal, lognormal, weibull and gamma have the mean best and that deviation (weibull: its shape by the common power law of the ratio); beta lies in the interval, with its mean at best.
    """
    if best is None or best != best:
        return np.zeros(samples)
    if lo is None or hi is None or not hi > lo:
        return np.full(samples, max(best, 0.0))
    spread = (hi - lo) / (2 * _WIDE)
    ratio = spread / best if best > 0 else 0.0
    rng = _keyed(f"{seed}|{name}")
    if kind in ("uniform", "rectangular"):
        out = _within(_ints(samples)[0], lo, hi)
    elif kind == "triangular":
        mode = min(max(best, lo), hi)
        if abs((mode - lo) - (hi - mode)) <= _SAME * (hi - lo):  # two evenly spread values
            a, b = _ints(samples, 2)
            a >>= 1
            b >>= 1
            a += b
            out = _within(a, lo, hi)
        else:
            out = rng.triangular(lo, mode, hi, samples)
    elif kind == "normal":
        out = _normal(samples, spread)
        out += np.float32(best)
        np.maximum(out, 0, out=out)
    elif kind in ("lognormal", "weibull", "gamma") and not ratio:
        out = np.full(samples, best)
    elif kind == "lognormal":
        width = math.log1p(ratio**2)
        out = _normal(samples, math.sqrt(width))
        out += np.float32(math.log(best) - width / 2)
        np.exp(out, out=out)
    elif kind == "weibull":
        shape = ratio**-1.086
        out = _above_zero(_ints(samples)[0])
        np.negative(np.log(out, out=out), out=out)
        np.log(out, out=out)
        out *= np.float32(1 / shape)
        np.exp(out, out=out)
        out *= np.float32(best / math.gamma(1 + 1 / shape))
    elif kind == "gamma":
        out = _gamma(rng, ratio**-2, samples)
        out *= np.float32(best * ratio**2)
    elif kind == "beta":
        at = min(max((best - lo) / (hi - lo), 0.01), 0.99)
        if abs(at - 0.5) <= _SAME:  # beta(2, 2) is the median of three evenly spread values
            a, b, c = _ints(samples, 3)
            low = np.minimum(a, b)
            np.maximum(a, b, out=a)
            out = _within(np.maximum(np.minimum(a, c, out=a), low, out=a), lo, hi)
        else:
            out = rng.beta(4 * at, 4 * (1 - at), samples)
            out *= hi - lo
            out += lo
    else:
        out = np.full(samples, best)
    return out if lo > _SINGLE * hi or out.dtype == np.float32 and kind in _POSITIVE else np.maximum(out, 0, out=out)


def _keyed(name: str) -> np.random.Generator:
    """The generator of this process, at the place that a name has; making one takes longer than many draws."""
    state = np.frombuffer(blake2b(name.encode(), digest_size=32).digest(), np.uint64)
    _BITS.state = {"bit_generator": "SFC64", "state": {"state": state}, "has_uint32": 0, "uinteger": 0}
    return _RNG


def _ints(samples: int, rows: int = 1) -> np.ndarray:
    """Rows of 32-bit integers, signed, all equally likely."""
    return _BITS.random_raw((samples * rows + 1) // 2).view(np.int32)[: samples * rows].reshape(rows, samples)


def _within(ints: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Integers as values between lo and hi."""
    out = ints.astype(np.float32)
    out *= np.float32((hi - lo) * 2.0**-32)
    out += np.float32((lo + hi) / 2)
    return out


def _above_zero(ints: np.ndarray) -> np.ndarray:
    """Integers as values between 0 and 1, neither included, of which the small ones are as precise as others."""
    out = ints.view(np.uint32).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-32 * (1 - 2.0**-24))
    return out


def _normal(samples: int, spread: float) -> np.ndarray:
    """Normal values around 0, two from each radius and angle (Box and Muller)."""
    half = (samples + 1) // 2
    radius, angle = _ints(half, 2)
    radius = _above_zero(radius)
    np.log(radius, out=radius)
    radius *= np.float32(-2 * spread**2)
    np.sqrt(radius, out=radius)
    angle = angle.astype(np.float32)
    angle *= np.float32(math.pi * 2.0**-31)
    out = np.empty(2 * half, np.float32)
    np.multiply(np.cos(angle, out=out[:half]), radius, out=out[:half])
    np.multiply(np.sin(angle, out=out[half:]), radius, out=out[half:])
    return out[:samples]


def _gamma(rng: np.random.Generator, shape: float, samples: int) -> np.ndarray:
    """Marsaglia and Tsang's rejection for many at once; what is rejected is drawn again."""
    if shape < 1:
        return rng.standard_gamma(shape, samples)
    d = shape - 1 / 3
    x, u = _normal(samples, 1.0), _above_zero(_ints(samples)[0])
    v = x * np.float32(1 / math.sqrt(9 * d))
    v += np.float32(1)
    fourth = x * x
    fourth *= fourth
    fourth *= np.float32(0.0331)
    doubt = np.flatnonzero(u <= fourth)  # holds all cubes that are not above 0
    v *= v * v
    c, x, u = (w[doubt].astype(np.float64) for w in (v, x, u))
    c = np.maximum(c, 1e-300)
    again = doubt[np.log1p(-u) >= x * x / 2 + d * (1 - c + np.log(c))]
    v *= np.float32(d)
    if len(again):
        v[again] = rng.standard_gamma(shape, len(again))
    return v


def slice_vectors(paths: DataFrame, sizes: DataFrame, samples: int = SAMPLES, seed: int = SEED, most: int = PATHS, block: int = BLOCK) -> DataFrame:
    """(class, key, block, vector): of paths (class, key, and of the edges above, between and below: name, kind, best, lo, hi), their products summed and divided by n of sizes (class, n)."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, shared_edge, shared_draws = None, None, None, None

        def given():
            cut = [total[i : i + block] for i in range(0, samples, block)]
            return pd.DataFrame({"class": at[0], "key": at[1], "part": at[2], "block": range(len(cut)), "vector": cut})

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if row[:3] != at:
                    if at is not None:
                        yield given()
                    at, total = row[:3], np.zeros(samples)
                above, between, below = row[3:8], row[8:13], row[13:18]
                if above != shared_edge:  # paths below one edge come one after another
                    shared_edge, shared_draws = above, draws(*above, samples, seed)
                product = draws(*between, samples, seed) * draws(*below, samples, seed)
                total += product * shared_draws if product.dtype != shared_draws.dtype else np.multiply(product, shared_draws, out=product)
        if at is not None:
            yield given()

    shared.checkpoint_folder(paths.sparkSession)
    paths = paths.select(*_PATHS).checkpoint()
    counted = paths.groupBy("class", "key").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"), F.count(F.lit(1)).alias("rows"))
    # draws cost time that bytes do not show, so tasks are dealt by paths
    tasks = (counted.agg(F.sum("rows")).first()[0] or 0) // most + paths.sparkSession.sparkContext.defaultParallelism
    part = F.pmod(F.xxhash64("above_name", "between_name", "below_name"), F.col("parts")).alias("part")
    dealt = paths.join(counted, ["class", "key"]).select("class", "key", part, *_PATHS[2:]).repartition(min(tasks, MOST_TASKS), "class", "key", "part").sortWithinPartitions("class", "key", "part", "above_name", "between_name", "below_name")
    summed = dealt.mapInPandas(sums, "class string, key string, part long, block int, vector array<double>")
    some = _together(summed.withColumn("part", F.floor(F.col("part") / MEET)), "sum", "part")
    return _together(some, "sum").join(sizes, "class").select("class", "key", "block", F.transform("vector", lambda v: v / F.col("n")).alias("vector"))


def _together(vectors: DataFrame, how: str, *also: str) -> DataFrame:
    """Sums or means of vectors of one class, key and block, in an order that does not depend on arrival."""
    add = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", 0), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    listed = vectors.groupBy("class", "key", *also, "block").agg(F.array_sort(F.collect_list("vector")).alias("all"))
    out = listed.select("class", "key", *also, "block", add.alias("vector"), F.size("all").alias("n_vectors"))
    return out.drop("n_vectors") if how == "sum" else out.select("class", "key", "block", F.transform("vector", lambda x: x / F.col("n_vectors")).alias("vector"))


def class_vectors(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """Vectors of leaves and, by height, of all classes above them by gated edges (parent, child)."""
    shared.checkpoint_folder(leaves.sparkSession)
    known = every = leaves.checkpoint()
    own = known.select("class").distinct()
    for level in heights.with_heights(own, edges):
        below = known.withColumnRenamed("class", "child")
        made = _together(level.join(below, "child").select(F.col("parent").alias("class"), "key", "block", "vector"), "mean").checkpoint()
        every = every.unionByName(made.join(own, "class", "left_anti"))
        known = known.unionByName(made.join(own, "class", "left_anti"))
    return every


def bands(vectors: DataFrame, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """(class, key, n_samples, mean, quantiles) of each class and key; a vector of all samples is put together in one row."""
    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v = [np.concatenate(blocks) for blocks in frame["blocks"]]
            yield pd.DataFrame({"class": frame["class"], "key": frame["key"], "n_samples": [len(x) for x in v], "mean": [np.sort(x).mean() for x in v], "quantiles": [np.quantile(x, percentiles) for x in v]})

    whole = vectors.groupBy("class", "key").agg(F.collect_list("vector").alias("blocks"))
    return whole.mapInPandas(ranked, "class string, key string, n_samples long, mean double, quantiles array<double>")


def store_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path of the store with its three edges; kinds by supplier and part, an upper edge as wide as the worst statement below it."""
    kind = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), CAST(pmod({}, 8) AS INT) + 1)"
    edge = lambda name, key, best, lo, hi: f"{name[1]} AS {name[0]}_name, {kind.format(key)} AS {name[0]}_kind, {best} AS {name[0]}_best, {lo} AS {name[0]}_lo, {hi} AS {name[0]}_hi"
    return tables.sql_query(f"""SELECT product_class || '_Y' || CAST(yr AS STRING) AS class, element_class AS key,
        {edge(("above", "concat_ws('|', 'pc', ord, sup)"), "sup", "f1", "f1 * (1 - clim)", "f1 * (1 + clim)")},
        {edge(("between", "concat_ws('|', 'cm', ord, sup, prt)"), "prt + sup", "f2", "f2 * (1 - lim)", "f2 * (1 + lim)")},
        {edge(("below", "concat_ws('|', 'me', ord, sup, prt)"), "prt", "f3", "lo", "hi")}
        FROM (SELECT t.*, p.product_class, p.yr FROM (SELECT *, MAX(lim) OVER (PARTITION BY ord, sup) AS clim FROM path) t JOIN placed p ON t.ord = p.ord) x""")(spark, sf_dir)


def mc_band(spark: SparkSession, sf_dir: str, samples: int = SAMPLES, seed: int = SEED, scope: str | None = "BUILDING") -> DataFrame:
    """Bands of the classes under a segment, whose names start with its name, or of all classes (None), from every path of theirs."""
    shared.checkpoint_folder(spark)
    paths = store_paths(spark, sf_dir)
    sizes = tables.sql_query("SELECT product_class || '_Y' || CAST(yr AS STRING) AS class, n FROM n_products")(spark, sf_dir)
    if scope is not None:
        paths = paths.filter(F.col("class").startswith(scope))
    found = bands(class_vectors(slice_vectors(paths, sizes, samples, seed), heights.gate_edges(spark, sf_dir)))
    columns = [F.round(F.get("quantiles", i), 9).alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTILES)]
    return found.select("class", F.col("key").alias("element_class"), "n_samples", F.round("mean", 9).alias("mean"), *columns)


#: No SQL: the draws are numpy's. tests/test_vectors.py holds it against a walk over the paths and against means without draws.
QUERIES = {"mc_band": mc_band}
