"""Op 12: embedding whitening by the exact characteristic polynomial of the integer scatter.

Vectors become integers, and each distinct vector counts once. Their scatter, n * sum(x x') - S S',
is a matrix of integers that is n^2 times the covariance; it is summed exactly, batch by batch. Its
characteristic polynomial comes from reductions to Hessenberg form modulo primes of 31 bits, dealt over tasks, and
Chinese remaindering; enough primes are taken to hold every coefficient. All roots are
real, so the sign changes of the polynomial shifted to a point count the roots beyond it exactly
(Budan, Descartes): counts isolate the roots, bisection by signs sharpens them to 160 bits. A component spans the
null space of scatter - root and comes by inverse iteration in decimals of 120 digits, one task each;
roots that agree to 100 bits share one null space and get orthogonal vectors of it.

Only figures of the dimension reach the driver: d^2 sums, d + 1 coefficients a prime and 16 components.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are
entries too large for a long and vectors of another length than the most common one (of equally common
ones the longer). Components of no variance are not returned, as nothing whitens them; a table of one distinct vector gives
no rows. A deviation too large for a long is null. Rows that repeat are returned each; null ids stay null; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vector_codes import integers, vectors

SCALE, OFFSET = 64, 1_000_000
MOST_COMPONENTS = 16
ROOT_BITS, SAME_BITS, DIGITS = 160, 100, 120
PRIMES_A_TASK = 16
BIG = 1 << 62


# --- exact sums ---------------------------------------------------------------


def _products(x: np.ndarray) -> np.ndarray:
    """The products of columns of x, summed over its rows exactly, as int64 or object."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) < 1 << 53:
        return (x.T.astype(float) @ x.astype(float)).astype(np.int64)
    digits, rest = [], x  # base 2^12, the highest one signed: products of blocks of 2^15 rows are exact as doubles
    while np.abs(rest).max() >= 1 << 12:
        digits.append((rest & 0xFFF).astype(float))
        rest = rest >> 12
    digits.append(rest.astype(float))
    total = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << 12 * (i + j))
    return total


def _block_sums(batches):
    total = None
    for _, x in vectors(batches):
        ones = np.ones((len(x), 1), np.int64)
        product = _products(np.hstack([ones, x])).astype(object)  # row 0: the count and the sums
        total = product if total is None else total + product
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "sum": [str(v) for v in total[i, j]]})


def sums_of(distinct: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors x, sums by dimension and sums of products, all exact."""
    sent = distinct.select("x").mapInArrow(_block_sums, "i int, j int, sum string")
    rows = sent.groupBy("i", "j").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()  # (d + 1)(d + 2) / 2 rows
    if not rows:
        return 0, [], []
    d = max(r["j"] for r in rows)
    full = [[0] * (d + 1) for _ in range(d + 1)]
    for r in rows:
        full[r["i"]][r["j"]] = full[r["j"]][r["i"]] = int(r["sum"])
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def scatter(n: int, sums: list[int], products: list[list[int]]) -> list[list[int]]:
    """n^2 times the covariance."""
    return [[n * p - a * b for p, b in zip(row, sums)] for row, a in zip(products, sums)]


# --- characteristic polynomial ------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The largest primes below top < 2^32 (Miller-Rabin with bases that decide there)."""

    def prime(m: int) -> bool:
        odd, twos = m - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            power = pow(base, odd, m)
            if power not in (1, m - 1) and all((power := power * power % m) != m - 1 for _ in range(twos - 1)):
                return False
        return True

    found, m = [], (top - 1) | 1
    while len(found) < count:
        if prime(m):
            found.append(m)
        m -= 2
    return found


def hessenberg_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo p < 2^31, highest first.

    Similarity transforms modulo p make the matrix upper Hessenberg; the polynomials of its leading blocks follow each other.
    """
    h, d = matrix % p, len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m][None, :]) % p
        # the inverse transform on columns: products stay below 2^62, so each is reduced before they are added
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor[None, :] % p).sum(axis=1)) % p
    blocks = [np.array([1], np.int64)]  # lowest coefficient first
    for k in range(d):
        nxt = np.zeros(k + 2, np.int64)
        nxt[1:] = blocks[k]
        nxt[:-1] -= blocks[k] * h[k, k] % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            nxt[: i + 1] -= int(h[i, k]) * run % p * blocks[i] % p
        blocks.append(nxt % p)
    return blocks[-1][::-1].tolist()


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial of this nonnegative definite matrix is larger.

    They are elementary symmetric functions of the roots, whose sum is the trace: at most prod(1 + root) <= (1 + trace / d)^d.
    """
    d = len(matrix)
    return (1 + -(-sum(matrix[i][i] for i in range(d)) // d)) ** d


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The integer of least absolute value with these residues (Garner)."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact integer coefficients of det(x - matrix), highest first; the primes are dealt over tasks."""
    needed = (2 * coefficient_bound(matrix)).bit_length() // 30 + 1
    primes = primes_below(1 << 31, needed)

    def residues(frames):
        for frame in frames:
            out = [hessenberg_polynomial(np.array([[v % p for v in row] for row in matrix], np.int64), p) for p in frame["prime"].tolist()]
            yield pd.DataFrame({"prime": frame["prime"], "residues": out})

    dealt = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(-(-needed // PRIMES_A_TASK))
    got = {r["prime"]: r["residues"] for r in dealt.mapInPandas(residues, "prime bigint, residues array<bigint>").collect()}
    return [remaindered([got[p][k] for p in primes], primes) for k in range(len(matrix) + 1)]


# --- roots --------------------------------------------------------------------


def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    return [c << (k * bits) for k, c in enumerate(poly)]


def beyond(poly: list[int], a: int) -> int:
    """How many roots of a polynomial of real roots only are greater than a, with multiplicity."""
    c = list(poly)
    for last in range(len(c) - 1, 0, -1):  # Taylor shift by Horner's scheme
        for k in range(1, last + 1):
            c[k] += a * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], a: int) -> int:
    value = 0
    for c in poly:
        value = value * a + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """The `count` largest positive roots, falling, each as (r, s, m): r / 2^s to so many bits, m times.

    Intervals are halved until they hold one root, or until what they hold agrees to SAME_BITS bits.
    """
    top = 1
    while beyond(poly, top):
        top *= 2
    found: list[tuple[int, int, int]] = []
    stack = [(0, top, 0, beyond(poly, 0), 0)]  # (low, high] / 2^shift, and the counts beyond both ends
    while stack and sum(m for *_, m in found) < count:
        low, high, shift, beyond_low, beyond_high = stack.pop()
        inside = beyond_low - beyond_high
        if inside == 1 or inside and (high - low) << SAME_BITS <= high:
            found.append((*_sharpened(poly, low, high, shift, inside, bits), inside))
        elif inside:
            low, middle, high, shift = _halved(low, high, shift)
            beyond_middle = beyond(_scaled(poly, shift), middle)
            stack += [(low, middle, shift, beyond_low, beyond_middle), (middle, high, shift, beyond_middle, beyond_high)]
    return found


def _halved(low: int, high: int, shift: int) -> tuple[int, int, int, int]:
    if (low + high) % 2:
        low, high, shift = 2 * low, 2 * high, shift + 1
    return low, (low + high) // 2, high, shift


def _sharpened(poly: list[int], low: int, high: int, shift: int, inside: int, bits: int) -> tuple[int, int]:
    """A root in (low, high] to so many bits, by the polynomial's sign where it changes; others agree to SAME_BITS bits by now."""
    scaled = _scaled(poly, shift)
    above = _sign(scaled, high)
    while above and inside % 2 and (high - low) << bits > high:
        before = shift
        low, middle, high, shift = _halved(low, high, shift)
        if shift != before:
            scaled = _scaled(poly, shift)
        sign = _sign(scaled, middle)
        if sign == 0:
            return middle, shift
        low, high = (low, middle) if sign == above else (middle, high)
    return (low + high, shift + 1) if above else (high, shift)


# --- components ---------------------------------------------------------------


def null_space(matrix: list[list[int]], root: int, shift: int, many: int) -> np.ndarray:
    """`many` orthonormal vectors that matrix - root / 2^shift sends to almost nothing, as rows of doubles."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        context.Emin, context.Emax = -(10**9), 10**9
        a = np.array([[Decimal((v << shift) - (root if i == j else 0)) for j, v in enumerate(row)] for i, row in enumerate(matrix)], object)
        tiny = Decimal(10) ** (5 - DIGITS) * max(abs(v) for v in a.ravel()) or Decimal(1)
        order = np.arange(d)
        for k in range(d):  # LU with row pivots
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * a[None, k, k + 1 :]
        seeded = np.random.default_rng(12).integers(-(1 << 30), 1 << 30, (many, d))
        basis = [np.array([Decimal(int(v)) for v in row], object) for row in seeded]
        for _ in range(3):
            made: list[np.ndarray] = []
            for start in basis:
                y = start[order].copy()
                for k in range(d):
                    y[k + 1 :] -= a[k + 1 :, k] * y[k]
                for k in range(d - 1, -1, -1):
                    y[k] = y[k] / a[k, k]
                    y[:k] -= a[:k, k] * y[k]
                for _twice in range(2):
                    for other in made:
                        y = y - other * (other * y).sum()
                made.append(y / (y * y).sum().sqrt())
            basis = made
        return np.array([[float(v) for v in row] for row in basis])


def components(spark: SparkSession, matrix: list[list[int]], most: int = MOST_COMPONENTS) -> list[tuple[int, int, list[float]]]:
    """(r, s, unit vector) of the largest roots r / 2^s of the matrix, falling; one task a root."""
    d = len(matrix)
    if not any(matrix[i][i] for i in range(d)):
        return []
    roots = largest_roots(characteristic_polynomial(spark, matrix), most)

    def solved(frames):
        for frame in frames:
            rows = frame[["root", "shift", "many"]].itertuples(index=False)
            yield pd.DataFrame({"k": frame["k"], "found": [null_space(matrix, int(r), int(s), int(m)).tolist() for r, s, m in rows]})

    given = [(k, str(r), s, m) for k, (r, s, m) in enumerate(roots)]
    dealt = spark.createDataFrame(given, "k int, root string, shift int, many int").repartition(max(1, len(given)))
    got = {r["k"]: r["found"] for r in dealt.mapInPandas(solved, "k int, found array<array<double>>").collect()}
    return [(r, s, v) for k, (r, s, _) in enumerate(roots) for v in got[k]][:most]


# --- whitening ----------------------------------------------------------------


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly."""
    top = max(map(abs, sums), default=0) + n * (int(np.abs(x).max(initial=0)) + 1)
    return n * x - np.array(sums, np.int64) if top < BIG else n * x.astype(object) - np.array(sums, object)


def _whitened(centred: np.ndarray, n: int, axes: np.ndarray) -> np.ndarray:
    """Projections on the scaled components; dimension by dimension, so that a row's value does not depend on its block."""
    y = centred.astype(float) / n
    out = np.zeros((len(y), axes.shape[1]))
    for k in range(axes.shape[0]):
        out += y[:, k, None] * axes[k]
    return out


def _deviation(centred: np.ndarray) -> list[int | None]:
    top = int(np.abs(centred).max(initial=0))
    if top * top * centred.shape[1] < BIG:
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in centred]
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(distinct: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> float:
    """Largest absolute entry of the covariance of whitened over the distinct vectors minus the identity, to 12 digits."""

    def moments(batches):
        size = axes.shape[1] + 1
        total = np.zeros((size, size))
        for _, x in vectors(batches):
            w = _whitened(_centred(x, n, sums), n, axes)
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "sum": total[i, j]})

    rows = distinct.select("x").mapInArrow(moments, "i int, j int, sum double").groupBy("i", "j").agg(F.sum("sum").alias("sum")).collect()
    m = {(r["i"], r["j"]): r["sum"] / n for r in rows}  # at most 17 * 18 / 2
    return round(max(abs(v - m[0, i] * m[0, j] - (i == j)) for (i, j), v in m.items() if i), 12)


def whiten(rows: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """Up to `most` whitened coordinates of each row that has a vector; see the module for what is defined."""
    spark = rows.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kept = integers(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), SCALE).drop("embedding")
    distinct = common.scratch_table(kept.select("x").distinct(), "distinct")
    # x here is without the contract's OFFSET, which cancels in n * x - S
    n, sums, products = sums_of(distinct)
    matrix = scatter(n, sums, products) if n else []
    found = components(spark, matrix, most) if n else []
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    explained = [_ratio(r, trace << s) for r, s, _ in found]
    deviations = [_root(r, s) / n for r, s, _ in found]  # the root of the variance r / 2^s / n^2
    axes = np.array([v for *_, v in found]).T / np.array(deviations)
    error = identity_error(distinct, n, sums, axes)
    k = len(found)

    def out(batches):
        for table, x in vectors(batches, rows=1 << 13):
            centred = _centred(x, n, sums)
            deviation = pa.array(_deviation(centred), pa.int64())
            place = np.repeat(np.arange(len(x)), k)
            columns = {
                "vec_id": table.column("vec_id").take(pa.array(place)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": np.full(len(place), n), "deviation": deviation.take(pa.array(place)), "whitened": _whitened(centred, n, axes).ravel(),
                "explained": np.tile(explained, len(x)), "identity_error": np.full(len(place), error),
            }
            yield from pa.table(columns).to_batches(max_chunksize=1 << 14)

    return kept.mapInArrow(out, schema)


def _ratio(a: int, b: int) -> float:
    return a / b  # of integers: correctly rounded whatever their size


def _root(r: int, shift: int) -> float:
    """The square root of r / 2^shift."""
    return isqrt(r << (shift % 2 + 128)) / (1 << ((shift + shift % 2) // 2 + 64))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
