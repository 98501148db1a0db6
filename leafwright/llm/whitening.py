"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers ``floor(64 c) + 1000000``.  The distinct vectors' scatter ``n * sum(x x') - S S'`` is a
matrix of integers, added up exactly: tasks multiply limbs of 20 bits, whose sums stay below 2**53, and send
one row per entry and limb.  Its characteristic polynomial is found modulo many primes, each by reduction to
Hessenberg form, in tasks of their own; Chinese remainders give the integer coefficients, as many primes as a
bound on these calls for.

A symmetric matrix has real eigenvalues only, so by Descartes' rule the sign changes of the polynomial moved
by ``a`` are *exactly* the number of eigenvalues above ``a``, with multiplicity.  Bisection by that count
isolates the greatest eigenvalues in integer arithmetic to far more digits than a double holds.  Eigenvectors
are the null space of the scatter less an eigenvalue, found by inverse iteration with decimals of that
precision; equal eigenvalues share one space, of which an orthonormal basis is taken.

What the driver holds depends on the number of dimensions (scatter, polynomial, components), never on rows.
Polynomial and bisection are meant for some hundred dimensions.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors
count as if zeros followed; equal rows get equal results; a null id is kept; components without variance
(rank below the number wanted) are not returned, so one distinct vector or none gives no rows; an entry whose
integer is beyond 61 bits counts as one of 61 bits, a deviation beyond 38 digits is null; other columns are
left out.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm.common import read
from leafwright.llm.registry import query
from leafwright.session import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
FARTHEST = 1 << 61
LIMB = 20  # bits of a limb; 4096 products of two stay below 2**53
STRIP = 4096
DIGITS = 60  # of eigenvalues and of the inverse iteration, besides those that gaps cost
CLUSTER = Decimal(10) ** -40  # eigenvalues closer than this share of the greatest are one


# the integer scatter


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, y: usable vectors as integers less the shift (which no deviation depends on)."""
    v = F.col(vector)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor(c.cast("double") * SCALE)))
    scaled = F.transform(v, bounded)
    return rows.filter(v.isNotNull() & sound).select(F.col(key).alias("key"), scaled.alias("y"))


def matrix_of(column, width: int) -> np.ndarray:
    """Lists as rows of equal width, zeros after shorter ones."""
    ends = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.flatten()), np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Parts of 20 bits, signed, least first, as doubles."""
    sign, rest, out = np.sign(y), np.abs(y), []
    while not out or rest.any():
        out.append((sign * (rest & ((1 << LIMB) - 1))).astype(float))
        rest = rest >> LIMB
    return out


def scatter(distinct: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and n * sum(y y') - S S' of the distinct vectors, exact."""
    upper = np.triu_indices(width)

    def moments(batches):
        n, sums, total = 0, {}, {}
        for batch in batches:
            y = matrix_of(batch.column("y"), width)
            n += len(y)
            for low in range(0, len(y), STRIP):
                parts = _limbs(y[low : low + STRIP])
                for a, one in enumerate(parts):
                    sums[a] = sums.get(a, 0) + one.sum(0).astype(np.int64)
                    for b, two in enumerate(parts):
                        total[a + b] = total.get(a + b, 0) + (one.T @ two).astype(np.int64)
        entry, limb, value = [-1], [0], [n]
        for a, s in sums.items():
            entry += range(width)
            limb += [a] * width
            value += s.tolist()
        for a, g in total.items():
            entry += range(width, width + len(upper[0]))
            limb += [a] * len(upper[0])
            value += g[upper].tolist()
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entry, pa.int32()), "limb": pa.array(limb, pa.int32()), "value": pa.array(value, pa.int64())})

    added = distinct.select("y").mapInArrow(moments, "entry int, limb int, value long")
    added = added.groupBy("entry", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow()
    flat: dict[int, int] = {}
    for e, a, v in zip(*(added.column(c).to_pylist() for c in ("entry", "limb", "value"))):
        flat[e] = flat.get(e, 0) + (int(v) << (LIMB * a))
    n = flat.get(-1, 0)
    sums = [flat.get(i, 0) for i in range(width)]
    out = [[0] * width for _ in range(width)]
    for k, (i, j) in enumerate(zip(*upper)):
        out[i][j] = out[j][i] = n * flat.get(width + k, 0) - sums[i] * sums[j]
    return n, sums, out


# the characteristic polynomial


def primes_below(top: int, bits: int) -> list[int]:
    """Primes from ``top`` down whose product has more than ``bits`` bits."""

    def prime(p: int) -> bool:  # the bases decide for all numbers below 2**32
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7):
            x = pow(a, d, p)
            if x in (1, p - 1):
                continue
            for _ in range(r - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                return False
        return True

    out, have, p = [], 0.0, top - 1 | 1
    while have <= bits + 1:
        if prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t I - A) modulo a prime below 2**31, constant first."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):  # similar to an upper Hessenberg matrix
        pivot = np.flatnonzero(a[k + 1 :, k])
        if not len(pivot):
            continue
        r = k + 1 + int(pivot[0])
        a[[k + 1, r]] = a[[r, k + 1]]
        a[:, [k + 1, r]] = a[:, [r, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the leading k rows
    leading[0, 0] = 1
    for k in range(d):
        grown = np.concatenate(([0], leading[k, :-1]))
        weight = np.zeros(k + 1, np.int64)
        below = 1
        for i in range(k, -1, -1):
            weight[i] = a[i, k] * below % p
            below = below * int(a[i, i - 1]) % p if i else below
        leading[k + 1] = (grown - (weight[:, None] * leading[: k + 1] % p).sum(0)) % p
    return leading[d].tolist()


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t I - A), exact, constant first, for a positive semidefinite matrix of integers."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # the k-th elementary symmetric function of numbers >= 0 is greatest when all are equal
    bound = max((math.comb(d, k) * (-(-trace // d)) ** k for k in range(1, d + 1)), default=1)
    primes = primes_below(1 << 31, bound.bit_length() + 1)
    sent = spark.sparkContext.broadcast(matrix)

    def reduce(batches):
        for batch in batches:
            found = [polynomial_modulo(sent.value, p) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    frame = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    table = frame.mapInArrow(reduce, "p long, c array<long>").toArrow()
    out, modulus = [0] * (d + 1), 1
    for p, c in zip(table.column("p").to_pylist(), table.column("c").to_pylist()):
        lift = pow(modulus, -1, p)
        out = [x + modulus * ((v - x) * lift % p) for x, v in zip(out, c)]
        modulus *= p
    return [x - modulus if 2 * x > modulus else x for x in out]


# its roots


def roots_above(coefficients: list[int], a: int, shift: int) -> int:
    """How many roots exceed a / 2**shift; all roots are real."""
    d = len(coefficients) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(coefficients)]  # the roots times 2**shift
    changes, last = 0, 0
    for i in range(d + 1):  # moved by a, constant first, one coefficient done per round
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
        sign = (c[i] > 0) - (c[i] < 0)
        if sign:
            changes += bool(last) and sign != last
            last = sign
    return changes


def greatest_roots(coefficients: list[int], wanted: int) -> list[Decimal]:
    """The ``wanted`` greatest positive roots (all if fewer), falling, each as often as it counts."""
    d = len(coefficients) - 1
    zeros = next(k for k, v in enumerate(coefficients) if v)
    wanted = min(wanted, d - zeros)
    coefficients = coefficients[zeros:]
    if not wanted:
        return []
    top = 1 << (-coefficients[-2]).bit_length()  # the trace bounds the roots
    digits = DIGITS + 10
    shift = max(0, int(digits * 3.33) - top.bit_length()) + 64
    # intervals (low, high] of numbers / 2**shift with the count of roots above each end
    out: list[tuple[int, int]] = []
    todo = [(0, top << shift, len(coefficients) - 1, 0)]
    width = max(1, (top << shift) >> int(digits * 3.33))
    while todo:
        low, high, above_low, above_high = todo.pop()
        if above_low == above_high or above_high >= wanted:
            continue
        # until one root is left, then by Newton's steps; roots never apart end as one interval
        if above_low - above_high == 1 and high - low > width:
            low, high = _sharpened(coefficients, low, high, shift, width)
        if high - low <= width:
            out += [(low, high)] * (above_low - above_high)
            continue
        mid = (low + high) >> 1
        above = roots_above(coefficients, mid, shift)
        todo += [(low, mid, above_low, above), (mid, high, above, above_high)]
    out.sort(reverse=True)
    with localcontext() as context:
        context.prec = digits + 20
        return [(Decimal(a) + Decimal(b)) / 2 / Decimal(1 << shift) for a, b in out[:wanted]]


def _value(coefficients: list[int], a: int, shift: int) -> int:
    """The polynomial at a / 2**shift, times 2**(shift * degree)."""
    d, total = len(coefficients) - 1, 0
    for k in range(d, -1, -1):
        total = total * a + (coefficients[k] << (shift * (d - k)))
    return total


def _sharpened(coefficients: list[int], low: int, high: int, shift: int, width: int) -> tuple[int, int]:
    """The interval of a single root, narrowed by the sign of the polynomial."""
    at_high = _value(coefficients, high, shift)
    if not at_high:
        return high - 1, high
    while high - low > width:
        mid = (low + high) >> 1
        value = _value(coefficients, mid, shift)
        if not value:
            return mid - 1, mid
        if (value > 0) == (at_high > 0):
            high = mid
        else:
            low = mid
    return low, high


# its components


def components_of(matrix: list[list[int]], roots: list[Decimal]) -> np.ndarray:
    """Unit eigenvectors, one row each, of roots that fall."""
    d, out, at = len(matrix), [], 0
    with localcontext() as context:
        context.prec = 2 * DIGITS
        while at < len(roots):
            like = [r for r in roots[at:] if roots[at] - r <= CLUSTER * roots[0]]
            out += _null_space(matrix, roots[at], len(like), d)
            at += len(like)
    return np.array([[float(v) for v in row] for row in out]).reshape(len(out), d)


def _null_space(matrix, root: Decimal, wanted: int, d: int) -> list[list[Decimal]]:
    """An orthonormal basis of the vectors that the matrix multiplies by ``root``."""
    a = [[Decimal(v) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    tiny = root * Decimal(10) ** -(DIGITS + 20)
    rows = list(range(d))
    for k in range(d):  # triangular factors, rows swapped for the greatest pivot
        best = max(range(k, d), key=lambda r: abs(a[rows[r]][k]))
        rows[k], rows[best] = rows[best], rows[k]
        top = a[rows[k]]
        if abs(top[k]) < tiny:
            top[k] = tiny
        for r in rows[k + 1 :]:
            low = a[r]
            if low[k]:
                f = low[k] = low[k] / top[k]
                for j in range(k + 1, d):
                    low[j] -= f * top[j]

    def solved(b: list[Decimal]) -> list[Decimal]:
        x = [b[r] for r in rows]
        for i in range(d):
            x[i] -= sum((a[rows[i]][j] * x[j] for j in range(i)), Decimal(0))
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - sum((a[rows[i]][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[rows[i]][i]
        return x

    basis: list[list[Decimal]] = []
    for start in range(wanted):
        v = [Decimal((i * i + 3 * i + 7 * start * i + start) % 97 + 1) for i in range(d)]
        for _ in range(3):
            v = solved(v)
            for u in basis:
                along = sum((p * q for p, q in zip(u, v)), Decimal(0))
                v = [q - along * p for p, q in zip(u, v)]
            length = sum((q * q for q in v), Decimal(0)).sqrt()
            v = [q / length for q in v]
        basis.append(v)
    return basis


# the whitened vectors


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained, identity_error of every usable row."""
    spark = rows.sparkSession
    usable = quantised(rows, key, vector)
    distinct = stored(usable.groupBy("y").agg(F.lit(1).alias("one")).select("y"))
    width = distinct.agg(F.max(F.size("y"))).first()[0] or 0
    # a vector and its like with zeros behind are one
    padded = F.concat("y", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("y")))
    if distinct.filter(F.size("y") < width).limit(1).count():
        distinct = stored(distinct.select(padded.alias("y")).distinct())
    n, sums, matrix = scatter(distinct, width)
    trace = sum(matrix[i][i] for i in range(width))
    roots = greatest_roots(polynomial(spark, matrix), wanted) if trace else []
    vectors = components_of(matrix, roots)
    # eigenvalues of the covariance are those of the scatter over n * n
    spread = np.array([float((r.sqrt()) / n) for r in roots])
    explained = [float(r / trace) for r in roots]
    constants = spark.sparkContext.broadcast((n, sums, vectors, spread))

    def project(y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        n, sums, vectors, spread = constants.value
        greatest = max((int(np.abs(y).max(initial=0)) * n + max(map(abs, sums), default=0)), 1)
        if greatest * greatest * max(width, 1) < 1 << 63:
            away = n * y - np.array(sums, np.int64)
            squares = (away * away).sum(1).tolist()
            centred = away / n
        else:
            away = y.astype(object) * n - np.array(sums, object)
            squares = [int(v) if v < 10**38 else None for v in (away * away).sum(1)]
            centred = (away / n).astype(float)
        return centred @ vectors.T / spread, squares

    found = len(roots)
    upper = np.triu_indices(found)

    def first(batches):
        for batch in batches:
            w, _ = project(matrix_of(batch.column("y"), width))
            yield pa.RecordBatch.from_pydict({"entry": pa.array(range(found), pa.int32()), "value": w.sum(0)})

    def second(mean):
        def run(batches):
            for batch in batches:
                w = project(matrix_of(batch.column("y"), width))[0] - mean
                yield pa.RecordBatch.from_pydict({"entry": pa.array(range(len(upper[0])), pa.int32()), "value": (w.T @ w)[upper]})

        return run

    def summed(run, size: int) -> np.ndarray:
        table = distinct.mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("v")).toArrow()
        out = np.zeros(size)
        out[table.column("entry").to_numpy()] = table.column("v").to_numpy()
        return out / n

    error = 0.0
    if found:
        covariance = summed(second(summed(first, found)), len(upper[0]))
        error = float(np.abs(covariance - (upper[0] == upper[1])).max())
    schema = (
        f"key {rows.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0),"
        " whitened double, explained double, identity_error double"
    )

    def results(batches):
        for batch in batches:
            w, squares = project(matrix_of(batch.column("y"), width))
            m = len(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(np.repeat(np.arange(m), found))),
                 pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)), pa.array(np.full(m * found, n)),
                 pa.array(squares, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), found))),
                 pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * found, error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(results, schema).withColumnRenamed("key", key)


@query("op13_whitening")
def op13(spark, sf_dir):
    """Every usable vector on the components of the distinct quantised vectors; no SQL finds eigenvectors.

    A deviation beyond 63 bits (more than some million distinct vectors) is null here; ``whiten`` has it whole.
    """
    found = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
