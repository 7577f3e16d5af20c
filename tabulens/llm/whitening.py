"""Whitening of embeddings from exact sums: covariances by polarisation.

Entries become integers, x = floor(scale * entry). Over the list of distinct vectors, n of them with sums S, the centred
values n * x - S are integers too, so no rounding enters before the end. What is aggregated is only squares: of the
centred value of every dimension, and of the sum of every two dimensions. As Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b),
their differences are all covariances, which are put together and decomposed. Tasks send partial sums, one number for
each pair of dimensions; the driver sees nothing but these sums and never a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table, written

SCALE, COMPONENTS = 256, 4
#: Integers beyond this count as this; a bound that keeps n * x within 64 bits up to two thousand million vectors.
LARGEST = 2**31
#: Sums travel as digits to this base, so that the sum of any number of them fits a decimal.
DIGIT = 60
#: Vectors that are squared together, and the bits of the parts that large values are cut into.
TOGETHER, PART = 4096, 24


class Whitening(NamedTuple):
    """Of n distinct vectors: sums by dimension, eigenvalues from the largest down, their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(vector: Column, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * entry); null if the vector is null or holds nulls or values that are not finite."""
    entry = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    bounded = lambda x: F.greatest(F.least(x.cast("double"), F.lit(1e9)), F.lit(-1e9))
    return F.when(F.forall(vector, finite), F.transform(vector, lambda x: entry(bounded(x)).cast("long")))


def matrix(vectors: pa.Array, dimensions: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S; as Python's integers where 64 bits might not hold a sum of two."""
    if n * (int(np.abs(x).max(initial=0)) + 1) >= 2**61:
        return n * x.astype(object) - sums
    return n * x - sums.astype(np.int64)


def square_sums(z: np.ndarray, axis: int) -> np.ndarray:
    """Exact sums of squares along an axis, as Python's integers."""
    if z.dtype == object:
        return (z * z).sum(axis=axis)
    z = np.abs(z)
    rounds = -(-max(1, int(z.max(initial=0)).bit_length()) // PART)
    parts = [(z >> np.int64(PART * k)) & np.int64(2**PART - 1) for k in range(rounds)]
    total = np.zeros(z.shape[1 - axis], object)
    for i, a in enumerate(parts):
        for j in range(i, rounds):
            total += (a * parts[j]).sum(axis=axis).astype(object) * ((1 if i == j else 2) << PART * (i + j))
    return total


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(x): each distinct vector once, in the shared folder; copies collapse in the tasks that read them."""
    return written(vectors.select("x").distinct(), "vectors")


def squares(distinct: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """For each dimension i, at (i, i), and each two, at (i, j): the sum of squares of their centred values' sum."""
    d, total = len(sums), np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                y = centred(matrix(batch.column(0).slice(low, TOGETHER), d), n, total)
                for i in range(d):
                    # Of dimension i alone, and of its sum with each later one.
                    z = np.concatenate([y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]], axis=1)
                    found[i] = found.get(i, 0) + square_sums(z, 0)
        rows = [(i, i + k, p, v >> DIGIT * p & (1 << DIGIT) - 1) for i, some in found.items() for k, v in enumerate(some) for p in range(v.bit_length() // DIGIT + 1)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "p", "digit"])

    digits = distinct.mapInArrow(run, "i int, j int, p int, digit long")
    merged = digits.groupBy("i", "j", "p").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))
    out: dict[tuple[int, int], int] = {}
    for r in merged.collect():  # a few numbers for each pair of dimensions
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.digit) << DIGIT * r.p)
    return out


def fit(distinct: DataFrame) -> Whitening | None:
    """Of the distinct vectors, all of one length; None if there are none, or they have no dimensions."""
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    rows = sorted(sums.collect())  # one row for each dimension
    if not rows:
        return None
    n, total = rows[0].n, [int(r.s) for r in rows]
    q = squares(distinct, n, total)
    d, scale = len(total), 2 * n**3
    covariance = np.empty((d, d))
    for i in range(d):
        covariance[i, i] = float(Fraction(2 * q[i, i], scale))
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = float(Fraction(q[i, j] - q[i, i] - q[j, j], scale))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Of the two unit vectors, the one whose largest entry is above zero.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    return Whitening(n, total, values, vectors * signs, float(np.trace(covariance)))


def projected(x: np.ndarray, found: Whitening, components: int) -> np.ndarray:
    """Whitened values; NaN of a component without variance."""
    y = centred(x, found.n, np.array(found.sums, object)).astype(float) / found.n
    values = found.values[:components]
    flat = values <= max(1.0, found.values[0]) * len(values) * 1e-13
    return y @ (found.vectors[:, :components] / np.sqrt(np.where(flat, np.nan, values)))


def identity_error(distinct: DataFrame, found: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over the fit list."""
    d = len(found.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = projected(matrix(batch.column(0), d), found, components)
            yield pa.RecordBatch.from_arrays([pa.array([w.sum(axis=0).tolist()]), pa.array([(w.T @ w).ravel().tolist()])], names=["s", "q"])

    parts = distinct.mapInArrow(run, "s array<double>, q array<double>")
    total = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(components)] + [F.sum(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(components**2)]
    row = parts.agg(*total).first()
    # The whitened mean is zero but for rounding; it is taken off all the same.
    mean = np.array(row[:components], float) / found.n
    covariance = np.array(row[components:], float).reshape(components, components) / found.n - np.outer(mean, mean)
    error = np.abs(covariance - np.eye(components))
    return float(np.nanmax(error)) if not np.isnan(error).all() else 0.0


def whiten(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per remaining row and component (from 1, by falling eigenvalue): ``key``, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds nulls, NaN or infinities do not remain. Where vectors differ in length, those of the
    length that most distinct ones have remain, of equally many the longest. Repeated rows and null keys remain as they
    are; n counts each distinct vector once. Entries beyond 2**31 after scaling count as that. A component without
    variance (one distinct vector, or a constant direction) is null when whitened. Equal eigenvalues have no order of
    their own: any vectors of their space do. Other columns are not looked at. No rows give no rows.
    """
    rows = docs.select(F.col(quoted(key)).alias("key"), integers(F.col(quoted(vector)), scale).alias("x")).where(F.size("x") > 0)
    distinct = distinct_vectors(rows)
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"key {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    distinct, rows = (df.where(F.size("x") == lengths.d) for df in (distinct, rows))
    found = fit(distinct)
    count = min(components, lengths.d)
    error = identity_error(distinct, found, count)
    explained = found.values[:count] / found.trace if found.trace > 0 else np.full(count, np.nan)
    sums = np.array(found.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), lengths.d)
            away = square_sums(centred(x, found.n, sums), 1)
            w = projected(x, found, count).ravel()
            each = np.repeat(np.arange(len(x)), count)
            of = np.tile(np.arange(count), len(x))
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(of + 1, pa.int32()), pa.array(np.full(len(of), found.n)),
                pa.array([Decimal(v) for v in away], pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(w, pa.float64(), mask=np.isnan(w)), pa.array(explained[of], pa.float64(), mask=np.isnan(explained[of])), pa.array(np.full(len(of), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op13_whitened_vectors(spark, sf_dir):
    done = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return done.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
