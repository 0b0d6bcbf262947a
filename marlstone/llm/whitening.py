"""Embedding whitening from an exact covariance.

Entries become integers. A task splits them into limbs of LIMB bits, signed at the top, so that the float64 products of
matrices of limbs are exact sums; these are put together again as integers in base 2^LIMB, whose digits Spark sums over all
tasks. The driver holds one matrix of the dimension: exact sums of products, an exact covariance numerator, and its
eigenvectors. A further pass measures the covariance of what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from marlstone.llm.common import give_back, table, written

#: Scale and shift of an entry; bits of a limb; rows of a product: 2 * LIMB + log2(ROWS) stay under 53; most components;
#: most different lengths of vectors; entries beyond this are held at it.
SCALE, SHIFT, LIMB, ROWS, MOST, LENGTHS, EDGE = 64, 1_000_000, 18, 1 << 14, 32, 64, 2.0**62


def whole(vectors: np.ndarray) -> np.ndarray:
    """Integers of the entries: floor(64 c) + 1,000,000."""
    return np.clip(np.floor(SCALE * vectors), -EDGE, EDGE).astype(np.int64) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k times 2^(LIMB k); all but the top one lie in 0 to 2^LIMB - 1."""
    out = []
    while True:
        if np.abs(x).max(initial=0) < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB


def gram(x: np.ndarray) -> np.ndarray:
    """Digits in base 2^LIMB of the exact products x'x, the least first; all but the last are in 0 to 2^LIMB - 1."""
    parts = limbs(x)
    sums = np.zeros((2 * len(parts) + 1, x.shape[1], x.shape[1]), np.int64)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            sums[i + j] += (a.T @ b).astype(np.int64)
    return carried(sums)


def carried(sums: np.ndarray) -> np.ndarray:
    for k in range(len(sums) - 1):
        sums[k + 1] += sums[k] >> LIMB
        sums[k] &= (1 << LIMB) - 1
    return sums


def by_length(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as float64) for each length of the batch."""
    column = batch.column(at)
    if not len(column):
        return
    lengths = np.diff(column.offsets.to_numpy())
    starts, flat = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield part, flat[starts[part][:, None] + np.arange(d)].astype(np.float64)


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, digit, pos, value) of a task: the upper triangle of [x 1]'[x 1], which holds sums and the count too."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, vectors in by_length(batch):
            new = gram(np.column_stack([whole(vectors), np.ones(len(vectors), np.int64)]))
            old = total.get(vectors.shape[1], new[:0])
            both = np.zeros((max(len(old), len(new)) + 1, *new.shape[1:]), np.int64)
            both[: len(old)] += old
            both[: len(new)] += new
            both = carried(both)
            total[vectors.shape[1]] = both if both[-1].any() else both[:-1]
    for d, digits in total.items():
        upper = np.triu_indices(d + 1)
        for k, digit in enumerate(digits):
            value = digit[upper]
            yield pa.record_batch({"d": pa.array(np.full(len(value), d, np.int32)), "digit": pa.array(np.full(len(value), k, np.int32)), "pos": pa.array(np.arange(len(value), dtype=np.int32)), "value": pa.array(value)})
    total.clear()
    give_back()


class Fit:
    """Exact sums of one length's vectors, and the components of their covariance."""

    def __init__(self, d: int, triangle: list[int]):
        upper = dict(zip(zip(*np.triu_indices(d + 1), strict=True), triangle, strict=True))
        at = lambda i, j: upper[min(i, j), max(i, j)]
        self.d, self.n, self.sums = d, at(d, d), [at(i, d) for i in range(d)]
        square = self.n * self.n
        # n * sum(x x') - S S' is exact; dividing two integers rounds once
        v = np.array([[(self.n * at(i, j) - self.sums[i] * self.sums[j]) / square for j in range(d)] for i in range(d)])
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")
        e, u = e[order], u[:, order]
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
        self.k = min(d, MOST)
        self.values, self.trace = e, float(sum(Fraction(self.n * at(i, i) - self.sums[i] ** 2, square) for i in range(d)))
        # a direction without variance, up to rounding, gives 0
        live = e > d * np.finfo(float).eps * max(e[0], 0)
        self.turn = u[:, : self.k] * np.where(live, 1 / np.sqrt(np.where(live, e, 1)), 0.0)[: self.k]

    @property
    def explained(self) -> list[float]:
        return [float(max(x, 0) / self.trace) if self.trace else 0.0 for x in self.values[: self.k]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S: in 64 bits where they hold it, else as Python's integers."""
        wide = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) >= 1 << 62
        x = x.astype(object) if wide else x
        return self.n * x - np.array(self.sums, dtype=object if wide else np.int64)

    def deviation(self, z: np.ndarray) -> list[int | None]:
        """Sum of squares; null beyond 64 bits."""
        if z.dtype == object or int(np.abs(z).max(initial=0)) ** 2 * self.d >= 1 << 63:
            return [v if v < 1 << 63 else None for v in (z.astype(object) ** 2).sum(axis=1)]
        return (z**2).sum(axis=1).tolist()

    def project(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64) @ self.turn


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    return vectors.filter(F.size(column) > 0).filter(~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def fitted(vectors: DataFrame) -> dict[int, Fit]:
    """A fit for each length; `vectors` has one column."""
    parts = vectors.mapInArrow(products, "d int, digit int, pos int, value long")
    sums = parts.groupBy("d", "digit", "pos").agg(F.sum("value").alias("value"))
    lengths = sums.select("d").distinct().limit(LENGTHS + 1).collect()
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    triangles: dict[int, list[int]] = {r.d: [0] * ((r.d + 1) * (r.d + 2) // 2) for r in lengths}
    for r in sums.collect():
        triangles[r.d][r.pos] += r.value << LIMB * r.digit
    return {d: Fit(d, t) for d, t in triangles.items()}


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per row: key, n, deviation, whitened (array of its components), explained (array), identity_error.

    Rows go whose vector is null or empty or holds a null or an entry that isn't finite. Vectors of different lengths are
    fitted apart. A component without variance is 0, and counts in identity_error. Repeated rows count and stay; null keys stay; an empty
    table gives an empty one. Other columns aren't read. Entries beyond 2^62 are held there; a deviation beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")), "v")
    fits = fitted(rows.select("v"))
    shared = spark.sparkContext.broadcast(fits)
    kind = _parse_datatype_string(f"key {vectors.schema[key].dataType.simpleString()}, d int, n long, deviation long, whitened array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in by_length(batch, 1):
                fit = shared.value[values.shape[1]]
                z = fit.centred(whole(values))
                flat = fit.project(z)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, fit.k, dtype=np.int32)), pa.array(flat.ravel()))
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), fit.d, np.int32)), pa.array(np.full(len(at), fit.n, np.int64)), pa.array(fit.deviation(z), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "d", "n", "deviation", "whitened"])
        give_back()

    out = written(rows.mapInArrow(run, kind))
    errors = identity_errors(out.select("whitened", "d"), fits)
    known = [(d, fit.explained, errors[d]) for d, fit in fits.items()]
    about = spark.createDataFrame(known, "d int, explained array<double>, identity_error double")
    return out.join(F.broadcast(about), "d").select(F.col("key").alias(key), "n", "deviation", "whitened", "explained", "identity_error")


def identity_errors(whitened: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length the largest entry of the whitened rows' covariance minus the identity, measured on all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for at, w in by_length(batch):
                for d in np.unique(lengths[at]):
                    ones = np.column_stack([w[lengths[at] == d], np.ones(int((lengths[at] == d).sum()))])
                    total[int(d)] = total.get(int(d), 0) + ones.T @ ones
        for d, sums in total.items():
            value = sums.ravel()
            yield pa.record_batch({"d": pa.array(np.full(len(value), d, np.int32)), "pos": pa.array(np.arange(len(value), dtype=np.int32)), "value": pa.array(value)})
        give_back()

    sums: dict[int, np.ndarray] = {d: np.zeros((fit.k + 1) ** 2) for d, fit in fits.items()}
    for r in whitened.mapInArrow(run, "d int, pos int, value double").groupBy("d", "pos").agg(F.sum("value").alias("value")).collect():
        sums[r.d][r.pos] = r.value
    out = {}
    for d, fit in fits.items():
        m = sums[d].reshape(fit.k + 1, fit.k + 1) / fit.n
        out[d] = float(np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(fit.k)).max())
    return out


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: a row for each vector and component."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return out.select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error"
    )


def brute_force(vectors: list[list[float]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(deviations, covariance, centred rows) of vectors of one length by Python's integers and fractions; for tests."""
    from math import floor

    x = [[floor(SCALE * c) + SHIFT for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    v = [[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)]
    return [sum(c * c for c in r) for r in z], np.array(v), np.array([[float(Fraction(c, n)) for c in r] for r in z])
