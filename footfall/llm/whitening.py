"""Whitening of embeddings by blockwise QR, bidiagonalisation and qd iterations.

Tasks reduce their centred rows block by block to one triangle R, and triangles are
stacked and reduced again, so only matrices as wide as the vectors leave a task.
Householder reflections make R bidiagonal.  The squares of its singular values come from
dqds, which finds small ones as accurately as large ones, and their vectors from twisted
factorisations; the reflections turn those into directions of the data.

Entries are whole numbers, so counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import settled, table

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, after scaling, have no place in a long.
LARGEST = float(1 << 62)
#: Bytes of a block of centred rows.
BLOCK = 1 << 24
EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this share of the larger are told apart by orthogonalisation.
CLOSE = 1e-8


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x, width): vectors of ``floor(64 * c) + 1000000`` as little-endian longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
            bad = np.concatenate(([0], np.cumsum(~(np.abs(values) < LARGEST))))  # and not NaN
            width = ends[1:] - ends[:-1]
            good = column.is_valid().to_numpy(zero_copy_only=False) & (
                bad[ends[1:]] == bad[ends[:-1]]) & (width > 0)
            whole = np.floor(np.where(np.abs(values) < LARGEST, values, 0)).astype("<i8") + SHIFT
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)),
                 pa.array([whole[ends[i]:ends[i + 1]].tobytes() for i in at], pa.binary()),
                 pa.array(width[at], pa.int32())], ["vec_id", "x", "width"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col(vector).cast("array<double>").alias("vector")).mapInArrow(
        run, "vec_id long, x binary, width int")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, column: int = 0):
    step = max(1, BLOCK // (8 * width))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, _matrix(part.column(column), width)


def _added(parts: DataFrame) -> list:
    """Sums by place of arrays (sums), added by Spark; one number for each place returns."""
    rows = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(
        F.sum("value").alias("value")).collect()
    return [r.value for r in sorted(rows, key=lambda r: r.at)]


def reflection(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, b, a) with (1 - b v v') x = a times the first unit vector."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    a = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= a
    return v, 2.0 / float(v @ v), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal and superdiagonal of U' R V, and the reflections whose product is V."""
    a, n, rights = r.astype(float), len(r), []
    for k in range(n):
        v, b, top = reflection(a[k:, k])
        a[k:, k + 1:] -= b * np.outer(v, v @ a[k:, k + 1:])
        a[k:, k] = 0.0
        a[k, k] = top
        if k < n - 2:
            v, b, top = reflection(a[k, k + 1:])
            a[k + 1:, k + 1:] -= b * np.outer(a[k + 1:, k + 1:] @ v, v)
            a[k, k + 1:] = 0.0
            a[k, k + 1] = top
            rights.append((v, b))
    return np.diag(a).copy(), np.diag(a, 1).copy(), rights


def _dqds(q: list[float], e: list[float], shift: float):
    """One transform by ``shift``: (q, e, lower bound of the least eigenvalue left), or the
    place where a negative value says that the shift was too large and that value."""
    n, d, inverse = len(q), q[0] - shift, 0.0
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return None, i, d
        out_q[i] = d + e[i]
        inverse += 1 / d if d > 0 else np.inf
        ratio = q[i + 1] / out_q[i] if out_q[i] > 0 else 0.0
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None, n - 1, d
    out_q[n - 1] = d
    inverse += 1 / d if d > 0 else np.inf
    return out_q, out_e, 1 / inverse


def qd_eigenvalues(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by shifted dqds.

    A shift is the smaller eigenvalue of the last two rows; where it goes beyond the least
    eigenvalue, the value left over gives a safe one, else a transform without shift does.
    """
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale], 0.0)]
    while work:
        q, e, sigma = work.pop()
        safe = 0.0
        for _ in range(200 * len(q) + 200):
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= EPS * EPS * (sigma + q[i + 1]) or e[i] < 1e-290), None)
            if len(q) == 1:
                found.append(sigma + q[0])
                break
            if cut is not None:
                work += [(q[:cut + 1], e[:cut], sigma), (q[cut + 1:], e[cut + 1:], sigma)]
                break
            if q[0] * 1.5 < q[-1]:  # the small end belongs last
                q, e = q[::-1], e[::-1]
            a, b, c = q[-2] + e[-1], q[-1], e[-1] * q[-1]
            larger = (a + b + float(np.sqrt((a - b) ** 2 + 4 * c))) / 2
            shift = q[-2] * (b / larger) if larger > 0 else 0.0
            new_q, new_e, left = _dqds(q, e, shift)
            if new_q is None and new_e == len(q) - 1 and shift + left > 0:
                shift += left
                new_q, new_e, left = _dqds(q, e, shift)
            if new_q is None:
                shift = safe
                new_q, new_e, left = _dqds(q, e, shift)
            if new_q is None:
                shift = 0.0
                new_q, new_e, left = _dqds(q, e, shift)
            safe = left * (1 - 4 * EPS) if shift == 0.0 else 0.0
            q, e, sigma = new_q, new_e, sigma + shift
        else:
            raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(found))[::-1] * scale ** 2


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue, from its twisted factorisation.

    L D L' - value from the top and U D U' - value from the bottom meet where what remains
    is least.
    """
    n = len(diagonal)
    tiny = EPS * max(float(np.abs(diagonal).max()), 1e-290)
    a = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    q, low = a * a, above / a[:-1]
    floor = EPS * EPS * float(q.max())

    def safe(x: float) -> float:
        return x if abs(x) > floor else (floor if x >= 0 else -floor)

    s, down = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        down[i] = q[i] * low[i] / safe(s[i] + q[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    p, up = np.empty(n), np.empty(n - 1)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = q[i] / safe(q[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues of R'R and their unit vectors, as columns.

    Eigenvalues that are zero to double precision have no direction and are left out.
    """
    diagonal, above, rights = bidiagonal(r)
    values = qd_eigenvalues(diagonal, above)
    values = values[:most][values[:most] > len(r) * EPS * values[0]]
    vectors: list[np.ndarray] = []
    product = np.diag(diagonal ** 2) + np.diag(np.append(0.0, above ** 2))
    product += np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    for k, value in enumerate(values):
        close = [v for v, other in zip(vectors, values) if other - value <= CLOSE * other]
        z = twisted_vector(diagonal, above, value) if len(diagonal) > 1 else np.ones(1)

        def apart(z: np.ndarray) -> np.ndarray:
            for v in close + close:
                z = z - (z @ v) * v
            return z

        if close and np.linalg.norm(apart(z)) < 0.5:  # inverse iteration beside the others
            z = apart(np.random.default_rng(k).standard_normal(len(z)))
            shifted = product - np.eye(len(z)) * (value + 8 * EPS * values[0])
            for _ in range(3):
                z = apart(np.linalg.solve(shifted, z / np.linalg.norm(z)))
        z = apart(z)
        vectors.append(z / np.linalg.norm(z))
    out = np.array(vectors).reshape(len(values), len(r)).T
    for i in range(len(rights) - 1, -1, -1):
        v, b = rights[i]
        out[i + 1:] -= b * np.outer(v, v @ out[i + 1:])
    top = np.abs(out).argmax(axis=0) if out.size else np.zeros(0, int)
    return values, out * np.where(out[top, np.arange(out.shape[1])] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector x: project x - sums / n on a direction, divide by its root."""

    width: int
    n: int                   # distinct vectors of the fit
    sums: list[int]          # of each dimension, exact
    largest: int             # absolute entry
    values: np.ndarray       # eigenvalues of the covariance, falling
    directions: np.ndarray   # (width, components)
    trace: float             # of the covariance
    identity_error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - sums: whole numbers, as Python's own where longs are too short."""
        if self.n * 2 * (self.largest + 1) < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sums)^2, exact."""
        d = self.scaled(x)
        if d.dtype != object and (np.square(d.astype(np.float64)).sum(axis=1) < 2.0 ** 62).all():
            return (d * d).sum(axis=1).tolist()
        return [sum(int(v) * int(v) for v in row) for row in d]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values))


def fit_whitening(fit: DataFrame, width: int, most: int) -> Whitening | None:
    """The whitening of distinct vectors (x) of one width; None where there's no vector."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, largest = np.zeros((3, width), np.int64), 0, 0
        for _, x in _blocks(batches, width):
            # in three parts, so that sums of many large entries fit
            for i, part in enumerate((x & 0xFFFFFF, x >> 24 & 0xFFFFFF, x >> 48)):
                total[i] += part.sum(axis=0)
            n, largest = n + len(x), max(largest, int(x.max()), -int(x.min()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([[n, *total.reshape(-1).tolist()]], pa.list_(pa.int64())),
             pa.array([largest], pa.int64())], ["sums", "largest"])

    parts = settled(fit.mapInArrow(summed, "sums array<long>, largest long"), "vector-sums")
    n, *sums = _added(parts) or [0]
    if not n:
        return None
    low, middle, high = (sums[i * width:(i + 1) * width] for i in range(3))
    totals = [a + (b << 24) + (c << 48) for a, b, c in zip(low, middle, high, strict=True)]
    made = Whitening(width, n, totals, parts.agg(F.max("largest")).first()[0],
                     np.zeros(0), np.zeros((width, 0)), 0.0)

    def reduced(blocks: Iterator[np.ndarray]) -> bytes:
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return np.concatenate([r, np.zeros((width - len(r), width))]).tobytes()

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduced(made.centred(x) for _, x in _blocks(batches, width))
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary())], ["r"])

    def stacked(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"turn": [key[0]], "r": [reduced(
            np.frombuffer(r).reshape(width, width) for frame in rows for r in frame["r"])]})

    triangles = settled(fit.mapInArrow(triangle, "r binary").select(
        F.spark_partition_id().alias("turn"), "r"), "triangles")
    for fewer in (256, 16):
        triangles = triangles.withColumn("turn", F.col("turn") % fewer).groupBy(
            "turn").applyInPandas(stacked, "turn int, r binary")
    r = np.frombuffer(reduced(np.frombuffer(row.r).reshape(width, width)
                              for row in triangles.sort("turn").collect())).reshape(width, width)
    # at most 16 triangles
    values, directions = leading(r, most)
    k = len(values)
    made = Whitening(width, n, totals, made.largest, values / n, directions,
                     float((r * r).sum()) / n)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, width):
            w = made.whitened(x)
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array([[*first.tolist(), *second.reshape(-1).tolist()]], pa.list_(pa.float64()))],
            ["sums"])

    got = np.array(_added(fit.mapInArrow(moments, "sums array<double>")), float) / n
    mean, square = got[:k], got[k:].reshape(k, k)
    error = np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0)
    return Whitening(width, n, totals, made.largest, made.values, made.directions, made.trace,
                     float(error))


def whiten(rows: DataFrame, vector: str = "embedding", most: int = 16) -> DataFrame:
    """Rows of (vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null, empty or hold null, non-finite or (beyond 2^62 / 64) too large
    entries are left out, and so are those whose length isn't that of the most vectors (the
    longer one of a tie): they have no place in the covariance.  The fit takes each
    distinct vector once, so copies change nothing; every remaining row is whitened, rows
    alike alike, null ids too.  There are ``most`` components or as many as the vectors
    span: equal vectors, or a single one, give no rows, nor does an empty table.  Of tied
    eigenvalues any orthonormal vectors are taken; a vector's largest entry is positive.
    ``deviation`` is DECIMAL(38, 0), null beyond that.  Only vec_id and the vector are read.
    """
    spark = rows.sparkSession
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    kept = settled(whole_vectors(rows, vector), "vectors")
    common = kept.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common.width
    kept = kept.where(F.col("width") == width)
    fit = settled(kept.select("x").distinct(), "distinct-vectors")
    made = fit_whitening(fit, width, most)
    if not len(made.values):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, limit = len(made.values), 10 ** 38
        for part, x in _blocks(batches, width, 1):
            rows = len(x)
            at = np.repeat(np.arange(rows), k)
            far = pa.array([Decimal(d) if d < limit else None for d in made.deviation(x)],
                           pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, made.n)), far.take(pa.array(at)),
                 pa.array(made.whitened(x).reshape(-1)),
                 pa.array(np.tile(made.values / made.trace, rows)),
                 pa.array(np.full(rows * k, made.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained",
                 "identity_error"])

    return kept.select("vec_id", "x").mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation AS BIGINT)"))
