"""Embedding whitening by pivoted Cholesky and one-sided Jacobi (operator 13).

Entries become integers, ``x = floor(1024 * c) + 100000``, so every sum over the
corpus is exact and does not depend on the order of the rows:

1. one pass counts the rows and sums every dimension (per vector length);
2. a second pass subtracts the rounded means and sums the products of the
   centred entries, the scatter, in limbs of 21 bits whose float64 matrix products are exact;
3. the scatter, ``d * d`` numbers whatever the rows, is factored on the driver as
   ``P'AP = LL'`` by pivoted Cholesky; one-sided Jacobi rotations make the columns of ``L``
   orthogonal.  Their squared norms are the eigenvalues and the normalised columns the components, to high
   relative accuracy, since ``LL'`` is never formed again;
4. a third pass projects the centred rows and writes the whitened values; their own
   covariance, computed from the written rows, gives ``identity_error``.

Defined results: a row whose vector is null, empty, or holds null or non-finite
entries is dropped, as is one whose length is not the most frequent (of equally
frequent ones the largest); entries beyond 2**61 count as 2**61; repeated rows count
each; ids may be null and of any type; components without variance (beyond rounding) are left out, so
equal or single vectors and an empty table give no rows; extra columns are ignored.  ``deviation`` is null
where it does not fit a long; ``distance2``, the squared distance from the mean, is always given.

Scale: tasks send one row of sums for each pair of dimensions, added up by Spark; nothing grows with the rows
but the whitened values, ``components`` doubles a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, table

SCALE, SHIFT = 1024, 100_000
_BITS = 21  # a product of two limbs is below 2**42, so 2,048 of them add up exactly in float64
_BLOCK = 1024
_MOST = float(1 << 61)
_WIDE = pa.decimal128(38, 0)


# ---------------------------------------------------------------- rows

def matrices(vectors: pa.Array, length: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, float64 matrix) of the usable vectors of a batch."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, np.int64)
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    first = vectors.offsets.to_numpy()[:-1].astype(np.int64)
    entries = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    for d in [length] if length else np.unique(sizes[known & (sizes > 0)]):
        rows = np.flatnonzero(known & (sizes == d))
        for at in range(0, len(rows), _BLOCK):
            part = rows[at : at + _BLOCK]
            x = entries[first[part][:, None] + np.arange(d)[None, :]]
            fine = np.isfinite(x).all(axis=1)
            if fine.any():
                yield int(d), part[fine], x[fine]


def integers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """float64 limbs whose sum over ``limb[k] * 2**(21 * k)`` is ``y``; as many as its size needs."""
    out = []
    while True:
        if (np.abs(y) < 1 << _BITS).all():
            return [*out, y.astype(float)]
        out.append((y & ((1 << _BITS) - 1)).astype(float))
        y = y >> _BITS


class Sums:
    """Exact sums of int64 arrays, by limb."""

    def __init__(self) -> None:
        self.level: dict[int, np.ndarray] = {}

    def add(self, level: int, value: np.ndarray) -> None:
        """``value`` holds whole numbers below 2**53."""
        if level not in self.level:
            self.level[level] = np.zeros(value.shape, object)
            self._small = getattr(self, "_small", {}) | {level: (np.zeros(value.shape, np.int64), 0)}
        small, n = self._small[level]
        small += value.astype(np.int64)
        if n == 511:
            self.level[level] = self.level[level] + small
            small = np.zeros(value.shape, np.int64)
        self._small[level] = (small, (n + 1) % 512)

    def items(self) -> Iterator[tuple[int, np.ndarray]]:
        for level, total in self.level.items():
            yield level, total + self._small[level][0]


def _sums_of(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[Sums, int]] = {}
        held = 0
        for batch in batches:
            for d, rows, c in matrices(batch.column(0)):
                sums, n = found.get(d) or (Sums(), 0)
                held += 0 if d in found else d
                for k, limb in enumerate(limbs(integers(c))):
                    sums.add(k, limb.sum(axis=0))
                found[d] = (sums, n + len(rows))
            if held > 1 << 20:  # many lengths
                yield from _sum_rows(found, columns)
                found, held = {}, 0
        yield from _sum_rows(found, columns)

    return run


def _sum_rows(found: dict, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for d, (sums, n) in found.items():
        for level, total in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(d, d), pa.int64()), pa.array(np.full(d, n if level == 0 else 0), pa.int64()),
                pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, level), pa.int32()),
                pa.array([Decimal(int(v)) for v in total], _WIDE)], names=columns)


# ---------------------------------------------------------------- the factorisation

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``l``, ``order``) with ``a[order][:, order] = l @ l.T``, ``l`` lower trapezoidal of the numerical rank."""
    a = a.copy()
    d = len(a)
    order, l = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(float(np.diag(a).max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if not a[p, p] > floor:
            return l[:, :k], order
        for m in (a, l):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        l[k, k] = np.sqrt(a[k, k])
        l[k + 1 :, k] = a[k + 1 :, k] / l[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
    return l, order


def jacobi_columns(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` times rotations that make its columns orthogonal, by rounds of disjoint pairs."""
    g = l.T.copy()
    r = len(g)
    if r < 2:
        return g.T
    even = r + r % 2
    ring = np.arange(even)
    tolerance = np.finfo(float).eps * np.sqrt(len(l))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = g[p], g[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > tolerance
            if turn.any():
                p, q, x, y, xx, yy, xy = p[turn], q[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                g[p], g[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= tolerance:
            break
    return g.T


def principal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the symmetric ``a``, those without variance left out."""
    l, order = pivoted_cholesky(a)
    if not l.shape[1]:
        return np.empty(0), np.empty((len(a), 0))
    turned = jacobi_columns(l)
    norm = np.sqrt((turned * turned).sum(axis=0))
    rank = np.argsort(-norm, kind="stable")
    rank = rank[norm[rank] > 0]
    out = np.empty((len(a), len(rank)))
    out[order] = turned[:, rank] / norm[rank]
    return norm[rank] ** 2, out


# ---------------------------------------------------------------- the operator

def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8) -> dict | None:
    """Mean, components and eigenvalues of the usable vectors; None without any."""
    values = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    names = ["d", "n", "i", "level", "s"]
    sums = values.mapInArrow(_sums_of(names), "d long, n long, i int, level int, s decimal(38,0)")
    sums = materialize(sums.groupBy("d", "i", "level").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "whiten-sums")
    most = sums.where("i = 0 and level = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most.d, most.n
    total = [0] * d
    for r in sums.where(F.col("d") == d).collect():  # d rows a limb
        total[r.i] += int(r.s) << (_BITS * r.level)
    centre = [(2 * s + n) // (2 * n) for s in total]  # the rounded means
    rest = [s - n * m for s, m in zip(total, centre)]
    middle = np.array(centre, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = Sums()
        for batch in batches:
            for _, _, c in matrices(batch.column(0), d):
                part = limbs(integers(c) - middle)
                for k, a in enumerate(part):
                    for m, b in enumerate(part):
                        scatter.add(k + m, a.T @ b)
        i, j = np.triu_indices(d)
        for level, value in scatter.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), level), pa.int32()),
                pa.array([Decimal(int(v)) for v in value[i, j]], _WIDE)], names=["i", "j", "level", "s"])

    entries = values.mapInArrow(products, "i int, j int, level int, s decimal(38,0)")
    # n * n * V, whole numbers: d * (d + 1) / 2 of them a limb level, whatever the rows
    exact = np.zeros((d, d), object)
    for r in entries.groupBy("i", "j", "level").agg(F.sum("s").alias("s")).collect():
        exact[r.i, r.j] += (int(r.s) << (_BITS * r.level)) * n
    covariance = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (int(exact[i, j]) - rest[i] * rest[j]) / (n * n)
    value, unit = principal(covariance)
    keep = int((value[:components] > d * np.finfo(float).eps * value[:1].max(initial=0.0)).sum())
    return {"d": d, "n": n, "centre": centre, "rest": rest, "values": value[:keep], "units": unit[:, :keep],
            "trace": float(np.trace(covariance))}


def deviations(y: np.ndarray, n: int, rest: list[int]) -> tuple[list[int | None], np.ndarray]:
    """(exact sum of ``(n * y - rest)**2`` or None beyond a long, squared distance from the mean) of each row."""
    off = np.array(rest, float) / n
    distance = ((y - off) ** 2).sum(axis=1)
    about = distance * float(n) * float(n)
    small = n * float(np.abs(y).max(initial=0)) + n < 2.0**62  # then n * y - rest fits a long
    out: list[int | None] = [None] * len(y)
    quick = about < 2.0**62 if small else np.zeros(len(y), bool)
    if quick.any():
        gap = y[quick] * np.int64(n) - np.array(rest, np.int64)
        for k, v in zip(np.flatnonzero(quick), (gap * gap).sum(axis=1).tolist()):
            out[k] = v
    for k in np.flatnonzero(~quick & (about < 2.0**63 * 1.001)):
        exact = sum((n * int(v) - r) ** 2 for v, r in zip(y[k], rest))
        out[k] = exact if exact < 1 << 63 else None
    return out, distance


def whiten(vectors: DataFrame, components: int = 8, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, distance2, whitened, explained, identity_error`` of every usable row and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[ident].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, distance2 double, w array<double>"
    model = fit(vectors, vector, components)
    if model is None or not len(model["values"]):
        empty = spark.createDataFrame([], schema)
        return empty.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", "distance2",
                            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    d, n, rest = model["d"], model["n"], model["rest"]
    middle, off = np.array(model["centre"], np.int64), np.array([r / n for r in rest])
    project = model["units"] / np.sqrt(model["values"])
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, c in matrices(batch.column(1), d):
                y = integers(c) - middle
                # not by BLAS, whose order of addition may change with the batch
                w = np.einsum("ij,jk->ik", y - off, project)
                exact, distance = deviations(y, n, rest)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array(exact, pa.int64()), pa.array(distance),
                    pa.ListArray.from_arrays(np.arange(0, k * len(rows) + 1, k, dtype=np.int32), pa.array(w.ravel()))],
                    names=["vec_id", "deviation", "distance2", "w"])

    wide = vectors.select(F.col(ident), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)
    wide = materialize(wide, "whitened")
    entry = [F.get("w", F.lit(i)) for i in range(k)]
    mean = wide.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(entry)]).first()
    gap = [e - F.lit(float(m)) for e, m in zip(entry, mean)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = wide.agg(*[F.avg(gap[i] * gap[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, second))
    share = F.array(*[F.lit(float(v / model["trace"])) for v in model["values"]])
    long = wide.select("vec_id", "deviation", "distance2", F.posexplode("w").alias("k", "whitened"))
    return long.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                       "distance2", "whitened", F.get(share, F.col("k")).alias("explained"),
                       F.lit(float(error)).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
