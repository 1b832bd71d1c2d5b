"""Embedding whitening by a covariance in two passes.

Entries become integers first, x = floor(64 c) + 1000000.  The first pass adds them up
exactly, which gives the mean; the second centres every vector by n x - S, integers still,
and only then multiplies, a block of rows at a time (GEMM).  Blocks of a part are added up in
its task, parts by treeAggregate, so the driver gets a few matrices whatever the number of
parts.  LAPACK's symmetric solver gives the components; they go to all executors once, a
matrix of dimensions by components, and every vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries beyond this are no longer whole numbers that a long holds.
LARGEST = 2.0**62
#: Entries of a block of rows that is worked on at once.
BLOCK = 1 << 20
#: Sums of this size are handed on before they could leave the range of a long.
FULL = 2**62


def entries(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and integer vectors of the rows that take part, those of one length together."""
    vectors = batch.column("embedding")
    length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) * SCALE)
        fine = np.abs(whole) < LARGEST  # false for what is not a number
    start = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length
    for d in np.unique(length) if dim is None else [dim]:
        if d == 0:
            continue
        same, step = np.flatnonzero(length == d), max(1, BLOCK // int(d))
        for k in range(0, len(same), step):
            rows = same[k : k + step]
            at = start[rows][:, None] + np.arange(d)
            usable = fine[at].all(axis=1)
            if usable.any():
                yield rows[usable], whole[at[usable]].astype(np.int64) + OFFSET


def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: dim, n and the sum of each dimension, of a part of the table."""
    kept: dict[int, list] = {}  # no larger than the part itself, as each length has a vector there

    def row(dim: int, n: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"dim": [dim], "n": [n], "sums": [[Decimal(int(s)) for s in sums]]}, SUMS)

    for batch in batches:
        for _, x in entries(batch):
            # a batch's own sums: in parts that can't overflow
            most = max(1, FULL // max(1, int(np.abs(x).max())))
            for k in range(0, len(x), most):
                part, dim = x[k : k + most], x.shape[1]
                n, sums = kept.get(dim, (0, np.zeros(dim, object)))
                kept[dim] = (n + len(part), sums + part.sum(axis=0).astype(object))
    for dim, (n, sums) in kept.items():
        yield row(dim, n, sums)


SUMS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])


def moments(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Length of the vectors that take part, their number, and the exact sum of each dimension."""
    parts = vectors.mapInArrow(column_sums, "dim int, n long, sums array<decimal(38,0)>")
    # a row a part and length; each dimension is added up apart
    per = parts.select("dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    chosen = per.where("at = 0").orderBy(F.col("n").desc(), F.col("dim").desc()).select("dim", "n").first()
    if chosen is None:
        return 0, 0, []
    sums = per.where(F.col("dim") == chosen.dim).orderBy("at").select("s").collect()  # a row a dimension
    return chosen.dim, chosen.n, [int(r.s) for r in sums]


def shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they fit, else as Python's integers."""
    bound = n * int(np.abs(x).max()) + max(map(abs, sums))
    if bound < FULL:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return shifted(x, n, sums).astype(np.float64) / n


def gram(vectors: DataFrame, dim: int, n: int, sums: list[int], projection: np.ndarray | None = None) -> np.ndarray:
    """Second pass: the mean outer product of the centred (and, if asked for, projected) vectors."""
    size = dim if projection is None else projection.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast((n, sums, projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, projection = sent.value
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in entries(batch, dim):
                c = centred(x, n, sums)
                if projection is not None:
                    c = c @ projection
                total += c.T @ c
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    def added(a: np.ndarray, part) -> np.ndarray:
        return a + (np.frombuffer(part.part).reshape(size, size) if hasattr(part, "part") else part)

    parts = vectors.mapInArrow(run, "part binary").rdd
    return parts.treeAggregate(np.zeros((size, size)), added, added, depth=max(2, parts.getNumPartitions().bit_length() // 4)) / n


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and which of them have a variance at all."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return values, vectors, values > max(values[0], 0) * len(covariance) * np.finfo(float).eps


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of vectors(vec_id, embedding).

    A row for every vector and component up to most (or the number of dimensions).  Vectors
    that are null or empty or hold null or non-finite entries take no part, nor do those with
    an entry beyond 2^56, which is no long any more once scaled.  All others are whitened
    together if of one length; of several lengths the most frequent counts (of equally
    frequent ones the longest), and vectors of other lengths take no part.  Repeated rows and
    null ids count like others.  A component without variance has whitened null and explained
    0, and is left out of identity_error; deviation is null where it leaves the range of a
    long.  Equal eigenvalues come in the solver's order.  Other columns are ignored whatever
    their names; no vectors give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    only = rows.select("embedding")
    dim, n, sums = moments(only)
    if not n:
        return spark.createDataFrame([], RESULT)
    covariance = gram(only, dim, n, sums)
    values, axes, varied = components(covariance, most)
    scaled = axes / np.sqrt(np.where(varied, values, 1.0))
    # what is projected is centred exactly (all n x - S add up to 0), so its mean is 0 as well
    there = gram(only, dim, n, sums, scaled[:, varied]) if varied.any() else np.zeros((0, 0))
    error = float(np.abs(there - np.eye(len(there))).max(initial=0.0))
    trace = float(np.trace(covariance))
    explained = np.where(varied, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    sent = spark.sparkContext.broadcast((scaled, varied, sums, explained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, varied, sums, explained = sent.value
        k = len(varied)
        for batch in batches:
            for at, x in entries(batch, dim):
                offset = shifted(x, n, sums)
                if float(np.abs(offset).max()) ** 2 * dim < FULL:
                    deviation = pa.array((offset**2).sum(axis=1))
                else:
                    whole = (offset.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([d if d < 2**63 else None for d in whole], pa.int64())
                projected = (offset.astype(np.float64) / n) @ scaled
                where = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(at[where])), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(len(where), n)), "deviation": deviation.take(pa.array(where)),
                    "whitened": pa.array(projected.ravel(), mask=np.tile(~varied, len(at))), "explained": pa.array(np.tile(explained, len(at))),
                    "identity_error": pa.array(np.full(len(where), error)),
                })

    return rows.mapInArrow(run, RESULT)
