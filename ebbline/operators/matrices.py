"""Eigenvalues of a correlation matrix that is never formed: products with it are two passes over a panel of returns.

A panel has a row per date with the standardised returns of all assets as one array. C q = X'(X q) / n, so a block of vectors is
multiplied inside tasks and only sums of assets times block size numbers come together. Block Lanczos with full
orthogonalisation needs a few such products for the eigenvalues above the noise limit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.operators.series import aligned

#: Assets whose vectors the driver holds (eight of them 8 MB); vectors of a block; products at most.
MOST_ASSETS, BLOCK, MOST_PRODUCTS, TOLERANCE, SEED = 100_000, 8, 80, 1e-9, 11


def panel(returns: DataFrame) -> tuple[list[str], DataFrame]:
    """Names in order, and date, x: the standardised returns of all assets, on the dates that have them all. Assets without variation count as 0."""
    rows = aligned(returns)
    each = rows.groupBy("asset").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    names = [r.asset for r in each.select("asset").orderBy("asset").limit(MOST_ASSETS + 1).collect()]
    if len(names) > MOST_ASSETS:
        raise ValueError(f"{MOST_ASSETS} assets at most")
    z = F.coalesce((F.col("r") - F.col("mean")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0))
    arrays = rows.join(each, "asset").groupBy("date").agg(F.sort_array(F.collect_list(F.struct("asset", z.alias("z")))).alias("a"))
    return names, arrays.select("date", F.transform("a", lambda e: e["z"]).alias("x"))


def product(x: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'X q for the rows x of X: each task sums over its dates, an aggregate adds up the tasks."""

    def part(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            m = values.reshape(-1, len(q))
            total += m.T @ (m @ q)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), *[pa.array(total[:, k].copy()) for k in range(q.shape[1])]], names=["i", *[f"v{k}" for k in range(q.shape[1])]])

    columns = [f"v{k}" for k in range(q.shape[1])]
    summed = x.select("x").mapInArrow(part, "i long, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns])
    out = np.zeros(q.shape)
    found = summed.toArrow()
    out[found.column("i").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], 1)
    return out


def leading(multiply, size: int, limit: float, block: int = BLOCK, products: int = MOST_PRODUCTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above limit of a symmetric matrix, falling, and their vectors; multiply(q) gives the matrix times a block of vectors."""
    v, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, min(block, size))))
    basis, images = v, np.zeros((size, 0))
    for _ in range(products):
        images = np.hstack([images, multiply(v)])
        small = basis.T @ images
        values, y = np.linalg.eigh((small + small.T) / 2)
        residual = np.linalg.norm(images @ y - basis @ y * values, axis=0)
        # A value within its residual of the limit could be on either side.
        if basis.shape[1] == size or not ((values + residual > limit) & (residual > TOLERANCE * max(values[-1], 1e-300))).any():
            break
        w = images[:, -v.shape[1] :]
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        v = u[:, s > 1e-12 * max(values[-1], 1e-300)][:, : size - basis.shape[1]]
        if not v.shape[1]:
            break
        v = v - basis @ (basis.T @ v)
        v, _ = np.linalg.qr(v)
        basis = np.hstack([basis, v])
    else:
        raise ArithmeticError(f"eigenvalues above {limit} after {products} products not settled")
    above = np.flatnonzero(values > limit)[::-1]
    return values[above], basis @ y[:, above]


def cleaned_correlation(returns: DataFrame) -> DataFrame:
    """asset_i, asset_j, correlation of the eigenvalues above the Marchenko-Pastur limit only, noise_share, limit.

    The result has assets squared rows, each made in the task of its asset_i from that many factor loadings; the driver
    holds loadings (assets times eigenvalues above the limit), never the matrix."""
    spark = returns.sparkSession
    names, x = panel(returns)
    shape = "asset_i string, asset_j string, correlation double, noise_share double, limit double"
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    days = x.count()
    if not names or not days:
        x.unpersist()
        return spark.createDataFrame([], shape)
    limit = (1 + math.sqrt(len(names) / days)) ** 2
    values, vectors = leading(lambda q: product(x, q) / days, len(names), limit)
    x.unpersist()
    loadings = vectors * np.sqrt(values)
    loadings = loadings / np.sqrt(np.maximum((loadings**2).sum(1, keepdims=True), 1e-12))
    noise = 1 - len(values) / len(names)

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                c = loadings @ loadings[i]
                c[i] = 1.0
                n = len(c)
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * n, pa.string()), pa.array(names, pa.string()), pa.array(c), pa.array(np.full(n, noise)), pa.array(np.full(n, limit))], names=["asset_i", "asset_j", "correlation", "noise_share", "limit"])

    return spark.range(len(names)).mapInArrow(rows, shape)
