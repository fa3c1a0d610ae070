"""A rotation of vectors to their principal axes, fitted on a bounded sample; any sample gives a rotation, so results never hang on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in the sample, on average: rows whose hash lies below a threshold.
SAMPLE = 4096
RANGE = 1 << 30


def sampled(rows: DataFrame, vector: str, total: int, sample: int = SAMPLE) -> np.ndarray:
    """About ``sample`` vectors, chosen by their hash: the same ones at every run, and few from any partition."""
    few = rows.where(F.pmod(F.xxhash64(vector), F.lit(RANGE)) < int(min(1.0, sample / max(total, 1)) * RANGE)).select(vector).toArrow()
    return np.array(few.column(0).to_pylist(), np.float64)


def principal_axes(sample: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal columns by falling variance, and the variances."""
    if len(sample) < 2:
        return np.eye(size), np.ones(size)
    with np.errstate(all="ignore"):
        covariance = np.cov(sample, rowvar=False).reshape(size, size)
    if not np.isfinite(covariance).all():
        return np.eye(size), np.ones(size)
    values, axes = np.linalg.eigh(covariance)
    return axes[:, ::-1].copy(), np.maximum(values[::-1], 0)


def proper_vector(column: str, size: int | None = None) -> Column:
    """Is it an array (of ``size`` components) of numbers, none of them NULL, NaN or infinite?"""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & ((F.size(x) == size) if size else (F.size(x) > 0)), F.lit(False))
