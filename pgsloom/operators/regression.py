"""Linear fits by group from one mergeable aggregate: residuals of scores against principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """(by, n, intercept, coefficients, r2): least squares of ``y`` on ``xs`` in each group.

    The table is read once: means and covariances of all pairs are merged from partial ones, k (k + 3) / 2 numbers a group
    for k components whatever its rows, so a group that holds most of the rows is summed up where they lie. The system of
    k equations is then solved once a group. Rows with a null or NaN in any of the columns are left out; components that do
    not vary, or that depend on others, get the solution of least norm; a group without rows has no fit.
    """
    k, names = len(xs), [*xs, y]
    whole = rows
    for c in names:
        whole = whole.withColumn(c, F.col(c).cast("double")).filter(F.col(c).isNotNull() & ~F.isnan(c))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = whole.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("m"), F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("c"))

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            g = part.num_rows
            means, flat = (np.array(part.column(c).to_pylist(), float).reshape(g, -1) for c in ("m", "c"))
            cov = np.zeros((g, k + 1, k + 1))
            for at, (i, j) in enumerate(pairs):
                cov[:, i, j] = cov[:, j, i] = flat[:, at]
            x, xy, yy = cov[:, :k, :k], cov[:, :k, k], cov[:, k, k]
            # in units of each component's own deviation, so that what counts as dependent has no unit
            scale = np.sqrt(np.einsum("gii->gi", x))
            scale = np.where(scale > 0, scale, 1.0)
            beta = np.einsum("gij,gj->gi", np.linalg.pinv(x / scale[:, :, None] / scale[:, None, :], rcond=1e-10, hermitian=True), xy / scale) / scale
            intercept = means[:, k] - np.einsum("gi,gi->g", beta, means[:, :k])
            r2 = np.divide(np.einsum("gi,gi->g", beta, xy), yy, out=np.zeros(g), where=yy > 0)
            ends = pa.array(np.arange(g + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in by], part.column("n"), pa.array(intercept), pa.ListArray.from_arrays(ends, pa.array(beta.ravel())), pa.array(r2)], names=[*by, "n", "intercept", "coefficients", "r2"])

    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    return sums.mapInArrow(solve, f"{types}n bigint, intercept double, coefficients array<double>, r2 double")


def predicted(xs: list[str]) -> Column:
    """What a fit says of a row that stands beside it."""
    out = F.col("intercept")
    for i, c in enumerate(xs):
        out = out + F.col("coefficients")[i] * F.col(c)
    return out


def residuals(rows: DataFrame, fits: DataFrame, by: list[str], y: str, xs: list[str], out: str = "residual") -> DataFrame:
    """Rows with what is left of ``y``; null where a group has no fit or a component is missing. Fits are a row a group."""
    return rows.join(fits.select(*by, "intercept", "coefficients"), by, "left").withColumn(out, F.col(y) - predicted(xs)).drop("intercept", "coefficients")
