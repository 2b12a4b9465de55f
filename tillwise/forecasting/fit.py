"""Least-squares fits of every candidate on every series.

Moving-average terms use two-stage least squares (Hannan and Rissanen 1982): a
long autoregression gives residuals, whose lags then enter the regression.
Seasonal lags are additive. Coefficients therefore differ from exact maximum
likelihood. Spark shapes the designs and sums them to one Gram matrix per (series,
block); the only Python is the solve of its sub-matrices, and no design row reaches it.
Which candidates a series tries is a table as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.forecasting.design import (
    LONG_AR,
    Shape,
    lagged,
    shape_of,
    with_residuals,
    without_residuals,
)
from tillwise.forecasting.specs import Spec, spec_table
from tillwise.operators.gram import gram

RIDGE = 1e-8  # on the unit-diagonal normal equations: near-collinear regressors stay solvable

# Squared errors below this share of the target's raw squares are rounding, not a fit.
LEAST_ERROR = 1e-12

FIT_SCHEMA = (
    "series_id string, block int, ord int, n long, k int, sse double, aic double, const double, "
    "phi array<double>, beta array<double>, theta array<double>, level_ar array<double>, fitted boolean"
)


def solve(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Ridge-guarded solution of gram @ b = cross after scaling to unit diagonal.

    Two refinement steps take the ridge's bias out of well-determined directions.
    """
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    unit, target = gram / np.outer(scale, scale), cross / scale
    guarded = unit + RIDGE * np.eye(len(scale))
    b = np.linalg.solve(guarded, target)
    for _ in range(2):
        b = b + np.linalg.solve(guarded, target - unit @ b)
    return b / scale


def full_matrix(cells) -> np.ndarray:
    """The symmetric matrix behind an upper triangle."""
    cells = np.asarray(cells, float)
    size = int(math.isqrt(8 * len(cells) + 1) - 1) // 2
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = cells
    return out + np.triu(out, 1).T


def least_squares(full: np.ndarray, columns: list[int], constant: bool):
    """(const, coefficients, sse) of one candidate, or None where it cannot be fitted.

    ``full`` is the Gram matrix of (1, regressors..., target); ``columns`` counts the regressors from 0.
    """
    n, sums = full[0, 0], full[0, 1:]
    if n <= len(columns) + constant + 1:
        return None
    products = full[1:, 1:] - np.outer(sums, sums) / n if constant else full[1:, 1:]
    inner, cross = products[np.ix_(columns, columns)], products[columns, -1]
    b = solve(inner, cross) if columns else np.zeros(0)
    sse = float(products[-1, -1] - 2 * b @ cross + b @ inner @ b)
    const = float((sums[-1] - sums[columns] @ b) / n) if constant else 0.0
    return (const, b, sse) if math.isfinite(sse) and sse > LEAST_ERROR * full[-1, -1] else None


def level_polynomial(phi: np.ndarray, block: tuple[int, int, int], length: int) -> np.ndarray:
    """Lag weights on the undifferenced target: AR polynomial times the differences."""
    d, seasonal, s = block
    poly = np.concatenate([[1.0], -phi])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal):
        poly = np.convolve(poly, np.concatenate([[1.0], np.zeros(s - 1), [-1.0]]))
    weights = np.zeros(length)
    tail = -poly[1 : length + 1]
    weights[: len(tail)] = tail
    return weights


def _first_stage(rows: DataFrame, shape: Shape) -> DataFrame:
    """Long autoregression per (series, block): coefficients over (1, lags, exog)."""
    sample = rows.where(F.col("in_fit") & (F.col("position") > shape.first_stage_after) & F.col("lags").isNotNull())
    sums = gram(sample, ["series_id", "block"], F.concat(F.array(F.lit(1.0)), "lags", "dx", F.array("dy")))
    columns = list(range(shape.history + shape.n_exog))

    def run(batches):
        for batch in batches:
            found = [(r["series_id"], r["block"], least_squares(full_matrix(r["cells"]), columns, True)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(
                [{"series_id": s, "block": i, "first_coef": [f[0], *f[1].tolist()]} for s, i, f in found if f], schema=ARROW_FIRST_SCHEMA
            )

    return sums.mapInArrow(run, "series_id string, block int, first_coef array<double>")


def design_rows(series: DataFrame, specs: list[Spec], n_exog: int, long_ar: int = LONG_AR) -> tuple[DataFrame, Shape]:
    """All lag and residual-lag columns the candidates need."""
    shape = shape_of(specs, n_exog, long_ar)
    rows = lagged(series, shape)
    if shape.ma:
        return with_residuals(rows, _first_stage(rows, shape), shape), shape
    return without_residuals(rows), shape


def candidate_lists(rows: DataFrame, shape: Shape, specs: list[Spec], chosen: DataFrame | None = None) -> DataFrame:
    """(series_id, block, tries): what every series tries, grouped by the block that its fit needs.

    ``chosen`` (series_id, ord) names candidates series by series; without it every series tries all.
    The candidate table is as long as the list of specifications, so it is broadcast.
    """
    block = F.create_map(*[F.lit(x) for i, s in enumerate(specs) for x in (i, shape.blocks.index(s.block))])
    table = spec_table(rows.sparkSession, specs).withColumn("block", block[F.col("ord")])
    listed = F.sort_array(F.collect_list(F.struct("ord", "p", "q", "seasonal_p", "seasonal_q", "s", "trend"))).alias("tries")
    if chosen is not None:
        return chosen.select("series_id", "ord").distinct().join(F.broadcast(table), "ord").groupBy("series_id", "block").agg(listed)
    every = rows.groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return every.join(F.broadcast(table.groupBy("block").agg(listed)), "block")


def fit_candidates(rows: DataFrame, shape: Shape, specs: list[Spec], chosen: DataFrame | None = None) -> DataFrame:
    """Coefficients, SSE and AIC of every candidate that a series tries; one that fails has ``fitted`` false and no SSE.

    AIC = n ln(SSE/n) + 2k, with all candidates of a series on the same rows.
    """
    tries = candidate_lists(rows, shape, specs, chosen)
    if chosen is not None:
        rows = rows.join(tries.select("series_id", "block"), ["series_id", "block"], "left_semi")
    vector = F.concat("lags", "dx", "residual_lags")
    sample = rows.where(
        F.col("in_fit") & (F.col("position") > shape.sample_after) & F.col("dy").isNotNull() & vector.isNotNull()
    )
    sums = gram(sample, ["series_id", "block"], F.concat(F.array(F.lit(1.0)), vector, F.array("dy")))
    h, k = shape.history, shape.n_exog
    exog = list(range(h, h + k))

    def one(row: dict, full: np.ndarray | None, t: dict) -> dict:
        spec = Spec(t["p"], 0, t["q"], t["seasonal_p"], 0, t["seasonal_q"], t["s"], t["trend"])
        columns = [lag - 1 for lag in spec.ar_lags()] + exog + [h + k + lag - 1 for lag in spec.ma_lags()]
        size = len(columns) + spec.trend
        n = 0 if full is None else round(full[0, 0])
        out = {"series_id": row["series_id"], "block": row["block"], "ord": t["ord"], "n": n, "k": size, "fitted": False}
        fit = None if full is None else least_squares(full, columns, spec.trend)
        if fit is None:
            return out
        const, b, sse = fit
        spread = np.zeros(h + k + shape.ma)
        spread[columns] = b
        return out | {
            "fitted": True,
            "sse": sse,
            "aic": n * math.log(sse / n) + 2 * size,
            "const": const,
            "phi": spread[: shape.ar].tolist(),
            "beta": spread[h : h + k].tolist(),
            "theta": spread[h + k :].tolist(),
            "level_ar": level_polynomial(spread[: shape.ar], shape.blocks[row["block"]], shape.level_lags).tolist(),
        }

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                full = None if row["cells"] is None else full_matrix(row["cells"])
                yield pa.RecordBatch.from_pylist([one(row, full, t) for t in row["tries"]], schema=ARROW_FIT_SCHEMA)

    return tries.join(sums, ["series_id", "block"], "left").mapInArrow(run, FIT_SCHEMA)


_LIST = pa.list_(pa.float64())
ARROW_FIRST_SCHEMA = pa.schema([("series_id", pa.string()), ("block", pa.int32()), ("first_coef", _LIST)])
ARROW_FIT_SCHEMA = pa.schema(
    [
        ("series_id", pa.string()),
        ("block", pa.int32()),
        ("ord", pa.int32()),
        ("n", pa.int64()),
        ("k", pa.int32()),
        ("sse", pa.float64()),
        ("aic", pa.float64()),
        ("const", pa.float64()),
        ("phi", _LIST),
        ("beta", _LIST),
        ("theta", _LIST),
        ("level_ar", _LIST),
        ("fitted", pa.bool_()),
    ]
)
FIT_COLUMNS = ARROW_FIT_SCHEMA.names[:-1]


def best_by_aic(fits: DataFrame) -> DataFrame:
    """The candidate with the least AIC per series; ties go to the earlier one."""
    best = F.min_by(F.struct(*FIT_COLUMNS[1:]), F.struct("aic", "ord"))
    return fits.where(F.col("aic").isNotNull()).groupBy("series_id").agg(best.alias("_b")).select("series_id", "_b.*")


def with_fallback(best: DataFrame, series: DataFrame, shape: Shape, fallback: Spec) -> DataFrame:
    """Give every series a model: where nothing fitted, the fallback's differences alone.

    Such a series is too short to estimate anything, so the fallback carries
    zero coefficients (a random walk on its differences) and a null AIC.
    """
    walk = level_polynomial(np.zeros(shape.ar), fallback.block, shape.level_lags)
    zeros = {"phi": [0.0] * shape.ar, "beta": [0.0] * shape.n_exog, "theta": [0.0] * shape.ma, "level_ar": walk.tolist()}
    every = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    out = every.join(best, "series_id", "left").withColumn("is_fallback", F.col("ord").isNull())
    out = out.withColumns(
        {c: F.coalesce(c, F.array(*[F.lit(v) for v in vs]).cast("array<double>")) for c, vs in zeros.items()}
    )
    return out.withColumns(
        {
            "block": F.coalesce("block", F.lit(shape.blocks.index(fallback.block))),
            "const": F.coalesce("const", F.lit(0.0)),
        }
    )


def spec_text(specs: list[Spec], fallback: Spec | None = None, order: str = "ord"):
    """Readable specification column for result tables."""

    def text(s: Spec) -> str:
        return f"({s.p},{s.d},{s.q})({s.P},{s.D},{s.Q},{s.s})" + ("+c" if s.trend else "")

    names = F.array(*[F.lit(text(s)) for s in specs])
    found = F.get(names, F.col(order))
    return F.coalesce(found, F.lit(text(fallback))) if fallback else found


__all__ = [
    "best_by_aic",
    "design_rows",
    "fit_candidates",
    "spec_text",
    "with_fallback",
]
