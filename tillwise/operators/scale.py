"""Per-series scaling. A fitted scaler is a table or a column, never driver state.

Both methods reduce to (x - center) / scale with scale 1 for a constant column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.rolling import KEYS
from tillwise.functions.scalars import at_least_zero

MINMAX, STANDARD = "minmax", "standard"


def _center_scale(c: Column, method: str) -> tuple[Column, Column]:
    """The two fitted numbers as aggregates."""
    if method == MINMAX:
        center, spread = F.min(c), F.max(c) - F.min(c)
    elif method == STANDARD:
        center, spread = F.avg(c), F.stddev_pop(c)
    else:
        raise ValueError(f"unknown scaling {method!r}")
    return center.cast("double"), F.when(spread == 0, F.lit(1.0)).otherwise(spread.cast("double"))


def _fitted_on(c: str, where: Column | None) -> Column:
    return F.col(c) if where is None else F.when(where, F.col(c))


def fit_scaler(
    df: DataFrame, columns: list[str], method: str, keys=KEYS, where: Column | None = None
) -> DataFrame:
    """Parameter table (keys, column_name, center, scale), fitted on the rows in ``where``."""
    cells = []
    for c in columns:
        center, scale = _center_scale(_fitted_on(c, where), method)
        cells.append(F.struct(F.lit(c).alias("column_name"), center.alias("center"), scale.alias("scale")))
    return df.groupBy(*keys).agg(F.array(*cells).alias("_p")).select(*keys, F.inline("_p"))


def with_scaler(
    df: DataFrame, columns: list[str], method: str, keys=KEYS, where: Column | None = None, name: str = "scaler"
) -> DataFrame:
    """Fit and attach in one step: a struct column of parameters on every row.

    Grouping and join both use the series partitioning the feature windows
    left behind, so neither shuffles the rows again. Window aggregates would
    save the join but cost several times more with many columns.
    """
    fields = []
    for c in columns:
        center, scale = _center_scale(_fitted_on(c, where), method)
        fields.append(F.struct(center.alias("center"), scale.alias("scale")).alias(c))
    return df.join(df.groupBy(*keys).agg(F.struct(*fields).alias(name)), list(keys))


def attach_scaler(df: DataFrame, params: DataFrame, columns: list[str], keys=KEYS, name: str = "scaler") -> DataFrame:
    """Join a parameter table fitted elsewhere as a struct column."""
    entry = F.struct("column_name", F.struct("center", "scale"))
    table = params.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    fields = F.struct(*[F.element_at("_m", F.lit(c)).alias(c) for c in columns]).alias(name)
    return df.join(table.select(*keys, fields), list(keys), "left")


def scaled(c: str, scaler: str = "scaler", of: str | None = None) -> Column:
    p = F.col(f"{scaler}.{of or c}")
    return (F.col(c) - p["center"]) / p["scale"]


def unscaled(value, of: str, scaler: str = "scaler") -> Column:
    p = F.col(f"{scaler}.{of}")
    value = F.col(value) if isinstance(value, str) else value
    return value * p["scale"] + p["center"]


def scale_columns(df: DataFrame, columns: list[str], scaler: str = "scaler") -> DataFrame:
    """Overwrite the columns by their scaled values."""
    return df.withColumns({c: scaled(c, scaler) for c in columns})


def amount_back(value, of: str, scaler: str = "scaler") -> Column:
    """Standardised log amount back to a non-negative amount."""
    return at_least_zero(F.expm1(unscaled(value, of, scaler)))
