"""Candidate specifications."""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Spec(NamedTuple):
    """(p,d,q)(P,D,Q,s) with an optional constant in the differenced equation."""

    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0
    trend: bool = False

    @property
    def block(self) -> tuple[int, int, int]:
        """What fixes the differenced sample: (d, D, s when seasonal differencing is on)."""
        return (self.d, self.D, self.s if self.D else 0)

    def ar_lags(self) -> list[int]:
        return sorted({*range(1, self.p + 1), *(self.s * k for k in range(1, self.P + 1))})

    def ma_lags(self) -> list[int]:
        return sorted({*range(1, self.q + 1), *(self.s * k for k in range(1, self.Q + 1))})


def arima_grid(max_p: int = 3, max_d: int = 2, max_q: int = 3) -> list[Spec]:
    """Full grid; a constant only without differencing."""
    grid = product(range(max_p + 1), range(max_d + 1), range(max_q + 1))
    return [Spec(p, d, q, trend=d == 0) for p, d, q in grid]


def sarima_grid(max_p: int = 2, max_d: int = 1, max_q: int = 2, s: int = 7) -> list[Spec]:
    """Full grid times the on/off seasonal orders, no constant."""
    grid = product(range(max_p + 1), range(max_d + 1), range(max_q + 1), range(2), range(2), range(2))
    return [Spec(*orders, s) for orders in grid]


# The two hand-picked candidate lists, in trial order, and the
# specifications used when no candidate can be fitted.
SARIMAX_MAIN = [
    Spec(3, 1, 3, 1, 1, 1, 7),
    Spec(2, 1, 2, 2, 1, 2, 7),
    Spec(3, 1, 2, 1, 1, 1, 14),
    Spec(4, 1, 1, 0, 1, 1, 7),
    Spec(2, 0, 2, 1, 1, 1, 7),
    Spec(1, 1, 1, 0, 1, 1, 7),
]
SARIMAX_COMPARED = [
    Spec(1, 1, 1, 1, 1, 1, 7, True),
    Spec(2, 1, 2, 1, 1, 1, 7, True),
    Spec(1, 1, 2, 0, 1, 1, 7, True),
    Spec(2, 0, 2, 1, 1, 1, 7, True),
    Spec(1, 1, 1, 2, 1, 1, 7, True),
]
SARIMAX_SINGLE = Spec(0, 1, 2, 0, 1, 1, 7)
ARIMA_FALLBACK = Spec(1, 1, 1)
SARIMA_FALLBACK = Spec(1, 1, 1, 1, 1, 1, 7)
SARIMAX_FALLBACK = Spec(1, 1, 1, 0, 0, 0, 0)


def spec_table(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """The candidates as a table (ord, p, d, q, P, D, Q, s, trend)."""
    rows = [(i, *spec) for i, spec in enumerate(specs)]
    fields = "ord int, p int, d int, q int, seasonal_p int, seasonal_d int, seasonal_q int, s int, trend boolean"
    return spark.createDataFrame(rows, fields)
