"""Small input frames."""

import datetime

import numpy as np

DAY0 = datetime.date(2024, 1, 1)


def day(i: int) -> datetime.date:
    return DAY0 + datetime.timedelta(days=int(i))


def daily(spark, series: dict):
    """(series_id, day, amount) rows from {series_id: values}."""
    rows = [(k, day(i), None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, day date, amount double")


def sales(spark, rows):
    """(sale_id, series_id, amount, item, rating, day, payment) from short tuples."""
    return spark.createDataFrame(
        rows,
        "sale_id long, series_id string, amount double, item string, rating double, day date, payment string",
    )


def column(df, key, value, order="day"):
    """{key: [values in order]}"""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r[order])):
        out.setdefault(r[key], []).append(r[value])
    return out


def same(got, want, tol=1e-9):
    """Equal lists of floats, where None and NaN agree."""
    a = np.array([np.nan if v is None else v for v in got], float)
    b = np.array([np.nan if v is None else v for v in want], float)
    return a.shape == b.shape and np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True)
