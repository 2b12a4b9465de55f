"""Pooled sequence regressors: the fourteen-day windows of all series in one Spark ML fit.

They take the place of recurrent nets: same inputs, target, loss and split.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators import encode
from tillwise.functions.scalars import calendar_columns

# Fixed value: input columns of the transaction-level regression.
TABULAR = ["item_code", "rating", "payment_code", "year", "month", "day_of_month", "day_of_week"]


def as_vector(x: Column) -> Column:
    return array_to_vector(F.flatten(x))


def fit_linear(train: DataFrame, loss: str = "huber", max_iter: int = 50) -> LinearRegressionModel:
    """Linear sequence regressor with Huber or squared loss."""
    data = train.select(as_vector(F.col("x")).alias("features"), F.col("y").alias("label"))
    return LinearRegression(loss=loss, maxIter=max_iter, regParam=1e-6, standardization=True).fit(data)


def fit_boosted(sequences: DataFrame, max_iter: int = 10, tolerance: float = 0.01) -> Model:
    """Boosted trees on the train rows that stop when the valid rows stop improving; test rows are not touched."""
    data = sequences.where(F.col("split").isin("train", "valid")).select(
        as_vector(F.col("x")).alias("features"),
        F.col("y").alias("label"),
        (F.col("split") == "valid").alias("held_out"),
    )
    trees = GBTRegressor(
        maxIter=max_iter, maxDepth=3, maxBins=16, seed=42, validationIndicatorCol="held_out", validationTol=tolerance
    )
    return trees.fit(data)


def predict(model: Model, sequences: DataFrame) -> DataFrame:
    """Adds ``predicted`` (still on the scaled target)."""
    out = model.transform(sequences.withColumn("features", as_vector(F.col("x"))))
    return out.withColumnRenamed("prediction", "predicted").drop("features")


def _window(seed: Column, values: Column) -> Column:
    """The input after some recursive steps.

    Every step drops the oldest row and appends a copy of the newest with only
    the target replaced, so the appended rows are the last seed row with the
    predicted values as targets.
    """
    newest = F.element_at(seed, -1)
    others = F.slice(newest, 2, F.size(newest) - 1)
    appended = F.transform(values, lambda v: F.concat(F.array(v), others))
    return F.slice(F.concat(seed, appended), F.size(values) + 1, F.size(seed))


def _as_forecast(df: DataFrame, values: Column) -> DataFrame:
    out = df.select("series_id", "day", F.posexplode(values).alias("_i", "predicted"))
    step = (F.col("_i") + 1).cast("int")
    return out.select("series_id", F.date_add("day", step).alias("day"), step.alias("step"), "predicted")


def recurse_linear(model: LinearRegressionModel, seeds: DataFrame, steps: int = 7) -> DataFrame:
    """Recursive forecast of a linear model as one fold: (series_id, day, step, predicted)."""
    return recurse_weights([float(v) for v in model.coefficients.toArray()], float(model.intercept), seeds, steps)


def recurse_weights(weights: list[float], level: float, seeds: DataFrame, steps: int = 7) -> DataFrame:
    """The same from a weight for every cell of the window, oldest row first."""
    listed, start = F.array(*[F.lit(w) for w in weights]), F.lit(level)

    def value(window: Column) -> Column:
        products = F.zip_with(F.flatten(window), listed, lambda a, b: a * b)
        return F.aggregate(products, start, lambda s, v: s + v)

    values = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.array().cast("array<double>"),
        lambda out, _: F.concat(out, F.array(value(_window(F.col("x"), out)))),
    )
    return _as_forecast(seeds, values)


def recurse_model(model: Model, seeds: DataFrame, steps: int = 7) -> DataFrame:
    """Recursive forecast of any Spark ML regressor: a fixed chain of transforms over all series."""
    state = seeds.select("series_id", "day", "x", F.array().cast("array<double>").alias("_out"))
    for _ in range(steps):
        scored = model.transform(state.withColumn("features", as_vector(_window(F.col("x"), F.col("_out")))))
        state = scored.select("series_id", "day", "x", F.concat("_out", F.array("prediction")).alias("_out"))
    return _as_forecast(state, F.col("_out"))


def tabular_features(sales: DataFrame) -> DataFrame:
    """Transaction-level matrix: coded item and payment, rating, calendar; target amount."""
    coded = encode.code_by_first_seen(sales, "item", "day", "sale_id", "item_code")
    payment = encode.code_from_dict("payment", encode.PAYMENT_CODES).alias("payment_code")
    return coded.select(
        "sale_id", "amount", "item_code", "rating", payment, *calendar_columns("day", TABULAR[3:])
    )


def fit_tabular(train: DataFrame, columns: list[str]) -> LinearRegressionModel:
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    data = assembler.transform(train).select("features", F.col("amount").alias("label"))
    return LinearRegression(regParam=1e-6).fit(data)


def predict_tabular(model: LinearRegressionModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    return model.transform(assembler.transform(rows)).withColumnRenamed("prediction", "predicted").drop("features")
