"""Result tables: predictions and metrics by model, scalers.

A write replaces the partitions (models) that it holds and leaves all others alone. Spark writes the new
files beside the table and puts them in place when the whole job has ended, so a run that breaks off
before leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column lists of the result tables.
PREDICTION_COLUMNS = ["series_id", "model", "split", "day", "actual", "predicted"]
METRIC_COLUMNS = ["series_id", "model", "metric", "value"]
SCALER_COLUMNS = ["series_id", "column_name", "center", "scale"]


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that occur in the rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Test predictions, actuals and forecasts, one directory per model."""
    write_partitions(df.select(*PREDICTION_COLUMNS), path, "model")


def write_metrics(df: DataFrame, path: str) -> None:
    write_partitions(df.select(*METRIC_COLUMNS), path, "model")


def write_scaler_params(df: DataFrame, path: str) -> None:
    df.select(*SCALER_COLUMNS).write.mode("overwrite").parquet(path)


PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("actual", T.DoubleType()),
        T.StructField("predicted", T.DoubleType()),
        T.StructField("model", T.StringType()),
    ]
)


def read_predictions(spark, path: str) -> DataFrame:
    """Partition column ``model`` prunes directories when filtered on."""
    return spark.read.schema(PREDICTION_SCHEMA).parquet(path)
