"""How good predictions were."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions with their actuals, on a composite key."""
    return predictions.join(actuals, list(keys))


def absolute_error(df: DataFrame, actual: str, predicted: str, by: Sequence[str]) -> DataFrame:
    """N, MAE and RMSE for each group and overall (nulls in the group columns) in one pass."""
    off = F.col(actual) - F.col(predicted)
    return df.rollup(*by).agg(F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"))


def leaderboard(df: DataFrame, actual: str, candidates: Sequence[str]) -> DataFrame:
    """MAE of each candidate column over the rows where it is known, best first, unknown last."""
    long = df.unpivot([actual], list(candidates), "model", "predicted")
    return long.groupBy("model").agg(F.count("predicted").alias("n"), F.avg(F.abs(F.col(actual) - F.col("predicted"))).alias("mae")).orderBy(F.asc_nulls_last("mae"), "model")


def log_loss(label: str, chances: dict[str, str], floor: float = 1e-15) -> Column:
    """Mean negative logarithm of the chance given to what happened."""
    given = F.coalesce(*(F.when(F.col(label) == k, F.col(c)) for k, c in chances.items()))
    return -F.avg(F.ln(F.greatest(given, F.lit(floor))))


def classification(df: DataFrame, label: str, predicted: str, chances: dict[str, str]) -> DataFrame:
    """N, accuracy and log-loss."""
    return df.agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"), log_loss(label, chances).alias("log_loss"))


def confusion(df: DataFrame, label: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts of each label against each prediction, over a pinned list."""
    return df.groupBy(F.col(label).alias("label")).pivot(predicted, list(labels)).agg(F.count(F.lit(1))).na.fill(0)
