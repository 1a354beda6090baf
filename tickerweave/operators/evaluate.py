"""Metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _errors(actual: str, predicted: str):
    e = F.col(actual) - F.col(predicted)
    return e, F.try_divide(F.abs(e), F.abs(F.col(actual)))


def regression(df: DataFrame, actual: str, predicted: str, keys: list[str] = []) -> DataFrame:
    """mse, mae, rmse and mape (in %), over all rows or by key. A zero actual has no percentage error."""
    e, share = _errors(actual, predicted)
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(share) * 100).alias("mape")
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, pct): pct of the actual class."""
    n = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("actual")))


def classification(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1; what has no denominator is 0."""
    hit = F.count_if((F.col(actual) == 1) & (F.col(predicted) == 1))
    said, true = F.count_if(F.col(predicted) == 1), F.count_if(F.col(actual) == 1)
    one = df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"), hit.alias("h"), said.alias("s"), true.alias("t"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    made = one.select("accuracy", ratio(F.col("h").cast("double"), F.col("s")).alias("precision"), ratio(F.col("h").cast("double"), F.col("t")).alias("recall"))
    return made.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_trial(trials: DataFrame, metric: str = "val_loss") -> DataFrame:
    """The trial with the least metric; ties go to the smallest id."""
    return trials.agg(F.min_by(F.struct(*trials.columns), F.struct(metric, "trial_id")).alias("x")).select("x.*")


def error_histogram(df: DataFrame, actual: str, predicted: str, width: float) -> DataFrame:
    """(bin, n): how many errors (actual - predicted) lie in [bin, bin + width)."""
    return df.groupBy((F.floor((F.col(actual) - F.col(predicted)) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def plot_series(df: DataFrame, keys: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(Ticker, Date, kind, value): actual and predicted curves of the given tickers, long, as plots take them."""
    rows = df.join(keys, "Ticker", "left_semi")
    kinds = F.array(F.struct(F.lit("actual").alias("kind"), F.col(actual).alias("value")), F.struct(F.lit("predicted").alias("kind"), F.col(predicted).alias("value")))
    return rows.select("Ticker", "Date", F.inline(kinds))
