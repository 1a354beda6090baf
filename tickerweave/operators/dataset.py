"""Supervised datasets: lags, targets, chronological splits, scaling fitted on the training part, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions import indicators as I
from tickerweave.functions.columns import min_max


def enumerated(df: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, code): codes from 0 by first appearance in ``order``."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__o"))
    return first.select(key, (F.row_number().over(Window.orderBy("__o", key)) - 1).alias(f"{key.lower()}_enumerated"))


def lagged(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """All lags and the next close: one exchange, one sort, and one window expression for each distance, over all columns together."""
    w = I.by_ticker()
    target = I.target("Close", w).alias("target_close")
    if len(columns) < 2:
        return df.select("*", *I.lags(columns, n, w), target)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    made = df.select("*", *[F.lag(row, i).over(w).alias(f"__lag_{i}") for i in range(1, n + 1)], target)
    return made.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__lag_{i}.c{k}").alias(f"{c}_lag_{i}") for k, c in enumerate(columns) for i in range(1, n + 1)], "target_close")


def complete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def chronological_split(df: DataFrame, day: str = "Date", train: float = 0.8, validation: float = 0.9) -> DataFrame:
    """split = train, validation or test, cut at distinct dates. The dates are ranked among themselves (a short table, sent to the rows), not the rows."""
    days = df.select(day).distinct().filter(F.col(day).isNotNull())
    place = days.select(day, F.row_number().over(Window.orderBy(day)).alias("__i"), F.count("*").over(Window.partitionBy()).alias("__n"))
    part = place.select(
        day,
        F.when(F.col("__i") <= F.floor(F.col("__n") * train), "train").when(F.col("__i") <= F.floor(F.col("__n") * validation), "validation").otherwise("test").alias("split"),
    )
    return df.join(F.broadcast(part), day)


def positional_split(df: DataFrame, order: list[str], shares: list[tuple[str, float]]) -> DataFrame:
    """Splits by row number in ``order``. The number comes from counts by the first key and a running sum over those, so only one key's rows are ever sorted together."""
    key = order[0]
    counts = df.groupBy(key).count()
    base = counts.select(key, (F.sum("count").over(Window.orderBy(key)) - F.col("count")).alias("__base"), F.sum("count").over(Window.partitionBy()).alias("__n"))
    numbered = df.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order[1:]))).join(base, key)
    at = F.col("__base") + F.col("__i")
    total, made = 0.0, None
    for name, share in shares:
        total += share
        limit = F.floor(F.col("__n") * F.lit(round(total, 10)))
        made = F.when(at <= limit, name) if made is None else made.when(at <= limit, name)
    return numbered.withColumn("split", made.otherwise(shares[-1][0])).drop("__i", "__base", "__n")


def fit_min_max(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """Minimum and maximum of every column, over all rows or by key, in one aggregate."""
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])


def scaled(df: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """Columns scaled by fitted statistics (one row, or one for each key)."""
    joined = df.join(fitted, keys, "left") if keys else df.crossJoin(F.broadcast(fitted))
    return joined.select(*[min_max(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi")).alias(c) if c in columns else F.col(c) for c in df.columns])


def sequences(df: DataFrame, features: list[str], length: int, target: str, ahead: int = 0) -> DataFrame:
    """(Ticker, Date, x, y): the ``length`` rows before this one as an array of arrays, and the target ``ahead`` rows on; only full ones."""
    w = Window.partitionBy("Ticker").orderBy("Date")
    row = F.array(*[F.col(c).cast("double") for c in features])
    y = F.lead(target, ahead).over(w) if ahead else F.col(target)
    made = df.select("Ticker", "Date", F.collect_list(row).over(w.rowsBetween(-length, -1)).alias("x"), y.alias("y"))
    return made.filter((F.size("x") == length) & F.col("y").isNotNull())


def tensors(df: DataFrame, features: list[str], lags: int, constant: str | None = None) -> DataFrame:
    """(Ticker, Date, x): lagged columns back as [steps][features], the oldest step first; ``constant`` is repeated in each step."""
    extra = [F.col(constant).cast("double")] if constant else []
    step = lambda i: F.array(*[F.col(f"{c}_lag_{i}" if i else c).cast("double") for c in features], *extra)
    return df.select("Ticker", "Date", F.array(*[step(i) for i in range(lags, -1, -1)]).alias("x"))
