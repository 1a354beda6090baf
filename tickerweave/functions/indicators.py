"""Technical indicators as Column builders over one ordered window per ticker.

All of them share the window spec they are given, so any number of them in one
``select`` costs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, Window
from pyspark.sql import functions as F


def by_ticker(key: str = "Ticker", order: str = "Date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def filled(x: Column, w: WindowSpec) -> Column:
    """The last value that is not null up to here."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def pct_change(x: str, w: WindowSpec, n: int = 1) -> Column:
    """x / x n rows ago - 1, nulls filled forward on both sides. The value n rows ago is that of the filled series."""
    before = F.last(F.col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -n))
    return F.try_divide(filled(F.col(x), w), before) - 1


def daily_return(close: str, w: WindowSpec) -> Column:
    return pct_change(close, w) * 100


def log_return(close: str, w: WindowSpec) -> Column:
    """Nulls are not filled."""
    return F.ln(F.try_divide(F.col(close), F.lag(close).over(w)))


def intraday_range(high: str, low: str, open_: str) -> Column:
    return F.try_divide(F.col(high) - F.col(low), F.col(open_)) * 100


def rolling(x: Column, n: int, w: WindowSpec, what=F.avg) -> Column:
    """An aggregate of n rows, null until n values that are not null lie in the frame."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, what(x).over(frame))


def sma(x: str, n: int, w: WindowSpec) -> Column:
    return rolling(F.col(x), n, w)


def volatility(returns: Column, n: int, w: WindowSpec) -> Column:
    return rolling(returns, n, w, F.stddev_samp)


def rsi(change: Column, n: int, w: WindowSpec) -> Column:
    """Plain means of gains and losses (not Wilder's); null where there is no loss. ``change``: today's close less yesterday's."""
    gain = F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))
    loss = F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))
    ratio = F.try_divide(rolling(gain, n, w), F.nullif(rolling(loss, n, w), F.lit(0.0)))
    return 100 - 100 / (1 + ratio)


def typical_price(high: str, low: str, close: str) -> Column:
    """(high + low + close) / 3; volume plays no part."""
    return (F.col(high) + F.col(low) + F.col(close)) / 3


def lags(columns: list[str], n: int, w: WindowSpec) -> list[Column]:
    return [F.lag(c, i).over(w).alias(f"{c}_lag_{i}") for c in columns for i in range(1, n + 1)]


def target(close: str, w: WindowSpec) -> Column:
    return F.lead(close, 1).over(w)
