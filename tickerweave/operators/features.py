"""Price features of every ticker: one exchange by ticker for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerweave.functions import indicators as I
from tickerweave.functions.columns import rounded


def with_ema(bars: DataFrame, close: str = "Close", span: int = 12, name: str = "EMA_12", key: str = "Ticker", order: str = "Date", unique: bool = False) -> DataFrame:
    """Adds the exponential mean y = a x + (1 - a) y', y0 = x0, a = 2 / (span + 1), in row order.

    A null leaves the mean as it is, but the next value weighs more for it:
    after g steps from the value before, y = (b x' + a x) / (b + a) with
    b = (1 - a) ** g. Before the first value the mean is null. One pass over
    the rows, sorted by ticker, in Arrow batches: what goes on from batch to
    batch is one mean, so a worker's memory does not grow with the table or
    with a ticker's history. Rows of one ``order`` go by the other columns,
    which must be of orderable types, unless ``unique``.
    """
    a = 2.0 / (span + 1)
    rest = [] if unique else [F.col(f"`{c}`") for c in bars.columns if c not in (key, order)]
    rows = bars.repartition(key).sortWithinPartitions(key, order, *rest)

    @F.arrow_udf("double")
    def fold(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, state = None, None
        for keys, values in batches:
            x = values.to_numpy(zero_copy_only=False)
            starts = _starts(keys)
            made = np.empty(len(x))
            for lo, hi in zip(starts, [*starts[1:], len(x)]):
                if lo or keys[0].as_py() != last:
                    state = None
                made[lo:hi], state = _means(x[lo:hi], a, state)
            last = keys[-1].as_py() if len(keys) else last
            yield pa.array(made, from_pandas=True)

    # a filter that went below would take rows from under the means: it stays above what is not deterministic
    return rows.withColumn(name, fold.asNondeterministic()(F.col(key), F.col(f"`{close}`").cast("double")))


def _starts(keys: pa.Array) -> list[int]:
    """Where a run of equal keys begins; nulls are equal."""
    if not len(keys):
        return []
    one, two = keys[:-1], keys[1:]
    other = pc.or_(pc.fill_null(pc.not_equal(one, two), False), pc.xor(one.is_null(), two.is_null()))
    return [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist()]


def _means(x: np.ndarray, a: float, state: tuple[float, int] | None = None, block: int = 128) -> tuple[np.ndarray, tuple[float, int] | None]:
    """The means of a part of a series (missing: nan), and the state after it: the mean so far and how many rows ago its last value was.

    In blocks: y_j = P_j (y + sum of d_i x_i / P_i), P the running product of the old values' weights.
    """
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return np.full(len(x), np.nan if state is None else state[0]), state and (state[0], state[1] + len(x))
    means = np.empty(len(at) + 1)  # the first is the mean before
    means[0], before = (x[at[0]], int(at[0])) if state is None else (state[0], -1 - state[1])
    w = (1.0 - a) ** np.diff(at, prepend=before).astype(np.float64)
    old, new = w / (w + a), a / (w + a)
    if state is None:
        old[0], new[0] = 1.0, 0.0
    for lo in range(0, len(w), block):
        p = np.cumprod(old[lo : lo + block])
        means[lo + 1 : lo + 1 + len(p)] = p * (means[lo] + np.cumsum(new[lo : lo + block] * x[at[lo : lo + len(p)]] / p))
    filled = means[np.searchsorted(at, np.arange(len(x)), side="right")]
    if state is None:
        filled[: at[0]] = np.nan
    return filled, (float(means[-1]), len(x) - 1 - int(at[-1]))


def _ema(values, a: float) -> list:
    """The means of one whole series; None where there is none yet."""
    made, _ = _means(np.array([np.nan if v is None else v for v in values], np.float64), a)
    return [None if v != v else v for v in made.tolist()]


def price_features(bars: DataFrame, digits: int | None = 4) -> DataFrame:
    """All indicators of every bar, rounded (raw prices too) to ``digits``. (Ticker, Date) is unique."""
    w = I.by_ticker()
    first = bars.select("*", I.daily_return("Close", w).alias("Daily_Return_Pct"), (F.col("Close") - F.lag("Close").over(w)).alias("__change"))
    made = first.select(
        *[c for c in bars.columns],
        "Daily_Return_Pct",
        I.log_return("Close", w).alias("Log_Return"),
        rounded(I.intraday_range("High", "Low", "Open"), 4).alias("Intraday_Range_Pct"),
        *[I.sma("Close", n, w).alias(f"SMA_{n}") for n in (5, 10, 20)],
        I.volatility(F.col("Daily_Return_Pct"), 10, w).alias("Volatility_10"),
        I.rsi(F.col("__change"), 14, w).alias("RSI_14"),
        I.typical_price("High", "Low", "Close").alias("VWAP"),
        I.rolling(F.col("Volume").cast("double"), 10, w).alias("Volume_SMA_10"),
        *[(I.pct_change("Close", w, n) * 100).alias(f"Pct_Change_{n}d") for n in (5, 10)],
    )
    # the mean comes last: its rows are those of the windows, by ticker and in order, which go no further through an exchange
    at = made.columns.index("Volatility_10")
    made = with_ema(made, unique=True).select(*made.columns[:at], "EMA_12", *made.columns[at:])
    if digits is None:
        return made
    return made.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])
