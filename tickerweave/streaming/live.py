"""The same tables kept up to date from streams (an extension: batch is the primary form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_articles(articles: DataFrame, stamp: str = "ts", late: str = "1 day") -> DataFrame:
    """Each url once, as long as its repeats come within ``late``; older state is dropped."""
    return articles.withWatermark(stamp, late).dropDuplicatesWithinWatermark(["url"])


def hourly_bars(trades: DataFrame, stamp: str = "ts", price: str = "value", ticker: str = "event_type", order: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count of every hour and ticker; an hour is final once the watermark has passed it."""
    o = F.struct(stamp, order)
    made = trades.withWatermark(stamp, late).groupBy(F.window(stamp, "1 hour").alias("w"), F.col(ticker).alias("Ticker"))
    bars = made.agg(F.min_by(price, o).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"), F.max_by(price, o).alias("Close"), F.count("*").alias("Volume"))
    return bars.select("Ticker", F.col("w.start").alias("Hour"), "Open", "High", "Low", "Close", "Volume")
