"""The four phases from raw news and prices to features and calendars, each one's output staged and made once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.functions import columns as C
from tickerweave.operators import features as P
from tickerweave.operators import relational as R
from tickerweave.sources import files as S


def merged_news(news: DataFrame) -> DataFrame:
    """Phase 1: rows with a title and a text, one for each url (the first date's), dates as days."""
    rows = R.long_enough(news.select(F.to_date(C.loose_timestamp(F.col("date"))).alias("date"), "title", "news", "url"), title=4, news=6)
    return R.first_per_key(rows, ["url"], [F.asc_nulls_last("date"), "title", "news"])


def cleaned_news(merged: DataFrame, start: str, end: str, as_landed: bool = False) -> DataFrame:
    """Phase 2: texts cleaned, short ones dropped, days within the window, the source's domain.

    Texts are measured after they were cleaned (a line end is '. ' by then), or as they landed with ``as_landed``.
    """
    rows = R.within_dates(merged, "date", start, end)
    if as_landed:
        rows = R.long_enough(rows, title=1, news=100)
    rows = rows.withColumns({"title": C.clean_article(C.newlines_to_stops(F.col("title"))), "news": C.clean_article(C.newlines_to_stops(F.col("news"))), "source": C.source_domain(F.col("url"))})
    return rows if as_landed else R.long_enough(rows, title=1, news=100)


def cleaned_prices(prices: DataFrame, sectors: DataFrame, start: str, end: str) -> DataFrame:
    """Phase 3, first half: days within the window, no stale bars, no bars without any value, the sector."""
    rows = R.without_stale(R.within_dates(prices, "Date", start, end)).na.drop("all", subset=["Open", "High", "Low", "Close"])
    return R.lookup(rows, sectors, "Ticker")


def run(spark: SparkSession, news: DataFrame, prices: DataFrame, sectors: DataFrame, out: str, start: str, end: str, force: bool = False, as_landed: bool = False) -> dict[str, DataFrame]:
    """news, prices, features, calendar and volume; a phase whose output is in ``out`` already is not run again (unless ``force``)."""
    made: dict[str, DataFrame] = {}
    made["merged"] = S.stage(spark, f"{out}/merged", lambda: merged_news(news), force)
    made["news"] = S.stage(spark, f"{out}/news", lambda: cleaned_news(made["merged"], start, end, as_landed), force)
    made["prices"] = S.stage(spark, f"{out}/prices", lambda: cleaned_prices(prices, sectors, start, end), force)
    made["features"] = S.stage(spark, f"{out}/features", lambda: P.price_features(made["prices"]), force)
    made["calendar"] = S.stage(spark, f"{out}/calendar", lambda: R.trading_calendar(made["prices"]), force)
    made["volume"] = S.stage(spark, f"{out}/volume", lambda: R.daily_news_volume(made["news"]), force)
    made["summary"] = S.summary({n: df for n, df in made.items()})
    return made
