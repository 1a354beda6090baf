"""Price bars, news and sectors derived from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars: a supplier is a ticker, its unit prices of a day the trades, in line order.

    A day has about one trade, so trades are not summed up before they are
    moved: they go by ticker, as few plain columns, and windows over tickers
    find them where they are, in order of days.
    """
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("Ticker"), F.to_date("l_shipdate").alias("Date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("q"),
        "l_orderkey", "l_linenumber", "l_partkey",
    ).repartition("Ticker")
    o = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
    return rows.groupBy("Ticker", "Date").agg(
        F.min_by("price", o).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max_by("price", o).alias("Close"),
        F.max_by("price", o).alias("Adj Close"), F.sum("q").cast("long").alias("Volume"),
    )


BARS = """
t AS (SELECT CAST(l_suppkey AS VARCHAR) AS Ticker, CAST(l_shipdate AS DATE) AS Date, l_extendedprice / l_quantity AS price, l_quantity AS q,
  {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice / l_quantity} AS o FROM lineitem),
bars AS (SELECT Ticker, Date, arg_min(price, o) AS Open, max(price) AS High, min(price) AS Low, arg_max(price, o) AS Close,
  arg_max(price, o) AS "Adj Close", CAST(sum(q) AS BIGINT) AS Volume FROM t GROUP BY 1, 2)"""


def news(spark: SparkSession, sf: str) -> DataFrame:
    """One article per document: dated by its id over 30 days, titled by its first line, with a url of its source."""
    d = table(spark, sf, "documents")
    return d.select(
        F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))").alias("date"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("news"),
        F.concat(F.lit("https://www."), "source", F.lit(".com/news/"), F.col("doc_id").cast("string")).alias("url"), "source", "doc_id",
    )


NEWS = """
news AS (SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS date, split_part(text, chr(10), 1) AS title, text AS news,
  'https://www.' || source || '.com/news/' || doc_id AS url, source, doc_id FROM documents)"""


def intraday_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of each event type."""
    o = F.struct("ts", "event_id")
    return (
        table(spark, sf, "events").groupBy(F.col("event_type").alias("Ticker"), F.date_trunc("hour", "ts").alias("Hour"))
        .agg(F.min_by("value", o).alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", o).alias("Close"), F.count("*").alias("Volume"))
    )


INTRADAY = """
SELECT event_type AS Ticker, date_trunc('hour', ts) AS Hour, arg_min(value, {'a': ts, 'b': event_id}) AS Open, max(value) AS High, min(value) AS Low,
  arg_max(value, {'a': ts, 'b': event_id}) AS Close, count(*) AS Volume FROM events GROUP BY 1, 2"""


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """(Ticker, Sector): the nation of the supplier; a dimension for lookups."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").cast("string").alias("Ticker"), F.col("n_name").alias("Sector"))


SECTORS = "sectors AS (SELECT CAST(s_suppkey AS VARCHAR) AS Ticker, n_name AS Sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
