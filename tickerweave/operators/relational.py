"""Filters, joins, aggregates, reshaping: the relational part, as DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.columns import day_name, rounded


def long_enough(df: DataFrame, **least: int) -> DataFrame:
    """Rows whose named texts have at least so many characters."""
    return df.filter(reduce(lambda a, b: a & b, [F.length(c) >= n for c, n in least.items()]))


def within_dates(df: DataFrame, day: str, start: str, end: str, keep_null: bool = False) -> DataFrame:
    """Both ends included; a null date is dropped, or kept for crawled lists."""
    inside = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.filter(inside | F.col(day).isNull() if keep_null else inside)


def without_stale(bars: DataFrame) -> DataFrame:
    """Drops days with no volume and no move; a comparison with null is not 'stale', so such rows stay."""
    stale = (F.col("Volume") == 0) & (F.col("Open") == F.col("Close"))
    return bars.filter(~F.coalesce(stale, F.lit(False)))


def with_history(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with at least ``least`` rows."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).filter(F.col("__n") >= least).drop("__n")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; rows with one that is no number are dropped."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns}).na.drop(subset=columns)


def with_news(bars: DataFrame, daily: DataFrame, how: str = "left") -> DataFrame:
    """Market-wide daily rows joined to bars by date; the news date is kept as news_date. A row a day is few: they are sent to the bars, which stay where they are."""
    return bars.join(F.broadcast(daily.withColumnRenamed("date", "news_date")), F.col("Date") == F.col("news_date"), how)


def with_ticker_news(bars: DataFrame, scores: DataFrame, score: list[str], exact: bool = False, how: str = "left") -> DataFrame:
    """Per-ticker scores joined by (Ticker, Date), missing ones 0; ``exact`` compares timestamps, else days."""
    right = scores if exact else scores.withColumn("Date", F.to_date("Date"))
    made = bars.join(right, ["Ticker", "Date"], how)
    return made.na.fill(0.0, subset=score)


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join to a dimension; what is not in it gets nulls. The optimizer broadcasts it when it is small."""
    return df.join(dimension, key, "left")


def unmapped(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(dimension, key, "left_anti")


def top_keys(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).count().orderBy(F.desc("count"), key).limit(k)


def trading_calendar(prices: DataFrame) -> DataFrame:
    made = prices.filter("Date is not null").groupBy("Date").agg(F.count_distinct("Ticker").alias("Num_Tickers"))
    return made.withColumn("Day_Of_Week", day_name(F.col("Date")))


def daily_news_volume(news: DataFrame) -> DataFrame:
    made = news.filter("date is not null").groupBy(F.col("date").alias("Date"))
    return made.agg(F.count("title").alias("Num_Articles"), F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("Sources"))


def joined_text(df: DataFrame, key: str, text: str, order: list[str], sep: str = " ") -> DataFrame:
    """Texts of a key in order, joined; a group's texts are one value, as the result needs."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), sep).alias(text))


def mean_scores(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in scores])


def document_scores(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Mean chunk probabilities of each document; one without chunks is (0, 0, 1) in (pos, neg, neu)."""
    mean = chunks.groupBy(key).agg(F.avg("pos").alias("pos"), F.avg("neg").alias("neg"), F.avg("neu").alias("neu"))
    made = docs.select(key).join(mean, key, "left")
    return made.select(key, F.coalesce("pos", F.lit(0.0)).alias("pos"), F.coalesce("neg", F.lit(0.0)).alias("neg"), F.coalesce("neu", F.lit(1.0)).alias("neu"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wide_to_long(wide: DataFrame, tickers: list[str], fields: list[str], suffix: str = ".NS", digits: int = 2, names: list[Column] | None = None) -> DataFrame:
    """Columns 'TICKER|Field' to rows (Date, Ticker, fields); rows without any value are dropped, doubles rounded. ``names``: the tickers, if the columns do not name them."""
    names = names or [F.lit(t.removesuffix(suffix)) for t in tickers]
    rows = [F.struct(n.alias("Ticker"), *[F.col(f"`{t}|{f}`").alias(f) for f in fields]) for t, n in zip(tickers, names)]
    made = wide.select("Date", F.inline(F.array(*rows))).na.drop("all", subset=fields)
    return made.select("Date", "Ticker", *[rounded(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in made.dtypes if c in fields])


def wide_blocks(rows: DataFrame, fields: list[str], width: int = 64) -> tuple[DataFrame, DataFrame]:
    """(header, wide) of rows (Ticker, Date, fields): the tickers as columns, ``width`` of them in a block.

    ``header`` has a row for each block: its tickers in order. ``wide`` has a
    row for each block and date, with columns 'slot|Field'; slot is the place
    of the ticker in the header. So a plan has the columns of one block,
    however many tickers there are, and their names don't come to the driver.
    A null ticker can name no column and is left out.
    """
    names = rows.select("Ticker").distinct().filter("Ticker is not null")
    at = names.select("Ticker", (F.row_number().over(Window.orderBy("Ticker")) - 1).alias("__n"))  # one short row for each ticker
    listed = F.sort_array(F.collect_list(F.struct("__n", "Ticker")))
    header = at.groupBy(F.floor(F.col("__n") / width).cast("int").alias("block")).agg(F.transform(listed, lambda x: x["Ticker"]).alias("tickers"))
    placed = rows.join(header.select("block", F.posexplode("tickers").alias("__slot", "Ticker")), "Ticker")
    cells = placed.select("block", "Date", "__slot", *fields).repartition("block", "Date").groupBy("block", "Date").pivot("__slot", list(range(width)))
    return header, cells.agg(*[F.first(f).alias(f) for f in fields]).toDF("block", "Date", *[f"{i}|{f}" for i in range(width) for f in fields])


def blocks_to_long(header: DataFrame, wide: DataFrame, fields: list[str], digits: int = 2) -> DataFrame:
    """``wide_to_long`` of the blocks of ``wide_blocks``; the header, a name for each ticker, is sent to them."""
    slots = [c.split("|")[0] for c in wide.columns if c.endswith(f"|{fields[0]}")]
    return wide_to_long(wide.join(F.broadcast(header), "block"), slots, fields, digits=digits, names=[F.get("tickers", F.lit(int(i))) for i in slots])


def oldest_on_page(links: DataFrame, page: str, day: str) -> DataFrame:
    return links.groupBy(page).agg(F.min(day).alias("oldest"))


def filter_columns(df: DataFrame, drop: list[str]) -> DataFrame:
    return df.drop(*drop)


def ranked(df: DataFrame, metric: Column, *ties: Column, buckets: int = 64) -> DataFrame:
    """Rows numbered from 0 by a numeric metric (nulls first).

    The metric's quantiles cut the rows into buckets, which are counted; a
    row's number is its number in its bucket and the buckets before, so no
    task sorts all rows.
    """
    rows = df.withColumn("__m", metric.cast("double"))
    cuts = sorted(set(rows.approxQuantile("__m", [i / buckets for i in range(1, buckets)], 0.005)))
    listed = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("__b", F.coalesce(F.size(F.filter(listed, lambda c: c <= F.col("__m"))), F.lit(0)))
    rows = rows.withColumn("__b", F.when(F.col("__m").isNull(), -1).otherwise(F.col("__b")))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    base = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__base"))
    made = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__m", *ties))).join(base, "__b")
    return made.withColumn("rank", (F.col("__i") + F.col("__base") - 1).cast("int")).drop("__m", "__b", "__i", "__base")


def unseen(links: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Links, once each, that are not in ``seen``."""
    return links.dropDuplicates([key]).join(seen.select(key).distinct(), key, "left_anti")


def stale_report(bars: DataFrame) -> DataFrame:
    """(Date, n): on which days bars are dropped as stale, and how many."""
    return bars.filter((F.col("Volume") == 0) & (F.col("Open") == F.col("Close"))).groupBy("Date").agg(F.count("*").alias("n"))
