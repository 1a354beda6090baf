"""Registry of the engine's queries and of their SQL counterparts.

Each entry runs over whole tables. Doubles are rounded half-to-even on the
scaled value on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerweave.functions import columns as C
from tickerweave.functions import html as H
from tickerweave.functions import indicators as I
from tickerweave.operators import dataset as D
from tickerweave.operators import evaluate as E
from tickerweave.operators import features as P
from tickerweave.operators import models as M
from tickerweave.operators import relational as R
from tickerweave.plans import phases as PH
from tickerweave.sources import files as S
from tickerweave.sources import virtual as V

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, make, sql: str | None = None) -> None:
    _QUERIES[name] = make
    if sql:
        _SQL[name] = sql.strip()


def _r(x: str, digits: int = 4) -> str:
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def _rnd(*columns: str, digits: int = 4):
    return [C.rounded(F.col(f"`{c}`"), digits).alias(c) for c in columns]


def _t(name: str):
    return lambda s, sf: V.table(s, sf, name)


# --- shared inputs ---------------------------------------------------------

HOLES = """
holes AS (SELECT Ticker, Date, Open, High, Low, CASE WHEN Volume % 11 <> 0 THEN Close END AS Close, CASE WHEN Volume % 7 <> 0 THEN Volume END AS Volume FROM bars)"""
DAILY = """
daily AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""
SCORES = """
scores AS (SELECT CAST(l_suppkey AS VARCHAR) AS Ticker, CAST(l_shipdate AS DATE) AS Date, max(l_discount) AS score FROM lineitem GROUP BY 1, 2)"""


def holes(s, sf):
    """Bars with nulls in Close and Volume."""
    return V.bars(s, sf).select(
        "Ticker", "Date", "Open", "High", "Low", F.when(F.col("Volume") % 11 != 0, F.col("Close")).alias("Close"), F.when(F.col("Volume") % 7 != 0, F.col("Volume")).alias("Volume")
    )


def daily(s, sf):
    """Market-wide daily rows (from orders), not for every day."""
    o = V.table(s, sf, "orders").filter("o_orderstatus = 'F'")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("score"))


def scores(s, sf):
    x = V.table(s, sf, "lineitem")
    return x.groupBy(F.col("l_suppkey").cast("string").alias("Ticker"), F.to_date("l_shipdate").alias("Date")).agg(F.max("l_discount").alias("score"))



# --- sources and sinks -----------------------------------------------------

_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _csv(s, sf, columns=None):
    path = S.fresh_path(s, "customer-csv")
    S.write_csv(V.table(s, sf, "customer"), path)
    return S.read_csv(s, path, _CUSTOMER, columns)


def _appended(s, sf):
    path = S.fresh_path(s, "customer-csv")
    c = V.table(s, sf, "customer")
    S.write_csv(c.filter("c_custkey % 2 = 0"), path, append=True)
    S.write_csv(c.filter("c_custkey % 2 = 1"), path, append=True)
    return S.read_csv(s, path, _CUSTOMER)


def _staged(s, sf):
    path = S.fresh_path(s, "stage")
    S.stage(s, path, lambda: V.table(s, sf, "nation"))
    return S.stage(s, path, lambda: V.table(s, sf, "nation").limit(0))


def _resumed(s, sf):
    path = S.fresh_path(s, "chunks")
    o = V.table(s, sf, "orders").select("o_orderkey", "o_totalprice")
    S.resume_chunks(o.filter("o_orderkey % 4 < 2"), F.expr("o_orderkey % 4"), path)
    return S.resume_chunks(o, F.expr("o_orderkey % 4"), path).select("o_orderkey", "o_totalprice", F.col("chunk").cast("long").alias("chunk"))


def _rest(s, sf):
    e = V.table(s, sf, "events")
    item = F.struct(F.unix_timestamp("ts").alias("datetime"), F.col("event_type").alias("headline"))
    landed = e.groupBy(F.col("user_id").alias("symbol")).agg(F.to_json(F.collect_list(item)).alias("body"))
    return S.rest_news(landed)


_add("s01_csv_scan", _csv, "SELECT * FROM customer")
_add("s03_csv_projected", lambda s, sf: _csv(s, sf, ["c_custkey", "c_acctbal"]), "SELECT c_custkey, c_acctbal FROM customer")
_add("s10_normalised_names", lambda s, sf: S.normalised_names(V.bars(s, sf), {"ticker": "symbol"}), f"""WITH {V.BARS} SELECT Ticker AS symbol, Date AS date, Open AS open, High AS high, Low AS low, "Adj Close" AS close, Volume AS volume FROM bars""")
_add("s13_rest_news", _rest, """SELECT user_id AS symbol, date_trunc('second', ts) AS "Date", event_type AS "News" FROM events""")
_add("k02_append_write", _appended, "SELECT * FROM customer")
_add("k03_skip_if_exists", _staged, "SELECT * FROM nation")
_add("k04_resumed_chunks", _resumed, "SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 4 AS BIGINT) AS chunk FROM orders")
_add("k05_summary", lambda s, sf: S.summary({n: V.table(s, sf, n) for n in ("orders", "customer")}), " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns FROM {t}" for t in ("orders", "customer")))
_add("bars", V.bars, f"WITH {V.BARS} SELECT * FROM bars")
_add("intraday_bars", V.intraday_bars, V.INTRADAY)

# --- filters and projections -----------------------------------------------

_H = f"WITH {V.BARS}, {HOLES} "
_N = f"WITH {V.NEWS} "
_add("f01_drop_null_subset", lambda s, sf: holes(s, sf).na.drop(subset=["Volume"]), _H + "SELECT * FROM holes WHERE Volume IS NOT NULL")
_add("f02_drop_null_any", lambda s, sf: D.complete(holes(s, sf)), _H + "SELECT * FROM holes WHERE Volume IS NOT NULL AND Close IS NOT NULL")
_add("f03_drop_null_all", lambda s, sf: holes(s, sf).na.drop("all", subset=["Close", "Volume"]), _H + "SELECT * FROM holes WHERE Volume IS NOT NULL OR Close IS NOT NULL")
_add("f04_stub_filter", lambda s, sf: R.long_enough(V.news(s, sf), title=4, news=6).select("doc_id"), _N + "SELECT doc_id FROM news WHERE length(title) > 3 AND length(news) > 5")
_add("f05_short_articles", lambda s, sf: R.long_enough(V.news(s, sf), news=100).select("doc_id"), _N + "SELECT doc_id FROM news WHERE length(news) >= 100")
_add("f06_date_window", lambda s, sf: R.within_dates(V.news(s, sf), "date", "2024-01-05", "2024-01-12").select("doc_id", "date"), _N + "SELECT doc_id, date FROM news WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
_add("f07_stale_bars", lambda s, sf: R.without_stale(holes(s, sf).withColumns({"Volume": F.when(F.col("Volume") % 2 == 0, 0).otherwise(F.col("Volume"))})), _H + """
  SELECT * FROM (SELECT * REPLACE (CASE WHEN Volume % 2 = 0 THEN 0 ELSE Volume END AS Volume) FROM holes) WHERE NOT coalesce(Volume = 0 AND Open = Close, false)""")
_add("f08_drop_columns", lambda s, sf: R.filter_columns(V.table(s, sf, "customer"), ["c_name", "c_acctbal"]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_add("f09_membership", lambda s, sf: V.table(s, sf, "part").filter(F.col("p_size").isin(1, 5, 9)), "SELECT * FROM part WHERE p_size IN (1, 5, 9)")
_add("f10_equality", lambda s, sf: V.bars(s, sf).filter("Ticker = '7'"), f"WITH {V.BARS} SELECT * FROM bars WHERE Ticker = '7'")
_add("f11_min_history", lambda s, sf: R.with_history(V.table(s, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 12), "SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 12")
_add("f12_fill", lambda s, sf: holes(s, sf).na.fill({"Volume": 0, "Close": 0.0}), _H + "SELECT * REPLACE (coalesce(Volume, 0) AS Volume, coalesce(Close, 0) AS Close) FROM holes")
_add("f13_article_urls", lambda s, sf: V.news(s, sf).filter(C.is_article_url(F.col("url"), "src1", ("/page/", "7.com"))).select("url"), _N + "SELECT url FROM news WHERE contains(url, 'src1') AND regexp_matches(url, '[-/]\\d+/?$') AND NOT contains(url, '/page/') AND NOT contains(url, '7.com')")
_add("f14_numeric_coercion", lambda s, sf: R.numeric(V.table(s, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("n/a").alias("v")), ["v"]), "SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_size > 25")
_add("f15_section_label", lambda s, sf: V.table(s, sf, "pages").select("page_id", C.section_of(F.concat("url", F.when(F.col("page_id") % 3 == 0, "/business/1").when(F.col("page_id") % 3 == 1, "/market/2").otherwise("/z"))).alias("section")), "SELECT page_id, CASE WHEN contains(url, '/business/') OR page_id % 3 = 0 THEN 'Business' WHEN contains(url, '/market/') OR page_id % 3 = 1 THEN 'Market' ELSE 'Other' END AS section FROM pages")

# --- joins -----------------------------------------------------------------

_BD = f"WITH {V.BARS}, {DAILY} "
_BS = f"WITH {V.BARS}, {SCORES} "
_add("j01_news_left_join", lambda s, sf: R.with_news(V.bars(s, sf), daily(s, sf)).select("Ticker", "Date", "Close", "news_date", "n", "score"), _BD + "SELECT Ticker, b.Date, Close, d.date AS news_date, n, score FROM bars b LEFT JOIN daily d ON b.Date = d.date")
_add("j02_ticker_news_filled", lambda s, sf: R.with_ticker_news(V.bars(s, sf), scores(s, sf), ["score"]).select("Ticker", "Date", "Close", "score"), _BS + "SELECT Ticker, Date, Close, coalesce(score, 0) AS score FROM bars LEFT JOIN scores USING (Ticker, Date)")
_add("j03_ticker_news_inner", lambda s, sf: R.with_ticker_news(V.bars(s, sf), scores(s, sf), ["score"], how="inner").select("Ticker", "Date", "Close", "score"), _BS + "SELECT Ticker, Date, Close, score FROM bars JOIN scores USING (Ticker, Date)")
_add("j04_sector_lookup", lambda s, sf: R.lookup(V.bars(s, sf), V.sectors(s, sf).filter("Sector < 'M'"), "Ticker").select("Ticker", "Date", "Close", "Sector"), f"WITH {V.BARS}, {V.SECTORS} SELECT Ticker, Date, Close, Sector FROM bars LEFT JOIN (SELECT * FROM sectors WHERE Sector < 'M') USING (Ticker)")
_add("j04_unmapped", lambda s, sf: R.unmapped(V.bars(s, sf), V.sectors(s, sf).filter("Sector < 'M'"), "Ticker"), f"WITH {V.BARS}, {V.SECTORS} SELECT DISTINCT Ticker FROM bars WHERE Ticker NOT IN (SELECT Ticker FROM sectors WHERE Sector < 'M')")
_add("j05_top_tickers", lambda s, sf: V.bars(s, sf).join(R.top_keys(V.bars(s, sf), "Ticker", 5).select("Ticker"), "Ticker", "left_semi"), f"WITH {V.BARS}, k AS (SELECT Ticker FROM bars GROUP BY 1 ORDER BY count(*) DESC, Ticker LIMIT 5) SELECT * FROM bars WHERE Ticker IN (SELECT Ticker FROM k)")

# --- aggregates ------------------------------------------------------------

_add("a01_trading_calendar", lambda s, sf: R.trading_calendar(V.bars(s, sf)), f"WITH {V.BARS} SELECT Date, count(DISTINCT Ticker) AS \"Num_Tickers\", dayname(Date) AS \"Day_Of_Week\" FROM bars GROUP BY 1")
_add("a02_daily_news_volume", lambda s, sf: R.daily_news_volume(V.news(s, sf)), _N + "SELECT date AS \"Date\", count(title) AS \"Num_Articles\", string_agg(DISTINCT source, ', ' ORDER BY source) AS \"Sources\" FROM news GROUP BY 1")
_add("a04_text_by_day", lambda s, sf: R.joined_text(V.news(s, sf), "date", "title", ["doc_id"]), _N + "SELECT date, string_agg(title, ' ' ORDER BY doc_id) AS title FROM news GROUP BY 1")
_add("a05_mean_scores", lambda s, sf: R.mean_scores(V.table(s, sf, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_discount", "l_tax"]).select("l_suppkey", "l_returnflag", *_rnd("l_discount", "l_tax")), f"SELECT l_suppkey, l_returnflag, {_r('avg(l_discount)')} AS l_discount, {_r('avg(l_tax)')} AS l_tax FROM lineitem GROUP BY 1, 2")
_add("a07_value_counts", lambda s, sf: R.top_keys(V.table(s, sf, "orders"), "o_custkey", 20), "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_add("a08_text_lengths", lambda s, sf: V.table(s, sf, "documents").agg(C.rounded(F.avg(F.length("text")), 4).alias("mean_len"), F.max(F.length("text")).alias("max_len")), f"SELECT {_r('avg(length(text))')} AS mean_len, CAST(max(length(text)) AS INTEGER) AS max_len FROM documents")
_add("a09_extent", lambda s, sf: V.bars(s, sf).agg(F.min("Date").alias("first"), F.max("Date").alias("last"), F.count_distinct("Ticker").alias("tickers")), f"WITH {V.BARS} SELECT min(Date) AS first, max(Date) AS last, count(DISTINCT Ticker) AS tickers FROM bars")
_add("a10_fit_min_max", lambda s, sf: D.fit_min_max(V.bars(s, sf), ["Open", "Close"], ["Ticker"]), f"WITH {V.BARS} SELECT Ticker, min(Open) AS \"Open__lo\", max(Open) AS \"Open__hi\", min(Close) AS \"Close__lo\", max(Close) AS \"Close__hi\" FROM bars GROUP BY 1")
_add("a17_oldest_on_page", lambda s, sf: R.oldest_on_page(V.table(s, sf, "events"), "user_id", "ts"), "SELECT user_id, min(ts) AS oldest FROM events GROUP BY 1")


def _chunk_scores(s, sf):
    c = V.table(s, sf, "conversations").select("conv_id", (F.length("text") % 7 / 10.0).alias("pos"), (F.length("text") % 3 / 10.0).alias("neg"), F.lit(0.1).alias("neu"), "turn")
    docs = V.table(s, sf, "conversations").select("conv_id").distinct()
    return R.document_scores(docs, c, "conv_id").select("conv_id", *_rnd("pos", "neg", "neu"))


_add("a06_document_scores", _chunk_scores, f"""
WITH m AS (SELECT conv_id, avg(length(text) % 7 / 10.0) AS pos, avg(length(text) % 3 / 10.0) AS neg, avg(0.1) AS neu FROM conversations GROUP BY 1)
SELECT DISTINCT c.conv_id, {_r('coalesce(pos, 0.0)')} AS pos, {_r('coalesce(neg, 0.0)')} AS neg, {_r('coalesce(neu, 1.0)')} AS neu FROM conversations c LEFT JOIN m USING (conv_id)""")

# --- windows ---------------------------------------------------------------

_W = "OVER (PARTITION BY Ticker ORDER BY Date)"
_PREP = f"""WITH {V.BARS}, {HOLES},
g AS (SELECT *, last_value(Close IGNORE NULLS) OVER (PARTITION BY Ticker ORDER BY Date) AS f FROM holes)"""


def _before(n: int) -> str:
    return f"lag(f, {n}) {_W}"


def _holed(*columns, digits: int = 4):
    def make(s, sf):
        w = I.by_ticker()
        made = holes(s, sf).select("Ticker", "Date", *[c(w).alias(n) for n, c in columns])
        return made.select("Ticker", "Date", *_rnd(*[n for n, _ in columns], digits=digits))

    return make


def _full(x: str, n: int, what: str = "avg") -> str:
    w = f"OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {what}({x}) {w} END"


_add("w01_daily_return", _holed(("r", lambda w: I.daily_return("Close", w))), _PREP + f" SELECT Ticker, Date, {_r(f'(f / {_before(1)} - 1) * 100')} AS r FROM g")
_add("w02_log_return", _holed(("r", lambda w: I.log_return("Close", w))), _PREP + f" SELECT Ticker, Date, {_r(f'ln(Close / lag(Close) {_W})')} AS r FROM g")
_add("w03_intraday_range", _holed(("r", lambda w: I.intraday_range("High", "Low", "Open"))), _PREP + f" SELECT Ticker, Date, {_r('(High - Low) / Open * 100')} AS r FROM g")
_add("w04_sma", _holed(*[(f"sma_{n}", lambda w, n=n: I.sma("Close", n, w)) for n in (5, 10, 20)]), _PREP + f" SELECT Ticker, Date, {', '.join(f'{_r(_full("Close", n))} AS sma_{n}' for n in (5, 10, 20))} FROM g")
_A = "(2.0::DOUBLE / 13)"
_EMA_FOLD = f"""list_reduce(list({{'y': Close, 'g': 0}}) OVER (PARTITION BY Ticker ORDER BY Date), lambda s, r: CASE WHEN r.y IS NULL THEN {{'y': s.y, 'g': s.g + 1}}
  WHEN s.y IS NULL THEN {{'y': r.y, 'g': 0}} ELSE {{'y': (pow(1 - {_A}, s.g + 1) * s.y + {_A} * r.y) / (pow(1 - {_A}, s.g + 1) + {_A}), 'g': 0}} END).y"""
_add("w05_ema", lambda s, sf: P.with_ema(holes(s, sf)).select("Ticker", "Date", *_rnd("EMA_12")), f"WITH {V.BARS}, {HOLES} SELECT Ticker, Date, {_r(_EMA_FOLD)} AS \"EMA_12\" FROM holes")
_add("w06_volatility", lambda s, sf: (lambda w: holes(s, sf).withColumn("d", I.daily_return("Close", w)).select("Ticker", "Date", I.volatility(F.col("d"), 10, w).alias("v")).select("Ticker", "Date", *_rnd("v")))(I.by_ticker()), _PREP + f", d AS (SELECT Ticker, Date, (f / {_before(1)} - 1) * 100 AS d FROM g) SELECT Ticker, Date, {_r(_full('d', 10, 'stddev_samp'))} AS v FROM d")
_add("w07_rsi", lambda s, sf: (lambda w: V.bars(s, sf).withColumn("c", F.col("Close") - F.lag("Close").over(w)).select("Ticker", "Date", I.rsi(F.col("c"), 14, w).alias("v")).select("Ticker", "Date", *_rnd("v")))(I.by_ticker()), f"""WITH {V.BARS},
c AS (SELECT Ticker, Date, Close - lag(Close) {_W} AS c FROM bars), u AS (SELECT Ticker, Date, CASE WHEN c > 0 THEN c WHEN c <= 0 THEN 0 END AS up, CASE WHEN c < 0 THEN -c WHEN c >= 0 THEN 0 END AS dn FROM c),
m AS (SELECT Ticker, Date, {_full('up', 14)} AS gain, {_full('dn', 14)} AS loss FROM u) SELECT Ticker, Date, {_r('100 - 100 / (1 + gain / nullif(loss, 0))')} AS v FROM m""")
_add("w08_typical_price", _holed(("r", lambda w: I.typical_price("High", "Low", "Close"))), _PREP + f" SELECT Ticker, Date, {_r('(High + Low + Close) / 3')} AS r FROM g")
_add("w09_volume_sma", _holed(("r", lambda w: I.sma("Volume", 10, w))), _PREP + f" SELECT Ticker, Date, {_r(_full('Volume', 10))} AS r FROM g")
_add("w10_pct_change", _holed(*[(f"p_{n}", lambda w, n=n: I.pct_change("Close", w, n) * 100) for n in (5, 10)]), _PREP + f" SELECT Ticker, Date, {', '.join(f'{_r(f"(f / {_before(n)} - 1) * 100")} AS p_{n}' for n in (5, 10))} FROM g")
_add("w11_lags", lambda s, sf: D.lagged(V.bars(s, sf).select("Ticker", "Date", "Open", "Close", "Volume"), ["Open", "Close", "Volume"], 10), f"WITH {V.BARS} SELECT Ticker, Date, Open, Close, Volume, {', '.join(f'lag({c}, {i}) {_W} AS \"{c}_lag_{i}\"' for c in ('Open', 'Close', 'Volume') for i in range(1, 11))}, lead(Close) {_W} AS target_close FROM bars")
_add("w13_return_fraction", _holed(("r", lambda w: I.pct_change("Close", w)), digits=6), _PREP + f" SELECT Ticker, Date, {_r(f'f / {_before(1)} - 1', 6)} AS r FROM g")
_add("w14_sequences_ahead", lambda s, sf: D.sequences(V.bars(s, sf), ["Open", "Close"], 10, "Close", 1), f"""WITH {V.BARS}, q AS (SELECT Ticker, Date, list([Open, Close]) OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x, lead(Close) {_W} AS y FROM bars)
SELECT * FROM q WHERE len(x) = 10 AND y IS NOT NULL""")
_add("w15_sequences", lambda s, sf: D.sequences(V.bars(s, sf), ["Close"], 10, "Close"), f"""WITH {V.BARS}, q AS (SELECT Ticker, Date, list([Close]) OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x, Close AS y FROM bars)
SELECT * FROM q WHERE len(x) = 10 AND y IS NOT NULL""")
_add("w16_enumerate", lambda s, sf: D.enumerated(V.bars(s, sf), "Ticker", "Date", "Open"), f"WITH {V.BARS}, m AS (SELECT Ticker, min({{'a': Date, 'b': Open}}) AS o FROM bars GROUP BY 1) SELECT Ticker, CAST(row_number() OVER (ORDER BY o, Ticker) - 1 AS INTEGER) AS ticker_enumerated FROM m")
_add("w17_first_per_key", lambda s, sf: R.first_per_key(V.table(s, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]), "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
_add("w18_chronological_split", lambda s, sf: D.chronological_split(V.bars(s, sf).select("Ticker", "Date", "Close")).select("Ticker", "Date", "Close", "split"), f"""WITH {V.BARS}, d AS (SELECT DISTINCT Date FROM bars), p AS (SELECT Date, row_number() OVER (ORDER BY Date) AS i, count(*) OVER () AS n FROM d)
SELECT Ticker, b.Date, Close, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM bars b JOIN p USING (Date)""")
_add("w19_positional_split", lambda s, sf: D.positional_split(V.bars(s, sf).select("Ticker", "Date"), ["Ticker", "Date"], [("train", 0.7), ("validation", 0.15), ("test", 0.15)]), f"""WITH {V.BARS}, p AS (SELECT Ticker, Date, row_number() OVER (ORDER BY Ticker, Date) AS i, count(*) OVER () AS n FROM bars)
SELECT Ticker, Date, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM p""")
_add("w20_rank", lambda s, sf: R.ranked(V.table(s, sf, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal"), F.col("s_suppkey")), "SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS INTEGER) AS rank FROM supplier")

_FEATURES = ["Daily_Return_Pct", "Log_Return", "Intraday_Range_Pct", "SMA_5", "SMA_10", "SMA_20", "EMA_12", "Volatility_10", "RSI_14", "VWAP", "Volume_SMA_10", "Pct_Change_5d", "Pct_Change_10d"]
_add("price_features", lambda s, sf: P.price_features(V.bars(s, sf).drop("Adj Close")), f"""WITH {V.BARS},
g AS (SELECT *, Close AS f, Close - lag(Close) {_W} AS c, (Close / lag(Close) {_W} - 1) * 100 AS d FROM bars),
u AS (SELECT *, CASE WHEN c > 0 THEN c WHEN c <= 0 THEN 0 END AS up, CASE WHEN c < 0 THEN -c WHEN c >= 0 THEN 0 END AS dn FROM g)
SELECT Ticker, Date, {_r('Open')} AS Open, {_r('High')} AS High, {_r('Low')} AS Low, {_r('Close')} AS Close, Volume, {_r('d')} AS "Daily_Return_Pct", {_r(f'ln(Close / lag(Close) {_W})')} AS "Log_Return",
{_r(_r('(High - Low) / Open * 100'))} AS "Intraday_Range_Pct", {', '.join(f'{_r(_full("Close", n))} AS "SMA_{n}"' for n in (5, 10, 20))},
{_r("list_reduce(list(Close) OVER (PARTITION BY Ticker ORDER BY Date), lambda a, x: a * (1 - 2.0::DOUBLE / 13) + x * (2.0::DOUBLE / 13))")} AS "EMA_12", {_r(_full('d', 10, 'stddev_samp'))} AS "Volatility_10",
{_r(f"100 - 100 / (1 + ({_full('up', 14)}) / nullif({_full('dn', 14)}, 0))")} AS "RSI_14", {_r('(High + Low + Close) / 3')} AS "VWAP", {_r(_full('Volume', 10))} AS "Volume_SMA_10",
{', '.join(f'{_r(f"(f / {_before(n)} - 1) * 100")} AS "Pct_Change_{n}d"' for n in (5, 10))} FROM u""")

# --- sorts, unions, reshaping ----------------------------------------------

_add("o01_sort", lambda s, sf: V.table(s, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey"), "SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
_add("o03_top_k", lambda s, sf: V.table(s, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("o04_sorted_distinct", lambda s, sf: V.bars(s, sf).select("Date").distinct().orderBy("Date"), f"WITH {V.BARS} SELECT DISTINCT Date FROM bars ORDER BY 1")
_add("u01_union_by_name", lambda s, sf: R.union_all(V.table(s, sf, "customer").select("c_custkey", "c_name"), V.table(s, sf, "customer").select("c_name", "c_acctbal")), "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer UNION ALL SELECT NULL, c_name, c_acctbal FROM customer")
_add("u02_union_distinct_key", lambda s, sf: R.first_per_key(R.union_all(V.table(s, sf, "customer").select("c_custkey", F.lit(0).alias("f")), V.table(s, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("f"))), ["c_custkey"], ["f"]), "SELECT c_custkey, min(f) AS f FROM (SELECT c_custkey, 0 AS f FROM customer UNION ALL SELECT o_custkey, 1 FROM orders) GROUP BY 1")


def _wide(s, sf):
    """All tickers as columns, in blocks of them, and back."""
    fields = ["Open", "Close", "Volume"]
    return R.blocks_to_long(*R.wide_blocks(V.bars(s, sf), fields), fields)


_add("u03_wide_to_long", _wide, f"WITH {V.BARS} SELECT Date, Ticker, {_r('Open', 2)} AS Open, {_r('Close', 2)} AS Close, Volume FROM bars")
_add("u05_tensors", lambda s, sf: D.tensors(D.complete(D.lagged(V.bars(s, sf).select("Ticker", "Date", "Open", "Close"), ["Open", "Close"], 3)), ["Open", "Close"], 3), f"""WITH {V.BARS}, q AS (SELECT Ticker, Date, list([Open, Close]) OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x, lead(Close) {_W} AS y FROM bars)
SELECT Ticker, Date, x FROM q WHERE len(x) = 4 AND y IS NOT NULL""")

# --- text, html, dates, maths ----------------------------------------------

_D = _t("documents")
_add("t01_newlines", lambda s, sf: _D(s, sf).select("doc_id", F.md5(C.newlines_to_stops(F.col("text"))).alias("h")), r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\n\r]+', '. ', 'g'), '^\s+', ''), '\s+$', '')) AS h FROM documents")
_add("t02_entities", lambda s, sf: V.table(s, sf, "part").select("p_partkey", C.unescaped(F.concat("p_name", F.lit(" &amp; &#8377;"))).alias("t")), "SELECT p_partkey, p_name || ' & ₹' AS t FROM part")
_add("t03_teasers", lambda s, sf: V.table(s, sf, "part").select("p_partkey", C.without_teasers(F.concat(F.lit("Foo. ALSO READ: "), "p_name", F.lit(" and more here. Next one."))).alias("t")), "SELECT p_partkey, 'Foo. . Next one.' AS t FROM part")
_add("t04_whitespace", lambda s, sf: _D(s, sf).select("doc_id", F.md5(C.squeezed(F.col("text"))).alias("h")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) AS h FROM documents")
_add("t05_domain", lambda s, sf: V.news(s, sf).select("doc_id", C.source_domain(F.col("url")).alias("domain")), _N + r"SELECT doc_id, nullif(regexp_extract(url, 'https?://(?:www\.)?([\w\-]+\.\w+)', 1), '') AS domain FROM news")
_add("t07_alnum", lambda s, sf: _D(s, sf).select("doc_id", F.md5(C.alnum_only(F.lower("text"))).alias("h")), r"SELECT doc_id, md5(regexp_replace(lower(text), '[^a-zA-Z0-9\s\x{00A0}]', '', 'g')) AS h FROM documents")
_add("t08_tokens", lambda s, sf: _D(s, sf).select("doc_id", F.size(C.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(C.tokens(F.col("text")), "|")).alias("h")), r"SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, '|')) AS h FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda t: t <> '') AS w FROM documents)")
_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
_add("t09_stop_words", lambda s, sf: _D(s, sf).select("doc_id", F.md5(F.array_join(C.without_stop_words(C.tokens(F.lower("text"))), " ")).alias("h")), rf"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '[\s\x{{00A0}}]+'), lambda t: t <> '' AND t NOT IN ({_STOP})), ' ')) AS h FROM documents")
_LEMMA = "CASE " + " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in C._IRREGULAR.items()) + r""" WHEN regexp_matches(t, '[^aeiou]ies$') AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y')
  WHEN regexp_matches(t, '(ss|x|z|ch|sh)es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, '[^su]s$') AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END"""
_add("t10_normalised_text", lambda s, sf: _D(s, sf).select("doc_id", F.md5(C.normalised_text(F.col("text"))).alias("h")), rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9\s\x{{00A0}}]', '', 'g'), '[\s\x{{00A0}}]+'), lambda t: t <> '' AND t NOT IN ({_STOP})) AS w FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda t: {_LEMMA}), ' ')) AS h FROM t""")
_add("t12_title_and_body", lambda s, sf: V.news(s, sf).select("doc_id", C.title_and_body(F.col("title"), F.col("news")).alias("t")), _N + "SELECT doc_id, substring(coalesce(title, '') || '. ' || substring(coalesce(news, ''), 1, 300), 1, 512) AS t FROM news")
_add("t13_suffix", lambda s, sf: V.table(s, sf, "nation").select(F.upper(C.without_suffix(F.concat(F.lower("n_name"), F.lit(".NS")), ".NS")).alias("t")), "SELECT upper(n_name) AS t FROM nation")


def _windows(s, sf):
    d = _D(s, sf).select("doc_id", C.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.posexplode(C.token_windows(F.col("w")))).select("doc_id", "pos", F.size("col").alias("n"), F.md5(F.array_join("col", " ")).alias("h"))


_add("t14_token_windows", _windows, r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda t: t <> '') AS w FROM documents),
c AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 510 THEN 1 ELSE 1 + CAST(ceil((len(w) - 510) / 254.0) AS INTEGER) END AS k FROM t),
x AS (SELECT doc_id, w, unnest(range(0, k)) AS pos FROM c)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len(list_slice(w, pos * 254 + 1, pos * 254 + 510)) AS INTEGER) AS n, md5(array_to_string(list_slice(w, pos * 254 + 1, pos * 254 + 510), ' ')) AS h FROM x""")
_add("h03_article_fields", lambda s, sf: V.table(s, sf, "pages").select("page_id", H.article_fields("html").alias("x")).select("page_id", "x.*"))
_add("h07_links", lambda s, sf: V.table(s, sf, "pages").select("page_id", F.posexplode(H.page_links("html"))).select("page_id", F.col("pos"), F.col("col").alias("href")))
_add("d01_loose_parse", lambda s, sf: V.table(s, sf, "orders").select("o_orderkey", C.loose_timestamp(F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz").alias("t")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN date_trunc('second', o_orderdate) END AS t FROM orders")
_add("d03_format", lambda s, sf: V.table(s, sf, "orders").select("o_orderkey", C.iso_date(F.col("o_orderdate")).alias("d"), C.strict_date(C.iso_date(F.col("o_orderdate"))).alias("day"), C.day_name(F.col("o_orderdate")).alias("name")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(o_orderdate AS DATE) AS day, dayname(o_orderdate) AS name FROM orders")
_add("d06_iso_local", lambda s, sf: V.table(s, sf, "orders").select("o_orderkey", F.to_date(C.iso_local(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00+05:30")))).alias("day")), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
_add("d07_epoch", lambda s, sf: V.table(s, sf, "events").select("event_id", C.without_zone(C.from_epoch(F.unix_timestamp("ts"))).alias("t")), "SELECT event_id, date_trunc('second', ts) AS t FROM events")
_add("m01_rounding", lambda s, sf: V.table(s, sf, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), C.rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("r2"), C.rounded(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("r4")), f"SELECT l_orderkey, l_linenumber, l_partkey, {_r('l_extendedprice / l_quantity', 2)} AS r2, {_r('l_extendedprice / l_quantity', 4)} AS r4 FROM lineitem")
_add("m03_softmax", lambda s, sf: V.table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[C.rounded(x, 6).alias(n) for x, n in zip(C.softmax(F.col("l_discount"), F.col("l_tax"), F.lit(0.05)), ("pos", "neg", "neu"))]), f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{_r(f"exp({x}) / (exp(l_discount) + exp(l_tax) + exp(0.05))", 6)} AS {n}' for x, n in (('l_discount', 'pos'), ('l_tax', 'neg'), ('0.05', 'neu')))} FROM lineitem")
_add("m05_scaling", lambda s, sf: (lambda b: D.scaled(b, D.fit_min_max(b, ["Close"], ["Ticker"]), ["Close"], ["Ticker"]).select("Ticker", "Date", *_rnd("Close", digits=6)))(V.bars(s, sf).select("Ticker", "Date", "Close")), f"WITH {V.BARS}, m AS (SELECT Ticker, min(Close) AS lo, max(Close) AS hi FROM bars GROUP BY 1) SELECT Ticker, Date, {_r('(Close - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END', 6)} AS Close FROM bars JOIN m USING (Ticker)")
_add("m06_direction", lambda s, sf: (lambda w: V.bars(s, sf).select("Ticker", "Date", C.direction(I.pct_change("Close", w)).alias("up")))(I.by_ticker()), f"WITH {V.BARS} SELECT Ticker, Date, CAST(Close / lag(Close) {_W} - 1 > 0 AS INTEGER) AS up FROM bars")

# --- models and evaluation -------------------------------------------------


def _predicted(s, sf):
    """Persistence: tomorrow's close is today's; rows with a target."""
    return M.Persistence().predict(D.lagged(V.bars(s, sf).select("Ticker", "Date", "Close"), [], 0).filter("target_close is not null"))


_PRED = f"WITH {V.BARS}, p AS (SELECT Ticker, Date, Close AS prediction, lead(Close) {_W} AS target_close FROM bars QUALIFY target_close IS NOT NULL)"
_MET = ", ".join(f"{_r(x)} AS {n}" for x, n in (("avg((target_close - prediction) * (target_close - prediction))", "mse"), ("avg(abs(target_close - prediction))", "mae"), ("sqrt(avg((target_close - prediction) * (target_close - prediction)))", "rmse"), ("avg(abs(target_close - prediction) / abs(target_close)) * 100", "mape")))
_add("a11_metrics", lambda s, sf: E.regression(_predicted(s, sf), "target_close", "prediction").select(*_rnd("mse", "mae", "rmse", "mape")), f"{_PRED} SELECT {_MET} FROM p")
_add("a12_metrics_per_ticker", lambda s, sf: E.regression(_predicted(s, sf), "target_close", "prediction", ["Ticker"]).select("Ticker", *_rnd("mse", "mae", "rmse", "mape")), f"{_PRED} SELECT Ticker, {_MET} FROM p GROUP BY 1")


def _directions(s, sf):
    w = I.by_ticker()
    b = V.bars(s, sf).select("Ticker", "Date", C.direction(I.pct_change("Close", w)).alias("predicted"))
    return b.withColumn("actual", F.lead("predicted").over(w)).filter("actual is not null and predicted is not null")


_DIR = f"WITH {V.BARS}, b AS (SELECT Ticker, Date, CAST(Close / lag(Close) {_W} - 1 > 0 AS INTEGER) AS predicted FROM bars), p AS (SELECT *, lead(predicted) {_W} AS actual FROM b), q AS (SELECT * FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL)"
_add("a14_confusion", lambda s, sf: E.confusion(_directions(s, sf), "actual", "predicted").select("actual", "predicted", "n", *_rnd("pct")), f"{_DIR} SELECT actual, predicted, count(*) AS n, {_r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY actual)')} AS pct FROM q GROUP BY 1, 2")
_add("a15_classification", lambda s, sf: E.classification(_directions(s, sf), "actual", "predicted").select(*_rnd("accuracy", "precision", "recall", "f1")), f"""{_DIR}, m AS (SELECT avg(CAST(actual = predicted AS INTEGER)) AS a, count(*) FILTER (actual = 1 AND predicted = 1)::DOUBLE / count(*) FILTER (predicted = 1) AS p, count(*) FILTER (actual = 1 AND predicted = 1)::DOUBLE / count(*) FILTER (actual = 1) AS r FROM q)
SELECT {_r('a')} AS accuracy, {_r('p')} AS precision, {_r('r')} AS recall, {_r('2 * p * r / (p + r)')} AS f1 FROM m""")
_add("a16_best_trial", lambda s, sf: E.best_trial(V.table(s, sf, "supplier").select(F.col("s_suppkey").alias("trial_id"), F.col("s_acctbal").alias("val_loss"), "s_name")), "SELECT s_suppkey AS trial_id, s_acctbal AS val_loss, s_name FROM supplier ORDER BY 2, 1 LIMIT 1")
_add("l01_lexicon_sentiment", lambda s, sf: M.LexiconScorer().score(_D(s, sf).select("doc_id", "text"), "text").select("doc_id", *_rnd("pos", "neg", "neu", digits=6)), rf"""
WITH t AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9\s\x{{00A0}}]', '', 'g'), '[\s\x{{00A0}}]+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in M.POSITIVE)}))) AS p, len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in M.NEGATIVE)}))) AS n FROM t),
g AS (SELECT *, greatest(p, n, 1) AS m FROM c), e AS (SELECT doc_id, exp(p - m) AS a, exp(n - m) AS b, exp(1 - m) AS d FROM g)
SELECT doc_id, {_r('a / (a + b + d)', 6)} AS pos, {_r('b / (a + b + d)', 6)} AS neg, {_r('d / (a + b + d)', 6)} AS neu FROM e""")
_add("l03_persistence", lambda s, sf: _predicted(s, sf).select("Ticker", "Date", "prediction", "target_close"), f"{_PRED} SELECT Ticker, Date, prediction, target_close FROM p")


def _search(s, sf):
    made = D.lagged(V.bars(s, sf).select("Ticker", "Date", "Open", "High", "Low", "Close"), [], 0).filter("target_close is not null").drop("Ticker")
    rows = D.chronological_split(S.stage(s, S.fresh_path(s, "targets"), lambda: made))  # read by the split, the fit and the scores
    made = M.grid_search(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), ["Open", "High", "Low", "Close"])
    return made.select("trial_id", "feature", *_rnd("val_loss", digits=2))


_SPLIT = f"""{_PRED.replace("Close AS prediction", "Open, High, Low, Close")}, d AS (SELECT DISTINCT Date FROM p), o AS (SELECT Date, row_number() OVER (ORDER BY Date) AS i, count(*) OVER () AS n FROM d),
q AS (SELECT p.*, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM p JOIN o USING (Date))"""
_add("l05_grid_search", _search, _SPLIT + " UNION ALL ".join(
    f" SELECT {i} AS trial_id, '{f}' AS feature, {_r('avg(pow(target_close - ({0} * a + b), 2))'.format(f), 2)} AS val_loss FROM q, (SELECT regr_slope(target_close, {f}) AS a, regr_intercept(target_close, {f}) AS b FROM q WHERE split = 'train') WHERE split = 'validation'"
    for i, f in enumerate(("Open", "High", "Low", "Close"))
))


# --- further operators of the inventory ------------------------------------


def _predictions_written(s, sf):
    path = S.fresh_path(s, "predictions")
    _predicted(s, sf).select("Ticker", "Date", F.col("target_close").alias("actual"), "prediction").write.parquet(path)
    return s.read.parquet(path)


def _csv_folder(s, sf, glob=None):
    """The customers of each segment in their own CSV folders, read back by one glob over the files."""
    path = S.fresh_path(s, "segments")
    V.table(s, sf, "customer").write.partitionBy("c_mktsegment").option("header", True).csv(path)
    return S.read_csv(s, f"{path}/*", "c_custkey long, c_name string, c_nationkey int, c_acctbal double", glob="part-*.csv")


def _news_repaired(s, sf):
    """News in two folders of files, those of one without a header line, taken by position. Each task writes the file of what it reads."""
    rows = V.news(s, sf).select("date", F.col("doc_id").cast("string").alias("title"), F.md5("news").alias("news"), "url", "doc_id")
    paths = []
    for i in range(2):
        paths.append(S.fresh_path(s, "news"))
        rows.filter(F.col("doc_id") % 2 == i).drop("doc_id").write.option("header", i == 0).csv(paths[-1])
    return S.news_files(s, paths).select("date", "title", "news", "url", "file")


def _landed_prices(s, sf):
    path = S.fresh_path(s, "prices")
    V.bars(s, sf).write.parquet(path)
    return S.landed_prices(s, path, "1995-01-01", "1996-01-01")


def _trial_logs(s, sf):
    path = S.fresh_path(s, "trials")
    V.table(s, sf, "supplier").select(F.col("s_suppkey").alias("trial_id"), F.col("s_acctbal").alias("val_loss")).write.json(path)
    return E.best_trial(S.trials(s, path, one_each=False))


_add("s02_csv_round_trip_nation", lambda s, sf: (lambda p: (S.write_csv(V.table(s, sf, "nation"), p), S.read_csv(s, p, "n_nationkey int, n_name string, n_regionkey int"))[1])(S.fresh_path(s, "nation")), "SELECT * FROM nation")
_add("s05_glob_scan", _csv_folder, "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
_add("s07_header_repair", _news_repaired, _N + "SELECT CAST(date AS VARCHAR) AS date, CAST(doc_id AS VARCHAR) AS title, md5(news) AS news, url, CAST(doc_id % 2 AS INTEGER) AS file FROM news")
_add("s12_landed_prices", _landed_prices, f"WITH {V.BARS} SELECT * FROM bars WHERE Date >= DATE '1995-01-01' AND Date < DATE '1996-01-01'")
_add("s14_trial_logs", _trial_logs, "SELECT s_suppkey AS trial_id, s_acctbal AS val_loss FROM supplier ORDER BY 2, 1 LIMIT 1")
_add("k06_predictions_written", _predictions_written, f"{_PRED} SELECT Ticker, Date, target_close AS actual, prediction FROM p")
_add("o02_resorted_chunks", lambda s, sf: _resumed(s, sf).orderBy("o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 4 AS BIGINT) AS chunk FROM orders ORDER BY 2, 1")
_add("j06_global_scaling", lambda s, sf: (lambda b: D.scaled(b, D.fit_min_max(b, ["Open", "Close"]), ["Open", "Close"]).select("Ticker", "Date", *_rnd("Open", "Close", digits=6)))(V.bars(s, sf).select("Ticker", "Date", "Open", "Close")), f"WITH {V.BARS}, m AS (SELECT min(Open) AS ol, max(Open) AS oh, min(Close) AS cl, max(Close) AS ch FROM bars) SELECT Ticker, Date, {_r('(Open - ol) / (oh - ol)', 6)} AS Open, {_r('(Close - cl) / (ch - cl)', 6)} AS Close FROM bars, m")


def _aligned(s, sf):
    """Predictions stand at the day they are for, beside that day's close."""
    w = I.by_ticker()
    ahead = V.bars(s, sf).select("Ticker", F.lead("Date").over(w).alias("Date"), F.col("Close").alias("prediction")).filter("Date is not null")
    return V.bars(s, sf).select("Ticker", "Date", F.col("Close").alias("actual")).join(ahead, ["Ticker", "Date"])


_add("j07_aligned_predictions", _aligned, f"WITH {V.BARS} SELECT Ticker, Date, Close AS actual, lag(Close) {_W} AS prediction FROM bars QUALIFY prediction IS NOT NULL")
_add("a13_metrics_top_tickers", lambda s, sf: E.regression(_predicted(s, sf).join(R.top_keys(V.bars(s, sf), "Ticker", 5).select("Ticker"), "Ticker", "left_semi"), "target_close", "prediction", ["Ticker"]).select("Ticker", *_rnd("mae", "rmse")), f"{_PRED}, k AS (SELECT Ticker FROM bars GROUP BY 1 ORDER BY count(*) DESC, Ticker LIMIT 5) SELECT Ticker, {_r('avg(abs(target_close - prediction))')} AS mae, {_r('sqrt(avg((target_close - prediction) * (target_close - prediction)))')} AS rmse FROM p WHERE Ticker IN (SELECT Ticker FROM k) GROUP BY 1")
_add("u04_flattened_windows", lambda s, sf: _D(s, sf).select("doc_id", F.posexplode(C.tokens(F.col("text"))).alias("pos", "token")), r"SELECT doc_id, CAST(unnest(range(0, len(w))) AS INTEGER) AS pos, unnest(w) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda t: t <> '') AS w FROM documents)")
_add("t06_lower", lambda s, sf: V.table(s, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("t")), "SELECT c_custkey, lower(c_mktsegment) AS t FROM customer")
_add("t11_joined_tokens", lambda s, sf: _D(s, sf).select("doc_id", F.md5(F.array_join(C.tokens(F.col("text")), " ")).alias("h")), r"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda t: t <> ''), ' ')) AS h FROM documents")
_add("m02_maths", lambda s, sf: V.table(s, sf, "customer").select("c_custkey", C.rounded(F.ln(F.abs("c_acctbal") + 1), 6).alias("ln"), C.rounded(F.sqrt(F.abs("c_acctbal")), 6).alias("root"), C.clipped(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped")), f"SELECT c_custkey, {_r('ln(abs(c_acctbal) + 1)', 6)} AS ln, {_r('sqrt(abs(c_acctbal))', 6)} AS root, least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) AS clipped FROM customer")
_add("m04_polarity", lambda s, sf: M.LexiconScorer().score(V.table(s, sf, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", C.rounded(C.polarity(F.col("pos"), F.col("neg")), 6).alias("polarity")), rf"""
WITH t AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9\s\x{{00A0}}]', '', 'g'), '[\s\x{{00A0}}]+') AS w FROM conversations),
c AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in M.POSITIVE)}))) AS p, len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in M.NEGATIVE)}))) AS n FROM t)
SELECT conv_id, turn, {_r('(exp(p) - exp(n)) / (exp(p) + exp(n) + exp(1))', 6)} AS polarity FROM c""")
_add("l04_training_log", lambda s, sf: M.loss_plateau(V.table(s, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("epoch"), F.col("s_acctbal").alias("val_mse")), 15), """
WITH e AS (SELECT CAST(s_suppkey AS INTEGER) AS epoch, s_acctbal AS val_mse FROM supplier), b AS (SELECT *, min(val_mse) OVER (ORDER BY epoch) AS best FROM e),
a AS (SELECT *, epoch - max(CASE WHEN val_mse = best THEN epoch END) OVER (ORDER BY epoch) AS waited FROM b),
o AS (SELECT *, coalesce(max(waited) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM a)
SELECT epoch, val_mse, best, waited, pow(0.5::DOUBLE, floor(waited / 7)) AS lr_factor FROM o WHERE over < 15""")


# --- variants, and what needs several operators together --------------------


def _csv_missing(s, sf):
    """Numbers with every kind of missing cell."""
    path = S.fresh_path(s, "missing-csv")
    token = F.element_at(F.array(*map(F.lit, ["NA", "NaN", "null", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = V.table(s, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, token).otherwise(F.col("p_size").cast("string")).alias("p_size"), "p_retailprice")
    S.write_csv(rows, path)
    return S.read_csv(s, path, "p_partkey long, p_size int, p_retailprice double", multi_line=False)


def _csv_excluding(s, sf):
    """A folder of files and their combination, which is left out."""
    path = S.fresh_path(s, "with-combined")
    V.table(s, sf, "nation").write.option("header", True).csv(f"{path}/parts")
    combined = V.table(s, sf, "nation").coalesce(1)
    combined.write.option("header", True).csv(f"{path}/combined")
    names = [r.name for r in s.read.format("binaryFile").load(f"{path}/combined").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).collect()]
    return S.read_csv(s, [f"{path}/parts", f"{path}/combined"], "n_nationkey int, n_name string, n_regionkey int", glob="*.csv", exclude=names)


def _folder(s, sf):
    """One CSV file for each nation's suppliers, keyed by its folder; read by name."""
    path = S.fresh_path(s, "by-name")
    V.table(s, sf, "supplier").coalesce(1).write.option("header", True).csv(path)
    return S.read_folder_by_name(s, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").drop("ticker")


def _landed_links(s, sf):
    """Landed pages, their links, of these the articles that are not in the list of those seen."""
    path = S.fresh_path(s, "pages")
    V.table(s, sf, "pages").write.parquet(path)
    return S.landed_pages(s, path)


_EXCLUDED = ("/photos/", "/videos/", "/page/", "/tag/", "/author/", "/about/", "7.com")
_add("s04_missing_numbers", _csv_missing, "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size, p_retailprice FROM part")
_add("s05_glob_excluding", _csv_excluding, "SELECT * FROM nation")
_add("s06_folder_by_name", _folder, "SELECT * FROM supplier")
_add("s11_landed_pages", _landed_links, "SELECT url, html FROM pages")
_add("f06_date_window_with_null", lambda s, sf: R.within_dates(V.news(s, sf).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("date")).alias("date")), "date", "2024-01-05", "2024-01-12", keep_null=True), _N + "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN date END AS date FROM news WHERE doc_id % 5 = 0 OR date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
_add("f07_stale_report", lambda s, sf: R.stale_report(V.bars(s, sf).withColumn("Volume", F.when(F.col("Volume") % 2 == 0, 0).otherwise(F.col("Volume")))), f"WITH {V.BARS} SELECT Date, count(*) AS n FROM bars WHERE Volume % 2 = 0 AND Open = Close GROUP BY 1")
_add("f12_neutral", lambda s, sf: V.news(s, sf).select("doc_id", F.md5(C.or_neutral(F.when(F.col("doc_id") % 3 != 0, F.col("title")))).alias("h")), _N + "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 OR trim(title) = '' THEN 'neutral' ELSE title END) AS h FROM news")
_add("f13_unseen_articles", lambda s, sf: R.unseen(V.news(s, sf).filter(C.is_article_url(F.col("url"), "news", _EXCLUDED)).select("url"), V.news(s, sf).filter("source = 'src2'").select("url")), _N + "SELECT DISTINCT url FROM news WHERE regexp_matches(url, '[-/]\\d+/?$') AND NOT contains(url, '7.com') AND url NOT IN (SELECT url FROM news WHERE source = 'src2')")
_add("j02_exact_times", lambda s, sf: R.with_ticker_news(V.intraday_bars(s, sf).withColumnRenamed("Hour", "Date").select("Ticker", "Date", "Close"), V.table(s, sf, "events").groupBy(F.col("event_type").alias("Ticker"), F.date_trunc("hour", "ts").alias("Date")).agg(F.max("value").alias("score")).filter("score > 50"), ["score"], exact=True), f"WITH i AS ({V.INTRADAY}), e AS (SELECT event_type AS Ticker, date_trunc('hour', ts) AS Hour, max(value) AS score FROM events GROUP BY 1, 2 HAVING max(value) > 50) SELECT Ticker, Hour AS \"Date\", Close, coalesce(score, 0) AS score FROM i LEFT JOIN e USING (Ticker, Hour)")

_EIGHT = ["Open", "High", "Low", "Close", "Adj Close", "Volume", "n", "score"]
_add("w11_lags_8x10", lambda s, sf: D.complete(D.lagged(R.with_news(V.bars(s, sf), daily(s, sf)).drop("news_date"), _EIGHT, 10)).select("Ticker", "Date", *[F.col(f"`{c}_lag_{i}`") for c in _EIGHT for i in (1, 5, 10)], "target_close"), _BD + f"""
, j AS (SELECT Ticker, b.Date, Open, High, Low, Close, "Adj Close", Volume, n, score FROM bars b LEFT JOIN daily d ON b.Date = d.date),
q AS (SELECT *, lead(Close) {_W} AS target_close, {', '.join(f'lag("{c}", {i}) {_W} AS "{c}_lag_{i}"' for c in _EIGHT for i in range(1, 11))} FROM j)
SELECT Ticker, Date, {', '.join(f'"{c}_lag_{i}"' for c in _EIGHT for i in (1, 5, 10))}, target_close FROM q WHERE n IS NOT NULL AND score IS NOT NULL AND target_close IS NOT NULL AND {' AND '.join(f'"{c}_lag_{i}" IS NOT NULL' for c in _EIGHT for i in range(1, 11))}""")


def _sequence_check(x: str) -> str:
    """Long sequences as their ends, size and sum, so that 60 steps of every bar can be compared."""
    return f"CAST(len({x}) AS INTEGER) AS n, {_r(f'{x}[1][1]', 6)} AS first, {_r(f'{x}[60][1]', 6)} AS last, {_r(f'list_sum(list_transform({x}, lambda v: v[1]))', 4)} AS total"


def _summed(df):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])
    return df.select("Ticker", "Date", F.size("x").alias("n"), C.rounded(F.col("x")[0][0], 6).alias("first"), C.rounded(F.col("x")[59][0], 6).alias("last"), C.rounded(total, 4).alias("total"), C.rounded(F.col("y"), 6).alias("y"))


def _scaled_bars(s, sf):
    b = V.bars(s, sf).select("Ticker", "Date", "Close")
    return D.scaled(b, D.fit_min_max(b, ["Close"], ["Ticker"]), ["Close"], ["Ticker"])


_MM = f"WITH {V.BARS}, m AS (SELECT Ticker, min(Close) AS lo, max(Close) AS hi FROM bars GROUP BY 1), c AS (SELECT Ticker, Date, (Close - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS Close, lo, hi FROM bars JOIN m USING (Ticker))"
_60 = "OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_add("w14_sequences_60", lambda s, sf: _summed(D.sequences((lambda w: V.bars(s, sf).select("Ticker", "Date", "Close", I.pct_change("Close", w).alias("Return")))(I.by_ticker()), ["Close"], 60, "Return", 1)), f"WITH {V.BARS}, r AS (SELECT Ticker, Date, Close, Close / lag(Close) {_W} - 1 AS ret FROM bars), q AS (SELECT Ticker, Date, list([Close]) {_60} AS x, lead(ret) {_W} AS y FROM r) SELECT Ticker, Date, {_sequence_check('x')}, {_r('y', 6)} AS y FROM q WHERE len(x) = 60 AND y IS NOT NULL")
_add("w15_scaled_sequences_60", lambda s, sf: _summed(D.sequences(_scaled_bars(s, sf), ["Close"], 60, "Close")), f"{_MM}, q AS (SELECT Ticker, Date, list([Close]) {_60} AS x, Close AS y FROM c) SELECT Ticker, Date, {_sequence_check('x')}, {_r('y', 6)} AS y FROM q WHERE len(x) = 60 AND y IS NOT NULL")
_add("w19_positional_split_90_10", lambda s, sf: D.positional_split(V.bars(s, sf).select("Ticker", "Date"), ["Ticker", "Date"], [("train", 0.9), ("test", 0.1)]), f"WITH {V.BARS}, p AS (SELECT Ticker, Date, row_number() OVER (ORDER BY Ticker, Date) AS i, count(*) OVER () AS n FROM bars) SELECT Ticker, Date, CASE WHEN i <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM p")


def _unscaled(s, sf):
    b = V.bars(s, sf).select("Ticker", "Date", "Close")
    fitted = D.fit_min_max(b, ["Close"], ["Ticker"])
    made = D.scaled(b, fitted, ["Close"], ["Ticker"]).join(fitted, "Ticker")
    return made.select("Ticker", "Date", C.rounded(C.min_max_inverse(F.col("Close"), F.col("Close__lo"), F.col("Close__hi")), 4).alias("Close"))


_add("m05_inverse", _unscaled, f"{_MM} SELECT Ticker, Date, {_r('Close * CASE WHEN hi = lo THEN 1 ELSE hi - lo END + lo')} AS Close FROM c")


def _chunk_means(s, sf):
    """Windows of all documents as one flat table, scored, and mapped back to their documents."""
    d = _D(s, sf).select("doc_id", C.tokens(F.col("text")).alias("w"))
    flat = d.select("doc_id", F.explode(C.token_windows(F.col("w"))).alias("x"))
    scored = flat.select("doc_id", (F.size("x") / 510.0).alias("pos"), (1 - F.size("x") / 510.0).alias("neg"), F.lit(0.0).alias("neu"))
    return R.document_scores(d, scored, "doc_id").select("doc_id", *_rnd("pos", "neg", "neu", digits=6))


_WIN = r"""
t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda t: t <> '') AS w FROM documents),
k AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 510 THEN 1 ELSE 1 + CAST(ceil((len(w) - 510) / 254.0) AS INTEGER) END AS k FROM t),
x AS (SELECT doc_id, w, pos, list_slice(w, pos * 254 + 1, pos * 254 + 510) AS c FROM (SELECT doc_id, w, unnest(range(0, k)) AS pos FROM k))"""
_add("u04_scores_mapped_back", _chunk_means, f"WITH {_WIN}, m AS (SELECT doc_id, avg(len(c) / 510.0::DOUBLE) AS p FROM x GROUP BY 1) SELECT doc_id, {_r('coalesce(p, 0)', 6)} AS pos, {_r('coalesce(1 - p, 0)', 6)} AS neg, CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS neu FROM documents LEFT JOIN m USING (doc_id)")


def _encoded(s, sf):
    ids = F.transform(C.tokens(F.col("text")), lambda t: F.length(t) + 1000)
    d = _D(s, sf).select("doc_id", F.posexplode(C.encoded_windows(ids)).alias("pos", "x"))
    return d.select("doc_id", "pos", F.md5(F.array_join(F.transform("x.ids", lambda i: i.cast("string")), " ")).alias("h"), F.aggregate("x.mask", F.lit(0), lambda a, m: a + m).alias("used"), F.size("x.ids").alias("n"))


_add("t14_encoded_windows", _encoded, f"WITH {_WIN}, e AS (SELECT doc_id, pos, list_concat(list_concat([101], list_transform(c, lambda t: CAST(length(t) + 1000 AS INTEGER))), [102]) AS i FROM x) SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(array_to_string(list_concat(i, list_transform(range(512 - len(i)), lambda z: 0)), ' ')) AS h, CAST(len(i) AS INTEGER) AS used, 512 AS n FROM e")
_add("k07_error_histogram", lambda s, sf: E.error_histogram(_predicted(s, sf), "target_close", "prediction", 50.0), f"{_PRED} SELECT floor((target_close - prediction) / 50.0) * 50.0::DOUBLE AS bin, count(*) AS n FROM p GROUP BY 1")
_add("k07_plot_series", lambda s, sf: E.plot_series(_predicted(s, sf), R.top_keys(V.bars(s, sf), "Ticker", 3).select("Ticker"), "target_close", "prediction"), f"{_PRED}, k AS (SELECT Ticker FROM bars GROUP BY 1 ORDER BY count(*) DESC, Ticker LIMIT 3), u AS (SELECT * FROM p WHERE Ticker IN (SELECT Ticker FROM k)) SELECT Ticker, Date, 'actual' AS kind, target_close AS value FROM u UNION ALL SELECT Ticker, Date, 'predicted', prediction FROM u")

# Regression on lags: no SQL solves it; tests hold it against numpy's least squares.
_LAGS = [f"Close_lag_{i}" for i in range(1, 11)] + ["Close"]


def _lag_rows(s, sf):
    """The lags are made once, as a table: the split and every pass of a fit read it again."""
    made = D.complete(D.lagged(V.bars(s, sf).select("Ticker", "Date", "Close"), ["Close"], 10))
    return D.chronological_split(S.stage(s, S.fresh_path(s, "lags"), lambda: made))


def _lag_regression(s, sf):
    rows = _lag_rows(s, sf)
    fitted = M.LagRegression(_LAGS, solver="normal").fit(rows.filter("split = 'train'"))
    return fitted.predict(rows.filter("split = 'test'")).select("Ticker", "Date", "target_close", *_rnd("prediction", digits=2))


def _ridge_search(s, sf):
    rows = _lag_rows(s, sf)
    return M.ridge_search(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), _LAGS, {"ridge": [0.0, 0.1, 1.0], "lasso_share": [0.0, 0.5]}).select("trial_id", "ridge", "lasso_share", *_rnd("val_loss", digits=2))


def _skipped_training(s, sf):
    """A model is fitted and saved by the first call and only loaded by the second one, which never sees a training row."""
    path, rows = S.fresh_path(s, "model"), _lag_rows(s, sf)
    M.LagRegression(_LAGS, solver="normal").fit_or_load(rows.filter("split = 'train'"), path)
    again = M.LagRegression(_LAGS, solver="normal").fit_or_load(rows.limit(0), path)
    return E.regression(again.predict(rows.filter("split = 'test'")), "target_close", "prediction").select(*_rnd("mse", "mae", "rmse", "mape", digits=2))


def _run_saved(s, sf):
    """A run's predictions, loss by iteration and weights, written side by side."""
    path, rows = S.fresh_path(s, "run"), _lag_rows(s, sf)
    fitted = M.LagRegression(_LAGS, solver="l-bfgs", rounds=20).fit(rows.filter("split = 'train'"))
    S.save_run(fitted.predict(rows.filter("split = 'test'")).select("Ticker", "Date", "target_close", "prediction"), fitted.log, fitted.model, path)
    return M.loss_plateau(s.read.parquet(f"{path}/log"), 15).select("epoch", *_rnd("val_mse", digits=2))


_add("l03_lag_regression", _lag_regression)
_add("l04_run_saved", _run_saved)
_add("l05_ridge_search", _ridge_search)
_add("l06_training_skipped", _skipped_training)


def _phases(s, sf):
    """Articles are measured as they landed, as the SQL does; the phases alone measure them cleaned."""
    made = PH.run(s, V.news(s, sf).withColumn("date", F.col("date").cast("string")), V.bars(s, sf).drop("Adj Close"), V.sectors(s, sf), S.fresh_path(s, "phases"), "1990-01-01", "2030-01-01", as_landed=True)
    return made["calendar"].join(made["volume"].select("Date", "Num_Articles"), "Date", "full")


_add("p01_four_phases", _phases, f"""WITH {V.BARS}, {V.NEWS}, c AS (SELECT Date, count(DISTINCT Ticker) AS "Num_Tickers", dayname(Date) AS "Day_Of_Week" FROM bars WHERE NOT (Volume = 0 AND Open = Close) GROUP BY 1),
v AS (SELECT date AS "Date", count(title) AS "Num_Articles" FROM news WHERE length(title) > 3 AND length(news) >= 100 GROUP BY 1) SELECT coalesce(c.Date, v.Date) AS "Date", "Num_Tickers", "Day_Of_Week", "Num_Articles" FROM c FULL JOIN v ON c.Date = v.Date""")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
