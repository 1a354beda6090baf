"""Functions and operators against pandas and hand-made rows."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerweave.functions import columns as C
from tickerweave.functions import html as H
from tickerweave.functions import indicators as I
from tickerweave.operators import dataset as D
from tickerweave.operators import evaluate as E
from tickerweave.operators import features as P
from tickerweave.operators import models as M
from tickerweave.operators import relational as R


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    import __spark_entry__

    __spark_entry__._importable(spark)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def bars(spark, closes, volumes=None, ticker="A"):
    rows = [(ticker, dt.date(2024, 1, 1) + dt.timedelta(i), c, c + 1.0 if c is not None else None, c - 1.0 if c is not None else None, c, (volumes or [100] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "Ticker string, Date date, Open double, High double, Low double, Close double, Volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("Ticker", "Date").select("Ticker", "Date", name).collect()]


def same(got, want):
    return all((a is None and (b is None or math.isnan(b))) or (a is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got, want, strict=True))


def test_ema_by_hand(spark):
    got = column(P.with_ema(bars(spark, [10.0, 11.0, 12.5, 11.0, 13.0])), "EMA_12")
    assert math.isclose(got[-1], 10.96029550786037)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(1, 1000)), min_size=1, max_size=40))
def test_indicators_against_pandas(spark, closes):
    df, w = bars(spark, closes), I.by_ticker()
    s = pd.Series(closes, dtype=float)
    f = s.ffill()
    got = df.select("*", I.pct_change("Close", w).alias("p1"), I.pct_change("Close", w, 5).alias("p5"), I.sma("Close", 5, w).alias("sma"), I.volatility(F.col("Close"), 10, w).alias("sd"), I.log_return("Close", w).alias("lr"))
    assert same(column(got, "p1"), (f / f.shift(1) - 1).tolist())
    assert same(column(got, "p5"), (f / f.shift(5) - 1).tolist())
    assert same(column(got, "sma"), s.rolling(5).mean().tolist())
    assert same(column(got, "lr"), np.log(s / s.shift(1)).tolist())
    assert all(a is None or abs(a - b) < 1e-6 for a, b in zip(column(got, "sd"), s.rolling(10).std()))
    assert [a is None for a in column(got, "sd")] == s.rolling(10).std().isna().tolist()


def test_rsi_of_rising_prices_is_null(spark):
    got = P.price_features(bars(spark, [float(i) for i in range(1, 20)]))
    assert set(column(got, "RSI_14")) == {None}


def test_fill_before_pct_change(spark):
    df, w = bars(spark, [1.0, None, 2.0]), I.by_ticker()
    assert column(df.select("*", I.pct_change("Close", w).alias("p")), "p") == [None, 0.0, 1.0]
    assert column(df.select("*", I.log_return("Close", w).alias("p")), "p") == [None, None, None]


def test_rounding(spark):
    x = np.random.default_rng(0).normal(size=2000) * 100
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(C.rounded(F.col("x"), 4).alias("y")).collect()
    assert [r.y for r in got] == np.round(x, 4).tolist()
    assert one(spark, lambda c: C.rounded(c, 4), 1.00005, "double") == np.round(1.00005, 4)


def test_text(spark):
    assert one(spark, C.clean_article, "A &amp; B  &#8377;") == "A & B ₹"
    assert one(spark, C.without_teasers, "Foo. ALSO READ: Some other story here. Next sentence.") == "Foo. . Next sentence."
    assert one(spark, C.newlines_to_stops, "\na\n\nb\r\nc ") == ". a. b. c"
    assert one(spark, C.source_domain, "https://www.a-b.com/x/1") == "a-b.com"
    assert one(spark, C.source_domain, "nothing") is None
    assert one(spark, lambda c: C.without_suffix(c, ".NS"), "ABC.NS.NS") == "ABC.NS"
    assert one(spark, C.normalised_text, "The Companies' shares rose; don't sell, boxes!") == "company share rose dont sell box"
    assert one(spark, C.or_neutral, "  ") == "neutral" and one(spark, C.or_neutral, None) == "neutral"
    assert one(spark, lambda c: C.title_and_body(F.lit(None).cast("string"), c), "x" * 400) == ". " + "x" * 300


def test_token_windows(spark):
    for n, want in ((0, []), (1, [1]), (510, [510]), (511, [510, 257]), (1000, [510, 510, 492])):
        got = one(spark, lambda c: F.transform(C.token_windows(C.tokens(c)), F.size), "w " * n)
        assert got == want, n


def test_dates(spark):
    assert one(spark, lambda c: F.to_date(C.iso_local(c)), "2025-09-01T23:00:00+05:30") == dt.date(2025, 9, 1)
    assert one(spark, C.loose_timestamp, "bad") is None and one(spark, C.loose_timestamp, "2025-13-01") is None
    assert one(spark, lambda c: C.day_name(C.strict_date(c)), "2024-01-01") == "Monday"
    with pytest.raises(Exception):
        one(spark, C.strict_date, "bad")


def test_html():
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "NewsArticle", "headline": "H", "articleBody": "B", "datePublished": "2025", "author": [{"name": "N"}]}]}</script>'
    assert H.article(f"<html>{ld}<h1>x</h1></html>") == ("2025", "H", "B", "N")
    long = "p" * 31
    got = H.article(f'<title>T</title><meta property="article:published_time" content="D"><meta name="author" content="A"><p>{long}<p>short<p>{long}')
    assert got == ("D", "T", f"{long}\n{long}", "A")
    assert H.article('<script type="application/ld+json">{bad</script><time>now</time>') == ("now", None, None, None)
    assert H.article(None) == (None, None, None, None)
    assert H.author_name({"name": "x"}) == "x" and H.author_name("y") == "y" and H.author_name([]) is None
    assert H.page('<a href="a">1</a><a href="b"></a><a href="a">').links == ["a", "b", "a"]


def test_stale_bars_keep_unknown(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (None, 1.0, 1.0), (0, 1.0, 2.0), (5, 1.0, 1.0)], "Volume long, Open double, Close double")
    assert R.without_stale(df).count() == 3


def test_first_per_key_keeps_one_null(spark):
    df = spark.createDataFrame([("u", 1, 0), ("u", 0, 5), (None, 0, 1), (None, 0, 2)], "url string, file int, row int")
    got = {(r.url, r.file, r.row) for r in R.first_per_key(df, ["url"], ["file", "row"]).collect()}
    assert got == {("u", 0, 5), (None, 0, 1)}


def test_document_without_chunks_is_neutral(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    chunks = spark.createDataFrame([(1, 0.5, 0.25, 0.25), (1, 0.7, 0.05, 0.25)], "id long, pos double, neg double, neu double")
    got = {r.id: (r.pos, r.neg, r.neu) for r in R.document_scores(docs, chunks, "id").collect()}
    assert got[2] == (0.0, 0.0, 1.0) and math.isclose(got[1][0], 0.6)


def test_news_join_and_complete(spark):
    b = bars(spark, [1.0, 2.0, 3.0])
    daily = spark.createDataFrame([(dt.date(2024, 1, 2), 0.5)], "date date, score double")
    got = R.with_news(b, daily)
    assert got.count() == 3 and D.complete(got).count() == 1 and "news_date" in got.columns
    late = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 9), 0.5)], "Ticker string, Date timestamp, score double")
    assert column(R.with_ticker_news(b, late, ["score"]), "score") == [0.0, 0.5, 0.0]
    assert column(R.with_ticker_news(b, late, ["score"], exact=True), "score") == [0.0, 0.0, 0.0]


def test_splits(spark):
    got = D.chronological_split(bars(spark, [float(i) for i in range(10)]))
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 8, "validation": 1, "test": 1}
    b = bars(spark, [float(i) for i in range(20)])
    got = D.positional_split(b, ["Ticker", "Date"], [("train", 0.7), ("validation", 0.15), ("test", 0.15)])
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 14, "validation": 3, "test": 3}


def test_scaling(spark):
    b = bars(spark, [2.0, 4.0, 3.0]).withColumn("k", F.lit(7.0))
    fitted = D.fit_min_max(b, ["Close", "k"])
    got = D.scaled(b, fitted, ["Close", "k"])
    assert column(got, "Close") == [0.0, 1.0, 0.5] and column(got, "k") == [0.0] * 3
    back = got.crossJoin(fitted).select("Ticker", "Date", C.min_max_inverse(F.col("Close"), F.col("Close__lo"), F.col("Close__hi")).alias("y"))
    assert column(back, "y") == [2.0, 4.0, 3.0]


def test_sequences_and_tensors(spark):
    b = bars(spark, [float(i) for i in range(8)])
    got = D.sequences(b, ["Close"], 3, "Close", 1).orderBy("Date").collect()
    assert len(got) == 4 and got[0].x == [[0.0], [1.0], [2.0]] and got[0].y == 4.0
    lagged = D.complete(D.lagged(b.select("Ticker", "Date", "Close"), ["Close"], 2))
    assert D.tensors(lagged, ["Close"], 2).orderBy("Date").first().x == [[0.0], [1.0], [2.0]]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "a int, p int")
    got = E.classification(df, "a", "p").first()
    assert (got.precision, got.recall, got.f1) == (0.0, 0.0, 0.0) and math.isclose(got.accuracy, 1 / 3)
    m = E.regression(spark.createDataFrame([(2.0, 1.0), (4.0, 5.0)], "y double, z double"), "y", "z").first()
    assert (m.mse, m.mae, m.rmse) == (1.0, 1.0, 1.0) and math.isclose(m.mape, 37.5)
    t = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "trial_id string, val_loss double")
    assert E.best_trial(t).first().trial_id == "a"


def test_models(spark):
    got = M.LexiconScorer().score(spark.createDataFrame([("Profits rise",), (None,)], "t string"), "t").collect()
    assert got[0].pos > got[0].neg and all(math.isclose(r.pos + r.neg + r.neu, 1.0) for r in got)
    rows = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "Close double, target_close double")
    fit = M.LinearTrend().fit(rows)
    assert math.isclose(fit.slope, 2.0) and math.isclose(fit.intercept, 1.0)
    log = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 2.0, 2.5, 2.6, 2.7, 1.0])], "epoch int, val_mse double")
    assert [r.epoch for r in M.loss_plateau(log, 3).orderBy("epoch").collect()] == [0, 1, 2, 3, 4]


def test_wide_to_long(spark):
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.234, None, 5, None)], "Date date, `A.NS|Open` double, `B.NS|Open` double, `A.NS|Volume` long, `B.NS|Volume` long")
    got = R.wide_to_long(wide, ["A.NS", "B.NS"], ["Open", "Volume"]).collect()
    assert [(r.Ticker, r.Open, r.Volume) for r in got] == [("A", 1.23, 5)]


def test_training_log_reads_all_suppliers(spark, tmp_path):
    from tickerweave.plans import catalog

    spark.createDataFrame([(i, 1000.0 - i) for i in range(1, 151)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    assert catalog.queries()["l04_training_log"](spark, str(tmp_path)).count() == 150


def test_ema_weighs_by_gaps(spark):
    """Against pandas' ewm, with nulls at the start, inside and at the end, over several blocks."""
    import random

    import pandas as pd

    rng = random.Random(1)
    values = [None, None] + [None if rng.random() < 0.3 else rng.uniform(1, 100) for _ in range(700)] + [None]
    want = pd.Series(values, dtype="float64").ewm(span=12, adjust=False).mean()
    got = P._ema(values, 2.0 / 13)
    assert got[:2] == [None, None] and all(abs(a - b) < 1e-9 for a, b in zip(got[2:], want[2:]) if b == b)
    assert P._ema([10.0, None, 12.0, 13.0], 2.0 / 13)[2:] == pytest.approx(pd.Series([10.0, None, 12.0, 13.0]).ewm(span=12, adjust=False).mean()[2:].tolist())
    assert P._ema([None, None], 0.1) == [None, None]


def test_json_articles_with_raw_line_ends():
    from tickerweave.functions import html as H

    page = '<script type="application/ld+json">{"@type": "NewsArticle", "headline": " A ", "datePublished": 2024, "articleBody": "one\n\ttwo "}</script><p>other text that is long enough to count</p>'
    assert H.article(page) == ("2024", "A", "one\n\ttwo", None)


def test_batch_scorer_loads_once_and_lag_regression(spark, tmp_path):
    import numpy as np
    from tickerweave.operators import models as M

    def load():
        return lambda texts: [(float(len(t)), 0.0, 1.0) for t in texts]

    got = M.BatchScorer(load).score(spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string"), "t").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "abc", 3.0, 0.0, 1.0), (2, None, 0.0, 0.0, 1.0)]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, target_close double")
    fitted = M.LagRegression(["a", "b", "c"], solver="normal").fit(df)
    want = np.linalg.lstsq(np.c_[x, np.ones(80)], y, rcond=None)[0]
    assert np.allclose([*fitted.model.coefficients, fitted.model.intercept], want, atol=1e-6)
    first = M.LagRegression(["a", "b", "c"], solver="normal").fit_or_load(df, str(tmp_path / "m"))
    again = M.LagRegression(["a", "b", "c"]).fit_or_load(df.limit(0), str(tmp_path / "m"))
    assert list(first.model.coefficients) == list(again.model.coefficients)
    trials = M.ridge_search(df, df, ["a", "b", "c"], {"ridge": [0.0, 10.0]}).orderBy("val_loss").collect()
    assert len(trials) == 2 and trials[0].ridge == 0.0
    assert fitted.predict(df).count() == 80


def test_rank_without_a_global_window(spark):
    import random

    from tickerweave.operators import relational as R

    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, float(rng.randrange(300))])) for i in range(500)]
    got = {r.i: r["rank"] for r in R.ranked(spark.createDataFrame(rows, "i int, v double"), F.col("v"), F.col("i")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(want)}
    assert R.ranked(spark.createDataFrame([], "i int, v double"), F.col("v"), F.col("i")).count() == 0
