"""What keeps the queries over bars and news in proportion to their tables: plans, tables made once, and the same results."""

from __future__ import annotations

import datetime as dt
import os
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerweave.functions import indicators as I
from tickerweave.operators import dataset as D
from tickerweave.operators import features as P
from tickerweave.operators import models as M
from tickerweave.operators import relational as R
from tickerweave.plans import catalog
from tickerweave.sources import virtual as V

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    import __spark_entry__

    __spark_entry__._importable(spark)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def made_once(df, name: str) -> bool:
    return all(f"/{name}-" in f for f in df.inputFiles())


def test_tickers_as_columns_in_blocks(spark):
    """the plan has the columns of one block, not three for each ticker."""
    rng = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(6)]
    rows = [(f"T{t}", d, rng.choice([None, 1.234, 2.345]), rng.choice([None, t])) for t in range(150) for d in days if rng.random() < 0.4] + [(None, days[0], 1.0, 1)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Open double, Volume long")
    header, wide = R.wide_blocks(df, ["Open", "Volume"], width=16)
    tickers = {r[0] for r in rows} - {None}
    assert len(wide.columns) == 2 + 16 * 2 and header.count() == -(-len(tickers) // 16)
    got = {(r.Ticker, r.Date, r.Open, r.Volume) for r in R.blocks_to_long(header, wide, ["Open", "Volume"]).collect()}
    assert got == {(t, d, o and float(round(o, 2)), v) for t, d, o, v in rows if t and (o is not None or v is not None)}


@tables
def test_wide_query_has_few_columns(spark):
    """F2: the tickers of sf0.001 fit one block, others would be further rows."""
    assert plan(catalog.queries()["u03_wide_to_long"](spark, SF)).count("|Open#") < 64 * 12


def test_news_files_are_written_where_they_are_read(spark, tmp_path):
    """no task gathers all documents."""
    docs = spark.createDataFrame([(i, f"title {i}\n" + "text " * 9, "en", f"s{i % 3}", 50) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["s07_header_repair"](spark, str(tmp_path))
    folders = {os.path.dirname(f) for f in got.inputFiles()}
    assert len(folders) == 2 and len([f for f in got.inputFiles() if "part-" in f]) > 3
    rows = got.collect()
    assert sorted(int(r.title) for r in rows) == list(range(30)) and all(r.file == int(r.title) % 2 for r in rows)


@tables
def test_bars_go_through_one_exchange(spark):
    """F4 to F11: windows over bars find them by ticker and in order; trades are not gathered in two steps."""
    p = plan(D.lagged(V.bars(spark, SF), ["Open", "Close"], 2))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("+- Sort ") == 1


@tables
def test_grid_search_reads_a_table(spark):
    """every candidate is fitted and scored in the same pass over rows that were made once."""
    got = catalog.queries()["l05_grid_search"](spark, SF)
    assert made_once(got, "targets") and plan(got).count("Union") == 0


def test_grid_search_is_that_of_each_candidate(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(x, rng.random(), 3 * x + rng.random()) for x in (rng.random() for _ in range(60))], "a double, b double, target_close double")
    got = {r.feature: (r.trial_id, r.val_loss) for r in M.grid_search(df, df, ["a", "b"]).collect()}
    for i, f in enumerate("ab"):
        p = M.LinearTrend(f).fit(df).predict(df)
        want = p.agg(F.avg(F.pow(F.col("target_close") - F.col("prediction"), 2))).first()[0]
        assert got[f][0] == i and got[f][1] == pytest.approx(want)


@tables
def test_lags_are_made_once(spark):
    """the split and the fits read the lags from a table, not from line items each time."""
    rows = catalog._lag_rows(spark, SF)
    assert made_once(rows, "lags")
    assert "BroadcastHashJoin" in plan(rows) and "SortMergeJoin" not in plan(rows)


def test_ridge_search_scores_all_trials_at_once(spark):
    """one pass over the validation part."""
    rng = random.Random(4)
    df = spark.createDataFrame([(x, y, 2 * x - y + rng.random()) for x, y in ((rng.random(), rng.random()) for _ in range(60))], "a double, b double, target_close double")
    found = M.ridge_search(df, df, ["a", "b"], {"ridge": [0.0, 1.0], "lasso_share": [0.0, 0.5]})
    assert plan(found).count("Union") == 0
    for r in found.collect():
        p = M.LagRegression(["a", "b"], ridge=r.ridge, lasso_share=r.lasso_share).fit(df).predict(df)
        assert r.val_loss == pytest.approx(p.agg(F.avg(F.pow(F.col("target_close") - F.col("prediction"), 2))).first()[0])


def test_ema_goes_on_from_batch_to_batch(spark):
    """F8, F10: a worker holds one batch of rows, however long the histories and large the parts are."""
    rng = random.Random(6)
    closes = {t: [None if rng.random() < 0.3 else rng.uniform(1, 100) for _ in range(n)] for t, n in (("A", 40), ("B", 1), (None, 23), ("C", 9), ("D", 64))}
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(i), x) for t, xs in closes.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = P.with_ema(spark.createDataFrame(rows, "Ticker string, Date date, Close double"))
        got = {(r.Ticker, r.Date): r.EMA_12 for r in df.collect()}
        late = {(r.Ticker, r.Date): r.EMA_12 for r in df.filter("Date > date'2024-01-20'").collect()}  # rows before still count
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for t, xs in closes.items():
        want = pd.Series(xs, dtype="float64").ewm(span=12, adjust=False).mean()
        for i, w in enumerate(want):
            g = got[t, dt.date(2024, 1, 1) + dt.timedelta(i)]
            assert g is None if w != w else g == pytest.approx(w, rel=1e-12)
    assert late and all(got[k] == v for k, v in late.items())
    assert "collect_list" not in plan(df)


@tables
def test_price_features_go_through_one_exchange(spark):
    """F8, F10"""
    p = plan(P.price_features(V.bars(spark, SF).drop("Adj Close")))
    assert p.count("Exchange hashpartitioning") == 1 and "collect_list" not in p


def test_lags_of_many_columns_share_a_window_expression(spark):
    """as many as there are distances, not columns times distances."""
    rows = [("A" if i % 3 else "B", dt.date(2024, 1, 1) + dt.timedelta(i), float(i), None if i % 4 == 0 else i) for i in range(30)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double, `a b` long")
    got = D.lagged(df, ["Close", "a b"], 5)
    want = df.select("*", *I.lags(["Close", "a b"], 5, I.by_ticker()), I.target("Close", I.by_ticker()).alias("target_close"))
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    window = next(x for x in plan(got).splitlines() if "Window [" in x)
    assert window.count("windowspecdefinition(") == 6


@tables
def test_news_by_day_leave_the_bars_where_they_are(spark):
    """whatever the optimizer takes the days' size for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(R.with_news(V.bars(spark, SF), catalog.daily(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
