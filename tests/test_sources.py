"""CSV, JSON, file sinks, staging, streams."""

from __future__ import annotations

import datetime as dt

from tickerweave.sources import files as S
from tickerweave.streaming import live


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tolerant_csv(spark, tmp_path):
    put(tmp_path / "a_news.csv", 'a,b,c\n1,"x, ""y""\nz",2.5\nbad,NA,1\n3,null,4\n')
    put(tmp_path / "other.csv", "a,b,c\n9,9,9\n")
    got = S.read_csv(spark, str(tmp_path), "a int, b string, c double", glob="*_news.csv").collect()
    assert [tuple(r) for r in got] == [(1, 'x, "y"\nz', 2.5), (3, None, 4.0)]


def test_folder_keys_from_names(spark, tmp_path):
    put(tmp_path / "abc.csv", "close\n1.5\n")
    put(tmp_path / "xyz.csv", "close\n2.5\n")
    got = S.read_folder_by_name(spark, str(tmp_path), "close double").collect()
    assert {(r.ticker, r.close) for r in got} == {("ABC", 1.5), ("XYZ", 2.5)}


def test_names(spark):
    df = spark.createDataFrame([(1.0, None, "x")], "` Close` double, `Adj Close` double, `Date ` string")
    got = S.normalised_names(df, {"date": "Date"})
    assert set(got.columns) == {"close", "Date"} and got.first().close is None


def test_news_files_without_headers(spark, tmp_path):
    files = [
        put(tmp_path / "1.csv", "date,title,news,url,section\n2024-01-01,T,N,u1,s\n"),
        put(tmp_path / "2.csv", "2024-01-02,T2,N2,https://x/news/2\n2024-01-03,T3,N3,u3\n"),
        put(tmp_path / "3.csv", "a,b\n1,2\n"),
        put(tmp_path / "4.csv", ""),
    ]
    got = S.news_files(spark, files).collect()
    assert {(r.file, r.url) for r in got} == {(0, "u1"), (1, "https://x/news/2"), (1, "u3")}


def test_rest_replies(spark):
    landed = spark.createDataFrame([("A", '[{"datetime": 86400, "headline": "h"}]'), ("B", "oops"), ("C", "[]")], "symbol string, body string")
    got = S.rest_news(landed).collect()
    assert [(r.symbol, r.Date, r.News) for r in got] == [("A", dt.datetime(1970, 1, 2), "h")]


def test_trials(spark, tmp_path):
    put(tmp_path / "t1" / "trial.json", '{"trial_id": "1",\n "val_loss": 0.5}')
    put(tmp_path / "t2" / "trial.json", '{"trial_id": "2", "val_loss": 0.25}')
    from tickerweave.operators.evaluate import best_trial

    assert best_trial(S.trials(spark, str(tmp_path))).first().trial_id == "2"


def test_stage_and_resume(spark, tmp_path):
    df = spark.range(10)
    assert S.stage(spark, str(tmp_path / "s"), lambda: df).count() == 10
    assert S.stage(spark, str(tmp_path / "s"), lambda: df.limit(1)).count() == 10
    assert S.stage(spark, str(tmp_path / "s"), lambda: df.limit(1), force=True).count() == 1
    path = str(tmp_path / "c")
    S.resume_chunks(df.filter("id % 3 = 0"), df.id % 3, path)
    assert S.resume_chunks(df, df.id % 3, path).count() == 10
    assert S.resume_chunks(df, df.id % 3, path).count() == 10
    S.write_csv(df, str(tmp_path / "w"), append=True)
    S.write_csv(df, str(tmp_path / "w"), append=True)
    assert S.read_csv(spark, str(tmp_path / "w"), "id long").count() == 20
    assert {r.table: r.n_rows for r in S.summary({"a": df, "b": df.limit(2)}).collect()} == {"a": 10, "b": 2}


def test_streams(spark, tmp_path):
    rows = [(1, "u1", dt.datetime(2024, 1, 1, 10, 5), "A", 1.0), (2, "u1", dt.datetime(2024, 1, 1, 10, 9), "A", 3.0), (3, "u2", dt.datetime(2024, 1, 1, 10, 59), "A", 2.0), (4, "u3", dt.datetime(2024, 1, 1, 15, 0), "A", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, url string, ts timestamp, event_type string, value double").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    for name, make in (("articles", live.new_articles), ("hours", live.hourly_bars)):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.url for r in spark.table("articles").collect()) == ["u1", "u2", "u3"]
    got = spark.table("hours").collect()
    assert [(r.Open, r.High, r.Low, r.Close, r.Volume) for r in got] == [(1.0, 3.0, 1.0, 2.0, 3)]


def test_missing_numbers_and_options(spark, tmp_path):
    put(tmp_path / "n.csv", "a,b\n1,NA\n2,NaN\n3,\n4,2.5\nx,1\n5,oops\n")
    got = sorted(tuple(r) for r in S.read_csv(spark, str(tmp_path / "n.csv"), "a int, b double", multi_line=False).collect())
    assert got == [(1, None), (2, None), (3, None), (4, 2.5)]
    (tmp_path / "l.csv").write_bytes("a,b\n1,caf\xe9\n".encode("latin-1"))
    assert S.read_csv(spark, str(tmp_path / "l.csv"), "a int, b string", encoding="ISO-8859-1").first().b == "caf\xe9"
    got = S.read_csv(spark, str(tmp_path), "a int, b string", glob="*.csv", exclude=["l.csv"], columns=["a"])
    assert got.count() == 5 and got.columns == ["a"]


def test_skipped_files(spark, tmp_path):
    put(tmp_path / "abc.csv", "close\n1.5\n")
    put(tmp_path / "bad.csv", "close\nx\n")
    put(tmp_path / "empty.csv", "")
    read = S.read_folder_by_name(spark, str(tmp_path), "close double")
    assert {r.ticker for r in S.skipped_files(spark, str(tmp_path), read).collect()} == {"BAD", "EMPTY"}


def test_news_folder_of_headed_files(spark, tmp_path):
    put(tmp_path / "d" / "1.csv", "date,title,news,url\n2024-01-01,T,N,u1\n")
    put(tmp_path / "d" / "2.csv", "Date,Title,News,URL\n2024-01-02,T,N,u2\n2024-01-03,,N,u3\n")
    put(tmp_path / "e.csv", "2024-01-04,T,the news,u4\n")
    got = S.news_files(spark, [str(tmp_path / "d"), str(tmp_path / "e.csv")]).collect()
    assert {(r.file, r.url, r.title) for r in got} == {(0, "u1", "T"), (0, "u2", "T"), (0, "u3", None), (1, "u4", "T")}
    assert S.news_files(spark, []).count() == 0


def test_summary_with_sizes(spark, tmp_path):
    df = spark.range(10).toDF("a")
    df.write.parquet(str(tmp_path / "t"))
    row = S.with_sizes(spark, S.summary({"t": df}), {"t": str(tmp_path / "t")}).first()
    assert (row.n_rows, row.n_columns) == (10, 1) and row.kb > 0
