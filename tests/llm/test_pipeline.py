"""The pipeline against what each stage should do to planted documents, and the registered queries on the smallest tables."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline
from tickerweave.llm import mixing, registry, unigram

SF = Path("/root/testdata/sf0.001")


def words(rng, n):
    return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))


def tables(spark, path, rows, labels=()):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(41)
    passage, base = words(rng, 60), words(rng, 200)
    near = base.split()
    near[50] = "changed"
    texts = {i: words(rng, 120) for i in range(20)}
    texts[20] = texts[3] + " you are an idiot ."
    texts[21], texts[22], texts[23] = base, base, " ".join(near)
    texts[24], texts[25] = f"{words(rng, 50)} {passage} {words(rng, 90)}", f"{words(rng, 150)} {passage} {words(rng, 20)}"
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts.items()] + [(26, None, None, None, None), (None, "", "en", "a", 0), (27, texts[0], "en", "a", 1), (0, texts[0], "en", "a", 1)]
    sf = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:4])
    ids = [sorted([r.doc_id for r in d.collect()], key=str) for d in seen]
    assert 20 not in ids[0] and len(ids[0]) == len(rows) - 1
    assert len({21, 22, 23} & set(ids[1])) == 1 and len({0, 27} & set(ids[1])) == 1
    assert set(range(1, 20)) | {24, 25, 26, None} <= set(ids[1]) and len(ids[1]) == len(set(ids[1]))
    by = {r.doc_id: r for r in seen[2].collect()}
    assert ids[2] == ids[1] and passage in by[24].text and passage.split()[5] not in by[25].text.split()
    assert by[25].n_chars == len(by[25].text) and by[24].text == texts[24]
    model = unigram.Unigram(unigram.vocabulary())
    count = lambda t: sum(map(unigram.Counts(model).__getitem__, model.units(t)))
    tokens = {s: sum(count(r.text) for r in seen[3].collect() if r.text and r.source == s) for s in "ab"}
    have = {s: sum(count(r.text) for r in seen[2].collect() if r.text and r.source == s) for s in "ab"}
    budget = mixing.budgets(have, {s: have[s] ** 0.5 for s in "ab"})
    for x in "ab":  # the largest sum of these documents' tokens within the budget
        reach = 1
        for r in seen[2].collect():
            if r.text and r.source == x:
                reach |= reach << count(r.text)
        assert tokens[x] == (reach & ((2 << budget[x]) - 1)).bit_length() - 1
    assert ids[4] == ids[3] and all(r.round_trip for r in seen[4].collect())
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.select("doc_id", "n_tokens").collect()), key=str) == sorted(map(tuple, seen[4].select("doc_id", "n_tokens").collect()), key=str)


def test_near_duplicates_of_unlike_sizes_go(spark):
    rng = random.Random(61)
    rows = []
    for k in range(20):
        w = words(rng, 100).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, f"{words(rng, 200)} {' '.join(w[:70])} {words(rng, 50)}")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert set(range(1, 40, 2)) <= kept and len(kept) <= 22


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_queries_and_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    n = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for name, query in registry.queries().items():
        df = query(spark, str(SF))
        rows = df.collect()
        if name in registry.oracle_sql():
            found = con.execute(registry.oracle_sql()[name])
            names = [d[0] for d in found.description]
            assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall()), name
        elif name.split("_")[0] in ("op1", "op5", "op8", "op10"):
            assert len(rows) == n, name
