"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are one class first. The classes' vectors are assigned to their
nearest ``overlap`` of the cluster centres, so the shards overlap. In each
shard a graph is built by robust pruning (a neighbour is dropped when a nearer
kept one is close enough to it), and the shards' adjacency lists are united.
Every vector is a query: range-expanding greedy search runs from the medoid of
each of its ``probes`` nearest shards over the united lists (while half of the
list of candidates may be results, it is widened). A result that also lives in
a shard where the query was not yet carries the query there, until no query
reaches a new shard, so the search goes on across shards. Results are verified
by their exact cosine. A brute-force audit of a seeded sample of queries gives
the recall; below the target the search is done again with twice the probes
and candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, components, cut, drop, ready


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v of length one; rows without id, with a null or empty or zero vector, or with null or non-finite entries are left out; of repeated ids the smallest vector stays."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    )
    good = good.filter("norm > 0 and norm < double('infinity')").groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x"))
    return good.select("vec_id", F.transform("x.v", lambda x: (x / F.col("x.norm")).cast("double")).alias("v"))


def prune(x: np.ndarray, degree: int, alpha: float, pool: int) -> list[np.ndarray]:
    """Robust-pruned adjacency of the rows of x (unit vectors), from each one's ``pool`` nearest."""
    n, made = len(x), []
    for at in range(0, n, 512):
        sim = x[at : at + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2.0
        k = min(pool, n - 1)
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(sim), 0), np.int64)
        for i in range(len(sim)):
            c = near[i]
            c = c[np.lexsort((c, -sim[i, c]))]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sim[i, c]))
            between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[c] @ x[c].T)))
            alive, kept = np.ones(len(c), bool), []
            for j in range(len(c)):
                if alive[j]:
                    kept.append(c[j])
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[j] > d
            made.append(np.array(kept, np.int64))
    return made


def connect(links: list[set], x: np.ndarray, medoid: int) -> None:
    """Makes every node reachable from the medoid: a part that is not is linked, both ways, to the nearest node that is."""
    seen = np.zeros(len(links), bool)
    todo = [medoid]
    seen[medoid] = True
    while True:
        while todo:
            for j in links[todo.pop()]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return
        i, have = int(rest[0]), np.flatnonzero(seen)
        j = int(have[np.argmax(x[have] @ x[i])])
        links[i].add(j)
        links[j].add(i)
        seen[i] = True
        todo.append(i)


def search(q: np.ndarray, x: np.ndarray, links: list[np.ndarray], start: int, cosine: float, beam: int) -> np.ndarray:
    """Rows within the radius: greedy search whose list grows while half of it are results, then from every result outwards."""
    s0 = float(x[start] @ q)
    seen, heap, best = {start}, [(-s0, start)], [(s0, start)]
    found = {start} if s0 >= cosine else set()
    while heap:
        s, i = heapq.heappop(heap)
        if len(best) >= beam and -s < best[0][0] and -s < cosine:
            break
        new = [j for j in links[i] if j not in seen]
        if not new:
            continue
        seen.update(new)
        for j, t in zip(new, (x[new] @ q).tolist()):
            if t >= cosine:
                found.add(j)
                if 2 * len(found) > beam:
                    beam *= 2
            if len(best) < beam or t > best[0][0] or t >= cosine:
                heapq.heappush(heap, (-t, j))
                heapq.heappush(best, (t, j))
                if len(best) > beam:
                    heapq.heappop(best)
    return np.array(sorted(found), np.int64)


#: Centres are held by every worker; more of them than this (in MB) are refused.
CENTRES_MB = 256


def centres(points: DataFrame, shards: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means over all vectors; it starts from the ``shards`` vectors whose hashed ids are lowest."""
    start = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(shards).collect()
    c = np.array([r.v for r in start])
    for _ in range(rounds if shards > 1 else 1):
        shared = points.sparkSession.sparkContext.broadcast(Centres(c))

        def sums(batches):
            at = shared.value
            total, n = np.zeros_like(at.c), np.zeros(len(at.c), np.int64)
            for batch in batches:
                x = np.array(batch.column("v").to_pylist()).reshape(-1, at.c.shape[1])
                best = at.nearest(x, 1)[:, 0]
                np.add.at(total, best, x)
                n += np.bincount(best, minlength=len(at.c))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["i", "s"])

        dims = c.shape[1]
        got = points.mapInArrow(sums, "i int, s array<double>").groupBy("i").agg(*(F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims))).collect()
        for r in got:
            v = np.array([r[f"s{d}"] for d in range(dims)])
            c[r.i] = v / max(np.linalg.norm(v), 1e-12)
        shared.unpersist()
    return c


class Centres:
    """Nearest centres of vectors: all are looked at up to ``flat`` of them, else those of the nearest cells of a coarse level."""

    def __init__(self, c: np.ndarray, flat: int = 4096, cells: int = 12):
        if c.nbytes > CENTRES_MB << 20:
            raise ValueError(f"{len(c)} centres are more than {CENTRES_MB} MB: give a larger shard")
        self.c, self.coarse, self.cells = c, None, cells
        if len(c) > flat:
            k = int(len(c) ** 0.5)
            self.coarse = c[np.linspace(0, len(c) - 1, k).astype(int)]
            for _ in range(4):
                own = np.concatenate([(c[a : a + 4096] @ self.coarse.T).argmax(axis=1) for a in range(0, len(c), 4096)])
                total = np.zeros_like(self.coarse)
                np.add.at(total, own, c)
                self.coarse = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
            self.inside = [np.flatnonzero(own == i) for i in range(k)]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """The numbers of each row's k nearest centres, nearest first."""
        k = min(k, len(self.c))
        out = []
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            if self.coarse is None:
                out.append(np.argsort(-(part @ self.c.T), axis=1, kind="stable")[:, :k])
                continue
            cells = np.argsort(-(part @ self.coarse.T), axis=1, kind="stable")[:, : self.cells]
            for row, near in zip(part, cells):
                at = np.concatenate([self.inside[i] for i in near])
                if len(at) < k:
                    at = np.arange(len(self.c))
                out.append(at[np.argsort(-(self.c[at] @ row), kind="stable")[:k]][None, :])
        return np.concatenate(out) if out else np.empty((0, k), np.int64)


def _array(batch, name: str, dims: int) -> np.ndarray:
    """The vectors in a column of a record batch or table as rows."""
    col = batch.column(name)
    parts = [x.flatten().to_numpy(zero_copy_only=False) for x in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])]
    return np.concatenate([np.empty(0), *parts]).reshape(-1, dims)


def _pairs(points: DataFrame, n: int, cosine, shard, overlap, probes, degree, alpha, pool, beam, target, audited) -> DataFrame:
    """(vec_a, vec_b), written out: pairs of different vectors of one length at ``cosine`` and above."""
    spark = points.sparkSession
    c = centres(points, max(1, -(-n * overlap // shard)) if n > shard else 1)
    dims = c.shape[1]
    shared = spark.sparkContext.broadcast(Centres(c))

    def assign(k):
        def work(batches):
            for batch in batches:
                to = shared.value.nearest(_array(batch, "v", dims), k)
                rows = pa.array(np.repeat(np.arange(len(to)), to.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), batch.column("vec_id").take(rows), batch.column("v").take(rows)], ["shard", "vec_id", "v"])

        return work

    placed = "shard int, vec_id long, v array<double>"
    members = cut(points.mapInArrow(assign(overlap), placed))

    def build(table):
        ids, x = table.column("vec_id").to_numpy(), _array(table, "v", dims)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        links = [set(y.tolist()) for y in prune(x, degree, alpha, pool)]
        connect(links, x, int((x @ x.mean(axis=0)).argmax()))
        return pa.table({"vec_id": np.repeat(ids, [len(y) for y in links]), "to": ids[np.array([j for y in links for j in sorted(y)], np.int64)]})

    edges = members.groupBy("shard").applyInArrow(build, "vec_id long, to long")
    both = edges.union(edges.select(F.col("to").alias("vec_id"), F.col("vec_id").alias("to")))
    graph = cut(members.join(both.groupBy("vec_id").agg(F.collect_set("to").alias("links")), "vec_id", "left"))

    def find(width):
        def work(key, nodes: pa.Table, asked: pa.Table) -> pa.Table:
            out: list = [np.empty((0, 2), np.int64)]
            if nodes.num_rows and asked.num_rows:
                ids, x = nodes.column("vec_id").to_numpy(), _array(nodes, "v", dims)
                order = np.argsort(ids)
                ids, x = ids[order], x[order]
                given = nodes.column("links").to_pylist()
                lists = []
                for i in order.tolist():
                    y = np.array(sorted(given[i] or ()), np.int64)
                    at = np.minimum(np.searchsorted(ids, y), len(ids) - 1)
                    lists.append(at[ids[at] == y].tolist())
                medoid = int((x @ x.mean(axis=0)).argmax())
                for q, v in zip(asked.column("vec_id").to_pylist(), _array(asked, "v", dims)):
                    got = ids[search(v, x, lists, medoid, cosine - 1e-9, width)]
                    got = got[got != q]
                    out.append(np.stack([np.full(len(got), q), got], axis=1))
            flat = np.concatenate(out)
            return pa.table({"q": flat[:, 0], "x": flat[:, 1]})

        return work

    a, b = points.toDF("vec_a", "va"), points.toDF("vec_b", "vb")
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    homes = cut(members.select(F.col("vec_id").alias("x"), "shard"))
    while True:
        new = cut(points.mapInArrow(assign(probes), placed))
        asked, found = new.select("shard", F.col("vec_id").alias("q")), None
        while True:
            hits = cut(graph.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(find(beam), "q long, x long").distinct())
            found = hits if found is None else cut(found.union(hits).distinct())
            # a result's other shards are where the search goes on
            go = hits.join(homes, "x").select("shard", "q").distinct().join(asked, ["shard", "q"], "left_anti")
            new = cut(go.join(points.withColumnRenamed("vec_id", "q"), "q").select("shard", F.col("q").alias("vec_id"), "v"))
            if new.isEmpty():
                break
            asked = asked.union(new.select("shard", F.col("vec_id").alias("q")))
        pairs = found.select(F.least("q", "x").alias("vec_a"), F.greatest("q", "x").alias("vec_b")).distinct()
        pairs = cut(pairs.join(a, "vec_a").join(b, "vec_b").filter(dot >= cosine).select("vec_a", "vec_b"))
        if probes >= len(c) or not audited or audit_points(points, pairs, cosine, audited) >= target:
            drop(members, graph, homes)
            return pairs
        probes, beam = 2 * probes, 2 * beam


def near_pairs(
    classes: DataFrame, cosine: float = 0.95, shard: int = 2_000, overlap: int = 2, probes: int = 4, degree: int = 32, alpha: float = 1.2, pool: int = 64,
    beam: int = 32, target: float = 0.95, audited: int = 256,
) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of the different vectors in (vec_id, dims, v) whose cosine is at least ``cosine``."""
    made = None
    for row in classes.groupBy("dims").count().orderBy("dims").collect():
        part = _pairs(
            classes.filter(F.col("dims") == row.dims).select("vec_id", "v"), row["count"], cosine, shard, overlap, probes, degree, alpha, pool, beam, target, audited
        )
        made = part if made is None else made.union(part)
    return made if made is not None else classes.sparkSession.createDataFrame([], "vec_a long, vec_b long")


def near_vectors(vectors: DataFrame, **params) -> DataFrame:
    """(vec_id, group_id, links), one row for each usable vector.

    links: how many other vectors are within ``cosine`` (0.95), equal ones
    among them; group_id: the smallest vec_id that is reached over such links
    (its own without any). Rows without id or with an unusable vector (null,
    empty, zero, null or non-finite entries) have no row; of repeated ids the
    smallest vector counts; vectors of different lengths are never near; other
    columns are not read; an empty table gives an empty one. The number of
    shards follows the table's size; parameters: see ``near_pairs``. Equal
    vectors are counted and not searched for, so a vector that a third of the
    rows have costs no more than another.
    """
    ready(vectors.sparkSession)
    v = F.col("v")
    points = cut(clean(vectors).withColumns({"dims": F.size(v), "s1": F.xxhash64(v), "s2": F.xxhash64(F.lit(1), v)}))
    classes = cut(points.groupBy("dims", "s1", "s2").agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    pairs = cut(near_pairs(classes.select(F.col("rep").alias("vec_id"), "dims", "v"), **params))
    both = pairs.union(pairs.select("vec_b", "vec_a")).toDF("rep", "other")
    more = both.join(classes.select(F.col("rep").alias("other"), "m"), "other").groupBy("rep").agg(F.sum("m").alias("more"))
    comp = cut(components(pairs.toDF("a", "b")).withColumnRenamed(KEY, "rep"))
    made = classes.select("dims", "s1", "s2", "rep", "m").join(more, "rep", "left").join(comp, "rep", "left")
    made = made.select("dims", "s1", "s2", F.coalesce("comp", "rep").alias("group_id"), (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return points.select("vec_id", "dims", "s1", "s2").join(made, ["dims", "s1", "s2"]).select("vec_id", "group_id", "links")


def audit_points(points: DataFrame, pairs: DataFrame, cosine: float, queries: int) -> float:
    """Share of the true neighbours of ``queries`` seeded queries that ``pairs`` holds (1.0 when there are none), by brute force over all of (vec_id, v)."""
    asked = points.orderBy(F.xxhash64(F.lit(99), "vec_id"), "vec_id").limit(queries).collect()
    if not asked:
        return 1.0
    shared = points.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in asked]), np.array([r.v for r in asked])))

    def work(batches):
        ids, q = shared.value
        for batch in batches:
            x, own = _array(batch, "v", q.shape[1]), batch.column("vec_id").to_numpy()
            for at in range(0, len(x), 1024):
                i, j = np.nonzero(x[at : at + 1024] @ q.T >= cosine)
                lo, hi = np.minimum(own[at + i], ids[j]), np.maximum(own[at + i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(lo[lo < hi]), pa.array(hi[lo < hi])], ["vec_a", "vec_b"])

    true = points.mapInArrow(work, "vec_a long, vec_b long").distinct()
    row = true.join(pairs.withColumn("hit", F.lit(1)), ["vec_a", "vec_b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("k")).first()
    return row.k / row.n if row.n else 1.0


PAIRS_SQL = """
WITH RECURSIVE p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
q AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM p),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r(v, g) AS (SELECT vec_id, vec_id FROM q UNION SELECT e.b, r.g FROM r JOIN e ON r.v = e.a),
k AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
SELECT r.v AS vec_id, min(r.g) AS group_id, CAST(coalesce(min(k.links), 0) AS BIGINT) AS links FROM r LEFT JOIN k ON k.a = r.v GROUP BY 1
"""
