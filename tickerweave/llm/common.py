"""Helpers that the training-data operators share.

Row identity: a document is its pair (doc_id, text). Rows that agree in both
are one document (a repeated row); a null text counts as the empty text; a
null doc_id is a value like any other. ``KEY`` is a 64-bit hash of the pair.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "__key"
WORD = re.compile(r"[^\W_]+")
ROOT = str(Path(__file__).resolve().parents[2])
#: A side of a join is broadcast only up to this many rows, counted first.
BROADCAST_ROWS = 1_500_000
#: Up to so many edges, counted first, one task joins into components.
EDGES = 1_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed and give freed memory back; texts go to them in batches of 2,000 unless the session says otherwise."""
    env = spark.sparkContext.environment
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2")):
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tickerweave.shared", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tickerweave-")
        spark.conf.set("spark.tickerweave.shared", found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


@atexit.register
def _remove_written() -> None:
    """Results read these tables lazily, so they go when the driver's process ends."""
    for path in _WRITTEN:
        if path.startswith(("/", "file:")):
            shutil.rmtree(re.sub(r"^file:/+", "/", path), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._tw_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_tw_path", None)
        if path and (path.startswith("/") or path.startswith("file:")):
            shutil.rmtree(re.sub(r"^file:/+", "/", path), ignore_errors=True)
        elif path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files that nothing reads any more go at once and not when its heap happens to be full; gives its free memory back."""
    gc.collect()
    trim()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:  # by reflection, as the server's own class is not open to calls
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without this command
        pass


def shielded(work):
    """For functions that give the rows of ``docs`` back: its columns whose names begin like our own ('__') are renamed meanwhile."""

    @functools.wraps(work)
    def run(*args, **kwargs):
        at = next(i for i, x in enumerate(args) if isinstance(x, DataFrame))
        names = args[at].columns
        inside = {c: f"kept{i}{c}" for i, c in enumerate(names) if c.startswith("__")}
        got = work(*args[:at], args[at].withColumnsRenamed(inside), *args[at + 1 :], **kwargs)
        return got.toDF(*names)

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(KEY, doc_id, text) of every row; whatever other columns there are is left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        F.xxhash64("doc_id", "text").alias(KEY), "doc_id", "text"
    )


def add_key(docs: DataFrame) -> DataFrame:
    """``docs`` with KEY, all its columns kept."""
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def join_small(left: DataFrame, right: DataFrame, how: str, limit: int = BROADCAST_ROWS, on: str = KEY) -> DataFrame:
    """Join on KEY (or ``on``); ``right`` (a written table) is broadcast when it has at most ``limit`` rows, else both sides are shuffled."""
    return left.join(F.broadcast(right) if right.count() <= limit else right, on, how)


_USED: dict | None = None


def alone(cache: dict) -> dict:
    """``cache``; what the worker had remembered for another operator is given up, as workers live on from stage to stage."""
    global _USED
    if _USED is not cache:
        if _USED is not None:
            _USED.clear()
        _USED = cache
    return cache


def rest() -> None:
    """At a task's end: gives remembered words and free memory back, as idle workers live on beside the next stage's."""
    if _USED is not None:
        _USED.clear()
    trim()


def trim() -> None:
    """Gives free memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def pieces(batches, rows: int = 1024):
    """The record batches in slices, so that only so many texts are Python strings at a time; at the end the worker rests."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    rest()


def gathered(batches, rows: int = 8_000, size: int = 24_000_000):
    """The record batches put together to about ``rows`` rows or ``size`` bytes, where what is done with a batch has a cost of its own."""
    have: list = []
    for batch in batches:
        have.append(batch)
        if sum(b.num_rows for b in have) >= rows or sum(b.nbytes for b in have) >= size:
            yield pa.Table.from_batches(have).combine_chunks()
            have = []
    if have:
        yield pa.Table.from_batches(have).combine_chunks()
    rest()


class WordHash(dict):
    """word -> 64-bit hash of its lower case, remembered for up to ``most`` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return made


_HASH = WordHash()


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word (letters and digits, case folded) of the text."""
    words = WORD.findall(text)
    return np.fromiter(map(alone(_HASH).__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive entries of h: a polynomial in an odd base, modulo 2**64, mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, size, parts, at = 0x9E3779B97F4A7C15, 1, h, 0
    out = np.zeros(n, np.uint64)
    while True:  # powers of two, put together by the bits of width
        if width & size:
            out = out * np.uint64(pow(base, size, 1 << 64)) + parts[at : at + n]
            at += size
        size *= 2
        if size > width:
            return mix(out)
        half = size // 2
        parts = parts[:-half] * np.uint64(pow(base, half, 1 << 64)) + parts[half:]


def joined(batches) -> Iterator[pa.RecordBatch]:
    """(KEY, comp) of all the edges (a, b) in the batches."""
    have = list(batches)
    if sum(b.num_rows for b in have):
        a, b = (np.concatenate([x.column(i).to_numpy() for x in have]) for i in (0, 1))
        del have
        keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(keys))  # keys are sorted: the smallest number is the smallest key's
        while True:
            lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = lo < hi
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, hi[apart], lo[apart])
            while True:
                above = root[root]
                if np.array_equal(above, root):
                    break
                root = above
        for i in range(0, len(keys), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 65_536]), pa.array(keys[root[i : i + 65_536]])], [KEY, "comp"])
    rest()


def components(edges: DataFrame) -> DataFrame:
    """(KEY, comp): the smallest key of each connected component of the edges (a, b).

    Up to EDGES different edges are joined by one task, as each round's jobs
    cost the driver more than that. More of them go through alternating
    large-star and small-star rounds; each is written to the shared folder, so
    their number (logarithmic) does not lengthen the lineage.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b <= a")
        # aggregated and joined back, not a window: a node that very many edges have is split by the join
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = both.join(least, "a")
        if large:
            got = least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            got = least.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return got.filter("a <> b").distinct()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    sign = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    before = now.agg(sign.alias("x")).first()[0]
    if before.n <= EDGES:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(joined, f"{KEY} {kind}, comp {kind}")
    while True:
        new = cut(star(star(now, True), False))
        after = new.agg(sign.alias("x")).first()[0]
        drop(now)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias(KEY), F.col("b").alias("comp")).union(now.select(F.col("b").alias(KEY), F.col("b").alias("comp")).distinct())


def sifted(pairs: DataFrame, sigs: DataFrame, close) -> DataFrame:
    """The pairs (a, b) whose signatures ``close`` lets pass."""

    @F.pandas_udf("boolean")
    def passes(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(close(_matrix(x), _matrix(y)), dtype=bool)

    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    return both.filter(passes("sa", "sb")).select("a", "b")


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)


def across(mixed: DataFrame, sigs: DataFrame, close, chunk: int = 1024) -> DataFrame:
    """(a, b): of each bucket in (bucket, KEY, comp) the pairs of different components whose signatures ``close`` lets pass.

    Pairs are compared as rows of arrays and only those that pass are ever
    written. A bucket of more than ``chunk`` members is split into chunks, each
    pair of which is a group of its own, so no task holds a whole hot bucket.
    """
    sizes = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sizes = sizes.filter("lo <> hi").select("bucket", "chunks")
    rows = mixed.join(sizes, "bucket").withColumn("c", F.expr(f"cast(pmod(xxhash64({KEY}), chunks) as int)"))
    rows = rows.select("bucket", KEY, "comp", "c", F.explode(F.expr("sequence(0, chunks - 1)")).alias("o"))
    rows = rows.select("bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", KEY, "comp").join(sigs.toDF(KEY, "sig"), KEY)

    def compare(batches):
        have: list = []
        for batch in batches:
            have.append(batch)
            if sum(x.num_rows for x in have) >= 16_384:
                table = pa.Table.from_batches(have)
                end = _last_group(table)
                if end:
                    yield from _cross(table.slice(0, end), close)
                have = table.slice(end).to_batches()
        if have:
            yield from _cross(pa.Table.from_batches(have), close)

    sorted_ = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return sorted_.mapInArrow(compare, "a long, b long")


def _group_starts(table: pa.Table) -> np.ndarray:
    cols = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
    change = np.zeros(max(len(cols[0]) - 1, 0), bool)
    for c in cols:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _last_group(table: pa.Table) -> int:
    return int(_group_starts(table)[-1])


def _cross(table: pa.Table, close) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if not n:
        return
    starts = _group_starts(table)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    key, comp, c = (table.column(x).to_numpy() for x in (KEY, "comp", "c"))
    inner = table.column("i").to_numpy() == table.column("j").to_numpy()
    sig = _matrix(table.column("sig").to_pylist())
    row = np.arange(n)
    for d in range(1, int((end - row).max())):  # all pairs (x, x + d) of all groups at once
        row = row[row + d < end[row]]
        x = row[(comp[row] != comp[row + d]) & (inner[row] | (c[row] != c[row + d]))]
        for at in range(0, len(x), 65_536):
            p = x[at : at + 65_536]
            p = p[close(sig[p], sig[p + d])]
            if len(p):
                a, b = np.minimum(key[p], key[p + d]), np.maximum(key[p], key[p + d])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: Columns of what ``scattered`` makes, and the upper bits of a bucket's hash that it keeps (two buckets that agree in them count as one).
SCATTERED, BUCKET_BITS = "part int, buckets binary, keys binary", 48


def scattered(keys: np.ndarray, buckets: np.ndarray, parts: int) -> pa.RecordBatch:
    """The members (keys[i], buckets[i]) by range of buckets, a row for each range: 14 bytes a member instead of a row for each."""
    cut_ = buckets >> np.uint64(64 - BUCKET_BITS)
    order = np.argsort(cut_)
    cut_, keys = cut_[order], keys[order]
    part = (cut_ >> np.uint64(BUCKET_BITS - 24)).astype(np.int64) * parts >> 24
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(part))
    planes = cut_.view(np.uint8).reshape(-1, 8)[:, BUCKET_BITS // 8 - 1 :: -1]  # highest bytes first: these compress, as they are sorted
    blobs = [planes[a:b].T.tobytes() for a, b in zip(at, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["part", "buckets", "keys"])


def met(batches) -> Iterator[pa.RecordBatch]:
    """(bucket, KEY, first) of all rows of ``scattered`` in some ranges: the buckets with several members, those with the same members once.

    A bucket is named by its members, so that equal ones of other ranges have its name.
    """
    cut_, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        for b, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            wide = np.zeros((len(k) // 8, 8), np.uint8)
            wide[:, BUCKET_BITS // 8 - 1 :: -1] = np.frombuffer(b, np.uint8).reshape(BUCKET_BITS // 8, -1).T
            cut_.append(wide.view("<u8")[:, 0])
            keys.append(np.frombuffer(k, np.int64))
    bucket, key = np.concatenate(cut_), np.concatenate(keys)
    del cut_, keys
    order = np.argsort(bucket)
    bucket, key = bucket[order], key[order]
    same = bucket[1:] == bucket[:-1]
    some = np.append(False, same) | np.append(same, False) if len(bucket) else np.zeros(0, bool)
    bucket, key = bucket[some], key[some]
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    bucket, key = bucket[new], key[new]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(at, len(key)))
    if len(at):
        name = mix(np.add.reduceat(mix(key.view(np.uint64)), at) + n.astype(np.uint64))
        _, one = np.unique(name, return_index=True)
        keep = np.zeros(len(at), bool)
        keep[one] = True
        keep = np.repeat(keep & (n > 1), n)
        rows = [np.repeat(name, n).view(np.int64)[keep], key[keep], np.repeat(key[at], n)[keep]]
        for a in range(0, len(rows[0]), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 65_536]) for x in rows], ["bucket", KEY, "first"])
    rest()


def ranges(spark: SparkSession) -> int:
    """Into how many ranges of buckets ``scattered`` parts its members."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def agreed(buckets: DataFrame, verify, sigs: DataFrame, close, spent=()) -> DataFrame:
    """(KEY, comp) from buckets, as ``scattered`` makes them: components of all verified pairs that share a bucket.

    ``sigs`` (KEY, sig) has a signature of one
    length for every key, and ``close`` says of two arrays of them which pairs
    may be near at all; ``verify`` takes and returns pairs (a, b). Tables
    ``spent`` are dropped once the buckets are read.

    First every member is held against its buckets' smallest keys, then, of
    buckets with members in different components, every member outside the
    smallest component against the smallest key out there. What is still in
    different components is compared by signature, all with all, and verified
    where it passes. Pairs within a component can change nothing, so the
    components are those of all such pairs, while a bucket of n true copies
    costs n checks.
    """
    spark = sigs.sparkSession
    shared = cut(buckets.repartition("part").mapInArrow(met, f"bucket long, {KEY} long, first long").distinct())
    drop(*spent)
    sweep(spark)
    stars = cut(shared.filter(F.col(KEY) != F.col("first")).select(F.col("first").alias("a"), F.col(KEY).alias("b")).distinct())
    # each member's smallest candidate first; another only where that leaves the two apart
    likely = cut(sifted(stars, sigs, close))
    nearest = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    good = cut(verify(nearest))
    comp = cut(components(good))
    of = comp.select(KEY, "comp")
    apart = likely.join(nearest, ["a", "b"], "left_anti").join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    good = cut(good.union(verify(apart.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))))
    drop(comp)
    sweep(spark)

    def left_apart(good, among):
        comp = cut(components(good))
        inside = join_small(among.select("bucket", KEY, "first"), comp, "left").select("bucket", KEY, "first", F.coalesce("comp", KEY).alias("comp"))
        ends = inside.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket", "lo")
        return comp, cut(inside.join(ends, "bucket"))

    comp, mixed = left_apart(good, shared)
    drop(shared)
    out = mixed.filter("comp <> lo")
    second = out.groupBy("bucket").agg(F.min(F.struct(KEY, "comp")).alias("s"))
    more = out.join(second, "bucket").filter("comp <> s.comp").select(F.least(F.col(KEY), F.col("s")[KEY]).alias("a"), F.greatest(F.col(KEY), F.col("s")[KEY]).alias("b"))
    more = cut(more.distinct().join(stars, ["a", "b"], "left_anti"))
    found = cut(verify(sifted(more, sigs, close)))
    if not found.isEmpty():
        good, before = cut(good.union(found)), mixed
        drop(comp)
        comp, mixed = left_apart(good, before)  # a bucket within one component stays so
        drop(before)
    sweep(spark)
    tried = stars.union(more)
    # all pairs of a bucket's first are among the stars
    others = mixed.filter(F.col(KEY) != F.col("first")).select("bucket", KEY, "comp")
    rest = cut(across(others, sigs, close).distinct().join(tried, ["a", "b"], "left_anti"))
    found = cut(verify(rest))
    done = comp
    if not found.isEmpty():
        done = cut(components(good.union(found)))
    drop(mixed)
    sweep(spark)
    return done


def merge_spans(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or touching [start, end) by (KEY, doc_id, kind)."""
    who = [KEY, "doc_id", "kind"]
    w = Window.partitionBy(*who).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("new", new).withColumn("island", island).groupBy(*who, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def parts(docs: DataFrame, chars: int = 12_000_000) -> int:
    """Number of hash groups whose rows are worked on as arrays: one for each ``chars`` characters of text, two for each shuffle partition at least."""
    total = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chars))


def set_copies_apart(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((KEY, doc_id, text) with one document of each different text of at least ``least`` words, (KEY, doc_id, kind, start, end) of the texts that several documents have).

    The one is the first by doc_id (null last), then KEY. Of the others all is
    'repeat' and 'copy', of the first all is 'repeat'. So however many copies
    a text has, its words are gone through once.
    """
    rows = keyed(docs).filter(F.length("text") >= 2 * least - 1)  # least words and what parts them
    named = rows.select(KEY, "doc_id", F.md5("text").alias("same"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))
    many = named.groupBy("same").agg(F.min_by(KEY, order).alias("lead"), F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).filter("lo <> hi").select("same", "lead")
    copies = cut(named.join(many, "same").select(KEY, (F.col(KEY) != F.col("lead")).alias("later")).distinct())
    later = cut(copies.filter("later").select(KEY))

    def whole(batches):
        for batch in pieces(batches):
            n = [len(WORD.findall(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("doc_id"), batch.column("later"), pa.array(n, pa.int32())], [KEY, "doc_id", "later", "end"])

    # few texts are copies: broadcast while their keys are few, and one row for each document
    some = join_small(rows, copies, "inner").select(KEY, "doc_id", "later", "text").mapInArrow(whole, f"{KEY} long, doc_id long, later boolean, end int")
    some = some.filter(F.col("end") >= least).distinct()
    kinds = F.explode(F.when(F.col("later"), F.array(F.lit("repeat"), F.lit("copy"))).otherwise(F.array(F.lit("repeat"))))
    spans = some.select(KEY, "doc_id", kinds.alias("kind"), F.lit(0).alias("start"), "end")
    return join_small(rows, later, "left_anti"), spans


def ranks_of(ids: list, keys: np.ndarray) -> np.ndarray:
    """Order of documents, as a number for each row: by doc_id (null last), then by key."""
    null = np.array([i is None for i in ids])
    value = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((keys, value, null))
    change = np.ones(len(order), bool)
    k = keys[order]
    change[1:] = k[1:] != k[:-1]
    made = np.empty(len(order), np.int64)
    made[order] = np.cumsum(change)
    return made


#: Repeats of at least ``least`` words in two or more documents, in SQL (for ``repeats``' and ``blocks``' results).
REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, min(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS w
  FROM documents GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k FROM d),
s AS (SELECT k, doc_id, w, unnest(range(0, len(w) - {least} + 1)) AS a FROM n WHERE len(w) >= {least}),
g AS (SELECT k, doc_id, a, array_to_string(list_slice(w, a + 1, a + {least}), ' ') AS t FROM s),
f AS (SELECT k, doc_id, a, min(k) OVER (PARTITION BY t) AS lo, max(k) OVER (PARTITION BY t) AS hi FROM g),
x AS (SELECT k, doc_id, a, 'repeat' AS kind FROM f WHERE lo <> hi UNION ALL SELECT k, doc_id, a, 'copy' FROM f WHERE lo < k),
y AS (SELECT *, CASE WHEN a > lag(a) OVER (PARTITION BY k, kind ORDER BY a) + {least} THEN 1 ELSE 0 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY k, kind ORDER BY a) AS island FROM y)
SELECT doc_id, kind, CAST(min(a) AS INTEGER) AS "start", CAST(max(a) + {least} AS INTEGER) AS "end"
FROM z GROUP BY k, doc_id, kind, island
"""
