"""Suffix-array dedup over a run-length index.

Words are the alphabet. Every window of ``least`` words belongs to its
minimiser (the lowest-hashed run of ``gram`` words in it), so equal windows
meet in one group wherever they come from. The windows of a document that
belong to one minimiser form a short segment; segments whose minimiser two
documents share are gathered, and each group of them is a small, very
repetitive corpus. Over it a run-compressed Burrows-Wheeler transform is built
with suffix-array samples at the ends of its runs. Matching statistics (the
longest match with any other suffix) are streamed through it from right to
left: inside a run both neighbours follow along and the match grows by one; at
a run's end the match restarts from the lengths sampled there. Matches of at
least ``least`` words are marked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, KEY, WORD, add_key, cut, drop, join_small, merge_spans, mix, parts, pieces, ranks_of, ready, rest, set_copies_apart, shielded, windows, word_hashes


def segments(h: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first, last window start) of each run of windows with one minimiser."""
    g = windows(h, gram)
    width = least - gram + 1
    if len(g) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(len(g) - width + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return g[at[first]], first, np.append(first[1:], len(at)) - 1


class RunIndex:
    """Run-length index of segments of integers >= 0; segment i ends in its own terminator."""

    def __init__(self, parts: list[np.ndarray]):
        n = len(parts)
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.offsets = np.cumsum(self.sizes + 1) - self.sizes - 1
        flat = np.concatenate(parts)
        _, inverse = np.unique(flat, return_inverse=True)
        self.text = np.empty(len(flat) + n, np.int64)
        ends = self.offsets + self.sizes
        inside = np.ones(len(self.text), bool)
        inside[ends] = False
        self.text[inside] = inverse + n
        self.text[ends] = np.arange(n)
        order, levels = self._suffixes()
        size = len(order)
        bwt = self.text[order - 1]
        head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        tail = np.append(head[1:], size) - 1
        self.head, self.tail, char = head, tail, bwt[head]
        sample_head, sample_tail = order[head], order[tail]  # the samples at the runs' ends
        by = np.lexsort((head, char))
        lengths = (tail - head + 1)[by]
        to = np.empty(len(head), np.int64)
        to[by] = np.cumsum(lengths) - lengths
        self.to = to  # where a run's first entry goes
        # in front of a run's first entry stands, one step on, the last entry of the run before it in (char, place) order
        up, down = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        match = self._common((sample_tail[by[:-1]] - 1) % size, (sample_head[by[1:]] - 1) % size, levels)
        up[by[1:]], down[by[:-1]] = match, match
        self.up, self.down = up, down

    def _suffixes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array by prefix doubling, and the ranks of all substrings of lengths 1, 2, 4, ..."""
        rank, levels, size, h = self.text.copy(), [], len(self.text), 1
        longest = int(self.sizes.max()) + 1
        while True:
            levels.append(rank.astype(np.int32))
            if h >= longest:
                return np.argsort(rank, kind="stable"), levels
            key = rank * (size + 1)
            key[:-h] += rank[h:] + 1
            order = np.argsort(key)
            k = key[order]
            new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank = np.empty(size, np.int64)
            rank[order] = new
            h *= 2

    def _common(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        a, b, got, size = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(self.text)
        for k in range(len(levels) - 1, -1, -1):
            ok = (a < size) & (b < size)
            same = np.zeros(len(a), bool)
            same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
            step = same.astype(np.int64) << k
            a += step
            b += step
            got += step
        return got

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text position: matching statistic, match with the suffix before, and place in suffix order.

        All segments advance in step from their terminators (whose places are
        their numbers), the longest first.
        """
        order = np.argsort(-self.sizes, kind="stable")
        sizes, q = self.sizes[order], order.astype(np.int64)
        at = (self.offsets + self.sizes)[order]
        up, down = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        ms, before, place = (np.zeros(len(self.text), np.int64) for _ in range(3))
        place[at] = q
        for step in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -step, side="left"))
            q, up, down, at = q[:m], up[:m], down[:m], at[:m] - 1
            run = np.searchsorted(self.head, q, side="right") - 1
            up = np.where(q == self.head[run], self.up[run], up + 1)
            down = np.where(q == self.tail[run], self.down[run], down + 1)
            q = self.to[run] + q - self.head[run]
            ms[at], before[at], place[at] = np.maximum(up, down), up, q
        return ms, before, place


def mark(words: list[np.ndarray], low: np.ndarray, high: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per segment, for each of its windows: lowest and highest rank of a document that has it.

    ``low`` and ``high``: the ranks of the documents that have the segment.
    A window without a match of ``least`` words elsewhere has its segment's own.
    """
    index = RunIndex(words)
    ms, before, place = index.stream()
    size = len(index.text)
    owner = np.repeat(np.arange(len(words)), index.sizes + 1)
    by_place = np.empty(size, np.int64)
    by_place[place] = owner
    lcp = np.empty(size, np.int64)
    lcp[place] = before
    start = np.flatnonzero(lcp < least)
    block = np.cumsum(lcp < least) - 1
    lo, hi = np.minimum.reduceat(low[by_place], start), np.maximum.reduceat(high[by_place], start)
    made = []
    for i, (at, n) in enumerate(zip(index.offsets.tolist(), index.sizes.tolist())):
        here = slice(at, at + n - least + 1)
        b = block[place[here]]
        long = ms[here] >= least
        made.append((np.where(long, lo[b], low[i]), np.where(long, hi[b], high[i])))
    return made


def shared_runs(docs: DataFrame, least: int = 50, gram: int = 8) -> DataFrame:
    """(KEY, doc_id, kind, start, end), see ``run_repeats``."""
    ready(docs.sparkSession)
    groups = parts(docs)
    once, copies = set_copies_apart(docs, least)

    def anchors(batches):
        for batch in pieces(batches):
            keys, found = batch.column(0).to_numpy(), []
            for text in batch.column(1).to_pylist():
                found.append(segments(word_hashes(text), least, gram)[0])
            n = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)), pa.array(np.repeat(keys, n))], ["a", KEY])

    # pre-aggregated by task: a minimiser that very many documents have is a few rows before it is shuffled
    found = cut(once.select(KEY, "text").mapInArrow(anchors, f"a long, {KEY} long"))
    both = found.groupBy("a").agg(F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).filter("lo <> hi").select("a")
    by_doc = cut(found.join(both, "a").groupBy(KEY).agg(F.collect_set("a").alias("anchors")).withColumn("m", F.size("anchors")))
    drop(found)
    total = by_doc.agg(F.sum("m")).first()[0] or 0
    rows = join_small(once, by_doc.drop("m"), "inner", BROADCAST_ROWS * (total <= BROADCAST_ROWS))
    schema = f"p int, a long, {KEY} long, doc_id long, start int, words binary"
    arrow = pa.schema([("p", pa.int32()), ("a", pa.int64()), (KEY, pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def gather(batches):
        for batch in pieces(batches):
            out: list = [[] for _ in arrow]
            for key, i, text, have in zip(*(batch.column(c) for c in (KEY, "doc_id", "text", "anchors"))):
                key, i = key.as_py(), i.as_py()
                h = word_hashes(text.as_py())
                a, first, last = segments(h, least, gram)
                use = np.flatnonzero(np.isin(a, have.values.to_numpy().view(np.uint64)))
                short = h.astype(np.uint32)
                for x, f, t in zip(a[use].tolist(), first[use].tolist(), last[use].tolist()):
                    row = (x % groups, x - (1 << 64) if x >> 63 else x, key, i, f, short[f : t + least].tobytes())
                    for col, v in zip(out, row):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, arrow)], schema=arrow)

    result = pa.schema([(KEY, pa.int64()), ("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def index(table: pa.Table) -> pa.Table:
        key, a, start = (table.column(c).to_numpy() for c in (KEY, "a", "start"))
        ids, blobs = table.column("doc_id").to_pylist(), table.column("words").to_pylist()
        rank = ranks_of(ids, key)
        number: dict = {}
        which = np.array([number.setdefault(x, len(number)) for x in zip(a.tolist(), blobs)], np.int64)
        low, high = np.full(len(number), np.iinfo(np.int64).max), np.zeros(len(number), np.int64)
        np.minimum.at(low, which, rank)
        np.maximum.at(high, which, rank)
        words = [mix(np.frombuffer(b, np.uint32).astype(np.uint64) ^ mix(np.full(1, x & (1 << 64) - 1, np.uint64))) for x, b in number]
        got = mark(words, low, high, least)
        counts = np.array([len(x) for x, _ in got], np.int64)
        lo, hi = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        base = np.cumsum(counts) - counts
        n = counts[which]  # windows of each row
        row = np.repeat(np.arange(len(key)), n)
        t = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = base[which][row] + t
        out = []
        for kind, mask in (("repeat", lo[at] != hi[at]), ("copy", lo[at] < rank[row])):
            r, x = row[mask], t[mask]
            if len(r):
                first = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(x) > least)])
                last = np.append(first[1:], True)
                rr = r[first]
                out.append(pd.DataFrame({KEY: key[rr], "doc_id": pd.array([ids[i] for i in rr], "Int64"), "kind": kind, "start": (start[rr] + x[first]).astype(np.int32), "end": (start[rr] + x[last] + least).astype(np.int32)}))
        made = pa.Table.from_pandas(pd.concat(out), schema=result, preserve_index=False) if out else result.empty_table()
        rest()
        return made

    spans = rows.mapInArrow(gather, schema).groupBy("p").applyInArrow(index, f"{KEY} long, doc_id long, kind string, start int, end int")
    return merge_spans(spans.unionByName(copies))


def run_repeats(docs: DataFrame, least: int = 50, gram: int = 8) -> DataFrame:
    """(doc_id, kind, start, end): maximal stretches covered by runs of ``least`` words that another document has too.

    start and end count words (letters and digits, case folded). kind
    'repeat': all such stretches; 'copy': what of them an earlier document
    (smaller doc_id, null last, then KEY) has, which is what ``cut_copies``
    removes. Null, empty and short texts have none; repeated rows are one
    document, so they are no repeats of each other; a null doc_id is a value;
    repeats within one document alone do not count; other columns are not
    read; an empty table gives an empty one; texts count whole, however long.
    """
    return shared_runs(docs, least, gram).select("doc_id", "kind", "start", "end")


@shielded
def cut_copies(spark: SparkSession, docs: DataFrame, least: int = 50, gram: int = 8) -> DataFrame:
    """``docs`` with the 'copy' stretches of ``run_repeats`` cut out of the texts, all columns and rows kept.

    What is cut runs from a stretch's first word to the start of the word
    after it. n_chars, where there is such a column, is the new length of the
    texts that changed. A document whose every word is cut stays, with what
    is left of its text.
    """
    spans = shared_runs(docs, least, gram).filter("kind = 'copy'").groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    rows = join_small(add_key(docs), cut(spans), "left", 400_000)

    @F.pandas_udf("string")
    def without(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, c):
            if c is None or t is None:
                return t
            places = [m.start() for m in WORD.finditer(t)] + [len(t)]
            kept, at = [], 0
            for x in c:
                kept.append(t[at : places[x["start"]]])
                at = places[x["end"]]
            return "".join([*kept, t[at:]])

        return pd.Series([one(t, c) for t, c in zip(text, cuts)], dtype=object)

    changed = rows.filter("__cuts is not null").withColumn("text", without(F.col("text").cast("string"), "__cuts"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.filter("__cuts is null").unionByName(changed).select(*docs.columns)
