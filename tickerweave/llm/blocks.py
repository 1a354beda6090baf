"""Substring dedup by fixed-block anchors.

The index holds every document's non-overlapping blocks of ``block`` words.
Every rolling window of that many words probes it. A repeat of at least
``2 * block - 1`` words holds a whole block, so each one has a hit; hits are
then extended to maximal exact repeats of at least ``least`` words.

Windows travel packed, as arrays for each hash range, and not as rows: 4 bytes
of hash (the range gives more bits) and 2 of position. False hits of so short
a hash end at the extension, which compares windows of ``least`` words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, cut, merge_spans, mix, parts, pieces, ranks_of, ready, set_copies_apart, windows, word_hashes

_PACKED = "p int, docs binary, counts binary, steps binary, hashes binary"


def pack(keys: np.ndarray, texts: list[str], block: int, groups: int) -> list[tuple]:
    """(group, docs, counts, position steps, hashes) of all windows of a batch."""
    found = [windows(word_hashes(t), block) for t in texts]
    sizes = np.array([len(h) for h in found], np.int64)
    if not sizes.sum():
        return []
    h = np.concatenate(found)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    pos = np.arange(len(h), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group = ((h >> np.uint64(32)) % np.uint64(groups)).astype(np.uint16 if groups < 65536 else np.uint32)
    order = np.argsort(group, kind="stable")
    group, owner, pos, low = group[order], owner[order], pos[order], h[order].astype(np.uint32)
    edges = np.flatnonzero(np.diff(group)) + 1
    made = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(group)]):
        o, p = owner[a:b], pos[a:b]
        first = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1])
        step = np.diff(p, prepend=0)
        step[first] = p[first]
        wide = np.uint16 if step.max() < 65536 else np.uint32
        counts = np.diff(np.append(first, b - a)).astype(np.uint32)
        made.append((int(group[a]), keys[o[first]].tobytes(), counts.tobytes(), step.astype(wide).tobytes(), low[a:b].tobytes()))
    return made


def unpack(docs: bytes, counts: bytes, steps: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, hash) of every window."""
    h = np.frombuffer(hashes, np.uint32)
    n = np.frombuffer(counts, np.uint32).astype(np.int64)
    step = np.frombuffer(steps, np.uint16 if len(steps) == 2 * len(h) else np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    pos = total - np.repeat(total[first] - step[first], n)
    return np.repeat(np.frombuffer(docs, np.int64), n), pos.astype(np.int32), h


def hits(once: DataFrame, block: int, groups: int) -> DataFrame:
    """(KEY, pos, g): windows of (KEY, text) that equal a block, where two documents share it; g names the block's text."""

    def probe(batches):
        for batch in batches:
            made = pack(batch.column(0).to_numpy(), batch.column(1).to_pylist(), block, groups)
            for at in range(0, len(made), 64):
                yield pa.RecordBatch.from_pydict(dict(zip(("p", "docs", "counts", "steps", "hashes"), ([*c] for c in zip(*made[at : at + 64])))), pa.schema([("p", pa.int32()), *((x, pa.binary()) for x in ("docs", "counts", "steps", "hashes"))]))

    def match(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        rows = [unpack(*x) for x in zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "steps", "hashes")))]
        key, pos, h = (np.concatenate(x) for x in zip(*rows))
        del rows
        order = np.argsort(h)
        key, pos, h = key[order], pos[order], h[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
        good = (np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)) & np.logical_or.reduceat(pos % block == 0, start)
        keep = np.repeat(good, np.diff(np.append(start, len(h))))
        g = h[keep].astype(np.int64) | np.int64(p) << 32
        return pa.table({KEY: key[keep], "pos": pos[keep], "g": g})

    return once.select(KEY, "text").mapInArrow(probe, _PACKED).groupBy("p").applyInArrow(match, f"{KEY} long, pos int, g long")


def shared_blocks(docs: DataFrame, block: int = 25, least: int = 50) -> DataFrame:
    """(KEY, doc_id, kind, start, end), see ``block_repeats``."""
    if least < 2 * block - 1:
        raise ValueError("a repeat must be long enough to hold a whole block: least >= 2 * block - 1")
    ready(docs.sparkSession)
    reach, groups = least - block + 1, parts(docs)
    once, copies = set_copies_apart(docs, least)
    found = hits(once, block, groups).distinct()
    by_doc = cut(found.groupBy(KEY).agg(F.collect_list(F.struct("pos", "g")).alias("hits")))
    rows = once.join(by_doc, KEY)
    schema = f"p int, g long, {KEY} long, doc_id long, pos int, near binary"

    def around(batches):
        for batch in pieces(batches):
            seen, out = set(), []
            for key, i, text, hs in zip(*(batch.column(c) for c in (KEY, "doc_id", "text", "hits"))):
                key = key.as_py()
                if key in seen:
                    continue
                h = windows(word_hashes(text.as_py()), least)
                if not len(h):
                    continue
                st = hs.values
                pos, g = st.field("pos").to_numpy(), st.field("g").to_numpy()
                at = pos[:, None].astype(np.int64) - (reach - 1) + np.arange(reach)[None, :]
                w = np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)] >> np.uint64(24), 0).astype("<u8")
                near = np.ascontiguousarray(w.view(np.uint8).reshape(len(pos), reach, 8)[:, :, :5])
                out.append((np.full(len(pos), key), [i.as_py()] * len(pos), pos, g, [x.tobytes() for x in near]))
            if out:
                g = np.concatenate([x[3] for x in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((mix(g.view(np.uint64)) % np.uint64(groups)).astype(np.int32)), pa.array(g), pa.array(np.concatenate([x[0] for x in out])),
                        pa.array([i for x in out for i in x[1]], pa.int64()), pa.array(np.concatenate([x[2] for x in out]).astype(np.int32)), pa.array([b for x in out for b in x[4]], pa.binary()),
                    ],
                    ["p", "g", KEY, "doc_id", "pos", "near"],
                )

    def extend(table: pa.Table) -> pa.Table:
        key, g, pos = (table.column(c).to_numpy() for c in (KEY, "g", "pos"))
        ids = table.column("doc_id").to_pylist()
        near = np.frombuffer(b"".join(table.column("near").to_pylist()), np.uint8).reshape(len(key), reach, 5)
        w = np.zeros((len(key), reach, 8), np.uint8)
        w[:, :, :5] = near
        w = w.view("<u8")[:, :, 0]
        rank = ranks_of(ids, key)
        row, t = np.nonzero(w)
        name = mix(w[row, t] ^ mix(g[row].view(np.uint64) * np.uint64(64) + t.astype(np.uint64)))
        order = np.argsort(name)
        name, row, t = name[order], row[order], t[order]
        r = rank[row]
        start = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1]) if len(name) else np.empty(0, np.int64)
        out = []
        if len(name):
            sizes = np.diff(np.append(start, len(name)))
            lo, hi = np.repeat(np.minimum.reduceat(r, start), sizes), np.repeat(np.maximum.reduceat(r, start), sizes)
            for kind, mask in (("repeat", lo != hi), ("copy", lo < r)):
                first, last = np.full(len(key), reach), np.full(len(key), -1)
                np.minimum.at(first, row[mask], t[mask])
                np.maximum.at(last, row[mask], t[mask])
                have = np.flatnonzero(last >= 0)
                base = pos[have] - (reach - 1)
                out.append(pd.DataFrame({KEY: key[have], "doc_id": pd.array([ids[i] for i in have], "Int64"), "kind": kind, "start": (base + first[have]).astype(np.int32), "end": (base + last[have] + least).astype(np.int32)}))
        schema_ = pa.schema([(KEY, pa.int64()), ("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.Table.from_pandas(pd.concat(out), schema=schema_, preserve_index=False) if out else schema_.empty_table()

    spans = rows.mapInArrow(around, schema).groupBy("p").applyInArrow(extend, f"{KEY} long, doc_id long, kind string, start int, end int")
    return merge_spans(spans.distinct().unionByName(copies))


def block_repeats(docs: DataFrame, block: int = 25, least: int = 50) -> DataFrame:
    """(doc_id, kind, start, end): maximal stretches covered by runs of ``least`` words that another document has too.

    start and end count words (letters and digits, case folded). kind
    'repeat': all such stretches; 'copy': what of them an earlier document
    (smaller doc_id, null last, then KEY) has, which is what a dedup cuts.
    Null, empty and short texts have none; repeated rows are one document, so
    they are no repeats of each other; a null doc_id is a value; repeats
    within one document alone do not count; other columns are not read; an
    empty table gives an empty one; texts count whole, however long.
    """
    return shared_blocks(docs, block, least).select("doc_id", "kind", "start", "end")
