"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A document longer than ``chunk_chars`` is split at fixed places. A piece may
cross a chunk's end by up to ``longest - 1`` characters; how far it does is the
boundary state. Each chunk yields its transfer matrix over these states (best
score from entering at offset i to leaving at offset j), in parallel. The
matrices combine associatively in the max-plus semiring; the scan gives every
chunk the scores of its entry states. With those each chunk finds, again on
its own, the best path to each of its exit states; what remains is to follow
the exits back through the chunks. Scores add exactly, so the path, ties
included, is that of one search over the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, alone, cut, keyed, pieces, ready, rest
from .unigram import MODEL, SPACE, Unigram, loaded, vocabulary

LOW = -1e300


def transfer(model: Unigram, text: str, size: int) -> np.ndarray:
    """Matrix [entry offset][exit offset] of a chunk of ``size`` characters; text runs on for up to longest - 1 more.

    Entry offsets beyond the first place where every path must pass (a word's
    start) need only their own short stretch; from there on one search serves
    all of them.
    """
    k = model.longest
    made = np.full((k, k), LOW)
    gate = next((i for i in range(k - 1, size) if text[i] == SPACE and text[i - 1] != SPACE), None)
    if gate is None:
        for i in range(min(k, size + 1)):
            best = model.lattice(text, {i: 0.0})[0]
            made[i, : min(k, len(text) - size + 1)] = best[size : size + k]
        return made
    tail = model.lattice(text[gate:])[0]
    rest = np.array(tail[size - gate : size - gate + k])
    for i in range(k):
        x = model.lattice(text[:gate], {i: 0.0})[0][gate]
        if x > -1e299:
            made[i, : len(rest)] = np.where(rest > -1e299, x + rest, LOW)
    return made


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    made = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(made > -1e299, made, LOW)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Entry scores of every chunk: a work-efficient inclusive scan (pairs first), then the first row of each prefix."""

    def prefixes(ms):
        if len(ms) == 1:
            return ms
        pairs = prefixes([times(ms[i], ms[i + 1]) for i in range(0, len(ms) - 1, 2)])
        made = [ms[0]]
        for i in range(1, len(ms)):
            made.append(pairs[i // 2] if i % 2 else times(pairs[i // 2 - 1], ms[i]))
        return made

    k = len(matrices[0])
    first = np.full(k, LOW)
    first[0] = 0.0
    return [first, *(p[0] for p in prefixes(matrices[:-1]))] if len(matrices) > 1 else [first]


def exits(model: Unigram, text: str, size: int, entry: np.ndarray) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """(ids of the stretch that all best paths share, [(exit offset, entry offset, ids after it)]) for the exits that can be reached."""
    best, start, piece = model.lattice(text, {i: x for i, x in enumerate(entry) if x > -1e299 and i <= len(text)})
    ends = [j for j in range(min(model.longest, len(text) - size + 1)) if best[size + j] > -1e299]
    seen, meet = {size + ends[0]}, size + ends[0]
    at = size + ends[0]
    while start[at] >= 0:
        at = start[at]
        seen.add(at)
    for j in ends[1:]:
        at = size + j
        while at not in seen and start[at] >= 0:
            at = start[at]
        meet = min(meet, at if at in seen else -1)
    trunk, common = model.back(text, start, piece, meet) if meet >= 0 else ([], -1)
    made = []
    for j in ends:
        end = size + j
        while end != meet and start[end] >= 0:
            end = start[end]
        ids, at = _between(model, text, start, piece, size + j, end)
        made.append((j, common if meet >= 0 else at, ids))
    return trunk, made


def _between(model: Unigram, text: str, start: list[int], piece: list[int], end: int, stop: int) -> tuple[list[int], int]:
    """Ids of the path from ``stop`` to ``end``, and ``stop``."""
    kept, start[stop] = start[stop], -1
    ids, at = model.back(text, start, piece, end)
    start[stop] = kept
    return ids, at


def _list(blobs: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def encode(docs: DataFrame, model: str = MODEL, chunk_chars: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for every row of ``docs``.

    round_trip: decoding ids gives the text again (with U+2581 read as a
    space, as the tokenizer does). Null and empty texts have no ids; null
    doc_ids stay; repeated rows are encoded each; other columns are not read;
    an empty table gives an empty one; texts are encoded whole, however long.
    ``chunk_chars`` decides which documents are split; the ids do not depend on
    it.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary(model))
    rows = keyed(docs)
    schema = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"

    def whole(batches):
        unigram, _, ids = loaded(shared)
        get = alone(ids).__getitem__
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            made = [b"".join(map(get, unigram.units(t))) for t in texts]
            same = [unigram.decode(memoryview(b).cast("i")) == t.replace(SPACE, " ") for b, t in zip(made, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) // 4 for b in made], pa.int64()), _list(made), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "round_trip"],
            )

    def matrices(frames):
        unigram = loaded(shared)[0]
        for pdf in frames:
            yield pd.DataFrame(
                {KEY: pdf[KEY], "k": pdf["k"], "m": [transfer(unigram, t, int(s)).tobytes() for t, s in zip(pdf["part"], pdf["size"])]}
            )

    def combine(pdf):
        pdf = pdf.drop_duplicates("k").sort_values("k")
        n = int(np.sqrt(len(pdf["m"].iloc[0]) // 8))
        got = scan([np.frombuffer(m, np.float64).reshape(n, n) for m in pdf["m"]])
        return pd.DataFrame({KEY: pdf[KEY].to_numpy(), "k": pdf["k"].to_numpy(), "entry": [v.tobytes() for v in got]})

    def paths(frames):
        unigram = loaded(shared)[0]
        for pdf in frames:
            out: list = []
            for key, k, text, size, entry in zip(pdf[KEY], pdf["k"], pdf["part"], pdf["size"], pdf["entry"]):
                trunk, tails = exits(unigram, text, int(size), np.frombuffer(entry, np.float64))
                out.append((key, k, -1, 0, np.array(trunk, np.int32).tobytes()))
                out += [(key, k, j, i, np.array(ids, np.int32).tobytes()) for j, i, ids in tails]
            yield pd.DataFrame(out, columns=[KEY, "k", "j", "i", "ids"])

    def follow(pdf):
        unigram = loaded(shared)[0]
        by = {(k, j): (i, b) for k, j, i, b in zip(pdf["k"], pdf["j"], pdf["i"], pdf["ids"])}
        made, j = [], 0
        for k in range(int(pdf["k"].max()), -1, -1):
            j, b = by[k, j]
            made += [b, by[k, -1][1]]
        blob = b"".join(reversed(made))
        text = unigram.decode(memoryview(blob).cast("i"))
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "blob": [blob], "md5": [hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()]})

    def unpack(batches):
        for batch in pieces(batches, 64):
            blobs = batch.column("blob").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) // 4 for b in blobs], pa.int64()), _list(blobs), batch.column("round_trip")],
                ["doc_id", "n_tokens", "ids", "round_trip"],
            )

    look = Unigram(shared.value).longest - 1
    cut_schema = pa.schema([(KEY, pa.int64()), ("k", pa.int32()), ("part", pa.string()), ("size", pa.int32())])

    def split(batches):
        """Each long text is gone through once and leaves in parts."""
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column(0)[row].as_py(), SPACE + batch.column(1)[row].as_py().replace(" ", SPACE)
                for at in range(0, len(text), 16 * chunk_chars):
                    starts = range(at, min(at + 16 * chunk_chars, len(text)), chunk_chars)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(starts), pa.int64()), pa.array([x // chunk_chars for x in starts], pa.int32()),
                            pa.array([text[x : x + chunk_chars + look] for x in starts]), pa.array([min(chunk_chars, len(text) - x) for x in starts], pa.int32()),
                        ],
                        schema=cut_schema,
                    )
        rest()

    short = rows.filter(F.length("text") <= chunk_chars).select("doc_id", "text").mapInArrow(whole, schema)
    longer = rows.filter(F.length("text") > chunk_chars)
    # written out: the parts are spread over all tasks twice, and the steps below end before the short texts begin
    chunks = cut(longer.select(KEY, "text").mapInArrow(split, f"{KEY} long, k int, part string, size int").repartition(KEY, "k"))
    entries = chunks.mapInPandas(matrices, f"{KEY} long, k int, m binary").groupBy(KEY).applyInPandas(combine, f"{KEY} long, k int, entry binary")
    found = chunks.join(entries, [KEY, "k"]).mapInPandas(paths, f"{KEY} long, k int, j int, i int, ids binary")
    blobs = cut(found.groupBy(KEY).applyInPandas(follow, f"{KEY} long, blob binary, md5 string"))
    ids = longer.select(KEY, "doc_id", F.md5(F.translate("text", SPACE, " ")).alias("want"))
    giant = ids.join(blobs, KEY).select("doc_id", "blob", (F.col("want") == F.col("md5")).alias("round_trip")).mapInArrow(unpack, schema)
    return short.unionByName(giant)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, an empty table an empty one."""
    shared = ready(encoded.sparkSession).sparkContext.broadcast(vocabulary(model))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        unigram = loaded(shared)[0]
        return pd.Series([None if x is None else unigram.decode([int(i) for i in x]) for x in ids], dtype=object)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), text("ids").alias("text"))
