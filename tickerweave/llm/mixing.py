"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact token length), the lengths being those
of ``token_counts``. A source's budget is its weight's share of the total, and
all it has where that is less (``budgets``). Most of it is met by the
proportional whole number of documents of each length; the rest by
bounded-knapsack dynamic programming over the lengths' leftover counts, which
finds the largest sum that can be reached. Where that is not the budget
itself, a larger rest is left to the knapsack, in the end all of it. The
counts are then met with the documents that a seeded hash puts first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, shielded
from .token_counts import count_column
from .unigram import MODEL

#: Largest rest, in tokens over the lengths' greatest common divisor, for which the knapsack keeps its table (4 bytes each).
LARGEST_REST = 1 << 26


def fit_counts(lengths: list[int], counts: list[int], budget: int, window: int = 4096) -> list[int]:
    """Documents to take of each length (> 0): the largest sum of tokens at most ``budget``.

    ``window`` is the rest that the knapsack gets first; it grows until the
    budget (less what no sum of these lengths can be, by their greatest common
    divisor) is met or the knapsack had everything, so the sum is the largest
    there is. Only a budget beyond LARGEST_REST that no rest of that size can
    meet may be missed by more than it had to be.
    """
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    size, have = [lengths[i] for i in order], [counts[i] for i in order]
    if sum(a * b for a, b in zip(size, have)) <= budget:
        return list(counts)
    unit = math.gcd(*size)
    size, goal = [x // unit for x in size], budget // unit
    total, best, lacking = sum(a * b for a, b in zip(size, have)), [0] * len(size), goal
    while True:
        take = [b * max(0, goal - window) // total for b in have]
        lack = goal - sum(a * b for a, b in zip(size, take))
        for i in range(len(size) - 1, -1, -1):
            if lack <= window:
                break
            add = min(have[i] - take[i], max(0, lack - window // 2) // size[i])
            take[i] += add
            lack -= add * size[i]
        for i, add in knapsack(size, [b - a for a, b in zip(take, have)], lack):
            take[i] += add
            lack -= add * size[i]
        if lack < lacking:
            best, lacking = take, lack
        if lacking == 0 or window >= min(goal, LARGEST_REST):
            break
        window *= 8
    made = [0] * len(lengths)
    for i, at in enumerate(order):
        made[at] = best[i]
    return made


def knapsack(size: list[int], left: list[int], goal: int) -> list[tuple[int, int]]:
    """(index, number) whose sizes sum to the largest reachable value at most ``goal``; each index at most ``left`` times.

    Reachable sums are the bits of an integer; counts are split into powers
    of two. Which step reached a sum first is kept for the way back. It stops
    as soon as the goal itself is reached.
    """
    if goal <= 0:
        return []
    mask, reach, steps = (1 << (goal + 1)) - 1, 1, []
    first = np.zeros(goal + 1, np.int32)
    for i, (a, n) in enumerate(zip(size, left)):
        if a > goal or reach >> goal & 1:
            break
        n, part = min(n, goal // a), 1
        while n > 0 and not reach >> goal & 1:
            many = min(part, n)
            new = (reach << (a * many) & mask) & ~reach
            if new:
                steps.append((i, many))
                bits = np.unpackbits(np.frombuffer(new.to_bytes(goal // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                reach |= new
            n -= many
            part *= 2
    at, found = reach.bit_length() - 1, {}
    while at:
        i, many = steps[first[at] - 1]
        found[i] = found.get(i, 0) + many
        at -= size[i] * many
    return sorted(found.items())


def budgets(tokens: dict[str, int], want: dict[str, float], total: int | None = None, exact: bool = False) -> dict[str, int]:
    """Tokens to take of each source: shares by ``want``, none above what the source has.

    With a ``total``, what a source cannot fill goes to the others by their
    weights. Without one, all sources fill their shares where ``exact``; else
    the mixture is the largest in which the sources that fill their shares
    hold at least half of the weights, and the others give all they have.
    """
    left = {s: w for s, w in want.items() if w > 0 and tokens[s] > 0}
    made = dict.fromkeys(want, 0)
    if not left:
        return made
    full = sorted(left, key=lambda s: (tokens[s] / left[s], s))
    if total is None:
        share, level = sum(left.values()), tokens[full[0]] / left[full[0]]
        held = share
        for s in () if exact else full:
            if held < 0.5 * share * (1 - 1e-9):
                break
            level = tokens[s] / left[s]
            held -= left[s]
        return made | {s: min(tokens[s], int(round(level * w))) for s, w in left.items()}
    rest, share = total, sum(left.values())
    for s in full:
        made[s] = min(tokens[s], int(round(rest * left[s] / share)))
        rest, share = rest - made[s], share - left[s]
    return made


@shielded
def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 42, total: int | None = None, model: str = MODEL
) -> DataFrame:
    """The rows of ``docs`` that make up the mixture, with all its columns.

    ``weights``: target share of each source's tokens (sources not named get
    none). Without them the share is proportional to the source's own tokens
    to the power ``alpha`` (1 keeps everything, 0 makes all sources equal).
    ``total``: tokens of the mixture; without it, explicit weights are met
    exactly by the largest mixture that can, and the others as ``budgets`` says.
    Tokens are those of ``model``, counted in the whole text. A null source is
    the source ''. Null and empty texts have no tokens: they cost no budget
    and stay, whatever their source. Repeated rows are documents each; ties of
    the hash go by the row's own hash (rows alike in id, text and source are
    interchangeable). Lengths are taken over all rows. An empty table gives an
    empty one.
    """
    text, source = F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit(""))
    row = F.xxhash64(F.col("doc_id").cast("long"), text, source)
    some = F.length(text) > 0
    # what is counted, ranked and shuffled has no text in it
    lengths = docs.filter(some).select(row.alias("row"), source.alias("s"), count_column(docs.sparkSession, text, model).alias("n"))
    lengths = cut(lengths.groupBy("row", "s", "n").agg(F.count("*").alias("m")))
    hist = cut(lengths.groupBy("s", "n").agg(F.sum("m").alias("c")))
    tokens = {r["s"]: int(r.t) for r in hist.groupBy("s").agg(F.sum(F.col("n") * F.col("c")).alias("t")).collect()}
    want = {s: float(weights.get(s, 0.0)) for s in tokens} if weights is not None else {s: t**alpha for s, t in tokens.items()}
    budget = budgets(tokens, want, total, exact=weights is not None)

    def fit(pdf):
        got = fit_counts(pdf["n"].tolist(), pdf["c"].tolist(), budget.get(pdf["s"].iloc[0], 0))
        return pd.DataFrame({"s": pdf["s"], "n": pdf["n"], "take": np.array(got, np.int64)})

    takes = hist.groupBy("s").applyInPandas(fit, "s string, n long, take long").filter("take > 0")
    order = Window.partitionBy("s", "n").orderBy(F.xxhash64(F.lit(seed), "row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = lengths.withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0))).join(takes, ["s", "n"])
    kept = cut(ranked.withColumn("t", F.least(F.col("m"), F.col("take") - F.col("before"))).filter("t > 0").select(F.col("row").alias("__row"), "m", "t"))
    few = kept.count() <= BROADCAST_ROWS

    def of(part):
        part = part.select("__row", F.col("t").alias("__t"))
        return docs.filter(some).withColumn("__row", row).join(F.broadcast(part) if few else part, "__row")

    # rows of which only some copies are taken (at most one kind for each source and length) are numbered
    cut_off = of(kept.filter("t < m")).withColumn("__rank", F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0)))).filter("__rank <= __t")
    blank = docs.filter(F.coalesce(F.length(text), F.lit(0)) == 0)
    return of(kept.filter("t = m")).select(*docs.columns).unionByName(cut_off.select(*docs.columns)).unionByName(blank)
