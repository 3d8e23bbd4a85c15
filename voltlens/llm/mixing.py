"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a weight; the budget (``share`` of all words) is dealt by weight, a target stops
at ``cap`` times the size of its source and the excess goes to the others by weight.  A source takes
all its documents as often as its target holds it whole; what remains of the target is fitted to
the documents:

1. documents are counted by exact length (a histogram per source, combined before the shuffle);
2. all of the remainder but ``window`` words is taken in proportion from every length, then from the longest
   down until at most ``window`` words are open;
3. bounded-knapsack dynamic programming over the documents left picks counts per length that come
   nearest to the open rest from below;
4. within a length, the documents with the smallest seeded hashes are taken.

Step 4 needs ranks among documents of one source and length, which may be a third of all rows: the
hash deals them to 256 slices, slice counts give offsets, and only the slice at the border is ranked.

The histogram of a source has a row per distinct length, not per document, so it fits one task.  The
table of sources (a row each, like the weights) is the only thing ordered as a whole.  Cases: null
text has size 0; null source is a source of its own, last; empty tables give empty results; empty
documents are copied as often as their source is, and count nothing; reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlens.llm.common import stored

CYCLE = (5.0, 2.0, 1.0)
CAP = 3
SEED = 17
SLICES = 256
WINDOW = 1 << 16


def word_count(text) -> F.Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """Sources (column ``source``) by code point, null last, with the weights of ``cycle`` in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.select("source", F.get(values, place % len(cycle)).alias("weight"))


def targets(sources: DataFrame, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """``source, source_size, weight`` -> the same with ``target``.

    With level t, a source gets min(cap x size, weight x t).  The level rises until the budget is
    spent: sources once at their stop stay there, so each round is one aggregate and the rounds end.
    """
    ceiling = F.col("source_size") * F.lit(float(cap))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    budget = min(float(share), float(cap)) * total
    level = -1.0
    while True:
        full = ceiling < F.col("weight") * F.lit(level) if level >= 0 else F.lit(False)
        stopped, weight = sources.agg(
            F.sum(F.when(full, ceiling).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        raised = (budget - stopped) / weight if weight else level
        if raised <= level or not weight:
            break
        level = raised
    level = max(level, 0.0)
    return sources.withColumn("target", F.least(ceiling, F.col("weight") * F.lit(level)))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to take so that their sum comes nearest to ``budget`` from below."""
    taken = np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    budget = max(0, min(int(budget), whole))
    if not budget:
        return taken
    taken = (counts * (max(0, budget - window) / whole)).astype(np.int64)
    while (over := int((taken * sizes).sum()) - budget) > 0:  # only by rounding of the ratio
        at = int(np.flatnonzero((taken > 0) & (sizes > 0))[-1])
        taken[at] -= min(int(taken[at]), -(-over // int(sizes[at])))
    open_ = budget - int((taken * sizes).sum())
    for at in np.argsort(-sizes, kind="stable"):
        size, spare = int(sizes[at]), int(counts[at] - taken[at])
        if open_ <= window or not size:
            break
        more = min(spare, open_ // size, -(-(open_ - window) // size))
        taken[at] += more
        open_ -= more * size
    return taken + knapsack(sizes, counts - taken, open_)


def knapsack(sizes: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by reachable sums: counts whose sum is the largest one up to ``budget``.

    Counts are split into powers of two; a sum remembers the first piece that reached it, and that
    piece is later than all pieces below, so following the pieces back gives the counts.
    """
    taken = np.zeros(len(sizes), np.int64)
    usable = [at for at in np.argsort(-sizes, kind="stable") if 0 < sizes[at] <= budget and spare[at] > 0]
    if budget <= 0 or not usable:
        return taken
    reach, mask, top = 1, (1 << (budget + 1)) - 1, 1 << budget
    by = np.zeros(budget + 1, np.int64)
    pieces: list[tuple[int, int]] = []
    width = (budget + 8) // 8
    for at in usable:
        size, left, step = int(sizes[at]), min(int(spare[at]), budget // int(sizes[at])), 1
        while left and not reach & top:
            step = min(step, left)
            fresh = (reach << (size * step)) & mask & ~reach
            if fresh:
                flags = np.frombuffer(fresh.to_bytes(width, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(flags, bitorder="little"))] = len(pieces)
                pieces.append((at, step))
                reach |= fresh
            left -= step
            step *= 2
        if reach & top:
            break
    total = reach.bit_length() - 1
    while total:
        at, step = pieces[by[total]]
        taken[at] += step
        total -= int(sizes[at]) * step
    return taken


PLAN = "source string, bare boolean, size long, number long, target double, source_size long, repeats long, extra long"


def fit_source(rows):
    """Plan of one source: a row per length with ``repeats`` of all and ``extra`` documents taken once more."""
    rows = rows.sort_values("size").reset_index(drop=True)
    target, whole = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    repeats = int(target // whole) if whole else 1
    rest = round(target - repeats * whole) if whole else 0
    extra = fit_counts(rows["size"].to_numpy(np.int64), rows["number"].to_numpy(np.int64), rest)
    return rows.assign(repeats=repeats, extra=extra)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cap: int = CAP,
    share: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``row`` (its columns), ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``weights`` has ``source`` and ``weight``; without it the weights 5, 2, 1 repeat over the sources
    in order.  ``copies`` is how often the mix holds the document, ``taken`` = ``copies`` x ``size``.
    """
    place = F.xxhash64(F.lit(seed), docs[id_col])
    sized = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_col].alias("id"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        docs[source_col].isNull().alias("bare"),
        word_count(docs[text_col]).alias("size"),
        F.pmod(place, F.lit(SLICES)).alias("slice"),
    )
    key = ["source", "bare", "size", "slice"]
    slices = stored(sized.groupBy(*key).agg(F.count("*").alias("number")), "slices")
    named = F.when(~F.col("bare"), F.col("source")).alias("source")
    sizes = stored(
        slices.groupBy("source", "bare").agg(F.sum(F.col("size") * F.col("number")).alias("source_size"))
        .select(named, "source_size"),
        "sources",
    )
    given = cycle_weights(sizes) if weights is None else weights.select("source", "weight")
    left, right = sizes.alias("l"), given.alias("r")
    aims = stored(targets(
        left.join(right, F.col("l.source").eqNullSafe(F.col("r.source")), "left")
        .select("l.source", "l.source_size", F.coalesce("r.weight", F.lit(0.0)).alias("weight")),
        cap, share,
    ), "targets").select(
        F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("bare"),
        "source_size", "target",
    )
    lengths = slices.groupBy("source", "bare", "size").agg(F.sum("number").alias("number"))
    plan = (
        lengths.join(aims, ["source", "bare"])
        .select("source", "bare", "size", "number", "target", "source_size",
                F.lit(0).cast("long").alias("repeats"), F.lit(0).cast("long").alias("extra"))
        .groupBy("source", "bare").applyInPandas(fit_source, PLAN)
    )
    before = Window.partitionBy("source", "bare", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("before", F.coalesce(F.sum("number").over(before), F.lit(0)))
    shares = offsets.join(plan.drop("number"), ["source", "bare", "size"]).select(
        *key, "target", "source_size", "repeats",
        F.greatest(F.lit(0), F.least("number", F.col("extra") - F.col("before"))).alias("extra"),
    )
    order = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 1), F.col("id")), "id")
    ranked = sized.withColumn("place", F.row_number().over(order)).join(shares, key)
    copies = F.col("repeats") + (F.col("place") <= F.col("extra")).cast("long")
    return ranked.select(
        "row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The documents the mix holds, columns as they came, with ``copies`` and the figures of ``mix``.

    Columns of ``docs`` with these names are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    mixed = mix(docs, weights, **options).where("copies > 0")
    old = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return mixed.select(*old, *new)
