"""Nearest neighbours by cosine with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on at most ``SAMPLE`` unit vectors chosen by hash: each node is split by k-means
into ``BRANCH`` parts until a leaf stands for about ``LEAF_ROWS`` rows of the whole table (or the
sample is used up).  Every row is indexed: it goes down the tree to its leaf.  A query walks the
tree with a priority queue of boxes ordered by the distance to their centres, so its leaves come in
order of promise; how many it visits is calibrated: for ``CALIBRATION`` rows chosen by hash the
exact neighbours over all rows are found by brute force, and visits are widened until the share of
these neighbours in visited leaves reaches ``RECALL``.

Search is a join of (query, leaf) with (leaf, row), done in blocks of about ``BLOCK_ROWS`` rows and at most
some ``BLOCK_QUERIES`` queries: small neighbouring leaves share a block, a crowded leaf is dealt to
several, a much visited block is searched in slices.  A block gives at most ``k`` + 1 rows per query.  Equal vectors have equal scores, and ties go to smaller ids: of the rows with one
vector only the ``k`` + 1 smallest ids can be in any result, so a search scores just these, and
queries with one vector are searched once.  Scores are computed in double precision on the original
vectors, always in the same order of operations.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do
rows without an id, nor vectors of another length than most rows; rows that repeat id and vector
count once; a query never finds its own id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import stored

SAMPLE = 20_000
BRANCH = 8
LEAF_ROWS = 256
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
CALIBRATION = 200
RECALL = 0.97
NEIGHBOURS = 5


@dataclass
class Tree:
    """Centres of all nodes, the children of each node, and the leaf number of a node (-1: inner)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """Leaf number of each vector, always down to the nearest centre."""
        at = np.zeros(len(unit), np.int64)
        todo = np.arange(len(unit))
        while len(todo):
            rest = []
            for node in np.unique(at[todo]):
                mine = todo[at[todo] == node]
                kids = self.children[node]
                if kids:
                    at[mine] = np.array(kids)[distances(unit[mine], self.centres[kids]).argmin(axis=1)]
                    rest.append(mine)
            todo = np.concatenate(rest) if rest else todo[:0]
        return self.leaf[at]

    def visit(self, unit: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for one vector, best bin first."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                far = ((self.centres[kids] - unit) ** 2).sum(axis=1)
                order = far.argsort(kind="stable")
                for i in order[1:]:
                    heapq.heappush(queue, (float(far[i]), kids[i]))
                node = kids[order[0]]
            found.append(int(self.leaf[node]))
        return found


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2.0 * rows @ centres.T


def k_means(rows: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and assignment; fewer than ``parts`` centres if there are fewer distinct vectors."""
    centres = rows[rng.integers(len(rows))][None, :]
    while len(centres) < parts:  # k-means++ seeding
        gap = np.maximum(0.0, (rows**2).sum(axis=1) + distances(rows, centres).min(axis=1))
        if gap.sum() <= 1e-9 * len(rows):
            break
        centres = np.vstack((centres, rows[rng.choice(len(rows), p=gap / gap.sum())]))
    part = distances(rows, centres).argmin(axis=1)
    for _ in range(rounds):
        centres = np.stack([rows[part == k].mean(axis=0) if (part == k).any() else centres[k] for k in range(len(centres))])
        now = distances(rows, centres).argmin(axis=1)
        if (now == part).all():
            break
        part = now
    return centres, part


def fit(sample: np.ndarray, rows_in_all: int, seed: int = 3, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree on unit vectors; leaves stand for about ``leaf_rows`` of ``rows_in_all`` rows."""
    rng = np.random.default_rng(seed)
    least = max(2.0 * branch, leaf_rows * len(sample) / max(1, rows_in_all))
    centres, children = [sample.mean(axis=0)], [[]]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= least:
            continue
        middle, part = k_means(sample[rows], branch, rng)
        used = [k for k in range(len(middle)) if (part == k).any()]
        if len(used) < 2:
            continue
        for k in used:
            children[node].append(len(centres))
            todo.append((len(centres), rows[part == k]))
            centres.append(middle[k])
            children.append([])
    inner = np.array([bool(c) for c in children])
    return Tree(np.stack(centres), children, np.where(inner, -1, np.cumsum(~inner) - 1))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row; a row's score does not depend on the other rows."""
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest(queries, rows, ids, k: int, own=None, open_=None):
    """Exact best ``k`` of ``rows`` for each query: (query position, row position, score) triples.

    A matrix product finds what can be among the best; these are scored again one by one.  ``own``
    gives the id that each query must not find, ``open_`` which rows it may find.
    """
    if not len(rows):
        return
    unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    rough = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]) @ unit.T
    if own is not None:
        rough[own[:, None] == ids[None, :]] = -np.inf
    if open_ is not None:
        rough[~open_] = -np.inf
    keep = min(k, len(rows))
    limits = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - 1e-9
    for i in range(len(queries)):
        near = np.flatnonzero((rough[i] >= limits[i]) & (rough[i] > -np.inf))
        scores = cosines(queries[i], rows[near])
        for j in np.lexsort((ids[near], -scores))[:k]:
            yield i, int(near[j]), float(scores[j])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``vector`` (doubles) of the rows that take part."""
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(
        finite & F.exists("vector", lambda x: x != 0)
    )


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 1))


@dataclass
class Index:
    """A fitted tree with all rows in leaf blocks."""

    tree: Tree | None
    rows: DataFrame  # vec_id, vector, leaf
    visits: int
    recall: float


def build(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
    recall: float = RECALL, sample_rows: int = SAMPLE, calibration: int = CALIBRATION, seed: int = 31,
) -> Index:
    """Fit the tree, index every row, calibrate the number of leaves to visit."""
    rows = usable(vectors, id_col, vector_col)
    count, width = rows.agg(F.count("*"), F.mode(F.size("vector"), True)).first()
    rows = rows.where(F.size("vector") == (width or 0))
    place = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_000))
    near = rows.where(place < F.lit(1_500_000.0 * sample_rows / max(1, count)))
    picked = near.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "vector").limit(sample_rows).toPandas()
    if picked.empty:
        return Index(None, rows.withColumn("leaf", F.lit(0).cast("long")), 0, 1.0)
    sample = matrix(picked["vector"])
    tree = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), count)

    def to_leaf(batches):
        for part in batches:
            m = matrix(part["vector"])
            if len(m):
                yield part.assign(leaf=tree.assign(m / np.linalg.norm(m, axis=1, keepdims=True)))

    leafed = stored(
        rows.mapInPandas(to_leaf, "vec_id long, vector array<double>, leaf long"), "leaves"
    )
    step = max(1, len(picked) // calibration)
    trial = picked.iloc[::step][:calibration]
    asked, asked_ids = matrix(trial["vector"]), trial["vec_id"].to_numpy()

    def exact(batches):
        import pandas as pd

        for part in batches:
            found = [
                (int(asked_ids[i]), s, int(part["vec_id"].iloc[j]), int(part["leaf"].iloc[j]))
                for i, j, s in nearest(asked, matrix(part["vector"]), part["vec_id"].to_numpy(), k, asked_ids)
            ]
            yield pd.DataFrame(found, columns=["query_id", "score", "vec_id", "leaf"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = (
        leafed.mapInPandas(exact, "query_id long, score double, vec_id long, leaf long")
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query_id", "leaf").collect()
    )
    units = dict(zip(asked_ids, asked / np.linalg.norm(asked, axis=1, keepdims=True), strict=True))
    order = {q: {leaf: n for n, leaf in enumerate(tree.visit(u, tree.leaves))} for q, u in units.items()}
    depth = np.sort([order[r["query_id"]][r["leaf"]] + 1 for r in truth]) if truth else np.array([1])
    visits = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)])
    return Index(tree, leafed, visits, float((depth <= visits).mean()))


def leaf_blocks(counts: dict[int, int], leaves: int, block_rows: int) -> tuple[list[int], list[int]]:
    """First block and number of blocks of each leaf: small neighbours share one, crowded leaves get several."""
    first, parts, block, held = [], [], 0, 0
    for leaf in range(leaves):
        number = counts.get(leaf, 0)
        if held and held + number > block_rows:
            block, held = block + 1, 0
        first.append(block)
        parts.append(max(1, -(-number // block_rows)))
        held += number
        if parts[-1] > 1:
            block, held = block + parts[-1], 0
    return first, parts


def search(
    index: Index, queries: DataFrame, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """The ``k`` nearest indexed rows of each query (``vec_id``, ``vector``), itself excepted.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.
    """
    tree, visits = index.tree, index.visits
    same = Window.partitionBy("leaf", "vector").orderBy("vec_id")
    heads = stored(
        index.rows.select("leaf", "vector", "vec_id").distinct()
        .withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"),
        "heads",
    )
    counts = dict(heads.groupBy("leaf").count().collect())  # a row per leaf of the tree
    first_block, parts = leaf_blocks(counts, tree.leaves if tree else 1, block_rows)
    placed = heads.withColumn("block", (
        F.get(F.lit(first_block), F.col("leaf"))
        + F.pmod(F.xxhash64("vec_id", "vector"), F.get(F.lit(parts), F.col("leaf")).cast("long"))
    ).cast("long"))

    def leaves(batches):
        import pandas as pd

        for part in batches:
            m = matrix(part["vector"])
            if tree is None or not len(m):
                continue
            rows = []
            for q, first, own, unit in zip(part["vector"], part["first"], part["own"], m / np.linalg.norm(m, axis=1, keepdims=True), strict=True):
                by_block: dict[int, list[int]] = {}
                for leaf in tree.visit(unit, visits):
                    for block in range(first_block[leaf], first_block[leaf] + parts[leaf]):
                        by_block.setdefault(block, []).append(leaf)
                rows.extend((first, own, q, block, mine) for block, mine in by_block.items())
            yield pd.DataFrame(rows, columns=["first", "own", "query", "block", "leaves"])

    # Equal vectors are searched once, and the one row under a query's own id goes afterwards.  An id with
    # several vectors is searched for itself, its own rows left out from the start.
    crowded = heads.groupBy("vec_id").count().where("count > 1").select("vec_id", F.col("vec_id").cast("string").alias("own"))
    named = queries.select("vec_id", "vector").distinct().join(crowded, "vec_id", "left").select(
        F.col("vec_id").alias("query_id"), "vector", "own",
        F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit("voltlens"), "vector"), "own").alias("first"))
    named = stored(named, "named")
    distinct = named.select("vector", "own", "first").distinct()
    wanted = stored(
        distinct.mapInPandas(leaves, "first string, own string, query array<double>, block long, leaves array<long>"), "asked"
    )
    slices = wanted.groupBy("block").agg(F.ceil(F.count("*") / block_queries).alias("slices"))
    asked = wanted.join(slices, "block").select(
        "block", F.pmod(F.xxhash64("first"), F.col("slices")).alias("slice"), "first", "own", "query", "leaves"
    )
    rows = placed.join(slices, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "leaf", "vec_id", "vector"
    )

    def block(left, right):
        import pandas as pd

        q, r = matrix(left["query"]), matrix(right["vector"])
        ids, first, leaf = right["vec_id"].to_numpy(), left["first"].to_numpy(), right["leaf"].to_numpy()
        kinds, place = np.unique(leaf, return_inverse=True)
        open_ = np.stack([np.isin(kinds, x)[place] for x in left["leaves"]]) if len(q) else None
        for i, own in enumerate(left["own"]):
            if own is not None:
                open_[i] &= ids != int(own)
        found = [
            (first[at + i], int(ids[j]), s)
            for at in range(0, len(q) if len(r) else 0, 256)
            for i, j, s in nearest(q[at : at + 256], r, ids, k + 1, open_=open_[at : at + 256])
        ]
        return pd.DataFrame(found, columns=["first", "vec_id", "score"])

    hits = asked.groupBy("block", "slice").cogroup(rows.groupBy("block", "slice")).applyInPandas(
        block, "first string, vec_id long, score double"
    )
    best = Window.partitionBy("first").orderBy(F.desc("score"), "vec_id")
    short = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    found = named.select("query_id", "first").join(short, "first").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
