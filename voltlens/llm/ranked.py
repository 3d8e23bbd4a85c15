"""Ranked lexical search: exact inner products of sparse vectors by a ball tree.

A document's coordinate for a term is ``(10^9 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``; an item's
is the term's weight ``floor(1000 ln((2N + 2) / (2 df + 1)))`` times its repeats.  The score is their inner product
in 64-bit integers.  N counts documents with a term, L all terms, n those of the document.

Each task puts its documents, ``BLOCK`` at a time, into a tree of balls: a node is halved along the line between
two far documents until ``LEAF`` are left, and keeps the mean of its documents and the greatest distance to it.
An item's score inside a ball is at most its product with the mean plus its length times the radius (Cauchy and
Schwarz, coordinates scaled by the root of the weights).  An item walks the tree best bound first through a
priority queue and stops at the first bound below its worst kept score; leaves are scored in integers.
Bounds are rounded up by more than the error of their sums, so no document is lost, ties included.

In Spark: one pass over the texts writes each document's counts of item terms; the totals and frequencies are
aggregates of it; a second pass over these counts keeps ``top`` documents per item and task, which a ranking
per item merges.  Items are a stated query set: they are taken in blocks of about ``block_bytes`` of text, so a
task holds one block of items and one of documents, however large the tables.

Cases: null and term-less texts have no terms and are no result; items without terms, or whose terms no
document holds, give no rows; rows of equal item id and text are one item; repeated documents are ranked
each; null ids come last among ties; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns, arrow_type, discard, stored
from voltlens.llm.decontam import words_of

TOP = 20
BLOCK = 8192
LEAF = 64
BLOCK_BYTES = 500_000
#: Relative error that a sum of products in doubles stays under, with room.
SLACK = 1e-10


@dataclass
class Query:
    """An item over the term numbers of its block: repeats, and once the weights are known, its vector."""

    item: object
    terms: np.ndarray
    repeats: np.ndarray
    vector: np.ndarray | None = None
    scaled: np.ndarray | None = None
    length: float = 0.0


def queries_of(rows: Sequence[tuple[object, bytes]]) -> tuple[dict[bytes, int], list[Query]]:
    number: dict[bytes, int] = {}
    found = []
    for item, text in rows:
        counts = Counter(number.setdefault(w, len(number)) for w in words_of(text))
        if counts:
            terms = np.array(sorted(counts), np.int64)
            found.append(Query(item, terms, np.array([counts[int(t)] for t in terms], np.int64)))
    return number, found


def weigh(queries: list[Query], frequency: np.ndarray, documents: int) -> np.ndarray:
    """Vectors of the items; returns the weight of every term (0 for terms that no document holds)."""
    weights = np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) if df else 0 for df in frequency], np.int64
    )
    for q in queries:
        use = weights[q.terms] > 0
        q.terms, q.repeats = q.terms[use], q.repeats[use]
        q.vector = weights[q.terms] * q.repeats
        q.scaled = q.repeats * np.sqrt(weights[q.terms].astype(float))
        q.length = float(np.linalg.norm(q.scaled))
    return weights


@dataclass
class Rows:
    """Sparse rows: integer coordinates, and the same scaled by the root of the weights."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    scaled: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(starts, self.terms[at], self.values[at], self.scaled[at])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums per row; no row is empty."""
        return np.add.reduceat(values, self.starts[:-1])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        part = slice(self.starts[row], self.starts[row + 1])
        out[self.terms[part]] = self.scaled[part]
        return out


class Leaf:
    """Coordinates of a few documents, dense over the terms they hold."""

    def __init__(self, rows: Rows, numbers: np.ndarray, width: int):
        self.numbers = numbers
        held, inverse = np.unique(rows.terms, return_inverse=True)
        self.place = np.full(width, -1, np.int32)
        self.place[held] = np.arange(len(held))
        self.values = np.zeros((len(rows), len(held)), np.int64)
        self.values[np.repeat(np.arange(len(rows)), np.diff(rows.starts)), inverse] = rows.values

    def scores(self, query: Query) -> np.ndarray:
        place = self.place[query.terms]
        held = place >= 0
        return self.values[:, place[held]] @ query.vector[held]


class BallTree:
    """Balls over sparse rows; node 0 is the root."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        self.width, self.leaf = width, leaf
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.below: list[tuple[int, int] | Leaf] = []
        self.build(rows, np.arange(len(rows)), rows.sums(rows.scaled**2))

    def build(self, rows: Rows, numbers: np.ndarray, squares: np.ndarray) -> int:
        node = len(self.centres)
        centre = np.bincount(rows.terms, rows.scaled, self.width) / len(rows)
        own = float(centre @ centre)
        away = np.maximum(squares - 2 * rows.sums(rows.scaled * centre[rows.terms]) + own, 0)
        self.centres.append(centre)
        self.radii.append(math.sqrt(float((away + SLACK * (squares + own)).max())))
        self.below.append((0, 0))
        if len(rows) <= self.leaf:
            self.below[node] = Leaf(rows, numbers, self.width)
            return node
        one = rows.dense(int(away.argmax()), self.width)
        far = squares - 2 * rows.sums(rows.scaled * one[rows.terms])
        line = one - rows.dense(int(far.argmax()), self.width)
        order = np.argsort(rows.sums(rows.scaled * line[rows.terms]), kind="stable")
        half = len(order) // 2
        self.below[node] = tuple(self.build(rows.take(part), numbers[part], squares[part]) for part in (order[:half], order[half:]))
        return node

    def bound(self, node: int, query: Query) -> float:
        """No document below the node scores more."""
        product = float(self.centres[node][query.terms] @ query.scaled)
        return (product + query.length * self.radii[node]) * (1 + 1e-8) + 1

    def search(self, query: Query, best: list[tuple], top: int, ids: Sequence) -> int:
        """Merge the documents of the tree into ``best``, sorted (-score, null, id); returns the leaves visited."""
        visited = 0
        heap = [(-self.bound(0, query), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            floor = -best[-1][0] if len(best) == top else 1
            if -bound < floor:
                break
            below = self.below[node]
            if isinstance(below, tuple):
                for child in below:
                    b = self.bound(child, query)
                    if b >= floor:
                        heapq.heappush(heap, (-b, child))
                continue
            visited += 1
            scores = below.scores(query)
            good = np.flatnonzero(scores >= floor)
            if len(good):
                for at in good:
                    one = ids[below.numbers[at]]
                    best.append((-int(scores[at]), one is None, one if one is not None else 0))
                best.sort()
                del best[top:]
        return visited


def counted(docs: DataFrame, number: dict[bytes, int], doc_col: str, text_col: str) -> DataFrame:
    """Documents with terms: ``doc``, ``n`` and the counts of the terms of ``number``."""

    def start():
        def work(texts):
            sizes, ids, counts = [], [], []
            for text in texts:
                words = words_of(text)
                own = Counter(map(number.get, words))
                own.pop(None, None)
                sizes.append(len(words))
                ids.append(list(own))
                counts.append(list(own.values()))
            return [sizes, ids, counts]

        return work

    fields = [
        T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
    slim = docs.select(docs[doc_col].alias("doc"), docs[text_col].cast("string").alias("text"))
    return add_columns(slim, ["text"], fields, start, ["doc"]).where("n > 0")


def block_rows(batch: pa.RecordBatch, weights: np.ndarray, documents: int, total: int) -> tuple[list, Rows | None]:
    """Ids and coordinates of the documents of a batch that hold a weighted term."""
    sizes = batch.column(1).to_numpy(zero_copy_only=False)
    lists, numbers = batch.column(2), batch.column(3)
    ends = np.diff(lists.offsets.to_numpy())
    terms, counts = lists.flatten().to_numpy(), numbers.flatten().to_numpy()
    m = 75 + (25 * sizes * documents) // total
    per_row = np.repeat(np.arange(len(sizes)), ends)
    use = weights[terms] > 0
    per_row, terms, counts = per_row[use], terms[use].astype(np.int64), counts[use]
    if not len(terms):
        return [], None
    values = (1_000_000_000 * counts) // (1000 * counts + 12 * m[per_row])
    kept, sizes = np.unique(per_row, return_counts=True)
    rows = Rows(np.concatenate(([0], np.cumsum(sizes))), terms, values, values * np.sqrt(weights[terms].astype(float)))
    return batch.column(0).take(pa.array(kept)).to_pylist(), rows


def best_per_task(
    counts: DataFrame, queries: list[Query], weights: np.ndarray, documents: int, total: int, top: int, item_type: T.DataType
) -> DataFrame:
    schema = T.StructType([
        T.StructField("place", T.IntegerType()), T.StructField("item_id", item_type),
        T.StructField("doc", counts.schema["doc"].dataType), T.StructField("score", T.LongType()),
    ])
    kinds = [arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, rows = block_rows(batch.slice(at, BLOCK), weights, documents, total)
                if rows is not None:
                    tree = BallTree(rows, len(weights))
                    for query, own in zip(queries, best, strict=True):
                        if len(query.terms):
                            tree.search(query, own, top, ids)
        found = [
            (place, q.item, None if null else doc, -score)
            for place, (q, own) in enumerate(zip(queries, best, strict=True)) for score, null, doc in own
        ]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=schema.names
            )

    return counts.select("doc", "n", "terms", "counts").mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``top`` documents of every item."""
    asked = items.select(
        items[item_col].alias("item"), F.coalesce(items[item_text_col].cast("string"), F.lit("")).cast("binary").alias("text")
    ).distinct()
    item_type = asked.schema["item"].dataType
    volume = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toLocalIterator()
        number, queries = queries_of(sorted(((r["item"], bytes(r["text"])) for r in rows), key=lambda r: (str(r[0]), r[1])))
        counts = stored(counted(docs, number, doc_col, text_col), "terms")
        documents, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(number), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            frequency[r["term"]] = r["count"]
        weights = weigh(queries, frequency, documents)
        part = best_per_task(counts, queries, weights, documents, total, top, item_type)
        if blocks > 1:
            part = stored(ranked(part, top), "ranked")
            discard(counts)
        found = part if found is None else found.union(part)
    found = found if blocks > 1 else ranked(found, top)
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
