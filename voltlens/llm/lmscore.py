"""Cross-entropy difference of documents under a target and a background model.

Both models are bigram models over one vocabulary, with the same smoothing: the background counts all
documents, the target those that ``target`` marks,

    p(w | v) = MIX c(v w) / c(v) + (1 - MIX) (c(w) + 1) / (N + |V|).

A document does not vouch for itself: its own counts are taken off all counts it is scored with.
The score is the mean over its tokens of (target loss - background loss), lower is closer to the target.

1. Words are counted over all documents, per chunk first, then combined; the vocabulary is the most
   frequent ones, at most ``WORDS`` of them, word 0 is everything else.
2. Documents are written as word numbers, with the target mark joined to these and not to the texts.
3. Word counts and the counts of head pairs (both among the ``HEAD`` most frequent words) fit every task.
4. Other pairs go in blocks of (pair, row, counts) to the partition of their pair; the partition holds all
   rows of its pairs, counts them and scores them in one pass, so there is no second scan and no join.

Pairs grow with the corpus and are never gathered; there are ``LEAST_PARTS`` partitions or more, of about
``PART_TOKENS`` tokens whatever the size of the corpus; each returns a row per document that it has pairs of.  The pairs that most documents share are head pairs, which are scored where
the document is read; any other pair has one row per document at most.

Cases: null, empty and wordless texts have 0 tokens and null losses; without a target document the target
model is uniform; repeated rows are scored each; missing ids are kept; an id marked twice is marked.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns, chunks, discard, stored
from voltlens.llm.decontam import words_of

WORDS = 60_000  # at most 65,000: word numbers take 16 bits, pairs 32
HEAD = 512
MIX = 0.6
PART_TOKENS = 2_000_000
LEAST_PARTS = 64
CODED_BYTES = 1 << 20  # of word numbers handled at once
BUCKETS_PER_PART = 8
FLUSH_WORDS = 200_000


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (binary) and its ``number`` in all texts."""
    kind = pa.schema([("word", pa.binary()), ("number", pa.int64())])

    def count(batches):
        seen: Counter = Counter()

        def flush():
            made = pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], kind)
            seen.clear()
            return made

        for batch in batches:
            for part in chunks(batch, range(batch.num_columns)):
                for text in part.column(0).to_pylist():
                    seen.update(words_of(text))
                if len(seen) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    texts = docs.select(docs[text_col].cast("binary").alias("text"))
    return texts.mapInArrow(count, "word binary, number long").groupBy("word").agg(F.sum("number").alias("number"))


def vocabulary(counts: DataFrame, most: int = WORDS) -> list[bytes]:
    """The most frequent words, at most ``most``, most frequent first.

    A histogram of the logarithms of the counts gives the least count, so no more than the
    vocabulary itself is sorted or fetched.
    """
    level = F.floor(F.log2("number") * 16).cast("int")
    steps = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in steps:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return []
    rows = counts.where(level >= least).select("word", "number").collect()
    return [bytes(r["word"]) for r in sorted(rows, key=lambda r: (-r["number"], bytes(r["word"])))]


def encode(docs: DataFrame, text_col: str, words: list[bytes]) -> DataFrame:
    """``docs`` with ``ids``: the word numbers of the text as little-endian 16-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def start():
        number = {w: i + 1 for i, w in enumerate(shared.value)}

        def work(texts):
            return [[np.fromiter((number.get(w, 0) for w in words_of(t)), "<u2").tobytes() for t in texts]]

        return work

    keep = [c for c in docs.columns if c != text_col]
    return add_columns(docs, [text_col], [T.StructField("ids", T.BinaryType())], start, keep)


class Pairs:
    """Distinct pairs of a document with their numbers, and its own counts of both words."""

    def __init__(self, ids: bytes, size: int, head: int):
        self.words = np.frombuffer(ids, "<u2").astype(np.int64)
        before = np.concatenate(([size], self.words[:-1]))  # ``size`` stands for the start of the text
        self.keys, self.numbers = np.unique(before * (size + 1) + self.words, return_counts=True)
        self.first, self.second = np.divmod(self.keys, size + 1)
        self.own_first = counted(before, self.first)
        self.own_second = counted(self.words, self.second)
        top = min(head, size)
        self.head = ((self.first < top) | (self.first == size)) & (self.second < top)


def counted(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    kinds, numbers = np.unique(values, return_counts=True)
    return numbers[np.searchsorted(kinds, asked)]


def losses(pair, own, first, own_first, second, own_second, total, own_total, size):
    """Loss of one model for pairs, all counts without the document's own."""
    context = first - own_first
    chance = np.where(context > 0, (pair - own) / np.maximum(1, context), 0.0)
    single = (second - own_second + 1.0) / (total - own_total + size)
    return -np.log(np.where(context > 0, MIX * chance + (1 - MIX) * single, single))


class Model:
    """What every task knows: word counts and head pair counts, of the target and of all documents."""

    def __init__(self, size: int, counts: np.ndarray, ends: np.ndarray, head: np.ndarray):
        self.size, self.counts, self.head = size, counts, head
        self.totals = counts.sum(axis=1)
        # A word that ends a text has no successor; as many texts start as end.
        self.contexts = np.concatenate((counts - ends, ends.sum(axis=1, keepdims=True)), axis=1)

    def both(self, pair, number, first, own_first, second, own_second, marked, tokens):
        """Target and background losses; ``marked`` documents have own counts in the target too."""
        return [
            losses(pair[k], number * m, self.contexts[k][first], own_first * m, self.counts[k][second], own_second * m,
                   self.totals[k], tokens * m, self.size)
            for k, m in ((0, marked), (1, 1))
        ]


def small_counts(coded: DataFrame, size: int, head: int) -> Model:
    """Word counts, last words and head pairs, summed per chunk before they are combined.

    Keys: words from 0 on, last words from ``size`` on, then the head pairs.
    """
    top = min(head, size)
    width = 2 * size + (top + 1) * top

    def tally(texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) // 2 for t in texts])
        words = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)
        before = np.concatenate(([0], words[:-1]))
        before[np.cumsum(sizes) - sizes] = size
        head_pair = ((before < top) | (before == size)) & (words < top)
        first = np.minimum(before[head_pair], top)
        keys = (words, size + words[np.cumsum(sizes) - 1], 2 * size + first * top + words[head_pair])
        return np.bincount(np.concatenate(keys), minlength=width)

    def count(batches):
        for batch in batches:
            for part in chunks(batch, range(batch.num_columns), CODED_BYTES):
                rows = [(t, m) for t, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t]
                every, target = (tally(x) if x else np.zeros(width, np.int64) for x in ([t for t, _ in rows], [t for t, m in rows if m]))
                seen = np.flatnonzero(every)
                yield pa.record_batch([pa.array(x) for x in (seen, target[seen], every[seen])], ["key", "target", "every"])

    rows = (
        coded.select("ids", "marked").mapInArrow(count, "key long, target long, every long").groupBy("key")
        .agg(F.sum("target").alias("target"), F.sum("every").alias("every")).toPandas()
    )  # at most ``width`` rows
    found = np.zeros((2, width))
    for k, column in enumerate(("target", "every")):
        found[k][rows["key"]] = rows[column]
    return Model(size, found[:, :size], found[:, size : 2 * size], found[:, 2 * size :].reshape(2, top + 1, top))


FOUND = "rid long, gap double, every float"

#: Columns of a block of pairs; row ids ascend within a block and are kept as differences.
BLOCK_COLUMNS = (("key", "<u4"), ("rid", "<i8"), ("number", "<u4"), ("own_first", "<u4"), ("own_second", "<u4"), ("tokens", "<u4"), ("marked", "<u1"))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns one after the other: alike values side by side compress well in the shuffle."""
    key, rid, *rest = columns
    return b"".join(
        c.astype(kind).tobytes()
        for c, (_, kind) in zip((key, np.diff(rid, prepend=0), *rest), BLOCK_COLUMNS, strict=True)
    )


def unpack(block: bytes) -> list[np.ndarray]:
    rows = len(block) // sum(np.dtype(kind).itemsize for _, kind in BLOCK_COLUMNS)
    out, at = [], 0
    for name, kind in BLOCK_COLUMNS:
        values = np.frombuffer(block, kind, rows, at)
        at += values.nbytes
        out.append(np.cumsum(values) if name == "rid" else values if name == "key" else values.astype(np.int64))
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """Scattered pair keys, so that neighbouring pairs do not share a bucket."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def score(
    docs: DataFrame, marks: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, head: int = HEAD
) -> DataFrame:
    """One row per document: ``doc_id``, ``tokens``, ``loss_target``, ``loss_background``, ``score``.

    ``marks`` has the ``doc_id`` of the target documents.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    counts = stored(word_counts(slim, "text"), "words")
    chosen = vocabulary(counts, min(words, 65_000))
    discard(counts)
    size = len(chosen) + 1
    target = marks.select("doc_id").distinct().withColumn("marked", F.lit(True))
    coded = stored(
        encode(slim, "text", chosen).join(target, "doc_id", "left")
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "ids", F.coalesce("marked", F.lit(False)).alias("marked")),
        "coded",
    )
    shared = docs.sparkSession.sparkContext.broadcast(small_counts(coded, size, head))
    tokens = (coded.agg(F.sum(F.length("ids"))).first()[0] or 0) // 2

    def head_scores(batches):
        model = shared.value
        top = model.head.shape[2]
        for batch in batches:
            for part in chunks(batch, range(batch.num_columns), CODED_BYTES):
                rows = []
                for rid, ids, marked in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if ids:
                        p = Pairs(ids, size, head)
                        h = p.head
                        first = p.first[h]
                        pair = [m[np.where(first == size, top, first), p.second[h]] for m in model.head]
                        both = model.both(pair, p.numbers[h], first, p.own_first[h], p.second[h], p.own_second[h],
                                          int(marked), len(p.words))
                        rows.append((rid, *sums(both, lambda x: float((x * p.numbers[h]).sum()))))
                yield table(rows, ("rid", "gap", "every"), (pa.int64(), pa.float64(), pa.float32()))

    parts = max(LEAST_PARTS, ceil(tokens / PART_TOKENS))

    def open_pairs(batches):
        for batch in batches:
            for part in chunks(batch, range(batch.num_columns), CODED_BYTES):
                columns = [[] for _ in BLOCK_COLUMNS]
                for rid, ids, marked in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if ids:
                        p = Pairs(ids, size, head)
                        o = ~p.head
                        n = int(o.sum())
                        row = (p.keys[o], np.full(n, rid), p.numbers[o], p.own_first[o], p.own_second[o],
                               np.full(n, len(p.words)), np.full(n, marked))
                        for column, values, (_, kind) in zip(columns, row, BLOCK_COLUMNS, strict=True):
                            column.append(values.astype(kind))
                if not columns[0]:
                    continue
                joined = [np.concatenate(c) for c in columns]
                buckets = mixed(joined[0]) % (parts * BUCKETS_PER_PART)
                order = np.argsort(buckets, kind="stable")
                joined, buckets = [c[order] for c in joined], buckets[order]
                cuts = np.flatnonzero(np.diff(buckets)) + 1
                edges = [0, *cuts.tolist(), len(buckets)] if len(buckets) else [0]
                blocks = [pack([c[i:j] for c in joined]) for i, j in zip(edges, edges[1:], strict=False)]
                yield pa.record_batch([pa.array(buckets[edges[:-1]].astype(np.int64)), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def pair_scores(batches):
        model = shared.value
        blocks = [unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not blocks:
            return
        key, rid, number, own_first, own_second, length, marked = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        kinds, place = np.unique(key, return_inverse=True)
        pair = [np.bincount(place, number * m, len(kinds))[place] for m in (marked, 1)]
        first, second = np.divmod(key.astype(np.int64), size + 1)
        both = model.both(pair, number, first, own_first, second, own_second, marked, length)
        rids, place = np.unique(rid, return_inverse=True)
        found = sums(both, lambda x: np.bincount(place, x * number, len(rids)))
        yield pa.record_batch([pa.array(rids), pa.array(found[0]), pa.array(found[1].astype(np.float32))], ["rid", "gap", "every"])

    source = coded.select("rid", "ids", "marked")
    spread = source.mapInArrow(open_pairs, "bucket long, block binary").repartition(parts, "bucket").select("bucket", "block")
    losses_ = source.mapInArrow(head_scores, FOUND).union(spread.mapInArrow(pair_scores, FOUND)).groupBy("rid").agg(
        F.sum("gap").alias("gap"), F.sum("every").alias("every")
    )
    number = (F.length("ids") / 2).cast("long")
    named = coded.select("rid", "doc_id", number.alias("tokens")).join(losses_, "rid", "left")
    every, gap = F.col("every") / F.col("tokens"), F.col("gap") / F.col("tokens")
    return named.select(
        "doc_id", "tokens", (every + gap).alias("loss_target"), every.alias("loss_background"), gap.alias("score")
    )


def sums(both, add):
    """Sums of (target - background) and of the background loss; the difference is taken before rounding."""
    target, every = both
    return add(target - every), add(every)


def table(rows: list[tuple], names, kinds) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
