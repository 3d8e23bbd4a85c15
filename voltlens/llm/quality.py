"""Document quality with histogram gradient-boosted trees over document statistics.

Statistics of a whole text (lengths, character classes, repetition, line shapes) are computed in one
narrow stage and written once; labels join these few numbers, never the texts.  Trees are fitted on
at most ``SAMPLE`` labelled rows chosen by hash: quantile bins, per-level gradient histograms, second-
order gains.  The fitted trees are flat arrays (feature, threshold, children, value), and scoring
walks all rows of a batch down a tree at once in numpy.

Cases: null and empty texts have all statistics 0 and still get a score; rows with a missing label
do not train; without any label, or with one class only, the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns, stored

SAMPLE = 20_000
TREES = 80
DEPTH = 4
RATE = 0.15
BINS = 64
RIDGE = 1.0
LEAST_ROWS = 10

STATISTICS = (
    "chars", "words", "word_length", "letters", "upper", "digits", "spaces", "marks", "high_bytes",
    "distinct_words", "top_word", "lines", "line_length", "repeated_lines", "short_lines", "end_marks",
    "symbols", "long_words", "entropy", "pair_repeats", "plain_words", "separators",
)

BYTE = np.arange(256)
LETTER = (BYTE >= 65) & (BYTE <= 90) | (BYTE >= 97) & (BYTE <= 122)
UPPER = (BYTE >= 65) & (BYTE <= 90)
DIGIT = (BYTE >= 48) & (BYTE <= 57)
SPACE = (BYTE == 32) | (BYTE >= 9) & (BYTE <= 13)
HIGH = BYTE >= 128
MARK = ~(LETTER | DIGIT | SPACE | HIGH)
STOP = np.isin(BYTE, [ord(c) for c in ".,;:!?'\"()"])
SEPARATOR = np.isin(BYTE, [ord(c) for c in "|<>{}[]\\/=_~^`"])


def statistics(text: bytes | None) -> list[float]:
    """The numbers of ``STATISTICS`` for one text; shares lie between 0 and 1."""
    if not text:
        return [0.0] * len(STATISTICS)
    size = len(text)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda mask: float(bytes_[mask].sum()) / size
    words = text.split()
    number = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    rows = max(1, len(lines))
    used = bytes_[bytes_ > 0] / size
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), sum(map(len, words)) / number,
        share(LETTER), share(UPPER), share(DIGIT), share(SPACE), share(MARK), share(HIGH),
        len(counts) / number, max(counts.values(), default=0) / number,
        float(np.log1p(len(lines))), float(np.log1p(size / rows)), 1 - len(set(lines)) / rows if lines else 0.0,
        sum(len(x) < 30 for x in lines) / rows, sum(x.rstrip()[-1:] in b".!?" for x in lines) / rows,
        share(MARK & ~STOP), sum(len(w) > 20 for w in words) / number, float(-(used * np.log2(used)).sum()),
        1 - pairs / (len(words) - 1) if len(words) > 1 else 0.0, sum(map(bytes.isalpha, words)) / number,
        share(SEPARATOR),
    ]


def add_statistics(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``stats``, an array of doubles in the order of ``STATISTICS``."""

    def start():
        return lambda texts: [[statistics(t) for t in texts]]

    return add_columns(docs, [text_col], [T.StructField("stats", T.ArrayType(T.DoubleType()))], start, keep)


@dataclass
class Trees:
    """Boosted trees as flat arrays; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                low = rows[every, self.feature[at]] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees for labels 0 and 1 by logistic loss."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(labels) and 0 < labels.sum() < len(labels):
        cuts = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(rows.shape[1])]
        binned = np.stack([np.searchsorted(c, rows[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        total = np.full(len(labels), base)
        for _ in range(TREES):
            p = 1.0 / (1.0 + np.exp(-total))
            root, moved = grow(binned, cuts, labels - p, p * (1 - p), nodes)
            roots.append(root)
            total += moved
    table = np.array(nodes).reshape(-1, 5)
    whole = table[:, [0, 2, 3]].astype(np.int64)
    return Trees(base, np.array(roots, np.int64), whole[:, 0], table[:, 1], whole[:, 1], whole[:, 2], table[:, 4], DEPTH)


def grow(binned, cuts, gradient, weight, nodes) -> tuple[int, np.ndarray]:
    """One tree, level by level; appends its nodes and returns its root and the score of each row."""
    rows, width = binned.shape
    place = np.zeros(rows, np.int64)
    root = len(nodes)
    nodes.append([0, np.inf, root, root, 0.0])
    level = [root]
    for _ in range(DEPTH):
        if not level:
            break
        slot = np.full(len(nodes), -1)
        slot[level] = np.arange(len(level))
        here = slot[place + root]
        live = here >= 0
        key = ((here[live, None] * width + np.arange(width)) * BINS + binned[live]).ravel()
        size = len(level) * width * BINS
        shape = (len(level), width, BINS)
        hist = [
            np.bincount(key, np.repeat(v[live], width) if v is not None else None, size).reshape(shape)
            for v in (gradient, weight, None)
        ]
        lows = [np.cumsum(h, axis=2) for h in hist]
        sums = [x[:, :1, -1:] for x in lows]
        (g, h, n), (gs, hs, ns) = lows, sums
        gain = g**2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
        gain = np.where((n >= LEAST_ROWS) & (ns - n >= LEAST_ROWS), gain, -1.0).reshape(len(level), -1)
        after = []
        for i, node in enumerate(level):
            best = int(gain[i].argmax())
            if gain[i, best] <= 1e-9:
                continue
            k, cut = divmod(best, BINS)
            left, right = len(nodes), len(nodes) + 1
            nodes[node] = [k, float(cuts[k][cut]), left, right, 0.0]
            for child in (left, right):
                nodes.append([0, np.inf, child, child, 0.0])
            mine = live & (here == i)
            place[mine] = np.where(binned[mine, k] <= cut, left, right) - root
            after += [left, right]
        level = after
    count = len(nodes) - root
    value = RATE * np.bincount(place, gradient, count) / (np.bincount(place, weight, count) + RIDGE)
    for i in range(count):
        nodes[root + i][4] = float(value[i])
    return root, value[place]


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str, limit: int = SAMPLE, seed: int = 23):
    """At most ``limit`` labelled rows of statistics, chosen by a hash of their id."""
    known = labels.select("doc_id", F.col(label_col).alias("label")).where("label in (0, 1) and doc_id is not null")
    count = known.count()
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000))
    near = known.where(place < F.lit(2.0 * limit / max(1, count) * 1_000_000))
    rows = (
        near.join(stats, "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label")
        .select("stats", "label").limit(limit).toPandas()
    )
    table = np.array(rows["stats"].tolist(), float).reshape(-1, len(STATISTICS))
    return table, rows["label"].to_numpy(float)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", limit: int = SAMPLE,
) -> DataFrame:
    """One row per document: ``doc_id`` and ``score``, from trees fitted on ``labels`` (``doc_id``, label)."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    stats = stored(add_statistics(slim, keep=["doc_id"]), "stats")
    trees = fit(*training_rows(stats, labels, label_col, limit))

    def start():
        def work(rows):
            return [trees.score(np.array(rows, float).reshape(-1, len(STATISTICS)))]

        return work

    return add_columns(stats, ["stats"], [T.StructField("score", T.DoubleType())], start, keep=["doc_id"])
