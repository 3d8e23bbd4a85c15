"""Benchmark decontamination with an Aho-Corasick automaton over word windows.

Texts are normalised to words (A-Z lower-cased; digits, letters and everything beyond ASCII make
words).  Every run of ``window`` consecutive words of a benchmark item is a pattern; an item with
fewer words, but not none, is one pattern.  Patterns are sequences of word numbers in one
automaton, so a text is scanned once whatever the number of items.  Word positions are mapped back
to code-point offsets of the original text.

A benchmark is a stated query set of any size: it is taken in blocks of about ``block_bytes`` of
text, one automaton and one pass each, so neither the driver nor a task holds more than a block.  One
block, the usual case, is one narrow pass; the hits of several are written per distinct text, gathered by
text hash and joined back.

Cases: null and empty texts have no words and are clean; null or word-less items never match; items
that repeat (or share windows) are all named; an item without an id is named ``null``; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns, plain_names, stored, text_key

WINDOW = 10
BLOCK_BYTES = 1_000_000

#: Bytes to words: A-Z lower-cased, digits, a-z and all bytes beyond ASCII kept, the rest blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_words", T.ArrayType(RANGE)),
    T.StructField("hit_spans", T.ArrayType(RANGE)),
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Matcher:
    """One automaton over a block of items."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        named: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                named.setdefault(ids[at : at + size], set()).add(name)
        self.patterns = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in named.items():
            self.patterns.add_word(key, (len(key), tuple(names)))
        if named:
            self.patterns.make_automaton()
        self.empty = not named

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges (end exclusive) covered by patterns, and the items behind them."""
        if self.empty or not words:
            return [], set()
        number = self.number.get
        ranges: list[tuple[int, int]] = []
        names: set[str] = set()
        for last, (size, found) in self.patterns.iter(tuple([number(w, 0) for w in words])):
            ranges.append((last - size + 1, last + 1))
            names.update(found)
        return merged(ranges), names


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of words."""
    if not ranges:
        return []
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    starts, ends = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


class Benchmark:
    """Items in blocks of about ``block_bytes``; a block is fetched when it is asked for."""

    def __init__(self, table: DataFrame, text_col: str, item_col: str, block_bytes: int):
        self.items = table.select(
            F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"),
            F.col(text_col).cast("string").cast("binary").alias("text"),
        ).where("text is not null").distinct()
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = max(1, -(-total // block_bytes))

    def block(self, number: int) -> list[tuple[str, bytes]]:
        rows = self.items.where(F.pmod(F.xxhash64("name", "text"), F.lit(self.blocks)) == number)
        return sorted((r["name"], bytes(r["text"])) for r in rows.toLocalIterator())


_LOADED: dict[str, Matcher] = {}


def matcher(items: Sequence[tuple[str, bytes]], window: int, key: str) -> Matcher:
    """The automaton of a block, built once per Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Matcher(items, window)
    return _LOADED[key]


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    benchmark_text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with the columns of ``FIELDS``.

    ``n_words`` and ``n_hit`` count words, ``items`` names the items found (sorted as strings),
    ``hit_words`` and ``hit_spans`` are the hit passages as word and as code-point ranges.
    """
    source = Benchmark(benchmark, benchmark_text_col, item_col, block_bytes)
    if source.blocks == 1:
        return add_columns(docs, [text_col], FIELDS, scanner(source.block(0), window), keep)
    packed = docs.select(
        F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"),
        docs[text_col].alias("text"), *text_key(docs[text_col]),
    )
    hits = None
    for number in range(source.blocks):
        part = add_columns(packed.select("k1", "k2", "text"), ["text"], FIELDS, scanner(source.block(number), window), ["k1", "k2"])
        part = stored(part.where("n_hit > 0").select("k1", "k2", "items", "hit_words").dropDuplicates(["k1", "k2"]), "hits")
        hits = part if hits is None else hits.union(part)
    hits = hits.groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hit_words")).alias("hit_words")
    )
    joined = packed.join(hits, ["k1", "k2"], "left")
    found = add_columns(joined, ["text", "items", "hit_words"], FIELDS, scanner([], window), ["row"])
    new = [f.name for f in FIELDS]
    old = docs.columns if keep is None else keep
    return found.select(*[F.col("row")[c].alias(c) for c in old if c.lower() not in new], *new)


def scanner(items: Sequence[tuple[str, bytes]], window: int):
    digest = hashlib.sha256(repr((items, window)).encode()).hexdigest()

    def start():
        machine = matcher(items, window, digest)

        def work(texts, known=None, before=None):
            out: list[list] = [[], [], [], [], []]
            for at, text in enumerate(texts):
                words = words_of(text)
                ranges, names = machine.scan(words)
                if before is not None and before[at]:
                    ranges = merged(ranges + [(r["start"], r["end"]) for r in before[at]])
                    names |= set(known[at])
                spans = original_spans(text, ranges) if ranges else []
                row = (
                    len(words), sum(b - a for a, b in ranges), sorted(names),
                    [{"start": a, "end": b} for a, b in ranges],
                    [{"start": a, "end": b} for a, b in spans],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return start


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, columns as they came."""
    plain, back = plain_names(docs, text=text_col)
    return scan_documents(plain, benchmark, **options).where("n_hit = 0").select(*back)
