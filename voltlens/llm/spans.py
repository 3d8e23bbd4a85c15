"""Spans of pattern matches with DataFrame functions only.

Spark's pattern functions give matches but no places.  The pieces between the matches (``split`` with the
same pattern) have the lengths that are missing: a match starts after all pieces and matches before it.
Running sums are taken in blocks of ``BLOCK``, so texts with very many matches stay affordable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern (never matching nothing) and what a match must satisfy."""

    name: str
    pattern: str
    holds: Callable[[Column], Column] | None = None


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running(steps: Column) -> Column:
    """Running sums of an array of longs."""

    def block(b: Column) -> Column:
        part = F.struct(
            total(F.slice(steps, F.lit(1), b * BLOCK)).alias("before"),
            F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)).alias("own"),
        )
        return let(part, lambda p: F.transform(p["own"], lambda _, i: p["before"] + total(F.slice(p["own"], F.lit(1), i + 1))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    return F.flatten(F.transform(blocks, block))


def distances(hits: Column, gaps: Column) -> Column:
    """From the start of the match before (or of the text) to the start of each match."""
    return F.transform(
        hits, lambda _, i: (gaps[i] + F.when(i == 0, 0).otherwise(F.length(F.get(hits, i - 1)))).cast("bigint")
    )


def placed(hits: Column) -> Callable[[Column], Column]:
    return lambda starts: F.transform(hits, lambda m, i: F.struct(
        starts[i].alias("start"), (starts[i] + F.length(m)).alias("end"), m.alias("hit")))


def holding(kind: Kind) -> Callable[[Column], Column]:
    return lambda s: kind.holds(s["hit"])


def add_spans(df: DataFrame, text_col: str, kinds: Sequence[Kind]) -> DataFrame:
    """``df`` with one array of (start, end, hit) per kind, named after it; code points, end exclusive.

    Matches are leftmost and do not overlap within a kind; those that fail ``holds`` are dropped
    after matching, without another try.  Null and empty texts have no spans.
    """
    text = df[text_col]
    none = F.array().cast("array<string>")
    lengths = F.array().cast("array<int>")
    cut = df
    for k in kinds:
        some = text.rlike(k.pattern)
        cut = cut.withColumns({
            f"_hits_{k.name}": F.when(some, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none),
            f"_gaps_{k.name}": F.when(some, F.transform(F.split(text, k.pattern, -1), F.length)).otherwise(lengths),
        })
    for k in kinds:
        hits = F.col(f"_hits_{k.name}")
        ahead = distances(hits, F.col(f"_gaps_{k.name}"))
        cut = cut.withColumn(f"_gaps_{k.name}", F.when(F.size(hits) > 0, ahead).otherwise(F.array().cast("array<bigint>")))
    for k in kinds:
        hits = F.col(f"_hits_{k.name}")
        found = let(running(F.col(f"_gaps_{k.name}")), placed(hits))
        if k.holds:
            found = F.filter(found, holding(k))
        cut = cut.withColumn(k.name, F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPAN)))
    return cut.drop(*[f"_{part}_{k.name}" for part in ("hits", "gaps") for k in kinds])


def tagged(kinds: Sequence[str]) -> Column:
    """All spans of the kinds as one array of (start, end, place of the kind, kind)."""
    def named(place: int, name: str) -> Column:
        return F.transform(name, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(place).alias("place"), F.lit(name).alias("kind")))

    return F.concat(*[named(i, name) for i, name in enumerate(kinds)])


def listing(spans: Column, *, by_kind: bool) -> Column:
    """``kind:start:end``, comma-joined, by kind and start or by start and kind."""
    first = ("place", "start") if by_kind else ("start", "place")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s[first[0]].cast("bigint").alias("a"), s[first[1]].cast("bigint").alias("b"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["start"].alias("start"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its ``mask``; overlapping spans become one, masked as the first."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done, s):
        fresh = F.concat(
            F.substr(text, (done["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - done["at"]).cast("int")), s["mask"]
        )
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(fresh))).otherwise(done["parts"]).alias("parts"),
        )

    def finish(done):
        return F.concat(F.array_join(done["parts"], ""), F.substr(text, (done["at"] + 1).cast("int")))

    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, finish)).otherwise(text)
