"""One row per key, repeated keys, and key-based filters.

A key may be shared by a third of all rows, so nothing here puts all rows of a
key into one task: aggregates combine before the shuffle and the repeat
marking works on slices of a key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def one_per_key(
    df: DataFrame, keys: str | Sequence[str], eligible: Column | None = None
) -> DataFrame:
    """Keep the smallest eligible row, in column order, of every key.

    A plain aggregate: each input partition reduces its copies to one row
    before anything is shuffled, and the winner does not depend on row order.
    ``eligible`` is judged inside the aggregate: a filter below it would be
    pushed under the projection that parses the columns and parse them again.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return (df if eligible is None else df.where(eligible)).distinct()
    row = F.struct(*rest)
    if eligible is not None:
        row = F.when(eligible, row)
    best = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    if eligible is not None:
        best = best.where(F.col("_row").isNotNull())
    return best.select(
        *[F.col(name) if name in keys else F.col(f"_row.{name}").alias(name) for name in df.columns]
    )


def mark_repeats(df: DataFrame, key: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Add a flag that is true on every row of a key but its first in ``order``.

    Keys are counted first, from the key alone and combined before the shuffle.  Rows of keys that occur once,
    nearly all, are done then; only the others are ranked.  Full ties of ``order`` go by a hash of the row,
    so the result does not depend on how rows are dealt.  Rows with a blank key are never repeats.

    Ranking takes two steps.  The first is inside (key, input partition), so a group is never larger than
    what one task read anyway; the leaders of these slices are then ranked per key, at most one row per input
    partition.  Rows already known to be repeats keep to their slice in the second step.
    """
    keyed = df.withColumn("_key", F.nullif(key, F.lit("")))
    several = keyed.groupBy(F.col("_key").alias("_several")).agg(F.count("*").alias("_n")).where("_n > 1 AND _several IS NOT NULL")
    known = keyed.join(several.select("_several"), F.col("_key") == F.col("_several"), "left")
    once = known.where(F.col("_several").isNull()).withColumn(name, F.lit(False))
    sliced = known.where(F.col("_several").isNotNull()).select(
        "*", F.xxhash64(*df.columns).alias("_hash"),
        F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().alias("_line"),
    )
    # The line number decides between rows that are equal in every column only.
    ranking = [*order, F.col("_hash"), F.col("_line")]
    ranked = sliced.withColumn("_local", F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(*ranking)))
    leader_or_slice = F.when(F.col("_local") == 1, F.lit(-1)).otherwise(F.col("_slice"))
    overall = F.row_number().over(Window.partitionBy("_key", leader_or_slice).orderBy(*ranking))
    repeated = ranked.withColumn("_overall", overall).withColumn(name, (F.col("_local") > 1) | (F.col("_overall") > 1))
    return once.select(*df.columns, name).union(repeated.select(*df.columns, name))


def newest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int
) -> DataFrame:
    """The first ``limit`` rows of each key in ``order``.

    The filter on ``row_number`` lets Spark keep only ``limit`` rows per key and
    input partition before the shuffle (WindowGroupLimit).
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def with_known_key(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs in ``parents`` (semi join)."""
    return df.join(parents.select(key).distinct(), key, "left_semi")


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks, each with its row count.

    The child is reduced to (key, count) first, so a hot key costs one row.
    """
    counts = child.where(F.col(child_key).isNotNull()).groupBy(
        F.col(child_key).alias("orphan_key")
    ).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias("orphan_key")).distinct()
    return counts.join(known, "orphan_key", "left_anti")
