"""Checks on frame headers; they read the schema only and start no job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` naming, in sorted order, every column ``df`` lacks."""
    absent = sorted(set(names).difference(df.columns))
    if absent:
        raise ValueError(f"{what} lacks required columns: {', '.join(absent)}")


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first of ``candidates`` that ``df`` has, or ``None``."""
    have = set(df.columns)
    return next((name for name in candidates if name in have), None)
