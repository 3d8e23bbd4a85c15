"""Predicates on raw text columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def trimmed(name: str) -> Column:
    return F.trim(F.col(name))


def blank(name: str) -> Column:
    """True for null and for text of spaces only; never null."""
    return F.coalesce(trimmed(name) == "", F.lit(True))


def present(name: str) -> Column:
    return ~blank(name)


def folded_in(name: str, allowed: Iterable[str]) -> Column:
    """Membership of the trimmed, lower-cased text; null text gives null."""
    return F.lower(trimmed(name)).isin(*allowed)
