"""Ordered list algebra on arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most sources an element keeps, and the most file paths (fixed values).
MOST_SOURCES, MOST_PATHS = 300, 100


def union(old: Column, new: Column) -> Column:
    """Distinct elements in order of first occurrence, old before new, without nulls and ''."""
    return F.array_distinct(F.filter(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))


def cap(items: Column, most: int = MOST_SOURCES, keep: str = "FIFO") -> Column:
    """At most ``most``: the last ones (FIFO) or the first ones (KEEP)."""
    if most <= 0:
        return F.array().cast("array<string>")
    if keep == "KEEP":
        return F.slice(items, 1, most)
    return F.when(F.size(items) > most, F.slice(items, -most, most)).otherwise(items)


def cap_paths(paths: Column, most: int = MOST_PATHS, keep: str = "FIFO") -> Column:
    """Capped file paths, with a last entry that says so."""
    note = "...truncated...(FIFO)" if keep == "FIFO" else "...truncated...(KEEP Old)"
    return F.when(F.size(paths) > most, F.concat(cap(paths, most, keep), F.array(F.lit(note)))).otherwise(paths)


def subtract(items: Column, gone: Column) -> Column:
    """Items that are not among ``gone``; order and repeats stay."""
    return F.filter(items, lambda x: ~F.array_contains(gone, x))


def keywords(items: Column) -> Column:
    """Comma lists merged: split, trimmed, distinct, sorted, joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(items, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != ""))), ",")
