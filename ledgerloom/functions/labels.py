"""Label arrays: taxonomy order, set comparison with duplicates kept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import TAXONOMY


def taxonomy() -> Column:
    return F.array(*[F.lit(name) for name in TAXONOMY])


def in_taxonomy(labels: Column) -> Column:
    """True when every label is a taxonomy name (an empty list is fine)."""
    unknown = F.array_except(labels, taxonomy())
    return F.coalesce(F.size(unknown) == 0, F.lit(False))


def merged(receipt_labels: Column, item_labels: Column) -> Column:
    """Labels of the receipt and of its items together, in taxonomy order."""
    return F.array_intersect(taxonomy(), F.array_union(receipt_labels, item_labels))


def missing(expected: Column, got: Column) -> Column:
    """Entries of ``expected`` absent from ``got``; repeated entries stay repeated."""
    return F.filter(expected, lambda x: ~F.array_contains(got, x))


def spurious(expected: Column, got: Column) -> Column:
    return missing(got, expected)


def hits(expected: Column, got: Column) -> Column:
    return F.filter(got, lambda x: F.array_contains(expected, x))


def same_labels(expected: Column, got: Column) -> Column:
    """Equal once sorted; a repeated label makes two lists different."""
    return F.array_sort(expected) == F.array_sort(got)
