"""Reproducible row assignment from a hash of the row id.

The bucket depends only on the seed and the id, never on partitioning or on the
order in which rows arrive, so a recomputed task puts each row where it was.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_digits(seed: int | Column, *ids: Column) -> Column:
    """The first 8 hex digits of md5('seed:id[:id...]'); their order is that of the numbers."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", first, *[c.cast("string") for c in ids])
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def id_hash(seed: int | Column, *ids: Column) -> Column:
    """32-bit number from the first 8 hex digits of md5('seed:id[:id...]')."""
    return F.conv(hash_digits(seed, *ids), 16, 10).cast("bigint")


def in_holdout(*ids: Column, percent: int = 33, seed: int = 7) -> Column:
    """True for the rows of the held-out part."""
    return (id_hash(seed, *ids) % 100) < percent


def fold_of(*ids: Column, folds: int = 3, seed: int = 7) -> Column:
    """Fold number in [0, folds)."""
    return (id_hash(seed, *ids) % folds).cast("int")
