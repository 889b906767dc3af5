"""Dimension lookups and removal of rows by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.labels import or_unseen
from flowlens.schema import UNKNOWN

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a table by one aggregation, of which each task sends a row."""
    size = sum(
        (
            F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 8
            for f in df.schema.fields
        ),
        F.lit(0),
    )
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """Hint a broadcast only for a table whose measured size allows it.

    Anything larger joins by shuffle, where adaptive execution splits the
    partition of a hot key.
    """
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def map_labels(
    df: DataFrame,
    label: str,
    dimension: DataFrame,
    key: str,
    value: str,
    unseen: str = UNKNOWN,
    output: str | None = None,
) -> DataFrame:
    """Look up ``label`` in a dimension with unique keys; every row of ``df`` stays."""
    output = output or value
    dim = dimension.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = join_level(df, dim, F.col(label))
    return joined.withColumn(
        output, or_unseen(F.col("_value"), F.col(label), unseen)
    ).drop("_key", "_value")


def join_level(df: DataFrame, dim: DataFrame, level: Column, **limits: int) -> DataFrame:
    """Left join of a level with the column ``_key`` of a dimension with unique keys.

    Beyond a broadcast, rows without a level take no part in the shuffle, where they
    would all meet in one partition.
    """
    if fits_broadcast(dim, **limits):
        return df.join(F.broadcast(dim), level == F.col("_key"), "left")
    found = df.where(level.isNotNull()).join(dim, level == F.col("_key"), "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema.fields]
    return found.unionByName(df.where(level.isNull()).select("*", *none))


def drop_ids(df: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Remove the rows whose keys occur in ``ids``."""
    return df.join(ids.select(*keys), list(keys), "left_anti")


def union_ids(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The set of ids that occur in any of the tables."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out.distinct()
