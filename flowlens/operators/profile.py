"""Column statistics, all columns in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, sample standard deviation, max, min and counts."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("stddev"),
                F.max(c).cast("double").alias("max"),
                F.min(c).cast("double").alias("min"),
                F.count(c).alias("n_values"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[
                    F.col(f"s{i}.{name}").alias(name)
                    for name in ("mean", "stddev", "max", "min", "n_values")
                ],
            )
            for i, c in enumerate(columns)
        ]
    )
    return stats.select("n_rows", F.inline(entries))


def min_max(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of every column, from one job.

    NaN does not count as a value; a column without values gives ``(None, None)``.
    """
    aggs = []
    for c in columns:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.min(value), F.max(value)]
    row = df.agg(*aggs).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
