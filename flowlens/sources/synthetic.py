"""Seeded synthetic tables for demonstrations and tests.

Every number is computed from a hash of seed, row and column, so it does not
depend on how the rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *parts: Column) -> Column:
    """Number in (0, 1) from a 53-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _normal(seed: int, *parts: Column) -> Column:
    """Standard normal number, by the Box-Muller transform."""
    radius = F.sqrt(-2.0 * F.log(_uniform(seed, F.lit("r"), *parts)))
    return radius * F.cos(2.0 * math.pi * _uniform(seed, F.lit("a"), *parts))


def blobs(
    spark: SparkSession,
    n: int,
    centers: int = 2,
    dims: int = 2,
    seed: int = 1,
    spread: float = 1.0,
    box: float = 10.0,
) -> DataFrame:
    """Gaussian clusters: ``id, x1 .. xd, y`` with centres in [-box, box]."""
    cluster = F.col("id") % centers
    columns = [
        (
            (_uniform(seed, F.lit("c"), cluster, F.lit(d)) * 2 - 1) * box
            + spread * _normal(seed, F.col("id"), F.lit(d))
        ).alias(f"x{d + 1}")
        for d in range(dims)
    ]
    return spark.range(n).select("id", *columns, cluster.cast("int").alias("y"))


def linear_points(
    spark: SparkSession,
    n: int,
    coefficients: list[float],
    noise: float = 0.1,
    seed: int = 1,
) -> tuple[DataFrame, list[float]]:
    """Normal features with a noisy linear target, and the true coefficients."""
    xs = [F.col(f"x{d + 1}") for d in range(len(coefficients))]
    points = spark.range(n).select(
        "id",
        *[
            _normal(seed, F.col("id"), F.lit(d)).alias(f"x{d + 1}")
            for d in range(len(coefficients))
        ],
    )
    target = sum((c * x for c, x in zip(coefficients, xs)), F.lit(0.0))
    return (
        points.withColumn("y", target + noise * _normal(seed, F.col("id"), F.lit("noise"))),
        list(coefficients),
    )
