"""Distances and norms over ``array<double>`` columns, and vector conversion."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    """Distance of order ``p``; orders 1 and 2 are the two above."""
    if p == 1:
        return manhattan(a, b)
    if p == 2:
        return euclidean(a, b)
    return F.pow(
        _total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))),
        F.lit(1.0 / p),
    )


def l1_norm(a: Column) -> Column:
    return _total(F.transform(a, lambda x: F.abs(x)))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def densify(vector: Column) -> Column:
    """Sparse to dense vector without leaving the JVM."""
    return array_to_vector(vector_to_array(vector))


def vector_size(vector: Column) -> Column:
    """Number of entries of a vector, zeros included; a sparse one is not filled up."""
    parts = F.unwrap_udt(vector)
    return F.coalesce(parts["size"], F.size(parts["values"]))


def value_at(vector: Column, position: int) -> Column:
    """One entry of a vector, null beyond its end; a sparse one is not filled up."""
    parts = F.unwrap_udt(vector)
    stored = F.array_position(parts["indices"], F.lit(position)).cast("int")
    sparse = F.when(stored > 0, F.get(parts["values"], stored - 1)).when(parts["size"] > position, 0.0)
    return F.when(parts["type"] == 0, sparse).otherwise(F.get(parts["values"], F.lit(position)))


def active_indices(vector: Column) -> Column:
    """Positions of the non-zero entries of a vector; a sparse one is not filled up."""
    parts = F.unwrap_udt(vector)
    # Dense vectors have no stored positions.
    return F.filter(
        F.transform(
            parts["values"],
            lambda x, i: F.when(x != 0.0, F.when(parts["type"] == 0, F.get(parts["indices"], i)).otherwise(i)),
        ),
        lambda i: i.isNotNull(),
    )
