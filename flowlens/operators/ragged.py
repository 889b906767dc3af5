"""Union of tables whose columns differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_ragged(*tables: DataFrame) -> DataFrame:
    """Append tables by column name; a column a table lacks is null for its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
