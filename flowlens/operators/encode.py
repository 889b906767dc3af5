"""Nominal columns: indexing by frequency and one-hot encoding."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.lookup import join_level
from flowlens.session import materialize

SINGLE_TASK_ROWS = 1_000_000
WIDE_LEVELS = 1_000


def number_rows(
    df: DataFrame, order: list, output: str = "position", task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Number the rows 0, 1, ... in a total order, without one task seeing all rows.

    Small tables use a plain window. Larger ones are range-partitioned by Spark and
    stored; each stored part is then numbered on its own and shifted by the number
    of rows in the parts before it. Storing fixes the part boundaries, so a task
    that runs again cannot see other ones.
    """
    rows = df.count()
    if rows <= task_rows:
        return df.withColumn(
            output, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1
        )
    parts = -(-rows // task_rows)
    stored = materialize(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    sizes = dict(stored.groupBy("_part").count().collect())
    shifts = list(accumulate((sizes.get(part, 0) for part in range(parts)), initial=0))
    shift = F.element_at(F.lit(shifts).cast("array<bigint>"), F.col("_part") + 1)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return stored.withColumn(output, (shift + local).cast("bigint")).drop("_part")


def _cells(columns: list[str]):
    """One row per nominal column: its name and its value as text."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                for c in columns
            ]
        )
    )


def count_levels(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Rows per level of all columns, ``column, level, n``, and the levels per column.

    One pass counts all columns. Its result, one row per level, is stored, because
    the steps from here on read it several times. A missing value is no level.
    """
    counts = materialize(
        df.select(_cells(columns))
        .where("level is not null")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n")),
        "levels",
    )
    sizes = dict(counts.groupBy("column").count().collect())
    return counts, {c: sizes.get(c, 0) for c in columns}


def frequency_levels(
    df: DataFrame, columns: list[str], task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Levels of nominal columns: ``column, level, n, index``, most frequent first.

    Indexes start at 0 in each column; equal counts are ordered by the level.
    """
    counts, sizes = count_levels(df, columns)
    order = [F.desc("n"), F.asc("level")]
    few = [c for c in columns if sizes[c] <= task_rows]
    rank = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    numbered = [
        counts.where(F.col("column").isin(few)).withColumn("index", rank.cast("bigint") - 1)
    ]
    numbered += [
        number_rows(counts.where(F.col("column") == c), order, "index", task_rows)
        for c in columns
        if c not in few
    ]
    return reduce(DataFrame.unionByName, numbered)


def _join_index(df: DataFrame, levels: DataFrame, column: str, output: str) -> DataFrame:
    found = levels.where(F.col("column") == column).select(
        F.col("level").alias("_key"), F.col("index").cast("double").alias(output)
    )
    return join_level(df, found, F.col(column).cast("string")).drop("_key")


def index_by_frequency(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Append ``<column>_index`` for each column; unseen and missing levels get null."""
    levels = frequency_levels(df if fit_on is None else fit_on, columns)
    for c in columns:
        df = _join_index(df, levels, c, f"{c}_index")
    return df


def collect_levels(df: DataFrame, columns: list[str], max_levels: int = WIDE_LEVELS) -> dict:
    """Sorted levels of each column; fails beyond ``max_levels`` instead of cutting."""
    pairs = df.select(_cells(columns)).where("level is not null").distinct()
    rows = pairs.limit(max_levels * len(columns) + 1).collect()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for column, level in rows:
        levels[column].append(level)
    for column, found in levels.items():
        if len(found) > max_levels:
            raise ValueError(
                f"{column} has more than {max_levels} levels: use the sparse encoding"
            )
    return {c: sorted(found) for c, found in levels.items()}


def onehot_wide(
    df: DataFrame,
    columns: list[str],
    levels: dict[str, list[str]] | None = None,
    max_levels: int = WIDE_LEVELS,
) -> DataFrame:
    """Replace nominal columns by one 0/1 column per level, named ``column=level``."""
    levels = levels or collect_levels(df, columns, max_levels)
    dummies = [
        F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}={v}")
        for c in columns
        for v in levels[c]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *dummies)


def onehot_long(
    df: DataFrame, columns: list[str], keys: list[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Sparse one-hot form: ``column, index`` of the single 1, per record and column."""
    indexed = index_by_frequency(df.select(*keys, *columns), columns, fit_on or df)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_index").cast("bigint").alias("index"))
        for c in columns
    ]
    return indexed.select(*keys, F.inline(F.array(*cells))).where("index is not null")
