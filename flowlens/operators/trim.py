"""Removal of the most extreme rows of numeric columns.

The number of rows to remove grows with the table, so they are never sorted into one
task or collected. The cut-off of each end is found from the number of rows per value:
these counts are stored in ranges of ascending values, the sums of the ranges name the
one that holds the cut-off, and only that range is looked into. Rows that share the
cut-off value are cut by key in the same way. Values and keys are compared in their own
types, so integers of any size, infinities and text keys are exact; removing the rows is
then a plain filter on literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import discard, materialize

RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Cut:
    """The last row to take: its value, and its key unless all of that value go."""

    value: object
    key: object
    from_top: bool

    def takes(self, value: Column, key: Column) -> Column:
        limit = F.lit(self.value)
        beyond = value > limit if self.from_top else value < limit
        ties = F.lit(True) if self.key is None else key <= F.lit(self.key)
        return F.coalesce(_is_number(value) & (beyond | ((value == limit) & ties)), F.lit(False))


def _is_number(value: Column) -> Column:
    """Neither missing nor NaN."""
    return value.isNotNull() & (F.lower(value.cast("string")) != "nan")


def _ranges(weights: DataFrame, range_rows: int) -> DataFrame:
    """Rows ``x, n`` stored in ranges of ascending ``x``. Storing fixes the ranges, so a
    task that runs again cannot see other ones."""
    parts = max(1, -(-weights.count() // range_rows))
    by_range = weights.repartitionByRange(parts, "x").withColumn("_part", F.spark_partition_id())
    return materialize(by_range, "ranges")


def _locate(ranges: DataFrame, need: int, from_top: bool) -> tuple:
    """The ``x`` at which the weights from one end reach ``need``, what is still wanted of
    it, and its weight."""
    sums = ranges.groupBy("_part").agg(F.sum("n")).collect()
    for part, total in sorted(sums, reverse=from_top):
        if need <= total:
            break
        need -= total
    order = F.desc("x") if from_top else F.asc("x")
    run = F.sum("n").over(Window.partitionBy("_part").orderBy(order))
    found = (
        ranges.where(F.col("_part") == part)
        .withColumn("run", run)
        .where(F.col("run") >= need)
        .orderBy("run")
        .first()
    )
    return found["x"], need - (found["run"] - found["n"]), found["n"]


def find_cuts(
    df: DataFrame, column: str, key: str, count: int, range_rows: int = RANGE_ROWS
) -> tuple[Cut | None, Cut | None]:
    """Cut-offs of the ``count`` smallest and of the ``count`` largest rows.

    Equal values go by ascending key at both ends; keys are unique. Rows without a value
    or a key are never taken. The table is read once for the counts and once for the
    keys of the two cut-off values.
    """
    pairs = df.select(F.col(column).alias("x"), F.col(key).alias("k")).where(
        _is_number(F.col("x")) & F.col("k").isNotNull()
    )
    counts = materialize(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = min(count, total)
    if count <= 0:
        discard(counts)
        return None, None
    ranges = _ranges(counts, range_rows)
    ends = {from_top: _locate(ranges, count, from_top) for from_top in (False, True)}
    values = [x for x, wanted, n in ends.values() if wanted < n]
    keys = materialize(pairs.where(F.col("x").isin(values)), "ties") if values else None
    cuts = []
    for from_top, (value, wanted, n) in ends.items():
        last = None
        if wanted < n:
            own = keys.where(F.col("x") == F.lit(value)).select(F.col("k").alias("x"), F.lit(1).alias("n"))
            by_key = _ranges(own, range_rows)
            last = _locate(by_key, wanted, False)[0]
            discard(by_key)
        cuts.append(Cut(value, last, from_top))
    for stored in (counts, ranges, keys):
        if stored is not None:
            discard(stored)
    return tuple(cuts)


def trim_extremes(
    df: DataFrame,
    columns: list[str],
    key: str,
    per_mille: float = 1.0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Drop the highest and the lowest rows of each column, column after column.

    The number dropped at each end is ``per_mille`` thousandths of the rows of the
    table as given. A column sees what the columns before it left. Equal values go
    in the order of ``key``.
    """
    needed = materialize(df.select(key, *[c for c in dict.fromkeys(columns) if c != key]), "trim")
    count, left = int(needed.count() * per_mille / 1000 + 0.5), needed
    for c in columns:
        for cut in find_cuts(left, c, key, count, range_rows):
            if cut is not None:
                stays = ~cut.takes(F.col(c), F.col(key))
                left, df = left.where(stays), df.where(stays)
    discard(needed)
    return df
