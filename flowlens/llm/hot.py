"""Joins with one row per group, where a group may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

SHARE = 1000  # a group that more than one grouped row in so many is in is hot: fewer than so many are
ROWS = 10_000  # and no group of fewer rows is


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str) -> DataFrame:
    """``rows`` joined, inner or left, with ``groups``, which have one row per ``key``.

    Groups of which ``size`` says that they hold more than one in ``SHARE`` of all grouped
    rows are fewer than ``SHARE`` and go to the rows; the rows of all others meet their
    group by a shuffle in which no key is hot. ``rows`` should be stored, as it is read twice.
    """
    groups = materialize(groups, "groups")
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(ROWS, total // SHARE)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    rest = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key, how))
