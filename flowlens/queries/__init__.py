"""Registered queries with, where SQL can express them, an equivalent SQL text.

Each module has ``QUERIES`` (name -> callable of session and table folder) and
``ORACLES`` (name -> SQL over the same tables). Both sides name the columns alike
and round to six places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, name: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, ROUND).alias(name)
