"""Column selection, renaming and separation of features and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.schema import feature_columns


def select_features(df: DataFrame, features, *keep: str) -> DataFrame:
    """Project a feature set (14, 16, 41 or a list) plus the columns in ``keep``."""
    return df.select(*feature_columns(features), *keep)


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cast_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(label).cast("double"))


def split_features_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The columns other than the label, and the label column."""
    return df.select(*[c for c in df.columns if c != label]), df.select(label)
