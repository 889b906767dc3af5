"""Table readers and result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.schema import ATTACK_TYPE_SCHEMA, CONNECTION_SCHEMA, FIELD_ROLE_SCHEMA

CORRUPT = "corrupt_record"
NULL_TEXT = "\\N"


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    mode: str = "FAILFAST",
    null_text: str = "",
) -> DataFrame:
    """Header-less CSV with a given schema.

    ``FAILFAST`` stops at a malformed row; ``PERMISSIVE`` keeps it, with its text in
    the column ``corrupt_record``. Cells equal to ``null_text`` are null.
    """
    options = {"mode": mode, "nullValue": null_text}
    if mode.upper() == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options["columnNameOfCorruptRecord"] = CORRUPT
    return spark.read.csv(path, schema=schema, **options)


def read_connections(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Connection records."""
    return read_typed_csv(spark, path, CONNECTION_SCHEMA, mode)


def read_attack_types(spark: SparkSession, path: str) -> DataFrame:
    """Attack names and their categories; rows may be separated by CR only."""
    return read_typed_csv(spark, path, ATTACK_TYPE_SCHEMA)


def read_field_roles(spark: SparkSession, path: str) -> DataFrame:
    """Field names and whether they are continuous or symbolic."""
    return read_typed_csv(spark, path, FIELD_ROLE_SCHEMA)


def read_points(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Points ``f1 .. fn`` with a class name; blank lines are no rows."""
    schema = T.StructType(
        [T.StructField(f"f{i + 1}", T.DoubleType()) for i in range(n_features)]
        + [T.StructField("class", T.StringType())]
    )
    return read_typed_csv(spark, path, schema)


def read_named(spark: SparkSession, path: str, names: list[str], label: str) -> DataFrame:
    """Numeric table with supplied column names and an integer class column."""
    schema = T.StructType(
        [
            T.StructField(name, T.IntegerType() if name == label else T.DoubleType())
            for name in names
        ]
    )
    return read_typed_csv(spark, path, schema)


def write_typed_csv(df: DataFrame, path: str, null_text: str = NULL_TEXT) -> None:
    """CSV that ``read_typed_csv`` with the same ``null_text`` reads back unchanged.

    A null text of its own keeps empty strings apart from missing ones, and blanks
    around a text stay. What the format cannot hold fails instead of coming back as
    something else: a text equal to ``null_text`` (unless that is empty) or with a line
    break.
    """

    def stored(name: str) -> Column:
        value = F.col(f"`{name}`")
        lost = value.rlike("[\\r\\n]")
        if null_text:
            lost = lost | (value == null_text)
        message = F.concat(F.lit(f"{name} has a text that CSV does not keep: "), value)
        return F.when(lost, F.raise_error(message).cast("string")).otherwise(value).alias(name)

    rows = df.select(
        *[
            stored(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
    rows.write.csv(
        path,
        nullValue=null_text,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_leaderboard(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("overwrite").save(path)
