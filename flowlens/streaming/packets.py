"""Packets from capture files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions import packets as P
from flowlens.operators.layers import dissect
from flowlens.sources.captures import PATTERN, frames_of

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_capture(
    spark: SparkSession,
    path: str,
    pattern: str = PATTERN,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """Streaming frames of the capture files in a folder, each file once.

    A trigger takes so many files, or whole files of so many bytes, at most one of the two.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return frames_of(reader.load(path), **options)


def packet_lines(frames: DataFrame) -> DataFrame:
    """Per packet: time text, layer chain, length and one-line summary.

    Works on batch and on streaming frames alike.
    """
    layers = F.col("layers")
    return dissect(frames).select(
        "file",
        "idx",
        P.time_text(F.col("ts")).alias("time"),
        F.array_join(P.layer_chain(layers), " ").alias("chain"),
        F.col("size").alias("length"),
        P.summary(layers).alias("summary"),
    )


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a parquet table, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
