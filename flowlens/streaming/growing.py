"""Capture files that grow while they are read.

A trigger reads what was added to the files of a folder since the last one, up to the
last whole record, and notes for each file how far it came: the byte, the number of
frames, and the blocks that later frames depend on. Frames and notes are one write; a
trigger counts once that write is complete, and one that broke off is done again from
the same notes. So every record is read once, whenever its bytes arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.captures import BATCH_BYTES, BATCH_ROWS, PATTERN, list_captures
from flowlens.sources.formats import FILE_HEADER, SECTION, Capture, Damaged, is_packed

_ROWS = (
    "note boolean, file string, idx bigint, us bigint, linktype int, caplen int, len int, frame binary, "
    "stop bigint, state binary"
)
_SCHEMA = pa.schema(
    [
        ("note", pa.bool_()), ("file", pa.string()), ("idx", pa.int64()), ("us", pa.int64()),
        ("linktype", pa.int32()), ("caplen", pa.int32()), ("len", pa.int32()), ("frame", pa.binary()),
        ("stop", pa.int64()), ("state", pa.binary()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, f.type) for values, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA
    )


def _added(path: str, length: int, stop: int, idx: int, state: bytes) -> Iterator[tuple]:
    """The frames of whole records from ``stop`` on, and a note of how far they go."""
    if length >= FILE_HEADER and length > stop:
        if is_packed(path):
            raise ValueError(f"a packed file cannot be read on: {path}")
        with Capture(path) as capture:
            form = capture.form
            form.restore(state)
            stop = max(stop, form.begin)
            try:
                for position, record, size in capture.records(stop, length):
                    # Bytes behind the listed length are for the next trigger.
                    if len(record) < size or position + size > length:
                        break
                    found = form.frame(record)
                    kept = form.kept(record)
                    state = kept if kept[:4] == SECTION.to_bytes(4, "big") else state + kept
                    if found:
                        yield False, path, idx, *found, None, None
                        idx += 1
                    stop = position + size
            except Damaged:
                raise capture.damaged() from None
    yield True, path, idx, None, None, None, None, None, stop, state


def _read_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            held, size = [], 0
            for found in _added(row["path"], row["length"], row["stop"], row["idx"], row["state"]):
                held.append(found)
                size += len(found[7] or b"")
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)


def _is_done(spark: SparkSession, store: str, trigger: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/trigger={trigger}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_on(spark: SparkSession, folder: str, store: str, pattern: str = PATTERN) -> int:
    """Read what the files of ``folder`` have that earlier triggers did not read; returns the
    trigger's number. ``store`` belongs to this folder alone and keeps frames and notes.

    What was added to a file is read by one task. Packed files are refused.
    """
    trigger = 0
    while _is_done(spark, store, trigger):
        trigger += 1
    files = list_captures(spark, folder, pattern).select("path", "length")
    if trigger:
        notes = spark.read.schema(_ROWS).parquet(f"{store}/trigger={trigger - 1}").where("note")
        notes = notes.select(F.col("file").alias("path"), "idx", "stop", "state")
        # A file that is gone keeps its note, so that it is not read again if it comes back.
        files = files.join(notes, "path", "full")
    else:
        files = files.withColumns(
            {"idx": F.lit(0).cast("bigint"), "stop": F.lit(0).cast("bigint"), "state": F.lit(b"")}
        )
    files = files.fillna(0, ["length", "idx", "stop"]).withColumn("state", F.coalesce("state", F.lit(b"")))
    tasks = spark.sparkContext.defaultParallelism
    files.repartition(tasks, "path").mapInArrow(_read_on, _ROWS).write.mode("overwrite").parquet(
        f"{store}/trigger={trigger}"
    )
    return trigger


def frames_read(spark: SparkSession, store: str, trigger: int | None = None) -> DataFrame:
    """The frames that all finished triggers read, or one of them."""
    done = 0
    while _is_done(spark, store, done):
        done += 1
    wanted = range(done) if trigger is None else [trigger]
    paths = [f"{store}/trigger={t}" for t in wanted if t < done]
    rows = spark.read.schema(_ROWS).parquet(*paths) if paths else spark.createDataFrame([], _ROWS)
    return rows.where("not note").select(
        "file", "idx", F.timestamp_micros("us").alias("ts"), "linktype", "caplen", "len", "frame"
    )
