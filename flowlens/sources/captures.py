"""Capture files as tables of frames, in batch and as a stream.

Spark lists the files; their contents never pass through the file listing. Formats are
told by their first bytes: classic and next-generation captures, either of them packed
by gzip. A file up to ``split_bytes`` is read by one task, record after record, and so is
a packed one of any size, because it can only be unpacked from its start.

The place of a record is known only from the one before it. A larger file is cut into
byte ranges all the same: each range guesses where its first record begins, by a chain
of likely headers, and follows the records to the next range. The guess is right if the
range before ends there, and by induction from the start of the file so are all if all
agree. Ranges that do not agree follow the records again from where the one before
ended, and only those. Then the ranges are read, and all further work done, by many
tasks. In a stream, where a step cannot look at results of the one before, and for a
prefix, which ends early, one task follows the records of a file.

A file that still grows while it is streamed is read once, up to its listed length:
stream folders of closed files. Memory per task is bounded by the read buffer, not by
the size of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import materialize
from flowlens.sources.formats import (
    GUESS_BYTES,
    SECTION,
    Capture,
    Damaged,
    first_record,
    is_packed,
)

SPLIT_BYTES = 64 << 20
TASK_BYTES = 1 << 20  # a task has at least so many bytes to read, however small the splits
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
ROUNDS = 3  # of following ranges again that do not agree
GUESSES = 8  # of where the records of a range begin

#: Names that capture files usually have.
PATTERN = "*.{pcap,pcapng,cap,pcap.gz,pcapng.gz,cap.gz}"

_SPLITS = "path string, start bigint, stop bigint, first bigint, state binary"
_RANGES = (
    "path string, length bigint, number bigint, start bigint, stop bigint, "
    "frames bigint, sections bigint, kept binary"
)
_FRAMES = (
    "file string, idx bigint, us bigint, linktype int, caplen int, len int, frame binary"
)


# --- reading, inside tasks ------------------------------------------------------------


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, f.type) for values, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _sequential_ranges(path: str, split_bytes: int, first: int | None):
    """Ranges of about ``split_bytes`` that begin at a record, by following the records."""
    with Capture(path) as capture:
        if capture.packed:
            yield path, 0, None, 0, b""
            return
        form = capture.form
        start, begun, number, end = form.begin, 0, 0, form.begin
        kept, state = b"", b""
        try:
            for position, record, size in capture.records():
                if first is not None and number >= first:
                    break
                if position - start >= split_bytes:
                    yield path, start, position, begun, state
                    start, begun, state = position, number, kept
                fresh = form.kept(record)
                kept = fresh if fresh[:4] == SECTION.to_bytes(4, "big") else kept + fresh
                number += form.is_frame(record)
                end = position + size
        except Damaged:
            raise capture.damaged() from None
        if end > start:
            # The last range also sees what is cut off.
            yield path, start, end if first is not None else None, begun, state


_SPLIT_SCHEMA = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()), ("state", pa.binary())]
)


def _find_ranges(split_bytes: int, first: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = list(_sequential_ranges(path, split_bytes, first))
                if rows:
                    yield _batch(rows, _SPLIT_SCHEMA)

    return run


def _follow(path: str, start: int | None, begin: int, stop: int):
    """Where the records of a range begin and end, how many frames and sections they have,
    and what later ranges depend on. Without a ``start`` it is guessed, and guessed anew
    where following it meets what no record can be; a range that has no likely one has no
    start, and one that is damaged from a given start on has no end. A range inside a long
    record begins and ends behind it."""
    if start is not None or begin == 0:
        return _followed(path, start, begin, stop)
    guess = begin
    for _ in range(GUESSES):
        with Capture(path) as capture:
            guess = first_record(capture.form, capture.source, guess, stop + 4 * GUESS_BYTES)
        if guess is None:
            break
        found = _followed(path, guess, begin, stop)
        if found[1] is not None:
            return found
        guess += 1
    return None, None, 0, 0, b""


def _followed(path: str, start: int | None, begin: int, stop: int):
    with Capture(path) as capture:
        form = capture.form
        start = form.begin if begin == 0 else start
        end, frames, sections, kept = start, 0, 0, b""
        try:
            for position, record, size in capture.records(start, stop):
                end = position + size
                fresh = form.kept(record)
                if fresh[:4] == SECTION.to_bytes(4, "big"):
                    sections, kept = sections + 1, b""
                kept += fresh
                frames += form.is_frame(record)
        except Damaged:
            end = None
        return start, end, frames, sections, kept


_RANGE_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("length", pa.int64()), ("number", pa.int64()), ("start", pa.int64()),
        ("stop", pa.int64()), ("frames", pa.int64()), ("sections", pa.int64()), ("kept", pa.binary()),
    ]
)


def _follow_ranges(split_bytes: int):
    """Rows ``path, length, number, start`` to ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["number"] * split_bytes
                found = _follow(row["path"], row["start"], begin, min(row["length"], begin + split_bytes))
                yield _batch([(row["path"], row["length"], row["number"], *found)], _RANGE_SCHEMA)

    return run


def _mark_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [is_packed(path) for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(packed, pa.bool_())], names=[*batch.schema.names, "packed"]
        )


def _frame_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [
        pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()
    ]
    names = ["file", "idx", "us", "linktype", "caplen", "len", "frame"]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, t) for values, t in zip(zip(*rows), types)], names=names
    )


def _read_ranges(first: int | None, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                rows, size, idx = [], 0, split["first"]
                with Capture(split["path"]) as capture:
                    for _, us, link, caplen, length, frame in capture.frames(
                        split["start"], split["stop"], split["state"] or b"", strict
                    ):
                        if first is not None and idx >= first:
                            break
                        rows.append((split["path"], idx, us, link, caplen, length, frame))
                        idx, size = idx + 1, size + len(frame)
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _frame_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _frame_batch(rows)

    return run


# --- Spark side ------------------------------------------------------------------------


def _disagreeing(ranges: DataFrame, split_bytes: int) -> DataFrame:
    """Ranges with ``wrong``, whether the range before does not end at their start, ``again``,
    where they are to start then, and ``sound``, how far the file is known to be right.

    Up to the first one that disagrees all ranges of a file are right, and where they end
    starts every range that is reached by their last record; others start again where the
    one before ended.
    """
    order, whole = Window.partitionBy("path").orderBy("number"), Window.partitionBy("path")
    marked = ranges.withColumn("again", F.lag("stop").over(order)).withColumn(
        "wrong", (F.col("number") > 0) & ~F.coalesce(F.col("start") == F.col("again"), F.lit(False))
    )
    marked = marked.withColumn("_first", F.min(F.when(F.col("wrong"), F.col("number"))).over(whole))
    marked = marked.withColumn(
        "sound", F.max(F.when(F.col("number") == F.col("_first"), F.col("again"))).over(whole)
    )
    reached = F.col("number") * split_bytes <= F.col("sound")
    return marked.withColumn("again", F.when(reached, F.col("sound")).otherwise(F.col("again"))).drop("_first")


def parallel_ranges(listed: DataFrame, split_bytes: int, tasks: int) -> DataFrame:
    """Splits of unpacked files (``path, length``) whose ranges were followed by many tasks.

    Ranges that disagree are followed again, in a few rounds; in a file where some still do,
    all records are followed by one task.
    """
    cut = listed.select(
        "path",
        "length",
        F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(length - 1) div {split_bytes}"), F.lit(0)))).alias("number"),
        F.lit(None).cast("bigint").alias("start"),
    )
    follow = _follow_ranges(split_bytes)
    ranges = materialize(
        cut.repartition(tasks, "path", "number").mapInArrow(follow, _RANGES), "capture-ranges"
    )
    for round_ in range(ROUNDS + 1):
        checked = _disagreeing(ranges, split_bytes)
        wrong = checked.where("wrong")
        left, broken = wrong.agg(
            F.count("*"), F.min(F.when(F.col("sound").isNull(), F.col("path")))
        ).first()
        if broken:
            raise ValueError(f"damaged record in {broken}")
        if not left or round_ == ROUNDS:
            break
        again = wrong.where("again is not null").select(
            "path", "length", "number", F.col("again").alias("start")
        )
        others = checked.where("not wrong or again is null").select(*ranges.columns)
        ranges = materialize(
            others.unionByName(again.repartition(tasks, "path", "number").mapInArrow(follow, _RANGES)),
            "capture-ranges",
        )
    agreed = _splits(ranges)
    if not left:
        return agreed
    # Files full of what looks like records, or of records that do not.
    odd = materialize(wrong.select("path").distinct(), "odd-captures")
    followed = odd.mapInArrow(_find_ranges(split_bytes, None), _SPLITS)
    return agreed.join(odd, "path", "left_anti").unionByName(followed)


def _splits(ranges: DataFrame) -> DataFrame:
    """What readers need of ranges that agree."""
    order = Window.partitionBy("path").orderBy("number")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # What a range depends on was kept since the last range with a section header.
    since = Window.partitionBy("path", "group").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.aggregate(
        F.collect_list("kept").over(since), F.lit(b""), lambda joined, piece: F.concat(joined, piece)
    )
    begun = F.sum((F.col("sections") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("number"))) == 1
    return (
        ranges.withColumn("first", F.coalesce(F.sum("frames").over(so_far), F.lit(0)))
        .withColumn("group", begun)
        .withColumn("after", kept)
        .withColumn("state", F.lag("after").over(order))
        # The last range also sees what is cut off.
        .withColumn("stop", F.when(~last, F.col("stop")))
        .where("stop is null or stop > start")
        .select("path", "start", "stop", "first", "state")
    )


def frames_of(
    files: DataFrame,
    first: int | None = None,
    split_bytes: int = SPLIT_BYTES,
    tasks: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Frames of the listed files (``path, length``), in the order ``idx`` per file.

    ``first`` keeps the first records of each file and stops reading there. The
    ranges of large files are spread over ``tasks`` tasks, by default one for each
    ``split_bytes`` (a megabyte at least) of them, in a stream the number of shuffle partitions; their number
    is given because adaptive execution would join the few bytes that describe them into
    one task. A frame shorter than its ``caplen`` was cut off at the end of its file;
    ``strict`` fails there, and where a file ends within a record header. Frames that
    come without a time have a null one.
    """
    spark = files.sparkSession
    listed = files.select("path", "length")
    large = listed.where(F.col("length") > split_bytes)
    if tasks is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not files.isStreaming:
            size = large.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
            tasks = max(spark.sparkContext.defaultParallelism, -(-size // max(split_bytes, TASK_BYTES)))
    whole = listed.where(F.col("length") <= split_bytes)
    if files.isStreaming or first is not None:
        splits = large.mapInArrow(_find_ranges(split_bytes, first), _SPLITS)
    else:
        marked = large.mapInArrow(_mark_packed, "path string, length bigint, packed boolean")
        marked = materialize(marked, "captures")
        whole = whole.unionByName(marked.where("packed").drop("packed"))
        splits = parallel_ranges(marked.where("not packed").drop("packed"), split_bytes, tasks)
    whole = whole.select(
        "path",
        F.lit(0).cast("bigint").alias("start"),
        F.lit(None).cast("bigint").alias("stop"),
        F.lit(0).cast("bigint").alias("first"),
        F.lit(None).cast("binary").alias("state"),
    )
    divided = splits.repartition(tasks, "path", "start")
    read = _read_ranges(first, strict)
    frames = whole.mapInArrow(read, _FRAMES).unionByName(divided.mapInArrow(read, _FRAMES))
    return frames.select(
        "file",
        "idx",
        F.timestamp_micros("us").alias("ts"),
        "linktype",
        "caplen",
        "len",
        "frame",
    )


def list_captures(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """Paths and lengths of capture files; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )


def read_capture(spark: SparkSession, path: str, pattern: str = PATTERN, **options) -> DataFrame:
    """Frames of all capture files below ``path``."""
    return frames_of(list_captures(spark, path, pattern), **options)
