"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A sketch has a fixed number of bins. In every round each shingle falls into one bin by
a new hash, and the first round that reaches a bin, with its smallest hash there, fills
it; after as many rounds as bins, round k aims all shingles at bin k. So every bin is
filled, whatever the size of the set, after few rounds for large sets, and the share of
equal bins estimates the similarity with the concentration of independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.linking import SetFilter, link_groups, lookup
from flowlens.llm.words import distinct, hashes, mix, shingles, tokenize, unused
from flowlens.session import materialize

BANDS, ROWS = 40, 6  # at a similarity of 0.8 a pair shares no band once in 190,000 pairs
WORDS = 16  # numbers of 64 bits that stand for a set, to rule out pairs
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BATCH = 256


def sketches(values: np.ndarray, owner: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """One row of ``bins`` numbers per text; a text without shingles keeps empty bins."""
    out = np.full(texts * bins, _EMPTY)
    waiting = np.bincount(owner, minlength=texts) > 0
    for turn in range(2 * bins):
        if not len(values):
            break
        h = mix(values + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64)))
        if turn < bins:
            place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            place = turn - bins
        # Later rounds give larger numbers, so a filled bin stays as it is.
        value = (np.uint64(turn) << np.uint64(40)) | (mix(h) >> np.uint64(24))
        np.minimum.at(out, owner * bins + place, value)
        full = (out.reshape(texts, bins) != _EMPTY).all(axis=1)
        if (full & waiting).any():
            left = ~full[owner]
            values, owner = values[left], owner[left]
            waiting &= ~full
    return out.reshape(texts, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per text and band; equal for equal rows of the same band only."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    key = mix(key * np.uint64(0xD6E8FEB86659FD93))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def set_bits(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """``WORDS`` numbers per text; every shingle sets one of their bits."""
    size = 64 * WORDS
    on = np.zeros((texts, size), bool)
    on[owner, (mix(values ^ np.uint64(0x77)) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(on, axis=1).view(np.int64)


def _rows_of(numbers: np.ndarray) -> pa.ListArray:
    n, width = numbers.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(numbers.ravel())
    )


def shingle_sets(texts: list[bytes | None], size: int):
    """Distinct shingle hashes of texts with their texts, ordered by text, then hash."""
    ids, ends, vocabulary = tokenize(texts)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return distinct(*shingles(hashes(vocabulary)[ids], ends, size))


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_a, set_b, bands, bits``; the two sums stand for the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(begin, _BATCH)
                n = batch.num_rows
                values, owner = shingle_sets(batch.column(1).to_pylist(), size)
                counts = np.bincount(owner, minlength=n)
                sums = []
                for salt in (0x51, 0xA3):
                    total = np.zeros(n + 1, np.uint64)
                    np.add.at(total, owner, mix(values ^ np.uint64(salt)))
                    sums.append(total[:n].view(np.int64))
                keys = band_keys(sketches(values, owner, n, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array(counts.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        _rows_of(np.ascontiguousarray(keys).view(np.int64)),
                        _rows_of(set_bits(values, owner, n)),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return docs.mapInArrow(
        run,
        "doc_id bigint, text_hash bigint, n_shingles bigint, set_a bigint, set_b bigint, "
        "bands array<bigint>, bits array<bigint>",
    )


def _similar(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``a, b, text_a, text_b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(begin, _BATCH)
                n = batch.num_rows
                both = batch.column(2).to_pylist() + batch.column(3).to_pylist()
                values, owner = shingle_sets(both, size)
                sizes = np.bincount(owner, minlength=2 * n)
                pair = owner % n
                order = np.lexsort((values, pair))
                value, pair = values[order], pair[order]
                twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][twice], minlength=n)
                union = sizes[:n] + sizes[n:] - common
                linked = pa.array((100 * common >= percent * union) & (common > 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(linked), batch.column(1).filter(linked)], names=["a", "b"]
                )

    return texts.mapInArrow(run, "a bigint, b bigint")


def _rare_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``bucket, id, lead, far`` of ``id, text``: texts that are similar enough share a bucket.

    The shingles of a text are put in order, those first that few of the texts have. Sets
    that have so much in common share one of the first, of which the smaller set needs
    fewer: there it leads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(begin, _BATCH)
                values, owner = shingle_sets(batch.column(1).to_pylist(), size)
                sizes = np.bincount(owner, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(values.view(np.int64)), pa.array(sizes[owner])],
                    names=["id", "bucket", "size"],
                )

    sets = materialize(texts.mapInArrow(run, "id bigint, bucket bigint, size bigint"), "sets")
    often = sets.groupBy("bucket").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "bucket"))
    placed = sets.join(often, "bucket").withColumn("place", place)
    # Of x and y, x not smaller, at least percent of x and 2 * percent / (100 + percent) of y are shared.
    probes = f"size - ({percent} * size + 99) div 100 + 1"
    leads = f"size - (2 * {percent} * size + 99 + {percent}) div (100 + {percent}) + 1"
    return placed.where(f"often > 1 and place <= {probes}").select(
        "bucket", "id", F.expr(f"place <= {leads}").alias("lead"), F.lit(0).alias("far")
    )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A text's set has its distinct runs of ``size`` words, A-Z in lower case; a shorter
    text's whole sequence is its one run. Two texts are linked if 100 * intersection is
    at least ``percent`` * union of their full sets; ``component_id`` is the smallest id
    that links reach. Texts with equal sets are one before any comparing, so copies make
    no pairs. Null, empty and blank texts have no runs and are linked with nothing.

    Rows of one id are kept or dropped as their texts are: a repeated row is kept with
    its twin. Rows without an id keep a null component, are linked with nothing, and are
    kept. An empty table gives an empty result.
    """
    # A row is known by its id and the hash of its text, a class by that of its first row.
    rows_in = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        F.xxhash64(F.col(text).cast("binary")).alias("text_hash"),
    )
    signed = materialize(_signatures(rows_in, size, bands, rows), "signatures")
    has_set = signed.where("n_shingles > 0 and doc_id is not null")
    of_set = ["set_a", "set_b", "n_shingles"]
    classes = has_set.groupBy(*of_set).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = materialize(
        classes.select(*of_set, "first.doc_id", "first.text_hash", F.xxhash64(*of_set).alias("id")), "classes"
    )
    members = has_set.join(classes, [*of_set, "doc_id", "text_hash"]).select(
        F.explode("bands").alias("bucket"), "id", F.lit(True).alias("lead")
    )

    def texts_of(ids: DataFrame) -> DataFrame:
        few = ids.count()
        needed = classes.join(lookup(ids, few), "id").select("doc_id", "text_hash", "id")
        rows = rows_in.join(lookup(needed, few), ["doc_id", "text_hash"])
        return rows.dropDuplicates(["id"]).select("id", "text")

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = materialize(texts_of(ids), "texts")
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return _similar(both.select("a", "b", "text_a", "text_b"), size, percent)

    bits = has_set.join(classes, [*of_set, "doc_id", "text_hash"]).select(
        "id", F.col("n_shingles").alias("size"), *[F.get("bits", F.lit(i)).alias(f"bits{i}") for i in range(WORDS)]
    )
    groups = link_groups(
        members, confirm, SetFilter(bits.dropDuplicates(["id"]), percent),
        finer=lambda ids: _rare_shingles(texts_of(ids), size, percent),
    )
    named = classes.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("_smallest"))
    named = materialize(named.join(smallest, "component").select(*of_set, "_smallest"), "named")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_smallest", "doc_id"))
    return (
        signed.join(lookup(named), of_set, "left")
        .withColumn("component_id", own)
        .select(
            "doc_id", "n_shingles", "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose document is in a group with a smaller id."""
    gone = near_duplicates(docs, doc_id=doc_id, text=text, **options).where(~F.col("kept"))
    (name,) = unused(docs.columns, "gone")
    gone = materialize(gone.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(lookup(gone), F.col(doc_id).cast("bigint") == F.col(name), "left_anti")
