"""Exact duplicates by an exchange of compressed fingerprints.

A pass over the documents cuts each partition into senders of bounded size. A sender's
distinct fingerprints, 48 bits of a hash, go sorted and Golomb-coded to the owners of
their ranges, one message for each owner. An owner, who sees all fingerprints of its
range, answers every message with a bitmap of those that others have too; with what
repeats inside a sender that makes a bitmap over the sender's rows. Only rows whose bit
is set are suspects, and only their texts are shuffled, to be grouped byte by byte;
every other row is known to be alone without its text having moved.

What is stored in the pass (rows, messages, and each row's place in its sender's list)
comes from one attempt of a task, so places and rows always belong together.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowlens.llm.hot import join_groups
from flowlens.operators.lookup import broadcast_if_small
from flowlens.session import materialize

BITS = 48  # of a fingerprint; a false match only makes a suspect
SENDER_ROWS = 1 << 20  # rows of a sender at most
MAX_OWNERS = 1 << 14
SPACE = b" \t\n\x0b\x0c\r"


# Golomb codes


def encode(values: np.ndarray, low: int) -> bytes:
    """Golomb code of sorted distinct numbers, none below ``low``.

    The divisor is the power of two next below ln 2 times the mean gap. Quotients, in
    unary, and remainders stand apart, so that numpy can read all of them at once.
    """
    gaps = np.diff(values, prepend=low - 1) - 1
    width = max(0, int(np.log2(max(1.0, 0.69 * float(gaps.mean())))))
    quotients, rest = gaps >> width, gaps & ((1 << width) - 1)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    bits = np.unpackbits(rest.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]
    quotient_bytes = np.packbits(unary).tobytes()
    head = struct.pack("<IBI", len(values), width, len(quotient_bytes))
    return head + quotient_bytes + np.packbits(bits).tobytes()


_HEAD = struct.calcsize("<IBI")


def decode(code: bytes, low: int) -> np.ndarray:
    """The numbers that ``encode`` was given."""
    n, width, size = struct.unpack_from("<IBI", code)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, _HEAD))
    quotients = np.diff(np.flatnonzero(unary == 0)[:n], prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=_HEAD + size), count=n * width)
    whole = np.zeros((n, 64), np.uint8)
    whole[:, 64 - width :] = bits.reshape(n, width)
    rest = np.packbits(whole, axis=1).view(">u8").ravel().astype(np.int64)
    return low - 1 + np.cumsum((quotients << width) + rest + 1)


def lowest(owner: int, owners: int) -> int:
    """The first fingerprint of an owner's range."""
    return -(-(owner << BITS) // owners)


# What tasks do


def _messages(fingerprints: np.ndarray, owners: int) -> tuple[list[int], list[bytes], bytes]:
    """A sender's owners, what it sends them, and where in its list each row is."""
    values, places = np.unique(fingerprints, return_inverse=True)
    cuts = np.searchsorted(values, [lowest(o, owners) for o in range(owners)] + [1 << BITS])
    sent = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
    codes = [encode(values[cuts[o] : cuts[o + 1]], lowest(o, owners)) for o in sent]
    return sent, codes, places.astype("<u4").tobytes()


def _send(owners: int, schema: pa.Schema, sender_rows: int):
    """Rows with their fingerprints' digests; after each sender's rows, its messages."""

    def extra(sender: int, held: list[np.ndarray]) -> pa.RecordBatch:
        sent, codes, places = _messages(np.concatenate(held), owners)
        n = len(sent) + 1
        known = {
            "kind": pa.array(["message"] * len(sent) + ["places"]),
            "sender": pa.array([sender] * n, pa.int64()),
            "owner": pa.array([*sent, None], pa.int32()),
            "payload": pa.array([*codes, places], pa.binary()),
        }
        columns = [known.get(f.name, pa.nulls(n, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId() << 32
        held, count = [], 0
        for whole in batches:
            begin = 0
            while begin < whole.num_rows:
                batch = whole.slice(begin, min(whole.num_rows - begin, sender_rows - count))
                begin += batch.num_rows
                raw = batch.column(1).cast(pa.binary()).to_pylist()
                texts = [b"" if t is None else t.translate(None, SPACE) for t in raw]
                hashed = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
                held.append((hashed >> np.uint64(64 - BITS)).astype(np.int64))
                known = {
                    "kind": pa.array(["row"] * len(texts)),
                    "sender": pa.array(np.full(len(texts), sender)),
                    "slot": pa.array(np.arange(count, count + len(texts), dtype=np.int32)),
                    "doc": batch.column(0),
                    "n_chars": pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
                    "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    "text": pa.array(texts, pa.binary()).cast(schema.field("text").type),
                }
                columns = [known.get(f.name, pa.nulls(len(texts), f.type)) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                count += len(texts)
                if count == sender_rows:
                    yield extra(sender, held)
                    sender, held, count = sender + 1, [], 0
        if count:
            yield extra(sender, held)

    return run


def _answer(owners: int):
    """Bitmaps for all messages of an owner: which fingerprints other senders have too."""

    def run(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        low = lowest(owner, owners)
        lists = [decode(code.as_buffer(), low) for code in table.column("payload")]
        values = np.concatenate(lists)
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        shared = np.zeros(len(values), np.uint8)
        shared[order[1:][same]] = 1
        shared[order[:-1][same]] = 1
        ends = np.cumsum([len(x) for x in lists])
        return pa.table(
            {
                "sender": table.column("sender"),
                "owner": table.column("owner"),
                "n": pa.array([len(x) for x in lists], pa.int32()),
                "payload": pa.array([np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])], pa.binary()),
            }
        )

    return run


def _suspects(table: pa.Table) -> pa.Table:
    """The bitmap over a sender's rows, from its places and the owners' answers."""
    rows = sorted(table.to_pylist(), key=lambda r: -1 if r["owner"] is None else r["owner"])
    places = np.frombuffer(rows[0]["payload"], "<u4")
    shared = np.concatenate(
        [np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=r["n"]) for r in rows[1:]]
    )
    marked = shared[places].astype(bool) | (np.bincount(places)[places] > 1)
    bits = [np.packbits(marked, bitorder="little").tobytes()] if marked.any() else []
    return pa.table(
        {"sender": pa.array([rows[0]["sender"]] * len(bits), pa.int64()), "bits": pa.array(bits, pa.binary())}
    )


# Steps


def exchange(docs: DataFrame, text: str, carry: list[str], sender_rows: int = SENDER_ROWS) -> tuple[DataFrame, DataFrame]:
    """The stored rows ``sender, slot, doc, n_chars, sha, text``, ``doc`` holding the columns
    ``carry``, and ``sender, bits`` with a bit for each suspect."""
    spark = docs.sparkSession
    owners = min(MAX_OWNERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(text).alias("text"))
    schema = (
        T.StructType().add("kind", "string").add("sender", "long").add("slot", "integer").add("owner", "integer")
        .add("doc", given.schema["doc"].dataType).add("n_chars", "long").add("sha", "string")
        .add("text", "string").add("payload", "binary")
    )
    stored = materialize(given.mapInArrow(_send(owners, to_arrow_schema(schema), sender_rows), schema), "senders")
    messages = stored.where("kind = 'message'").select("sender", "owner", "payload")
    answers = messages.groupBy("owner").applyInArrow(
        _answer(owners), "sender bigint, owner int, n int, payload binary"
    )
    places = stored.where("kind = 'places'").select("sender", "owner", F.lit(None).cast("int").alias("n"), "payload")
    bits = answers.unionByName(places).groupBy("sender").applyInArrow(_suspects, "sender bigint, bits binary")
    rows = stored.where("kind = 'row'").drop("kind", "owner", "payload")
    return rows, materialize(bits, "bitmaps")


def find(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
    sender_rows: int = SENDER_ROWS,
) -> DataFrame:
    """``doc, keep_id, group_size, kept, text_sha256`` for every row; ``doc`` is a struct of
    the columns ``carry``, by default only the id.

    Texts are equal that are identical without ASCII white space; null, empty and blank
    ones are equal. Of equal texts the row with the most code points stays, then the one with
    the smallest id, null ids last; of rows that agree in both, which are repeated rows, one.
    An empty table gives an empty result. Columns of any name may be carried.
    """
    carry = carry or [doc_id]
    rows, bitmaps = exchange(docs, text, carry, sender_rows)
    bitmaps = broadcast_if_small(bitmaps)
    bit = F.expr("shiftright(cast(conv(hex(substring(bits, slot div 8 + 1, 1)), 16, 10) as int), slot % 8) & 1")
    marked = rows.join(bitmaps, "sender", "left").withColumn("suspect", F.coalesce(bit, F.lit(0)) == 1).drop("bits")
    doc = F.col("doc").getField(doc_id)
    alone = marked.where("not suspect").select(
        "doc", doc.alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    # Byte for byte: the text itself is a key of the grouping, copies are counted before it moves.
    suspects = marked.where("suspect")
    sizes = suspects.groupBy("sha", "text").agg(F.count("*").alias("group_size")).drop("text")
    few = materialize(suspects.select("sender", "slot", "doc", "n_chars", "sha"), "suspects")
    first = F.struct(
        (-F.col("n_chars")).alias("less"), doc.isNull().alias("unnamed"), doc.alias("id"), "sender", "slot"
    )
    best = few.groupBy("sha").agg(F.min(first).alias("best"))
    together = join_groups(few, best.join(sizes, "sha"), "sha", "group_size", "inner")
    found = together.select(
        "doc", F.col("best.id").alias("keep_id"), "group_size",
        ((F.col("best.sender") == F.col("sender")) & (F.col("best.slot") == F.col("slot"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return alone.unionByName(found)


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return find(docs, text, doc_id, docs.columns).where("kept").select("doc.*")
