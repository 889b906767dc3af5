"""Language-model scores by a hierarchical Pitman-Yor model.

Every context has a restaurant: words are its customers, and a customer who opens a new
table sends one customer to the restaurant above, which all contexts share; a new table
there is a draw from a uniform base. A word's context is the ending of the word before
it, one of 255 classes, or the start of the text.

The seating is sampled by Gibbs sweeps. A sweep seats the customers of every (context,
word) cell anew, given the tables of the sweep before in the rest of the model, so cells
are independent within a sweep and Spark spreads them by word. The state of a cell is
its number of tables, all that the predictive probability needs. Predictive
probabilities are averaged over the sweeps that are kept.

Counts of words and cells, seating and probabilities are tables that grow with the
corpus and are spread by word. Only sums over contexts and the model's most frequent
words, a fixed number, go to the driver and to every task. Texts stay where they are
read: what moves is, for each block of texts, each word once with the places it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.words import hashes, tokenize
from flowlens.session import discard, materialize

CONTEXTS = 256
END = b"\n"  # no word has a line break
DISCOUNT = (0.8, 0.7)  # shared restaurant, contexts
STRENGTH = (10.0, 5.0)
BURN_IN, KEPT = 2, 2
HEAD = 8_192  # most frequent words, whose probabilities every task has
BLOCK_TOKENS, BLOCK_TEXTS = 1_500_000, 1 << 16
PART_BYTES = 32 << 20  # of text, for each part that words are spread over
EXACT = 64  # customers seated one by one before they are seated in small groups
SEATED = 1 / 32


# Blocks of texts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together to about as many words as a block has."""
    held, size, texts = [], 0, 0
    for whole in batches:
        for begin in range(0, whole.num_rows, 512):
            batch = whole.slice(begin, 512)
            held.append(batch)
            size += batch.column(1).nbytes // 6
            texts += batch.num_rows
            if size >= BLOCK_TOKENS or texts >= BLOCK_TEXTS - 512:
                yield held
                held, size, texts = [], 0, 0
    if held:
        yield held


def _tokens(texts: list[bytes | None]):
    """Word numbers with an end after each text, text and context of each, vocabulary."""
    ids, ends, vocabulary = tokenize(texts)
    n = len(texts)
    counts = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(n), counts + 1)
    out = np.full(len(ids) + n, len(vocabulary), np.int64)
    is_word = np.ones(len(out), bool)
    is_word[ends + np.arange(n)] = False
    out[is_word] = ids
    vocabulary.append(END)
    endings: dict[bytes, int] = {}
    kind = np.fromiter((endings.setdefault(w[-3:], len(endings)) for w in vocabulary), np.int64, len(vocabulary))
    of_ending = (hashes(list(endings)) % np.uint64(CONTEXTS - 1) + np.uint64(1)).astype(np.int64)
    context = np.zeros(len(out), np.int64)
    context[1:] = of_ending[kind[out[:-1]]]
    context[np.concatenate([[0], (ends + np.arange(n) + 1)[:-1]]).astype(np.int64)] = 0
    return out, owner, context, hashes(vocabulary).view(np.int64)


def _binary(values: np.ndarray, begins: np.ndarray, dtype: str) -> pa.Array:
    """One binary value for each run of numbers that begins at ``begins``."""
    width = np.dtype(dtype).itemsize
    offsets = (np.append(begins, len(values)) * width).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values, dtype).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), data])


def _flat(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    rows = column.to_pylist()
    width = np.dtype(dtype).itemsize
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // width
    return np.frombuffer(b"".join(rows), dtype), sizes


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


# Counts


def _cells(docs: DataFrame, parts: int) -> DataFrame:
    """``w, c, ctx, n``: words with their count, contexts and counts by context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches):
            texts = [t for b in held for t in b.column(1).to_pylist()]
            ids, _, context, word = _tokens(texts)
            key, n = np.unique(ids * CONTEXTS + context, return_counts=True)
            begins = _runs(key // CONTEXTS)
            w = word[key[begins] // CONTEXTS]
            packed = (key % CONTEXTS).astype(np.uint32) | (n.astype(np.uint32) << np.uint32(8))
            yield pa.RecordBatch.from_arrays([pa.array(w), _binary(packed, begins, "<u4")], names=["w", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        packed, sizes = _flat(table["cells"], "<u4")
        w = np.repeat(table["w"].to_numpy(), sizes)
        context, n = packed & np.uint32(255), (packed >> np.uint32(8)).astype(np.int64)
        order = np.lexsort((context, w))
        w, context, n = w[order], context[order], n[order]
        begins = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (context[1:] != context[:-1])]))
        n = np.add.reduceat(n, begins)
        w, context = w[begins], context[begins]
        words = _runs(w)
        return pa.table(
            {
                "w": w[words],
                "c": np.add.reduceat(n, words),
                "ctx": _binary(context, words, "u1"),
                "n": _binary(n, words, "<u4"),
            }
        )

    counted = docs.mapInArrow(count, "w bigint, cells binary")
    counted = counted.withColumn("part", F.expr(f"pmod(w, {parts})"))
    return counted.groupBy("part").applyInArrow(merge, "w bigint, c bigint, ctx binary, n binary")


# Seating


def _seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that customers open one after another, for many dishes at once.

    A customer opens a table with weight ``new`` against one for each seated customer,
    less the discount for each table. The first ones are seated one by one; once many
    are seated, a small share of them sits down at a time, with the weights as they are
    before, which change very little meanwhile.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    customers, new = customers[order], new[order]
    opened = tables[order]
    seated = 1
    active = int(np.searchsorted(-customers, -1, side="left"))
    while active:
        size = 1 if seated < EXACT else max(1, int(seated * SEATED))
        chance = new[:active] / (new[:active] + seated - discount * opened[:active])
        sitting = np.minimum(size, customers[:active] - seated)
        if size == 1:
            opened[:active] += rng.random(active) < chance
        else:
            opened[:active] += rng.binomial(sitting, np.clip(chance, 0, 1))
        seated += size
        active = int(np.searchsorted(-customers, -seated, side="left"))
    tables[order] = opened
    return tables.astype(np.int64)


def _sums(state: DataFrame, column: str, dtype: str) -> np.ndarray:
    """Sums of a cell column by context."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS, np.int64)
        for batch in batches:
            values, _ = _flat(batch.column(1), dtype)
            context, _ = _flat(batch.column(0), "u1")
            total += np.bincount(context, weights=values, minlength=CONTEXTS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXTS)), pa.array(total)], names=["ctx", "n"])

    rows = state.select("ctx", column).mapInArrow(add, "ctx bigint, n bigint").groupBy("ctx").agg(F.sum("n").alias("n"))
    out = np.zeros(CONTEXTS)
    for row in rows.collect():
        out[row["ctx"]] = row["n"]
    return out


_STATE = "w bigint, c bigint, ctx binary, n binary, tables binary, shared bigint, own binary, above binary"


def _first_state(cells: DataFrame) -> DataFrame:
    """One table for each cell and word, and no kept sweep yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes = _flat(batch.column(3), "<u4")
            begins = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    _binary(np.ones(len(counts)), begins, "<u4"),
                    pa.array(np.ones(batch.num_rows, np.int64)),
                    _binary(np.zeros(len(counts)), begins, "<f4"),
                    pa.array([b""] * batch.num_rows, pa.binary()),
                ],
                names=["w", "c", "ctx", "n", "tables", "shared", "own", "above"],
            )

    return cells.mapInArrow(run, _STATE)


class Totals:
    """Sums of a state: customers and tables by context, and of the shared restaurant."""

    def __init__(self, state: DataFrame, customers: np.ndarray, words: int):
        self.customers = customers
        self.tables = _sums(state, "tables", "<u4")
        self.shared_customers = self.tables.sum()
        self.shared_tables = float(state.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0])
        self.base = 1 / (words + 1)  # one share of the base for all unknown words

    def above(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability in the shared restaurant."""
        all_ = STRENGTH[0] + self.shared_customers
        rest = (STRENGTH[0] + DISCOUNT[0] * self.shared_tables) * self.base
        return (np.maximum(customers - DISCOUNT[0] * tables, 0) + rest) / all_

    def fall_back(self) -> np.ndarray:
        """What each context leaves to the shared restaurant."""
        return (STRENGTH[1] + DISCOUNT[1] * self.tables) / (STRENGTH[1] + self.customers)


def _sweep(state: DataFrame, totals: Totals, turn: int, keep: bool, seat: bool) -> DataFrame:
    """Count the present seating in, if it is kept, and seat all customers anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 200_000:
                yield from work(held)
                held = []
        if held:
            yield from work(held)

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if not table.num_rows:
            return
        counts, sizes = _flat(table["n"], "<u4")
        counts = counts.astype(np.int64)
        context, _ = _flat(table["ctx"], "u1")
        tables, _ = _flat(table["tables"], "<u4")
        own, _ = _flat(table["own"], "<f4")
        shared = table["shared"].to_numpy()
        begins = np.cumsum(sizes) - sizes
        above = totals.above(np.add.reduceat(tables, begins).astype(np.float64), shared)
        above_rows = table["above"].to_pylist()
        if keep:
            direct = np.maximum(counts - DISCOUNT[1] * tables, 0) / (STRENGTH[1] + totals.customers[context])
            own = own + direct / KEPT
            added = above.astype("<f4").tobytes()
            above_rows = [a + added[4 * i : 4 * i + 4] for i, a in enumerate(above_rows)]
        if seat:
            w = table["w"].to_numpy()
            rng = np.random.default_rng([turn, int(w[0]) & 0xFFFFFFFF, len(w)])
            new = (STRENGTH[1] + DISCOUNT[1] * totals.tables[context]) * np.repeat(above, sizes)
            tables = _seat(counts, new, DISCOUNT[1], rng)
            base = (STRENGTH[0] + DISCOUNT[0] * totals.shared_tables) * totals.base
            arriving = np.add.reduceat(tables, begins)
            shared = _seat(arriving, np.full(len(arriving), base), DISCOUNT[0], rng)
        out = pa.table(
            {
                "w": table["w"], "c": table["c"], "ctx": table["ctx"], "n": table["n"],
                "tables": _binary(tables, begins, "<u4"), "shared": pa.array(shared.astype(np.int64)),
                "own": _binary(own, begins, "<f4"), "above": pa.array(above_rows, pa.binary()),
            }
        )
        yield from out.combine_chunks().to_batches()

    return state.mapInArrow(run, _STATE)


class Model:
    """The averaged model: a table by word, and the sums that go with it."""

    def __init__(self, table: DataFrame, words: int, tokens: int, kept: list[Totals], parts: int):
        self.table, self.words, self.tokens, self.parts = table, words, tokens, parts
        zero = np.zeros(1)
        # Rows: kept sweeps. What a context leaves to the shared restaurant, by context.
        self.leaves = np.array([t.fall_back() for t in kept])
        self.unknown = np.array([t.above(zero, zero)[0] for t in kept])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Count, seat and average over all rows of ``docs``; null texts count as empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(32, size // PART_BYTES)
    cells = _cells(rows, parts)
    state = materialize(_first_state(cells), "seating")
    words, tokens = state.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    customers = _sums(state, "n", "<u4")
    kept = []
    for turn in range(BURN_IN + KEPT + 1):
        totals = Totals(state, customers, words)
        keep = turn > BURN_IN
        if keep:
            kept.append(totals)
        before = state
        # The last round only counts the last seating in.
        state = materialize(_sweep(state, totals, turn, keep, turn < BURN_IN + KEPT), "seating")
        discard(before)
    return Model(state.select("w", "c", "ctx", "own", "above"), words, tokens, kept, parts)


# Scores


def _log_cells(ctx: np.ndarray, own: np.ndarray, above: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """log10 of averaged probabilities: ``own`` of the context and what it leaves."""
    return np.log10(own + np.einsum("sk,sk->k", leaves[:, ctx], above) / KEPT)


def _head(model: Model) -> dict[str, np.ndarray]:
    """The most frequent words, by hash, with the log probability in every context."""
    rows = model.table.orderBy(F.desc("c"), "w").limit(HEAD).toArrow().sort_by("w")
    n = rows.num_rows
    above, _ = _flat(rows["above"], "<f4")
    above = above.reshape(n, KEPT).astype(np.float64)
    ctx, sizes = _flat(rows["ctx"], "u1")
    own, _ = _flat(rows["own"], "<f4")
    p = above @ model.leaves / KEPT
    p[np.repeat(np.arange(n), sizes), ctx] += own
    counts = rows["c"].to_numpy()
    return {"w": rows["w"].to_numpy(), "log": np.log10(p).astype(np.float32), "base": model.base(counts)}


_DOC = np.dtype(
    [("doc_id", "<i8"), ("null", "u1"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")]
)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs``.

    A text is its words, A-Z in lower case, and an end. ``base_score`` is the sum of
    log10 of smoothed relative frequencies, ``score`` of the model's probabilities. Null
    and empty texts have the end only. Repeated rows and null ids stay.
    """
    spark: SparkSession = docs.sparkSession
    head = spark.sparkContext.broadcast(_head(model))
    parts, leaves, unknown = model.parts, model.leaves, model.unknown
    no_count = float(model.base(np.zeros(1))[0])
    tokens, words = model.tokens, model.words
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text")
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        task = TaskContext.get().partitionId()
        for number, held in enumerate(_blocks(batches)):
            block = (task << 24) + number
            texts = [t for b in held for t in b.column(1).to_pylist()]
            ids, owner, context, word = _tokens(texts)
            place = np.searchsorted(known["w"], word)
            place = np.minimum(place, max(len(known["w"]) - 1, 0))
            in_head = known["w"][place] == word if len(known["w"]) else np.zeros(len(word), bool)
            mine = in_head[ids]
            at, of = place[ids[mine]], owner[mine]
            n = len(texts)
            found = np.zeros(n, _DOC)
            given = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            found["null"] = given.is_null().to_numpy(zero_copy_only=False)
            found["doc_id"] = given.fill_null(0).to_numpy(zero_copy_only=False)
            found["n"] = np.bincount(owner, minlength=n)
            found["known"] = np.bincount(of, minlength=n)
            if len(at):
                found["base"] = np.bincount(of, weights=known["base"][at], minlength=n)
                found["score"] = np.bincount(of, weights=known["log"][at, context[mine]], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block % parts]), pa.array([None], pa.int64()), pa.array([block]), pa.array([found.tobytes()], pa.binary())],
                names=["part", "w", "block", "data"],
            )
            ids, owner, context = ids[~mine], owner[~mine], context[~mine]
            if len(ids):
                order = np.argsort(ids, kind="stable")
                begins = _runs(ids[order])
                w = word[ids[order][begins]]
                places = (owner[order].astype(np.uint32) << np.uint32(8)) | context[order].astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w % parts), pa.array(w), pa.array(np.full(len(w), block)),
                        _binary(places, begins, "<u4"),
                    ],
                    names=["part", "w", "block", "data"],
                )

    def combine(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        left = left.combine_chunks()
        is_text = left["w"].is_null()
        for block, data in zip(left.filter(is_text)["block"].to_pylist(), left.filter(is_text)["data"].to_pylist()):
            found = np.frombuffer(data, _DOC)
            out.append(
                (
                    np.full(len(found), block), np.arange(len(found)), found["doc_id"], found["null"] == 0,
                    found["n"], found["known"], found["base"], found["score"],
                )
            )
        places = left.filter(pa.compute.invert(is_text))
        if places.num_rows:
            data, sizes = _flat(places["data"], "<u4")
            w = np.repeat(places["w"].to_numpy(), sizes)
            key = np.repeat(places["block"].to_numpy(), sizes) * (1 << 24) + (data >> np.uint32(8)).astype(np.int64)
            context = (data & np.uint32(255)).astype(np.int64)
            right = right.sort_by("w")
            known_w = right["w"].to_numpy()
            counts = right["c"].to_numpy()
            ctx, of_word = _flat(right["ctx"], "u1")
            own, _ = _flat(right["own"], "<f4")
            above, _ = _flat(right["above"], "<f4")
            above = above.reshape(-1, KEPT).T.astype(np.float64)
            at = np.minimum(np.searchsorted(known_w, w), max(len(known_w) - 1, 0))
            seen = known_w[at] == w if len(known_w) else np.zeros(len(w), bool)
            base = np.full(len(w), no_count)
            p_above = np.repeat(unknown[:, None], len(w), axis=1)
            p_own = np.zeros(len(w))
            if seen.any():
                base[seen] = np.log10((counts[at[seen]] + 0.5) / (tokens + 0.5 * (words + 1)))
                p_above[:, seen] = above[:, at[seen]]
                cells = np.repeat(np.arange(len(known_w)), of_word) * CONTEXTS + ctx
                wanted = at[seen] * CONTEXTS + context[seen]
                cell = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
                p_own[seen] = np.where(cells[cell] == wanted, own[cell], 0)
            value = _log_cells(context, p_own, p_above, leaves)
            order = np.argsort(key, kind="stable")
            begins = _runs(key[order])
            texts = key[order][begins]
            out.append(
                (
                    texts >> 24, texts & ((1 << 24) - 1), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool),
                    np.zeros(len(texts), np.int64), np.add.reduceat(seen[order].astype(np.int64), begins),
                    np.add.reduceat(base[order], begins), np.add.reduceat(value[order], begins),
                )
            )
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 8
        arrays = [pa.array(c) for c in columns]
        has_id = columns[3].astype(bool)
        return pa.table(
            {
                "block": arrays[0].cast("int64"), "idx": arrays[1].cast("int64"),
                "doc_id": pa.array(columns[2].astype(np.int64), mask=~has_id),
                "n": arrays[4].cast("int64"), "known": arrays[5].cast("int64"),
                "base": arrays[6].cast("float64"), "score": arrays[7].cast("float64"),
            }
        )

    spread_rows = rows.mapInArrow(spread, "part bigint, w bigint, block bigint, data binary")
    spread_rows = spread_rows.withColumn("part", F.expr(f"pmod(part, {parts})"))
    by_word = model.table.withColumn("part", F.expr(f"pmod(w, {parts})"))
    partial = (
        spread_rows.groupBy("part")
        .cogroup(by_word.groupBy("part"))
        .applyInArrow(
            combine,
            "block bigint, idx bigint, doc_id bigint, n bigint, known bigint, base double, score double",
        )
    )
    return (
        partial.groupBy("block", "idx")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .where("n_tokens > 0")
        .drop("block", "idx")
    )


def held_out(doc_id: Column, remainder: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder mod 5; not so for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))
