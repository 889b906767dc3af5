"""Language-model scores by a hierarchical Pitman-Yor model whose contexts are words.

Every word has a restaurant for what follows it, and so has the start of a text: words
are its customers, and a customer who opens a new table sends one customer to the
restaurant above, which all contexts share; a new table there is a draw from a uniform
base. The number of restaurants is that of the distinct words.

The seating is sampled by Gibbs sweeps. A sweep seats the customers of every (context,
word) cell anew, given the tables of the sweep before in the rest of the model. Cells,
contexts and words are rows that a sweep joins by context and by word. A cell of one
customer always has one table, so only the others take part. Predictive probabilities
are averaged over the sweeps that are kept.

Only the most frequent words, a fixed number, go to the driver and to every task; what
hangs on a pair of them is spread by both, what hangs on one by the other, so that no
frequent word is one task's. Rows that are to be scored are counted beside those to be
learnt from: what occurs once in those and never in these needs no row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.language import _binary, _flat, _runs, _seat
from flowlens.llm.words import hashes, mix, tokenize
from flowlens.session import discard, materialize

END = b"\n"  # no word has white space
START = int(hashes([b" "]).view(np.int64)[0])
DISCOUNT = (0.8, 0.7)  # shared restaurant, contexts
STRENGTH = (10.0, 5.0)
BURN_IN, KEPT = 2, 2
HEAD = 65_000  # most frequent words, which every task knows, by numbers of two bytes
BLOCK_TOKENS, BLOCK_TEXTS = 400_000, 30_000
PART_BYTES = 4 << 20  # of text, for each part that pairs of words are spread over
SEATS = 100_000  # rows seated together


# Blocks of texts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of ``doc_id, text, train`` put together to about as many words as a block has."""
    held, size, texts = [], 0, 0
    for whole in batches:
        for begin in range(0, whole.num_rows, 128):
            batch = whole.slice(begin, 128)
            held.append(batch)
            size += batch.column(1).nbytes // 6
            texts += batch.num_rows
            if size >= BLOCK_TOKENS or texts >= BLOCK_TEXTS:
                yield pa.Table.from_batches(held)
                held, size, texts = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _tokens(texts: list[bytes | None]):
    """Numbers of words with an end after each text, text of each, hashes by number."""
    ids, ends, vocabulary = tokenize(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(ends, prepend=0) + 1)
    out = np.full(len(ids) + n, len(vocabulary), np.int64)
    is_word = np.ones(len(out), bool)
    is_word[ends + np.arange(n)] = False
    out[is_word] = ids
    return out, owner, hashes([*vocabulary, END]).view(np.int64)


def _is_in(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where numbers would be among ordered ones, and whether they are there."""
    if not len(ordered):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return at, ordered[at] == x


_ROUTE = "pmod(if(hc, if(hw, c ^ shiftleft(w, 7), w), c), {})"  # as in _Pairs
_TAIL = 0xFFFF


class _Pairs:
    """The tokens of texts in order of part, context and word, with the runs they make.

    A pair's part goes by its word that is not frequent, the context first; else by both.
    Runs are cut where they are longer than ``most``, so that their lengths are a byte.
    """

    def __init__(self, texts: list[bytes | None], head: np.ndarray, parts: int, most: int):
        ids, owner, word = _tokens(texts)
        self.word = np.append(word, START)
        before = np.roll(ids, 1)
        before[np.concatenate([[True], owner[1:] != owner[:-1]])] = len(word)
        at, self.frequent = _is_in(self.word, head)
        self.code = np.where(self.frequent, at, _TAIL)
        c, w = self.word[before], word[ids]
        of_both = np.where(self.frequent[ids], c ^ (w << np.int64(7)), w)
        part = np.where(self.frequent[before], of_both, c) % parts
        bits = int(len(word)).bit_length()
        key = (((part << bits) | before) << bits) | ids
        self.order = np.argsort(key)
        key = key[self.order]
        self.owner = owner[self.order]
        self.pairs = _cut(_runs(key), len(key), most)  # among tokens
        key = key[self.pairs]
        self.w = key & ((1 << bits) - 1)
        key >>= bits
        self.contexts = _cut(_runs(key), len(key), 255)  # among pairs
        key = key[self.contexts]
        self.c = key & ((1 << bits) - 1)
        key >>= bits
        begins = _runs(key)  # among contexts
        self.part = key[begins]
        self.by_context, self.by_pair = begins, self.contexts[begins]
        self.by_token = self.pairs[self.by_pair]

    def numbers(self) -> np.ndarray:
        """The word of every token."""
        return np.repeat(self.w, np.diff(np.append(self.pairs, len(self.owner))))

    def words(self, number: np.ndarray, begins: np.ndarray) -> list[pa.Array]:
        """Words by part: numbers of frequent ones, and hashes of the others."""
        tail = ~self.frequent[number]
        before = np.concatenate([[0], np.cumsum(tail)])
        return [
            _binary(self.code[number], begins, "<u2"),
            _binary(self.word[number[tail]], before[begins], "<i8"),
        ]

    def arrays(self) -> list[pa.Array]:
        """``part, c, ct, pairs, w, wt``."""
        size = np.diff(np.append(self.contexts, len(self.pairs)))
        return [
            pa.array(self.part), *self.words(self.c, self.by_context), _binary(size, self.by_context, "u1"),
            *self.words(self.w, self.by_pair),
        ]


_PACKED = "part bigint, c binary, ct binary, pairs binary, w binary, wt binary"


def _cut(begins: np.ndarray, size: int, most: int) -> np.ndarray:
    """Runs that begin there, cut into such of at most so many."""
    long = np.diff(np.append(begins, size))
    pieces = -(-long // most)
    first = np.cumsum(pieces) - pieces
    return np.repeat(begins, pieces) + most * (np.arange(pieces.sum()) - np.repeat(first, pieces))


def _unpacked(table: pa.Table, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of context and word of all pairs."""
    words = []
    for name in "cw":
        code, _ = _flat(table[name], "<u2")
        tail = code == _TAIL
        word = head[np.where(tail, 0, code)]
        word[tail], _ = _flat(table[f"{name}t"], "<i8")
        words.append(word)
    return np.repeat(words[0], _flat(table["pairs"], "u1")[0]), words[1]


# Counts


def _count_words(rows: DataFrame) -> DataFrame:
    """``w, n, h``: how often a word is in the rows to learn from, and in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, owner, word = _tokens(block["text"].to_pylist())
            train = block["train"].to_numpy()[owner]
            n = np.bincount(ids[train], minlength=len(word))
            h = np.bincount(ids[~train], minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(h)], names=["w", "n", "h"])

    counted = rows.mapInArrow(run, "w bigint, n bigint, h bigint")
    return counted.groupBy("w").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))


def _count_cells(rows: DataFrame, head: np.ndarray, parts: int) -> DataFrame:
    """``c, w, n, h, hc, hw``: pairs to learn from with their number, whether other rows
    have them, and whether the context and the word are frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pairs = _Pairs(block["text"].to_pylist(), head, parts, 127)
            train = block["train"].to_numpy()[pairs.owner].astype(np.int64)
            n = np.add.reduceat(train, pairs.pairs)
            h = np.diff(np.append(pairs.pairs, len(train))) > n
            yield pa.RecordBatch.from_arrays(
                [*pairs.arrays(), _binary(2 * n + h, pairs.by_pair, "u1")],
                names=["part", "c", "ct", "pairs", "w", "wt", "n"],
            )

    def merge(table: pa.Table) -> pa.Table:
        c, w = _unpacked(table, head)
        both = _flat(table["n"], "u1")[0].astype(np.int64)
        order = np.argsort(_both(c, w))
        c, w, both = c[order], w[order], both[order]
        pairs = _changes(c, w)
        n, h = np.add.reduceat(both >> 1, pairs), np.maximum.reduceat(both & 1, pairs)
        known = n > 0
        c, w, n, h = c[pairs][known], w[pairs][known], n[known], h[known]
        return pa.table(
            {"c": c, "w": w, "n": n, "h": h.astype(bool), "hc": _is_in(c, head)[1], "hw": _is_in(w, head)[1]}
        )

    return rows.mapInArrow(run, f"{_PACKED}, n binary").groupBy("part").applyInArrow(
        merge, "c bigint, w bigint, n bigint, h boolean, hc boolean, hw boolean"
    )


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


# Seating


@dataclass(frozen=True)
class Totals:
    """Customers and tables of the shared restaurant."""

    customers: float
    tables: float
    words: int

    @property
    def opening(self) -> float:
        """Weight of a new table in the shared restaurant."""
        return (STRENGTH[0] + DISCOUNT[0] * self.tables) / (self.words + 1)

    def above(self, customers: float, tables: float) -> float:
        """Probability, in the shared restaurant, of a word that so many tables serve."""
        return (max(customers - DISCOUNT[0] * tables, 0) + self.opening) / (STRENGTH[0] + self.customers)

    def above_sql(self) -> str:
        rest = f"{self.opening!r}D) / {STRENGTH[0] + self.customers!r}D"
        return f"(greatest(arriving - {DISCOUNT[0]}D * shared, 0D) + {rest}"


def _leaves(customers: float, tables: float) -> float:
    """What a context leaves to the shared restaurant."""
    return (STRENGTH[1] + DISCOUNT[1] * tables) / (STRENGTH[1] + customers)


_LEAVES = f"({STRENGTH[1]}D + {DISCOUNT[1]}D * tables) / ({STRENGTH[1]}D + n)"
_DIRECT = f"greatest(n - {DISCOUNT[1]}D * t, 0D) / {KEPT}"


def _seated(rows: DataFrame, customers: str, opening: str, discount: float, turn: int, out: str) -> DataFrame:
    """``rows`` with the tables ``out`` that ``customers`` open, without the column ``opening``."""
    kept = [c for c in rows.columns if c not in (opening, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SEATS:
                yield from seat(held)
                held = []
        if held:
            yield from seat(held)

    def seat(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if not table.num_rows:
            return
        rng = np.random.default_rng([turn, TaskContext.get().partitionId(), table.num_rows])
        tables = _seat(table[customers].to_numpy(), table[opening].to_numpy(), discount, rng)
        seated = table.select(kept).append_column(out, pa.array(np.minimum(tables, table[customers].to_numpy())))
        yield from seated.combine_chunks().to_batches()

    schema = rows.select(*kept, F.lit(0).cast("bigint").alias(out)).schema
    return rows.mapInArrow(run, schema)


def _looked_up(rows: DataFrame, table: DataFrame, key: str, frequent: str) -> DataFrame:
    """``rows`` joined with ``table`` by a word; frequent words, few in number, go to every task."""
    few = F.broadcast(table.where("head").drop("head"))
    rest = table.where("not head").drop("head")
    return rows.where(frequent).join(few, key).unionByName(rows.where(f"not {frequent}").join(rest, key))


class Model:
    """The averaged model: rows by pair of words and by word, and the sums that go with it.

    ``cells``: ``c, w, direct, hc, hw``, what a context keeps for a word, times its customers
    and strength. ``info``: ``w, head, n`` and, for each kept sweep, ``above`` in the shared
    restaurant and what the word's own restaurant ``leaves`` to it. Pairs and words without
    a row occur once if they are of a row that was learnt from, else never.
    """

    def __init__(
        self, cells: DataFrame, info: DataFrame, head: np.ndarray, tokens: int, words: int, parts: int,
        kept: list[Totals],
    ):
        self.cells, self.info, self.head = cells, info, head
        self.tokens, self.words, self.parts = tokens, words, parts
        self.never = [t.above(0, 0) for t in kept]
        self.once = [t.above(1, 1) for t in kept]


def _rows(docs: DataFrame, train: Column, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )


def learn(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of the rows of ``docs`` for which ``train`` holds, to score rows of ``docs`` with."""
    rows = _rows(docs, train, doc_id, text)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(32, size // PART_BYTES)
    counts = materialize(_count_words(rows), "words")
    known = counts.where("n > 0")
    tokens, words = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(hashes([END]).view(np.int64)[0])
    texts = known.where(F.col("w") == end).select("n").first()
    often = known.orderBy(F.desc("n"), "w").limit(HEAD).select("w").toArrow()["w"].to_numpy()
    head = np.sort(np.append(often, START))
    cells = materialize(_count_cells(rows, head, parts), "cells")

    # Words that occur more than once, and the start: one customer opens one table.
    start = docs.sparkSession.range(1).select(
        F.lit(START).alias("w"), F.lit(texts[0] if texts else 0).cast("bigint").alias("n")
    )
    frequent = F.broadcast(
        counts.where("n > 0").orderBy(F.desc("n"), "w").limit(HEAD).select("w", F.lit(True).alias("head"))
    )
    by_context = cells.where("n = 1").groupBy(F.col("c").alias("w")).agg(F.count("*").alias("ones_after"))
    by_word = cells.where("n = 1").groupBy("w").agg(F.count("*").alias("ones"))
    info = (
        counts.where("n > 1").select("w", "n").unionByName(start)
        .join(frequent, "w", "left")
        .join(by_context, "w", "left")
        .join(by_word, "w", "left")
        .select(
            "w", (F.coalesce("head", F.lit(False)) | (F.col("w") == START)).alias("head"), "n",
            F.coalesce("ones_after", F.lit(0)).alias("ones_after"), F.coalesce("ones", F.lit(0)).alias("ones"),
            F.lit(None).cast("bigint").alias("shared"),
        )
    )
    info = stored = materialize(info, "info")
    once = counts.where("n = 1").join(frequent, "w", "left").where("head or h > 0")
    once = materialize(once.select("w", "head", "n"), "once")
    state = cells.where("n > 1").select(
        "c", "w", "n", "hc", "hw", F.lit(0.0).alias("direct"), F.lit(1).cast("bigint").alias("t")
    )
    state = materialize(state, "seating")
    singles = materialize(cells.where("n = 1 and h").select("c", "w", "hc", "hw"), "singles")
    discard(cells)
    alone = known.where("n = 1").count()
    discard(counts)

    kept: list[Totals] = []
    totals = None
    for turn in range(BURN_IN + KEPT + 1):
        info = _served(info, state, totals, turn)
        before, stored = stored, materialize(info, "info")
        discard(before)
        customers, opened = stored.agg(F.sum("arriving"), F.sum("shared")).first()
        totals = Totals(float(customers + alone), float(opened + alone), words)
        info = stored
        if keep := turn > BURN_IN:
            kept.append(totals)
            k = len(kept)
            info = info.withColumns({f"above{k}": F.expr(totals.above_sql()), f"leaves{k}": F.expr(_LEAVES)})
        if turn < BURN_IN + KEPT:
            old, state = state, materialize(_swept(state, stored, totals, turn, keep), "seating")
            discard(old)

    pairs = state.select("c", "w", F.expr(f"direct + {_DIRECT}").alias("direct"), "hc", "hw")
    pairs = pairs.unionByName(singles.withColumn("direct", F.lit(1 - DISCOUNT[1])))
    averages = [f"{name}{k + 1}" for k in range(KEPT) for name in ("above", "leaves")]
    lone = {f"above{k + 1}": t.above(1, 1) for k, t in enumerate(kept)}
    lone |= {f"leaves{k + 1}": _leaves(1, 1) for k in range(KEPT)}
    once = once.select(
        "w", F.coalesce("head", F.lit(False)).alias("head"), "n", *[F.lit(lone[a]).alias(a) for a in averages]
    )
    return Model(pairs, info.select("w", "head", "n", *averages).unionByName(once), head, tokens, words, parts, kept)


def _served(info: DataFrame, state: DataFrame, totals: Totals | None, turn: int) -> DataFrame:
    """Words with the tables they have now, those that serve them, and the seating of the
    latter in the shared restaurant."""
    sums = (
        state.selectExpr("inline(array(struct(c as w, t as now, 0L as sent), struct(w, 0L as now, t as sent)))")
        .groupBy("w").agg(F.sum("now").alias("now"), F.sum("sent").alias("sent"))
    )
    rows = info.join(sums, "w", "left").withColumns(
        {
            "tables": F.coalesce("now", F.lit(0)) + F.col("ones_after"),
            "arriving": F.coalesce("sent", F.lit(0)) + F.col("ones"),
        }
    )
    if totals is None:
        return rows.drop("now", "sent").withColumn("shared", F.least("arriving", F.lit(1).cast("bigint")))
    rows = rows.drop("now", "sent").withColumn("opening", F.lit(totals.opening))
    return _seated(rows, "arriving", "opening", DISCOUNT[0], turn, "shared")


def _swept(state: DataFrame, info: DataFrame, totals: Totals, turn: int, keep: bool) -> DataFrame:
    """Cells with their customers seated anew; the present seating is counted in, if it is kept."""
    contexts = info.select(
        F.col("w").alias("c"), "head", F.expr(f"{STRENGTH[1]}D + {DISCOUNT[1]}D * tables").alias("weight")
    )
    words = info.select("w", "head", F.expr(totals.above_sql()).alias("above"))
    cells = _looked_up(_looked_up(state, contexts, "c", "hc"), words, "w", "hw")
    cells = cells.select(
        "c", "w", "n", "hc", "hw", F.expr(f"direct + {_DIRECT}" if keep else "direct").alias("direct"),
        F.expr("weight * above").alias("opening"),
    )
    return _seated(cells, "n", "opening", DISCOUNT[1], turn, "t")


# Scores


_MODEL = "part bigint, c bigint, w bigint, n bigint, v array<double>"
_SUMS = "block bigint, doc_id array<bigint>, text binary, n binary, known binary, base binary, score binary"
_SCORED = f"{_SUMS}, place bigint, w bigint, train boolean, own double, leaves array<double>"
_TEXTS = "block bigint, place bigint, doc_id bigint, n bigint, known bigint, base double, score double"


def score(docs: DataFrame, train: Column, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of the ``docs`` the model
    was made with.

    A text is its words, A-Z in lower case, and an end. ``base_score`` is the sum of
    log10 of smoothed relative frequencies, ``score`` of the model's probabilities. Null
    and empty texts have the end only. Repeated rows and null ids stay.
    """
    head, parts = model.head, model.parts
    averages = model.info.columns[3:]
    few = model.info.where("head").toArrow().sort_by("w")
    frequent = docs.sparkSession.sparkContext.broadcast(
        (few["w"].to_numpy(), few["n"].to_numpy(), np.column_stack([few[a].to_numpy() for a in averages]))
    )
    never = np.ravel([[a, 1.0] for a in model.never])
    once = np.ravel([[a, _leaves(1, 1)] for a in model.once])
    all_tokens, smooth = model.tokens, model.tokens + 0.5 * (model.words + 1)
    rows = _rows(docs, train, doc_id, text)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = ["part", "c", "ct", "pairs", "w", "wt", "block", "doc_id", "tokens", "texts", "n", "known", "base"]
        common, counts, _ = frequent.value
        of_head = np.log10((counts + 0.5) / smooth)
        for number, block in enumerate(_blocks(batches)):
            name = (task << 31) + number
            pairs = _Pairs(block["text"].to_pylist(), head, parts, 255)
            place = 2 * pairs.owner + block["train"].to_numpy()[pairs.owner]
            rows = len(pairs.part)
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    *pairs.arrays(),
                    pa.array(np.full(rows, name)),
                    pa.nulls(rows, pa.list_(pa.int64())),
                    _binary(np.diff(np.append(pairs.pairs, len(place))), pairs.by_pair, "u1"),
                    _binary(place, pairs.by_token, "<u2"),
                    *[none] * 3,
                ],
                names=names,
            )
            # The base of frequent words is known here.
            at, found = _is_in(pairs.word, common)
            number = pairs.numbers()
            mine, texts = found[number], block.num_rows
            owner = pairs.owner[mine]
            sums = [
                np.bincount(pairs.owner, minlength=texts),
                np.bincount(owner, weights=counts[at[number[mine]]] > 0, minlength=texts),
                np.bincount(owner, weights=of_head[at[number[mine]]], minlength=texts),
            ]
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name % parts]), *[none] * 5, pa.array([name]),
                    pa.array([block["doc_id"].to_pylist()], pa.list_(pa.int64())), none, none,
                    *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(sums, ("<i8", "<i8", "<f8"))],
                ],
                names=names,
            )

    def combine(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.filter(left["c"].is_null())
        out = [_scored(texts.num_rows, **{k: texts[k] for k in ("block", "doc_id", "n", "known", "base")})]
        left = left.filter(left["c"].is_valid())
        if left.num_rows:
            out += pair_scores(left, right)
        return pa.concat_tables(out)

    def pair_scores(left: pa.Table, right: pa.Table) -> list[pa.Table]:
        place, size = _flat(left["texts"], "<u2")
        block = np.repeat(left["block"].to_numpy(), size)
        each, _ = _flat(left["tokens"], "u1")
        c, w = (np.repeat(x, each) for x in _unpacked(left, head))
        train, place = (place & 1).astype(bool), (place >> 1).astype(np.int64)

        is_cell = right["c"].is_valid()
        cells, info = right.filter(is_cell), right.filter(pa.compute.invert(is_cell)).sort_by("w")
        key = _both(cells["c"].to_numpy(), cells["w"].to_numpy())
        order = np.argsort(key)
        at, found = _is_in(_both(c, w), key[order])
        direct = np.where(train, 1 - DISCOUNT[1], 0.0)
        if cells.num_rows:
            kept = _values(cells, 1)[order, 0]
            direct[found] = kept[at[found]]

        tail = (info["w"].to_numpy(), info["n"].to_numpy(), _values(info, len(averages)))
        of_context, in_c = _known(c, train, frequent.value, tail, once, never)
        of_word, in_w = _known(w, train, frequent.value, tail, once, never)
        own = direct / (STRENGTH[1] + of_context[0])
        leaves = of_context[1][:, 1::2]
        # A word that is not frequent after one that is not either is known elsewhere.
        here = in_c | in_w | (c == w)
        p = own[here] + np.einsum("ij,ij->i", leaves[here], of_word[1][here, 0::2]) / KEPT
        n = of_word[0][here]
        counted = in_w[here]  # where the text is
        known = np.where(counted, 0, n > 0)
        base = np.where(counted, 0, np.log10((n + 0.5) / smooth))
        sums = _by_text(block[here], place[here], known, base, np.log10(p))
        far = ~here
        rest = {
            "block": block[far], "place": place[far], "w": w[far], "train": train[far], "own": own[far],
            "leaves": _lists(leaves[far]),
        }
        return [sums, _scored(int(far.sum()), **rest)]

    packed = rows.mapInArrow(spread, f"{_PACKED}, block bigint, doc_id array<bigint>, tokens binary, texts binary, n binary, known binary, base binary")
    none = F.lit(None).cast("bigint")
    by_word = model.info.where("not head").select(
        F.expr(f"pmod(w, {parts})").alias("part"), none.alias("c"), "w", "n", F.array(*averages).alias("v")
    )
    by_pair = model.cells.select(
        F.expr(_ROUTE.format(parts)).alias("part"), "c", "w", none.alias("n"), F.array("direct").alias("v")
    )
    known = by_word.unionByName(by_pair)
    found = packed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(combine, _SCORED)
    found = materialize(found, "scored")

    # Pairs of two words that are not frequent.
    default = [F.when(F.col("train"), a).otherwise(b) for a, b in zip(once[0::2].tolist(), never[0::2].tolist())]
    above = [F.coalesce(F.col(a), d) for a, d in zip(averages[0::2], default)]
    p = F.col("own") + sum((F.get("leaves", F.lit(k)) * a for k, a in enumerate(above)), F.lit(0.0)) / KEPT
    seen = F.coalesce(F.col("of_word"), F.col("train").cast("bigint"))
    rare = (
        found.where("w is not null").select("block", "place", "w", "train", "own", "leaves")
        .join(model.info.where("not head").withColumnRenamed("n", "of_word"), "w", "left")
        .select(
            "block", "place", none.alias("doc_id"), F.lit(0).cast("bigint").alias("n"),
            (seen > 0).cast("bigint").alias("known"),
            F.log10((seen + 0.5) / F.lit(smooth)).alias("base"), F.log10(p).alias("score"),
        )
    )
    each = found.where("w is null").drop("place", "w", "train", "own", "leaves")
    each = each.groupBy("block").applyInArrow(_texts, _TEXTS)
    return (
        each.unionByName(rare)
        .groupBy("block", "place")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("block", "place")
    )


def _scored(rows: int, **columns) -> pa.Table:
    """A table of ``_SCORED`` with some of its columns, the others null."""
    kinds = {
        "block": pa.int64(), "doc_id": pa.list_(pa.int64()), "text": pa.binary(), "n": pa.binary(),
        "known": pa.binary(), "base": pa.binary(), "score": pa.binary(), "place": pa.int64(), "w": pa.int64(),
        "train": pa.bool_(), "own": pa.float64(), "leaves": pa.list_(pa.float64()),
    }
    given = {k: v.cast(kinds[k]) if isinstance(v, pa.ChunkedArray) else pa.array(v, kinds[k]) for k, v in columns.items()}
    return pa.table({k: given[k] if k in given else pa.nulls(rows, kind) for k, kind in kinds.items()})


def _by_text(block: np.ndarray, text: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> pa.Table:
    """Sums by text, a row for each block."""
    order = np.lexsort((text, block))
    block, text = block[order], text[order]
    begins = _changes(block, text)
    if not len(begins):
        return _scored(0)
    known, base, score = (np.add.reduceat(x[order], begins) for x in (known, base, score))
    block, text = block[begins], text[begins]
    rows = _runs(block)
    sums = {
        "text": _binary(text, rows, "<u2"), "known": _binary(known, rows, "<u4"),
        "base": _binary(base, rows, "<f8"), "score": _binary(score, rows, "<f4"),
    }
    return _scored(len(rows), block=block[rows], **sums)


def _texts(table: pa.Table) -> pa.Table:
    """A row for every text of a block, with its sums."""
    texts = table.filter(table["doc_id"].is_valid())
    sums = table.filter(table["doc_id"].is_null())
    doc_id = texts["doc_id"].combine_chunks().flatten()
    n, known, base = (_flat(texts[k], kind)[0] for k, kind in (("n", "<i8"), ("known", "<i8"), ("base", "<f8")))
    size = len(doc_id)
    text, _ = _flat(sums["text"], "<u2")
    more = [_flat(sums[k], kind)[0] for k, kind in (("known", "<u4"), ("base", "<f8"), ("score", "<f4"))]
    more = [np.bincount(text, weights=x, minlength=size) for x in more]
    return pa.table(
        {
            "block": np.full(size, table["block"][0].as_py()), "place": np.arange(size), "doc_id": doc_id,
            "n": n, "known": known + more[0].astype(np.int64), "base": base + more[1], "score": more[2],
        }
    )


def _both(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    return mix(mix(c.astype(np.int64).view(np.uint64)) + w.astype(np.int64).view(np.uint64))


def _values(table: pa.Table, width: int) -> np.ndarray:
    """Lists of as many numbers as rows of a matrix."""
    return np.array(table["v"].combine_chunks().flatten()).reshape(-1, width)


def _lists(numbers: np.ndarray) -> pa.ListArray:
    n, width = numbers.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(numbers.ravel()))


def _known(x: np.ndarray, train: np.ndarray, head: tuple, tail: tuple, once: np.ndarray, never: np.ndarray):
    """How often words occur with their averages, and whether they are frequent ones."""
    n = train.astype(np.int64)
    values = np.where(train[:, None], once, never)
    for words, counts, averages in (tail, head):
        at, found = _is_in(x, words)
        n[found], values[found] = counts[at[found]], averages[at[found]]
    return (n, values), found
