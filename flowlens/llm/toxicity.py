"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is an embedding of the word and the mean of embeddings of its character
runs (with marks for its start and end), both looked up by hash. Two gated recurrent
layers read a window of words forwards and backwards, attention weighs the states, and a
logistic unit scores the window. Windows overlap by half and cover the whole text; a
text's score is that of its worst window.

Training and scoring are numpy. Training uses a bounded sample of labelled rows on the
driver; the labels are of whole texts, so every pass scores all their windows and trains
on those that score highest: in a toxic text the one most likely to be the reason, in a
clean text the worst mistakes. Scoring runs in tasks over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.words import mix, tokenize

WINDOW, STEP = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN = 8, 16, 8
INPUT = WORD_DIM + CHAR_DIM
SAMPLE = 3_000  # labelled texts that a model is trained on, at most
EPOCHS = 10
_BATCH = 256
_CACHE = 200_000
_WORDS = 8192  # words whose character runs are in memory at a time


def _char_runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character embeddings for runs of 3 to 5 bytes of words, one word after
    another, and how many each word has. Marks stand before and after a word."""
    parts = [_runs_of(words[i : i + _WORDS]) for i in range(0, len(words), _WORDS)]
    return tuple(np.concatenate(part) for part in zip(*parts))


def _runs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"^" + w + b"$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked) + bytes(5), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ends))
    owner = np.repeat(np.arange(len(words)), sizes)
    value = data[: len(ends)].copy()
    rows, holders = [], []
    for n in range(1, 6):
        if n > 1:
            value = value + (data[n - 1 : len(ends) + n - 1] << np.uint64(8 * (n - 1)))
        if n >= 2:  # two bytes only where a word has no more
            inside = at + n <= ends
            if n == 2:
                inside &= sizes[owner] == 2
            rows.append((mix(value[inside] + np.uint64(n << 56)) >> np.uint64(64 - 14)).astype(np.int64))
            holders.append(owner[inside])
    holder = np.concatenate(holders)
    order = np.argsort(holder, kind="stable")
    return np.concatenate(rows)[order].astype(np.int32), np.bincount(holder, minlength=len(words)).astype(np.int32)


def _scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by index."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        begins = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out[index[begins]] = np.add.reduceat(values[order], begins)
    return out


def _word_row(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word, 7) % WORD_ROWS


def _windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of all windows; a text without words has none."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = ends - starts
    n = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STEP) + 1), 0)
    owner = np.repeat(np.arange(len(ends)), n)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[owner] + index * STEP
    return first, np.minimum(WINDOW, ends[owner] - first), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, forward and backward passes. Arrays are time x windows x width."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def weights(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {
            "word": weights(WORD_ROWS, WORD_DIM, scale=0.05),
            "char": weights(CHAR_ROWS, CHAR_DIM, scale=0.3),
            "attend": weights(2 * HIDDEN, scale=0.3),
            "out": weights(2 * HIDDEN, scale=0.3),
            "bias": np.full(1, -2.0, np.float32),
        }
        for side in "fb":
            # Update gate, reset gate, candidate.
            self.w[f"in_{side}"] = weights(INPUT, 3 * HIDDEN, scale=INPUT**-0.5)
            self.w[f"gates_{side}"] = weights(HIDDEN, 2 * HIDDEN, scale=HIDDEN**-0.5)
            self.w[f"cand_{side}"] = weights(HIDDEN, HIDDEN, scale=HIDDEN**-0.5)
            self.w[f"b_{side}"] = np.zeros(3 * HIDDEN, np.float32)

    def inputs(self, rows: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Input vectors of words; of ``runs`` each word has the next ``counts``."""
        total = np.add.reduceat(self.w["char"][runs], np.cumsum(counts) - counts)
        return np.hstack([self.w["word"][rows], total / np.sqrt(counts).astype(np.float32)[:, None]])

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What words add to the gates of both directions."""
        return {s: x @ self.w[f"in_{s}"] + self.w[f"b_{s}"] for s in "fb"}

    def gates(self, rows: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """``projected`` for any number of words, some at a time."""
        out = {s: np.empty((len(rows), 3 * HIDDEN), np.float32) for s in "fb"}
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        for a in range(0, len(rows), _WORDS):
            b = min(a + _WORDS, len(rows))
            some = self.projected(self.inputs(rows[a:b], runs[ends[a] : ends[b]], counts[a:b]))
            for s in "fb":
                out[s][a:b] = some[s]
        return out

    def _read(self, side: str, given: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; where the mask is 0 the state stays as it is."""
        steps, n, _ = given.shape
        gates, cand = self.w[f"gates_{side}"], self.w[f"cand_{side}"]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        for t in order:
            zr = _sigmoid(given[t, :, : 2 * HIDDEN] + h @ gates)
            z, r = zr[:, :HIDDEN] * mask[t], zr[:, HIDDEN:]
            rh = r * h
            c = np.tanh(given[t, :, 2 * HIDDEN :] + rh @ cand)
            if keep is not None:
                keep.append((t, h, zr, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def forward(self, given: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        trace = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([self._read(s, given[s], mask, trace[s]) for s in "fb"], axis=2)
        score = states @ self.w["attend"] + (mask[:, :, 0] - 1) * np.float32(1e4)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.update(trace=trace, states=states, weight=weight, pooled=pooled)
        return pooled @ self.w["out"] + self.w["bias"]

    def backward(self, kept: dict, mask: np.ndarray, error: np.ndarray) -> tuple[dict, dict]:
        """Gradients of the weights behind the inputs, and of what words add to the gates."""
        grad = {"out": kept["pooled"].T @ error, "bias": error.sum(keepdims=True)}
        states, weight = kept["states"], kept["weight"]
        d_pooled = error[:, None] * self.w["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.w["attend"]
        given = {}
        for k, side in enumerate("fb"):
            gates, cand = self.w[f"gates_{side}"], self.w[f"cand_{side}"]
            own = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_given = np.zeros((*mask.shape[:2], 3 * HIDDEN), np.float32)
            d_gates, d_cand = np.zeros_like(gates), np.zeros_like(cand)
            dh = np.zeros(own.shape[1:], np.float32)
            for t, h, zr, c in reversed(kept["trace"][side]):
                dh = dh + own[t]
                z, r = zr[:, :HIDDEN] * mask[t], zr[:, HIDDEN:]
                dc = dh * z * (1 - c * c)
                drh = dc @ cand.T
                dz = dh * (c - h) * mask[t] * zr[:, :HIDDEN] * (1 - zr[:, :HIDDEN])
                dr = drh * h * r * (1 - r)
                dzr = np.hstack([dz, dr])
                d_given[t, :, : 2 * HIDDEN], d_given[t, :, 2 * HIDDEN :] = dzr, dc
                d_gates += h.T @ dzr
                d_cand += (r * h).T @ dc
                dh = dh * (1 - z) + drh * r + dzr @ gates.T
            grad[f"gates_{side}"], grad[f"cand_{side}"] = d_gates, d_cand
            given[side] = d_given
        return grad, given


def _gather(first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (time x windows) and mask of windows."""
    at = np.arange(int(size.max()))[:, None]
    mask = at < size
    place = np.minimum(first + at, len(ids) - 1)
    return np.where(mask, ids[place], 0), mask.astype(np.float32)[:, :, None]


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            fix = np.float32(np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn))
            self.weights[k] -= np.float32(self.rate) * fix * m / (np.sqrt(v) + np.float32(1e-6))


def train(texts: list[bytes | None], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> Network:
    """A network that tells texts of label 1 from those of label 0. Same input, same result."""
    net = Network()
    ids, ends, vocabulary = tokenize(texts)
    first, size, owner = _windows(ends)
    if not len(owner) or len(np.unique(labels)) < 2:
        return net
    rows = np.array([_word_row(w) for w in vocabulary])
    runs, lengths = _char_runs(vocabulary)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    rng = np.random.default_rng(5)
    adam = _Adam(net.w, rate)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for epoch in range(epochs):
        adam.rate = rate * (1 if epoch < epochs * 2 // 3 else 0.3)
        # Toxic texts train on their highest window, clean ones on it and a random one.
        given = net.gates(rows, runs, lengths)
        logit = _score(net, given, first, size, ids)
        order = np.lexsort((-logit, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        picked = [top, rng.choice(len(owner), min(len(owner), len(top) // 2), replace=False)]
        if epoch == 0:
            picked = [top, np.arange(len(owner))[rng.permutation(len(owner))[: 2 * len(top)]]]
        use = np.concatenate([picked[0], picked[1][labels[owner[picked[1]]] == 0]])
        use = use[rng.permutation(len(use))]
        for begin in range(0, len(use), 128):
            at = use[begin : begin + 128]
            words, mask = _gather(first[at], size[at], ids)
            seen, inverse = np.unique(words, return_inverse=True)
            inverse = inverse.reshape(words.shape)
            holder = np.repeat(np.arange(len(seen)), lengths[seen])
            place = np.arange(len(holder)) - np.repeat(np.cumsum(lengths[seen]) - lengths[seen], lengths[seen])
            own = runs[offsets[seen][holder] + place]
            x = net.inputs(rows[seen], own, lengths[seen])
            given = {s: g[inverse] for s, g in net.projected(x).items()}
            kept: dict = {}
            p = _sigmoid(net.forward(given, mask, kept))
            error = ((p - labels[owner[at]]) * weight[owner[at]] / len(at)).astype(np.float32)
            grad, d_given = net.backward(kept, mask, error)
            dx = np.zeros_like(x)
            for s in "fb":
                total = _scatter(inverse.ravel(), d_given[s].reshape(-1, 3 * HIDDEN), len(seen))
                grad[f"in_{s}"], grad[f"b_{s}"] = x.T @ total, total.sum(axis=0)
                dx += total @ net.w[f"in_{s}"].T
            grad["word"] = _scatter(rows[seen], dx[:, :WORD_DIM], WORD_ROWS)
            grad["word"] += np.float32(1e-4) * net.w["word"]
            part = dx[:, WORD_DIM:] / np.sqrt(np.maximum(lengths[seen], 1)).astype(np.float32)[:, None]
            grad["char"] = _scatter(own, part[holder], CHAR_ROWS)
            adam.step(grad)
    return net


def _score(net: Network, given: dict, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of all windows, in blocks of windows of like length."""
    out = np.empty(len(first), np.float32)
    order = np.argsort(size, kind="stable")
    for begin in range(0, len(order), 2048):
        at = order[begin : begin + 2048]
        words, mask = _gather(first[at], size[at], ids)
        out[at] = net.forward({s: given[s][words] for s in "fb"}, mask)
    return out


class Scorer:
    """Scores texts and remembers what words add to the gates."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.net = Network.__new__(Network)
        self.net.w = weights
        self.known: dict[bytes, int] = {}
        self.given = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def _table(self, vocabulary: list[bytes]) -> dict[str, np.ndarray]:
        if len(self.known) > _CACHE:
            self.known = {}
        new = [w for w in vocabulary if w not in self.known]
        if new:
            count = len(self.known)
            found = self.net.gates(np.array([_word_row(w) for w in new]), *_char_runs(new))
            for s, g in found.items():
                if count + len(new) > len(self.given[s]):
                    room = np.empty((2 * (count + len(new)), 3 * HIDDEN), np.float32)
                    room[:count] = self.given[s][:count]
                    self.given[s] = room
                self.given[s][count : count + len(new)] = g
            self.known.update(zip(new, range(count, count + len(new))))
        place = np.fromiter(map(self.known.__getitem__, vocabulary), np.int64, len(vocabulary))
        return {s: g[place] for s, g in self.given.items()}

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of label 1 for every text; a text without words gets the lowest."""
        out = np.full(len(texts), -np.inf, np.float32)
        ids, ends, vocabulary = tokenize(texts)
        if len(ids):
            first, size, owner = _windows(ends)
            logit = _score(self.net, self._table(vocabulary), first, size, ids)
            np.maximum.at(out, owner, logit)
        return _sigmoid(np.maximum(out, -30).astype(np.float64))


def sample(labelled: DataFrame, doc_id: str, label: str, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled rows, half of them of label 1 where there are so many,
    by the hash of their id: the same rows every time."""
    order = F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample"))
    ones = labelled.where(F.col(label) == 1).orderBy(order, doc_id).limit(most // 2)
    zeros = labelled.where(F.col(label) == 0).orderBy(order, doc_id).limit(most - most // 2)
    return ones.unionByName(zeros)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Train on documents with a label for which ``usable`` holds. Rows without an id, a
    text or a label are not used; without both labels the network stays as it begins. An id
    with both labels counts as 1; of an id's texts, however often it occurs, the last in
    order of bytes is used."""
    known = labels.where(F.col(label).isin(0, 1)).where(usable).groupBy(doc_id).agg(F.max(label).alias(label))
    chosen = sample(known, doc_id, label)
    found = (
        docs.select(doc_id, F.col(text).cast("binary").alias("text"))
        .join(F.broadcast(chosen), doc_id)
        .where("text is not null")
        .groupBy(doc_id, label)
        .agg(F.max("text").alias("text"))
        .orderBy(doc_id)
        .select("text", label)
        .toArrow()
    )
    return train(found["text"].to_pylist(), found[label].to_numpy().astype(np.float32))


def score_documents(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; null and empty texts get the lowest score."""
    weights = docs.sparkSession.sparkContext.broadcast({"w": net.w})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = weights.value
        if "scorer" not in held:  # stays with the worker, like the broadcast value
            held["scorer"] = Scorer(held["w"])
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(begin, _BATCH)
                score = held["scorer"](batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").schema.add("score", "double"))


def drop_toxic(docs: DataFrame, net: Network, limit: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``limit`` or more."""
    weights = docs.sparkSession.sparkContext.broadcast({"w": net.w})
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = weights.value
        if "scorer" not in held:
            held["scorer"] = Scorer(held["w"])
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(begin, _BATCH)
                texts = batch.column(place).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(held["scorer"](texts) < limit))

    return docs.mapInArrow(run, docs.schema)
