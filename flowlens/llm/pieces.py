"""Sub-word encoding with a merge-type piece model, by a table over prefixes.

For every prefix of a word the table holds the one token its encoding ends with. An
automaton over the vocabulary names the pieces that end at a position; the right one
is the piece that is compatible with the last token of the prefix before it, that is,
the two encode to themselves when put side by side. The ids are then read off from
the end backwards.

No piece has a space mark after another character, so no merge crosses the start of a
run of spaces, and each run with the word after it is encoded on its own. Characters
outside the vocabulary never merge; they split a word and become byte tokens.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
CACHE = 200_000  # distinct words a worker remembers before it starts anew
PAIRS = 1_000_000  # tested pairs of tokens a worker remembers before it starts anew


def read_model(path: str) -> dict:
    """Pieces, scores and special ids of a model file, read with its library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, scores, byte_ids = {}, {}, {}
    surface: list[bytes] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            plain[piece] = i
            scores[i] = model.get_score(i)
            surface.append(piece.replace(MARK, " ").encode())
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte tokens for unknown characters")
    if any(b == MARK and a != MARK for p in plain for a, b in zip(p, p[1:])):
        raise ValueError("the model has pieces that cross the start of a word")
    return {
        "plain": plain,
        "scores": scores,
        "bytes": [byte_ids[b] for b in range(256)],
        "surface": surface,
        "begin": model.bos_id(),
        "end": model.eos_id(),
    }


class Encoder:
    """Encodes and decodes texts with the tables of ``read_model``."""

    def __init__(self, model: dict):
        self.model = model
        self.plain, self.scores = model["plain"], model["scores"]
        self.text_of = {i: p for p, i in self.plain.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.plain.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.singles = {p for p in self.plain if len(p) == 1}
        # The place before a word is a token of empty text, which is compatible with
        # the tokens that encode to themselves.
        self.start = len(model["surface"])
        self.text_of[self.start] = ""
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.head = np.array([model["begin"]], "<u4").tobytes()
        self.tail = np.array([model["end"]], "<u4").tobytes()

    def merged(self, text: str) -> list[str]:
        """The defining procedure: join the best neighbours, the leftmost first."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                joined = self.plain.get(parts[i] + parts[j])
                if joined is not None:
                    heapq.heappush(queue, (-self.scores[joined], i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, left, right = heapq.heappop(queue)
            if parts[i] != left or parts[j] != right or after[i] != j:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        a, b = self.text_of[left], self.text_of[right]
        return self.merged(a + b) == ([a, b] if a else [b])

    def run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        last = [-1] * (len(text) + 1)
        begins = last[:]
        last[0] = self.start
        compatible, stride = self.compatible, self.start + 1
        if len(compatible) > PAIRS:
            compatible.clear()
        for at, (size, token) in self.automaton.iter(text):
            end = at + 1
            if last[end] < 0:
                left = last[end - size]
                if left >= 0:
                    right = compatible.get(left * stride + token)
                    if right is None:
                        right = compatible[left * stride + token] = (
                            self.follows(left, token)
                        )
                    if right:
                        last[end], begins[end] = token, end - size
        out = []
        at = len(text)
        while at:
            if last[at] < 0:
                raise ValueError("no token ends the prefix; the model is not of the merge type")
            out.append(last[at])
            at = begins[at]
        out.reverse()
        return out

    def word(self, word: str) -> bytes:
        """Ids of one run of marks and the word after it, as little-endian numbers."""
        if self.singles.issuperset(word):
            return self.packed(self.run(word))
        out: list[int] = []
        begin = 0
        for i, char in enumerate(word):
            if char not in self.singles:
                if begin < i:
                    out += self.run(word[begin:i])
                out += [self.model["bytes"][b] for b in char.encode()]
                begin = i + 1
        if begin < len(word):
            out += self.run(word[begin:])
        return self.packed(out)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, with begin and end, as little-endian 32-bit numbers."""
        if not text:
            return self.head + self.tail
        cache, out, marks = self.cache, [self.head], ""
        # The text gets one mark before it; a mark in the text is a space to the model.
        for word in text.replace(MARK, " ").split(" "):
            marks += MARK
            if not word:
                continue
            word, marks = marks + word, ""
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.word(word)
                if len(word) <= 64:
                    cache[word] = ids
            out.append(ids)
        if marks:
            out.append(self.word(marks))
        out.append(self.tail)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: surfaces joined, without the space put before the text."""
        surface = self.model["surface"]
        data = b"".join(map(surface.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the ids of every text and the text they decode to.

    Ids are little-endian unsigned 32-bit numbers in a binary column, with begin and
    end. A null or empty text has these two only and decodes to the empty text. All
    input columns stay, but ``ids`` and ``decoded`` replace columns of these names.
    Repeated rows stay. The file is read by the driver; tasks get its tables.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType(
        [f for f in rows.schema.fields]
        + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())]
    )
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The broadcast value stays in a worker, and with it what its tasks remember.
        tables = model.value
        encoder = tables.get("encoder")
        if encoder is None:
            encoder = tables["encoder"] = Encoder(tables)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = [encoder.encode(t) for t in part.column(place).to_pylist()]
                texts = [encoder.decode(np.frombuffer(f, "<u4")) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.binary()), pa.array(texts, pa.string())],
                    names=[*kept, ids, decoded],
                )

    return rows.mapInArrow(run, schema)


def digest(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded text."""
    return encoded.select(
        doc_id,
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


