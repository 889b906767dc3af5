"""Words, split by ASCII white space, as columns and inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null, empty or blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenize(texts: list[bytes | None], lower: bool = True):
    """Words of many texts as numbers: ``(ids, ends, vocabulary)``.

    ``ids`` are positions in ``vocabulary`` (distinct words as bytes), one per word;
    the words of text i end before ``ends[i]``. bytes.split() splits on exactly the
    six ASCII white-space characters and bytes.lower() changes only A-Z.
    """
    known: dict[bytes, int] = _Numbering()
    number = known.__getitem__
    ids: list[int] = []
    ends = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            ids.extend(map(number, (text.lower() if lower else text).split()))
        ends[i] = len(ids)
    return np.array(ids, np.int64), ends, list(known)


class _Numbering(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def hashes(vocabulary: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hash: np.ndarray, ends: np.ndarray, size: int):
    """Hashes of all runs of ``size`` words, and the text each run is from.

    A text of fewer words gives its whole sequence as one run; a text without words
    gives none.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = ends - starts
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(ends)), runs)
    first = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(len(owner))
    last = ends[owner]
    out = np.full(len(owner), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(size):
        at = first + k
        inside = at < last
        word = np.where(inside, word_hash[np.minimum(at, len(word_hash) - 1)], np.uint64(0)) if len(owner) else out
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word + np.where(inside, np.uint64(k + 1), np.uint64(0)))
    return out, owner


def distinct(values: np.ndarray, owner: np.ndarray):
    """Distinct ``(owner, value)`` pairs, ordered by owner, then value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]
