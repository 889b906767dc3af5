"""Golomb codes, and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import exact, hot

SCHEMA = "doc_id bigint, text string, sender string, slot int, sha string, doc int, best string, bits int"
SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


@given(st.sets(st.integers(0, (1 << exact.BITS) - 1), min_size=1), st.integers(1, 1 << 14), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_come_back(values, owners, data):
    owner = data.draw(st.integers(0, owners - 1))
    low = exact.lowest(owner, owners)
    values = np.array(sorted(v for v in values if v >= low) or [low], np.int64)
    assert np.array_equal(exact.decode(exact.encode(values, low), low), values)


def test_codes_are_small():
    """About the entropy of the gaps: 48 bits less those of their number, and two or so."""
    rng = np.random.default_rng(0)
    for n in (1000, 100_000):
        values = np.unique(rng.integers(0, 1 << exact.BITS, n))
        bits = 8 * len(exact.encode(values, 0)) / len(values)
        assert bits < exact.BITS - np.log2(n) + 2.2


def corpus(rng):
    texts = [None, "", " \n\t", "é x", "é x", "a b", "ab", "a  b", " ", "word " * 40_000, "word" * 40_000]
    texts += [f"text {rng.randint(0, 60)}" + " " * rng.randint(0, 4) for _ in range(300)]
    texts += [f"only {i}" for i in range(200)] + ["hot copy"] * 200 + ["hot copy "] * 3
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], rows[5], rows[5], (None, "hot copy "), (None, "ab"), (None, "nameless"), (None, "nameless")]


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        groups[text.translate(SPACE)].append((-len(text), doc_id is None, doc_id, text))
    out = []
    for text, members in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], members[0][2], len(members), i == 0, sha) for i, m in enumerate(members)]
    return sorted(out, key=repr)


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(*r, "x", i, "y", i, "z", i) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("sender_rows, rows_of_hot", [(exact.SENDER_ROWS, hot.ROWS), (16, 50)])
def test_classes(spark, monkeypatch, sender_rows, rows_of_hot):
    monkeypatch.setattr(hot, "ROWS", rows_of_hot)
    rows = corpus(random.Random(12))
    found = exact.find(frame(spark, rows), sender_rows=sender_rows)
    found = found.select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_suspects_are_few(spark):
    """Rows that are alone are not shuffled with their texts."""
    rows = [(i, f"text {i}") for i in range(500)] + [(1000 + i, "twice") for i in range(2)]
    stored, bits = exact.exchange(frame(spark, rows), "text", ["doc_id"], 64)
    marked = sum(bin(int.from_bytes(r["bits"], "little")).count("1") for r in bits.collect())
    assert marked == 2 and stored.count() == len(rows)


def test_other_columns_stay(spark):
    rows = corpus(random.Random(5))
    docs = frame(spark, rows)
    kept = exact.drop_repeats(docs)
    assert kept.schema == docs.schema
    given_rows = {repr(tuple(r)) for r in docs.collect()}
    found = [tuple(r) for r in kept.collect()]
    assert all(repr(r) in given_rows for r in found)
    assert sorted((r[0] for r in found), key=repr) == sorted((e[0] for e in expected(rows) if e[3]), key=repr)


def test_empty(spark):
    docs = frame(spark, corpus(random.Random(1))).limit(0)
    assert exact.find(docs).count() == 0 and exact.drop_repeats(docs).count() == 0
