"""The filter audit against brute force over every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from flowlens.llm import audit, hot

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, id int, part string, digest string, done int, good string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus():
    rng = random.Random(13)
    plain = [f"w{i}" for i in range(200)]
    texts = [None, "", "  \n ", "A" * 40, "one two", "$" + " a" * 80, " ".join(plain), "é " + " ".join(plain)]
    texts += [" ".join(plain[:60]) + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * rng.randint(0, 2) for _ in range(10)]
    for _ in range(60):
        words = [rng.choice(plain[: rng.choice([20, 200])]) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.4:
            words[0] = rng.choice("#$%&*|")
        if rng.random() < 0.4:
            words = [w.upper() for w in words]
        texts.append(" ".join(words))
    texts += ["a repeated text"] * 120 + [" ".join(plain)] * 5 + ["long " * 30_000, "Long$ " * 30_000]
    rows = [(i, t, rng.choice(["s0", "s1", "", None, "S"])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[3], rows[3], (None, "a repeated text", "s0"), (None, "alone", None), (None, "alone", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, len(texts), 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    return rows, labels


def fails(doc_id, text, least):
    words = WORD.findall(text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if least is not None and (doc_id is None or doc_id > least):
        out.add("E")
    return out


def expected(rows, labels):
    ids = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids[text or ""] = min(doc_id, ids.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    facts = [(p or "", fails(d, t or "", ids.get(t or "")), d in good, d in toxic) for d, t, p in rows]
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        here = [f[1:] for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[0]]
                left = [f for f in left if letter not in f[0]]
                every = [f for f in here if letter in f[0]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), len(every) - len(gone), sum(f[0] == {letter} for f in here),
                    sum(f[1] for f in gone), sum(f[2] for f in gone), letter,
                )
    return sorted((*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in out.items())


COLUMNS = (
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
    "toxic_lost", "shapley",
)


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "x", "y", 3, "z") for r in rows], SCHEMA)
    said = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    return sorted(tuple(r) for r in audit.audit(docs, said).select(*COLUMNS).collect())


@pytest.mark.parametrize("rows_of_hot", [hot.ROWS, 20])
def test_every_order(spark, monkeypatch, rows_of_hot):
    """Also with texts of more than 20 rows taken for hot ones."""
    monkeypatch.setattr(hot, "ROWS", rows_of_hot)
    rows, labels = corpus()
    assert found(spark, rows, labels) == expected(rows, labels)


def test_no_labels_and_no_failures(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "s")]
    assert found(spark, rows, []) == expected(rows, [])


def test_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [(1, 1, 1)]) == []


def test_survivors_are_not_broadcast(spark, monkeypatch):
    """However small the files of the survivors are: their rows are what counts."""
    plans, store = [], audit.materialize

    def stored(df, label):
        if label == "counts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(audit, "materialize", stored)
    rows, labels = corpus()
    assert found(spark, rows, labels) == expected(rows, labels)
    assert len(plans) == 3 and not any("Broadcast" in plan for plan in plans)
