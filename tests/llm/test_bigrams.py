"""The language model whose contexts are words, against counting and its own tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import bigrams, language, queries
from llm.test_native import documents
from llm.test_scoring import is_held, lm_texts, lm_tokens

def held():
    return language.held_out(F.col("doc_id"))


def number(word):
    return int(language.hashes([word]).view(np.int64)[0])


def pairs_of(text):
    tokens = lm_tokens(text)
    return list(zip([b" ", *tokens[:-1]], tokens))


def test_contexts_are_words(spark, tmp_path):
    """Two words that end alike are two contexts, in the query's scores."""
    rng = random.Random(4)
    ids = [i for i in range(400) if not is_held(i)]
    asked = [i for i in range(400) if is_held(i)][:2]
    texts = {i: " ".join(rng.choice(["northing cold", "southing warm"]) for _ in range(20)) for i in ids}
    texts |= dict(zip(asked, ["northing cold", "northing warm"]))
    docs = documents(spark, list(texts.values()), ids=list(texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op4_language(spark, str(tmp_path)).collect()}
    assert got[asked[0]] > got[asked[1]] + 1


@pytest.mark.parametrize("head", [65_000, 3])
def test_scores(spark, monkeypatch, head):
    """Counts by counting, scores by the model's own tables, for frequent words and others."""
    monkeypatch.setattr(bigrams, "HEAD", head)
    texts = lm_texts()
    docs = documents(spark, texts)
    model = bigrams.learn(docs, ~held())
    learnt = [t for i, t in enumerate(texts) if not is_held(i)]
    counts = Counter(w for t in learnt for w in lm_tokens(t))
    followed = Counter(p for t in learnt for p in pairs_of(t))
    customers = Counter(c for t in learnt for c, _ in pairs_of(t))
    total, words = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (total, words)
    info = {r["w"]: r for r in model.info.collect()}
    cells = {(r["c"], r["w"]): r["direct"] for r in model.cells.collect()}
    assert len(info) == model.info.count() and len(cells) == model.cells.count()
    for (c, w), n in followed.items():
        direct = cells.get((number(c), number(w)))
        assert n == 1 or 0 <= direct <= n - 0.7 + 1e-9
        if n == 1 and direct is not None:
            assert direct == pytest.approx(0.3)

    def above(w):
        if counts[w] and number(w) in info:
            row = info[number(w)]
            assert row["n"] == counts[w]
            return [row["above1"], row["above2"]]
        return model.once if counts[w] else model.never

    def leaves(c):
        if number(c) in info:
            return [info[number(c)]["leaves1"], info[number(c)]["leaves2"]]
        return [bigrams._leaves(1, 1) if customers[c] else 1] * 2

    def p(c, w):
        direct = cells.get((number(c), number(w)), 0.3) if followed[c, w] else 0
        return direct / (5 + customers[c]) + np.dot(above(w), leaves(c)) / 2

    for c in [b" ", b"the", b"cat", b"one", b"never"]:
        rest = np.dot(model.never, leaves(c)) / 2  # one share of the base for all unknown words
        assert sum(p(c, w) for w in counts) + rest == pytest.approx(1)

    got = {r["doc_id"]: r for r in bigrams.score(docs, ~held(), model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        tokens = lm_tokens(text)
        assert got[i]["n_tokens"] == len(tokens)
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in tokens)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (words + 1))) for w in tokens)
        assert got[i]["base_score"] == pytest.approx(base)
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(c, w)) for c, w in pairs_of(text)))


def test_beats_classes_of_endings(spark):
    """Held-out log10 probability a word, of this model and of the one by endings."""
    rng = random.Random(9)
    after = defaultdict(list)
    words = [f"{rng.choice('bdgklmnprst')}{i}ing" for i in range(300)]
    for w in words:
        after[w] = rng.sample(words, 3)
    texts = []
    for _ in range(300):
        text = [rng.choice(words)]
        while len(text) < 80:
            text.append(rng.choice(after[text[-1]]))
        texts.append(" ".join(text))
    docs = documents(spark, texts)
    new = bigrams.score(docs, ~held(), bigrams.learn(docs, ~held()))
    old = language.score(docs, language.learn(docs.where(~held())))
    each = []
    for scored in (new, old):
        rows = scored.where(held()).collect()
        each.append(sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    print("log10 a word by words, by endings:", each)
    assert each[0] > each[1] + 0.5


def test_odd_tables(spark):
    docs = documents(spark, ["a b", "a b", None, "c", "x y " * 50_000], ids=[1, 1, None, None, 7])
    assert zlib.crc32(b"1") % 5 != 1
    rows = bigrams.score(docs, ~held(), bigrams.learn(docs, ~held())).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 2, 7: 1}
    assert {r["n_tokens"] for r in rows} == {3, 1, 2, 100_001}
    none = bigrams.learn(docs, F.lit(None).cast("boolean"))
    assert (none.tokens, none.words) == (0, 0)
    rows = bigrams.score(docs, F.lit(False), none).collect()
    assert len(rows) == 5 and {r["n_known"] for r in rows} == {0}
    empty = bigrams.learn(docs.limit(0), ~held())
    assert bigrams.score(docs.limit(0), ~held(), empty).collect() == []


def test_cut_runs():
    assert bigrams._cut(np.array([0, 3, 10]), 11, 3).tolist() == [0, 3, 6, 9, 10]
    assert bigrams._cut(np.zeros(0, int), 0, 3).tolist() == []
