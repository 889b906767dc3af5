"""Toxicity, quality, language model and pieces on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from flowlens.llm import language, pieces, quality, toxicity
from llm.test_native import WORD, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or [a + b for a in ("ba", "to", "mi", "lu", "ke") for b in ("n", "ra", "st", "", "lo")]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# Pieces


def piece_texts():
    rng = random.Random(8)
    texts = [
        None, "", " ", "  ", "a  b   c ", "a\n\n b\t\tc", "▁x ▁▁ y", " " * 999 + "z" + " " * 333,
        "<s> </s> <unk> <0x0A>", "é\x00ﬁ 　日本語🙂 x", "aaaa" * 300, "a" * 5000, "▁", "�", " \n ",
        "word " * 20000,
    ]
    alphabet = "ab e\n ▁tTh  日éx1.,-()\t"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    parts = [" ", "  ", "    ", "\n", "a", " the", "ing", "ation", "▁"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    return texts


def test_pieces_like_the_library(spark):
    texts = piece_texts()
    docs = documents(spark, texts).withColumn("ids", F.lit("clash"))
    encoded = pieces.encode_documents(docs, MODEL)
    assert encoded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    got = {r["doc_id"]: r for r in pieces.digest(encoded).collect()}
    plain = {r["doc_id"]: r["decoded"] for r in encoded.select("doc_id", "decoded").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in enumerate(texts):
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        data = np.array(ids, "<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids), repr(text)
        assert got[i]["ids_sha256"] == hashlib.sha256(data).hexdigest(), repr(text)
        assert plain[i] == model.decode(ids), repr(text)
        assert got[i]["decoded_sha256"] == hashlib.sha256(plain[i].encode()).hexdigest()
    assert pieces.encode_documents(docs.limit(0), MODEL).collect() == []


def test_pieces_forget(monkeypatch):
    """Small caches give the same ids."""
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    encoder = pieces.Encoder(pieces.read_model(MODEL))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in piece_texts()[1:300]:
        ids = np.array(model.encode(text, add_bos=True, add_eos=True), "<u4")
        assert encoder.encode(text) == ids.tobytes()


# Toxicity


def test_gradients():
    """Analytic gradients against differences."""
    net = toxicity.Network(3)
    rng = np.random.default_rng(1)
    for name in net.w:
        net.w[name] = net.w[name].astype(np.float64)
    x = rng.standard_normal((5, toxicity.INPUT))
    words = rng.integers(0, 5, (6, 4))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 5])).astype(float)[:, :, None]
    labels = np.array([1.0, 0, 1, 0])

    def loss():
        logit = net.forward({s: g[words] for s, g in net.projected(x).items()}, mask)
        return float(np.sum(np.log1p(np.exp(logit)) - labels * logit))

    kept: dict = {}
    logit = net.forward({s: g[words] for s, g in net.projected(x).items()}, mask, kept)
    grad, _ = net.backward(kept, mask, 1 / (1 + np.exp(-logit)) - labels)
    for name in ("out", "bias", "attend", "gates_f", "gates_b", "cand_f", "cand_b"):
        for at in list(np.ndindex(net.w[name].shape))[:6]:
            old = net.w[name][at]
            net.w[name][at] = old + 1e-3
            up = loss()
            net.w[name][at] = old - 1e-3
            down = loss()
            net.w[name][at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3), (name, at)


def toxic_rows(n):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = prose(rng, rng.choice([5, 30, 200])).split()
        bad = i % 3 == 0
        for _ in range(2 * bad):
            words.insert(rng.randint(0, len(words)), rng.choice(["grolm", "vexx"]) + rng.choice(["en", "ation", "o", "ix", "ure"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(i, t, "kept") for i, t, _ in rows], "doc_id bigint, text string, score string")
    odd = spark.createDataFrame([(None, "grolmation", "x"), (-1, None, "x"), (-2, "", "x"), (-3, " \n", "x")], docs.schema)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    held = language.held_out(F.col("doc_id"), 0)
    net = toxicity.fit(docs.unionByName(odd), labels.where("doc_id is null or doc_id <> 5"), ~held)
    scored = toxicity.score_documents(docs.unionByName(odd).unionByName(docs.limit(3)), net)
    got = scored.withColumn("held", held).collect()
    assert len(got) == len(rows) + 4 + 3
    truth = {i: y for i, _, y in rows}
    out = [(r["score"] >= 0.5) == (truth[r["doc_id"]] == 1) for r in got if r["held"] and r["doc_id"] in truth]
    assert len(out) > 100 and np.mean(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (-1, -2, -3))
    kept = toxicity.drop_toxic(docs, net).collect()
    low = {r["doc_id"] for r in got if r["score"] < 0.5}
    assert {r["doc_id"] for r in kept} == low & set(truth)
    assert kept[0]["score"] == "kept"


def test_every_window_counts():
    """A bad word anywhere in a long text is found, and batches do not matter."""
    rows = toxic_rows(600)
    net = toxicity.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32))
    clean = prose(random.Random(6), 3000).split()
    scorer = toxicity.Scorer(net.w)
    assert scorer([" ".join(clean).encode()])[0] < 0.5
    texts = [" ".join([*clean[:at], "grolmix", "vexxure", *clean[at:]]).encode() for at in (0, 777, 1500, 2999)]
    together = scorer(texts + [None, b""])
    assert (together[:4] >= 0.5).all() and (together[4:] < 0.5).all()
    assert np.allclose([scorer([t])[0] for t in texts], together[:4], atol=1e-5)


def test_training_reads_all_of_long_texts(monkeypatch):
    """Every pass looks for the highest window among all windows, up to the last word."""
    rng = random.Random(12)
    texts = [prose(rng, n).encode() for n in (5, 3000, 900, 7001, 0, 40)]
    seen, score = [], toxicity._score

    def spy(net, given, first, size, ids):
        seen.append(np.zeros(len(ids), int))
        for begin, n in zip(first, size):
            seen[-1][begin : begin + n] += 1
        return score(net, given, first, size, ids)

    monkeypatch.setattr(toxicity, "_score", spy)
    toxicity.train(texts, np.array([0, 1, 0, 1, 0, 1], np.float32), epochs=2)
    assert len(seen) == 2
    assert all(len(n) == 5 + 3000 + 900 + 7001 + 40 and (n > 0).all() for n in seen)


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    net = toxicity.fit(docs, none, F.lit(True))
    assert len(toxicity.score_documents(docs, net).collect()) == 2
    assert toxicity.score_documents(docs.limit(0), net).collect() == []


# Quality


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    filled = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] >= 2:
            hit |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(line in filled[:i] for i, line in enumerate(filled)), len(hit), len(filled), len(set(words)),
    )


def quality_texts():
    rng = random.Random(12)
    texts = [
        None, "", " \n\t", "one", "a a a a", "a b c a b c", "é # 日本 | x\n\né # 日本 | x\n y", "x" * 9000,
        "a b\na b\n a b\n\x0b\n\x0b", "w " * 3000, "no break space #",
    ]
    texts += [prose(rng, rng.choice([3, 30, 60, 90])) + rng.choice(["", "\nsame line here", "\n#|", "\n\n"]) for _ in range(150)]
    return texts


def test_statistics(spark):
    texts = quality_texts()
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in quality.statistics(docs, "doc_id", "text", "lang", "source").collect()}
    for i, text in enumerate(texts):
        r = got[i]
        found = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"))
        assert found == plain_statistics(text), repr(text)
    rows = quality.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, _, _, _, repeat, *_ = plain_statistics(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(docs.limit(0)).collect() == []


def plain_mcd(x, share=quality.CORE):
    """The estimate by exact concentration steps from many random starts."""
    rng = np.random.default_rng(0)
    h = int(np.ceil(share * len(x)))
    best = None
    floor = np.diag(quality.FLOORS**2)
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, quality.P), quality.P + 2)
    for _ in range(30):
        part = x[rng.choice(len(x), quality.P + 2, replace=False)]
        for _ in range(30):
            mean = part.mean(axis=0)
            cov = np.cov(part.T, bias=True) * factor + floor
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            part = x[np.argsort(d)[:h]]
        spread = np.linalg.slogdet(cov)[1]
        if best is None or spread < best[0]:
            best = spread, mean, cov
    _, mean, cov = best
    d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    part = x[d <= quality.chi2_quantile(0.975, quality.P)]
    mean, cov = part.mean(axis=0), np.cov(part.T, bias=True) + floor
    return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)


def test_outliers(spark):
    rng = random.Random(3)
    texts, sources = [], []
    for i in range(900):
        junk = i % 10 == 0
        words = prose(rng, rng.randint(60, 300)).split()
        if junk:
            words = [w + rng.choice(["#", "|", "***", "$$"]) for w in words]
        texts.append(" ".join(words))
        sources.append(rng.choice(["a", "a", "a", "b", None, "tiny"] if i % 90 else ["rare"]))
    docs = documents(spark, texts, sources)
    got = {r["doc_id"]: r for r in quality.judge(docs, least_group=60).collect()}
    ok = [not got[i]["kept"] for i in range(0, 900, 10) if not got[i]["base_failed"]]
    wrong = [not got[i]["kept"] for i in range(900) if i % 10 and not got[i]["base_failed"]]
    assert np.mean(ok) == 1 and np.mean(wrong) < 0.01

    # Distances of the largest group against the exact steps.
    stats = quality.statistics(docs, "doc_id", "text", "lang", "source").where("lang = 'en' and source = 'a'")
    rows = stats.select("doc_id", *quality.features()).collect()
    rows = [r for r in rows if not got[r[0]]["base_failed"]]
    exact = plain_mcd(np.array([r[1:] for r in rows], float))
    mine = np.array([got[r[0]]["distance"] for r in rows])
    assert np.corrcoef(np.log(exact), np.log(mine))[0, 1] > 0.98
    assert np.median(np.abs(np.log(exact / mine))) < 0.15


def test_chi2():
    draws = np.random.default_rng(1).standard_normal((200_000, 6))
    d = (draws**2).sum(axis=1)
    for q in (0.5, 0.75, 0.975):
        assert (d <= quality.chi2_quantile(q, 6)).mean() == pytest.approx(q, abs=0.01)


# Language model


def lm_texts():
    rng = random.Random(7)
    texts = [None, "", " ", "One one ONE", "new\nline\ttab", "a" * 3000, "ärger ÄRGER", "x y " * 2000]
    groups = [["the", "cat", "sat", "on", "a", "mat"], ["der", "hund", "lief", "in", "das", "haus"]]
    for i in range(300):
        texts.append(prose(rng, rng.choice([1, 8, 60]), groups[i % 2] + [f"rare{rng.randint(0, 400)}"]))
    return texts


def lm_tokens(text):
    return [w for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())] + [b"\n"]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def lm(spark):
    texts = lm_texts()
    docs = documents(spark, texts)
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    return texts, docs, model


@pytest.mark.parametrize("head", [8_192, 4])
def test_language(spark, lm, monkeypatch, head):
    """Base scores by counting; scores by the model's own table; head and tail agree."""
    texts, docs, model = lm
    monkeypatch.setattr(language, "HEAD", head)
    counts = Counter(w for i, t in enumerate(texts) if not is_held(i) for w in lm_tokens(t))
    total, words = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (total, words)
    table = {}
    for r in model.table.collect():
        own = dict(zip(np.frombuffer(r["ctx"], "u1").tolist(), np.frombuffer(r["own"], "<f4").tolist()))
        table[r["w"]] = (r["c"], own, np.frombuffer(r["above"], "<f4").astype(float))
    got = {r["doc_id"]: r for r in language.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        tokens = lm_tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (words + 1))) for w in tokens)
        expected, before = 0.0, None
        for w in tokens:
            ctx = 0 if before is None else int(language.hashes([before[-3:]])[0] % np.uint64(255)) + 1
            c, own, above = table.get(int(language.hashes([w]).view(np.int64)[0]), (0, {}, model.unknown))
            assert c == counts[w]
            expected += math.log10(own.get(ctx, 0) + float(model.leaves[:, ctx] @ above) / language.KEPT)
            before = w
        row = got[i]
        assert row["n_tokens"] == len(tokens)
        assert row["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert row["base_score"] == pytest.approx(base)
        assert row["score"] == pytest.approx(expected, rel=1e-4)


def test_probabilities_sum_to_one(lm):
    """Over all known words and the unknown one, in contexts with and without words."""
    _, _, model = lm
    total = model.unknown @ model.leaves / language.KEPT
    for r in model.table.collect():
        total += np.frombuffer(r["above"], "<f4") @ model.leaves / language.KEPT
        np.add.at(total, np.frombuffer(r["ctx"], "u1"), np.frombuffer(r["own"], "<f4"))
    assert np.allclose(total, 1, atol=1e-3)


def test_model_beats_the_base(spark, lm):
    texts, docs, model = lm
    rows = [r for r in language.score(docs, model).collect() if is_held(r["doc_id"]) and r["n_tokens"] > 5]
    assert len(rows) > 20
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_seating():
    """Mean number of tables against seating customers one at a time."""
    rng = np.random.default_rng(2)
    for customers, new, discount in ((5, 0.3, 0.7), (200, 2.0, 0.7), (3000, 1.0, 0.5)):
        mine = language._seat(np.full(400, customers), np.full(400, new), discount, rng).mean()
        tables = []
        for _ in range(150):
            t = 1
            for seated in range(1, customers):
                t += rng.random() < new / (new + seated - discount * t)
            tables.append(t)
        assert mine == pytest.approx(np.mean(tables), rel=0.12)


def test_language_of_odd_tables(spark):
    docs = documents(spark, ["a b", "a b", None, "c"], ids=[1, 1, None, None])
    model = language.learn(docs)
    rows = language.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 2}
    empty = language.learn(docs.limit(0))
    assert (empty.tokens, empty.words) == (0, 0)
    assert len(language.score(docs, empty).collect()) == 4
    assert language.score(docs.limit(0), model).collect() == []
