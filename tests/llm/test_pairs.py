"""Near-duplicates, line deduplication and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import lines, linking, minhash
from llm.test_native import WORD, documents


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_texts():
    rng = random.Random(21)
    texts = [None, "", " \n", "one", "ONE", "one two", "Éa éa", "a a a a a", "a a a a", "x" * 3000]
    vocabulary = [f"w{i}" for i in range(500)]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 150]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = words[:]
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    # A chain: each is near the next, the ends are not near each other.
    words = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(25):
        words = words[:]
        words[3 * i] = f"new{i}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    texts = near_texts()
    docs = documents(spark, texts)
    sets = [shingle_set(t, size) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    expected = components(range(len(texts)), links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size, percent).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert got[i]["n_shingles"] == len(s)
        assert got[i]["component_id"] == expected[i]
        assert got[i]["kept"] == (expected[i] == i)
    assert len(set(expected.values())) < len(texts) - 60


def test_near_duplicates_odd_tables(spark):
    text = "some words that are long enough to count here"
    docs = documents(spark, [text, text, text, None, text + " x", "else"], ids=[4, 4, None, 4, 2, 9])
    rows = minhash.near_duplicates(docs, 1, 80).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_shingles"]) for r in rows) == [
        (-1, -1, 9), (2, 2, 10), (4, 2, 9), (4, 2, 9), (4, 4, 0), (9, 9, 1),
    ]
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    out = minhash.drop_near_duplicates(docs, size=1)
    assert out.columns == docs.columns


def test_sketches_fill_and_estimate():
    """Every bin is filled, and equal bins estimate the similarity."""
    rng = np.random.default_rng(3)
    bins = 240
    for n in (1, 2, 7, 1000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        out = minhash.sketches(a, np.zeros(n, np.int64), 1, bins)
        assert (out != minhash._EMPTY).all()
    found = []
    for _ in range(30):
        common = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
        owner = np.repeat([0, 1], 80)
        out = minhash.sketches(np.concatenate([a, b]), owner, 2, bins)
        alone = minhash.sketches(b, np.zeros(80, np.int64), 1, bins)
        assert (out[1] == alone[0]).all()
        found.append((out[0] == out[1]).mean())
    assert np.mean(found) == pytest.approx(0.6, abs=0.02)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in linking.components(df).collect()}
    expected = components({n for link in links for n in link}, links)
    single = {n for n in expected if all(a == b for a, b in links if n in (a, b))}
    assert got == {n: c for n, c in expected.items() if n not in single}


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_link_groups_loses_no_link(spark, monkeypatch, broadcast_rows):
    """Links that are in one bucket only, and not with its hub, with and without broadcasts."""
    monkeypatch.setattr(linking, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(4)
    members = [(b, i, rng.random() < 0.5) for b in range(30) for i in rng.sample(range(120), 14)]
    good = {(min(a, b), max(a, b)) for a in range(120) for b in range(120) if a != b and (a * b) % 11 == 3}
    df = spark.createDataFrame(members, "bucket bigint, id bigint, lead boolean")
    table = spark.createDataFrame(sorted(good), "a bigint, b bigint")
    got = linking.link_groups(df, lambda pairs: pairs.join(table, ["a", "b"]))
    got = {r["id"]: r["component"] for r in got.collect()}
    buckets = defaultdict(list)
    for b, i, lead in members:
        buckets[b].append((i, lead))
    links = {
        (min(i, j), max(i, j)) for m in buckets.values() for i, a in m for j, b in m if i != j and (a or b)
    } & good
    # The hub is compared with all of its bucket, so more links than these may hold.
    expected = components(range(120), links)
    for i in range(120):
        for j in range(i):
            if expected[i] == expected[j]:
                assert got[i] == got[j]
    allowed = components(range(120), good)
    assert all(allowed[i] == allowed[c] for i, c in got.items())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_edit_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for i in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "é", "b"])
        rows.append((i, -i, a, "".join(b)))
    rows += [(601, -601, "a" * 3000 + "x" + "b" * 3000, "a" * 2999 + "x" + "b" * 3001), (602, -602, "", "")]
    df = spark.createDataFrame(rows, "a bigint, b bigint, line_a string, line_b string")
    expected = {i for i, _, a, b in rows if abs(len(a) - len(b)) <= edits and (len(a) > 99 or distance(a, b) <= edits)}
    expected -= {601} if edits < 2 else set()
    assert {r["a"] for r in lines._near(df, edits).collect()} == expected
    direct = df.where(lines.edit_distance(F.col("line_a"), F.col("line_b"), edits) <= edits)
    assert {r["a"] for r in direct.collect()} == expected


def line_docs():
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdé fgh") for _ in range(rng.choice([5, 19, 20, 25, 40, 90]))) for _ in range(40)]
    base += ["a" * 30, "ab" * 15, "a" * 31, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaab"]

    def changed(line):
        out = list(line)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            p = rng.randint(0, len(out))
            out[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
        return "".join(out)

    texts = [None, "", "\n", " \n\t\n", base[0], base[0], f"{base[1]}\n{base[1]}\n", "x" * 4000 + "\n" + "x" * 4000]
    for _ in range(60):
        texts.append("\n".join(changed(rng.choice(base)) if rng.random() < 0.8 else "" for _ in range(rng.randint(1, 9))))
    return texts


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_lines(spark, edits):
    texts = line_docs()
    docs = documents(spark, texts)
    where = [
        (i, pos, line) for i, t in enumerate(texts) if t
        for pos, line in enumerate(t.split("\n")) if WORD.search(line)
    ]
    different = sorted({line for *_, line in where})
    links = [
        (a, b) for i, a in enumerate(different) for b in different[:i]
        if len(a) >= 20 and len(b) >= 20 and abs(len(a) - len(b)) <= edits and len(a) < 1000 and distance(a, b) <= edits
    ]
    group = components(different, links)
    firsts = {}
    gone = defaultdict(list)
    for i, pos, line in sorted(where):
        if firsts.setdefault(group[line], (i, pos)) != (i, pos):
            gone[i].append(pos)
    got = {r["doc_id"]: r for r in lines.summary(docs, edits=edits).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i]["repeated"] == ",".join(map(str, gone[i])), i
        assert got[i]["n_lines"] == sum(d == i for d, *_ in where)
        assert got[i]["n_repeated"] == len(gone[i])
    assert sum(map(len, gone.values())) > 50
    out = lines.drop_repeated_lines(docs, edits)
    assert out.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, text in enumerate(texts):
        left = None if text is None else "\n".join(
            line for pos, line in enumerate(text.split("\n")) if pos not in gone[i]
        )
        assert after[i] == left


def test_lines_of_odd_tables(spark):
    docs = documents(spark, ["a b c", "a b c", "a b c", None, "a b c"], ids=[3, 3, None, None, 7])
    rows = sorted((r["doc_id"] or -1, r["n_lines"], r["n_repeated"]) for r in lines.summary(docs).collect())
    assert rows == [(-1, 0, 0), (-1, 1, 1), (3, 1, 0), (3, 1, 0), (7, 1, 1)]
    assert lines.summary(docs.limit(0)).collect() == []
    assert lines.drop_repeated_lines(docs.limit(0)).collect() == []


@pytest.fixture
def compared(monkeypatch):
    """How many pairs each round compares."""
    counts = []
    store = linking.materialize

    def counting(df, label):
        stored = store(df, label)
        if label == "pairs":
            counts.append(stored.count())
        return stored

    monkeypatch.setattr(linking, "materialize", counting)
    return counts


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (1, 60)])
def test_rare_shingles_bring_links_together(spark, size, percent):
    """Sets that are similar enough share a bucket, in which one of them leads."""
    texts = sorted({t for t in near_texts() if t and t.strip()})
    sets = [shingle_set(t, size) for t in texts]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "id bigint, text binary")
    of = defaultdict(dict)
    for r in minhash._rare_shingles(df, size, percent).collect():
        of[r["id"]][r["bucket"]] = r["lead"]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    assert len(links) > 60
    assert [k for k in links if not any(of[k[0]][b] or of[k[1]][b] for b in of[k[0]].keys() & of[k[1]])] == []


def test_near_duplicates_by_finer_buckets(spark, monkeypatch):
    monkeypatch.setattr(linking, "LARGE", 1)
    test_near_duplicates(spark, 3, 85)


def test_lines_share_pieces(spark):
    """Hardly any pair that is not near comes to the edit distance, and every near one does."""
    rng = random.Random(47)
    start = "".join(rng.choice("abcdefgh é") for _ in range(40))
    rows = []
    for i in range(400):
        a = start + "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(40, 90)))
        b = list(a if i % 2 else start + "".join(rng.choice("abcdefgh é") for _ in range(len(a) - 40)))
        for _ in range(rng.randint(0, 2)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        rows.append((i, a, "".join(b)))
    df = spark.createDataFrame(rows, "i bigint, a string, b string")
    got = {r["i"] for r in df.where(lines._share_pieces(F.col("a"), F.col("b"), 2)).collect()}
    near = {i for i, a, b in rows if distance(a, b) <= 2}
    assert near <= got
    assert len(near) >= 200
    assert len(got) <= len(near) + 4


def test_documents_of_a_common_passage(spark, compared):
    """Documents that share nine tenths of their shingles, too few for a link."""
    rng = random.Random(43)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(passage + [f"u{i}_{k}" for k in range(210)]) for i in range(150)]
    texts.append(texts[7] + " more")
    rows = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert rows == {**{i: i for i in range(150)}, 150: 7}
    assert sum(compared[2:]) <= 10 * len(texts)  # two rounds compare with hubs, by every band
