"""Every stage of the pipeline against brute force over the smallest tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from flowlens.llm import lines, mixing, toxicity
from flowlens.session import materialize
from llm.test_native import WORD, plain_mix
from llm.test_pairs import components, distance, shingle_set

SF_DIR = f"{oracle.TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_DIR), "test_stage"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "near-duplicates", "mixing", "encoding",
    ]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_toxic_documents_go(spark, stages):
    net = corpus_pipeline.toxicity_network(spark, SF_DIR)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(stages[0], net).collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {i for i in before if scores[i] < 0.5}
    assert all(after[i]["text"] == before[i]["text"] for i in after)


def test_repeated_lines_go(stages):
    before, after = rows(stages[1]), rows(stages[2])
    where = [
        (i, pos, line) for i, r in before.items() if r["text"]
        for pos, line in enumerate(r["text"].split("\n")) if WORD.search(line)
    ]
    by_length = defaultdict(set)
    for *_, line in where:
        by_length[len(line)].add(line)
    links = [
        (a, b) for n, own in by_length.items() if n >= lines.LEAST for a in own
        for m in range(n, n + lines.EDITS + 1) for b in by_length.get(m, ())
        # Most pairs differ in many places; only like beginnings or ends are worth a look.
        if a < b and (a[: n // 3 - 2] == b[: n // 3 - 2] or a[-(n // 3 - 2):] == b[-(n // 3 - 2):] or n < 60)
        and distance(a, b) <= lines.EDITS
    ]
    group = components({line for *_, line in where}, links)
    firsts, gone = {}, defaultdict(set)
    for i, pos, line in sorted(where):
        if firsts.setdefault(group[line], (i, pos)) != (i, pos):
            gone[i].add(pos)
    assert set(after) == set(before) and sum(map(len, gone.values())) > 20
    for i, r in before.items():
        if r["text"] is not None:
            left = [line for pos, line in enumerate(r["text"].split("\n")) if pos not in gone[i]]
            assert after[i]["text"] == "\n".join(left)


def test_near_duplicates_go(stages):
    before, after = rows(stages[2]), rows(stages[3])
    sets = {i: shingle_set(r["text"], 5) for i, r in before.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    group = components(set(sets), links)
    assert set(after) == {i for i in before if group[i] == i}


def test_mix(stages):
    before = stages[3].collect()
    given = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in before]
    _, _, taken = plain_mix(given)
    got = Counter()
    texts = {r["doc_id"]: WORD.findall(r["text"] or "") for r in before}
    for r in stages[4].collect():
        words = WORD.findall(r["text"])
        assert words == texts[r["doc_id"]][: len(words)] and words
        got[r["doc_id"]] += len(words)
    assert got == Counter({key[0]: n for key, n in taken.items() if n})


def test_encoding(stages):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    given = Counter(
        (r["doc_id"], np.array(model.encode(r["text"], add_bos=True, add_eos=True), "<u4").tobytes())
        for r in stages[4].collect()
    )
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in stages[5].collect()) == given


def test_whole_run(spark, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() == stages[5].count()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.collect() == []


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert mixing.WEIGHTS == (3, 1, 2)
