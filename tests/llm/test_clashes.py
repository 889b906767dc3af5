"""Columns of users that are named like those that operators add for themselves."""

from __future__ import annotations

import pytest

from flowlens.llm import exact, lines, minhash, mixing
from flowlens.llm.words import unused

NAMES = [
    "__row", "__gone", "_id", "_n", "_size", "_take", "_taken", "_src", "row", "gone_row", "gone", "_gone",
    "of", "src", "size", "taken", "n", "take", "Take", "id", "doc", "kept", "component_id", "slot", "sender",
]
NAMES = [n for i, n in enumerate(NAMES) if n.lower() not in {m.lower() for m in NAMES[:i]}]


def frame(spark):
    rows = [
        (i, f"a line that many have in common\nline {i % 7} " + "words " * (40 + i % 7), f"s{i % 2}", *[f"{c}{i}" for c in NAMES])
        for i in range(20)
    ]
    schema = ", ".join(["doc_id bigint", "text string", "source string", *[f"`{c}` string" for c in NAMES]])
    return spark.createDataFrame(rows, schema)


def test_unused_names():
    assert unused(["A", "b", "_b"], "a", "b", "c", "C") == ["_a", "__b", "c", "_C"]


@pytest.mark.parametrize(
    "operator",
    [lines.drop_repeated_lines, minhash.drop_near_duplicates, mixing.mix_documents, exact.drop_repeats],
)
def test_values_stay(spark, operator):
    docs = frame(spark)
    out = operator(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for row in rows:
        assert [row[c] for c in NAMES] == [f"{c}{row['doc_id']}" for c in NAMES]
