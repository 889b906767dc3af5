"""Nearest-neighbour join against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import vectors as V
from flowlens.operators.knn import (
    knn_approximate,
    knn_join,
    knn_predict,
    knn_scores,
    recall,
    search_ks,
    vote,
)


def points(spark, array, first=0, labels=None):
    rows = [
        (first + i, [float(x) for x in row], None if labels is None else labels[i])
        for i, row in enumerate(array)
    ]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int")


def brute(queries, train, k, p):
    out = {}
    for i, q in enumerate(queries):
        d = (np.abs(train - q) ** p).sum(axis=1) ** (1 / p)
        order = sorted(range(len(train)), key=lambda j: (round(d[j], 9), j))[:k]
        out[i] = [(j, round(d[j], 6)) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["train_id"], round(r["distance"], 6)))
    return out


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize(
    "cells,block,route", [(None, None, None), (9, 16, None), (40, 7, None), (9, 16, "pivots"), (40, 7, "pivots")]
)
def test_equals_brute_force(spark, p, cells, block, route):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 10
    train = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 4))
    train[::3] = train[0]  # a third of the rows are copies of one point
    queries = np.vstack([train[:20], centres + 0.5, rng.normal(size=(5, 4)) * 40])
    got = knn_join(
        points(spark, queries), points(spark, train), 5, p=p, cells=cells, block_rows=block, route=route
    )
    assert found(got) == brute(queries, train, 5, p)


def test_routes(spark):
    df = points(spark, np.random.default_rng(2).normal(size=(200, 3)))
    with pytest.raises(ValueError):
        knn_join(df, df, 1, route="somehow")
    same = [found(knn_join(df, df, 4, route=r, cells=8)) for r in ("plain", "boxes", "pivots")]
    assert same[0] == same[1] == same[2]


def clumps(dims, rng, rows=40_000, groups=60):
    """Points around centres that are far apart against what they are spread."""
    centres = rng.normal(size=(groups, dims)) * 10
    return centres[rng.integers(0, groups, rows)] + rng.normal(size=(rows, dims)) * 0.5


def test_what_a_sample_expects():
    """Clumps in many dimensions are for bands or boxes, a cloud is for one plain pass."""
    from flowlens.operators import knn

    rng = np.random.default_rng(3)
    clumped, cloud = clumps(64, rng, 3000), rng.normal(size=(3000, 64))

    def shares(points):
        train, queries = points[:2800], points[2800:]
        pivots = knn.Space(knn._far_apart(train, knn.PIVOTS, 2))
        return [knn.expected_share(train, queries, 2, 2, space) for space in (knn.Space(), pivots)]

    assert min(shares(clumped)) < 0.2
    assert min(shares(cloud)) > knn.WORTH


@pytest.mark.parametrize("name", ["clumps", "cloud", "embeddings"])
def test_share_of_pairs_in_many_dimensions(spark, name):
    """In 64 dimensions either less than half of the pairs are compared, or all of them in
    one pass, without cells, a first look, or anything stored."""
    from oracle import TESTDATA

    from flowlens.functions.vectors import as_doubles
    from flowlens.operators import knn

    rng = np.random.default_rng(4)
    if name == "embeddings":
        rows = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet")
        t = rows.select(F.col("vec_id").alias("tid"), as_doubles(F.col("embedding")).alias("v"))
    else:
        data = clumps(64, rng, 4000) if name == "clumps" else rng.normal(size=(4000, 64))
        t = points(spark, data).select(F.col("id").alias("tid"), F.col("features").alias("v"))
    q = t.withColumnRenamed("tid", "qid")
    space = knn.choose_space(t, q, t.count(), 5, 2)
    if space is None:
        print(f"{name}: one plain pass")
        assert name != "clumps"
        return
    _, routed, counts = knn._searched_cells(q, t, 64, 5, 2, space)
    need = [r["cells"] for r in routed.select("cells").collect()]
    share = sum(counts[c].sum() for c in need) / len(need) / counts.sum()
    print(f"{name}: {'boxes' if space.pivots is None else 'pivots'}, share of pairs {share:.3f}")
    assert name != "cloud" and share < knn.WORTH


def test_k_beyond_the_table(spark):
    train, queries = np.arange(6.0).reshape(3, 2), np.zeros((2, 2))
    got = knn_join(points(spark, queries), points(spark, train), 10, cells=2)
    assert {i: len(v) for i, v in found(got).items()} == {0: 3, 1: 3}
    assert knn_join(points(spark, queries), points(spark, train[:0]), 3).count() == 0


def test_nearby_points_far_from_the_origin(spark):
    """The product form of the distance loses all digits here; the result must not."""
    base = np.full((1, 3), 1e7)
    train = base + np.arange(50)[:, None] * 1e-3
    queries = base + np.array([[0.0201] * 3])
    got = found(knn_join(points(spark, queries), points(spark, train), 3))
    assert [j for j, _ in got[0]] == [20, 21, 19]


def test_hand_checked_neighbour_and_vote(spark):
    train = points(spark, np.array([[2.0, 2, 2], [4, 4, 4]]), labels=[0, 1])
    one = knn_join(points(spark, np.array([[5.0, 5, 5]])), train, 1, p=1, label="label").first()
    assert (one["train_id"], one["distance"], one["label"]) == (1, 3.0, 1)
    ballots = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "b"), (2, 2, "a")],
        "query_id int, rank int, label string",
    )
    votes = {(r["query_id"], r["k"]): r["prediction"] for r in vote(ballots, [1, 3]).collect()}
    assert votes == {(1, 1): "a", (1, 3): "a", (2, 1): "b", (2, 3): "a"}


def test_hand_checked_distances(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0], [4.0, 4.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(V.euclidean(a, b), V.manhattan(a, b), V.minkowski(a, b, 3)).first()
    assert row[0] == pytest.approx(12**0.5) and row[1] == 6 and row[2] == pytest.approx(24 ** (1 / 3))


def test_first_neighbour_of_the_train_part_is_itself(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 80).tolist()
    df = points(spark, rng.normal(size=(80, 5)), labels=labels)
    scores = knn_scores(knn_predict(df, df, [1, 3])).collect()
    assert {r["k"]: r["accuracy"] for r in scores}[1] == 1.0
    assert search_ks() == list(range(1, 50, 2))


def test_pairs_are_not_planned_as_a_cross_join(spark):
    df = points(spark, np.random.default_rng(2).normal(size=(60, 3)))
    plan = knn_join(df, df, 2, cells=5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_records_need_few_cells(spark):
    """Mean share of the cells, and of the train rows in them, that a query is sent to."""
    from oracle import TESTDATA
    from pyspark.ml.functions import vector_to_array

    from flowlens.operators import knn
    from flowlens.queries import learning

    rows = learning._prepared(spark, f"{TESTDATA}/sf0.01", 14).withColumn("v", vector_to_array("features"))
    q = rows.where("held").select(F.col("conn_id").alias("qid"), "v").limit(3000)
    t = rows.where("not held").select(F.col("conn_id").alias("tid"), "v")
    _, routed, counts = knn._searched_cells(q, t, 64, 1, 2)
    need = [r["cells"] for r in routed.select("cells").collect()]
    cells = sum(map(len, need)) / len(need) / len(counts)
    share = sum(counts[c].sum() for c in need) / len(need) / counts.sum()
    print(f"cells {cells:.3f}, train rows {share:.3f}")
    assert cells < 0.6 and share < 0.6


def test_tree_cells_are_balanced():
    from flowlens.operators import knn

    points = np.random.default_rng(2).normal(size=(4096, 3))
    cell = knn._cell_of(points, *knn._tree(points, 5))
    assert np.bincount(cell, minlength=32).max() <= 140
    same = np.ones((50, 2))
    assert set(knn._cell_of(same, *knn._tree(same, 3))) == {0}


def test_approximate_search_measures_its_recall(spark):
    rng = np.random.default_rng(8)
    data = clumps(32, rng, 3000, 20)
    train, asked = points(spark, data[:2700]), points(spark, data[2700:])
    exact = knn_join(asked, train, 5)
    for share, least in ((0.1, 0.9), (1.0, 1.0)):
        near = knn_approximate(asked, train, 5, cells=32, share=share)
        row = recall(near, exact).first()
        print(f"share {share}: recall {row['recall']:.3f}")
        assert (row["queries"], row["neighbors"]) == (300, 1500) and row["recall"] >= least
    assert found(near) == found(exact)
    # Nothing is nearer than the exact neighbours, and repeated points are as good as each other.
    same = points(spark, np.ones((400, 3)))
    row = recall(knn_approximate(same, same, 3, cells=8, share=0.3), knn_join(same, same, 3)).first()
    assert row["recall"] == 1.0
    assert recall(knn_approximate(asked, train.limit(0), 3), knn_join(asked, train.limit(0), 3)).first()["found"] == 0
    with pytest.raises(ValueError):
        knn_approximate(asked, train, 5, share=0)


def test_rough_kinds_keep_every_neighbour():
    from flowlens.operators import knn

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(5000, 16))
    far = np.vstack([b, np.full((1, 16), 1e9)])  # one outlier makes steps and errors large
    copies = np.repeat(b[:5], 900, axis=0)
    for points in (b, far, copies, b * 1e35):
        order = rng.permutation(len(points))
        for p in (1, 2, 3):
            exact = knn.distances(a, points, p)
            rows, columns, dist = knn.block_top_k(a, points, order, 6, p)
            assert rows.tolist() == np.repeat(np.arange(40), 6).tolist()
            for i in range(40):
                best = np.lexsort((order, exact[i]))[:6]
                assert columns[6 * i : 6 * i + 6].tolist() == best.tolist()
                assert dist[6 * i : 6 * i + 6].tolist() == exact[i, best].tolist()


def test_blocks_copy_each_row_a_few_times():
    from flowlens.operators import knn

    # A million rows on each side: no row goes to more than a few dozen blocks.
    million = np.array([1_000_000])
    assert max(knn._blocks(million, knn._block_rows(million, million, 12))) <= 40


def test_approximate_neighbours_of_a_small_table(spark):
    """A fifth of the buckets holds nine of ten neighbours on few records too."""
    from flowlens.queries import learning
    from oracle import TESTDATA

    row = learning.knn_approximate_recall(spark, f"{TESTDATA}/sf0.001").first()
    assert row["enough"] and row["queries"] == 142


@pytest.mark.parametrize("p", [1, 2, 3])
def test_tree_in_a_task_keeps_every_neighbour(p):
    """With bounds from elsewhere, without, and where most rows are copies of one point."""
    from flowlens.operators import knn

    rng = np.random.default_rng(6)
    a = rng.uniform(size=(70, 4))
    cloud = rng.uniform(size=(6000, 4))
    for points in (cloud, np.vstack([cloud[:1500], np.repeat(a[:1], 3000, axis=0)])):
        order, exact = rng.permutation(len(points)), knn.distances(a, points, p)
        kth = np.sort(exact, axis=1)[:, 4]
        for bound in (kth, kth * 1.3, np.full(len(a), np.inf), np.where(np.arange(len(a)) % 2, kth, np.inf)):
            rows, columns, dist = knn.tree_top_k(a, points, order, 5, p, bound)
            for i in range(len(a)):
                best = np.lexsort((order, exact[i]))[:5]
                assert columns[rows == i].tolist() == best.tolist()
                assert dist[rows == i].tolist() == exact[i, best].tolist()


def _copies(monkeypatch, search, asked):
    """Mean number of copies of a query in each join of blocks that a search makes."""
    from flowlens.operators import knn

    seen, join = [], knn._block_join

    def counted(q, *args):
        seen.append(q.count() / asked)
        return join(q, *args)

    with monkeypatch.context() as patch:
        patch.setattr(knn, "_block_join", counted)
        search()
    return seen


def test_few_copies_of_a_query_travel(spark, monkeypatch):
    """To large cells, and to cells of many buckets: the shuffle of 1 GB took 70 GB of disk."""
    from oracle import TESTDATA
    from pyspark.ml.functions import vector_to_array

    from flowlens.queries import learning

    rows = learning._prepared(spark, f"{TESTDATA}/sf0.01", 14).withColumn("features", vector_to_array("features"))
    train, asked = rows.where("not held").cache(), rows.where("held").limit(2000).cache()
    options = {"query_id": "conn_id", "train_id": "conn_id"}
    exact = _copies(monkeypatch, lambda: knn_join(asked, train, 1, route="boxes", **options), 2000)
    near = _copies(monkeypatch, lambda: knn_approximate(asked, train, 10, share=0.2, **options), 2000)
    print(f"copies of a query: exact {exact}, approximate {near}")
    assert len(exact) == len(near) == 2 and max(exact) < 10 and max(near) < 4


def test_sample_of_a_large_table_is_the_same(spark):
    """Only rows of small hashes are sorted: a task kept, and sent, as many as were asked for."""
    from flowlens.operators import knn

    rows = spark.range(50_000).select(F.col("id").alias("tid"), F.array(F.col("id").cast("double")).alias("v"))
    every, least = knn._sample(rows, "tid", 300), knn._sample(rows, "tid", 300, 50_000)
    assert every.tolist() == least.tolist()
    assert knn._sample(rows.limit(10), "tid", 300, 10).shape == (10, 1)
