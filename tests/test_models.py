"""Preparation, fitting, search, saving and whole runs."""

from __future__ import annotations

import oracle
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowlens.functions.vectors import active_indices, value_at, vector_size
from flowlens.plans import experiment, models, trees
from flowlens.plans.prepare import CoarseLabeler, fit_features, prepared
from flowlens.operators.metrics import ranking_area
from flowlens.queries import learning
from flowlens.queries.traffic import connections
from flowlens.sources import synthetic
from flowlens.sources.models import load_model, save_model

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    return connections(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def blobs(spark):
    df = synthetic.blobs(spark, 400, centers=2, dims=3, seed=1, spread=2.0)
    vectors = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(df)
    return vectors.select("id", "features", F.col("y").cast("double").alias("label")).cache()


@pytest.mark.parametrize("features,plain", [(14, 14), (16, 14), (41, 38)])
def test_encoded_width(records, features, plain):
    fitted = fit_features(records, features)
    row = prepared(fitted, records, "conn_id").first()
    nominal = {14: [], 16: ["service", "flag"], 41: ["protocol_type", "service", "flag"]}[features]
    levels = sum(records.select(c).distinct().count() for c in nominal)
    assert row["features"].size == plain + levels


def test_features_stay_in_range_and_one_hot_rows_sum_to_one(records):
    fitted = fit_features(records, 41, dense=True)
    a = vector_to_array("features")
    out = prepared(fitted, records).select(
        F.array_min(a).alias("lo"), F.array_max(a).alias("hi"),
        F.aggregate(F.slice(a, 39, F.size(a)), F.lit(0.0), lambda s, x: s + x).alias("hot"),
    )
    low, high, least, most = out.agg(F.min("lo"), F.max("hi"), F.min("hot"), F.max("hot")).first()
    assert low >= 0 and high <= 1 and (least, most) == (3.0, 3.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_unseen_level_gives_an_empty_block(spark, records):
    fitted = fit_features(records, 16)
    strange = records.limit(1).withColumn("service", F.lit("never seen"))
    vector = prepared(fitted, strange).first()["features"]
    assert vector.toArray()[14:].sum() == 1.0


def test_saved_preparation_and_model_give_equal_predictions(spark, records, tmp_path):
    fitted = fit_features(records, 16)
    train = prepared(fitted, records, "conn_id")
    model = models.estimator("binLR", maxIter=5).fit(train)
    save_model(fitted, str(tmp_path / "prep"))
    model.write().save(str(tmp_path / "model"))
    loaded = type(model).load(str(tmp_path / "model"))
    again = prepared(load_model(str(tmp_path / "prep")), records, "conn_id")
    before = models.predictions(model, train, "conn_id").collect()
    after = models.predictions(loaded, again, "conn_id").collect()
    assert sorted(before) == sorted(after)


def test_label_stage(spark):
    df = spark.createDataFrame([("normal",), ("normal2",), ("back",)], "labels string")
    assert [r["label"] for r in CoarseLabeler().transform(df).collect()] == [0.0, 1.0, 1.0]
    loose = CoarseLabeler(match="prefix", outputCol="y")
    assert [r["y"] for r in loose.transform(df).collect()] == [0.0, 0.0, 1.0]


def test_grids_have_no_repeats():
    assert len(models.default_grid("binLR", 14)) == 80
    grid = models.default_grid("DTree", 14)
    assert len(grid) == 30 * 13 and len({tuple(g.items()) for g in grid}) == len(grid)
    assert {g["maxFeatures"] for g in grid} == set(range(2, 15))


@pytest.mark.parametrize(
    "algorithm,params",
    [
        ("binLR", {"tol": 1e-3, "maxIter": 50}),
        ("linSVC", {"tol": 0.1, "maxIter": 10}),
        ("DTree", {"maxDepth": 5, "maxBins": 14}),
        ("DTree", {"maxDepth": 5, "maxFeatures": 2}),
        ("RForest", {"maxDepth": 5, "maxFeatures": 2, "numTrees": 5}),
    ],
)
def test_learners_separate_the_blobs(blobs, algorithm, params):
    train, test = models.holdout(blobs, "id")
    model, log = models.fit_fixed(algorithm, train, test, params)
    assert log[0][4] > 0.9 and log[1][4] > 0.9
    if algorithm == "DTree" and "maxFeatures" in params:
        assert model.getNumTrees == 1
    if algorithm != "linSVC":
        assert ranking_area(model.transform(test)) > 0.9
    out = models.predictions(model, test, "id")
    assert out.count() == test.count()
    assert ("probability" in out.columns) == (algorithm != "linSVC")


def test_unknown_names_are_refused(blobs):
    with pytest.raises(ValueError):
        models.estimator("other")
    with pytest.raises(ValueError):
        experiment.run(blobs, 14, "other", {}, ["id"])


def test_cross_validation(spark, blobs):
    grid = models.param_grid(maxDepth=[2, 4], maxFeatures=[1, 3])
    fitted = models.cross_validate("DTree", blobs, ["id"], grid)
    assert len(fitted.avgMetrics) == 4 and max(fitted.stdMetrics) > 0
    best = models.best_parameters(fitted)
    assert best["params"]["maxDepth"] in (2, 4)
    assert models.cross_validation_log(spark, "DTree", fitted).count() == 4


def test_validation_does_not_depend_on_partitions(spark, blobs):
    grid = models.param_grid(maxIter=[1, 20], regParam=[0.0, 0.1])
    found = [
        models.train_validation("binLR", blobs.repartition(n), ["id"], grid) for n in (1, 50)
    ]
    assert found[0].values == found[1].values and found[0].best == found[1].best
    first, second = (models.best_parameters(f) for f in found)
    assert first["params"] == second["params"] and first["metric"] > 0.9
    assert first["coefficients"] == pytest.approx(second["coefficients"], rel=1e-6)
    log = found[0].log(spark).collect()
    assert [r["place"] for r in log] == [0, 1, 2, 3] and sum(r["best"] for r in log) == 1
    table = {r["position"]: r["coefficient"] for r in found[0].coefficients(spark).collect()}
    assert [table[i] for i in range(3)] == first["coefficients"] and table[-1] == first["intercept"]
    tied = models.Validated("binLR", grid, "accuracy", [0.5, 0.7, 0.7, 0.1], None)
    assert tied.best == 1


def test_wide_levels_fill_the_same_slots(spark, records, tmp_path):
    """A table of levels gives the vectors of the collected ones, also saved and loaded."""
    strange = records.limit(3).withColumn("service", F.lit(None).cast("string")).withColumn("flag", F.lit("new"))
    rows = records.unionByName(strange)
    narrow = prepared(fit_features(records, 16), rows, "conn_id").collect()
    wide = fit_features(records, 16, collected_levels=5)
    save_model(wide, str(tmp_path / "wide"))
    again = load_model(str(tmp_path / "wide"))
    assert again.stages[-1].levels.count() == sum(again.stages[-1].getOrDefault("sizes"))

    def key(found):
        return sorted((r["conn_id"], r["label"], r["features"].toArray().tolist()) for r in found)

    for model in (wide, again):
        assert key(prepared(model, rows, "conn_id").collect()) == key(narrow)
    plan = prepared(again, rows, "conn_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    scored = models.estimator("binLR", maxIter=3).fit(prepared(wide, records))
    assert scored.numFeatures == len(narrow[0]["features"])


def test_node_tables_score_like_the_model(blobs):
    from flowlens.plans import trees

    spark = blobs.sparkSession
    for fitted in (
        models.estimator("DTree", maxDepth=6).fit(blobs),
        models.estimator("RForest", maxDepth=4, numTrees=5).fit(blobs),
    ):
        nodes = trees.node_table(spark, fitted)
        scored = {r["id"]: r["probability"] for r in trees.score_rows(blobs, nodes, "id").collect()}
        own = models.predictions(fitted, blobs, "id").collect()
        assert scored == pytest.approx({r["id"]: r["probability"] for r in own})
    counts = {r["node"]: (r["n"], r["positives"]) for r in trees.node_counts(blobs, nodes.where("tree = 0")).collect()}
    assert counts[1][0] == blobs.count()
    for node, (n, s) in counts.items():
        if 2 * node in counts or 2 * node + 1 in counts:
            sides = [counts.get(2 * node + i, (0, 0)) for i in (0, 1)]
            assert (n, s) == tuple(map(sum, zip(*sides)))


def test_nominal_features_go_left_by_value(spark, records):
    from flowlens.plans import trees
    from pyspark.ml.feature import StringIndexer

    rows = StringIndexer(inputCol="flag", outputCol="f").fit(records).transform(records)
    rows = VectorAssembler(inputCols=["f", "dst_host_count"], outputCol="features").transform(rows)
    rows = CoarseLabeler().transform(rows).select("conn_id", "features", "label")
    fitted = models.estimator("DTree", maxDepth=4).fit(rows)
    nodes = trees.node_table(spark, fitted)
    scored = {r["conn_id"]: r["probability"] for r in trees.score_rows(rows, nodes, "conn_id").collect()}
    own = models.predictions(fitted, rows, "conn_id").collect()
    assert scored == pytest.approx({r["conn_id"]: r["probability"] for r in own})


def test_bagged_trees_do_not_depend_on_partitions(blobs):
    from flowlens.plans import trees

    spark = blobs.sparkSession
    found = []
    for n in (1, 7):
        fitted = trees.fit_bagged(blobs.repartition(n), ["id"], 3, maxDepth=3)
        found.append(sorted(map(str, trees.node_table(spark, fitted).collect())))
    assert found[0] == found[1]
    drawn = blobs.select(trees.drawn_times(1, F.col("id")).alias("k")).agg(F.avg("k"), F.max("k")).first()
    assert abs(drawn[0] - 1) < 0.2 and drawn[1] < 8


def test_areas_of_scores_are_exact_with_ties(spark):
    import random

    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from flowlens.operators.metrics import curve_points, ranking_areas

    rng = random.Random(5)
    rows = [
        (g, rng.choice([0.1, 0.5, 0.5, 2.0, -3.0, rng.random()]), rng.randint(0, 1))
        for g in ("a", "b", None) for _ in range(200)
    ]
    rows += [("c", 1.0, 1), ("c", 0.0, 1), ("a", None, 1), ("a", float("nan"), 0), ("a", 0.3, None), ("z", 0.0, 1), ("z", -0.0, 0)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    for range_rows in (1_000_000, 20):
        areas = {r["g"]: r for r in ranking_areas(df, by=("g",), range_rows=range_rows).collect()}
        assert areas["c"]["auroc"] is None and areas["z"]["auroc"] == 0.5
        for g in ("a", "b", None):
            own = [(s, y) for group, s, y in rows if group == g and s is not None and s == s and y is not None]
            pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
            wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
            assert areas[g]["auroc"] == pytest.approx(wins / len(pos) / len(neg))
            part = spark.createDataFrame(own, "rawPrediction double, label int")
            area = BinaryClassificationEvaluator(metricName="areaUnderPR", numBins=0).evaluate(part)
            assert areas[g]["aupr"] == pytest.approx(area)
        points = curve_points(df.where("g = 'b'"), range_rows=range_rows).orderBy(F.desc("score")).collect()
        assert (points[-1]["tp"], points[-1]["fp"]) == (areas["b"]["positives"], areas["b"]["negatives"])
    assert ranking_areas(df.limit(0), by=("g",)).count() == 0


def test_certificate_bounds_the_distance_from_the_best(blobs):
    from pyspark.ml.classification import LinearSVC

    from flowlens.operators.metrics import hinge_certificate

    rows = blobs.withColumn("x", vector_to_array("features"))
    reg, objectives, gaps = 0.05, [], []
    for steps in (1, 3, 5):
        model = LinearSVC(regParam=reg, maxIter=steps, tol=1e-3, standardization=False).fit(blobs)
        out = hinge_certificate(rows, model.coefficients.toArray().tolist(), model.intercept, reg, "x").first()
        objectives.append(out["objective"])
        gaps.append(out["gap"])
    best = min(objectives)
    assert all(o - best <= g + 1e-9 for o, g in zip(objectives, gaps))
    assert objectives[-1] <= objectives[0] and gaps[-1] < 0.05
    with pytest.raises(ValueError):
        hinge_certificate(rows, [0.0, 0.0, 0.0], 0.0, 0.0, "x")


def test_repeated_holdout_keeps_every_round(blobs):
    log = models.repeated_holdout("binLR", blobs, ["id"], models.param_grid(maxIter=[1, 10]), rounds=3)
    rows = log.collect()
    assert len(rows) == 6 and {r["fold"] for r in rows} == {0, 1, 2}
    assert all(r["seconds"] > 0 for r in rows)


def test_knn_search_scores_every_k(blobs):
    train, test = models.holdout(blobs.withColumn("features", vector_to_array("features")), "id")
    log = models.knn_search(train, test, "id", [1, 3, 5], metrics=("accuracy", "areaUnderPR"))
    rows = log.collect()
    assert len(rows) == 6 and all(r["value"] > 0.9 for r in rows)


def test_linear_regression_finds_the_coefficients(spark):
    df, true = synthetic.linear_points(spark, 500, [3.0, -2.0], noise=0.01)
    rows = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)
    model = models.fit_linear(rows, "y")
    assert model.coefficients.toArray() == pytest.approx(true, abs=0.01)


@pytest.mark.parametrize(
    "algorithm,params",
    [("kNN", {"k": 1}), ("binLR", {"maxIter": 10}), ("DTree", {"maxDepth": 8, "maxBins": 32})],
)
def test_whole_run(records, algorithm, params):
    rows = {r["metric"]: r["value"] for r in experiment.run(
        records, 14, algorithm, params, ["conn_id"]
    ).collect()}
    assert rows["areaUnderROC"] > 0.6


def test_separate_test_table(records):
    train, test = models.holdout(records, "conn_id", percent=20, seed=3)
    strange = test.withColumn("service", F.lit("only here"))
    rows = experiment.run(train, 16, "binLR", {"maxIter": 10}, ["conn_id"], test=strange).collect()
    assert len(rows) == 2 and all(0 < r["value"] <= 1 for r in rows)


@pytest.mark.parametrize(
    "algorithm,grid",
    [("kNN", models.param_grid(k=[1, 3, 5])), ("binLR", models.param_grid(maxIter=[1, 10, 20]))],
)
def test_search_logs_every_point_of_every_round(records, algorithm, grid):
    log = experiment.search(records, 14, algorithm, ["conn_id"], grid, rounds=2).collect()
    assert len(log) == 6 and {r["fold"] for r in log} == {0, 1}
    assert len({(r["fold"], r["value"]) for r in log}) > 1


def test_sparse_vectors_are_not_filled_up(spark):
    wide = 2_000_000_000  # filled up, one vector would take 16 GB
    rows = spark.createDataFrame(
        [
            (1, Vectors.sparse(wide, [0, 7, wide - 1], [0.5, 0.0, 1.0])),
            (2, Vectors.dense([0.0, 2.0, 0.0])),
            (3, Vectors.sparse(4, [], [])),
        ],
        ["id", "v"],
    )
    v = F.col("v")
    found = rows.orderBy("id").select(active_indices(v), vector_size(v), value_at(v, 0), value_at(v, 7), value_at(v, 1))
    assert [tuple(row) for row in found.collect()] == [
        ([0, wide - 1], wide, 0.5, 0.0, 0.0),
        ([1], 3, 0.0, None, 2.0),
        ([], 4, 0.0, None, 0.0),
    ]


def test_draws_hash_a_row_once(spark):
    rows = spark.range(200).withColumn("tree", (F.col("id") % 3).cast("int"))
    by_column = trees.drawn_times(F.col("tree") + 100, F.col("id"))
    plan = rows.select(by_column)._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") <= 2  # the expression and its name
    by_number = F.coalesce(*[F.when(F.col("tree") == j, trees.drawn_times(100 + j, F.col("id"))) for j in range(3)])
    assert rows.where(by_column != by_number).count() == 0


def test_forest_scores_rows_that_share_their_keys(spark, tmp_path):
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").limit(300)
    # The same keys again, with other features.
    twins = items.withColumn("l_quantity", (F.col("l_quantity") % 50) + 1)
    items.unionByName(twins).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = learning.forest_scores(spark, str(tmp_path))
    assert found.count() == 600 and found.where("trees <> 10").count() == 0


def test_parts_for_trees_are_stored_and_keep_their_slots(spark):
    """Executor memory is left to the learners, and one-hot slots stay binary for trees."""
    rows = connections(spark, f"{oracle.TESTDATA}/sf0.001")
    train, test = models.holdout(rows, "conn_id")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with experiment._prepared_parts(train, test, 41, "DTree", ["conn_id"]) as parts:
        sizes = [part.count() for part in parts]
        assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
        expected = prepared(fit_features(train, 41), train)
        assert parts[0].schema["features"].metadata == expected.schema["features"].metadata
        assert "binary" in parts[0].schema["features"].metadata["ml_attr"]["attrs"]
        assert parts[0].exceptAll(expected).count() == 0
    assert sizes == [train.count(), test.count()]
    assert models.TREE_MEMORY_MB * 4 <= 1024  # in each of four tasks of an executor


def test_neighbour_runs_keep_nothing_in_memory(spark, monkeypatch):
    """A cached train part filled the executors, which keep it beside the blocks they compare."""
    from oracle import TESTDATA

    from flowlens.plans import experiment
    from flowlens.queries import learning

    kept, predict = [], experiment.knn_predict

    def watched(*args, **options):
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        plan = args[1]._jdf.queryExecution().withCachedData().toString()
        kept.append("InMemoryRelation" in plan)
        return predict(*args, **options)

    monkeypatch.setattr(experiment, "knn_predict", watched)
    spark.catalog.clearCache()
    assert learning.run_separate_table(spark, f"{TESTDATA}/sf0.001").count() == 1
    assert kept == [0, False]


def test_equal_rows_are_drawn_as_one(spark):
    """The sums of their draws are stored, and trees are those of single rows."""
    from flowlens.plans import trees
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(4000).select(
        "id",
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"),
        ((F.col("id") % 35) * (F.col("id") % 3) > 30).cast("double").alias("label"),
    )
    drawn = trees.draw_rows(rows, ["id"], 3, 100)
    assert drawn.count() <= 70
    single = rows.select(*[F.sum(trees.drawn_times(100 + j, F.col("id"))) for j in range(3)]).first()
    assert drawn.select(*[F.sum(F.get("draws", F.lit(j))) for j in range(3)]).first() == single
    every = trees.draw_rows(rows, ["id"], 3, 100, merge=False)
    assert every.count() == 4000

    def nodes(df):
        return trees.node_table(spark, trees.fit_drawn(df, 3, maxDepth=3))

    def known(table):
        return sorted((r["tree"], r["node"], r["feature"], r["cut"], tuple(r["class_weights"])) for r in table.collect())

    one = nodes(drawn)
    assert known(one) == known(nodes(every))
    counts = trees.node_counts(drawn, one, weight=F.get("draws", F.col("tree"))).where("node = 1").orderBy("tree")
    assert [r["n"] for r in counts.collect()] == list(single)


def test_rows_go_down_all_trees_at_once(blobs):
    """Without a row for each tree and level; and as by joins."""
    from flowlens.plans import trees

    nodes = trees.node_table(blobs.sparkSession, trees.fit_bagged(blobs, ["id"], 3, maxDepth=4))
    holes = blobs.withColumn("features", F.when(F.col("id") % 3 == 0, nans()(F.col("features"))).otherwise(F.col("features")))
    scored = trees.score_rows(holes, nodes, "id")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    placed = trees.place_rows(holes, nodes).join(nodes, ["tree", "node"])
    share = F.get("class_weights", F.lit(1)) / (F.get("class_weights", F.lit(0)) + F.get("class_weights", F.lit(1)))
    joined = {r["id"]: (r["p"], r["n"]) for r in placed.groupBy("id").agg(F.avg(share).alias("p"), F.count("*").alias("n")).collect()}
    found = {r["id"]: (r["probability"], r["trees"]) for r in scored.collect()}
    assert found.keys() == joined.keys()
    assert all(found[i] == pytest.approx(joined[i]) for i in found)


def nans():
    """Vectors with a missing first value."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return lambda v: array_to_vector(F.transform(vector_to_array(v), lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x)))
