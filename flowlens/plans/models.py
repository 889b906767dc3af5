"""Model fitting, parameter search and scoring.

The learners are Spark ML's. A search records one row per parameter set and fold in
a run log, which the leaderboard ranks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from time import perf_counter

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import (
    CrossValidator,
    CrossValidatorModel,
    ParamGridBuilder,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.split import fold_of, in_holdout
from flowlens.operators.knn import knn_predict, search_ks
from flowlens.operators.leaderboard import RUN_LOG_SCHEMA
from flowlens.operators.metrics import hard_metrics

# Algorithm names of the run log.
ALGORITHMS = ("kNN", "DTree", "linSVC", "RForest", "binLR")
METRICS = {"accuracy": "accuracy", "areaUnderROC": "auroc_hard", "areaUnderPR": "aupr_hard"}
TREE_MEMORY_MB = 256  # of statistics, in each of the tasks that run side by side


# --- learners and grids ----------------------------------------------------------------


def estimator(algorithm: str, seed: int = 7, **params) -> Estimator:
    """The learner for an algorithm name.

    Trees take ``maxDepth``, ``maxBins`` (histogram bins) and ``maxFeatures`` (columns
    tried per split). A single tree with ``maxFeatures`` is a forest of one that sees
    every row.
    """
    params = dict(params)
    if algorithm == "binLR":
        return LogisticRegression(**params)
    if algorithm == "linSVC":
        return LinearSVC(**params)
    subset = params.pop("maxFeatures", None)
    if subset is not None:
        params["featureSubsetStrategy"] = str(subset)
    common = {"impurity": "gini", "maxMemoryInMB": TREE_MEMORY_MB, "seed": seed}
    if algorithm == "RForest":
        return RandomForestClassifier(**common, **params)
    if algorithm == "DTree":
        if subset is None:
            return DecisionTreeClassifier(**common, **params)
        return RandomForestClassifier(numTrees=1, bootstrap=False, **common, **params)
    raise ValueError(f"no learner named {algorithm}")


def param_grid(**values: Iterable) -> list[dict]:
    """All combinations, each once, in the order given."""
    lists = [list(dict.fromkeys(v)) for v in values.values()]
    return [dict(zip(values, combination)) for combination in product(*lists)]


# The ranges that published searches went through.
SEARCHED = {
    "tol": [1e0, 1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6, 1e-7, 1e-8, 1e-9],
    "maxIter": [1, 10, 100, 1_000, 10_000, 100_000, 1_000_000, 10_000_000],
    "deepest": 30,
}


def default_grid(algorithm: str, n_features: int) -> list[dict]:
    """The searched values of an algorithm's parameters in all combinations; a tree may
    try any number of columns per split, from two to all."""
    if algorithm in ("binLR", "linSVC"):
        return param_grid(tol=SEARCHED["tol"], maxIter=SEARCHED["maxIter"])
    depths = range(1, SEARCHED["deepest"] + 1)
    return param_grid(maxDepth=depths, maxFeatures=range(2, n_features + 1))


def _grid_for(learner: Estimator, grid: list[dict]) -> list[dict]:
    """Spark parameter maps of a list of plain dictionaries."""
    maps = []
    for point in grid:
        builder = ParamGridBuilder()
        for name, value in point.items():
            if name == "maxFeatures":
                name, value = "featureSubsetStrategy", str(value)
            builder = builder.baseOn({learner.getParam(name): value})
        maps += builder.build()
    return maps


def _learner_for(algorithm: str, grid: list[dict], **fixed) -> Estimator:
    if algorithm == "DTree" and any("maxFeatures" in g for g in grid):
        fixed.setdefault("maxFeatures", "all")
    return estimator(algorithm, **fixed)


# --- splits ----------------------------------------------------------------------------


def holdout(
    df: DataFrame, *ids: str, percent: int = 33, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Train and held-out part by a hash of the ids."""
    out = in_holdout(*[F.col(c) for c in ids], percent=percent, seed=seed)
    return df.where(~out), df.where(out)


def with_folds(df: DataFrame, *ids: str, folds: int = 3, seed: int = 7) -> DataFrame:
    return df.withColumn("fold", fold_of(*[F.col(c) for c in ids], folds=folds, seed=seed))


# --- fitting and scoring ----------------------------------------------------------------


def score(model: Model, df: DataFrame, metric: str = "areaUnderROC") -> float:
    """One metric of the hard predictions, from one aggregation."""
    return hard_metrics(model.transform(df).select("prediction", "label")).first()[METRICS[metric]]


def fit_fixed(
    algorithm: str,
    train: DataFrame,
    test: DataFrame,
    params: dict,
    metric: str = "areaUnderROC",
    fold: int = 0,
    train_score: bool = True,
) -> tuple[Model, list[tuple]]:
    """Fit one parameter set; the run log has the held-out and the training score."""
    begin = perf_counter()
    model = estimator(algorithm, **params).fit(train)
    seconds = perf_counter() - begin
    text = {k: str(v) for k, v in params.items()}
    rows = [(algorithm, text, fold, metric, score(model, test, metric), seconds)]
    if train_score:
        value = score(model, train, metric)
        rows.append((algorithm, text, fold, f"{metric} (train)", value, seconds))
    return model, rows


def fit_grid(
    algorithm: str,
    train: DataFrame,
    test: DataFrame,
    grid: list[dict],
    metric: str = "areaUnderROC",
    fold: int = 0,
    parallelism: int = 4,
) -> list[tuple]:
    """Fit and score every parameter set, several at a time, in the order of the grid."""

    def one(params: dict) -> list[tuple]:
        return fit_fixed(algorithm, train, test, params, metric, fold, train_score=False)[1]

    with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
        runs = pool.map(inheritable_thread_target(train.sparkSession)(one), grid)
    return [row for rows in runs for row in rows]


def run_log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RUN_LOG_SCHEMA)


def repeated_holdout(
    algorithm: str,
    df: DataFrame,
    ids: list[str],
    grid: list[dict],
    rounds: int = 3,
    percent: int = 33,
    seed: int = 7,
    metric: str = "areaUnderROC",
    parallelism: int = 4,
) -> DataFrame:
    """Every parameter set on several independent 67/33 splits, each fit timed."""
    rows: list[tuple] = []
    for number in range(rounds):
        parts = holdout(df, *ids, percent=percent, seed=seed + number)
        train, test = (p.persist(StorageLevel.MEMORY_AND_DISK) for p in parts)
        try:
            rows += fit_grid(algorithm, train, test, grid, metric, number, parallelism)
        finally:
            train.unpersist()
            test.unpersist()
    return run_log(df.sparkSession, rows)


def cross_validate(
    algorithm: str,
    df: DataFrame,
    ids: list[str],
    grid: list[dict],
    folds: int = 3,
    seed: int = 7,
    metric: str = "areaUnderROC",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Search by cross-validation over hash folds; several models train at a time."""
    learner = _learner_for(algorithm, grid)
    folded = with_folds(df, *ids, folds=folds, seed=seed)
    folded = folded.select("features", "label", "fold").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return CrossValidator(
            estimator=learner,
            estimatorParamMaps=_grid_for(learner, grid),
            evaluator=BinaryClassificationEvaluator(
                rawPredictionCol="prediction", labelCol="label", metricName=metric
            ),
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        ).fit(folded)
    finally:
        folded.unpersist()


@dataclass
class Validated:
    """A search on one split: the value of every point, and the winner fitted on all rows."""

    algorithm: str
    grid: list[dict]
    metric: str
    values: list[float]
    model: Model

    @property
    def best(self) -> int:
        """Place of the best point in the grid, the first of equal ones."""
        return max(range(len(self.values)), key=lambda i: (self.values[i], -i))

    def log(self, spark: SparkSession) -> DataFrame:
        """``algorithm, params, place, metric, value, best``, a row per point."""
        rows = [
            (self.algorithm, {k: str(v) for k, v in point.items()}, i, self.metric, value, i == self.best)
            for i, (point, value) in enumerate(zip(self.grid, self.values))
        ]
        return spark.createDataFrame(
            rows, "algorithm string, params map<string,string>, place int, metric string, value double, best boolean"
        )

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``position, coefficient`` of a linear winner; the intercept has position -1."""
        found = [*enumerate(self.model.coefficients.toArray().tolist()), (-1, float(self.model.intercept))]
        return spark.createDataFrame(found, "position int, coefficient double")


def train_validation(
    algorithm: str,
    df: DataFrame,
    ids: list[str],
    grid: list[dict],
    percent: int = 33,
    seed: int = 7,
    metric: str = "areaUnderROC",
    parallelism: int = 4,
) -> Validated:
    """Search on a single split by a hash of the ids; the winner is fitted on all rows.

    Which rows validate depends on ids and seed alone, not on how ``df`` is partitioned.
    """
    split = in_holdout(*[F.col(c) for c in ids], percent=percent, seed=seed)
    marked = df.select("features", "label", split.alias("held")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = marked.where("not held"), marked.where("held")
        values = [row[4] for row in fit_grid(algorithm, train, test, grid, metric, 0, parallelism)]
        found = Validated(algorithm, grid, metric, values, None)
        found.model = estimator(algorithm, **grid[found.best]).fit(marked)
        return found
    finally:
        marked.unpersist()


def best_parameters(fitted: CrossValidatorModel | Validated) -> dict:
    """Parameters, score and, for linear models, coefficients of the winner."""
    if isinstance(fitted, Validated):
        out = {"params": fitted.grid[fitted.best], "metric": fitted.values[fitted.best]}
        model = fitted.model
    else:
        scores = fitted.avgMetrics
        best = max(range(len(scores)), key=lambda i: scores[i])
        out = {
            "params": {p.name: v for p, v in fitted.getEstimatorParamMaps()[best].items()},
            "metric": scores[best],
            "std": fitted.stdMetrics[best],
        }
        model = fitted.bestModel
    coefficients = getattr(model, "coefficients", None)
    if coefficients is not None:
        out["coefficients"] = coefficients.toArray().tolist()
        out["intercept"] = model.intercept
    return out


def cross_validation_log(
    spark: SparkSession, algorithm: str, fitted: CrossValidatorModel, seconds: float | None = None
) -> DataFrame:
    """Mean and deviation per parameter set, in the form of a leaderboard."""
    metric = fitted.getEvaluator().getMetricName()
    rows = [
        (
            algorithm,
            ":".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda x: x[0].name)),
            metric,
            float(mean),
            float(std),
            seconds,
        )
        for point, mean, std in zip(
            fitted.getEstimatorParamMaps(), fitted.avgMetrics, fitted.stdMetrics
        )
    ]
    return spark.createDataFrame(
        rows, "algorithm string, key string, metric string, mean double, std double, seconds double"
    )


def predictions(model: Model, df: DataFrame, *keep: str) -> DataFrame:
    """Class prediction and, where the model has one, class probability."""
    out = model.transform(df)
    columns = [*keep, "label", "prediction"]
    if "probability" in out.columns:
        return out.select(
            *columns, F.get(vector_to_array("probability"), F.lit(1)).alias("probability")
        )
    return out.select(*columns)


# --- kNN and linear regression -----------------------------------------------------------


def knn_search(
    train: DataFrame,
    test: DataFrame,
    ids: str,
    ks: list[int] | None = None,
    p: float = 2,
    fold: int = 0,
    metrics: tuple[str, ...] = ("areaUnderROC",),
) -> DataFrame:
    """Scores for every k from one neighbour join, as a run log.

    The neighbours for the largest k contain those for all smaller ones, so the
    distances are computed once; the seconds are left to the caller.
    """
    ks = ks or search_ks()
    predicted = knn_predict(test, train, ks, query_id=ids, train_id=ids, vector="features", p=p)
    table = hard_metrics(predicted, by=("k",))
    return table.select(
        F.lit("kNN").alias("algorithm"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("params"),
        F.lit(fold).alias("fold"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(METRICS[m]).alias("value"))
                    for m in metrics
                ]
            )
        ),
        F.lit(None).cast("double").alias("seconds"),
    )


def knn_cross_validation(
    df: DataFrame,
    ids: str,
    ks: list[int] | None = None,
    folds: int = 3,
    seed: int = 7,
    p: float = 2,
    metrics: tuple[str, ...] = ("areaUnderROC",),
) -> DataFrame:
    """Scores for every k and fold as a run log; each fold is searched in the others."""
    folded = with_folds(df, ids, folds=folds, seed=seed)
    logs = [
        knn_search(
            folded.where(F.col("fold") != fold),
            folded.where(F.col("fold") == fold),
            ids,
            ks,
            p,
            fold,
            metrics,
        )
        for fold in range(folds)
    ]
    return reduce(DataFrame.unionByName, logs)


def fit_linear(df: DataFrame, target: str, features: str = "features"):
    """Least squares by the normal equations: one pass, one small matrix."""
    return LinearRegression(
        featuresCol=features, labelCol=target, solver="normal", regParam=0.0
    ).fit(df)
