"""Vector norms and distances, nearest neighbours, votes, linear regression."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import vectors as V
from flowlens.functions.labels import coarse_label
from flowlens.operators.knn import knn_join, knn_predict, search_ks
from flowlens.operators.leaderboard import summarize_runs
from flowlens.operators.metrics import accuracy_of
from flowlens.plans.models import fit_linear, holdout
from flowlens.plans.models import knn_cross_validation as cross_validate_knn
from flowlens.queries import r, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", V.as_doubles(F.col("embedding")).alias("embedding"), "label"
    )


# --- norms and distances ----------------------------------------------------------------


@query(
    """
    SELECT vec_id, count(*) AS width, round(sum(abs(x)), 6) AS l1,
           round(sqrt(sum(x * x)), 6) AS l2
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id
    """
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).withColumn("v", array_to_vector("embedding"))
    assembled = VectorAssembler(inputCols=["v"], outputCol="features").transform(rows)
    dense = assembled.withColumn("features", V.densify(F.col("features")))
    a = vector_to_array("features")
    return dense.select(
        "vec_id",
        F.size(a).cast("bigint").alias("width"),
        r(V.l1_norm(a), "l1"),
        r(V.l2_norm(a), "l2"),
    )


@query(
    """
    WITH p AS (
      SELECT a.vec_id, unnest(a.embedding)::DOUBLE - unnest(b.embedding)::DOUBLE AS g
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(sqrt(sum(g * g)), 6) AS euclidean, round(sum(abs(g)), 6) AS manhattan,
           round(pow(sum(pow(abs(g), 3)), 1.0 / 3), 6) AS minkowski3
    FROM p GROUP BY vec_id
    """
)
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return rows.join(after, "vec_id").select(
        "vec_id",
        r(V.euclidean(a, b), "euclidean"),
        r(V.manhattan(a, b), "manhattan"),
        r(V.minkowski(a, b, 3), "minkowski3"),
    )


# --- nearest neighbours -------------------------------------------------------------------

_L1 = "list_sum(list_transform(list_zip(q.v, t.v), lambda z: abs(z[1] - z[2])))"
_L2 = "sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_VECTORS = """
    e AS (
      SELECT vec_id, embedding::DOUBLE[] AS v, label,
             ('0x' || substr(md5('7:' || vec_id), 1, 8))::BIGINT % 100 < 33 AS held
      FROM embeddings)
"""


def _neighbors_sql(distance: str) -> str:
    return f"""
    WITH {_VECTORS}, d AS (
      SELECT q.vec_id AS query_id, t.vec_id AS train_id, {distance} AS distance
      FROM e q CROSS JOIN e t)
    SELECT query_id, train_id, round(distance, 6) AS distance, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank
          FROM d)
    WHERE rank <= 5
    """


def _votes_sql(distance: str, ks: list[int]) -> str:
    values = ", ".join(f"({k})" for k in ks)
    return f"""
    WITH {_VECTORS}, d AS (
      SELECT q.vec_id AS query_id, q.label AS truth, t.vec_id AS train_id, t.label, {distance} AS distance
      FROM e q CROSS JOIN e t WHERE q.held AND NOT t.held),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d),
    votes AS (
      SELECT query_id, truth, k, label, count(*) AS n
      FROM ranked JOIN (VALUES {values}) AS g(k) ON rank <= k GROUP BY ALL),
    winners AS (
      SELECT query_id, truth AS label, k, label AS prediction
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY n DESC, label) AS place
            FROM votes)
      WHERE place = 1)
    """


def _neighbors(spark: SparkSession, sf_dir: str, p: float) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    found = knn_join(
        rows, rows, 5, p=p, query_id="vec_id", train_id="vec_id", vector="embedding"
    )
    return found.select("query_id", "train_id", r("distance", "distance"), "rank")


def _votes(spark: SparkSession, sf_dir: str, ks: list[int], p: float) -> DataFrame:
    train, test = holdout(_embeddings(spark, sf_dir), "vec_id")
    return knn_predict(
        test, train, ks, query_id="vec_id", train_id="vec_id", vector="embedding", p=p
    )


@query(_neighbors_sql(_L1))
def knn_neighbors_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 1)


@query(_neighbors_sql(_L2))
def knn_neighbors_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 2)


@query(_votes_sql(_L1, [3, 7]) + "SELECT query_id, k, label, prediction FROM winners")
def knn_vote_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir, [3, 7], 1).select("query_id", "k", "label", "prediction")


@query(_votes_sql(_L2, [3, 7]) + "SELECT query_id, k, label, prediction FROM winners")
def knn_vote_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir, [3, 7], 2).select("query_id", "k", "label", "prediction")


@query(
    _votes_sql(_L1, [3])
    + "SELECT count(*) AS n, round(100.0 * avg((prediction = label)::INTEGER), 6) AS accuracy FROM winners"
)
def knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir, [3], 1).agg(
        F.count(F.lit(1)).alias("n"),
        r(accuracy_of(F.col("prediction"), F.col("label")) * 100, "accuracy"),
    )


@query(
    _votes_sql(_L2, search_ks())
    + "SELECT k, round(avg((prediction = label)::INTEGER), 6) AS accuracy FROM winners GROUP BY k"
)
def knn_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _votes(spark, sf_dir, search_ks(), 2)
        .groupBy("k")
        .agg(r(accuracy_of(F.col("prediction"), F.col("label")), "accuracy"))
    )


@query(
    f"""
    WITH e AS (
      SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label = 0 THEN 0 ELSE 1 END AS label,
             ('0x' || substr(md5('7:' || vec_id), 1, 8))::BIGINT % 3 AS fold
      FROM embeddings),
    d AS (
      SELECT q.vec_id AS query_id, q.label AS truth, q.fold, t.vec_id AS train_id, t.label,
             {_L2} AS distance
      FROM e q CROSS JOIN e t WHERE q.fold <> t.fold),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d),
    votes AS (
      SELECT query_id, truth, fold, k, label, count(*) AS n
      FROM ranked JOIN (VALUES (1), (3), (5)) AS g(k) ON rank <= k GROUP BY ALL),
    winners AS (
      SELECT fold, k, truth, label AS prediction
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY n DESC, label) AS place
            FROM votes)
      WHERE place = 1),
    scores AS (
      SELECT fold, k, avg((prediction = truth)::INTEGER) AS accuracy,
             (avg(prediction) FILTER (truth = 1) + avg(1 - prediction) FILTER (truth = 0)) / 2 AS auroc
      FROM winners GROUP BY fold, k),
    log AS (
      SELECT k, 'accuracy' AS metric, accuracy AS value FROM scores
      UNION ALL SELECT k, 'areaUnderROC' AS metric, auroc AS value FROM scores)
    SELECT 'k=' || k AS key, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
           count(*) AS runs
    FROM log GROUP BY k, metric
    """
)
def knn_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select(
        "vec_id",
        F.col("embedding").alias("features"),
        coarse_label(F.col("label").cast("string"), normal="0").alias("label"),
    )
    log = cross_validate_knn(rows, "vec_id", [1, 3, 5], metrics=("accuracy", "areaUnderROC"))
    return summarize_runs(log).select("key", "metric", r("mean", "mean"), r("std", "std"), "runs")


# --- linear regression --------------------------------------------------------------------


@query(
    """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept
    FROM lineitem
    """
)
def linreg_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(items)
    model = fit_linear(rows, "l_extendedprice")
    return spark.range(1).select(
        r(F.lit(float(model.coefficients[0])), "slope"),
        r(F.lit(float(model.intercept)), "intercept"),
    )


@query(
    """
    WITH m AS (
      SELECT covar_pop(l_quantity, l_extendedprice) AS sy1, covar_pop(l_discount, l_extendedprice) AS sy2,
             covar_pop(l_quantity, l_discount) AS s12, var_pop(l_quantity) AS s11,
             var_pop(l_discount) AS s22, avg(l_quantity) AS m1, avg(l_discount) AS m2,
             avg(l_extendedprice) AS my
      FROM lineitem),
    b AS (
      SELECT (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b1,
             (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my
      FROM m)
    SELECT l_orderkey, l_linenumber,
           round(my - b1 * m1 - b2 * m2 + b1 * l_quantity + b2 * l_discount, 3) AS prediction
    FROM lineitem, b
    """
)
def linreg_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"
    )
    rows = VectorAssembler(
        inputCols=["l_quantity", "l_discount"], outputCol="features"
    ).transform(items)
    model = fit_linear(rows, "l_extendedprice")
    return model.transform(rows).select(
        "l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction")
    )
