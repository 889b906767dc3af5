"""Fitted trees as tables: their nodes, scores by joins, and what rows each node holds."""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.split import hash_digits
from flowlens.operators.lookup import broadcast_if_small, fits_broadcast
from flowlens.plans.models import estimator
from flowlens.session import discard, materialize, scratch_path

# Chances of a row to be drawn at most 0, 1, ... times when as many rows are drawn as there are.
_DRAWN = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


# --- bootstrapping by a hash ----------------------------------------------------------------


def _times(digits: Column) -> Column:
    """Draws of a row by the digits of its hash; most rows are done after a comparison or two."""
    found = F.when(digits < f"{math.floor(_DRAWN[0] * (1 << 32)):08x}", 0.0)
    for k, chance in enumerate(_DRAWN[1:], 1):
        found = found.when(digits < f"{math.floor(chance * (1 << 32)):08x}", float(k))
    return found.otherwise(float(len(_DRAWN)))


def drawn_times(seed: int | Column, *ids: Column) -> Column:
    """How often a row is in a bootstrap sample: Poisson by a hash of its id.

    Depends on seed and id alone, so a task that runs again draws the same rows.
    """
    # Inside a lambda the hash is one value; elsewhere each comparison may compute it again.
    return F.get(F.transform(F.array(hash_digits(seed, *ids)), _times), F.lit(0))


def draw_rows(df: DataFrame, ids: list[str], trees: int = 10, seed: int = 100, merge: bool = True) -> DataFrame:
    """``features, label, draws``, stored: rows of equal features and label are one, with the
    draws of all of them for each tree.

    The learner, and a count of the rows in nodes, see no difference, because a weight is a
    sum; only a least number of rows in a node is of rows that are not merged.
    """
    keys = [F.col(c) for c in ids]
    digits = F.array(*[hash_digits(seed + number, *keys) for number in range(trees)])
    # With two uses the digits stay a column, which is compiled; within a lambda's argument
    # they would be interpreted.
    draws = F.when(F.size("_digits") > 0, F.transform("_digits", _times))
    drawn = df.select("features", "label", digits.alias("_digits")).select("features", "label", draws.alias("draws"))
    if not merge:
        return materialize(drawn, "drawn")
    sums = F.array(*[F.sum(F.get("draws", F.lit(number))) for number in range(trees)])
    return materialize(drawn.groupBy("features", "label").agg(sums.alias("draws")), "drawn")


def fit_bagged(
    df: DataFrame, ids: list[str], trees: int = 10, seed: int = 100, parallelism: int = 4, **params
) -> list[Model]:
    """Trees on bootstrap samples of ``df``, tree ``j`` on the one of seed ``seed + j``.

    The same rows give the same trees, however they are partitioned. What the learner needs
    is stored with the draws of all trees, as it reads the rows several times for each.
    """
    stored = draw_rows(df, ids, trees, seed, merge=params.get("minInstancesPerNode", 1) == 1)
    try:
        return fit_drawn(stored, trees, parallelism, **params)
    finally:
        discard(stored)


def fit_drawn(drawn: DataFrame, trees: int = 10, parallelism: int = 4, **params) -> list[Model]:
    """A tree for each of the samples of ``draw_rows``."""

    def one(number: int) -> Model:
        rows = drawn.select("features", "label", F.get("draws", F.lit(number)).alias("drawn"))
        learner = estimator("DTree", **params)
        return learner.setWeightCol("drawn").fit(rows.where("drawn > 0"))

    with ThreadPool(max(1, min(parallelism, trees))) as pool:
        return pool.map(inheritable_thread_target(drawn.sparkSession)(one), range(trees))


# --- nodes ------------------------------------------------------------------------------------


def _number(rows: pd.DataFrame) -> pd.DataFrame:
    """Heap numbers for the nodes of one tree: the children of node i are 2 i and 2 i + 1."""
    rows = rows.sort_values("id")
    numbers = {0: 1}
    # Stored in preorder: parents come before their children.
    for name, left, right in zip(rows["id"], rows["leftChild"], rows["rightChild"]):
        if left >= 0:
            numbers[left], numbers[right] = 2 * numbers[name], 2 * numbers[name] + 1
    return rows.assign(node=rows["id"].map(numbers))[["tree", "id", "node"]]


def node_table(spark: SparkSession, fitted: Model | list[Model]) -> DataFrame:
    """The nodes of a fitted tree, a forest, or several trees, one row each.

    ``node`` is the heap number, 1 at the root. An inner node sends a row to its left child
    if ``feature`` is at most ``cut`` or, of a nominal feature, among ``left_values``;
    leaves have null there. ``gain`` and ``impurity`` are Gini's, ``class_weights`` the
    weight of each class in the rows the model was fitted on.
    """
    stored = []
    for number, model in enumerate(fitted if isinstance(fitted, list) else [fitted]):
        path = scratch_path(spark, "tree")
        model.write().overwrite().save(path)
        nodes = spark.read.parquet(f"{path}/data")
        if "nodeData" in nodes.columns:
            stored.append(nodes.select(F.col("treeID").alias("tree"), "nodeData.*"))
        else:
            stored.append(nodes.withColumn("tree", F.lit(number)))
    rows = reduce(DataFrame.unionByName, stored)
    # A tree was grown on the driver, so it fits a task.
    numbers = (
        rows.select("tree", "id", "leftChild", "rightChild")
        .groupBy("tree")
        .applyInPandas(_number, "tree int, id int, node bigint")
    )
    inner, nominal = F.col("leftChild") >= 0, F.col("split.numCategories") >= 0
    values = F.col("split.leftCategoriesOrThreshold")
    return rows.join(numbers, ["tree", "id"]).select(
        "tree",
        "node",
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ~nominal, F.get(values, F.lit(0))).alias("cut"),
        F.when(inner & nominal, values).alias("left_values"),
        F.when(inner, F.col("gain")).alias("gain"),
        "impurity",
        F.col("impurityStats").alias("class_weights"),
        "prediction",
    )


def place_rows(rows: DataFrame, nodes: DataFrame, features: str = "features") -> DataFrame:
    """Every row once for each tree, with ``tree`` and the ``node`` of the leaf it ends in.

    A join with the inner nodes moves all rows one level down; there are as many joins as
    the deepest tree has levels. Missing values go right, as they do in the learner.
    """
    last, trees = nodes.agg(F.max("node"), F.sort_array(F.collect_set("tree"))).first()
    inner = nodes.where("feature is not null").select(
        F.col("tree").alias("_tree"), F.col("node").alias("_node"), "feature", "cut", "left_values"
    )
    inner = broadcast_if_small(inner)
    placed = (
        rows.withColumn("_values", vector_to_array(features))
        .withColumn("tree", F.explode(F.lit(trees)))
        .withColumn("node", F.lit(1).cast("bigint"))
    )
    value = F.get("_values", F.col("feature"))
    left = F.coalesce(F.when(F.isnan(value), False), value <= F.col("cut"), F.array_contains("left_values", value))
    down = F.when(F.col("feature").isNull(), F.col("node")).otherwise(
        F.col("node") * 2 + F.when(left, 0).otherwise(1)
    )
    for _ in range(int(last).bit_length() - 1):
        placed = (
            placed.join(inner, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")), "left")
            .withColumn("node", down)
            .drop("_tree", "_node", "feature", "cut", "left_values")
        )
    return placed.drop("_values")


def _descend(rows: DataFrame, nodes: list, keys: tuple[str, ...], features: str) -> DataFrame:
    """``keys``, the sum of the shares of a row's leaves in all trees, and the number of trees.

    The nodes go to every task, where a batch of rows moves down all trees level by level.
    """
    place = {(n["tree"], n["node"]): i for i, n in enumerate(nodes)}
    feature = np.array([-1 if n["feature"] is None else n["feature"] for n in nodes])
    cut = np.array([np.inf if n["cut"] is None else n["cut"] for n in nodes])
    share = np.array([np.nan if n["share"] is None else n["share"] for n in nodes])
    below = np.array([
        [i, i] if n["feature"] is None else [place[n["tree"], 2 * n["node"] + side] for side in (0, 1)]
        for i, n in enumerate(nodes)
    ])
    roots = [i for (_, node), i in sorted(place.items()) if node == 1]
    levels = max(n["node"] for n in nodes).bit_length() - 1
    column = np.maximum(feature, 0)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(keys))
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            every, total = np.arange(batch.num_rows), np.zeros(batch.num_rows)
            for root in roots:
                at = np.full(batch.num_rows, root)
                for _ in range(levels):
                    # Missing values are not at most the cut and go right.
                    at = below[at, (~(values[every, column[at]] <= cut[at])).astype(np.intp)]
                total += share[at]
            columns = [*batch.columns[: len(keys)], pa.array(total), pa.array(np.full(len(every), len(roots)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "share", "count"])

    asked = rows.select(*keys, vector_to_array(features).alias("_values"))
    added = [T.StructField("share", T.DoubleType()), T.StructField("count", T.LongType())]
    return asked.mapInArrow(score, T.StructType([*asked.schema.fields[:-1], *added]))


def score_rows(rows: DataFrame, nodes: DataFrame, *keys: str, features: str = "features") -> DataFrame:
    """``keys``, ``probability`` of class 1, the mean of the leaves' shares, ``prediction`` and
    the number of ``trees``. ``keys`` must name a row.

    A row goes down all trees at once, unless the nodes are too many for a task, or some
    split by nominal values; then rows move by joins, once for each tree.
    """
    total = F.aggregate("class_weights", F.lit(0.0), lambda a, x: a + x)
    share = F.when(F.col("feature").isNull(), F.get("class_weights", F.lit(1)) / total)
    slim = nodes.select("tree", "node", "feature", "cut", share.alias("share"))
    if fits_broadcast(slim) and nodes.where("left_values is not null").isEmpty() and not nodes.isEmpty():
        scored = _descend(rows, slim.collect(), keys, features)
        if nodes.select("tree").distinct().count() > 1:
            scored = scored.groupBy(*keys).agg(F.sum("share").alias("share"), F.sum("count").alias("count"))
        scored = scored.select(*keys, (F.col("share") / F.col("count")).alias("probability"), F.col("count").alias("trees"))
        # Equal shares go to class 0, as in the learner.
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
    placed = place_rows(rows.select(*keys, features), nodes, features)
    leaves = nodes.where("feature is null").select(
        "tree", "node", (F.get("class_weights", F.lit(1)) / total).alias("share")
    )
    shares = placed.drop(features).join(broadcast_if_small(leaves), ["tree", "node"])
    trees = nodes.agg(F.count_distinct("tree")).first()[0]
    if trees == 1:
        scored = shares.select(*keys, F.col("share").alias("probability"), F.lit(1).cast("bigint").alias("trees"))
    else:
        scored = shares.groupBy(*keys).agg(F.avg("share").alias("probability"), F.count("*").alias("trees"))
    # Equal shares go to class 0, as in the learner.
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


def node_counts(
    rows: DataFrame, nodes: DataFrame, label: str = "label", weight: Column | None = None, features: str = "features"
) -> DataFrame:
    """What the nodes hold of ``rows``: ``tree, node, n, positives, impurity`` of all rows that
    pass through a node; ``weight`` may use the column ``tree``.

    Rows are counted in their leaves, and the counts, not the rows, go up to all ancestors.
    """
    weight = F.lit(1.0) if weight is None else weight
    leaves = (
        place_rows(rows, nodes, features)
        .withColumn("_weight", weight)
        .groupBy("tree", "node")
        .agg(F.sum("_weight").alias("n"), F.sum(F.col("_weight") * F.col(label)).alias("positives"))
    )
    upward = F.expr("transform(sequence(0, cast(floor(log2(node)) as int)), up -> shiftright(node, up))")
    share = F.col("positives") / F.col("n")
    return (
        leaves.withColumn("node", F.explode(upward))
        .groupBy("tree", "node")
        .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
        .withColumn("impurity", F.when(F.col("n") > 0, 2 * share * (1 - share)))
    )
