"""Preparation of connection records, model fitting, search and scoring."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.labels import coarse_label
from flowlens.functions.split import in_holdout
from flowlens.functions.vectors import active_indices, as_doubles, value_at, vector_size
from flowlens.operators.knn import knn_approximate, knn_join, recall
from flowlens.operators.leaderboard import leaderboard, params_key
from flowlens.operators.metrics import curve_points as score_curve
from flowlens.operators.metrics import hinge_certificate, ranking_areas
from flowlens.operators.scale import MinMax
from flowlens.plans import experiment, models, trees
from flowlens.plans.prepare import CoarseLabeler, encoding_stages, fit_features, prepared
from flowlens.queries import r, table
from flowlens.queries.traffic import CONNECTION_SQL, connection_columns, connections
from flowlens.schema import FEATURES, FEATURES_14, FEATURES_16, ROLES
from flowlens.session import discard, materialize, scratch_path, spread
from flowlens.sources.models import load_model, save_model
from flowlens.sources.tables import read_connections, write_typed_csv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- connection records -----------------------------------------------------------------------


@query(
    f"""
    WITH c AS ({CONNECTION_SQL})
    SELECT labels, protocol_type, count(*) AS n, round(sum(src_bytes), 2) AS src_bytes,
           round(avg(dst_host_count), 6) AS dst_host_count, max(service) AS service,
           round(sum("count" + duration + labels_numeric), 2) AS total
    FROM c GROUP BY labels, protocol_type
    """
)
def scan_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "connections-csv")
    write_typed_csv(connections(spark, sf_dir).select(*connection_columns()), path, null_text="")
    return (
        read_connections(spark, path)
        .groupBy("labels", "protocol_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("src_bytes"), 2).alias("src_bytes"),
            r(F.avg("dst_host_count"), "dst_host_count"),
            F.max("service").alias("service"),
            F.round(F.sum(F.col("count") + F.col("duration") + F.col("labels_numeric")), 2).alias(
                "total"
            ),
        )
    )


_HELD = "('0x' || substr(md5('7:' || conn_id), 1, 8))::BIGINT % 100 < 33"


def _prepare_sql(columns: tuple[str, ...]) -> str:
    """CTEs: ranges and level ranks of the train part, applied to all rows."""
    numeric = [c for c in columns if ROLES[c] == "numeric"]
    binary = [c for c in columns if ROLES[c] == "binary"]
    nominal = [c for c in columns if ROLES[c] == "nominal"]
    bounds = ", ".join(f'min("{c}") AS "{c}_lo", max("{c}") AS "{c}_hi"' for c in numeric)
    scaled = ", ".join(
        f'CASE WHEN "{c}_hi" > "{c}_lo" THEN ("{c}" - "{c}_lo") / ("{c}_hi" - "{c}_lo")'
        f' ELSE 0 END AS "{c}"'
        for c in numeric
    )
    ranks = "".join(
        f""", {c}_rank AS (
          SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS {c}_index
          FROM c WHERE NOT held GROUP BY {c})"""
        for c in nominal
    )
    joins = " ".join(f"LEFT JOIN {c}_rank USING ({c})" for c in nominal)
    indexes = "".join(f", {c}_index" for c in nominal)
    plain = "".join(f', "{c}"' for c in binary)
    return f"""
    WITH c AS (SELECT *, {_HELD} AS held FROM ({CONNECTION_SQL})),
    b AS (SELECT {bounds} FROM c WHERE NOT held){ranks},
    p AS (
      SELECT conn_id, held, CASE WHEN labels = 'normal' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label,
             {scaled}{plain}{indexes}
      FROM c CROSS JOIN b {joins})
    """


def _prepared(
    spark: SparkSession, sf_dir: str, features: int, reload: bool = False
) -> DataFrame:
    """All records, encoded with what the train part taught."""
    rows = connections(spark, sf_dir).withColumn("held", in_holdout(F.col("conn_id")))
    fitted = fit_features(rows.where(~F.col("held")), features)
    if reload:  # store the preparation and load it again, as a later scoring job would
        path = scratch_path(spark, "preparation")
        save_model(fitted, path)
        fitted = load_model(path)
    return prepared(fitted, rows, "conn_id", "held")


@query(
    _prepare_sql(FEATURES_14)
    + "SELECT conn_id, held, label, "
    + ", ".join(f'round("{c}", 6) AS "{c}"' for c in FEATURES_14)
    + " FROM p"
)
def prepare_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _prepared(spark, sf_dir, 14).withColumn("a", vector_to_array("features"))
    return out.select(
        "conn_id", "held", "label", *[r(F.col("a")[i], c) for i, c in enumerate(FEATURES_14)]
    )


def _hot(active: Column, start: int, stop: int) -> Column:
    """Which position of a one-hot block is set, null if none is, from all that are."""
    hot = F.filter(active, lambda i: (i >= start) & (i < stop))
    return (F.get(hot, F.lit(0)) - start).cast("bigint")


@query(
    _prepare_sql(FEATURES_16)
    + """
    SELECT conn_id, held, label, service_index, flag_index, round("count", 6) AS "count",
           round(dst_bytes, 6) AS dst_bytes, round(dst_host_rerror_rate, 6) AS dst_host_rerror_rate,
           (SELECT count(*) FROM service_rank) + (SELECT count(*) FROM flag_rank) + 14 AS width
    FROM p
    """
)
def prepare_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _prepared(spark, sf_dir, 16, reload=True).withColumn("a", vector_to_array("features"))
    out = out.withColumn("active", active_indices(F.col("features")))
    a, active = F.col("a"), F.col("active")
    services = F.size(a) - 14 - 11
    return out.select(
        "conn_id",
        "held",
        "label",
        _hot(active, 14, 14 + services).alias("service_index"),
        _hot(active, 14 + services, F.size(a)).alias("flag_index"),
        r(a[FEATURES_14.index("count")], "count"),
        r(a[FEATURES_14.index("dst_bytes")], "dst_bytes"),
        r(a[FEATURES_14.index("dst_host_rerror_rate")], "dst_host_rerror_rate"),
        F.size(a).cast("bigint").alias("width"),
    )


_PLAIN_41 = [c for c in FEATURES if ROLES[c] != "nominal"]


@query(
    _prepare_sql(FEATURES)
    + "SELECT conn_id, held, label, round("
    + " + ".join(f'"{c}"' for c in _PLAIN_41)
    + ", 6) AS plain_sum, round("
    + " + ".join(f'{i + 1} * "{c}"' for i, c in enumerate(_PLAIN_41))
    + """, 6) AS weighted_sum,
       ((protocol_type_index IS NOT NULL)::INTEGER + (service_index IS NOT NULL)::INTEGER
        + (flag_index IS NOT NULL)::INTEGER)::DOUBLE AS hot_sum
    FROM p
    """
)
def prepare_41(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(_PLAIN_41)
    out = _prepared(spark, sf_dir, 41).withColumn("a", vector_to_array("features"))
    plain = F.slice("a", 1, n)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    return out.select(
        "conn_id",
        "held",
        "label",
        r(total(plain), "plain_sum"),
        r(total(F.transform(plain, lambda x, i: x * (i + 1))), "weighted_sum"),
        total(F.slice("a", n + 1, F.size("a"))).alias("hot_sum"),
    )


_WIDE_KEYS = ("l_orderkey", "l_linenumber", "l_suppkey")
_WIDE_HELD = f"('0x' || substr(md5('7:' || {" || ':' || ".join(_WIDE_KEYS)}), 1, 8))::BIGINT % 100 < 33"


@query(
    f"""
    WITH t AS (SELECT *, {_WIDE_HELD} AS held FROM lineitem),
    part AS (SELECT l_partkey::VARCHAR AS level, row_number() OVER (ORDER BY count(*) DESC, l_partkey::VARCHAR) - 1 AS slot
             FROM t WHERE NOT held GROUP BY l_partkey),
    ship AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS level,
                    row_number() OVER (ORDER BY count(*) DESC, strftime(l_shipdate, '%Y-%m-%d')) - 1 AS slot
             FROM t WHERE NOT held GROUP BY 1),
    b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM t WHERE NOT held)
    SELECT {', '.join(_WIDE_KEYS)}, held, CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label,
           round((l_quantity - lo) / (hi - lo), 6) AS quantity, part.slot AS part_slot, ship.slot AS ship_slot,
           2 + (SELECT count(*) FROM part) + (SELECT count(*) FROM ship) AS width
    FROM t CROSS JOIN b LEFT JOIN part ON part.level = l_partkey::VARCHAR
         LEFT JOIN ship ON ship.level = strftime(l_shipdate, '%Y-%m-%d')
    """
)
def prepare_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal columns whose levels stay a table, saved with the preparation and loaded again."""
    rows = _spread_items(spark, sf_dir).select(
        *_WIDE_KEYS, "l_quantity", "l_tax", "l_returnflag", F.col("l_partkey").cast("string").alias("part"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"), in_holdout(*[F.col(k) for k in _WIDE_KEYS]).alias("held"),
    )
    roles = {"l_quantity": "numeric", "l_tax": "binary", "part": "nominal", "ship": "nominal"}
    fitted = fit_features(
        rows.where("not held"), list(roles), roles, label_stage=CoarseLabeler(inputCol="l_returnflag", normal="N"),
        collected_levels=0,
    )
    path = scratch_path(spark, "wide-preparation")
    save_model(fitted, path)
    fitted = load_model(path)
    parts = F.lit(2 + fitted.stages[-1].getOrDefault("sizes")[0])
    v = F.col("features")
    out = prepared(fitted, rows, *_WIDE_KEYS, "held").withColumn("width", vector_size(v))
    return out.withColumn("active", active_indices(v)).select(
        *_WIDE_KEYS, "held", "label",
        F.coalesce(r(value_at(v, 0), "quantity"), F.lit(0.0)).alias("quantity"),
        _hot(F.col("active"), 2, parts).alias("part_slot"),
        _hot(F.col("active"), parts, F.col("width")).alias("ship_slot"),
        F.col("width").cast("bigint").alias("width"),
    )


# --- models on the embeddings -------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id",
        array_to_vector(as_doubles(F.col("embedding"))).alias("features"),
        coarse_label(F.col("label").cast("string"), normal="0").alias("label"),
    )


def _held_predictions(
    spark: SparkSession, sf_dir: str, algorithm: str, **params
) -> DataFrame:
    train, test = models.holdout(_vectors(spark, sf_dir), "vec_id")
    model = models.estimator(algorithm, **params).fit(train)
    return models.predictions(model, test, "vec_id")


@query()
def model_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_predictions(spark, sf_dir, "binLR", tol=1e-3, maxIter=100)


@query()
def model_linsvc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_predictions(spark, sf_dir, "linSVC", tol=0.1, maxIter=10, regParam=1e-4)


@query()
def model_dtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_predictions(spark, sf_dir, "DTree", maxDepth=8, maxFeatures=14)


@query()
def model_rforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_predictions(spark, sf_dir, "RForest", maxDepth=8, maxFeatures=8, numTrees=10)


# --- models whose optimum SQL can compute ---------------------------------------------------------

# With one nominal feature the best logistic regression predicts the share of attacks per
# level; with few distinct values the best first split of a tree is a search over all of them.
_SHARE_LABEL = "l_orderkey % 9 < l_linenumber"
_SPLIT_LABEL = "l_quantity * (1 - l_discount) > 25"
_SPLIT_FEATURES = ["l_quantity", "l_discount", "l_linenumber"]

_SPLIT_SQL = f"""
    WITH t AS (SELECT *, ({_SPLIT_LABEL})::INTEGER AS y FROM lineitem),
    tot AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM t),
    vals AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS f, {c}::DOUBLE AS v, count(*) AS n, sum(y) AS s FROM t GROUP BY {c}"
        for c in _SPLIT_FEATURES)}),
    cum AS (SELECT f, v, (sum(n) OVER w)::DOUBLE AS nl, (sum(s) OVER w)::DOUBLE AS sl
            FROM vals WINDOW w AS (PARTITION BY f ORDER BY v)),
    best AS (
      SELECT f, v, sl / nl AS pl, (s - sl) / (n - nl) AS pr
      FROM cum, tot WHERE nl < n
      ORDER BY sl * (1 - sl / nl) + (s - sl) * (1 - (s - sl) / (n - nl)) LIMIT 1),
    sided AS (
      SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
             CASE WHEN (CASE f {" ".join(f"WHEN '{c}' THEN {c}::DOUBLE" for c in _SPLIT_FEATURES)} END)
                  <= v THEN pl ELSE pr END AS p
      FROM t, best)
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
           CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
           round(p, 6) AS probability
    FROM sided
"""


def _spread_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


def _first_split(spark: SparkSession, sf_dir: str, algorithm: str, **params) -> DataFrame:
    items = _spread_items(spark, sf_dir).select(
        "l_orderkey", *_SPLIT_FEATURES, F.expr(_SPLIT_LABEL).cast("double").alias("label")
    )
    rows = VectorAssembler(inputCols=_SPLIT_FEATURES, outputCol="features").transform(items)
    model = models.estimator(algorithm, maxDepth=1, maxBins=64, **params).fit(rows)
    return models.predictions(model, rows, "l_orderkey", *_SPLIT_FEATURES).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "prediction",
        r("probability", "probability"),
    )


@query(_SPLIT_SQL)
def model_first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_split(spark, sf_dir, "DTree")


@query(_SPLIT_SQL)
def model_forest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of one tree that sees all rows and all columns."""
    return _first_split(
        spark, sf_dir, "RForest", numTrees=1, bootstrap=False, maxFeatures=len(_SPLIT_FEATURES)
    )


# Whole trees: SQL grows them level by level over all cuts of all features, then takes out
# splits whose leaves agree, as the learner does.
_TREE_LABEL = (
    "(l_quantity * (round(l_discount * 100) + l_linenumber) + (l_orderkey * 7919 + l_linenumber * 104729) % 40) % 120 > 60"
)
_TREE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_TREE_DEPTH = 5
_TREE_SEED = 100


def _drawn_sql(tree: str, keys: tuple[str, ...]) -> str:
    at = f"('0x' || substr(md5(({_TREE_SEED} + {tree}) || ':' || {" || ':' || ".join(keys)}), 1, 8))::BIGINT"
    over = " + ".join(f"CASE WHEN {at} >= {math.floor(c * (1 << 32))} THEN 1 ELSE 0 END" for c in trees._DRAWN)
    return f"({over})"


def _trees_sql(count: int, weight: str) -> str:
    """CTEs: ``rows_`` with features x0 to x2, ``nodes`` of all trees, ``kept`` after taking out."""
    xs = range(len(_SPLIT_FEATURES))
    values = ", ".join(f"{c}::DOUBLE AS x{i}" for i, c in enumerate(_SPLIT_FEATURES))
    pick = " ".join(f"WHEN {i} THEN x{i}" for i in xs)
    steps = [
        f"""rows_ AS (SELECT {', '.join(_TREE_KEYS)}, {values}, ({_TREE_LABEL})::INTEGER::DOUBLE AS y FROM lineitem),
        following AS ({" UNION ALL ".join(
            f"SELECT {i} AS f, v, lead(v) OVER (ORDER BY v) AS above FROM (SELECT DISTINCT x{i} AS v FROM rows_)"
            for i in xs)}),
        cells0 AS MATERIALIZED (
          SELECT tree, 1::BIGINT AS node, x0, x1, x2, sum(w) AS n, sum(w * y) AS s
          FROM (SELECT *, ({weight})::DOUBLE AS w FROM rows_, range({count}) AS r(tree)) WHERE w > 0
          GROUP BY tree, x0, x1, x2)"""
    ]
    for d in range(_TREE_DEPTH):
        steps.append(
            f"""whole{d} AS (SELECT tree, node, sum(n) AS n, sum(s) AS s FROM cells{d} GROUP BY tree, node),
            sides{d} AS (
              SELECT tree, node, f, v, sum(sum(n)) OVER k AS nl, sum(sum(s)) OVER k AS sl
              FROM ({" UNION ALL ".join(f"SELECT tree, node, {i} AS f, x{i} AS v, n, s FROM cells{d}" for i in xs)})
              GROUP BY tree, node, f, v WINDOW k AS (PARTITION BY tree, node, f ORDER BY v)),
            gains{d} AS (
              SELECT tree, node, f, v, n, s,
                     2 * (s / n) * (1 - s / n) - 2 * (sl * (1 - sl / nl) + (s - sl) * (1 - (s - sl) / (n - nl))) / n AS gain
              FROM sides{d} JOIN whole{d} USING (tree, node) WHERE nl < n AND s > 0 AND s < n),
            best{d} AS MATERIALIZED (
              SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, v) AS place FROM gains{d})
              JOIN following USING (f, v) WHERE place = 1 AND gain > 1e-12),
            cells{d + 1} AS MATERIALIZED (
              SELECT tree, node * 2 + (CASE f {pick} END > v)::INTEGER AS node, x0, x1, x2, c.n, c.s
              FROM cells{d} AS c JOIN best{d} USING (tree, node))"""
        )
    last = _TREE_DEPTH
    steps.append(
        f"""whole{last} AS (SELECT tree, node, sum(n) AS n, sum(s) AS s FROM cells{last} GROUP BY tree, node),
        grown{last} AS (SELECT *, NULL::INTEGER AS f, NULL::DOUBLE AS cut, NULL::DOUBLE AS gain FROM whole{last})"""
    )
    # A split stays if a side is split itself or its sides predict different classes.
    for d in reversed(range(last)):
        steps.append(
            f"""stays{d} AS (
              SELECT tree, node // 2 AS node FROM grown{d + 1} GROUP BY tree, node // 2
              HAVING bool_or(f IS NOT NULL) OR count(DISTINCT s > n - s) = 2),
            grown{d} AS (
              SELECT w.tree, w.node, w.n, w.s, CASE WHEN k.node IS NOT NULL THEN b.f END AS f,
                     CASE WHEN k.node IS NOT NULL THEN (b.v + b.above) / 2 END AS cut,
                     CASE WHEN k.node IS NOT NULL THEN b.gain END AS gain
              FROM whole{d} AS w LEFT JOIN best{d} AS b USING (tree, node) LEFT JOIN stays{d} AS k USING (tree, node))"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM grown{d}" for d in range(last + 1))
    # Nodes below a split that was taken out go too.
    steps.append(
        f"""every AS MATERIALIZED ({every}),
        kept AS MATERIALIZED (
          SELECT e.* FROM every AS e LEFT JOIN every AS p ON p.tree = e.tree AND p.node = e.node // 2
          WHERE e.node = 1 OR p.f IS NOT NULL)"""
    )
    return "WITH " + ",\n".join(steps)


_NODES_SQL = """
    SELECT tree::INTEGER AS tree, node, f AS feature, round(cut, 6) AS cut, round(n, 6) AS n, round(s, 6) AS positives,
           round(2 * (s / n) * (1 - s / n), 6) AS impurity, round(gain, 6) AS gain,
           CASE WHEN s > n - s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
    FROM kept
"""


def _descend_sql(count: int) -> str:
    """Leaf of each row in each tree."""
    pick = " ".join(f"WHEN {i} THEN x{i}" for i in range(len(_SPLIT_FEATURES)))
    out = f"down0 AS (SELECT {', '.join(_TREE_KEYS)}, x0, x1, x2, tree, 1::BIGINT AS node FROM rows_, range({count}) AS r(tree))"
    for d in range(_TREE_DEPTH):
        out += f""", down{d + 1} AS (
          SELECT {', '.join(f'q.{k}' for k in _TREE_KEYS)}, x0, x1, x2, q.tree,
                 CASE WHEN k.f IS NULL THEN q.node ELSE q.node * 2 + (CASE k.f {pick} END > k.cut)::INTEGER END AS node
          FROM down{d} AS q LEFT JOIN kept AS k ON k.tree = q.tree AND k.node = q.node)"""
    return f", {out}"


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _spread_items(spark, sf_dir).select(
        *_TREE_KEYS, "l_quantity", "l_discount", F.expr(_TREE_LABEL).cast("double").alias("label")
    )
    rows = VectorAssembler(inputCols=_SPLIT_FEATURES, outputCol="features").transform(items)
    return rows.select(*_TREE_KEYS, "l_quantity", "l_discount", "features", "label")


def _one_tree(spark: SparkSession, rows: DataFrame) -> DataFrame:
    fitted = models.estimator("DTree", maxDepth=_TREE_DEPTH, maxBins=64).fit(rows)
    return materialize(trees.node_table(spark, fitted), "nodes")


def _bagged(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples, and the nodes of the trees fitted on them."""
    drawn = trees.draw_rows(rows, list(_TREE_KEYS), 10, _TREE_SEED)
    fitted = trees.fit_drawn(drawn, 10, maxDepth=_TREE_DEPTH, maxBins=64)
    return drawn, materialize(trees.node_table(spark, fitted), "nodes")


def _held(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Nodes with what a count of the rows in them says, not what the learner noted."""
    own = counts.select("tree", "node", "n", "positives", F.col("impurity").alias("own"))
    return nodes.join(own, ["tree", "node"]).select(
        "tree", "node", "feature", r("cut", "cut"), r("n", "n"), r("positives", "positives"), r("own", "impurity"),
        r("gain", "gain"), "prediction",
    )


@query(_trees_sql(1, "1") + _NODES_SQL)
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of five levels, each node with the rows that reach it."""
    rows = _tree_rows(spark, sf_dir)
    nodes = _one_tree(spark, rows)
    return _held(nodes, trees.node_counts(rows, nodes))


@query(
    _trees_sql(1, "1")
    + _descend_sql(1)
    + f"""
    SELECT {', '.join(f'd.{k}' for k in _TREE_KEYS)}, d.node, round(k.s / k.n, 6) AS probability,
           CASE WHEN k.s > k.n - k.s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
    FROM down{_TREE_DEPTH} AS d JOIN kept AS k USING (tree, node)
    """
)
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf of every row and what it says, by joins with the nodes."""
    rows = _tree_rows(spark, sf_dir)
    nodes = _one_tree(spark, rows)
    placed = trees.place_rows(rows.select(*_TREE_KEYS, "features"), nodes)
    weights = F.col("class_weights")
    share = F.get(weights, F.lit(1)) / (F.get(weights, F.lit(0)) + F.get(weights, F.lit(1)))
    return placed.join(nodes.where("feature is null"), ["tree", "node"]).select(
        *_TREE_KEYS, "node", r(share, "probability"), "prediction"
    )


@query(_trees_sql(10, _drawn_sql("tree", _TREE_KEYS)) + _NODES_SQL)
def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten trees on samples drawn by a hash, each node with the drawn rows that reach it."""
    drawn, nodes = _bagged(spark, _tree_rows(spark, sf_dir))
    return _held(nodes, trees.node_counts(drawn, nodes, weight=F.get("draws", F.col("tree"))))


@query(
    _trees_sql(10, _drawn_sql("tree", _TREE_KEYS))
    + _descend_sql(10)
    + f"""
    , mean AS (SELECT {', '.join(_TREE_KEYS)}, x0, x1, x2, avg(k.s / k.n) AS p, count(*) AS n
               FROM down{_TREE_DEPTH} AS d JOIN kept AS k USING (tree, node) GROUP BY ALL)
    SELECT {', '.join(_TREE_KEYS)}, round(p, 6) AS probability, n AS trees,
           CASE WHEN round(p, 9) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
    FROM mean
    """
)
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of ten trees for every row."""
    rows = _tree_rows(spark, sf_dir)
    drawn, nodes = _bagged(spark, rows)
    discard(drawn)
    # Line items may share all keys; with their features they are the rows that SQL groups.
    scored = trees.score_rows(rows, nodes, *_TREE_KEYS, "l_quantity", "l_discount")
    return scored.select(
        *_TREE_KEYS, r("probability", "probability"), "trees",
        (F.round("probability", 9) > 0.5).cast("double").alias("prediction"),
    )


@query(
    f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, ({_SHARE_LABEL})::INTEGER AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           CASE WHEN avg(y) OVER w > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
           round(avg(y) OVER w, 4) AS probability
    FROM t WINDOW w AS (PARTITION BY l_linenumber)
    """
)
def model_logreg_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _spread_items(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linenumber").cast("string").alias("line"),
        F.expr(_SHARE_LABEL).cast("double").alias("label"),
    )
    encoded = Pipeline(stages=encoding_stages(items, ["line"])).fit(items).transform(items)
    rows = encoded.withColumnRenamed("line_numeric", "features")
    model = models.estimator("binLR", tol=1e-8, maxIter=200).fit(rows)
    return models.predictions(model, rows, "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", "prediction",
        F.round("probability", 4).alias("probability"),
    )


@query()
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hash folds over a small tolerance grid, ranked."""
    grid = models.param_grid(tol=[1.0, 1e-3], maxIter=[10, 100])
    fitted = models.cross_validate("binLR", _vectors(spark, sf_dir), ["vec_id"], grid)
    return models.cross_validation_log(spark, "binLR", fitted).select(
        "algorithm", "key", "metric", "mean", "std"
    )


@query()
def model_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated hold-out over a tree grid; the best parameter sets."""
    log = models.repeated_holdout(
        "DTree",
        _vectors(spark, sf_dir),
        ["vec_id"],
        models.param_grid(maxDepth=[3, 6], maxBins=[14, 32]),
    )
    return leaderboard(log, 5)


_TREE_HELD = f"('0x' || substr(md5('7:' || {" || ':' || ".join(_TREE_KEYS)}), 1, 8))::BIGINT % 100 < 33"


def _validation_sql() -> str:
    """The held-out accuracy of trees of each depth grown on the other rows."""
    pick = " ".join(f"WHEN {i} THEN x{i}" for i in range(len(_SPLIT_FEATURES)))
    out = _trees_sql(1, f"CASE WHEN {_TREE_HELD} THEN 0 ELSE 1 END")
    out += f", all_nodes AS ({' UNION ALL '.join(f'SELECT node, s > n - s AS yes FROM whole{d}' for d in range(_TREE_DEPTH + 1))})"
    out += f", down0 AS (SELECT x0, x1, x2, y, 1::BIGINT AS node FROM rows_ WHERE {_TREE_HELD})"
    for d in range(_TREE_DEPTH):
        out += f""", down{d + 1} AS (
          SELECT x0, x1, x2, y, CASE WHEN b.node IS NULL THEN q.node
                 ELSE q.node * 2 + (CASE b.f {pick} END > (b.v + b.above) / 2)::INTEGER END AS node
          FROM down{d} AS q LEFT JOIN best{d} AS b ON b.node = q.node)"""
    points = " UNION ALL ".join(
        f"SELECT {d - 1} AS place, {d} AS depth, avg(((y = 1) = yes)::INTEGER) AS value FROM down{d} JOIN all_nodes USING (node)"
        for d in range(1, _TREE_DEPTH + 1)
    )
    return out + f"""
    , points AS ({points})
    SELECT place::INTEGER AS place, 'maxBins=64:maxDepth=' || depth AS key, round(value, 6) AS value,
           row_number() OVER (ORDER BY value DESC, place) = 1 AS best FROM points
    """


@query(_validation_sql())
def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of a search on one split by a hash, and the best of them."""
    grid = models.param_grid(maxDepth=range(1, _TREE_DEPTH + 1), maxBins=[64])
    found = models.train_validation("DTree", _tree_rows(spark, sf_dir), list(_TREE_KEYS), grid, metric="accuracy")
    return found.log(spark).select("place", params_key(F.col("params")).alias("key"), r("value", "value"), "best")


@query(
    f"""
    WITH t AS (SELECT l_linenumber::VARCHAR AS line, ({_SHARE_LABEL})::INTEGER AS y FROM lineitem),
    g AS (SELECT line, count(*) AS n, avg(y) AS p FROM t GROUP BY line)
    SELECT (row_number() OVER (ORDER BY n DESC, line) - 1)::INTEGER AS position, round(ln(p / (1 - p)), 2) AS logit FROM g
    """
)
def validation_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's coefficients as a table: the logit of each level of one nominal feature."""
    items = _spread_items(spark, sf_dir).select(
        *_TREE_KEYS, F.col("l_linenumber").cast("string").alias("line"), F.expr(_SHARE_LABEL).cast("double").alias("label")
    )
    encoded = Pipeline(stages=encoding_stages(items, ["line"])).fit(items).transform(items)
    rows = encoded.withColumnRenamed("line_numeric", "features")
    grid = models.param_grid(tol=[1e-9], maxIter=[200, 300])
    found = models.train_validation("binLR", rows, list(_TREE_KEYS), grid, metric="accuracy")
    table_ = found.coefficients(spark)
    intercept = table_.where("position = -1").select(F.col("coefficient").alias("intercept"))
    return (
        table_.where("position >= 0").join(F.broadcast(intercept), F.lit(True))
        .select("position", F.round(F.col("coefficient") + F.col("intercept"), 2).alias("logit"))
    )


# --- real-valued scores, and proofs of being best ------------------------------------------------

_SCORED_SQL = """
    WITH t AS (SELECT l_returnflag, l_linestatus, round(l_extendedprice * l_discount, 0) AS score,
                      (l_quantity * 2 + l_linenumber * 5 + l_orderkey % 40 > 80)::INTEGER AS y FROM lineitem),
    g AS (SELECT l_returnflag, l_linestatus, score, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
          FROM g WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY score DESC))
"""
_SCORED_BY = ("l_returnflag", "l_linestatus")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_items(spark, sf_dir).select(
        *_SCORED_BY,
        F.round(F.col("l_extendedprice") * F.col("l_discount")).alias("score"),
        F.expr("l_quantity * 2 + l_linenumber * 5 + l_orderkey % 40 > 80").cast("int").alias("label"),
    )


@query(
    _SCORED_SQL
    + """
    SELECT l_returnflag, l_linestatus, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
           round(sum(neg::DOUBLE * (tp - pos + pos / 2.0::DOUBLE)) / sum(pos) / sum(neg), 6) AS auroc,
           round(sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp > pos + neg
                 THEN (tp - pos) / (tp + fp - pos - neg) ELSE tp / (tp + fp) END) / 2) / sum(pos), 6) AS aupr
    FROM c GROUP BY l_returnflag, l_linestatus
    """
)
def score_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ranges far below the number of scores, so that sums go over several of them.
    return ranking_areas(_scored(spark, sf_dir), by=_SCORED_BY, range_rows=10_000).select(
        *_SCORED_BY, "positives", "negatives", r("auroc", "auroc"), r("aupr", "aupr")
    )


@query(
    _SCORED_SQL
    + """
    SELECT l_returnflag, l_linestatus, score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c
    """
)
def score_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_curve(_scored(spark, sf_dir), by=_SCORED_BY, range_rows=10_000)


# The separator halfway between the class means, which SQL finds too, and how far it is
# from the best one for the hinge loss.
_MARGIN_FEATURES = ("l_quantity / 50", "l_discount * 10", "l_tax * 10")
_MARGIN_REG = 0.01


@query(
    f"""
    WITH t AS (SELECT {', '.join(f'({c})::DOUBLE AS x{j}' for j, c in enumerate(_MARGIN_FEATURES))},
                      ({_SPLIT_LABEL})::INTEGER AS y FROM lineitem),
    m AS (SELECT {', '.join(f'avg(x{j}) FILTER (y = {v}) AS m{v}{j}' for v in (0, 1) for j in range(3))} FROM t),
    s AS (SELECT {', '.join(f'4 * (m1{j} - m0{j}) AS w{j}' for j in range(3))},
                 -2 * ({' + '.join(f'(m1{j} - m0{j}) * (m1{j} + m0{j})' for j in range(3))}) AS b FROM m),
    d AS (SELECT t.*, s.*, 2 * y - 1 AS v, {' + '.join(f'x{j} * w{j}' for j in range(3))} + b AS margin FROM t, s),
    e AS (SELECT *, (v * margin <= 1)::INTEGER AS near FROM d),
    a AS (SELECT count(*)::DOUBLE AS n, sum(greatest(0, 1 - v * margin)) AS hinge,
                 {', '.join(f'sum(near * x{j}) FILTER (y = 1) AS p{j}, sum(near * x{j}) FILTER (y = 0) AS q{j}, any_value(w{j}) AS w{j}' for j in range(3))},
                 (sum(near) FILTER (y = 1))::DOUBLE AS p, (sum(near) FILTER (y = 0))::DOUBLE AS q FROM e),
    f AS (SELECT *, least(p, q) AS few, hinge / n AS loss,
                 hinge / n + {_MARGIN_REG} / 2 * ({' + '.join(f'w{j} * w{j}' for j in range(3))}) AS objective,
                 sqrt({' + '.join(f'({_MARGIN_REG} * w{j} - (p{j} - q{j}) / n) ** 2' for j in range(3))} + ((p - q) / n) ** 2) AS norm,
                 {' + '.join(f'((p{j} * least(p, q) / p - q{j} * least(p, q) / q) / n) ** 2' for j in range(3))} AS gained FROM a),
    h AS (SELECT *, least(1, 2 * few / n * {_MARGIN_REG} / gained) AS share FROM f)
    SELECT n::BIGINT AS n, round(loss, 6) AS loss, round(objective, 6) AS objective, round(norm, 6) AS norm,
           round(objective - (share * 2 * few / n - share * share * gained / (2 * {_MARGIN_REG})), 6) AS gap
    FROM h
    """
)
def margin_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread_items(spark, sf_dir).select(
        F.array(*[F.expr(c) for c in _MARGIN_FEATURES]).alias("features"),
        F.expr(_SPLIT_LABEL).cast("int").alias("label"),
    )
    means = rows.groupBy("label").agg(*[F.avg(F.get("features", F.lit(j))).alias(f"m{j}") for j in range(3)])
    low, high = ([row[f"m{j}"] for j in range(3)] for row in means.orderBy("label").collect())
    weights = [4 * (h - m) for h, m in zip(high, low)]
    offset = -2 * sum((h - m) * (h + m) for h, m in zip(high, low))
    found = hinge_certificate(rows, weights, offset, _MARGIN_REG)
    return found.select("n", *[r(c, c) for c in ("loss", "objective", "norm", "gap")])


# --- whole runs on the connection records ---------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str, features: int, algorithm: str, **params) -> DataFrame:
    """The run log without the seconds, which differ from run to run."""
    log = experiment.run(connections(spark, sf_dir), features, algorithm, params, ids=["conn_id"])
    return log.select(
        "algorithm", params_key(F.col("params")).alias("key"), "fold", "metric", r("value", "value")
    )


# The nearest train record of every held-out one, and the mean of both recalls.
_NEAREST_SQL = f"""{_prepare_sql(FEATURES_14)},
    n AS (
      SELECT q.conn_id, q.label AS y,
             min_by(t.label, ({" + ".join(f'(q."{c}" - t."{c}") ** 2' for c in FEATURES_14)}, t.conn_id)) AS p
      FROM p AS q, p AS t WHERE q.held AND NOT t.held GROUP BY q.conn_id, q.label)
    SELECT 'kNN' AS algorithm, 'k=1' AS key, 0::INTEGER AS fold, 'areaUnderROC' AS metric,
           round((avg(CASE WHEN y = 1 THEN p END) + avg(CASE WHEN y = 0 THEN 1 - p END)) / 2, 6) AS value
    FROM n
"""


@query()
def run_14_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 14, "binLR", tol=1e-3, maxIter=100)


@query(_NEAREST_SQL)
def run_14_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 14, "kNN", k=1)


@query(
    f"""
    SELECT count(*) AS queries, 10 * count(*) AS neighbors, true AS enough, true AS fewer
    FROM ({CONNECTION_SQL}) WHERE split_part(conn_id, '-', 1)::BIGINT % 40 = 0
    """
)
def knn_approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least nine of ten neighbours are found in a fifth of the buckets or less."""
    rows = _prepared(spark, sf_dir, 14).withColumn("features", vector_to_array("features"))
    rows = materialize(rows.select("conn_id", "features"), "points")
    apart = F.split("conn_id", "-")[0].cast("bigint") % 40 == 0
    train, asked = rows.where(~apart), rows.where(apart)
    share = 0.2
    options = {"query_id": "conn_id", "train_id": "conn_id"}
    found = knn_approximate(asked, train, 10, share=share, **options)
    measured = recall(found, knn_join(asked, train, 10, **options))
    return measured.select("queries", "neighbors", (F.col("recall") >= 0.9).alias("enough"), F.lit(share < 0.5).alias("fewer"))


_SEPARATE = "split_part(conn_id, '-', 1)::BIGINT % 40 = 0"


@query(_NEAREST_SQL.replace(_HELD, _SEPARATE))
def run_separate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run scored on a table of its own, prepared with what the train table taught."""
    every = connections(spark, sf_dir)
    apart = F.split("conn_id", "-")[0].cast("bigint") % 40 == 0
    log = experiment.run(
        every.where(~apart), 14, "kNN", {"k": 1}, ids=["conn_id"], test=every.where(apart)
    )
    return log.select(
        "algorithm", params_key(F.col("params")).alias("key"), "fold", "metric", r("value", "value")
    )


@query()
def run_16_linsvc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 16, "linSVC", tol=0.1, maxIter=10, regParam=1e-6)


@query()
def run_41_dtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 41, "DTree", maxDepth=23, maxBins=38)


@query()
def run_16_rforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 16, "RForest", maxDepth=10, maxBins=16, numTrees=10)


@query()
def search_14_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hold-out rounds over a tolerance grid on the records, ranked."""
    log = experiment.search(
        connections(spark, sf_dir),
        14,
        "binLR",
        ["conn_id"],
        models.param_grid(tol=[1.0, 1e-3], maxIter=[10, 100]),
        rounds=2,
    )
    return leaderboard(log, 5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, hash split, scaling fitted on the train part, logistic regression, ranking."""
    rows = table(spark, sf_dir, "embeddings")
    columns = [f"x{i}" for i in range(64)]
    rows = rows.select(
        "vec_id",
        coarse_label(F.col("label").cast("string"), normal="0").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)],
    )
    train, test = models.holdout(rows, "vec_id")
    scaler = MinMax(inputCols=columns).fit(train)

    def points(df: DataFrame) -> DataFrame:
        return scaler.transform(df).select(
            array_to_vector(F.array(*columns)).alias("features"), "label"
        )

    runs = []
    for params in models.param_grid(tol=[1e-3], maxIter=[10, 100]):
        _, log = models.fit_fixed("binLR", points(train), points(test), params)
        runs += log
    return leaderboard(models.run_log(spark, runs), 5, metric="areaUnderROC")
