"""Scans, projections, labels, profiles, encoding, scaling, splits, metrics, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.split import fold_of, in_holdout
from flowlens.operators import encode, lookup, metrics, project, ragged, scale, trim
from flowlens.operators.leaderboard import leaderboard, summarize_runs
from flowlens.operators.profile import numeric_columns, profile
from flowlens.queries import r, table
from flowlens.schema import FINE_LABELS
from flowlens.session import scratch_path
from flowlens.sources.tables import (
    read_attack_types,
    read_field_roles,
    NULL_TEXT,
    read_typed_csv,
    write_leaderboard,
    write_typed_csv,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- scans and projections ---------------------------------------------------------------


@query(
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    """
)
def scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer-csv")
    write_typed_csv(customer, path)
    return read_typed_csv(spark, path, customer.schema, null_text=NULL_TEXT)


@query(
    """
    SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN user_id END AS user_id, event_type,
           CASE WHEN event_id % 7 = 3 THEN concat(event_id, ',u', user_id, ',', event_type) END
             AS corrupt_record
    FROM events
    """
)
def scan_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in which every seventh row has a text where a number belongs."""
    events = table(spark, sf_dir, "events")
    user = F.concat(F.when(F.col("event_id") % 7 == 3, "u").otherwise(""), F.col("user_id"))
    path = scratch_path(spark, "events-csv")
    events.select(F.concat_ws(",", "event_id", user, "event_type")).write.text(path)
    schema = events.select("event_id", "user_id", "event_type").schema
    return read_typed_csv(spark, path, schema, mode="PERMISSIVE")


@query(
    """
    SELECT r_regionkey, n_nationkey, lower(r_name) AS category,
           CASE WHEN n_nationkey % 2 = 0 THEN 'continuous' ELSE 'symbolic' END AS kind
    FROM nation JOIN region ON n_regionkey = r_regionkey
    """
)
def scan_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and categories, and names and kinds, written to files and looked up there."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    categories, kinds = scratch_path(spark, "categories"), scratch_path(spark, "kinds")
    region.select(F.concat_ws(",", "r_name", F.lower("r_name"))).write.text(categories, lineSep="\r")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "continuous").otherwise("symbolic")
    nation.select(F.concat_ws(",", "n_name", kind)).write.text(kinds)
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lookup.map_labels(rows, "r_name", read_attack_types(spark, categories), "attack", "category")
    rows = lookup.map_labels(rows, "n_name", read_field_roles(spark, kinds), "name", "kind")
    return rows.select("r_regionkey", "n_nationkey", "category", "kind")


@query(
    """
    SELECT l_quantity AS quantity, l_discount AS discount, l_linestatus,
           CAST(l_linenumber AS DOUBLE) AS label
    FROM lineitem
    """
)
def feature_set_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kept = project.select_features(
        items, ["l_quantity", "l_discount", "l_linestatus", "l_shipdate"], "l_linenumber"
    )
    named = project.rename_columns(
        project.drop_columns(kept, "l_shipdate"),
        {"l_quantity": "quantity", "l_discount": "discount", "l_linenumber": "label"},
    )
    return project.cast_label(named)


# --- labels ---------------------------------------------------------------------------------


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label
    FROM events
    """
)
def label_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", L.coarse_label(F.col("event_type"), normal="view").alias("label")
    )


@query(
    """
    SELECT event_id,
           CASE WHEN starts_with(event_type, 'vi') THEN event_type ELSE 'attack' END AS collapsed,
           CASE WHEN starts_with(event_type, 'vi') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label
    FROM events
    """
)
def label_coarse_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        L.collapse_attacks(F.col("event_type"), normal="vi").alias("collapsed"),
        L.coarse_label(F.col("event_type"), normal="vi", match="prefix").alias("label"),
    )


# The dimension leaves out one event type on purpose.
EVENT_CLASSES = [("view", "normal"), ("click", "probe"), ("signup", "r2l"), ("error", "dos")]


@query(
    """
    SELECT e.event_id, e.event_type, coalesce(d.category, 'unknown') AS category
    FROM events e
    LEFT JOIN (VALUES ('view', 'normal'), ('click', 'probe'), ('signup', 'r2l'), ('error', 'dos'))
         AS d(attack, category) ON e.event_type = d.attack
    """
)
def label_join_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ", ".join(f"('{attack}', '{category}')" for attack, category in EVENT_CLASSES)
    classes = spark.sql(f"SELECT * FROM VALUES {pairs} AS d(attack, category)")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return lookup.map_labels(events, "event_type", classes, "attack", "category")


_NAMES = list(FINE_LABELS) + ["not_in_the_list"]
_FINE_VALUES = ", ".join(f"('{a}', '{c}')" for a, c in FINE_LABELS.items())
_NAME_LIST = ", ".join(f"'{n}'" for n in _NAMES)


@query(
    f"""
    WITH named AS (
      SELECT event_id, ([{_NAME_LIST}])[1 + CAST(event_id % {len(_NAMES)} AS INTEGER)] AS attack
      FROM events)
    SELECT n.event_id, n.attack, coalesce(d.category, 'unknown') AS category
    FROM named n LEFT JOIN (VALUES {_FINE_VALUES}) AS d(attack, category) USING (attack)
    """
)
def label_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    attack = F.element_at(F.lit(_NAMES), (F.col("event_id") % len(_NAMES)).cast("int") + 1)
    return (
        table(spark, sf_dir, "events")
        .select("event_id", attack.alias("attack"))
        .withColumn("category", L.fine_label(F.col("attack")))
    )


# --- profiles --------------------------------------------------------------------------------

_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    " UNION ALL ".join(
        f"""
        SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_values,
               round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
               round(max({c})::DOUBLE, 6) AS "max", round(min({c})::DOUBLE, 6) AS "min"
        FROM lineitem
        """
        for c in sorted(_PROFILED)
    )
)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    columns = numeric_columns(items, exclude=("l_orderkey", "l_partkey", "l_suppkey"))
    return profile(items, columns).select(
        "column",
        "n_rows",
        "n_values",
        r("mean", "mean"),
        r("stddev", "stddev"),
        r("max", "max"),
        r("min", "min"),
    )


# --- encoding --------------------------------------------------------------------------------


@query(
    """
    WITH levels AS (
      SELECT event_type, count(*) AS n,
             row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS idx
      FROM events GROUP BY event_type)
    SELECT e.event_id, e.event_type, l.idx::DOUBLE AS event_type_index
    FROM events e JOIN levels l USING (event_type)
    """
)
def index_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return encode.index_by_frequency(events, ["event_type"])


@query(
    """
    SELECT 'user_id' AS "column", user_id::VARCHAR AS level, count(*) AS n,
           row_number() OVER (ORDER BY count(*) DESC, user_id::VARCHAR) - 1 AS "index"
    FROM events GROUP BY user_id
    UNION ALL
    SELECT 'event_type' AS "column", event_type AS level, count(*) AS n,
           row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS "index"
    FROM events GROUP BY event_type
    """
)
def frequency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.frequency_levels(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(
    """
    WITH f AS (
      SELECT l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS idx
      FROM lineitem GROUP BY l_returnflag),
    s AS (
      SELECT l_linestatus, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) - 1 AS idx
      FROM lineitem GROUP BY l_linestatus)
    SELECT l_orderkey, l_linenumber, 'l_returnflag' AS "column", f.idx AS "index"
    FROM lineitem JOIN f USING (l_returnflag)
    UNION ALL
    SELECT l_orderkey, l_linenumber, 'l_linestatus' AS "column", s.idx AS "index"
    FROM lineitem JOIN s USING (l_linestatus)
    """
)
def onehot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.onehot_long(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        ["l_orderkey", "l_linenumber"],
    )


@query(
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS "l_returnflag=A",
           CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag=N",
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag=R",
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS "l_linestatus=F",
           CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS "l_linestatus=O"
    FROM lineitem
    """
)
def onehot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    return encode.onehot_wide(items, ["l_returnflag", "l_linestatus"])


# --- scaling ---------------------------------------------------------------------------------

_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    """
    WITH m AS (
      SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) e0,
             max(l_extendedprice) e1, min(l_discount) d0, max(l_discount) d1
      FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           round(CASE WHEN q1 > q0 THEN (l_quantity - q0) / (q1 - q0) ELSE 0 END, 6) AS l_quantity,
           round(CASE WHEN e1 > e0 THEN (l_extendedprice - e0) / (e1 - e0) ELSE 0 END, 6)
             AS l_extendedprice,
           round(CASE WHEN d1 > d0 THEN (l_discount - d0) / (d1 - d0) ELSE 0 END, 6) AS l_discount,
           0.0::DOUBLE AS constant
    FROM lineitem, m
    """
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *_SCALED, F.lit(7.0).alias("constant")
    )
    out = scale.scale_minmax(items, [*_SCALED, "constant"])
    return out.select(
        "l_orderkey", "l_linenumber", *[r(c, c) for c in _SCALED], "constant"
    )


@query(
    """
    WITH h AS (
      SELECT event_id, user_id, value,
             ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT % 100 < 33 AS held
      FROM events),
    m AS (
      SELECT min(value) v0, max(value) v1, min(user_id) u0, max(user_id) u1
      FROM h WHERE NOT held)
    SELECT event_id, held, round((value - v0) / (v1 - v0), 6) AS value,
           round((user_id - u0)::DOUBLE / (u1 - u0), 6) AS user_id
    FROM h, m
    """
)
def minmax_train_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", in_holdout(F.col("event_id")).alias("held")
    )
    out = scale.scale_minmax(events, ["value", "user_id"], fit_on=events.where(~F.col("held")))
    return out.select("event_id", "held", r("value", "value"), r("user_id", "user_id"))


@query(
    """
    WITH v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL
                                     WHEN event_id % 5 = 1 THEN NULL ELSE value END AS value,
                      CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id FROM events),
    b AS (SELECT min(value) AS lo, max(value) AS hi, min(user_id) AS ulo, max(user_id) AS uhi FROM v)
    SELECT event_id, round(coalesce((value - lo) / (hi - lo), 0), 6) AS value,
           round(coalesce((user_id - ulo) / (uhi - ulo), 0), 6) AS user_id
    FROM v, b
    """
)
def minmax_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing numbers and NaN take no part in the ranges and become 0."""
    part = F.col("event_id") % 5
    value = F.when(part == 1, F.lit(float("nan"))).when(part != 0, F.col("value"))
    user = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", value.alias("value"), user.alias("user_id")
    )
    out = scale.scale_minmax(rows, ["value", "user_id"])
    return out.select("event_id", r("value", "value"), r("user_id", "user_id"))


@query(
    """
    SELECT 'features' AS part, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS total
    FROM lineitem GROUP BY l_linenumber
    UNION ALL
    SELECT 'label', NULL, count(*), round(sum(l_discount), 2) FROM lineitem
    """
)
def features_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label column taken off, and sums over both parts."""
    items = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_discount")
    features, label = project.split_features_label(items, "l_discount")
    sums = features.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total")
    )
    return sums.select(F.lit("features").alias("part"), "l_linenumber", "n", "total").unionByName(
        label.agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 2).alias("total")).select(
            F.lit("label").alias("part"),
            F.lit(None).cast(features.schema["l_linenumber"].dataType).alias("l_linenumber"),
            "n", "total",
        )
    )


# --- trimming --------------------------------------------------------------------------------


@query(
    """
    WITH k AS (SELECT CAST(round(count(*) / 1000.0) AS BIGINT) AS k FROM orders),
    ranked AS (
      SELECT o_orderkey, o_totalprice,
             row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS high,
             row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS low
      FROM orders)
    SELECT o_orderkey, o_totalprice FROM ranked, k WHERE high > k AND low > k
    """
)
def trim_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return trim.trim_extremes(orders, ["o_totalprice"], "o_orderkey")


@query(
    """
    WITH k AS (SELECT CAST(round(count(*) / 50.0) AS BIGINT) AS k FROM events),
    first_pass AS (
      SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS high,
             row_number() OVER (ORDER BY value, event_id) AS low
      FROM events),
    kept AS (
      SELECT event_id, value, user_id FROM first_pass, k WHERE high > k AND low > k),
    second_pass AS (
      SELECT *, row_number() OVER (ORDER BY user_id DESC, event_id) AS high,
             row_number() OVER (ORDER BY user_id, event_id) AS low
      FROM kept)
    SELECT event_id, value, user_id FROM second_pass, k WHERE high > k AND low > k
    """
)
def trim_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    # Few sorted rows, so that the counting search runs at this size as well.
    return trim.trim_extremes(
        events, ["value", "user_id"], "event_id", per_mille=20.0, range_rows=1_000
    )


@query(
    """
    WITH k AS (SELECT CAST(round(count(*) / 100.0) AS BIGINT) AS k FROM orders),
    wide AS (SELECT md5(o_orderkey::VARCHAR) AS id, 9007199254740992 + o_custkey AS big FROM orders),
    ranked AS (
      SELECT id, big, row_number() OVER (ORDER BY big DESC, id) AS high,
             row_number() OVER (ORDER BY big, id) AS low
      FROM wide)
    SELECT id, big FROM ranked, k WHERE high > k AND low > k
    """
)
def trim_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers beyond what doubles can tell apart, and a text key."""
    wide = table(spark, sf_dir, "orders").select(
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("id"),
        (F.lit(2**53) + F.col("o_custkey")).alias("big"),
    )
    return trim.trim_extremes(wide, ["big"], "id", per_mille=10.0)


@query(
    """
    SELECT o.o_orderkey, o.o_custkey FROM orders o
    WHERE NOT EXISTS (
      SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey
        AND (c.c_acctbal < 0 OR c.c_mktsegment = 'MACHINERY'))
    """
)
def drop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    ids = lookup.union_ids(
        customer.where("c_acctbal < 0").select("o_custkey"),
        customer.where("c_mktsegment = 'MACHINERY'").select("o_custkey"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup.drop_ids(orders, ids, "o_custkey")


@query(
    """
    SELECT event_id, value, NULL::VARCHAR AS props, NULL::BIGINT AS user_id
    FROM events WHERE event_type = 'view'
    UNION ALL BY NAME
    SELECT event_id, props FROM events WHERE event_type = 'purchase'
    UNION ALL BY NAME
    SELECT event_id, user_id, value FROM events WHERE event_type = 'error'
    """
)
def union_ragged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")

    def of(kind: str, *columns: str) -> DataFrame:
        return events.where(F.col("event_type") == kind).select(*columns)

    return ragged.union_ragged(
        of("view", "event_id", "value"),
        of("purchase", "event_id", "props"),
        of("error", "event_id", "user_id", "value"),
    )


# --- splits ----------------------------------------------------------------------------------


@query(
    """
    SELECT event_id,
           ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT % 100 < 33 AS held
    FROM events
    """
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", in_holdout(F.col("event_id"), percent=33, seed=7).alias("held")
    )


@query(
    """
    SELECT event_id,
           (('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT % 3)::INTEGER AS fold
    FROM events
    """
)
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", fold_of(F.col("event_id"), folds=3, seed=7).alias("fold")
    )


# --- metrics ---------------------------------------------------------------------------------

_COUNTS = """
    WITH c AS (
      SELECT count(*) FILTER (toxic = 0 AND quality = 1)::DOUBLE tp,
             count(*) FILTER (toxic = 0 AND quality = 0)::DOUBLE fp,
             count(*) FILTER (toxic = 1 AND quality = 0)::DOUBLE tn,
             count(*) FILTER (toxic = 1 AND quality = 1)::DOUBLE fn
      FROM labels)
"""


def _label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        (1 - F.col("toxic")).cast("double").alias("prediction"),
        F.col("quality").cast("double").alias("label"),
    )


@query(_COUNTS + "SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c")
def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_predictions(spark, sf_dir).agg(
        r(metrics.accuracy_of(F.col("prediction"), F.col("label")), "accuracy")
    )


@query(_COUNTS + "SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auroc_hard FROM c")
def metric_auroc_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hard_metrics(_label_predictions(spark, sf_dir)).select(
        r("auroc_hard", "auroc_hard")
    )


@query(
    _COUNTS
    + """
    , p AS (SELECT tp / (tp + fn) AS rec, tp / (tp + fp) AS prec,
                   (tp + fn) / (tp + fp + tn + fn) AS share FROM c)
    SELECT round(rec * prec + (1 - rec) * (prec + share) / 2, 6) AS aupr_hard FROM p
    """
)
def metric_aupr_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hard_metrics(_label_predictions(spark, sf_dir)).select(
        r("aupr_hard", "aupr_hard")
    )


@query(
    """
    SELECT d.lang, count(*) FILTER (l.toxic = 0 AND l.quality = 1) AS tp,
           count(*) FILTER (l.toxic = 0 AND l.quality = 0) AS fp,
           count(*) FILTER (l.toxic = 1 AND l.quality = 0) AS tn,
           count(*) FILTER (l.toxic = 1 AND l.quality = 1) AS fn
    FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang
    """
)
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"
    )
    rows = joined.select(
        "lang", (1 - F.col("toxic")).alias("prediction"), F.col("quality").alias("label")
    )
    return metrics.confusion(rows, by=("lang",))


# --- run log and leaderboard ------------------------------------------------------------------

_SUMMARY = """
    SELECT event_type AS algorithm, 'k=' || (props->>'k') AS key, 'value' AS metric,
           avg(value) AS mean, stddev_pop(value) AS std,
           avg(user_id::DOUBLE) AS mean_seconds, stddev_pop(user_id::DOUBLE) AS std_seconds,
           count(*) AS runs
    FROM events GROUP BY ALL
"""
_ROUNDED = """
    SELECT algorithm, key, metric, round(mean, 6) AS mean, round(std, 6) AS std,
           round(mean_seconds, 6) AS mean_seconds, round(std_seconds, 6) AS std_seconds, runs
"""


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("algorithm"),
        F.from_json("props", "map<string,string>").alias("params"),
        F.lit(0).alias("fold"),
        F.lit("value").alias("metric"),
        "value",
        F.col("user_id").cast("double").alias("seconds"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "algorithm",
        "key",
        "metric",
        *[r(c, c) for c in ("mean", "std", "mean_seconds", "std_seconds")],
        "runs",
    )


@query(f"{_ROUNDED} FROM ({_SUMMARY})")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summarize_runs(_event_runs(spark, sf_dir)))


@query(
    f"{_ROUNDED} FROM ({_SUMMARY}) AS s"
    " ORDER BY s.mean DESC, s.std, s.algorithm, s.key LIMIT 5"
)
def leaderboard_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "leaderboard")
    write_leaderboard(leaderboard(_event_runs(spark, sf_dir), 5), path)
    return _rounded(spark.read.parquet(path))
