"""Sources, schema, labels, encoding, scaling, trimming and joins on small inputs."""

from __future__ import annotations

import math
import re
from types import SimpleNamespace

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from flowlens import schema
from flowlens.functions import labels as L
from flowlens.functions.split import fold_of, in_holdout
from flowlens.operators import encode, lookup, metrics, profile, project, ragged, scale, trim
from flowlens.operators.leaderboard import RUN_LOG_SCHEMA, leaderboard, params_key, summarize_runs
from flowlens.queries import learning
from flowlens.session import scratch_path, scratch_root
from flowlens.sources import synthetic, tables


def record(service="http", flag="SF", label="normal", **numbers) -> str:
    cells = []
    for name, role in schema.ROLES.items():
        if role == "nominal":
            cells.append({"protocol_type": "tcp", "service": service, "flag": flag}[name])
        else:
            value = numbers.get(name, 0)
            cells.append("" if value is None else str(value))
    return ",".join([*cells, label, "21"])


@pytest.fixture(scope="module")
def records_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "records.csv"
    lines = [
        record("http", src_bytes=10, count=1),
        record("http", src_bytes=20, count=3, label="neptune"),
        record("smtp", src_bytes=30, count=5, label="satan", flag="S0"),
        record("smtp", src_bytes=None, count=7, label="guess_passwd", flag="REJ"),
        record("ftp", src_bytes=50, count=9, label="rootkit"),
        record("ftp", src_bytes=60, count=11, label="normal_looking"),
        record("dns", src_bytes=70, count=13, label="never_seen"),
    ]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def records(spark, records_file):
    return tables.read_connections(spark, records_file)


# --- schema ----------------------------------------------------------------------------


def test_feature_sets_and_roles():
    assert len(schema.FEATURES) == 41 and len(schema.CONNECTION_SCHEMA) == 43
    assert [len(schema.feature_columns(n)) for n in (14, 16, 41)] == [14, 16, 41]
    roles = [
        len(schema.columns_with_role(schema.FEATURES, r)) for r in ("nominal", "binary", "numeric")
    ]
    assert roles == [3, 6, 32]
    names = list(schema.FEATURES)
    assert [names.index(c) for c in schema.columns_with_role(names, "binary")] == [
        6, 11, 13, 14, 20, 21,
    ]
    with pytest.raises(ValueError):
        schema.feature_columns(15)


def test_attack_dictionary():
    sizes = {c: len(n.split()) for c, n in schema.ATTACKS_BY_CATEGORY.items()}
    assert sizes == {"DoS": 10, "Probe": 6, "R2L": 15, "U2R": 8}
    assert len(schema.FINE_LABELS) == 40


# --- sources ---------------------------------------------------------------------------


def test_records_are_typed(records):
    assert records.count() == 7
    assert dict(records.dtypes)["src_bytes"] == "double"
    assert records.where("src_bytes is null").count() == 1


def test_malformed_row_stops_the_scan(spark, tmp_path, records_file):
    bad = tmp_path / "bad.csv"
    bad.write_text(record() + "\n" + record().rsplit(",", 1)[0] + "\n")
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_connections(spark, str(bad)).collect()
    kept = tables.read_connections(spark, str(bad), mode="PERMISSIVE").collect()
    assert [row[tables.CORRUPT] is not None for row in kept] == [False, True]


def test_dictionaries(spark, tmp_path):
    types = tmp_path / "types.csv"
    types.write_bytes(b"back,dos\rperl,u2r\rnormal,normal\runknown,unknown")
    assert [tuple(r) for r in tables.read_attack_types(spark, str(types)).collect()] == [
        ("back", "dos"), ("perl", "u2r"), ("normal", "normal"), ("unknown", "unknown"),
    ]
    fields = tmp_path / "fields.csv"
    fields.write_text("duration,continuous\nservice,symbolic\n")
    assert tables.read_field_roles(spark, str(fields)).count() == 2


def test_points_skip_blank_lines_and_keep_the_last_row(spark, tmp_path):
    path = tmp_path / "points.dat"
    path.write_text("5.1,3.5,1.4,0.2,a\n4.9,3.0,1.4,0.2,b\n\n")
    rows = tables.read_points(spark, str(path), 4).collect()
    assert [r["class"] for r in rows] == ["a", "b"] and rows[0]["f1"] == 5.1
    path.write_text("5.1,3.5,1.4,0.2,a\n4.9,3.0,1.4,0.2,b")
    assert tables.read_points(spark, str(path), 4).count() == 2


def test_named_columns(spark, tmp_path):
    path = tmp_path / "named.csv"
    path.write_text("6,148,1\n1,85,0\n")
    df = tables.read_named(spark, str(path), ["preg", "plas", "class"], "class")
    assert df.dtypes == [("preg", "double"), ("plas", "double"), ("class", "int")]
    assert df.count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.1), (2, "", None), (3, None, -1e-9)], "i int, s string, d double")
    path = str(tmp_path / "out")
    tables.write_typed_csv(df, path)
    back = tables.read_typed_csv(spark, path, df.schema, null_text=tables.NULL_TEXT)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("master", ["local[4]", "spark://host:7077", "yarn"])
def test_only_a_local_session_may_lack_the_shared_folder(master):
    class Unset:
        conf = {}
        sparkContext = SimpleNamespace(master=master)

    if master.startswith("local"):
        assert scratch_root(Unset()) == scratch_root(Unset())
    else:
        with pytest.raises(RuntimeError):
            scratch_root(Unset())


def test_blobs_do_not_depend_on_partitioning(spark):
    a = synthetic.blobs(spark, 500, seed=3)
    assert sorted(a.collect()) == sorted(synthetic.blobs(spark, 500, seed=3).repartition(3).collect())
    stats = a.groupBy("y").agg(F.stddev("x1").alias("s"), F.count("*").alias("n")).collect()
    assert [r["n"] for r in stats] == [250, 250]
    assert all(0.8 < r["s"] < 1.2 for r in stats)


# --- projection and labels -----------------------------------------------------------------


def test_projection(records):
    assert project.select_features(records, 14, "labels").columns == [*schema.FEATURES_14, "labels"]
    features, label = project.split_features_label(records, "labels")
    assert len(features.columns) == 42 and label.columns == ["labels"]
    assert profile.shape(records) == (7, 43)


def test_coarse_labels(spark):
    df = spark.createDataFrame([("normal",), ("normal_looking",), ("satan",), (None,)], "l string")
    out = df.select(
        L.coarse_label(F.col("l")), L.coarse_label(F.col("l"), match="prefix"),
        L.collapse_attacks(F.col("l")),
    ).collect()
    assert [tuple(r) for r in out] == [
        (0.0, 0.0, "normal"), (1.0, 0.0, "normal_looking"), (1.0, 1.0, "attack"), (None, None, None),
    ]


def test_fine_labels_and_unseen(spark):
    df = spark.createDataFrame([("smurf",), ("ps",), ("zzz",), (None,)], "l string")
    assert [r[0] for r in df.select(L.fine_label(F.col("l"))).collect()] == [
        "DoS", "U2R", "unknown", "unknown",
    ]
    with pytest.raises(PySparkException):
        df.select(L.fine_label(F.col("l"), unseen="error")).collect()


@pytest.mark.parametrize("limit", [100, 1])
def test_lookup_keeps_every_row(spark, limit, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(lookup.fits_broadcast, "__defaults__", (limit, 1 << 20))
    dim = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, None)], "id int, l string")
    out = lookup.map_labels(df, "l", dim, "k", "v")
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [
        (1, "x"), (2, "x"), (3, "unknown"), (4, "unknown"),
    ]
    hint = "ResolvedHint" in out._jdf.queryExecution().analyzed().toString()
    assert hint == (limit == 100)
    with pytest.raises(PySparkException):
        lookup.map_labels(df, "l", dim, "k", "v", unseen="error").collect()


# --- encoding ------------------------------------------------------------------------------


def test_frequency_index_breaks_ties_alphabetically(records):
    levels = {r["level"]: r["index"] for r in encode.frequency_levels(records, ["service"]).collect()}
    assert levels == {"ftp": 0, "http": 1, "smtp": 2, "dns": 3}


def test_numbering_in_parts_equals_numbering_in_one(spark):
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("n"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("c")
    )
    order = [F.desc("c"), F.asc("n")]
    one = encode.number_rows(df, order).collect()
    many = encode.number_rows(df, order, task_rows=700).collect()
    assert sorted(one) == sorted(many)


def test_level_numbers_do_not_depend_on_the_split_into_tasks(spark, records):
    columns = ["service", "flag", "labels"]
    one = encode.frequency_levels(records, columns).collect()
    assert sorted(one) == sorted(encode.frequency_levels(records, columns, task_rows=3).collect())


def test_one_hot_forms(spark, records):
    wide = encode.onehot_wide(records.select("service", "flag"), ["service", "flag"])
    assert wide.columns == [
        "service=dns", "service=ftp", "service=http", "service=smtp",
        "flag=REJ", "flag=S0", "flag=SF",
    ]
    assert all(sum(r) == 2 for r in wide.collect())
    with pytest.raises(ValueError):
        encode.onehot_wide(records, ["service"], max_levels=2)
    long = encode.onehot_long(records, ["service", "flag"], ["count"])
    assert long.count() == 14
    some = encode.onehot_long(records, ["flag"], ["count"], fit_on=records.where("flag = 'SF'"))
    assert some.count() == 5


# --- profile and scaling ---------------------------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "a double, b int")
    rows = {r["column"]: r for r in profile.profile(df, profile.numeric_columns(df)).collect()}
    assert (rows["a"]["mean"], rows["a"]["min"], rows["a"]["max"]) == (2.0, 1.0, 3.0)
    assert rows["a"]["stddev"] == pytest.approx(math.sqrt(2)) and rows["b"]["stddev"] == 0.0


def test_ranges_take_one_job(spark, records):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranges", "ranges")
    numeric = schema.columns_with_role(schema.FEATURES, "numeric")
    ranges = profile.min_max(records, numeric)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ranges["src_bytes"] == (10.0, 70.0) and ranges["num_outbound_cmds"] == (0.0, 0.0)
    assert len(tracker.getJobIdsForGroup("ranges")) <= 2


def test_scaling_rules(spark):
    df = spark.createDataFrame(
        [(0.0, 4.0, None), (5.0, 4.0, 1.0), (10.0, 4.0, float("nan"))], "a double, b double, c double"
    )
    assert [tuple(r) for r in scale.scale_minmax(df, ["a", "b"]).select("a", "b").collect()] == [
        (0.0, 0.0), (0.5, 0.0), (1.0, 0.0),
    ]
    kept = scale.scale_minmax(df, ["b"], constant="keep")
    assert {r["b"] for r in kept.collect()} == {4.0}
    filled = scale.scale_minmax(df, ["c"])
    assert [r["c"] for r in filled.collect()] == [0.0, 0.0, 0.0]
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_scaling_learns_from_the_train_part_only(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    test = spark.createDataFrame([(20.0,), (-5.0,)], "a double")
    assert [r["a"] for r in scale.scale_minmax(test, ["a"], fit_on=train).collect()] == [2.0, -0.5]


def test_scaling_of_many_columns(spark):
    names = [f"c{i}" for i in range(12)]
    rows = [(i, *[None if j == i else float("nan") if j == i + 1 else float(i * j) for j in range(12)]) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names))
    wide = scale.MinMax(inputCols=names).fit(df).transform(df)
    assert wide.columns == df.columns
    each = df
    for begin in range(0, 12, 4):  # few columns are scaled one by one
        each = scale.scale_minmax(each, names[begin : begin + 4])
    assert sorted(wide.collect()) == sorted(each.collect())
    kept = scale.MinMax(inputCols=names, fillNull=False).fit(df).transform(df)
    assert [r["c3"] for r in kept.orderBy("id").collect()] == [0.0, 0.25, None, None, 1.0]


def test_prepared_rows_compile_to_short_methods(spark, capsys):
    """The virtual machine optimizes no method of more than 8,000 bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = learning.prepare_41(spark, f"{oracle.TESTDATA}/sf0.001")
        capsys.readouterr()
        rows.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


# --- trimming --------------------------------------------------------------------------------


def brute_trim(rows, count, columns):
    for c in columns:
        valued = [r for r in rows if r[c] is not None and not math.isnan(r[c])]
        low = sorted(valued, key=lambda r: (r[c], r[0]))[:count]
        high = sorted(valued, key=lambda r: (-r[c], r[0]))[:count]
        gone = {r[0] for r in low} | {r[0] for r in high}
        rows = [r for r in rows if r[0] not in gone]
    return {r[0] for r in rows}


@pytest.mark.parametrize("range_rows", [1, 7, 100_000])
def test_trim_equals_brute_force_with_a_hot_value(spark, range_rows):
    rows = [
        (i, 7.0 if i % 3 == 0 else float((i * 37) % 101) ** 3, None if i % 50 == 1 else float(i % 11))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id bigint, v double, w double")
    out = trim.trim_extremes(df, ["v", "w"], "id", per_mille=35, range_rows=range_rows)
    assert {r["id"] for r in out.collect()} == brute_trim(rows, 21, [1, 2])


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.integers(-5, 5) | st.floats(-1e12, 1e12), min_size=3, max_size=40),
    st.integers(1, 400),
)
def test_trim_property(spark, values, per_mille):
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    out = trim.trim_extremes(df, ["v"], "id", per_mille=per_mille, range_rows=3)
    count = int(len(rows) * per_mille / 1000 + 0.5)
    assert {r["id"] for r in out.collect()} == brute_trim(rows, count, [1])


@pytest.mark.parametrize("range_rows", [2, 100_000])
def test_trim_compares_in_the_own_type(spark, range_rows):
    """Text keys, infinities, NaN and integers that doubles cannot tell apart."""
    big = 2**53
    rows = [(f"k{i}", big + i % 4, v) for i, v in enumerate([math.inf, -math.inf, 1.0, 2.0, math.inf, None, math.nan, 2.0])]
    df = spark.createDataFrame(rows, "id string, b bigint, v double")
    left = trim.trim_extremes(df, ["b"], "id", per_mille=250, range_rows=range_rows)
    assert {r["id"] for r in left.collect()} == {"k1", "k2", "k5", "k6"}
    left = trim.trim_extremes(df, ["v"], "id", per_mille=250, range_rows=range_rows)
    assert {r["id"] for r in left.collect()} == {"k3", "k5", "k6", "k7"}
    assert trim.trim_extremes(df.limit(0), ["v"], "id").count() == 0


def test_lookup_is_the_same_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("x", 4), (None, 5)], "l string, i int")
    dim = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    small = sorted(map(tuple, lookup.map_labels(df, "l", dim, "k", "v").collect()), key=str)
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *a, **b: False)
    assert sorted(map(tuple, lookup.map_labels(df, "l", dim, "k", "v").collect()), key=str) == small


def test_csv_keeps_or_refuses_texts(spark, tmp_path):
    texts = [" pad ", "", None, 'a "quoted", text', "tab\t", "'", "\\", "ü"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tables.write_typed_csv(df, str(tmp_path / "a"))
    back = tables.read_typed_csv(spark, str(tmp_path / "a"), df.schema, null_text=tables.NULL_TEXT)
    assert [r["t"] for r in back.orderBy("i").collect()] == texts
    for k, bad in enumerate(["a\nb", "a\rb", tables.NULL_TEXT]):
        with pytest.raises(Exception, match="does not keep"):
            tables.write_typed_csv(spark.createDataFrame([(1, bad)], df.schema), str(tmp_path / f"b{k}"))


def test_ragged_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 0.5)], "id int, b double")
    assert [tuple(r) for r in ragged.union_ragged(a, b).orderBy("id").collect()] == [
        (1, "x", None), (2, None, 0.5),
    ]


# --- splits, metrics, ranking ----------------------------------------------------------------


def test_split_is_a_stable_partition(spark):
    df = spark.range(3000)
    held = df.where(in_holdout(F.col("id")))
    rest = df.where(~in_holdout(F.col("id")))
    assert held.count() + rest.count() == 3000
    assert 0.28 < held.count() / 3000 < 0.38
    again = df.repartition(7).where(in_holdout(F.col("id")))
    assert sorted(held.collect()) == sorted(again.collect())
    other = df.where(in_holdout(F.col("id"), seed=8))
    assert sorted(other.collect()) != sorted(held.collect())
    folds = df.groupBy(fold_of(F.col("id")).alias("f")).count().collect()
    assert {r["f"] for r in folds} == {0, 1, 2}


def test_hard_metrics_equal_the_evaluators(spark):
    rows = [(float(i % 3 == 0), float(i % 2)) for i in range(37)]
    df = spark.createDataFrame(rows, "prediction double, label double")
    ours = metrics.hard_metrics(df).first()
    for metric, column in (("areaUnderROC", "auroc_hard"), ("areaUnderPR", "aupr_hard")):
        theirs = BinaryClassificationEvaluator(
            rawPredictionCol="prediction", metricName=metric
        ).evaluate(df)
        assert ours[column] == pytest.approx(theirs, abs=1e-12)
    assert ours["accuracy"] == pytest.approx(sum(p == y for p, y in rows) / 37)


def test_hand_checked_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "b")], "p string, y string")
    value = df.agg(metrics.accuracy_of(F.col("p"), F.col("y")) * 100).first()[0]
    assert round(value, 2) == 66.67


def test_leaderboard(spark):
    log = []
    for key, values in (("1", (0.9, 0.8, 0.7)), ("2", (0.8, 0.8, 0.8)), ("3", (0.5, 0.6, 0.7)),
                        ("4", (0.1, 0.2, 0.3)), ("5", (0.95, 0.95, 0.95)), ("6", (0.0, 0.0, 0.0))):
        for fold, value in enumerate(values):
            log.append(("x", {"tol": key, "maxIter": "10"}, fold, "accuracy", value, float(fold)))
    df = spark.createDataFrame(log, RUN_LOG_SCHEMA)
    top = leaderboard(df).collect()
    assert [r["key"] for r in top] == [f"maxIter=10:tol={k}" for k in "52134"]
    assert top[2]["std"] == pytest.approx(math.sqrt(2 / 300)) and top[0]["runs"] == 3
    assert len(leaderboard(df, 50).collect()) == 6
    assert summarize_runs(df).count() == 6
    assert df.select(params_key(F.col("params"))).first()[0] == "maxIter=10:tol=1"
