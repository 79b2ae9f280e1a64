"""Edge cases on literal tables: nulls, ties, constants, empty input."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalar as fn
from tallyframe.functions import tails
from tallyframe.operators import (
    aggregate, clean, cluster, encode, group, impute, model, outliers, scale, select, spatial,
)
from tallyframe.sources import schemas


STATUSES = ("open", "packed", "void")


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        (4, "n1", ["p", "q"], 12, "packed"), (6, "n2", ["r"], 55, "void"), (11, "n3", [], 55, "open"),
        (30, "n4", ["s"], 41, "packed"),
    ]
    return spark.createDataFrame(rows, schemas.ORDERS)


def values(spark, *numbers):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(numbers)], "id int, v double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("id").collect()]


# --- orders ----------------------------------------------------------------

def test_order_reports(orders):
    finished = F.col("status") == "packed"
    assert aggregate.conditional_sum(orders, finished, "total").first()[0] == 53
    assert aggregate.conditional_sum(orders, F.col("status") == "?", "total").first()[0] == 0
    assert aggregate.maximum(orders, "total", floor=0).first()[0] == 55
    assert aggregate.maximum(orders.where("false"), "total", floor=0).first()[0] == 0
    assert aggregate.row_of_max(orders, "total", "id").first()["id"] == 6  # first of the tie
    assert aggregate.row_of_min(orders, "total", "id").first()["items"] == ["p", "q"]
    assert [r["id"] for r in select.sort_desc(orders, "total", "id").collect()] == [6, 11, 30, 4]


def test_status_updates(spark, orders):
    updated, row = clean.update_status_by_id(orders, 11, "void", STATUSES)
    assert row.first()["status"] == "void" and updated.where("status = 'void'").count() == 2
    assert clean.update_status_by_id(orders, 999, "void", STATUSES)[1].count() == 0
    with pytest.raises(ValueError):
        clean.update_status_by_id(orders, 11, "lost", STATUSES)
    batch = spark.createDataFrame([(4, "open"), (30, "void")], "id int, status string")
    got = {r["id"]: r["status"] for r in clean.update_statuses(orders, batch, STATUSES).collect()}
    assert got == {4: "open", 6: "void", 11: "open", 30: "void"}
    for rows, message in (([(4, "lost")], "unknown status"), ([(4, "open"), (4, "void")], "two updates")):
        with pytest.raises(Exception, match=message):
            clean.update_statuses(orders, spark.createDataFrame(rows, "id int, status string"), STATUSES).collect()


def test_append_order(orders):
    longer, row = clean.append_order(orders, [5, "n5", ["t"], 1, "open"])
    assert longer.count() == 5 and row.first()["items"] == ["t"]
    with pytest.raises(ValueError):
        clean.append_order(orders, [5, "n5"])
    with pytest.raises(TypeError):
        clean.append_order(orders, "5")


def test_extremes_of_any_type(spark, orders):
    assert aggregate.row_of_max(orders, "status", "id").first()["id"] == 6
    assert aggregate.row_of_min(orders, "customer", "id").first()["id"] == 4
    timed = orders.withColumn("at", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(id % 11)"))
    assert aggregate.row_of_max(timed, "at", "id").first()["id"] == 30
    assert aggregate.row_of_max(orders.where("false"), "status", "id").count() == 0


def test_positions_from_both_ends(orders):
    assert sorted(r["id"] for r in select.rows_at(orders, "id", [-1, 0]).collect()) == [4, 30]
    with pytest.raises(IndexError):
        select.rows_at(orders, "id", [4])


def test_confusion_has_a_row_for_every_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "a int, p int")
    got = {tuple(r) for r in model.confusion_matrix(rows, "a", "p", [0, 1]).collect()}
    assert got == {(0, 1, 2), (1, 0, 0)}


def test_nothing_to_cluster(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(20)], "id int, a double, b double")
    with pytest.raises(ValueError, match="nothing to cluster"):
        cluster.cluster_assign(same, ["a", "b"], k_max=3)


# --- aggregates ------------------------------------------------------------

def test_nothing_to_aggregate(spark):
    empty = values(spark).where("false")
    assert aggregate.total(empty, "v").first()[0] == 0
    assert aggregate.any_match(empty, F.col("v") > 0).first()[0] is False
    assert aggregate.mode(empty, "v").first()[0] is None
    assert aggregate.describe(empty, ["v"]).first()["count"] == 0
    assert aggregate.histogram(empty, "v").count() == 0
    assert aggregate.density_curve(empty, "v").count() == 0
    assert aggregate.null_profile(empty).first()["null_percent"] is None
    assert outliers.outlier_summary(empty, "v").count() <= 1
    assert aggregate.boxplot_stats(empty, "v").count() == 0
    assert spatial.grid_density(empty, "v", "v").count() == 0


def test_one_row_and_constants(spark):
    one = values(spark, 3)
    assert aggregate.spread(one, "v").first()[0] is None
    assert aggregate.describe(one, ["v"]).first()["std"] is None
    flat = values(spark, 2, 2, 2)
    assert [(r["bin"], r["n"]) for r in aggregate.histogram(flat, "v", 10).orderBy("bin").collect()] == [(i, 3 * (i == 5)) for i in range(10)]
    assert column(scale.scale_standard(flat, ["v"])) == [0, 0, 0]
    assert column(scale.scale_minmax(flat, ["v"])) == [0, 0, 0]
    assert column(scale.scale_robust(flat, ["v"])) == [0, 0, 0]
    assert spatial.grid_density(flat, "v", "v").count() == 0


def test_nulls_stay_null_in_treatments(spark):
    df = values(spark, 1, 2, None, 3, 4, 100)
    low, high = outliers.fit_bounds(df, "v")
    assert (low, high) == (-1.0, 7.0)
    assert column(outliers.cap_outliers(df, "v")) == [1, 2, None, 3, 4, 7]
    assert column(outliers.replace_outliers_mean(df, "v")) == [1, 2, None, 3, 4, 2.5]
    assert column(outliers.replace_outliers_median(df, "v")) == [1, 2, None, 3, 4, 3]
    assert column(outliers.replace_outliers_percentile(df, "v")) == pytest.approx([1, 2, None, 3, 4, 61.6])
    assert [r["v"] for r in outliers.top_outliers(df, "v").collect()] == [100]
    got = outliers.outlier_summary(df, "v").first()
    assert (got["n_outliers"], got["outlier_percent"], got["min_outlier"]) == (1, 20.0, 100.0)


def test_scalers(spark):
    df = values(spark, 1, 2, 3, None)
    got = column(scale.scale_columns(df, ["v"], "standard")[0])
    assert got == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5), None])
    assert column(scale.scale_columns(df, ["v"], "minmax")[0]) == [0, 0.5, 1, None]
    assert column(scale.scale_columns(values(spark, -1, 0, 3), ["v"], "log")[0]) == pytest.approx(
        [math.log(1), math.log(2), math.log(5)]
    )
    with pytest.raises(ValueError):
        scale.scale_columns(df, ["v"], "other")


def test_fills(spark):
    df = values(spark, 1, None, 4, 10)
    assert column(impute.fill_mean(df, ["v"])) == [1, 5, 4, 10]
    assert column(impute.fill_median(df, ["v"])) == [1, 4, 4, 10]
    text = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b"), (4, "a")], "id int, v string")
    assert column(impute.fill_mode(text, ["v"])) == ["b", "a", "a", "b", "a"]


def test_groups_drop_null_keys_and_sum_nothing_to_zero(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), ("b", 2.0)], "k string, v double")
    got = {r["k"]: (r["v_sum"], r["v_count"], r["v_median"]) for r in
           group.group_many(df, ["k"], {"v": ["sum", "count", "median"]}).collect()}
    assert got == {"a": (0.0, 0, None), "b": (2.0, 1, 2.0)}
    assert [tuple(r) for r in group.group_one(df, "k", "count").collect()] == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        group.group_many(df, ["k"], {"v": ["product"]})


def test_words(spark):
    df = spark.createDataFrame([("  The cat the CAT \n dog ",), (None,)], "t string")
    got = [tuple(r) for r in group.word_count(df, "t", more_than=0).collect()]
    assert got == [("cat", 2), ("none", 1), ("dog", 1)]


def test_collected_points_are_whole(spark):
    df = spark.range(1000).select(
        "id", F.expr("timestamp_ntz'2020-01-01 05:00:00'").alias("t"), F.col("id").cast("double").alias("y"),
        (-F.col("id")).cast("double").alias("x"),
    )
    rows = group.collect_points(df, "t", "hour", "id", "y", "x", chunk_rows=50).collect()
    assert len(rows) == 20 and max(r["n"] for r in rows) < 100
    assert sorted(v for r in rows for v in r["lats"]) == [float(i) for i in range(1000)]
    assert all(a == -b for r in rows for a, b in zip(r["lats"], r["lngs"]))


# --- encodings -------------------------------------------------------------

def test_label_codes_both_ways(spark):
    df = spark.createDataFrame([(v,) for v in ["pear", "fig", None, "apple", "fig"]], "v string")
    want = {"apple": 0, "fig": 1, "pear": 2}
    for few in (10, 1):
        assert {r["value"]: r["code"] for r in encode.label_codes(df, "v", few=few).collect()} == want
    labelled = {r["value"]: r["code"] for r in encode.label_codes(df, "v", "nan").collect()}
    assert labelled == {"apple": 0, "fig": 1, "nan": 2, "pear": 3}
    assert df.count() == encode.label_encode(df, "v").count()


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, v string")
    out = encode.one_hot_encode(df, "v")
    assert out.columns == ["id", "v", "v_a", "v_b"]
    assert [tuple(r)[2:] for r in out.orderBy("id").collect()] == [(0, 1), (0, 0), (1, 0)]
    with pytest.raises(ValueError):
        encode.one_hot_encode(df, "v", limit=1)


# --- functions -------------------------------------------------------------

def test_hour_bands(spark):
    df = spark.range(24).select(F.col("id").alias("h"), fn.hour_band(F.col("id")).alias("b")).orderBy("h")
    bands = [r["b"] for r in df.collect()]
    assert bands == ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 4 + ["night"] * 2


def test_clip_and_names(spark):
    df = values(spark, -5, 5, 50, None).withColumn("v", fn.clip(F.col("v"), 0.0, None))
    assert column(df) == [0, 5, 50, None]
    assert fn.join_names(["State", "Month"]) == "State_Month"


def test_grid_counts_points_strictly_inside(spark):
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 4.0), (1.0, 0.5), (0.5, 0.5), (2.0, 2.5), (3.5, 3.5)], "x double, y double")
    got = {(r["i"], r["j"]): r["n"] for r in spatial.grid_density(df, "x", "y", 4).collect()}
    assert got == {(0, 0): 1, (3, 3): 1}
    closed = {(r["i"], r["j"]): r["n"] for r in spatial.grid_density(df, "x", "y", 4, closed="left").collect()}
    assert closed == {(0, 0): 2, (1, 0): 1, (2, 2): 1, (3, 3): 2}


def test_tails():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert tails.student_quantile(0.975, 10) == pytest.approx(2.22813885, abs=1e-7)
    assert tails.f_upper(4.0, 2, 12) == pytest.approx(0.046656, abs=1e-6)


# --- models ----------------------------------------------------------------

def test_exact_silhouette_and_its_bound(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (10.0, 1), (12.0, 1)], "v double, label int")
    a = [1, 1, 2, 2]
    b = [11, 10, 9.5, 11.5]
    want = sum((y - x) / max(x, y) for x, y in zip(a, b)) / 4
    assert cluster.silhouette_exact(df, ["v"], "label").first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        cluster.silhouette_exact(df, ["v"], "label", limit=3)


def test_calinski_of_one_cluster_is_null(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0)], "v double, label int")
    assert cluster.calinski_harabasz(df, ["v"], "label") is None


def test_best_k(spark):
    sweep = spark.createDataFrame(
        [(2, 0.5, 100.0, 7.0), (3, 0.6, 40.0, 9.0), (4, 0.6, 30.0, 9.0)],
        "k int, silhouette double, inertia double, calinski_harabasz double",
    )
    assert tuple(cluster.best_k(sweep).first()) == (3, 3, 3)


def test_logistic_needs_two_classes(spark):
    df = spark.createDataFrame([(i, i % 4 > 0, float(i)) for i in range(40)], "id int, flag boolean, x double")
    with pytest.raises(ValueError, match="single class"):
        model.logistic_fit(df, "flag", ["x"], "id")
    with pytest.raises(ValueError, match="also a feature"):
        model.logistic_fit(df, "x", ["x"], "id")
    with pytest.raises(ValueError, match="unknown"):
        model.ols_fit(df, "x", ["y"])


def test_logistic_separates(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 5)) for i in range(200)], "id int, y double, z double")
    fitted = model.logistic_fit(df.withColumn("x", F.col("y") / 10), "y", ["x", "z"], "id")
    report = {r["class"]: r["f1"] for r in
              model.classification_report(fitted.predict_labels(fitted.test), "label", "prediction").collect()}
    assert report["accuracy"] > 0.9
    assert model.coefficients(df, fitted).first()["feature"] == "x"


def test_report_with_a_missing_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "a int, p int")
    got = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in model.classification_report(df, "a", "p").collect()}
    assert got["0"] == (0.0, 0.0, 0)
    assert got["1"] == pytest.approx((1.0, 2 / 3, 2 + 1))


def test_ols_recovers_a_plane(spark):
    rows = [(i, float(i % 7), float(i % 11), 2 + 3.0 * (i % 7) - (i % 11) + (i * 37 % 10 - 4.5) / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    fitted = model.ols_fit(df, "y", ["a", "b"])
    assert fitted.params == pytest.approx([2, 3, -1], abs=0.02)
    report = {r["name"]: r["value"] for r in model.ols_summary(fitted, "id", buckets=3).collect()}
    assert report["r2"] > 0.999 and report["f_p_value"] < 1e-12 and 0 < report["durbin_watson"] < 4
    assert {r["feature"] for r in model.ols_coefficients(fitted).collect()} == {"const", "a", "b"}


def test_cluster_queries_try_all_k_on_lineitem(spark):
    from tallyframe.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    assert sorted(r["k"] for r in QUERIES["cluster_sweep"](spark, folder).collect()) == list(range(2, 11))
    labelled = QUERIES["cluster_assign"](spark, folder)
    assert labelled.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_exact_silhouette_takes_more_than_20000_rows(spark):
    df = spark.range(20_500).select((F.col("id") % 2 * 10 + F.col("id") % 10 / 10).alias("v"), (F.col("id") % 2).alias("label"))
    exact = cluster.silhouette_exact(df, ["v"], "label").first()[0]
    assert 0.9 < exact < 1
