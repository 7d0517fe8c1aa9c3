"""Summaries of days that merge, against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendtrace.operators import daily as D
from spendtrace.operators import evaluate as E
from spendtrace.sources import writers


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).select(
        (F.col("id") % 7).cast("int").alias("day"),
        F.exp(F.randn(1) * 3).alias("wide"), F.randn(2).alias("both"),
        (F.rand(3) < 0.1).cast("int").alias("flag"),
        F.when(F.rand(4) < 0.5, F.rand(5) * 1e6).alias("gaps"),
        F.lit(None).cast("double").alias("empty"), (F.lit(1e9) + F.rand(6)).alias("far")).cache()


COLUMNS = ["wide", "both", "flag", "gaps", "empty", "far"]


def test_merged_days_equal_the_whole(spark, rows):
    got = {r.feature: r for r in D.value_summary(D.daily_values(rows, F.col("day"), COLUMNS)).collect()}
    whole = {r.feature: r for r in D.value_summary(D.daily_values(rows, F.lit(0), COLUMNS)).collect()}
    assert sorted(got) == sorted(whole) == sorted(set(COLUMNS) - {"empty"})
    data = rows.toPandas()
    for name, r in got.items():
        values = data[name].dropna().to_numpy(float)
        assert (r["count"], r.min, r.max) == (len(values), values.min(), values.max())
        assert r.mean == pytest.approx(values.mean(), rel=1e-12, abs=1e-12)
        assert r.std == pytest.approx(values.std(ddof=1), rel=1e-6)
        for q, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            exact = np.quantile(values, [share], method="lower")[0]
            above = np.quantile(values, [share], method="higher")[0]
            slack = D.RELATIVE_ERROR * max(abs(exact), abs(above)) + 1e-9
            assert exact - slack <= r[q] <= above + slack
            assert r[q] == whole[name][q]


@pytest.mark.parametrize("value", [0.0, 1.0, -1.0, 1e-12, 1e-9, -3.7e-5, 12.5, 1e300, -1e300, 0.1])
def test_bucket_holds_its_value(spark, value):
    row = spark.range(1).select(F.lit(value).alias("v")).select(
        D.bucket_value(D.value_bucket(F.col("v"))).alias("b")).first()
    assert row.b == (0.0 if abs(value) < 1e-9 else pytest.approx(value, rel=D.RELATIVE_ERROR * 1.0001))


def test_area_lies_within_its_error(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 5).alias("day"), F.when(F.col("id") % 9 > 0, F.rand(1)).alias("p"),
        F.rand(2).alias("u")).select("day", "p", F.when(F.col("day") == 4, 0).otherwise(
            (F.col("u") < F.col("p") * F.col("p")).cast("int")).alias("y")).cache()
    counted = D.daily_scores(rows, F.col("day"), "p", "y")
    got = {r.day: r for r in D.auc_summary(counted, "day").collect()}
    exact = {r.day: r.auc_roc for r in E.auc_by(rows.filter("p is not null"), "day", "p", "y").collect()}
    for day in range(4):
        assert abs(got[day].auc_roc - exact[day]) <= got[day].auc_error < 0.01
    assert got[4].auc_roc is None and exact[4] is None
    total = D.auc_summary(counted).first()
    assert total.n == rows.filter("p is not null").count()
    assert abs(total.auc_roc - E.auc_by(rows.filter("p is not null").withColumn("k", F.lit(1)), "k", "p", "y")
               .first().auc_roc) <= total.auc_error


def test_scores_at_the_ends(spark):
    rows = spark.createDataFrame([(0.0, 0), (1.0, 1), (1e-300, 0), (None, 1), (float("nan"), 1), (0.5, None)],
                                 "p double, y int").withColumn("day", F.lit("d"))
    got = D.auc_summary(D.daily_scores(rows, F.col("day"), "p", "y")).first()
    assert (got.n, got.auc_roc, got.auc_error) == (4, 1.0, 0.0)
    assert D.auc_summary(D.daily_scores(rows.limit(0), F.col("day"), "p", "y")).first().auc_roc is None


def test_a_day_counted_again_takes_its_place(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 9.0), ("b", float("inf"))],
                                 "day string, x double")
    store = writers.daily_table(str(tmp_path / "daily"))
    store.put(D.daily_values(rows, F.col("day"), ["x"]))
    assert D.value_summary(store.read(spark)).first().mean == pytest.approx(17 / 4)
    corrected = rows.filter("day = 'a'").withColumn("x", F.col("x") * 10).limit(1)
    store.put(D.daily_values(corrected, F.col("day"), ["x"]))
    got = D.value_summary(store.read(spark)).first()
    assert got["count"] == 3 and got.mean == pytest.approx(8)
    one = store.read(spark, spark.createDataFrame([("b",)], "day string"))
    assert D.value_summary(one).first()["count"] == 1


def test_exact_quartiles_from_the_rows_of_a_few_buckets(spark, rows):
    data = rows.toPandas()
    for max_rows in (None, 50):
        got = {r.feature: r for r in E.feature_summary(rows, COLUMNS, max_rows).collect()}
        assert sorted(got) == sorted(set(COLUMNS) - {"empty"})
        for name, r in got.items():
            values = data[name].dropna().to_numpy(float)
            assert [r.q25, r.q50, r.q75] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)
            assert (r["count"], r.min, r.max) == (len(values), values.min(), values.max())
            assert r.std == pytest.approx(values.std(ddof=1), rel=1e-6)


def test_exact_quartiles_of_odd_values(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(-inf, 1.0), (-inf, None), (-2.0, None), (3.0, None), (inf, None), (inf, None)],
                                 "x double, y double")
    got = {r.feature: r for r in E.feature_summary(rows, ["x", "y"]).collect()}
    assert (got["x"].min, got["x"].max, got["x"].q50) == (-inf, inf, 0.5)
    assert (got["y"].std, got["y"].q25, got["y"].q75) == (None, 1.0, 1.0)
    assert E.feature_summary(rows.limit(0), ["x"]).count() == 0
