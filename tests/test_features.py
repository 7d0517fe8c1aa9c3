import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators import features as FT
from spendtrace.operators import history as H
from spendtrace.operators.profile import profile_columns
from spendtrace.plans.scoring import behaviour
from tests.helpers import SCHEMA, START, by_id, close, plain_features, random_log, row


@pytest.mark.parametrize("max_rows", [None, 25])
def test_features_match_plain_loops(spark, max_rows):
    """Both ways: one group per customer, and customers cut into runs."""
    rows = random_log()
    log = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = by_id(FT.point_features(log, max_rows=max_rows), C.FEATURES)
    want = plain_features(rows, C.HOME_LOCATIONS)
    assert got.keys() == want.keys()
    wrong = [k for k in want if not close(got[k], want[k])]
    assert wrong == []


def test_only_large_customers_are_cut(spark):
    rows = random_log(customers=2, rows=40) + [row("one", 9000)]
    history = FT.log_history(spark.createDataFrame(rows, SCHEMA), max_rows=20)
    assert {r[0] for r in history.whole.select("customer_id").distinct().collect()} == {"one"}
    assert history.cut.select(H.RUN).distinct().count() > 2
    biggest = history.cut.groupBy("customer_id", H.RUN).count().agg(F.max("count")).first()[0]
    assert biggest < 80  # rows and expiry marks of one customer


def test_tasks_hold_few_rows_however_large_a_run_is_asked_for(spark, monkeypatch):
    """A longer log makes more tasks, not larger ones, and features stay the same."""
    rows = random_log(customers=1, rows=300, seed=3) + [
        (f"s{i % 60}", *r[1:]) for i, r in enumerate(random_log(customers=1, rows=600, seed=5), 300)]
    rows = [(r[0], f"t{i:05d}", *r[2:]) for i, r in enumerate(rows)]
    log = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(H, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(H, "MAX_ROWS_PER_RUN", 40)
    history = FT.log_history(log, max_rows=1000)
    assert history.whole.rdd.getNumPartitions() == 15
    runs = history.cut.groupBy(H.RUN).count()
    assert runs.count() >= 15 and runs.agg(F.max("count")).first()[0] <= 80
    dealt = FT.add_point_features(history).cut
    assert dealt.rdd.getNumPartitions() == 30
    got = by_id(FT.point_features(log, max_rows=1000), C.FEATURES)
    want = plain_features(rows, C.HOME_LOCATIONS)
    assert [k for k in want if not close(got[k], want[k])] == []
    one = {r.transaction_id: r for r in behaviour(log, max_rows=1000).rows().collect()}
    monkeypatch.undo()
    two = {r.transaction_id: r for r in behaviour(log).rows().collect()}
    columns = [*C.FEATURES, "n_prior", *profile_columns(), "steps"]
    assert [k for k in two if not close([one[k][c] for c in columns], [two[k][c] for c in columns], 1e-6)] == []


def test_one_customer_with_a_third_of_all_rows(spark):
    rows = random_log(customers=1, rows=300, seed=3)
    rows += [row(f"s{i}", 5000 + i, START + timedelta(minutes=i)) for i in range(600)]
    log = spark.createDataFrame(rows, SCHEMA)
    got = by_id(FT.point_features(log, max_rows=100), C.FEATURES)
    want = plain_features(rows, C.HOME_LOCATIONS)
    assert [k for k in want if not close(got[k], want[k])] == []


def features_of(spark, rows):
    log = spark.createDataFrame(rows, SCHEMA)
    return {r["transaction_id"]: r for r in FT.point_features(log).collect()}


def test_first_and_second_row(spark):
    got = features_of(spark, [row(number=0, amount=50.0),
                              row(number=1, amount=80.0, at=START + timedelta(days=1))])
    first, second = got["t00000"], got["t00001"]
    assert (first.amount_zscore, first.amount_pct_of_avg) == (0.0, 100.0)
    assert (first.hour_is_unusual, first.category_is_unusual) == (0, 1)
    assert (first.is_new_device, first.is_new_location, first.txn_velocity_1h) == (1, 1, 0)
    assert second.amount_zscore == pytest.approx((80 - 50) / max(0.3 * 50, 0.1 * 50, 1.0))
    assert (second.is_new_device, second.category_is_unusual) == (0, 0)


def test_constant_and_huge_amounts(spark):
    rows = [row(number=i, amount=200.0, at=START + timedelta(days=i)) for i in range(4)]
    rows.append(row(number=4, amount=1e7, at=START + timedelta(days=5)))
    got = features_of(spark, rows)
    assert got["t00003"].amount_zscore == 0.0
    assert (got["t00004"].amount_zscore, got["t00004"].amount_pct_of_avg) == (10.0, 1000.0)


def test_velocity_bound_and_ties(spark):
    hour = timedelta(hours=1)
    rows = [row("a", 0), row("a", 1, START + hour),
            row("b", 2), row("b", 3, START + hour + timedelta(microseconds=1)),
            row("c", 4), row("c", 5)]
    got = features_of(spark, rows)
    assert [got[f"t0000{i}"].txn_velocity_1h for i in range(6)] == [0, 1, 0, 0, 0, 1]


def test_unknown_location_is_foreign_and_case_matters(spark):
    got = features_of(spark, [row("a", 0, location=None), row("b", 1, location="mumbai"),
                              row("c", 2, location="Mumbai")])
    assert [got[f"t0000{i}"].is_foreign_location for i in range(3)] == [1, 1, 0]


def test_stored_feature_columns_are_replaced(spark):
    log = spark.createDataFrame(random_log(customers=1, rows=5), SCHEMA)
    once = FT.point_features(log)
    assert FT.point_features(once).columns == once.columns


def test_later_rows_change_nothing_before(spark):
    rows = random_log(customers=2, rows=30)
    cut = START + timedelta(days=2)
    early = spark.createDataFrame([r for r in rows if r[2] < cut], SCHEMA)
    every = FT.point_features(spark.createDataFrame(rows, SCHEMA)).filter(
        F.col("timestamp") < F.lit(cut))
    assert by_id(FT.point_features(early), C.FEATURES) == by_id(every, C.FEATURES)


def test_customer_filter_reaches_the_scan(spark, small, tmp_path):
    spark.createDataFrame(random_log(), SCHEMA).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = FT.point_features(log).filter("customer_id = 'c1'")._jdf.queryExecution().toString()
    assert "EqualTo(customer_id,c1)" in plan


def test_one_exchange_serves_all_windows(spark, tmp_path):
    spark.createDataFrame(random_log(), SCHEMA).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = FT.point_features(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("max_rows", [None, 15])
def test_failed_logins_of_the_day_before(spark, max_rows):
    rows = random_log(customers=3, rows=50, seed=11)
    log = spark.createDataFrame(rows, SCHEMA)
    got = by_id(FT.failed_logins_trailing(log, F.col("merchant_category") == "fuel", max_rows),
                ["failed_logins_24h"])
    for r in rows:
        want = sum(p[0] == r[0] and p[4] == "fuel"
                   and timedelta(0) < r[2] - p[2] <= timedelta(days=1) for p in rows)
        assert got[r[1]] == [want]


@pytest.mark.parametrize("max_rows", [None, 20])
def test_positions_number_a_whole_table(spark, max_rows):
    rows = random_log()
    log = spark.createDataFrame(rows, SCHEMA).withColumn("_all", F.lit(0))
    history = H.split_history(log, "_all", ("customer_id", "timestamp", "transaction_id"),
                              max_rows)
    got = by_id(H.positions(history).rows(), ["n_prior"])
    ordered = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    assert all(got[r[1]] == [i] for i, r in enumerate(ordered))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("max_rows", [1, 7, 40])
def test_cut_equals_whole_for_any_key(spark, seed, max_rows):
    """Null keys and values, equal times, runs of one row."""
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        at = START + timedelta(hours=rng.randint(0, 60))
        rows.append((
            rng.choice([None, None, "a", "b"]), f"t{i:03d}", at, rng.choice([5.0, 7.5, 900.0]),
            rng.choice(["fuel", None, "food"]), rng.choice([None, "d1", "d2"]),
            rng.choice(["Pune", "Lagos", None]), rng.randint(0, 3), 0))
    log = spark.createDataFrame(rows, (
        "customer_id string, transaction_id string, timestamp timestamp, amount double,"
        " merchant_category string, device_id string, location string, failed_logins_24h int,"
        " is_fraud int"))
    whole = behaviour(log).rows().orderBy("transaction_id").collect()
    cut = {r.transaction_id: r for r in behaviour(log, max_rows=max_rows).rows().collect()}
    for r in whole:
        for c in [*C.FEATURES, "n_prior", *profile_columns()]:
            assert cut[r.transaction_id][c] == pytest.approx(r[c], abs=1e-9), (r.transaction_id, c)
        assert np.allclose(np.array(cut[r.transaction_id].steps), np.array(r.steps))
    failed = F.col("merchant_category") == "fuel"
    one = FT.failed_logins_trailing(log, failed).orderBy("transaction_id").collect()
    two = FT.failed_logins_trailing(log, failed, max_rows).orderBy("transaction_id").collect()
    assert [r.failed_logins_24h for r in one] == [r.failed_logins_24h for r in two]


def test_more_runs_than_ranges(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_RANGES", 3)
    monkeypatch.setattr(H, "MAX_SPLIT_KEYS", 0)
    rows = spark.createDataFrame([(None if i % 2 else "k", i) for i in range(200)], "k string, v int")
    history = H.positions(H.split_history(rows, key="k", order=("v",), max_rows=5), "at")
    assert history.cut.select(H.RUN).distinct().count() > 20
    assert all(r["at"] == r.v // 2 for r in history.rows().collect())
