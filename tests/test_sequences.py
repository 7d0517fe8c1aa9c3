from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators import features as FT
from spendtrace.operators import profile as P
from spendtrace.operators import sequences as S
from tests.helpers import SCHEMA, START, close, plain_features, random_log, row


def history_of(spark, rows, max_rows=None):
    log = spark.createDataFrame(rows, SCHEMA)
    return FT.add_point_features(FT.log_history(log, max_rows)).settled()


def days(customer, count, first=0):
    return [row(customer, first + i, START + timedelta(days=i), 100.0 + i) for i in range(count)]


def test_ten_rows_give_none_and_eleven_give_one(spark):
    got = S.sequences(history_of(spark, days("a", 10) + days("b", 11, 20))).collect()
    assert [(r.customer_id, r.transaction_id, len(r.seq)) for r in got] == [("b", "t00030", 10)]


@pytest.mark.parametrize("max_rows", [None, 12])
def test_steps_are_the_rows_before(spark, max_rows):
    rows = random_log(customers=3, rows=45)
    features = plain_features(rows, C.HOME_LOCATIONS)
    got = {r.transaction_id: r.steps
           for r in S.add_steps(history_of(spark, rows, max_rows)).rows().collect()}
    for customer in ("c0", "c1", "c2"):
        own = sorted((r for r in rows if r[0] == customer), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(own):
            want = [features[p[1]] for p in own[max(0, i - 10):i]]
            assert close(got[r[1]], want)


def test_short_latest_window_repeats_the_first_row(spark):
    features = FT.point_features(spark.createDataFrame(days("a", 3), SCHEMA))
    window = S.latest_sequence(features).first().seq
    assert len(window) == 10 and window[:8] == [window[0]] * 8
    assert window[8] != window[7] and window[9] != window[8]
    assert S.latest_sequence(features.filter("customer_id = 'nobody'")).count() == 0


def test_latest_window_includes_the_newest_row(spark):
    features = FT.point_features(spark.createDataFrame(days("a", 14), SCHEMA))
    newest = features.orderBy(F.desc("timestamp")).select(*C.FEATURES).first()
    assert close(S.latest_sequence(features).first().seq[-1], list(newest))


def test_no_history_pads_with_zeros(spark):
    empty = F.array().cast("array<array<double>>")
    got = spark.range(1).select(S.padded(empty).alias("w")).first().w
    assert got == [[0.0] * 9] * 10


@pytest.mark.parametrize("max_rows", [None, 12])
def test_profile_as_of_each_row(spark, max_rows):
    rows = random_log(customers=2, rows=40)
    features = plain_features(rows, C.HOME_LOCATIONS)
    got = {r.transaction_id: r
           for r in P.add_profile(history_of(spark, rows, max_rows)).rows().collect()}
    for customer in ("c0", "c1"):
        own = sorted((r for r in rows if r[0] == customer), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(own):
            for j, f in enumerate(C.FEATURES):
                past = [features[p[1]][j] for p in own[:i]]
                mean = sum(past) / i if i else 0.0
                std = (sum((v - mean) ** 2 for v in past) / i) ** 0.5 if i > 1 else 1.0
                assert close(got[r[1]][f"mean_{f}"], mean, 1e-8)
                assert close(got[r[1]][f"std_{f}"], std, 1e-6)


# Fixed inputs: given feature vectors and their similarities.
@pytest.mark.parametrize("current,similar,deviation", [
    ([0.15, 0, 0, 0, 0, 0.3, 0, 1, 98], 98.17, 0.054),
    ([1.2, 0, 0, 0, 0, 1.0, 0, 2, 140], 71.2, 0.985),
    ([8.0, 1, 1, 1, 1, 5, 1, 3, 450], 1.78, 11.681),
])
def test_similarity_of_given_vectors(spark, current, similar, deviation):
    mean = [0.1, 0, 0, 0, 0, 0.2, 0, 1, 100]
    std = [0.5, 0.1, 0.1, 0.1, 0.1, 0.4, 0.1, 0.5, 15]
    columns = {}
    for f, c, m, s in zip(C.FEATURES, current, mean, std):
        columns |= {f: F.lit(float(c)), f"mean_{f}": F.lit(float(m)), f"std_{f}": F.lit(float(s))}
    got = P.add_similarity(spark.range(1).withColumns(columns)).first()
    assert got.similarity_pct == similar
    assert got.deviation_pct == pytest.approx(100 - similar)
    assert got.avg_z_deviation == deviation


def test_profile_table_and_unknown_customer(spark):
    features = FT.point_features(spark.createDataFrame(days("a", 4) + days("b", 1, 50), SCHEMA))
    profile = P.customer_profile(features)
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "customer_id string")
    got = {r.customer_id: r for r in P.profile_for(asked, profile).collect()}
    assert (got["z"].n_rows, got["z"].mean_amount_zscore, got["z"].std_amount_zscore) == (0, 0, 1)
    assert got["b"].std_amount_zscore == 1.0
    prefix = P.customer_profile(features, first_rows=2).filter("customer_id = 'a'").first()
    assert prefix.n_rows == 2
