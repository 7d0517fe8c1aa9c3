import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators import learn as L
from spendtrace.operators import validate as V
from spendtrace.plans import scoring
from spendtrace.sources import readers, writers
from spendtrace.streaming import behaviour as B
from spendtrace.streaming import sinks
from tests.helpers import SCHEMA, START, close, random_log, row

SCALER = [(0.1, 1.2), (0.2, 0.4), (0.02, 0.13), (0.01, 0.1), (0.01, 0.1), (0.15, 0.6),
          (0.1, 0.3), (0.1, 0.3), (106.0, 111.0), (3.0, 12.0)]
MODELS = L.RiskModels(L.fixed_trajectory_model(), L.fixed_transaction_model(SCALER),
                      [[0.0] * 10, [0.2] * 10])
VALUES = ["risk_score", "fraud_probability", "similarity_pct", "deviation_pct", "alert_level"]


def values(df):
    return {r.transaction_id: [r[c] for c in VALUES] for r in df.collect()}


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("max_rows", [None, 30])
def test_batch_scores_equal_log_scores(spark, max_rows):
    rows = random_log(customers=3, rows=40)
    cut = START + timedelta(days=2)
    every = values(scoring.score_log(log_of(spark, rows), MODELS))
    stored = log_of(spark, [r for r in rows if r[2] < cut])
    batch = log_of(spark, [r for r in rows if r[2] >= cut]).drop("is_fraud")
    got = values(scoring.score_batch(stored, batch, MODELS, max_rows=max_rows))
    assert len(got) > 10
    assert all(close(v, every[k], 1e-6) for k, v in got.items())


def test_input_order_does_not_matter(spark):
    rows = random_log(customers=2, rows=30)
    a = values(scoring.score_log(log_of(spark, rows), MODELS))
    b = values(scoring.score_log(log_of(spark, rows[::-1]).repartition(5), MODELS))
    assert a.keys() == b.keys() and all(close(a[k], b[k], 1e-9) for k in a)


def test_suspicious_request_is_critical_with_reasons(spark):
    rows = [row(number=i, at=START + timedelta(days=i), amount=1400.0 + 10 * (i % 5),
                device="DEV_A", location="Hyderabad") for i in range(30)]
    attack = [row(number=900, at=START + timedelta(days=31, hours=14), amount=85000.0,
                  category="electronics", device="DEV_UNKNOWN_9999", location="Lagos", logins=4)]
    normal = [row(number=901, at=START + timedelta(days=31), amount=1420.0, device="DEV_A",
                  location="Hyderabad")]
    scored = {r.transaction_id: r for r in scoring.score_batch(
        log_of(spark, rows), log_of(spark, attack + normal).drop("is_fraud"), MODELS).collect()}
    bad, good = scored["t00900"], scored["t00901"]
    assert bad.alert_level == "Critical Risk" and bad.fraud_probability == 99.9
    assert bad.similarity_pct < good.similarity_pct
    assert {r.feature for r in bad.reasons} & {"is_foreign_location", "is_new_device"}
    assert good.alert_level == "Low Risk" and good.reasons == []


def test_batch_file_rows_see_earlier_rows_of_the_file(spark, tmp_path):
    lines = ["customer_id,amount,merchant_category", *[f"a,{100 + i},fuel" for i in range(12)]]
    (tmp_path / "b.csv").write_text("\n".join(lines) + "\n")
    rows = readers.well_formed(readers.batch_csv(spark, str(tmp_path / "b.csv")))
    batch = V.with_defaults(V.check_rows(rows).valid)
    log = scoring.behaviour(batch).rows().orderBy("file_row")
    assert [r.amount for r in log.collect()] == [100.0 + i for i in range(12)]
    assert [r.txn_velocity_1h for r in log.collect()] == list(range(12))
    stored = log_of(spark, [row("a", at=START)])
    scored = scoring.score_batch(stored, batch, MODELS)
    assert scored.count() == 12


def test_summary_lists_all_levels(spark):
    rows = spark.createDataFrame([("Low Risk",), ("Low Risk",)], "alert_level string")
    got = [(r.alert_level, r.n) for r in scoring.batch_summary(rows).collect()]
    assert got == [("Critical Risk", 0), ("High Risk", 0), ("Medium Risk", 0), ("Low Risk", 2)]


def run_stream(spark, folder, schema, out, checkpoint):
    stream = sinks.read_transactions(spark, folder, schema)
    sinks.write_scored(B.score_stream(stream, MODELS, with_reasons=False), out,
                       checkpoint).awaitTermination()


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    rows = random_log(customers=3, rows=24)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    log = log_of(spark, rows)
    ends = [START + timedelta(days=1), START + timedelta(days=2), START + timedelta(days=900)]
    start = START - timedelta(days=1)
    for end in ends:
        part = (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end))
        log.filter(part).write.mode("append").parquet(folder)
        run_stream(spark, folder, log.schema, out, checkpoint)
        start = end
    # the same transactions once more: nothing is added
    writers.append_scored(scoring.score_log(log, MODELS, with_reasons=False), out)
    stored = writers.read_scored(spark, out)
    assert stored.count() == len(rows)
    want = values(scoring.score_log(log, MODELS, with_reasons=False))
    got = values(stored)
    assert all(close(got[k], want[k], 1e-6) for k in want)


def test_json_bodies_are_checked_filled_and_scored_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    bodies = [{"customer_id": "a", "amount": 50.0 + i, "merchant_category": "fuel",
               "timestamp": f"2024-03-0{i + 1}T10:00:00Z"} for i in range(3)]
    bodies.append({"customer_id": "a", "amount": -1.0, "merchant_category": "fuel"})
    (folder / "one.json").write_text("\n".join(json.dumps(b) for b in bodies))
    stream = sinks.read_transactions(spark, str(folder), C.BATCH_SCHEMA, file_format="json")
    scored = B.score_stream(V.with_defaults(V.check_rows(stream).valid), MODELS)
    sinks.write_scored(scored, out, str(tmp_path / "check")).awaitTermination()
    got = writers.read_scored(spark, out).orderBy("timestamp").collect()
    assert [r.amount for r in got] == [50.0, 51.0, 52.0]
    assert {r.device_id for r in got} == {"DEV_a_A"} and got[0].location == "Hyderabad"


def test_late_row_is_marked(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = log_of(spark, []).schema
    seen = []
    for i, hours in enumerate([5, 2, 9]):
        log_of(spark, [row(number=i, at=START + timedelta(hours=hours))]).coalesce(1).write.mode(
            "append").parquet(folder)
        stream = sinks.read_transactions(spark, folder, schema)
        rows = B.running_behaviour(stream)
        (rows.writeStream.option("checkpointLocation", str(tmp_path / "check"))
         .foreachBatch(lambda batch, _: seen.extend(
             (r.transaction_id, r.is_late, r.n_prior) for r in batch.collect()))
         .trigger(availableNow=True).start().awaitTermination())
    assert seen == [("t00000", False, 0), ("t00001", True, 1), ("t00002", False, 2)]


def test_rows_within_the_delay_are_taken_in_event_order(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = log_of(spark, []).schema
    seen = []
    arrivals = [[(0, 5.0), (1, 5.4)], [(2, 5.2), (3, 6.5)], [(4, 5.1)], [(5, 30.0)], [(6, 60.0)]]
    for part in arrivals:
        log_of(spark, [row(number=i, at=START + timedelta(hours=h)) for i, h in part]).coalesce(
            1).write.mode("append").parquet(folder)
        stream = sinks.read_transactions(spark, folder, schema)
        (B.running_behaviour(stream, delay="1 hour").writeStream
         .option("checkpointLocation", str(tmp_path / "check"))
         .foreachBatch(lambda batch, _: seen.extend(
             (r.transaction_id[-1], r.is_late, r.n_prior) for r in batch.collect()))
         .trigger(availableNow=True).start().awaitTermination())
    in_order = [s[0] for s in seen if not s[1]]
    assert in_order == ["0", "2", "1", "3", "5"]  # row 6 still waits
    assert [s[:2] for s in seen if s[1]] == [("4", True)]
    assert [s[2] for s in seen] == list(range(len(seen)))


def test_repeated_ids_are_dropped_within_the_delay(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = log_of(spark, random_log(customers=1, rows=6))
    log.union(log).write.parquet(folder)
    stream = sinks.distinct_transactions(sinks.read_transactions(spark, folder, log.schema))
    (stream.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "check"))
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 6


def test_fixed_values():
    """The domain constants, written out here so that a changed value is noticed."""
    assert C.SEQUENCE_LENGTH == 10
    assert C.FEATURES == [
        "amount_zscore", "hour_is_unusual", "is_new_device", "is_new_location",
        "is_foreign_location", "failed_logins_24h", "category_is_unusual", "txn_velocity_1h",
        "amount_pct_of_avg"]
    assert C.MODEL_INPUTS == [*C.FEATURES, "risk_score"]
    assert set(C.DISPLAY_NAMES) == set(C.MODEL_INPUTS)
    assert C.HOME_LOCATIONS == ("Hyderabad Mumbai Delhi Bangalore Chennai Kolkata Pune Ahmedabad "
                                "Jaipur Lucknow").split()
    assert (C.UNUSUAL_FREQUENCY, C.VELOCITY_SECONDS, C.FAILED_LOGIN_SECONDS) == (0.05, 3600, 86400)
    assert (C.ZSCORE_LIMIT, C.PCT_LIMIT, C.INPUT_LIMIT, C.PROBABILITY_CAP) == (10, 1000, 6, 0.999)
    assert (C.REASON_THRESHOLD, C.TOP_REASONS, C.SIMILARITY_DECAY) == (0.05, 4, 2.9)
    assert (C.DECISION_THRESHOLD, C.TEST_PERCENT, C.MIN_RING_CUSTOMERS) == (0.5, 20, 2)
    assert (C.CUSTOMER_LIST_LIMIT, C.TIMELINE_LIMIT, C.BACKGROUND_ROWS) == (50, 100, 200)
    assert C.ALERT_CUTS == [25, 50, 80] and C.DEFAULT_LOCATION == "Hyderabad"
    assert C.ALERT_LEVELS == ["Low Risk", "Medium Risk", "High Risk", "Critical Risk"]


def test_timeline_of_the_store_reads_one_bucket(spark, tmp_path):
    log = log_of(spark, random_log(customers=8, rows=6))
    path = str(tmp_path / "scored")
    writers.append_scored(scoring.score_log(log, MODELS, with_reasons=False), path)
    customer = log.first().customer_id
    found = writers.scored_of_customer(spark, path, customer)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(customer_bucket" in plan
    assert f"EqualTo(customer_id,{customer})" in plan
    assert found.count() == 6
