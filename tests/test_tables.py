import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spendtrace import session
from spendtrace import contract as C
from spendtrace.functions.columns import generated_transaction_id, sequential_transaction_id
from spendtrace.operators import learn as L
from spendtrace.operators import rings as R
from spendtrace.operators import validate as V
from spendtrace.plans import reports
from spendtrace.sources import readers, writers
from tests.helpers import SCHEMA, START, random_log, row

# Fixed input: a given batch file.
SAMPLE = """customer_id,amount,merchant_category,device_id,location,failed_logins_24h
CUST_0001,1500,grocery,,,0
CUST_0002,92000,electronics,DEV_UNKNOWN_1234,Lagos,5
CUST_0003,2200,dining,,,0
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_missing_required_columns_are_listed(spark, tmp_path):
    path = write(tmp_path / "b.csv", "device_id,amount\nx,1\n")
    with pytest.raises(ValueError, match=r"\['customer_id', 'merchant_category'\]"):
        readers.batch_csv(spark, path)


def test_sample_batch_gets_defaults(spark, tmp_path):
    rows = readers.well_formed(readers.batch_csv(spark, write(tmp_path / "b.csv", SAMPLE)))
    checked = V.check_rows(rows)
    got = V.with_defaults(checked.valid).orderBy("customer_id").collect()
    assert checked.quarantined.count() == 0
    assert [r.device_id for r in got] == ["DEV_CUST_0001_A", "DEV_UNKNOWN_1234", "DEV_CUST_0003_A"]
    assert [r.location for r in got] == ["Hyderabad", "Lagos", "Hyderabad"]
    assert all(r.transaction_id.startswith("TXN_") and r.timestamp for r in got)


def test_only_required_columns_are_enough(spark, tmp_path):
    path = write(tmp_path / "b.csv", "amount,merchant_category,customer_id\n7.5,fuel,a\n")
    valid = V.check_rows(readers.well_formed(readers.batch_csv(spark, path))).valid
    got = V.with_defaults(valid, device_pattern="D-{}").first()
    assert (got.amount, got.device_id, got.failed_logins_24h) == (7.5, "D-a", 0)


def test_bad_values_and_lines_are_kept_apart(spark, tmp_path):
    path = write(tmp_path / "b.csv", "customer_id,amount,merchant_category\n"
                 "a,ten,fuel\nb,-3,fuel\nc,5,fuel,extra,fields\n,4,fuel\nd,6,\ne,7,fuel\n")
    rows = readers.batch_csv(spark, path)
    checked = V.check_rows(readers.well_formed(rows))
    reasons = {r.customer_id: r.violations for r in checked.quarantined.collect()}
    assert reasons == {
        "a": ["amount is missing", "amount does not parse"], "b": ["amount must be positive"],
        None: ["customer_id is missing"], "d": ["merchant_category is missing"]}
    assert [r.customer_id for r in checked.valid.collect()] == ["e"]
    assert [r._corrupt_record for r in readers.malformed(rows).collect()] == [
        "c,5,fuel,extra,fields"]


def test_ids(spark):
    rows = spark.createDataFrame([("a", 12), ("a", 12345678)], "c string, n int")
    got = rows.select(generated_transaction_id(F.col("c"), F.col("n")).alias("g"),
                      sequential_transaction_id(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["TXN_0000012", "TXN_12345678"]
    assert len({r.g for r in got}) == 2
    assert all(len(r.g) == 14 and r.g[4:] == r.g[4:].upper() for r in got)


def test_log_csv_round_trip_and_bad_file(spark, tmp_path):
    log = spark.createDataFrame(random_log(2, 10), SCHEMA).select(
        "customer_id", "transaction_id", "timestamp", "amount", "merchant_category",
        "device_id", "location", "failed_logins_24h", F.lit(0).alias("is_new_device"),
        F.lit(0).alias("is_new_location"), "is_fraud")
    log.write.option("header", True).csv(str(tmp_path / "log"))
    back = readers.transactions_csv(spark, str(tmp_path / "log"))
    assert back.exceptAll(log).count() == 0 and back.count() == 20
    bad = write(tmp_path / "bad.csv", ",".join(C.TRANSACTION_SCHEMA.names) + "\na,b,nope\n")
    with pytest.raises(Exception):
        readers.transactions_csv(spark, bad).collect()


def test_absent_history_is_empty(spark, tmp_path):
    empty = readers.stored_history(spark, str(tmp_path / "nothing"))
    assert empty.count() == 0 and empty.columns == C.TRANSACTION_SCHEMA.names


def test_json_bodies(spark):
    body = json.dumps({"customer_id": "a", "amount": 5.5, "merchant_category": "fuel",
                       "device_id": "d", "location": "Pune", "failed_logins_24h": 2,
                       "timestamp": "2024-03-01T10:00:00Z"})
    got = readers.transactions_json(spark.createDataFrame([(body,)], "value string")).first()
    assert (got.customer_id, got.amount, got.failed_logins_24h) == ("a", 5.5, 2)
    assert got.timestamp is not None and got.transaction_id is None


def scored_rows(spark, ids):
    return spark.createDataFrame(
        [(i, "a", START + timedelta(days=n), 5.0, "fuel", "d", "Pune", 0, 1.0, 2.0, 3.0, 97.0,
          "Low Risk") for n, i in enumerate(ids)],
        "transaction_id string, customer_id string, timestamp timestamp, amount double,"
        " merchant_category string, device_id string, location string, failed_logins_24h int,"
        " risk_score double, fraud_probability double, similarity_pct double,"
        " deviation_pct double, alert_level string")


def test_append_scored_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "scored")
    writers.append_scored(scored_rows(spark, ["t1", "t2"]), path)
    writers.append_scored(scored_rows(spark, ["t1", "t2", "t3", "t3"]), path)
    stored = writers.read_scored(spark, path)
    assert sorted(r.transaction_id for r in stored.collect()) == ["t1", "t2", "t3"]
    assert stored.schema["is_fraud_actual"].dataType.simpleString() == "boolean"


def test_timeline_keeps_the_oldest(spark):
    scored = scored_rows(spark, [f"t{i}" for i in range(6)])
    got = reports.customer_timeline(scored, "a", limit=2).collect()
    assert [r.transaction_id for r in got] == ["t0", "t1"]
    assert reports.customer_timeline(scored, "other").count() == 0


def test_feature_files_are_in_customer_order(spark, tmp_path):
    log = spark.createDataFrame(random_log(4, 20), SCHEMA)
    writers.write_features(log, str(tmp_path / "f"), files=3)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 80 and len(list((tmp_path / "f").glob("part-*"))) == 3


def test_models_and_sequences_are_stored(spark, tmp_path):
    models = L.RiskModels(L.fixed_trajectory_model(),
                          L.fixed_transaction_model([(0.0, 1.0)] * 10), [[0.5] * 10])
    writers.save_models(spark, models, str(tmp_path / "m"))
    assert writers.load_models(spark, str(tmp_path / "m")) == models
    table = spark.createDataFrame([("a", "t", [[1.0] * 9] * 10, 1)],
                                  "customer_id string, transaction_id string,"
                                  " seq array<array<double>>, label int")
    writers.write_sequences(table, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first() == table.first()


def ring_log(spark):
    rows = [row(f"c{i:03d}", i, device="shared") for i in range(25)]
    rows += [row("c001", 100, device="pair"), row("c002", 101, device="pair"),
             row("c002", 102, device="pair"), row("c003", 103, device="own"),
             row("c004", 104, device=None), row("c005", 105, device=None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rings_are_one_record_each_largest_first(spark):
    got = R.rings(ring_log(spark)).collect()
    assert [(r.identifier, r.n_customers, r.transaction_count) for r in got] == [
        ("shared", 25, 25), ("pair", 2, 3)]
    assert R.rings(ring_log(spark), min_customers=3).count() == 1


@pytest.mark.parametrize("max_rows", [None, 10])
def test_members_and_pages_in_order(spark, max_rows):
    members = R.ring_members(R.device_counts(ring_log(spark)), max_rows=max_rows)
    shared = members.filter("identifier = 'shared'").orderBy("position").collect()
    assert [(r.position, r.customer_id) for r in shared] == [(i, f"c{i:03d}") for i in range(25)]
    pages = R.ring_pages(members, 4).filter("identifier = 'shared'").orderBy("page").collect()
    assert [c for r in pages for c in r.customer_ids] == [f"c{i:03d}" for i in range(25)]
    assert [r.page for r in pages] == list(range(7))


def test_ring_of_more_than_a_thousand_customers(spark):
    log = spark.range(1500).select(
        F.format_string("c%05d", "id").alias("customer_id"), F.lit("big").alias("device_id"))
    assert [(r.identifier, r.n_customers) for r in R.rings(log).collect()] == [("big", 1500)]
    members = R.ring_members(R.device_counts(log), max_rows=400).orderBy("position").collect()
    assert [(r.position, r.customer_id) for r in members] == [(i, f"c{i:05d}") for i in range(1500)]


def test_report_has_fallback_sentence(spark):
    scored = scored_rows(spark, ["t1", "t2"]).withColumn("reasons", F.when(
        F.col("transaction_id") == "t1", F.array(F.struct(
            F.lit("is_new_device").alias("feature"), F.lit("New Device").alias("display_name"),
            F.lit(0.1234).alias("attribution")))).otherwise(F.array().cast(C.REASON_TYPE)))
    got = {(r.transaction_id, r.label): r.value for r in reports.report_rows(scored).collect()}
    assert got["t1", "New Device"] == "+0.123"
    assert ("t2", C.NO_REASONS_SENTENCE) in got
    assert got["t1", "Amount"] == "Rs. 5.00"


def test_a_written_table_is_read_in_small_pieces(spark, monkeypatch):
    """One file of a written table makes several tasks, so none decodes and caches all of it."""
    monkeypatch.setattr(session, "ROW_GROUP_BYTES", 1 << 20)
    rows = spark.range(0, 600_000, 1, 1).select("id", F.rand(7).alias("x"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert before in ("16m", "16777216b")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        table = session.materialize(rows)
        pieces = table.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in pieces) == 600_000
        assert len(pieces) > 2 and max(r["count"] for r in pieces) < 400_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
