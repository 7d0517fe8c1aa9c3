"""Tables named by manifests: keyed tables, and the scored store with its index of ids."""

import pytest
from pyspark.sql import functions as F

from spendtrace.sources import manifest as M
from spendtrace.sources import writers
from spendtrace.sources.manifest import KeyedTable
from spendtrace.streaming import sinks
from tests.helpers import random_log
from tests.test_scoring import log_of


def pairs(spark, low, high, n):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(n).alias("n"))


def held(spark, table):
    return {r.k: r.n for r in table.read(spark).collect()}


def test_later_rows_replace_earlier_ones_and_reruns_do_nothing(spark, tmp_path):
    table, want = KeyedTable(str(tmp_path / "t"), ("k",)), {}
    for number in range(12):
        low = (number * 7) % 40
        assert table.put(pairs(spark, low, low + 5, number), number, "q")
        want |= {f"k{i}": number for i in range(low, low + 5)}
        assert not table.put(pairs(spark, 0, 99, -1), number, "q")
        assert held(spark, table) == want
    assert table.put(pairs(spark, 0, 2, 5), 0, "another query") and held(spark, table) == {"k0": 5, "k1": 5}
    assert table.put(pairs(spark, 0, 0, 5), 1, "another query") and len(held(spark, table)) == 2
    empty = KeyedTable(str(tmp_path / "e"), ("k",))
    assert not empty.exists(spark)
    empty.put(pairs(spark, 0, 0, 1))
    assert held(spark, empty) == {}


def test_bytes_written_follow_the_changes(spark, tmp_path, monkeypatch):
    written = []
    real = KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, rows: written.append(run := real(self, rows)) or run)
    table = KeyedTable(str(tmp_path / "t"), ("k",))
    table.put(pairs(spark, 0, 20_000, 0), 0, "q")
    for number in range(1, 33):
        table.put(pairs(spark, number, number + 10, number), number, "q")
    assert sum(r["rows"] for r in written[1:]) < 32 * 10 * 7  # never the 20,000 again
    told = M.newest(spark, table.path)
    assert len(told["parts"]["rows"]) <= 8


def test_runs_merge_like_by_like():
    assert M.to_merge([]) == 0 and M.to_merge([100]) == 0 and M.to_merge([100, 10]) == 0
    assert M.to_merge([100, 10, 8]) == 2 and M.to_merge([30, 10, 8]) == 3
    assert M.to_merge([100, 60], most=50) == 0
    runs, total = [], 0
    for _ in range(1000):
        runs.append(10)
        count = M.to_merge(runs)
        if count:
            merged = sum(runs[-count:])
            total, runs = total + merged, [*runs[:-count], merged]
    assert len(runs) < 12 and total < 1000 * 10 * 12


def test_reader_during_a_switch_and_job_that_ends_half_way(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path / "t"), ("k",))
    table.put(pairs(spark, 0, 5, 1), 0, "q")
    before = table.read(spark)
    table.put(pairs(spark, 0, 5, 2), 1, "q")
    assert {r.n for r in before.collect()} == {1}  # its folders stay for one change more
    monkeypatch.setattr(M, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.put(pairs(spark, 0, 9, 3), 2, "q")
    monkeypatch.undo()
    assert held(spark, table) == {f"k{i}": 2 for i in range(5)}
    half = tmp_path / "t" / "_manifest" / "000000000099.json"
    half.write_text('{"parts": ')
    assert held(spark, table) == {f"k{i}": 2 for i in range(5)}
    assert table.put(pairs(spark, 0, 1, 4), 2, "q") and held(spark, table)["k0"] == 4


def test_second_writer_of_one_state_fails(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",))
    table.put(pairs(spark, 0, 5, 1))
    seen = M.newest(spark, table.path)
    table.put(pairs(spark, 0, 5, 2))
    with pytest.raises(RuntimeError, match="another job"):
        M.commit(spark, table.path, seen, seen)


def scored_rows(spark, low, high, day=1, customers=5):
    rows = spark.range(low, high).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), (F.col("id") % customers).cast("string").alias("customer_id"),
        F.expr(f"timestamp'2024-01-0{day} 00:00:00' + make_interval(0,0,0,0,0,0,id)").alias("timestamp"))
    rest = {"amount": 1.0, "merchant_category": "m", "device_id": "d", "location": "l", "failed_logins_24h": 0,
            "risk_score": 1.0, "fraud_probability": 2.0, "similarity_pct": 3.0, "deviation_pct": 4.0,
            "alert_level": "Low Risk"}
    return rows.withColumns({k: F.lit(v) for k, v in rest.items()})


def test_few_ids_open_few_index_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "IDS_PER_FILE", 100)
    path = str(tmp_path / "store")
    writers.append_scored(scored_rows(spark, 0, 4000), path)
    run = M.newest(spark, path)["parts"]["ids"][0]
    assert len(run["files"]) > 20
    opened = []
    real = writers.files_with
    monkeypatch.setattr(writers, "files_with", lambda *a: opened.append(found := real(*a)) or found)
    writers.append_scored(scored_rows(spark, 3998, 4002, day=3), path)  # two stored on another date
    assert 2 <= len(opened[0]) <= 4
    stored = writers.read_scored(spark, path)
    assert stored.count() == 4002 and stored.filter("date = '2024-01-03'").count() == 2


@pytest.mark.parametrize("listed", [10_000, 3])
def test_ids_are_found_in_every_run(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(M, "LISTED", listed)
    monkeypatch.setattr(writers, "IDS_PER_FILE", 16)
    path = str(tmp_path / "store")
    for i in range(6):
        writers.append_scored(scored_rows(spark, i * 20, i * 20 + 40, day=i + 1), path)
    stored = writers.read_scored(spark, path)
    assert stored.count() == 140 == stored.select("transaction_id").distinct().count()
    told = M.newest(spark, path)
    assert sum(r["rows"] for r in told["parts"]["ids"]) == 140
    assert len(told["parts"]["rows"]) < 6
    writers.append_scored(stored.select(*scored_rows(spark, 0, 1).columns), path)
    assert M.newest(spark, path)["number"] == told["number"]


@pytest.mark.parametrize("listed", [10_000, 2])
def test_few_keys_open_few_files(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(M, "LISTED", listed)
    table = KeyedTable(str(tmp_path / "t"), ("k",), rows_per_file=50)
    table.put(pairs(spark, 0, 2000, 1))
    table.put(pairs(spark, 5, 8, 2))
    asked = spark.createDataFrame([("k6",), ("k99",), ("none",), (None,)], "name string")
    assert {(r.k, r.n) for r in table.read(spark, asked).collect()} == {("k6", 2), ("k99", 1)}
    if listed > 2:
        assert len(table.files(spark, asked)) <= 6


def test_empty_first_append(spark, tmp_path):
    path = str(tmp_path / "store")
    writers.append_scored(scored_rows(spark, 0, 0), path)
    assert writers.read_scored(spark, path).count() == 0
    writers.append_scored(scored_rows(spark, 0, 3), path)
    assert writers.read_scored(spark, path).count() == 3


def test_device_counts_of_a_stream_by_changes(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    log = log_of(spark, random_log(customers=4, rows=20))
    for i in range(3):
        log.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == i).write.mode("append").parquet(folder)
        stream = sinks.read_transactions(spark, folder, log.schema)
        sinks.count_devices(stream, out, checkpoint).awaitTermination()
    want = {(r.device_id, r.customer_id): r["count"] for r in log.filter("device_id is not null").groupBy(
        "device_id", "customer_id").count().collect()}

    def counted():
        return {(r.device_id, r.customer_id): r.n_txn for r in sinks.stored_device_counts(spark, out).collect()}

    assert counted() == want
    sinks.count_devices(sinks.read_transactions(spark, folder, log.schema), out, str(tmp_path / "new")).awaitTermination()
    assert counted() == want  # a new checkpoint counts from nothing and replaces the table
