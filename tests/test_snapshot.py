"""Snapshots: merged, carried on, and as the base of batches, against whole histories."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.operators import snapshot as SN
from spendtrace.plans import scoring
from spendtrace.sources import writers
from spendtrace.streaming import behaviour as B
from spendtrace.streaming import sinks
from tests.helpers import START, close, random_log, row
from tests.test_scoring import MODELS, log_of, values


def flat(snapshot):
    customers = {r.customer_id: [r.n, r.mean, r.m2, r.last, *r.hours, *sorted(r.recent), *sum(r.steps, []), *r.f_mean, *r.f_m2]
                 for r in snapshot.customers.collect()}
    return customers, {(r.customer_id, r.kind, r.value): r.n for r in snapshot.values.collect()}


def same(one, other):
    a, b = flat(one), flat(other)
    assert a[1] == b[1] and a[0].keys() == b[0].keys()
    for k, v in a[0].items():
        assert len(v) == len(b[0][k]) and close(v, b[0][k], 1e-6), k


@pytest.mark.parametrize("max_rows", [None, 12])
def test_snapshots_of_two_stretches_merge(spark, max_rows):
    rows = random_log(customers=4, rows=30)
    rows += [row("only-early", number=900, at=START), row("only-late", number=901, at=START + timedelta(days=60))]
    features = scoring.behaviour(log_of(spark, rows), max_rows=max_rows).rows()
    early = F.col("timestamp") < F.lit(START + timedelta(days=2))
    both = SN.merge_snapshots(SN.snapshot_of(features.filter(early)), SN.snapshot_of(features.filter(~early)))
    same(both, SN.snapshot_of(features))


@pytest.mark.parametrize("max_rows", [None, 9])
def test_batches_after_a_snapshot_equal_the_log(spark, tmp_path, max_rows):
    """Two batches in a row, the snapshot carried on, one customer cut into runs."""
    rows = random_log(customers=3, rows=40) + [row("new", number=950, at=START + timedelta(days=3))]
    cuts = [START + timedelta(days=2), START + timedelta(days=4), START + timedelta(days=900)]
    want = values(scoring.score_log(log_of(spark, rows), MODELS, with_reasons=False))
    stored = log_of(spark, [r for r in rows if r[2] < cuts[0]])
    path = str(tmp_path / "snapshot")
    writers.put_snapshot(SN.snapshot_of(scoring.behaviour(stored).rows()), path)
    snapshot = writers.read_snapshot(spark, path)
    unread = stored.filter(F.raise_error(F.lit("the history is not read")).isNull())
    got = {}
    for low, high in zip(cuts, cuts[1:]):
        batch = log_of(spark, [r for r in rows if low <= r[2] < high]).drop("is_fraud")
        carried = scoring.carry_batch(snapshot, unread, batch, MODELS, max_rows=max_rows, with_reasons=False)
        got |= values(carried.scored)
        writers.put_snapshot(carried.changed, path)
        snapshot = writers.read_snapshot(spark, path)
    assert len(got) == sum(r[2] >= cuts[0] for r in rows) > 10
    assert all(close(v, want[k], 1e-6) for k, v in got.items())
    same(snapshot, SN.snapshot_of(scoring.behaviour(log_of(spark, rows)).rows()))


def test_back_dated_rows_read_their_customers_history(spark):
    rows = random_log(customers=4, rows=30)
    cut = START + timedelta(days=3)
    customers = sorted({r[0] for r in rows})
    held = [r for r in rows if r[0] == customers[1] and START + timedelta(days=1) <= r[2] < START + timedelta(days=2)]
    held = held or [r for r in rows if r[0] == customers[1] and r[2] < cut][:3]
    stored = log_of(spark, [r for r in rows if r[2] < cut and r not in held])
    batch = log_of(spark, [r for r in rows if r[2] >= cut] + held).drop("is_fraud")
    snapshot = SN.snapshot_of(scoring.behaviour(stored).rows())
    want = values(scoring.score_log(log_of(spark, rows), MODELS, with_reasons=False))
    asked = stored.filter(F.col("customer_id") == customers[1])  # all that it may need
    carried = scoring.carry_batch(snapshot, asked, batch, MODELS, with_reasons=False)
    got = values(carried.scored)
    assert set(got) == {r[1] for r in rows if r[2] >= cut or r in held}
    assert all(close(v, want[k], 1e-6) for k, v in got.items())
    whole = SN.snapshot_of(scoring.behaviour(log_of(spark, rows)).rows())
    same(carried.changed, whole.only(batch))


def test_nothing_stored_and_nothing_new(spark):
    log = log_of(spark, random_log(customers=2, rows=5))
    nothing = SN.snapshot_of(scoring.behaviour(log.limit(0)).rows())
    batch = log.drop("is_fraud")
    got = values(scoring.score_batch(log.limit(0), batch, MODELS, with_reasons=False, snapshot=nothing))
    want = values(scoring.score_log(log, MODELS, with_reasons=False))
    assert got.keys() == want.keys() and all(close(got[k], want[k], 1e-9) for k in want)
    known = SN.snapshot_of(scoring.behaviour(log).rows())
    assert scoring.carry_batch(known, log, batch.limit(0), MODELS).scored.count() == 0


@pytest.mark.parametrize("delay,max_rows", [(None, None), (None, 12), ("1 minute", None)])
def test_stream_starts_from_a_snapshot(spark, tmp_path, delay, max_rows):
    rows = random_log(customers=3, rows=24) + [
        row("only-early", number=900, at=START), row("newcomer", number=901, at=START + timedelta(days=2))]
    cut = START + timedelta(days=1)
    log = log_of(spark, rows)
    snapshot = SN.snapshot_of(scoring.behaviour(log.filter(F.col("timestamp") < F.lit(cut)), max_rows=max_rows).rows())
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    parts = [(cut, START + timedelta(days=2)), (START + timedelta(days=2), START + timedelta(days=900))]
    for low, high in parts:
        log.filter((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high))).write.mode("append").parquet(folder)
        if high > START + timedelta(days=3) and delay:
            log_of(spark, [row("end", number=999, at=START + timedelta(days=1000))]).write.mode("append").parquet(folder)
        stream = sinks.read_transactions(spark, folder, log.schema)
        scored = B.score_stream(stream, MODELS, with_reasons=False, delay=delay, snapshot=snapshot)
        sinks.write_scored(scored, out, checkpoint).awaitTermination()
    want = values(scoring.score_log(log, MODELS, with_reasons=False))
    got = values(writers.read_scored(spark, out).filter("customer_id != 'end'"))
    assert set(got) == {r[1] for r in rows if r[2] >= cut}
    assert all(close(v, want[k], 1e-6) for k, v in got.items())


def test_rejected_rows_leave_no_trace(spark, tmp_path):
    rows = [r[:8] for r in random_log(customers=2, rows=20)]
    bad = [("c0", "b1", rows[5][2], None, "fuel", "d1", "Pune", 0), (None, "b2", rows[6][2], 5.0, "fuel", "d1", "Pune", 0),
           ("c1", "b3", rows[7][2], float("nan"), "fuel", "dX", "Rome", 0), ("c1", "b4", rows[3][2], -4.0, None, "dY", "Oslo", -2)]
    schema = "customer_id string, transaction_id string, timestamp timestamp, amount double, merchant_category string, " \
             "device_id string, location string, failed_logins_24h int"
    folder, out, dead, checkpoint = (str(tmp_path / n) for n in ("in", "out", "dead", "check"))
    raw = spark.createDataFrame(rows + bad, schema)
    half = F.col("timestamp") < F.lit(rows[10][2])
    counted = []
    for part in (raw.filter(half), raw.filter(~half)):
        part.write.mode("append").parquet(folder)
        stream = sinks.read_transactions(spark, folder, raw.schema)
        query = sinks.write_checked(B.score_checked_stream(stream, MODELS, with_reasons=False), out, dead, checkpoint)
        query.awaitTermination()
        counted += [p.observedMetrics["rules"] for p in query.recentProgress if "rules" in p.observedMetrics]
    clean = spark.createDataFrame([(*r[:5], r[5] or f"DEV_{r[0]}_A", *r[6:]) for r in rows], schema)
    want = values(scoring.score_log(clean, MODELS, with_reasons=False))
    got = values(writers.read_scored(spark, out))
    assert got.keys() == want.keys() and all(close(got[k], want[k], 1e-6) for k in want)
    told = {r.transaction_id: r.violations for r in sinks.read_rejected(spark, dead).collect()}
    assert told == {"b1": ["amount is missing"], "b2": ["customer_id is missing"], "b3": ["amount is missing"],
                    "b4": ["amount must be positive", "merchant_category is missing",
                           "failed_logins_24h must not be negative"]}
    assert sum(c["rejected"] for c in counted) == 4 and sum(c["rows"] for c in counted) == len(rows) + 4


def test_rows_that_break_rules_do_not_end_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    log = log_of(spark, [row(number=0), row(number=1, amount=None), row(number=2, at=None), row(number=3, at=START + timedelta(hours=1))])
    log.write.parquet(folder)
    seen = []
    (B.running_behaviour(sinks.read_transactions(spark, folder, log.schema)).writeStream
     .option("checkpointLocation", str(tmp_path / "check"))
     .foreachBatch(lambda batch, _: seen.extend((r.transaction_id, r.n_prior, r.amount_zscore) for r in batch.collect()))
     .trigger(availableNow=True).start().awaitTermination())
    assert [s[:2] for s in seen] == [("t00000", 0), ("t00003", 1)] and all(s[2] == 0 for s in seen)


class Held:
    """A map state that counts what is written."""

    def __init__(self):
        self.values, self.written = {}, 0

    def getValue(self, key):
        return self.values.get(key)

    def updateValue(self, key, value):
        self.values[key] = value
        self.written += len(repr((key, value)))

    def removeKey(self, key):
        self.values.pop(key, None)


class Handle:
    def __init__(self):
        self.maps = []

    def getMapState(self, *_):
        self.maps.append(Held())
        return self.maps[-1]

    def written(self):
        return sum(m.written for m in self.maps)


COLUMNS = T.StructType([T.StructField("event_micros", T.LongType()), T.StructField("id", T.StringType())])


def test_waiting_rows_come_out_in_order():
    pick = random.Random(3)
    handle = Handle()
    waiting = B.WaitingRows(handle, COLUMNS)
    held, taken = [], []
    for step in range(200):
        new = [(pick.randrange(0, 3 * 86_400_000_000), f"{step}-{i}") for i in range(pick.randrange(0, 6))]
        new += [(new[0][0], f"{step}-again")] if new else []
        waiting.add(new)
        held += new
        assert waiting.first() == (min(h[0] for h in held) // 1_000_000 * 1_000_000 if held else None)
        if step % 7 == 0:
            passed = pick.randrange(0, 3 * 86_400_000_000)
            due = waiting.take(passed)
            assert sorted(due) == sorted(h for h in held if h[0] < passed)
            seconds = [d[0] // 1_000_000 for d in due]
            assert seconds == sorted(seconds)
            held = [h for h in held if h[0] >= passed]
    assert sorted(waiting.take(1 << 60)) == sorted(held) and waiting.first() is None
    assert not any(m.values for m in handle.maps)


def test_bytes_written_for_a_row_do_not_grow_with_the_rows_that_wait():
    costs = []
    for rows in (200, 20_000):
        handle = Handle()
        waiting = B.WaitingRows(handle, COLUMNS)
        waiting.add([(i * 86_400_000_000 * 30 // rows, "x") for i in range(rows)])
        before = handle.written()
        for i in range(50):
            waiting.add([(i * 40_000_000_000 + 17, "y")])
        costs.append((handle.written() - before) / 50)
    assert costs[1] < 3 * costs[0] + 2000 and costs[1] < 4000


class _Held:
    """A value or map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_a_customers_rows_cost_few_state_calls_and_no_frame_each(monkeypatch):
    """Two batches of a customer: values as from plain sums, one frame made per batch."""
    taker = B.RunningBehaviour()
    taker.stats, taker.seen, made = _Held(), _Held(), []
    rows = [("c", f"t{i}", 7_000_000_000 * i, 10.0 + i, "fuel", None if i % 2 else "d", "Pune", 0, i % 24, 1)
            for i in range(40)]
    names = [*B.KEPT, "event_hour", "foreign"]
    batches = [pd.DataFrame(part[::-1], columns=names) for part in (rows[:25], rows[25:])]
    make = pd.DataFrame
    monkeypatch.setattr(pd, "DataFrame", lambda *a, **b: made.append(1) or make(*a, **b))
    got = [next(taker.handleInputRows(("c",), iter([b]), None)) for b in batches]
    monkeypatch.undo()
    assert len(made) == 2
    # the record and four values (a category, two devices, a place), read and written once a batch
    assert (taker.stats.calls, taker.seen.calls) == (4, 16)
    out = pd.concat(got, ignore_index=True)
    assert out["transaction_id"].tolist() == [r[1] for r in rows]
    assert out["n_prior"].tolist() == list(range(40)) and not out["is_late"].any()
    for i in (0, 1, 24, 25, 39):
        amounts = [r[3] for r in rows[:i]]
        mean = sum(amounts) / i if i else rows[i][3]
        assert out["features"][i][8] == pytest.approx(min(rows[i][3] / mean * 100, 1000.0))
        past = [f[0] for f in out["features"][:i]]
        assert out["means"][i][0] == pytest.approx(sum(past) / i if i else 0.0)
        assert len(out["steps"][i]) == min(i, 10)
