"""Customers' running behaviour taken by buckets, against one row at a time."""

import json
import math
import random
from bisect import bisect_left, bisect_right, insort

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import replay
from spendtrace.plans import scoring
from spendtrace.streaming import behaviour as B
from spendtrace.streaming import packed, running
from tests.helpers import close, random_log
from tests.test_scoring import MODELS, log_of

HOUR = 3_600_000_000
SCHEMA = pa.schema([
    ("customer_id", pa.string()), ("transaction_id", pa.string()), ("event_micros", pa.int64()), ("amount", pa.float64()),
    ("merchant_category", pa.string()), ("device_id", pa.string()), ("location", pa.string()),
    ("failed_logins_24h", pa.int32()), ("event_hour", pa.int32()), ("foreign", pa.int32())])
OUT = [*B.KEPT, "means", "stds", "is_late", "n_prior", "features", "steps"]


class State:
    """A value or map state in memory that counts its calls and the bytes written."""

    def __init__(self):
        self.held, self.calls, self.written = {}, 0, 0

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.written += len(repr(value))
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.held.pop(key, None)


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, *_):
        return self.states.setdefault(name, State())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def calls(self):
        return sum(s.calls for s in self.states.values())


class Watermark:
    def __init__(self, micros):
        self.millis = micros // 1000

    def getCurrentWatermarkInMs(self):
        return self.millis


def started(kind, *of):
    processor, handle = kind(*of), Handle()
    processor.init(handle)
    return processor, handle


def frame(rows):
    return pd.DataFrame({"rows": [packed.to_bytes(pa.Table.from_pylist(rows, SCHEMA))]})


def rows_of(frames):
    parts = [pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames]
    return [r for part in packed.unpack(OUT)(iter(parts)) for r in part.to_pylist()]


def random_rows(pick, customers, rows, since, span, prefix):
    out = []
    for i in range(rows):
        at = since + pick.randrange(span) // 60_000_000 * 60_000_000
        who = f"c{pick.randrange(customers)}"
        out.append({"customer_id": who, "transaction_id": None if pick.random() < 0.02 else f"{prefix}-{i:05d}",
                    "event_micros": at, "amount": 5.0 if who == "c0" else round(pick.uniform(1, 900), 2),
                    "merchant_category": pick.choice("abc"), "device_id": pick.choice(["d1", None, f"x{i}"]),
                    "location": pick.choice(["Pune", "Oslo"]), "failed_logins_24h": pick.randrange(3),
                    "event_hour": at // HOUR % 24, "foreign": pick.randrange(2)})
    return out


class OneByOne:
    """The rows of one customer, one after the other, as written sums."""

    def __init__(self):
        self.n, self.mean, self.m2, self.last, self.hours, self.recent, self.steps = 0, 0.0, 0.0, -(1 << 62), [0] * 24, [], []
        self.f_mean, self.f_m2, self.used = [0.0] * 9, [0.0] * 9, {}

    def count(self, *entry):
        self.used[entry] = self.used.get(entry, 0) + 1
        return self.used[entry] - 1

    def take(self, r):
        n, at, amount = self.n, r["event_micros"], r["amount"]
        uses = [self.count(c, r[c]) for c in ("merchant_category", "device_id", "location")]
        mean = self.mean if n else amount
        spread = (self.m2 / n) ** 0.5 if n > 1 else max(0.3 * mean, 1.0)
        spread = max(spread, 0.1 * mean, 1.0)
        features = [
            min(max((amount - mean) / spread, -10.0), 10.0), float(n > 0 and self.hours[r["event_hour"]] / n < 0.05),
            float(uses[1] == 0), float(uses[2] == 0), float(r["foreign"]), float(r["failed_logins_24h"]),
            float(n == 0 or uses[0] / n < 0.05),
            float(bisect_right(self.recent, at + HOUR) - bisect_left(self.recent, at - HOUR)),
            min(max(amount / max(mean, 1e-6) * 100, 0.0), 1000.0)]
        out = {"n_prior": n, "is_late": at < self.last, "features": features, "steps": list(self.steps),
               "means": list(self.f_mean) if n else [0.0] * 9,
               "stds": [math.sqrt(v / n) for v in self.f_m2] if n > 1 else [1.0] * 9}
        self.n += 1
        for mean, m2, value, k in [("mean", "m2", amount, None), *(("f_mean", "f_m2", v, k) for k, v in enumerate(features))]:
            held, sums = (getattr(self, mean), getattr(self, m2)) if k is None else (self.f_mean[k], self.f_m2[k])
            gap = value - held
            held += gap / self.n
            sums += gap * (value - held)
            if k is None:
                self.mean, self.m2 = held, sums
            else:
                self.f_mean[k], self.f_m2[k] = held, sums
        self.hours[r["event_hour"]] += 1
        self.last = max(self.last, at)
        insort(self.recent, at)
        del self.recent[:bisect_left(self.recent, self.last - HOUR)]
        self.steps = [*self.steps, features][-10:]
        return out


def one_by_one(past, rows):
    """What each row of a batch finds, by customer and in event order."""
    out = []
    for r in sorted(rows, key=lambda r: (r["customer_id"], r["event_micros"], r["transaction_id"] is None, r["transaction_id"] or "")):
        out.append({c: r[c] for c in B.KEPT} | past.setdefault(r["customer_id"], OneByOne()).take(r))
    return out


def alike(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert {c: g[c] for c in [*B.KEPT, "is_late", "n_prior"]} == {c: w[c] for c in [*B.KEPT, "is_late", "n_prior"]}
        for c in ("features", "steps", "means"):
            assert close(g[c], w[c], 1e-9), (c, g, w)
        assert close(g["stds"], w["stds"], 1e-6) and [v == 0 for v in g["stds"]] == [v == 0 for v in w["stds"]]


@pytest.mark.parametrize("sizes", [{}, {"STRETCH": 7, "IN_RECORD": 3, "PER_PAGE": 2, "ROWS_OUT": 20}])
def test_rows_of_a_bucket_equal_rows_one_by_one(monkeypatch, sizes):
    """Batches that overlap, so some rows are late; many values of a customer; a constant amount."""
    for name, value in sizes.items():
        monkeypatch.setattr(B, name, value)
    pick, past = random.Random(5), {}
    taker, handle = started(B.BucketBehaviour, T.StringType())
    tables = 0
    for step in range(8):
        rows = random_rows(pick, 9, 150, step * 20 * HOUR, 30 * HOUR, f"t{step}")
        frames = list(taker.handleInputRows((1,), iter([frame(rows[:70]), frame(rows[70:])]), None))
        tables += len(frames)
        alike(rows_of(frames), one_by_one(past, rows))
    assert len(taker.records.pages.held) > 1 if sizes else not handle.states["seen"].held
    assert tables > 30 if sizes else tables == 8
    last = one_by_one(past, random_rows(pick, 1, 1, 0, HOUR, "end"))
    assert last[0]["stds"][0] == 0  # a constant amount keeps a spread of exactly nothing


def test_an_infinite_amount_is_taken_as_one_by_one():
    rows = random_rows(random.Random(1), 1, 6, 0, 9 * HOUR, "t")
    for r, amount in zip(sorted(rows, key=lambda r: r["event_micros"]), [7.0, math.inf, 3.0, 4.0, 5.0, 6.0]):
        r["amount"] = amount
    taker, _ = started(B.BucketBehaviour, T.StringType())
    got, want = rows_of(taker.handleInputRows((1,), iter([frame(rows)]), None)), one_by_one({}, rows)
    for g, w in zip(got, want):
        assert [g["features"][k] for k in (0, 8)] == [None if w["features"][k] != w["features"][k] else w["features"][k] for k in (0, 8)]


def test_a_null_in_a_snapshots_steps_stays_null():
    record = dict(zip(B.PAST, (2, 5.0, 0.0, 0, [1] * 24, [0], [[1.0] * 9, [1.0] * 8 + [None]], [1.0] * 9, [0.0] * 9)))
    taker, _ = started(B.BucketBehaviour, T.StringType())
    table = pa.Table.from_pylist([{"customer_id": "c0", "kind": None, "value": json.dumps(record), "n": 2}])
    taker.handleInitialState((1,), pd.DataFrame({"rows": [packed.to_bytes(table)]}), None)
    got = rows_of(taker.handleInputRows((1,), iter([frame(random_rows(random.Random(1), 1, 1, HOUR, HOUR, "t"))]), None))
    assert got[0]["steps"] == record["steps"] and got[0]["n_prior"] == 2


def test_customers_with_a_few_rows_cost_less_than_a_call_each():
    pick, (taker, handle) = random.Random(2), started(B.BucketBehaviour, T.StringType())
    for step in range(3):
        before = handle.calls()
        frames = list(taker.handleInputRows((1,), iter([frame(random_rows(pick, 400, 1500, step * 90 * HOUR, 80 * HOUR, f"t{step}"))]), None))
        assert len(frames) == 1 and handle.calls() - before < 200
    # one customer alone does not read or write the bucket
    before, written = handle.calls(), taker.records.pages.written
    list(taker.handleInputRows((1,), iter([frame(random_rows(pick, 1, 3, 900 * HOUR, HOUR, "one"))]), None))
    assert handle.calls() - before <= 4
    assert taker.records.pages.written - written < 4 * sum(len(repr(p)) for p in taker.records.pages.held.values()) / 50


def test_pages_split_one_by_one():
    pages = B.Pages(State(), State())
    for i in range(300):
        pages.open()
        held = pages.get(f"c{i}")
        assert held.past.n == 0 and len(pages.read) == 1
        held.past.n, held.used["x"] = i + 1, i
        splits = pages.pages.calls
        pages.close()
        assert pages.pages.calls - splits <= 6
    pages.open()
    assert pages.number == -(-300 // B.PER_PAGE)
    assert all((pages.get(f"c{i}").past.n, pages.get(f"c{i}").used) == (i + 1, {"x": i}) for i in range(300))
    assert pages.customers == 300


def test_a_record_is_the_same_after_its_bytes():
    past = running.Past.of([3, 1.5, 0.25, -7, list(range(24)), [5, 1], [[float(i)] * 9 for i in range(4)], [0.1] * 9, [0.2] * 9])
    again = running.Past.from_bytes(past.to_bytes())
    assert again.values() == past.values() and past.recent.tolist() == [1, 5]
    assert running.Past.from_bytes(running.Past().to_bytes()).values() == running.Past().values()


def test_an_initial_state_may_come_in_parts():
    pick, past = random.Random(4), {}
    early = random_rows(pick, 3, 40, 0, 50 * HOUR, "a")
    one_by_one(past, early)
    told = []
    for who, held in past.items():
        record = dict(zip(B.PAST, (held.n, held.mean, held.m2, held.last, held.hours, held.recent, held.steps, held.f_mean, held.f_m2)))
        kinds = {column: kind for kind, column in B.KINDS.items()}
        told += [(who, kinds[c], v, n) for (c, v), n in held.used.items()] + [(who, None, json.dumps(record), held.n)]
    pick.shuffle(told)
    taker, _ = started(B.BucketBehaviour, T.StringType())
    for part in (told[::2], told[1::2]):
        table = pa.Table.from_arrays([pa.array(c) for c in zip(*part)], names=B.INITIAL)
        taker.handleInitialState((1,), pd.DataFrame({"rows": [packed.to_bytes(table), None]}), None)
    later = random_rows(pick, 4, 60, 51 * HOUR, 20 * HOUR, "b")
    alike(rows_of(taker.handleInputRows((1,), iter([frame(later)]), None)), one_by_one(past, later))


def test_waiting_rows_of_a_bucket_cost_less_than_a_call_each():
    """Rows of 300 customers in any order, a watermark that moves a little at a time, late ones among them."""
    pick, past = random.Random(6), {}
    taker, handle = started(B.OrderedBehaviour, T.StringType())
    got, arrived = [], []
    for step in range(4):
        rows = random_rows(pick, 300, 2000, 0, 700 * HOUR, f"t{step}")
        arrived += rows
        got += taker.handleInputRows((1,), iter([frame(rows)]), Watermark(0))
    waiting = handle.states["waiting"]
    assert not got and handle.calls() < 200 and len(handle.timers) == 4
    written = waiting.written
    for step in range(1, 101):
        got += taker.handleExpiredTimer((1,), Watermark(step * 7 * HOUR), None)
    assert waiting.written < 12 * written  # rows that are not due are not written again and again
    alike_in_order = sorted(rows_of(got), key=lambda r: (r["customer_id"], r["n_prior"]))
    alike(alike_in_order, one_by_one(past, arrived))
    assert not waiting.held and not handle.states["waiting_lists"].held
    behind = random_rows(pick, 300, 5, 0, HOUR, "late")
    late = rows_of(taker.handleInputRows((1,), iter([frame(behind)]), Watermark(700 * HOUR)))
    alike(late, one_by_one(past, behind))
    assert all(r["is_late"] for r in late if r["n_prior"])


def test_rows_are_packed_by_bucket_whatever_their_batches(spark):
    log = spark.range(5000).select((F.col("id") % 97).alias("customer_id"), "id", F.lit(None).cast("string").alias("none"))
    table = log.withColumn("bucket", F.col("customer_id").cast("int") % 7)
    got = table.repartition(2).mapInArrow(packed.pack, packed.PACKED).collect()
    assert 7 <= len(got) <= 14
    rows = [(r.bucket, v) for r in got for v in packed.from_bytes(bytes(r.rows)).to_pylist()]
    assert sorted(v["id"] for _, v in rows) == list(range(5000))
    assert all(v["customer_id"] % 7 == bucket and v["none"] is None for bucket, v in rows)


def test_arrivals_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """Several files a part, several micro-batches, and the scores of the whole log."""
    log = log_of(spark, random_log(customers=12, rows=30)).withColumn(
        "customer_id", F.substring("customer_id", 2, 5).cast("bigint")).withColumn(
        "transaction_id", F.substring("transaction_id", 2, 9).cast("bigint"))
    log = log.withColumn("location", F.lit("CITY_1")).repartition(6)
    monkeypatch.setattr(replay.fx, "episode_log", lambda *_: log)
    monkeypatch.setattr(replay, "new_folder", lambda _, label: str(tmp_path / label))
    got = {r.transaction_id: r for r in replay.scored_in_order(spark, "", MODELS).collect()}
    assert len([*(tmp_path / "arrivals").glob("*.parquet")]) > 2 * 4 + 1
    assert len([*(tmp_path / "stream" / "commits").glob("[0-9]*")]) >= 4
    want = {r.transaction_id: r for r in scoring.score_log(log, MODELS, replay.fx.episode_home(), with_reasons=False).collect()}
    assert got.keys() == want.keys() and len(want) == 360
    for k, w in want.items():
        assert close([got[k].risk_score, got[k].fraud_probability, got[k].similarity_pct],
                     [w.risk_score, w.fraud_probability, w.similarity_pct], 1e-6) and not got[k].is_late
