"""Running behaviour of each customer as keyed streaming state.

The handler keeps what the batch windows derive from earlier rows and hands
features, profile and earlier steps of each arriving row to the same scoring
expressions the batch jobs use. Work per row does not grow with the history.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spendtrace import contract as C
from spendtrace.functions.columns import flag, micros
from spendtrace.operators.features import SECOND, home_city
from spendtrace.operators.learn import RiskModels
from spendtrace.operators.snapshot import KINDS, Snapshot
from spendtrace.operators.validate import RULES, violation_list, with_defaults, with_violations
from spendtrace.plans.scoring import score_behaviour
from spendtrace.streaming import packed
from spendtrace.streaming.running import HOURS, STRETCH, Past, earlier

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATS = ("n bigint, mean double, m2 double, last bigint, hours array<bigint>,"
         " recent array<bigint>, steps array<array<double>>,"
         " f_mean array<double>, f_m2 array<double>")

KEPT = ["customer_id", "transaction_id", "event_micros", "amount", "merchant_category",
        "device_id", "location", "failed_logins_24h"]

# Values of a customer that are kept in its record; further ones are entries of a map.
IN_RECORD = 256
# Customers of a page of records, on average at most.
PER_PAGE = 8
# Rows that leave the state together.
ROWS_OUT = 16_384
# Rows of one packed table that waits for the watermark.
ROWS_WAITING = 8_192
# A waiting table that is due in part goes on in this many parts, unless it is small.
PARTS, SMALL = 8, 64


class RunningBehaviour(StatefulProcessor):
    """State of one customer.

    One record holds everything of bounded size: moments of the amount and of
    each feature, rows per hour of day, times of the last hour, the latest
    steps. Values without a bound (categories, devices, locations) are entries
    of a map state, so only those an arriving row names are read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stats = handle.getValueState("stats", STATS)
        self.seen = handle.getMapState("seen", "kind string, value string", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _together(rows)
        if len(batch):
            yield self._take(batch)

    def _take(self, batch: pd.DataFrame) -> pd.DataFrame:
        """The rows in event order, with what the customer did before each."""
        ids = batch["transaction_id"].tolist()
        order = _event_order(batch["event_micros"].tolist(), ids)
        columns = {c: batch[c].array.take(order) for c in batch.columns}
        held = self.stats.get()
        past = Past() if held is None else Past.of(held)
        before = {}
        for kind, column in KINDS.items():
            entries = [_entry(v) for v in columns[column]]
            known = {e: self.seen.getValue((kind, e)) for e in dict.fromkeys(entries)}
            counts = {e: 0 if n is None else n[0] for e, n in known.items()}
            before[kind] = np.empty(len(entries), dtype=np.int64)
            for i, entry in enumerate(entries):
                before[kind][i] = counts[entry]
                counts[entry] += 1
            for entry, number in counts.items():
                self.seen.updateValue((kind, entry), (number,))
        numbers = {c: np.asarray(columns[c]) for c in NUMBERS}
        taken = [*_stretches(past, numbers, before, 0, len(ids))]
        self.stats.update(past.values())
        out = {name: [v for part in taken for v in part[name].tolist()]
               for name in ("means", "stds", "is_late", "n_prior", "features")}
        out["steps"] = [s for part in taken for s in _steps(part)]
        return pd.DataFrame({c: columns[c] for c in KEPT} | out)

    def close(self) -> None:
        pass


NUMBERS = {"event_micros": np.int64, "amount": np.float64, "event_hour": np.int64, "foreign": np.float64,
           "failed_logins_24h": np.float64}


def _stretches(past: Past, numbers: dict, before: dict, start: int, end: int) -> Iterator[dict]:
    """What `past` says of the rows from `start` to `end`, some thousand at a time.

    `before` has the earlier uses of each row's values.
    """
    seen_at = past.hours
    hours = numbers["event_hour"][start:end].astype(np.int64)
    of_hour = seen_at[hours] + earlier(hours)
    for a in range(start, end, STRETCH):
        rows = slice(a, min(a + STRETCH, end))
        at, amount, hour, foreign, logins = (numbers[c][rows].astype(kind) for c, kind in NUMBERS.items())
        yield past.take(at, amount, of_hour[rows.start - start:rows.stop - start], hour, foreign, logins,
                        before["category"][rows], before["device"][rows] == 0, before["location"][rows] == 0)


def _steps(part: dict) -> list[list]:
    vectors, leads = np.concatenate([part["lead"], part["features"]]), len(part["lead"])
    return [vectors[max(0, i - C.SEQUENCE_LENGTH):i].tolist()
            for i in range(leads, len(vectors))]


class BucketBehaviour(RunningBehaviour):
    """State of the customers of a bucket, whose rows are taken together.

    A customer's record has what `RunningBehaviour` keeps and up to `IN_RECORD`
    of its values; further values are entries of a map, read when a row names
    them. Records lie in pages of a few customers, so work follows the rows and
    customers of a micro-batch, not those of the bucket.
    """

    def __init__(self, customer: T.DataType):
        self.customer = customer

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructField("customer", self.customer)
        kind, value = (T.StructField(c, T.StringType()) for c in ("kind", "value"))
        self.records = Pages(handle.getValueState("size", "customers bigint, pages bigint"),
                             handle.getMapState("pages", "page bigint", "records binary"))
        self.seen = handle.getMapState("seen", T.StructType([key, kind, value]), "n bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Packed rows of a snapshot, as `_initial_state` makes them.

        A bucket may come in several parts; a customer's rows may be in any of them.
        """
        self.records.open()
        for data in initialState["rows"].dropna():
            table = packed.from_bytes(data)
            for customer, kind, value, n in zip(*(table[c].to_pylist() for c in INITIAL)):
                held = self.records.get(customer)
                if kind is None:
                    told = json.loads(value)
                    held.past = Past.of([told[c] for c in PAST])
                else:
                    self._use(customer, held, (kind, _entry(value)), n, 0)
        self.records.close()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = _unpacked(rows)
        if table is not None:
            yield from self._take(table)

    def _take(self, table: pa.Table) -> Iterator[pd.DataFrame]:
        """Packed rows, each customer's in event order, with what it did before each."""
        table = table.take(pc.sort_indices(table, sort_keys=[
            (c, "ascending") for c in ("customer_id", "event_micros", "transaction_id")])).combine_chunks()
        customer, names = _codes(table["customer_id"])
        numbers = {c: table[c].to_numpy() for c in NUMBERS}
        self.records.open()
        records = [self.records.get(name) for name in names]
        before = {kind: self._before(kind, customer, names, records, table[column])
                  for kind, column in KINDS.items()}
        rows = table.select(KEPT)
        ends = np.searchsorted(customer, np.arange(len(names)), "right").tolist()
        start = since = 0
        parts: list[dict] = []
        for held, end in zip(records, ends):
            for part in _stretches(held.past, numbers, before, start, end):
                parts.append(part)
                start += len(part["features"])
                if start - since >= ROWS_OUT:
                    yield _out(rows.slice(since, start - since), parts)
                    since, parts = start, []
        self.records.close()
        if parts:
            yield _out(rows.slice(since), parts)

    def _before(self, kind: str, customer: np.ndarray, names: list, records: list[Record], column) -> np.ndarray:
        """Earlier uses of each row's value by its customer; the records count the new ones."""
        value, values = _codes(column)
        entries = [_entry(v) for v in values]
        pairs, at, uses = np.unique(customer * len(entries) + value, return_inverse=True, return_counts=True)
        known = np.empty(len(pairs), dtype=np.int64)
        for i, (pair, new) in enumerate(zip(pairs.tolist(), uses.tolist())):
            who, what = divmod(pair, len(entries))
            entry, held = (kind, entries[what]), records[who]
            known[i] = self._used(names[who], held, entry)
            self._use(names[who], held, entry, new, known[i])
        return known[at] + earlier(at)

    def _used(self, customer, held: Record, entry: tuple[str, str]) -> int:
        name = "".join(entry)
        if name in held.used or not held.more:
            return held.used.get(name, 0)
        found = self.seen.getValue((customer, *entry))
        return 0 if found is None else int(found[0])

    def _use(self, customer, held: Record, entry: tuple[str, str], new: int, known: int) -> None:
        """Count `new` uses of a value that had `known`."""
        name = "".join(entry)
        if name in held.used or (not held.more and len(held.used) < IN_RECORD):
            held.used[name] = int(known + new)
        else:
            held.more = True
            self.seen.updateValue((customer, *entry), (int(known + new),))


class Record:
    """A customer's past and the values it has used; `more` if there are others in the map."""

    def __init__(self, past: Past, used: dict[str, int], more: bool = False):
        self.past, self.used, self.more = past, used, more


class Pages:
    """Records of a bucket's customers, `PER_PAGE` to a page on average.

    Pages are numbered from 0 and a customer's is found from a hash and the
    number of pages. As customers come, one page after the other is split, so
    a new customer moves the records of a page and never those of the bucket.
    """

    def __init__(self, size, pages):
        self.size, self.pages = size, pages

    def open(self) -> None:
        """Forget what was read; for each stretch of rows."""
        self.told = self.size.get() or (0, 1)
        self.customers, self.number = (int(v) for v in self.told)
        self.read: dict[int, dict] = {}
        self.asked: dict = {}

    def get(self, customer) -> Record:
        """The record of a customer, which `close` writes."""
        if customer not in self.asked:
            held = self._page(self._place(customer)).get(customer)
            self.customers += held is None
            self.asked[customer] = Record(Past(), {}) if held is None else Record(
                Past.from_bytes(held[0]), *held[1:])
        return self.asked[customer]

    def close(self) -> None:
        """Write the pages of the customers that were asked for."""
        changed = set()
        for customer, held in self.asked.items():
            place = self._place(customer)
            self._page(place)[customer] = (held.past.to_bytes(), held.used, held.more)
            changed.add(place)
        while self.customers > PER_PAGE * self.number:
            changed |= self._split()
        for place in changed:
            self.pages.updateValue((place,), (pickle.dumps(self.read[place], protocol=5),))
        if (self.customers, self.number) != tuple(self.told):
            self.size.update((self.customers, self.number))
        self.read, self.asked = {}, {}

    def _split(self) -> set[int]:
        source = self.number - (1 << self.number.bit_length() - 1)
        page, new = self._page(source), self.number
        self.number += 1
        self.read[new] = {c: page.pop(c) for c in [*page] if self._place(c) == new}
        return {source, new}

    def _page(self, place: int) -> dict:
        if place not in self.read:
            held = self.pages.getValue((place,))
            self.read[place] = {} if held is None else pickle.loads(bytes(held[0]))
        return self.read[place]

    def _place(self, customer) -> int:
        known, level = zlib.crc32(str(customer).encode()), self.number.bit_length()
        place = known % (1 << level)
        return place if place < self.number else known % (1 << level - 1)


class WaitingRows:
    """Rows of a customer by time, from which the earliest are taken.

    Rows lie under their second. The seconds that have rows are listed per hour,
    the hours per day and the days in one record, so adding a row writes its
    second and at most three short lists, however many rows wait, and taking
    rows reads only the lists on the way to them.
    """

    SPANS = (86_400 * SECOND, 3600 * SECOND, SECOND)

    def __init__(self, handle: StatefulProcessorHandle, columns: T.StructType):
        rows = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in columns)
        self.at = columns.names.index("event_micros")
        self.rows = handle.getMapState("waiting", "second bigint", f"rows array<struct<{rows}>>")
        self.lists = handle.getMapState("waiting_lists", "span bigint, number bigint", "parts array<bigint>")

    def add(self, rows: list[tuple]) -> None:
        by_second: dict[int, list[tuple]] = {}
        for row in rows:
            by_second.setdefault(int(row[self.at]) // SECOND, []).append(row)
        entered: dict[tuple[int, int], set[int]] = {}
        for second, new in by_second.items():
            held = self.rows.getValue((second,))
            self.rows.updateValue((second,), ([*map(tuple, held[0] if held else []), *new],))
            if held is None:
                parent = (0, 0)
                for span in self.SPANS:
                    part = second * SECOND // span
                    entered.setdefault(parent, set()).add(part)
                    parent = (span, part)
        for node, parts in entered.items():
            known = self._parts(node)
            if not parts <= set(known):
                self.lists.updateValue(node, (sorted({*known, *parts}),))

    def first(self) -> int | None:
        """The start of the earliest second with rows, in microseconds."""
        node = (0, 0)
        for span in self.SPANS:
            parts = self._parts(node)
            if not parts:
                return None
            node = (span, parts[0])
        return node[1] * SECOND

    def take(self, passed: int) -> list[tuple]:
        """Remove and return the rows before `passed`, second by second."""
        taken: list[tuple] = []
        self._take((0, 0), 0, passed, taken)
        return taken

    def _take(self, node: tuple[int, int], level: int, passed: int, taken: list[tuple]) -> bool:
        """Take below a node; whether nothing is left of it."""
        span, parts = self.SPANS[level], self._parts(node)
        left = []
        for i, part in enumerate(parts):
            if part * span >= passed:
                left += parts[i:]
                break
            gone = (self._take_second(part, passed, taken) if span == SECOND
                    else self._take((span, part), level + 1, passed, taken))
            if not gone:
                left.append(part)
        if not left and parts:
            self.lists.removeKey(node)
        elif len(left) < len(parts):
            self.lists.updateValue(node, (left,))
        return not left

    def _take_second(self, second: int, passed: int, taken: list[tuple]) -> bool:
        rows = [tuple(r) for r in self.rows.getValue((second,))[0]]
        taken += [r for r in rows if r[self.at] < passed]
        left = [r for r in rows if r[self.at] >= passed]
        if left:
            self.rows.updateValue((second,), (left,))
        else:
            self.rows.removeKey((second,))
        return not left

    def _parts(self, node: tuple[int, int]) -> list[int]:
        held = self.lists.getValue(node)
        return [int(p) for p in held[0]] if held else []


class OrderedBehaviour(BucketBehaviour):
    """Takes rows in event order across micro-batches.

    A row waits until the watermark has passed its time, so rows that arrive
    within the delay are taken in their place. One timer stands at the earliest
    of them, and whatever is due is taken before a row that arrives behind the
    watermark.

    Rows wait in packed tables of consecutive times, filed under their first
    row. One that is due in part goes on as several smaller ones, so a row is
    written again a few times at most, however slowly the watermark moves.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = WaitingRows(handle, T.StructType([
            T.StructField("event_micros", T.LongType()), T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._release(passed)
        table = _unpacked(rows)
        if table is not None:
            late = pc.less(table["event_micros"], passed)
            behind = table.filter(late)
            if len(behind):
                yield from self._take(behind)
            self._wait(table.filter(pc.invert(late)), ROWS_WAITING)
        self._wake()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(timerValues.getCurrentWatermarkInMs() * 1000)
        self._wake()

    def _release(self, passed: int) -> Iterator[pd.DataFrame]:
        """Take all waiting rows before `passed`, in order; the rest go on waiting."""
        due = []
        for _, data in self.waiting.take(passed):
            table = packed.from_bytes(data)
            count = int(np.searchsorted(table["event_micros"].to_numpy(), passed))
            due.append(table.slice(0, count))
            self._wait(table.slice(count), max(SMALL, len(table) // PARTS))
        if due:
            yield from self._take(pa.concat_tables(due))

    def _wait(self, table: pa.Table, most: int) -> None:
        """File rows in tables of up to `most` rows, earliest first."""
        if len(table):
            table = table.take(pc.sort_indices(table, sort_keys=[("event_micros", "ascending")])).combine_chunks()
            parts = [table.slice(a, most) for a in range(0, len(table), most)]
            self.waiting.add([(part["event_micros"][0].as_py(), packed.to_bytes(part)) for part in parts])

    def _wake(self) -> None:
        """Keep a timer at the end of the second of the earliest waiting row."""
        first = self.waiting.first()
        if first is not None:
            self.handle.registerTimer((first + SECOND) // 1000)


INITIAL = ["customer_id", "kind", "value", "n"]
# The fields of a customer's record, as in STATS.
PAST = [part.split()[0] for part in STATS.split(", ")]


def _unpacked(chunks: Iterator[pd.DataFrame]) -> pa.Table | None:
    tables = [packed.from_bytes(data) for chunk in chunks for data in chunk["rows"] if data is not None]
    return pa.concat_tables(tables) if tables else None


def _out(rows: pa.Table, parts: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("rows", "vectors", "moments"), ([v] for v in packed.taken(rows, parts)))))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Each value as its place among the distinct ones, null one of them."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _together(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(chunks)
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _event_order(micros: list, ids: list) -> list[int]:
    """Places of the rows by time and id, null ids last at their time."""
    return sorted(range(len(ids)), key=lambda i: (
        (micros[i], 1, 0) if _is_null(ids[i]) else (micros[i], 0, ids[i])))


def _is_null(value) -> bool:
    return value is None or value is pd.NA or value != value


def _entry(value) -> str:
    """A value as it is written in the map; null is a value of its own."""
    return "" if _is_null(value) else "=" + str(value)


def takeable() -> Column:
    """Whether a row can enter the state: it breaks no row rule and has a time."""
    whole = F.coalesce("failed_logins_24h", F.lit(-1)) >= 0
    return (F.size(violation_list()) == 0) & F.col("timestamp").isNotNull() & whole


def running_behaviour(stream: DataFrame, is_home: Column | None = None, delay: str | None = None,
                      snapshot: Snapshot | None = None) -> DataFrame:
    """Features, profile and earlier steps of each arriving transaction.

    With a `snapshot` the first micro-batch of a new checkpoint starts from it,
    so customers it knows are no newcomers; later runs go on from the
    checkpoint. Rows that are not `takeable` never reach the state and are not
    returned; `score_checked_stream` returns them with the rules they break.

    Without `delay` a row is taken when it arrives, rows of one micro-batch in
    event order. With `delay` rows are held back until the watermark passes them
    and are taken in event order across micro-batches. Either way a row older
    than one already taken from the customer is marked `is_late` and is scored
    against the state as it is.

    The keys of the state are buckets of customers, and rows reach it packed by
    bucket. One customer's rows of a micro-batch go to one task, so the bytes a
    trigger takes (see `read_transactions`) bound what a very active customer can
    bring.
    """
    is_home = home_city() if is_home is None else is_home
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at_type = stream.schema["timestamp"].dataType
    if delay is not None:
        stream = stream.withWatermark("timestamp", delay)
    prepared = stream.filter(takeable()).select(
        *[c for c in KEPT if c != "event_micros"],
        micros("timestamp").alias("event_micros"), F.hour("timestamp").alias("event_hour"),
        flag(~F.coalesce(is_home, F.lit(False))).alias("foreign"))
    # without the watermarked column in its input the operator drops no late rows
    columns = prepared.schema
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *[columns[c] for c in KEPT],
        T.StructField("means", array), T.StructField("stds", array),
        T.StructField("is_late", T.BooleanType()), T.StructField("n_prior", T.LongType()),
        T.StructField("features", array), T.StructField("steps", T.ArrayType(array))])
    processor = BucketBehaviour if delay is None else OrderedBehaviour
    states = _by_bucket(prepared).transformWithStateInPandas(
        statefulProcessor=processor(columns["customer_id"].dataType),
        outputStructType=packed.TAKEN, outputMode="Append",
        timeMode="None" if delay is None else "EventTime",
        initialState=None if snapshot is None else _initial_state(snapshot, columns))
    # A bucket's rows leave in tables, so those of a very active customer are scored by all tasks.
    tasks = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = states.repartition(tasks).mapInArrow(packed.unpack(schema.names), schema).withColumn(
        "timestamp", F.timestamp_micros("event_micros").cast(at_type)).drop("event_micros")
    whole_numbers = set(C.FEATURES) - {"amount_zscore", "amount_pct_of_avg"}
    named = {}
    for i, f in enumerate(C.FEATURES):
        value = F.get("features", F.lit(i))
        named[f] = value.cast("int") if f in whole_numbers else value
        named[f"mean_{f}"] = F.get("means", F.lit(i))
        named[f"std_{f}"] = F.get("stds", F.lit(i))
    return states.withColumns(named).drop("features", "means", "stds")


def _by_bucket(rows: DataFrame):
    return rows.withColumn("bucket", packed.bucket_of()).mapInArrow(
        packed.pack, packed.PACKED).groupBy("bucket")


def _initial_state(snapshot: Snapshot, columns: T.StructType):
    """One row per value of a customer, and one without a kind whose value is its record.

    The record is text: a column of lists costs Spark's way to Arrow the square of a batch.
    """
    record = F.to_json(F.struct(*PAST)).alias("value")
    rows = snapshot.customers.select("customer_id", F.lit(None).cast("string").alias("kind"), record, "n").unionByName(
        snapshot.values.select("customer_id", "kind", "value", "n"))
    return _by_bucket(rows.withColumn("customer_id", F.col("customer_id").cast(columns["customer_id"].dataType)))


def score_stream(stream: DataFrame, models: RiskModels, is_home: Column | None = None,
                 with_reasons: bool = True, delay: str | None = None,
                 snapshot: Snapshot | None = None) -> DataFrame:
    """Scored transactions of a stream; the expressions are those of the batch jobs."""
    return score_behaviour(running_behaviour(stream, is_home, delay, snapshot), models, with_reasons,
                           extra=["is_late"])


def score_checked_stream(stream: DataFrame, models: RiskModels, is_home: Column | None = None,
                         with_reasons: bool = True, delay: str | None = None,
                         snapshot: Snapshot | None = None, request: str = "") -> DataFrame:
    """All rows of a raw stream: valid ones scored, the others with the rules they break.

    `violations` is null for a scored row. A rejected row keeps its values as
    far as they parse, in the columns of the contract, and `given`, the row as
    it came. Rules come before defaults and state, so a rejected row leaves no
    trace in either. The counts of rows and of broken rules are observed as
    `rules` in the progress of the query.
    """
    given = F.to_json(F.struct(*stream.columns))
    rows = with_violations(stream.withColumn("given", given)).observe(
        "rules", F.count("*").alias("rows"), F.count_if(F.size("violations") > 0).alias("rejected"),
        *[F.count_if(F.array_contains("violations", name)).alias(name) for name in RULES])
    valid = with_defaults(rows.filter(F.size("violations") == 0).drop("violations", "given"), request=request)
    scored = score_stream(valid, models, is_home, with_reasons, delay, snapshot)
    rejected = rows.filter(F.size("violations") > 0)
    kept = [c for c in C.SCORED_COLUMNS if c in rejected.columns]
    return scored.unionByName(rejected.select(*kept, "violations", "given"), allowMissingColumns=True)
