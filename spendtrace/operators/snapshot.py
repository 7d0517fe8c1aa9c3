"""What a customer has done so far, as a table that merges and is carried forward.

A snapshot is what scoring needs of the past: moments, counts, the last hour and
the latest vectors in one row per customer, and in a second table one row per
value a customer has used, since their number has no bound. Everything is an
aggregate, so a customer of any size is combined before its shuffle, and the
snapshots of two stretches of time merge into that of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators.features import (
    SECOND, add_state, features_of_state, log_history,
)
from spendtrace.operators.history import History, LargeKeys, merge_moments
from spendtrace.operators.profile import prior_profile, settle_profile
from spendtrace.operators.sequences import add_steps, last_steps, vector

KINDS = {"category": "merchant_category", "device": "device_id", "location": "location"}
HOURS = 24

CUSTOMER_COLUMNS = ["customer_id", "n", "mean", "m2", "last", "hours", "recent", "steps",
                    "f_mean", "f_m2"]
VALUE_COLUMNS = ["customer_id", "kind", "value", "n"]

# Snapshot rows of cut customers that a broadcast may hold: some two KB each.
MAX_BROADCAST_SNAPSHOTS = 10_000


@dataclass(frozen=True)
class Snapshot:
    """`customers`: one row per customer; `values`: one per customer, kind and value."""

    customers: DataFrame
    values: DataFrame

    def only(self, wanted: DataFrame) -> Snapshot:
        """The part of the customers in `wanted`."""
        names = wanted.select("customer_id").distinct()
        return Snapshot(*(t.join(names, "customer_id", "left_semi")
                          for t in (self.customers, self.values)))


def snapshot_of(features: DataFrame) -> Snapshot:
    """Snapshot of feature rows with `_t`, the event time in microseconds.

    The rows are those of `scoring.with_risk` or `behaviour`. Rows of one instant
    are in the order of their ids, or of `file_row` where they have it. Amounts
    are present, as the row rules demand.
    """
    at_once = ["file_row"] if "file_row" in features.columns else []
    moments = [F.avg("amount").alias("mean"), (F.var_pop("amount") * F.count("amount")).alias("m2")]
    hour = F.hour("timestamp")
    totals = features.groupBy("customer_id").agg(
        F.count("*").alias("n"), *moments, F.max("_t").alias("last"),
        F.array(*[F.count_if(hour == h) for h in range(HOURS)]).alias("hours"),
        F.array(*[F.avg(f) for f in C.FEATURES]).alias("f_mean"),
        F.array(*[F.var_pop(f) * F.count(f) for f in C.FEATURES]).alias("f_m2"))
    newest = Window.partitionBy("customer_id").orderBy(
        *[F.col(c).desc() for c in ("_t", *at_once, "transaction_id")])
    latest = (
        features.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= C.SEQUENCE_LENGTH).groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), vector().alias("v")))).alias("_s"))
        .select(F.col("customer_id").alias("_c"), F.col("_s.v").alias("steps")))
    ends = totals.select(F.col("customer_id").alias("_c"), "last")
    near = C.VELOCITY_SECONDS * SECOND
    recent = (
        features.select("customer_id", "_t").join(ends, F.col("customer_id").eqNullSafe(F.col("_c")))
        .filter(F.col("_t") >= F.col("last") - near).groupBy("_c")
        .agg(F.sort_array(F.collect_list("_t")).alias("recent")).withColumnRenamed("_c", "_r"))
    customers = totals.join(latest, F.col("customer_id").eqNullSafe(F.col("_c"))).join(
        recent, F.col("customer_id").eqNullSafe(F.col("_r")))
    named = F.explode(F.array(*[F.struct(
        F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"))
        for kind, column in KINDS.items()])).alias("_v")
    values = features.select("customer_id", named).groupBy("customer_id", "_v").agg(
        F.count("*").alias("n"))
    return Snapshot(customers.select(*CUSTOMER_COLUMNS),
                    values.select("customer_id", "_v.*", "n").select(*VALUE_COLUMNS))


def merge_snapshots(earlier: Snapshot, later: Snapshot) -> Snapshot:
    """Snapshot of both stretches; `later` has only rows after those of `earlier`."""
    a, b = (s.customers.select(F.struct("*").alias(name)) for s, name in (
        (earlier, "a"), (later, "b")))
    both = a.join(b, F.col("a.customer_id").eqNullSafe(F.col("b.customer_id")), "full_outer")

    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"a.{name}"), F.col(f"b.{name}")

    n = sum((F.coalesce(x, F.lit(0)) for x in of("n")), F.lit(0)).cast("bigint")
    _, mean, m2 = merge_moments(*(F.col(f"{s}.{c}") for s in "ab" for c in ("n", "mean", "m2")))
    parts = [merge_moments(*(F.col(f"{s}.{c}") if c == "n" else F.get(F.col(f"{s}.{c}"), F.lit(i))
                             for s in "ab" for c in ("n", "f_mean", "f_m2")))
             for i in range(len(C.FEATURES))]
    last = F.greatest(*of("last"))
    no_vectors, no_times = F.array().cast("array<array<double>>"), F.array().cast("array<bigint>")
    times = F.concat(*(F.coalesce(x, no_times) for x in of("recent")))
    steps = F.concat(*(F.coalesce(x, no_vectors) for x in of("steps")))
    hours = F.when(F.col("a").isNull(), F.col("b.hours")).when(
        F.col("b").isNull(), F.col("a.hours")).otherwise(
        F.zip_with(*of("hours"), lambda x, y: x + y))
    customers = both.select(
        F.coalesce(*of("customer_id")).alias("customer_id"), n.alias("n"), mean.alias("mean"),
        m2.alias("m2"), last.alias("last"), hours.alias("hours"),
        F.filter(times, lambda t: t >= last - C.VELOCITY_SECONDS * SECOND).alias("recent"),
        last_steps(steps, C.SEQUENCE_LENGTH).alias("steps"),
        F.array(*[p[1] for p in parts]).alias("f_mean"), F.array(*[p[2] for p in parts]).alias("f_m2"))
    values = earlier.values.unionByName(later.values).groupBy("customer_id", "kind", "value").agg(
        F.sum("n").alias("n"))
    return Snapshot(customers, values.select(*VALUE_COLUMNS))


def one_table(snapshot: Snapshot) -> DataFrame:
    """Both tables as one: a customer's row has no kind, the rows of its values have one."""
    values = snapshot.values.select("customer_id", "n", "kind", "value")
    return snapshot.customers.withColumns({
        "kind": F.lit(None).cast("string"), "value": F.lit(None).cast("string")}).unionByName(
        values, allowMissingColumns=True)


def from_rows(rows: DataFrame) -> Snapshot:
    """A snapshot from the rows of `one_table`."""
    return Snapshot(rows.filter(F.col("kind").isNull()).select(*CUSTOMER_COLUMNS),
                    rows.filter(F.col("kind").isNotNull()).select(*VALUE_COLUMNS))


def _joined(history: History, table: DataFrame, large: LargeKeys | None) -> History:
    """Snapshot columns beside the rows of their customer.

    Customers that are cut are few, so theirs are sent to the runs.
    """
    few = large is not None and large.count <= MAX_BROADCAST_SNAPSHOTS
    whole = history.whole.join(table, "customer_id", "left")
    cut = history.cut
    if cut is not None and few:
        cut = cut.join(F.broadcast(large.only(table, "customer_id")), "customer_id", "left")
    elif cut is not None:
        cut = cut.join(table, "customer_id", "left")
    return history.derive(whole, cut)


def _with_counts(history: History, values: DataFrame) -> History:
    """How often the customer has used the row's category, device and location before."""
    for kind, column in KINDS.items():
        known = values.filter(F.col("kind") == kind).select(
            F.col("customer_id").alias("_c"), F.col("value").alias("_value"),
            F.col("n").alias(f"_before_{kind}"))

        def looked_up(rows: DataFrame, known=known, column=column) -> DataFrame:
            return rows.join(known, (F.col("customer_id") == F.col("_c")) & F.col(column).cast(
                "string").eqNullSafe(F.col("_value")), "left").drop("_c", "_value")

        history = history.map(looked_up)
    return history


def behaviour_after(snapshot: Snapshot, batch: DataFrame, is_home: Column | None = None,
                    large: LargeKeys | None = None, max_rows: int | None = None) -> History:
    """`scoring.behaviour` of the rows of a batch that all come after their snapshot.

    Windows run over the batch alone; what they find is merged with the snapshot
    row by row, so no row of the history is read.
    """
    history = add_state(log_history(batch, max_rows, large))
    small = snapshot.customers.select("customer_id", *[
        F.col(c).alias(f"_was_{c}") for c in ("n", "mean", "m2", "hours", "recent")])
    history = _with_counts(_joined(history, small, large), snapshot.values)
    was = F.coalesce("_was_n", F.lit(0))
    count, mean, m2 = merge_moments(
        F.col("_was_n"), F.col("_was_mean"), F.col("_was_m2"), F.col("n_prior"),
        F.col("prior_mean"), F.col("prior_std") * F.col("prior_std") * F.col("n_prior"))
    near = C.VELOCITY_SECONDS * SECOND
    late = F.size(F.filter("_was_recent", lambda t: t >= F.col("_t") - near))

    def plus(name: str, more: Column) -> Column:
        return F.col(name) + F.coalesce(more, F.lit(0))

    merged = {
        "_own": F.col("n_prior"), "n_prior": F.col("n_prior") + was, "prior_mean": mean,
        "prior_std": F.sqrt(m2 / count),
        "_hour_seen": plus("_hour_seen", F.get("_was_hours", F.col("_hour"))),
        "_category_seen": plus("_category_seen", F.col("_before_category")),
        "is_new_device": F.when(F.col("_before_device").isNull(), F.col("is_new_device")).otherwise(0),
        "is_new_location": F.when(
            F.col("_before_location").isNull(), F.col("is_new_location")).otherwise(0),
        "txn_velocity_1h": (F.col("txn_velocity_1h") + F.when(was > 0, late).otherwise(0)).cast("int"),
    }
    gone = [c for c in small.columns if c != "customer_id" and c != "_was_n"] + [
        f"_before_{kind}" for kind in KINDS]
    history = features_of_state(history.map(lambda rows: rows.withColumns(merged).drop(*gone)), is_home)
    history = add_steps(prior_profile(history.settled()))

    rest = snapshot.customers.select("customer_id", *[
        F.col(c).alias(f"_was_{c}") for c in ("steps", "f_mean", "f_m2")])
    own, profile = F.col("_own"), {}
    for i, f in enumerate(C.FEATURES):
        spread = F.col(f"_std_{f}") * F.col(f"_std_{f}") * own
        total, mean, m2 = merge_moments(
            F.col("_was_n"), F.get("_was_f_mean", F.lit(i)), F.get("_was_f_m2", F.lit(i)),
            own, F.col(f"_mean_{f}"), spread)
        profile |= {f"_mean_{f}": mean, f"_std_{f}": F.sqrt(m2 / total)}
    earlier = F.coalesce("_was_steps", F.array().cast("array<array<double>>"))
    profile["steps"] = last_steps(F.concat(earlier, F.col("steps")), C.SEQUENCE_LENGTH)
    history = _joined(history, rest, large).map(lambda rows: rows.withColumns(profile).drop(
        "_own", "_was_n", *[c for c in rest.columns if c != "customer_id"]))
    return settle_profile(history)
