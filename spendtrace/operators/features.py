"""The nine behavioural features, each from the customer's earlier rows only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import clip, flag, micros
from spendtrace.operators.history import (
    LEAD, History, LargeKeys, first_seen, join_carry, merge_moments, seen_count, split_history,
)

SECOND = 1_000_000
PRIOR = (Window.unboundedPreceding, -1)


def home_city() -> Column:
    return F.col("location").isin(C.HOME_LOCATIONS)


def log_history(log: DataFrame, max_rows: int | None = None,
                large: LargeKeys | None = None) -> History:
    """History of a transaction log in (time, transaction id) order.

    Rows of a batch file carry `file_row`; at one instant they keep file order,
    after stored rows.

    Customers that are cut also get one expiry mark per row, placed just after
    the row leaves the velocity window, so that the number of rows inside the
    window is a running sum: +1 at a row, -1 at its mark.
    """
    timed = log.withColumn("_t", micros("timestamp"))

    at_once = ["file_row"] if "file_row" in log.columns else []

    def with_marks(rows: DataFrame) -> DataFrame:
        span = C.VELOCITY_SECONDS * SECOND + 1
        marks = rows.select("customer_id", "transaction_id",
                            (F.col("_t") + span).alias("_t"), F.lit(0).alias("_kind"))
        return rows.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)

    return split_history(timed, order=("_t", *at_once, "transaction_id"),
                         cut_order=("_t", "_kind", *at_once, "transaction_id"),
                         expand=with_marks, max_rows=max_rows, large=large)


def add_amount_state(history: History) -> History:
    """n_prior, prior_mean, prior_std (population) and txn_velocity_1h."""
    ordered = history.ordered()
    prior = ordered.rowsBetween(*PRIOR)
    # the sort of the ordered window also serves this one
    older = (history.group().orderBy("_t")
             .rangeBetween(Window.unboundedPreceding, -(C.VELOCITY_SECONDS * SECOND + 1)))
    whole = (
        history.whole
        .withColumn("n_prior", F.row_number().over(ordered).cast("bigint") - 1)
        .withColumn("prior_mean", F.avg("amount").over(prior))
        .withColumn("prior_std", F.stddev_pop("amount").over(prior))
        .withColumn("txn_velocity_1h",
                    (F.col("n_prior") - F.count("*").over(older)).cast("int"))
    )
    return history.derive(whole, history.cut)


def cut_state(history: History) -> History:
    """All state columns of cut customers, from one pass; removes the expiry marks.

    Lead rows bring in what was before a run, so every column is a running
    total inside the run.
    """
    row = F.col("_kind") == 1
    values = ["_hour", "merchant_category", "device_id", "location"]
    runs = history.derive(history.whole, history.cut.withColumn(
        "_step", F.when(row, 1).otherwise(-1)))
    runs = runs.with_lead_rows(values, ["_step"], ["amount"], row)
    prior = runs.run_ordered().rowsBetween(*PRIOR)
    inside = {
        "n_prior": F.sum("_w").over(prior),
        "_live": F.sum("_step").over(prior),
        "_cnt": F.count("amount").over(prior),
        "_mean": F.avg("amount").over(prior),
        "_var": F.var_pop("amount").over(prior),
        **{f"_{x}": F.max(f"amount_{x}").over(prior) for x in ("n0", "mean0", "m20")},
        **{f"_seen_{v}": F.coalesce(F.sum(f"_w_{v}").over(
            runs.run_ordered(v).rowsBetween(*PRIOR)), F.lit(0)) for v in values},
    }
    count, mean, m2 = merge_moments(
        F.col("_n0"), F.col("_mean0"), F.col("_m20"),
        F.col("_cnt"), F.col("_mean"), F.col("_var") * F.col("_cnt"))
    cut = (
        runs.cut.withColumns(inside).filter((F.col(LEAD) == 1) & row)
        .withColumns({
            "n_prior": F.coalesce("n_prior", F.lit(0)).cast("bigint"),
            "prior_mean": mean, "prior_std": F.sqrt(m2 / count),
            "txn_velocity_1h": F.coalesce("_live", F.lit(0)).cast("int"),
            "_hour_seen": F.col("_seen__hour"),
            "_category_seen": F.col("_seen_merchant_category"),
            "is_new_device": F.when(F.col("_seen_device_id") == 0, 1).otherwise(0),
            "is_new_location": F.when(F.col("_seen_location") == 0, 1).otherwise(0),
        })
        .drop(*[c for c in inside if c != "n_prior"], LEAD, "_w", "_step", "_kind",
              *[f"_w_{v}" for v in values], *[f"amount_{x}" for x in ("n0", "mean0", "m20")])
    )
    return replace(runs, whole=history.whole, cut=cut, cut_order=history.order)


def feature_columns(is_home: Column) -> dict[str, Column]:
    """Features of a row from the state columns; see `add_point_features`."""
    amount, n = F.col("amount"), F.col("n_prior")
    mean = F.when(n > 0, F.col("prior_mean")).otherwise(amount)
    raw_std = F.when(n > 1, F.col("prior_std")).otherwise(F.greatest(mean * 0.3, F.lit(1.0)))
    std = F.greatest(raw_std, mean * 0.1, F.lit(1.0))
    share = C.UNUSUAL_FREQUENCY
    return {
        "amount_zscore": clip((amount - mean) / std, -C.ZSCORE_LIMIT, C.ZSCORE_LIMIT),
        "hour_is_unusual": flag((n > 0) & (F.col("_hour_seen") / n < share)),
        "is_new_device": F.col("is_new_device"),
        "is_new_location": F.col("is_new_location"),
        "is_foreign_location": flag(~F.coalesce(is_home, F.lit(False))),
        "failed_logins_24h": F.col("failed_logins_24h"),
        "category_is_unusual": flag((n == 0) | (F.col("_category_seen") / n < share)),
        "txn_velocity_1h": F.col("txn_velocity_1h"),
        "amount_pct_of_avg": clip(
            amount / F.greatest(mean, F.lit(1e-6)) * 100, 0.0, C.PCT_LIMIT),
    }


def add_state(history: History) -> History:
    """What the features of a row are made of: counts and moments of the earlier rows.

    One exchange on the customer serves all windows, since the customer is part
    of each partition key.
    """
    hour = F.hour("timestamp")

    def prepared(rows: DataFrame) -> DataFrame:
        return _without_features(rows).withColumn("_hour", hour)

    history = history.map(prepared)
    own = history.derive(history.whole, None)
    own = seen_count(own, "_hour", "_hour_seen")
    own = seen_count(own, "merchant_category", "_category_seen")
    own = first_seen(own, "device_id", "is_new_device")
    own = first_seen(own, "location", "is_new_location")
    own = add_amount_state(own)
    history = history if history.cut is None else cut_state(history)
    return history.derive(own.whole, history.cut)


def features_of_state(history: History, is_home: Column | None = None) -> History:
    """The nine features from the columns of `add_state`, which leave; n_prior stays."""
    columns = feature_columns(home_city() if is_home is None else is_home)
    internal = ["prior_mean", "prior_std", "_hour", "_hour_seen", "_category_seen"]
    return history.map(lambda rows: rows.withColumns(columns).drop(*internal))


def add_point_features(history: History, is_home: Column | None = None) -> History:
    """Adds the nine features and n_prior; a column of the same name is replaced."""
    return features_of_state(add_state(history), is_home)


def _without_features(rows: DataFrame) -> DataFrame:
    """Drop recomputed columns; failed_logins_24h is an input and stays."""
    return rows.drop(*[c for c in C.FEATURES if c != "failed_logins_24h"], "n_prior")


def point_features(log: DataFrame, is_home: Column | None = None,
                   max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """Transaction log plus the nine feature columns."""
    history = log_history(log, max_rows, large)
    return add_point_features(history, is_home).rows().drop("_t", "n_prior")


def failed_logins_trailing(log: DataFrame, failed: Column,
                           max_rows: int | None = None) -> DataFrame:
    """Failed attempts of the customer in the 24 hours before each row.

    `failed` marks the rows that are failed attempts. Rows of the same instant
    do not count for each other.
    """
    span = C.FAILED_LOGIN_SECONDS * SECOND
    timed = log.withColumn("_t", micros("timestamp")).withColumn("_failed", flag(failed))

    def with_marks(rows: DataFrame) -> DataFrame:
        # at one instant: expired attempts leave, rows look, new attempts enter
        entered = rows.filter("_failed = 1").select(
            "customer_id", "transaction_id", "_t", F.lit(2).alias("_kind"), F.lit(1).alias("_step"))
        left = rows.filter("_failed = 1").select(
            "customer_id", "transaction_id", (F.col("_t") + span + 1).alias("_t"),
            F.lit(0).alias("_kind"), F.lit(-1).alias("_step"))
        looking = rows.withColumn("_kind", F.lit(1)).withColumn("_step", F.lit(0))
        return (looking.unionByName(entered, allowMissingColumns=True)
                .unionByName(left, allowMissingColumns=True))

    history = split_history(timed, order=("_t", "transaction_id"),
                            cut_order=("_t", "_kind", "transaction_id"),
                            expand=with_marks, max_rows=max_rows).dealt()
    trailing = history.group().orderBy("_t").rangeBetween(-span, -1)
    whole = history.whole.withColumn(
        "failed_logins_24h",
        F.coalesce(F.sum("_failed").over(trailing), F.lit(0)).cast("int"))
    cut = history.cut
    if cut is not None:
        prior = history.run_ordered().rowsBetween(*PRIOR)
        before = history.carried({"_sum": F.sum("_step")}, {"_before": F.sum("_sum")})
        cut = (
            cut.withColumn("_live", F.coalesce(F.sum("_step").over(prior), F.lit(0)))
            .filter("_kind = 1")
            .transform(join_carry, before, history.key)
            .withColumn("failed_logins_24h",
                        (F.col("_live") + F.coalesce("_before", F.lit(0))).cast("int"))
            .drop("_live", "_before", "_kind", "_step")
        )
    return history.derive(whole, cut).rows().drop("_t", "_failed")
