"""From a transaction log and fitted models to scored rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import alert_level, micros
from spendtrace.operators.explain import add_probability_contributions, top_reasons
from spendtrace.operators.features import add_point_features, log_history
from spendtrace.operators.history import (
    History, LargeKeys, find_large, semi_join, split_history,
)
from spendtrace.operators.learn import RiskModels, TrajectoryModel
from spendtrace.operators.profile import add_profile, add_similarity
from spendtrace.operators.sequences import add_steps
from spendtrace.operators.snapshot import (
    Snapshot, behaviour_after, merge_snapshots, snapshot_of,
)
from spendtrace.session import materialize


def behaviour(log: DataFrame, is_home: Column | None = None, max_rows: int | None = None,
              large: LargeKeys | None = None) -> History:
    """Features, profile and earlier steps of every row: everything scoring reads."""
    history = add_point_features(log_history(log, max_rows, large), is_home).settled()
    return add_steps(add_profile(history))


def with_risk(log: DataFrame, model: TrajectoryModel, is_home: Column | None = None,
              max_rows: int | None = None, large: LargeKeys | None = None) -> DataFrame:
    """Log plus features, n_prior and the trajectory risk_score of each row.

    `_t`, the event time in microseconds, stays: `score_features` orders by it.
    """
    history = add_steps(add_point_features(log_history(log, max_rows, large), is_home).settled())
    return history.rows().withColumn("risk_score", model.risk_score(F.col("steps"))).drop("steps")


def hand_off(rows: DataFrame) -> DataFrame:
    """Rows that have a full window and so a learned risk score."""
    return rows.filter(F.col("n_prior") >= C.SEQUENCE_LENGTH)


def score_behaviour(rows: DataFrame, models: RiskModels, with_reasons: bool = True,
                    extra: list[str] | None = None) -> DataFrame:
    """Scores, alert level, similarity and reasons from `behaviour` columns.

    `extra` names further columns to keep.
    """
    scored = (
        rows.withColumn("risk_score", models.trajectory.risk_score(F.col("steps")))
        .withColumn("_probability", models.transaction.served_probability())
        .withColumn("alert_level", alert_level(F.col("_probability")))
        .withColumn("fraud_probability", F.round(F.col("_probability") * 100, 2))
    )
    scored = add_similarity(scored)
    columns = [*C.SCORED_COLUMNS, *(extra or [])]
    if with_reasons:
        elevated = F.col("_probability") >= C.REASON_THRESHOLD
        scored = add_probability_contributions(
            scored, models.transaction, models.background, when=elevated
        ).withColumn("reasons", top_reasons(F.col("contributions")))
        columns.append("reasons")
    return scored.select(*columns)


def score_features(features: DataFrame, models: RiskModels, large: LargeKeys | None = None,
                   max_rows: int | None = None, with_reasons: bool = True) -> DataFrame:
    """Scores from a stored table of `with_risk`, whose features are not built again."""
    history = split_history(features, order=("_t", "transaction_id"), max_rows=max_rows,
                            large=large)
    return score_behaviour(add_steps(add_profile(history)).rows(), models, with_reasons)


def score_log(log: DataFrame, models: RiskModels, is_home: Column | None = None,
              max_rows: int | None = None, with_reasons: bool = True) -> DataFrame:
    """Every row of a log, scored as it would have been on arrival."""
    return score_behaviour(behaviour(log, is_home, max_rows).rows(), models, with_reasons)


def batch_behaviour(stored: DataFrame, batch: DataFrame, is_home: Column | None = None,
                    max_rows: int | None = None) -> DataFrame:
    """`behaviour` of the rows of a batch, by the whole histories of its customers."""
    customers = batch.select("customer_id").distinct()
    # sizes over all stored customers: one column, without the join
    large = find_large(stored.select("customer_id").unionByName(batch.select("customer_id")),
                       "customer_id", max_rows)
    known = semi_join(stored, customers, "customer_id", large)
    log = known.withColumn("_new", F.lit(False)).unionByName(
        batch.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return behaviour(log, is_home, large=large).rows()


def score_batch(stored: DataFrame, batch: DataFrame, models: RiskModels,
                is_home: Column | None = None, max_rows: int | None = None,
                with_reasons: bool = True, snapshot: Snapshot | None = None) -> DataFrame:
    """New transactions against stored history; a row also sees earlier rows of the batch.

    Only the history of customers in the batch is read on. Rows are placed by
    event time, so a back-dated row is scored where it belongs. With a
    `snapshot` of the stored rows see `carry_batch`, which this does without
    carrying it on.
    """
    if snapshot is not None:
        return carry_batch(snapshot, stored, batch, models, is_home, max_rows, with_reasons).scored
    rows = batch_behaviour(stored, batch, is_home, max_rows).filter("_new").drop("_new")
    return score_behaviour(rows, models, with_reasons)


@dataclass(frozen=True)
class Carried:
    """`scored` rows of a batch and `changed`, the new snapshot of its customers."""

    scored: DataFrame
    changed: Snapshot


def carry_batch(snapshot: Snapshot, stored: DataFrame, batch: DataFrame, models: RiskModels,
                is_home: Column | None = None, max_rows: int | None = None,
                with_reasons: bool = True) -> Carried:
    """Score a batch from a snapshot of the stored rows and carry the snapshot on.

    Stored rows are read only for customers with a back-dated row, one not after
    the latest stored row; these are scored, and their snapshots made anew, from
    their whole histories. Everything else follows the size of the batch.
    """
    batch = materialize(batch, "batch")
    snapshot = Snapshot(*(t.join(batch.select("customer_id").distinct(), "customer_id", "left_semi")
                          for t in (snapshot.customers, snapshot.values)))
    snapshot = Snapshot(materialize(snapshot.customers, "known"), materialize(snapshot.values, "known"))
    back = materialize(
        batch.join(snapshot.customers.select("customer_id", "last"), "customer_id").filter(
            micros("timestamp") <= F.col("last")).select("customer_id").distinct(), "back-dated")
    if back.isEmpty():
        rows, parts = _after(snapshot, batch, is_home, max_rows), []
    else:
        onward = batch.join(back, "customer_id", "left_anti")
        rows = _after(snapshot, onward, is_home, max_rows)
        asked = batch.join(back, "customer_id", "left_semi")
        anew = materialize(batch_behaviour(stored, asked, is_home, max_rows), "behaviour")
        parts = [anew]
        snapshot = Snapshot(*(t.join(back, "customer_id", "left_anti")
                              for t in (snapshot.customers, snapshot.values)))
    changed = merge_snapshots(snapshot, snapshot_of(rows))
    for anew in parts:
        renewed = snapshot_of(anew)
        changed = Snapshot(changed.customers.unionByName(renewed.customers),
                           changed.values.unionByName(renewed.values))
        rows = rows.unionByName(anew.filter("_new").drop("_new"), allowMissingColumns=True)
    return Carried(score_behaviour(rows, models, with_reasons), changed)


def _after(snapshot: Snapshot, batch: DataFrame, is_home: Column | None,
           max_rows: int | None) -> DataFrame:
    large = find_large(batch, "customer_id", max_rows)
    return materialize(behaviour_after(snapshot, batch, is_home, large).rows(), "behaviour")


def batch_summary(scored: DataFrame) -> DataFrame:
    """Rows per alert level, all four levels, most severe first."""
    names = F.array(*[F.lit(level) for level in reversed(C.ALERT_LEVELS)])
    levels = scored.sparkSession.range(len(C.ALERT_LEVELS), numPartitions=1).select(
        F.get(names, F.col("id").cast("int")).alias("alert_level"),
        F.col("id").cast("int").alias("severity_order"))
    counts = scored.groupBy("alert_level").agg(F.count("*").alias("n"))
    return (levels.join(counts, "alert_level", "left")
            .select("alert_level", "severity_order", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy("severity_order"))
