"""The training chain: features, windows, both fits, held-out metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators.boosted import fit_boosted_model
from spendtrace.operators.features import add_point_features, log_history
from spendtrace.operators.learn import (
    RiskModels, add_split, background_sample, fit_trajectory_model, fit_transaction_model,
    read_background,
)
from spendtrace.operators.sequences import add_steps
from spendtrace.operators.trajectory import grow_trajectory_trees
from spendtrace.plans.reports import model_metrics
from spendtrace.session import materialize


@dataclass(frozen=True)
class Trained:
    models: RiskModels
    table: DataFrame  # rows with a full window: features, is_test, p_trajectory, risk_score

    def metrics(self) -> DataFrame:
        return model_metrics(self.table.filter("is_test"), self.models.transaction)


def training_table(log: DataFrame, is_home: Column | None = None,
                   max_rows: int | None = None) -> DataFrame:
    """Rows with a full window, split, written once because both fits read it often."""
    history = add_steps(add_point_features(log_history(log, max_rows), is_home).settled())
    full = history.rows().filter(F.col("n_prior") >= C.SEQUENCE_LENGTH)
    return materialize(add_split(full).drop("_t", "n_prior"), "training")


def train(log: DataFrame, is_home: Column | None = None, max_rows: int | None = None,
          regs: tuple[float, ...] = (0.01,), trees: bool = False) -> Trained:
    """Stage 1 on the windows, then stage 2 on the features and stage-1 scores.

    Several `regs` are compared on a validation part of the training rows. With
    `trees` both stages are boosted trees, of which a validation part decides
    the number.
    """
    table = training_table(log, is_home, max_rows)
    windows = table.filter("not is_test").select(
        "transaction_id", F.col("steps").alias("seq"), F.col("is_fraud").alias("label"))
    trajectory = grow_trajectory_trees(windows).model if trees else fit_trajectory_model(windows, regs)
    # the second fit and the metrics read narrow rows, without the windows
    narrow = materialize(
        table.withColumn("p_trajectory", trajectory.probability(F.col("steps")))
        .withColumn("risk_score", F.round(F.col("p_trajectory") * 100, 2)).drop("steps"),
        "stage2")
    rows = narrow.filter("not is_test")
    transaction = fit_boosted_model(rows).portable() if trees else fit_transaction_model(rows, regs)
    background = read_background(background_sample(rows, transaction.scaler))
    return Trained(RiskModels(trajectory, transaction, background), narrow)
