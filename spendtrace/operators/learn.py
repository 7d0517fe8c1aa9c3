"""Split, scaling, class weights and the two class-weighted models.

A fitted model is two short lists of numbers (coefficients and scaler), so it
is applied as column expressions inside generated code.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import clip, hash_bucket, logistic, number_array, total
from spendtrace.operators.sequences import long_form, padded

Scaler = list[tuple[float, float]]


# --- split, scaler, weights ---------------------------------------------------

def add_split(rows: DataFrame, percent: int = C.TEST_PERCENT) -> DataFrame:
    """`is_test` from a hash of the transaction id: the same rows on every run,
    and the same for both models. Each class is split at the same rate."""
    return rows.withColumn("is_test", hash_bucket("transaction_id", 1000) < percent * 10)


def add_time_split(rows: DataFrame, cut) -> DataFrame:
    """`is_test` for rows at or after `cut`, so overlapping windows cannot leak."""
    return rows.withColumn("is_test", F.col("timestamp") >= F.lit(cut))


def scaler_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (population, 1 where it is 0) of each column."""
    stats = rows.agg(*[x for c in columns for x in (
        F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"),
                 F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")).alias("std"))
        for c in columns])).alias("s")
    return stats.select(pairs).select("s.*")


def sequence_scaler_stats(sequences: DataFrame) -> DataFrame:
    """Scaler over all steps of all windows."""
    return scaler_stats(long_form(sequences.select("seq")), C.FEATURES)


def read_scaler(stats: DataFrame, columns: list[str]) -> Scaler:
    """The few numbers of a scaler, for use as literals."""
    found = {r["feature"]: (r["mean"], r["std"]) for r in stats.limit(len(columns)).collect()}
    return [found[c] for c in columns]


def class_weights(rows: DataFrame, label: str = "is_fraud") -> DataFrame:
    """n_pos, n_neg and the weight of a positive row, at least 1."""
    counts = rows.agg(F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("n_pos"),
                      F.count(label).alias("_n"))
    negatives = F.col("_n") - F.col("n_pos")
    return counts.select(
        "n_pos", negatives.alias("n_neg"),
        F.greatest(negatives / F.greatest("n_pos", F.lit(1)), F.lit(1.0)).alias("weight_pos"))


def normalised(column: str | Column, mean: float, std: float) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return (value.cast("double") - mean) / std


def normalised_inputs(scaler: Scaler, limit: float | None = C.INPUT_LIMIT) -> list[Column]:
    """Stage-2 inputs on the scaler's scale, limited when a limit is given."""
    scaled = [normalised(c, *s) for c, s in zip(C.MODEL_INPUTS, scaler)]
    return [clip(x, -limit, limit) for x in scaled] if limit else scaled


# --- models -------------------------------------------------------------------

@dataclass(frozen=True)
class TrajectoryModel:
    """Linear model on the flattened window; `weights` holds one row per step."""

    intercept: float
    weights: list[list[float]]
    scaler: Scaler = field(default_factory=lambda: [(0.0, 1.0)] * len(C.FEATURES))

    def probability(self, steps: Column) -> Column:
        """From the steps before the row, padded when there are fewer than ten."""
        # the scaler is folded into the weights: one product per step and feature
        offset, weights = self.intercept, []
        for row in self.weights:
            for w, (mean, std) in zip(row, self.scaler):
                offset -= w * mean / std
                weights.append(w / std)
        products = F.zip_with(F.flatten(padded(steps)), number_array(weights),
                              lambda x, w: x * w)
        return logistic(F.aggregate(products, F.lit(offset), lambda a, v: a + v))

    def risk_score(self, steps: Column) -> Column:
        return F.round(self.probability(steps) * 100, 2)


@dataclass(frozen=True)
class TransactionModel:
    """Linear model on the ten scaled inputs."""

    intercept: float
    weights: list[float]
    scaler: Scaler

    def logit(self, inputs: list[Column]) -> Column:
        return F.lit(self.intercept) + total([x * w for x, w in zip(inputs, self.weights)])

    def probability(self, inputs: list[Column]) -> Column:
        return logistic(self.logit(inputs))

    def served_probability(self) -> Column:
        """With limited inputs and below certainty, as scoring reports it."""
        return F.least(self.probability(normalised_inputs(self.scaler)),
                       F.lit(C.PROBABILITY_CAP))

    def background_value(self, row: list[float]) -> float:
        return self.intercept + sum(x * w for x, w in zip(row, self.weights))


@dataclass(frozen=True)
class RiskModels:
    trajectory: TrajectoryModel
    transaction: TransactionModel  # or trees.TreeModel, which has the same methods
    background: list[list[float]]  # scaled training rows, at most BACKGROUND_ROWS


# Fixed demonstration coefficients, so that scores can be checked by value.
# Stage 1 weighs the mean of each feature over the window, stage 2 the ten
# scaled inputs in model order.
FIXED_TRAJECTORY_INTERCEPT = -5.0
FIXED_TRAJECTORY_WEIGHTS = [0.45, 0.2, 1.5, 0.8, 3.0, 1.2, 0.1, 0.05, 0.004]
FIXED_TRANSACTION_INTERCEPT = -4.5
FIXED_TRANSACTION_WEIGHTS = [0.7, 0.1, 0.4, 0.35, 0.45, 0.6, 0.1, 0.05, 0.5, 0.4]


def fixed_trajectory_model() -> TrajectoryModel:
    step = [w / C.SEQUENCE_LENGTH for w in FIXED_TRAJECTORY_WEIGHTS]
    return TrajectoryModel(FIXED_TRAJECTORY_INTERCEPT, [step] * C.SEQUENCE_LENGTH)


def fixed_transaction_model(scaler: Scaler) -> TransactionModel:
    return TransactionModel(FIXED_TRANSACTION_INTERCEPT, FIXED_TRANSACTION_WEIGHTS, scaler)


def background_sample(train: DataFrame, scaler: Scaler,
                      rows: int = C.BACKGROUND_ROWS) -> DataFrame:
    """Scaled training rows with the smallest hash of the id: a fixed-size draw
    without replacement that is the same on every run."""
    scaled = [x.alias(c) for c, x in zip(C.MODEL_INPUTS, normalised_inputs(scaler, None))]
    drawn = F.md5(F.col("transaction_id").cast("string"))
    return (train.select("transaction_id", drawn.alias("_h"), *scaled)
            .orderBy("_h", "transaction_id").limit(rows).drop("_h"))


def read_background(sample: DataFrame) -> list[list[float]]:
    return [[r[c] for c in C.MODEL_INPUTS]
            for r in sample.select(*C.MODEL_INPUTS).limit(C.BACKGROUND_ROWS).collect()]


# --- fitting --------------------------------------------------------------------

def _fit_logistic(rows: DataFrame, features: Column, label: str, regs: tuple[float, ...],
                  max_iter: int, tol: float = 1e-5) -> LogisticRegressionModel:
    """Class-weighted fit. Of several strengths of regularisation the one with the
    best area under the curve on a validation part of the training rows is kept."""
    weight = class_weights(rows, label).first()["weight_pos"]
    table = rows.select(
        array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, weight).otherwise(1.0).alias("weight"),
        (hash_bucket("transaction_id", 1 << 20) % 100 < C.VALIDATION_PERCENT).alias("held_out"))

    def fit(part: DataFrame, reg: float) -> LogisticRegressionModel:
        return LogisticRegression(
            weightCol="weight", maxIter=max_iter, tol=tol, regParam=reg,
            standardization=False, aggregationDepth=2).fit(part)

    best = regs[0]
    if len(regs) > 1:
        evaluator = BinaryClassificationEvaluator(numBins=0)
        fitted, held_out = table.filter("not held_out"), table.filter("held_out")
        best = max(regs, key=lambda reg: evaluator.evaluate(
            fit(fitted, reg).transform(held_out)))
    return fit(table, best)


def fit_trajectory_model(sequences: DataFrame, regs: tuple[float, ...] = (0.01,),
                         max_iter: int = 30) -> TrajectoryModel:
    """Fit P(row is fraud | ten rows before it) on the training windows.

    `sequences` has transaction_id, seq and label.
    """
    scaler = read_scaler(sequence_scaler_stats(sequences), C.FEATURES)
    flat = F.flatten("seq")
    steps, width = C.SEQUENCE_LENGTH, len(C.FEATURES)
    scaled = F.array(*[normalised(F.get(flat, F.lit(i)), *scaler[i % width])
                       for i in range(steps * width)])
    model = _fit_logistic(sequences, scaled, "label", regs, max_iter)
    values = [float(v) for v in model.coefficients]
    return TrajectoryModel(
        float(model.intercept),
        [values[k * width:(k + 1) * width] for k in range(steps)], scaler)


def fit_transaction_model(train: DataFrame, regs: tuple[float, ...] = (0.01,),
                          max_iter: int = 30) -> TransactionModel:
    """Fit the fraud probability on the ten inputs; training inputs are not limited."""
    scaler = read_scaler(scaler_stats(train, C.MODEL_INPUTS), C.MODEL_INPUTS)
    model = _fit_logistic(train, F.array(*normalised_inputs(scaler, None)), "is_fraud",
                          regs, max_iter)
    return TransactionModel(
        float(model.intercept), [float(v) for v in model.coefficients], scaler)


def stationarity(train: DataFrame, model: TransactionModel,
                 regs: tuple[float, ...] = (0.01,)) -> DataFrame:
    """(position, input, gradient) of the fitted objective at the model's coefficients.

    The objective is the class-weighted mean loss plus reg / 2 times the squared
    weights; its gradient vanishes at the optimum only. Of several `regs` the
    one with the smallest gradients is taken.
    """
    inputs = normalised_inputs(model.scaler, None)
    weight = class_weights(train, "is_fraud").select("weight_pos")
    rows = train.join(F.broadcast(weight)).withColumn(
        "_w", F.when(F.col("is_fraud") == 1, F.col("weight_pos")).otherwise(1.0)).withColumn(
        "_off", F.col("_w") * (model.probability(inputs) - F.col("is_fraud")))
    names = ["intercept", *C.MODEL_INPUTS]
    sums = rows.agg(F.sum("_w").alias("w"), *[
        F.sum(F.col("_off") * x).alias(f"g{i}") for i, x in enumerate([F.lit(1.0), *inputs])])
    found = []
    for reg in regs:
        pull = [0.0, *[reg * v for v in model.weights]]
        gradient = F.array(*[F.abs(F.col(f"g{i}") / F.col("w") + v) for i, v in enumerate(pull)])
        found.append(F.struct(F.array_max(gradient).alias("most"), gradient.alias("g")))
    best = sums.select(F.least(*found).alias("b") if len(found) > 1 else found[0].alias("b"))
    return best.select(F.posexplode("b.g").alias("position", "gradient")).select(
        "position", F.get(F.array(*map(F.lit, names)), F.col("position")).alias("input"), "gradient")
