"""Stage 1 as boosted trees on the window, grown while the validation part gets better."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from spendtrace import contract as C
from spendtrace.functions.columns import hash_bucket, logistic
from spendtrace.operators.boosted import library_nodes
from spendtrace.operators.evaluate import auc_by
from spendtrace.operators.learn import Scaler, class_weights
from spendtrace.operators.sequences import padded
from spendtrace.operators.trees import tree_value

PATIENCE = 5


@dataclass(frozen=True)
class TrajectoryTrees:
    """Trees on the flattened window: input step * features + feature, oldest step first.

    Stands wherever the linear `TrajectoryModel` stands.
    """

    intercept: float
    trees: list[list[list[float]]]
    scaler: Scaler = field(default_factory=lambda: [(0.0, 1.0)] * len(C.FEATURES))

    def values(self, steps: Column) -> Column:
        """The value of each tree, an array; the window is flattened once per row."""
        def of(window: Column) -> Column:
            inputs = _Inputs(window)
            return F.array(*[tree_value(t, inputs) for t in self.trees])

        return F.element_at(F.transform(F.array(F.flatten(padded(steps))), of), 1)

    def probability(self, steps: Column) -> Column:
        """From the steps before the row, padded when there are fewer than ten."""
        return logistic(F.aggregate(self.values(steps), F.lit(float(self.intercept)), lambda a, v: a + v))

    def risk_score(self, steps: Column) -> Column:
        return F.round(self.probability(steps) * 100, 2)


class _Inputs:
    """Entries of a window by number, as `tree_value` asks for them."""

    def __init__(self, window: Column):
        self.window = window

    def __getitem__(self, i: int) -> Column:
        return F.get(self.window, F.lit(i))


@dataclass(frozen=True)
class Grown:
    """The model, and (step, AUC on the validation part) of every number of trees."""

    model: TrajectoryTrees
    curve: list[tuple[int, float]]
    chosen: int
    stopped: int


def best_step(curve: list[tuple[int, float]], patience: int = PATIENCE) -> tuple[int, int]:
    """(chosen, stopped): watching stops `patience` steps after the best one so far."""
    best, chosen = float("-inf"), 0
    for step, auc in curve:
        if auc > best:
            best, chosen = auc, step
        elif step - chosen >= patience:
            return chosen, step
    return chosen, curve[-1][0]


def grow_trajectory_trees(sequences: DataFrame, max_steps: int = 30, depth: int = 3,
                          patience: int = PATIENCE) -> Grown:
    """Fit P(row is fraud | ten rows before it), a tree per step, on the training windows.

    `sequences` has transaction_id, seq and label. Trees are fitted by MLlib on
    the class-weighted windows outside the validation part, which a hash of the
    id decides. The area under the ROC curve of that part is taken after each
    tree, from one pass over it; watching stops when it has not risen for
    `patience` steps, and the trees up to the best step are kept. The windows
    are held by the executors during the fit only.
    """
    weight = class_weights(sequences, "label").first()["weight_pos"]
    part = hash_bucket("transaction_id", 1 << 20) % 100 < C.VALIDATION_PERCENT
    table = sequences.filter(~part).select(
        array_to_vector(F.flatten("seq")).alias("features"), F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, weight).otherwise(1.0).alias("weight")).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = GBTClassifier(weightCol="weight", maxIter=max_steps, maxDepth=depth, seed=42).fit(table)
    finally:
        table.unpersist()
    trees = [library_nodes(t._call_java("rootNode"), 2.0 * w)
             for t, w in zip(fitted.trees, fitted.treeWeights)]
    whole = TrajectoryTrees(0.0, trees)
    curve = validation_curve(whole, sequences.filter(part))
    if not curve:  # one class only, so nothing to watch
        return Grown(whole, [], len(trees), len(trees))
    chosen, stopped = best_step(curve, patience)
    return Grown(TrajectoryTrees(0.0, trees[:chosen]), curve, chosen, stopped)


def validation_curve(model: TrajectoryTrees, sequences: DataFrame) -> list[tuple[int, float]]:
    """(step, AUC) of the first 1, 2, ... trees on windows with a label."""
    running = F.aggregate(
        model.values(F.col("seq")), F.array().cast("array<double>"),
        lambda sums, v: F.concat(sums, F.array(F.coalesce(F.element_at(
            F.concat(F.array(F.lit(model.intercept)), sums), -1), F.lit(0.0)) + v)))
    scores = sequences.select("label", F.posexplode(running).alias("_i", "score")).select(
        (F.col("_i") + 1).alias("step"), "label", "score")
    return sorted((r["step"], r["auc_roc"]) for r in auc_by(scores, "step", "score", "label").collect()
                  if r["auc_roc"] is not None)


# Fixed demonstration trees on the window, so that scores can be checked by value:
# input = step * 9 + feature, step 9 the latest.
FIXED_WINDOW_TREES = [
    [[9 * 9 + 4, 0.5, 1, 2], [8 * 9 + 5, 1.5, 3, 4], [9 * 9 + 0, 1.0, 5, 6], [-1.5], [0.4], [0.8], [2.2]],
    [[0 * 9 + 8, 120.0, 1, 2], [5 * 9 + 7, 0.5, 3, 4], [7 * 9 + 2, 0.5, 5, 6], [-0.7], [0.1], [0.3], [1.4]],
]
FIXED_WINDOW_INTERCEPT = -1.0


def fixed_trajectory_trees() -> TrajectoryTrees:
    return TrajectoryTrees(FIXED_WINDOW_INTERCEPT, FIXED_WINDOW_TREES)
