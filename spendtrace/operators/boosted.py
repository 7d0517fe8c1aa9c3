"""A boosted-tree form of the transaction model, and attribution for any model."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import hash_bucket
from spendtrace.operators.learn import (
    Scaler, class_weights, normalised, read_scaler, scaler_stats,
)
from spendtrace.operators.trees import TreeModel

# Adds the column `score` to rows that have the input columns.
Score = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class BoostedModel:
    """Fitted trees over the scaled inputs."""

    trees: GBTClassificationModel
    scaler: Scaler

    def score(self, rows: DataFrame, scaled: bool = False) -> DataFrame:
        """`rows` with score, the fraud probability; `scaled` if the inputs are scaled already."""
        inputs = [F.col(c).cast("double") for c in C.MODEL_INPUTS]
        if not scaled:
            inputs = [normalised(x, *s) for x, s in zip(inputs, self.scaler)]
        found = self.trees.transform(rows.withColumn("_x", array_to_vector(F.array(*inputs))))
        return found.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
            "_x", "rawPrediction", "probability", "prediction")

    def portable(self) -> TreeModel:
        """The trees as plain numbers. The library's probability is logistic(2 * margin)."""
        trees = [library_nodes(tree._call_java("rootNode"), 2.0 * weight)
                 for tree, weight in zip(self.trees.trees, self.trees.treeWeights)]
        return TreeModel(0.0, trees, self.scaler)


def library_nodes(root, scale: float) -> list[list[float]]:
    """Nodes of one of the library's trees, breadth first, its leaf values times `scale`."""
    nodes, waiting = [[]], [(0, root)]
    for at, node in waiting:
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[at] = [scale * node.prediction()]
        else:
            split, left = node.split(), len(nodes)
            nodes += [[], []]
            nodes[at] = [split.featureIndex(), split.threshold(), left, left + 1]
            waiting += [(left, node.leftChild()), (left + 1, node.rightChild())]
    return nodes


def fit_boosted_model(train: DataFrame, max_iter: int = 20, depth: int = 4) -> BoostedModel:
    """Class-weighted boosted trees; a validation part of the rows ends the boosting."""
    scaler = read_scaler(scaler_stats(train, C.MODEL_INPUTS), C.MODEL_INPUTS)
    weight = class_weights(train, "is_fraud").first()["weight_pos"]
    inputs = [normalised(F.col(c).cast("double"), *s) for c, s in zip(C.MODEL_INPUTS, scaler)]
    table = train.select(
        array_to_vector(F.array(*inputs)).alias("_x"), F.col("is_fraud").cast("double").alias("y"),
        F.when(F.col("is_fraud") == 1, weight).otherwise(1.0).alias("w"),
        (hash_bucket("transaction_id", 1 << 20) % 100 < C.VALIDATION_PERCENT).alias("held_out"))
    trees = GBTClassifier(
        featuresCol="_x", labelCol="y", weightCol="w", validationIndicatorCol="held_out",
        maxIter=max_iter, maxDepth=depth, seed=42).fit(table)
    return BoostedModel(trees, scaler)


def coalition_attribution(rows: DataFrame, key: str, inputs: list[str], score: Score,
                          background: list[list[float]], seed: int = 42) -> DataFrame:
    """(key, contributions): how much each input moved the score of a row, for any model.

    Each background row comes with one order of the inputs, an order and its
    reverse in turn. Along it the inputs change one by one from the background's
    values to the row's, and an input's contribution is the mean change of the
    score at its step. So the contributions add up to the row's score minus the
    mean background score. A row costs (inputs + 1) scores per background row:
    hand in only the rows that need reasons. Keys have to be unique.
    """
    rng, steps, order = random.Random(seed), [], list(range(len(inputs)))
    for n, values in enumerate(background):
        if n % 2:
            order = order[::-1]
        else:
            rng.shuffle(order)
        for k in range(len(inputs) + 1):
            own = [i in order[:k] for i in range(len(inputs))]
            steps.append({"own": own, "b": list(map(float, values)),
                          "came": order[k - 1] if k else -1,
                          "next": order[k] if k < len(inputs) else -1})
    plan = F.from_json(F.lit(json.dumps(steps)), (
        "array<struct<own:array<boolean>,b:array<double>,came:int,next:int>>"))
    open_ = rows.select(key, *inputs, F.explode(plan).alias("_s")).select(
        key, F.col("_s.came").alias("_came"), F.col("_s.next").alias("_next"),
        *[F.when(F.get("_s.own", F.lit(i)), F.col(c).cast("double")).otherwise(
            F.get("_s.b", F.lit(i))).alias(c) for i, c in enumerate(inputs)])
    share = 1.0 / len(background)
    moved = [F.sum(F.when(F.col("_came") == i, F.col("score")).when(
        F.col("_next") == i, -F.col("score")).otherwise(0.0)) * share for i in range(len(inputs))]
    return score(open_).groupBy(key).agg(F.array(*moved).alias("contributions"))
