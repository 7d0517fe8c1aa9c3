"""Trees as plain numbers: scored as column expressions and explained exactly.

A `TreeModel` stands wherever the linear transaction model stands: in scoring of
logs, batches and streams, in attribution, and in the store of models.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import logistic, total
from spendtrace.operators.learn import Scaler, normalised_inputs


def tree_value(tree: list[list[float]], inputs, at: int = 0) -> Column:
    """The value of a tree; `inputs` gives the column of a number. A null goes to the right."""
    node = tree[at]
    if len(node) == 1:
        return F.lit(float(node[0]))
    side, threshold, left, right = node
    return F.when(inputs[int(side)] <= F.lit(float(threshold)), tree_value(tree, inputs, int(left))).otherwise(
        tree_value(tree, inputs, int(right)))


@dataclass(frozen=True)
class TreeModel:
    """Sum of trees on the ten scaled inputs, as a logit.

    A tree is a list of nodes, the root first: [input, threshold, left, right] of
    a split, whose left side has values up to the threshold, or [value] of a leaf.
    """

    intercept: float
    trees: list[list[list[float]]]
    scaler: Scaler = field(default_factory=lambda: [(0.0, 1.0)] * len(C.MODEL_INPUTS))

    def logit(self, inputs: list[Column]) -> Column:
        """Nested conditions, one path of which is evaluated per tree."""
        return total([F.lit(float(self.intercept)), *[tree_value(t, inputs) for t in self.trees]])

    def probability(self, inputs: list[Column]) -> Column:
        return logistic(self.logit(inputs))

    def served_probability(self) -> Column:
        """With limited inputs and below certainty, as scoring reports it."""
        return F.least(self.probability(normalised_inputs(self.scaler)), F.lit(C.PROBABILITY_CAP))

    def background_value(self, row: list[float]) -> float:
        return float(self.logits(np.array([row], dtype=float))[0])

    def logits(self, x: np.ndarray) -> np.ndarray:
        found = np.full(len(x), float(self.intercept))
        for leaf in self.leaves:
            found[leaf.inside(x).all(axis=1)] += leaf.value
        return found

    @cached_property
    def leaves(self) -> list[Leaf]:
        found = []
        for tree in self.trees:
            stack = [(0, {})]
            while stack:
                at, box = stack.pop()
                node = tree[at]
                if len(node) == 1:
                    found.append(Leaf(float(node[0]), box))
                    continue
                i, threshold = int(node[0]), float(node[1])
                low, high = box.get(i, (-math.inf, math.inf))
                stack.append((int(node[2]), {**box, i: (low, min(high, threshold))}))
                stack.append((int(node[3]), {**box, i: (max(low, threshold), high)}))
        return found


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and its box: the (low, high] of each input on the way to it."""

    value: float
    box: dict[int, tuple[float, float]]

    @cached_property
    def inputs(self) -> list[int]:
        return sorted(self.box)

    def inside(self, x: np.ndarray) -> np.ndarray:
        """Whether each input of each row lies in the leaf's range; a null is to the right."""
        low, high = (np.array([self.box[i][k] for i in self.inputs]) for k in (0, 1))
        own = x[:, self.inputs]
        missing = np.isnan(own)
        return np.where(missing, high == np.inf, (own > low) & (own <= high))

    def pattern(self, x: np.ndarray) -> np.ndarray:
        """The answers of `inside` as one number per row."""
        return self.inside(x) @ (1 << np.arange(len(self.inputs)))

    @cached_property
    def shares(self) -> np.ndarray:
        """[row's pattern, background's pattern, input]: the inputs' Shapley values at this leaf.

        With each input from the row or from the background, the leaf is reached
        if the u inputs that only the row has inside come from the row and the v
        that only the background has inside from the background. Of all orders,
        (u-1)! v! / (u+v)! reach it by the step of a certain one of the u, and
        u! (v-1)! / (u+v)! leave it by that of a certain one of the v.
        """
        k = len(self.inputs)
        table = np.zeros((1 << k, 1 << k, k))
        for own, other in itertools.product(range(1 << k), repeat=2):
            rows = [i for i in range(k) if own >> i & 1 and not other >> i & 1]
            others = [i for i in range(k) if other >> i & 1 and not own >> i & 1]
            if (own | other) != (1 << k) - 1 or not rows + others:
                continue
            u, v, f = len(rows), len(others), math.factorial
            for i in rows:
                table[own, other, i] = self.value * f(u - 1) * f(v) / f(u + v)
            for i in others:
                table[own, other, i] = -self.value * f(u) * f(v - 1) / f(u + v)
        return table


def tree_contributions(model: TreeModel, x: np.ndarray, background: np.ndarray,
                       weights: np.ndarray | None = None) -> np.ndarray:
    """Shapley value of each input of each row on the logit, weighed over the background.

    `weights` has a number per row and background row, by default one over their
    number. For one background row a leaf's part depends only on which inputs on
    its way are inside for the row and for the background row, so the background
    is summed by pattern: a row costs a few numbers per leaf, whatever the inputs.
    """
    if weights is None:
        weights = np.full((len(x), len(background)), 1.0 / len(background))
    out = np.zeros((len(x), x.shape[1]))
    for leaf in model.leaves:
        if leaf.inputs:
            patterns = leaf.pattern(background)
            by_pattern = np.zeros((len(background), 1 << len(leaf.inputs)))
            by_pattern[np.arange(len(background)), patterns] = 1.0
            shares = leaf.shares[leaf.pattern(x)]
            out[:, leaf.inputs] += np.einsum("rp,rpi->ri", weights @ by_pattern, shares)
    return out


# Fixed demonstration trees on scaled inputs, so that scores can be checked by
# value: inputs 0 amount_zscore, 2 is_new_device, 4 is_foreign_location,
# 5 failed_logins_24h, 9 risk_score.
FIXED_TREE_INTERCEPT = -3.0
FIXED_TREES = [
    [[4, 0.5, 1, 2], [9, 0.25, 3, 4], [5, 0.5, 5, 6], [-0.6], [0.9], [1.1], [2.4]],
    [[0, 1.0, 1, 2], [2, 1.5, 3, 4], [0, 3.0, 5, 6], [-0.3], [0.8], [0.7], [1.9]],
    [[9, 1.5, 1, 2], [5, 1.0, 3, 4], [4, 0.5, 5, 6], [-0.2], [0.6], [0.5], [1.3]],
]


def fixed_tree_model(scaler: Scaler) -> TreeModel:
    return TreeModel(FIXED_TREE_INTERCEPT, FIXED_TREES, scaler)
