"""Fitted models as text: linear ones and trees, both stages and the background."""

from __future__ import annotations

import json
import math

from spendtrace.operators.learn import RiskModels, TrajectoryModel, TransactionModel
from spendtrace.operators.trajectory import TrajectoryTrees
from spendtrace.operators.trees import TreeModel

# The classes of a stage's model: without and with trees.
KINDS = {"trajectory": (TrajectoryModel, TrajectoryTrees), "transaction": (TransactionModel, TreeModel)}


def to_json(models: RiskModels) -> str:
    """Both models and the background; trees are told by their `trees`."""

    def numbers(model) -> dict:
        return {name: getattr(model, name) for name in model.__dataclass_fields__}

    return json.dumps({**{name: numbers(getattr(models, name)) for name in KINDS},
                       "background": models.background})


def from_json(text: str) -> RiskModels:
    found, models = json.loads(text), {}
    for name, (linear, trees) in KINDS.items():
        told = found[name]
        told["scaler"] = [tuple(s) for s in told["scaler"]]
        if not math.isfinite(told["intercept"]):
            raise ValueError(f"{name} model has no finite intercept")
        models[name] = (trees if "trees" in told else linear)(**told)
    return RiskModels(**models, background=found["background"])
