"""How much each model input moved a score, relative to background rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spendtrace import contract as C
from spendtrace.functions.columns import display_name
from spendtrace.operators.learn import TransactionModel, normalised_inputs
from spendtrace.operators.trees import TreeModel, tree_contributions


def logit_contributions(model: TransactionModel, background: list[list[float]]) -> list[Column]:
    """Exact contributions on the logit: weight times distance from the background mean."""
    means = [sum(column) / len(background) for column in zip(*background)]
    return [(x - m) * w
            for x, m, w in zip(normalised_inputs(model.scaler), means, model.weights)]


def add_probability_contributions(rows: DataFrame, model: TransactionModel | TreeModel,
                                  background: list[list[float]],
                                  when: Column | None = None,
                                  name: str = "contributions") -> DataFrame:
    """How much each input moved the probability, as one array in input order.

    For each background row b the change of the logit is split among the inputs
    and scaled to the change of the probability by the slope
    s_b = (p(x) - p(b)) / (logit(x) - logit(b)); the contributions are the means
    over the background. So nothing is sampled and they add up to p(x) minus the
    mean background probability. Rows for which `when` does not hold, or with a
    null input, get null.

    For the linear model the part of input i is its weight times (x_i - b_i), and
    the result is the expected gradient of the probability; a row needs eleven
    sums over the background, of s_b and of s_b * b_i for each input, one matrix
    product per batch of rows. For trees it is the Shapley value of the input
    between x and b, see `tree_contributions`.
    """
    logits = np.array([model.background_value(b) for b in background])
    probabilities = 1.0 / (1.0 + np.exp(-logits))
    split = _tree_split if isinstance(model, TreeModel) else _linear_split

    @pandas_udf("array<double>")
    def explained(logit: pd.Series, probability: pd.Series, wanted: pd.Series,
                  *inputs: pd.Series) -> pd.Series:
        x = np.column_stack([i.to_numpy(dtype=float, na_value=np.nan) for i in inputs])
        out = np.full(len(logit), None, dtype=object)
        use = wanted.fillna(False).to_numpy(dtype=bool) & ~np.isnan(x).any(axis=1)
        if use.any():
            step = logit.to_numpy(dtype=float)[use, None] - logits
            rise = probability.to_numpy(dtype=float)[use, None] - probabilities
            flat = np.abs(step) <= 1e-9
            slopes = np.where(flat, probabilities * (1 - probabilities),
                              rise / np.where(flat, 1.0, step))
            moved = split(model, x[use], np.array(background, dtype=float), slopes / len(background))
            for i, values in zip(np.flatnonzero(use), moved):
                out[i] = values
        return pd.Series(out)

    inputs = normalised_inputs(model.scaler)
    wanted = F.lit(True) if when is None else when
    return rows.withColumn(name, explained(
        model.logit(inputs), model.probability(inputs), wanted, *inputs))


def _linear_split(model: TransactionModel, x: np.ndarray, background: np.ndarray,
                  slopes: np.ndarray) -> np.ndarray:
    # Measured from the first background row, so that an input on which all rows
    # agree moves nothing at all.
    start = background[0]
    moved = (x - start) * slopes.sum(axis=1, keepdims=True) - slopes @ (background - start)
    return moved * np.array(model.weights)


def _tree_split(model: TreeModel, x: np.ndarray, background: np.ndarray,
                slopes: np.ndarray) -> np.ndarray:
    parts = [tree_contributions(model, x[i:i + 4096], background, slopes[i:i + 4096])
             for i in range(0, len(x), 4096)]
    return np.concatenate(parts)


def top_reasons(contributions: Column, top: int = C.TOP_REASONS) -> Column:
    """The largest positive contributions, largest first; empty when there are none."""
    named = F.transform(contributions, lambda value, i: F.struct(
        (-value).alias("order"), i.alias("position"), value.alias("attribution")))
    positive = F.filter(named, lambda r: r["attribution"] > 0)
    names = F.array(*[F.lit(c) for c in C.MODEL_INPUTS])

    def reason(r: Column) -> Column:
        feature = F.get(names, r["position"])
        return F.struct(feature.alias("feature"), display_name(feature).alias("display_name"),
                        r["attribution"].alias("attribution"))

    ranked = F.transform(F.slice(F.array_sort(positive), 1, top), reason)
    return F.coalesce(ranked, F.array().cast(C.REASON_TYPE))


def reasons_long(scored: DataFrame) -> DataFrame:
    """One row per reason: rank 1 is the strongest."""
    return (scored.select("transaction_id", F.posexplode("reasons").alias("_i", "r"))
            .select("transaction_id", (F.col("_i") + 1).alias("rank"), "r.*"))


def reasons_for_display(scored: DataFrame) -> DataFrame:
    """Chart order: rounded to four decimals, smallest bar first."""
    bars = F.array_sort(F.transform("reasons", lambda r: F.struct(
        F.round(r["attribution"], 4).alias("value"), r["display_name"].alias("name"))))
    return (scored.select("transaction_id", F.posexplode(bars).alias("_i", "b"))
            .select("transaction_id", (F.col("_i") + 1).alias("position"),
                    F.col("b.name").alias("name"), F.col("b.value").alias("value")))
