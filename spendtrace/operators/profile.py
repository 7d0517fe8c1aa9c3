"""A customer's own profile and the similarity of a transaction to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import total
from spendtrace.operators.history import (
    History, join_carry, merge_moments, positions, split_history,
)

# Spark's own default for limiting the rows of a window before its shuffle.
GROUP_LIMIT = 1000


def prior_profile(history: History) -> History:
    """_mean_x and _std_x (population) of each feature over the rows before; null without any."""
    prior = history.ordered().rowsBetween(Window.unboundedPreceding, -1)
    raw = {}
    for f in C.FEATURES:
        raw[f"_mean_{f}"] = F.avg(f).over(prior)
        raw[f"_std_{f}"] = F.stddev_pop(f).over(prior)
    whole = history.whole.withColumns(raw)
    written, history = history, history.dealt()
    cut = history.cut
    if cut is not None:
        prior = history.run_ordered().rowsBetween(Window.unboundedPreceding, -1)
        inside = {}
        for f in C.FEATURES:
            inside[f"_n_{f}"] = F.count(f).over(prior)
            inside[f"_avg_{f}"] = F.avg(f).over(prior)
            inside[f"_var_{f}"] = F.var_pop(f).over(prior)
        merged = {}
        for f in C.FEATURES:
            count, mean, m2 = merge_moments(
                F.col(f"{f}_n0"), F.col(f"{f}_mean0"), F.col(f"{f}_m20"),
                F.col(f"_n_{f}"), F.col(f"_avg_{f}"), F.col(f"_var_{f}") * F.col(f"_n_{f}"))
            merged[f"_mean_{f}"] = mean
            merged[f"_std_{f}"] = F.sqrt(m2 / count)
        cut = (
            cut.withColumns(inside)
            .transform(join_carry, written.carried_moments(C.FEATURES), history.key)
            .withColumns(merged)
            .drop(*inside, *[f"{f}_{x}" for f in C.FEATURES for x in ("n0", "mean0", "m20")])
        )
    return history.derive(whole, cut)


def settle_profile(history: History) -> History:
    """mean_x and std_x from the columns of `prior_profile`, which leave."""
    n = F.col("n_prior")
    final = {}
    for f in C.FEATURES:
        final[f"mean_{f}"] = F.when(n > 0, F.col(f"_mean_{f}")).otherwise(0.0)
        final[f"std_{f}"] = F.when(n > 1, F.col(f"_std_{f}")).otherwise(1.0)
    raw = [f"_{kind}_{f}" for f in C.FEATURES for kind in ("mean", "std")]
    return history.map(lambda rows: rows.withColumns(final).drop(*raw))


def add_profile(history: History) -> History:
    """mean_x and std_x (population) of each feature over the rows before.

    No earlier row gives mean 0 and deviation 1, one earlier row deviation 1.
    """
    return settle_profile(prior_profile(history))


def profile_columns() -> list[str]:
    return [f"{kind}_{f}" for f in C.FEATURES for kind in ("mean", "std")]


def mean_deviation() -> Column:
    """Mean absolute z of the features against mean_x and std_x."""
    def z(f: str) -> Column:
        std = F.when(F.col(f"std_{f}") <= 1e-6, 1.0).otherwise(F.col(f"std_{f}"))
        return F.abs((F.col(f) - F.col(f"mean_{f}")) / std)
    return total([z(f) for f in C.FEATURES]) / len(C.FEATURES)


def add_similarity(rows: DataFrame, digits: int = 3) -> DataFrame:
    """similarity_pct, deviation_pct and avg_z_deviation from the profile columns."""
    similarity = F.round(100 * F.exp(-F.col("_avg_z") / C.SIMILARITY_DECAY), 2)
    return (
        rows.withColumn("_avg_z", mean_deviation())
        .withColumn("similarity_pct", similarity)
        .withColumn("deviation_pct", F.round(100 - F.col("similarity_pct"), 2))
        .withColumn("avg_z_deviation", F.round("_avg_z", digits))
        .drop("_avg_z")
    )


def customer_profile(features: DataFrame, first_rows: int | None = None,
                     order: tuple[str, ...] = ("timestamp", "transaction_id"),
                     max_rows: int | None = None) -> DataFrame:
    """Profile per customer: n_rows, mean_x and sample std_x of each feature.

    `first_rows` keeps the earliest rows of each customer only. Up to
    `GROUP_LIMIT` the filter on the row number limits rows before the shuffle;
    beyond it large customers are cut into runs.
    """
    if first_rows is not None and first_rows > GROUP_LIMIT:
        numbered = positions(split_history(features, order=order, max_rows=max_rows), "_nth")
        features = numbered.rows().filter(F.col("_nth") < first_rows)
    elif first_rows is not None:
        oldest = Window.partitionBy("customer_id").orderBy(*order)
        features = (features.withColumn("_nth", F.row_number().over(oldest))
                    .filter(F.col("_nth") <= first_rows))
    aggregates = [F.count("*").alias("n_rows")]
    for f in C.FEATURES:
        aggregates += [F.avg(f).alias(f"mean_{f}"),
                       F.coalesce(F.stddev_samp(f), F.lit(1.0))
                       .alias(f"std_{f}")]
    return features.groupBy("customer_id").agg(*aggregates)


def profile_for(customers: DataFrame, profile: DataFrame) -> DataFrame:
    """Profiles of the listed customers; an unknown one gets mean 0 and deviation 1."""
    joined = customers.join(profile, "customer_id", "left")
    defaults = {"n_rows": 0}
    for f in C.FEATURES:
        defaults |= {f"mean_{f}": 0.0, f"std_{f}": 1.0}
    return joined.fillna(defaults)


def long_profile(profile: DataFrame) -> DataFrame:
    """One row per customer and feature: feature, mean, std."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"),
                 F.col(f"std_{f}").alias("std")) for f in C.FEATURES])).alias("p")
    return profile.select("customer_id", "n_rows", pairs).select("customer_id", "n_rows", "p.*")
