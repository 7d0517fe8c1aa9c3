"""Classification metrics of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators import daily as D
from spendtrace.operators.history import running_total, split_history
from spendtrace.session import materialize


def confusion(rows: DataFrame, probability: str, label: str,
              threshold: float = C.DECISION_THRESHOLD) -> DataFrame:
    """One row with the four counts; a probability equal to the threshold is positive."""
    predicted = F.col(probability) >= threshold
    actual = F.col(label) == 1
    return rows.agg(
        F.count_if(~actual & ~predicted).alias("true_negative"),
        F.count_if(~actual & predicted).alias("false_positive"),
        F.count_if(actual & ~predicted).alias("false_negative"),
        F.count_if(actual & predicted).alias("true_positive"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1_score, test_set_size, fraud_rate_pct; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in (
        "true_negative", "false_positive", "false_negative", "true_positive"))

    def ratio(above: Column, below: Column) -> Column:
        return F.when(below > 0, above / below).otherwise(0.0)

    size = tn + fp + fn + tp
    return counts.select(
        "*",
        F.round(ratio(tp, tp + fp), 4).alias("precision"),
        F.round(ratio(tp, tp + fn), 4).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1_score"),
        size.alias("test_set_size"),
        F.round(ratio((tp + fn) * 100, size), 3).alias("fraud_rate_pct"))


def auc_roc(rows: DataFrame, probability: str, label: str,
            max_rows: int | None = None) -> DataFrame:
    """One row with the exact area under the ROC curve; ties count half, null for one class.

    Rows are combined per distinct score first. The running count over scores is
    one window while it is small and is cut into ranges of scores beyond that.
    """
    scores = materialize(rows.groupBy(F.col(probability).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) != 1).alias("_neg"),
    ), "scores").withColumn("_all", F.lit(0))
    ranked = running_total(split_history(
        scores, key="_all", order=("_score",), max_rows=max_rows), "_neg", "_below")
    pairs = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    positives, negatives = F.sum("_pos"), F.sum("_neg")
    return ranked.rows().agg(
        F.when((positives > 0) & (negatives > 0),
               F.round(pairs / positives / negatives, 4)).alias("auc_roc"))


def auc_by(rows: DataFrame, key: str, score: str, label: str, max_rows: int | None = None) -> DataFrame:
    """(key, auc_roc): the exact area, not rounded, for each value of `key`.

    Scores are combined per key and value first; a key with very many different
    scores is cut into ranges of them.
    """
    scores = materialize(rows.groupBy(key, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) != 1).alias("_neg")), "scores")
    ranked = running_total(split_history(
        scores, key=key, order=("_score",), max_rows=max_rows), "_neg", "_below")
    pairs = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    positives, negatives = F.sum("_pos"), F.sum("_neg")
    return ranked.rows().groupBy(key).agg(F.when(
        (positives > 0) & (negatives > 0), pairs / positives / negatives).alias("auc_roc"))


def metrics(rows: DataFrame, probability: str, label: str, model: str,
            threshold: float = C.DECISION_THRESHOLD) -> DataFrame:
    """The metrics record of one model: a single row, confusion matrix nested."""
    counts = rates(confusion(rows, probability, label, threshold))
    return counts.select(
        F.lit(model).alias("model"), "precision", "recall", "f1_score",
        auc_roc(rows, probability, label).scalar().alias("auc_roc"),
        F.struct("true_negative", "false_positive", "false_negative", "true_positive")
        .alias("confusion_matrix"),
        "test_set_size", "fraud_rate_pct", F.lit(threshold).alias("threshold"))


def feature_summary(features: DataFrame, columns: list[str],
                    max_rows: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column, one row each.

    Quartiles are exact and interpolate. Buckets of values, combined before their
    shuffle, tell in which bucket the rows around a quartile lie. Only the rows of
    those buckets are counted by value, and not where a bucket has one value; running
    counts over them are cut into ranges when there are many.
    """
    placed = materialize(D.placed_buckets(D.value_buckets(features, columns)), "buckets")
    ranks = D.quartile_ranks()
    held = F.array(*[F.struct(F.lit(name).alias("name"), rank.alias("rank")) for name, rank in ranks.items()])
    wanted = placed.select("feature", "bucket", "low", "high", "below", "n", F.explode(held).alias("r")).filter(
        (F.col("below") <= F.col("r.rank")) & (F.col("r.rank") < F.col("below") + F.col("n"))).select(
        "feature", "bucket", "low", "high", F.col("r.name").alias("name"),
        (F.col("r.rank") - F.col("below")).alias("rank"))
    known = wanted.filter("low <=> high").select("feature", "name", F.col("low").alias("value"))
    # At most one row per column and rank: a short list, whatever the size of the table.
    spans = sorted({(r.feature, r.bucket, r.low, r.high)
                    for r in wanted.filter("not low <=> high").collect()})
    if spans:
        rows = features.select(F.explode(F.array(*[F.when(
            F.col(c).cast("double").between(low, high),
            F.struct(F.concat_ws(" ", F.lit(c), F.lit(bucket)).alias("span"), F.col(c).cast("double").alias("value")))
            for c, bucket, low, high in spans])).alias("p")).filter("p is not null").select("p.*")
        counts = materialize(rows.groupBy("span", "value").agg(F.count("*").alias("_n")), "values")
        ranked = running_total(split_history(
            counts, key="span", order=("value",), max_rows=max_rows), "_n", "_below").rows()
        asked = wanted.select("feature", "name", "rank", F.concat_ws(" ", "feature", "bucket").alias("span"))
        known = known.unionByName(ranked.join(F.broadcast(asked), "span").filter(
            (F.col("_below") <= F.col("rank")) & (F.col("rank") < F.col("_below") + F.col("_n"))).select(
            "feature", "name", "value"))
    found = known.groupBy("feature").pivot("name", list(ranks)).agg(F.first("value"))
    return D.moments(placed).join(found, "feature").select(
        "feature", "count", "mean", "std", "min", *D.between_ranks(), "max")


def dataset_size(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_rows"),
                   F.countDistinct("customer_id").alias("n_customers"),
                   F.round(F.avg("is_fraud") * 100, 3).alias("fraud_rate_pct"))
