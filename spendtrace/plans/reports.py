"""Analyst-facing queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators.evaluate import metrics
from spendtrace.operators.learn import TransactionModel, normalised_inputs
from spendtrace.sources.readers import path_exists
from spendtrace.sources.writers import save_metrics


def customers(log: DataFrame, limit: int = C.CUSTOMER_LIST_LIMIT) -> DataFrame:
    """The first customer ids in order; `n_customers` counts all of them."""
    ids = log.select("customer_id").distinct()
    count = ids.agg(F.count("*").alias("n")).scalar()
    return ids.orderBy("customer_id").limit(limit).withColumn("n_customers", count)


def customer_timeline(scored: DataFrame, customer_id,
                      limit: int = C.TIMELINE_LIMIT) -> DataFrame:
    """Scored transactions of a customer, oldest first; the limit keeps the oldest."""
    return (
        scored.filter(F.col("customer_id") == F.lit(customer_id))
        .select("transaction_id", "timestamp", "risk_score", "fraud_probability", "alert_level")
        .orderBy("timestamp", "transaction_id").limit(limit)
    )


def report_rows(scored: DataFrame) -> DataFrame:
    """The explanation report of each transaction: section, position, label, value, meaning."""
    def pct(column: str) -> Column:
        return F.concat(F.format_number(column, 1), F.lit("%"))

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("-"))

    def line(section: str, position: int, label: str, value: Column,
             meaning: str | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(position).alias("position"),
            F.lit(label).alias("label"), value.alias("value"),
            F.lit(meaning).cast("string").alias("meaning"))

    details = "Transaction Details"
    risk = "Risk Assessment"
    reasons = "Reasons"
    score_text = F.concat(F.format_number("risk_score", 1), F.lit(" / 100"))
    fixed = [
        line("Alert", 1, "Alert Level", F.coalesce("alert_level", F.lit("Unknown"))),
        line(details, 1, "Transaction ID", text("transaction_id")),
        line(details, 2, "Customer ID", text("customer_id")),
        line(details, 3, "Timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
        line(details, 4, "Amount", F.concat(F.lit("Rs. "), F.format_number("amount", 2))),
        line(details, 5, "Merchant Category", F.replace(
            text("merchant_category"), F.lit("_"), F.lit(" "))),
        line(details, 6, "Device ID", text("device_id")),
        line(details, 7, "Location", text("location")),
        line(details, 8, "Failed Logins (24h)", text("failed_logins_24h")),
        *[line(risk, i, name, value, C.METRIC_MEANINGS[name])
          for i, (name, value) in enumerate([
              ("Risk Score", score_text), ("Fraud Probability", pct("fraud_probability")),
              ("Behavioral Similarity", pct("similarity_pct")),
              ("Deviation", pct("deviation_pct"))], start=1)],
    ]
    why = F.transform("reasons", lambda r, i: F.struct(
        F.lit(reasons).alias("section"), (i + 1).alias("position"),
        r["display_name"].alias("label"),
        F.format_string("%+.3f", r["attribution"]).alias("value"),
        F.lit(None).cast("string").alias("meaning")))
    none = F.array(line(reasons, 1, C.NO_REASONS_SENTENCE, F.lit(None).cast("string")))
    all_lines = F.concat(
        F.array(*fixed), F.when(F.size("reasons") > 0, why).otherwise(none))
    return scored.select("transaction_id", F.explode(all_lines).alias("l")).select(
        "transaction_id", "l.*")


def model_metrics(test_rows: DataFrame, transaction: TransactionModel) -> DataFrame:
    """Metrics of both models on held-out rows with features, p_trajectory and is_fraud.

    Inputs are limited as in scoring, the probability is not capped.
    """
    scored = test_rows.withColumn("p_transaction", transaction.probability(
        normalised_inputs(transaction.scaler)))
    return metrics(scored, "p_trajectory", "is_fraud", "trajectory").unionByName(
        metrics(scored, "p_transaction", "is_fraud", "transaction"))


def stored_metrics(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                   refresh: bool = False) -> DataFrame:
    """The stored metrics table; computed when absent or on refresh."""
    if refresh or not path_exists(spark, path):
        save_metrics(compute(), path)
    return spark.read.parquet(path)
