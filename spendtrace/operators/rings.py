"""Devices shared by several customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators.history import find_large, positions, split_history
from spendtrace.session import materialize


def device_counts(log: DataFrame) -> DataFrame:
    """Transactions per (device, customer); rows without a device do not count."""
    return (log.filter(F.col("device_id").isNotNull())
            .groupBy("device_id", "customer_id").agg(F.count("*").alias("n_txn")))


def ring_sizes(counts: DataFrame, min_customers: int = C.MIN_RING_CUSTOMERS) -> DataFrame:
    """Shared devices with their number of customers and transactions."""
    return (
        counts.groupBy(F.col("device_id").alias("identifier"))
        .agg(F.count("*").alias("n_customers"), F.sum("n_txn").alias("transaction_count"))
        .filter(F.col("n_customers") >= min_customers)
        .select(F.lit("shared_device").alias("ring_type"), "identifier", "n_customers",
                "transaction_count")
    )


def ring_members(counts: DataFrame, min_customers: int = C.MIN_RING_CUSTOMERS,
                 max_rows: int | None = None) -> DataFrame:
    """One row per ring and customer, for rings of any size.

    `position` counts the customers of a ring from 0 in the order of their ids;
    a very large ring is cut into runs for that. The sizes of devices with very many customers are broadcast, so their rows
    are not brought together for the join.
    """
    counts = materialize(counts, "device-counts")
    large = find_large(counts, "device_id", max_rows)
    sizes = materialize(ring_sizes(counts, min_customers), "ring-sizes")
    same = F.col("device_id") == F.col("identifier")
    if large.keys is None:
        members = counts.join(sizes, same)
    else:
        # as many rows as there are large keys, at most
        large_sizes = large.only(sizes.withColumn("device_id", F.col("identifier")), "device_id")
        members = large.without(counts, "device_id").join(sizes, same).unionByName(
            large.only(counts, "device_id").join(
                F.broadcast(large_sizes.drop("device_id")), same))
    placed = positions(split_history(
        materialize(members, "ring-members"), key="identifier", order=("customer_id",),
        max_rows=max_rows), "position").rows()
    return placed.select("ring_type", "identifier", "position", "customer_id", "n_txn",
                         "n_customers", "transaction_count")


def rings(log: DataFrame, min_customers: int = C.MIN_RING_CUSTOMERS) -> DataFrame:
    """One record per ring of any size, largest first; `ring_members` lists the customers."""
    return largest_first(ring_sizes(device_counts(log), min_customers))


def largest_first(sizes: DataFrame) -> DataFrame:
    return sizes.orderBy(F.desc("n_customers"), F.desc("transaction_count"), "identifier")


def ring_pages(members: DataFrame, page_size: int) -> DataFrame:
    """The customers of each ring as lists of `page_size`, in order across pages."""
    return (
        members.withColumn("page", F.floor(F.col("position") / page_size).cast("int"))
        .groupBy("ring_type", "identifier", "n_customers", "transaction_count", "page")
        .agg(F.sort_array(F.collect_list("customer_id")).alias("customer_ids"))
    )
