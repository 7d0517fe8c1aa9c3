"""Sinks and running reports over scored transactions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendtrace.operators.rings import device_counts, largest_first, ring_sizes
from spendtrace.session import materialize
from spendtrace.sources.manifest import KeyedTable
from spendtrace.sources.writers import append_scored

ALERT_KEYS = ("day", "alert_level")
DEVICE_KEYS = ("device_id", "customer_id")


def read_transactions(spark: SparkSession, path: str, schema, bytes_per_trigger: int = 512 << 20,
                      file_format: str = "parquet") -> DataFrame:
    """Transaction files as a stream; with json, one request body per line.

    A micro-batch takes at most about `bytes_per_trigger` of files.
    """
    return (spark.readStream.schema(schema).format(file_format)
            .option("maxBytesPerTrigger", bytes_per_trigger).load(path))


def distinct_transactions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a transaction id that arrive within the delay."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["transaction_id"])


def write_scored(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch once per transaction id, also when it is run again."""
    return (scored.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, _: append_scored(batch, path))
            .trigger(availableNow=True).start())


def write_checked(rows: DataFrame, path: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """The scored and the rejected rows of `score_checked_stream`, beside each other.

    A micro-batch is computed once. Scored rows are appended once per
    transaction id; rejected ones go to a folder per micro-batch, which a batch
    that is run again replaces.
    """
    def put(batch: DataFrame, number: int) -> None:
        once = materialize(batch, "micro-batch")
        bad = once.filter(F.col("violations").isNotNull())
        append_scored(once.filter(F.col("violations").isNull()), path)
        kept = [c for c in ("customer_id", "transaction_id", "timestamp", "amount", "merchant_category",
                            "violations", "given") if c in bad.columns]
        bad.select(*kept).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return (rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
            .trigger(availableNow=True).start())


def read_rejected(spark: SparkSession, rejected: str) -> DataFrame:
    return spark.read.parquet(rejected).drop("batch")


def count_alerts(scored: DataFrame, path: str, checkpoint: str,
                 span: str = "1 day") -> StreamingQuery:
    """Running rows per alert level and time span, kept as one small table.

    A micro-batch writes the counts it has changed; see `stored_alert_counts`.
    """
    counts = (scored.groupBy(F.window("timestamp", span).alias("w"), "alert_level")
              .agg(F.count("*").alias("n"))
              .select(F.col("w.start").alias("day"), "alert_level", "n"))
    return _write_changes(counts, KeyedTable(path, ALERT_KEYS), checkpoint)


def stored_alert_counts(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(path, ALERT_KEYS).read(spark)


def count_devices(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running transactions per (device, customer), kept as one table.

    The counts are the state of the stream, so a batch that is run again counts
    once, a table from an earlier checkpoint is replaced, and a report reads one
    row per pair.
    """
    log.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _write_changes(device_counts(log), KeyedTable(path, DEVICE_KEYS), checkpoint)


def stored_device_counts(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(path, DEVICE_KEYS).read(spark)


def _write_changes(counts: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Put the changed counts of each micro-batch into a table.

    What is written follows the batch, not the table, and readers see whole
    batches. The id of the query, which its checkpoint holds, tells a batch that
    is run again from one of a new checkpoint.
    """
    def put(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"]
        table.put(batch, number, json.loads(query)["id"])

    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(put).trigger(availableNow=True).start())


def running_rings(spark: SparkSession, path: str, min_customers: int = 2) -> DataFrame:
    """Rings over all device counts stored so far."""
    return largest_first(ring_sizes(stored_device_counts(spark, path), min_customers))
