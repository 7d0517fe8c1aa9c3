"""Replay a stored log as a stream that arrives in slices of time.

Each slice is one run of the streaming query on the same checkpoint, so every
run after the first restores its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace.operators.learn import RiskModels
from spendtrace.operators.snapshot import Snapshot
from spendtrace.session import materialize, new_folder
from spendtrace.sources.writers import read_scored
from checks import fixtures as fx
from spendtrace.streaming import sinks
from spendtrace.streaming.behaviour import (
    running_behaviour, score_checked_stream, score_stream,
)

SLICES = 3


def _arrivals(log: DataFrame, folder: str) -> Iterator[int]:
    """Write the log to `folder` in slices of equal spans of time."""
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    ends = log.agg(F.min(seconds).alias("first"), F.max(seconds).alias("last")).first()
    span = (ends["last"] - ends["first"]) / SLICES + 1
    part = F.floor((seconds - ends["first"]) / span)
    for i in range(SLICES):
        log.filter(part == i).write.mode("append").parquet(folder)
        yield i


@contextmanager
def _state_partitions(spark: SparkSession) -> Iterator[None]:
    """One state partition per core: streams do not merge small partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _replayed(spark: SparkSession, log: DataFrame, run: Callable[[DataFrame, str], object]) -> None:
    log = materialize(log, "log")
    folder, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "stream")
    for _ in _arrivals(log, folder):
        with _state_partitions(spark):
            stream = sinks.read_transactions(spark, folder, log.schema)
            run(stream, checkpoint).awaitTermination()


def scored(spark: SparkSession, log: DataFrame, models: RiskModels,
           snapshot: Snapshot | None = None) -> DataFrame:
    out = new_folder(spark, "scored")
    _replayed(spark, log, lambda stream, checkpoint: sinks.write_scored(
        score_stream(stream, models, fx.episode_home(), with_reasons=False, snapshot=snapshot),
        out, checkpoint))
    return read_scored(spark, out)


def behaviour(spark: SparkSession, log: DataFrame, home: Column, snapshot: Snapshot) -> DataFrame:
    """Features, profile and steps of a log as a stream that starts from a snapshot."""
    out = new_folder(spark, "behaviour")
    _replayed(spark, log, lambda stream, checkpoint: running_behaviour(
        stream, home, snapshot=snapshot).writeStream.option(
        "checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def checked(spark: SparkSession, rows: DataFrame, models: RiskModels) -> tuple[DataFrame, DataFrame]:
    """Scored and rejected rows of a raw stream."""
    out, dead = new_folder(spark, "scored"), new_folder(spark, "rejected")
    _replayed(spark, rows, lambda stream, checkpoint: sinks.write_checked(
        score_checked_stream(stream, models, fx.episode_home(), with_reasons=False),
        out, dead, checkpoint))
    return read_scored(spark, out), sinks.read_rejected(spark, dead)


def scored_in_order(spark: SparkSession, sf_dir: str, models: RiskModels,
                    parts: int = 4) -> DataFrame:
    """The log in shuffled parts, one per micro-batch, scored in event order.

    Every part is as many files as tasks can write side by side. The delay covers
    the whole log; a last file far in the future moves the watermark past every row.
    """
    log = fx.episode_log(spark, sf_dir)
    log = materialize(log.withColumn("timestamp", F.col("timestamp").cast("timestamp")), "log")
    folder, out, checkpoint = (new_folder(spark, n) for n in ("arrivals", "scored", "stream"))
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(parts))
    files = min(spark.sparkContext.defaultParallelism, log.rdd.getNumPartitions())
    for i in range(parts):
        log.filter(part == i).coalesce(files).write.mode("append").parquet(folder)
    end = log.limit(1).withColumns({
        "timestamp": F.col("timestamp") + F.expr("interval 4000 days"),
        "transaction_id": F.lit(-1).cast("bigint"), "customer_id": F.lit(-1).cast("bigint")})
    end.coalesce(1).write.mode("append").parquet(folder)
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files)
              .parquet(folder))
    with _state_partitions(spark):
        scored = score_stream(stream, models, fx.episode_home(), with_reasons=False, delay="400 days")
        (scored.writeStream.option("checkpointLocation", checkpoint).option("path", out)
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).filter(F.col("customer_id") >= 0)


def alert_counts(spark: SparkSession, log: DataFrame, models: RiskModels) -> DataFrame:
    rows = scored(spark, log, models)
    out = new_folder(spark, "alerts")
    _replayed(spark, rows, lambda stream, checkpoint: sinks.count_alerts(stream, out, checkpoint))
    return sinks.stored_alert_counts(spark, out)


def rings(spark: SparkSession, log: DataFrame) -> DataFrame:
    out = new_folder(spark, "devices")
    _replayed(spark, log, lambda stream, checkpoint: sinks.count_devices(stream, out, checkpoint))
    return sinks.running_rings(spark, out)
