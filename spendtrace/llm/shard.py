"""Shards by jump consistent hashing, with gapless slots inside each shard.

A key's shard is found by jumping ahead along a fixed sequence of pseudo-random
numbers that depends on the key alone, so no table of the ring exists and
appending a shard moves only the rows that go into it, about 1 / (n + 1) of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spendtrace.llm.common import free_name, set_aside, table
from spendtrace.session import materialize

SHARDS = 24
ROW_OVERHEAD = 8
ROWS_PER_RUN = 1_000_000

# Fixed values of the published algorithm: its generator and its 31-bit scale.
MULTIPLIER = np.uint64(2862933555777941757)
SCALE = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. Whole arrays jump until every key has passed the end."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    reach = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = reach[moving]
            state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
            divisor = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            reach[moving] = ((shard[moving] + 1) * (SCALE / divisor)).astype(np.int64)
            moving = moving[reach[moving] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type, null included; the key is hashed to 64 bits first."""

    @pandas_udf("int")
    def jumped(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(), shards))

    return jumped(F.xxhash64(key))


def place(docs: DataFrame, shards: int = SHARDS, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row of `docs`.

    The shard depends on doc_id and the number of shards alone; `grown_shard` is
    the one with one shard more. Size is the UTF-8 bytes of the text plus 8;
    null text has 0 bytes and the crc of the empty string. A null id is a key of
    its own. Repeated rows share a shard and get slots of their own. An empty
    table gives no rows; other columns are not used.

    Slots count from 0 in each shard. A shard is cut by a hash of the row into
    runs of about `rows_per_run` rows; rows are numbered inside their run and a
    running sum over the run sizes, one short row per run, gives the offset, so
    no task sorts a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn(
        "grown_shard", shard_of(F.col("doc_id"), shards + 1))
    rows = materialize(rows, "shard-rows")
    return with_slots(rows, [F.col(c) for c in ("doc_id", "text_crc32", "size")], shards, rows_per_run).withColumn(
        "law", F.lit("key")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_slots(rows: DataFrame, key: list[Column], shards: int, rows_per_run: int) -> DataFrame:
    """Add `slot`, counting from 0 in each shard, in the order (run, key).

    `rows` is read more than once; hand in a written table.
    """
    runs = max(1, rows.count() // (shards * rows_per_run))
    run, at, n, offset = (free_name(rows, c) for c in ("_run", "_at", "_n", "_offset"))
    rows = rows.withColumn(run, F.pmod(F.xxhash64(*key), F.lit(runs)).cast("int"))
    sizes = rows.groupBy("shard", run).agg(F.count("*").alias(n))
    earlier = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard", run, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(offset))
    inside = Window.partitionBy("shard", run).orderBy(*key)
    return (
        rows.withColumn(at, F.row_number().over(inside) - 1)
        .join(offsets, ["shard", run])
        .withColumn("slot", (F.col(offset) + F.col(at)).cast("long"))
        .drop(run, at, offset)
    )


def place_rows(docs: DataFrame, shards: int = SHARDS,
               rows_per_run: int = ROWS_PER_RUN // 20) -> DataFrame:
    """All columns of `docs` with shard and slot (replaced where they exist).

    Nulls, repeats and empty tables are treated as by `place`. Runs are shorter
    here, since whole texts move with the rows.
    """
    inner, back = set_aside(docs, ("doc_id", "text"))
    kept = [column for column, name in zip(back, docs.columns) if name.lower() not in ("shard", "slot")]
    rows = inner.withColumn("shard", shard_of(F.col("doc_id"), shards))
    placed = with_slots(rows, [F.col("doc_id"), F.xxhash64("text")], shards, rows_per_run)
    return placed.select(*kept, "shard", "slot")


def shard_query(spark, folder: str) -> DataFrame:
    return place(table(spark, folder, "documents").select("doc_id", "text"))
