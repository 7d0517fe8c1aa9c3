"""Writing feature tables, sequences, scored transactions and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace import contract as C
from spendtrace.functions.columns import hash_bucket
from spendtrace.operators.learn import RiskModels
from spendtrace.operators.snapshot import Snapshot, from_rows, one_table
from spendtrace.operators.stored import from_json, to_json
from spendtrace.session import materialize
from spendtrace.sources.manifest import (
    KeyedTable, commit, files_with, listed_hashes, new_run, newest, schema_of, to_merge,
    told_schema, write_by_hash,
)

# Ids per file of the store's index.
IDS_PER_FILE = 5_000_000

# Folders of the scored store; a customer is in one of them.
CUSTOMER_BUCKETS = 64


def write_features(features: DataFrame, path: str, files: int | None = None) -> None:
    """Feature table in (customer, time) order, so customer filters skip row groups.

    Ranges over (customer, time, id) keep files even when one customer is large.
    """
    keys = ["customer_id", "timestamp", "transaction_id"]
    ranged = (features.repartitionByRange(*keys) if files is None
              else features.repartitionByRange(files, *keys))
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Windows, labels and their keys in one table."""
    sequences.write.mode("overwrite").parquet(path)


def append_scored(scored: DataFrame, path: str) -> None:
    """Append scored rows once per transaction id.

    An id that is stored already, whatever its date, is left out, so a repeated
    write adds nothing. Of new rows with one id the earliest stays, then the
    smallest by content (`conflicting_ids` reports them). Files hold one bucket
    of customers each, in (customer, time) order, so reading a customer touches
    one bucket and few row groups.

    Rows and an index of their ids are named by one manifest, so a job that ends
    half-way has appended nothing. The index lies in runs of files in the order
    of the ids' hashes, and the manifest has the first and last hash of each
    file: looking up a few ids opens one file per run and id at most. Runs of
    similar size are merged, and so are the files of the rows.
    """
    spark = scored.sparkSession
    seen = newest(spark, path)
    rows = scored.select(
        *C.SCORED_COLUMNS, F.lit(None).cast("boolean").alias("is_fraud_actual"),
        F.to_date("timestamp").alias("date"),
        customer_bucket(F.col("customer_id")).alias("customer_bucket"))
    if seen:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(seen)])
    first = Window.partitionBy("transaction_id").orderBy("timestamp", _content())
    rows = rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    rows = materialize(rows.withColumn("_hash", F.xxhash64("transaction_id")), "to-append")
    parts = {"rows": [], "ids": []}
    if seen:
        parts = {name: list(runs) for name, runs in seen["parts"].items()}
        stored = stored_ids(spark, path, rows.select("_hash"), seen)
        if stored is not None:
            rows = rows.join(stored, ["_hash", "transaction_id"], "left_anti")
    schema = rows.drop("_hash", "customer_bucket").schema
    told = {"schema": told_schema(T.StructType([*schema, rows.schema["customer_bucket"]]))}
    run = _write_rows(rows.drop("_hash"), path)
    if run["rows"]:
        added = _run_rows(spark, path, [run], told).select(
            F.xxhash64("transaction_id").alias("_hash"), "transaction_id")
        parts["rows"].append(run)
        parts["ids"].append(_write_ids(added, path))
    elif seen:
        return
    for name, merged in (("rows", _merged_rows), ("ids", _merged_ids)):
        count = to_merge([r["rows"] for r in parts[name]])
        if count:
            parts[name] = [*parts[name][:-count], merged(spark, path, parts[name][-count:], told)]
    commit(spark, path, {**told, "parts": parts}, seen)


def stored_ids(spark: SparkSession, path: str, hashes: DataFrame, told: dict) -> DataFrame | None:
    """(_hash, transaction_id) of the index files that can hold one of the hashes."""
    listed = listed_hashes(hashes)
    files = [f for run in told["parts"]["ids"] for f in files_with(path, run, listed)]
    return spark.read.schema(_id_schema(told)).parquet(*files) if files else None


def _id_schema(told: dict) -> T.StructType:
    return T.StructType([T.StructField("_hash", T.LongType()), schema_of(told)["transaction_id"]])


def _write_rows(rows: DataFrame, path: str) -> dict:
    folder, keys = new_run("rows"), ["customer_bucket", "customer_id", "timestamp", "transaction_id"]
    (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.partitionBy("customer_bucket").parquet(f"{path}/{folder}"))
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{folder}")
    return {"folder": folder, "rows": written.count()}


def _run_rows(spark: SparkSession, path: str, runs: list[dict], told: dict) -> DataFrame:
    schema = T.StructType([*schema_of(told), T.StructField("run", T.StringType())])
    if not runs:
        return spark.createDataFrame([], schema).drop("run")
    return (spark.read.schema(schema).option("basePath", f"{path}/rows")
            .parquet(*[f"{path}/{run['folder']}" for run in runs]).drop("run"))


def _merged_rows(spark: SparkSession, path: str, runs: list[dict], told: dict) -> dict:
    return _write_rows(_run_rows(spark, path, runs, told), path)


def _write_ids(ids: DataFrame, path: str) -> dict:
    return write_by_hash(ids, path, "ids", ["transaction_id"], IDS_PER_FILE)


def _merged_ids(spark: SparkSession, path: str, runs: list[dict], told: dict) -> dict:
    ids = spark.read.schema(_id_schema(told)).parquet(*[f"{path}/{run['folder']}" for run in runs])
    return _write_ids(ids, path)


def customer_bucket(customer: Column) -> Column:
    return F.coalesce(hash_bucket(customer, CUSTOMER_BUCKETS), F.lit(0))


def conflicting_ids(scored: DataFrame) -> DataFrame:
    """Ids that come with different content, and how many contents."""
    return scored.groupBy("transaction_id").agg(
        F.countDistinct(_content()).alias("n_contents")).filter("n_contents > 1")


def _content() -> Column:
    return F.xxhash64(*C.SCORED_COLUMNS)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the store's newest manifest names."""
    told = newest(spark, path)
    if told is None:
        raise FileNotFoundError(path)
    return _run_rows(spark, path, told["parts"]["rows"], told)


def scored_of_customer(spark: SparkSession, path: str, customer_id) -> DataFrame:
    """One customer's stored rows: their bucket only, filtered at the scan."""
    return read_scored(spark, path).filter(
        (F.col("customer_bucket") == customer_bucket(F.lit(customer_id)))
        & (F.col("customer_id") == F.lit(customer_id)))


def append_scored_jdbc(scored: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a table in a database; a repeated batch is the caller's to prevent.

    Spark's JDBC sink has no insert-if-absent. Not tested here: no database.
    """
    writer = scored.select(*C.SCORED_COLUMNS).write.format("jdbc").mode("append")
    writer.option("url", url).option("dbtable", table).options(**options).save()


def save_models(spark: SparkSession, models: RiskModels, path: str) -> None:
    """Coefficients, scalers and background rows of both stages, as one small table."""
    row = spark.range(1).select(F.lit(to_json(models)).alias("models"))
    row.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> RiskModels:
    return from_json(spark.read.parquet(path).first()["models"])


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(path)


def daily_table(path: str) -> KeyedTable:
    """Daily summaries of columns (operators.daily); a day that is counted again takes its place."""
    return KeyedTable(path, ("day", "feature"))


# --- snapshots of behaviour ------------------------------------------------------------

def snapshot_table(path: str) -> KeyedTable:
    """Customers and the values they used in one table, so both change in one step."""
    return KeyedTable(path, ("customer_id", "kind", "value"))


def put_snapshot(changed: Snapshot, path: str, batch: int | None = None, source: str = "") -> bool:
    """Store the snapshots of some customers in place of their earlier ones."""
    return snapshot_table(path).put(one_table(changed), batch, source)


def read_snapshot(spark: SparkSession, path: str, customers: DataFrame | None = None) -> Snapshot:
    """The stored snapshot, or that of the `customers` in a table; few ones open few files."""
    only = None if customers is None else customers.select("customer_id")
    return from_rows(snapshot_table(path).read(spark, only))
