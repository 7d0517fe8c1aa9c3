"""Session set-up and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a session needs for the plans in this package to come out as meant.
# The co-partition switch lets a join on (customer, run, x) reuse rows that are
# already hash-partitioned on (customer, run). The small least size keeps all
# cores busy on short logs; on long ones the advisory size decides, which bounds
# what a task reads. Files are read in small pieces, each at least a row group,
# so that what a task decodes and caches of a table does not grow with it.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

_local_roots: dict[str, str] = {}


# Bytes of a row group in the tables that `materialize` writes.
ROW_GROUP_BYTES = 8 << 20


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("spendtrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names.

    Only a local master may fall back to a folder of its own, since there the
    driver and all tasks see the same disk.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spendtrace-")
    return _local_roots[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/spendtrace/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete the tables this application wrote with `materialize`.

    For the end of a job; data frames that read those tables stop working.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and continue from the written table.

    A plan that reads its input several times then reads columns from parquet
    instead of running the shuffles before it again, and lost executors only
    cost the tasks after the table.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
