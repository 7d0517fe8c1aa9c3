"""Reading transaction logs, batch files, scored tables and stored sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace import contract as C
from spendtrace.operators.validate import check_columns

CORRUPT = "_corrupt_record"


def transactions_csv(spark: SparkSession, path: str,
                     schema: T.StructType = C.TRANSACTION_SCHEMA) -> DataFrame:
    """Raw log from CSV; the header must match the schema and a bad file fails."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("enforceSchema", False).csv(path))


def transactions_parquet(spark: SparkSession, path: str,
                         schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored_history(spark: SparkSession, path: str,
                   schema: T.StructType = C.TRANSACTION_SCHEMA) -> DataFrame:
    """Stored history, or an empty one when nothing has been stored yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def files_in(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path: itself, or those in the folder, by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in system.listStatus(where) if s.isFile()]
    names = sorted((s.getPath().getName(), s.getPath().toString()) for s in found)
    return [full for name, full in names if not name.startswith(("_", "."))]


def first_line(spark: SparkSession, file: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        reader = spark._jvm.java.io.BufferedReader(
            spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def with_place(rows: DataFrame) -> DataFrame:
    """Adds `file_row`: file, start of the block, and a number that grows inside it.

    The same files read in the same way give the same places.
    """
    place = [F.col("_metadata.file_path").alias("file"),
             F.col("_metadata.file_block_start").alias("block")]
    return rows.withColumn("file_row", F.struct(
        *place, F.monotonically_increasing_id().alias("row")))


def batch_csv(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """An uploaded batch: columns by header name, all as text, plus `file_row`.

    Each file's own header decides its columns and their order, so files of a
    folder may differ and optional columns may be absent; types are applied by
    `validate.conform`, which reports values that do not parse. Lines with the
    wrong number of fields keep their text in `_corrupt_record`. `file_row`
    grows in file order.
    """
    alike: dict[str, list[str]] = {}
    for file in files_in(spark, path):  # uploads are few; only their first lines are read here
        alike.setdefault(first_line(spark, file), []).append(file)
    parts = [_one_header(spark, files, numbered) for files in alike.values()]
    rows = parts[0] if parts else spark.createDataFrame([], C.BATCH_SCHEMA)
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def _one_header(spark: SparkSession, files: list[str], numbered: bool) -> DataFrame:
    header = spark.read.option("header", True).csv(files[0]).columns
    check_columns(header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    # a line counts as malformed whichever columns a later query needs
    rows = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
            .csv(files))
    return with_place(rows) if numbered else rows


def well_formed(batch: DataFrame) -> DataFrame:
    return batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(batch: DataFrame) -> DataFrame:
    """Lines to put aside, with the fields that could be read."""
    return batch.filter(F.col(CORRUPT).isNotNull())


def transactions_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON request bodies, one per row, as batch rows."""
    return lines.select(F.from_json(column, C.BATCH_SCHEMA).alias("t")).select("t.*")


def scored_as_json(scored: DataFrame) -> DataFrame:
    """Response bodies: one JSON text per scored row, reasons nested."""
    return scored.select("transaction_id", F.to_json(F.struct(*scored.columns)).alias("body"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None,
               bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A scored table in a database. `bounds` (low, high, parts) splits the read on `key`."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        low, high, parts = bounds
        reader = (reader.option("partitionColumn", key).option("lowerBound", low)
                  .option("upperBound", high).option("numPartitions", parts))
    return reader.load()
