"""Tables of several folders whose content changes in one step.

A table is what its newest manifest names: a small JSON file under `_manifest`
that is created once and never changed. New folders are written first and then
named, so a reader sees the table before or after a change and a job that ends in
between leaves only folders that nobody reads. A folder stays until the second
manifest after the last one that names it, so a reader that has just opened the
table can finish.

`KeyedTable` is a table of rows by key to which changed rows are written beside
the others. Runs of similar size are merged, so a row is written again only a
few times while the table grows and the bytes written follow the changes.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.session import materialize

# How many values are looked up one by one on the driver.
LISTED = 10_000
# Runs up to this many rows take part in merging; larger ones have large files anyway.
MERGED_ROWS = 50_000_000
# A run is merged with the newer ones once these have a half of its rows.
GROWTH = 2


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    where, system = _path(spark, f"{path}/_manifest")
    if not system.exists(where):
        return []
    names = (s.getPath().getName() for s in system.listStatus(where))
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))


def _file(path: str, number: int) -> str:
    return f"{path}/_manifest/{number:012d}.json"


def _read(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest, or None if its writer did not finish it."""
    where, system = _path(spark, _file(path, number))
    stream = system.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text[:-1]) if text.endswith("\n") else None


def newest(spark: SparkSession, path: str) -> dict | None:
    """The newest finished manifest of a table; None if it has none."""
    for number in reversed(_numbers(spark, path)):
        told = _read(spark, path, number)
        if told is not None:
            return told | {"number": number}
    return None


def commit(spark: SparkSession, path: str, told: dict, seen: dict | None) -> None:
    """Make `told` the table, if `seen` is still the newest manifest.

    Of two writers that have seen the same manifest one fails.
    """
    numbers = _numbers(spark, path)
    number = max(numbers, default=-1) + 1
    now = newest(spark, path)
    if (now or {}).get("number") != (seen or {}).get("number"):
        raise RuntimeError(f"another job has changed {path}")
    where, system = _path(spark, _file(path, number))
    stream = system.create(where, False)
    try:
        stream.write(bytearray((json.dumps({**told, "number": number}) + "\n").encode()))
    finally:
        stream.close()
    kept = {f for t in (told, seen or {}) for f in folders(t)}
    for old in numbers[:-1]:
        gone = _read(spark, path, old)
        for folder in set(folders(gone or {})) - kept:
            drop(spark, f"{path}/{folder}")
        drop(spark, _file(path, old))


def folders(told: dict) -> list[str]:
    """All folders that a manifest names, relative to the table."""
    return [run["folder"] for part in told.get("parts", {}).values() for run in part]


def drop(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def new_run(part: str) -> str:
    return f"{part}/run={uuid.uuid4().hex}"


def to_merge(rows: list[int], most: int | None = None) -> int:
    """How many of the newest runs, oldest first in `rows`, become one; 0 for none."""
    most = MERGED_ROWS if most is None else most
    count, size = 0, 0
    for i, n in enumerate(reversed(rows)):
        if i and (n > GROWTH * size or n > most):
            break
        count, size = i + 1, size + n
    return count if count > 1 else 0


def told_schema(schema: T.StructType) -> dict:
    """A schema for a manifest; later rows may have nulls wherever a type allows them."""
    text = schema.json()
    for flag in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{flag}":false', f'"{flag}":true')
    return json.loads(text)


def schema_of(told: dict) -> T.StructType:
    return T.StructType.fromJson(told["schema"])


# --- runs in the order of a hash ----------------------------------------------------

def write_by_hash(rows: DataFrame, path: str, part: str, keys: list[str], rows_per_file: int) -> dict:
    """One run of rows with `_hash`, in its order; its manifest entry has the ends of each file."""
    spark, folder, schema = rows.sparkSession, new_run(part), rows.schema
    rows = materialize(rows, "run")
    count = rows.count()
    order = ["_hash", *keys]
    rows.repartitionByRange(max(1, -(-count // rows_per_file)), *order).sortWithinPartitions(
        *order).write.parquet(f"{path}/{folder}")
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    ends = spark.read.schema(schema).parquet(f"{path}/{folder}").groupBy(name.alias("file")).agg(
        F.min("_hash").alias("low"), F.max("_hash").alias("high")).collect()
    return {"folder": folder, "rows": count, "files": sorted([r["file"], r["low"], r["high"]] for r in ends)}


def listed_hashes(hashes: DataFrame) -> list[int] | tuple[int, int]:
    """The values of the one column in order, if they are few; else the least and the greatest."""
    few = [r[0] for r in hashes.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return sorted(few)
    name = hashes.columns[0]
    ends = hashes.agg(F.min(name), F.max(name)).first()
    return ends[0], ends[1]


def files_with(path: str, run: dict, listed: list[int] | tuple[int, int] | None) -> list[str]:
    """Files of a run that may hold a hash: of a sorted list, or of a pair's range."""
    found = []
    for name, low, high in run["files"]:
        if listed is None:
            wanted = True
        elif isinstance(listed, tuple):
            wanted = low <= listed[1] and high >= listed[0]
        else:
            wanted = bisect_left(listed, low) < bisect_right(listed, high)
        if wanted:
            found.append(f"{path}/{run['folder']}/{name}")
    return found


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key at a path; a later row of a key replaces the earlier one.

    Runs are in the order of a hash of the first key, so rows of a few of its
    values are read from a few files.
    """

    path: str
    keys: tuple[str, ...]
    rows_per_file: int = 1_000_000

    def exists(self, spark: SparkSession) -> bool:
        return newest(spark, self.path) is not None

    def read(self, spark: SparkSession, only: DataFrame | None = None) -> DataFrame:
        """All rows, or those whose first key is in the one column of `only`."""
        told = newest(spark, self.path)
        if told is None:
            raise FileNotFoundError(self.path)
        listed = None
        if only is not None:
            # hashed as the type that the keys are stored in
            only = only.select(F.col(only.columns[0]).cast(schema_of(told)[self.keys[0]].dataType).alias(
                self.keys[0])).distinct()
            listed = listed_hashes(only.select(self._hash().alias("_hash")))
        rows = self._rows(spark, told, told["parts"]["rows"], listed).drop("_hash")
        if only is None:
            return rows
        wanted = only.withColumnRenamed(self.keys[0], "_wanted")
        return rows.join(wanted, F.col(self.keys[0]).eqNullSafe(F.col("_wanted")), "left_semi")

    def files(self, spark: SparkSession, only: DataFrame) -> list[str]:
        """The files that `read` opens for the values of `only`."""
        told = newest(spark, self.path)
        listed = listed_hashes(only.select(F.xxhash64(F.col(only.columns[0]).cast(
            schema_of(told)[self.keys[0]].dataType))))
        return [f for run in told["parts"]["rows"] for f in files_with(self.path, run, listed)]

    def _hash(self):
        return F.xxhash64(self.keys[0])

    def _rows(self, spark: SparkSession, told: dict, runs: list[dict], listed=None) -> DataFrame:
        schema = schema_of(told)
        stored = T.StructType([T.StructField("_hash", T.LongType()), *schema])
        found = [(i, files) for i, run in enumerate(runs) if (files := files_with(self.path, run, listed))]
        if not found:
            return spark.createDataFrame([], stored)
        parts = [spark.read.schema(stored).parquet(*files).withColumn("_age", F.lit(i)) for i, files in found]
        rows = parts[0]
        if len(parts) == 1:
            return rows.drop("_age")
        for part in parts[1:]:
            rows = rows.unionByName(part)
        others = [c for c in schema.names if c not in self.keys]
        latest = F.max_by(F.struct(*others), "_age").alias("_row")
        return rows.groupBy("_hash", *self.keys).agg(latest).select(
            "_hash", *self.keys, "_row.*").select(*stored.names)

    def put(self, rows: DataFrame, batch: int | None = None, source: str = "") -> bool:
        """Write changed rows, one per key; whether anything was done.

        `batch` counts the changes of a `source`. A change that is run again does
        nothing; one of another source replaces the table.
        """
        spark = rows.sparkSession
        seen = newest(spark, self.path)
        if seen and batch is not None and seen["source"] == source and seen["batch"] >= batch:
            return False
        runs = list(seen["parts"]["rows"]) if seen and (batch is None or seen["source"] == source) else []
        told = {"schema": told_schema(rows.schema), "source": source,
                "batch": -1 if batch is None else batch}
        if runs:
            told["schema"] = seen["schema"]
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(seen)])
        run = self._write(rows.select(self._hash().alias("_hash"), "*"))
        if run["rows"]:
            runs.append(run)
        count = to_merge([r["rows"] for r in runs])
        if count:
            runs = [*runs[:-count], self._write(self._rows(spark, told, runs[-count:]))]
        commit(spark, self.path, {**told, "parts": {"rows": runs}}, seen)
        return True

    def _write(self, rows: DataFrame) -> dict:
        return write_by_hash(rows, self.path, "rows", list(self.keys), self.rows_per_file)
