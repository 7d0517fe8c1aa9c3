"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Java regex of a word where only ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"

MAX_BROADCAST_ROWS = 1_000_000
# Rows of a few numbers or one digest each, so some 20 MB at most when broadcast.
MAX_LOOKUP_ROWS = 200_000
CHUNK_BYTES = 1 << 20
MAX_MEMO = 300_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo `folds` (null: fold of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast `df` if it is counted to be small, else leave it to a shuffle join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def join_frequent(rows: DataFrame, lookup: DataFrame, key: str, holders: str,
                  limit: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Left join of `rows` with `lookup`, which has one short row per key.

    `holders`, a column of `lookup` that is not returned, is at least the number
    of rows with that key. A lookup of at most `limit` rows is broadcast. From a
    longer one the keys with more than the `limit`-th part of all rows are, and
    those are fewer than `limit`; the rest is joined with a shuffle, in which no
    key is frequent any more. Rows without a partner should have keys of their
    own, since nulls would meet in one task. `lookup` is read several times.
    """
    size = lookup.agg(F.count("*").alias("rows"), F.sum(holders).alias("holders")).first()
    if size["rows"] <= limit:
        return rows.join(F.broadcast(lookup.drop(holders)), key, "left")
    frequent = lookup.filter(F.col(holders) > size["holders"] / limit).drop(holders)
    rare = lookup.filter(F.col(holders) <= size["holders"] / limit).drop(holders)
    return rows.join(F.broadcast(frequent), key).unionByName(
        rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rare, key, "left"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    An expression that a lambda mentions is otherwise computed for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """`df` with all but the needed columns under names that no operator uses.

    The columns returned with it give every column its own name back, in order.
    """
    wanted = {n.lower() for n in needed}
    names = [c if c.lower() in wanted else f"kept{i}" for i, c in enumerate(df.columns)]
    inner = df.select(*[quoted(c).alias(n) for c, n in zip(df.columns, names)])
    return inner, [F.col(n).alias(c) for c, n in zip(df.columns, names)]


def schema_with(df: DataFrame, added: str) -> StructType:
    """The columns of `df` and those of a DDL string behind them."""
    return StructType(df.schema.fields + StructType.fromDDL(added).fields)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has about `limit` bytes of text.

    A document is never cut: a longer one is a piece of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words per text.

    Words are cut at the six ASCII white-space characters. A word's hash is the
    sum of its bytes' random values times random odd numbers by position.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.flatnonzero(~_WHITE[data])
    first = np.ones(len(inside), bool)
    first[1:] = inside[1:] != inside[:-1] + 1
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = np.diff(starts, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    by_place = mix(np.arange(1, lengths.max() + 1)) | np.uint64(1)
    sums = np.add.reduceat(_BYTE_VALUES[data[inside]] * by_place[place], starts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(inside[starts], ends), prepend=0)
    return mix(sums + lengths.astype(np.uint64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (shifts and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def owners(counts: np.ndarray) -> np.ndarray:
    """Index of the text that each word belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words that start at each position, ends included as zeros."""
    padded = np.concatenate([words, np.zeros(width - 1, np.uint64)])
    out = np.zeros(len(words), np.uint64)
    for i in range(width):
        out = mix(out + padded[i:i + len(words)])
    return out


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUES = mix(np.arange(1, 257) << 20)
