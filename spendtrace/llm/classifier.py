"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL.

A document's features are its words and pairs of neighbouring words in two
views: as they are written (lower case), and as shapes, in which runs of
letters, capitals and digits are one sign each and other signs stand for
themselves; a word equal to the one before it is marked in the shape view. All
are hashed into 2**18 slots. Values are counts scaled to unit length.

Training follows the regularised leader: per slot a sum of adjusted gradients
and of squared gradients gives the weight in closed form, with many exact zeros.
Labelled rows are dealt by a hash into shards of bounded size, each shard is
trained in order by one task, and the weights are averaged, so training grows
with the labelled rows and no task or driver sees all of them. Scoring is the
sparse product of counts and weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.common import (
    MAX_MEMO, byte_texts, crc_fold, mix, schema_with, set_aside, small_or_shuffled, table, text_chunks,
)

SLOT_BITS = 18
ROWS_PER_SHARD = 4_000
HELD_OUT_FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Ftrl:
    """Learning rate, its smoothing, and the weights of both penalties."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 6


class WordViews(dict):
    """For each word: hash of the written form in the high half, of the shape in the low."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_MEMO:
            self.clear()
        value = self[word] = (xxhash.xxh32_intdigest(word.lower()) << 32) | xxhash.xxh32_intdigest(
            shape(word))
        return value


KINDS = bytes(
    b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 or c >= 128
    else b"9"[0] if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """`Don't!!` to `Aa'a!`: kinds of signs, each run once; signs beyond ASCII count as letters."""
    return RUNS.sub(rb"\1", word.translate(KINDS))


def features(texts: list[bytes], memo: WordViews) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value) of all texts, ordered by document and slot.

    Each document has a constant slot 0, so that empty texts have a score too.
    """
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = text.split()
        counts[i] = len(found)
        words += found
    views = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), counts)
    written, shaped = views >> np.uint64(32), views & np.uint64(0xFFFFFFFF)
    follows = np.zeros(len(words), bool)
    follows[1:] = doc[1:] == doc[:-1]
    same = follows.copy()
    same[1:] &= views[1:] == views[:-1]
    shaped = shaped * np.uint64(2) + same
    grams, grams_doc = [], []
    for kind, view in enumerate((written, shaped)):
        base = mix(view + np.uint64((kind + 1) << 40))
        pairs = mix(base[1:] + mix(base[:-1]))[follows[1:]]
        grams += [base, pairs]
        grams_doc += [doc, doc[1:][follows[1:]]]
    slot = np.concatenate(grams) >> np.uint64(64 - SLOT_BITS)
    slot = np.maximum(slot, 1)  # slot 0 is the constant
    key = (np.concatenate(grams_doc).astype(np.uint64) << np.uint64(SLOT_BITS)) | slot
    constant = np.arange(len(texts), dtype=np.uint64) << np.uint64(SLOT_BITS)
    key, n = np.unique(key, return_counts=True)
    doc = (key >> np.uint64(SLOT_BITS)).astype(np.int64)
    slot = (key & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    value = np.sqrt(n)
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    value = value / norm[doc]
    doc = np.concatenate([np.arange(len(texts)), doc])
    slot = np.concatenate([np.zeros(len(constant), np.int64), slot])
    value = np.concatenate([np.ones(len(texts)), value])
    order = np.argsort(doc, kind="stable")
    return doc[order], slot[order], value[order]


def fit_shard(rows: list[tuple[np.ndarray, np.ndarray, float]], how: Ftrl) -> np.ndarray:
    """Weights after `epochs` passes over (slots, values, label) in their order."""
    z, squares = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    for _ in range(how.epochs):
        for slots, values, label in rows:
            zs, ns = z[slots], squares[slots]
            w = leader(zs, ns, how)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
            grown = ns + g * g
            z[slots] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / how.alpha * w
            squares[slots] = grown
    return leader(z, squares, how)


def leader(z: np.ndarray, squares: np.ndarray, how: Ftrl) -> np.ndarray:
    """The regularised leader: zero where the gradients are small, else in closed form."""
    pulled = np.sign(z) * np.maximum(np.abs(z) - how.l1, 0.0)
    return -pulled / ((how.beta + np.sqrt(squares)) / how.alpha + how.l2)


def fit(labelled: DataFrame, how: Ftrl = Ftrl(), rows_per_shard: int = ROWS_PER_SHARD) -> np.ndarray:
    """Weights from rows with text and label (0 or 1), and doc_id where there is one.

    Null labels are left out, null texts are empty. Rows are dealt and ordered
    by a hash of their content and id, so that a rerun gives the same result and
    copies of a text are spread over the shards. The id serves for that alone.
    Without rows all weights are zero and every score is one half. The result
    has 2**18 numbers whatever the input.
    """
    ids = [c for c in ("doc_id",) if c in labelled.columns]
    rows = labelled.filter(F.col("label").isNotNull()).select(
        F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("label").cast("double").alias("label"),
        F.xxhash64("text", "label", *ids).alias("deal"))
    shards = max(1, -(-rows.count() // rows_per_shard))

    def fitted(kept: list) -> pa.RecordBatch:
        w = fit_shard(kept, how)
        used = np.flatnonzero(w)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(w[used], 1.0))], ["slot", "w"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, kept, now = WordViews(), [], None
        for piece in text_chunks(batches, "text"):
            owner = piece.column("shard").to_pylist()
            labels = piece.column("label").to_numpy(zero_copy_only=False)
            doc, slot, value = features(byte_texts(piece.column("text")), memo)
            ends = np.searchsorted(doc, np.arange(len(labels) + 1))
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if owner[i] != now and kept:
                    yield fitted(kept)
                    kept = []
                now = owner[i]
                kept.append((slot[a:b].astype(np.int32), value[a:b].astype(np.float32), labels[i]))
        if kept:
            yield fitted(kept)

    # Each shard is one task's; a task that had several would fit them one by one.
    dealt = rows.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int")).repartitionById(
        shards, "shard").sortWithinPartitions("shard", "deal").select("shard", "text", "label")
    sums = dealt.mapInArrow(train, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w"))
    got = sums.toPandas()
    weights = np.zeros(1 << SLOT_BITS)
    if len(got):
        models = got.loc[got["slot"] == -1, "w"].iloc[0]  # each shard reports itself at -1
        got = got[got["slot"] >= 0]
        weights[got["slot"].to_numpy()] = got["w"].to_numpy() / models
    return weights.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (probability of label 1) and predicted (score >= threshold).

    Whole texts are scored; null and empty ones have the score of the constant.
    An empty table gives no rows. Columns named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, w = WordViews(), shared.value
        for piece in text_chunks(batches, "text"):
            doc, slot, value = features(byte_texts(piece.column("text")), memo)
            total = np.bincount(doc, w[slot] * value, piece.num_rows)
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [*piece.schema.names, "score", "predicted"])

    return rows.mapInArrow(apply, schema_with(rows, "score double, predicted int"))


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: int = HELD_OUT_FOLDS) -> DataFrame:
    """(doc_id, text, label) of the documents of the training folds that have a label.

    A document labelled more than once takes the smallest label.
    """
    known = labels.filter(F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("label"))
    return docs.select("doc_id", "text").filter(crc_fold(F.col("doc_id"), folds) != 0).join(
        small_or_shuffled(known), F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "label")


def classifier_query(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weights = fit(labelled_rows(docs, table(spark, folder, "labels")))
    return score(docs, weights).select(
        "doc_id", (crc_fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"),
        "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` that the classifier does not reject, with the columns of `docs`.

    Columns may have any names; their values are returned as they are.
    """
    inner, back = set_aside(docs, ("doc_id", "text"))
    scored = score(inner, fit(labelled_rows(inner, labels)), threshold)
    return scored.filter(F.col("predicted") == 1).select(*back)
