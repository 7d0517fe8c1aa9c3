"""Target-distribution importance resampling over hashed word n-grams.

Every run of one to three words falls into a bucket. A bucket's gain is the
logarithm of how much likelier it is in the target texts than in the corpus; a
document's weight is the sum over its features, and a draw without replacement
by weight takes the highest weights plus a random number each.

A line break separates words, so texts are cut into lines. Equal lines of the
whole corpus are one row with the number of their occurrences: their features
are hashed once, counted times the occurrences, and summed once to the line's
weight. Features that reach over a line break are few and belong to their
document; they are hashed with it and added to both sides.

The hash of a run is put together from the hashes of its words: crc32 is linear,
so appending a word shifts the hash by the word's length, which is a lookup.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import byte_texts, join_frequent, owners, table, text_chunks
from spendtrace.session import materialize

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
SHARE = 5
LEAST_WORDS = 20
ROWS_PER_RANGE = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

# Words up to this length are hashed by lookups, longer ones one by one.
SHORT = 32
SPACE = np.uint32(zlib.crc32(b" "))


def _byte_table() -> np.ndarray:
    """What one step of crc32 does with each low byte of the register."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> 1), x >> 1).astype(np.uint32)
    return x


_STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """[length, place, byte]: that byte of a hash after `length` bytes of zeros more."""
    x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    tables = [x]
    for _ in range(SHORT):
        x = _STEP[x & 255] ^ (x >> np.uint32(8))
        tables.append(x)
    return np.stack(tables)


_SHIFT = _shift_tables()


def _shifted(hashes: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    parts = [_SHIFT[lengths, i, (hashes >> np.uint32(8 * i)) & 255] for i in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


class Words:
    """Words of several texts in order: `owner` the text, `line` the line of each."""

    def __init__(self, texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = _IN_WORD[self.data]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, ends = edges[::2], edges[1::2]
        self.lengths = ends - self.starts
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.owner = np.searchsorted(text_ends, self.starts, side="right")
        self.line = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)

    def hashes(self, which: np.ndarray) -> np.ndarray:
        """crc32 of each of the words `which`."""
        starts, lengths = self.starts[which], self.lengths[which]
        state = np.full(len(which), 0xFFFFFFFF, np.uint32)
        order = np.argsort(-lengths, kind="stable")
        longer = np.searchsorted(-lengths[order], -np.arange(min(SHORT, lengths.max(initial=0))))
        for at, count in enumerate(longer):
            rows = order[:count]
            x = state[rows] ^ self.data[starts[rows] + at]
            state[rows] = _STEP[x & 255] ^ (x >> np.uint32(8))
        out = ~state
        for i in np.flatnonzero(lengths > SHORT):
            out[i] = zlib.crc32(self._bytes(starts[i], lengths[i]))
        return out

    def _bytes(self, start: int, length: int) -> bytes:
        return self.data[start:start + length].tobytes()

    def buckets(self, same: np.ndarray, other: np.ndarray | None = None,
                buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
        """(first word, bucket) of each run of words with one value of `same`.

        With `other`, only of runs whose ends differ in `other`.
        """
        n, starts = len(same), []
        for width in range(1, LONGEST_RUN + 1):
            first = np.arange(max(n - width + 1, 0))
            taken = same[first] == same[first + width - 1]
            if other is not None:
                taken &= other[first] != other[first + width - 1]
            starts.append(first[taken])
        needed = np.zeros(n + LONGEST_RUN, bool)
        for width, first in enumerate(starts, 1):
            for i in range(width):
                needed[first + i] = True
        which = np.flatnonzero(needed)
        hashed = np.zeros(n, np.uint32)
        hashed[which] = self.hashes(which)
        found = []
        for width, first in enumerate(starts, 1):
            whole = hashed[first]
            for i in range(1, width):
                whole = self._append(_shifted(whole, 1) ^ SPACE, first + i, hashed)
            found.append((whole % np.uint32(buckets)).astype(np.uint16))
        return np.concatenate(starts), np.concatenate(found)

    def _append(self, before: np.ndarray, words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        lengths = self.lengths[words]
        out = _shifted(before, np.minimum(lengths, SHORT)) ^ hashed[words]
        for i in np.flatnonzero(lengths > SHORT):
            out[i] = zlib.crc32(self._bytes(self.starts[words[i]], lengths[i]), int(before[i]))
        return out


def _packed(owner: np.ndarray, values: np.ndarray, texts: int) -> pa.Array:
    """The values of each text as bytes of 16-bit numbers."""
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))]) * 2
    data = values[order].astype("<u2").tobytes()
    return pa.Array.from_buffers(pa.binary(), texts, [
        None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to words, runs over line breaks, and lines with words."""
    for batch in text_chunks(batches, "text"):
        texts = byte_texts(batch.column("text"))
        words = Words(texts)
        first, buckets = words.buckets(words.owner, words.line)
        lines = [Counter(map(_digest, filter(_has_word, text.split(b"\n")))) for text in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
        parts = pa.StructArray.from_arrays(
            [pa.array([d for x in lines for d in x], pa.binary()),
             pa.array([n for x in lines for n in x.values()], pa.int32())], ["digest", "times"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"),
             pa.array(np.bincount(words.owner, minlength=len(texts)).astype(np.int64)),
             _packed(words.owner[first], buckets, len(texts)),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)],
            ["doc_id", "digest", "n_words", "across", "lines"])


_NOT_IN_WORD = bytes(i for i in range(256) if not _IN_WORD[_LOWER[i]])


def _has_word(line: bytes) -> bool:
    return bool(line.strip(_NOT_IN_WORD))


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, times) to the digest and the features of the lines with words."""
    for batch in text_chunks(batches, "line"):
        lines = byte_texts(batch.column("line"))
        kept = [i for i, line in enumerate(lines) if _has_word(line)]
        if not kept:
            continue
        lines = [lines[i] for i in kept]
        words = Words(lines)
        first, buckets = words.buckets(words.owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(_digest, lines), pa.binary()), batch.column("times").take(pa.array(kept)),
             _packed(words.owner[first], buckets, len(lines))], ["digest", "times", "within"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, and how many each row has."""
    rows = column.to_pylist()
    counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 2
    return np.frombuffer(b"".join(rows), "<u2"), counts


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(packed, times) to features per bucket, one row per bucket and task."""
    sums = np.zeros(1 << 16, np.int64)
    for batch in batches:
        values, counts = _unpacked(batch.column(0))
        times = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), counts)
        np.add.at(sums, values, times)
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])],
                                     ["bucket", "n"])


def _weigh(name: str, gains: np.ndarray):
    """Replace a packed column, the last one, by the sum of its gains."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = _unpacked(batch.column(batch.num_columns - 1))
            running = np.concatenate([[0], np.cumsum(gains[values])])
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(running[ends] - running[ends - counts])],
                [*batch.schema.names[:-1], name])

    return weighed


def _text_digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


class Features:
    """Documents and distinct lines with their features, both written once."""

    def __init__(self, docs: DataFrame):
        """`docs` needs doc_id and text; other columns are not used."""
        doc_type = dict(docs.dtypes)["doc_id"]
        self.docs = materialize(
            docs.select("doc_id", "text", _text_digest().alias("digest")).mapInArrow(
                _read_documents, f"doc_id {doc_type}, digest string, n_words long, across binary, "
                "lines array<struct<digest: binary, times: int>>").select(
                F.monotonically_increasing_id().alias("row"), "*"), "document-features")
        # Grouped by the line itself, so equal names of different lines cannot meet here.
        lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(
            F.count("*").alias("times"))
        self.lines = materialize(lines.mapInArrow(
            _read_lines, "digest binary, times long, within binary"), "line-features")

    def counts(self) -> np.ndarray:
        """Features per bucket: of each distinct line times its occurrences, and over breaks."""
        parts = self.lines.select("within", "times").mapInArrow(_sums, "bucket int, n long").unionAll(
            self.docs.select("across", F.lit(1).cast("long").alias("times")).mapInArrow(
                _sums, "bucket int, n long"))
        sums = np.zeros(1 << 16, np.int64)
        for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            sums[row["bucket"]] = row["n"]
        return sums


def gains(corpus: np.ndarray, target: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed odds of each bucket, in the target over the corpus."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(
        (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
        for s, t in zip(corpus[:buckets].tolist(), target[:buckets].tolist())], np.int64)


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) with a Gumbel number g that the id decides (null: as an empty id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, share: int = SHARE,
               least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_digest, n_words, n_features, weight, score, rank), a row per row of `docs`.

    Of the N documents with at least `least_words` words, floor(share * N / 100)
    have a rank, 1 being the highest score; ties go to the smaller id, null ids
    last. Null and wordless texts have no features and weight 0. Repeated rows
    are documents of their own with equal scores; which of them ranks first is
    arbitrary. Without target texts, or with an empty corpus, the odds are those
    of the smoothing. An empty table gives no rows. `target` needs `text`; other
    columns are not used.
    """
    corpus = Features(docs)
    wanted = Features(target.select(F.lit(0).alias("doc_id"), "text")).counts()
    worth = gains(corpus.counts(), wanted)
    weights = materialize(corpus.lines.select("digest", "times", "within").mapInArrow(
        _weigh("weight", worth), "digest binary, times long, weight long"), "line-weights")
    doc_type = dict(docs.dtypes)["doc_id"]
    key = ["row", "doc_id", "text_digest", "n_words", "over"]
    rows = corpus.docs.select(
        "row", "doc_id", F.col("digest").alias("text_digest"), "n_words", "lines", "across").mapInArrow(
        _weigh("over", worth), f"row long, doc_id {doc_type}, text_digest string, n_words long, "
        "lines array<struct<digest: binary, times: int>>, over long")
    no_line = F.lpad(F.col("row").cast("string"), 20, "0").cast("binary")
    parts = rows.select(*key, F.explode_outer("lines").alias("_l")).select(
        *key, F.coalesce(F.col("_l.digest"), no_line).alias("digest"),
        F.col("_l.times").alias("in_document"))
    joined = join_frequent(parts, weights, "digest", "times")
    weight = F.col("over") + F.coalesce(F.sum(F.col("in_document") * F.col("weight")), F.lit(0))
    summed = joined.groupBy(*key).agg(weight.alias("weight"))
    n = F.col("n_words")
    scored = summed.select(
        "row", "doc_id", "text_digest", "n_words",
        sum((F.greatest(n - i, F.lit(0)) for i in range(1, LONGEST_RUN)), n).alias("n_features"),
        "weight", (F.col("weight") + luck(F.col("doc_id"), seed)).alias("score"))
    return _ranked(materialize(scored, "document-scores"), share, least_words).drop("row")


def _ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """Add `rank` to the best rows: ranges of the order, numbered behind each other."""
    able = F.col("n_words") >= least_words
    size = scored.agg(F.count("*").alias("rows"), F.count_if(able).alias("able")).first()
    drawn = share * size["able"] // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = scored.withColumn("able", able).repartitionByRange(
        max(1, -(-size["rows"] // ROWS_PER_RANGE)), *order).withColumn(
        "range", F.spark_partition_id())
    ranges = materialize(ranges, "score-ranges")
    counts = sorted(ranges.groupBy("range").count().collect())
    starts, total = {}, 0
    for number, rows in counts:
        if total < drawn:
            starts[number] = total
        total += rows
    within = ranges.filter(F.col("range").isin(list(starts)))
    offset = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else None
    names = [F.col(c) for c in scored.columns]
    rest = ranges.filter(~F.col("range").isin(list(starts))).select(
        *names, F.lit(None).cast("long").alias("rank"))
    if not starts:
        return rest
    place = (F.row_number().over(Window.partitionBy("range").orderBy(*order))
             + offset[F.col("range")]).cast("long")
    return within.withColumn("rank", place).select(
        *names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionAll(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """(rank, doc_id, text, weight, score): the texts that `importance` draws."""
    texts = docs.select("doc_id", "text")
    best = materialize(importance(texts, target, **options).filter(
        F.col("rank").isNotNull()), "drawn").withColumnRenamed("doc_id", "_id")
    same = (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("text_digest") == F.col("_digest"))
    found = texts.withColumn("_digest", _text_digest()).join(
        best.select("_id", "text_digest").distinct(), same, "left_semi").dropDuplicates(
        ["doc_id", "_digest"])
    return best.join(found, same).select("rank", "doc_id", "text", "weight", "score")


def importance_query(spark, folder: str) -> DataFrame:
    return importance(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
