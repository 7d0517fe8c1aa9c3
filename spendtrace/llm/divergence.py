"""Quality rules: distance of a document from the reference of its language.

A document is described by two histograms: kinds of characters, and the most
common words of a language with all other words in one bin. The references are
learned from the corpus: per language and kind the median share over its
documents, which junk below one half cannot move, and the shares of its most
common words over all its words. A document is compared by the Jensen-Shannon
distance (base 2) with each language and judged by the nearest one. Histograms
of short texts say little, so each rule has a least length.

Base measures (words, symbols, repeated lines and word windows) are computed in
the same pass; a document that fails them is not kept either.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import (
    MAX_MEMO, mix, owners, run_hashes, schema_with, table, text_chunks, word_hashes,
)

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
LEAST_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30

KINDS = ("small letter", "capital", "blank", "line end", "symbol", "punctuation, digit, other")
COMMON_WORDS = 50
EDGES = ".,;:!?'\"()[]{}#*$%&|<>-"


@dataclass(frozen=True)
class Limits:
    """Largest distance of either histogram, and the length from which it counts.

    The noise of a histogram falls with the root of the length, and so does the
    allowance for it: the limit at length n is `base` + `noise` / sqrt(n).
    """

    kinds: float = 0.14
    kinds_noise: float = 1.0
    kinds_from_chars: int = 100
    words: float = 0.33
    words_noise: float = 0.6
    words_from: int = 40

    def allows(self, by_kind: np.ndarray, chars: np.ndarray, by_word: np.ndarray,
               words: np.ndarray) -> np.ndarray:
        """Which texts pass both rules; a distance that is not there passes."""
        return ~(by_kind > self.kinds + self.kinds_noise / np.sqrt(np.maximum(chars, 1))) & ~(
            by_word > self.words + self.words_noise / np.sqrt(np.maximum(words, 1)))


@dataclass
class References:
    """Per language (rows) the shares of character kinds and of its common words."""

    names: list[str]
    kinds: np.ndarray
    words: list[list[str]]
    shares: np.ndarray  # the last column holds all other words


def _kind_table() -> np.ndarray:
    kind = np.full(1 << 16, len(KINDS) - 1, np.uint8)
    for point in range(1 << 16):
        c = chr(point)
        kind[point] = (3 if c == "\n" else 2 if c.isspace() else 4 if c in SYMBOLS
                       else 1 if c.isupper() else 0 if c.isalpha() else len(KINDS) - 1)
    return kind


_tables: list[np.ndarray] = []


def kind_counts(texts: list[str]) -> np.ndarray:
    """Characters of each kind (columns) in each text (rows)."""
    if not _tables:
        _tables.append(_kind_table())
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    kinds = _tables[0][np.minimum(points, (1 << 16) - 1)].astype(np.int64)
    owner = owners(np.fromiter(map(len, texts), np.int64, len(texts)))
    n = len(KINDS)
    return np.bincount(owner * n + kinds, minlength=len(texts) * n).reshape(len(texts), n)


def normal(word: bytes) -> bytes:
    """Lower case, without punctuation at the ends."""
    return word.decode("utf-8", "replace").lower().strip(EDGES).encode()


class CommonIds(dict):
    """Number of each common word, -1 for all others; remembered by the raw word."""

    def __init__(self, common: dict[bytes, int]) -> None:
        super().__init__()
        self.common = common

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_MEMO:
            self.clear()
        value = self[word] = self.common.get(normal(word), -1)
        return value


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) along the last axis; rows of zeros are at 1."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)

    apart = np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))
    return np.where(p.sum(axis=-1) > 0, apart, 1.0)


def repeated_words(hashes: np.ndarray, counts: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words per text that lie in a window of `width` words found more than once in it."""
    doc = owners(counts)
    ends = np.cumsum(counts)
    at = np.arange(len(hashes))
    start = at[at + width <= ends[doc]] if len(at) else at
    key = mix(run_hashes(hashes, width)[start] + mix(doc[start].astype(np.uint64)))
    order = np.argsort(key)
    alike = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(start), bool)
    twice[order[1:][alike]] = True
    twice[order[:-1][alike]] = True
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, start[twice], 1)
    np.add.at(covered, start[twice] + width, -1)
    return np.bincount(doc, np.cumsum(covered)[:-1] > 0, len(counts)).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if text.find("\n") < 0:
        return 0
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def learn(docs: DataFrame, common_words: int = COMMON_WORDS,
          least_chars: int = Limits.kinds_from_chars) -> References:
    """References from all documents with text and lang; null or empty ones are left out.

    What reaches the driver is one row per language and `common_words` words of
    each. Ties between words go to the smaller one.
    """
    rows = docs.filter(F.col("text").isNotNull() & (F.col("lang") != "")).select("lang", "text")
    names = [f"k{i}" for i in range(len(KINDS))]

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches, "text"):
            counts = kind_counts(piece.column("text").to_pylist())
            total = counts.sum(axis=1)
            use = total >= least_chars
            shares = counts[use] / total[use, None]
            yield pa.RecordBatch.from_arrays(
                [piece.column("lang").filter(pa.array(use)), *map(pa.array, shares.T)],
                ["lang", *names])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for piece in text_chunks(batches, "text"):
            for lang, text in zip(piece.column("lang").to_pylist(),
                                  piece.column("text").cast(pa.binary()).to_pylist()):
                held.setdefault(lang, Counter()).update(text.split())
            for lang in [x for x, c in held.items() if len(c) > MAX_MEMO]:
                yield counted(lang, held.pop(lang))
        for lang, counter in held.items():
            yield counted(lang, counter)

    def counted(lang: str, raw: Counter) -> pa.RecordBatch:
        merged: Counter = Counter()
        for word, n in raw.items():
            merged[normal(word)] += n
        merged.pop(b"", None)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(merged) + 1)),
             pa.array([*merged, None], pa.binary()).cast(pa.string()),
             pa.array([*merged.values(), sum(raw.values())], pa.int64())], ["lang", "word", "n"])

    medians = rows.mapInArrow(kinds, "lang string, " + ", ".join(f"{c} double" for c in names)).groupBy(
        "lang").agg(*[F.percentile_approx(c, 0.5, 1000).alias(c) for c in names]).orderBy("lang").toPandas()
    # A language's total stands under the null word, in front of its words.
    first = Window.partitionBy("lang").orderBy(F.col("word").isNotNull(), F.desc("n"), "word")
    top = rows.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")).withColumn("at", F.row_number().over(first)).filter(
        F.col("at") <= common_words + 1).orderBy("lang", "at").toPandas()
    kept = [x for x in medians["lang"] if (top["lang"] == x).sum() > 1]
    shares, common = np.zeros((len(kept), common_words + 1)), []
    for i, lang in enumerate(kept):
        own = top[top["lang"] == lang]
        n = own["n"].to_numpy()
        common.append(own["word"].tolist()[1:])
        shares[i, :len(n) - 1] = n[1:] / n[0]
        shares[i, -1] = 1 - shares[i].sum()
    middle = medians.set_index("lang").loc[kept, names].to_numpy(float).reshape(len(kept), len(names))
    return References(kept, middle / np.maximum(middle.sum(axis=1, keepdims=True), 1e-12), common, shares)


def judge(docs: DataFrame, references: References, limits: Limits = Limits()) -> DataFrame:
    """`docs` with the base measures, both distances, base_failed and kept.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are counts of
    whole texts, null texts being empty. A distance is null where the text is
    shorter than its rule needs or no language has a reference; then the rule
    does not reject. An empty table gives no rows. Columns named like a result
    are replaced.
    """
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = {*counted, "base_failed", "kind_distance", "word_distance", "kept"}
    rows = docs.select(*[c for c in docs.columns if c.lower() not in made])
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        every = sorted({w.encode() for words in known.words for w in words})
        place = {w: i for i, w in enumerate(every)}
        columns = [[place[w.encode()] for w in words] for words in known.words]
        ids = CommonIds(place)
        for piece in text_chunks(batches, "text"):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            raw = [t.encode() for t in texts]
            hashes, n = word_hashes(raw)
            symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
            chars = np.array([len(t) - sum(map(t.count, WHITE)) for t in texts], np.int64)
            lines = np.array([repeated_lines(t) for t in texts], np.int64)
            repeats = repeated_words(hashes, n)
            failed = (n < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            by_kind = nearest_kind(texts, known, limits)
            by_word = nearest_words(raw, n, ids, len(every), columns, known, limits)
            kept = ~failed & limits.allows(by_kind, chars, by_word, n)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, *map(pa.array, (n, chars, symbols, lines, repeats, failed)),
                 pa.array(by_kind, from_pandas=True), pa.array(by_word, from_pandas=True),
                 pa.array(kept)],
                [*piece.schema.names, *counted, "base_failed", "kind_distance", "word_distance", "kept"])

    return rows.mapInArrow(apply, schema_with(
        rows, ", ".join(f"{c} long" for c in counted)
        + ", base_failed boolean, kind_distance double, word_distance double, kept boolean"))


def nearest_kind(texts: list[str], known: References, limits: Limits) -> np.ndarray:
    """Least distance of character kinds to any language, NaN for short texts."""
    counts = kind_counts(texts)
    total = counts.sum(axis=1)
    out = np.full(len(texts), np.nan)
    use = total >= max(1, limits.kinds_from_chars)
    if use.any() and known.names:
        shares = counts[use] / total[use, None]
        out[use] = distance(shares[:, None, :], known.kinds[None]).min(axis=1)
    return out


def nearest_words(raw: list[bytes], n: np.ndarray, ids: CommonIds, n_ids: int,
                  columns: list[list[int]], known: References, limits: Limits) -> np.ndarray:
    """Least distance of common words to any language, NaN for short texts."""
    out = np.full(len(raw), np.nan)
    use = np.flatnonzero(n >= max(1, limits.words_from))
    if not len(use) or not known.names:
        return out
    words = [w for i in use for w in raw[i].split()]
    found = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(use)), n[use])
    common = found >= 0
    counts = np.bincount(doc[common] * n_ids + found[common], minlength=len(use) * n_ids).reshape(
        len(use), n_ids)
    best = np.full(len(use), np.inf)
    for i, own in enumerate(columns):
        p = np.zeros((len(use), known.shares.shape[1]))
        p[:, :len(own)] = counts[:, own] / n[use, None]
        p[:, -1] = 1 - p.sum(axis=1)
        best = np.minimum(best, distance(p, known.shares[i][None]))
    out[use] = best
    return out


def divergence_query(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return judge(docs.select("doc_id", "text"), learn(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "kind_distance", "word_distance")
