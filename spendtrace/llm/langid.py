"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to lower-case letters with one separator between runs of them.
Counts of four-character runs per language, over all training texts, determine
a model: the highest order uses the counts, lower orders the number of distinct
characters seen before a run, and each order is interpolated with the one below.
A model is stored as hash arrays in ascending order with a value for each hash.
The language with the lowest cross-entropy per character is chosen; the margin
in which texts of a language lie, found on training texts, calibrates rejection.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.common import crc_fold, mix, schema_with, table, text_chunks

ORDER = 4
BITS = 16  # of a folded character
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
EVIDENCE_CHARS = 50  # more characters than this add no certainty to the score
MEMO_BITS = 18


def _fold_table() -> np.ndarray:
    folded = np.zeros(1 << BITS, np.uint16)
    for point in range(1 << BITS):
        if chr(point).isalpha():
            lower = chr(point).lower()
            folded[point] = ord(lower[0]) if ord(lower[0]) < 1 << BITS else point
    return folded


_tables: list[np.ndarray] = []


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, 0 between runs of letters, and their text's index."""
    if not _tables:
        _tables.append(_fold_table())
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    codes = _tables[0][np.minimum(points, (1 << BITS) - 1)]
    for point in np.unique(points[points >= 1 << BITS]):
        letter = unicodedata.category(chr(point))[0] == "L"
        # Letters beyond the basic plane share codes of the private area.
        codes[points == point] = 0xE000 + point % 0x1900 if letter else 0
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return codes[keep], np.repeat(np.arange(len(texts)), lengths)[keep]


def runs(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The run that ends at each character, 16 bits each; before a text stand separators."""
    out = codes.astype(np.uint64)
    for back in range(1, ORDER):
        before = np.zeros(len(codes), np.uint64)
        same = text[back:] == text[:-back]
        before[back:] = np.where(same, codes[:-back], 0)
        out |= before << np.uint64(BITS * back)
    return out


def tail(run: np.ndarray, n: int) -> np.ndarray:
    """The last `n` characters of runs."""
    return run & np.uint64((1 << (BITS * n)) - 1) if n < ORDER else run


def keyed(run: np.ndarray, n: int) -> np.ndarray:
    return mix(run + np.uint64(n * 0x632BE59BD9B4E019 % (1 << 64)))


@dataclass
class Table:
    """Values by hash, hashes ascending."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return Table(keys[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        """Values of `keys`, and which of them are there."""
        if not len(self.keys):
            return np.full(len(keys), default, np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return np.where(there, self.values[at], np.float32(default)), there


@dataclass
class CharModel:
    """Probabilities of seen runs and weights of their contexts, for each order."""

    seen: list[Table]
    weights: list[Table]
    floor: float  # probability of a character never seen

    @staticmethod
    def fit(run: np.ndarray, count: np.ndarray, alphabet: int) -> CharModel:
        """From distinct runs of ORDER characters and their counts."""
        by_order = {ORDER: (run, count.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            kept, types = np.unique(tail(by_order[n + 1][0], n), return_counts=True)
            by_order[n] = (kept, types.astype(np.float64))
        seen, weights, floor = [], [], 1.0 / alphabet
        lower = np.zeros(0)
        for n in range(1, ORDER + 1):
            grams, counts = by_order[n]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            contexts, which = np.unique(grams >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(which, counts)
            weight = discount * np.bincount(which) / total
            if n == 1:
                below = np.full(len(grams), floor)
                floor *= weight[0] if len(weight) else 1.0
            else:
                shorter = tail(grams, n - 1)
                below = lower[np.searchsorted(by_order[n - 1][0], shorter)]
            p = np.maximum(counts - discount, 0) / total[which] + weight[which] * below
            seen.append(Table.of(keyed(grams, n), p))
            weights.append(Table.of(keyed(contexts, n), weight))
            lower = p
        return CharModel(seen, weights, floor)

    def bits(self, run: np.ndarray) -> np.ndarray:
        """Bits of the last character of each run, given those before it."""
        p = self.seen[0].get(keyed(tail(run, 1), 1), self.floor)[0]
        for n in range(2, ORDER + 1):
            gram = tail(run, n)
            weight, _ = self.weights[n - 1].get(keyed(gram >> np.uint64(BITS), n), 1.0)
            whole, there = self.seen[n - 1].get(keyed(gram, n), 0.0)
            p = np.where(there, whole, weight * p)
        return -np.log2(p)


@dataclass
class LanguageModels:
    names: list[str]
    models: list[CharModel]
    limits: np.ndarray  # bits per character above which a text is rejected

    def bits(self, run: np.ndarray) -> np.ndarray:
        return np.stack([m.bits(run) for m in self.models], axis=1).astype(np.float32)


class Memo:
    """Bits of runs met before, one run per place; a later run takes over its place."""

    def __init__(self, models: LanguageModels) -> None:
        self.models = models
        self.keys = np.zeros(1 << MEMO_BITS, np.uint64)
        self.known = np.zeros((1 << MEMO_BITS, len(models.names)), np.float32)
        self.used = np.zeros(1 << MEMO_BITS, bool)

    def bits(self, run: np.ndarray) -> np.ndarray:
        place = (mix(run) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        new = ~self.used[place] | (self.keys[place] != run)
        if new.any():
            fresh = np.unique(run[new])
            at = (mix(fresh) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
            values = self.models.bits(fresh)
            self.keys[at], self.known[at], self.used[at] = fresh, values, True
            out = self.known[place]
            out[new] = values[np.searchsorted(fresh, run[new])]
            # A place that a new run took over no longer speaks for the old one.
            lost = ~new & (self.keys[place] != run)
            if lost.any():
                out[lost] = self.models.bits(run[lost])
            return out
        return self.known[place]


def entropies(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character of each text in each language, and its folded length."""
    codes, text = fold(texts)
    n = np.bincount(text, minlength=len(texts))
    if not len(codes) or not memo.models.names:
        return np.zeros((len(texts), len(memo.models.names))), n
    bits = memo.bits(runs(codes, text))
    total = np.stack([np.bincount(text, bits[:, i], len(texts)) for i in range(bits.shape[1])], 1)
    return total / np.maximum(n, 1)[:, None], n


def plain_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def count_runs(rows: DataFrame) -> DataFrame:
    """(lang, run, n) over all rows of (text, lang), combined in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for piece in text_chunks(batches, "text"):
            texts, langs = plain_texts(piece.column("text")), piece.column("lang").to_pylist()
            for lang in set(langs):
                codes, text = fold([t for t, x in zip(texts, langs) if x == lang])
                parts = held.setdefault(lang, [])
                parts.append(np.unique(runs(codes, text), return_counts=True))
                if sum(len(r) for r, _ in parts) > 2_000_000:
                    merged = merge(parts)
                    if len(merged[0]) > 1_000_000:
                        yield counted(lang, *merged)
                        merged = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    held[lang] = [merged]
        for lang, parts in held.items():
            yield counted(lang, *merge(parts))

    return rows.mapInArrow(count, "lang string, run long, n long").groupBy("lang", "run").agg(
        F.sum("n").alias("n"))


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    run, which = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return run, np.bincount(which, np.concatenate([n for _, n in parts]), len(run)).astype(np.int64)


def counted(lang: str, run: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(run)), pa.array(run.view(np.int64)), pa.array(n)], ["lang", "run", "n"])


def fit(rows: DataFrame) -> LanguageModels:
    """Models from rows of (text, lang); null or empty languages and null texts are left out.

    Counts cover all rows, and a model has every run met, however rare, at any
    size of the input: models grow with the number of distinct runs, which all
    reach the driver and each task. The limits of rejection come from all rows
    with a letter. Without rows there are no models.
    """
    rows = rows.filter((F.col("lang") != "") & F.col("text").isNotNull()).select("text", "lang")
    got = count_runs(rows).toPandas()
    names = sorted(got["lang"].unique())
    run = got["run"].to_numpy().astype(np.int64).view(np.uint64)
    alphabet = len(np.unique(tail(run, 1))) + 1
    models = []
    for name in names:
        own = (got["lang"] == name).to_numpy()
        order = np.argsort(run[own])
        models.append(CharModel.fit(run[own][order], got["n"].to_numpy()[own][order], alphabet))
    fitted = LanguageModels(names, models, np.full(len(names), np.inf))
    if names:
        fitted.limits = limits(rows, fitted)
    return fitted


def limits(rows: DataFrame, fitted: LanguageModels) -> np.ndarray:
    """Per language the bits per character that one training text in 200 exceeds, and a tenth.

    All rows with a letter take part, short ones too, since texts of any length
    are held against the limit.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def own_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        place = {name: i for i, name in enumerate(memo.models.names)}
        for piece in text_chunks(batches, "text"):
            langs = piece.column("lang").to_pylist()
            bits, n = entropies(plain_texts(piece.column("text")), memo)
            at = [i for i, x in enumerate(langs) if x in place and n[i] > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in at], pa.string()),
                 pa.array([float(bits[i, place[langs[i]]]) for i in at], pa.float64())],
                ["lang", "bits"])

    edges = rows.mapInArrow(own_bits, "lang string, bits double").groupBy("lang").agg(
        F.percentile_approx("bits", 0.995, 10_000).alias("edge")).collect()
    found = {r["lang"]: r["edge"] * 1.1 for r in edges}
    return np.array([found.get(name, np.inf) for name in fitted.names])


def identify(docs: DataFrame, fitted: LanguageModels, reject: bool = True) -> DataFrame:
    """`docs` with lang_pred, score, bits and rejected.

    Whole texts are read. `lang_pred` is the language of least bits per
    character (ties: first name), `score` its posterior among the languages. A
    text above the limit of its language is `rejected`, and with `reject` also
    undetermined. Null texts and texts without a letter are undetermined with
    score 0 and null bits. An empty table gives no rows; columns named like a
    result are replaced.
    """
    made = {"lang_pred", "score", "bits", "rejected"}
    rows = docs.select(*[c for c in docs.columns if c.lower() not in made])
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        memo, names = Memo(models), np.array([*models.names, UNDETERMINED], object)
        for piece in text_chunks(batches, "text"):
            bits, n = entropies(plain_texts(piece.column("text")), memo)
            told = n > 0
            if models.names:
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(n)), best]
                gap = (bits - least[:, None]) * np.minimum(n, EVIDENCE_CHARS)[:, None]
                certain = 1.0 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)
                high = least > models.limits[best]
            else:
                best = np.zeros(len(n), np.int64)
                least, certain, high, told = np.zeros(len(n)), np.zeros(len(n)), ~told, told & False
            unsure = ~told | (high & reject)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(names[np.where(unsure, len(models.names), best)], pa.string()),
                 pa.array(np.where(told, certain, 0.0)), pa.array(least, pa.float64(), mask=~told),
                 pa.array(~told | high)],
                [*piece.schema.names, "lang_pred", "score", "bits", "rejected"])

    return rows.mapInArrow(apply, schema_with(
        rows, "lang_pred string, score double, bits double, rejected boolean"))


def langid_query(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold_of = crc_fold(F.col("doc_id"), FOLDS)
    fitted = fit(docs.filter(fold_of != HELD_OUT).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), fitted, reject=False).select(
        "doc_id", (fold_of == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
