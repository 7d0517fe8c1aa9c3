"""Alignment of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE, B a BPE of pieces with byte fallback. Both cut
the bytes of a space and the text. Where a token of A and a token of B end at
the same byte the two sequences can be cut; the tokens between two cuts are a
group, and the two tokens that end at a cut are linked.

All documents of a batch are merged at once: one NumPy array holds the pointer
into A of each unfinished document, another one that into B. In each step every
document moves the pointer whose token ends first, or both where the ends agree,
which emits a link and a cut. Documents that are through leave the arrays.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import byte_texts, join_frequent, table, text_chunks
from spendtrace.session import materialize

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 2 << 20

# Fixed pattern of the byte-level pre-tokenizer.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
           r"|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves, the others are numbered from 256.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from its JSON file; strings of special tokens are plain text.

    A vocabulary numbered in the order of its merges is one of ranks, which a
    faster library encodes; any other is left to the library of the file.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocab, letters = told["model"]["vocab"], _byte_letters()
        special = {t["content"] for t in told["added_tokens"]}
        entries = {word: bytes(letters[c] for c in word) for word in vocab if word not in special}
        size = 1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])])
        self.bytes = [b""] * size
        for word, data in entries.items():
            self.bytes[vocab[word]] = data
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        in_order = [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
        plain = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False,
                                          "trim_offsets": True, "use_regex": True}
        if in_order and plain and len(entries) == 256 + len(merges) and told["normalizer"] is None:
            import tiktoken

            coder = tiktoken.Encoding("a", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
                data: vocab[word] for word, data in entries.items()})
            self.encode = lambda texts: [coder.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda texts: [
                e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """BPE of pieces; a piece's bytes have U+2581 as space and <0xHH> as that byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode() for i in range(len(model))]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _coder(kind: type, path: str):
    coder = kind(path)
    return coder, np.array([len(b) for b in coder.bytes], np.int64)


def lockstep(ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray,
             starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, a, b) of every pair of tokens that end together, by document and place.

    `ends_*` are the byte ends of the tokens of all documents in turn, `starts_*`
    the place of each document's first token and, last, their number. A document
    ends both of its sequences at the same byte.
    """
    live = np.flatnonzero((np.diff(starts_a) > 0) & (np.diff(starts_b) > 0))
    at_a, at_b, last = starts_a[live].copy(), starts_b[live].copy(), starts_a[live + 1]
    documents, found_a, found_b = [], [], []
    while len(live):
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        linked = end_a == end_b
        documents.append(live[linked])
        found_a.append(at_a[linked])
        found_b.append(at_b[linked])
        at_a += end_a <= end_b
        at_b += end_b <= end_a
        going = at_a < last
        if not going.all():
            live, at_a, at_b, last = live[going], at_a[going], at_b[going], last[going]
    if not documents:
        return (np.zeros(0, np.int64),) * 3
    document = np.concatenate(documents)
    order = np.argsort(document, kind="stable")
    return document[order], np.concatenate(found_a)[order], np.concatenate(found_b)[order]


def _tokens(coder, texts: list[str], wanted: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    """Ids of each text, and whether their bytes are the wanted ones."""
    ids = coder.encode(texts)
    same = [b"".join(map(coder.bytes.__getitem__, i)) == w for i, w in zip(ids, wanted)]
    return ids, np.array(same, bool)


def _flat(ids: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the start of each document, and the byte end of each token in its document."""
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int64, starts[-1])
    running = np.concatenate([[0], np.cumsum(lengths[flat])])
    return flat, starts, running[1:] - np.repeat(running[starts[:-1]], np.diff(starts))


def _lists(counts: np.ndarray, *fields: tuple[str, np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = [pa.array(v.astype(np.int32)) for _, v in fields]
    inner = values[0] if len(fields) == 1 else pa.StructArray.from_arrays(
        values, [name for name, _ in fields])
    return pa.ListArray.from_arrays(pa.array(ends), inner)


def _align(path_a: str, path_b: str):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (coder_a, lengths_a), (coder_b, lengths_b) = _coder(ByteLevel, path_a), _coder(Pieces, path_b)
        names_a, names_b = (list(map(str, range(len(x)))) for x in (lengths_a, lengths_b))
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            data = byte_texts(batch.column("text"))
            texts = [t.decode() for t in data]
            wanted = [b" " + t for t in data]
            ids_a, same_a = _tokens(coder_a, [" " + t for t in texts], wanted)
            ids_b, same_b = _tokens(coder_b, texts, wanted)
            whole = same_a & same_b & np.array([len(t) > 0 for t in data], bool)
            ids_a = [i if ok else [] for i, ok in zip(ids_a, whole)]
            ids_b = [i if ok else [] for i, ok in zip(ids_b, whole)]
            flat_a, starts_a, ends_a = _flat(ids_a, lengths_a)
            flat_b, starts_b, ends_b = _flat(ids_b, lengths_b)
            document, a, b = lockstep(ends_a, starts_a, ends_b, starts_b)
            links = np.bincount(document, minlength=len(texts))
            stops = np.concatenate([[0], np.cumsum(links)])
            words = []
            for i in range(len(texts)):
                cut = slice(stops[i], stops[i + 1])
                words.append(_written(ids_a[i], (a[cut] - starts_a[i] + 1).tolist(), names_a,
                                      ids_b[i], (b[cut] - starts_b[i] + 1).tolist(), names_b))
            # Document and both ids in one number, which sorts far faster than rows of three.
            packed = (document * len(lengths_a) + flat_a[a]) * len(lengths_b) + flat_b[b]
            pairs, times = np.unique(packed, return_counts=True)
            owner, pair = np.divmod(pairs, len(lengths_a) * len(lengths_b))
            id_a, id_b = np.divmod(pair, len(lengths_b))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts_a)), pa.array(np.diff(starts_b)),
                 pa.array(words, pa.large_string()).cast(pa.string()), _lists(links, ("ends", ends_a[a])),
                 _lists(np.bincount(owner, minlength=len(texts)), ("a", id_a), ("b", id_b),
                        ("times", times))],
                ["doc_id", "n_a", "n_b", "groups", "cuts", "links"])

    return aligned


def _written(a: list[int], cuts_a: list[int], names_a: list[str],
             b: list[int], cuts_b: list[int], names_b: list[str]) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group."""
    parts, from_a, from_b = [], 0, 0
    for to_a, to_b in zip(cuts_a, cuts_b):
        left = names_a[a[from_a]] if to_a == from_a + 1 else ",".join(
            [names_a[i] for i in a[from_a:to_a]])
        right = names_b[b[from_b]] if to_b == from_b + 1 else ",".join(
            [names_b[i] for i in b[from_b:to_b]])
        parts.append(f"{left}|{right}")
        from_a, from_b = to_a, to_b
    return ";".join(parts)


def align(docs: DataFrame, folder: str = TOKENIZERS, file_a: str = FILE_A,
          file_b: str = FILE_B) -> DataFrame:
    """(doc_id, n_a, n_b, groups, cuts, links), a row per row of `docs`.

    `groups` has the ids of each group as `a1,a2|b1;a3|b2,b3`, `cuts` the byte
    ends of the groups in a space and the text, `links` the distinct linked id
    pairs of the document and how often each occurs. Null and empty texts, and
    texts of which a tokenizer does not give back every byte, have no tokens,
    an empty string and empty lists. Repeated rows are aligned each. An empty
    table gives no rows; only doc_id and text are used.

    The tokenizer files lie in `folder` of every executor. A document is
    tokenized whole, in the memory of one task.
    """
    doc_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _align(os.path.join(folder, file_a), os.path.join(folder, file_b)),
        f"doc_id {doc_type}, n_a long, n_b long, groups string, cuts array<int>, "
        "links array<struct<a: int, b: int, times: int>>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, holders, best) of the linked id pairs of all rows (a, b, times).

    `count` is the number of links, `holders` that of rows, and `best` tells the
    pairs with the highest count of their b. The window holds one row per id of
    A, at most a vocabulary.
    """
    counts = links.groupBy("a", "b").agg(F.sum("times").alias("count"), F.count("*").alias("holders"))
    highest = F.max("count").over(Window.partitionBy("b"))
    return counts.withColumn("best", F.col("count") == highest)


def alignment_counts(docs: DataFrame, **tokenizers: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of `docs`.

    Two tokens end at a cut and tokens have a byte at least, so a document has
    as many links as groups. `n_best` counts the links whose pair is the most
    frequent one of its B id in all documents, ties included; `count_sum` adds
    the pairs' counts over the links. Rows without tokens have zeros and an
    empty digest. Nulls, repeats and further columns are treated as by `align`.
    """
    groups = F.size("cuts").cast("long")
    digest = F.when(groups > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = materialize(align(docs, **tokenizers).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b",
        groups.alias("n_groups"), digest.alias("groups_sha256"), "links"), "alignments")
    key = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    # Both ids in one number; rows without links have negative numbers of their own.
    pair = F.coalesce(F.shiftleft(F.col("_l.a").cast("long"), 32) + F.col("_l.b"), -1 - F.col("row"))
    links = rows.select(*key, F.explode_outer("links").alias("_l")).select(
        *key, pair.alias("pair"), "_l.times")
    counts = materialize(pair_counts(rows.select(F.explode("links").alias("_l")).select("_l.*")).select(
        (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "count", "holders",
        "best"), "pair-counts")
    times = F.col("times")
    return join_frequent(links, counts, "pair", "holders").groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("best"), times)), F.lit(0)).cast("long").alias("n_best"),
        F.coalesce(F.sum(times * F.col("count")), F.lit(0)).cast("long").alias("count_sum")).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best",
        "count_sum", "groups_sha256")


def alignment_query(spark, folder: str) -> DataFrame:
    return alignment_counts(table(spark, folder, "documents"))
