"""Rows on their way into keyed state and out of it, packed by bucket.

A state call or a frame per customer costs far more than the work on a few rows.
Customers are therefore dealt to a fixed number of buckets, the keys of the state,
and the rows of a bucket travel as one Arrow table in a binary column. What is
wide, the earlier steps of each row, is laid out only on the way out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spendtrace import contract as C

# Keys of the state, and so the most tasks that share a stream. Part of a checkpoint.
BUCKETS = 512
# Rows that a task gathers before it packs them.
GATHERED = 200_000
PACKED = "bucket int, rows binary"
TAKEN = "rows binary, vectors binary, moments binary"

WIDTH = len(C.FEATURES)
_LZ4 = pa.ipc.IpcWriteOptions(compression="lz4")


def bucket_of(customer: str = "customer_id") -> Column:
    return F.pmod(F.xxhash64(customer), F.lit(BUCKETS)).cast("int")


def to_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_LZ4) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(data)) as held:
        return held.read_all()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a `bucket` as one packed table per bucket and stretch of input."""
    gathered, count = [], 0
    for batch in batches:
        gathered.append(batch)
        count += batch.num_rows
        if count >= GATHERED:
            yield _by_bucket(gathered)
            gathered, count = [], 0
    if count:
        yield _by_bucket(gathered)


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    order = np.argsort(table["bucket"].to_numpy(), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    buckets = table["bucket"].to_numpy()
    table = table.drop_columns("bucket")
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    ends = np.concatenate([starts[1:], [len(buckets)]])
    rows = [to_bytes(table.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[starts], pa.int32()), pa.array(rows, pa.binary())], ["bucket", "rows"])


def taken(rows: pa.Table, pieces: list[dict[str, np.ndarray]]) -> tuple[bytes, bytes, bytes]:
    """Rows with what `Past.take` gave for each stretch of them, as `unpack` reads it."""
    vectors, first, upto, at = [], [], [], 0
    for piece in pieces:
        lead, own = piece["lead"], piece["features"]
        place = np.arange(at + len(lead), at + len(lead) + len(own))
        first.append(np.maximum(place - C.SEQUENCE_LENGTH, at))
        upto.append(place)
        vectors += [lead, own]
        at = place[-1] + 1
    for name, parts in (("first", first), ("upto", upto), *(
            (c, [p[c] for p in pieces]) for c in ("is_late", "n_prior"))):
        rows = rows.append_column(name, pa.array(np.concatenate(parts)))
    moments = np.concatenate([np.hstack((p["means"], p["stds"])) for p in pieces])
    return to_bytes(rows), np.concatenate(vectors).tobytes(), moments.tobytes()


def unpack(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Taken rows with their columns in the order of `names`."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in zip(*(batch.column(c) for c in ("rows", "vectors", "moments"))):
                yield _laid_out(*(p.as_py() for p in part), names)
    return rows


def _laid_out(rows: bytes, vectors: bytes, moments: bytes, names: list[str]) -> pa.RecordBatch:
    table = from_bytes(rows).combine_chunks()
    vectors = np.frombuffer(vectors).reshape(-1, WIDTH)
    moments = np.frombuffer(moments).reshape(-1, 2 * WIDTH)
    first, upto = table["first"].to_numpy(), table["upto"].to_numpy()
    lengths = upto - first
    ends = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)
    steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _lists(vectors[places]))
    columns = {c: table[c].chunk(0) if table.num_rows else pa.array([], table[c].type) for c in table.column_names}
    columns |= {"features": _lists(vectors[upto]), "steps": steps,
                "means": _lists(moments[:, :WIDTH]), "stds": _lists(moments[:, WIDTH:])}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def _lists(values: np.ndarray) -> pa.ListArray:
    """Each row as a list; what is not a number, as from a snapshot's null, is null."""
    ends = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel(), from_pandas=True))
