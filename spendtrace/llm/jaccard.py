"""Exact Jaccard join on word shingles by partitioning the universe.

Two sets of sizes r and s with a Jaccard similarity of at least t differ in at
most H = floor((r + s)(1 - t) / (1 + t)) members. Members are hashed into
segments, whose number depends on the band of sizes. If a set has more than H
segments that are not empty, a similar set agrees with it in one whole segment
at least, so the hash of each segment's subset is an index key.

Allocation. Per band the number of segments is the smallest with which sets of
the band have H + 1 filled segments with room to spare; in small bands, where
that would be more segments than members, each member is its own segment. The
few sets that still fill too few segments are allocated a second unit on
segments of two or more members: such a segment also gives the keys of its
one-deletion neighbourhood, so that a difference of one in it is found too. If
that is not enough either, the members themselves are keys. One sufficient set
of a pair is enough, so each dearer kind of key is only for pairs of sets that
were both insufficient before.

Pruning. A key held by one set is a segment in which that set differs from all
others; with more than H of them it has no partner. The rest of a set's keys are
taken from the rarest on, and H + 1 of them, the single ones counted, suffice
for any partner, so frequent passages hardly ever become candidates.

Verification is exact, on the sets themselves. Each set has a sketch of 512
bits, the parities of its members by a hash; two sets differ in at least as many
members as their sketches in bits, so most pairs are ruled out by their
sketches. Large groups of near copies are not expanded into pairs: a group is
compared with its most typical set, and sets linked with that one need no
comparison among each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import (
    byte_texts, mix, run_hashes, schema_with, set_aside, small_or_shuffled, table, text_chunks,
    word_hashes,
)
from spendtrace.llm.components import connected_components
from spendtrace.session import materialize

WORDS_PER_SHINGLE = 5
PERCENT = 75
STAR_ROUNDS = 3
_SPARE = 4.0  # standard deviations of filled segments
SKETCH_LONGS = 8
_WIDEST = 40  # bands: sets of up to 2 ** 40 members


def most_different(r, s, percent: int = PERCENT):
    """H for sizes r and s (numbers or arrays)."""
    return (r + s) * (100 - percent) // (100 + percent)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.frexp(sizes.astype(np.float64))[1] - 1


def segments_of_band(band: int, percent: int = PERCENT) -> int:
    """Number of segments for sizes 2**band to 2**(band+1)-1, 0 for one per member."""
    size = (1 << (band + 1)) - 1
    need = most_different(size, size * 100 // percent, percent) + 1
    m = need
    while m < size:
        a = size / m
        empty = math.exp(-a)
        spread = math.sqrt(m * empty * (1 - (1 + a) * empty))
        if m * (1 - empty) - _SPARE * spread >= need:
            return m
        m += max(1, m // 50)
    return 0


def ascending(values: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


class Sets:
    """The shingle sets of a piece of documents, one after the other, each ascending."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        words, counts = word_hashes([t.lower() for t in texts])
        hashed = run_hashes(words, width)
        ends = np.cumsum(counts)
        parts = []
        for start, end in zip(ends - counts, ends):
            n = end - start
            if n >= width:
                parts.append(ascending(hashed[start:end - width + 1]))
            elif n:  # the whole sequence, told apart from longer ones by its length
                parts.append(run_hashes(np.append(words[start:end], np.uint64(n)), n + 1)[:1])
            else:
                parts.append(words[:0])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.members = np.concatenate(parts) if parts else words[:0]
        self.owner = np.repeat(np.arange(len(parts)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        scrambled = mix(self.members)
        self.low = mix(self._sums(scrambled) + self.sizes.astype(np.uint64))
        self.high = mix(self._sums(mix(scrambled ^ np.uint64(0xA5A5A5A5A5A5A5A5))))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.sizes), np.uint64)
        filled = self.sizes > 0
        if filled.any():
            total[filled] = np.add.reduceat(values, self.starts[filled])
        return total


class Keys:
    """Index keys of sets in one role: with their own band (0) or the one below (1)."""

    def __init__(self, sets: Sets, role: int, percent: int, segments: np.ndarray) -> None:
        sizes = sets.sizes
        self.band = np.where(sizes > 0, band_of(np.maximum(sizes, 1)) - role, -1)
        if role:
            # Only sets with a possible partner in the band below.
            reach = -(-sizes * percent // 100) <= (1 << np.maximum(self.band + 1, 0)) - 1
            self.there = (self.band >= 0) & reach
            self.differ = most_different(sizes, (1 << np.maximum(self.band + 1, 0)) - 1, percent)
        else:
            self.there = sizes > 0
            self.differ = most_different(sizes, sizes * 100 // percent, percent)
        self.sets, self.role = sets, role
        use = self.there[sets.owner]
        self.member, self.owner = sets.members[use], sets.owner[use]
        m = segments[np.maximum(self.band, 0)][self.owner].astype(np.uint64)
        # Members ascend, so their segments do, and a segment is a stretch of members.
        segment = ((self.member >> np.uint64(32)) * m) >> np.uint64(32)
        new = np.ones(len(self.member), bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (segment[1:] != segment[:-1]) | (m[1:] == 0)
        self.start = np.flatnonzero(new)
        self.of = self.owner[self.start]
        self.filled = np.bincount(self.of, minlength=len(sizes))
        place = np.where(m == 0, self.member, segment)[self.start]
        self.where = mix(place + mix(self.band[self.of].astype(np.uint64)))
        self.value = np.add.reduceat(mix(self.member), self.start) if len(self.start) else \
            self.member[:0]

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, set, kind) of the sets in `chosen` (a mask)."""
        take = chosen[self.of]
        keys = [mix(self.value[take] + self.where[take])]
        of, kinds = [self.of[take]], [np.full(take.sum(), self.role)]
        short = np.flatnonzero(chosen & self.there & (self.filled <= self.differ))
        for i in short:
            a, b = np.searchsorted(self.of, [i, i + 1])
            key, units = [], 0
            for j in range(a, b):
                end = self.start[j + 1] if j + 1 < len(self.start) else len(self.member)
                inside = mix(self.member[self.start[j]:end])
                value = [self.value[j:j + 1]]
                units += min(2, len(inside))
                if len(inside) > 1:
                    value.append(self.value[j] - inside)
                key.append(mix(np.concatenate(value) + self.where[j] + np.uint64(1 << 60)))
            keys += key
            if units <= self.differ[i]:
                own = self.member[np.searchsorted(self.owner, i):np.searchsorted(self.owner, i + 1)]
                keys.append(mix(own + mix(np.array([int(self.band[i]) + (2 << 60)], np.uint64))))
            n = sum(map(len, keys)) - sum(map(len, of))
            of.append(np.full(n, i))
            kinds.append(np.full(n, 2))
        return np.concatenate(keys), np.concatenate(of), np.concatenate(kinds)


def band_segments(percent: int) -> np.ndarray:
    return np.array([segments_of_band(b, percent) for b in range(_WIDEST)], np.int64)


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Name (low, high) and size n of the set of each row of `docs`, and for both roles
    its filled segments and the H of its possible partners. Columns but the text stay."""
    kept = [c for c in docs.columns if c != "text"]
    segments = band_segments(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches, "text"):
            sets = Sets(byte_texts(piece.column("text")), width)
            own, lower = (Keys(sets, role, percent, segments) for role in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in kept), pa.array(sets.low.view(np.int64)),
                 pa.array(sets.high.view(np.int64)), pa.array(sets.sizes),
                 *map(pa.array, (own.filled, lower.filled, own.differ, lower.differ))],
                [*kept, "low", "high", "n", "filled0", "filled1", "differ0", "differ1"])

    return docs.select(*kept, "text").mapInArrow(run, schema_with(
        docs.select(*kept), "low long, high long, n long, filled0 long, filled1 long, "
        "differ0 long, differ1 long"))


def index_keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, low, kind) of all sets; equal sets of a task give their keys once."""
    segments = band_segments(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in text_chunks(batches, "text"):
            sets = Sets(byte_texts(piece.column("text")), width)
            new = np.zeros(len(sets.sizes), bool)
            for i, name in enumerate(sets.low.tolist()):
                new[i] = sets.sizes[i] > 0 and name not in seen
                seen.add(name)
            if len(seen) > 1_000_000:
                seen.clear()
            for role in (0, 1):
                key, of, kind = Keys(sets, role, percent, segments).rows(new)
                if len(key):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(sets.low[of].view(np.int64)),
                         pa.array(kind.astype(np.int32))], ["key", "low", "kind"])

    return docs.select("text").mapInArrow(run, "key long, low long, kind int")


def parities(sets: Sets) -> np.ndarray:
    """The sketch of each set, SKETCH_LONGS signed 64-bit numbers."""
    bits = SKETCH_LONGS * 64
    bit = (mix(sets.members ^ np.uint64(0x5555)) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount(sets.owner * bits + bit, minlength=len(sets.sizes) * bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).reshape(-1, SKETCH_LONGS)


def read_sets(docs: DataFrame, width: int) -> DataFrame:
    """(low, members, sketch) of each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches, "text"):
            sets = Sets(byte_texts(piece.column("text")), width)
            ends = np.append(sets.starts, len(sets.members)).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.members.view(np.int64)))
            sketch = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets.sizes) + 1, dtype=np.int32) * SKETCH_LONGS),
                pa.array(parities(sets).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.low.view(np.int64)), members, sketch], ["low", "members", "sketch"])

    return docs.select("text").mapInArrow(run, "low long, members array<long>, sketch array<long>")


def candidates(described: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, low): which sets meet under which key, after pruning; and (key, c).

    The second table names for each key the set to compare the others with: the
    one whose keys are on the whole held most often, so of near copies the one
    that has least of its own.
    """
    dealt = keys.repartition("key").dropDuplicates(["key", "low"])
    shared = dealt.withColumn("held", F.count("*").over(Window.partitionBy("key"))).filter(
        F.col("held") > 1)
    shared = materialize(shared, "shared-keys")

    sizes = described.filter("n > 0").groupBy("low").agg(
        *[F.max(c).alias(c) for c in ("filled0", "filled1", "differ0", "differ1")])
    own = F.col("kind") == 0
    per_set = shared.filter("kind < 2").groupBy("low", "kind").agg(
        F.count("*").alias("with_others"), F.sum("held").alias("held_all"))
    per_set = (
        per_set.join(sizes, "low")
        .withColumn("differ", F.when(own, F.col("differ0")).otherwise(F.col("differ1")))
        .withColumn("filled", F.when(own, F.col("filled0")).otherwise(F.col("filled1")))
        .withColumn("alone", F.col("filled") - F.col("with_others"))
        .filter(F.col("alone") <= F.col("differ"))
        .select("low", "kind", (F.col("differ") + 1 - F.col("alone")).alias("wanted"),
                (F.col("held_all") / F.col("filled")).alias("typical"))
    )
    rarest = Window.partitionBy("low", "kind").orderBy("held", "key")
    left = shared.join(per_set, ["low", "kind"]).withColumn("at", F.row_number().over(rarest)).select(
        "key", "low", "typical", (F.col("at") <= F.col("wanted")).alias("first")).unionByName(
        shared.filter("kind = 2").select("key", "low", F.lit(0.0).alias("typical"), F.lit(True).alias("first")))
    left = materialize(left, "left-keys")
    groups = left.groupBy("key").agg(
        F.count_if("first").alias("n"), F.max(F.struct("typical", "low")).alias("best")).filter("n > 1")
    groups = materialize(groups.select("key", F.col("best.low").alias("c")), "groups")
    met = left.filter("first").select("key", "low").distinct().join(groups.select("key"), "key")
    return materialize(met, "met"), groups


def linked(percent: int):
    return F.col("same") * 100 >= F.col("union") * percent


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, union) of distinct pairs (a, b)."""
    left = sets.select(F.col("low").alias("a"), F.col("members").alias("_left"))
    right = sets.select(F.col("low").alias("b"), F.col("members").alias("_right"))
    same = F.size(F.array_intersect("_left", "_right"))
    return pairs.distinct().join(left, "a").join(right, "b").select(
        "a", "b", same.alias("same"), (F.size("_left") + F.size("_right")).alias("_both")).select(
        "a", "b", "same", (F.col("_both") - F.col("same")).alias("union"))


def may_link(percent: int) -> Column:
    """Whether the sketches of (n, sketch) and (n_, sketch_) leave a link possible."""
    apart = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch_")[k]))
                 for k in range(SKETCH_LONGS)), F.lit(0))
    return apart <= F.floor((F.col("n") + F.col("n_")) * (100 - percent) / (100 + percent))


def in_order() -> list[Column]:
    return [F.least("low", "low_").alias("a"), F.greatest("low", "low_").alias("b")]


def links_of(met: DataFrame, centres: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets that meet under a key, enough to connect all that are similar.

    Per round the sets of a key are compared with its centre, at first the given
    one, later the smallest set left. Those linked with it are connected
    through it. The others are compared with the linked ones and go to the next
    round; what is left after the last round is compared in pairs. Pairs that
    the sketches rule out are never formed.
    """
    facts = sets.select("low", F.size("members").alias("n"), "sketch")

    def other(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(*keep, *[F.col(c).alias(f"{c}_") for c in ("low", "n", "sketch")])

    def compared(pairs: DataFrame) -> DataFrame:
        return materialize(verify(pairs.select(*in_order()), sets).filter(
            linked(percent)).select("a", "b"), "compared")

    found = []
    for _ in range(STAR_ROUNDS):
        # Keys often have the same centre; their sets are then one group.
        placed = materialize(met.join(centres, "key"), "placed")
        groups = materialize(placed.select("c", "low").distinct().join(facts, "low"), "groups")
        around = other(facts.join(centres.select(F.col("c").alias("low")).distinct(), "low"))
        pairs = materialize(groups.join(around.withColumn("c", F.col("low_")), "c").filter(
            "low <> c").filter(may_link(percent)).select("c", "low", "low_"), "rays")
        joined = compared(pairs)
        on = materialize(pairs.withColumns(dict(zip("ab", in_order()))).join(
            joined, ["a", "b"], "left_semi").select("c", "low").unionByName(
            centres.select("c", F.col("c").alias("low")).distinct()), "joined")
        near = groups.join(on, ["c", "low"], "left_semi")
        far = groups.join(on, ["c", "low"], "left_anti")
        found += [joined, compared(far.join(other(near, "c"), "c").filter(may_link(percent)))]
        met = materialize(placed.join(on, ["c", "low"], "left_anti").select("key", "low"), "met")
        centres = met.groupBy("key").agg(F.min("low").alias("c"), F.count("*").alias("_k")).filter(
            "_k > 1").select("key", "c")
        if centres.isEmpty():
            return _all(found, met)
    rest = met.join(facts, "low")
    found.append(compared(rest.join(other(rest, "key"), "key").filter("low < low_").filter(may_link(percent))))
    return _all(found, met)


def _all(found: list[DataFrame], like: DataFrame) -> DataFrame:
    links = like.select(F.col("low").alias("a"), F.col("low").alias("b")).limit(0)
    for part in found:
        links = links.unionByName(part)
    return materialize(links.distinct(), "set-links")


def near_duplicates(docs: DataFrame, width: int = WORDS_PER_SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of `docs` (doc_id, text).

    The component's id is the smallest doc_id that links reach. Null texts and
    texts without words have no shingles and stand alone. Equal texts are one
    set, joined once. A null doc_id is no one's smallest id unless all of a
    component are null. Repeated rows give repeated results; an empty table
    gives none. Other columns are not used.
    """
    described, named = named_sets(docs.select("doc_id", "text"), width, percent)
    reached = named.filter(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("_least").alias("_reached"))
    final = named.join(reached, "component", "left").select(
        "low", "high", F.coalesce("_reached", "_least").alias("component_id"))
    return described.filter("n > 0").join(final, ["low", "high"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        described.filter("n = 0").select(
            "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def named_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The description of each row of `docs`, and per distinct set (low, high, _least, component).

    `_least` is the smallest doc_id of the set; `component` is null for a set without links.
    """
    described = materialize(describe(docs, width, percent), "sets")
    met, centres = candidates(described, index_keys(docs, width, percent))
    wanted = materialize(met.select("low").unionByName(
        centres.select(F.col("c").alias("low"))).distinct(), "wanted")
    holders = materialize(described.join(wanted, "low").groupBy("low", "high").agg(
        F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "holders")
    some = docs.select("doc_id", "text").join(
        small_or_shuffled(holders.withColumnRenamed("doc_id", "_holder")),
        F.col("doc_id").eqNullSafe(F.col("_holder")), "left_semi")
    sets = materialize(read_sets(some, width).join(wanted, "low", "left_semi").dropDuplicates(
        ["low"]), "members")
    labels = connected_components(links_of(met, centres, sets, percent))
    labels = materialize(labels.withColumnRenamed("node", "low"), "labels")

    classes = described.filter("n > 0").groupBy("low", "high").agg(F.min("doc_id").alias("_least"))
    return described, classes.join(labels, "low", "left")


def one_of_each(docs: DataFrame, width: int = WORDS_PER_SHINGLE,
                percent: int = PERCENT) -> DataFrame:
    """One row of `docs` per component of similar texts, and every row without words.

    Of a component the row with the smallest doc_id stays, null ids last, then
    the one with the smallest digest of the text; of rows equal in both, any one.
    Rows are told apart by id and text, so equal or null ids do not shrink.
    """
    docs, back = set_aside(docs, ("doc_id", "text"))
    text1, text2, own, low, high, row = "_text1", "_text2", "_id", "_low", "_high", "_row"
    marked = docs.withColumns({
        text1: F.xxhash64("text"), text2: F.xxhash64(F.lit(1), "text")})
    described, named = named_sets(marked.select(
        "doc_id", "text", F.col(text1).alias("text1"), F.col(text2).alias("text2")), width, percent)
    # A set without links is a component by its whole name.
    placed = described.filter("n > 0").join(named.select(
        "low", "high", F.coalesce("component", "low").alias("_c"),
        F.when(F.col("component").isNull(), F.col("high")).alias("_d")), ["low", "high"])
    first = placed.groupBy("_c", "_d").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text1", "text2")).alias("_f")).select(
        F.col("_f.doc_id").alias(own), F.col("_f.text1").alias(text1), F.col("_f.text2").alias(text2),
        F.col("_c").alias(low), F.col("_d").alias(high), F.lit(True).alias(row))
    wordless = described.filter("n = 0").select(
        F.col("doc_id").alias(own), F.col("text1").alias(text1), F.col("text2").alias(text2)).distinct()
    kept = materialize(first.unionByName(wordless, allowMissingColumns=True), "kept").alias("k")
    found = marked.alias("m").join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (
        F.col(f"m.{text1}") == F.col(f"k.{text1}")) & (F.col(f"m.{text2}") == F.col(f"k.{text2}")))
    # Rows without words are numbered, so that each stays.
    return found.select(*docs.columns, low, high, F.when(
        F.col(row).isNull(), F.monotonically_increasing_id()).alias(row)).dropDuplicates(
        [low, high, row]).select(*back)


def jaccard_query(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


JACCARD_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
starts as (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS_PER_SHINGLE} + 1, 1) + 1)) as i
  from words where len(w) > 0),
shingles as (select distinct doc_id, w[i:i + {WORDS_PER_SHINGLE} - 1] as s from starts),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
met as (select x.doc_id as a, y.doc_id as b, count(*) as same
  from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
one_way as (select a, b from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * same >= {PERCENT} * (p.n + q.n - same)),
links as (select a, b from one_way union all select b, a from one_way),
reach as (select doc_id, doc_id as other from documents
  union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
from documents d left join sizes using (doc_id)
  join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
"""
