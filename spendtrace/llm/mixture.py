"""Mix sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected number of
copies is target / source size, times its own weight where one is given. The
whole part of that number is taken for certain; the rest is the inclusion
probability p of one more copy. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u uniform in (0, 1), and the first ones are
taken until the words that remain to the target are used up.

The order within a source is never sorted as a whole. The rank has a value in
(0, 1), so its first bits give a bucket; sums per bucket, combined before their
shuffle, show in which bucket the source reaches its target, and only rows of
that one bucket are ordered row by row.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import WORD, quoted, set_aside, table
from spendtrace.session import materialize

WEIGHTS = (5, 2, 1)
LARGEST_FACTOR = 3
BUCKETS = 1 << 16
SEED = "mixture"
_UNIT_BITS = 52


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   factor: int = LARGEST_FACTOR) -> DataFrame:
    """(source, source_size) to targets: shares by weight, at most factor x size.

    Sources in code point order, null last, take the weights in turn. What a
    source may not take is shared again by weight. With sources ordered by
    cap / weight, those before some point are at their cap and the others get
    weight x level. Levels do not rise from that point on, so the largest one that
    is not above its ratio is the level. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    base = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
        .withColumn("cap", F.col("source_size") * factor)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything)
             - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = base.withColumn("level", level).withColumn(
        "common", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return levelled.select(
        "source", "source_size",
        F.when(F.col("common").isNull() | (F.col("ratio") < F.col("common")),
               F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("common")).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on `key` and `seed` only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    digits = _UNIT_BITS // 4
    value = F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    return (value + F.lit(0.5)) / F.lit(float(1 << _UNIT_BITS))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: int = LARGEST_FACTOR,
        seed: str = SEED, doc_weight: str | None = None,
        keep: list[str] | None = None) -> DataFrame:
    """Rows of `docs` with size, source_size, target, copies and taken (copies x size).

    `docs` needs doc_id, text and source; `keep` names the columns to return,
    all by default. The words are counted once into a narrow table for the
    totals, and again only if the texts are returned. `doc_weight` names a column of
    positive numbers that raise or lower a document's chance relative to the
    others of its source; without one all of a source have the same chance.
    A document takes at most `factor` copies.

    Null text has size 0 and takes what the order gives it, 0 words. Null
    sources form one source, ordered last. A row's number follows from its id,
    text and source, so rows with null or repeated ids and different texts are
    drawn apart; rows equal in all three draw the same number, cannot be told
    apart, and any of them may be the one taken. An empty table gives no rows.
    Other columns are kept, whatever their names; those named like a result are
    replaced.
    """
    made = {"size", "source_size", "target", "copies", "taken"}
    needed = ("doc_id", "text", "source", *([doc_weight] if doc_weight else []))
    names = [c for c in keep or docs.columns if c.lower() not in made]
    docs = docs.select(*[quoted(c) for c in dict.fromkeys([*needed, *names])])
    docs, back = set_aside(docs, needed)
    kept = [column for column, name in zip(back, dict.fromkeys([*needed, *names])) if name in names]
    weight = F.col(doc_weight).cast("double") if doc_weight else F.lit(1.0)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                      F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
                      F.coalesce(F.col("source").cast("string"), F.lit("null")))
    counted = docs.withColumn("_w", weight).withColumn("size", n_words(F.col("text"))).withColumn(
        "_u", uniform(key, seed))
    narrow = materialize(counted.select("doc_id", "source", "_w", "_u", "size"), "mixture-sizes")
    base = narrow if set(names) <= {"doc_id", "source"} else counted
    totals = materialize(narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_sum")),
        "mixture-sources")
    targets = source_targets(totals.select("source", "source_size"), weights, factor)
    per_source = totals.select(F.col("source").alias("_s"), "_sum").join(
        targets, F.col("_s").eqNullSafe(F.col("source"))).select(
        "_s", "source_size", "target",
        F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(F.lit(0.0))
        .alias("_rate"))
    per_source = materialize(per_source, "mixture-targets")

    wanted = F.least(F.col("_rate") * F.col("_w"), F.lit(float(factor)))
    u = F.col("_u")

    def rank(rows: DataFrame) -> DataFrame:
        return (
            rows.join(per_source, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_whole", F.floor(wanted).cast("long"))
            .withColumn("_p", wanted - F.col("_whole"))
            .withColumn("_q", F.when(
                F.col("_p") > 0, (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))))
            .withColumn("_bucket", F.floor(
                F.col("_q") / (1 + F.col("_q")) * BUCKETS).cast("int"))
        )

    ranked = rank(narrow)
    # Words per source and bucket, running in the order of the buckets.
    sums = ranked.groupBy("source").agg(
        F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    buckets = ranked.filter(F.col("_bucket").isNotNull()).groupBy("source", "_bucket").agg(
        F.sum("size").alias("_words"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    crossing = (
        buckets.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
        .select(F.col("source").alias("_b"), "_bucket", "_words", "_before")
        .join(sums.select(F.col("source").alias("_c"), "_certain"),
              F.col("_b").eqNullSafe(F.col("_c")))
        .join(per_source.select("_s", "target"), F.col("_b").eqNullSafe(F.col("_s")))
        .withColumn("_room", F.col("target") - F.col("_certain"))
        # The first bucket that reaches past the room, per source.
        .filter(F.col("_before") + F.col("_words") > F.col("_room"))
        .groupBy("_b").agg(F.min(F.struct("_bucket", "_before", "_room")).alias("_cut"))
        .select(F.col("_b").alias("_x"), F.col("_cut._bucket").alias("_at"),
                F.col("_cut._before").alias("_used"), F.col("_cut._room").alias("_room"))
    )
    crossing = materialize(crossing, "mixture-cuts")
    placed = rank(base).join(crossing, F.col("source").eqNullSafe(F.col("_x")), "left")
    # Only rows of the crossing bucket need their order; the others are their own group.
    at_edge = F.col("_bucket").isNotNull() & F.col("_at").isNotNull() & (
        F.col("_bucket") == F.col("_at"))
    clear = placed.filter(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "_more", (F.col("_bucket").isNotNull()
                  & (F.col("_at").isNull() | (F.col("_bucket") < F.col("_at")))).cast("int"))
    in_bucket = Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    prior = F.col("_used") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    # A document is taken if more than half of it fits, so that the end is the nearer one.
    edge = placed.filter(at_edge).withColumn("_prior", prior).withColumn(
        "_more", (F.col("_prior") + F.col("size") / 2 <= F.col("_room")).cast("int")).drop("_prior")
    copies = F.least(F.col("_whole") + F.coalesce(F.col("_more"), F.lit(0)),
                     F.lit(factor).cast("long"))
    return clear.unionByName(edge).withColumn("copies", copies).withColumn(
        "taken", F.col("copies") * F.col("size")).select(
        *kept, "size", "source_size", "target", "copies", "taken")


def expand_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy that the mix takes, with the columns of the documents."""
    return mixed.filter(F.col("copies") > 0).select(
        *columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    ).drop("_copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as a corpus: a row per copy, with the columns of `docs` as they are."""
    inner, back = set_aside(docs, ("doc_id", "text", "source"))
    return expand_copies(mix(inner, **options), inner.columns).select(*back)


def mixture_query(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), keep=["doc_id", "source"]).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


MIXTURE_SQL = rf"""
with base as (
  select doc_id, source, md5(coalesce(text, '')) as digest,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
weighed as (select *, [5,2,1][1 + ((row_number() over (order by source nulls last)) - 1) % 3] as weight
  from sizes),
ratios as (select *, source_size * 3 as cap, (source_size * 3)::double / weight as ratio from weighed),
levels as (select *,
    (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last
       rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by ratio, source nulls last
       rows between current row and unbounded following) as level from ratios),
common as (select *, max(case when level <= ratio then level end) over () as common from levels),
targets as (select source, source_size,
    case when common is null or ratio < common then cap::double else weight * common end as target
  from common),
drawn as (select b.doc_id, b.source, b.size, t.source_size, t.target,
    least(case when t.source_size > 0 then t.target / t.source_size::double else 0.0 end, 3.0::double)
      as wanted,
    (('0x' || substr(md5('{SEED}:' || coalesce(b.doc_id::varchar, 'null') || ':' || b.digest || ':' || coalesce(b.source, 'null')), 1, 13))::bigint + 0.5::double)
      / 4503599627370496.0::double as u
  from base b join targets t on b.source is not distinct from t.source),
ranked as (select *, floor(wanted)::bigint as whole, wanted - floor(wanted)::bigint as p from drawn),
ordered as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from ranked),
run as (select *, sum(whole * size) over (partition by source) as certain,
    sum(case when q is not null then size else 0 end) over (partition by source
      order by q nulls last, doc_id, size rows between unbounded preceding and current row) as upto
  from ordered)
select doc_id, size, source_size, target,
  least(whole + more, 3) * size as taken, least(whole + more, 3) as copies
from (select *, case when q is not null and upto - size + size / 2.0::double <= target - certain
        then 1 else 0 end as more from run)
"""
