"""Benchmark decontamination by winnowing.

Words of test items and documents are lower-cased in A-Z. A *window* is `span`
consecutive item words, or all words of a shorter item. Of the k-gram hashes of
a window the smallest is its fingerprint. A document keeps, for every `span`
consecutive words, the smallest k-gram hash with its position, which is about
two k-grams in every seven. Whatever window document and item share, both sides
choose the same hash in it, so a join of the kept hashes finds every shared
window, whatever its place. Hits are then extended: each possible window around
a hit is compared word by word with the windows of the items.

Items shorter than `span` have windows of their own lengths, so the document is
also winnowed for each shorter length that occurs among the items (fewer than
`span` lengths).

Texts are read once. Fingerprints carry the few words around them, so hits are
extended without reading the document again. Everything is built from DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.common import let, set_aside, small_or_shuffled, table
from spendtrace.session import materialize

SPAN = 10
KGRAM = 5
BLOCK = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Java regex of what stands between words: ASCII that is no letter or digit.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The low bits of a fingerprint hold its position in the block.
POSITION = (1 << 16) - 1


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def kgram(span: int) -> int:
    return min(KGRAM, span)


def joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, span, content, fingerprint): the distinct windows of each item."""
    rows = items.select("item_id", words_of(F.col("text")).alias("_words")).filter(
        F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(span))
    rows = rows.withColumn("span", length).withColumn(
        "_start", F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("span") + 1))).withColumn(
        "_window", F.slice("_words", F.col("_start"), F.col("span")))
    width = F.least(F.col("span"), F.lit(KGRAM))
    hashes = F.transform(F.sequence(F.lit(1), F.col("span") - width + 1),
                         lambda i: _high(F.xxhash64(F.slice(F.col("_window"), i, width))))
    return rows.select(
        "item_id", "span", F.array_join("_window", " ").alias("content"),
        F.array_min(hashes).alias("fingerprint")).distinct()


def _high(value: Column) -> Column:
    """A hash without the bits that hold the position."""
    return value.bitwiseAND(F.lit(~POSITION))


def fingerprints(words: Column, span: int) -> Column:
    """Kept (hash, place, around) of an array of words for windows of `span` words.

    `place` is the index, from 0, of the first word of `around`, which reaches
    over all windows that the k-gram could have been kept for.
    """
    k, n = kgram(span), F.size(words)
    # High bits hash, low bits position: the smallest one is the leftmost of equals.
    hashed = F.transform(
        F.slice(words, 1, F.greatest(n - k + 1, F.lit(0))),
        lambda _, i: _high(F.xxhash64(F.slice(words, i + 1, k))).bitwiseOR(i.cast("long")))
    kept = let(hashed, lambda h: F.array_distinct(F.transform(
        F.slice(h, 1, F.greatest(n - span + 1, F.lit(0))),
        lambda _, i: F.array_min(F.slice(h, i + 1, span - k + 1)))))

    def around(fp: Column) -> Column:
        at = fp.bitwiseAND(F.lit(POSITION)).cast("int")
        first = F.greatest(at - (span - k), F.lit(0))
        return F.struct(
            _high(fp).alias("fingerprint"), F.lit(span).alias("span"), first.alias("place"),
            joined(words, first + 1, at + span - first).alias("around"))

    return F.transform(kept, around)


def contaminate(docs: DataFrame, items: DataFrame, span: int = SPAN,
                block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated), a row per row of `docs`.

    `docs` needs doc_id and text, `items` item_id and text. A word is hit if it
    lies in an occurrence of a window; `items` are the ids with an occurring
    window, distinct and sorted as strings. Null and wordless texts have no
    words and no hits. Rows are told apart by id and a 128-bit digest of the
    text, so equal rows have equal results and ids may repeat or be null. Null
    item ids count under the empty name. An empty table of documents gives no
    rows; without items nothing is hit. Other columns are not used.

    Long documents are cut into blocks of `block` words that overlap by the
    span, so a row of the plan stays small whatever the text.
    """
    spark = docs.sparkSession
    windows = materialize(item_windows(items, span), "benchmark-windows")
    spans = sorted(r[0] for r in windows.select("span").distinct().collect()) or [span]
    known = windows.select("fingerprint", "span").distinct().withColumn("known", F.lit(True))

    # One row per block; the first also stands for the document itself.
    def cut(all_words: Column) -> Column:
        n = F.size(all_words)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(block))
        return F.transform(starts, lambda s: F.struct(
            s.alias("start"), n.cast("long").alias("n_words"),
            F.slice(all_words, s + 1, block + span - 1).alias("words")))

    blocks = docs.select(
        "doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_digest"),
        F.explode(let(words_of(F.col("text")), cut)).alias("_block")).withColumn(
        "n_words", F.col("_block.n_words"))
    words = F.col("_block.words")
    marker = F.when(F.col("_block.start") == 0, F.array(F.struct(
        F.xxhash64("_digest").alias("fingerprint"), F.lit(0).alias("span"), F.lit(0).alias("place"),
        F.lit("").alias("around")))).otherwise(F.array())
    found = F.concat(marker, *[fingerprints(words, s) for s in spans])
    marks = blocks.select("doc_id", "_digest", "n_words", F.col("_block.start").alias("_start"),
                          F.explode(found).alias("_f")).select(
        "doc_id", "_digest", "n_words", "_start", "_f.*")
    hits = (
        marks.join(small_or_shuffled(known), ["fingerprint", "span"], "left")
        .filter((F.col("span") == 0) | F.col("known"))
        .select("doc_id", "_digest", "n_words", "span",
                (F.col("_start") + F.col("place")).cast("long").alias("place"), "around")
    )
    hits = materialize(hits, "benchmark-hits")

    around = F.split("around", " ")
    tries = hits.filter(F.col("span") > 0).select(
        "doc_id", "_digest", "span", "place", around.alias("_words")).distinct().select(
        "doc_id", "_digest", "span", "place", "_words", F.explode(F.sequence(
            F.lit(0), F.size("_words") - F.col("span"))).alias("_at")).select(
        "doc_id", "_digest", "span", (F.col("place") + F.col("_at")).alias("place"),
        joined(F.col("_words"), F.col("_at") + 1, F.col("span")).alias("content")).distinct()
    contents = windows.groupBy("span", "content").agg(F.collect_set(
        F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("_ids"))
    matched = materialize(tries.join(
        small_or_shuffled(contents), ["span", "content"]), "benchmark-matches")

    key = ["doc_id", "_digest"]
    hit_words = matched.select(*key, F.explode(F.sequence(
        F.col("place"), F.col("place") + F.col("span") - 1)).alias("_word")).distinct().groupBy(
        *key).agg(F.count("*").alias("_n_hit"))
    # Windows of the same items say the same, so only distinct sets are opened.
    hit_items = matched.select(*key, "_ids").distinct().select(
        *key, F.explode("_ids").alias("_id")).groupBy(*key).agg(
        F.sort_array(F.collect_set("_id")).alias("_items"))
    result = hit_words.join(hit_items, (hit_words["doc_id"].eqNullSafe(hit_items["doc_id"]))
                            & (hit_words["_digest"] == hit_items["_digest"])).select(
        hit_words["doc_id"].alias("_d"), hit_words["_digest"].alias("_g"), "_n_hit", "_items")
    rows = hits.filter(F.col("span") == 0).select("doc_id", "_digest", "n_words")
    return rows.join(result, rows["doc_id"].eqNullSafe(F.col("_d"))
                     & (rows["_digest"] == F.col("_g")), "left").select(
        "doc_id", "_digest", "n_words", F.coalesce(F.col("_n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.col("_items"), F.array().cast("array<string>")).alias("items"),
        F.col("_n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows of `docs` in which no word is hit, with all their columns, whatever these are called."""
    inner, back = set_aside(docs, ("doc_id", "text"))
    bad = contaminate(inner, items, span).filter("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("_digest").alias("_bad_digest")).distinct()
    bad = materialize(bad, "contaminated")
    keyed = inner.withColumn("_digest", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return keyed.join(small_or_shuffled(bad), keyed["doc_id"].eqNullSafe(F.col("_bad_id"))
                      & (keyed["_digest"] == F.col("_bad_digest")), "left_anti").select(*back)


def decontaminate_query(spark, folder: str) -> DataFrame:
    got = contaminate(table(spark, folder, "documents").select("doc_id", "text"),
                      table(spark, folder, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


DECONTAMINATE_SQL = rf"""
with docs as (select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_starts as (select item_id, w, least(len(w), {SPAN}) as span,
    unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) as i from items where len(w) > 0),
windows as (select distinct item_id, span, array_to_string(w[i:i + span - 1], ' ') as content
  from item_starts),
doc_starts as (select doc_id, w, s.span, unnest(range(1, len(w) - s.span + 2)) as i
  from docs, (select distinct span from windows) s where len(w) >= s.span),
found as (select distinct d.doc_id, d.i, d.span, x.item_id
  from (select doc_id, i, span, array_to_string(w[i:i + span - 1], ' ') as content
        from doc_starts) d join windows x using (span, content)),
hit as (select doc_id, count(distinct word) as n_hit from
  (select doc_id, unnest(range(i, i + span)) as word from found) group by doc_id),
ids as (select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as digest from
  (select distinct doc_id, item_id::varchar as id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, coalesce(digest, sha256('')) as items_sha256,
  n_hit is not null as contaminated
from docs left join hit using (doc_id) left join ids using (doc_id)
"""
