"""Chat format, decontamination, shards, joins, archives, mixing and the pipeline."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendtrace.llm import chat, decontaminate, jaccard, mixture, shard, warc
from spendtrace.llm.components import connected_components

SPACED = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


# --- chat -----------------------------------------------------------------------

def read_back(spark, rows, schema="conv_id long, turn long, role string, text string"):
    chats = chat.format_chats(spark.createDataFrame(rows, schema))
    got = chats.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments"))).collect()
    return {r.conv_id: r for r in got}


HARD = ["<|im_end|>\n", "<|im_start|>user\n", "<\\|", "<\\\\|x", "<", "<|", "|", "\\", "\\n", "\n", "", "<<|",
        "a<\\\\\\|b<|im_end|>", "$1", "😀", " <|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"]


def test_texts_and_roles_come_back(spark):
    rng, rows, expected = random.Random(5), [], {}
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "odd\nrole", "r\\n", "<|x"]),
                  "".join(rng.choices(HARD, k=rng.randint(0, 4)))) for _ in range(rng.randint(1, 7))]
        expected[conv] = turns
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    got = read_back(spark, rows)
    for conv, turns in expected.items():
        assert [(t.role, t.text) for t in got[conv].back] == turns
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        assert "<|" not in re.sub(r"<\|im_(start|end)\|>", "", got[conv].formatted)


def test_order_of_roles_is_checked(spark):
    orders = ["sua", "ua", "uaua", "suaua", "", "u", "a", "uu", "aua", "sa", "su", "usa", "uax"]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, t, names[c], "x") for i, o in enumerate(orders) for t, c in enumerate(o)]
    got = read_back(spark, rows)
    for i, order in enumerate(orders):
        if order:
            assert got[i].valid == bool(re.fullmatch("s?(ua)+", order)), order
    assert got[12].final_state == "error"


def test_chat_edges(spark):
    rows = [(None, 0, "user", None), (None, 1, None, "x"), (7, 1, "assistant", "b"), (7, None, "user", "n"),
            (7, 1, "assistant", "b"), (8, 0, "assistant", "long " * 200_000)]
    got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[None].back] == [("user", ""), ("", "x")]
    assert [t.text for t in got[7].back] == ["n", "b", "b"]
    assert len(got[8].loss) == 1_000_000
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "segments", F.lit(1)).withColumn("_turns", F.lit(2))
    assert chat.format_chats(turns).count() == 3
    assert chat.format_chats(turns.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(begin="### ")


# --- decontamination ------------------------------------------------------------

def brute_hits(text, items, span=10):
    own, hit, ids = words(text), set(), set()
    for item_id, item_text in items:
        item = words(item_text)
        n = min(span, len(item))
        wanted = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i:i + n]) in wanted:
                hit.update(range(i, i + n))
                ids.add(str(item_id if item_id is not None else ""))
    return len(own), len(hit), sorted(ids)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "a", "É", "é", "Z", "z9", "don't", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate(
        [1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 25, 40, 10, 10])]
    items += [(100, None), (101, "..."), (102, items[10][1]), (None, items[9][1]), (10, items[10][1])]
    docs = [(1, None, 1), (2, "", 1), (3, "?!", 1), (4, "the " * 50, 1)]
    for i in range(5, 60):
        parts = [" ".join(rng.choices(vocabulary + ["q", "w", "e", "r"], k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            taken = (rng.choice(items)[1] or "").split(" ")
            cut = rng.randint(0, max(0, len(taken) - 8))
            parts += [", ".join(taken[cut:cut + rng.randint(3, 30)]),
                      " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))]
        docs.append((i, "\n".join(parts), 1))
    docs += [(5, docs[8][1], 1), docs[9], docs[9], (None, docs[10][1], 1)]
    schema = "doc_id long, text string, items int"
    table = spark.createDataFrame(docs, schema).withColumn("place", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("span", F.lit(0))
    for block in (16, 4096):
        got = decontaminate.contaminate(table, bench, block=block).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        mine = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=key)
        theirs = sorted(((d, *(b := brute_hits(t, items)), b[1] > 0) for d, t, _ in docs), key=key)
        assert mine == theirs
    kept = decontaminate.without_contaminated(table, bench)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        d for d, t, _ in docs if not brute_hits(t, items)[1])


def test_decontamination_of_long_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame(
        [(1, "w " * 50_000 + passage + " w" * 50_000), (2, passage.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminate(docs, bench).collect()}
    assert got[1].n_hit == got[2].n_hit == 12 and got[1].n_words == 100_012
    assert decontaminate.contaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminate(docs.limit(0), bench).count() == 0


# --- shards ---------------------------------------------------------------------

def jump_by_definition(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_its_definition():
    keys = np.array([0, 1, -1, 2 ** 62, -2 ** 63, 12345, 987654321], np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert shard.jump(keys, n).tolist() == [jump_by_definition(int(k) % (1 << 64), n) for k in keys]
    assert shard.jump(keys[:0], 5).tolist() == []


def check_placement(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.law == "key"
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))


def test_placement_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = shard.shard_query(spark, small).collect()
    assert len(rows) == len(texts)
    check_placement(rows, texts)
    cut = shard.place(docs, rows_per_run=2).collect()
    check_placement(cut, texts)
    assert {(r.doc_id, r.shard) for r in cut} == {(r.doc_id, r.shard) for r in rows}


def test_placement_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (1, None, 5), (None, "é", 6), (2, "x" * 300_000, 7)],
        "doc_id long, text string, shard int").withColumn("_run", F.lit(1))
    rows = shard.place(docs).collect()
    check_placement(rows, {1: None, None: "é", 2: "x" * 300_000})
    whole = shard.place_rows(docs)
    assert sorted(whole.columns) == sorted([*docs.columns, "slot"]) and whole.count() == 4
    assert shard.place(docs.limit(0)).count() == 0


# --- near duplicates --------------------------------------------------------------

def shingles(text):
    own = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i:i + 5]) for i in range(len(own) - 4))


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    least = list(range(len(sets)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                least[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, len(s), min(ids[root(i)], default=None) if s else d)
                   for i, (d, s) in enumerate(sets)), key=str)


def near_copies(rng, n_base, copies, sizes):
    docs, vocabulary = [], [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for _ in range(n_base):
        base = rng.choices(vocabulary, k=rng.choice(sizes))
        if rng.random() < 0.5:
            base[rng.randint(0, len(base)):0] = passage.split()
        for _ in range(rng.randint(1, copies)):
            changed = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            docs.append(" ".join(changed))
    return docs


@pytest.mark.parametrize("seed,sizes", [(1, [1, 2, 3, 5, 6, 8, 12, 20]), (2, [15, 30, 40, 70]), (3, [100, 150, 400])])
def test_components_equal_brute_force(spark, seed, sizes):
    rng = random.Random(seed)
    texts = near_copies(rng, 60, 6, sizes) + [None, "", " \n", "One two", "one TWO", "one two x"]
    docs = list(enumerate(texts, 10)) + [(3, texts[0]), (3, texts[0]), (4, texts[5]), (None, texts[1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("low", F.lit(1))
    got = jaccard.near_duplicates(table).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(docs)


def test_large_group_with_open_pairs(spark):
    """Copies at growing distance: stars leave pairs open, which later rounds find."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for step in range(40):
        docs.append((100 + step, " ".join(base)))
        for _ in range(1 + step % 3):
            base[rng.randrange(120)] = f"n{step}{rng.random()}"
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.near_duplicates(table).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(docs)


def test_sets_with_too_few_filled_segments_are_found(spark, monkeypatch):
    """With few segments nearly all sets need one-deletion keys or their members."""
    monkeypatch.setattr(jaccard, "segments_of_band", lambda band, percent=75: max(1, (1 << band) // 6))
    rng = random.Random(4)
    docs = list(enumerate(near_copies(rng, 40, 5, [6, 9, 20, 40])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.near_duplicates(table).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(docs)


def test_similar_sets_share_a_key():
    """The pigeonhole itself, over random pairs near the threshold."""
    rng = np.random.default_rng(0)
    segments = jaccard.band_segments(75)
    shared = tried = 0
    for size in [1, 2, 3, 4, 7, 8, 15, 16, 31, 33, 60, 100, 127, 128, 300, 511]:
        for _ in range(20):
            a = np.unique(jaccard.mix(rng.integers(0, 1 << 63, size, dtype=np.uint64)))
            lost = rng.integers(0, size // 7 + 1)
            extra = jaccard.mix(rng.integers(0, 1 << 63, rng.integers(0, size // 6 + 1), dtype=np.uint64))
            b = np.unique(np.concatenate([a[lost:], extra]))
            same = len(np.intersect1d(a, b))
            if 100 * same < 75 * (len(a) + len(b) - same) or not len(b):
                continue
            sets = jaccard.Sets([], 5)
            sets.sizes = np.array([len(a), len(b)])
            sets.members, sets.owner = np.concatenate([a, b]), np.repeat([0, 1], sets.sizes)
            keys = [set(), set()]
            for role in (0, 1):
                key, of, _ = jaccard.Keys(sets, role, 75, segments).rows(np.array([True, True]))
                for k, i in zip(key.tolist(), of.tolist()):
                    keys[i].add(k)
            tried += 1
            shared += bool(keys[0] & keys[1])
    assert tried > 150 and shared == tried


def test_one_of_each_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, "q w e r t y"), (4, None), (6, "")],
        "doc_id long, text string").withColumn("_kept", F.lit("x"))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 9]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_tells_rows_apart_by_id_and_text(spark):
    copied, alone = "a b c d e f g h", "q w e r t y u i"
    rows = [(7, copied), (3, copied), (7, alone), (None, copied), (None, "one two three four five six"),
            (None, "red green blue white black grey"), (None, "red green blue white black grey"),
            (None, None), (None, None), (8, ""), (8, ""), (8, "m n o p q r s"), (8, "z y x w v u t")]
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame(part, "doc_id long, text string")
        got = sorted(map(tuple, jaccard.one_of_each(docs).collect()), key=repr)
        assert got == sorted([
            (3, copied), (7, alone), (None, "one two three four five six"),
            (None, "red green blue white black grey"), (None, None), (None, None), (8, ""), (8, ""),
            (8, "m n o p q r s"), (8, "z y x w v u t")], key=repr)


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000), (None, 1)]
    links += [(b, a) for a, b in links[:50]]
    rng.shuffle(links)
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- archives ---------------------------------------------------------------------

def one_record(page_id, body, version="WARC/1.1", digest=True):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = [version, "WARC-Type: response", f"WARC-Record-ID: <urn:page:{page_id}>",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if digest:
        head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_salvage_passes_over_damage():
    first, second, third = (one_record(i, b"body %d WARC/1.1\r\n" % i * 9) for i in range(3))
    broken = bytearray(second)
    broken[-20] ^= 1
    for damage, reason in [(bytes(broken), "digest"), (second[:60], "repeated"), (second[:13], "header"), (b"\0" * 77, "version"),
                           (second.replace(b"Content-Length: ", b"Content-Length: 9"), "end"),
                           (second.replace(b"Content-Length: ", b"Content-Length: x"), "length")]:
        data = first + damage + third
        found = list(warc.salvage(data))
        ids = [h["warc-record-id"] for _, _, r, h, _ in found if r is None]
        assert ids[0] == "<urn:page:0>" and ids[-1] == "<urn:page:2>"
        gaps = [(a, b, r) for a, b, r, _, _ in found if r is not None]
        assert gaps[0][0] == len(first) and gaps[-1][1] == len(first + damage) and reason in gaps[0][2]
        assert [a for a, *_ in found] == [0] + [b for _, b, *_ in found][:-1]
    assert list(warc.salvage(b"")) == []
    assert [x[2] for x in warc.salvage(b"garbage")] == ["no version line"]


def test_salvage_of_compressed_members():
    members = [gzip.compress(one_record(i, b"page %d " % i * 50)) for i in range(4)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    data = members[0] + bytes(broken) + b"junk" + members[2] + members[3][:-5]
    found = list(warc.salvage(data))
    assert [h["warc-record-id"] for *_, r, h, _ in found if r is None] == ["<urn:page:0>", "<urn:page:2>"]
    gaps = [(a, b) for a, b, r, *_ in found if r is not None]
    assert gaps[0] == (len(members[0]), len(members[0]) + len(broken) + 4)
    assert gaps[-1][1] == len(data)


def recovered(data):
    return [h["warc-record-id"][10:-1] for _, _, r, h, _ in warc.salvage(data) if r is None]


@pytest.mark.parametrize("before", [b"quoted: ", b"quoted:\r\n", b"quoted\r\n\r\n"])
def test_a_quoted_record_is_not_one(before):
    quoting = bytearray(one_record(1, before + one_record(99, b"forged " * 9) + b"\r\n and so on"))
    quoting[-8] ^= 1
    first, last = one_record(0, b"a" * 99), one_record(2, b"b" * 99)
    assert recovered(first + bytes(quoting) + last) == ["0", "2"]
    gaps = [x[:3] for x in warc.salvage(first + bytes(quoting) + last) if x[2]]
    assert gaps == [(len(first), len(first) + len(quoting), "block digest differs")]
    # The end of the archive is a border too.
    assert recovered(first + bytes(quoting)) == ["0"]


def test_a_quoted_record_in_one_of_damaged_length():
    quoting = one_record(1, b"quoted: " + one_record(99, b"forged " * 9) + b" and so on")
    damaged = quoting.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert recovered(one_record(0, b"a") + damaged + one_record(2, b"b")) == ["0", "2"]


def test_records_around_damage_inside_a_member():
    records = [one_record(i, b"page %d " % i * 50) for i in range(5)]
    broken = bytearray(records[1])
    broken[-20] ^= 1
    member = gzip.compress(records[0] + bytes(broken) + records[2])
    data = member + gzip.compress(records[3])
    found = list(warc.salvage(data))
    assert recovered(data) == ["0", "2", "3"]
    gap, = [x for x in found if x[2]]
    low, high = len(records[0]), len(records[0] + broken)
    assert gap[:3] == (0, len(member), f"block digest differs, bytes {low} to {high} of the member")
    # An archive compressed as a whole, and one that is cut off.
    whole = gzip.compress(b"".join(records))
    assert recovered(whole) == list("01234")
    cut = whole[:-9]
    assert recovered(cut) == list("0123")
    assert [x[:3] for x in warc.salvage(cut) if x[2]] == [(0, len(cut), "unfinished member")]
    assert recovered(cut + gzip.compress(one_record(7, b"x"))) == list("01237")


@pytest.mark.parametrize("seed", range(20))
def test_random_damage_leaves_the_other_records(seed):
    rng = random.Random(seed)
    bodies = [bytes(rng.choice(b"ab \r\n<WARC/1.") for _ in range(rng.randint(0, 400))) for _ in range(12)]
    records = [one_record(i, body) for i, body in enumerate(bodies)]
    for packed in (False, True):
        parts = [gzip.compress(r) if packed else r for r in records]
        hurt = sorted(rng.sample(range(1, 12), 3))
        for i in hurt:
            # Bytes of the block are changed or lost.
            part, at = bytearray(parts[i]), len(parts[i]) - rng.randint(10, 18)
            if rng.random() < 0.5:
                part[at] ^= 255
            else:
                del part[at:at + 3]
            parts[i] = bytes(part)
        data = b"".join(parts)
        assert recovered(data) == [str(i) for i in range(12) if i not in hurt]
        spans = sorted({x[:2] for x in warc.salvage(data)})
        assert spans[0][0] == 0 and spans[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pages_come_back(spark, tmp_path):
    body = "<p>é</p>WARC/1.1\r\n\r\n" * 20
    rows = [(3, "http://x/\r\na b", body, 1), (1, "u", body, 1), (1, "u", body, 1), (2, None, None, 1),
            (7, "v", "", 1), (8, "w", "short", 1), (9, "w", "short", 1), (None, "n", body, 1),
            (5, "long", "x" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    warc.write_archives(pages, str(tmp_path / "out"), archive_bytes=2_000)
    got = warc.read_archives(spark, str(tmp_path / "out"))
    assert got.filter("reason is not null").count() == 0
    ids = [warc.page_name(F.col("record_id")), warc.page_name(F.col("headers")["warc-refers-to"])]
    read = got.select(*ids, "record_type", "payload").collect()
    kinds = Counter((r[0], r[1], r[2]) for r in read)
    assert kinds == Counter([(3, 1, "revisit"), (None, 1, "revisit"), (1, None, "response"),
                             (1, None, "response"), *((i, None, "response") for i in (2, 7, 8, 9, 5))])
    payload = {r[0]: bytes(r[3]).decode() for r in read if r[2] == "response"}
    assert payload == {1: body, 2: "", 7: "", 8: "short", 9: "short", 5: "x" * 3_000_000}
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


# --- mixing -----------------------------------------------------------------------

def targets_by_rounds(sizes):
    """Shares by weight; what is above a cap is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows, texts):
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        assert r.size == len(SPACED.findall(texts[r.doc_id] or ""))
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    target = targets_by_rounds(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return target


def test_mix_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    mixed = mixture.mix(docs)
    rows = mixed.collect()
    check_mix(rows, texts)
    again = {(r.doc_id, r.taken) for r in mixture.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixture.expand_copies(mixed, docs.columns).count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("shape", [[(1, 1)], [(40, 1), (1, 30), (5, 5)], [(0, 0), (3, 9)], [(30, 7), (2, 2), (2, 2), (2, 2)]])
def test_mix_targets_reach_caps(spark, shape):
    docs, n = [], 0
    for s, (count, size) in enumerate(shape):
        for _ in range(count):
            docs.append((n, "w " * size, f"s{s}" if s else None, 1))
            n += 1
    docs += [(n, None, "empty", 1), (n + 1, "", "empty", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, target int")
    check_mix(mixture.mix(table).collect(), {d: t for d, t, *_ in docs})


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string, w double"
    docs = spark.createDataFrame(
        [(None, "a b", None, 1.0), (None, "a b", None, 1.0), (1, "c " * 200_000, "x", 1.0), (2, "d", "x", 1.0)], schema)
    rows = mixture.mix(docs).collect()
    assert len(rows) == 4 and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixture.mix(docs.limit(0)).count() == 0
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 4 < 2, 3.0).otherwise(1.0).alias("w"))
    by = mixture.mix(many, doc_weight="w").filter("source = 'b'").groupBy("w").agg(F.avg("copies")).collect()
    rate = dict(map(tuple, by))
    assert rate[3.0] / rate[1.0] == pytest.approx(3, rel=0.25)


# --- the pipeline -----------------------------------------------------------------

def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    left = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, small), "stage")
        rows = out.collect()
        if k < 4:
            assert out.columns == names
        if k == 0:
            kept = {r.doc_id for r in rows}
            assert np.mean([quality[d] for d in kept if d in quality]) > 0.97
            assert np.mean([d in kept for d in quality if quality[d] == 1]) > 0.97
        elif k == 1:
            groups = brute_components([(d, left[d].text) for d in left])
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _, c in groups if d == c)
        elif k == 2:
            assert {r.doc_id for r in rows} == {
                d for d in left if not brute_hits(left[d].text, bench)[1]}
        elif k == 3:
            mixed = mixture.mix(docs).collect()
            assert Counter(r.doc_id for r in rows) == Counter(
                {r.doc_id: r.copies for r in mixed if r.copies})
        else:
            assert len(rows) == docs.count()
            for s in {r.shard for r in rows}:
                slots = sorted(r.slot for r in rows if r.shard == s)
                assert slots == list(range(len(slots)))
            assert corpus_pipeline.run(spark, small).count() == len(rows)
        assert all(r.text == left[r.doc_id].text for r in rows)
        docs, left = out, {r.doc_id: r for r in rows}


CLASHING = """label _labelled score predicted _w _q _p _u _s _x _at _room _bucket _rate _whole _bad_id _bad_digest
_digest size target copies taken source_size _copy _more _prior _used kept0 kept3 low high n n_words text1 text2
_text1 _text2 _id _low _high _row _c _d _f k m component digest stage _run _n _offset _at2 a.b we`ird""".split()


def test_columns_of_any_name_come_through_every_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    marked = docs.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id")).alias(c) for i, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, marked, small), "stage")
        if name != "sharding":
            assert out.columns == marked.columns
        rows = out.collect()
        assert len(rows) > 100
        for r in rows:
            assert all(r[c] == f"{i}:{r.doc_id}" for i, c in enumerate(CLASHING))


def test_rows_with_null_ids_are_drawn_apart(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixture.mix(rows).filter("doc_id is null").groupBy("source", "copies").count().collect()
    by = {(r.source, r.copies): r["count"] for r in got}
    for s in "ab":
        # every share of copies that the source has, its rows without ids have too
        shares = [n for (t, _), n in by.items() if t == s]
        assert len(shares) == 2 and min(shares) > 100, by
