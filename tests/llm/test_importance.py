"""Importance resampling against the definition, document by document."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from spendtrace.llm import common, importance
from spendtrace.llm.importance import drawn_documents, importance_query

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000
                   for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected(docs, target, share=5, least=20):
    """{place: (doc_id, n_features, weight, score)} and the ordered draw."""
    parsed = [features(text) for _, text in docs]
    corpus = Counter(f for _, fs in parsed for f in fs)
    wanted = Counter(f for text in target for f in features(text)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log(
            (wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))

    rows = []
    for (doc_id, _), (words, fs) in zip(docs, parsed):
        weight = sum(map(gain, fs))
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        luck = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(words), len(fs), weight, weight + luck))
    able = sorted((r for r in rows if r[1] >= least),
                  key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[:share * len(able) // 100]


def run(spark, docs, target, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    return importance.importance(frame, wanted, **options)


def check(got, rows, drawn):
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(d[0], d[4]) for d in drawn]


ODD = ["a", "B", "é", "word", "Word's", "x" * 33, "ü" * 40, "", "...", "z" * 32, "9", "\r", "ab-cd", "KK"]


def odd_documents(rng, n):
    texts = ["".join(rng.choice(ODD) + rng.choice([" ", "\n", "\n\n", " \n", ", "])
                     for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(i, rng.choice(texts) if i % 3 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("lookup", [common.MAX_LOOKUP_ROWS, 3])
def test_weights_and_draw_by_definition(spark, monkeypatch, lookup):
    monkeypatch.setattr(importance, "join_frequent", lambda *a: common.join_frequent(*a, limit=lookup))
    monkeypatch.setattr(importance, "ROWS_PER_RANGE", 40)
    docs = odd_documents(random.Random(3), 300)
    target = [t for _, t in docs[:9]] + ["word word a B", None, ""]
    check(run(spark, docs, target, share=30).collect(), *expected(docs, target, share=30))


def test_given_tables(spark, small):
    docs = [tuple(r) for r in common.table(spark, small, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in common.table(spark, small, "benchmark").collect()]
    rows, drawn = expected(docs, target)
    got = importance_query(spark, small).collect()
    places = {d[0]: i for i, d in enumerate(drawn, 1)}
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got} == {
        (r[0], r[2], r[3], r[4], places.get(r[0])) for r in rows}


def test_edges(spark):
    long = " ".join(f"w{i % 97}" for i in range(50_000)) + "\n" + "y" * 300_000
    same = "one two three " * 10
    docs = [(None, None), (None, same), (None, same), (1, ""), (2, "!!! \n ..."), (3, long), (3, same), (4, same)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    extra = frame.selectExpr("*", "1 as row", "2 as digest", "3 as score", "4 as `rank`", "5 as lines")
    target = spark.createDataFrame([(same, 1)], "text string, digest int")
    rows, drawn = expected(docs, [same], share=60)
    check(importance.importance(extra, target, share=60).collect(), rows, drawn)
    texts = drawn_documents(extra, target, share=60).orderBy("rank").collect()
    assert [r["rank"] for r in texts] == [1, 2, 3]
    assert [r.doc_id for r in texts] == [d[0] for d in drawn] and {r.text for r in texts} <= {same, long}
    assert importance.importance(extra.limit(0), target).count() == 0
    check(importance.importance(extra, target.limit(0), share=60).collect(), *expected(docs, [], share=60))
