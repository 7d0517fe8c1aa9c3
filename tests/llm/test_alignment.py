"""Cross-tokenizer alignment against the plain definition."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from spendtrace.llm import alignment, common
from spendtrace.llm.alignment import FILE_A, FILE_B, TOKENIZERS, ByteLevel, align, alignment_counts

ROW = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(os.path.join(TOKENIZERS, FILE_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(TOKENIZERS, FILE_B))
    letters = alignment._byte_letters()

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], [], [], []
        return ids_a, np.cumsum([len(x) for x in bytes_a]).tolist(), ids_b, np.cumsum(
            [len(x) for x in bytes_b]).tolist()

    return tokens


def expected(plain, docs):
    told, links = [], []
    for doc_id, text in docs:
        ids_a, ends_a, ids_b, ends_b = plain(text or "")
        cuts = sorted(set(ends_a) & set(ends_b))
        own = [(ids_a[ends_a.index(c)], ids_b[ends_b.index(c)]) for c in cuts]
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= high)
                                   for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        told.append((doc_id, len(ids_a), len(ids_b), ";".join(groups), cuts))
        links.append(own)
    counts = Counter(p for own in links for p in own)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = [(d, na, nb, len(cuts), len(own), sum(counts[p] == highest[p[1]] for p in own),
             sum(counts[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for (d, na, nb, g, cuts), own in zip(told, links)]
    return rows, told, links


ODD = ["Hello, world!", " two  spaces", "\n\n\t", "don't", "naïve café", "日本語", "😀👍🏽", "<|endoftext|>", "<s>", "</s>",
       "<unk>", "<0x0A>", "▁", "\x00", "  ", "antidisestablishmentarianism", "12345678", "é", "​", "ﬁ",
       "x" * 50, "\r\n", "　", "İ", "—", "…"]


@pytest.mark.parametrize("lookup", [common.MAX_LOOKUP_ROWS, 5])
def test_counts_by_definition(spark, plain, monkeypatch, lookup):
    monkeypatch.setattr(alignment, "join_frequent", lambda *a: common.join_frequent(*a, limit=lookup))
    rng = random.Random(11)
    docs = [(i, "".join(rng.choices(ODD, k=rng.randint(1, 6)))) for i in range(250)]
    docs += [(300 + i, o) for i, o in enumerate(ODD)] + [(7, docs[7][1]), (None, "a b"), (None, None), (9, "")]
    got = alignment_counts(spark.createDataFrame(docs, ROW)).collect()
    assert Counter(map(tuple, got)) == Counter(expected(plain, docs)[0])


def test_spans_and_links(spark, plain):
    docs = [(i, o) for i, o in enumerate(ODD)] + [(99, "the of and " * 30_000), (100, "y" * 20_000)]
    _, told, links = expected(plain, docs[:-2])
    got = {r.doc_id: r for r in align(spark.createDataFrame(docs, ROW)).collect()}
    for (doc_id, n_a, n_b, groups, cuts), own in zip(told, links):
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.groups, r.cuts) == (n_a, n_b, groups, cuts)
        assert {(x.a, x.b): x.times for x in r.links} == Counter(own)
    for doc_id, text in docs[-2:]:
        assert got[doc_id].cuts[-1] == len(text) + 1 and got[doc_id].groups.count("|") == len(got[doc_id].cuts)


def test_given_texts_and_library_of_the_file(spark, small, plain):
    docs = [tuple(r) for r in common.table(spark, small, "documents").select("doc_id", "text").limit(60).collect()]
    docs = [(d, t[:4000]) for d, t in docs]
    assert Counter(map(tuple, alignment_counts(spark.createDataFrame(docs, ROW)).collect())) == Counter(
        expected(plain, docs)[0])


def test_pointers_of_all_documents():
    rng = np.random.default_rng(2)
    ends = [[np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) if n else np.zeros(0, int)
             for _ in range(2)] for n in rng.integers(0, 40, 200)]
    starts = [np.concatenate([[0], np.cumsum([len(e[s]) for e in ends])]) for s in (0, 1)]
    flat = [np.concatenate([e[s] for e in ends]) for s in (0, 1)]
    d, a, b = alignment.lockstep(flat[0], starts[0], flat[1], starts[1])
    wanted = [(i, int(x)) for i, e in enumerate(ends) for x in np.intersect1d(*e)]
    assert list(zip(d.tolist(), flat[0][a].tolist())) == wanted
    assert (flat[0][a] == flat[1][b]).all()


def test_other_byte_level_vocabulary(tmp_path):
    """A file whose ids do not follow its merges goes through the file's own library."""
    import json

    with open(os.path.join(TOKENIZERS, FILE_A), encoding="utf-8") as file:
        told = json.load(file)
    vocab = told["model"]["vocab"]
    last = [w for w, i in vocab.items() if i >= 50_000]
    for w, i in zip(last, reversed([vocab[w] for w in last])):
        vocab[w] = i
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    one, other = ByteLevel(os.path.join(TOKENIZERS, FILE_A)), ByteLevel(str(path))
    texts = [" a<|endoftext|>b", " don't  stop\n\nnow", *last[:40]]
    for x, y in zip(one.encode(texts), other.encode(texts)):
        assert [one.bytes[i] for i in x] == [other.bytes[i] for i in y]


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, row string").selectExpr(
        "*", "1 as pair", "2 as links", "3 as n_a", "4 as count")
    assert alignment_counts(frame).count() == 1
    assert alignment_counts(frame.limit(0)).count() == 0
