"""Divergence rules, classifier, language models and extraction against plain definitions."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendtrace.llm import classifier, divergence, extract, langid
from spendtrace.llm.common import let, word_hashes

WORD = re.compile("[^\x20\x09-\x0D]+")
LONG = "The quick brown fox was not in the house of the king. " * 4000
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b ", None), (4, "word", None),
    (5, LONG, "en"), (6, "a b c d e f g h a b c d e f g h", "en"), (7, "x\ny\nx\n\nx", "de"),
    (8, "a b c d e f g h a b c d e f g h", "en"), (8, "a b c d e f g h a b c d e f g h", "en"),
    (None, "no id here at all", "en"), (9, "\x1c\x85  wide space", "en"),
    (10, "ÉCOLE " * 40, "fr"), (11, "|" * 500, "en"), (12, "😀 emoji 𐍈 gothic", None),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    starts = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if starts[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit))


def check_measures(rows):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base_measures(r.text), r.doc_id
        assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r.base_failed and r.kept)


def test_measures_of_odd_texts(odd):
    judged = divergence.judge(odd.withColumn("KEPT", F.lit(1)), divergence.learn(odd)).collect()
    assert len(judged) == len(ODD)
    check_measures(judged)


def test_measures_and_verdicts_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = divergence.judge(docs, divergence.learn(docs)).collect()
    check_measures(rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    passed = [r for r in rows if r.doc_id in quality and not r.base_failed]
    clean = [r.kept for r in passed if quality[r.doc_id] == 1]
    junk = [r.kept for r in passed if quality[r.doc_id] == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.2


def test_distance_is_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    kl = [sum(a * math.log2(a / b) for a, b in zip(x, m) if a) for x in (p, q)]
    assert divergence.distance(p, q) == pytest.approx(math.sqrt(sum(kl) / 2))
    assert divergence.distance(p, p) == 0 and divergence.distance(p * 0, q) == 1


def test_rules_without_references(spark, odd):
    empty = odd.limit(0)
    known = divergence.learn(empty)
    assert known.names == []
    assert divergence.judge(empty, known).count() == 0
    rows = divergence.judge(odd, known).collect()
    assert all(r.kept == (not r.base_failed) and r.kind_distance is None for r in rows)


def test_shape_and_repeat_marks():
    assert classifier.shape("Don't!!!".encode()) == b"Aa'a!"
    assert classifier.shape("ab12--é".encode()) == b"a9-a"
    memo = classifier.WordViews()
    doc, slot, value = classifier.features([b"one two one", b"", b"one two one"], memo)
    assert np.array_equal(slot[doc == 0], slot[doc == 2])
    assert list(slot[doc == 1]) == [0] and list(value[doc == 1]) == [1.0]
    unit = value[(doc == 0) & (slot > 0)]
    assert (unit ** 2).sum() == pytest.approx(1.0)


def test_leader_follows_its_definition():
    how = classifier.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.array([0.05, -2.0, 3.0]), np.array([4.0, 9.0, 0.0])
    expected = [0.0, (2.0 - 0.1) / ((1 + 3) / 0.5 + 0.2), -(3.0 - 0.1) / (1 / 0.5 + 0.2)]
    assert classifier.leader(z, n, how) == pytest.approx(expected)


def test_training_is_one_pass_of_updates_per_row():
    how = classifier.Ftrl(epochs=2)
    rows = [(np.array([0, 5]), np.array([1.0, 0.5]), 1.0), (np.array([0, 7]), np.array([1.0, 1.0]), 0.0)]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return -(z[i] - math.copysign(how.l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(2):
        for slots, values, label in rows:
            w = {i: weight(i) for i in slots}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(slots, values))))
            for i, v in zip(slots, values):
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha * w[i]
                n[i] += g * g
    got = classifier.fit_shard(rows, how)
    for i in (0, 5, 7, 9):
        assert got[i] == pytest.approx(weight(i))


def test_classifier_on_held_out_documents(spark, small):
    rows = classifier.classifier_query(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert len(rows) == docs.count()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {
        r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.predicted == quality[r.doc_id] for r in rows if r.doc_id in quality]
    assert np.mean(right) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_on_odd_and_empty_tables(spark, odd):
    weights = classifier.fit(odd.withColumn("label", F.lit(None).cast("int")))
    assert not weights.any()
    scored = classifier.score(odd.withColumn("Score", F.lit("mine")), weights).collect()
    assert len(scored) == len(ODD) and {r.score for r in scored} == {0.5}
    labelled = odd.withColumn("label", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int"))
    again = [classifier.fit(labelled.repartition(n)) for n in (1, 5)]
    assert np.array_equal(*again)
    assert classifier.score(odd.limit(0), weights).count() == 0
    kept = classifier.accepted(odd.withColumn("predicted", F.lit("x")), spark.createDataFrame(
        [(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert kept.columns == [*odd.columns, "predicted"] and kept.count() > 0


def brute_bits(model_runs, run, alphabet):
    """Interpolated Kneser-Ney straight from counts of four-character tuples."""
    levels = {4: model_runs}
    for n in (3, 2, 1):
        kinds = Counter()
        for gram in levels[n + 1]:
            kinds[gram[1:]] += 1
        levels[n] = kinds

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / alphabet
        table = levels[n]
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        below = p(gram[1:])
        if not same:
            return below
        total = sum(same.values())
        return max(same.get(gram, 0) - discount, 0) / total + discount * len(same) / total * below

    return -math.log2(p(run))


def test_model_equals_kneser_ney_by_definition():
    texts = ["the cat sat on the mat", "a cat ate the hat", "that hat"]
    codes, text = langid.fold(texts)
    run, count = np.unique(langid.runs(codes, text), return_counts=True)

    def as_tuple(value):
        return tuple((int(value) >> (16 * k)) & 0xFFFF for k in (3, 2, 1, 0))

    counts = {as_tuple(r): int(c) for r, c in zip(run, count)}
    alphabet = 20
    model = langid.CharModel.fit(run, count, alphabet)
    new_codes, new_text = langid.fold(["the zebra hat cats"])
    for r in np.concatenate([run, langid.runs(new_codes, new_text)]):
        assert model.bits(np.array([r], np.uint64))[0] == pytest.approx(
            brute_bits(counts, as_tuple(r), alphabet), rel=1e-5)
    # probabilities of all continuations of a context, known or not, are one
    context = int(run[5]) >> 16 << 16
    kinds = np.unique(langid.tail(run, 1))
    bits = model.bits(np.uint64(context) | kinds)
    unseen = alphabet - len(kinds)
    rest = 2.0 ** -model.bits(np.array([np.uint64(context | 0x7A7A)]))[0]
    assert (2.0 ** -bits).sum() + unseen * rest == pytest.approx(1.0, rel=1e-4)


def test_fold_keeps_letters_and_single_separators():
    codes, text = langid.fold(["A1b!!", "", "É 😀𐍈"])
    assert "".join(chr(c) if c else "_" for c in codes[text == 0]) == "a_b_"
    assert len(codes[text == 1]) == 0
    assert codes[text == 2][0] == ord("é") and (codes[text == 2] >= 0xE000).sum() == 1


def test_memo_gives_the_models_values():
    rng = np.random.default_rng(1)
    run = rng.integers(0, 1 << 60, 5000, dtype=np.uint64)
    model = langid.CharModel.fit(np.unique(run), np.ones(len(np.unique(run)), np.int64), 50)
    models = langid.LanguageModels(["x"], [model], np.array([np.inf]))
    memo = langid.Memo(models)
    for part in (run, run[::2], rng.permutation(run)):
        assert np.allclose(memo.bits(part), models.bits(part))


def test_language_of_documents(spark, small):
    rows = langid.langid_query(spark, small).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, odd):
    fitted = langid.fit(odd)
    assert fitted.names == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.identify(odd.withColumn("Bits", F.lit(1)), fitted, False).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[11].lang_pred == "und"
    assert got[1].score == 0 and got[1].bits is None
    assert got[10].lang_pred == "fr" and got[5].lang_pred == "en"
    strange = spark.createDataFrame([("qxzj vkwq " * 30,)], "text string")
    assert langid.identify(strange, langid.LanguageModels(
        fitted.names, fitted.models, np.full(3, 4.0))).first().lang_pred == "und"
    none = langid.fit(odd.limit(0))
    assert none.names == [] and langid.identify(odd, none).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(odd.limit(0), fitted).count() == 0


def test_models_have_every_run_at_any_size(spark):
    def fitted(copies):
        rare = spark.createDataFrame([("quartz vows jump", "en")], "text string, lang string")
        return langid.fit(spark.range(copies).select(
            F.lit("the cat sat on the mat and the hat was on that flat").alias("text"),
            F.lit("en").alias("lang")).unionByName(rare)).models[0]

    few, many = fitted(1), fitted(100_000)
    for a, b in zip(few.seen + few.weights, many.seen + many.weights):
        assert np.array_equal(a.keys, b.keys)
    # orders below the highest count distinct runs, so copies do not change them
    for a, b in zip(few.seen[:-1], many.seen[:-1]):
        assert np.array_equal(a.values, b.values)


def test_a_rare_language_and_short_texts_have_a_limit(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("the cat sat "), F.col("id")).alias("text"),
                                       F.lit("en").alias("lang")).unionByName(spark.createDataFrame(
        [("der hund lief durch den wald und kam erst am abend wieder nach hause", "de"),
         ("le chat dort", "fr"), ("123", "fr")], "text string, lang string"))
    fitted = langid.fit(rows)
    assert fitted.names == ["de", "en", "fr"] and np.isfinite(fitted.limits).all()


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><script>if (a < b) document.write("<p>no</p>")
</script><style>p{}</style></head><body class="has-sidebar"><header>Site name</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice"><p>We use cookies.</div>
<main><article><h1>Fish &amp; chips</h1><!-- <p>hidden</p> --><p>One <a href=x>two</a>
 three<br>four &lt;b&gt;<p>Five&nbsp;six<div class="advert"><p>Buy now</p></div><p>Seven
<form><p>Mail <input></form><p title="a > b">Eight</p></article>
<section id="comments"><p>Nice article, I like the way it is written.</p></section></main>
<aside><p>Side text that is long enough to be a block of its own, with the and of.</p></aside>
<footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_surroundings():
    assert extract.main_text(PAGE) == (
        "Fish & chips\nOne two three four <b>\nFive six\nSeven\nEight")


BODY = "The house of the king was in the middle of the town and it was not as old as the one by the river. " * 4


@pytest.mark.parametrize("open_, close", [
    ('<div class="content has-sidebar">', "</div>"), ('<div class="category-social">', "</div>"),
    ('<article class="post type-post tag-search">', "</article>"), ('<div id="no-comments">', "</div>"),
    ('<article class="related">', "</article>"), ('<div class="sidebar"><article>', "</article></div>"),
    ('<div class="social">', "</div>")])
def test_a_name_alone_does_not_condemn_the_article(open_, close):
    page = f"<body>{open_}<p>{BODY}</p>{close}<div class='sidebar'><p>{BODY[:99]}</p></div></body>"
    assert extract.main_text(page) == BODY.strip()


def test_a_teaser_article_does_not_stand_for_the_page():
    page = f"<body><article><p>Read more soon</p></article><div><p>{BODY}</p></div></body>"
    assert BODY.strip() in extract.main_text(page).split("\n")


def test_two_passes_without_an_article():
    good = "The house of the king was in the middle of the town and it was not as old as the one by the river. " * 3
    near = "It was one of the first that had been built there by the people."
    page = (f"<body><div><a href=1>First link</a> <a href=2>Second link</a></div><p>{good}</p>"
            f"<p>Short line</p><p>{near}</p><p>{good}</p><ul><li>Lorem ipsum dolor sit amet consectetur "
            "adipiscing elit sed eiusmod tempor incididunt labore</ul><p>Alone</p></body>")
    assert extract.main_text(page).split("\n") == [
        good.strip(), "Short line", near, good.strip()]
    G, B, S, N = extract.GOOD, extract.BAD, extract.SHORT, extract.NEAR
    assert extract.second_pass([B, S, G, S, S, B]) == [B, G, G, G, B, B]
    assert extract.second_pass([S, S]) == [B, B] and extract.second_pass([]) == []
    assert extract.second_pass([B, N, B, N, G]) == [B, B, B, G, G]


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<", ""), ("<article>plain", "plain"), ("<article><p>a<p>b</article>", "a\nb"),
    ("<article><p>a &#x41; &amp;lt; &unknown; &</article>", "a A &lt; &unknown; &"),
    ("<article><p>x <b>y</p><p>z</b></article>", "x y\nz"),
    ("<article><p>a<!-- open", "a"), ("<article><script>x", ""),
    ('<article><p class="x>y" id=\'q>"\'>t</p></article>', "t"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><p hidden>no</p><p>yes</p></article>", "yes"),
])
def test_malformed_markup(page, text):
    assert extract.main_text(page) == text


WORDS = {
    "en": "the of and to in house river table morning walked garden window letter stone colour".split(),
    "de": "der die und das mit haus fluss tisch morgen gegangen garten fenster brief stein farbe".split(),
    "pl": "i w na nie się dom rzeka stół ranek szedł ogród okno list kamień kolor".split(),
}


def rendered_page(rng: random.Random, landmark: str) -> tuple[str, str]:
    """A page from a random tree, and the text of its article."""
    lang = rng.choice(list(WORDS))
    words = WORDS[lang]

    def prose(least: int, most: int) -> str:
        return " ".join(rng.choice(words[:5]) if rng.random() < 0.4 else rng.choice(words[5:])
                        for _ in range(rng.randint(least, most)))

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{i}'>{prose(1, 3)}</a></li>" for i in range(n))

    body, lines = [], []
    for i in range(rng.randint(4, 9)):
        text = prose(40, 120) if i % 3 == 0 else prose(2, 30)
        lines.append(text)
        tag = "h2" if len(text) < 40 and i and rng.random() < 0.3 else rng.choice(["p", "div", "blockquote"])
        shown = text.replace(" ", rng.choice([" ", "\n  ", "<b> </b>"]), 1)
        body.append(f"<{tag}>{shown}</{tag}>")
        if rng.random() < 0.3:
            body.append(rng.choice([
                f"<aside><p>{prose(5, 20)}</p></aside>", f"<div class='advert'>{prose(5, 20)}</div>",
                f"<script>var a = '<p>{prose(3, 9)}</p>'</script>", f"<!-- <p>{prose(3, 9)}</p> -->",
                f"<form><p>{prose(3, 9)}</p><input></form>"]))
    article = f"<{landmark}>{''.join(body)}</{landmark}>"
    for _ in range(rng.randint(0, 3)):
        article = f"<div>{article}</div>"
    if rng.random() < 0.2:
        article = f"<form action='/'>{article}</form>"
    page = (f"<html lang='{lang}'><head><title>{prose(2, 5)}</title></head><body><header><p>{prose(2, 5)}</p>"
            f"</header><nav><ul>{links(6)}</ul></nav>{article}<ul>{links(5)}</ul>"
            f"<section id='comments'><p>{prose(5, 25)}</p></section><footer>{prose(3, 12)}</footer></body>")
    return page, "\n".join(lines)


@pytest.mark.parametrize("landmark", ["article", "main", "div", "section"])
def test_random_pages_give_their_article(landmark):
    rng = random.Random(landmark)
    pages = [rendered_page(rng, landmark) for _ in range(200)]
    wrong = [(page, text, extract.main_text(page)) for page, text in pages if extract.main_text(page) != text]
    assert not wrong, wrong[0]


def test_rules_decide_where_the_page_names_no_article(small):
    """The given pages with their landmarks taken away: what the two passes decide by themselves."""
    pages = [page or "" for page in pd.read_parquet(f"{small}/../sf0.01/pages.parquet").html]
    plain = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page) for page in pages]
    same = sum(extract.main_text(a) == extract.main_text(b) for a, b in zip(pages, plain))
    assert same >= 0.96 * len(pages)
    steps = Counter()
    for page in plain:
        read = extract.page_of(page)
        steps.update(step for b, step in zip(read.blocks, extract.decide(read, extract.Rules())) if not b.bad)
    first = sum(n for (label, _), n in steps.items() if label in (extract.GOOD, extract.BAD))
    # Density and length decide a part of the blocks, their neighbours the others.
    assert 0.2 < first / steps.total() < 0.8
    assert steps[extract.SHORT, extract.GOOD] and steps[extract.NEAR, extract.GOOD]


def test_neighbours_share_the_innermost_container():
    G, B, S, N = extract.GOOD, extract.BAD, extract.SHORT, extract.NEAR
    # Good and three short blocks in one container, then a bad one elsewhere.
    assert extract.second_pass([G, S, S, S, B], [0, 3, 3, 3, 1]) == [G, G, G, G, B]
    # A heading stands with what follows.
    assert extract.second_pass([B, S, N, G], [0, 1, 1, 1], [False, True, False, False]) == [B, G, G, G]
    assert extract.second_pass([G, S, B], strict=[True] * 3) == [G, B, B]


def test_landmarks_vote():
    # Unmarked text before an article that holds most of the text is left out, between two it is not.
    teaser = f"<div>{BODY[:150]}</div>"
    assert extract.main_text(f"<body>{teaser}<article><p>{BODY}</p></article></body>") == BODY.strip()
    both = f"<article><p>{BODY}</p></article>{teaser}<article><p>{BODY}</p></article>"
    assert extract.main_text(both).split("\n") == [BODY.strip(), BODY[:150].strip(), BODY.strip()]
    # A list of links inside an article is still one.
    page = f"<article><p>{BODY}</p><ul><li><a href=1>Read this</a><li><a href=2>And that</a></ul></article>"
    assert extract.main_text(page) == BODY.strip()


def test_a_page_inside_a_form():
    page = f"<body><form><div><p>{BODY}</p></div></form><form><p>Your mail address</p></form></body>"
    assert extract.main_text(page) == BODY.strip()


def test_other_languages_and_scripts():
    polish = ("Dom stał na wzgórzu i nie było w nim nikogo, a na stole leżał list, w którym król pisał, że nie "
              "wróci na zimę i że na wiosnę w ogrodzie nie będzie kwiatów. ") * 2
    chinese = "我的家在山上，我的朋友在城里。他的房子是新的，我的房子是旧的，我们的生活是好的。" * 6
    for text, lang in ((polish, "pl"), (chinese, "zh")):
        page = f"<html lang={lang}><body><ul><li><a href=1>{text[:20]}</a></ul><div><p>{text}</p></div></body>"
        assert extract.main_text(page) == text.strip()


@pytest.mark.parametrize("part", [
    "<div>", "<div class='ad'>", "<b>", "<p><b>", "<svg>", '<a "', "<!", "</p>", "<li>", "<form>",
    "<div><p>x", "<!--", "<article>"])
def test_time_is_linear_in_the_length(part):
    def seconds(size: int) -> float:
        start = time.perf_counter()
        extract.main_text(part * (size // len(part)))
        return time.perf_counter() - start

    # Eight times the length: 64 times the time if quadratic.
    assert seconds(400_000) < 24 * max(seconds(50_000), 0.01)


def test_extract_table(spark):
    rows = [(1, "u", PAGE, "mine"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "y"),
            (3, "w", "<article>" + "<p>word word</p>" * 30_000 + "</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = extract.extract(pages).collect()
    assert len(got) == 5 and sorted(got[0].asDict()) == ["n_chars", "page_id", "text", "url"]
    by = {r.page_id: r for r in got}
    assert by[2].text == "" and by[2].n_chars == 0 and by[3].n_chars == 30_000 * 10 - 1
    assert extract.extract(pages.limit(0)).count() == 0


def test_let_computes_once(spark):
    got = spark.range(3).select(let(F.col("id") * 2, lambda x: x + x).alias("v")).collect()
    assert [r.v for r in got] == [0, 4, 8]


def test_word_hashes_follow_words():
    texts = [b"", b" a bb\x0bccc\n", "é é\x1c \xa0".encode(), b"x" * 5000, b"bb", b"\t", b"ab ba"]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(words)) == len(set(hashes.tolist()))
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert word_hashes([])[0].tolist() == []
