"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by
where they stand (navigation, adverts and the like), by the share of their text
inside links, and by votes for a long text and for the density of stop words.
Blocks it cannot decide take, in the second pass, the label of the nearest
decided neighbours: nearest is what shares the innermost container, then what is
fewer blocks away. Where article elements hold most of the running text, standing
inside them is one vote more and standing outside one less, and blocks inside have
their neighbours inside.

Class names, ids and forms only suggest. What they suggest of an element is dropped if
it is an article or holds one, or has a long text that is most of the page's running text.

Stop words are those of the listed language that fits the page; where none fits,
the short words that the page itself repeats most.

A page is one row and is read whole, in time linear in its length; nothing is shared
between pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.common import schema_with, table, text_chunks

# Frequent function words of each language.
STOP_WORDS = {
    "en": "the of and a to in is you that it he was for on are as with his they be at one have this "
          "from or had by not but what all were when we there can an your which their if do will "
          "each about how up out them then she so these her would has",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
          "werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum "
          "war haben nur oder aber vor zur bis mehr durch man",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont "
          "avec ou son mais comme on aux nous sa cette ses été elle être ont ils même leur fait bien "
          "tout y",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le "
          "ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy "
          "años hasta desde está",
}
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th "
    "thead title tr ul".split())
RAW_TAGS = frozenset("script style noscript template iframe svg math object canvas audio video head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside button select textarea menu dialog".split())
# Often not part of the text, but some pages stand in one as a whole.
FORM_TAGS = frozenset(("form", "fieldset"))
# Elements that hold blocks together.
CONTAINERS = frozenset(
    "article aside blockquote body center details dialog dir div dl fieldset figure footer form header "
    "hgroup main menu nav ol section table td th ul".split())
LANDMARKS = frozenset(("article", "main"))
# An open p ends where one of these begins.
ENDS_P = BLOCK_TAGS - {"html", "body", "head", "title", "option", "optgroup", "legend"}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert "
                      "alertdialog dialog".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|"
    r"alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|widget|comments?|"
    r"commentlist|disqus|replies|reviews|respond|footer|foot|copyright|share|sharing|social|related|"
    r"recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip)"
    r"(?:$|[\s_-])", re.I)
# Names that tell what is beside or about an element, not what it is.
ABOUT = re.compile(r"(?:has|have|with|without|no|not|hide|tag|category|cat)[-_]", re.I)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|lang)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

# What is left of markup behind the last >.
UNENDED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
WORD = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]|"
                  "[^\\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+")
OWN_STOPS = 30  # short words of a page taken for its stop words
INNERMOST = 1 << 30  # more containers than any block has

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: characters, and shares of text and words."""

    short: int = 70
    long: int = 200
    link_share: float = 0.4
    stops_low: float = 0.15
    stops_high: float = 0.25


@dataclass(eq=False)
class Named:
    """An element that its name suggests is not part of the text, and the one around it."""

    around: Named | None = None
    article: bool = False  # holds one
    running: int = 0  # characters of running text
    bad: bool = False


@dataclass
class Block:
    """Text between two block-level tags.

    `depth` counts the containers around it, `shared` those that are also
    around the block before it.
    """

    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    bad: bool = False
    named: Named | None = None
    landmark: bool = False
    heading: bool = False
    depth: int = 0
    shared: int = 0
    text: str = ""
    link_chars: int = 0
    n_words: int = 0
    density: float = 0.0  # stop words in a word


@dataclass
class Open:
    """An open element; numbers and marks include those of the elements around it."""

    name: str = ""
    bad: bool = False
    landmarks: int = 0
    links: int = 0
    named: Named | None = None
    depth: int = 0  # containers
    block_at: int = 0  # place of the innermost block-level element
    limit_at: int = 0  # place of the innermost element that a p does not cross


@dataclass
class Page:
    """Blocks with text in page order, the named language, named elements in page order."""

    blocks: list[Block]
    lang: str
    named: list[Named]
    usual: float = 0.0  # density of the running text


class Elements:
    """The open elements, with the places of each name."""

    def __init__(self) -> None:
        self.stack = [Open()]
        self.places: dict[str, list[int]] = defaultdict(list)

    @property
    def top(self) -> Open:
        return self.stack[-1]

    def deepest(self, name: str) -> int:
        """Place of the innermost open element of a name, 0 for none."""
        places = self.places[name]
        return places[-1] if places else 0

    def push(self, element: Open) -> None:
        at = len(self.stack)
        element.depth = self.top.depth + (element.name in CONTAINERS)
        element.block_at = at if element.name in BLOCK_TAGS else self.top.block_at
        element.limit_at = at if element.name in LIMITS_P else self.top.limit_at
        self.places[element.name].append(at)
        self.stack.append(element)

    def close_from(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()


def page_of(page: str) -> Page:
    """The blocks of a page."""
    found: list[Block] = []
    named: list[Named] = []
    elements = Elements()
    now, at, lang, shared = Block(), 0, "", 0
    endless: set[str] = set()  # raw elements without an end from here on

    def close() -> Block:
        nonlocal shared
        if now.parts:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            now.link_chars = len(" ".join(html.unescape(" ".join(now.link_parts)).split()))
            if now.text:
                found.append(now)
                shared = now.depth
        top = elements.top
        shared = min(shared, top.depth)
        return Block(bad=top.bad, named=top.named, landmark=top.landmarks > 0,
                     heading=top.name in HEADINGS, depth=top.depth, shared=shared)

    def say(text: str) -> None:
        if text:
            now.parts.append(text)
            if elements.top.links:
                now.link_parts.append(text)

    size, last_end = len(page), page.rfind(">")
    while at < size:
        tag = TAG.search(page, at) if at <= last_end else UNENDED.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at:tag.start()])
        at = tag.end()
        if at > last_end and tag.re is UNENDED:
            break
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                say(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        is_block = name in BLOCK_TAGS
        if tag[1] or tag[4]:
            if name == "br":
                say(" ")
                continue
            deepest = elements.deepest(name)
            # An inline end tag does not close the blocks around it.
            if deepest and (is_block or elements.top.block_at <= deepest):
                elements.close_from(deepest)
                if is_block:
                    now = close()
            elif is_block:
                now = close()
            continue
        if name in RAW_TAGS:
            end = None if name in endless else re.compile(
                rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = size if name in ("script", "style") else at
            continue
        if name in VOID_TAGS:
            if name == "hr":
                now = close()
            elif name == "br":
                say(" ")
            continue
        attributes = tag[3] if tag[2] else tag[6] or ""
        if name in ENDS_P and (deepest := elements.deepest("p")):
            if elements.top.limit_at < deepest:
                elements.close_from(deepest)
        elif name == "li" and elements.top.name == "li":
            elements.close_from(len(elements.stack) - 1)
        around = elements.top
        values = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)} \
            if attributes else {}
        if name == "html":
            lang = values.get("lang", "")[:2].lower()
        inside = around.landmarks > 0
        bad = around.bad or is_bad(name, values, attributes, inside)
        is_landmark = name in LANDMARKS or values.get("role", "").lower() == "main"
        mark = around.named
        if is_landmark:
            if mark:
                mark.article = True
        elif not bad and is_named(name, values, inside):
            mark = Named(mark)
            named.append(mark)
        if not attributes.rstrip().endswith("/") or is_block:
            elements.push(Open(name, bad, around.landmarks + is_landmark,
                               around.links + (name == "a"), mark))
        # A bad inline element stands apart from the block it is in.
        if is_block or (bad and not around.bad) or mark is not around.named:
            now = close()
    close()
    return Page(found, lang, named)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LIMITS_P = frozenset("table td th caption object button article section aside div".split())


def is_bad(name: str, values: dict[str, str], attributes: str, in_landmark: bool) -> bool:
    """Whether an element by itself says that it is not part of the text."""
    if name in ("html", "body", "main"):
        return False
    if name in BAD_TAGS or values.get("role", "").lower() in BAD_ROLES:
        return True
    if name == "header" and not in_landmark:
        return True
    return bool(attributes and HIDDEN.search(attributes))


def is_named(name: str, values: dict[str, str], in_landmark: bool) -> bool:
    """Whether an element's class, id or kind suggests that it is not part of the text."""
    if name in ("html", "body"):
        return False
    if name in FORM_TAGS or values.get("role", "").lower() == "form":
        return True
    labels = " ".join(x for x in f"{values.get('class', '')} {values.get('id', '')}".split()
                      if not ABOUT.match(x))
    return bool(labels) and bool(BAD_NAMES.search(labels) or (
        not in_landmark and PAGE_HEADER.search(labels)))


def words_of(text: str) -> list[str]:
    """Lower-case words; scripts that leave no spaces between words give single characters."""
    return WORD.findall(text.lower())


def stop_words(texts: Sequence[list[str]], lang: str, rules: Rules) -> frozenset[str]:
    """The stop words to look for in the blocks of a page, given as lists of words.

    Those of the named language if they are frequent enough, else those of the
    listed language that is most frequent, else the page's own short words.
    """
    counts: Counter[str] = Counter()
    for words in texts:
        counts.update(words)
    least = rules.stops_low * sum(counts.values())
    shares = {name: sum(counts[w] for w in words) for name, words in _STOPS.items()}
    best = max(shares, key=lambda name: (name == lang and shares[name] >= least, shares[name], name))
    if shares[best] >= least:
        return _STOPS[best]
    short = [(-n, w) for w, n in counts.items() if n >= 3 and len(w) <= 4 and not w.isdigit()]
    return _STOPS[best] | frozenset(w for _, w in sorted(short)[:OWN_STOPS])


def weigh(page: Page, rules: Rules) -> bool:
    """Measure the blocks and decide the named elements; whether the landmarks vote.

    Running text is that of blocks outside bad elements with few links and with
    stop words. Landmarks vote if they hold half of it, and those without any only
    if nothing else has some.
    """
    words = [words_of(b.text) for b in page.blocks]
    linked = [b.link_chars > rules.link_share * len(b.text) for b in page.blocks]
    stops = stop_words([w for b, w, x in zip(page.blocks, words, linked) if not (b.bad or x)],
                       page.lang, rules)
    counted = []
    for block, found, many_links in zip(page.blocks, words, linked):
        block.n_words = len(found)
        block.density = sum(w in stops for w in found) / len(found) if found else 0.0
        if not (block.bad or many_links) and block.density >= rules.stops_low:
            counted.append((block, len(block.text)))
            if block.named:
                block.named.running += len(block.text)
    n_words = sum(b.n_words for b, _ in counted)
    page.usual = sum(b.n_words * b.density for b, _ in counted) / max(n_words, 1)
    for x in reversed(page.named):
        if x.around:
            x.around.running += x.running
            x.around.article |= x.article
    most = max(rules.long, sum(n for _, n in counted) / 2)
    for x in page.named:
        x.bad = (x.around is not None and x.around.bad) or not (x.article or x.running > most)
    for b in page.blocks:
        b.bad = b.bad or (b.named is not None and b.named.bad)
    left = [(b, n) for b, n in counted if not b.bad]
    inside = sum(n for b, n in left if b.landmark)
    return any(b.landmark and not b.bad for b in page.blocks) and 2 * inside >= sum(n for _, n in left)


def first_pass(block: Block, landmarks: bool, usual: float, rules: Rules) -> str:
    """The label of a block by itself: good, bad, near good or too short to tell.

    Few stop words say that a block is bad if they are two standard deviations below
    what as many words of the page's running text (density `usual`) would have.
    """
    length = len(block.text)
    side = (1 if block.landmark else -1) if landmarks else 0
    if block.bad or block.link_chars > rules.link_share * length:
        return BAD
    if length < rules.short:
        return BAD if block.link_chars and side <= 0 else SHORT
    due = max(usual, rules.stops_low) * block.n_words
    few = min(rules.stops_low / 2, (due - 2 * due ** 0.5) / max(block.n_words, 1))
    if side <= 0 and block.density < few:
        return BAD
    votes = side + (length >= rules.long) + (block.density >= rules.stops_low) + (
        block.density >= rules.stops_high)
    return GOOD if votes >= 3 else NEAR if votes >= 1 else SHORT


class Seen:
    """The nearest decided blocks on one side: (containers in common, place, label).

    What is bad by its element is no part of its container, so it counts for less
    than a block decided by its text in the same container.
    """

    def __init__(self, edge: str, place: int) -> None:
        self.text, self.element = (-2, place, edge), (-3, place, BAD)

    def step_to(self, shared: int) -> None:
        self.text = (min(self.text[0], 2 * shared), *self.text[1:])
        self.element = (min(self.element[0], 2 * shared - 1), *self.element[1:])

    def add(self, place: int, label: str, by_element: bool) -> None:
        if by_element:
            self.element = (INNERMOST, place, label)
        else:
            self.text = (INNERMOST, place, label)

    def nearest(self, place: int) -> tuple[int, int, str]:
        """Containers in common, minus blocks away, label."""
        return max((common, -abs(place - at), label) for common, at, label in (self.text, self.element))


def neighbours(labels: list[str], shared: Sequence[int], by_element: Sequence[bool],
               edge: str) -> list[tuple[tuple[int, int, str], tuple[int, int, str]]]:
    """For each block the nearest decided ones before and after it."""
    size = len(labels)
    sides = []
    for order, seen in ((range(size), Seen(edge, -1)), (range(size - 1, -1, -1), Seen(edge, size))):
        side = [(0, 0, edge)] * size
        forward = seen.text[1] < 0
        for i in order:
            if forward:
                seen.step_to(shared[i])
            side[i] = seen.nearest(i)
            if labels[i] in (GOOD, BAD):
                seen.add(i, labels[i], by_element[i])
            if not forward:
                seen.step_to(shared[i])
        sides.append(side)
    return list(zip(*sides))


def second_pass(labels: list[str], shared: Sequence[int] | None = None,
                headings: Sequence[bool] | None = None, strict: Sequence[bool] | None = None,
                by_element: Sequence[bool] | None = None, edge: str = BAD) -> list[str]:
    """Decide near-good blocks first, then short ones, by the nearest decided neighbours.

    The ends of the page count as `edge`. A near-good block between two bad ones
    is bad, otherwise good. A short block takes the label on which both neighbours
    agree, else that of the nearer one, and good if both are as near; a heading
    that is as near to what follows takes that label. A strict block is good
    between two good ones only.
    """
    out = list(labels)
    shared, by_element = shared or [0] * len(out), by_element or [False] * len(out)
    for kind in (NEAR, SHORT):
        if kind not in out:
            continue
        for i, (before, after) in enumerate(neighbours(out, shared, by_element, edge)):
            if out[i] != kind:
                continue
            if before[2] == after[2]:
                out[i] = after[2]
            elif strict and strict[i]:
                out[i] = BAD
            elif kind == NEAR:
                out[i] = GOOD
            elif headings and headings[i] and after[0] >= before[0]:
                out[i] = after[2]
            else:
                out[i] = GOOD if before[:2] == after[:2] else max(before, after)[2]
    return out


def decide(page: Page, rules: Rules) -> list[tuple[str, str]]:
    """For each block its labels after the first and the second pass."""
    landmarks = weigh(page, rules)
    blocks = page.blocks
    first = [first_pass(b, landmarks, page.usual, rules) for b in blocks]
    labels = list(first)
    if landmarks:
        # Blocks inside have their neighbours inside; what is bad by its element is not one.
        inside = [i for i, b in enumerate(blocks) if b.landmark and not b.bad]
        common, low = [], INNERMOST
        for b in blocks:
            low = min(low, b.shared)
            if b.landmark and not b.bad:
                common.append(low)
                low = INNERMOST
        for i, label in zip(inside, second_pass(
                [labels[i] for i in inside], common, [blocks[i].heading for i in inside], edge=GOOD)):
            labels[i] = label
    elif GOOD not in labels:
        # Without a good block, the likeliest ones with a word are the text.
        likeliest = NEAR if NEAR in labels else SHORT
        labels = [GOOD if x == likeliest and b.n_words else x for b, x in zip(blocks, labels)]
    second = second_pass(labels, [b.shared for b in blocks], [b.heading for b in blocks],
                         [landmarks] * len(blocks), [b.bad for b in blocks])
    return list(zip(first, second))


def main_text(page: str, rules: Rules = Rules()) -> str:
    """The good blocks of a page, one to a line."""
    read = page_of(page)
    return "\n".join(b.text for b, (_, x) in zip(read.blocks, decide(read, rules)) if x == GOOD)


_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`pages` without html, with text and n_chars (code points of the text).

    Null html is an empty page; a page without a good block has an empty text.
    A row gives a row, repeats included; an empty table gives none. Columns
    named like a result are replaced.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "html")]
    rows = pages.select(*kept, "html")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches, "html"):
            texts = [main_text(page or "", rules) for page in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in kept), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return rows.mapInArrow(apply, schema_with(rows.drop("html"), "text string, n_chars long"))


def extract_query(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", F.col("text"), "n_chars")
