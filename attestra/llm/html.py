"""HTML main text by two-pass block rules.

The page is cut into blocks at block-level tags. Every block knows the words it holds, how many of
them are in links, how many are stop words, and which containers it lies in. The first pass decides
each block: what lies in a container that never holds article text (menus, headers of the site,
footers, sidebars, notices, adverts, forms, comments) is bad; a block of links is bad; for the rest
length and stop-word density decide, and short blocks and headings stay open. The second pass gives
each open block the label of its nearest decided neighbours: good if both are good or the nearer one
is (at equal distance only a heading before good text), and good if the page has no decided block at
all.

A class or id is a hint, not a verdict: its words speak against a container only if what density
accepts lies elsewhere. A container named so (or a form, or an ``article`` or ``main`` named after adverts
or comments) that holds ``SPARED`` times as much good text as lies outside all such containers, and at
least half of the page's, wraps the article and stays. Class names with a word such as "no", "has" or
"with" say what a page has, not what an element is, and don't count. Only tags and roles, and other
elements named after adverts, comments and the like, are bad in any case.

Stop words are known for English, French, German and Spanish. Where a page has no block that density
accepts, its long unlinked blocks outside bad containers are good whatever their words; in scripts
without spaces two characters count as a word.

An ``article`` or ``main`` element, or a container named after content, is a prior only: inside it a
long block of few stop words stays open instead of bad, the bad containers around an open block don't
count as its neighbours, and an open block without any other decided neighbour is good.

Containers are recognised by their tag, role and the words of their class and id.

Defined results: a null or empty page has the empty text; unclosed, misnested and cut-off tags never
fail, an unclosed container ends with the element around it; equal pages (repeated rows too) give equal
texts; neighbours at equal distance with different labels: see above; a very long page is parsed as a
whole, in time linear in its length but for its depth; an empty table gives an empty result; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks

MIN_WORDS, LONG_WORDS = 8, 30
LOW_STOP, HIGH_STOP = 0.15, 0.28
SPARED = 4
MAX_LINK_SHARE = 0.5

# HTML's void elements, elements whose content is never text, and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg canvas object audio video select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
BAD_TAGS = frozenset("nav footer aside form menu dialog head search fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar note".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget comment comments reply replies disqus discussion pagination pager toolbar skip disclaimer copyright form search".split()
)
HARD_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo comment comments reply replies related recommended newsletter cookie cookies".split())
GOOD_WORDS = frozenset("article content post entry story main".split())
STATE_WORDS = frozenset("no not has have with without is enabled disabled open closed free layout hide show".split())
CLOSES = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
STOP = frozenset(
    """a about after all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its
    more my no not of on one or other our out she so some such than that the their them then there these they this to up was we were
    what when which who will with would you your
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses
    son sont sur un une vous
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für haben hat ich ihr im in ist mit
    nach nicht noch nur oder sich sie sind so um und uns von vor war was wie wir zu zum zur über
    al como con del el ella ellos era es esta este ha hay las lo los más me mi muy no nos para pero por porque se ser si sin sobre su
    sus también tiene todo un una y ya""".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[\s ]+")

_SLASHED = re.compile(r"=\s*[^\s\"']*/$")  # the slash belongs to a value without quotes
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0  # characters in links
    bad: bool = False
    doubted: tuple[int, ...] = ()  # the containers around it that their names speak against
    prior: bool = False  # in an element that marks the article or whose class or id names content
    heading: bool = False
    text: str = ""


def _container(tag: str, attributes: str, inside_good: bool) -> int:
    """-2: never article text; -1: its name, or being a form, speaks against it; 2: marks the article; 1: is named after content; 0: says nothing."""
    bad, good, named, doubted, hard = tag in BAD_TAGS and tag != "form", tag in GOOD_TAGS, False, tag == "form", False
    if tag == "header" and not inside_good:
        bad = True
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return -2
            if name == "role":
                bad, good = bad or value in BAD_ROLES, good or value in ("main", "article")
            elif name in ("class", "id"):
                for one in value.split():
                    words = set(re.split(r"[^a-z]+", one))
                    if not words & STATE_WORDS:
                        doubted, hard = doubted or bool(words & BAD_WORDS), hard or bool(words & HARD_WORDS)
                    named = named or bool(words & GOOD_WORDS)
    if tag in ("body", "html"):
        return 0
    if tag in GOOD_TAGS:
        return -1 if hard else 2
    if bad or hard:
        return -2
    return -1 if doubted else 2 if good else int(named)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    block = Block()
    stack: list[tuple[str, int]] = []  # open elements and their verdict
    doubts: list[int] = []  # the doubted ones among them, by number
    n_doubts = 0
    opened: Counter[str] = Counter()
    bad = good = likely = anchors = 0
    heading = False

    def flush() -> None:
        nonlocal block
        if block.parts:
            block.text = _SPACE.sub(" ", entities.unescape("".join(block.parts))).strip()
            if block.text:
                out.append(block)
        block = Block()

    def pop() -> None:
        nonlocal bad, good, likely, anchors
        tag, verdict = stack.pop()
        opened[tag] -= 1
        bad -= verdict == -2
        if verdict == -1:
            doubts.pop()
        good -= verdict == 2
        likely -= verdict == 1
        anchors -= tag == "a"

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        words = m[4]
        if words is not None:
            if not block.parts:
                block.bad, block.prior, block.heading, block.doubted = bad > 0, good + likely > 0, heading, tuple(doubts)
            block.parts.append(words)
            if anchors:
                block.linked += len(words.strip())
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                heading = False
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "br":
                block.parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                block.parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            for open_tag, closers in CLOSES.items():
                if opened[open_tag] and tag in closers:
                    depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == open_tag)
                    if open_tag == "p" or all(t not in ("ul", "ol", "dl", "table", "select") for t, _ in stack[depth:]):
                        while len(stack) > depth:
                            pop()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if m[3].endswith("/") and tag not in BLOCKS and not _SLASHED.search(m[3]):
            continue
        verdict = _container(tag, m[3], good > 0)
        stack.append((tag, verdict))
        opened[tag] += 1
        bad += verdict == -2
        if verdict == -1:
            doubts.append(n_doubts)
            n_doubts += 1
        good += verdict == 2
        likely += verdict == 1
        anchors += tag == "a"
        if verdict < 0 and tag not in BLOCKS:
            flush()
    flush()
    _settle(out)
    return out


def _settle(blocks: list[Block]) -> None:
    """Blocks in doubted containers are bad, but for those of containers that wrap the article."""
    inside: Counter[int] = Counter()
    free = total = 0
    for b in blocks:
        if not b.bad and _by_density(b):
            total += len(b.text)
            free += 0 if b.doubted else len(b.text)
            for c in b.doubted:
                inside[c] += len(b.text)
    spared = {c for c, n in inside.items() if n >= SPARED * free and 2 * n >= total}
    for b in blocks:
        b.bad = b.bad or not spared.issuperset(b.doubted)


def _length(text: str) -> int:
    return max(len(text.split()), 0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)


def decide(block: Block) -> bool | None:
    """First pass: True good, False bad, None open."""
    return False if block.bad else _by_density(block)


def _by_density(block: Block) -> bool | None:
    if block.linked > MAX_LINK_SHARE * len(block.text):
        return False
    words = block.text.lower().split()
    if len(words) < MIN_WORDS or block.heading:
        return None
    stop = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)
    if stop >= HIGH_STOP or len(words) >= LONG_WORDS and stop >= LOW_STOP:
        return True
    if stop < LOW_STOP and (block.prior or len(words) < LONG_WORDS):
        return None
    return stop >= LOW_STOP


def _neighbours(first: list[bool | None]) -> list[tuple[tuple[int, bool], tuple[int, bool]]]:
    """The nearest decided block before and after each block, with its label; places out of the page if there is none."""
    before: list[tuple[int, bool]] = []
    last = (-(1 << 60), False)
    for i, v in enumerate(first):
        if v is not None:
            last = (i, v)
        before.append(last)
    after: list[tuple[int, bool]] = [(0, False)] * len(first)
    last = (1 << 60, False)
    for i in range(len(first) - 1, -1, -1):
        if first[i] is not None:
            last = (i, first[i])
        after[i] = last
    return list(zip(before, after, strict=True))


def extract(page: str | None) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    first = [decide(b) for b in blocks]
    if True not in first:  # no text of a language that is known: length and links decide
        first = [True if not (b.bad or b.heading) and b.linked <= MAX_LINK_SHARE * len(b.text) and _length(b.text) >= LONG_WORDS else v for b, v in zip(blocks, first, strict=True)]
    every = _neighbours(first)
    inner = _neighbours([None if b.bad else v for b, v in zip(blocks, first, strict=True)])
    keep = []
    for i, v in enumerate(first):
        if v is None:
            (p, pv), (n, nv) = (inner if blocks[i].prior else every)[i]
            alone = p < 0 and n >= len(first)
            v = alone or pv and nv or (nv if n - i < i - p else pv if i - p < n - i else nv and blocks[i].heading)
        keep.append(v)
    return "\n".join(b.text for b, v in zip(blocks, keep, strict=True) if v)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = pa.array([extract(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")
