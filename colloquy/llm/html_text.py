"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags; inline tags, comments and markup vanish, and
scripts, styles and the like go with their content.  Each block knows its text, how much of it
is link text, how many of its words are stop words, and what it stands in.

Pass 1 judges each block by itself.  What stands in a menu, header, footer, sidebar, notice,
advert, form or comment part (by tag, role, class or id) is bad.  If the page marks its article
(``article``, else ``main`` or a division named as content), the rest is bad too, and the article's blocks are good when they
read like prose; short blocks, blocks with few stop words and link-rich blocks stay open.  On a
page without such a mark a block is good when it is long, rich in stop words and poor in links,
bad when it is rich in links or long with hardly a stop word, and open otherwise.

Pass 2 gives each open block the label of its nearest decided neighbours, before and after; if
the two differ, the nearer one's.  Only blocks that were decided by their text take part, so an
advert inside an article says nothing about the paragraph next to it.  Within a marked article
an open block is dropped only in a run of link-rich blocks at its edge, beyond all prose: the
article's own text is kept whole, however short or odd it is.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are tolerated;
an unclosed comment or script reaches to the end; a page with no block that reads like prose
keeps its blocks that are poor in links.  Character references are decoded once, white space
inside a block becomes one space, blocks are joined by one space in page order.  Rows are worked
on one at a time and nothing is cut off.  Repeated rows get equal texts; an empty table gives
no rows; other columns of the input are not carried.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import query, table

MAX_LINKS = 0.5
SHORT = 70
LONG = 200
FEW_STOPS = 0.10
MANY_STOPS = 0.20

# Stop words by language.
STOP_WORDS = frozenset(
    """
    the of and to in is that was for it with as his on be at by had not are but from or have an they which one you
    were her all she there would their we him been has when who will more no if out so said what up its about into
    than them can only other new some could time these two may then do first any my now such like our over me even
    der die das und ein eine einer eines dem den des im ist nicht mit für auf von zu sich auch als an werden aus er
    hat dass sie nach wird bei noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    sein wurde wenn können ich es wir am um unter gegen vom
    le la les de du un une et est que qui dans en pour pas sur au avec il plus par ne se ce sont aux ou mais comme
    on tout nous sa cette être fait son ses ils elle leur même deux après sans ces entre
    el los las y del se una su con por para como más pero sus lo al o este sí porque esta entre cuando muy sin sobre
    también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos era no
    """.split()
)
# HTML elements.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea object svg math canvas noframes xmp audio video".split())
BAD_TAGS = frozenset("head title nav footer aside header form menu dialog button select search fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
BAD_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice popup modal overlay newsletter subscribe signup sidebar aside widget related recommended
    recommendations menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments
    disqus reply replies respond discussion share sharing social toolbar pagination pager login search form disclaimer
    """.split()
)
BAD_STEMS = "comment cookie advert sidebar sponsor newsletter breadcrumb footer navigation masthead disclaimer".split()
NOT_BAD = frozenset("commentary commentator".split())
OWN_NAMES = frozenset("article post entry story with has no".split())
MAIN_NAMES = frozenset("article content post entry story".split())
CLOSED_BY = {  # fixed values: an open element that a new one ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    parts: list[str]
    linked: int = 0  # characters of link text
    barred: bool = False  # stands in a menu, advert, ...
    article: bool = False
    main: bool = False
    text: str = ""
    open: str = ""  # why pass 1 could not decide: "short" or "links"
    good: bool | None = None


def barred_by(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element is, by its tag or attributes, no part of an article."""
    if tag in BAD_TAGS and not (tag == "header" and inside_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                names = {x.lower() for x in NAME_PART.findall(word)}
                bad = {x for x in names if x in BAD_NAMES or (x.startswith(tuple(BAD_STEMS)) and x not in NOT_BAD)}
                if bad and not (names & OWN_NAMES and bad <= {"header", "sidebar", "notice", "form"}):
                    return True
    return False


def marks_main(tag: str, attributes: str) -> bool:
    """Whether an element that is not barred says that it holds the page's main text."""
    if tag == "main":
        return True
    if not attributes or tag not in ("div", "section", "td"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if (name, value.lower()) in (("role", "main"), ("itemprop", "articlebody")):
            return True
        if name in ("class", "id") and any({x.lower() for x in NAME_PART.findall(w)} & MAIN_NAMES for w in value.split()):
            return True
    return False


class OpenTags:
    """The open elements, with counts, so that an end tag or a new element that ends nothing costs no walk."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, bool, bool, bool]] = []  # tag, barred, article, main, link
        self.walls: list[int] = []  # places of the block elements among them
        self.solid: list[int] = []  # the same without heads
        self.blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # inline elements since each wall

    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.items[-1][1:] if self.items else (False, False, False, False)

    def push(self, item: tuple[str, bool, bool, bool, bool]) -> None:
        if item[0] in BLOCK_TAGS:
            self.walls.append(len(self.items))
            if item[0] != "head":
                self.solid.append(len(self.items))
            self.blocks[item[0]] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][item[0]] += 1
        self.items.append(item)

    def pop(self) -> str:
        tag = self.items.pop()[0]
        if tag in BLOCK_TAGS:
            self.walls.pop()
            if tag != "head":
                self.solid.pop()
            self.blocks[tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """End the nearest such element with all in it; an inline end tag does not end a block."""
        if (self.blocks if tag in BLOCK_TAGS else self.inline[-1])[tag]:
            while self.pop() != tag:
                pass

    def make_way(self, tag: str) -> None:
        """End what a new element ends by itself: the nearest block element, seen through heads."""
        ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag in BLOCK_TAGS else set())
        if not ends:
            return
        walls = self.walls if "head" in ends else self.solid
        if walls and self.items[walls[-1]][0] in ends:
            wall = walls[-1]
            while len(self.items) > wall:
                self.pop()


def blocks_of(page: str) -> Iterator[Block]:
    """The blocks of a page, in order; some have no text."""
    stack = OpenTags()
    state = (False, False, False, False)
    block, at, n = Block([]), 0, len(page)

    def text(piece: str) -> None:
        if piece:
            block.parts.append(piece)
            if state[3]:
                block.linked += len(piece.strip())
            if not piece.isspace():
                block.barred, block.article, block.main = state[:3]

    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            yield block
            block = Block([])
        elif tag == "br":
            block.parts.append(" ")
        if closing:
            stack.close(tag)
        elif tag in RAW_TAGS:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
        elif tag not in VOID_TAGS:
            stack.make_way(tag)
            barred, article, main, link = stack.state()
            barred = barred or barred_by(tag, attributes, article or main)
            main = main or (not barred and marks_main(tag, attributes))
            stack.push((tag, barred, article or tag == "article", main, link or tag == "a"))
        state = stack.state()
    yield block


def stop_share(text: str) -> float:
    words = [w.lower() for w in WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def judge_alone(block: Block, marked: bool) -> None:
    """Pass 1."""
    size, stops = len(block.text), stop_share(block.text)
    if block.linked > MAX_LINKS * size:
        block.open = "links"
        block.good = None if marked else False
    elif marked:
        block.open, block.good = ("", True) if size >= SHORT and stops >= FEW_STOPS else ("short", None)
    elif size >= LONG and stops < FEW_STOPS:
        block.good = False
    elif size >= LONG or (size >= SHORT and stops >= MANY_STOPS):
        block.good = stops >= MANY_STOPS or None
    if block.good is None and not block.open:
        block.open = "short"


def nearest(blocks: list[Block]) -> list[tuple[tuple[int, bool] | None, tuple[int, bool] | None]]:
    """For each block the (distance, label) of the decided blocks before and after it."""
    ways = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        seen, last = [None] * len(blocks), None
        for i in order:
            seen[i] = None if last is None else (abs(i - last), blocks[last].good)
            if blocks[i].good is not None:
                last = i
        ways.append(seen)
    return list(zip(*ways, strict=True))


def judge_by_neighbours(blocks: list[Block], marked: bool) -> None:
    """Pass 2."""
    links = [b.open == "links" for b in blocks]
    for i, (block, (before, after)) in enumerate(zip(blocks, nearest(blocks), strict=True)):
        if block.good is not None:
            continue
        if marked:
            edge = (before is None) != (after is None)
            run = links[i] and (links[max(i - 1, 0) : i] == [True] or links[i + 1 : i + 2] == [True])
            block.open = "drop" if edge and run else "keep"
        elif before is None and after is None:
            block.open = "keep"
        else:
            near = min((x for x in (before, after) if x is not None), key=lambda x: (x[0], x[1]))
            block.open = "keep" if near[1] else "drop"
    for block in blocks:
        if block.good is None:
            block.good = block.open == "keep"


def main_text(page: str) -> str:
    blocks = []
    for block in blocks_of(page):
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            blocks.append(block)
    blocks = [b for b in blocks if not b.barred]
    marked = True
    if any(b.article for b in blocks):
        blocks = [b for b in blocks if b.article]
    elif any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]
    else:
        marked = False
    for block in blocks:
        judge_alone(block, marked)
    if not marked and not any(b.good for b in blocks):
        for block in blocks:  # nothing reads like prose, perhaps for want of stop words in that language
            block.good = block.open != "links"
    judge_by_neighbours(blocks, marked)
    return " ".join(b.text for b in blocks if b.good)


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column("html")]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        read_pages, "page_id long, url string, text string, n_chars long"
    )


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
