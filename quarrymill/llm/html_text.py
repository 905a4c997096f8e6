"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; a line weighs its length, nothing where links make most of it (a lone
paragraph that is a link, with prose on both sides, keeps its weight), and a quarter beside an article or main element. Weights are
summed over sliding windows of WINDOW lines. A page has a level of its own: the lesser of PROSE_CHARS and LEVEL_PERCENT of its highest
window sum. Where the sum first reaches the level the text surges, after it last does so the text dives; the ends of an article are
such points too. Lines of an article surge by themselves, and so do paragraphs and headings on a page without one. What stands
between surge and dive is kept, but for weightless lines and, at both ends, lines that are neither paragraphs or headings nor reach the
level alone: a menu of short plain blocks goes, a short first or last paragraph stays.

Before that, lines of menus, headers, footers, sidebars, forms, adverts, notices and reader comments have no weight. Elements mark them by
name or role, or by words of a class, or of the id of a container (never of a heading or paragraph, whose ids are anchors): a whole word, the
last part of a word, or a first part that only words of layout follow; never a `no-`, `has-` or `with-` form. What is marked by words or
as a form alone but holds most of the page's text (of its articles' text, if it has articles) is a layout's name and weighs as any other.

Defined cases: a null or empty page has the empty text; unclosed and misnested tags are read as
browsers do for blocks (a block starts a new line); a tag, comment or raw text that never ends takes the rest of
the page with it, as in browsers; unknown character references stay as written; a page whose every line is marked by words
has the text of the element that holds most of it, and none if no element does; pages of any length are read whole,
in time that grows with their length; equal rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .staging import small_batches

#: Production parameters: lines a window, share of link text from which a line weighs nothing, share of the highest sum and length
#: of text that make a page's level, and the part of its weight that a line beside an article keeps.
WINDOW, LINK_PERCENT, LEVEL_PERCENT, PROSE_CHARS, BESIDE = 3, 60, 16, 60, 4
BATCH_BYTES = 4 << 20
#: Elements by their part in a page, and words in class, id or role that mark one.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("head script style noscript template iframe object svg canvas textarea select button option datalist audio video map title".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
CONTAINERS = frozenset("div section ul ol dl table tbody header form center details fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("li tr td th dt dd option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that mark an element as a whole class or id, or as its last part; of these, those that do as its first part too.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsors sponsored promo promos promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side "
    "footer header masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related recommended recommendations "
    "comment comments discussion discussions disqus replies respond copyright legal widget toolbar pagination pager skip hidden".split()
)
LEADING = frozenset("ad ads advert sidebar cookie cookies consent nav navbar menu footer comment comments newsletter promo sponsor share related breadcrumb breadcrumbs".split())
#: Words of layout that may follow a leading word.
LAYOUT = frozenset("area bar block body bottom box btn button buttons col column container content form group header heading holder inner item items left link links list module nav outer panel right row section slot tabs text title top unit widget wrap wrapper zone".split())
STATES = frozenset("no has with without is not layout".split())

TAG_OPEN = re.compile(r"<(?=[A-Za-z/!?])")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
SPACE = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)\s*(=\s*)?")
BARE = re.compile(r"[^\s>]*")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def marks(value: str, in_article: bool) -> bool:
    """True if a class or id names a part that is not main text; a header inside an article is main text."""
    for token in value.lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        if not parts or parts[0] in STATES:
            continue
        leads = parts[0] in LEADING and all(x in LAYOUT or x.isdigit() for x in parts[1:])
        word = token if token in MARKED else parts[-1] if parts[-1] in MARKED else parts[0] if leads else None
        if word and not (in_article and word in ("header", "masthead")):
            return True
    return False


class Lines:
    """Text lines of a page: (text, link characters, aside, marker, article, prose).

    aside: without weight by its element; marker: the innermost element above that class, id or a form mark, 0 for none; article: a number, 0
    outside; prose: the innermost block is a paragraph, a heading or the like.
    """

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool, int, int, bool]] = []
        self.parts: list[str] = []
        self.links = self.open_links = self.articles = 0
        #: (name, is a block, hidden, aside, marker, article, is a link); blocks by name; inline elements of each open block by name.
        self.stack: list[tuple] = []
        self.blocks: Counter = Counter()
        self.inline: list[Counter] = [Counter()]
        self.block_places: list[int] = []
        #: Parent of each marker; markers are numbered from 1 in page order.
        self.parents = [0]
        self.read(page)
        self.end_line()

    # -- tokens --------------------------------------------------------------------------------

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        closed = {'"': True, "'": True}  # whether such a quote can still follow
        while at < n:
            found = TAG_OPEN.search(page, at)
            if not found:
                self.data(page[at:])
                return
            if found.start() > at:
                self.data(page[at : found.start()])
            at = found.end()
            if page.startswith("!--", at):
                end = at + 3 if page.startswith((">", "->"), at + 3) else page.find("-->", at + 3)
                at = page.find(">", end) + 1 if end >= 0 else n
                continue
            closing = page[at] == "/"
            name = NAME.match(page, at + closing)
            if not name:  # a declaration or bogus comment, to the next >
                end = page.find(">", at)
                at = end + 1 if end >= 0 else n
                continue
            at, attributes = self.attributes(page, name.end(), closed)
            if at < 0:
                return
            tag = name[0].lower()
            if closing:
                self.end(tag)
                continue
            self.start(tag, attributes)
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else n

    @staticmethod
    def attributes(page: str, at: int, closed: dict) -> tuple[int, dict]:
        """(place after the tag, or -1 if it never ends; first value of each attribute)."""
        out: dict[str, str] = {}
        n = len(page)
        while True:
            at = SPACE.match(page, at).end()
            if at >= n:
                return -1, out
            if page[at] == ">":
                return at + 1, out
            found = ATTRIBUTE.match(page, at)
            if not found:  # a stray =
                at += 1
                continue
            at, value = found.end(), ""
            if found[2]:
                quote = page[at : at + 1]
                end = page.find(quote, at + 1) if quote in closed and closed.get(quote) else -1
                if quote in closed and end < 0:
                    closed[quote] = False
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.setdefault(found[1].lower(), value)

    # -- tree ----------------------------------------------------------------------------------

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, _, _, aside, marker, article, _ = self.stack[-1] if self.stack else (None, None, False, False, 0, 0, False)
                self.lines.append((text, self.links, aside, marker, article, self.innermost() in PROSE))
            self.parts, self.links = [], 0

    def data(self, text: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        if "&" in text:
            text = references.unescape(text)
        self.parts.append(text)
        if self.open_links:
            self.links += len(text.strip())

    def pop(self) -> tuple:
        entry = self.stack.pop()
        if entry[1]:
            self.blocks[entry[0]] -= 1
            self.inline.pop()
            self.block_places.pop()
        else:
            self.inline[-1][entry[0]] -= 1
        self.open_links -= entry[6]
        return entry

    def pop_block(self) -> str:
        """Close the innermost block and what is open in it."""
        while not (entry := self.pop())[1]:
            pass
        return entry[0]

    def innermost(self) -> str | None:
        return self.stack[self.block_places[-1]][0] if self.block_places else None

    def start(self, tag: str, attributes: dict) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        block = tag in BLOCKS
        if block:
            self.end_line()
            inner = self.innermost()
            if inner == "p" or tag in SELF_CLOSING and inner == tag:
                self.pop_block()
        if tag in VOID:
            return
        if tag == "a":
            self.end("a")  # links do not nest
        _, _, hidden, aside, marker, article, _ = self.stack[-1] if self.stack else (None, None, False, False, 0, 0, False)
        if tag in ("article", "main") and not aside and not article:
            self.articles += 1
            article = self.articles
        style = attributes.get("style", "").replace(" ", "").lower()
        concealed = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style
        aside = aside or tag in ASIDE or attributes.get("role", "").strip().lower() in ROLES or concealed or tag == "header" and not article
        if tag not in ("html", "body", "article", "main") or article and tag == "article" and self.articles != article:
            named = [attributes[k] for k in ("class", "id") if attributes.get(k) and (k == "class" or tag in CONTAINERS)]
            if tag == "form" or any(marks(references.unescape(v), article > 0) for v in named):
                self.parents.append(marker)
                marker = len(self.parents) - 1
        link = tag == "a" and ("href" in attributes or not ("name" in attributes or "id" in attributes))
        self.open_links += link
        if block:
            self.blocks[tag] += 1
            self.inline.append(Counter())
            self.block_places.append(len(self.stack))
        else:
            self.inline[-1][tag] += 1
        self.stack.append((tag, block, hidden or tag in HIDDEN, aside, marker, article, link))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.end_line()
            if self.blocks[tag] > 0:
                while self.pop_block() != tag:
                    pass
        elif self.inline[-1][tag] > 0:  # an inline end tag does not close blocks
            while self.pop()[0] != tag:
                pass

    # -- what is taken out ---------------------------------------------------------------------

    def kept(self) -> list[tuple[str, int, int, bool]]:
        """(text, link characters, article, prose) of the lines that no mark takes the weight from."""
        own = [0] * len(self.parents)
        articles = any(line[4] and not line[2] for line in self.lines)
        for text, links, aside, marker, article, _ in self.lines:
            own[marker] += 0 if aside or articles and not article else max(len(text) - links, 0)
        total = sum(own)
        for i in range(len(own) - 1, 0, -1):  # inner markers come after outer ones
            own[self.parents[i]] += own[i]
        out = [False] * len(own)
        for i in range(1, len(own)):
            out[i] = out[self.parents[i]] or 2 * own[i] <= total
        return [(text, links, article, prose) for text, links, aside, marker, article, prose in self.lines if not aside and not out[marker]]


def weigh(lines: list[tuple[str, int, int, bool]]) -> list[float]:
    articles = any(article for _, _, article, _ in lines)
    linked = [not article and 100 * links > LINK_PERCENT * len(text) for text, links, article, _ in lines]
    out = []
    for i, (text, _, article, prose) in enumerate(lines):
        lone = prose and 0 < i < len(lines) - 1 and not (linked[i - 1] or linked[i + 1]) and lines[i - 1][3] and lines[i + 1][3]
        weight = len(text) if not linked[i] or lone else 0
        out.append(weight if article or not articles else weight / BESIDE)
    return out


def sums(weights: list[float]) -> list[float]:
    """Of each line, the weight of the window that starts with it."""
    total = [0, *accumulate(weights)]
    return [total[min(i + WINDOW, len(weights))] - total[i] for i in range(len(weights))]


def region(weights: list[float], sure: list[bool], prose: list[bool], level: float) -> tuple[int, int]:
    """[surge, dive): from the first window sum that reaches the level, or sure line, to the end of the last, without weak ends."""
    points = [i for i, x in enumerate(sums(weights)) if sure[i] or x >= level > 0]
    if not points:
        return 0, 0
    a, b = points[0], min(points[-1] + WINDOW, len(weights))
    strong = [w > 0 and (s or p or w >= level) for w, s, p in zip(weights, sure, prose)]
    while a < b and not strong[a]:
        a += 1
    while a < b and not strong[b - 1]:
        b -= 1
    return a, b


def main_text(page: str | None) -> str:
    lines = Lines(page or "").kept()
    weights = weigh(lines)
    articles = any(line[2] for line in lines)
    level = min(LEVEL_PERCENT * max(sums(weights), default=0) / 100, PROSE_CHARS)
    out, start = [], 0
    for end in range(1, len(lines) + 1):
        if end < len(lines) and lines[end][2] == lines[start][2]:
            continue
        part = range(start, end)
        prose = [lines[i][3] for i in part]
        sure = [weights[i] > 0 and bool(lines[i][2] or not articles and lines[i][3]) for i in part]
        a, b = region([weights[i] for i in part], sure, prose, level)
        out += [lines[i][0] for i in part[a:b] if weights[i] > 0]
        start = end
    return "\n".join(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    kind = pages.schema[key].dataType.simpleString()
    small_batches(pages.sparkSession)
    kind_url = pages.schema[url].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in textops.slices(batch, 2, BATCH_BYTES):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    picked = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return picked.mapInArrow(run, f"id {kind}, url {kind_url}, text string, n_chars bigint").withColumnRenamed("id", key).withColumnRenamed("url", url)
