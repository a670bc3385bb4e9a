"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. A trained table gives the log-odds that a block of its form is content; marks of the
elements around it (a menu, a footer, an article) add to them. The log-odds are a block's capacities to the two
terminals. Blocks that follow each other, and blocks of one container, are joined by smoothness edges. The minimum cut
parts content from boilerplate: blocks whose own evidence outweighs all their edges are decided first, which changes no
minimum cut, and maximum flow decides the rest.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Log-odds that marks of boilerplate and of content add, and the most that a form can say.
AGAINST, INSIDE, FORM_LIMIT = -9.0, 5.0, 3.0
#: What a class or id in the way of boilerplate adds, or a form or the like around: a guess, which text and neighbours may outweigh.
NAMED_AGAINST = -4.0
#: Smoothness: blocks that follow each other, and blocks that share their container.
NEXT, SHARED = 0.3, 1.0
PSEUDO = 2.0

# Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template svg iframe object canvas textarea select head title annotation annotation-xml".split())
#: Raw elements that go on to the end of a page where they are not closed.
ENDLESS = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
BOILER_TAGS = frozenset("footer aside menu button".split())
#: Elements of boilerplate that may stand around a whole page: an article inside of them ends what they say.
AROUND_TAGS = frozenset("nav form dialog fieldset noscript".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu submenu topbar toolbar breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist respond reply replies disqus share sharing social related recommended pagination pager "
    "copyright legal disclaimer form search skip tags toc".split()
)
#: Names of readers' comments, which no mark inside of them ends, and what such names are made of besides.
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies disqus".split())
COMMENT_PARTS = COMMENT_NAMES | frozenset("list area section thread block box body item text author meta user reader readers title form tree container".split())
CONTENT_NAMES = frozenset("article articlebody post postbody entry story content main maincontent".split())
#: In a compound name these say that something else is beside, or isn't there: has-sidebar, no-ads.
AROUND_NAMES = frozenset("has have with without no not is layout wrapper wrap".split())
OPENED_ALONE = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

# Comments, tags (a tag with an odd quote ends at the next bracket), other markup, text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^"'<>]++|"[^"]*+"|'[^']*+')*+)>|</?[A-Za-z][^<>]*+>|<[!?/][^>]*+>?|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z:_-]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Marks that blocks inherit from the elements around them.
BOILER, CONTENT, LINK, HEAD, HIDDEN, HEADER, NAMED, AROUND, COMMENT, WITHIN = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512
#: Marks that a page may have around all it says: by names, by elements, and by names inside of elements so named.
DOUBTED = NAMED | AROUND | WITHIN


class Block:
    __slots__ = ("parts", "link", "marks", "container", "tag")

    def __init__(self, marks: int, container: int, tag: str):
        self.parts: list[str] = []
        self.link, self.marks, self.container, self.tag = 0, marks, container, tag


def _marks(tag: str, attributes: str, marks: int) -> int:
    """Marks inside an element, from those outside it."""
    if tag == "a":
        return marks | LINK
    inner = named = False
    if tag in BOILER_TAGS:
        marks |= BOILER
    elif tag in AROUND_TAGS:
        marks |= AROUND
    elif tag in CONTENT_TAGS:
        inner = True
    elif tag in HEADINGS:
        marks |= HEAD
    elif tag == "header":
        marks |= HEADER if marks & CONTENT else BOILER
    if attributes and tag not in ("body", "html"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                parts = [{x.lower() for x in NAME.findall(word)} for word in value.split()]
                names = set().union(*parts)
                boiler = set().union(*(x & BOILER_NAMES for x in parts if not x & AROUND_NAMES))
                if any(x & COMMENT_NAMES and x <= COMMENT_PARTS for x in parts):
                    marks |= COMMENT
                if boiler == {"header"} and names & CONTENT_NAMES:
                    marks |= CONTENT | HEADER  # the head of an article, with its title
                elif boiler:
                    named = True
                elif names & CONTENT_NAMES and not names & BOILER_NAMES:
                    inner = True
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    marks |= BOILER
                elif value.lower() in ("main", "article"):
                    inner = True
            elif name == "itemprop" and value.lower() == "articlebody":
                inner = True
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                marks |= HIDDEN
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                marks |= HIDDEN
    if inner:  # a mark of content ends what names further out say, and elements that may stand around a page
        marks = (marks | CONTENT) & ~DOUBTED
    if named:
        marks |= NAMED | (WITHIN if marks & NAMED else 0)
    return marks


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page, in order; scripts, styles and other raw elements have none."""
    out: list[Block] = []
    # tag, marks, number of the nearest element that holds blocks, tag of the nearest that isn't inline
    stack: list[tuple[str, int, int, str]] = [("", 0, 0, "")]
    unclosed: set[str] = set()
    opened: Counter = Counter()
    block: Block | None = None
    serial = at = 0
    end = len(html)

    def close(tags, bounds=()) -> None:
        """End the innermost of ``tags`` that stands above every element of ``bounds``."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                for t, *_ in stack[k:]:
                    opened[t] -= 1
                del stack[k:]
                return
            if stack[k][0] in bounds:
                return

    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if block is None:
                if piece.isspace():
                    continue
                _, marks, container, kind = stack[-1]
                block = Block(marks & ~LINK, container, kind)
                out.append(block)
            block.parts.append(piece)
            if stack[-1][1] & LINK:
                block.link += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                block = None
            if opened[tag] > 0:
                close((tag,))
            continue
        if tag in RAW:
            if not m[3].endswith("/") and tag != "head" and tag not in unclosed:
                stop = re.compile(rf"</{tag}(?![A-Za-z0-9:-])[^>]*>?", re.I).search(html, at)
                if stop:
                    at = stop.end()
                elif tag in ENDLESS:
                    at = end
                else:
                    unclosed.add(tag)
            continue
        if tag not in INLINE:
            block = None
            if opened["p"] > 0 and tag not in ("br", "hr"):
                close(("p",), ("article", "main", "section", "div", "td", "th", "li", "body", "blockquote"))
            if tag in OPENED_ALONE:
                same, bounds = OPENED_ALONE[tag]
                if any(opened[t] > 0 for t in same.split()):
                    close(same.split(), bounds.split())
        if tag in VOID:
            continue
        serial += 1
        _, marks, container, kind = stack[-1]
        inline = tag in INLINE
        stack.append((tag, _marks(tag, m[3], marks), container if inline or tag == "p" else serial, kind if inline else tag))
        opened[tag] += 1
    return out


def form_of(text: str, block: Block) -> int:
    """The form of a block, apart from its place: kind of element, length, share of links, last character."""
    words = text.count(" ") + 1
    length = sum(words > k for k in (2, 6, 14, 40))
    raw = max(1, sum(map(len, block.parts)))
    link = 0 if block.link == 0 else 1 if 2 * block.link < raw else 2
    tag = block.tag
    kind = 1 if tag == "p" else 2 if tag in HEADINGS else 3 if tag in ("li", "dt", "dd") else 4 if tag in ("td", "th", "tr", "table") else 0
    return ((kind * 5 + length) * 3 + link) * 2 + (text[-1] in ".!?:;\"'”»…")


def evidence(block: Block, form: int, table: dict[int, float]) -> float:
    """Log-odds that a block is content."""
    marks = block.marks
    if marks & (BOILER | COMMENT):
        return AGAINST
    odds = table.get(form, 0.0)
    if marks & DOUBTED:
        return odds + NAMED_AGAINST
    if marks & CONTENT:
        return odds + INSIDE
    return odds - (1.0 if marks & HEADER else 0.0)


def cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stand on the source's side of a minimum cut: capacities ``odds`` to the terminals, undirected edges."""
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node whose own evidence is as large as all its edges stands where that says
        i = todo.popleft()
        if side[i] is not None or abs(odds[i]) < sum(near[i].values()):
            continue
        side[i] = odds[i] > 0
        for j, w in near[i].items():
            odds[j] += w if side[i] else -w
            del near[j][i]
            todo.append(j)
        near[i].clear()
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, s in _flow(rest, odds, near).items():
            side[i] = s
    return [bool(s) for s in side]


def _flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """The same by maximum flow: shortest augmenting paths, level by level."""
    s, t, tiny = -1, -2, 1e-9
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[s], room[t] = {}, {}
    for i in nodes:
        room[s][i], room[i][s] = max(odds[i], 0.0), 0.0
        room[i][t], room[t][i] = max(-odds[i], 0.0), 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return {i: i in level for i in nodes}
        ways = {i: iter(list(room[i])) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] += flow
                k = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= tiny)
                del path[k + 1 :]
                continue
            for j in ways[i]:
                if room[i][j] > tiny and level.get(j) == level[i] + 1:
                    path.append(j)
                    ways[i] = _again(j, ways[i])
                    break
            else:
                path.pop()
                if path:
                    next(ways[path[-1]], None)


def _again(first, rest):
    yield first
    yield from rest


def text_of(block: Block) -> str:
    return " ".join(unescape("".join(block.parts)).split())


def main_text(html: str | None, table: dict[int, float]) -> str:
    """The content of a page: its blocks in order, joined by a space.

    Where names of elements, or elements that may stand around a page, leave nothing, blocks are judged without them, at
    first by the names that are left inside of others.
    """
    pairs = [(b, x) for b in blocks_of(html or "") if not b.marks & HIDDEN and (x := text_of(b))]
    text = _content(pairs, table)
    for doubted in (NAMED | AROUND, WITHIN):
        if not text and any(b.marks & doubted for b, _ in pairs):
            for b, _ in pairs:
                b.marks &= ~doubted
            text = _content(pairs, table)
    return text


def _content(pairs: list[tuple[Block, str]], table: dict[int, float]) -> str:
    odds = [evidence(b, form_of(x, b), table) for b, x in pairs]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (b, _) in enumerate(pairs):
        if i:
            edges[i - 1, i] = NEXT
        if b.container in last:
            k = (last[b.container], i)
            edges[k] = edges.get(k, 0.0) + SHARED
        last[b.container] = i
    return " ".join(x for (_, x), content in zip(pairs, cut(odds, edges)) if content)


def train_forms(pages: DataFrame) -> dict[int, float]:
    """Log-odds of content by form, from blocks of all pages that stand in marked elements: at most 300 counts reach the driver.

    Blocks in an article count as content, blocks in menus, footers and their like as boilerplate.
    """
    from math import log

    small_batches(pages.sparkSession)

    def work(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                for b in blocks_of(x.as_py() or ""):
                    if (boiler := b.marks & (BOILER | DOUBTED | COMMENT)) or b.marks & CONTENT:
                        if text := text_of(b):
                            counts[form_of(text, b), 0 if boiler else 1] += 1
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 3], ["form", "content", "n"])

    counted = pages.select("html").mapInArrow(work, "form long, content long, n long").groupBy("form", "content").agg(F.sum("n").alias("n")).collect()
    counts = {(r["form"], r["content"]): r["n"] for r in counted}
    total = [sum(n for (_, c), n in counts.items() if c == k) + PSEUDO for k in (0, 1)]
    odds = lambda f: log((counts.get((f, 1), 0) + PSEUDO) / total[1]) - log((counts.get((f, 0), 0) + PSEUDO) / total[0])
    return {f: max(-FORM_LIMIT, min(FORM_LIMIT, odds(f))) for f in {f for f, _ in counts}}


def extract_main_text(pages: DataFrame, table: dict[int, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (page_id, url, html, any others).

    A null or empty page, and one without content, has an empty text. Repeated rows are read each for itself. The table
    of forms is trained on ``pages`` unless given.
    """
    small_batches(pages.sparkSession)
    forms = train_forms(pages) if table is None else table
    kinds = dict(pages.dtypes)

    def work(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), forms) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
