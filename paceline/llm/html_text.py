"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import mapper

# Element names of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select xmp noframes".split())
ASIDE = frozenset("nav footer aside form menu dialog button head label input fieldset".split()) | RAW
# Elements whose start closes an open element of the same kind (end tags left out).
CLOSES = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dd", "dd": "dd", "option": "option"}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"side-?bars?|footers?|site-?header|page-?header|masthead|header|comments?|commentlist|disqus|repl(?:y|ies)|responses?|discussion|reactions?|feedback|notices?|cookies?|consent|gdpr|alerts?|pop-?ups?|modals?|overlays?|"
    r"newsletters?|subscribe|subscription|related|recommended|share|sharing|social|tags|widgets?|pagination|pager|toolbar|login|signup|search|skip-?link|paywall|copyright)(?=$|[\s_-])",
    re.I,
)
# Names that only tell of a part elsewhere, and headers that hold an article's own title.
NOT_NOISE = re.compile(r"\b(?:has|with|without|no)[_-][\w-]+|\b(?:article|post|entry|story|content)[_-]+header\b", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|responses?|teaser|card|related|promo|sponsor(?:ed)?|ads?|advert)(?=$|[\s_-])", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
MAIN = frozenset(("article", "main"))

# Elements that hold a piece of text, not a part of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl dir dt table thead tbody tfoot tr caption pre blockquote figure figcaption address details summary".split())
CELLS = frozenset("td th li dd".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"\s+")


class Node:
    """A block element: its parent, depth, name, and name with class."""

    __slots__ = ("parent", "depth", "name", "kind")

    def __init__(self, parent: Node | None, name: str, kind: tuple[str, str]):
        self.parent, self.name, self.kind = parent, name, kind
        self.depth = parent.depth + 1 if parent else 0


class Line:
    """One block's text: its letters within links, and the main element, heading and block that it stands in."""

    __slots__ = ("text", "linked", "main", "heading", "node")

    def __init__(self, text: str, linked: int, main: int, heading: bool, node: Node):
        self.text, self.linked, self.main, self.heading, self.node = text, linked, main, heading, node


def _noisy(name: str, attrs: str, in_main: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body"):
        return False
    noise = COMMENT if name in MAIN else NOISE
    for k, *values in _ATTR.findall(attrs):
        k, v = k.lower(), next(filter(None, values), "")
        if k in ("class", "id") and noise.search(NOT_NOISE.sub(" ", CAMEL.sub("-", v))):
            return True
        if (k == "role" and v.lower() in ROLES) or (k == "hidden") or (k == "aria-hidden" and v.lower() == "true"):
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


def _class(attrs: str) -> str:
    return next((" ".join(next(filter(None, v), "").split()) for k, *v in _ATTR.findall(attrs) if k.lower() == "class"), "")


def lines(page: str) -> list[Line]:
    """Strip the markup of ``page``: one line for each run of text between block boundaries.

    Scripts, styles and what is marked as menu, header, footer, sidebar, notice, advert, form or comment
    goes with the markup.  ``main`` numbers the outermost article or main element around a line (0: none).
    """
    out: list[Line] = []
    buffer: list[str] = []
    linked = mains = 0
    root = Node(None, "", ("", ""))
    stack: list[tuple[str, bool, Node]] = []  # open elements, whether their text is left out, and the block around it
    outer, heading, in_link = 0, False, False

    def flush() -> None:
        nonlocal linked
        text = _WHITE.sub(" ", html.unescape("".join(buffer))).strip()
        if text:
            out.append(Line(text, linked, outer, heading, stack[-1][2] if stack else root))
        buffer.clear()
        linked = 0

    opened: Counter[str] = Counter()  # open elements by name, headings and main elements together as well

    def push(name: str, left_out: bool, node: Node) -> None:
        stack.append((name, left_out, node))
        opened[name] += 1
        opened["#heading"] += name[0] == "h" and name[1:].isdigit()
        opened["#main"] += name in MAIN

    def pop(to: int) -> None:
        while len(stack) > to:
            name, *_ = stack.pop()
            opened[name] -= 1
            opened["#heading"] -= name[0] == "h" and name[1:].isdigit()
            opened["#main"] -= name in MAIN

    def state() -> None:
        nonlocal outer, heading, in_link
        heading, in_link = opened["#heading"] > 0, opened["a"] > 0
        if not opened["#main"]:
            outer = 0

    at, skip = 0, False
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not skip:
            buffer.append(text)
            linked += len(text) * in_link
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA[") and not skip:
            buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            flush()
        if m[1]:
            if opened[name]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        else:
            if CLOSES.get(name):
                alike = any(opened[k] for k, v in CLOSES.items() if v == CLOSES[name])
                stop = {"li": ("ul", "ol", "menu"), "p": BLOCKS - {"p"}}.get(name, ("table", "dl", "select"))
                for i in range(len(stack) - 1, -1, -1) if alike else ():
                    if CLOSES.get(stack[i][0]) == CLOSES[name]:
                        pop(i)
                        break
                    if stack[i][0] in stop:
                        break
            elif name in BLOCKS and stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name in MAIN and not outer and not skip:
                mains += 1
                outer = mains
            skip_now = (bool(stack) and stack[-1][1]) or _noisy(name, m[3], bool(outer))
            node = stack[-1][2] if stack else root
            if name in BLOCKS:
                node = Node(node, name, (name, _class(m[3]) if m[3] else ""))
            if name in RAW:  # its content is no markup
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                push(name, skip_now, node)
        state()
        skip = bool(stack) and stack[-1][1]
    flush()
    return out


def _ancestor(a: Node, b: Node) -> Node:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def _child(node: Node, above: Node) -> Node | None:
    """The child of ``above`` that is or holds ``node``; none where it isn't within, or is ``above`` itself."""
    last = None
    while node is not None and node.depth > above.depth:
        last, node = node, node.parent
    return last if node is above else None


def _inside(node: Node, above: Node) -> bool:
    return node is above or _child(node, above) is not None


def _links(row: Line, surge: float) -> bool:
    return row.linked >= 0.8 * len(row.text) and len(row.text) - row.linked < surge and not row.heading


def container(rows: list[Line], size: np.ndarray, first: int, stop: int, surge: float) -> Node:
    """The smallest element around the lines of a run that is a part of the page.

    A paragraph, list or table is none, nor is a cell or item of one line, nor one of several elements with the
    same name, class and parent that each hold ``surge`` of text: there the parent is asked.
    """
    text = [i for i in range(first, stop) if size[i]] or [first]
    node = rows[text[0]].node
    for i in text[1:]:
        node = _ancestor(node, rows[i].node)
    while node.parent is not None and node.name != "body":
        if node.name in TEXTUAL:
            node = node.parent
            continue
        held: dict[Node, float] = {}
        for r, n in zip(rows, size.tolist()):
            if (part := _child(r.node, node.parent)) and part.kind == node.kind:
                held[part] = held.get(part, 0.0) + n
        alike = sum(n >= surge for part, n in held.items() if part is not node) and node.name not in ("td", "th")
        one = sum(_inside(r.node, node) for r in rows) == 1
        if not (alike or (one and node.name in CELLS)):
            break
        node = node.parent
    return node


def main_lines(rows: list[Line], width: int = 3, surge: float = 60.0) -> list[Line]:
    """The lines from surge to dive of the text-length distribution.

    ``block[i]`` sums the unlinked text of ``width`` lines from line i on.  The main run holds the greatest total
    of text over consecutive lines whose blocks stay at ``surge`` or more (or half the greatest block, where all
    are less).  Other runs in the same ``container`` belong to it with all that stands between, however short the lines
    that part them, and with lines of links; those before the first and after the last text go.  It then reaches over the rest of each article or main element that holds a part of it, and never over
    one outside it.  Less than ``surge`` of text between its end and these elements' border, which the blocks only look
    at, goes; headings that stand right before it stay.
    """
    if not rows:
        return []
    size = np.array([max(0, len(r.text) - r.linked) for r in rows], float)
    block = np.convolve(size, np.ones(width))[width - 1 :] if len(size) >= width else size[::-1].cumsum()[::-1]
    block = np.concatenate([block, np.zeros(len(rows) - len(block))]) if len(block) < len(rows) else block[: len(rows)]
    high = block >= min(surge, 0.5 * float(block.max()))
    runs, start, total = [], None, 0.0
    for i, up in enumerate([*high.tolist(), False]):
        if up:
            start, total = (i, 0.0) if start is None else (start, total)
            total += size[i]
        elif start is not None:
            stop = min(len(rows), i + width - 1)  # a block reaches over the lines after its start
            while stop > i and size[stop - 1] == 0:
                stop -= 1
            total += float(size[i:stop].sum())
            runs.append((start, stop, total))
            start = None
    first, stop, _ = best = max(runs, key=lambda r: r[2])
    if len(runs) > 1:
        part = container(rows, size, first, stop, surge)
        at = runs.index(best)
        for near in runs[at + 1 :]:
            if not all(_inside(r.node, part) for r, n in zip(rows[stop : near[1]], size[stop : near[1]]) if n):
                break
            stop = near[1]
        for near in runs[:at][::-1]:
            if not all(_inside(r.node, part) for r, n in zip(rows[near[0] : first], size[near[0] : first]) if n):
                break
            first = near[0]
    while first < stop and _links(rows[first], surge):  # blocks reach over lines before and after the text
        first += 1
    while first < stop and _links(rows[stop - 1], surge):
        stop -= 1
    held = {r.main for r in rows[first:stop] if r.main}
    if held:  # the elements' borders, unless as much text as makes a surge stands beyond them
        at = [i for i, r in enumerate(rows) if r.main in held]
        begin, end = at[0], at[-1] + 1
        first = min(first, begin) if size[first:begin].sum() >= surge else begin
        stop = max(stop, end) if size[end:stop].sum() >= surge else end
    while first and rows[first - 1].heading:
        first -= 1
    return rows[first:stop]


def extract(page: str | None, width: int = 3, surge: float = 60.0) -> str:
    """Main text of one page, blocks joined by a space; null, empty or textless pages give the empty string."""
    return " ".join(r.text for r in main_lines(lines(page or ""), width, surge))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", width: int = 3, surge: float = 60.0) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``, by the whole html, however long or deeply nested.

    A null or empty page, and one without text, has the empty text.  Of runs of equal length the first in the page is the main one.
    Repeated rows and null ids or urls stay as they are; an empty table gives no rows; other columns are left out.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        def work(ids, urls, html_texts):
            texts = [extract(h, width, surge) for h in html_texts]
            return [ids, urls, texts, [len(t) for t in texts]]

        return work

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(mapper(["page_id", "url", "html"], make, schema, "html"), "page_id long, url string, text string, n_chars long")
