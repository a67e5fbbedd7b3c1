"""HTML to text by layout: a tree builder with implied tags, rules of visibility, and a renderer for blocks, lists and tables.

All visible text comes out, once and in order. White space collapses in running text and stays in `pre`; blocks stand on
lines of their own, paragraphs and headings with an empty line between; list items are marked and indented by depth; the
cells of a table are padded to their column's width. What is shown is decided by tags, `hidden`, inline styles, and the
rules of the page's own style elements whose selectors name one element (tag, classes, id); `visibility` may be turned on again
inside a part where it is off, `display: none` may not.

Time and output grow in proportion to the page. Columns are padded to PAD characters at most, a wider cell only moves the rest
of its own line, and no more than LEAP is left blank before a cell; past DEEPEST insets (lists, quotations, tables in each other) text is no longer indented further, but keeps its marks.

Defined cases: null and empty pages give empty text; unclosed and stray tags are repaired as a browser would, and once a tag's
quotation marks were found to run off the page's end, later tags end at the first >; elements nest to any depth, as tree and
text are built without recursion; pages are rendered one by one, so repeated rows and null ids stay; a very long page is
held as a tree, in memory of some ten times its length; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator
from itertools import accumulate
from html import unescape

from pyspark.sql import DataFrame

from barloom.llm.common import with_columns

# Fixed values of the HTML standard, as far as layout needs them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video datalist title meta link base area param source track noembed noframes annotation annotation-xml".split())
DRAWN_LATER = frozenset("defs symbol clippath mask pattern marker metadata desc title script style".split())  # parts of svg that show no text
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
PLAIN = frozenset("p div h1 h2 h3 h4 h5 h6 a b i em strong span small code".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
# A start tag ends open elements of the second list, looked for up to one of the third.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("td th tr caption colgroup", "table"), "tbody": ("td th tr tbody thead tfoot caption colgroup", "table"),
    "thead": ("td th tr tbody thead tfoot caption colgroup", "table"), "tfoot": ("td th tr tbody thead tfoot caption colgroup", "table"), "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
SCOPE = frozenset("table td th caption html template".split())
PASSES = frozenset("table tr tbody thead tfoot body html".split())

_TAG = re.compile(r"""<(?:!--(?:(?!-->).)*+(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|[!?/][^>]*+>)""", re.S)
_PLAIN_TAG = re.compile(r"""<(?:!--(?:(?!-->).)*+(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(?P<x>(?!))(?P<y>(?!))|[!?/][^>]*+>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_COMMENT = re.compile(r"/\*(?:(?!\*/).)*+(?:\*/|\Z)", re.S)
_BRACES = re.compile(r"([{}])")
_SELECTOR = re.compile(r"[\w*-]*(?:[.#][\w-]+)*", re.A)
_PART = re.compile(r"[.#]?[\w*-]+", re.A)
PAD = 60
DEEPEST = 32
LEAP = 4 * PAD  # the most that is left blank before a cell
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RUN = re.compile(r"[\t\n\r\f]|  ")  # white space that isn't one plain space


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        """An attribute's value; "" where it has none; None where it isn't there."""
        if not self.attrs or name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


class Open:
    """The open elements, and for each tag the positions at which it is open, so that no search walks them all."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """End the element at position k and all inside it."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost position of one of the tags; 0, the root's, where none is open."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def imply(self, ends: frozenset, stop: frozenset) -> None:
        """End the elements a start tag ends: the outermost of `ends` inside the innermost of `stop`."""
        outer = self.last(stop)
        if self.last(ends) > outer:
            self.cut(min(p[k] for t in ends if (p := self.at.get(t)) and (k := bisect_left(p, outer + 1)) < len(p)))

    def close(self, name: str) -> None:
        """End the nearest open element of that name, and what is open inside; nothing where a table cell stands between."""
        p = self.at.get(name)
        if p and (name in PASSES or p[-1] == len(self.nodes) - 1 or self.last(SCOPE) <= p[-1]):
            self.cut(p[-1])


def declared(style: str) -> tuple[bool | None, bool | None]:
    """Whether declarations show an element (display) and its text (visibility); None where they don't say."""
    display = visibility = None
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.partition("!")[0].strip()
        if name == "display" and value:
            display = value != "none"
        elif name == "visibility" and value:
            visibility = value not in ("hidden", "collapse") if value != "inherit" else None
    return display, visibility


class Styles:
    """Rules of style elements that say whether something is shown, for selectors of one element; rules within @ blocks are left out."""

    def __init__(self):
        self.rules: dict[str, list] = {}  # by one part of the selector -> (weight, other parts, display, visibility)

    def read(self, css: str) -> None:
        depth, prelude, order, skip = 0, "", 0, False
        for part in _BRACES.split(_COMMENT.sub(" ", css)):
            if part == "{":
                skip = skip or prelude.lstrip().startswith("@")
                depth += 1
            elif part == "}":
                depth = max(0, depth - 1)
                skip = skip and depth > 0
                prelude = ""
            elif depth == 1 and not skip and prelude:
                found = declared(part)
                if found != (None, None):
                    for selector in prelude.split(","):
                        self.add(selector.strip().lower(), found)
            else:
                prelude = part.rpartition(";")[2]

    def add(self, selector: str, found: tuple[bool | None, bool | None]) -> None:
        if not selector or not _SELECTOR.fullmatch(selector):
            return
        parts = [p for p in _PART.findall(selector) if p != "*"]
        weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), sum(p[0] not in "#." for p in parts))
        self.rules.setdefault(parts[-1] if parts else "*", []).append((weight, frozenset(parts), *found))

    def of(self, node: "Node") -> tuple[bool | None, bool | None]:
        own = {node.tag}
        if node.attrs:
            low = node.attrs.lower()
            if "class" in low:
                own |= {f".{c}" for c in (node.get("class") or "").lower().split()}
            if "id" in low and (name := node.get("id")):
                own.add(f"#{name.lower()}")
        out: list[bool | None] = [None, None]
        best: list[tuple] = [(-1,), (-1,)]
        for key in (*own, "*"):
            for weight, parts, *found in self.rules.get(key, ()):
                if parts <= own:
                    for k in (0, 1):
                        if found[k] is not None and weight >= best[k]:
                            out[k], best[k] = found[k], weight
        return out[0], out[1]


def parse(html: str, styles: Styles | None = None) -> Node:
    root = Node("html")
    stack, at, size = Open(root), 0, len(html)
    end_of_tags = html.rfind(">") + 1  # nothing that begins behind it can be a tag
    tag = _TAG

    def text(part: str) -> None:
        if part:
            stack.nodes[-1].children.append(unescape(part) if "&" in part else part)

    while at < size:
        m = tag.search(html, at, end_of_tags)
        if not m:
            rest = html.find("<!--", max(at, end_of_tags - 3))
            text(html[at : rest if rest >= 0 else size])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[5]:  # its quotation marks run to the end; looking that far for each such tag would take the square of the page
            tag = _PLAIN_TAG
        if not name:
            continue
        if m[1] or m[4]:
            stack.close(name)
            continue
        attrs = m[3] or ""
        if name in IMPLIED:
            stack.imply(*IMPLIED[name])
        if name in CLOSES_P:
            stack.close("p")
        if name == "html" or name == "body" and stack.at.get(name):
            continue
        node = Node(name, attrs)
        stack.nodes[-1].children.append(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at, end_of_tags)
            body = html[at : end.start() if end else size]
            at = end.end() if end else size
            if name in ("textarea", "title"):
                node.children.append(unescape(body))
            elif name == "xmp":
                node.children.append(body)
            elif name == "style" and styles is not None:
                styles.read(body)
            continue
        stack.push(node)
    return root


def shown(node: Node, styles: Styles) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether its text is visible (None: as around it)."""
    if node.tag in HIDDEN:
        return False, None
    display, visibility = styles.of(node) if styles.rules else (None, None)
    if not node.attrs:
        return node.tag != "dialog" if display is None else display, visibility
    low = node.attrs.lower()
    if node.tag == "input" and (node.get("type") or "").lower() == "hidden":
        return False, None
    if "style" in low and (style := node.get("style")):
        own = declared(style)
        display = display if own[0] is None else own[0]
        visibility = visibility if own[1] is None else own[1]
    if display is None and "hidden" in low and (hidden := node.get("hidden")) is not None and hidden.lower() != "until-found":
        return False, None
    if display is None and node.tag == "dialog":
        return node.get("open") is not None, visibility
    return display is not False, visibility


class Page:
    """Lines so far, the line being written, and what is due before the next text."""

    def __init__(self, styles: Styles, inset: int = 0, hid: bool = False):
        self.styles, self.inset, self.hid = styles, inset, hid
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.lead = ""  # marks of items that are due before the next text, where it is no longer indented

    def flow(self, text: str, pre: bool) -> None:
        if self.hid:
            return
        if pre:
            parts = text.replace("\r\n", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.line(force=True)
                if part:
                    self.put(part)
            return
        collapsed = _SPACE.sub(" ", text) if _RUN.search(text) else text
        if collapsed == " ":
            self.space = bool(self.now)
            return
        if collapsed[:1] == " ":
            collapsed, self.space = collapsed[1:], bool(self.now)
        if not collapsed:
            return
        tail = collapsed[-1] == " "
        self.put(collapsed[:-1] if tail else collapsed)
        self.space = tail

    def put(self, text: str) -> None:
        if not self.now and self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        if self.lead:
            text, self.lead = self.lead + text, ""
        self.now.append(text)

    def line(self, gap: int = 1, force: bool = False) -> None:
        if self.now or force:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines

    def nested(self, lines: list[str], first: str, rest: str, gap: int) -> None:
        """Lines rendered apart, with what leads the first and the others."""
        self.line(gap)
        for k, x in enumerate(lines):
            if k == 0 and self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.lines.append(((first if k == 0 else rest) + x).rstrip())
        if lines:
            self.gap = 0
        self.line(gap)


def run(step: Generator):
    """The result of a generator that yields the generators whose results it needs; they wait in a list, not on Python's stack."""
    waiting, got = [step], None
    while waiting:
        try:
            step = waiting[-1].send(got)
        except StopIteration as end:
            waiting.pop()
            got = end.value
        else:
            waiting.append(step)
            got = None
    return got


def lines_of(around: Page, children: list, pre: bool = False, depth: int = 0) -> Generator:
    page = Page(around.styles, around.inset + 1, around.hid)
    yield draw(page, children, pre, depth)
    return page.done()


def draw(page: Page, children: list, pre: bool, depth: int) -> Generator:
    for c in children:
        if isinstance(c, str):
            page.flow(c, pre)
            continue
        on, visibility = shown(c, page.styles)
        if not on:
            continue
        if visibility is None:
            if c.tag in PLAIN and len(c.children) == 1 and isinstance(c.children[0], str):  # most elements; a generator less for each
                gap = 2 if c.tag in SPACED else 1
                if c.tag in BLOCK:
                    page.line(gap)
                page.flow(c.children[0], pre)
                if c.tag in BLOCK:
                    page.line(gap)
            else:
                yield draw_one(page, c, pre, depth)
        else:
            around, page.hid = page.hid, not visibility
            yield draw_one(page, c, pre, depth)
            page.hid = around


def draw_one(page: Page, c: Node, pre: bool, depth: int) -> Generator:
    tag, deep = c.tag, page.inset >= DEEPEST
    if tag == "br":
        if not page.hid:
            page.line(force=True)
            page.gap = 0
    elif tag in ("ul", "ol", "menu", "dir"):
        yield draw_list(page, c, pre, depth)
    elif tag == "table" and not deep:
        page.line(2)
        for row in (yield table_lines(page, c, depth)):
            page.nested([row], "", "", 1)
        page.line(2)
    elif tag in ("dd", "blockquote") and not deep:
        page.nested((yield lines_of(page, c.children, pre, depth)), "  ", "  ", 2 if tag == "blockquote" else 1)
    elif tag == "details" and c.get("open") is None:
        page.line()
        yield draw(page, [x for x in c.children if isinstance(x, Node) and x.tag == "summary"], pre, depth)
        page.line()
    elif tag in ("textarea", "pre", "xmp", "listing"):
        page.line(2 if tag != "textarea" else 1)
        body = c.children
        if body and isinstance(body[0], str) and body[0][:1] == "\n":
            body = [body[0][1:], *body[1:]]
        yield draw(page, body, True, depth)
        page.line(2 if tag != "textarea" else 1)
    elif tag == "input":
        if (c.get("type") or "text").lower() in ("submit", "reset", "button", "text", "search", "url", "email") and (value := c.get("value")):
            page.flow(value, False)
    elif tag == "svg":
        for x in svg_texts(c):
            page.line()
            yield draw(page, [x], False, depth)
            page.line()
    elif tag in BLOCK:
        gap = 2 if tag in SPACED else 1
        page.line(gap)
        yield draw(page, c.children, pre, depth)
        page.line(gap)
    else:
        yield draw(page, c.children, pre, depth)


def svg_texts(svg: Node) -> list[Node]:
    """The elements of a drawing that show text, in order."""
    out, waiting = [], list(reversed(svg.children))
    while waiting:
        c = waiting.pop()
        if isinstance(c, Node) and c.tag not in DRAWN_LATER:
            if c.tag in ("text", "foreignobject"):
                out.append(c)
            elif shown(c, Styles())[0]:
                waiting += reversed(c.children)
    return out


def draw_list(page: Page, node: Node, pre: bool, depth: int) -> Generator:
    gap = 2 if depth == 0 else 1
    page.line(gap)
    number = 1
    if node.tag == "ol" and (start := node.get("start")) and re.fullmatch(r"\s*-?\d{1,9}\s*", start):
        number = int(start)
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            on, visibility = shown(c, page.styles)
            if not on:
                continue
            if node.tag == "ol" and (value := c.get("value")) and re.fullmatch(r"\s*-?\d{1,9}\s*", value):
                number = int(value)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            around, page.hid = page.hid, page.hid if visibility is None else not visibility
            if page.inset < DEEPEST:
                page.nested((yield lines_of(page, c.children, pre, depth + 1)), mark, " " * len(mark), 1)
            else:
                before, page.lead = page.lead, page.lead + mark
                page.line()
                yield draw(page, c.children, pre, depth + 1)
                page.line()
                page.lead = before if page.lead else ""
            page.hid = around
        else:
            yield draw(page, [c], pre, depth + 1)
    page.line(gap)


def spans(cell: Node, name: str, most: int) -> int:
    """How many columns or rows a cell says it takes, as the standard bounds it; a rowspan of 0 goes to the end of its group."""
    given = cell.get(name) or "1"
    n = min(int(given), most) if re.fullmatch("[0-9]{1,9}", given) else 1
    return n or (most if name == "rowspan" else 1)


class Columns:
    """The columns that no cell of a row above takes, as runs in order; each run that is taken comes back once, when its last row has ended."""

    def __init__(self):
        self.starts, self.ends, self.due = [0], [1 << 60], {}

    def free(self, at: int) -> int:
        """The first free column from `at` on."""
        k = bisect_right(self.starts, at) - 1
        return at if k >= 0 and at < self.ends[k] else self.starts[k + 1]

    def take(self, start: int, end: int, until: int) -> None:
        """Keep what is free of the columns start to end for rows before `until`."""
        at = self.free(start)
        while at < end:
            k = bisect_right(self.starts, at) - 1
            first, last = self.starts[k], self.ends[k]
            stop = min(end, last)
            self.starts[k : k + 1], self.ends[k : k + 1] = [x for x, y in ((first, at), (stop, last)) if x < y], [y for x, y in ((first, at), (stop, last)) if x < y]
            self.due.setdefault(until, []).append((at, stop))
            at = self.free(stop)

    def row_ends(self, row: int) -> None:
        for start, end in self.due.pop(row + 1, ()):
            k = bisect_left(self.starts, start)
            if self.starts[k] == end:  # there is always a run behind
                end = self.ends[k]
                del self.starts[k], self.ends[k]
            if k and self.ends[k - 1] == start:
                self.ends[k - 1] = end
            else:
                self.starts.insert(k, start)
                self.ends.insert(k, end)


def table_lines(page: Page, table: Node, depth: int) -> Generator:
    """The captions' lines, then those of the rows, cells padded to their columns' widths (PAD at most); spanning cells take several columns,
    and keep theirs free in the rows below, as many as their group of rows has."""
    out: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []  # a cell's lines, column and number of columns
    columns = Columns()

    def part(children: list, visibility: bool | None) -> Generator:
        around, page.hid = page.hid, page.hid if visibility is None else not visibility
        lines = yield lines_of(page, children, False, depth)
        page.hid = around
        return lines

    def walk(node: Node) -> Generator:
        loose: list = []
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    loose.append(c)
                continue
            on, visibility = shown(c, page.styles)
            if not on:
                continue
            around = page.hid
            if c.tag in ("caption", "tr", "tbody", "thead", "tfoot") and visibility is not None:
                page.hid = not visibility
            if c.tag == "caption":
                out.extend((yield part(c.children, None)))
            elif c.tag == "tr":
                cells, at, row = [], 0, len(rows)
                for x in c.children:
                    if isinstance(x, Node) and x.tag in ("td", "th"):
                        on, visibility = shown(x, page.styles)
                        if on:
                            at, wide, high = columns.free(at), spans(x, "colspan", 1000), spans(x, "rowspan", 65534)
                            cells.append(((yield part(x.children, visibility)), at, wide))
                            if high > 1:
                                columns.take(at, at + wide, row + high)
                            at += wide
                    elif not isinstance(x, str) or x.strip():
                        at = columns.free(at)
                        cells.append(((yield part([x], None)), at, 1))
                        at += 1
                rows.append(cells)
                columns.row_ends(row)
            elif c.tag in ("tbody", "thead", "tfoot"):
                columns.__init__()
                yield walk(c)
                columns.__init__()
            elif c.tag not in ("colgroup", "col"):
                loose.append(c)
            page.hid = around
        if loose:
            out.extend((yield part(loose, None)))

    yield walk(table)
    widths: dict[int, int] = {}
    for cells in rows:
        for lines, at, wide in cells:
            if wide == 1:
                widths[at] = max(widths.get(at, 0), min(PAD, max(map(len, lines), default=0)))
    # where each column begins, if those before it have cells of their own
    known = sorted(widths)
    starts = [0, *accumulate(widths[c] + 2 for c in known)]
    for cells in rows:
        if not any(lines for lines, _, _ in cells):
            continue
        for k in range(max(len(lines) for lines, _, _ in cells)):
            line, due = "", 0
            for lines, at, wide in cells:
                part = lines[k] if k < len(lines) else ""
                due = max(due, starts[bisect_left(known, at)])
                line = line.ljust(min(due, len(line) + LEAP)) + part if part else line
                due = max(starts[bisect_left(known, at + wide)], len(line) + 2 if part else 0)
            out.append(line.rstrip())
    return out


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    styles = Styles()
    tree = parse(html, styles)
    return "\n".join(run(lines_of(Page(styles, -1), [tree])))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines: one row for each page."""

    def fn(htmls):
        texts = [render(h) for h in htmls]
        return [texts, [t.count("\n") + 1 if t else 0 for t in texts]]

    return with_columns(pages, ["page_id"], "html", "text string, n_lines int", fn)
