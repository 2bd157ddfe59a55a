"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a text layout.

The builder opens and closes what HTML leaves out: a paragraph ends at the next block, list items,
table cells, rows and options end at their next one, an end tag closes what stands open inside it,
and unknown end tags are passed over.  Scripts, styles, templates, the head and its title, elements with
``hidden``, hidden inputs and what has inline ``display:none`` are not there.  Inline ``visibility`` is inherited: what is
hidden keeps its place and shows no text, and a ``visibility:visible`` inside shows again.  Everything else is visible:
navigation and footers too.

Layout: white space runs count as one space outside ``pre``; blocks start on lines of their own,
paragraphs, headings, lists and tables are set off by a blank line; ``br`` breaks a line and
``hr`` draws one; list items get a dash or their number, and nested lists of any depth are indented, by ``MOST_INDENT``
characters at most; an image shows its alternative text.

Cells of a table stand in the columns that ``colspan`` and ``rowspan`` give them, and columns are aligned.  What is added to
align them is bounded by the page's own size: lines of a cell are broken at spaces beyond ``MOST_WIDE`` characters, no cell
is padded further than that, a row passes over ``MOST_BLANK`` columns of cells from above at most, and cells beyond column
``MOST_SPANNED`` do not reach down.  Tables of one column are plain blocks, so they nest to any depth.  Tables of more
columns, nested ``MOST_NESTED`` deep in one another, lay their cells out one below the other.

Defined results: null and empty pages render as the empty text; repeated rows each stand; broken
markup never fails; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import kept_and, portions

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_THERE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript datalist iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure".split())
CELLS = frozenset(("td", "th"))
#: Types of input whose value is shown as text; none stands for text.
SHOWN_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"))
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: An opening tag ends the open elements named first, as far down as the ones named second.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "body": (frozenset(("head",)), frozenset(("html",))),
    **dict.fromkeys(ROW_GROUPS, (ROW_GROUPS | {"tr", "td", "th", "caption"}, frozenset(("table",)))),
}
#: Bounds of the layout: see above.
MOST_INDENT, MOST_WIDE, MOST_BLANK, MOST_SPANNED, MOST_NESTED = 64, 120, 24, 200, 16
#: The greatest spans that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Tags whose end closes cells that stand open inside.
ACROSS_CELLS = frozenset(("table", "tr", "tbody", "thead", "tfoot", "body", "html"))
PARAGRAPH = frozenset(("p",))
PARAGRAPH_BOUNDS = frozenset(("table", "td", "th", "button", "object", "caption", "li"))


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """The value of an attribute, "" if it has none, None if it is not there."""
        if name not in self.attributes.lower():
            return None
        for key, a, b, c in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(a or b or c)
        return None

    def unseen(self) -> bool:
        if self.tag in UNSEEN:
            return True
        if not self.attributes:
            return False
        return self.get("hidden") is not None or bool(NOT_THERE.search(self.get("style") or "")) or (self.tag == "input" and (self.get("type") or "").lower() == "hidden")

    def shown(self, inherited: bool) -> bool:
        """Whether its own text shows."""
        own = VISIBILITY.findall(self.get("style") or "") if self.attributes else []
        return own[-1].lower() == "visible" if own else inherited

    def span(self, name: str, most: int) -> int:
        value = (self.get(name) or "").strip()
        return min(max(int(value), 1), most) if re.fullmatch(r"\d{1,9}", value) else 1

    def columns(self) -> int:
        """The most cells that a row of this table has as its own."""
        most, todo = 0, [self]
        while todo:
            node = todo.pop()
            own = [c for c in node.children if not isinstance(c, str)]
            most = max(most, sum(c.span("colspan", MOST_COLUMNS) for c in own if c.tag in CELLS))
            todo += [c for c in own if c.tag == "tr" or c.tag in ROW_GROUPS]
        return most


def build(source: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at, end = [root], 0, len(source)
    last = source.rfind(">")
    #: Where in the stack the open elements of each tag stand, ascending.
    places: dict[str, list[int]] = defaultdict(list)

    def top(tags: frozenset[str]) -> int:
        """The place of the innermost open element of ``tags``, 0 if there is none."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def cut_off(place: int) -> None:
        """Ends the open elements from ``place`` on."""
        for node in stack[place:]:
            places[node.tag].pop()
        del stack[place:]

    def close(names: frozenset[str], bounds: frozenset[str]) -> None:
        """Ends the outermost open element of ``names`` above the nearest of ``bounds``."""
        bound = top(bounds)
        found = [own[i] for t in names if (own := places[t]) and (i := bisect_right(own, bound)) < len(own)]
        if found:
            cut_off(min(found))

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    while at < end:
        opens = source.find("<", at)
        if opens < 0 or last < opens:  # no tag ends any more; an open comment hides the rest
            comment = source.find("<!--", at)
            stack[-1].children.append(source[at:] if comment < 0 else source[at:comment])
            break
        m = TAG.match(source, opens)
        if m is None:
            stack[-1].children.append(source[at : opens + 1])
            at = opens + 1
            continue
        if opens > at:
            stack[-1].children.append(source[at:opens])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = top(frozenset((tag,)))
            if place and (tag in ACROSS_CELLS or place >= top(CELLS)):
                cut_off(place)
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CELLS and stack[-1].tag in ("table", *ROW_GROUPS):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        if tag in BLOCK:
            close(PARAGRAPH, PARAGRAPH_BOUNDS)
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            inner = source[at : stop.start() if stop else end]
            if tag in ("textarea", "xmp"):
                node.children.append(inner)
            at = stop.end() if stop else end
        elif tag not in VOID:
            push(node)
    return root


class Page:
    """Lines of a layout under way; ``gap`` counts the line ends owed before the next text.

    ``lead`` is what the next line starts with, if it is the first of list items; ``indent`` what all others start with.
    ``laid`` tells that lines of a table are among them.
    """

    __slots__ = ("lines", "line", "gap", "space", "lead", "indent", "laid")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.lead, self.indent, self.laid = "", "", False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def owe(self, n: int) -> None:
        self.end_line()
        if not self.lead:
            self.gap = max(self.gap, n)

    def put(self, text: str) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 1
            self.line.append(self.lead or self.indent)
            self.lead = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def flow(self, text: str) -> None:
        words = SPACE.split(text)
        if words[0] == "" and len(words) > 1 and self.line:
            self.space = True
        inner = " ".join(w for w in words if w)
        if inner:
            self.put(inner)
            self.space = words[-1] == ""

    def exact(self, text: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                if self.line:
                    self.end_line()
                elif self.lead:
                    self.put("")
                    self.end_line()
                else:
                    self.lines.append("")
            if part:
                self.put(part)

    def break_line(self) -> None:
        if self.line:
            self.end_line()
            self.gap = 1
        elif self.lines and not self.lead:
            self.gap = min(self.gap + 1, 2)

    def open_item(self, mark: str) -> str:
        """Begins a list item and returns the indent to go back to."""
        self.owe(1)
        before = self.indent
        if len(before) + len(mark) <= MOST_INDENT:
            self.indent = before + " " * len(mark)
        self.lead = (self.lead or before) + mark
        return before

    def close_item(self, before: str) -> None:
        if self.lead:  # an item without text is its mark
            self.put("")
        self.end_line()
        self.gap, self.indent = 1, before

    def finished(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Cells of a table under way: (row, column, columns, lines), and the columns that cells from above still take."""

    __slots__ = ("row", "at", "cells", "taken")

    def __init__(self):
        self.row, self.at = -1, 0
        self.cells: list[tuple[int, int, int, list[str]]] = []
        self.taken: dict[int, int] = {}

    def next_row(self) -> None:
        self.row, self.at = self.row + 1, 0

    def place(self, columns: int, rows: int, lines: list[str]) -> None:
        while self.taken.get(self.at, 0) > self.row:
            self.at += 1
        self.cells.append((self.row, self.at, columns, lines))
        if rows > 1:
            self.taken.update(dict.fromkeys(range(self.at, min(self.at + columns, MOST_SPANNED)), self.row + rows))
        self.at += columns


def broken(lines: list[str]) -> list[str]:
    """The lines of a cell, those that are too wide broken at spaces."""
    out = []
    for line in lines:
        while len(line) > MOST_WIDE and (at := line.rfind(" ", 1, MOST_WIDE + 1)) > 0:
            out.append(line[:at].rstrip(" "))
            line = line[at + 1 :]
        out.append(line)
    return out


def aligned(cells: list[tuple[int, int, int, list[str]]]) -> list[str]:
    """Cells (row, column, columns, lines), ascending, as lines with aligned columns."""
    widths: dict[int, int] = {}
    for _, c, n, lines in cells:
        wide = max(map(len, lines), default=0)
        widths[c] = max(widths.get(c, 0), min(wide, MOST_WIDE) if n == 1 else 0)
    columns = sorted(widths)
    ends = list(accumulate((widths[c] + 3 for c in columns), initial=0))

    def width(c: int, n: int) -> int:
        """Of a cell over ``n`` columns from ``c`` on; columns in which no cell begins have none."""
        return widths[c] if n == 1 else min(ends[bisect_left(columns, c + n)] - ends[bisect_left(columns, c)] - 3, MOST_WIDE)

    out = []
    for _, row in groupby(cells, key=lambda cell: cell[0]):
        parts, column = [], 0
        for _, c, n, lines in row:
            # columns that cells from above take are blank
            parts += [(widths[b], []) for b in range(column, min(c, column + MOST_BLANK)) if b in widths]
            parts.append((width(c, n), lines))
            column = c + n
        for k in range(max(len(lines) for _, lines in parts)):
            out.append(" | ".join([(lines[k] if k < len(lines) else "").ljust(w) for w, lines in parts]).rstrip())
    return out


def render(source: str | None) -> str:
    """The visible text of a page."""
    if not source:
        return ""
    pages = [Page()]
    #: Open tables, those of one column or nested too deep as None.
    tables: list[Table | None] = []
    lists: list[list] = []
    items: list[str | None] = []
    pre = 0
    todo: list = [(build(source), False, True)]
    while todo:
        node, leaving, shown = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if shown:
                text = html.unescape(node) if "&" in node else node
                page.exact(text) if pre else page.flow(text)
            continue
        tag = node.tag
        if leaving:
            if tag in CELLS and tables and tables[-1]:
                inner = pages.pop()
                lines = inner.finished() if inner.laid else broken(inner.finished())
                tables[-1].place(node.span("colspan", MOST_COLUMNS), node.span("rowspan", MOST_ROWS), lines or [""])
            elif tag == "table":
                own = tables.pop()
                for line in aligned(own.cells) if own else ():
                    page.end_line()
                    page.put(line)
                    page.laid = True
                page.owe(2)
            elif tag == "li":
                before = items.pop()
                if before is not None:
                    page.close_item(before)
            else:
                if tag in ("ul", "ol", "menu", "dir") and lists:
                    lists.pop()
                if tag == "pre":
                    pre -= 1
                if tag in BLOCK:
                    page.owe(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            continue
        if node.unseen():
            continue
        shown = node.shown(shown)
        if tag == "br":
            page.break_line()
            continue
        if tag in ("hr", "img", "input"):
            if tag == "hr" and shown:
                page.owe(1)
                page.put("---")
                page.owe(1)
            elif tag == "img" and shown:
                page.flow(node.get("alt") or "")
            elif shown and (node.get("type") or "").lower() in SHOWN_INPUTS:
                page.flow(node.get("value") or "")
            continue
        if tag == "table":
            page.owe(2)
            tables.append(Table() if len(pages) <= MOST_NESTED and node.columns() > 1 else None)
        elif tag == "tr" and tables:
            if tables[-1]:
                tables[-1].next_row()
            else:
                page.owe(1)
        elif tag in CELLS and tables:
            if tables[-1]:
                if tables[-1].row < 0:
                    tables[-1].next_row()
                pages.append(Page())
            else:
                page.owe(1)
        elif tag == "li":
            mark = lists[-1] if lists else [None, 0]
            mark[1] += 1
            items.append(page.open_item(f"{mark[1]}. " if mark[0] == "ol" else "- ") if shown else None)
            if not shown:
                page.owe(1)
        elif tag in BLOCK:
            page.owe(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.get("start") if tag == "ol" else None
                lists.append([tag, int(start) - 1 if start and re.fullmatch(r"-?\d{1,9}", start) else 0])
            if tag == "pre":
                pre += 1
        todo.append((node, True, shown))
        todo.extend((child, False, shown) for child in reversed(node.children))
    return "\n".join(pages[0].finished()).strip("\n")


def rendered(pages: DataFrame, markup: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without ``markup`` and with ``text``, the visible text; a column named so is replaced."""
    source, back = kept_and(pages, markup, (text,))
    kept = source.columns[:-1]

    def run(batches):
        import pyarrow as pa

        for batch in portions(batches, len(kept)):
            texts = [render(x.as_py()) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, text])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(text, T.StringType())])).select(*back, text)
