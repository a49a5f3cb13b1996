"""Layout-aware text of HTML pages.

A tree builder turns the tags of a page into a tree, with the end tags that HTML implies
(a paragraph ends before a block, a list item before the next, a cell before the next, and
so on), then a renderer walks the tree and emits all visible text:

* blocks stand on lines of their own, with the blank lines of their margins between them
  (margins of neighbours do not add up);
* list items start with ``- `` or their number and are indented by their nesting;
* tables are aligned: every column is as wide as its widest cell, cells are joined by two
  spaces, a cell that spans columns takes their width, one that spans rows keeps its columns free
  in the rows below, and a cell of several lines keeps them;
* ``pre`` and ``textarea`` keep their white space; elsewhere runs of it become one space;
* images give their alternative text, form fields their value, objects their fallback;
* formulas (MathML) and drawings (SVG) give their texts, the labels of a drawing apart.

Invisible: head contents other than the title (which is not part of the page's body and is
left out as well), script, style, template, noscript, comments, elements with ``hidden`` or the
style ``display:none``, what has or inherits the style ``visibility:hidden`` or ``collapse``
(parts of it may be ``visible`` again), closed ``details`` beyond their summary, closed
``dialog``, hidden inputs, contents of iframe, audio, video, canvas and datalist, and inside
formulas and drawings annotation, annotation-xml, defs, metadata, desc and title.  Styles count
where an element's own ``style`` attribute has them; rules of style sheets (``<style>``, linked
ones) and what scripts do are not applied.  ``aria-hidden`` hides nothing from the eye.

Cases: null and empty pages give the empty text; unclosed, crossed and stray tags are
repaired as above; nesting of any depth is walked without recursion; text of any length is
rendered whole.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused

#: Element names of HTML by their behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style template noscript head title iframe audio video canvas datalist".split())
FOREIGN = {"svg", "math"}
FOREIGN_UNSEEN = set("annotation annotation-xml defs metadata desc".split())  # and title
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
            "section select summary table ul caption".split())
SPACED = set("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol ul menu dir pre table fieldset".split())
ENDS_P = BLOCK - set("body html legend summary option optgroup select caption".split())
HEAD_ONLY = set("base link meta title style script noscript template head html".split())
ROW_GROUPS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}

#: start tag -> (elements that it ends, elements at which the search stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["thead"]

NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.counts: dict[str, int] = {}  # open elements by name: no search for absent ones

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.counts[self.open.pop().tag] -= 1

    def _in_foreign(self) -> bool:
        """Whether the innermost open formula, drawing or piece of HTML in a drawing is no HTML."""
        if not any(self.counts.get(t) for t in FOREIGN):
            return False
        return next(n.tag for n in reversed(self.open) if n.tag in FOREIGN or n.tag == "foreignobject") in FOREIGN

    def _end_implied(self, ends: set, stops: set) -> None:
        """Close the outermost open element of ``ends`` that no element of ``stops`` shields."""
        if not any(self.counts.get(t) for t in ends):
            return
        found = None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in stops:
                break
            if tag in ends:
                found = depth
        if found is not None:
            self._pop_to(found)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return  # the root stands for both; a page has one of each, given or implied
        if tag not in HEAD_ONLY and self.counts.get("head"):
            self._end_implied({"head"}, set())
        if tag in ENDS_P:
            self._end_implied({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in IMPLIED:
            self._end_implied(*IMPLIED[tag])
        if tag in CELLS and self.open[-1].tag in {"table"} | ROW_GROUPS:
            self._push(Node("tr", {}))  # a cell without a row starts one
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag in FOREIGN_UNSEEN and self._in_foreign():
            node.attrs["hidden"] = ""
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # a slash closes elements of formulas and drawings, but no HTML element
        if (tag in FOREIGN or self._in_foreign()) and self.open[-1].tag == tag:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "p" and not self.counts.get("p"):
            self.open[-1].children.append(Node("p", {}))  # a stray end tag is an empty paragraph
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        if not self.counts.get(tag):
            return
        stops = set() if tag == "table" else {"table"}
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._pop_to(depth)
                return
            if self.open[depth].tag in stops:
                return

    def handle_data(self, data):
        if self.counts.get("head") and self.open[-1].tag == "head" and data.strip():
            self._end_implied({"head"}, set())
        self.open[-1].children.append(data)


def rendered(node: Node) -> bool:
    """Whether an element has a box at all."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and NO_BOX.search(a["style"]))


def shown_in(node: Node, inherited: bool) -> bool:
    """Whether the box of an element shows: its own style's last word, else what it inherits."""
    own = VISIBILITY.findall(node.attrs.get("style", ""))
    return own[-1].lower() == "visible" if own else inherited


def width(text: str) -> int:
    """Columns of a line: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of a flow of blocks; ``prefix`` stands before the first line of a list item."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.space = False  # a collapsed space waits for the next text
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, data: str) -> None:
        words = SPACES.split(data)
        for k, word in enumerate(words):
            if k:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def verbatim(self, data: str) -> None:
        first, *others = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for line in others:
            self.end(keep=True)
            self.line.append(line)
        self.space = False

    def end(self, keep: bool = False) -> None:
        """End the current line; ``keep`` also an empty one."""
        line = "".join(self.line)
        self.line, self.space = [], False
        if not line.strip() and not keep:
            return
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indent)
        if self.marker is not None:
            indent, self.marker = indent[:len(indent) - len(self.marker)] + self.marker, None
        self.lines.append((indent + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = max(self.gap, 1)

    def whole(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end()
        for line in lines:
            self.line = [line]
            self.end(keep=True)


def span(node: Node, name: str) -> int:
    found = re.match(r"\s*(\d{1,4})", node.attrs.get(name, ""))
    return min(max(int(found[1]), 1), 1000) if found else 1


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """Cells (lines, columns, rows) of each row as (first column, lines, columns): a cell takes the
    first column that no cell from above still takes."""
    taken: dict[int, int] = {}  # column -> rows from here on that a cell above takes
    out = []
    for row in rows:
        cells, at, new = [], 0, {}
        for lines, s, down in row:
            while taken.get(at, 0):
                at += 1
            cells.append((at, lines, s))
            if down > 1:
                new.update(dict.fromkeys(range(at, at + s), down - 1))
            at += s
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | new
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table; rows of cells (lines, columns that it spans, rows that it spans)."""
    rows = placed(rows)
    widths = [0] * max((at + s for row in rows for at, _, s in row), default=0)
    spans = []
    for row in rows:
        for at, lines, s in row:
            size = max(map(width, lines), default=0)
            if s == 1:
                widths[at] = max(widths[at], size)
            else:
                spans.append((s, at, size))
    for s, at, size in sorted(spans):
        missing = size - sum(widths[at:at + s]) - 2 * (s - 1)
        if missing > 0:
            widths[at + s - 1] += missing
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            parts, end = [], 0
            for at, lines, s in row:
                parts += [" " * w for w in widths[end:at]]  # columns of cells from above
                room = sum(widths[at:at + s]) + 2 * (s - 1)
                text = lines[k] if k < len(lines) else ""
                parts.append(text + " " * (room - width(text)))
                end = at + s
            out.append("  ".join(parts).rstrip())
    return out


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.row: list[tuple[list[str], int, int]] | None = None


def render(root: Node) -> str:
    """All visible text of the tree: an explicit stack of (action, argument)."""
    flows, tables, lists, pre = [Lines()], [], [], 0
    shows = [True]  # of the open elements
    stack: list[tuple[str, object]] = [("node", root)]
    while stack:
        action, x = stack.pop()
        flow = flows[-1]
        if action == "node":
            if isinstance(x, str):
                if shows[-1]:
                    flow.verbatim(x) if pre else flow.text(x)
                continue
            tag = x.tag
            if not rendered(x):
                continue
            shown = shown_in(x, shows[-1])
            if tag == "br":
                if shown:
                    flow.end(keep=True)
                continue
            if tag == "img":
                if shown:
                    flow.text(x.attrs.get("alt", ""))
                continue
            if tag == "input":
                if shown and x.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image"):
                    flow.text(x.attrs.get("value") or x.attrs.get("placeholder", ""))
                continue
            children = x.children
            if tag == "details" and "open" not in x.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.append(("end", x))
            shows.append(shown)
            if tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row = []
                tables[-1].rows.append(tables[-1].row)
            elif tag in CELLS and tables:
                flows.append(Lines())
                lists.append(None)  # lists in a cell start their own nesting
            elif tag == "caption" and tables:
                flows.append(Lines())
            elif tag in ("ul", "ol", "menu", "dir"):
                start = re.match(r"-?\d{1,9}", x.attrs.get("start", "")) if tag == "ol" else None
                lists.append([tag, int(start[0]) if start else 1])
            elif tag == "li":
                kind = lists[-1] if lists and lists[-1] else ["ul", 1]
                mark = "- "
                if kind[0] == "ol":
                    given = re.fullmatch(r"\s*(-?\d{1,9})\s*", x.attrs.get("value", ""))
                    kind[1] = int(given[1]) if given else kind[1]
                    mark = f"{kind[1]}. "
                    kind[1] += 1
                flow.indent.append(" " * len(mark))
                flow.marker = mark if shown else None
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif tag in ("pre", "textarea"):
                pre += 1
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]  # the line break after the tag is no content
            elif tag == "q" and shown:
                flow.text('"')
            elif tag == "text":
                flow.space = True  # a label of a drawing
            stack += [("node", c) for c in reversed(children)]
            continue
        tag, shown = x.tag, shows.pop()
        if tag in CELLS and tables:
            flows.pop().end()
            lists.pop()
            flow.end()
            table = tables[-1]
            if table.row is None:
                table.row = []
                table.rows.append(table.row)
            down = 65534 if x.attrs.get("rowspan", "").strip() == "0" else span(x, "rowspan")  # 0: to the end
            table.row.append((flow.lines, span(x, "colspan"), down))
            continue
        if tag == "caption" and tables:
            flows.pop().end()
            flow.end()
            flows[-1].whole(flow.lines)
            continue
        if tag in BLOCK:
            flow.end()
        if tag == "table":
            flow.whole(aligned(tables.pop().rows))
        elif tag == "tr" and tables:
            tables[-1].row = None
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            flow.indent.pop()
            flow.marker = None
        elif tag in ("blockquote", "dd"):
            flow.indent.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "q" and shown:
            flow.text('"')
        elif tag == "text":
            flow.space = True
        if tag in BLOCK:
            flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    flows[0].end()
    lines = flows[0].lines
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def visible_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def text_column(html: Column) -> Column:
    @arrow_udf("string")
    def page_texts(pages: pa.Array) -> pa.Array:
        return pa.array([visible_text(p) for p in strings(pages)], pa.string())
    return page_texts(html)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages`` and the visible text; an existing column of that name raises."""
    if unused(pages, text) != [text]:
        raise ValueError(f"column {text} exists; name another")
    return pages.withColumn(text, text_column(F.col(html)))
