"""HTML extraction by layout-aware rendering.

A page becomes a tree: missing end tags are implied (p before a block; li, dt, dd, option, cells and rows before their like), missing rows too; an end tag of a paragraph that isn't open ends a
line as an empty paragraph does. Then all visible text is rendered. Hidden: head, script, style, template, noscript, iframe, object, datalists' and media's inner text, comments (one without an end runs to
the page's end), elements with the ``hidden`` attribute, ``aria-hidden=true`` or ``display: none``, hidden inputs, closed dialogs, and closed details but for their summary; with ``visibility: hidden`` an element's own
text, which what is below it inherits until it says otherwise. All options of a select list are shown, a line each. Blanks collapse outside pre and textarea. Blocks start on lines of their own; paragraphs,
headings, lists and tables stand apart by an empty line; list items have bullets or numbers and are indented by depth; table cells are
padded to the width of their column and parted by `` | ``; a cell that spans rows or columns keeps its place free below and beside it (up to where another cell's place begins), in columns where a cell begins. What stands in a table
but in no cell comes before it; forms and the like in a table are looked through for rows and cells.

The time is linear in the page but for logarithms, whatever its depth and spans. Padding of all tables of a page is at most PADDING blanks a character of it (and FREE more): a table that would take more is padded to columns of NARROW at
most, beyond which long lines hang over, and if that is still too much its cells are only parted. Tables nested deeper than TABLE_DEPTH give their cells as plain blocks, and nothing is indented by more than INDENT.

A null or empty page has the empty text. Repeated rows are rendered each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas svg math datalist title noframes".split())
#: Blocks, and those of them that stand apart by an empty line.
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table ul tr td th thead tbody tfoot caption option optgroup".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
#: A start tag ends the open elements named first, if no element named second is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: What may stand in a head; any other start tag closes it.
IN_HEAD = frozenset("title meta link style script base template noscript noframes".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Tables nested deeper than this are rendered as plain blocks.
TABLE_DEPTH = 8
INDENT = 80
#: Blanks that pad tables, for each character of the page and for any page; the widest column that is padded in a table that would take more.
PADDING, FREE, NARROW = 8, 10_000, 40
#: Elements through which a block doesn't end a paragraph.
FENCE = frozenset("td th table caption li div object button select datalist".split())
#: Fixed values of HTML: the widest colspan and rowspan.
COLSPAN, ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children", "seen", "shown")

    def __init__(self, tag: str, attrs: dict[str, str], seen: bool = True):
        """``seen``: the parent's text is visible; then ``seen`` is the node's own, and ``shown`` is whether it is there at all."""
        self.tag, self.attrs, self.children = tag, attrs, []
        self.shown, self.seen = tag not in HIDDEN and (tag != "dialog" or "open" in attrs), seen
        if attrs:
            style = {m[1].lower(): m[2].lower() for m in STYLE.finditer(attrs["style"])} if "style" in attrs else {}
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or style.get("display") == "none" or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
                self.shown = False
            if style.get("visibility") in ("hidden", "collapse", "visible"):
                self.seen = style["visibility"] == "visible"


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.closing = False
        self.root = Node("html", {})
        self.open = [self.root]
        #: Places of each tag's open elements, so that no search walks the open elements.
        self.at: dict[str, list[int]] = {"html": [0]}

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.at[node.tag].pop()
        del self.open[i:]

    def _end(self, names: set[str], fence: set[str]) -> None:
        while (i := self._last(names)) > 0 and i > self._last(fence):
            self._cut(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCK:
            if tag not in ("option", "optgroup"):
                self._end({"p"}, FENCE)
            if tag in ("td", "th") and not any(n.tag == "tr" for n in self.open[-2:]):
                self._push("tr", {})
        self._push(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.open[-1].seen)
        self.open[-1].children.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        fence = {"td", "th"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else set()
        i = self._last({tag})
        if i > 0 and i >= self._last(fence):
            self._cut(i)
        elif tag == "p":
            self.handle_starttag("p", [])
            self._cut(self._last({"p"}))

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = super().parse_comment(i, report)
        return len(self.rawdata) if found < 0 and self.closing else found

    def close(self) -> None:
        self.closing = True
        super().close()

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Page:
    """Lines under way: an indent, a first-line mark for list items, and how many line ends are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.due_empty = False
        self.indent = 0
        self.mark = ""

    def text(self, data: str) -> None:
        words = SPACES.sub(" ", data)
        if words == " " or not words:
            self.space |= bool(words) and bool(self.line)
            return
        if words[0] == " ":
            self.space = bool(self.line)
        self._begin()
        self.line.append((" " if self.space else "") + words.strip(" "))
        self.space = words[-1] == " "

    def _begin(self) -> None:
        if self.line:
            return
        if self.due_empty and self.lines:
            self.lines.append("")
        self.due_empty = False
        self.space = False
        self.line.append(" " * max(0, min(self.indent, INDENT) - len(self.mark)) + self.mark)
        self.mark = ""

    def exact(self, data: str) -> None:
        for i, part in enumerate(data.split("\n")):
            if i:
                self.end(keep=True)
            if part:
                self._begin()
                self.line.append(part)

    def end(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif keep and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, apart: bool) -> None:
        self.end()
        self.due_empty |= apart


def holders(table: Node) -> set[int]:
    """Ids of the nodes below ``table`` that hold rows or cells of it."""
    found: set[int] = set()
    path = [(table, iter(table.children))]
    while path:
        child = next(path[-1][1], None)
        if child is None:
            path.pop()
        elif isinstance(child, Node) and child.tag != "table" and child.shown:
            if child.tag == "tr" or child.tag in CELLS:
                for node, _ in reversed(path):
                    if id(node) in found:
                        break
                    found.add(id(node))
            if child.tag not in CELLS:
                path.append((child, iter(child.children)))
    return found


def table_parts(table: Node) -> tuple[list[list[Node]], list[Node], list[Node | str]]:
    """Rows of cells, captions, and what else is there. Forms and the like are looked through for rows and cells."""
    rows: list[list[Node]] = []
    captions: list[Node] = []
    rest: list[Node | str] = []
    through = holders(table)
    row: list[Node] | None = None
    below = [(table, iter(table.children))]
    inside = 0
    while below:
        node, children = below[-1]
        child = next(children, None)
        if child is None:
            below.pop()
            if node.tag == "tr":
                inside -= 1
                if not inside:
                    row = None
        elif isinstance(child, str):
            if node.seen:
                rest.append(child)
        elif not child.shown:
            continue
        elif child.tag in CELLS:
            if row is None:
                row = []
                rows.append(row)
            row.append(child)
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag == "tr" or child.tag in SECTIONS or id(child) in through:
            if child.tag == "tr":
                if not inside:
                    row = []
                    rows.append(row)
                inside += 1
            rest.append(" ")
            below.append((child, iter(child.children)))
        else:
            rest.append(child)
    return rows, captions, rest


def span(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name, "1")
    return max(1, min(int(n[:6]), most)) if n.isdigit() and n.isascii() else 1


class Taken:
    """Columns that cells of earlier rows hold, as runs that don't touch; each run is let go piece by piece."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []

    def free(self, at: int) -> tuple[int, int | None]:
        """The first free column from ``at``, and where the next run begins."""
        i = bisect_right(self.starts, at)
        if i and self.ends[i - 1] > at:
            at = self.ends[i - 1]
        return at, self.starts[i] if i < len(self.starts) else None

    def hold(self, start: int, end: int, row: int) -> None:
        heapq.heappush(self.until, (row, start, end))
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def let_go(self, row: int) -> None:
        """Frees what is held up to before ``row``."""
        while self.until and self.until[0][0] <= row:
            _, start, end = heapq.heappop(self.until)
            i = bisect_right(self.starts, start) - 1
            low, high = self.starts[i], self.ends[i]
            kept = [(a, b) for a, b in ((low, start), (end, high)) if a < b]
            self.starts[i : i + 1], self.ends[i : i + 1] = [a for a, _ in kept], [b for _, b in kept]


class Room:
    """How many blanks may still pad tables of a page."""

    def __init__(self, size: int) -> None:
        self.left = PADDING * size + FREE


def render_table(found: list[list[Node]], depth: int, room: Room) -> list[str]:
    rows: list[list[tuple[int, list[str]]]] = []
    taken = Taken()
    number = 0
    for row in found:
        if row:
            taken.let_go(number)
        at, cells, held = 0, [], []
        for cell in row:
            at, limit = taken.free(at)
            cells.append((at, render(cell, depth + 1, room)))
            wide, high = span(cell, "colspan", COLSPAN), span(cell, "rowspan", ROWSPAN)
            end = at + wide if limit is None else min(at + wide, limit)
            if high > 1:
                held.append((at, end, number + high))
            at = end
        for one in held:
            taken.hold(*one)
        number += bool(row)
        rows.append(cells)
    rows = [cells for cells in rows if any(lines for _, lines in cells)]
    column = {c: i for i, c in enumerate(sorted({c for cells in rows for c, _ in cells}))}
    widths = [0] * len(column)
    for cells in rows:
        for c, lines in cells:
            widths[column[c]] = max(widths[column[c]], *map(len, lines), 0)
    for most in (None, NARROW):
        own = widths if most is None else [min(w, most) for w in widths]
        upto = [0]
        for w in own:
            upto.append(upto[-1] + w + 3)
        blanks = sum(upto[column[cells[-1][0]]] * max(len(lines) for _, lines in cells) for cells in rows)
        if blanks <= room.left:
            room.left -= blanks
            return _padded(rows, column, own)
    return [" | ".join(lines[k] for _, lines in cells if k < len(lines)) for cells in rows for k in range(max(len(lines) for _, lines in cells))]


def _padded(rows: list[list[tuple[int, list[str]]]], column: dict[int, int], widths: list[int]) -> list[str]:
    out = []
    for cells in rows:
        for k in range(max(len(lines) for _, lines in cells)):
            line = [" " * w for w in widths[: column[cells[-1][0]] + 1]]
            for c, lines in cells:
                if k < len(lines):
                    line[column[c]] = lines[k].ljust(widths[column[c]])
            out.append(" | ".join(line).rstrip(" "))
    return out


def render(root: Node, depth: int = 0, room: Room | None = None) -> list[str]:
    """The lines of what is below ``root``; one stack instead of recursion, so depth does no harm."""
    page, room = Page(), room or Room(0)
    stack: list[tuple[Node, Iterator, bool, dict]] = [(root, iter(root.children), root.tag in ("pre", "textarea"), {"n": 0})]
    items = int(root.tag == "li")
    while stack:
        node, children, exact, state = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node is not root and node.tag in BLOCK:
                page.block(node.tag in APART and not (node.tag in ("ul", "ol", "menu") and state.get("nested")))
                page.indent -= state.get("in", 0)
                if node.tag == "li":
                    page.mark = ""
                    items -= 1
            continue
        folded = node.tag == "details" and "open" not in node.attrs
        if isinstance(child, str):
            if node.seen and not folded:
                page.exact(child) if exact else page.text(child)
            continue
        if not child.shown or (folded and child.tag != "summary"):
            continue
        tag, below = child.tag, {"n": 0}
        if tag == "br":
            page.end(keep=True)
            continue
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and items > 0
            below["nested"] = nested
            page.block(tag in APART and not nested)
        if tag == "table" and depth < TABLE_DEPTH:
            rows, captions, rest = table_parts(child)
            loose = Node("div", {})
            loose.children = rest
            for lines in (render(loose, depth + 1, room), [x for c in captions for x in render(c, depth + 1, room)] + render_table(rows, depth, room)):
                for line in lines:
                    page.exact(line)
                    page.end(keep=True)
                page.block(bool(lines))
            page.block(True)
            continue
        if tag in ("dd", "blockquote"):
            below["in"] = 2
            page.indent += 2
        if tag in ("ul", "ol", "menu"):
            start = child.attrs.get("start", "1")
            below["n"] = int(start) - 1 if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 0
        if tag == "li":
            state["n"] += 1
            items += 1
            mark = f"{state['n']}. " if node.tag == "ol" else "- "
            page.mark = mark if child.seen else ""
            below["in"] = len(mark)
            page.indent += below["in"]
        if not child.seen:
            pass
        elif tag == "img" and child.attrs.get("alt", "").strip():
            page.text(child.attrs["alt"])
        elif tag == "input" and child.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search") and child.attrs.get("value"):
            page.text(child.attrs["value"])
        stack.append((child, iter(child.children), exact or tag in ("pre", "textarea"), below))
    page.end()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def visible_text(html: str) -> str:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return "\n".join(render(builder.root, 0, Room(len(html))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text: a row for each page."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([visible_text(t) for t in texts], pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(look, "page_id long, text string")


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
