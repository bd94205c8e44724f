"""HTML extraction (operator 8): layout-aware rendering of all visible text.

A tree builder on the tokens of the standard library's HTML tokenizer supplies implied tags: void
elements, paragraphs closed by blocks, list items, definition terms, options and table parts closed
by their next siblings, and end tags that close what is open inside them or are ignored.  Visibility
rules drop elements that are never rendered, those with ``hidden``, ``type=hidden`` or a style of
``display: none``; under ``visibility: hidden`` text is dropped until a descendant is visible again.

The renderer keeps block spacing (paragraphs and headings a blank line apart, other blocks on lines
of their own), list markers with indentation, preformatted text, and tables whose cells are padded
to the width of their column.  White space elsewhere collapses to single spaces.

A page is parsed within its task; nothing is shuffled, but that a table in fewer parts than there are
cores is dealt over all of them first.  Tree and renderer keep their own stacks, so
elements may be nested to any depth, and what is open is looked up by tag, not searched for.  The lines of
an inner block are held as one part of the outer one and written out at the end, so that depth doesn't
multiply the work.  For the same reason white space is bounded: indentation stops growing at
``MAX_INDENT`` columns, tables inside of ``MAX_NESTED`` others are blocks of rows, and the cells of a table
whose aligned text would be more than ``ALIGNED`` times as long as what is in its cells follow each
other two spaces apart.  No text is left out by these bounds.

Defined results: a null or empty page has an empty text; a null id stays null; broken markup is
rendered by the rules above; marked sections other than in comments are bogus comments, up to the
next ``>``; what begins like a tag behind a page's last ``>`` is text; spans of cells that aren't numbers are 1, larger ones than the HTML standard's bounds are
these bounds; a character reference beyond all characters is U+FFFD; repeated rows give repeated
rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Generator, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import slices, small_batches
from inkwell.session import spread

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_RENDERED = frozenset(
    "head title script style template noscript iframe object audio video canvas svg math datalist area param rp noframes".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: What an opening tag closes, and the elements that such closing does not look beyond.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
PARAGRAPH_STOPS = ("table", "td", "th", "li", "dd", "button", "caption")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SPACED = HEADINGS | frozenset("p blockquote ul ol dl pre table figure fieldset menu dir hr".split())
BLOCKS = CLOSES_PARAGRAPH | frozenset("html body li dt dd tr caption legend optgroup option".split())
#: The standard's bounds of a cell's spans.
MAX_COLUMNS, MAX_ROWS = 1000, 65534
#: Bounds of white space: columns of indentation, tables around an aligned one, aligned text for that of the cells.
MAX_INDENT, MAX_NESTED, ALIGNED = 64, 16, 32
_NUMBER = re.compile(r"[ \t\n\f\r]*\+?0*([0-9]*)")
_ZEROS, _FAR = re.compile(r"&#0{7,}(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of nodes and strings, with the tags that the markup leaves out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: Of each tag the places among the open elements, innermost last.
        self.places: dict[str, list[int]] = {}
        self.endless = False  # a comment was found that nothing ends

    def innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_until(self, tags, stops) -> bool:
        """Closes the innermost open element of these tags, and what is open inside it, unless it lies beyond a stop."""
        at = self.innermost(tags)
        if not at or at < self.innermost(stops):
            return False
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in CLOSES_PARAGRAPH:
            self.close_until(("p",), PARAGRAPH_STOPS)
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.places[self.open.pop().tag].pop()
        if tag in SIBLINGS:
            closed, stops = SIBLINGS[tag]
            for _ in range(3):
                if not self.close_until(closed, stops):
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end of a tag means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Node("p", {}))
            return
        stops = ("table",) if tag not in ("table", "body") else ()
        if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table", "body", "html"):
            stops = ("td", "th", "caption", "table")
        self.close_until((tag,), stops)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: int = True) -> int:
        if self.endless:
            return -1
        end = super().parse_comment(i, report)
        self.endless = end < 0
        return end


def visible(node: Node, inherited: bool) -> tuple[bool, bool]:
    """Whether the element is laid out at all, and whether its own text shows."""
    if node.tag in NOT_RENDERED or "hidden" in node.attrs or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
        return False, False
    style = node.attrs.get("style", "")
    if style:
        if _NO_DISPLAY.search(style):
            return False, False
        if found := _VISIBILITY.findall(style):
            return True, found[-1].lower() not in ("hidden", "collapse")
    return True, inherited


class Part:
    """Lines (or parts) with a mark before the first one (none: as before the others) and an indent before the others."""

    __slots__ = ("lines", "mark", "indent")

    def __init__(self, lines: list, mark: str | None = None, indent: str = "") -> None:
        self.lines, self.mark, self.indent = lines, mark, indent


def written(lines: list) -> list[str]:
    """The lines with their parts written out; lines without anything aren't indented."""
    out: list[str] = []
    stack = [[iter(lines), None, "", True]]  # what is left, its mark, all indents so far, and whether it has begun
    while stack:
        left, _, indent, _ = stack[-1]
        item = next(left, None)
        if item is None:
            stack.pop()
        elif isinstance(item, Part):
            deeper = indent + item.indent if len(indent) < MAX_INDENT else indent
            stack.append([iter(item.lines), item.mark, deeper, False])
        else:
            before, at, some = [], len(stack) - 1, bool(item)
            while not stack[at][3]:  # these parts begin with this line
                _, mark, indent, _ = stack[at]
                stack[at][3] = True
                at -= 1
                if mark is not None or some:
                    before.append(indent[len(stack[at][2]) :] if mark is None else mark)
                    some = some or bool(mark)
            text = "".join(reversed(before)) + item
            out.append(stack[at][2] + text if text else text)
    return out


class Block:
    """Lines of a block, and the blank lines that are due before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed space is due
        self.gap = 0
        self.lead = 0  # the same before the first line, for the block around this one

    def text(self, data: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(data.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end_line(force=True)
                if part:
                    self.line.append(part)
            return
        for k, word in enumerate(_SPACE.split(data)):
            if k:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            self.flush_gap()
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def flush_gap(self) -> None:
        if self.lines and self.gap:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def break_block(self, gap: int) -> None:
        """A new line begins; gap 2: after a blank one.  Of several gaps the largest counts."""
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, gap)
        else:
            self.lead = max(self.lead, gap)

    def add(self, lines: list, spaced: bool, lead: int = 0, tail: int = 0) -> None:
        gap = 2 if spaced else 1
        self.break_block(max(gap, lead))
        if lines:
            self.flush_gap()
            self.lines.append(lines[0] if len(lines) == 1 else Part(lines))
            self.gap = max(gap, tail)


#: A renderer of one element: it yields the renderers of elements inside it and is sent what they return.
Rendering = Generator["Rendering", object, object]


def completed(rendering: Rendering) -> object:
    """What a rendering returns, run on a stack of its own."""
    stack, value = [rendering], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(inner)
            value = None
    return value


def inline(node: Node, out: Block, shown: bool, keep: bool, depth: int, tables: int) -> Rendering:
    for child in node.children:
        if isinstance(child, str):
            if shown:
                out.text(child, keep)
            continue
        laid_out, show = visible(child, shown)
        if not laid_out:
            continue
        tag = child.tag
        if tag == "br":
            out.end_line(force=True)
        elif tag == "hr":
            out.break_block(2)
        elif tag == "img" and show and child.attrs.get("alt", "").strip():
            out.text(child.attrs["alt"], False)
        elif tag == "input" and show and child.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text"):
            out.text(" " + child.attrs.get("value", "") + " ", False)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.add((yield list_lines(child, show, depth + 1, tables)), depth == 0)
        elif tag == "table":
            out.add((yield table_lines(child, show, tables + 1)), True)
        elif tag in BLOCKS:
            inner = Block()
            yield inline(child, inner, show, keep or tag == "pre", depth, tables)
            inner.end_line()
            lines = inner.lines
            if tag in ("blockquote", "dd") and lines:
                lines = [Part(lines, None, "  ")]
            out.add(lines, tag in SPACED, inner.lead, inner.gap)
        else:
            yield inline(child, out, show, keep or tag in ("textarea", "listing"), depth, tables)


def list_lines(node: Node, shown: bool, depth: int, tables: int) -> Rendering:
    """Items with markers; what follows an item's first line is indented to it."""
    lines: list = []
    try:
        number = int(node.attrs.get("start", 1))
    except ValueError:
        number = 1
    for child in node.children:
        if isinstance(child, str):
            if child.strip() and shown:
                lines.append(_SPACE.sub(" ", child.strip()))
            continue
        laid_out, show = visible(child, shown)
        if not laid_out:
            continue
        inner = Block()
        holder = child if child.tag == "li" else Node("li", {})
        if child.tag != "li":
            holder.children = [child]
        yield inline(holder, inner, show, False, depth, tables)
        inner.end_line()
        mark = ""
        if child.tag == "li":
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
        if inner.lines:
            lines.append(Part(inner.lines, mark, " " * len(mark)))
    return lines


def span(value: str, most: int) -> int:
    """A cell's span by the standard's rules for numbers, at most ``most``; -1 for a zero, 1 for what isn't a number."""
    digits = _NUMBER.match(value)
    if not digits[1]:
        return -1 if "0" in digits[0] else 1
    return min(int(digits[1][:6]), most)


class Grid:
    """Rows of a table as (column, lines) of the cells that begin in them."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        #: Columns that cells from above still take: first, behind the last, the row in which they are free again.
        self.down: list[list[int]] = []
        self.until = 0

    def begin_group(self, rows: int) -> None:
        """A group of so many rows at most begins; spans end with it."""
        self.down, self.until = [], len(self.rows) + rows

    def new_row(self) -> None:
        self.rows.append([])
        self.at = self.next = 0

    def cell(self, lines: list[str], across: int, deep: int) -> None:
        row = len(self.rows) - 1
        while self.next < len(self.down):
            first, behind, free = self.down[self.next]
            if free <= row:
                del self.down[self.next]
            elif first <= self.at:
                self.at = max(self.at, behind)
                self.next += 1
            else:
                break
        self.rows[-1].append((self.at, lines))
        if deep > 1:
            free = min(row + deep, self.until)
            before = self.down[self.next - 1] if self.next else None
            if before and before[1:] == [self.at, free]:
                before[1] = self.at + across
            else:
                self.down.insert(self.next, [self.at, self.at + across, free])
                self.next += 1
        self.at += across

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for c, lines in row:
                widths[c] = max([widths.get(c, 0), *map(len, lines)])
        order = sorted(c for c, width in widths.items() if width)
        far = dict(zip(order, itertools.accumulate(widths[c] + 2 for c in order)))
        deep = [max((len(x) for _, x in row), default=0) for row in self.rows]
        held = sum(len(x) + 2 for row in self.rows for _, lines in row for x in lines)
        space = sum(n * far[max(used)] for row, n in zip(self.rows, deep) if (used := [c for c, _ in row if c in far]))
        if space > ALIGNED * (held + 1024):
            cells = ([lines for _, lines in row if lines] for row in self.rows)
            return ["  ".join(x for lines in row for x in lines) for row in cells if row]
        out = []
        for row, n in zip(self.rows, deep):
            cells = dict(row)
            if cells:
                used = order[: bisect.bisect_right(order, row[-1][0])]
                for k in range(n):
                    parts = ((cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(widths[c]) for c in used)
                    out.append("  ".join(parts).rstrip())
        return out


def table_lines(node: Node, shown: bool, tables: int) -> Rendering:
    """A caption, then rows of cells padded to the widths of their columns; spanned columns and rows stay empty.

    Deep inside of other tables its lines are those of a block.
    """
    caption: list[str] = []
    grid = Grid()
    if tables > MAX_NESTED:
        inner = Block()
        for child in node.children:
            holder = Node("div", {})
            holder.children = [child]
            yield inline(holder, inner, shown, False, 1, tables)
            inner.break_block(1)
        inner.end_line()
        return inner.lines

    def cell(source: Node, show: bool) -> Rendering:
        inner = Block()
        yield inline(source, inner, show, False, 1, tables)
        inner.end_line()
        return [x for x in written(inner.lines) if x]

    def rows_in(parent: Node) -> int:
        return 1 + sum(not isinstance(x, str) and x.tag in ("tr", "td", "th") for x in parent.children)

    def walk(parent: Node, show: bool) -> Rendering:
        in_row = parent.tag == "tr"
        for child in parent.children:
            if isinstance(child, str):
                if child.strip() and show:
                    caption.append(_SPACE.sub(" ", child.strip()))
                continue
            laid_out, seen = visible(child, show)
            if not laid_out:
                continue
            if child.tag in ("td", "th"):
                if not in_row:
                    in_row = True
                    grid.new_row()
                across = max(1, span(child.attrs.get("colspan", "1"), MAX_COLUMNS))
                deep = span(child.attrs.get("rowspan", "1"), MAX_ROWS)
                grid.cell((yield cell(child, seen)), across, MAX_ROWS if deep < 0 else deep)
            elif child.tag == "tr":
                in_row = False
                grid.new_row()
                yield walk(child, seen)
            elif child.tag in ("tbody", "thead", "tfoot"):
                in_row = False
                grid.begin_group(rows_in(child))
                yield walk(child, seen)
                grid.begin_group(rows_in(node))
            elif child.tag not in ("col", "colgroup"):
                caption.extend((yield cell(child, seen)))

    grid.begin_group(rows_in(node))
    yield walk(node, shown)
    return caption + grid.lines()


def render(html: str) -> str:
    """The visible text of a page."""
    if "&#" in html:  # the standard library reads a number of any length
        html = _FAR.sub("\uFFFD", _ZEROS.sub("&#", html))
    builder = TreeBuilder()
    last = html.rfind(">") + 1
    builder.feed(html[:last])
    builder.close()
    if last < len(html):  # no tag is complete here
        builder.handle_data(unescape(html[last:]))
    out = Block()
    completed(inline(builder.root, out, True, False, 0, 0))
    out.end_line()
    lines = written(out.lines)
    first, last = 0, len(lines)
    while first < last and not lines[first].strip():
        first += 1
    while last > first and not lines[last - 1].strip():
        last -= 1
    return "\n".join(lines[first:last])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [render(html) if html else "" for html in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    rows = small_batches(pages).select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return spread(rows).mapInArrow(run, "page_id long, text string")
