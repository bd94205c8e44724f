"""A plain renderer for comparison: recursive, with tables as full grids and open elements searched one by one."""

import re
from html import unescape
from html.parser import HTMLParser

# Fixed values, written down from the HTML standard's sections on void elements, optional tags and rendering.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = set(
    "area audio canvas datalist head iframe math noframes noscript object param rp script style svg template title video".split()
)
HEADINGS = {f"h{k}" for k in range(1, 7)}
CLOSES_PARAGRAPH = HEADINGS | set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)
BLOCKS = CLOSES_PARAGRAPH | set("body caption dd dt html legend li optgroup option tr".split())
SPACED = HEADINGS | set("blockquote dir dl fieldset figure hr menu ol p pre table ul".split())
CELLS, GROUPS = {"td", "th"}, {"tbody", "thead", "tfoot"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": (CELLS | {"tr"}, {"table"}),
    **{t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")},
    **{t: (CELLS, {"tr", "table"}) for t in CELLS},
    **{t: (GROUPS | CELLS | {"tr", "caption"}, {"table"}) for t in GROUPS},
}


class Node:
    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []


def visible(node, inherited):
    """(laid out, own text shows) by the hidden attribute and the declarations of the style attribute, the last one first."""
    kind = node.attrs.get("type", "").lower()
    if node.tag in NEVER_SHOWN or "hidden" in node.attrs or (node.tag, kind) == ("input", "hidden"):
        return False, False
    declared = [d.split(":", 1) for d in node.attrs.get("style", "").lower().split(";") if ":" in d]
    if any(k.strip() == "display" and v.strip() == "none" for k, v in declared):
        return False, False
    shown = [v.strip() for k, v in declared if k.strip() == "visibility"]
    return True, shown[-1] not in ("hidden", "collapse") if shown else inherited

_SPACE = re.compile(r"[ \t\n\r\f]+")


class TreeBuilder(HTMLParser):
    """Builds a tree of nodes and strings, with the tags that the markup leaves out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def close_until(self, tags: set[str], stops: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in CLOSES_PARAGRAPH:
            self.close_until({"p"}, {"table", "td", "th", "li", "dd", "button", "caption"})
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
        if tag in SIBLINGS:
            closed, stops = SIBLINGS[tag]
            for _ in range(3):
                before = len(self.open)
                self.close_until(closed, stops)
                if len(self.open) == before:
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end of a tag means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag == "p" and all(node.tag != "p" for node in self.open):
            self.open[-1].children.append(Node("p", {}))
            return
        stops = {"table"} if tag not in ("table", "body") else set()
        if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table", "body", "html"):
            stops = {"td", "th", "caption", "table"}
        self.close_until({tag}, stops)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)


class Block:
    """Lines of a block, and the blank lines that are due before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.space = False  # a collapsed space is due
        self.gap = 0
        self.lead = 0  # the same before the first line, for the block around this one

    def text(self, data: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(data.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end_line(force=True)
                self.line += part
            return
        for k, word in enumerate(_SPACE.split(data)):
            if k:
                self.space = True
            if word:
                self.line += (" " if self.space and self.line else "") + word
                self.space = False

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            self.flush_gap()
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

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

    def add(self, lines: list[str], spaced: bool, lead: int = 0, tail: int = 0) -> None:
        gap = 2 if spaced else 1
        self.break_block(max(gap, lead))
        if lines:
            self.flush_gap()
            self.lines += lines
            self.gap = max(gap, tail)


def inline(node: Node, out: Block, shown: bool, keep: bool, depth: int) -> None:
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
            out.add(list_lines(child, show, depth + 1), depth == 0)
        elif tag == "table":
            out.add(table_lines(child, show), True)
        elif tag in BLOCKS:
            inner = Block()
            inline(child, inner, show, keep or tag == "pre", depth)
            inner.end_line()
            lines = inner.lines
            if tag in ("blockquote", "dd"):
                lines = ["  " + x if x else x for x in lines]
            out.add(lines, tag in SPACED, inner.lead, inner.gap)
        else:
            inline(child, out, show, keep or tag in ("textarea", "listing"), depth)


def list_lines(node: Node, shown: bool, depth: int) -> list[str]:
    """Items with markers; what follows an item's first line is indented to it."""
    lines: list[str] = []
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
        inline(holder, inner, show, False, depth)
        inner.end_line()
        mark = ""
        if child.tag == "li":
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
        if inner.lines:
            lines += [mark + inner.lines[0], *(" " * len(mark) + x if x else x for x in inner.lines[1:])]
    return lines


def number(text: str) -> int | None:
    text = text.lstrip(" \t\n\f\r").removeprefix("+")
    digits = ""
    for c in text:
        if c not in "0123456789":
            break
        digits += c
    return int(digits[-6:]) if digits and len(digits.lstrip("0")) <= 6 else 10**6 if digits else None


def table_lines(node: Node, shown: bool) -> list[str]:
    caption: list[str] = []

    def cell(source: Node, show: bool) -> list[str]:
        inner = Block()
        inline(source, inner, show, False, 1)
        inner.end_line()
        return [x for x in inner.lines if x]

    def cells(parent: Node, show: bool, group: list[int]) -> None:
        row = None
        if parent.tag == "tr":
            grid_rows.append((group[0], row := []))
        for child in parent.children:
            if isinstance(child, str):
                if child.strip() and show:
                    caption.append(_SPACE.sub(" ", child.strip()))
                continue
            laid_out, seen = visible(child, show)
            if not laid_out:
                continue
            if child.tag in ("td", "th"):
                if row is None:
                    grid_rows.append((group[0], row := []))
                across, deep = (number(child.attrs.get(k, "1")) for k in ("colspan", "rowspan"))
                across = 1 if across is None else min(max(across, 1), 1000)
                deep = 1 if deep is None else min(deep, 65534) or 65534
                row.append((cell(child, seen), across, deep))
            elif child.tag == "tr":
                row = None
                cells(child, seen, group)
            elif child.tag in ("tbody", "thead", "tfoot"):
                row = None
                group[0] = next_group()
                cells(child, seen, group)
                group[0] = next_group()
            elif child.tag not in ("col", "colgroup"):
                caption.extend(cell(child, seen))

    numbers = iter(range(10**9))
    next_group = lambda: next(numbers)
    grid_rows: list[tuple[int, list]] = []
    cells(node, shown, [next_group()])
    place: dict[tuple[int, int], list[str]] = {}
    for r, (group, row) in enumerate(grid_rows):
        c = 0
        for lines, across, deep in row:
            while (r, c) in place:
                c += 1
            for down in range(min(deep, len(grid_rows) - r)):
                if grid_rows[r + down][0] == group:
                    for k in range(across):
                        place[r + down, c + k] = lines if not down and not k else place.get((r + down, c + k), [])
            c += across
    widths: dict[int, int] = {}
    for (r, c), lines in place.items():
        widths[c] = max([widths.get(c, 0), *map(len, lines)])
    out = list(caption)
    for r in range(len(grid_rows)):
        row = [place.get((r, c), []) for c in sorted(widths) if widths[c]]
        wide = [widths[c] for c in sorted(widths) if widths[c]]
        for n in range(max(map(len, row), default=0)):
            out.append("  ".join((x[n] if n < len(x) else "").ljust(w) for x, w in zip(row, wide)).rstrip())
    return out


def render(html: str) -> str:
    """The visible text of a page."""
    builder = TreeBuilder()
    last = html.rfind(">") + 1
    builder.feed(html[:last])
    builder.close()
    if html[last:]:
        builder.handle_data(unescape(html[last:]))
    out = Block()
    inline(builder.root, out, True, False, 0)
    out.end_line()
    lines = out.lines
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    return "\n".join(lines)
