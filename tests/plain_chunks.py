"""Chunking as plain loops over one text, for comparison with the column expressions of the library."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

# Where a text may be cut, strongest first.  No ASCII full stop: it also ends numbers.
CUTS = ("。！？!?；;", "，,：:）)】]”\"", "\n\r", " \t")
#: A soft cut is sought in the last 30 percent of the allowed stretch.
LOOK_BACK = 0.7
SIZE, MOST, OVERLAP, CHILD, LEAST_CHILD = 800, 1400, 120, 200, 64
BATCH, SHORT_TAIL = 4000, 500
#: Units and windows for breaks; characters that an answer's part may be away from where the last one ended.
UNIT, WINDOW, SLACK = 180, 8, 50
CUT_MARK = "<<<<CUT>>>>"
_THOUGHTS, _FENCED = re.compile(r"<think>.*?</think>", re.S | re.I), re.compile(r"```(?:\w+)?\s*(.*?)\s*```", re.S)
_BLANK_LINES = re.compile(r"(?:\r?\n[ \t]*){2,}")
_EDGE = " \t\n\r"
_FENCE, _TABLE, _HEADING = re.compile(r"```"), re.compile(r"\s*\|.*\|\s*$"), re.compile(r"(#{1,6})\s+")

Span = tuple[int, int]


@dataclass(frozen=True)
class Block:
    start: int
    end: int
    kind: str
    level: int = 0


def trimmed(text: str, start: int, end: int) -> Span | None:
    """The span without blanks and line ends at its edges; None if nothing is left."""
    inner = text[start:end]
    left = len(inner) - len(inner.lstrip(_EDGE))
    right = len(inner.rstrip(_EDGE))
    return (start + left, start + right) if right > left else None


def paragraphs(text: str) -> list[Span]:
    """Spans between blank lines."""
    edges = [0, *(x for m in _BLANK_LINES.finditer(text) for x in m.span()), len(text)]
    found = (trimmed(text, a, b) for a, b in zip(edges[::2], edges[1::2]))
    return [s for s in found if s]


def soft_cut(text: str, start: int, end: int) -> int:
    """Behind the last mark of the strongest kind near the end of the stretch; its end if there is none."""
    lowest = min(start + int((end - start) * LOOK_BACK), end)
    window = text[max(lowest - 1, 0) : end]
    for marks in CUTS:
        last = max(window.rfind(m) for m in marks)
        if last >= 0:
            return max(lowest - 1, 0) + last + 1
    return end


def pieces(text: str, span: Span, most: int) -> list[Span]:
    """A span in parts of at most ``most`` characters, cut softly."""
    start, end = span
    out = []
    while most > 0 and end - start > most:
        cut = soft_cut(text, start, start + most)
        cut = cut if cut > start else start + most
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def line_groups(text: str, span: Span, most: int) -> list[Span]:
    """A span in groups of whole lines of at most ``most`` characters; a longer line stands alone."""
    if most <= 0 or span[1] - span[0] <= most:
        return [span]
    ends = [span[0] + m.end() for m in re.finditer(r"\n", text[span[0] : span[1]])]
    out, begin, last = [], span[0], span[0]
    for end in [*(e for e in ends if e < span[1]), span[1]]:
        if last > begin and end - begin > most:
            out.append((begin, last))
            begin = last
        last = end
    return [*out, (begin, last)]


def structure(text: str) -> list[Block]:
    """Code fences, tables, headings and paragraphs in order; a fence without an end runs to the text's end."""
    if not text:
        return []
    lines = text.split("\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    kinds, fenced = [], False
    for line in lines:
        fence = bool(_FENCE.match(line))
        heading = _HEADING.match(line)
        if fenced or fence:
            kinds.append("close" if fenced and fence else "code" if fenced else "open")
            fenced = not fenced if fence else fenced
        elif _TABLE.match(line):
            kinds.append("table")
        elif heading:
            kinds.append(f"heading{len(heading[1])}")
        else:
            kinds.append("paragraph" if line.strip() else "blank")
    out: list[Block] = []
    k = 0
    while k < len(lines):
        stop, kind = k + 1, kinds[k]
        if kind == "open":
            while stop < len(lines) and kinds[stop - 1] != "close":
                stop += 1
        elif kind in ("table", "paragraph"):
            while stop < len(lines) and kinds[stop] == kind:
                stop += 1
        span: Span | None = (at[k], min(at[stop] - 1, len(text)))
        if kind in ("paragraph", "blank"):
            span = trimmed(text, *span)
        if span:
            name = {"open": "code"}.get(kind, kind.rstrip("123456"))
            out.append(Block(*span, name, int(kind[-1]) if kind.startswith("heading") else 0))
        k = stop
    return out


def overlapped(text: str, span: Span, overlap: int, most: int) -> tuple[int, int]:
    """Characters to add left and right: up to ``overlap``, the right ones given up first over ``most``.

    If sentences begin and end within both additions, these end at sentence borders.
    """
    start, end = span
    left, right = min(overlap, start), min(overlap, len(text) - end)
    room_left, room_right = left, right
    over = max(0, left + right + end - start - most) if most > 0 else 0
    cut = min(over, right)
    right, over = right - cut, over - cut
    left -= min(over, left)
    a, b = start - left, end + right
    stops = CUTS[0] + CUTS[2]
    first = next((i + 1 for i in range(a, min(len(text), a + room_left + 1)) if text[i] in stops), a)
    last = next((i + 1 for i in range(b - 1, max(0, b - room_right - 1) - 1, -1) if text[i] in stops), b)
    if first < start and last > end:
        a, b = first, last
    return start - a, b - end


def batches(text: str, most: int = BATCH, short: int = SHORT_TAIL) -> list[Span]:
    """Whole paragraphs packed up to ``most`` characters; long ones are cut; a short last batch joins the one before."""
    units = [p for s in paragraphs(text) for p in pieces(text, s, most)]
    out: list[Span] = []
    for start, end in units:
        if out and end - out[-1][0] <= most:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    if len(out) > 1 and out[-1][1] - out[-1][0] < short:
        tail = out.pop()
        out[-1] = (out[-1][0], tail[1])
    return out


def flat_spans(text: str, most: int = MOST) -> list[Span]:
    """Paragraphs, cut where they are too long."""
    return [p for s in paragraphs(text) for p in pieces(text, s, most)]


def parents(text: str, most: int = MOST) -> list[tuple[int, int, str]]:
    """Spans of parents: a heading opens one, code and tables stand alone, paragraphs gather up to ``most``."""
    out: list[tuple[int, int, str]] = []
    current: Span | None = None

    def close() -> None:
        nonlocal current
        if current:
            out.extend((*p, "text") for p in pieces(text, current, most))
        current = None

    for block in structure(text):
        if block.kind in ("code", "table"):
            close()
            out += [(*g, block.kind) for g in line_groups(text, (block.start, block.end), most)]
        elif block.kind == "heading":
            close()
            current = (block.start, block.end)
        elif current and block.end - current[0] <= most:
            current = (current[0], block.end)
        else:
            close()
            current = (block.start, block.end)
    close()
    return out


def children(text: str, parent: tuple[int, int, str], size: int = CHILD) -> list[Span]:
    """A structured parent whole, any other in parts."""
    start, end, kind = parent
    return [(start, end)] if kind != "text" else pieces(text, (start, end), max(LEAST_CHILD, size))


def from_marks(text: str, answer: str) -> tuple[list[Span], str]:
    """Spans between a model's marks, and how they were found: ``strict`` if the answer without marks is the text,
    ``aligned`` if its parts follow each other in the text with little between, else none."""
    plain = _THOUGHTS.sub("", answer or "").strip()
    fence = _FENCED.search(plain) or _FENCED.search(answer or "")
    tried = [answer, (answer or "").strip(), plain, *((fence[1], fence[1].strip()) if fence else ())]
    for candidate in dict.fromkeys(x for x in tried if x):
        parts = candidate.split(CUT_MARK)
        if "".join(parts) == text:
            ends = list(accumulate(map(len, parts)))
            mode = "strict"
        else:
            ends, mode = [], "aligned"
            at = 0
            for part in parts if len(parts) > 1 else ():
                found = text.find(part, at)
                if found < 0 or found - at > SLACK:
                    break
                at = found + len(part)
                ends.append(at)
            if len(ends) != len(parts) or text[at:].strip():
                continue
            ends[-1] = len(text)
        edges = sorted({0, *ends, len(text)})
        if spans := list(zip(edges, edges[1:])):
            return spans, mode
    return [], ""


def nearest_break(sizes: list[int], target: int) -> int:
    """How many of the units, but not all of them, come nearest to the target length together; of equals the first."""
    sums = list(accumulate(sizes[:-1]))
    return min(range(len(sums)), key=lambda k: abs(sums[k] - target)) + 1 if sums else 1


def windows(text: str, target: int = SIZE, choose=nearest_break) -> list[Span]:
    """Units of up to UNIT characters, joined up to a break that ``choose`` finds in each window of WINDOW of them."""
    units = [p for s in paragraphs(text) for p in pieces(text, s, UNIT)]
    out, k = [], 0
    while k < len(units):
        window = units[k : k + WINDOW]
        n = choose([b - a for a, b in window], target) if len(window) > 1 else 1
        out.append((window[0][0], window[n - 1][1]))
        k += n
    return out
