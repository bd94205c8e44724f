"""One deterministic automaton for many byte patterns.

Patterns are regular expressions of bytes: characters, ``\\xHH`` and escaped marks, classes, groups,
``|``, ``?``, ``*``, ``+`` and counts.  Each is compiled to moves between places; by subset construction
over all of them at once, with byte values that no pattern tells apart taken together, the sets of
places become states; states that nothing tells apart are joined.  What remains is an array of
transitions, read once for each byte for all patterns.

Of every pattern the matches are the leftmost ones, each as long as it can be, that don't overlap.
For that a state holds a pattern's open attempts in the order of their beginnings.  The first to be
complete ends the others, and is over with the first byte that it can't take; the state behind that
byte tells which patterns' matches were over before it.  Patterns for which this needs to look further
back (a complete match that may grow again after a gap, an attempt that is complete before an earlier
one is decided) are refused.  Where a match began is read backwards from its end, by the automaton of
the reversed pattern, no further than to the match before.
"""

from __future__ import annotations

import numpy as np

#: Parsed patterns: a set of byte values as a bit mask, parts in a row, choices, or a repeated part.
SET, ROW, CHOICE, REPEAT = range(4)
#: Symbols that a lane has about, and lanes under which they are scanned one by one.
LANE, FEW = 512, 192


class Parser:
    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def parse(self) -> tuple:
        found = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text}")
        return found

    def take(self, mark: str) -> bool:
        if self.text.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False

    def choice(self) -> tuple:
        found = [self.row()]
        while self.take("|"):
            found.append(self.row())
        return (CHOICE, found) if len(found) > 1 else found[0]

    def row(self) -> tuple:
        found = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            found.append(self.repeated())
        return ROW, found

    def repeated(self) -> tuple:
        part = self.atom()
        for mark, least, most in (("?", 0, 1), ("*", 0, None), ("+", 1, None)):
            if self.take(mark):
                return REPEAT, part, least, most
        if self.take("{"):
            counts = self.text[self.at : self.text.index("}", self.at)]
            self.at += len(counts) + 1
            least, comma, most = counts.partition(",")
            return REPEAT, part, int(least), int(most) if most else None if comma else int(least)
        return part

    def value(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        if self.take("x"):
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 1
        if self.text[self.at - 1].isalnum():
            raise ValueError(f"\\{self.text[self.at - 1]} isn't known in {self.text}")
        return ord(self.text[self.at - 1])

    def atom(self) -> tuple:
        if self.take("("):
            self.take("?:")
            found = self.choice()
            if not self.take(")"):
                raise ValueError(f"a group isn't closed in {self.text}")
            return found
        if not self.take("["):
            return SET, 1 << self.value()
        if self.take("^"):
            raise ValueError(f"negated classes aren't known in {self.text}")
        bits = 0
        while not self.take("]"):
            low = high = self.value()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self.value()
            bits |= sum(1 << b for b in range(low, high + 1))
        return SET, bits


class Places:
    """The places of a pattern and the moves between them; ``reverse`` for the pattern read backwards."""

    def __init__(self, parsed: tuple, reverse: bool = False) -> None:
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.reverse = reverse
        first, self.end = self.build(parsed)
        self.start = self.closed([first])

    def place(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, part: tuple) -> tuple[int, int]:
        first, last = self.place(), self.place()
        kind, inner, *counts = part
        if kind == SET:
            self.moves[first].append((inner, last))
        elif kind == CHOICE:
            for x in inner:
                a, b = self.build(x)
                self.free[first].append(a)
                self.free[b].append(last)
        else:
            least, most = counts or (None, None)
            parts = inner if kind == ROW else [inner] * (least if most is None else most)
            at = first
            for k, x in enumerate(reversed(parts) if self.reverse else parts):
                a, b = self.build(x)
                self.free[at].append(a)
                if kind == REPEAT and k >= least:
                    self.free[at].append(last)
                at = b
            if kind == REPEAT and most is None:
                a, b = self.build(inner)
                self.free[at].append(a)
                self.free[b] += [a, last]
            if kind == ROW or most is not None or not least or at != first:
                self.free[at].append(last)
        return first, last

    def closed(self, places) -> frozenset[int]:
        """The places, and those reached from them without a byte, that take bytes or end the pattern."""
        seen, waiting = set(places), list(places)
        while waiting:
            for x in self.free[waiting.pop()]:
                if x not in seen:
                    seen.add(x)
                    waiting.append(x)
        return frozenset(x for x in seen if self.moves[x] or x == self.end)

    def after(self, places: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed([y for x in places for bits, y in self.moves[x] if bits >> byte & 1])


def _byte_classes(masks: set[int]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte value, and one value of each class."""
    kinds: dict[tuple, int] = {}
    ordered, one = sorted(masks), []
    classes = np.zeros(256, np.uint8)
    for b in range(256):
        kind = tuple(m >> b & 1 for m in ordered)
        if kind not in kinds:
            kinds[kind] = len(kinds)
            one.append(b)
        classes[b] = kinds[kind]
    return classes, one


def minimised(table: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States as few as possible: their transitions, and what each tells; state 0 stays the first of its kind."""
    _, label = np.unique(told, return_inverse=True)
    while True:
        kinds, first, new = np.unique(np.column_stack([label, label[table]]), axis=0, return_index=True, return_inverse=True)
        new = new.reshape(-1)
        if len(kinds) == label.max() + 1:
            return new[table[first]], told[first], int(new[0])
        label = new


class Automaton:
    """All patterns in one; see the module."""

    def __init__(self, patterns: list[str]) -> None:
        parsed = [Parser(p).parse() for p in patterns]
        rules = [Places(p) for p in parsed]
        masks = {bits for r in rules for moves in r.moves for bits, _ in moves}
        self.classes, one = _byte_classes(masks)
        self.end = len(one)  # the symbol behind a text
        self.backwards = [self._backward(Places(p, reverse=True), one) for p in parsed]
        steps = [{} for _ in rules]

        def step(k: int, open_: tuple, symbol: int) -> tuple[tuple, bool]:
            if (open_, symbol) not in steps[k]:
                steps[k][open_, symbol] = self._step(rules[k], patterns[k], open_, one[symbol] if symbol < self.end else None)
            return steps[k][open_, symbol]

        begin = ((),) * len(rules), 0
        known, rows = {begin: 0}, []
        waiting = [begin]
        for state in waiting:  # it grows meanwhile
            row = []
            for symbol in range(self.end + 1):
                found = [step(k, x, symbol) for k, x in enumerate(state[0])]
                to = tuple(x for x, _ in found), sum(over << k for k, (_, over) in enumerate(found))
                if to not in known:
                    known[to] = len(known)
                    waiting.append(to)
                row.append(known[to])
            rows.append(row)
        table, told, start = minimised(np.array(rows), np.array([over for _, over in waiting]))
        # The start comes first, states that tell of matches last.
        order = np.lexsort((np.arange(len(told)) != start, told > 0))
        place = np.argsort(order)
        table, self.told = place[table[order]], told[order]
        self.states, self.width = table.shape
        self.loud = int((self.told == 0).sum()) * self.width
        #: Symbols behind which every state goes on as from the start.
        self.resets = (table[table] == table[0]).all(axis=(0, 2))
        self.table = (table * self.width).astype(np.int32).ravel()

    @staticmethod
    def _step(rule: Places, pattern: str, open_: tuple, byte: int | None) -> tuple[tuple, bool]:
        over = False
        if open_ and rule.end in open_[0]:
            grown = rule.after(open_[0], byte) if byte is not None else frozenset()
            if grown:
                if rule.end not in grown:
                    raise ValueError(f"a match of {pattern} may be complete, and then again after a gap")
                return (grown,), False
            over, open_ = True, ()
        if byte is None:
            return (), over
        found, seen = [], set()
        for places in (*open_, rule.start):
            if new := rule.after(places, byte) - seen:
                found.append(frozenset(new))
                seen |= new
        if any(rule.end in x for x in found[1:]) and rule.end not in found[0]:
            raise ValueError(f"a match of {pattern} may be complete before an earlier attempt is decided")
        return tuple(found[:1] if found and rule.end in found[0] else found), over

    @staticmethod
    def _backward(places: Places, one: list[int]) -> tuple[list[list[int]], list[bool]]:
        """Transitions by symbol, and whether a state has read a whole match; state 0 is dead, 1 the start."""
        known = {frozenset(): 0, places.start: 1}
        waiting, rows = [frozenset(), places.start], []
        for state in waiting:
            row = []
            for byte in one:
                to = places.after(state, byte)
                if to not in known:
                    known[to] = len(known)
                    waiting.append(to)
                row.append(known[to])
            rows.append(row)
        return rows, [places.end in x for x in waiting]

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The symbols of all texts, ``end`` behind each."""
        return np.insert(self.classes[raw], offsets[1:], np.uint8(self.end))

    def ends(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where matches were over, in order, and as a mask of which patterns.

        The symbols are cut into lanes behind resets, all of which take a step at a time.
        """
        n = len(symbols)
        cuts = np.flatnonzero(self.resets[symbols]) + 1
        begins = cuts[np.searchsorted(cuts, np.arange(LANE, n, LANE))]
        begins = np.unique(np.append(0, begins))
        begins = begins[begins < n]
        sizes = np.diff(np.append(begins, n))
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        state = np.zeros(len(begins), np.int32)
        active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)) + 1), "left")  # lanes of more symbols
        places, states = [], []
        j = 0
        while j < len(active) and active[j] >= FEW:
            m = active[j]
            now = self.table[state[:m] + symbols[begins[:m] + j]]
            state[:m] = now
            if now.max() >= self.loud:
                hit = np.flatnonzero(now >= self.loud)
                places.append(begins[hit] + j)
                states.append(now[hit])
            j += 1
        if j < len(active) and active[j]:
            table, loud = self.table.tolist(), self.loud
            for begin, size, s in zip(begins[: active[j]].tolist(), sizes.tolist(), state.tolist()):
                for at, x in enumerate(symbols[begin + j : begin + size].tolist(), begin + j):
                    s = table[s + x]
                    if s >= loud:
                        places.append(np.array([at]))
                        states.append(np.array([s]))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, masks = np.concatenate(places), self.told[np.concatenate(states) // self.width]
        order = np.argsort(at, kind="stable")
        return at[order], masks[order]

    def begin(self, rule: int, symbols: np.ndarray, least: int, end: int) -> int:
        """Where the match of a pattern that ends at ``end`` begins: as far back as it can, down to ``least``."""
        rows, whole = self.backwards[rule]
        state, found, block = 1, end, 64
        at = end
        while at > least and state:
            low = max(least, at - block)
            for x in symbols[low:at][::-1].tolist():
                state = rows[state][x]
                if not state:
                    break
                at -= 1
                if whole[state]:
                    found = at
            block *= 2
        return found
