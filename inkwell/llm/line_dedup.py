"""Line dedup (operator 10): segment-partition edit join.

All lines that aren't blank are compared over the whole corpus.  Two lines are linked if their edit
distance is at most what the shorter one allows: an edit for every ``EDIT_CHARS`` characters, ``TAU`` at
most (so none below ``EDIT_CHARS``, where two edits would turn one word into another).  Linked lines
form classes; of each class the first line (by doc_id, then position) stays and the others are cut out
of their texts.  Blank lines part paragraphs and are neither compared nor cut.

The join cuts a line that allows t edits into t + 1 segments.  A longer line within t edits of it has
at least one of them unchanged, near the same place, so lines are looked up by (length, segment number,
segment): each line indexes its own segments and, for every length from its own down to TAU less,
probes the substrings at the places that the edits before and behind a segment allow.  A line that
allows none has one segment, itself: its links are its equals, which bear its name.  A task reads
the keys off prefix sums of a polynomial hash, once for each line that it meets, and deals them out
packed in arrays by parts of the key space.  One part is joined at a time: its indexed keys come
first and are held, one line for each; lines that probe them stream by, so that no segment's lines
are gathered, however many share it.  Lines that share a key are candidates.  Those that lengths and
parity maps of trigrams don't rule out are verified with banded bit-parallel edit distance, for many
pairs at once, and grouped (see ``grouping``).  Of two very long lines equal stretches are skipped
whole, and only the edits are tried.

Lines are named by 64-bit hashes in the join; exact repeats are told by 128 bits.

Defined results: a null text stays null and an empty one empty; rows with a null id are neither
compared nor changed; rows that repeat an id are one document, whose equal lines at one position
are one line; a table of blank lines comes back unchanged; an empty table gives an empty result;
all columns of the table are kept as they are, whatever their names, but for the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import mix64, number, numbered, slices, small_batches
from inkwell.llm.grouping import link_groups
from inkwell.session import checkpointed

TAU, EDIT_CHARS = 2, 12
#: Characters of the grams, and bits, of a line's parity map: bit k says whether an odd number of grams falls on k.
GRAM, PARITY_BITS = 3, 512
#: Keys that one part of the key space holds about, and the parts at least.
PART_KEYS, LEAST_PARTS = 400_000, 32
#: Characters of both sides that are verified at once.
VERIFY_CHARS = 1 << 20
#: Characters from which on two lines are compared by equal stretches.
LONG_LINE = 1 << 14
#: Keys of one part that are looked up at once.
LOOKUP_KEYS = 1 << 18
#: Names of lines that a task remembers to tell which lines it has met; beyond, it forgets them and starts anew.
SEEN_NAMES = 200_000
#: Text whose lines are hashed at once; the arrays take some fifty times its bytes.
LINE_BYTES = 1 << 20
#: Candidates' names are broadcast to find their lines up to this many, else joined.
BROADCAST_NAMES = 200_000
_BASE = 0xD6E8FEB86659FD93 | 1
#: Whether a character is white space; the last place stands for all beyond.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers


def allowed(size: np.ndarray) -> np.ndarray:
    """The edits that lines of these lengths allow."""
    return np.minimum(TAU, size // EDIT_CHARS)


class Lines:
    """The lines of some texts that aren't blank: where each begins and ends among all characters, its text and its number there."""

    def __init__(self, texts: list[str]) -> None:
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.chars)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        breaks = np.flatnonzero(self.chars == 10)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        starts = starts[starts < n]
        owner = np.searchsorted(offsets, starts, "right") - 1
        after = np.append(breaks, n)[np.searchsorted(breaks, starts)]
        ends = np.minimum(after, offsets[owner + 1])
        first = np.searchsorted(owner, owner)  # the text's first line
        number = np.arange(len(starts)) - first
        ink = np.append(0, np.cumsum(~_SPACE[np.minimum(self.chars, len(_SPACE) - 1)], dtype=np.int64))
        taken = ink[ends] > ink[starts]
        self.starts, self.ends, self.owner, self.number = starts[taken], ends[taken], owner[taken], number[taken]
        self.up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(self.chars.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the characters from a to b."""
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every line: of the whole, and of the hashes of its segments."""
        size = self.ends - self.starts
        second = np.zeros(len(size), np.uint64)
        for at, length in segments(size):
            begin = self.starts + at
            second = mix64(second ^ self.hashes(begin, begin + length))
        return self.first_names(), second.view(np.int64)

    def first_names(self) -> np.ndarray:
        """The first hash of every line."""
        return self.hashes(self.starts, self.ends).view(np.int64)

    def keys(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the segments of some lines (lowest bit 1) and of the substrings they probe (0), and each key's line."""
        keys, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for less, edits in ((x, t) for t in range(1, TAU + 1) for x in range(t + 1)):
            some = line[allowed(self.ends[line] - self.starts[line] - less) == edits]
            starts = self.starts[some]
            size = self.ends[some] - starts
            for k, (at, length) in enumerate(segments(size - less, edits + 1)):
                lo = np.maximum(at - k, at + less - (edits - k))
                hi = np.minimum(at + k, at + less + (edits - k))
                for shift in range(-edits, edits + 1):
                    place = at + shift
                    ok = (place >= lo) & (place <= hi) & (place >= 0) & (place + length <= size)
                    begin = (starts + place)[ok]
                    key = mix64(self.hashes(begin, begin + length[ok]) + ((size[ok] - less) * (TAU + 1) + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    own = np.uint64(less == 0 and shift == 0)
                    keys.append(key & ~np.uint64(1) | own)
                    lines.append(some[ok])
        return np.concatenate(keys), np.concatenate(lines)


def segments(size: np.ndarray, many: int = TAU + 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Place and length of each of so many segments of lines of these lengths; the last ones are longer."""
    short, longer = size // many, size % many
    out, at = [], np.zeros_like(size)
    for k in range(many):
        length = short + (k >= many - longer)
        out.append((at, length))
        at = at + length
    return out


def near(a: str, b: str, edits: int) -> bool:
    """Whether two texts are within so many edits: what both begin with is skipped, then each edit is tried."""
    lo, hi = 0, min(len(a), len(b)) + 1
    step = 1 << 10
    while hi - lo > 1:  # they are equal up to lo
        at = min(lo + step, hi - 1)
        if a[lo:at] == b[lo:at]:
            lo, step = at, step * 2
        else:
            hi, step = at, max(1, (at - lo) // 2)
    a, b = a[lo:], b[lo:]
    if not a or not b or not edits:
        return len(a) + len(b) <= edits
    return near(a[1:], b[1:], edits - 1) or near(a[1:], b, edits - 1) or near(a, b[1:], edits - 1)


def linked(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of texts whether they are within the edits that the shorter one allows."""
    edits = allowed(np.array([min(len(a), len(b)) for a, b in zip(left, right)], np.int64))
    out = np.zeros(len(left), bool)
    short = np.array([max(len(a), len(b)) < LONG_LINE for a, b in zip(left, right)], bool)
    for k in np.flatnonzero(~short).tolist():
        out[k] = abs(len(left[k]) - len(right[k])) <= edits[k] and near(left[k], right[k], int(edits[k]))
    some = np.flatnonzero(short).tolist()
    out[some] = distances([left[k] for k in some], [right[k] for k in some]) <= edits[some]
    return out


def distances(left: list[str], right: list[str], tau: int = TAU) -> np.ndarray:
    """For each pair of texts their edit distance, if it is at most ``tau``, else more than that: banded and bit-parallel.

    Bit k of a pair's vectors stands for row j - tau + k of column j.  The distance is followed down
    the band's last diagonal to the last row of the left text, then along that row.
    """
    n = len(left)
    if not n:
        return np.zeros(0, np.int64)
    rows, columns = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    swap = rows > columns
    left, right = [b if s else a for a, b, s in zip(left, right, swap)], [a if s else b for a, b, s in zip(left, right, swap)]
    rows, columns = np.minimum(rows, columns), np.maximum(rows, columns)
    wide = 2 * tau + 1
    a = np.full((n, rows.max() + 2 * wide + columns.max()), 0xFFFFFFFF, np.uint32)
    b = np.full((n, columns.max()), 0xFFFFFFFE, np.uint32)
    for k in range(n):
        a[k, tau : tau + rows[k]] = np.frombuffer(left[k].encode("utf-32-le", "surrogatepass"), np.uint32)
        b[k, : columns[k]] = np.frombuffer(right[k].encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    one, full, last = np.uint64(1), np.uint64((1 << wide) - 1), np.uint64(wide - 1)
    plus = np.full(n, full & ~np.uint64((1 << tau) - 1), np.uint64)  # rows from 1 on grow by one in column 0
    minus = np.zeros(n, np.uint64)
    distance = np.where(columns - rows <= tau, np.minimum(tau, rows), tau + 1)
    for j in range(1, int(columns.max()) + 1):
        match = np.zeros(n, np.uint64)
        for k in range(wide):
            match |= (a[j - 1 + k] == b[j - 1]).astype(np.uint64) << np.uint64(k)
        same = (((match & plus) + plus) ^ plus | match | minus) & full
        right_plus = (minus | ~(same | plus)) & full
        right_minus = same & plus
        moves = j <= columns
        down = moves & (j + tau <= rows)
        distance += np.where(down, 1 - (same >> last & one).astype(np.int64), 0)
        bit = np.clip(rows - j + tau, 0, wide - 1).astype(np.uint64)
        along = moves & (j + tau > rows) & (rows - j + tau >= 0)
        distance += np.where(along, (right_plus >> bit & one).astype(np.int64) - (right_minus >> bit & one).astype(np.int64), 0)
        shifted = same >> one
        plus, minus = (right_minus | ~(shifted | right_plus)) & full, shifted & right_plus
    return distance


def _name_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        at = 0
        for part in slices(batch, 1, LINE_BYTES):
            lines = Lines(part.column(1).to_pylist())
            first, second = lines.names()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at + lines.owner]), pa.array(lines.number, pa.int32()), pa.array(first), pa.array(second)],
                names=["doc_id", "line", "name", "check"],
            )
            at += part.num_rows


class Fresh:
    """Tells which names a task has not met yet."""

    def __init__(self, most: int = SEEN_NAMES) -> None:
        self.most, self.known = most, np.zeros(0, np.int64)

    def __call__(self, names: np.ndarray) -> np.ndarray:
        """Places, in their order, where names are met for the first time."""
        distinct, first = np.unique(names, return_index=True)
        at = np.searchsorted(self.known, distinct)
        new = (at == len(self.known)) | (np.append(self.known, 0)[at] != distinct)
        if len(self.known) + new.sum() > self.most:
            self.known = distinct
        else:
            self.known = np.sort(np.concatenate([self.known, distinct[new]]), kind="stable")
        return np.sort(first[new])


def _deal_keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            for part in slices(batch, 1, LINE_BYTES):
                lines = Lines(part.column(1).to_pylist())
                names = lines.first_names()
                keys, line = lines.keys(fresh(names))
                probe, keys = 1 - (keys & np.uint64(1)).astype(np.int64), keys >> np.uint64(1)
                to = (keys >> np.uint64(32)).astype(np.int64) % parts * 2 + probe
                order = np.argsort(to, kind="stable")
                to, keys, line = to[order], keys[order].view(np.int64), names[line[order]]
                used, first = np.unique(to, return_index=True)
                offsets = pa.array(np.append(first, len(to)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used // 2, pa.int64()),
                        pa.array(used % 2, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys)),
                        pa.ListArray.from_arrays(offsets, pa.array(line)),
                    ],
                    names=["part", "probe", "keys", "lines"],
                )

    return run


class _Index:
    """The indexed keys of one part: each with its first line, and whether other lines were met."""

    def __init__(self) -> None:
        self.keys, self.first, self.shared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, keys: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
        """Indexes keys of lines; the rows (group, id) that this finds."""
        keys, lines = np.concatenate([self.keys, keys]), np.concatenate([self.first, lines])
        shared = np.append(self.shared, np.zeros(len(keys) - len(self.keys), bool))
        order = np.argsort(keys, kind="stable")  # a key's line that is held stays the first
        keys, lines = keys[order], lines[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        at = np.cumsum(new) - 1
        self.keys, self.first, self.shared = keys[new], lines[new], shared[order][new]
        other = lines != self.first[at]
        return self._met(at[other], lines[other])

    def probe(self, keys: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
        """Looks up keys of lines; the rows (group, id) that this finds."""
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(at < len(self.keys))
        hit = hit[self.keys[at[hit]] == keys[hit]]
        hit = hit[self.first[at[hit]] != lines[hit]]
        return self._met(at[hit], lines[hit])

    def _met(self, at: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
        newly = np.unique(at[~self.shared[at]])
        self.shared[newly] = True
        at, lines = np.concatenate([newly, at]), np.concatenate([self.first[newly], lines])
        order = np.lexsort((lines, at))
        at, lines = at[order], lines[order]
        new = np.append(True, (at[1:] != at[:-1]) | (lines[1:] != lines[:-1]))[: len(at)]
        return pa.RecordBatch.from_arrays([pa.array(self.keys[at[new]]), pa.array(lines[new])], names=["group", "id"])


def _match_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, indexed keys first, into (group, id) of the keys that an indexed line shares with another.

    A row may come out more than once.
    """
    now, index, keys, lines, held = (None, None), _Index(), [], [], 0

    def found() -> pa.RecordBatch:
        look = index.probe if now[1] else index.add
        return look(np.concatenate(keys), np.concatenate(lines))

    for batch in batches:
        for k, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if held and (row != now or held >= LOOKUP_KEYS):
                yield found()
                keys, lines, held = [], [], 0
            if row[0] != now[0]:
                index = _Index()
            now = row
            keys.append(batch.column(2)[k].values.to_numpy(zero_copy_only=False))
            lines.append(batch.column(3)[k].values.to_numpy(zero_copy_only=False))
            held += len(keys[-1])
    if held:
        yield found()


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh = Fresh()
    for batch in batches:
        for part in slices(batch, 1, LINE_BYTES):
            texts = part.column(1).to_pylist()
            lines = Lines(texts)
            names = lines.first_names()
            first = fresh(names)
            names = names[first]
            base = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])[lines.owner[first]]
            cut = [texts[o][s:e] for o, s, e in zip(lines.owner[first].tolist(), (lines.starts[first] - base).tolist(), (lines.ends[first] - base).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cut, pa.string())], names=["name", "text"])


def parity(lines: Lines) -> np.ndarray:
    """The parity maps of the long lines, a row each."""
    many = np.maximum(0, lines.ends - lines.starts - GRAM + 1)
    owner = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + lines.starts[owner]
    falls = (lines.hashes(at, at + GRAM) >> np.uint64(20)).astype(np.int64) % PARITY_BITS
    odd = np.bincount(owner * PARITY_BITS + falls, minlength=len(many) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(many), PARITY_BITS // 64)


def may_be_linked(x: Column, y: Column) -> Column:
    """Whether traits (n, parity) of two lines leave it open that they are within the edits that the shorter one allows.

    An edit adds or takes one character at most, and GRAM grams on either side.
    """
    differ = sum(F.bit_count(F.get(x["parity"], k).bitwiseXOR(F.get(y["parity"], k))) for k in range(PARITY_BITS // 64))
    edits = F.least(F.lit(TAU), F.floor(F.least(x["n"], y["n"]) / EDIT_CHARS))
    return (F.abs(x["n"] - y["n"]) <= edits) & (differ <= 2 * GRAM * edits)


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, LINE_BYTES):
            lines = Lines(part.column(1).to_pylist())
            maps = parity(lines)
            offsets = pa.array((np.arange(len(maps) + 1) * maps.shape[1]).astype(np.int32))
            sizes = pa.array(lines.ends - lines.starts, pa.int64())
            columns = [part.column(0), sizes, pa.ListArray.from_arrays(offsets, pa.array(maps.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "parity"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = (c.to_pylist() for c in batch.columns)
        order = sorted(range(len(a)), key=lambda k: len(left[k]) + len(right[k]))
        kept, lo = [], 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * (len(left[order[hi]]) + len(right[order[hi]])) <= VERIFY_CHARS:
                hi += 1
            some = order[lo:hi]
            kept += [some[k] for k in np.flatnonzero(linked([left[k] for k in some], [right[k] for k in some]))]
            lo = hi
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], names=["a", "b"]
        )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, name, first_doc, first_line: every line that repeats an earlier one of its class."""
    rows = numbered(small_batches(docs)).select(
        F.col(number(docs, id_col)).cast("long").alias("doc_id"), F.col(number(docs, text_col)).cast("string").alias("text")
    )
    rows = rows.where("doc_id is not null and text is not null")
    lines = checkpointed(rows.mapInArrow(_name_lines, "doc_id long, line int, name long, check long"))
    total = lines.count()
    parts = max(LEAST_PARTS, total * 12 // PART_KEYS)
    dealt = rows.mapInArrow(_deal_keys(parts), "part long, probe long, keys array<long>, lines array<long>")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "probe")
    members = checkpointed(dealt.mapInArrow(_match_keys, "group long, id long"))
    names = members.select("id").distinct()
    names = checkpointed(names)
    sized = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    texts = rows.mapInArrow(_line_texts, "name long, text string").join(sized, F.col("name") == F.col("id"), "left_semi")
    texts = checkpointed(texts.groupBy("name").agg(F.min("text").alias("text")))

    def test(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("name").alias("name_a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("name").alias("name_b"), F.col("text").alias("text_b"))
        both = pairs.join(left, F.col("a") == F.col("name_a")).join(right, F.col("b") == F.col("name_b"))
        both = both.where(F.abs(F.length("text_a") - F.length("text_b")) <= TAU)
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")

    traits = texts.select("name", "text").mapInArrow(_traits, "id long, n long, parity array<long>")
    traits = checkpointed(traits.select("id", F.struct("n", "parity").alias("traits")))
    found = link_groups(members, traits, test, may_be_linked)
    named = lines.join(found, F.col("name") == F.col("node"), "left")
    # A line alone in its class is told apart from another of the same name by its check.
    named = named.select(
        "doc_id", "line", "name",
        F.coalesce("component", "name").alias("class"), F.when(F.col("component").isNull(), F.col("check")).alias("check"),
    )
    named = checkpointed(named)
    first = named.groupBy("class", "check").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("many"))
    first = checkpointed(first.where("many > 1").select(F.col("class").alias("c"), F.col("check").alias("k"), "first"))
    same = (F.col("class") == F.col("c")) & F.col("check").eqNullSafe(F.col("k"))
    return (
        named.join(first, same)
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
        .select("doc_id", "line", "name", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))
    )


COUNTS = "n_lines int, n_compared int, n_removed int, n_short int"


def _cut(text_at: int, counts: bool):
    """Rows whose last two columns list the lines to cut from the text at ``text_at``, and these lines' names.

    With ``counts``, every row comes out, with COUNTS behind its other columns; else those of which something is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at, LINE_BYTES):
                texts, drops, known = (part.column(k).to_pylist() for k in (text_at, part.num_columns - 2, part.num_columns - 1))
                gone = _found(texts, drops, known)
                numbers = [[0, 0, 0, 0] for _ in texts]
                for k, text in enumerate(texts):
                    if text and (counts or k in gone):
                        lines, drop = text.split("\n"), gone.get(k, ())
                        if counts:
                            removed = [lines[n] for n in drop]
                            short = sum(len(x) < TAU * EDIT_CHARS for x in removed)
                            numbers[k] = [len(lines), sum(not x.isspace() for x in lines if x), len(removed), short]
                        texts[k] = "\n".join(x for n, x in enumerate(lines) if n not in drop)
                columns = part.columns[:-2]
                columns[text_at] = pa.array(texts, pa.string())
                if counts:
                    columns += [pa.array(x, pa.int32()) for x in zip(*numbers)]
                    yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])
                else:
                    left = pa.array([k not in gone or bool(t and not t.isspace()) for k, t in enumerate(texts)], pa.bool_())
                    yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))]).filter(left)

    return run


def _found(texts: list[str | None], drops: list, known: list) -> dict[int, set[int]]:
    """For each text with lines to cut, those that bear the names given; another text under the same id may lack them."""
    asked = [k for k, drop in enumerate(drops) if drop and texts[k]]
    if not asked:
        return {}
    lines = Lines([texts[k] for k in asked])
    place = lines.owner << 32 | lines.number
    wanted = np.concatenate([np.array(drops[k], np.int64) | i << 32 for i, k in enumerate(asked)])
    names = np.concatenate([np.array(known[k], np.int64) for k in asked])
    if not len(place):
        return {}
    at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
    same = (place[at] == wanted) & (lines.names()[0][at] == names)
    gone: dict[int, set[int]] = {}
    for x in wanted[same].tolist():
        gone.setdefault(asked[x >> 32], set()).add(x & 0xFFFFFFFF)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents without their repeated lines, as (kept, counted).

    ``kept`` has the columns of docs; a document of which nothing but blank lines is left after a cut is
    left out.  ``counted`` has doc_id, n_lines, n_compared (lines that aren't blank), n_removed, n_short
    (of those removed the ones that are too short to allow all TAU edits) and text (what is left) for
    every document.
    """
    gone = repeated_lines(docs, id_col, text_col).groupBy("doc_id").agg(
        F.collect_list("line").alias("lines"), F.collect_list("name").alias("names")
    )
    gone = checkpointed(gone)
    rows, doc_id, text = numbered(docs), F.col(number(docs, id_col)).cast("long"), number(docs, text_col)
    joined = rows.join(gone, doc_id == gone["doc_id"], "left").withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([T.StructField(f.name, T.StringType() if f"c{k}" == text else f.dataType) for k, f in enumerate(docs.schema)])
    kept = joined.select(*rows.columns, "lines", "names").mapInArrow(_cut(rows.columns.index(text), False), schema)
    brief = joined.select(doc_id.alias("doc_id"), F.col(text).alias("text"), "lines", "names")
    counted = brief.mapInArrow(_cut(1, True), f"doc_id long, text string, {COUNTS}")
    return kept, counted.select("doc_id", "n_lines", "n_compared", "n_removed", "n_short", "text")
