"""SentencePiece encoding and decoding (operator 3): suffix-array matching.

A task concatenates the distinct pre-tokens of its batch, sorts the suffixes of that text (by as
many bytes as the longest piece has), and binary-searches every piece of the vocabulary for the
range of suffixes that begin with it.  The ranges are all occurrences of all pieces: edges from
start to end positions.  Sorted by end position the edges are relaxed: the last token of the
encoding up to a position is the one edge into it whose piece may stand behind the last token at
the edge's start.

Two pieces may stand together if merging their concatenation never joins across the border.  For
byte-pair merges that is known to be enough: a sequence is the encoding of its text exactly if each
neighbouring pair in it is.  ``PieceTable.stands`` decides it from the merge trees of the two pieces,
so the ids equal the library's.  Characters without a piece fall back to their bytes.

Defined results: a null or empty text has no ids and decodes to an empty text; a null id stays
null; repeated rows give repeated rows; an empty table gives an empty result; further columns are
not read.  A very long text is worked on in parts, and so is a long run without a space: windows of
it that overlap are encoded apart and joined at a token that both have, which gives the encoding of
the whole because each neighbouring pair stands together.  A run in which two windows have no token in
common (as in one of a single character) is relaxed from its beginning to its end instead, stretch by
stretch with what the one before came to, in time and memory in proportion to its length.  A space sign (U+2581) in a text decodes as a
space, as in the library.
"""

from __future__ import annotations

from array import array
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import mix64, slices, small_batches
from inkwell.llm.pretokens import SPACE, check_model, load, parts, pretokens

ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.StringType())])
#: Pre-tokens whose ids a worker keeps, and slots for verdicts on pairs of pieces.
CACHE_WORDS, PAIR_BITS = 200_000, 21
PAIR_SLOTS = 1 << PAIR_BITS
#: Text whose new words are indexed at once; the edges take some hundred times a new word's bytes.
INDEX_BYTES = 1 << 20
#: Bytes of a word that is encoded in windows, of a window, and of what it shares with the next one.
LONG_BYTES, WINDOW, OVERLAP = 1 << 13, 1 << 12, 1 << 9
#: Bytes of a long word whose edges are held at once where it is relaxed in order.
STRETCH = 1 << 16
_NEVER = 1 << 60
_workers: dict[str, tuple] = {}


class PieceTable:
    """The pieces of a model as bytes (the space sign as a space) with merge ranks and merge trees."""

    def __init__(self, model_path: str) -> None:
        sp = load(model_path)
        check_model(sp)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        texts = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in range(n) if not special[i]}
        by_score = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in texts}))}
        self.rank = {t: by_score[-sp.get_score(i)] for i, t in texts.items()}
        if missing := {c for t in self.rank for c in t} - self.rank.keys():
            raise ValueError(f"characters {sorted(missing)[:5]} are in pieces but aren't pieces")
        #: For each piece that merging makes from its own characters: its spine on either side, outermost last.
        self.left: dict[str, list[str]] = {}
        self.right: dict[str, list[str]] = {}
        trees: dict[str, tuple[str, str] | None] = {}
        for t in sorted(self.rank, key=len):
            if (tree := self._tree(t)) is not False:
                trees[t] = tree
        for t in trees:  # shorter ones come first
            tree = trees[t]
            self.left[t] = [*(self.left[tree[0]] if tree else ()), t]
            self.right[t] = [*(self.right[tree[1]] if tree else ()), t]
        self.usable = [(i, t) for i, t in texts.items() if t in trees]
        self.decoded = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)])
            if sp.is_byte(i)
            else b""
            if sp.is_control(i)
            else " ⁇ ".encode()
            if sp.is_unknown(i)
            else sp.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(n)
        ]

    def _tree(self, piece: str) -> tuple[str, str] | None | bool:
        """The last join that makes the piece from its characters; None for a character, False if none does."""
        parts, last = list(piece), None
        while len(parts) > 1:
            joins = [(self.rank.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(joins)
            if rank == _NEVER:
                return False
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def stands(self, a: str, b: str) -> bool:
        """Whether merging the text a + b ends in the two pieces a and b.

        The symbols beside the border grow along a's right and b's left spine, in the order of
        their ranks.  The border falls if a join across it ranks before both sides' next joins; at
        equal ranks the leftmost join goes first.
        """
        rank, xs, ys = self.rank, self.right[a], self.left[b]
        i = j = 0
        while True:
            across = rank.get(xs[i] + ys[j], _NEVER)
            grow_x = rank[xs[i + 1]] if i + 1 < len(xs) else _NEVER
            grow_y = rank[ys[j + 1]] if j + 1 < len(ys) else _NEVER
            if across < grow_x and across <= grow_y:
                return False
            if grow_x == grow_y == _NEVER:
                return True
            if grow_x <= grow_y:
                i += 1
            else:
                j += 1


class Encoder:
    """Encodes batches of pre-tokens; keeps the ids of words and the verdicts on pairs of pieces."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        usable = sorted(table.usable, key=lambda x: x[1].encode())
        self.ids = np.array([i for i, _ in usable])
        self.texts = [t for _, t in usable]
        raw = [t.encode() for t in self.texts]
        self.sizes = np.array([len(b) for b in raw])
        self.chars = np.array([len(t) for t in self.texts])
        self.width = -(-max(map(len, raw), default=1) // 8)
        self.low = self._keys(raw, b"\0")
        self.high = self._keys(raw, b"\xff")
        self.byte_ids = np.array([table.bytes_at.get(b, table.unknown) for b in range(256)])
        self.words: dict[str, bytes] = {}
        #: A direct-mapped cache: the pair that each slot holds, and whether its pieces may stand together.
        self.pairs = np.full(PAIR_SLOTS, -1, np.int64)
        self.fits = np.zeros(PAIR_SLOTS, bool)

    def _keys(self, raw: list[bytes], filler: bytes) -> np.ndarray:
        full = b"".join(b.ljust(self.width * 8, filler) for b in raw)
        return np.frombuffer(full, ">u8").astype(np.uint64).reshape(len(raw), self.width)

    def suffixes(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The positions in the order of what follows them, and that order's keys, 8 bytes each."""
        padded = np.concatenate([text, np.zeros(self.width * 8 + 8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        keys = [eight[starts + 8 * k].view(">u8").ravel().astype(np.uint64) for k in range(self.width)]
        order = np.argsort(keys[0])
        first = keys[0][order]
        same = np.zeros(len(order), bool)  # only suffixes with the same first 8 bytes need the later ones
        same[1:] = first[1:] == first[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        at = order[tied]
        order[tied] = at[np.lexsort([*(k[at] for k in keys[:0:-1]), first[tied]])]
        return starts[order], [first, *(k[order] for k in keys[1:])]

    def ranges(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of suffixes that begin with it, by binary search."""
        lo = np.searchsorted(keys[0], self.low[:, 0], "left")
        hi = np.searchsorted(keys[0], self.high[:, 0], "right")
        for p in np.flatnonzero((self.sizes > 8) & (hi > lo)):
            a, b = lo[p], hi[p]
            for k in range(1, -(-int(self.sizes[p]) // 8)):
                part = keys[k][a:b]
                a, b = a + np.searchsorted(part, self.low[p, k], "left"), a + np.searchsorted(part, self.high[p, k], "right")
            lo[p], hi[p] = a, b
        return lo, hi

    def edges(self, text: np.ndarray, word_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence within a word; piece -1: a character without a piece."""
        chars = np.flatnonzero((text & 0xC0) != 0x80)
        order, keys = self.suffixes(text, chars)
        lo, hi = self.ranges(keys)
        counts = hi - lo
        piece = np.repeat(np.arange(len(counts)), counts)
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        start = order[first + np.arange(len(piece))]
        end = start + self.sizes[piece]
        inside = end <= ends[word_of[start]]
        start, end, piece = start[inside], end[inside], piece[inside]
        has = np.zeros(len(text) + 1, bool)
        has[start[self.chars[piece] == 1]] = True
        bare = np.flatnonzero(~has[chars])
        after = np.append(chars, len(text))
        return (
            np.concatenate([start, chars[bare]]),
            np.concatenate([end, after[bare + 1]]),
            np.concatenate([piece, np.full(len(bare), -1)]),
        )

    def together(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may stand behind the one before it."""
        keys = before << 32 | piece
        slots = (mix64(keys) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        lacking = self.pairs[slots] != keys
        out = self.fits[slots]
        if lacking.any():
            fresh, at = np.unique(keys[lacking], return_inverse=True)
            texts, stands = self.texts, self.table.stands
            verdicts = np.array([stands(texts[k >> 32], texts[k & 0xFFFFFFFF]) for k in fresh.tolist()])
            out[lacking] = verdicts[at]
            slots = (mix64(fresh) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            _, one = np.unique(slots, return_index=True)  # of pairs that share a slot one is kept
            self.pairs[slots[one]], self.fits[slots[one]] = fresh[one], verdicts[one]
        return out

    def tokens(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' tokens in order: piece, start and end among all bytes, text's number; and these bytes."""
        text = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(b) for b in raw])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word_of = np.repeat(np.arange(len(raw)), sizes)
        start, end, piece = self.edges(text, word_of, ends)
        depth = end - begins[word_of[start]]
        by_depth = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        start, end, piece = start[by_depth], end[by_depth], piece[by_depth]
        cuts = np.flatnonzero(np.diff(depth[by_depth], prepend=-1, append=-1))
        last = np.full(len(text) + 1, -2)  # the last piece of the encoding up to here; -2: none ends here
        back = np.zeros(len(text) + 1, np.int64)
        opens = np.zeros(len(text) + 1, bool)
        opens[begins] = True
        for lo, hi in zip(cuts, cuts[1:]):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            before = last[s]
            free = opens[s] | (before == -1) | ((before >= 0) & (p == -1))
            ask = np.flatnonzero(~free & (before >= 0))
            free[ask] = self.together(before[ask], p[ask])
            last[e[free]], back[e[free]] = p[free], s[free]
        at, found = ends, []
        while len(at):
            found.append(at)
            at = back[at]
            at = at[~opens[at]]
        at = np.sort(np.concatenate(found))  # where tokens end, in the order of the text
        return last[at], back[at], at, word_of[back[at]], text

    def token_ids(self, pieces: np.ndarray, froms: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' ids, and how many each has: characters without a piece become their bytes."""
        many = np.where(pieces < 0, at - froms, 1)
        if (pieces >= 0).all():
            return self.ids[pieces], many
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        bare = np.repeat(pieces < 0, many)
        of_bytes = self.byte_ids[text[np.minimum(np.repeat(froms, many) + nth, len(text) - 1)]]
        return np.where(bare, of_bytes, np.repeat(self.ids[pieces], many)), many

    def learn(self, words: list[str]) -> None:
        """Encode words (each without the first of its space signs) into the cache."""
        pieces, froms, at, owner, text = self.tokens([(" " + w).encode() for w in words])
        ids, many = self.token_ids(pieces, froms, at, text)
        stops = np.cumsum(np.bincount(np.repeat(owner, many), minlength=len(words)) * 4).tolist()
        flat = ids.astype("<i4").tobytes()
        self.words.update(zip(words, map(flat.__getitem__, map(slice, [0, *stops], stops))))

    def long_word(self, word: str) -> bytes:
        """The ids of a long word, as ``encode`` gives them, with memory for some windows of it."""
        raw = (" " + word).encode()
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        cut = lambda x: int(starts[np.searchsorted(starts, x)]) if x <= starts[-1] else len(raw)
        begins = [cut(x) for x in range(0, len(raw), WINDOW)]
        begins = [x for x in begins if x < len(raw)]
        ends = [cut(x + WINDOW + OVERLAP) for x in begins]
        many, done, held = max(1, INDEX_BYTES // (2 * WINDOW)), [], None

        def finished(tokens: tuple) -> None:
            ids, _ = self.token_ids(*tokens, whole)
            done.append(ids.astype("<i4").tobytes())

        whole = np.frombuffer(raw, np.uint8)
        for k in range(0, len(begins), many):
            pieces, froms, at, owner, text = self.tokens([raw[a:b] for a, b in zip(begins[k : k + many], ends[k : k + many])])
            base = np.cumsum([0, *(b - a for a, b in zip(begins[k : k + many], ends[k : k + many]))])
            for n, begin in enumerate(begins[k : k + many]):
                mine = owner == n
                new = pieces[mine], froms[mine] - base[n] + begin, at[mine] - base[n] + begin
                if held is not None:
                    keys = [x[1] << 16 | (x[2] - x[1]) for x in (held, new)]
                    common, left, right = np.intersect1d(*keys, return_indices=True)
                    if len(common):
                        finished(tuple(x[: left[0]] for x in held))
                        new = tuple(x[right[0] :] for x in new)
                    else:
                        return self.in_order(raw)
                held = new
        finished(held)
        return b"".join(done)

    def in_order(self, raw: bytes) -> bytes:
        """The ids of one long word, relaxed position by position over stretches of its edges."""
        text = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        n, longest = len(raw), self.width * 8
        last, back = array("i", [-2]) * (n + 1), array("i", [0]) * (n + 1)
        last[0] = -1  # anything may stand behind the beginning
        stands, texts, known = self.table.stands, self.texts, {}
        lo = 0
        while lo < n:
            hi = int(starts[np.searchsorted(starts, lo + STRETCH)]) if lo + STRETCH <= starts[-1] else n
            base = max(0, lo - longest)
            part = text[base:hi]
            start, end, piece = self.edges(part, np.zeros(len(part), np.int64), np.array([len(part)]))
            new = end + base > lo
            start, end, piece = start[new] + base, end[new] + base, piece[new]
            order = np.argsort(end, kind="stable")
            for s, e, p in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist()):
                before = last[s]
                if before == -2 or last[e] != -2:
                    continue
                if before >= 0 and p >= 0:
                    key = before << 32 | p
                    fits = known.get(key)
                    if fits is None:
                        if len(known) > PAIR_SLOTS:
                            known.clear()
                        fits = known[key] = stands(texts[before], texts[p])
                    if not fits:
                        continue
                last[e], back[e] = p, s
            lo = hi
        ends, at = [], n
        while at:
            ends.append(at)
            at = back[at]
        at = np.array(ends[::-1], np.int64)
        ids, _ = self.token_ids(np.frombuffer(last, np.int32)[at].astype(np.int64), np.frombuffer(back, np.int32)[at].astype(np.int64), at, text)
        return ids.astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        cut = []
        for text in texts:
            words = []
            for part in parts(text.replace(SPACE, " ")):
                words += pretokens(part) or ([""] if text else [])
            cut.append(words)
        lacking = set().union(*cut).difference(self.words)
        known = self.words
        if long := {w: self.long_word(w) for w in lacking if len(w) > LONG_BYTES}:
            known = ChainMap(self.words, long)
        if lacking := list(lacking.difference(long)):
            self.learn(lacking)
        return [b"".join(map(known.__getitem__, words)) for words in cut]


def _encoder(model_path: str, table: PieceTable) -> Encoder:
    """This worker's encoder of the model."""
    encoder = _workers.setdefault(model_path, None) or Encoder(table)
    _workers[model_path] = encoder
    return encoder


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", pa.int32(), False)))


def _texts(lists: pa.Array, decoded: list[bytes]) -> pa.Array:
    """What each list of ids decodes to."""
    of, texts = decoded.__getitem__, []
    for ids in lists:
        raw = b"".join(map(of, ids.values.to_numpy().tolist())) if ids.is_valid else b""
        texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 (of the text's UTF-8) and token_ids of every document, as the library encodes it."""
    table = docs.sparkSession.sparkContext.broadcast(PieceTable(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path, table.value)
        for batch in batches:
            for piece in slices(batch, 1, INDEX_BYTES):
                ids = _lists(encoder.encode(piece.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), ids], names=ENCODED.names)

    return _rows(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (as ``encode`` returns it) with the text that its ids stand for, in column decoded."""
    table = small_batches(encoded).sparkSession.sparkContext.broadcast(PieceTable(model_path).decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(part.column(2), table.value)], names=DECODED.names)

    return encoded.select(*ENCODED.names).mapInArrow(run, DECODED)


def recode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass: each part of a batch is encoded, and its ids decoded, by one worker."""
    table = docs.sparkSession.sparkContext.broadcast(PieceTable(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path, table.value)
        for batch in batches:
            for piece in slices(batch, 1, INDEX_BYTES):
                ids = _lists(encoder.encode(piece.column(1).to_pylist()))
                texts = _texts(ids, table.value.decoded)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), ids, texts], names=DECODED.names)

    return _rows(docs, id_col, text_col).mapInArrow(run, DECODED)
