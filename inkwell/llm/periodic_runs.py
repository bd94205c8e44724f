"""Periodic run detection (operator 13): heavy/light lag counting.

A run of a text is a stretch of words with a smallest period q (words q apart are identical), of at
least ``LEAST`` words and two periods, that neither neighbouring word extends.  Inside it at least
max(LEAST - q, q) words in a row equal the word q further on.  So for every lag the pairs of equal
words at that distance are counted first, exactly: a word with many places (heavy) adds the
autocorrelation of its places, by FFT; the others (light) add the differences of their places, pair
by pair.  Only lags with enough pairs are scanned for islands of consecutive matches.

Two things keep the scans few and short, and leave the result as it is:

*   A run that was found explains its own pairs at all multiples of its period.  A run whose smallest
    period is such a multiple shares none of these pairs (it would overlap the first one by its own
    period, and so have the first one's period too), so they are taken off the counts.
*   An island of q matches in a row covers ``PROBES`` probes in a row that lie q / PROBES apart.  At
    large lags only the probes are compared, and where enough in a row match the island is measured.

Each text is worked on alone within its task; nothing is shuffled.  Memory follows the longest text.

Defined results: a null or empty text, and one without words, has no runs and an empty collapsed text;
a null id stays null (and ``rewritten`` leaves its text alone); repeated rows give repeated rows; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkwell.llm.common import id_text, slices
from inkwell.llm.merkle import CRC_TABLE, crc_sql

#: Words of the shortest run, and periods that a run has at least.
LEAST, PERIODS = 12, 2
#: Probes that the shortest island of a large lag covers, and the lag from which probes are used.
PROBES, PROBED_LAG = 16, 64
#: Pairs of places that are counted at once, and points of all transforms at once.
PAIRS, POINTS = 1 << 20, 1 << 22

SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in "doc_id n_runs start length period exponent_milli".split()]
    + [T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]
)
Run = tuple[int, int, int]


def needed(lags: np.ndarray) -> np.ndarray:
    """Matches in a row that a run of each period has at least."""
    return np.maximum(LEAST - lags, lags * (PERIODS - 1))


def heavy_from(n: int) -> float:
    """Places from which a word of a text of n words is heavy: there its pairs cost more than a transform."""
    return max(32.0, np.sqrt(n * np.log2(n + 1)))


def lag_counts(codes: np.ndarray) -> np.ndarray:
    """For each lag up to half of the words, how many words equal the word at that distance behind them."""
    n, most = len(codes), len(codes) // PERIODS
    out = np.zeros(most + 1, np.int64)
    places = np.argsort(codes, kind="stable")
    many = np.bincount(codes)
    heavy = many >= heavy_from(n)
    if heavy.any():
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        words = np.flatnonzero(heavy)
        starts = np.cumsum(many) - many
        at_once = max(1, POINTS // size)
        for k in range(0, len(words), at_once):
            some = words[k : k + at_once]
            rows = np.zeros((len(some), size))
            for row, w in zip(rows, some):
                row[places[starts[w] : starts[w] + many[w]]] = 1
            spectrum = np.fft.rfft(rows, axis=1)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    owner = codes[places]
    light = ~heavy[owner]
    places, owner = places[light], owner[light]
    step, waiting, held = 1, [], 0
    while True:  # pairs of a word's places, the step-th next one each
        same = owner[step:] == owner[:-step] if step < len(owner) else np.zeros(0, bool)
        apart = (places[step:] - places[: len(same)])[same]
        waiting.append(apart[apart <= most])
        held += len(apart)
        if held > PAIRS or not len(apart):
            out += np.bincount(np.concatenate(waiting), minlength=most + 1)
            waiting, held = [], 0
        if not len(apart):
            break
        step += 1
    out[0] = 0
    return out


def _stretches(flags: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of at least ``least`` true flags."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return zip(begins[long].tolist(), ends[long].tolist())


def _reach(codes: np.ndarray, at: int, q: int, limit: int, step: int) -> int:
    """How far matches at lag q go on from ``at`` (which matches) towards ``limit``, in growing blocks."""
    block = PROBES
    while at != limit:
        stop = min(at + block, limit) if step > 0 else max(at - block, limit)
        lo, hi = (at, stop) if step > 0 else (stop, at)
        same = codes[lo:hi] == codes[lo + q : hi + q]
        if not same.all():
            return lo + int(np.argmin(same)) if step > 0 else lo + len(same) - int(np.argmin(same[::-1]))
        at, block = stop, block * 2
    return limit


def islands(codes: np.ndarray, q: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the maximal stretches of enough places in a row whose word equals the one q further on."""
    n, least = len(codes) - q, int(needed(np.array(q)))
    if q < PROBED_LAG:
        yield from _stretches(codes[:n] == codes[q:], least)
        return
    apart = q // PROBES
    hits = codes[:n:apart] == codes[q::apart]
    done = -1
    for lo, hi in _stretches(hits, least // apart):
        if lo * apart < done:
            continue
        begin = _reach(codes, lo * apart, q, 0, -1)
        done = _reach(codes, (hi - 1) * apart, q, n, 1)
        if done - begin >= least and (codes[begin:done] == codes[begin + q : done + q]).all():
            yield begin, done
        elif done - begin >= least:
            yield from ((begin + a, begin + b) for a, b in _stretches(codes[begin:done] == codes[begin + q : done + q], least))


def runs_of(codes: np.ndarray) -> list[Run]:
    """Start, length and smallest period of every run, by start, then period."""
    if len(codes) < LEAST:
        return []
    counts = lag_counts(codes)
    lags = np.arange(len(counts))
    enough = needed(lags)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero((counts >= enough) & (lags > 0)).tolist():
        if counts[q] < enough[q]:  # the runs found so far explain its matches
            continue
        for begin, end in islands(codes, q):
            length = end - begin + q
            if found.setdefault((begin, length), q) == q:
                multiples = np.arange(q, min(length, len(counts)), q)
                counts[multiples] -= length - multiples
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    starts, lengths, periods = np.array(runs).T
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of which those from some place on repeat the ones there in one document out of ten.

    Place and period follow from the CRC-32 of the id.
    """
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _coded(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def periodic_runs(docs: DataFrame, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every whole text: how many, the longest, and digests of all and of the collapsed text.

    With ``rewrite`` the texts are those that ``rewritten`` makes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.encode().split()  # bytes are split at exactly \x20 and \x09-\x0D
                    if rewrite:
                        words = rewritten(doc_id, words)
                    runs = runs_of(_coded(words)) if len(words) >= LEAST else []
                    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    exponent = 1000 * length // period if runs else None
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    left = b" ".join(collapsed(words, runs))
                    digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest()
                    rows.append((doc_id, len(runs), start, length, period, exponent, *digests))
                columns = [pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def oracle_sql() -> str:
    """All equal pairs of words by distance, islands of consecutive ones, and of equal stretches the least distance."""
    return f"""
    with crc as materialized (select {CRC_TABLE} as t),
    split as materialized (
        select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws,
            len(ws) as n, coalesce({crc_sql("doc_id", "t")}, 1) as h, h // 10 as g,
            case when n > 0 then g % n else 0 end as a, 1 + (n - a) // (3 + g % 8) as p
        from documents, crc),
    texts as materialized (
        select doc_id, n, case when h % 10 = 0 and n > 0
            then list_transform(range(n), lambda i: ws[1 + case when i >= a then a + (i - a) % p else i end]) else ws end as ws
        from split),
    words as materialized (select doc_id, n, unnest(ws) as w, unnest(range(n)) as i from texts),
    pairs as (
        select x.doc_id, y.i - x.i as q, x.i
        from words x join words y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and y.i - x.i <= x.n // 2),
    islands as (
        select doc_id, q, min(i) as s, count(*) + q as length
        from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs)
        group by doc_id, q, island having count(*) >= greatest({LEAST} - q, q)),
    runs as materialized (select doc_id, s, length, min(q) as q from islands group by doc_id, s, length),
    dropped as (select distinct doc_id, unnest(range(s + q, s + length)) as i from runs),
    kept as (
        select doc_id, string_agg(w, ' ' order by i) as text
        from words anti join dropped using (doc_id, i) group by doc_id),
    longest as (
        select doc_id, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as listed,
            first(s order by length desc, s, q) as start, first(length order by length desc, s, q) as length,
            first(q order by length desc, s, q) as period
        from runs group by doc_id)
    select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
        sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
    from texts left join longest using (doc_id) left join kept using (doc_id)
    """
