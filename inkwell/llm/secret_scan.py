"""Secret scans (operator 11): combined deterministic automaton.

The rules' patterns are compiled on the driver, once, to one minimal automaton (see ``automaton``), whose
arrays are broadcast; their size depends on the rules alone.  A task reads each byte of its texts once,
for all rules: many stretches of text take a step at a time, cut where every rule has to start anew.
Nothing is shuffled.

A rule's spans are its leftmost matches that don't overlap, of which those stay whose group (or whole) has
enough characters; one that is dropped still hides what it covers.  The first three rules are the base;
the others are formats of well-known tokens.

Patterns take ASCII only, so the bytes of other characters end every match; places are code points, ends
exclusive.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows give repeated
rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkwell.llm.automaton import Automaton
from inkwell.llm.common import id_text, slices, text_bytes


def either_case(words: str) -> str:
    """A pattern for the words, with each letter in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group (0: all of it) has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0


BASE = (
    Rule(
        "assign",
        f"({either_case('password|passwd|secret|token|api_?key')})"
        + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    # Runs of fewer than six characters are in every other word; that they are dropped is known at once.
    Rule("hex", "[0-9a-f]{6,}", 16),
)
RULES = BASE + (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("google", "AIza[0-9A-Za-z_-]+", 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0),
)
SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_assign", "n_access", "n_hex")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)
Span = tuple[int, int, int]


@functools.lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton([r.pattern for r in rules])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], automaton: Automaton) -> None:
        self.rules, self.automaton = rules, automaton
        self.forms = [re.compile(r.pattern.encode()) if r.group else None for r in rules]

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[Span]]:
        """For each text that has any, its spans as (start, rule's number, end) in code points, in this order."""
        symbols = self.automaton.symbols(raw, offsets)
        at, masks = self.automaton.ends(symbols)
        if not len(at):
            return {}
        first = offsets[:-1] + np.arange(len(offsets) - 1)  # where each text begins among the symbols
        owner = np.searchsorted(first, at, "right") - 1
        found: dict[int, list[Span]] = {}
        before = [(-1, 0)] * len(self.rules)  # text and end of each rule's last match
        for end, text, mask in zip(at.tolist(), owner.tolist(), masks.tolist()):
            for k, rule in enumerate(self.rules):
                if not mask >> k & 1:
                    continue
                least = before[k][1] if before[k][0] == text else int(first[text])
                before[k] = text, end
                start = self.automaton.begin(k, symbols, least, end)
                size = end - start
                if rule.group and size >= rule.least:
                    size = len(self.forms[k].fullmatch(raw[start - text : end - text].tobytes())[rule.group])
                if size >= rule.least:
                    found.setdefault(text, []).append((start - int(first[text]), k, end - int(first[text])))
        for text, spans in found.items():
            points = np.append(0, np.cumsum((raw[offsets[text] : offsets[text + 1]] & 0xC0) != 0x80))
            found[text] = sorted((int(points[a]), k, int(points[b])) for a, k, b in spans)
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of every whole text; ``rules`` begin with the three of the base.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base's spans, listed) and spans (all,
    listed): ``kind:start:end`` by start, then in the order of the rules, joined by commas.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, shared.value)
        listed = lambda spans: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            for part in slices(batch):
                found = scanner.scan(*text_bytes(part.column(1)))
                counts = np.zeros((len(BASE), part.num_rows), np.int64)
                digests = [hashlib.sha256(b"").hexdigest()] * part.num_rows
                spans = [""] * part.num_rows
                for text, some in found.items():
                    base = [s for s in some if s[1] < len(BASE)]
                    for _, k, _ in base:
                        counts[k, text] += 1
                    digests[text] = hashlib.sha256(listed(base).encode()).hexdigest()
                    spans[text] = listed(some)
                columns = [part.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def oracle_sql() -> str:
    """Each rule's matches by the database's own expressions; places from the lengths of what lies between them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = []
    for k, rule in enumerate(RULES):
        p = quoted(rule.pattern)
        each.append(f"""
            select doc_id, row, {k} as k, '{rule.kind}' as kind,
                unnest(regexp_extract_all(text, {p})) as whole, unnest(regexp_extract_all(text, {p}, {rule.group})) as checked,
                unnest(regexp_split_to_array(text, {p})[:-2]) as gap, unnest(range(len(regexp_extract_all(text, {p})))) as nth,
                {rule.least} as least
            from texts""")
    return f"""
    with texts as materialized (select doc_id, coalesce(text, '') as text, row_number() over () as row from documents),
    matches as ({" union all ".join(each)}),
    spans as (
        select *, sum(length(gap) + length(whole)) over (partition by row, k order by nth) as stop from matches),
    kept as (
        select row, k, stop - length(whole) as start, kind || ':' || (stop - length(whole))::bigint || ':' || stop::bigint as span
        from spans where length(checked) >= least),
    listed as (
        select row, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
            count(*) filter (where k = 2) as n_hex, string_agg(span, ',' order by start, k) filter (where k < {len(BASE)}) as base,
            string_agg(span, ',' order by start, k) as spans
        from kept group by row)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from texts left join listed using (row)
    """
