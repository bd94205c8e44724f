"""Chunking: paragraphs, structure, soft cuts, overlap, parents and children, batches, windows, marks.

Spans are half-open and count code points.  A text is cut where it lies, by column expressions over arrays of its
lines and paragraphs: what depends on earlier cuts is a fold over such an array, so nothing is shuffled
and no text leaves the JVM.  Only the soft cuts of stretches that are too long are sought by a
small helper (``soft_cuts``), which is sent these stretches and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import ids
from inkwell.session import small_batches, spread

# Where a text may be cut, strongest first.  No ASCII full stop: it also ends numbers.
CUTS = ("。！？!?；;", "，,：:）)】]”\"", "\n\r", " \t")
#: A soft cut is sought in the last 30 percent of the allowed stretch.
LOOK_BACK = 0.7
SIZE, MOST, OVERLAP, CHILD, LEAST_CHILD = 800, 1400, 120, 200, 64
BATCH, SHORT_TAIL = 4000, 500
#: Units and windows for breaks; characters that an answer's part may be away from where the last one ended.
UNIT, WINDOW, SLACK = 180, 8, 50
CUT_MARK = "<<<<CUT>>>>"
#: White space in the sense of Unicode; what is trimmed off a span; blank lines.
_WS, _EDGE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", " \t\n\r"
_WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BLANK = r"(?:\r?\n[ \t]*){2,}"
_SPAN, _PART = "struct<start:int,end:int>", "struct<start:int,end:int,kind:string>"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _sub(text: Column, start: Column, size: Column) -> Column:
    """``size`` characters from a place that counts from 0."""
    return F.substring(text, (start + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))


def _cumulated(sizes: Column) -> Column:
    """The sums of a list up to each of its numbers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"] + n)).alias("sums"))
    return F.aggregate(sizes, start, step, lambda s: s["sums"])


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(_WHITE))


def _said(text: Column) -> Column:
    """Whether there is anything but white space."""
    return text.rlike("[^" + _WS[1:])


def paragraphs(text: Column) -> Column:
    """start, end, text of the stretches between blank lines, without white space at their edges."""
    parts = F.split(_text(text), _BLANK, -1)
    between = F.concat(F.array(F.lit("")), F.regexp_extract_all(_text(text), F.lit(_BLANK), 0))
    ends = _cumulated(F.zip_with(between, parts, lambda x, y: F.length(x) + F.length(y)))

    def inner(part: Column, end: Column) -> Column:
        lead = F.length(part) - F.length(F.ltrim(part, F.lit(_EDGE)))
        said = F.trim(part, F.lit(_EDGE))
        start = end - F.length(part) + lead
        return F.struct(start.cast("int").alias("start"), (start + F.length(said)).cast("int").alias("end"), said.alias("text"))

    return F.filter(F.zip_with(parts, ends, inner), lambda s: s["end"] > s["start"])


def _soft_ends(text: str, most: int) -> list[int]:
    """Where parts of at most ``most`` characters end: behind the last mark of the strongest kind near each one's end."""
    out, start = [], 0
    while most > 0 and len(text) - start > most:
        end = start + most
        low = max(start + int(most * LOOK_BACK) - 1, 0)
        window = text[low:end]
        places = (max(window.rfind(m) for m in marks) for marks in CUTS)
        cut = next((low + p + 1 for p in places if p >= 0), end)
        start = cut if cut > start else end
        out.append(start)
    return [*out, len(text)]


def soft_cuts(texts: Column, most: int) -> Column:
    """For each of a list of texts the ends of its parts of at most ``most`` characters; null for null."""

    def run(column: pa.Array) -> pa.Array:
        # One row's texts at a time become Python objects.
        found = ([None if t is None else _soft_ends(t, most) for t in list_.as_py()] if list_.is_valid else None for list_ in column)
        return pa.array(found, pa.list_(pa.list_(pa.int32())))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # Marked so that the optimizer leaves it a column of its own and doesn't fold it into the expressions that use it.
    return F.arrow_udf(run, "array<array<int>>").asNondeterministic()(texts)


def _pieces(rows: DataFrame, spans: str, most: int, out: str, kept: str | None = None) -> DataFrame:
    """``rows`` with ``out``: the spans (start, end, text, ...) of a column as pieces (start, end, text, nth of its span).

    Only texts that are too long go to the helper.  With ``kept`` the pieces bear this field of their span too.
    """
    long = F.transform(spans, lambda s: F.when(s["end"] - s["start"] > most, s["text"]))
    some = F.exists(long, lambda x: x.isNotNull())
    rows = small_batches(rows).withColumn("__ends", soft_cuts(F.when(some, long), most))

    def cut(span: Column, nth: Column) -> Column:
        ends = F.coalesce(F.get(F.col("__ends"), nth), F.array(span["end"] - span["start"]))
        begins = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        extra = [span[kept].alias(kept)] if kept else []
        return F.zip_with(begins, ends, lambda a, b: F.struct(
            (span["start"] + a).cast("int").alias("start"), (span["start"] + b).cast("int").alias("end"), _sub(span["text"], a, b - a).alias("text"), nth.alias("of"), *extra
        ))

    return rows.withColumn(out, F.flatten(F.transform(spans, cut))).drop("__ends")


def _let(then: Callable[[Column], Column], **values: Column) -> Column:
    """``then`` of values that are computed once, however often it uses them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def overlaps(near: Column, base: Column, size: Column, start: Column, end: Column, overlap: int, most: int) -> Column:
    """l and r, characters to add left and right of a span: up to ``overlap``, the right ones given up first over ``most``.

    If sentences begin and end within both additions, these end at sentence borders.  ``near`` is the text from
    ``base`` on that an addition may look at (see ``flat_chunks``), ``size`` the length of the whole.
    """
    stops = (CUTS[0] + CUTS[2]).replace("]", r"\]")
    zero = F.lit(0)

    def placed(x: Column) -> Column:
        over = F.greatest(zero, x["left"] + x["right"] + end - start - most) if most > 0 else zero
        return _let(lambda o: _let(sought, left=x["left"], right=x["right"], a=start - (x["left"] - F.least(o["over"] - F.least(o["over"], x["right"]), x["left"])), b=end + x["right"] - F.least(o["over"], x["right"])), over=over)

    def sought(x: Column) -> Column:
        low = F.greatest(zero, x["b"] - x["right"] - 1)
        ahead = _sub(near, x["a"] - base, F.least(size, x["a"] + x["left"] + 1) - x["a"])
        return _let(told, a=x["a"], b=x["b"], low=low, ahead=ahead, behind=_sub(near, low - base, x["b"] - low))

    def told(x: Column) -> Column:
        before = F.length(F.regexp_extract(x["ahead"], f"^[^{stops}]*", 0))
        last = F.length(F.regexp_extract(x["behind"], f"(?s)^.*[{stops}]", 0))
        return _let(
            sides, a=x["a"], b=x["b"], first=F.when(before < F.length(x["ahead"]), x["a"] + before + 1).otherwise(x["a"]), last=F.when(last > 0, x["low"] + last).otherwise(x["b"])
        )

    def sides(x: Column) -> Column:
        whole = (x["first"] < start) & (x["last"] > end)
        left, right = start - F.when(whole, x["first"]).otherwise(x["a"]), F.when(whole, x["last"]).otherwise(x["b"]) - end
        return F.struct(left.cast("int").alias("l"), right.cast("int").alias("r"))

    return _let(placed, left=F.least(F.lit(overlap), start), right=F.least(F.lit(overlap), size - end))


def structure(text: Column) -> Column:
    """start, end, kind, level of code fences, tables, headings and paragraphs; a fence without an end runs to the text's end."""
    lines = F.split(_text(text), "\n")
    block = "struct<start:int,end:int,kind:string,level:int>"
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("fenced"), F.lit(None).cast(block).alias("now"), F.array().cast(f"array<{block}>").alias("done")
    )

    def told(line: Column) -> Column:
        # What a line is by itself, before the fold, so that each pattern is tried once.
        level = F.length(F.regexp_extract(line, rf"^(#{{1,6}}){_WS}+", 1))
        table = line.contains("|") & line.rlike(rf"^{_WS}*\|.*\|{_WS}*$")
        return _let(
            lambda x: F.struct(
                line.startswith("```").alias("fence"), F.when(table, "table").when(x["level"] > 0, "heading").when(_said(line), "paragraph").otherwise("blank").alias("plain"),
                x["level"].alias("level"), x["size"].alias("size"), (x["size"] - F.length(F.ltrim(line, F.lit(_EDGE)))).alias("lead"), (x["size"] - F.length(F.rtrim(line, F.lit(_EDGE)))).alias("trail"),
            ), level=F.when(line.startswith("#"), level).otherwise(0), size=F.length(line),
        )

    def step(s: Column, line: Column) -> Column:
        return _let(lambda x: placed(s, line, x["kind"]), kind=F.when(s["fenced"] | line["fence"], "code").otherwise(line["plain"]))

    def placed(s: Column, line: Column, kind: Column) -> Column:
        end = s["at"] + line["size"]
        loose = kind.isin("paragraph", "blank")
        goes_on = s["now"].isNotNull() & (s["fenced"] | (~line["fence"] & kind.isin("table", "paragraph") & (s["now"]["kind"] == kind)))
        begin = F.when(goes_on, s["now"]["start"]).otherwise(F.when(loose, s["at"] + line["lead"]).otherwise(s["at"]))
        now = F.struct(
            begin.cast("int").alias("start"), F.when(loose, end - line["trail"]).otherwise(end).cast("int").alias("end"), kind.alias("kind"),
            F.when(kind == "heading", line["level"]).otherwise(0).cast("int").alias("level"),
        )
        done = F.when(goes_on | s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct((end + 1).alias("at"), (s["fenced"] != line["fence"]).alias("fenced"), now.cast(block).alias("now"), done.alias("done"))

    found = F.aggregate(F.transform(lines, told), start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    return F.when(F.length(_text(text)) == 0, F.array().cast(f"array<{block}>")).otherwise(F.filter(found, lambda b: (b["end"] > b["start"]) | (b["kind"] == "code")))


def _gathered(blocks: Column, most: int) -> Column:
    """start, end, kind of parents before they are cut: a heading opens one, code and tables stand alone, others gather."""
    none = F.lit(None).cast(_SPAN)
    start = F.struct(none.alias("now"), F.array().cast(f"array<{_PART}>").alias("done"))
    of = lambda x, kind: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind")).cast(_PART)
    closed = lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(of(s["now"], F.lit("text")))))

    def step(s: Column, b: Column) -> Column:
        alone = b["kind"].isin("code", "table")
        joins = (b["kind"] != "heading") & s["now"].isNotNull() & (b["end"] - s["now"]["start"] <= most)
        now = F.when(alone, none).otherwise(F.struct(F.when(joins, s["now"]["start"]).otherwise(b["start"]).alias("start"), b["end"].alias("end")).cast(_SPAN))
        done = F.when(alone, F.concat(closed(s), F.array(of(b, b["kind"])))).when(joins, s["done"]).otherwise(closed(s))
        return F.struct(now.alias("now"), done.alias("done"))

    return F.aggregate(blocks, start, step, closed)


def _line_groups(part: Column, most: int) -> Column:
    """A span (start, end, kind, text) in groups of whole lines of at most ``most`` characters; a longer line stands alone."""
    sizes = F.transform(F.split(part["text"], "\n"), lambda x: F.length(x) + 1)
    ends = F.transform(_cumulated(sizes), lambda e: F.least(part["start"] + e, part["end"]))
    ends = F.filter(ends, lambda e: e < part["end"])
    start = F.struct(part["start"].alias("begin"), part["start"].alias("last"), F.array().cast(f"array<{_SPAN}>").alias("done"))
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")).cast(_SPAN))

    def step(s: Column, end: Column) -> Column:
        over = (s["last"] > s["begin"]) & (end - s["begin"] > most)
        return F.struct(
            F.when(over, s["last"]).otherwise(s["begin"]).alias("begin"), end.cast("int").alias("last"), F.when(over, F.concat(s["done"], span(s["begin"], s["last"]))).otherwise(s["done"]).alias("done")
        )

    whole = F.aggregate(F.concat(ends, F.array(part["end"])), start, step, lambda s: F.concat(s["done"], span(s["begin"], s["last"])))
    return F.when((F.lit(most) <= 0) | (part["end"] - part["start"] <= most), span(part["start"], part["end"])).otherwise(whole)


def _packed(units: Column, most: int, short: int) -> Column:
    """start, end of units packed up to ``most`` characters; a short last batch joins the one before."""
    start = F.struct(F.lit(None).cast(_SPAN).alias("now"), F.array().cast(f"array<{_SPAN}>").alias("done"))

    def step(s: Column, u: Column) -> Column:
        joins = s["now"].isNotNull() & (u["end"] - s["now"]["start"] <= most)
        now = F.struct(F.when(joins, s["now"]["start"]).otherwise(u["start"]).alias("start"), u["end"].alias("end")).cast(_SPAN)
        done = F.when(joins | s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(now.alias("now"), done.alias("done"))

    def last(s: Column) -> Column:
        before = F.try_element_at(s["done"], F.lit(-1))
        small = (F.size(s["done"]) > 0) & (s["now"]["end"] - s["now"]["start"] < short)
        joined = F.concat(F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(F.struct(before["start"].alias("start"), s["now"]["end"].alias("end")).cast(_SPAN)))
        return F.when(s["now"].isNull(), s["done"]).when(small, joined).otherwise(F.concat(s["done"], F.array(s["now"])))

    return F.aggregate(units, start, step, last)


def nearest_break(sizes: Column, target: int) -> Column:
    """How many of the units, but not all of them, come nearest to the target length together; of equals the first."""
    sums = _cumulated(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))))
    away = F.transform(sums, lambda x, k: F.struct(F.abs(x - target).alias("d"), (k + 1).alias("n")))
    return F.coalesce(F.array_min(away)["n"], F.lit(1))


def _windowed(units: Column, target: int, choose: Callable[[Column, int], Column]) -> Column:
    """start, end of units joined up to a break that ``choose`` finds in each window of WINDOW of them."""
    start = F.struct(F.lit(0).alias("k"), F.array().cast(f"array<{_SPAN}>").alias("done"))

    def step(s: Column, nth: Column) -> Column:
        window = F.slice(units, s["k"] + 1, WINDOW)
        n = F.when(F.size(window) > 1, choose(F.transform(window, lambda u: u["end"] - u["start"]), target)).otherwise(1).cast("int")
        span = F.struct(F.get(window, F.lit(0))["start"].alias("start"), F.get(window, n - 1)["end"].alias("end")).cast(_SPAN)
        grown = F.struct((s["k"] + n).cast("int").alias("k"), F.concat(s["done"], F.array(span)).alias("done"))
        return F.when(nth < s["k"], s).otherwise(grown)

    return F.aggregate(F.when(F.size(units) > 0, F.sequence(F.lit(0), F.size(units) - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["done"])


# -- over tables


def _units(docs: DataFrame, doc_id: str, text: str, most: int) -> DataFrame:
    """doc_id, text, size, units: every document's paragraphs in pieces of at most ``most`` characters."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = rows.select("*", F.length("text").alias("size"), paragraphs(F.col("text")).alias("spans"))
    return _pieces(rows, "spans", most, "units").drop("spans")


def flat_chunks(docs: DataFrame, doc_id: str, text: str, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """doc_id, chunk_index, start, end, overlap_left, overlap_right, content, chunk_id of every chunk.

    doc_id holds source document ids; a null or blank text has no chunks.
    """
    rows = _units(docs, doc_id, text, most)
    # A chunk takes along what its additions may look at, so that the text ends here.
    base = lambda u: F.greatest(u["start"] - overlap - 1, F.lit(0))
    near = lambda u: _sub(F.col("text"), base(u), u["end"] - base(u) + overlap + 2)
    told = F.transform("units", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), base(u).alias("base"), near(u).alias("near")))
    rows = rows.select("doc_id", "size", F.posexplode(told).alias("chunk_index", "s")).select("doc_id", "size", "chunk_index", "s.*")
    sides = overlaps(*map(F.col, ("near", "base", "size", "start", "end")), overlap, most + 2 * overlap)
    rows = rows.select("*", F.explode(F.array(sides)).alias("o"))  # an explode of one keeps these expressions in one place
    content = F.trim(_sub(F.col("near"), F.col("start") - F.col("o.l") - F.col("base"), F.col("end") + F.col("o.r") - F.col("start") + F.col("o.l")))
    rows = rows.select("doc_id", "chunk_index", "start", "end", F.col("o.l").alias("overlap_left"), F.col("o.r").alias("overlap_right"), content.alias("content"))
    return rows.withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content")))


def parent_spans(docs: DataFrame, doc_id: str, text: str, most: int = MOST) -> DataFrame:
    """doc_id, parents: start, end, text and kind of every document's parents."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), _text(F.col(text)).alias("text")))
    rows = rows.withColumn("wide", _gathered(structure(F.col("text")), most))
    told = F.transform("wide", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), _sub(F.col("text"), s["start"], s["end"] - s["start"]).alias("text")))
    rows = rows.withColumn("wide", told)
    part = lambda s, a, b: F.struct(a.alias("start"), b.alias("end"), _sub(s["text"], a - s["start"], b - a).alias("text"), s["kind"].alias("kind"))
    cut = F.transform("wide", lambda s: F.when(s["kind"] == "text", F.array(part(s, s["start"], s["end"]))).otherwise(
        F.transform(_line_groups(s, most), lambda g: part(s, g["start"], g["end"]))
    ))
    rows = rows.withColumn("wide", F.flatten(cut))
    # Structured parts are as they are; only the others are cut softly.
    soft = F.transform("wide", lambda s: s.withField("text", F.when(s["kind"] == "text", s["text"])))
    rows = _pieces(rows.withColumn("soft", soft), "soft", most, "parents", "kind")
    again = F.transform("parents", lambda p: p.withField("text", F.coalesce(p["text"], F.get("wide", p["of"])["text"])).withField("end", F.when(p["kind"] == "text", p["end"]).otherwise(F.get("wide", p["of"])["end"])))
    return rows.select("doc_id", again.alias("parents"))


def parent_child_chunks(docs: DataFrame, doc_id: str, text: str, most: int = MOST, child: int = CHILD) -> tuple[DataFrame, DataFrame]:
    """Parents (doc_id, chunk_index, chunk_id, chunk_type, content, child_ids) and their children (parent_id, child_id, content).

    A structured parent is its own child, any other one is cut into parts.
    """
    size = max(LEAST_CHILD, child)
    rows = parent_spans(docs, doc_id, text, most)
    soft = F.transform("parents", lambda p: p.withField("text", F.when(p["kind"] == "text", p["text"])))
    rows = _pieces(rows.withColumn("soft", soft), "soft", size, "kids", "kind")
    whole = lambda k: F.coalesce(k["text"], F.get("parents", k["of"])["text"])
    mine = lambda p, nth: F.transform(F.filter("kids", lambda k: k["of"] == nth), lambda k: F.trim(whole(k)))
    listed = F.transform("parents", lambda p, nth: F.struct(p["kind"].alias("kind"), F.trim(p["text"]).alias("content"), mine(p, nth).alias("parts")))
    rows = rows.select("doc_id", F.posexplode(listed).alias("chunk_index", "s")).select("doc_id", "chunk_index", F.col("s.kind").alias("chunk_type"), "s.content", "s.parts")
    rows = rows.where("content != ''").withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content")))
    parts = F.filter("parts", lambda x: x != "")
    own = F.transform(parts, lambda x: F.struct(ids.child_id(F.col("chunk_id"), x).alias("child_id"), x.alias("content")))
    rows = rows.withColumn("own", own)
    listed_ids = F.array_distinct(F.transform("own", lambda x: x["child_id"]))
    kids = rows.select(F.col("chunk_id").alias("parent_id"), F.explode("own").alias("c")).select("parent_id", "c.child_id", "c.content")
    return rows.select("doc_id", "chunk_index", "chunk_id", "chunk_type", "content", listed_ids.alias("child_ids")), kids.distinct()


def batches(docs: DataFrame, doc_id: str, text: str, most: int = BATCH, short: int = SHORT_TAIL) -> DataFrame:
    """doc_id, batch, start, end: whole paragraphs packed up to ``most`` characters; long ones are cut; a short last batch joins the one before."""
    found = _units(docs, doc_id, text, most).select("doc_id", F.posexplode(_packed(F.col("units"), most, short)).alias("batch", "s"))
    return found.select("doc_id", "batch", "s.start", "s.end")


def window_spans(docs: DataFrame, doc_id: str, text: str, target: int = SIZE, choose: Callable[[Column, int], Column] = nearest_break) -> DataFrame:
    """doc_id, start, end: units of up to UNIT characters, joined up to a break that ``choose`` finds in each window of them.

    ``choose`` maps the sizes of a window's units to how many of them come before the break; it takes a model's place.
    """
    found = _units(docs, doc_id, text, UNIT).select("doc_id", F.explode(_windowed(F.col("units"), target, choose)).alias("s"))
    return found.select("doc_id", "s.start", "s.end")


def excerpts(docs: DataFrame, doc_id: str, text: str, least: int = 60, most: int = 800) -> DataFrame:
    """doc_id, position, excerpt: paragraphs of at least ``least`` characters, long ones in soft parts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.filter(paragraphs(F.col(text)), lambda s: s["end"] - s["start"] >= least).alias("spans"))
    return _pieces(rows, "spans", most, "units").select("doc_id", F.posexplode("units").alias("position", "s")).select("doc_id", "position", F.col("s.text").alias("excerpt"))


def _marked(text: Column, candidate: Column) -> Column:
    """mode and ends of the parts of one form of an answer: null if they neither are the text nor follow each other in it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<int>").alias("ends"), text.alias("rest"))

    def step(s: Column, part: Column) -> Column:
        # A part is sought in what is left of the text, no further than it may be away.
        place = F.call_function("locate", part, F.substring(s["rest"], F.lit(1), F.length(part) + SLACK)) - 1
        return F.when(s["ok"], _let(lambda x: moved(s, x), place=F.when(F.length(part) == 0, 0).otherwise(place), size=F.length(part))).otherwise(s)

    def moved(s: Column, x: Column) -> Column:
        used = x["place"] + x["size"]
        at, ok = (s["at"] + used).cast("int"), x["place"] >= 0
        on = F.struct(at.alias("at"), ok.alias("ok"), F.concat(s["ends"], F.array(at)).alias("ends"), F.substring(s["rest"], used + 1, F.length(s["rest"])).alias("rest"))
        return F.when(ok, on).otherwise(F.struct(s["at"].alias("at"), ok.alias("ok"), s["ends"].alias("ends"), s["rest"].alias("rest")))

    def aligned(x: Column) -> Column:
        ends = F.concat(F.slice(x["done"]["ends"], 1, F.greatest(F.size(x["done"]["ends"]) - 1, F.lit(0))), F.array(F.length(text)))
        return F.when(x["done"]["ok"] & ~_said(x["done"]["rest"]), F.struct(F.lit("aligned").alias("mode"), ends.alias("ends")))

    def judged(x: Column) -> Column:
        strict = F.struct(F.lit("strict").alias("mode"), _cumulated(F.transform(x["parts"], F.length)).alias("ends"))
        loose = F.when(F.size(x["parts"]) > 1, _let(aligned, done=F.aggregate(x["parts"], start, step)))
        return F.when(F.array_join(x["parts"], "") == text, strict).otherwise(loose)

    return _let(judged, parts=F.split(candidate, CUT_MARK))


def paragraph_sizes(text: Column) -> Column:
    """The lengths of a text's paragraphs."""
    inner = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?:\r?\n[ \t]*){2,}"), lambda p: F.length(F.regexp_replace(p, r"^[ \t\r\n]+|[ \t\r\n]+$", "")))
    return F.filter(inner, lambda n: n > 0)


def needs_model(sizes: Column, batch: int, alone: int = 2000) -> Column:
    """Whether paragraphs of these sizes can't cut a text: there is none, or one longer than a batch; without a limit of
    batches, a single one longer than ``alone``."""
    none = F.size(sizes) == 0
    return none | ((F.array_max(sizes) > batch) if batch > 0 else ((F.size(sizes) == 1) & (F.array_max(sizes) > alone)))


def longest(size: Column, configured: Column | None = None) -> Column:
    """The most characters of a chunk: as configured, or 400 or half more than its size."""
    cap = F.greatest(size + 400, (size * 1.5).cast("int"))
    return cap if configured is None else F.coalesce(F.when(configured > 0, configured), cap)


def marked_spans(docs: DataFrame, doc_id: str, text: str, answer: str) -> DataFrame:
    """doc_id, mode, start, end: the spans between a model's marks, and how they were found.

    ``strict`` if the answer without marks is the text, ``aligned`` if its parts follow each other in the text with
    little between.  The answer is tried as it is, stripped, without thoughts, and as what stands in its fence.
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), _text(F.col(text)).alias("t"), _text(F.col(answer)).alias("a"))).where(F.length("t") > 0)
    # Patterns are tried only where they may match; an explode of one keeps the stripped form in one place.
    said = F.when(F.lower("a").contains("<think>"), F.regexp_replace("a", r"(?is)<think>.*?</think>", "")).otherwise(F.col("a"))
    rows = rows.select("*", F.explode(F.array(_strip(said))).alias("plain"))
    plain = F.col("plain")
    fence = rf"(?s)```(?:[\p{{L}}\p{{N}}_]+)?{_WS}*(.*?){_WS}*```"
    inside = lambda x: F.when(x.contains("```") & x.rlike(fence), F.regexp_extract(x, fence, 1))
    fenced = F.coalesce(inside(plain), inside(F.col("a")))
    tried = F.array_distinct(F.filter(F.array(F.col("a"), _strip(F.col("a")), plain, fenced, _strip(fenced)), lambda x: F.length(x) > 0))
    # A form is tried only if those before it didn't fit.
    found = F.aggregate(tried, F.lit(None).cast("struct<mode:string,ends:array<int>>"), lambda s, x: F.coalesce(s, _marked(F.col("t"), x)))
    # An explode of one keeps this in one place; a filter would work it out once more.
    rows = rows.select("doc_id", F.length("t").alias("size"), F.explode(F.array(found)).alias("found"))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.col("size")), "found.ends")))
    rows = rows.select("doc_id", "found.mode", edges.alias("edges"))
    spans = F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges") - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return rows.select("doc_id", "mode", F.explode(spans).alias("s")).select("doc_id", "mode", "s.start", "s.end")


#: Lines that may stand between the parts of a table: blank ones, and those that say that it goes on.
_BETWEEN, _RULE = r"(?i)^\s*$|^\s*(续|[(（]?continued)", r"^[\s|:-]+$"


def stitch_tables(pages: DataFrame, doc_id: str, page: str, text: str) -> DataFrame:
    """doc_id, page, line, text: the lines of a document's pages, without the headers that a table repeats after a break.

    A table goes on if only blank lines, or ones that say so, stand between its parts, and the next part begins with
    the same header; these lines and the header, with the rule below it, are left out then.  A page stays one row until
    the end: it is summed up as its first and its last header, each with the count of other lines before it, and
    windows over the pages of a document compare these.
    """
    table, between, other = 0, 1, 2
    kind = lambda x: F.when(x.rlike(r"^\s*\|.*\|\s*$"), table).when(x.rlike(_BETWEEN), between).otherwise(other).cast("tinyint")
    lines, kinds, begins, whole = F.split("text", "\n"), F.col("kinds"), F.col("begins"), F.size("kinds")
    others = lambda xs: F.size(F.filter(xs, lambda x: x == other)).cast("long")
    order = Window.partitionBy("doc_id").orderBy(F.asc("page"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.col(page).alias("page"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("kinds", F.transform(lines, kind))
    rows = rows.withColumn("open", F.coalesce(F.lag(F.element_at("kinds", -1)).over(order) == table, F.lit(False)))
    rows = rows.withColumn("others", F.coalesce(F.sum(others(kinds)).over(earlier), F.lit(0)))
    # Where stretches of table lines begin, with their first lines.
    goes_on = lambda k: F.when(k > 0, F.get(kinds, k - 1) == table).otherwise(F.col("open"))
    found = F.transform(lines, lambda x, k: F.when((F.get(kinds, k) == table) & ~goes_on(k), F.struct(k.alias("k"), F.trim(x).alias("header"))))
    rows = rows.withColumn("begins", F.filter(found, lambda x: x.isNotNull()))
    told = lambda x: F.when(x.isNotNull(), F.struct(x["header"].alias("header"), (F.col("others") + others(F.slice(kinds, 1, x["k"]))).alias("others")))
    first, last = F.get(begins, F.lit(0)), F.get(begins, F.size(begins) - 1)
    rows = rows.withColumn("first", told(first)).withColumn("seen", F.last(told(last), ignorenulls=True).over(earlier))
    # Which of them go on with the stretch before them; the first one's may be on an earlier page.
    same = F.when(F.col("first").isNotNull(), F.coalesce(F.col("seen") == F.col("first"), F.lit(False)))
    rows = rows.withColumn("same", same)
    many = F.greatest(F.size(begins) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(begins, 1, many), F.slice(begins, 2, many), lambda a, b: (a["header"] == b["header"]) & (others(F.slice(kinds, a["k"] + 1, b["k"] - a["k"])) == 0))
    rows = rows.withColumn("on", F.when(F.size(begins) > 0, F.concat(F.array("same"), pairs)).otherwise(F.array().cast("array<boolean>")))
    # What the pages on both sides tell: whether the line before this page is a header that is left out, and whether the next stretch goes on.
    back = Window.partitionBy("doc_id").orderBy(F.desc("page"))
    at_end = (last["k"] == whole - 1) & F.element_at("on", -1)
    rows = rows.withColumn("ahead", F.coalesce(F.last("same", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    rows = rows.withColumn("header_before", F.coalesce(F.lead(F.when(F.size(begins) > 0, at_end)).over(back), F.lit(False)))
    stretch = lambda k, on: F.struct(k.alias("k"), on.alias("on"))
    starts = F.concat(F.array(stretch(F.lit(-1), F.col("header_before"))), F.zip_with(begins, "on", lambda b, on: stretch(b["k"], on)))
    rows = rows.select("doc_id", "page", "text", "kinds", "ahead", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts") - 1), F.array(stretch(whole, F.col("ahead"))))
    # A line of a stretch stays (0), goes (1) or goes if it is a rule (2).
    fate = lambda x, away, on, gap: F.when((x == between) & gap, 1).when(on & (away == 0), 1).when(on & (away == 1) & (x == table), 2).otherwise(0)
    own = lambda a, b: F.transform(F.slice(kinds, F.greatest(a["k"], F.lit(0)) + 1, b["k"] - F.greatest(a["k"], F.lit(0))), lambda x, k: fate(x, k + F.greatest(-a["k"], F.lit(0)), a["on"], b["on"]))
    fates = F.flatten(F.zip_with("starts", ends, own))
    # Every page has a line; a plain explode would work the list out twice, to drop empty ones.
    rows = rows.select("doc_id", "page", F.posexplode_outer(F.zip_with(lines, fates, lambda x, f: F.struct(x.alias("text"), f.alias("fate")))).alias("line", "x"))
    left_out = (F.col("x.fate") == 1) | ((F.col("x.fate") == 2) & F.col("x.text").rlike(_RULE))
    return rows.where(~left_out).select("doc_id", "page", "line", "x.text")
