"""Column expressions over lines and paragraphs against plain loops over each text, and on small cases."""

import random

import plain_chunks as plain
import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunking as C

BITS = [
    "word", "two words", "。", "！", "，", ". ", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r\n \r\n", "\n \t\n", "```\n", "```py\n", "# T\n", "### Sub\n",
    "#no\n", "| a | b |\n", "|---|---|\n", " | c |\n", "a|b\n", "数据库表", "é🙂", " ", "　\n", "x" * 40, "。x" * 9, "end", "``", "\x1c", "\x0b\n",
]


def texts(seed, n=220):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "```", "a"] + ["".join(rng.choices(BITS, k=rng.randrange(1, 45))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    found = texts(1)
    return found, spark.createDataFrame([*enumerate(found), (-1, None)], "id int, text string").repartition(3).cache()


def rows(df, *columns):
    out = {}
    for r in df.select("id" if "id" in df.columns else "doc_id", *columns).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return out


def spans(df, column):
    return {r[0]: [(x["start"], x["end"]) for x in r[1]] for r in df.select("id", column).collect()}


def test_paragraphs(docs):
    found, table = docs
    got = {r.id: [(x["start"], x["end"], x["text"]) for x in r.s] for r in table.select("id", C.paragraphs(F.col("text")).alias("s")).collect()}
    assert got == {-1: [], **{k: [(a, b, t[a:b]) for a, b in plain.paragraphs(t)] for k, t in enumerate(found)}}


def test_structure(docs):
    found, table = docs
    got = {r.id: [(x["start"], x["end"], x["kind"], x["level"]) for x in r.s] for r in table.select("id", C.structure(F.col("text")).alias("s")).collect()}
    wanted = {k: [(b.start, b.end, b.kind, b.level) for b in plain.structure(t)] for k, t in enumerate(found)}
    for k, t in enumerate(found):
        assert got[k] == wanted[k], t
    assert got[-1] == []


@pytest.mark.parametrize("most", [7, 25, 1400])
def test_pieces(docs, most):
    found, table = docs
    units = C._units(table, "id", "text", most)
    got = {r.doc_id: [(x["start"], x["end"], x["text"]) for x in r.units] for r in units.select("doc_id", "units").collect()}
    assert got == {-1: [], **{k: [(a, b, t[a:b]) for a, b in plain.flat_spans(t, most)] for k, t in enumerate(found)}}


@pytest.mark.parametrize("overlap, most", [(0, 20), (5, 20), (12, 30)])
def test_overlaps(docs, overlap, most):
    found, table = docs
    got = rows(C.flat_chunks(table, "id", "text", overlap, most), "chunk_index", "start", "end", "overlap_left", "overlap_right")
    for k, t in enumerate(found):
        cut = plain.flat_spans(t, most)
        wanted = [(n, a, b, *plain.overlapped(t, (a, b), overlap, most + 2 * overlap)) for n, (a, b) in enumerate(cut)]
        assert sorted(got.get(k, [])) == wanted, t
    assert -1 not in got


@pytest.mark.parametrize("most", [15, 60, 1400])
def test_parents(docs, most):
    found, table = docs
    got = {r.doc_id: [(x["start"], x["end"], x["kind"], x["text"]) for x in r.parents] for r in C.parent_spans(table, "id", "text", most).collect()}
    for k, t in enumerate(found):
        assert got[k] == [(a, b, kind, t[a:b]) for a, b, kind in plain.parents(t, most)], t


def test_parents_and_children(docs):
    found, table = docs
    parents, kids = C.parent_child_chunks(table.withColumn("id", F.concat(F.lit("d"), "id")), "id", "text", 120, 64)
    got = rows(parents, "chunk_index", "chunk_type", "content")
    listed = {r.chunk_id: r.child_ids for r in parents.collect()}
    for k, t in enumerate(found):
        wanted = [(n, kind, t[a:b].strip(" ")) for n, (a, b, kind) in enumerate(plain.parents(t, 120))]
        assert sorted(got.get(f"d{k}", [])) == [w for w in wanted if w[2]], t
    mine = {}
    for r in kids.collect():
        mine.setdefault(r.parent_id, set()).add((r.child_id, r.content))
    assert {p: {c for c, _ in some} for p, some in mine.items()} == {p: set(ids) for p, ids in listed.items() if ids}
    wanted = {t[a:b].strip(" ") for t in found for p in plain.parents(t, 120) if t[p[0] : p[1]].strip(" ") for a, b in plain.children(t, p, 64)} - {""}
    assert {c for some in mine.values() for _, c in some} == wanted


@pytest.mark.parametrize("most, short", [(30, 10), (80, 25), (4000, 500)])
def test_batches(docs, most, short):
    found, table = docs
    got = rows(C.batches(table, "id", "text", most, short), "batch", "start", "end")
    assert {k: sorted(v) for k, v in got.items()} == {k: [(n, *s) for n, s in enumerate(b)] for k, t in enumerate(found) if (b := plain.batches(t, most, short))}


@pytest.mark.parametrize("target", [10, 60, 800])
def test_windows(spark, target):
    found = ["\n\n".join(t.replace("\n", "")[:90] or "x" for t in texts(seed, 25)) for seed in range(12)]
    table = spark.createDataFrame([*enumerate(found)], "id int, text string")
    got = rows(C.window_spans(table, "id", "text", target), "start", "end")
    assert {k: sorted(v) for k, v in got.items()} == {k: plain.windows(t, target) for k, t in enumerate(found)}
    whole = rows(C.window_spans(table, "id", "text", target, lambda sizes, _: F.size(sizes)), "start", "end")
    assert {k: sorted(v) for k, v in whole.items()} == {k: plain.windows(t, target, lambda sizes, _: len(sizes)) for k, t in enumerate(found)}


def test_excerpts(docs):
    found, table = docs
    got = rows(C.excerpts(table, "id", "text", 20, 30), "position", "excerpt")
    wanted = {k: [t[a:b] for s in plain.paragraphs(t) if s[1] - s[0] >= 20 for a, b in plain.pieces(t, s, 30)] for k, t in enumerate(found)}
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v for k, v in wanted.items() if v}


def test_marks(spark):
    rng, pairs = random.Random(5), []
    for t in texts(3, 150):
        cuts = sorted(rng.randrange(len(t) + 1) for _ in range(rng.randrange(4)))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        lost = [p[rng.randrange(2) :] if rng.random() < 0.4 else p for p in parts]
        answer = plain.CUT_MARK.join(lost)
        pairs.append((t, rng.choice([answer, f"<think>a{plain.CUT_MARK}b</think>{answer}", f" ```text\n{answer}\n``` ", answer + " ", answer[:-1], answer.upper(), None, ""])))
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id int, text string, answer string")
    got = rows(C.marked_spans(table, "id", "text", "answer"), "mode", "start", "end")
    for k, (t, answer) in enumerate(pairs):
        cut, mode = plain.from_marks(t, answer or "")
        assert sorted(got.get(k, [])) == [(mode, a, b) for a, b in cut], (t, answer)
    assert len(got) > 40


def test_small_cases(spark):
    table = spark.createDataFrame([(1, "第一句。第二句。\n\n| a | b |\n|---|---|\n\n# Head\nbody")], "id int, text string")
    kinds = [(x["kind"], x["level"]) for x in table.select(C.structure(F.col("text"))).first()[0]]
    assert kinds == [("paragraph", 0), ("table", 0), ("heading", 1), ("paragraph", 0)]
    assert C._soft_ends("一二三。四五六。七八九", 5) == [4, 8, 11]
    assert C._soft_ends("y" * 11, 5) == [5, 10, 11]


def test_tables_over_page_breaks(spark):
    head = "| n | v |"
    pages = [
        (1, 0, f"intro\n{head}\n|---|---|\n| 1 | a |\n"), (1, 1, f"(continued)\n\n {head} \n|---|---|\n| 2 | b |"), (1, 2, f"{head}\n| 3 | c |\nend\n{head}\n| 4 | d |"),
        (2, 0, "| x |\n| 1 |"), (2, 1, "\n| y |\n| 2 |"), (3, 0, None), (3, 1, ""),
    ]
    table = spark.createDataFrame(pages, "d int, p int, t string")
    found = {}
    for r in C.stitch_tables(table, "d", "p", "t").orderBy("doc_id", "page", "line").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    # The third page's first table follows the second's without a line between, so it is the same stretch of lines.
    assert found[1] == ["intro", head, "|---|---|", "| 1 | a |", "| 2 | b |", head, "| 3 | c |", "end", head, "| 4 | d |"]
    assert found[2] == ["| x |", "| 1 |", "", "| y |", "| 2 |"] and found[3] == ["", ""]


def test_tables_over_page_breaks_line_by_line(spark):
    rng, pages = random.Random(7), []
    kinds = ("| a |", " | a | ", "| b |", "|---|", "|---|", "", " ", "(continued)", "said")
    for d in range(150):
        some = rng.sample(kinds, rng.randrange(2, 6))
        pages += [(d, 2 * p, rng.choice([None, *["\n".join(rng.choices(some, k=rng.randrange(1, 5)))] * 9])) for p in range(rng.randrange(1, 8))]
    wanted = set()
    for d in range(150):
        lines = [(p, k, x) for e, p, t in pages if e == d for k, x in enumerate((t or "").split("\n"))]
        header, gap, gone, n = None, None, set(), 0  # gap: lines behind the last table; None behind other text
        for at, (_, _, x) in enumerate(lines):
            if x.strip().startswith("|"):
                n += 1
                if n == 1:
                    on = gap is not None and header == x.strip()
                    gone |= {at, *gap} if on else set()
                    header = x.strip()
                if n == 2 and on and x == "|---|":
                    gone.add(at)
                gap = []
            else:
                n = 0
                gap = None if x == "said" or gap is None else [*gap, at]
        wanted |= {(d, *line) for at, line in enumerate(lines) if at not in gone}
    found = C.stitch_tables(spark.createDataFrame(pages, "d int, p int, t string"), "d", "p", "t")
    assert {tuple(r) for r in found.collect()} == wanted
