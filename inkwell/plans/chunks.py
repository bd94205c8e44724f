"""Chunking queries over whole documents.

Each document's lines stand for paragraphs here (they are joined by blank lines), so the corpus has
something to cut; DuckDB checks what SQL can say, tests hold the rest against fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import chunking, ids
from inkwell.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query


def _marks(k: int) -> str:
    return chunking.CUTS[k].replace("]", r"\]")


#: Sentence ends and line ends, at which overlaps end.
_STOPS = _marks(0) + _marks(2)
_LINES = """txt as (select doc_id, '0:d' || doc_id || ':' || substr(sha256(text), 1, 16) as owner, replace(text, chr(10), chr(10) || chr(10)) as txt from documents),
lines as (select doc_id, k, line, coalesce(sum(length(line) + 2) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as o from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)),
para as (select doc_id, k as p, o + length(line) - length(ltrim(line, ' ' || chr(9) || chr(13))) as s, length(trim(line, ' ' || chr(9) || chr(13))) as n from lines),
spans as (select doc_id, p, s, s + n as e from para where n > 0)"""


def _pieces(name: str, spans: str, most: int) -> str:
    """CTEs that cut spans (doc_id, p, s, e) into pieces of at most ``most`` characters, behind the strongest mark near their ends."""
    low = int(most * chunking.LOOK_BACK)
    window = f"substr(txt, greatest(s + {low} - 1, 0)::bigint + 1, s + {most} - greatest(s + {low} - 1, 0))"
    behind = [f"length(regexp_extract({window}, '(?s)^.*[{_marks(k)}]'))" for k in range(4)]
    cut = " ".join(f"when {b} > 0 then greatest(s + {low} - 1, 0) + {b}" for b in behind)
    return f"""{name}_cut(doc_id, p, n, s, e) as (select doc_id, p, 0, s, e from {spans} union all
  select c.doc_id, p, n + 1, (case {cut} else s + {most} end)::bigint, e from {name}_cut c join txt on txt.doc_id = c.doc_id where e - s > {most}),
{name} as (select doc_id, p, n, s, coalesce(lead(s) over (partition by doc_id, p order by n), e)::bigint as e from {name}_cut)"""


_FLAT = f"""with recursive {_LINES}, {_pieces("piece", "spans", chunking.MOST)},
sides as (select p.*, length(txt) as len, least({chunking.OVERLAP}, s) as l0, least({chunking.OVERLAP}, length(txt) - e) as r0, owner, txt,
  row_number() over (partition by p.doc_id order by p, n) - 1 as chunk_index from piece p join txt on p.doc_id = txt.doc_id),
room as (select *, greatest(0, l0 + r0 + e - s - {chunking.MOST + 2 * chunking.OVERLAP}) as over from sides),
cut as (select *, s - (l0 - least(over - least(over, r0), l0)) as a, e + r0 - least(over, r0) as b from room),
near as (select *, substr(txt, a + 1, least(len, a + l0 + 1) - a) as x, substr(txt, greatest(0, b - r0 - 1) + 1, b - greatest(0, b - r0 - 1)) as y from cut),
stops as (select *, length(regexp_extract(x, '^[^{_STOPS}]*')) as m, length(regexp_extract(y, '(?s)^.*[{_STOPS}]')) as q from near),
ends as (select *, case when m < length(x) then a + m + 1 else a end as first, case when q > 0 then greatest(0, b - r0 - 1) + q else b end as last from stops),
final as (select *, case when first < s and last > e then first else a end as fa, case when first < s and last > e then last else b end as fb from ends),
told as (select *, trim(substr(txt, fa + 1, fb - fa)) as content from final)
select owner as doc_id, chunk_index::int as chunk_index, s::int as start, e::int as "end", (s - fa)::int as overlap_left, (fb - e)::int as overlap_right, content,
owner || ':' || chunk_index || ':' || substr(sha256(content), 1, 12) as chunk_id from told"""
_PARENTS = f"""with recursive {_LINES.replace("from documents", "from docs")}, block as (
  select doc_id, row_number() over (partition by doc_id order by k) as k, case when line[1:2] = '# ' then 'heading' when line[1:2] = '| ' then 'table' else 'text' end as kind,
    case when line[1:2] in ('# ', '| ') then o else s end as s, case when line[1:2] in ('# ', '| ') then o + length(line) else s + n end as e
  from lines join para using (doc_id) where k = p and n > 0),
walk(doc_id, k, kind, s, e, g, gs) as (select doc_id, k, kind, s, e, 1, case when kind = 'table' then null else s end from block where k = 1 union all
  select b.doc_id, b.k, b.kind, b.s, b.e, case when b.kind = 'text' and gs is not null and b.e - gs <= {chunking.MOST} then g else g + 1 end,
    case when b.kind = 'table' then null when b.kind = 'text' and gs is not null and b.e - gs <= {chunking.MOST} then gs else b.s end
  from walk w join block b on b.doc_id = w.doc_id and b.k = w.k + 1),
groups as (select doc_id, g as p, min(s) as s, max(e) as e, bool_or(kind = 'table') as whole from walk group by 1, 2),
loose as (select * from groups where not whole), {_pieces("piece", "loose", chunking.MOST)},
parent as (select doc_id, p, n, s, e, 'text' as kind from piece union all select doc_id, p, 0, s, e, 'table' from groups where whole),
parents as (select parent.*, owner, txt, row_number() over (partition by parent.doc_id order by p, n) - 1 as chunk_index, trim(substr(txt, s::bigint + 1, (e - s)::bigint)) as content
  from parent join txt on parent.doc_id = txt.doc_id),
named as (select *, owner || ':' || chunk_index || ':' || substr(sha256(content), 1, 12) as chunk_id from parents where content <> ''),
small as (select doc_id, chunk_index as p, s, e from named where kind = 'text'), {_pieces("kid", "small", chunking.CHILD)},
every as (select chunk_id, chunk_index, kid.n, trim(substr(txt, kid.s + 1, kid.e - kid.s)) as c from kid join named on kid.doc_id = named.doc_id and kid.p = chunk_index
  union all select chunk_id, chunk_index, 0, content from named where kind = 'table'),
kids as (select *, chunk_id || ':sub:' || substr(sha256(c), 1, 12) as child_id from every where c <> ''),
once as (select chunk_id, child_id, min(n) as n from kids group by 1, 2),
listed as (select chunk_id, string_agg(child_id, ',' order by n) as child_ids from once group by 1)"""
#: Documents with a heading in every sixth line and a table row in every sixth, from the third on.
_DOCS = """docs as (select doc_id, string_agg(case k % 6 when 0 then '# ' || line when 3 then '| ' || line || ' |' else line end, chr(10) order by k) as text from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents) group by doc_id)"""
_PARENTS = _PARENTS.replace("with recursive ", f"with recursive {_DOCS}, ", 1)


def _spaced(t):
    owner = ids.source_doc_id(F.lit(0), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text"))
    return t("documents").select("doc_id", owner.alias("source_doc_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query(r"""with p as (select doc_id, trim(unnest(regexp_split_to_array(text, '\n')), ' ' || chr(9) || chr(13)) as p from documents)
select doc_id, count(*) as n, sum(length(p))::bigint as chars from p where p <> '' group by doc_id""")
def paragraph_split(t):
    """Paragraphs and how many characters they hold, however they are cut further."""
    rows = chunking.flat_chunks(_spaced(t), "doc_id", "text", overlap=0, most=10**9)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def _structured(t):
    mark = lambda x, k: F.when(k % 6 == 0, F.concat(F.lit("# "), x)).when(k % 6 == 3, F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    docs = t("documents").select("doc_id", text.alias("text"))
    return _spaced(lambda _: docs)


@query(_FLAT)
def flat_chunks(t):
    """C3, C4, C6, C8, C15, C16, C20"""
    return chunking.flat_chunks(_spaced(t), "source_doc_id", "text")


@query(_PARENTS + " select owner as doc_id, chunk_index::int as chunk_index, chunk_id, kind as chunk_type, content, coalesce(child_ids, '') as child_ids from named left join listed using (chunk_id)")
def parent_chunks(t):
    """Each parent with the list of its children."""
    parents, _ = chunking.parent_child_chunks(_structured(t), "source_doc_id", "text")
    return parents.withColumn("child_ids", F.array_join("child_ids", ","))


@query(_PARENTS + " select distinct chunk_id as parent_id, child_id, c as content from kids")
def child_chunks(t):
    """C18, R17"""
    return chunking.parent_child_chunks(_structured(t), "source_doc_id", "text")[1]


@query(f"""with recursive {_LINES}, {_pieces("unit", "spans", chunking.BATCH)},
units as (select doc_id, s, e, row_number() over (partition by doc_id order by p, n) as k from unit),
pack(doc_id, k, b, s, e) as (select doc_id, k, 0, s, e from units where k = 1 union all
  select u.doc_id, u.k, case when u.e - w.s <= {chunking.BATCH} then b else b + 1 end, case when u.e - w.s <= {chunking.BATCH} then w.s else u.s end, u.e
  from pack w join units u on u.doc_id = w.doc_id and u.k = w.k + 1),
found as (select doc_id, b, min(s) as s, max(e) as e from pack group by 1, 2),
ranked as (select *, max(b) over (partition by doc_id) as last from found),
joined as (select doc_id, case when b = last and b > 0 and e - s < {chunking.SHORT_TAIL} then b - 1 else b end as b, s, e from ranked)
select doc_id, b::int as batch, min(s)::int as start, max(e)::int as "end" from joined group by 1, 2""")
def batch_spans(t):
    """C11"""
    return chunking.batches(_spaced(t), "doc_id", "text")


@query(f"""with {_LINES}, n as (select doc_id, count(*) as many, max(e - s) as longest from spans group by 1)
select doc_id, coalesce(many, 0) = 0 or longest > 4000 as needs_model, coalesce(many, 0) = 0 or (many = 1 and longest > 2000) as unlimited from documents left join n using (doc_id)""")
def needs_model(t):
    """Whether paragraphs alone can't cut a document, with a limit of batches and without."""
    rows = _spaced(t)
    sizes = chunking.paragraph_sizes(F.col("text"))
    return rows.select("doc_id", chunking.needs_model(sizes, 4000).alias("needs_model"), chunking.needs_model(sizes, 0).alias("unlimited"))


@query("""select size, case when most > 0 then most else greatest(size + 400, (size * 1.5)::int) end as most from (select p_size * 40 as size, case when p_partkey % 3 = 0 then p_partkey else 0 end as most from part)""")
def chunk_size_cap(t):
    """C20"""
    size = F.col("p_size") * 40
    most = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey"))
    return t("part").select(size.alias("size"), chunking.longest(size, most).alias("most"))


@query(f"""with recursive {_LINES}, long as (select * from spans where e - s >= 60), {_pieces("piece", "long", 800)}
select p.doc_id, (row_number() over (partition by p.doc_id order by p, n) - 1)::int as position, substr(txt, s + 1, e - s) as excerpt from piece p join txt on p.doc_id = txt.doc_id""")
def excerpt_sample(t):
    """C27"""
    return chunking.excerpts(_spaced(t), "doc_id", "text")


@query("""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
cuts as (select doc_id, k, length(line) + coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as place,
  count(*) over (partition by doc_id) as many from lines),
total as (select doc_id, length(text) as len from documents),
edges as (select doc_id, 0 as place from total union select doc_id, place from cuts where k < many union select doc_id, len from total),
found as (select doc_id, place as s, lead(place) over (partition by doc_id order by place) as e from edges)
select f.doc_id, case when f.doc_id % 3 = 0 or many = 1 then 'strict' else 'aligned' end as mode, s::int as start, e::int as "end" from found f
join cuts c on c.doc_id = f.doc_id and k = 1 where f.doc_id % 3 < 2 and e > s""")
def marked_spans(t):
    """A model's marked text, plain, behind its thoughts with lost line ends, or another text altogether."""
    whole, lost = (F.array_join(F.split("text", "\n"), "<<<<CUT>>>>" + end) for end in ("\n", ""))
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("<think>no<<<<CUT>>>></think>"), lost, F.lit(" ")))
    rows = t("documents").withColumn("answer", answer.otherwise(F.concat(F.lit("lost<<<<CUT>>>>\n"), F.reverse("text"), F.lit("~"))))
    return chunking.marked_spans(rows, "doc_id", "text", "answer")


@query(f"""with recursive {_LINES}, {_pieces("unit", "spans", 180)}, units as (select doc_id, s, e, row_number() over (partition by doc_id order by p, n) as k from unit),
sizes as (select *, sum(e - s) over (partition by doc_id order by k) as total, count(*) over (partition by doc_id) as many from units),
step(doc_id, k, nxt) as (select doc_id, 1::bigint, (select min_by(u.k + 1, (abs(u.total - 800), u.k)) from sizes u where u.doc_id = w.doc_id and u.k between 1 and least(7, w.many - 1)) from sizes w where k = 1 union all
  select s.doc_id, s.nxt, (select min_by(u.k + 1, (abs(u.total - v.total + (v.e - v.s) - 800), u.k)) from sizes u where u.doc_id = s.doc_id and u.k between v.k and least(v.k + 6, v.many - 1))
  from step s join sizes v on v.doc_id = s.doc_id and v.k = s.nxt where s.nxt is not null),
found as (select step.doc_id, a.s, coalesce((select e from sizes u where u.doc_id = step.doc_id and u.k = step.nxt - 1), a.e) as e from step join sizes a on a.doc_id = step.doc_id and a.k = step.k)
select doc_id, s::int as start, e::int as "end" from found""")
def window_spans(t):
    """C14: breakpoints in windows of eight units, at the length nearest to the target where no model chooses."""
    return chunking.window_spans(_spaced(t), "doc_id", "text")


def _pages(t):
    """Pages of three tables each; some lines between tables are text, some say that the table goes on."""
    k = F.col("k")
    between = F.when(k % 4 == 0, F.concat(F.lit("said "), k.cast("string"))).when(k % 4 == 1, "(continued)").otherwise("")
    name = F.concat(F.lit("| name "), (F.expr("k div 5") % 2).cast("string"), F.lit(" | value |"))
    block = F.concat_ws("\n", name, F.lit("|---|---|"), F.concat(F.lit("| "), k.cast("string"), F.lit(" | x |")), between, F.lit(""))
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t"))
    pages = lines.groupBy("doc_id", F.expr("k div 3").alias("page")).agg(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))).alias("bs"))
    return pages.select("doc_id", "page", F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("text"))


@query(r"""with ks as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
raw as (select doc_id, k // 3 as page, k, i, case i when 0 then '| name ' || (k // 5 % 2) || ' | value |' when 1 then '|---|---|' when 2 then '| ' || k || ' | x |'
  when 3 then case k % 4 when 0 then 'said ' || k when 1 then '(continued)' else '' end else '' end as text from ks, range(5) r(i)),
l as (select *, row_number() over (partition by doc_id, page order by k, i) - 1 as line from raw),
goes as (select doc_id, k, k > 0 and k // 5 % 2 = (k - 1) // 5 % 2 and (k - 1) % 4 <> 0 as goes_on from ks)
select l.doc_id, page::int as page, line::int as line, text from l join goes g on g.doc_id = l.doc_id and g.k = l.k left join goes n on n.doc_id = l.doc_id and n.k = l.k + 1
where not (g.goes_on and i < 2) and not (i > 2 and coalesce(n.goes_on, false) and l.k % 4 <> 0) and not (i = 4 and l.k % 4 = 0 and coalesce(n.goes_on, false))""")
def stitched_tables(t):
    """Tables that go on after a page break lose their repeated headers; lines are rows."""
    return chunking.stitch_tables(_pages(t), "doc_id", "page", "text").select("doc_id", F.col("page").cast("int").alias("page"), "line", "text")
