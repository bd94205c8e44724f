"""Retrieval queries: similarity, BM25, fusion, diversity, thresholds, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import ids, retrieval
from inkwell.operators.text_index import index_of
from inkwell.operators.vector_index import vector_index_of
from inkwell.plans.base import Catalogue
from inkwell.session import checkpointed

catalogue = Catalogue()
query = catalogue.query

#: Vectors with ids divisible by this are the stated queries.
ASKED = 50
_NORM = "list_transform(embedding, lambda x: x::double)"
VECTOR_SQL = f"""
v as (select vec_id, {_NORM} as e from embeddings),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
vec as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (
  select q.vec_id as query_id, i.vec_id as item_id,
    round(list_sum(list_transform(list_zip(q.e, i.e), lambda p: p[1] * p[2])) / (q.norm * i.norm), 6) as score
  from n q join n i on q.vec_id <> i.vec_id where q.vec_id % {ASKED} = 0) qualify rank <= 15)"""
BM25_SQL = r"""
words as (select doc_id as item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark),
total as (select count(*) as n, avg(len(w)) as average from words),
postings as (select item_id, term, count(*) as tf, any_value(length) as length from
  (select item_id, len(w) as length, unnest(w) as term from words) where term in (select term from asked) group by item_id, term),
spread as (select term, count(*) as df from postings group by term),
bm as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (
  select query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) as score
  from postings join asked using (term) join spread using (term), total group by query_id, item_id) qualify rank <= 15)"""


def _vector_hits(t):
    v = t("embeddings")
    return retrieval.vector_topk(v.where(F.col("vec_id") % ASKED == 0), v, 15, "vec_id", "vec_id")


def _bm25_hits(t):
    """The stored index of documents is read, not their texts."""
    return index_of(t("documents"), "doc_id", "text").bm25(t("benchmark"), 15, "item_id", "text")


def _texted(hits, texts):
    """Hits with their texts: they are written first, so that their size is known and the texts are read where they lie, not dealt."""
    return texts.join(checkpointed(hits), "item_id")


@query(f"with {VECTOR_SQL} select query_id, item_id, score, rank::integer as rank from vec")
def vector_topk(t):
    return _vector_hits(t)


@query(f"with {VECTOR_SQL} select query_id, item_id, score, rank::integer as rank from vec")
def vector_index_topk(t):
    """The same rows from rings around centres, of which only those are read that may hold a neighbour."""
    v = t("embeddings")
    found, _ = vector_index_of(v.sparkSession, v, "vec_id").search(v.where(F.col("vec_id") % ASKED == 0), 15, "vec_id")
    return found


@query(f"with {BM25_SQL} select query_id, item_id, score, rank::integer as rank from bm")
def bm25_topk(t):
    return _bm25_hits(t)


#: Benchmark item i asks with its text and with vector i * ASKED; both channels name documents.
_CHANNELS = f"""
channels as (select query_id, 'bm25' as channel, item_id, rank from bm
  union all select query_id // {ASKED}, 'vector', item_id, rank from vec),
fused as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (
  select query_id, item_id, round(sum(1.0::double / (60 + rank)), 9) as score from
    (select query_id, channel, item_id, max(rank) as rank from channels group by all) group by query_id, item_id))"""


def _fused(t):
    text = _bm25_hits(t).select("query_id", F.lit("bm25").alias("channel"), "item_id", "rank")
    near = _vector_hits(t).select(F.expr(f"query_id div {ASKED}"), F.lit("vector"), "item_id", "rank")
    return retrieval.fuse(text.union(near), ["query_id"])


@query(f"with {VECTOR_SQL}, {BM25_SQL}, {_CHANNELS} select query_id, item_id, score, rank::integer as rank from fused where rank <= 12")
def rrf_two_channel(t):
    return _fused(t).where("rank <= 12")


_DIVERSE = """
placed as (select f.*, source, row_number() over (partition by query_id, source order by rank) as nth
  from fused f join documents d on f.item_id = d.doc_id where rank <= 12),
diverse as (select *, row_number() over (partition by query_id order by nth > 2, rank) as position from placed qualify position <= 6)"""


@query(
    f"with {VECTOR_SQL}, {BM25_SQL}, {_CHANNELS}, {_DIVERSE} "
    "select query_id, item_id, score, rank::integer as rank, source, position::integer as position from diverse"
)
def hybrid_retrieve(t):
    sources = t("documents").select(F.col("doc_id").alias("item_id"), "source")
    return retrieval.diversify(_fused(t).where("rank <= 12").join(sources, "item_id"), ["query_id"], "source")


@query(f"""with {BM25_SQL}, one as (select query_id % 5 as question, query_id as channel, item_id, rank from bm),
fused as (select question, item_id, round(sum(1.0::double / (60 + rank)), 9) as score from
  (select question, channel, item_id, max(rank) as rank from one group by all) group by question, item_id)
select *, (row_number() over (partition by question order by score desc, item_id))::integer as rank from fused qualify rank <= 12""")
def rrf_multi_query(t):
    """Items with one remainder are rewrites of one question; their rankings are fused again."""
    rankings = _bm25_hits(t).select((F.col("query_id") % 5).alias("question"), F.col("query_id").alias("channel"), "item_id", "rank")
    return retrieval.fuse(rankings, ["question"]).where("rank <= 12")


@query(f"""with {VECTOR_SQL} select query_id, item_id, score from
(select *, max(score) over (partition by query_id) as top from vec) where score >= least(0.35, top * 0.9)""")
def relative_threshold(t):
    return retrieval.above_threshold(_vector_hits(t), ["query_id"], 0.35, 0.9).select("query_id", "item_id", "score")


@query("""with hits as (select l_partkey % 50 as query_id, l_orderkey as parent, l_linenumber as child,
row_number() over (partition by l_partkey % 50 order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem)
select query_id, parent, child, rank::integer as rank from hits qualify row_number() over (partition by query_id, parent order by rank) = 1""")
def best_child_per_parent(t):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    hits = t("lineitem").withColumn("query_id", F.col("l_partkey") % 50).withColumn("rank", F.row_number().over(order))
    hits = hits.select("query_id", F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), "rank")
    return retrieval.best_child_per_parent(hits, ["query_id"], "parent")


@query(r"""with c as (select b.item_id as query_id, substr(b.text, 1, 200) as q, bm.item_id, d.text, bm.rank from (
with """ + BM25_SQL + r""" select * from bm) bm join benchmark b on b.item_id = bm.query_id join documents d on d.doc_id = bm.item_id),
s as (select query_id, item_id, rank, list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{N}]+')) as qt,
  regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as dt from c),
r as (select query_id, item_id, rank, round(len(list_filter(qt, lambda x: list_contains(dt, x))) / len(qt), 6) as rerank_score from s)
select query_id, item_id, rerank_score, (row_number() over (partition by query_id order by rerank_score desc, rank))::integer as position
from r qualify position <= 6""")
def rerank_overlap(t):
    texts = t("documents").select(F.col("doc_id").alias("item_id"), "text")
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = _texted(_bm25_hits(t), texts).join(asked, "query_id")
    return retrieval.rerank(found, ["query_id"], "question", "text", 6).select("query_id", "item_id", "rerank_score", "position")


_PHRASE = r"""with p as (select item_id as phrase_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
d as (select doc_id as item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents),
words as (select item_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from d),
parts as (select phrase_id, len(w) as width, unnest(w) as term, generate_subscripts(w, 1) - 1 as slot from p where len(w) > 0),
hits as (select phrase_id, item_id, width, slot, unnest(generate_series(pos - slot - SLOP, pos - slot)) as start from words join parts using (term)),
whole as (select phrase_id, item_id, start from hits group by phrase_id, item_id, width, start having count(distinct slot) = width)
select phrase_id, item_id, count(*) as n from whole group by all"""


@query(_PHRASE.replace("SLOP", "0"))
def phrase_exact(t):
    return index_of(t("documents"), "doc_id", "text").phrases(t("benchmark"), "item_id", "text")


@query(_PHRASE.replace("SLOP", "2"))
def phrase_slop(t):
    return index_of(t("documents"), "doc_id", "text").phrases(t("benchmark"), "item_id", "text", slop=2)


@query(f"""with {BM25_SQL}, hits as (select query_id from bm where score >= 40 group by 1)
select item_id as query_id, h.query_id is not null as sufficient,
case when h.query_id is null then 'no evidence was found' else '' end as missing from benchmark left join hits h on h.query_id = item_id""")
def evidence_gate(t):
    asked = t("benchmark").select(F.col("item_id").alias("query_id"))
    hits = _bm25_hits(t).where("score >= 40")
    return retrieval.evidence_gate(asked, hits, hits.select("query_id").where("false"))


@query(f"""with {BM25_SQL} select query_id,
string_agg('[' || item_id || '] ' || printf('%.4f', score) || chr(10) || text, chr(10) || chr(10) order by rank) as observation,
string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as citations
from bm join documents d on d.doc_id = item_id where rank <= 3 group by query_id""")
def observation_text(t):
    texts = t("documents").select(F.col("doc_id").alias("item_id"), "text")
    return retrieval.observation(_texted(_bm25_hits(t).where("rank <= 3"), texts), ["query_id"], "item_id", "text", "score")


@query("""with q as (select item_id as query_id, substr(text, 1, 8 + (item_id % 8)::int) as text from benchmark)
select query_id, length(text) between 1 and 12 and not regexp_matches(text, 'why|how|compare') as simple,
length(text) <= 16 and regexp_matches(text, '^(hi|hello|thanks)[ .!]*$') as chitchat from q""")
def simple_queries(t):
    text = F.expr("substring(text, 1, cast(8 + item_id % 8 as int))")
    q = t("benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))
    return q.select(
        "query_id",
        retrieval.is_simple(F.col("text"), ["why", "how", "compare"]).alias("simple"),
        ((F.length("text") <= 16) & F.col("text").rlike("^(hi|hello|thanks)[ .!]*$")).alias("chitchat"),
    )


@query("""with q as (select item_id as query_id, text, item_id % 4 = 0 as simple from benchmark),
rw as (select query_id, p as position, reverse(substr(text, 1, 5 * (p % 3 + 1)::int)) as text from q, range(1, 7) r(p)),
first as (select query_id, text, min(position) as position from rw group by 1, 2),
more as (select f.query_id, row_number() over (partition by f.query_id order by position) as spec, f.text from first f
  join q using (query_id) where not simple and f.text <> q.text and trim(f.text) <> '' qualify spec <= 4)
select query_id, 0 as spec, text, false as vector_only from q union all select query_id, spec::integer, text, false from more
union all select query_id, 5, substr(text || ' ' || text, 1, 1500), true from q where not simple""")
def query_specs(t):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    rewrites = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("position"), "text")
    rewrites = rewrites.withColumn("text", F.expr("reverse(substring(text, 1, 5 * (position % 3 + 1)))"))
    answers = q.select("query_id", F.concat_ws(" ", "text", "text").alias("text"))
    return retrieval.query_specs(q, rewrites, answers, F.col("query_id") % 4 == 0)


@query("""select doc_id, '0:' || 'doc_' || source || '_' || doc_id || ':' || substr(sha256(text), 1, 16) as source_doc_id from documents""")
def doc_ids(t):
    name = F.concat(F.lit("doc "), "source", F.lit(" "), F.col("doc_id").cast("string"))
    return t("documents").select("doc_id", ids.source_doc_id(F.lit(0), name, F.col("text")).alias("source_doc_id"))


@query("""with c as (select doc_id, '0:d' || doc_id || ':' || substr(sha256(text), 1, 16) as source_doc_id,
unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as chunk_index from documents)
select doc_id, chunk_index::integer as chunk_index, source_doc_id || ':' || chunk_index || ':' || substr(sha256(line), 1, 12) as chunk_id,
source_doc_id || ':' || chunk_index || ':' || substr(sha256(line), 1, 12) || ':sub:' || substr(sha256(line), 1, 12) as child_id from c""")
def chunk_ids(t):
    owner = ids.source_doc_id(F.lit(0), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text"))
    lines = t("documents").select("doc_id", owner.alias("owner"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    lines = lines.withColumn("chunk_id", ids.chunk_id(F.col("owner"), F.col("chunk_index"), F.col("line")))
    return lines.select("doc_id", "chunk_index", "chunk_id", ids.child_id(F.col("chunk_id"), F.col("line")).alias("child_id"))


@query("""select doc_id, lower(full_hash) = lower(known) or (length(known) = 16 and starts_with(lower(full_hash), lower(known))) as same from (
select doc_id, sha256(text) as full_hash, case doc_id % 3 when 0 then upper(sha256(text)) when 1 then upper(substr(sha256(text), 1, 16))
else substr(sha256(text), 1, 15) end as known from documents)""")
def hash_guard(t):
    h = F.sha2("text", 256)
    part = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, F.upper(F.substring(h, 1, 16)))
    return t("documents").select("doc_id", ids.same_content(h, part.otherwise(F.substring(h, 1, 15))).alias("same"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
p as (select a.vec_id as a, b.vec_id as b, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm), 6) as score
from n a join n b on a.vec_id < b.vec_id) select * from p where score >= 0.8""")
def similar_pairs(t):
    """J17"""
    return retrieval.all_pairs(*retrieval.similar_pairs(t("embeddings"), "vec_id", 0.8))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
turned as (select vec_id, e, e[2:] || e[:1] as f from v),
p as (select vec_id as a, vec_id + 1000000 as b,
  list_sum(list_transform(list_zip(e, f), lambda x: x[1] * (x[1] + 0.25 * x[2]))) as d, list_sum(list_transform(e, lambda x: x * x)) as ee,
  list_sum(list_transform(list_zip(e, f), lambda x: (x[1] + 0.25 * x[2]) * (x[1] + 0.25 * x[2]))) as ff from turned)
select a, b, round(d / sqrt(ee * ff), 6) as score from p where round(d / sqrt(ee * ff), 6) >= 0.9""")
def near_copies(t):
    """Every vector and a copy of it that a quarter of its own turned coordinates blurs; each copy is looked up among the links."""
    v = t("embeddings").select((F.col("vec_id") * 2).alias("item"), F.col("embedding").cast("array<double>").alias("embedding"))
    turned = F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", 1, 1))
    blurred = F.zip_with("embedding", turned, lambda x, y: x + 0.25 * y)
    both = v.union(v.select(F.col("item") + 1, blurred))
    found = retrieval.linked(v.select(F.col("item").alias("a"), (F.col("item") + 1).alias("b")), *retrieval.similar_pairs(both, "item", 0.9))
    return found.select(F.expr("a div 2").alias("a"), (F.expr("a div 2") + 1_000_000).alias("b"), "score")


@query(f"""with {VECTOR_SQL}, hits as (select query_id, item_id, score from vec where rank <= 8) select h.* from hits h join embeddings e on e.vec_id = item_id
where score >= 0.3 and label < 5""")
def card_search(t):
    """The limit comes before the threshold, the filter on the kind of card last."""
    kinds = t("embeddings").where("label < 5").select(F.col("vec_id").alias("item_id"))
    hits = retrieval.above_threshold(_vector_hits(t).where("rank <= 8"), ["query_id"], 0.3)
    return hits.join(kinds, "item_id").select("query_id", "item_id", "score")


@query("""with l as (select c_nationkey as q, 0 as list, c_custkey as position, c_mktsegment as text from customer union all
select s_nationkey, 1, s_suppkey, s_name from supplier union all select n_nationkey, 2, 1, 'BUILDING' from nation)
select q, text, row_number() over (partition by q order by list, position, text)::integer as place from
(select q, text, list, position from l qualify row_number() over (partition by q, text order by list, position) = 1)""")
def card_union(t):
    """T1, T3, T4"""
    one = t("customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("text"))
    two = t("supplier").select(F.col("s_nationkey").alias("q"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("text"))
    three = t("nation").select(F.col("n_nationkey").alias("q"), F.lit(1).cast("long").alias("position"), F.lit("BUILDING").alias("text"))
    return retrieval.card_union([one, two, three], "q", "text")


@query("""with once as (select p_type as text, min((p_brand, p_partkey)) as f from part group by 1),
turn as (select text, f[1] as p_brand, f[2] as p_partkey, row_number() over (partition by f[1] order by f[2])::integer as turn from once)
select text as p_type, p_brand, p_partkey, turn from turn order by turn, p_brand limit 40""")
def round_robin_questions(t):
    """Distinct texts in turn from each source, up to a total."""
    return retrieval.round_robin(t("part"), "p_brand", "p_type", "p_partkey", 40)


#: The kinds of files that may be uploaded, as the users of the knowledge base know them.
_KINDS = "txt text md markdown pdf docx csv json log xml html htm"


@query(f"""with k as (select string_split('{_KINDS} doc xls xlsx pptx exe Html PDF', ' ') as kinds),
n as (select doc_id, case doc_id % 5 when 1 then '../' when 2 then 'a' || chr(92) when 3 then 'b/' else '' end || source || '.' || kinds[1 + doc_id // 5 % len(kinds)] as name from documents, k)
select doc_id, name, doc_id % 5 in (0, 4) and lower(string_split(name, '.')[-1]) in (select unnest(string_split('{_KINDS}', ' '))) as allowed from n""")
def upload_whitelist(t):
    """Known kinds in either case, and no folders in the name."""
    from inkwell.sources.files import may_upload

    kinds = [*_KINDS.split(), "doc", "xls", "xlsx", "pptx", "exe", "Html", "PDF"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.expr("doc_id div 5") % len(kinds)).cast("int"))
    folder = F.get(F.array(*map(F.lit, ("", "../", "a\\", "b/", ""))), (F.col("doc_id") % 5).cast("int"))
    names = t("documents").select("doc_id", F.concat(folder, "source", F.lit("."), kind).alias("name"))
    return names.select("doc_id", "name", may_upload(F.col("name")).alias("allowed"))


_SLOPPY = _PHRASE.replace("words as", "standing as").replace("from words", "from standing").split("hits as")[0].replace("with p as", "p as", 1)


@query(f"""with {BM25_SQL.replace("qualify rank <= 15", "")}, {_SLOPPY}
moved as (select distinct phrase_id as query_id, item_id, width, slot, pos - slot as x from standing join parts using (term)),
begins as (select distinct query_id, item_id, width, x as s from moved),
ends as (select b.query_id, b.item_id, b.width, s, m.slot, min(x) as x from begins b join moved m on m.query_id = b.query_id and m.item_id = b.item_id
  and x between s and s + 2 group by all),
spans as (select query_id, item_id, s, max(x) as e from ends group by query_id, item_id, width, s having count(*) = width),
closest as (select query_id, item_id, e, max(s) as s from spans group by all),
places as (select query_id, item_id, sum(1.0::double / (1 + e - s)) as places from closest group by all),
clause as (select query_id, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) as weight, max(length) as length,
  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) as terms
  from postings join asked using (term) join spread using (term), total group by query_id, item_id),
whole_weight as (select query_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) as weight from asked join spread using (term), total group by 1),
summed as (select query_id, item_id, round(round(terms, 6) + coalesce(2 * w.weight * places * 2.2 / (places + 1.2 * (0.25 + 0.75 * length / average)), 0), 6) as score
  from clause join whole_weight w using (query_id) left join places using (query_id, item_id), total)
select query_id, item_id, score, (row_number() over (partition by query_id order by score desc, item_id))::integer as rank from summed qualify rank <= 15""")
def text_search(t):
    """R2 with its phrase clause, whose frequency falls with the distance of the words."""
    return index_of(t("documents"), "doc_id", "text").search(t("benchmark"), 15, "item_id", "text")


@query("""with w as (select c_custkey, '数据' || substr('库表行列值', 1, 1 + (c_custkey % 5)::int) || ' ' || c_name as s from customer),
h as (select c_custkey, regexp_extract_all(s, '[\\p{Han}]+')[1] as han, regexp_extract_all(lower(s), '[a-z0-9]+') as latin from w)
select c_custkey, array_to_string(list_concat(list_transform(generate_series(1, length(han) - 1), lambda i: substr(han, i, 2)), latin), ' ') as tokens from h""".replace("\\\\", "\\"))
def han_bigrams(t):
    """Runs of Han characters become pairs of neighbours."""
    han = F.expr("substring('库表行列值', 1, cast(1 + c_custkey % 5 as int))")
    s = F.concat(F.lit("数据"), han, F.lit(" "), "c_name")
    return t("customer").select("c_custkey", F.array_join(retrieval.tokens(s), " ").alias("tokens"))


_SPECS = """specs as (select *, query_id * 64 + spec as key from (
  select item_id as query_id, 0 as spec, text, false as vector_only from benchmark
  union all select query_id, row_number() over (partition by query_id order by position), text, false from (
    select item_id as query_id, substr(text, 1 + 12 * min(p), 80) as text, min(p) as position from benchmark, range(1, 4) r(p)
    where item_id % 4 <> 0 and substr(text, 1 + 12 * p, 80) <> text and trim(substr(text, 1 + 12 * p, 80)) <> '' group by item_id, text, substr(text, 1 + 12 * p, 80))
  union all select item_id, 5, substr(text || ' ' || text, 1, 1500), true from benchmark where item_id % 4 <> 0 and trim(text) <> '')),
chunks as (select doc_id as item_id, text, source, list_transform(embedding, lambda x: x::double) as e from documents left join embeddings on doc_id = vec_id),
c as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from chunks where e is not null),
q as (select key, list_transform(embedding, lambda x: x::double) as e from specs join embeddings on vec_id = query_id * 50 + spec),
qn as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from q),
raw as (select key, item_id, score, row_number() over (partition by key order by score desc, item_id) as rank from (
  select key, item_id, round(list_sum(list_transform(list_zip(qn.e, c.e), lambda p: p[1] * p[2])) / (qn.norm * c.norm), 6) as score from qn, c) qualify rank <= 15),
best as (select key // 64 as query_id, max(score) as max_score from raw group by 1),
near as (select key, item_id, rank from (select *, max(score) over (partition by key) as top from raw) where score >= least(0.35, top * 0.9)),
words as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from chunks),
asked as (select distinct key, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from specs where not vector_only),
total as (select count(*) as n, avg(len(w)) as average from words),
postings as (select item_id, term, count(*) as tf, any_value(length) as length from
  (select item_id, len(w) as length, unnest(w) as term from words) where term in (select term from asked) group by item_id, term),
spread as (select term, count(*) as df from postings group by term),
bm as (select key, item_id, row_number() over (partition by key order by score desc, item_id) as rank from (
  select key, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) as score
  from postings join asked using (term) join spread using (term), total group by key, item_id) qualify rank <= 15),
one as (select key, item_id, row_number() over (partition by key order by score desc, item_id) as rank from (
  select key, item_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from near union all select * from bm) group by key, item_id)),
fused as (select query_id, item_id, row_number() over (partition by query_id order by score desc, item_id) as rank from (
  select key // 64 as query_id, item_id, round(sum(1.0::double / (60 + rank)), 9) as score from one group by 1, 2) qualify rank <= 12),
cand as (select query_id, item_id, rank, text, source from fused join chunks using (item_id)),
sc as (select c.query_id, s.spec, item_id, rank, list_distinct(regexp_extract_all(lower(substr(s.text, 1, 200)), '[\\p{L}\\p{N}]+')) as qt,
  regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}]+') as dt from cand c join specs s using (query_id)),
rr as (select query_id, spec, item_id, row_number() over (partition by query_id, spec order by s desc, rank) as rank from (
  select *, case when len(qt) = 0 then 0 else round(len(list_filter(qt, lambda x: list_contains(dt, x))) / len(qt), 6) end as s from sc)),
again as (select query_id, item_id, row_number() over (partition by query_id order by score desc, item_id) as rank from (
  select query_id, item_id, round(sum(1.0::double / (60 + rank)), 9) as score from rr group by 1, 2)),
nth as (select a.query_id, a.item_id, a.rank, row_number() over (partition by a.query_id, source order by a.rank) as nth
  from again a join cand using (query_id, item_id)),
final as (select query_id, item_id, row_number() over (partition by query_id order by nth > 2, rank) as position from nth qualify position <= 6)
select query_id, item_id, position::integer as position, coalesce(max_score, 0) as max_score from final left join best using (query_id)""".replace("\\\\", "\\")


def _context(t, parents: bool):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    rewrites = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position"), "text")
    rewrites = rewrites.withColumn("text", F.expr("substring(text, 1 + 12 * position, 80)"))
    answers = q.select("query_id", F.concat_ws(" ", "text", "text").alias("text"))
    specs = retrieval.query_specs(q, rewrites, answers, F.col("query_id") % 4 == 0)
    vectors = t("embeddings").select("vec_id", "embedding")
    specs = specs.join(vectors, F.col("query_id") * ASKED + F.col("spec") == F.col("vec_id"), "left").drop("vec_id")
    chunks = t("documents").join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("item_id"), "text", "source", "embedding")
    if parents:
        up = F.expr("item_id div 4 * 4")
        chunks = chunks.select("*", F.when(F.col("item_id") == up, "parent").otherwise("child").alias("chunk_type"), up.alias("parent"))
    return retrieval.search_context(specs, chunks, parents=parents, index=index_of(t("documents"), "doc_id", "text"))


@query("with " + _SPECS)
def search_context(t):
    """Specs, both channels, two fusions, reranking by every spec and its fusion, spread sources, best cosine."""
    return _context(t, False)


_MAPPED = """raw as (select key, item_id, score, row_number() over (partition by key order by score desc, item_id) as rank from (
  select key, item_id // 4 * 4 as item_id, max(score) as score from hits where item_id // 4 * 4 in (select doc_id from documents) group by 1, 2)),
best as"""


@query("with " + _SPECS.replace("raw as (", "hits as (", 1).replace("best as", _MAPPED, 1))
def search_context_parents(t):
    """The same where vectors find children, which give way to their parents (every fourth document)."""
    return _context(t, True)


@query("""with e as (select c_custkey, 'c' || c_custkey as head, n_name as tail, 'lives in' as relation, c_mktsegment as hint from customer join nation on c_nationkey = n_nationkey),
seeds as (select s_suppkey % 40 as query_id, s_suppkey as position, n_name as name from supplier join nation on s_nationkey = n_nationkey),
firsts as (select query_id, name, min(position) as position from seeds group by 1, 2),
own as (select query_id, 0 as list, position, '- 【实体】' || name || '：region ' || n_regionkey as card from firsts join nation on name = n_name),
loc as (select query_id, head, relation, tail, min(position) as position, min(hint) as hint from firsts join e on tail = name group by all),
local as (select query_id, 1, row_number() over (partition by query_id order by position, head, relation, tail), '- 【关系】' || head || ' —[' || relation || ']→ ' || tail || '：' || hint from loc),
rel as (select r_regionkey * 8 + p as query_id, 2, p as position, '- 【关系】' || r_name from region, range(0, 8) x(p)),
whole as (select * from own union all select * from local union all select * from rel),
first as (select query_id, card, min((list, position)) as f from whole group by 1, 2),
s as (select query_id, card, f, list_distinct(regexp_extract_all(lower('machinery in ' || (query_id % 25)), '[\\p{L}\\p{N}]+')) as q, regexp_extract_all(lower(card), '[a-z0-9]+') as w from first)
select query_id, card, (row_number() over (partition by query_id order by round(len(list_filter(q, lambda x: list_contains(w, x))) / len(q), 6) desc, f, card))::integer as position
from s where query_id < 40 qualify position <= 8""".replace("\\\\", "\\"))
def dual_path_search(t):
    """Entity seeds with their edges, and relation cards, reranked as one pool."""
    names = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    edges = t("customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = edges.select(F.concat(F.lit("c"), "c_custkey").alias("head"), F.lit("lives in").alias("relation"), F.col("n_name").alias("tail"), F.col("c_mktsegment").alias("hint"))
    seeds = t("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    seeds = seeds.groupBy((F.col("s_suppkey") % 40).alias("query_id"), F.col("n_name").alias("name")).agg(F.min("s_suppkey").alias("position"))
    rel = t("region").select((F.col("r_regionkey") * 8).alias("k"), F.concat(F.lit("- 【关系】"), "r_name").alias("card"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("position"))
    rel = rel.select((F.col("k") + F.col("position")).alias("query_id"), "position", "card")
    asked = seeds.select("query_id").union(rel.select("query_id")).distinct().where("query_id < 40")
    asked = asked.select("query_id", F.concat(F.lit("machinery in "), (F.col("query_id") % 25).cast("string")).alias("text"))
    told = names.select(F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("summary"))
    return retrieval.dual_path(asked, seeds, rel, edges, told)


@query(f"""with {BM25_SQL.replace("qualify rank <= 15", "")},
fits as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank, count(*) over (partition by query_id) as total
  from bm join documents on doc_id = item_id where source = (select min(source) from documents))
select query_id, item_id, score, rank::integer as rank, total from fits where rank > 15 and rank <= 30""")
def keyword_list(t):
    """The second page of the documents of one source that match, by score, then by index, and how many there are."""
    first = t("documents").agg(F.min("source").alias("source"))
    allowed = t("documents").join(F.broadcast(first), "source").select(F.col("doc_id").alias("item_id"))  # one row
    return index_of(t("documents"), "doc_id", "text").listed(t("benchmark"), "item_id", "text", allowed, 2, 15)


@query(f"""with {VECTOR_SQL}, best as (select query_id, max(score) as s from vec group by 1)
select item_id as query_id, coalesce(s, 0) as max_score from benchmark left join best on query_id = item_id""")
def max_scores(t):
    """The best cosine of a question, 0 without hits."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"))
    return retrieval.max_scores(asked, _vector_hits(t))


@query("""with h as (select l_partkey % 50 as query_id, l_orderkey * 8 + l_linenumber as item_id, l_extendedprice as score from lineitem),
m as (select query_id, case when item_id % 8 = 0 then item_id else item_id // 8 * 8 end as up, score from h where item_id % 8 = 0 or item_id // 8 % 3 <> 0),
b as (select query_id, up as item_id, max(score) as score from m group by 1, 2)
select query_id, item_id, score, (row_number() over (partition by query_id order by score desc, item_id))::integer as rank from b""")
def parent_mapping(t):
    """Children give way to their parents; hits without a known parent go."""
    hits = t("lineitem").select(
        (F.col("l_partkey") % 50).alias("query_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"), F.col("l_extendedprice").alias("score")
    )
    up = F.expr("item_id div 8 * 8")
    kids = hits.select("item_id").distinct().select("item_id", F.when(F.col("item_id") % 8 == 0, "parent").otherwise("child").alias("chunk_type"), up.alias("parent"))
    parents = hits.select(up.alias("item_id")).distinct().where("item_id div 8 % 3 != 0 or item_id in (-1)")
    extra = parents.join(kids.where("chunk_type = 'parent'").select("item_id"), "item_id", "left_anti")
    chunks = kids.union(extra.select("item_id", F.lit("parent"), F.lit(None).cast("long")))
    return retrieval.to_parents(hits, ["query_id"], chunks)
