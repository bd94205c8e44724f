"""Graph queries over edges that are derived from the star schema.

Customers and nations are entities; an order is an edge customer -[status]-> nation that chunk
``c<order>`` bears out; suppliers give edges nation -[supplied_by]-> supplier.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import graph as G
from inkwell.operators import relational as R
from inkwell.operators.ids import container
from inkwell.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_RAW = """raw as (select c_name as head, o_orderstatus as relation, n_name as tail, o_orderkey as seq, 'c' || o_orderkey as chunk_id, o_orderpriority as hint
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey union all
select n_name, 'supplied_by', s_name, s_suppkey, 's' || s_suppkey, 'supply' from supplier join nation on s_nationkey = n_nationkey)"""
_EDGES = _RAW + """, edges as (select head, relation, tail, string_agg(chunk_id, ',' order by seq, chunk_id) as chunk_ids from raw group by 1, 2, 3)"""


def _raw(t):
    c, n = t("customer"), t("nation")
    orders = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.select(
        F.col("c_name").alias("head"), F.col("o_orderstatus").alias("relation"), F.col("n_name").alias("tail"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.col("o_orderpriority").alias("hint"),
    )
    supply = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return orders.union(
        supply.select("n_name", F.lit("supplied_by"), "s_name", "s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("supply"))
    )


def _edges(t):
    return G.merge_triples(_raw(t).withColumnRenamed("chunk_id", "chunk_ids"), ["seq"], ["chunk_ids"], [])


@query(f"with {_EDGES} select * from edges")
def merge_edges(t):
    """G3, K4, A10"""
    return _edges(t).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("""select o_custkey, string_agg(hint, '；' order by first) as summary from (select o_custkey, o_orderpriority as hint, min(o_orderkey) as first
from orders group by 1, 2) group by 1""")
def edge_hint_merge(t):
    """None of the five hints holds another, so all of them are joined."""
    rows = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("hint"))
    return rows.groupBy("o_custkey").agg(G.joined_all(G.first_seen("hint", ["o_orderkey"]), 400).alias("summary"))


@query(f"""with {_EDGES}, ends as (select head as name, 1 as o, 0 as i from edges union all select tail, 0, 1 from edges union all select r_name, 0, 0 from region)
select name, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from ends group by 1""")
def degree_stats(t):
    """Regions have no edges and count 0."""
    return G.degrees(_edges(t), t("region").select(F.col("r_name").alias("name")))


@query(f"""with {_EDGES}, ends as (select head as name from edges union all select tail from edges)
select name, count(*) as degree from ends group by 1 order by degree desc, name limit 10""")
def graph_top_entities(t):
    """A8, O6"""
    return G.top_entities(_edges(t), 10)


@query(f"with {_EDGES} select count(*) as edges, (select count(*) from (select head from edges union select tail from edges)) as entities from edges")
def graph_counts(t):
    """A8, T5, G10"""
    edges = _edges(t)
    return edges.agg(F.count("*").alias("edges")).crossJoin(G.nodes_of(edges).agg(F.count("*").alias("entities")))


_BOTH = "both_ways as (select head as a, tail as b from edges union select tail, head from edges)"


@query(f"""with recursive {_EDGES}, {_BOTH}, seed as (select min(head) as name from edges where relation = 'O'),
walk(name, hop) as (select name, 0 from seed union select b, hop + 1 from walk join both_ways on a = name where hop < 2),
near as (select name, min(hop) as hop from walk group by 1)
select min(hop) + 1 as hop, head, relation, tail from edges join near on name in (head, tail) where hop < 3 group by head, relation, tail order by 1, 2, 3, 4 limit 500""")
def khop_edges(t):
    """Three hops around one customer, the first 500 edges by hop and key."""
    edges = _edges(t)
    seed = edges.where("relation = 'O'").agg(F.min("head").alias("name"))
    return G.expand(edges, seed, 3)


_PATHS = f"""{_EDGES}, fit as (select distinct head, relation, tail, head || '|' || relation || '|' || tail as key from edges where contains(relation, 'F') or contains(relation, 'supp')),
steps as (select head as a, tail as b, key from fit union all select tail, head, key from fit where head <> tail),
seeds as (select min(head) as name from edges where relation = 'F' union select min(n_name) from nation),
p(hop, seed, fin, keys) as (select 0, name, name, []::varchar[] from seeds
  union all select hop + 1, seed, b, list_append(keys, key) from p join steps on a = fin where hop < 3 and not list_contains(keys, key)),
first_paths as (select hop, seed, array_to_string(keys, '>') as path, keys from p where hop > 0 order by hop, path, seed limit 60)"""


def _paths(t):
    edges = _edges(t)
    first = edges.where("relation = 'F'").agg(F.min("head").alias("name")).union(t("nation").agg(F.min("n_name")))
    return edges, G.paths(edges, first, 3, ["F", "supp"], most=60)


@query(f"with recursive {_PATHS} select hop, seed, path from first_paths")
def hinted_paths(t):
    """Paths of up to three edges, none twice, each of which bears a hint; the first 60."""
    return _paths(t)[1].select("hop", "seed", "path")


@query(f"with recursive {_PATHS} select head, relation, tail, chunk_ids from edges where head || '|' || relation || '|' || tail in (select unnest(keys) from first_paths)")
def path_subgraph(t):
    """The edges on the first 60 paths, with their chunks."""
    edges, found = _paths(t)
    return G.edges_on_paths(edges, found).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"with {_EDGES} select head, relation, tail from edges where list_has_any(string_split(chunk_ids, ','), ['c5', 'c10', 's3', 's4', 'c100'])")
def chunk_anchor_edges(t):
    """G6, P12"""
    return G.anchored(_edges(t), ["c5", "c10", "s3", "s4", "c100"]).select(*G.KEY)


@query(f"""with {_RAW} select distinct head, relation, tail from raw where contains(relation, 'supp') or contains(hint, 'supp') or contains('supp', hint)""")
def relation_hint(t):
    """G8, P15"""
    return G.by_hint(_raw(t).withColumnRenamed("hint", "category"), "supp").select(*G.KEY).distinct()


@query(f"""with {_EDGES}, n as (select head as name from edges union select tail from edges), w as (select distinct n_name as word from nation
union select distinct substr(s_name, 1, 17) from supplier)
select word, name from w join n on word = name union select word, name from w join n on contains(name, word) or contains(word, name)
where word not in (select word from w join n on word = name)""")
def entity_resolve(t):
    """Exact names first, parts of names for words that have none."""
    words = t("nation").select(F.col("n_name").alias("word"))
    words = words.union(t("supplier").select(F.substring("s_name", 1, 17))).distinct()
    return G.resolve(words, G.nodes_of(_edges(t)))


@query(f"""with {_EDGES}, left_over as (select head, relation, tail, list_filter(string_split(chunk_ids, ','), lambda x: not starts_with(x, 'c1')) as c from edges)
select head, relation, tail, array_to_string(c, ',') as chunk_ids from left_over where len(c) > 0""")
def prefix_purge(t):
    """G16, P13"""
    return G.purge(_edges(t), lambda x: x.startswith("c1")).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"""with {_EDGES}, n as (select head as name from edges union select tail from edges),
kept as (select * from edges where len(list_filter(string_split(chunk_ids, ','), lambda x: x not in ('s1', 's2', 's3', 'c5', 'c10'))) > 0)
select name from n where name not in (select head from kept union select tail from kept)""")
def id_purge_orphans(t):
    """G17, K8"""
    edges = _edges(t)
    return G.orphans(G.nodes_of(edges), G.purge(edges, lambda x: x.isin("s1", "s2", "s3", "c5", "c10")))


@query(f"""with {_RAW}, moved as (select case when head like 'Customer%' then 'C' || right(head, 1) else head end as head, relation,
case when tail like 'Supplier%' then 'S' || right(tail, 1) else tail end as tail, chunk_id from raw)
select head, relation, tail, count(distinct chunk_id) as chunks from moved group by 1, 2, 3""")
def rename_entities(t):
    """Edges that fall together keep the chunks of all."""
    edges = _edges(t)
    names = G.nodes_of(edges).where("name like 'Customer%' or name like 'Supplier%'")
    names = names.select(F.col("name").alias("old"), F.concat(F.substring("name", 1, 1), F.expr("right(name, 1)")).alias("new"))
    moved = G.rename(edges, names, ["chunk_ids"])
    return moved.select(*G.KEY, F.size("chunk_ids").cast("long").alias("chunks"))


@query(f"with {_EDGES}, gone as (select n_name from nation where n_regionkey = 1) select head, relation, tail from edges where head not in (select * from gone) and tail not in (select * from gone)")
def detach_delete(t):
    """G12, K23"""
    gone = t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"))
    edges = _edges(t)
    edges = edges.join(gone, F.col("head") == F.col("name"), "left_anti")
    return edges.join(gone, F.col("tail") == F.col("name"), "left_anti").select(*G.KEY)


@query(f"""with {_EDGES}, ends as (select head as name, relation from edges union all select tail, relation from edges),
r as (select name, relation, row_number() over (partition by name order by count(*) desc, relation) as k from ends group by 1, 2 qualify k <= 5),
l as (select name, string_agg(relation, ', ' order by k) as rels from r group by 1)
select name, coalesce(s_name || ' hint', '') as summary, name || chr(10) || rels || chr(10) || coalesce(s_name || ' hint', '') as vector_text
from l left join supplier on s_name = name""")
def entity_cards(t):
    """G19, G24"""
    hint = F.concat(F.col("s_name"), F.lit(" hint"))
    rows = t("supplier").select(F.col("s_name").alias("name"), F.explode(F.array(F.struct(F.lit(1).alias("position"), hint.alias("hint")), F.struct(F.lit(2).alias("position"), F.lit("hint").alias("hint")))).alias("h"))
    return G.entity_cards(_edges(t), rows.select("name", "h.position", "h.hint"))


@query(f"""with {_EDGES} select head || ' -[' || relation || ']-> ' || tail || ': ' || array_to_string(list_slice(string_split(chunk_ids, ','), 1, 3), '；') as line from edges""")
def edge_lines(t):
    """G23"""
    edges = _edges(t).withColumnRenamed("chunk_ids", "evidence")
    return edges.select(G.edge_text(edges).alias("line"))


@query("""select c_custkey as name, least(greatest(c_custkey % 7 - 1, 0), 3) as done, 3 - least(greatest(c_custkey % 7 - 1, 0), 3) as left_over from customer
where least(greatest(c_custkey % 7 - 1, 0), 3) < 3""")
def pending_hint_cursor(t):
    """G20, G22, M7"""
    hints = F.array(*map(F.lit, "abc"))
    cards = t("customer").select(F.col("c_custkey").alias("name"), hints.alias("hints"), (F.col("c_custkey") % 7 - 1).cast("int").alias("merged"))
    size = F.size("pending").cast("long")
    return G.pending_hints(cards).select("name", (3 - size).alias("done"), size.alias("left_over"))


@query(r"""select item_id, position::integer as position, head, relation, tail, evidence from (select item_id, 0 as position, 'Item ' || item_id as head, 'in' as relation,
'Set' as tail, trim(text) as evidence from (select item_id, regexp_replace(text, '[\n"\\]', ' ', 'g') as text from benchmark)) union all
select item_id, 1, 'Set', 'has', 'Item ' || item_id, '' from benchmark where item_id % 2 = 0""")
def parse_triples(t):
    """The second object of odd items lacks its relation and is dropped; names are normalised."""
    plain = F.regexp_replace("text", r'[\n"\\]', " ")
    one = F.concat(F.lit('{"head_name":"Item  '), "item_id", F.lit('（x）","relation_predicate":"in","tail":"「Set」","evidence":"'), plain, F.lit('  "}'))
    two = F.concat(F.lit('{"head":"Set","tail_name":"Item '), "item_id", F.lit('","relation":"'), F.when(F.col("item_id") % 2 == 0, "has").otherwise(""), F.lit('"}'))
    answers = t("benchmark").select("item_id", F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")).alias("answer"))
    return G.parse_triples(answers, ["item_id"], "answer")


@query(f"""with {_RAW}, rows_ as (select 'd' || (seq % 3) as doc, head, tail, hint from raw where head <> tail),
s as (select doc, head as name, 1 as o, 0 as i, hint as g from rows_ union all select doc, tail, 0, 1, '' from rows_)
select doc, name, sum(o)::bigint as out_delta, sum(i)::bigint as in_delta, coalesce(string_agg(distinct g, ',' order by g) filter (where trim(g) <> ''), '') as glosses from s group by 1, 2""")
def document_deltas(t):
    """A11, K5"""
    rows = _raw(t).select(F.concat(F.lit("d"), (F.col("seq") % 3).cast("string")).alias("doc"), "head", "tail", F.col("hint").alias("head_gloss"), F.lit("").alias("tail_gloss"))
    return G.document_deltas(rows).withColumn("glosses", F.array_join("glosses", ","))


@query(f"""with {_EDGES}, k as (select head, relation, tail, unnest(case when relation = 'O' then [1, 2] when relation = 'F' then []::integer[] else [3] end) as kb_id from edges
union all select head, relation, tail, 0 from edges where relation = 'F') select '{container("edges", 7)}' as container, kb_id, count(*) as n from k group by 2""")
def container_split(t):
    """G25"""
    kbs = F.when(F.col("relation") == "O", F.array(F.lit(1), F.lit(2))).when(F.col("relation") == "F", F.array().cast("array<int>")).otherwise(F.array(F.lit(3)))
    split = G.per_container(_edges(t).withColumn("kb_ids", kbs))
    return split.groupBy("kb_id").agg(F.count("*").alias("n")).select(F.lit(container("edges", 7)).alias("container"), "kb_id", "n")


@query(f"""with {_EDGES}, new as (select head, relation, tail, 'n1' as c from edges where relation = 'supplied_by' union all select 'Solo', 'knows', 'Solo2', 'n1')
select coalesce(e.head, n.head) as head, coalesce(e.relation, n.relation) as relation, coalesce(e.tail, n.tail) as tail,
concat_ws(',', e.chunk_ids, n.c) as chunk_ids from edges e full join new n on e.head = n.head and e.relation = n.relation and e.tail = n.tail""")
def merge_into_existing(t):
    """G14, K4"""
    old = _edges(t)
    spark = old.sparkSession
    new = old.where("relation = 'supplied_by'").select(*G.KEY, F.array(F.lit("n1")).alias("chunk_ids"))
    new = new.union(spark.range(1).select(F.lit("Solo"), F.lit("knows"), F.lit("Solo2"), F.array(F.lit("n1"))))
    return G.merge_into(old, new, ["chunk_ids"]).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("""with recursive p as (select c_custkey as a, c_custkey + 7 as b from customer where c_custkey % 10 < 7),
both_ways as (select a, b from p union select b, a from p), reach(n, m) as (select a, a from both_ways union select n, b from reach join both_ways on m = a)
select n as old, min(m) as new from reach group by 1""")
def canonical_names(t):
    """Merged names take the least one of their group."""
    pairs = t("customer").where("c_custkey % 10 < 7").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"))
    return G.canonical(pairs)


_WALK = """seed as (select min(head) as name from edges where relation = 'O'),
walk(name, hop) as (select name, 0 from seed union select b, hop + 1 from walk join both_ways on a = name where hop < 1),
near as (select name, min(hop) as hop from walk group by 1),
sub as (select min(hop) + 1 as hop, head, relation, tail from edges join near on name in (head, tail) where hop < 2 group by head, relation, tail order by 1, 2, 3, 4 limit 200)"""


def _seed(edges):
    return edges.where("relation = 'O'").agg(F.min("head").alias("name"))


@query(f"with recursive {_EDGES}, {_BOTH}, {_WALK} select head as source, tail as target, relation from sub")
def subgraph_links(t):
    """G9"""
    edges = _edges(t)
    return G.subgraph(edges, _seed(edges), 2)[1]


@query(f"with recursive {_EDGES}, {_BOTH}, {_WALK} select head as name from sub union select tail from sub")
def subgraph_nodes(t):
    """G9, T4"""
    edges = _edges(t)
    return G.subgraph(edges, _seed(edges), 2)[0]


@query(f"with {_EDGES}, n as (select head as name from edges union select tail from edges) select name, n_regionkey as region from n left join nation on name = n_name")
def full_graph_nodes(t):
    """The edges' ends with what their own table says of them."""
    entities = t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return G.full_graph(_edges(t), entities)[0]


@query(f"with {_EDGES} select head as source, tail as target, relation from edges")
def full_graph_links(t):
    """G10"""
    return G.full_graph(_edges(t), t("nation").select(F.col("n_name").alias("name")))[1]


@query(f"""with {_EDGES}, m as (select * from edges where (head like '%er#%1%' or tail like '%er#%1%') and relation like '%O%')
select head, relation, tail from m order by head, relation, tail limit 20 offset 20""")
def edge_list_page(t):
    """The second page of edges by parts of names."""
    rows = G.edge_list(_edges(t), "er#%1", "O").select(*G.KEY)
    return R.page(rows, [F.asc(c) for c in G.KEY], 2, 20)[0]


@query(f"""with {_RAW}, src as (select 'c' || o_orderkey as chunk_id from orders where o_orderpriority = '1-URGENT')
select distinct head, relation, tail from raw where chunk_id in (select chunk_id from src)""")
def edges_of_source(t):
    """Edges that a chunk of one source bears out."""
    chunks = t("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    return G.edge_list(_edges(t), chunks=chunks).select(*G.KEY)


@query(f"""with {_EDGES}, ends as (select head as name, relation, 1 as o, 0 as i from edges union all select tail, relation, 0, 1 from edges
union all select r_name, null, 0, 0 from region), asked as (select n_name as name from nation union select r_name from region)
select name, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, coalesce(string_agg(distinct relation, ',' order by relation), '') as relations
from ends where name in (select name from asked) group by 1""")
def entity_detail(t):
    """G11"""
    asked = t("nation").select(F.col("n_name").alias("name")).union(t("region").select("r_name"))
    return G.entity_detail(_edges(t), asked).withColumn("relations", F.array_join("relations", ","))


@query(f"with {_EDGES} select head, relation, tail, chunk_ids from edges where relation = 'F' and right(head, 1) = '3'")
def key_triple_lookup(t):
    """J16"""
    keys = _raw(t).where("relation = 'F' and right(head, 1) = '3'").select(*G.KEY)
    return G.edges_by_key(_edges(t), keys).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"""with {_RAW}, ends as (select seq, head as name, 1 as o, 0 as i, hint from raw union all select seq, tail, 0, 1, 'to ' || hint from raw),
old as (select name, sum(o) as o, sum(i) as i, max(hint) as g from ends where seq % 2 = 0 group by 1),
new as (select name, sum(o) as o, sum(i) as i, min(hint) as g from ends where seq % 3 = 0 group by 1)
select name, (coalesce(old.o, 0) + coalesce(new.o, 0))::bigint as out_degree, (coalesce(old.i, 0) + coalesce(new.i, 0))::bigint as in_degree,
case when new.o is not null then new.g else old.g end as glosses from old full join new using (name)""")
def graph_deltas_applied(t):
    """K5: degrees add up, glosses are replaced."""
    raw = _raw(t)
    ends = raw.select("seq", F.col("head").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i"), "hint").union(
        raw.select("seq", "tail", F.lit(0), F.lit(1), F.concat(F.lit("to "), "hint"))
    )
    part = lambda k, gloss: ends.where(F.col("seq") % k == 0).groupBy("name").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), gloss("hint").alias("glosses")
    )
    return G.apply_deltas(part(2, F.max), part(3, F.min))


@query(f"""with {_EDGES}, kept as (select head, relation, tail, chunk_ids from edges where relation <> 'P'), new as (select n_name as head, 'in' as relation, r_name as tail, 'n1' as chunk_ids
from nation join region on n_regionkey = r_regionkey), more as (select head, relation, tail, 'n2' as chunk_ids from edges where relation = 'supplied_by')
select head, relation, tail, string_agg(chunk_ids, ',' order by chunk_ids desc) as chunk_ids from (select * from kept union all select * from new union all select * from more) group by 1, 2, 3""")
def edge_replace(t):
    """Edges are deleted by key, others created or given more evidence."""
    edges = _edges(t)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    new = n.select(F.col("n_name").alias("head"), F.lit("in").alias("relation"), F.col("r_name").alias("tail"), F.array(F.lit("n1")).alias("chunk_ids"))
    more = edges.where("relation = 'supplied_by'").select(*G.KEY, F.array(F.lit("n2")).alias("chunk_ids"))
    return G.replace_edge(edges, edges.where("relation = 'P'"), new.union(more), ["chunk_ids"]).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("""with h as (select c_nationkey as name, count(*) as n from customer group by 1) select name, n::int as hints,
case when name % 2 = 0 then n else least(n, 1) end::int as merged, case when name % 2 = 0 then 'new' else 'old' end as summary from h""")
def cursor_write_back(t):
    """G22"""
    cards = t("customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.collect_list("c_name").alias("hints"))
    cards = cards.select("name", "hints", F.lit(1).alias("merged"), F.lit("old").alias("summary"))
    done = G.write_cursor(cards, cards.where("name % 2 = 0").select("name", F.lit("new").alias("summary")))
    return done.select("name", F.size("hints").alias("hints"), "merged", "summary")


@query("""with c as (select c_custkey, c_nationkey, count(*) over (partition by c_nationkey) as n from customer)
select c_custkey as old, min(c_custkey) over (partition by c_nationkey) as new from c where n > 1""")
def canonical_chain(t):
    """The customers of a nation as a chain, each linked with the one before it."""
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    pairs = t("customer").select(before.alias("a"), F.col("c_custkey").alias("b")).where("a is not null")
    return G.canonical(pairs)
