"""The admin back office's SQL shapes over the star schema.

Regions stand for top departments, nations for departments below them, customers for users.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import relational as R
from inkwell.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_DEPTS = """depts as (select r_regionkey + 100 as dept_id, 0 as parent_id, '0' as ancestors, r_name as name from region union all
select n_nationkey + 1000, n_regionkey + 100, '0,' || (n_regionkey + 100), n_name from nation)"""


def _depts(t):
    top = t("region").select((F.col("r_regionkey") + 100).alias("dept_id"), F.lit(0).alias("parent_id"), F.lit("0").alias("ancestors"), F.col("r_name").alias("name"))
    up = F.col("n_regionkey") + 100
    return top.union(t("nation").select(F.col("n_nationkey") + 1000, up, F.concat(F.lit("0,"), up.cast("string")), "n_name"))


@query("""select o_orderkey, o_orderstatus, o_orderdate from orders where o_orderstatus = 'O' and o_orderpriority like '%HIGH%'
and o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-07-01' and o_custkey in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)""")
def optional_filters(t):
    """P1, P2, P4, P6; one more filter has no value and isn't there."""
    rows = t("orders").where(
        R.all_of(
            R.given("O", lambda v: F.col("o_orderstatus") == v),
            R.given("HIGH", lambda v: R.like(F.col("o_orderpriority"), v)),
            R.given("", lambda v: F.col("o_orderpriority") == v),
            R.on_days(F.col("o_orderdate"), "1995-01-01", "1996-06-30"),
            R.given([1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], lambda v: F.col("o_custkey").isin(v)),
        )
    )
    return rows.select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("""select p_partkey, p_name from part where (p_name ilike '%A_E%' or p_type ilike '%steel%') and p_brand not like '%1%'
and p_size not in (1, 2, 3)""")
def like_filters(t):
    """P2, P3, P7, P8"""
    ok = F.col("p_name").ilike("%A_E%") | F.col("p_type").ilike("%steel%")
    return t("part").where(ok & ~R.like(F.col("p_brand"), "1") & ~F.col("p_size").isin(1, 2, 3)).select("p_partkey", "p_name")


@query("select event_id, user_id from events where ts >= timestamp '2024-01-02' and ts <= timestamp '2024-01-20 12:00:00'")
def timestamp_range(t):
    """P5"""
    span = F.col("ts").between(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return t("events").where(span).select("event_id", "user_id")


_KINDS = "case when l_returnflag = 'R' then 'child' when l_linenumber = 1 then 'parent' end"


@query(f"select l_orderkey, l_linenumber from lineitem where {_KINDS} is null or {_KINDS} <> 'child'")
def null_aware_inequality(t):
    """P9"""
    return t("lineitem").where(~F.expr(_KINDS).eqNullSafe(F.lit("child"))).select("l_orderkey", "l_linenumber")


@query(f"with {_DEPTS} select dept_id, name from depts where dept_id = 102 or list_contains(string_split(ancestors, ','), '102')")
def hierarchy_descendants(t):
    """P10"""
    return _depts(t).where((F.col("dept_id") == 102) | R.below(F.col("ancestors"), 102)).select("dept_id", "name")


@query(f"with {_DEPTS} select dept_id, name from depts where dept_id <> 102 and not list_contains(string_split(ancestors, ','), '102')")
def subtree_exclusion(t):
    """P27"""
    return _depts(t).where(~((F.col("dept_id") == 102) | R.below(F.col("ancestors"), 102))).select("dept_id", "name")


@query("""with c as (select l_orderkey, list(distinct l_partkey::varchar) as parts from lineitem group by 1)
select l_orderkey, list_contains(parts, '7') as has_7, list_has_any(parts, ['7', '8', '9']) as overlaps,
len(list_filter(parts, x -> starts_with(x, '12'))) > 0 as prefixed from c""".replace("x -> ", "lambda x: "))
def array_predicates(t):
    """P11, P12, P13"""
    parts = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parts"))
    return parts.select(
        "l_orderkey",
        F.array_contains("parts", "7").alias("has_7"),
        F.arrays_overlap("parts", F.array(*map(F.lit, "789"))).alias("overlaps"),
        F.exists("parts", lambda x: x.startswith("12")).alias("prefixed"),
    )


@query("""with k as (select distinct lower(substr(p_name, 2, 4)) as kw from part)
select p_partkey, kw from part join k on contains(lower(p_name), kw) or contains(kw, lower(p_name))""")
def containment_join(t):
    """Both ways, by pairs of characters."""
    words = t("part").select(F.lower(F.substring("p_name", 2, 4)).alias("kw")).distinct()
    names = t("part").select("p_partkey", F.lower("p_name").alias("name"))
    held = R.containing(names, "name", words, "kw").select("p_partkey", "kw")
    return held.union(R.containing(words, "kw", names, "name").select("p_partkey", "kw")).distinct()


@query("""select a.c_custkey, b.c_custkey as other from customer a join customer b on contains(a.c_name, b.c_name) union all
select c_custkey, -s_suppkey from customer join supplier on contains(c_name, substr(s_name, 10))""")
def shared_names(t):
    """Names that are alike but for their numbers, against each other, and parts of others; each by its rarest gram."""
    names = t("customer").select("c_custkey", "c_name")
    other = names.select(F.col("c_custkey").alias("other"), F.col("c_name").alias("part"))
    parts = t("supplier").select((-F.col("s_suppkey")).alias("other"), F.substring("s_name", 10, 100).alias("part"))
    return R.containing(names, "c_name", other.union(parts), "part").select("c_custkey", "other")


@query("""select c_custkey, contains(x, '+') or contains(x, '/*') or contains(x, 'sleep') or contains(x, '%0a') or contains(x, 'user()')
or contains(x, 'updatexml') or contains(x, 'extractvalue') or contains(x, 'information_schema') or c_custkey % 6 = 0 as refused
from (select c_custkey, lower(case c_custkey % 6 when 0 then 'a = 1 and b' when 1 then 'SLE EP(9)' when 2 then 'a+b' when 3 then '/ *' when 4 then 'Us er()' else c_name end) as y,
regexp_replace(y, '\\s', '', 'g') as x from customer)""".replace("\\\\", "\\"))
def keyword_guard(t):
    """White space is left out before the search."""
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, "a = 1 and b").when(k == 1, "SLE EP(9)").when(k == 2, "a+b").when(k == 3, "/ *").when(k == 4, "Us er()").otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", R.holds_keyword(text).alias("refused"))


_ROLES = [
    {"scope": 2, "depts": [1001, 1007]},
    {"scope": 4},
    {"scope": 5},
    {"scope": 1, "enabled": False},
]


@query(f"""with {_DEPTS} select c_custkey, c_nationkey + 1000 as dept_id from customer where c_nationkey + 1000 in (1001, 1007)
or c_nationkey + 1000 in (select dept_id from depts where dept_id = 103 or list_contains(string_split(ancestors, ','), '103')) or c_custkey = 42""")
def data_scope(t):
    """P17"""
    rows = t("customer").select("c_custkey", (F.col("c_nationkey") + 1000).alias("dept_id"))
    return R.data_scope(rows, "dept_id", "c_custkey", _ROLES, 42, 103, _depts(t))


@query("""select c_custkey, case when c_custkey % 10 = 0 then 'owner' when c_acctbal > 5000 then 'editor' else 'reader' end as role,
case when length(c_name) > 12 then substr(c_name, 1, 12) || '...' else c_name end as preview,
coalesce(case when c_acctbal < 0 then c_mktsegment end, '') as note from customer""")
def case_projections(t):
    """P23, P24, P26"""
    role = F.when(F.col("c_custkey") % 10 == 0, "owner").when(F.col("c_acctbal") > 5000, "editor").otherwise("reader")
    preview = F.when(F.length("c_name") > 12, F.concat(F.substring("c_name", 1, 12), F.lit("..."))).otherwise(F.col("c_name"))
    note = F.coalesce(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")), F.lit(""))
    return t("customer").select("c_custkey", role.alias("role"), preview.alias("preview"), note.alias("note"))


@query("""select c_custkey, '{' || '"c_custkey":' || c_custkey || case when c_acctbal < 0 then '' else ',"seg":"' || c_mktsegment || '"' end || '}' as row_map
from customer""")
def null_dropping_map(t):
    """P25"""
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg")
    return t("customer").select("c_custkey", F.to_json(F.struct("c_custkey", segment)).alias("row_map"))


@query("""select 'login_tokens:' || event_id as token, '10.0.0.' || user_id % 5 as ip, 'u' || user_id % 7 as user_name from events
where event_type in ('login', 'click', 'view', 'error') and user_id % 5 = 2 and user_id % 7 = 3 order by 1 desc""")
def online_sessions(t):
    """Keys with a prefix, of one address and one user, last key first."""
    prefix = F.when(F.col("event_type").isin("login", "click", "view", "error"), "login_tokens:").otherwise("captcha_codes:")
    rows = t("events").select(
        F.concat(prefix, F.col("event_id").cast("string")).alias("token"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")).alias("ip"),
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("user_name"),
    )
    return R.sessions(rows, "token", "login_tokens:", "10.0.0.2", "u3")


@query("""select 'job' || user_id % 9 as job, ts as started, ts + to_milliseconds((value * 10)::int) as ended, (value * 10)::int::bigint as millis, case when event_type = 'error' then '1' else '0' end as status,
'job' || user_id % 9 || ': ' || (value * 10)::int || ' ms' as message, case when event_type = 'error' then substr(repeat(props, 300), 1, 2000) end as error from events""")
def job_log(t):
    """M13"""
    millis = F.bround(F.col("value") * 10, 0).cast("int")
    runs = t("events").select(
        F.concat(F.lit("job"), (F.col("user_id") % 9).cast("string")).alias("job"), F.col("ts").alias("started"),
        (F.col("ts") + F.make_dt_interval(secs=millis / 1000)).alias("ended"), F.when(F.col("event_type") == "error", F.repeat("props", F.lit(300))).alias("error"),
    )
    return R.job_log(runs)


# -- joins


@query("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20")
def left_equi(t):
    """J1"""
    nations = t("nation").where("n_nationkey < 20")
    return t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("""select distinct c_custkey, n_name, o_orderpriority, l_returnflag from customer left join nation on c_nationkey = n_nationkey
left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey""")
def left_chain(t):
    """J2, A9"""
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("c_custkey", "n_name", "o_orderpriority", "l_returnflag").distinct()


@query("""select distinct r_name, n_name from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey
left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey where l_quantity > 49 and o_orderstatus = 'F'""")
def outer_made_inner(t):
    """The filter on the right side makes Catalyst turn the outer joins into inner ones."""
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = rows.join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.where("l_quantity > 49 and o_orderstatus = 'F'").select("r_name", "n_name").distinct()


@query("""select c_custkey, o_orderkey, case when o_orderkey is null then 'unread' else 'read' end as flag from customer
left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT'""")
def left_on_condition(t):
    """The condition belongs to the join, so customers without such an order stay."""
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderpriority") == "1-URGENT")
    flag = F.when(F.col("o_orderkey").isNull(), "unread").otherwise("read")
    return t("customer").join(t("orders"), on, "left").select("c_custkey", "o_orderkey", flag.alias("flag"))


@query("""select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey and c_acctbal > 0
left join nation on n_nationkey = c_nationkey""")
def inner_residual(t):
    """J5"""
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_acctbal") > 0)
    rows = t("orders").join(t("customer"), on).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name")


@query("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def semi_in(t):
    """J6"""
    chosen = t("nation").where("n_regionkey = 2")
    return t("customer").join(chosen, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def not_exists(t):
    """J7"""
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P")
    return t("customer").join(t("orders"), on, "left_anti").select("c_custkey")


@query(f"with {_DEPTS} select dept_id from depts where dept_id not in (select parent_id from depts)")
def not_in_leaves(t):
    """Parents are never null, so the anti join needs no null rule."""
    depts = _depts(t)
    return depts.join(depts.select(F.col("parent_id").alias("dept_id")), "dept_id", "left_anti").select("dept_id")


@query(f"with {_DEPTS} select d.dept_id, (select p.name from depts p where p.dept_id = d.parent_id) as parent_name from depts d")
def parent_scalar_subquery(t):
    """J9"""
    depts = _depts(t)
    up = depts.select(F.col("dept_id").alias("p"), F.col("name").alias("parent_name"))
    return depts.join(up, F.col("parent_id") == F.col("p"), "left").select("dept_id", "parent_name")


@query("""select distinct c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey and o_totalprice > 400000) > 0""")
def correlated_count(t):
    """A count compared with zero is a semi join."""
    rich = t("orders").where("o_totalprice > 400000")
    return t("customer").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""select n_name, coalesce(string_agg(s_name, ',' order by s_name), '') as members from nation
left join supplier on s_nationkey = n_nationkey group by n_name""")
def community_members(t):
    """One join in place of a query for each community."""
    rows = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("members"))


@query("""select o_orderkey, min(l_linenumber) as best_child, max(l_extendedprice) as score from orders
join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by o_orderkey""")
def child_to_parent(t):
    """J13 (J12)"""
    children = t("lineitem").where("l_returnflag = 'R'")
    rows = t("orders").join(children, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("best_child"), F.max("l_extendedprice").alias("score"))


@query("select user_id, event_type, count(*) as n from events e where not exists (select 1 from events d where d.user_id = e.user_id and d.event_type = e.event_type and d.value > 90) group by all")
def cached_questions(t):
    """What is done already is skipped."""
    done = t("events").where("value > 90").select("user_id", "event_type").distinct()
    return t("events").join(done, ["user_id", "event_type"], "left_anti").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""select o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as lines from orders
left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def one_to_many_fold(t):
    """J19"""
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    items = F.array_sort(F.collect_list(F.when(F.col("l_linenumber").isNotNull(), F.struct("l_linenumber", "l_returnflag"))))
    text = F.transform(items, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"]))
    return rows.groupBy("o_orderkey").agg(F.array_join(text, ",").alias("lines"))


# -- aggregates


@query("select count(*) as total, count(*) filter (where o_orderstatus = 'O') as open_orders from orders")
def filtered_count(t):
    """A1, A5"""
    return t("orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))


@query("""with g as (select source, count(*) as n from documents group by 1 order by n desc, source limit 5)
select source, n, sum(n) over () :: bigint as total from g""")
def source_stats_topn(t):
    """A2, A3, A4: the total is over the groups that are shown."""
    top = t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)
    return top.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("""select sum(coalesce(try_cast(cell as decimal(18,2)), 0))::decimal(38,2) as total, count(*) as cells from
(select case when l_linenumber % 3 = 0 then 'n/a' else l_quantity::decimal(18,2)::varchar end as cell from lineitem)""")
def column_totals(t):
    """Cells that aren't numbers count as 0."""
    cell = F.when(F.col("l_linenumber") % 3 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("decimal(18,2)").cast("string"))
    number = F.coalesce(F.expr("try_cast(cell as decimal(18,2))"), F.lit(0).cast("decimal(18,2)"))
    return t("lineitem").select(cell.alias("cell")).agg(F.sum(number).cast("decimal(38,2)").alias("total"), F.count("*").alias("cells"))


@query("""select case when isnan(score) or score is null then 'muted' when score >= 0.8 then 'good' when score >= 0.5 then 'mid' else 'bad' end as band,
count(*) as n, round(avg(case when isnan(score) then null else score end), 6) as mean from
(select case when event_id % 11 = 0 then 'nan'::double when event_id % 13 = 0 then null else (event_id % 101) / 100 end as score from events) group by 1""")
def metric_bands(t):
    """NaN counts as missing."""
    score = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("event_id") % 101 / 100)
    s = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    band = F.when(s.isNull(), "muted").when(s >= 0.8, "good").when(s >= 0.5, "mid").otherwise("bad")
    return t("events").select(score.alias("score")).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"))


@query("""select l_orderkey, string_agg(l_shipdate::date::varchar, ',' order by first, l_shipdate) as days from
(select l_orderkey, l_shipdate, min(l_linenumber) as first from lineitem group by 1, 2) group by 1""")
def hash_dedupe(t):
    """The first place of each value decides its order."""
    first = t("lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.min("l_linenumber").alias("first"))
    items = F.array_sort(F.collect_list(F.struct("first", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"))))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda x: x["d"]), ",").alias("days"))


@query("""select p_brand, string_agg(p_partkey::varchar, ',' order by p_size, p_partkey) as p_partkey from part group by 1""")
def sorted_group_list(t):
    """A19"""
    return R.to_list(t("part"), ["p_brand"], ["p_size", "p_partkey"], ["p_partkey"])


@query("""with shown as (select * from orders order by o_orderdate desc, o_orderkey limit 20) select count(*) filter (where o_orderstatus = 'O') as unread, count(*) as listed from shown""")
def conditional_count(t):
    """Only the rows that are shown count."""
    shown = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return shown.agg(F.count_if(F.col("o_orderstatus") == "O").alias("unread"), F.count("*").alias("listed"))


# -- order and pages


@query("select c_custkey, c_acctbal from customer order by c_nationkey, c_acctbal desc, c_custkey limit 20 offset 40")
def list_page(t):
    """O1, O2, O3"""
    rows, _ = R.page(t("customer"), [F.asc("c_nationkey"), F.desc("c_acctbal"), F.asc("c_custkey")], 3, 20)
    return rows.select("c_custkey", "c_acctbal")


@query("""select s_suppkey from supplier order by s_nationkey, s_suppkey
limit 100 offset (select (greatest(1, (count(*) + 99) // 100) - 1) * 100 from supplier)""")
def last_page(t):
    """A page beyond the last one becomes the last one; sizes over 100 become 100."""
    rows = t("supplier")
    return R.page(rows, R.check_order("s_nationkey, sSuppkey asc", rows.columns), 9999, 1000, reasonable=True)[0].select("s_suppkey")


@query("select c_custkey in (select o_custkey from orders) as in_use, count(*) as n from customer group by 1")
def existence(t):
    """O7"""
    used = t("orders").select(F.col("o_custkey").alias("k")).distinct()
    rows = t("customer").join(used, F.col("c_custkey") == F.col("k"), "left")
    return rows.groupBy(F.col("k").isNotNull().alias("in_use")).agg(F.count("*").alias("n"))


# -- mutations: final states


@query("""select o.o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) as o_orderstatus, o.o_totalprice, o.o_custkey from orders o
left join (select o_orderkey, 'X' as o_orderstatus from orders where o_orderdate >= date '1997-01-01') n using (o_orderkey) where o_orderdate < date '1998-01-01'
union all select o_orderkey, 'X', -1, o_custkey from orders where o_orderdate >= date '1998-01-01'""")
def upsert_state(t):
    """Of known keys only the status changes."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"]
    old = t("orders").where("o_orderdate < date'1998-01-01'").select(*columns)
    new = t("orders").where("o_orderdate >= date'1997-01-01'")
    new = new.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(-1.0).alias("o_totalprice"), "o_custkey")
    return R.upsert(old, new, ["o_orderkey"], ["o_orderstatus"])


@query("""select o_orderkey from orders where o_orderdate < date '1997-01-01' and o_orderkey not in (select o_orderkey from orders where o_orderdate >= date '1996-01-01')""")
def stale_difference(t):
    """T2"""
    return R.stale(t("orders").where("o_orderdate < date'1997-01-01'"), t("orders").where("o_orderdate >= date'1996-01-01'"), ["o_orderkey"])


@query("""select c_custkey, 'old' as origin from customer where c_custkey % 3 <> 0 union all
select c_custkey, 'new' from customer where c_custkey % 2 = 0 and c_custkey % 3 = 0""")
def insert_ignore(t):
    """K14"""
    rows = t("customer").select("c_custkey")
    old = rows.where("c_custkey % 3 <> 0").withColumn("origin", F.lit("old"))
    return R.insert_ignore(old, rows.where("c_custkey % 2 = 0").withColumn("origin", F.lit("new")), ["c_custkey"])


@query("""select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then '2' else '0' end as del_flag,
case when c_custkey % 5 = 0 then 'PATCHED' else c_mktsegment end as c_mktsegment, c_acctbal from customer""")
def soft_delete_and_patch(t):
    """K13, K15, K16, K17"""
    gone = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("del_flag", F.lit("2"))
    rows = t("customer").select("c_custkey", F.lit("0").alias("del_flag"), "c_mktsegment", "c_acctbal")
    segment = F.when(F.col("c_custkey") % 5 == 0, "PATCHED")
    changes = t("customer").select("c_custkey", segment.alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return R.patch(R.patch(rows, gone, ["c_custkey"]), changes, ["c_custkey"])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def delete_by_ids(t):
    """K7, K8, K11"""
    return R.remove(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"])


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'update' else 'insert' end as action from customer""")
def import_classify(t):
    """K24"""
    rows = t("customer").select("c_custkey")
    return R.classify_import(rows, rows.where("c_custkey % 2 = 0"), "c_custkey", True)


@query("""select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, coalesce(o.o_orderpriority, n.o_orderpriority) as o_orderpriority,
coalesce(n.o_totalprice, o.o_totalprice) as o_totalprice, case when n.o_orderkey is null then 'delete' when o.o_orderkey is null then 'insert' else 'update' end as action
from (select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderdate < date '1997-01-01') o full join
(select o_orderkey, 'new' as o_orderpriority, o_totalprice + 1 as o_totalprice from orders where o_orderdate >= date '1996-01-01') n on o.o_orderkey = n.o_orderkey""")
def three_way_sync(t):
    """K25"""
    columns = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    old = t("orders").where("o_orderdate < date'1997-01-01'").select(*columns)
    new = t("orders").where("o_orderdate >= date'1996-01-01'")
    new = new.select("o_orderkey", F.lit("new").alias("o_orderpriority"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return R.three_way_sync(old, new, "o_orderkey", ["o_orderpriority"])


# -- trees


@query(f"""with recursive {_DEPTS}, tree as (select dept_id as node, dept_id as root, 0 as depth, dept_id::varchar as path from depts where parent_id not in (select dept_id from depts)
union all select d.dept_id, root, depth + 1, path || '/' || d.dept_id from depts d join tree on d.parent_id = node) select * from tree""")
def tree_levels(t):
    """G26"""
    return R.levels(_depts(t), "dept_id", "parent_id")


@query(f"""with {_DEPTS} select dept_id as id, case when dept_id = 101 or list_contains(string_split(ancestors, ','), '101')
then '0,900' || substr(ancestors, 2) else ancestors end as ancestors from depts""")
def ancestor_rewrite(t):
    """G27"""
    return R.move_subtree(_depts(t).select(F.col("dept_id").alias("id"), "ancestors"), 101, "0,900", "0")
