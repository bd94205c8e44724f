"""URL filters (operator 2): rules, then link-graph propagation of trust and distrust between hosts.

Native: DataFrame functions only.  Rules are (verdict, host, path prefix); a rule fits its host and
all subdomains if the url's path starts with the rule's path, and the longest fitting rule decides
(longest as host + path; of equally long ones the longer host).  Urls that no rule fits get their
host's verdict:

*   host edges are the links between pages of different hosts (absolute href targets; others lead to
    the page's own host), each ``LINK`` in weight, and for every host an edge of weight 1 to and from
    its parent domain of two labels or more, so that hosts under one public suffix share little;
*   trusted seeds are hosts with pages that rules allow, blocked seeds hosts with pages that rules
    block, each weighed by its number of such pages;
*   trust is personalised PageRank from the trusted seeds along the edges, distrust the same from the
    blocked seeds against them (a host that links to blocked hosts is distrusted);
*   a host is blocked if its distrust is more than ``threshold`` times its trust.

Ranks are whole numbers of millionths of a millionth, divided with remainders dropped, so that the
result depends on no order of summation.  Only the host table is iterated over, never the pages;
counts are summed before they are shuffled by host.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and verdict
allow; an empty host is no node of the graph; a null html has no links; a null id stays null;
repeated rows are returned and counted as often as they occur; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import checkpointed

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rounds of propagation, the share that follows edges in percent, and what the ranks of all hosts sum to.
ROUNDS, FOLLOW, WHOLE = 12, 85, 10**12
THRESHOLD = 1
#: What a link weighs against an edge to a parent domain.
LINK = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^(?s)(.*?)://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'<>\s]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, prefix in reversed(ordered):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(prefix)
        text, verdict = F.when(fits, F.lit(where + prefix)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def host_edges(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """src, dst and weight of the edges between hosts: links, and both ways to each host's parent domain."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    links = links.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst"))
    links = links.where("src != '' and src != dst").groupBy("src", "dst").agg((F.count("*") * LINK).alias("weight"))
    hosts = judged.where("host != ''").select("host").distinct()
    labels = F.split("host", r"\.")
    ups = hosts.select(labels.alias("l")).select(
        F.explode(F.expr("transform(sequence(1, greatest(size(l) - 1, 1)), i -> slice(l, i, size(l)))")).alias("l")
    )
    ups = ups.where("size(l) >= 3").select(
        F.array_join("l", ".").alias("src"), F.expr("array_join(slice(l, 2, size(l)), '.')").alias("dst")
    )
    ups = ups.distinct().select("src", "dst", F.lit(1).cast("long").alias("weight"))
    return links.union(ups).union(ups.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, follow: int = FOLLOW) -> DataFrame:
    """host and rank: personalised PageRank from seeds (host, weight) along edges (src, dst, weight)."""
    total = seeds.agg(F.sum("weight").alias("all"))
    start = seeds.join(F.broadcast(total)).select(
        "host", F.expr(f"cast(weight as decimal(38,0)) * {WHOLE} div all").cast("long").alias("start")
    )
    out = edges.groupBy(F.col("src").alias("from")).agg(F.sum("weight").alias("all"))
    shares = checkpointed(edges.join(out, F.col("src") == F.col("from")).select("src", "dst", "weight", "all"))
    start = checkpointed(start)
    rank = start.select("host", F.col("start").alias("rank"))
    for k in range(rounds):
        sent = shares.join(rank, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"),
            F.expr(f"(cast(rank as decimal(38,0)) * weight * {follow}) div (all * 100)").cast("long").alias("rank"),
        )
        home = start.select("host", F.expr(f"start * {100 - follow} div 100").alias("rank"))
        rank = sent.union(home).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3:
            rank = checkpointed(rank)
    return rank


def judge(
    pages: DataFrame, rules: tuple = RULES, threshold: int = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of every page."""
    url = pages[url_col].cast("string")
    known = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), pages[html_col].cast("string").alias("html"))
    rule, ruled = best_rule(F.col("host"), F.col("path"), rules)
    known = known.select("page_id", "host", "path", "html", rule.alias("rule"), ruled.alias("ruled"))
    judged = known.drop("html")
    edges = checkpointed(host_edges(judged, known))
    seeds = judged.where("ruled is not null and host != ''").groupBy("host", "ruled").agg(F.count("*").alias("weight"))
    seeds = checkpointed(seeds)
    trust = propagate(edges, seeds.where("ruled = 'allow'").select("host", "weight"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, seeds.where("ruled = 'block'").select("host", "weight"))
    hosts = (
        trust.select("host", F.col("rank").alias("trust"), F.lit(0).cast("long").alias("distrust"))
        .union(distrust.select("host", F.lit(0).cast("long"), "rank"))
        .groupBy(F.col("host").alias("of"))
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    found = judged.join(hosts, F.col("host") == F.col("of"), "left")
    zero = F.lit(0).cast("long")
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    method = F.when(distrust > trust * threshold, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def oracle_sql(rules: tuple = RULES, rounds: int = ROUNDS, follow: int = FOLLOW, threshold: int = THRESHOLD) -> str:
    """The same in DuckDB's SQL, with the rounds written out."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ordered))
    ruled = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ordered))
    steps = [
        "parts as materialized (select page_id, html, "
        "case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages)",
        "known as materialized (select page_id, html, "
        f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, "
        "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts)",
        f"judged as materialized (select page_id, host, path, case {rule} end as rule, case {ruled} end as ruled from known)",
        "links as (select host as src, translate(t, '%s', '%s') as dst from (select host, unnest(regexp_extract_all(html, "
        "'href\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''<>\\s]+)', 1, 'i')) as t from known))" % (_UPPER, _LOWER),
        "ups as (with recursive up(h) as (select distinct host from judged where host <> '' union "
        "select substr(h, instr(h, '.') + 1) from up where len(string_split(h, '.')) >= 3) "
        "select h as src, substr(h, instr(h, '.') + 1) as dst from up where len(string_split(h, '.')) >= 3)",
        f"edges as materialized (select src, dst, count(*) * {LINK} as weight from links where src <> '' and src <> dst group by all "
        "union all select src, dst, 1 from ups union all select dst, src, 1 from ups)",
        "seeds as materialized (select host, ruled, count(*) as weight from judged where ruled is not null and host <> '' group by all)",
    ]
    for name, verdict, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        steps += [
            f"start_{name} as materialized (select host, ((weight::hugeint * {WHOLE}) // (select sum(weight) from seeds where ruled = '{verdict}'))"
            f"::bigint as start from seeds where ruled = '{verdict}')",
            f"shares_{name} as materialized (select {src} as src, {dst} as dst, weight, sum(weight) over (partition by {src}) as whole from edges)",
            f"rank_{name}_0 as (select host, start as rank from start_{name})",
        ]
        steps += [
            f"rank_{name}_{k + 1} as materialized (select host, sum(rank)::bigint as rank from (select dst as host, "
            f"((rank::hugeint * weight * {follow}) // (whole * 100)) as rank from shares_{name} join rank_{name}_{k} on src = host "
            f"union all select host, start * {100 - follow} // 100 from start_{name}) group by host)"
            for k in range(rounds)
        ]
    return (
        "with " + ", ".join(steps) + " select page_id, j.host, path, rule, "
        f"coalesce(ruled, case when coalesce(d.rank, 0) > coalesce(t.rank, 0) * {threshold} then 'block' else 'allow' end) as verdict, "
        "coalesce(t.rank, 0) as trust, coalesce(d.rank, 0) as distrust from judged j "
        f"left join rank_t_{rounds} t on j.host = t.host left join rank_d_{rounds} d on j.host = d.host"
    )
