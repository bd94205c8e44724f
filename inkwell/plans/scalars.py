"""Scalar function families over the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from inkwell.functions import numbers, text
from inkwell.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(translate(n, '＃０１２３（）', '#0123()'), '[（(][^（）()]*[）)]$', ''), '["''‘’「」]', '', 'g'), '\\s+', ' ', 'g')) as name
from (select c_custkey, '「' || replace(c_name, '0', '０') || '」  ' || c_custkey || '（note）' as n from customer)""".replace("\\\\", "\\"))
def entity_normalize(t):
    """G4"""
    name = F.concat(F.lit("「"), F.replace("c_name", F.lit("0"), F.lit("０")), F.lit("」  "), F.col("c_custkey").cast("string"), F.lit("（note）"))
    return t("customer").select("c_custkey", text.entity_name(name).alias("name"))


@query("""select c_custkey, case when length(c_name) < c_custkey % 25 then '' else substr(c_name, 1, (c_custkey % 25)::int) || repeat('*', greatest(least(c_custkey % 25 + 4, length(c_name)) - c_custkey % 25, 0)::int)
|| substr(c_name, (c_custkey % 25 + 5)::int) end as hidden from (select c_custkey, case when c_custkey % 11 = 0 then '' else c_name end as c_name from customer)
where c_name <> '' union all select c_custkey, '' from customer where c_custkey % 11 = 0""")
def hidden_names(t):
    """2.12: characters of a name behind stars, from any place on."""
    name = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_name"))
    rows = t("customer").select("c_custkey", name.alias("c_name"))
    start = functools.reduce(lambda rest, k: F.when(F.col("c_custkey") % 25 == k, text.hide(F.col("c_name"), k, k + 4)).otherwise(rest), range(25), F.lit(None).cast("string"))
    return rows.select("c_custkey", start.alias("hidden"))


@query(r"""select doc_id, regexp_replace(s, '(\S)\S(\S*)', '\1*\2', 'g') as name_mask,
regexp_replace('a' || doc_id || 'user@mail.example', '(^.)[^@]*(@.*$)', '\1****\2', 'g') as mail_mask,
regexp_replace((13800000000 + doc_id)::varchar, '(\d{3})\d{4}(\d{4})', '\1****\2', 'g') as phone_mask,
regexp_replace((110101199001010000 + doc_id)::varchar, '(\d{4})\d{10}(\d{3}[Xx]|\d{4})', '\1** **** ****\2', 'g') as id_mask,
regexp_replace((622202000000000000 + doc_id)::varchar, '\d{15}(\d{3})', '**** **** **** **** \1', 'g') as bank_mask,
repeat('*', length(s)) as password_mask, 'AB' || 'C***' || right(lpad(doc_id::varchar, 8, '0'), 1) as plate_mask from (select doc_id, text as s from documents)""")
def mask_pii(t):
    d = t("documents").select("doc_id", F.col("text").alias("s"))
    n = F.col("doc_id")
    plate = F.concat(F.lit("ABC"), F.substring(F.lpad(n.cast("string"), 8, "0"), 6, 3), F.substring(F.lpad(n.cast("string"), 8, "0"), 8, 1))
    return d.select(
        "doc_id",
        text.mask(F.col("s"), "name").alias("name_mask"),
        text.mask(F.concat(F.lit("a"), n.cast("string"), F.lit("user@mail.example")), "email").alias("mail_mask"),
        text.mask((n + 13800000000).cast("string"), "phone").alias("phone_mask"),
        text.mask((n + 110101199001010000).cast("string"), "id_card").alias("id_mask"),
        text.mask((n + 622202000000000000).cast("string"), "bank_card").alias("bank_mask"),
        text.mask(F.col("s"), "password").alias("password_mask"),
        text.mask(plate, "plate").alias("plate_mask"),
    )


@query("""select page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) as stripped,
sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped from pages""")
def html_strip(t):
    html = F.col("html")
    return t("pages").select("page_id", F.sha2(text.strip_tags(html), 256).alias("stripped"), F.sha2(text.escape_html(html), 256).alias("escaped"))


@query("""select event_id, (props->>'$.k')::bigint as k, coalesce((props->>'$.missing')::bigint, -1) as missing, '{"id":' || event_id || ',"type":"' || event_type || '"}' as dumped from events""")
def json_extract(t):
    parsed = F.from_json("props", "k long, missing long")
    dumped = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return t("events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["missing"], F.lit(-1)).alias("missing"), dumped.alias("dumped"))


@query("""select l_orderkey, l_linenumber, case l_returnflag || l_linestatus when 'AO' then 'accepted,open' when 'AF' then 'accepted,final' when 'RO' then 'returned,open'
when 'RF' then 'returned,final' when 'NO' then 'new,open' when 'NF' then 'new,final' end as labels, l_linestatus || ',' || l_returnflag as codes from lineitem""")
def dict_decode(t):
    """Values come in the expression's order, whatever order they are listed in."""
    listed = F.concat_ws(",", "l_linestatus", "l_returnflag")
    labels = text.decode_labels(listed, "A=accepted,R=returned,N=new,O=open,F=final")
    codes = text.encode_labels(labels, "O=open,F=final,A=accepted,R=returned,N=new")
    return t("lineitem").select("l_orderkey", "l_linenumber", labels.alias("labels"), codes.alias("codes"))


@query("""select o_orderkey, round(o_totalprice::varchar::decimal(30,10), 1)::decimal(30,1) as rounded,
case when o_custkey % 5 = 0 then 0 else round((o_custkey::decimal(18,0)::double / (o_custkey % 5)), 3) end::decimal(18,3) as quotient,
least(greatest(o_custkey, 100), 900) as clamped from orders""")
def exact_arithmetic(t):
    """Half up on what the number shows; a quotient by 0 is 0."""
    key = F.col("o_custkey")
    return t("orders").select(
        "o_orderkey",
        numbers.half_up(F.col("o_totalprice"), 1).cast("decimal(30,1)").alias("rounded"),
        numbers.divide(key, key % 5, 3).cast("decimal(18,3)").alias("quotient"),
        numbers.clamp(key, 100, 900).alias("clamped"),
    )


@query("""select event_id, (abs(epoch_us(ts) // 1000 - epoch_ms(timestamp '2024-01-10')) // 86400000)::bigint as days, (epoch_us(ts) // 1000)::bigint as ms,
(m // 1440)::bigint || '天' || ((m % 1440) // 60)::bigint || '小时' || (m % 60)::bigint || '分钟' as distance,
strftime(ts, '%Y-%m-%d %H:%M') as shown from (select *, (epoch_us(ts) // 1000 - epoch_ms(timestamp '2023-12-25')) // 60000 as m from events)""")
def date_functions(t):
    at = F.col("ts").cast("timestamp")
    return t("events").select(
        "event_id",
        numbers.whole_days(at, F.lit("2024-01-10 00:00:00").cast("timestamp")).cast("long").alias("days"),
        F.unix_millis(at).alias("ms"),
        numbers.distance_text(F.lit("2023-12-25 00:00:00").cast("timestamp"), at).alias("distance"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"),
    )


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def parse_dates(t):
    """Texts in three layouts are read by the first pattern that fits."""
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
    shown = shown.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    read = numbers.parse_any(shown, ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"))
    return t("orders").select("o_orderkey", F.date_format(read, "yyyy-MM-dd").alias("day"))


@query("""select p_partkey, 'brand_' || lower(replace(p_brand, 'Brand#', '')) || '_name' as snake, 'p' || 'Part' || 'Key' as camel, substr(p_name, 2, length(p_name) - 2) as inner_part,
len(list_filter(list_transform(string_split(p_type || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '')) as items,
regexp_matches('/part/' || p_partkey, '^/part/[^/]$') as one, regexp_matches('/part/' || p_partkey || '/x', '^/part/.*$') as deep, lpad(p_partkey::varchar, 9, '0') as padded from part""")
def string_functions(t):
    key = F.col("p_partkey").cast("string")
    brand = F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit("_Name"))
    wrapped = F.concat(F.lit("x{"), F.expr("substring(p_name, 2, length(p_name) - 2)"), F.lit("}"))
    return t("part").select(
        "p_partkey",
        text.snake_case(F.regexp_replace(brand, "_N", "N")).alias("snake"),
        text.camel_case(F.lit("p_part_key")).alias("camel"),
        text.between_last(wrapped, "{", "}").alias("inner_part"),
        F.size(text.to_list(F.concat_ws(",", "p_type", F.lit(" "), "p_brand"))).cast("long").alias("items"),
        text.path_matches(F.concat(F.lit("/part/"), key), "/part/?").alias("one"),
        text.path_matches(F.concat(F.lit("/part/"), key, F.lit("/x")), "/part/**").alias("deep"),
        F.lpad(key, 9, "0").alias("padded"),
    )


@query("""select doc_id, trim(text) as answer, case when doc_id % 2 = 0 then doc_id || '|b' end as listed from
(select doc_id, regexp_replace(trim(replace(text, chr(10), ' ')), '\\s+', ' ', 'g') as text from documents)""".replace("\\\\", "\\"))
def model_output(t):
    """Thought blocks, fences and noise around a JSON list are cut off."""
    plain = F.regexp_replace(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), r"\s+", " ")
    noisy = F.concat(F.lit("<think>a\nb</think>```json\n"), plain, F.lit("\n```"))
    key = F.col("doc_id").cast("string")
    found = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Sure: ["'), key, F.lit('", "b"] ok'))).otherwise("none")
    answer = F.trim(F.regexp_replace(text.without_thoughts(noisy), "^\n|\n$", ""))
    return t("documents").select("doc_id", answer.alias("answer"), F.array_join(text.json_array(found), "|").alias("listed"))


@query("""select c_custkey, 'dear ' || c_name || ', you owe ' || c_mktsegment || ' {} and {}' as filled from customer""")
def template_fill(t):
    """`{}` templates: values in turn, what lacks one stays, an escaped mark is plain."""
    return t("customer").select("c_custkey", text.fill_template("dear {}, you owe {} \\{} and {}", F.col("c_name"), F.col("c_mktsegment")).alias("filled"))


@query("""select p_partkey, case when p_partkey % 4 = 3 then null else p_size end as size, case when p_partkey % 4 = 3 then null else p_name end as name,
case when p_partkey % 4 = 3 then null else p_type || '|' || p_brand end as listed from part""")
def json_recovery(t):
    """Objects and lists in bare, fenced and wordy answers."""
    k = F.col("p_partkey") % 4
    obj = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name")))
    arr = F.to_json(F.array("p_type", "p_brand"))

    def noisy(x):
        fenced = F.concat(F.lit("<think>{a [b</think>here:\n```json\n"), x, F.lit("\n```\ndone"))
        return F.when(k == 0, x).when(k == 1, fenced).when(k == 2, F.concat(F.lit("well, "), x, F.lit(" is it"))).otherwise("nothing")

    found = text.json_object(noisy(obj), "size int, name string")
    return t("part").select("p_partkey", found["size"].alias("size"), found["name"].alias("name"), F.array_join(text.string_list(noisy(arr)), "|").alias("listed"))
