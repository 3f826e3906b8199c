"""Queries on resolving what a line means: which of a customer's orders, which call with which arguments, and its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import Tables, count_n, query

SQL_ENTITIES = """e as (select o_custkey as c, o_orderkey as id, o_orderstatus <> 'F' as active, lower(split_part(o_orderpriority, '-', 2)) as kind, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as chrono, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as newest, count(*) over (partition by o_custkey) as n from orders)"""


def entities(t: Tables) -> DataFrame:
    """(c, id, active, kind, chrono, newest, n): the orders of a customer, in the order of time."""
    per = W.partitionBy("o_custkey")
    return t.orders.select(
        F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("active"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("kind"),
        F.row_number().over(per.orderBy("o_orderdate", "o_orderkey")).alias("chrono"), F.row_number().over(per.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("newest"), F.count(F.lit(1)).over(per).alias("n"),
    )


@query("er_entities", f"with {SQL_ENTITIES} select c, max(case when newest = 1 then id end) as primary_id, max(case when newest = 2 then id end) as secondary_id, count(*) filter (where newest > 2) as extra, count(*) filter (where active) as active, count(distinct kind) as kinds from e group by 1")
def entity_table(t: Tables) -> DataFrame:
    """Entities of a record: primary, secondary and further identifiers, how many are active, and of how many kinds."""
    pick = lambda n: F.max(F.when(F.col("newest") == n, F.col("id")))
    return entities(t).groupBy("c").agg(pick(1).alias("primary_id"), pick(2).alias("secondary_id"), F.count_if(F.col("newest") > 2).alias("extra"), F.count_if("active").alias("active"), F.count_distinct("kind").alias("kinds"))


@query("er_ordinals", """
    select o_orderkey, case o_orderkey % 4 when 0 then 2 when 1 then null when 2 then -1 else 1 end as ordinal from orders""")
def ordinals(t: Tables) -> DataFrame:
    """Ordinals that name an entity, but not those of a field such as a floor or a line."""
    said = F.element_at(F.array(*map(F.lit, ("the second order please", "the second floor please", "my last order", "first order, third line"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    word = F.regexp_extract(said, "\\b(first|second|third|last)\\b(?! (?:floor|line|name))", 1)
    place = F.when(word == "first", 1).when(word == "second", 2).when(word == "third", 3).when(word == "last", -1)
    return t.orders.select("o_orderkey", place.alias("ordinal"))


@query("er_id_matches", """
    select o_orderkey, case o_orderkey % 3 when 0 then 'whole' when 1 then 'block' else 'none' end as match from orders""")
def id_matches(t: Tables) -> DataFrame:
    """An identifier that a line gives whole, or by a block of its digits as a whole run."""
    d = F.lpad(F.col("o_orderkey").cast("string"), 8, "5")
    case = F.col("o_orderkey") % 3
    block = F.expr("substring(lpad(cast(o_orderkey as string), 8, '5'), 5, 4)")
    said = F.when(case == 0, F.concat(F.lit("number "), d)).when(case == 1, F.concat(F.lit("ends in "), block)).otherwise(F.concat(F.lit("costs 9"), block))
    runs = F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0))
    return t.orders.select("o_orderkey", F.when(F.array_contains(runs, d), "whole").when(F.array_contains(runs, block), "block").otherwise("none").alias("match"))


SQL_MENTIONS = """m as (select c, case c % 6 when 0 then 'number ' || max(case when chrono = 1 then id end) when 1 then 'ends in ' || right('000' || max(case when newest = 1 then id end), 3) when 2 then 'the urgent one' when 3 then 'the second order' when 4 then 'my order' else 'number 999999999' end as said, c % 6 as k from e group by c)"""


def mentions(t: Tables) -> DataFrame:
    """(c, said): what a customer calls an order: identifier, block of digits, kind, ordinal, nothing, or an unknown identifier."""
    first, last = F.max(F.when(F.col("chrono") == 1, F.col("id"))).cast("string"), F.max(F.when(F.col("newest") == 1, F.col("id"))).cast("string")
    case = F.col("c") % 6
    made = F.when(case == 0, F.concat(F.lit("number "), first)).when(case == 1, F.concat(F.lit("ends in "), F.right(F.concat(F.lit("000"), last), F.lit(3)))).when(case == 2, "the urgent one").when(case == 3, "the second order").when(case == 4, "my order").otherwise("number 999999999")
    return entities(t).groupBy("c").agg(made.alias("said"))


@query("er_resolver", f"""
    with {SQL_ENTITIES}, {SQL_MENTIONS}, j as (select e.*, said, k, regexp_extract(said, '[0-9]+') as d from e join m using (c)),
    r as (select c, id, 1 as rank, 'id' as rule from j where k in (0, 5) and cast(id as varchar) = d union all select c, id, 2, 'digits' from j where k = 1 and right('000' || id, 3) = d union all select c, id, 3, 'kind' from j where k = 2 and kind = 'urgent' union all select c, id, 4, 'ordinal' from j where k = 3 and chrono = 2
          union all select c, id, 5, 'only' from j where k = 4 and n = 1 union all select c, arg_max(id, chrono), 6, 'newest active' from j where k = 4 and active group by c),
    u as (select c, rank, rule, max(id) as id from r group by 1, 2, 3 having count(*) = 1)
    select m.c, coalesce(arg_min(rule, rank), 'ask') as rule, arg_min(id, rank) as id from m left join u using (c) group by 1""")
def resolver(t: Tables) -> DataFrame:
    """Rules in order, each of which counts only if it has one candidate; an unknown identifier asks and never falls back."""
    j = entities(t).join(mentions(t), "c").withColumn("d", F.regexp_extract("said", "[0-9]+", 0))
    said, key = F.col("said"), F.col("id").cast("string")
    rules = [
        ("id", said.startswith("number") & (key == F.col("d"))),
        ("digits", said.startswith("ends in") & (F.right(F.concat(F.lit("000"), key), F.lit(3)) == F.col("d"))),
        ("kind", said.contains("urgent") & (F.col("kind") == "urgent")),
        ("ordinal", said.contains("second order") & (F.col("chrono") == 2)),
        ("only", (said == "my order") & (F.col("n") == 1)),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("rank"), F.lit(name).alias("rule"), F.col("id").alias("id"))) for i, (name, c) in enumerate(rules, 1)]), lambda x: x.isNotNull())
    newest = j.where("said = 'my order' and active").groupBy("c").agg(F.max_by("id", "chrono").alias("id")).select("c", F.lit(6).alias("rank"), F.lit("newest active").alias("rule"), "id")
    found = j.select("c", F.explode(hits).alias("h")).select("c", "h.rank", "h.rule", "h.id").unionByName(newest)
    unique = found.groupBy("c", "rank", "rule").agg(F.max("id").alias("id"), count_n()).where("n = 1")
    best = unique.groupBy("c").agg(F.min(F.struct("rank", "rule", "id")).alias("b"))
    return mentions(t).select("c").join(best, "c", "left").select("c", F.coalesce("b.rule", F.lit("ask")).alias("rule"), F.col("b.id").alias("id"))


@query("er_address", """
    select c_custkey, case when c_custkey % 4 = 0 then 'new' when c_custkey % 4 in (1, 2) and c_acctbal > 0 then 'registered' else 'ask' end as address from customer""")
def address(t: Tables) -> DataFrame:
    """Where to send: an address that is spelled out, the registered one if it is meant and known, else ask."""
    case = F.col("c_custkey") % 4
    said = F.when(case == 0, "to 12 Elm Road, Rome").when(case == 1, "to my home").when(case == 2, "to the same address").otherwise("over there")
    registered = F.when(F.col("c_acctbal") > 0, F.lit("known"))
    found = F.when(said.rlike("[0-9]+ [A-Z]"), "new").when(said.rlike("\\b(home|same|registered)\\b") & registered.isNotNull(), "registered").otherwise("ask")
    return t.customer.select("c_custkey", found.alias("address"))


#: Tools with their arguments: name, required, filled in by the server.
SPEC = [("cancel", "order", True, False), ("cancel", "reason", False, False), ("cancel", "customer", True, True), ("track", "order", True, False), ("track", "customer", True, True)]


@query("er_calls", """
    with c as (select o_orderkey, o_custkey, case when o_orderkey % 2 = 0 then 'cancel' else 'track' end as tool, o_orderkey % 7 = 3 as no_order from orders)
    select o_orderkey, tool, case when no_order then 'order' else '' end as ask, case when no_order then '' else 'order=' || o_orderkey || ';' end || 'customer=' || o_custkey || case when tool = 'cancel' then ';reason=late' else '' end as args, case when tool = 'track' then 'colour,reason' else 'colour' end as dropped from c""")
def calls(t: Tables) -> DataFrame:
    """Arguments against the specification of a tool: those of the server filled in, missing ones asked for, unknown ones dropped."""
    order = F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderkey").cast("string"))
    tool = F.when(F.col("o_orderkey") % 2 == 0, "cancel").otherwise("track")
    given = F.map_filter(F.create_map(F.lit("order"), order, F.lit("reason"), F.lit("late"), F.lit("colour"), F.lit("red")), lambda _, v: v.isNotNull())
    said = t.orders.select("o_orderkey", "o_custkey", tool.alias("tool"), given.alias("given"))
    spec = t.spark.createDataFrame(SPEC, "tool string, arg string, required boolean, server boolean")
    listed = spec.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("arg", "required", "server"))).alias("spec"))
    wide = said.join(F.broadcast(listed), "tool")  # the specification has two rows
    value = lambda a: F.when(a["server"], F.col("o_custkey").cast("string")).otherwise(F.try_element_at("given", a["arg"]))
    filled = F.filter("spec", lambda a: value(a).isNotNull())
    order_of = F.array(*map(F.lit, ("order", "customer", "reason")))
    written = F.array_join(F.transform(F.array_sort(F.transform(filled, lambda a: F.struct(F.array_position(order_of, a["arg"]).alias("p"), F.concat(a["arg"], F.lit("="), value(a)).alias("x")))), lambda s: s["x"]), ";")
    missing = F.array_join(F.transform(F.filter("spec", lambda a: a["required"] & value(a).isNull()), lambda a: a["arg"]), ",")
    dropped = F.array_join(F.array_sort(F.array_except(F.map_keys("given"), F.transform("spec", lambda a: a["arg"]))), ",")
    return wide.select("o_orderkey", "tool", missing.alias("ask"), written.alias("args"), dropped.alias("dropped"))


@query("er_gold_calls", """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'REF:' || o_orderkey else 'NEW:' || lower(split_part(o_orderpriority, '-', 2)) end as target, 'cancel(' || case when o_orderkey % 3 = 0 then 'REF:' || o_orderkey else 'NEW:' || lower(split_part(o_orderpriority, '-', 2)) end || ')' as call from orders""")
def gold_calls(t: Tables) -> DataFrame:
    """Gold values in canonical form: a reference to a record where the value names one, else the new value itself."""
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Order #"), F.col("o_orderkey").cast("string"))).otherwise(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    number = F.regexp_extract(said, "#([0-9]+)$", 1)
    rows = t.orders.select("o_orderkey", said.alias("said"), number.alias("number"))
    known = t.orders.select(F.col("o_orderkey").cast("string").alias("number"), F.lit(True).alias("known"))
    target = F.when(F.col("known"), F.concat(F.lit("REF:"), "number")).otherwise(F.concat(F.lit("NEW:"), F.lower("said")))
    return rows.join(known, "number", "left").select("o_orderkey", target.alias("target"), F.concat(F.lit("cancel("), target, F.lit(")")).alias("call"))


@query("er_server_shape", """
    select l_orderkey, string_agg('{"name":"add","args":{"part":' || l_partkey || ',"n":' || cast(l_quantity as bigint) || '}}', ';' order by l_linenumber, l_partkey, l_quantity) as calls from lineitem group by 1""")
def server_shape(t: Tables) -> DataFrame:
    """Calls as the server takes them: name and arguments as JSON, in order."""
    call = F.to_json(F.struct(F.lit("add").alias("name"), F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("n")).alias("args")))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", call.alias("call"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["call"]), ";").alias("calls"))


SQL_SCORED = """s as (select o_orderkey, o_orderstatus, o_orderkey % 11 as k from orders), g as (select *, case k when 0 then 'silent' when 1 then 'wrong tool' when 2 then 'missing argument' when 3 then 'wrong argument' when 4 then 'extra argument' when 5 then 'asked' else 'correct' end as failure from s)"""


def scored(t: Tables) -> DataFrame:
    """(o_orderkey, o_orderstatus, gold, pred, failure): gold and predicted calls, compared argument by argument."""
    k, key = F.col("o_orderkey") % 11, F.col("o_orderkey").cast("string")
    call = lambda tool, **args: F.struct(F.lit(tool).alias("tool"), F.create_map(*[x for n, v in args.items() for x in (F.lit(n), v)]).alias("args"))
    gold = call("cancel", order=key, reason=F.lit("late"))
    none = F.lit(None).cast("struct<tool:string,args:map<string,string>>")
    pred = F.when(k == 0, none).when(k == 1, call("track", order=key, reason=F.lit("late"))).when(k == 2, call("cancel", order=key)).when(k == 3, call("cancel", order=key, reason=F.lit("cost"))).when(k == 4, call("cancel", order=key, reason=F.lit("late"), colour=F.lit("red"))).when(k == 5, call("ask", order=key, reason=F.lit("late"))).otherwise(gold)
    rows = t.orders.select("o_orderkey", "o_orderstatus", gold.alias("gold"), pred.alias("pred"))
    keys = lambda c: F.map_keys(F.col(f"{c}.args"))
    differ = F.exists(F.array_intersect(keys("gold"), keys("pred")), lambda a: F.element_at("gold.args", a) != F.element_at("pred.args", a))
    failure = F.when(F.col("pred").isNull(), "silent").when(F.col("pred.tool") == "ask", "asked").when(F.col("pred.tool") != F.col("gold.tool"), "wrong tool").when(F.size(F.array_except(keys("gold"), keys("pred"))) > 0, "missing argument").when(differ, "wrong argument").when(F.size(F.array_except(keys("pred"), keys("gold"))) > 0, "extra argument").otherwise("correct")
    return rows.withColumn("failure", failure)


@query("er_failure_groups", f"with {SQL_SCORED} select failure, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 1) as pct from g group by 1")
def failure_groups(t: Tables) -> DataFrame:
    """Calls scored, and why those that are wrong are."""
    counted = scored(t).groupBy("failure").agg(count_n())
    total = counted.agg(F.sum("n")).scalar()
    return counted.select("failure", "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct"))


@query("ag_headline", f"""
    with {SQL_SCORED} select o_orderstatus, count(*) as n, count(*) filter (where failure not in ('silent', 'wrong tool', 'asked')) as tool_match, count(*) filter (where failure = 'correct') as correct, count(*) filter (where failure = 'asked') as ask, count(*) filter (where failure in ('wrong tool', 'wrong argument', 'extra argument', 'missing argument')) as silent_wrong, count(*) filter (where failure = 'silent') as missed from g group by 1""")
def headline(t: Tables) -> DataFrame:
    """Headline counters of scored calls by type."""
    n = lambda *names: F.count_if(F.col("failure").isin(*names))
    return scored(t).groupBy("o_orderstatus").agg(count_n(), F.count_if(~F.col("failure").isin("silent", "wrong tool", "asked")).alias("tool_match"), n("correct").alias("correct"), n("asked").alias("ask"), n("wrong tool", "wrong argument", "extra argument", "missing argument").alias("silent_wrong"), n("silent").alias("missed"))


@query("ag_argument_headline", f"""
    with {SQL_SCORED}, a as (select 'order' as arg, 'REF' as class, k <> 0 as there, true as equal, false as extra from g union all select 'reason', 'NEW', k not in (0, 2), k <> 3, false from g union all select 'colour', 'NEW', false, false, true from g where k = 4)
    select arg, class, count(*) filter (where there and equal) as ok, count(*) filter (where not there and not extra) as missing, count(*) filter (where extra) as extra, round(2.0 * count(*) filter (where there and equal) / greatest(2 * count(*) filter (where there and equal) + count(*) filter (where there and not equal) * 2 + count(*) filter (where not there and not extra) + count(*) filter (where extra), 1), 6) as f1 from a group by 1, 2""")
def argument_headline(t: Tables) -> DataFrame:
    """For each argument its class (a reference or a new value), and how often it is right, missing or extra."""
    both = F.array_union(F.map_keys("gold.args"), F.coalesce(F.map_keys("pred.args"), F.array().cast("array<string>")))
    rows = scored(t).select("gold", "pred", F.explode(both).alias("arg"))
    g, p = F.try_element_at("gold.args", F.col("arg")), F.try_element_at("pred.args", F.col("arg"))
    ok, missing, extra, wrong = F.count_if(g == p), F.count_if(p.isNull()), F.count_if(g.isNull()), F.count_if(g != p)
    kind = F.when(F.col("arg") == "order", "REF").otherwise("NEW")
    f1 = F.round(ok * 2.0 / F.greatest(ok * 2 + wrong * 2 + missing + extra, F.lit(1)), 6)
    return rows.groupBy("arg", kind.alias("class")).agg(ok.alias("ok"), missing.alias("missing"), extra.alias("extra"), f1.alias("f1"))


@query("er_guarded", f"""
    with {SQL_ENTITIES}, {SQL_MENTIONS} select k as kind, count(*) as n, count(*) filter (where k = 5 or (k = 2 and not exists (select 1 from e where e.c = m.c and kind = 'urgent'))) as held from m group by 1""")
def guarded(t: Tables) -> DataFrame:
    """Calls that are held back as what they name is no entity of the record: counted by how it was named."""
    words = entities(t).groupBy("c").agg(F.collect_set("kind").alias("kinds"), F.collect_set(F.col("id").cast("string")).alias("ids"))
    rows = mentions(t).join(words, "c")
    number = F.regexp_extract("said", "^number ([0-9]+)$", 1)
    held = ((number != "") & ~F.array_contains("ids", number)) | (F.col("said").contains("urgent") & ~F.array_contains("kinds", "urgent"))
    return rows.groupBy((F.col("c") % 6).alias("kind")).agg(count_n(), F.count_if(held).alias("held"))


@query("ag_first_seen_mode", """
    with c as (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2) select user_id, event_type as mode_type, n from c qualify row_number() over (partition by user_id order by n desc, first) = 1""")
def first_seen_mode(t: Tables) -> DataFrame:
    """The most frequent value of a key; of equally frequent ones, the first that was seen."""
    c = t.events.groupBy("user_id", "event_type").agg(count_n(), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "first", "event_type", "n")).alias("m")).select("user_id", F.col("m.event_type").alias("mode_type"), "m.n")


@query("wn_curve_minimum", """
    with d as (select user_id, date_trunc('day', ts) as day, avg(value) filter (where event_type = 'view') as a, avg(value) filter (where event_type = 'click') as b from events group by 1, 2), m as (select *, least(a, b) as v from d)
    select user_id, arg_min(day, (round(v, 9), day)) as day, round(min(v), 6) as least from m where v is not null group by 1""")
def curve_minimum(t: Tables) -> DataFrame:
    """The step at which the lower of two curves is least, of equal ones the first."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    d = t.events.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(mean("view").alias("a"), mean("click").alias("b")).withColumn("v", F.least("a", "b")).where("v is not null")
    return d.groupBy("user_id").agg(F.min_by("day", F.struct(F.round("v", 9).alias("v"), "day")).alias("day"), F.round(F.min("v"), 6).alias("least"))


@query("wn_chronological_pick", f"with {SQL_ENTITIES} select c, max(case when chrono = 2 then id end) as second_earliest, arg_max(id, chrono) filter (where active) as newest_active from e group by 1")
def chronological_pick(t: Tables) -> DataFrame:
    """The nth earliest, and the newest that is active."""
    return entities(t).groupBy("c").agg(F.max(F.when(F.col("chrono") == 2, F.col("id"))).alias("second_earliest"), F.max_by(F.when(F.col("active"), F.col("id")), F.when(F.col("active"), F.col("chrono"))).alias("newest_active"))
