"""Mentions of a customer's orders, made from the tables' own values; the SQL resolves them again by the same rules over pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..sources.tables import written
from .registry import Tables, query

MADE = """
    named as (select l_orderkey, arg_min(p_name, row(l_linenumber, p_partkey)) as name from lineitem join part on p_partkey = l_partkey group by 1),
    e as (select o_custkey as owner, o_orderkey as entity, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as name, o_orderdate as since from orders join named on l_orderkey = o_orderkey),
    said as (select entity as mention, owner, case entity % 9 when 0 then 'cancel order ' || lpad(cast(entity as varchar), 8, '0') when 1 then 'the one ending in ' || right(cast(entity as varchar), 3) when 2 then name when 3 then 'my ' || split_part(name, ' ', -1) || ' please'
        when 4 then 'the second one' when 5 then 'my latest order' when 6 then 'that order' when 7 then 'where is the ' || name || ' now' else 'order ' || (entity + 10) end as raw from e),
    m as (select mention, owner, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) as text from said)"""


RESOLVED = f"""
    with {MADE},
    pairs as (select mention, m.owner, text, string_split(text, ' ') as w, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[0-9]+$')) as runs, entity, cast(entity as varchar) as id, name, since, count(*) over (partition by mention) as n,
        row_number() over (partition by mention order by since, entity) as place, row_number() over (partition by mention order by since desc, entity) as back from m join e on e.owner = m.owner),
    shared as (select owner, k from (select distinct owner, entity, unnest(string_split(name, ' ')) as k from e) group by 1, 2 having count(*) > 1),
    alone as (select owner, list(k) as common from shared group by 1),
    f as (select p.*, len(list_filter(list_distinct(string_split(name, ' ')), lambda x: list_contains(w, x) and not coalesce(list_contains(common, x), false))) as hits, case when contains(' ' || text || ' ', ' ' || name || ' ') and len(string_split(name, ' ')) <= 4 then length(name) else 0 end as held from pairs p left join alone a on a.owner = p.owner),
    g as (select *, max(hits) over (partition by mention) as most, max(held) over (partition by mention) as widest from f),
    r as (
        select mention, 0 as rule, entity from g where text = name union select mention, 1, entity from g where len(list_filter(runs, lambda x: regexp_replace(x, '^0+([0-9])', '\\1') = id)) > 0
        union select mention, 2, entity from g where len(list_filter(runs, lambda x: length(x) >= 3 and (length(x) < length(id) or length(id) = 3) and ends_with(id, x))) > 0
        union select mention, 3, entity from g where length(id) > 3 and len(list_filter(runs, lambda x: length(regexp_replace(x, '^0+([0-9])', '\\1')) = length(id) and levenshtein(regexp_replace(x, '^0+([0-9])', '\\1'), id) <= 1)) > 0
        union select mention, 4, entity from g where (list_contains(w, 'latest') or list_contains(w, 'newest')) and back = 1 union select mention, 4, entity from g where (list_contains(w, 'oldest') or list_contains(w, 'earliest')) and place = 1
        union select mention, 5, entity from g where held > 0 and held = widest union select mention, 6, entity from g where hits > 0 and hits = most
        union select mention, 7, entity from g where list_contains(w, case place when 2 then 'second' when 3 then 'third' when 4 then 'fourth' when 5 then 'fifth' else '-' end) union select mention, 8, entity from g where n = 1),
    u as (select mention, rule, min(entity) as entity from r group by 1, 2 having count(*) = 1), b as (select mention, min(rule) as rule, arg_min(entity, rule) as entity from u group by 1)
    select m.mention, coalesce(list_extract(['exact', 'id', 'block', 'misheard', 'role', 'contains', 'words', 'ordinal', 'only'], rule + 1), 'ask') as rule, entity from m left join b using (mention)"""


@query("er_mentions", RESOLVED)
def mentions(t: Tables) -> DataFrame:
    """Every order mentioned by its id, its end, its name, a word of it, its place, or an id that was misheard."""
    orders = written(owned_orders(t))
    return R.resolve(orders.select(F.col("entity").alias("mention"), "owner", said_of().alias("text")), orders)


def owned_orders(t: Tables, *more: str) -> DataFrame:
    """(owner, entity, name, at, and ``more`` columns of orders): orders, named by their first part; no side is broadcast, as both grow with the tables."""
    lines = t.lineitem.join(t.part.select("p_partkey", "p_name").hint("shuffle_hash"), F.col("p_partkey") == F.col("l_partkey")).repartition("l_orderkey")  # few lines of an order come in one task, so they aren't counted before
    named = lines.groupBy("l_orderkey").agg(F.min_by("p_name", F.struct("l_linenumber", "p_partkey")).alias("name"))
    return t.orders.join(named.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("entity"), "name", F.col("o_orderdate").alias("at"), *more)


def said_of() -> Column:
    """What is said to mean an order, in one of nine ways."""
    key, name = F.col("entity").cast("string"), R.plain(F.col("name"))
    forms = [F.concat(F.lit("cancel order "), F.lpad(key, 8, "0")), F.concat(F.lit("the one ending in "), F.right(key, F.lit(3))), name, F.concat(F.lit("my "), F.substring_index(name, " ", -1), F.lit(" please")), F.lit("the second one"), F.lit("my latest order"), F.lit("that order"), F.concat(F.lit("where is the "), name, F.lit(" now")), F.concat(F.lit("order "), (F.col("entity") + 10).cast("string"))]
    way = F.col("entity") % len(forms)
    return reduce(lambda said, i: said.when(way == i, forms[i]), range(1, len(forms) - 1), F.when(way == 0, forms[0])).otherwise(forms[-1])  # only the one that is said is made
