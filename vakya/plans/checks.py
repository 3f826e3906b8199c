"""Queries on the checks of calls, records and rows: each gives the issues, or counts that tell whether a rule holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import Tables, count_n, query
from .texts import ALNUM, EMAIL


@query("val_all_call_checks", r"""
    with t as (select conv_id, turn, role, text, len(regexp_split_to_array(trim(text), '[ \n]+')) as w, max(turn) over (partition by conv_id) as last, min(turn) over (partition by conv_id) as first from conversations)
    select conv_id, count(*) between 4 and 9 as turn_count, max(case when turn = first and role in ('user', 'system') then 1 else 0 end) = 1 as opens, max(case when turn = last and role = 'assistant' then 1 else 0 end) = 1 as closes, max(w) <= 120 as line_words,
           count(*) filter (where role = 'user' and regexp_matches(text, '[^\x00-\x7F]')) as marked_lines, count(*) filter (where trim(text) = '') as blank, count(distinct turn) = count(*) and max(turn) - min(turn) + 1 = count(*) as no_gaps from t group by 1""")
def all_call_checks(t: Tables) -> DataFrame:
    """Number of turns, first and last line, words of a line, marks, blanks and gaps of each call."""
    per = W.partitionBy("conv_id")
    rows = t.conversations.withColumn("w", F.size(F.split(F.trim("text"), "[ \\n]+"))).withColumn("last", F.max("turn").over(per)).withColumn("first", F.min("turn").over(per))
    some = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    n = F.count(F.lit(1))
    return rows.groupBy("conv_id").agg(
        n.between(4, 9).alias("turn_count"), some((F.col("turn") == F.col("first")) & F.col("role").isin("user", "system")).alias("opens"), some((F.col("turn") == F.col("last")) & (F.col("role") == "assistant")).alias("closes"),
        (F.max("w") <= 120).alias("line_words"), F.count_if((F.col("role") == "user") & F.col("text").rlike("[^\\x00-\\x7F]")).alias("marked_lines"), F.count_if(F.trim("text") == "").alias("blank"),
        ((F.count_distinct("turn") == n) & (F.max("turn") - F.min("turn") + 1 == n)).alias("no_gaps"),
    )


@query("val_language_share", r"""
    with w as (select conv_id, turn, unnest(regexp_split_to_array(lower(text), '[ \n]+')) as word from conversations where turn > 0), l as (select conv_id, turn, count(*) as n, count(*) filter (where regexp_matches(word, '[^\x00-\x7F]')) as marked from w group by 1, 2)
    select conv_id, round(sum(marked) / sum(n), 4) as share, count(*) filter (where marked = 0) as plain_lines, sum(marked) / sum(n) >= 0.05 or count(*) filter (where marked = 0) <= 2 as passes, case when sum(marked) / sum(n) < 0.05 then 'low' when sum(marked) / sum(n) < 0.3 then 'mixed' else 'high' end as band from l group by 1""")
def language_share(t: Tables) -> DataFrame:
    """Share of marked words on free lines, with a floor, a limit of plain lines, and a band."""
    words = t.conversations.where("turn > 0").select("conv_id", "turn", F.explode(F.split(F.lower("text"), "[ \\n]+")).alias("word"))
    lines = words.groupBy("conv_id", "turn").agg(count_n(), F.count_if(F.col("word").rlike("[^\\x00-\\x7F]")).alias("marked"))
    share, plain = F.try_divide(F.sum("marked"), F.sum("n")), F.count_if(F.col("marked") == 0)
    return lines.groupBy("conv_id").agg(F.round(share, 4).alias("share"), plain.alias("plain_lines"), ((share >= 0.05) | (plain <= 2)).alias("passes"), F.when(share < 0.05, "low").when(share < 0.3, "mixed").otherwise("high").alias("band"))


@query("val_forms_agree", r"""
    with j as (select conv_id, role, lower(string_agg(text, ' ' order by turn)) as s from conversations group by 1, 2), c as (select conv_id, role, len(regexp_extract_all(s, '[a-z]er[ .,]')) as a, len(regexp_extract_all(s, '[a-z]e[ .,]')) as b from j)
    select conv_id, role, cast(case role when 'user' then a else b end as bigint) as fitting, cast(case role when 'user' then b else a end as bigint) as wrong, case role when 'user' then a >= b else b >= a end as passes from c""")
def forms_agree(t: Tables) -> DataFrame:
    """Endings that fit a speaker against those that fit the other, over all of a speaker's lines."""
    said = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " "))
    c = t.conversations.groupBy("conv_id", "role").agg(said.alias("s"))
    a, b = F.regexp_count("s", F.lit("[a-z]er[ .,]")).cast("bigint"), F.regexp_count("s", F.lit("[a-z]e[ .,]")).cast("bigint")
    user = F.col("role") == "user"
    fitting, wrong = F.when(user, a).otherwise(b), F.when(user, b).otherwise(a)
    return c.select("conv_id", "role", fitting.alias("fitting"), wrong.alias("wrong"), (fitting >= wrong).alias("passes"))


@query("val_write_structure", """
    with p as (select l_orderkey, l_linenumber, l_returnflag, l_quantity <= 45 as done, date_diff('day', l_shipdate, lead(l_shipdate) over (partition by l_orderkey order by l_linenumber, l_shipdate)) as pause, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_shipdate) - l_linenumber as step from lineitem)
    select l_orderkey, count(*) as planned, count(*) filter (where done) as written, string_agg(l_returnflag, '' order by l_returnflag) = coalesce(string_agg(l_returnflag, '' order by l_returnflag) filter (where done), '') as same_tools, count(*) filter (where step > 1) as gaps, count(*) filter (where pause not between -365 and 365) as long_pauses from p group by 1""")
def write_structure(t: Tables) -> DataFrame:
    """Planned and actual writes of a call as multisets of tools, their order and the pauses between them."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate")
    rows = t.lineitem.select("l_orderkey", "l_returnflag", (F.col("l_quantity") <= 45).alias("done"), F.datediff(F.lead("l_shipdate").over(w), "l_shipdate").alias("pause"), (F.lead("l_linenumber").over(w) - F.col("l_linenumber")).alias("step"))
    tools = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    return rows.groupBy("l_orderkey").agg(count_n().alias("planned"), F.count_if("done").alias("written"), (tools("l_returnflag") == tools(F.when(F.col("done"), F.col("l_returnflag")))).alias("same_tools"), F.count_if(F.col("step") > 1).alias("gaps"), F.count_if(~F.col("pause").between(-365, 365)).alias("long_pauses"))


@query("val_check_like", r"""
    select conv_id, count(*) filter (where regexp_matches(lower(text), '(^|[^a-z])(the|die|les?)[^a-z]') and turn % 3 <> 1) as outside, count(*) filter (where regexp_matches(lower(text), '(^|[^a-z])(the|die|les?)[^a-z]') and turn % 3 = 1) as inside from conversations where role = 'assistant' group by 1""")
def check_like(t: Tables) -> DataFrame:
    """Lines that read like check lines outside the turns that the structure has for them."""
    like, slot = F.lower("text").rlike("(^|[^a-z])(the|die|les?)[^a-z]"), F.col("turn") % 3 == 1
    return t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.count_if(like & ~slot).alias("outside"), F.count_if(like & slot).alias("inside"))


@query("val_claims", """
    with e as (select event_id, user_id, event_type, json_extract_string(props, '$.k') as k, ts from events), c as (select user_id, k, min(ts) as first from e where event_type = 'click' group by 1, 2)
    select e.user_id, count(*) as claims, count(*) filter (where c.first is null or c.first >= e.ts) as unconfirmed from e left join c on e.user_id = c.user_id and e.k = c.k where event_type = 'purchase' group by 1""")
def claims(t: Tables) -> DataFrame:
    """Claims of a done action whose value no earlier confirmation has."""
    e = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "ts")
    confirmed = e.where("event_type = 'click'").groupBy("user_id", "k").agg(F.min("ts").alias("first"))
    found = e.where("event_type = 'purchase'").join(confirmed, ["user_id", "k"], "left")
    return found.groupBy("user_id").agg(count_n().alias("claims"), F.count_if(F.col("first").isNull() | (F.col("first") >= F.col("ts"))).alias("unconfirmed"))


@query("val_provenance", """
    select l_shipmode, count(*) as n, count(p_partkey) as known_part, count(s_suppkey) as known_supplier, count(*) filter (where l_extendedprice > l_quantity * p_retailprice * 2) as odd_price from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem) left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey group by 1""")
def provenance(t: Tables) -> DataFrame:
    """Written values and the records they come from: the part, the supplier, and a price that fits."""
    wide = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return wide.groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).agg(count_n(), F.count("p_partkey").alias("known_part"), F.count("s_suppkey").alias("known_supplier"), F.count_if(F.col("l_extendedprice") > F.col("l_quantity") * F.col("p_retailprice") * 2).alias("odd_price"))


@query("val_two_parts", f"""
    with w as (select conv_id, turn, role, {ALNUM.format('text')} as w from conversations), l as (select conv_id, turn, role, w[-1] as last_word, lead(role) over o as next_role, lead(w[1]) over o as next_word, lead(role, 2) over o as third from w window o as (partition by conv_id order by turn))
    select conv_id, count(*) as parts, count(*) filter (where next_role = 'assistant' and third = 'user') as asked_between, count(*) filter (where next_word = last_word) as echoed from l where role = 'user' group by 1""")
def two_parts(t: Tables) -> DataFrame:
    """Values said in two parts: the other speaker asks between them."""
    o = W.partitionBy("conv_id").orderBy("turn")
    tokens = X.alnum_tokens(F.col("text"))
    rows = t.conversations.select("conv_id", "role", F.try_element_at(tokens, F.lit(-1)).alias("last_word"), F.lead("role").over(o).alias("next_role"), F.lead(F.try_element_at(tokens, F.lit(1))).over(o).alias("next_word"), F.lead("role", 2).over(o).alias("third"))
    return rows.where("role = 'user'").groupBy("conv_id").agg(count_n().alias("parts"), F.count_if((F.col("next_role") == "assistant") & (F.col("third") == "user")).alias("asked_between"), F.count_if(F.col("next_word") == F.col("last_word")).alias("echoed"))


@query("val_numbers_known", """
    with e as (select event_id, user_id, json_extract_string(props, '$.k') as k, ts, event_type from events)
    select event_type, count(*) as n, count(*) filter (where rn > 1) as seen_before from (select *, row_number() over (partition by user_id, k order by ts, event_id) as rn from e) group by 1""")
def numbers_known(t: Tables) -> DataFrame:
    """Numbers that a speaker has used before, by kind of line."""
    k = F.get_json_object("props", "$.k")
    first = F.row_number().over(W.partitionBy("user_id", k).orderBy("ts", "event_id"))
    return t.events.withColumn("rn", first).groupBy("event_type").agg(count_n(), F.count_if(F.col("rn") > 1).alias("seen_before"))


@query("val_style", f"""
    with o as (select conv_id, {ALNUM.format('text')} as w, lower(text) as x from conversations where turn = 0), l as (select conv_id, w, lag(w) over (order by conv_id) as b, x from o)
    select conv_id, round(len(list_intersect(w, b)) / greatest(len(list_distinct(w)), 1), 6) as opening_like_last, regexp_matches(x, '(^|[^a-z])(die|la|the)([^a-z]|$)') as banned, len(w) - len(list_distinct(w)) as repeats from l where b is not null""")
def style(t: Tables) -> DataFrame:
    """Openings compared with the one before by their words, banned words, repeats."""
    w = X.alnum_tokens(F.col("text"))
    calls = t.conversations.where("turn = 0").select("conv_id", w.alias("w"), F.lower("text").alias("x"))
    last = t.conversations.where("turn = 0").select("conv_id", w.alias("b"))
    # The call before by id: ids are dealt into ranges, and the range before gives its greatest id.
    ranges = calls.select("conv_id", F.floor(F.col("conv_id") / 1000).alias("r"))
    tops = ranges.groupBy("r").agg(F.max("conv_id").alias("top"))
    before_range = tops.select("r", F.lag("top").over(W.orderBy("r")).alias("carried"))  # one row for each thousand calls
    within = F.lag("conv_id").over(W.partitionBy("r").orderBy("conv_id"))
    links = ranges.withColumn("within", within).join(before_range, "r").select("conv_id", F.coalesce("within", "carried").alias("before"))
    wide = calls.join(links.where("before is not null"), "conv_id").join(last.withColumnRenamed("conv_id", "before"), "before")
    distinct = F.size(F.array_distinct("w"))
    return wide.select("conv_id", F.round(F.size(F.array_intersect("w", "b")) / F.greatest(distinct, F.lit(1)), 6).alias("opening_like_last"), F.col("x").rlike("(^|[^a-z])(die|la|the)([^a-z]|$)").alias("banned"), (F.size("w") - distinct).cast("bigint").alias("repeats"))


@query("val_records", rf"""
    with x as (select doc_id, list_distinct(regexp_extract_all(text, '{EMAIL}')) as mails, list_distinct(regexp_extract_all(text, '[0-9]{{3,}}')) as ids, list_distinct(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) as dates, regexp_extract_all(source, '[0-9]+') as allowed, len(regexp_split_to_array(trim(text), '[ \n]+')) as words from documents)
    select doc_id, len(mails) as mails, len(list_filter(mails, lambda m: not ends_with(lower(m), 'example.com'))) as foreign_mails, len(list_filter(ids, lambda i: not list_contains(allowed, i))) as unknown_ids, len(list_filter(dates, lambda d: cast(substr(d, 6, 2) as int) not between 1 and 12)) as bad_dates, words <= 2000 as within_words from x""")
def records(t: Tables) -> DataFrame:
    """What a record may say: mails of the domain, numbers of its bundle, dates that exist, a limit of words."""
    each = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    x = t.documents.select("doc_id", each(EMAIL).alias("mails"), each("[0-9]{3,}").alias("ids"), each("[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("dates"), F.regexp_extract_all("source", F.lit("[0-9]+"), F.lit(0)).alias("allowed"), F.size(F.split(F.trim("text"), "[ \\n]+")).alias("words"))
    n = lambda c: F.size(c).cast("bigint")
    return x.select(
        "doc_id", n("mails").alias("mails"), n(F.filter("mails", lambda m: ~F.lower(m).endswith("example.com"))).alias("foreign_mails"), n(F.array_except("ids", "allowed")).alias("unknown_ids"),
        n(F.filter("dates", lambda d: ~F.substring(d, 6, 2).cast("int").between(1, 12))).alias("bad_dates"), (F.col("words") <= 2000).alias("within_words"),
    )


@query("val_scenarios", """
    with k as (select p_partkey, p_name, p_brand, list_aggregate(list_sort(string_split(lower(p_name), ' ')), 'string_agg', ' ') as key from part)
    select p_partkey, len(string_split(p_name, ' ')) between 2 and 3 as shape, regexp_matches(p_name, 'old|bolt') as banned, count(*) over (partition by p_brand, key) as same_title from k""")
def scenarios(t: Tables) -> DataFrame:
    """Shape, banned words and near-duplicate titles: the same words in any order within a brand."""
    key = F.array_join(F.array_sort(F.split(F.lower("p_name"), " ")), " ")
    k = t.part.select("p_partkey", "p_name", "p_brand", key.alias("key"))
    same = k.groupBy("p_brand", "key").agg(count_n().alias("same_title"))
    return k.join(same, ["p_brand", "key"]).select("p_partkey", F.size(F.split("p_name", " ")).between(2, 3).alias("shape"), F.col("p_name").rlike("old|bolt").alias("banned"), "same_title")


@query("val_row_issues", """
    with i as (select unnest([case when p_name is null or p_name = '' then 'empty name' end, case when p_type not in ('PROMO', 'SMALL', 'MEDIUM') then 'unknown type' end, case when p_size > 40 then 'size too great' end, case when p_retailprice > 1000 then 'price too high' end, case when len(string_split(p_name, ' ')) > 2 then 'extra words' end]) as issue, p_partkey from part)
    select issue, count(*) as n, min(p_partkey) as first from i where issue is not null group by 1""")
def row_issues(t: Tables) -> DataFrame:
    """Rows against their contract: values in lists, limits, non-empty strings; each issue with its count and first row."""
    rule = lambda c, name: F.when(c, name)
    issues = F.array(
        rule(F.col("p_name").isNull() | (F.col("p_name") == ""), "empty name"), rule(~F.col("p_type").isin("PROMO", "SMALL", "MEDIUM"), "unknown type"), rule(F.col("p_size") > 40, "size too great"),
        rule(F.col("p_retailprice") > 1000, "price too high"), rule(F.size(F.split("p_name", " ")) > 2, "extra words"),
    )
    return t.part.select("p_partkey", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue")).groupBy("issue").agg(count_n(), F.min("p_partkey").alias("first"))


@query("val_prepared_twice", r"""
    with a as (select lang, text, trim(regexp_replace(text, '[ \n]+', ' ', 'g')) as once from documents) select lang, count(*) as n, count(*) filter (where text <> once) as changed, count(*) filter (where once <> trim(regexp_replace(once, '[ \n]+', ' ', 'g'))) as changed_again from a group by 1""")
def prepared_twice(t: Tables) -> DataFrame:
    """Preparing text twice changes nothing more: rows that the first and the second pass change."""
    prepare = lambda c: F.trim(F.regexp_replace(c, "[ \\n]+", " "))
    a = t.documents.select("lang", "text", prepare("text").alias("once"))
    return a.groupBy("lang").agg(count_n(), F.count_if(F.col("text") != F.col("once")).alias("changed"), F.count_if(F.col("once") != prepare("once")).alias("changed_again"))


@query("val_conflicts", """
    with l as (select l_orderkey, count(*) filter (where l_linestatus = 'O') as open_lines, count(*) as n, min(l_shipdate) as first from lineitem group by 1)
    select o_orderkey, case when o_orderstatus = 'F' and open_lines > 0 then 'finished with open lines' when o_orderstatus = 'O' and open_lines = 0 then 'open without open lines' when first < o_orderdate then 'shipped before ordered' else 'pending' end as conflict, n from orders join l on l_orderkey = o_orderkey
    where (o_orderstatus = 'F' and open_lines > 0) or (o_orderstatus = 'O' and open_lines = 0) or first < o_orderdate""")
def conflicts(t: Tables) -> DataFrame:
    """Records that contradict one another; the first rule that applies names the conflict."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), count_n(), F.min("l_shipdate").alias("first"))
    status = F.col("o_orderstatus")
    rule = F.when((status == "F") & (F.col("open_lines") > 0), "finished with open lines").when((status == "O") & (F.col("open_lines") == 0), "open without open lines").when(F.col("first") < F.col("o_orderdate"), "shipped before ordered")
    return t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", rule.alias("conflict"), "n").where("conflict is not null")


@query("val_interruptions", """
    with l as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next from conversations)
    select conv_id, count(*) filter (where role = 'assistant' and next = 'user' and not regexp_matches(trim(text), '[.!?]$')) as cut_off, count(*) filter (where role = 'assistant' and next = 'user' and not regexp_matches(trim(text), '[.!?]$')) = 1 as exactly_one from l group by 1""")
def interruptions(t: Tables) -> DataFrame:
    """Lines without a final mark that the other speaker follows; a call should have exactly one."""
    rows = t.conversations.withColumn("next", F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")))
    cut = F.count_if((F.col("role") == "assistant") & (F.col("next") == "user") & ~F.trim("text").rlike("[.!?]$"))
    return rows.groupBy("conv_id").agg(cut.alias("cut_off"), (cut == 1).alias("exactly_one"))
