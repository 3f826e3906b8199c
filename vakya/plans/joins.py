"""Queries on joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import Tables, query


def seconds(col: str = "ts"):
    return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / 1000000).cast("bigint")


def ordered_text(sep: str = " "):
    """Texts of a group in the order of their turns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), sep)


@query("jn_equi_inner", """
    select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def equi_inner(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query("jn_ordered_concat", """
    select conv_id, role, md5(string_agg(text, ' ' order by turn)) as joined, count(*) as n from conversations group by 1, 2""")
def ordered_concat(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id", "role").agg(F.md5(ordered_text()).alias("joined"), F.count(F.lit(1)).alias("n"))


@query("jn_missing_counters", """
    select source, count(*) as docs, count(*) filter (where l.doc_id is null) as missing, round(avg(quality), 6) as quality from documents d left join labels l using (doc_id) group by 1""")
def missing_counters(t: Tables) -> DataFrame:
    side = t.labels.select("doc_id", "quality", F.lit(1).alias("there"))
    return t.documents.select("doc_id", "source").join(side, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("there").isNull()).alias("missing"), F.round(F.avg("quality"), 6).alias("quality"))


@query("jn_semi", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("jn_anti", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query("jn_leak_check", """
    with s as (select distinct o_custkey, case when o_orderdate < timestamp '1996-01-01' then 'early' when o_orderdate < timestamp '1998-01-01' then 'middle' else 'late' end as part from orders)
    select a.part as a, b.part as b, count(*) as shared from s a join s b using (o_custkey) where a.part < b.part group by 1, 2""")
def leak_check(t: Tables) -> DataFrame:
    """Keys that two splits share: each key's splits are gathered once (at most three), then paired."""
    part = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "early").when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "middle").otherwise("late")
    parts = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(part)).alias("parts"))
    pairs = F.flatten(F.transform("parts", lambda a: F.transform(F.filter("parts", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return parts.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))


@query("jn_text_overlap", """
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select doc_id, count(*) as shared from l where lower(trim(line)) in (select lower(trim(unnest(string_split(text, chr(10))))) from benchmark) group by 1""")
def text_overlap(t: Tables) -> DataFrame:
    """Lines that are lines of a benchmark item."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", F.lower(F.trim("line")))
    return lines.join(t.benchmark.select(F.explode(F.split("text", "\n")).alias("text")).select(F.lower(F.trim("text")).alias("key")).distinct(), "key", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


@query("jn_pairing_ids", """
    select n_name || '_g' || g as call_id, n_nationkey, g from nation, (select unnest([1, 2, 3, 4]) as g)""")
def pairing_ids(t: Tables) -> DataFrame:
    """Every nation with each of four fixed pairings."""
    return t.nation.select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("g")).select(F.concat("n_name", F.lit("_g"), F.col("g").cast("string")).alias("call_id"), "n_nationkey", "g")


@query("jn_interval_overlap", """
    with e as (select event_id, user_id, event_type, epoch_us(ts) // 1000000 as s from events), a as (select *, s + 1800 as z from e where event_type = 'error'), b as (select *, s + 600 as z from e where event_type = 'click')
    select a.event_id as error_id, b.event_id as click_id, least(a.z, b.z) - greatest(a.s, b.s) as overlap_s,
           case when b.s >= a.s and b.z <= a.z then 'full' else 'partial' end as coverage from a join b on a.user_id = b.user_id and b.z > a.s and b.s < a.z""")
def interval_overlap(t: Tables) -> DataFrame:
    base = t.events.select("event_id", "user_id", "event_type", seconds().alias("s"))
    spans = lambda kind, n: base.where(F.col("event_type") == kind).select("event_id", "user_id", "s", (F.col("s") + n).alias("z"))
    found = J.interval_overlap(spans("error", 1800), spans("click", 600), "user_id", "s", "z", 3600)
    whole = (F.col("b.s") >= F.col("a.s")) & (F.col("b.z") <= F.col("a.z"))
    return found.select(F.col("a.event_id").alias("error_id"), F.col("b.event_id").alias("click_id"), (F.least("a.z", "b.z") - F.greatest("a.s", "b.s")).alias("overlap_s"), F.when(whole, "full").otherwise("partial").alias("coverage"))


@query("jn_asof_backward", """
    select p.event_id, max_by(e.event_id, row(e.ts, e.event_id)) as last_error from (select * from events where event_type = 'purchase') p left join (select * from events where event_type = 'error') e on p.user_id = e.user_id and e.ts < p.ts group by 1""")
def asof_backward(t: Tables) -> DataFrame:
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    return J.nearest_before(of("purchase"), of("error"), "user_id", "ts", F.col("event_id"), "event_id", "last_error").select("event_id", "last_error")


@query("jn_asof_forward", """
    select e.event_id, coalesce(min(epoch_us(p.ts) // 1000000), 1000000000000) as next_s from (select * from events where event_type = 'error') e left join (select * from events where event_type = 'purchase') p on p.user_id = e.user_id and p.ts > e.ts group by 1""")
def asof_forward(t: Tables) -> DataFrame:
    """The next purchase after each error, or far away."""
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "error", 1).otherwise(0), "event_id").rowsBetween(1, W.unboundedFollowing)
    at = F.first(F.when(F.col("event_type") == "purchase", seconds()), ignorenulls=True).over(w)
    return t.events.where("event_type in ('error', 'purchase')").select("event_id", "event_type", F.coalesce(at, F.lit(1000000000000)).alias("next_s")).where("event_type = 'error'").drop("event_type")


@query("jn_interval_assign", """
    with u as (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as nxt from conversations where role = 'user')
    select u.conv_id, u.turn, max(c.turn) as last_answer from u left join conversations c on c.conv_id = u.conv_id and c.role = 'assistant' and c.turn > u.turn and (u.nxt is null or c.turn < u.nxt) group by 1, 2""")
def interval_assign(t: Tables) -> DataFrame:
    """The last answer between a user turn and the next one: the user turn before each answer decides, so no range join is needed."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    marked = t.conversations.select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))
    answers = marked.where("role = 'assistant' and asked is not null").groupBy("conv_id", F.col("asked").alias("turn")).agg(F.max("turn").alias("last_answer"))
    return marked.where("role = 'user'").select("conv_id", "turn").join(answers, ["conv_id", "turn"], "left")


@query("jn_equal_then_range", """
    with w as (select user_id, event_id, epoch_us(ts) // 1000000 as s from events where event_type = 'purchase'), c as (select user_id, event_id, epoch_us(ts) // 1000000 as s from events where event_type = 'view')
    select w.event_id, max(c.s) filter (where c.s = w.s) as exact, max(c.s) filter (where c.s < w.s and c.s >= w.s - 7200) as near,
           case when max(c.s) filter (where c.s = w.s) is not null then 'exact' when max(c.s) filter (where c.s < w.s and c.s >= w.s - 7200) is not null then 'range' else 'none' end as how
    from w left join c on w.user_id = c.user_id and c.s <= w.s and c.s >= w.s - 7200 group by 1""")
def equal_then_range(t: Tables) -> DataFrame:
    """An exact match in time, else the last one within two hours: one frame over the union."""
    rows = t.events.where("event_type in ('purchase', 'view')").select("user_id", "event_id", "event_type", seconds().alias("s"))
    seen = F.when(F.col("event_type") == "view", F.col("s"))
    near = F.max(seen).over(W.partitionBy("user_id").orderBy("s").rangeBetween(-7200, -1))
    exact = F.max(seen).over(W.partitionBy("user_id").orderBy("s").rangeBetween(0, 0))
    found = rows.select("event_id", "event_type", exact.alias("exact"), near.alias("near")).where("event_type = 'purchase'")
    return found.select("event_id", "exact", "near", F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "range").otherwise("none").alias("how"))


@query("jn_window_concat", """
    with a as (select conv_id, turn from conversations where role = 'assistant')
    select a.conv_id, a.turn, count(c.turn) as n, md5(coalesce(string_agg(c.text, ' ' order by c.turn), '')) as joined from a left join conversations c on c.conv_id = a.conv_id and c.turn between a.turn - 2 and a.turn - 1 group by 1, 2""")
def window_concat(t: Tables) -> DataFrame:
    """The two turns before each answer, joined in order."""
    w = W.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, -1)
    near = F.array_sort(F.collect_list(F.struct("turn", "text")).over(w))
    text = F.array_join(F.transform(near, lambda x: x["text"]), " ")
    return t.conversations.select("conv_id", "turn", "role", F.size(near).cast("bigint").alias("n"), F.md5(text).alias("joined")).where("role = 'assistant'").drop("role")


@query("jn_argmax_overlap", """
    with w as (select distinct conv_id, turn, role, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from conversations),
    p as (select a.conv_id, a.turn, u.turn as j, count(*) as score from w a join w u on a.conv_id = u.conv_id and a.word = u.word and u.role = 'user' and u.turn < a.turn where a.role = 'assistant' and a.word <> '' group by 1, 2, 3)
    select conv_id, turn, max_by(j, row(score, j)) as best, max(score) as score from p group by 1, 2""")
def argmax_overlap(t: Tables) -> DataFrame:
    """The earlier user turn that shares most words with an answer; ties: the later one."""
    words = t.conversations.select("conv_id", "turn", "role", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where("word <> ''")
    asked = words.where("role = 'user'").select("conv_id", "word", F.col("turn").alias("j"))
    pairs = words.where("role = 'assistant'").join(asked, ["conv_id", "word"]).where("j < turn").groupBy("conv_id", "turn", "j").agg(F.count(F.lit(1)).alias("score"))
    best = F.max(F.struct("score", "j"))
    return pairs.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.j").alias("best"), F.col("b.score").alias("score"))


@query("jn_paired_outcomes", """
    with a as (select doc_id, quality = 1 as ok from labels), b as (select doc_id, n_chars > 1500 as ok from documents where doc_id % 3 <> 0), w as (select coalesce(a.ok, false) as l, coalesce(b.ok, false) as r from a full join b using (doc_id))
    select count(*) filter (where l and r) as both, count(*) filter (where l and not r) as only_left, count(*) filter (where not l and r) as only_right, count(*) filter (where not l and not r) as neither from w""")
def paired_outcomes(t: Tables) -> DataFrame:
    """Two judgements of documents, either of which may be missing."""
    return J.set_report(t.labels, t.documents.where("doc_id % 3 <> 0"), "doc_id", F.col("quality") == 1, F.col("n_chars") > 1500)


@query("jn_deltas", """
    with a as (select c_nationkey as k, avg(c_acctbal) as x from customer group by 1), b as (select s_nationkey as k, avg(s_acctbal) as y from supplier group by 1)
    select k, round(x, 6) as customers, round(y, 6) as suppliers, round(x - y, 6) as delta from a join b using (k)""")
def deltas(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y"))
    return a.join(b, "k").select("k", F.round("x", 6).alias("customers"), F.round("y", 6).alias("suppliers"), F.round(F.col("x") - F.col("y"), 6).alias("delta"))


@query("jn_row_diff", """
    select doc_id, n_chars, length(text) as counted from documents where n_chars is distinct from length(text)""")
def row_diff(t: Tables) -> DataFrame:
    """Rows where two counts of the same thing differ."""
    a, b = t.documents.select("doc_id", "n_chars"), t.documents.select("doc_id", F.length("text").cast("bigint").alias("counted"))
    return a.join(b, "doc_id").where(~F.col("n_chars").eqNullSafe(F.col("counted")))


@query("set_union_rows", """
    select l_orderkey as k, 'line' as kind, count(*) as n from lineitem group by 1 union all select o_orderkey, 'order', count(*) from orders group by 1""")
def union_rows(t: Tables) -> DataFrame:
    of = lambda df, key, kind: df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k", F.lit(kind).alias("kind"), "n")
    return of(t.lineitem, "l_orderkey", "line").unionByName(of(t.orders, "o_orderkey", "order"))


@query("set_algebra", """
    select 'both' as part, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all
    select 'documents only', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'labels only', count(*) from (select doc_id from labels except select doc_id from documents)""")
def set_algebra(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b).distinct(), "documents only")).unionByName(count(b.exceptAll(a).distinct(), "labels only"))


@query("set_equal_assert", """
    select count(*) = 0 as equal from ((select distinct o_custkey as k from orders except select c_custkey from customer) union all (select c_custkey from customer except select o_custkey from orders))""")
def set_equal(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    return a.subtract(b).unionByName(b.subtract(a)).agg((F.count(F.lit(1)) == 0).alias("equal"))


@query("set_resumable_todo", """
    select o_orderkey, o_custkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_linenumber = 1)""")
def resumable(t: Tables) -> DataFrame:
    """Work that has no result yet."""
    done = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("set_override_merge", """
    select doc_id, coalesce(l.quality, 0) as quality, l.doc_id is not null as fresh from documents d left join labels l using (doc_id)""")
def override_merge(t: Tables) -> DataFrame:
    """Old rows, where new ones exist for the key the new ones."""
    new = t.labels.select("doc_id", F.col("quality"), F.lit(True).alias("fresh"))
    old = t.documents.select("doc_id", F.lit(0).alias("quality"), F.lit(False).alias("fresh")).join(new, "doc_id", "left_anti")
    return new.join(t.documents, "doc_id", "left_semi").unionByName(old)
