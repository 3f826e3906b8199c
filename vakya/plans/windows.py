"""Queries over ordered turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import windows as O
from .registry import Tables, query
from .sampling import HC

WORDS_SQL = "len(list_filter(string_split_regex(trim(text), '[ \\t\\n\\r]+'), lambda w: w <> ''))"


def n_words(col: str = "text"):
    return F.size(F.filter(F.split(F.trim(F.col(col)), "[ \\t\\n\\r]+"), lambda w: w != "")).cast("bigint")


@query("flagship_conversation_report", f"""
    with t as (select conv_id, turn, role, {WORDS_SQL} as words, case when {HC} < 0.4 then 'short' when {HC} < 0.8 then 'medium' else 'long' end as split,
                      last_value(role) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as last_role from conversations),
    c as (select split, role, conv_id, avg(words) as m from t group by 1, 2, 3),
    a as (select split, role, count(distinct conv_id) as conversations, count(*) as turns, round(avg(words), 6) as mean_words, quantile_cont(words::double, 0.5) as median_words,
                 round(count(distinct conv_id) filter (where last_role = 'user') / count(distinct conv_id), 6) as unanswered from t group by 1, 2)
    select a.*, round(s.mean_of_means, 6) as mean_of_means, round(s.std_of_means, 6) as std_of_means from a join (select split, role, avg(m) as mean_of_means, stddev_pop(m) as std_of_means from c group by 1, 2) s using (split, role)""")
def flagship(t: Tables) -> DataFrame:
    """For each hash split and role: conversations, turns, words a turn, the spread of means, and the share without a last answer."""
    whole = W.partitionBy("conv_id")
    turns = t.conversations.select("conv_id", "turn", "role", n_words().alias("words"), H.band(H.h01(F.col("conv_id")), [(0.4, "short"), (0.8, "medium")], "long").alias("split"), F.max_by("role", "turn").over(whole).alias("last_role"))
    means = turns.groupBy("split", "role", "conv_id").agg(F.avg("words").alias("m")).groupBy("split", "role").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.stddev_pop("m"), 6).alias("std_of_means"))
    open_ = F.countDistinct(F.when(F.col("last_role") == "user", F.col("conv_id")))
    found = turns.groupBy("split", "role").agg(
        F.countDistinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("turns"), F.round(F.avg("words"), 6).alias("mean_words"),
        F.expr("percentile(words, 0.5)").alias("median_words"), F.round(open_ / F.countDistinct("conv_id"), 6).alias("unanswered"),
    )
    return found.join(means, ["split", "role"])


@query("wn_lag_lead_structure", """
    select conv_id, turn, role, lag(role) over w as before, lead(role) over w as after,
           coalesce(role = 'assistant' and (lag(role) over w <> 'user' or lag(role) over w is null), false) as broken
    from conversations window w as (partition by conv_id order by turn)""")
def lag_lead(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    prior = F.lag("role").over(w)
    return t.conversations.select("conv_id", "turn", "role", prior.alias("before"), F.lead("role").over(w).alias("after"), F.coalesce((F.col("role") == "assistant") & ((prior != "user") | prior.isNull()), F.lit(False)).alias("broken"))


@query("wn_first_last_turn", """
    select conv_id, min_by(role, turn) as first_role, max_by(role, turn) as last_role, max(turn) as last_turn, count(*) as turns from conversations group by 1""")
def first_last(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns"))


@query("wn_seen_so_far", """
    with w as (select distinct conv_id, turn, role, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from conversations),
    f as (select conv_id, word, min(turn) as first_user from w where role = 'user' group by 1, 2)
    select a.conv_id, a.turn, count(*) as words, count(*) filter (where f.first_user < a.turn) as seen from w a left join f using (conv_id, word)
    where a.role = 'assistant' and a.word <> '' group by 1, 2""")
def seen_so_far(t: Tables) -> DataFrame:
    """Words of an answer that an earlier user turn has: the running set is the first turn of each word."""
    words = t.conversations.select("conv_id", "turn", "role", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where("word <> ''")
    first = words.where("role = 'user'").groupBy("conv_id", "word").agg(F.min("turn").alias("first_user"))
    return words.where("role = 'assistant'").join(first, ["conv_id", "word"], "left").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("first_user") < F.col("turn")).alias("seen"))


@query("wn_previous_value", """
    select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as previous_purchase,
           first_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as next_error from events""")
def previous_value(t: Tables) -> DataFrame:
    order = ["ts", "event_id"]
    found = O.before(t.events, "user_id", order, F.when(F.col("event_type") == "purchase", F.col("event_id")), "previous_purchase")
    return O.after(found, "user_id", order, F.when(F.col("event_type") == "error", F.col("event_id")), "next_error").select("event_id", "previous_purchase", "next_error")


@query("wn_type_islands", """
    with f as (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type then 1 else 0 end as new from events),
    i as (select *, sum(new) over (partition by user_id order by ts, event_id) as island from f)
    select user_id, cast(island as bigint) as island, min(event_type) as event_type, count(*) as n, min(event_id) as least_id, round(sum(value), 6) as total from i group by 1, 2""")
def type_islands(t: Tables) -> DataFrame:
    """Runs of events of one type."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    marked = t.events.withColumn("new", ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type")))
    return O.islands(marked, ["user_id"], ["ts", "event_id"], F.col("new")).groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_id"), F.round(F.sum("value"), 6).alias("total"))


@query("wn_gap_segments", """
    with f as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 3600 seconds then 1 else 0 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as segment from f)
    select user_id, cast(segment as bigint) as segment, count(*) as n, min(ts) as start, max(ts) as stop, array_to_string(list(event_type order by ts, event_id), ' ') as types from s group by 1, 2""")
def gap_segments(t: Tables) -> DataFrame:
    """Sessions: a new segment after an hour of silence."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return O.gap_segments(t.events, "user_id", "ts", "event_id", 3600).groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"), text.alias("types"))


@query("wn_last_two", """
    select event_id, user_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 2""")
def last_two(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("event_id", "user_id")


@query("wn_best_try", """
    select l_orderkey, min(l_discount) as discount, arg_min(l_linenumber, row(l_discount, l_linenumber)) as line from lineitem group by 1""")
def best_try(t: Tables) -> DataFrame:
    """The least discount of an order, ties by line."""
    best = F.min(F.struct("l_discount", "l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", F.col("b.l_discount").alias("discount"), F.col("b.l_linenumber").alias("line"))


@query("wn_first_passing", """
    select o_custkey, min(o_orderkey) filter (where o_orderstatus = 'F') as first_pass, count(*) as tries from orders group by 1""")
def first_passing(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("first_pass"), F.count(F.lit(1)).alias("tries"))


@query("wn_conditional_retry", """
    select o_orderkey, coalesce(bool_and(o_orderstatus <> 'F') over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), true) as runs from orders""")
def conditional_retry(t: Tables) -> DataFrame:
    """A try runs only if all earlier ones failed."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", F.coalesce(F.bool_and(F.col("o_orderstatus") != "F").over(w), F.lit(True)).alias("runs"))


@query("wn_timeline_offsets", """
    select conv_id, turn, length(text) as size, coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start from conversations""")
def timeline(t: Tables) -> DataFrame:
    """Running starts of turns laid end to end with a gap of two."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("size"), F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("bigint").alias("start"))


@query("wn_reuse_cap", """
    select o_orderkey, o_custkey from (select o_orderkey, o_custkey, dense_rank() over (partition by o_custkey order by o_orderkey) as r from orders) where r > 3""")
def reuse_cap(t: Tables) -> DataFrame:
    """Uses of a value beyond the first three."""
    return t.orders.withColumn("r", F.dense_rank().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("r > 3").select("o_orderkey", "o_custkey")


@query("wn_noise_floor", """
    select event_id, round(quantile_cont(value, 0.1) over (partition by user_id order by ts, event_id rows between 19 preceding and current row), 6) as floor from events""")
def noise_floor(t: Tables) -> DataFrame:
    """A low percentile of the last twenty values."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return t.events.select("event_id", F.round(F.expr("percentile(value, 0.1)").over(w), 6).alias("floor"))


@query("wn_quiet_run", """
    with f as (select *, sum(case when value >= 50 then 1 else 0 end) over (partition by user_id order by ts, event_id) as loud from events)
    select event_id, case when value >= 50 then 0 else row_number() over (partition by user_id, loud order by ts, event_id) - case when loud > 0 then 1 else 0 end end as quiet from f""")
def quiet_run(t: Tables) -> DataFrame:
    """Quiet events in a row up to each event."""
    loud = F.col("value") >= 50
    marked = O.islands(t.events, ["user_id"], ["ts", "event_id"], loud, "loud")
    n = F.row_number().over(W.partitionBy("user_id", "loud").orderBy("ts", "event_id"))
    return marked.select("event_id", F.when(loud, 0).otherwise(n - F.when(F.col("loud") > 0, 1).otherwise(0)).cast("bigint").alias("quiet"))


@query("wn_longest_run", """
    with f as (select *, sum(case when value >= 50 then 1 else 0 end) over (partition by user_id order by ts, event_id) as loud from events),
    r as (select user_id, loud, count(*) filter (where value < 50) as n from f group by 1, 2)
    select user_id, max(n) as longest from r group by 1""")
def longest_run(t: Tables) -> DataFrame:
    marked = O.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("value") >= 50, "loud")
    return marked.groupBy("user_id", "loud").agg(F.count_if(F.col("value") < 50).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("wn_clamped_padding", """
    select event_id, round(greatest(epoch_us(ts) / 1000000.0 - 60, coalesce((epoch_us(ts) + epoch_us(lag(ts) over w)) / 2000000.0, 0)), 3) as start_s,
           round(least(epoch_us(ts) / 1000000.0 + 60, coalesce((epoch_us(ts) + epoch_us(lead(ts) over w)) / 2000000.0, 1e12)), 3) as stop_s from events window w as (partition by user_id order by ts, event_id)""")
def clamped_padding(t: Tables) -> DataFrame:
    """A minute around each event, but not beyond the middle to its neighbours."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = lambda other: (at + other) / F.lit(2000000.0)
    return t.events.select(
        "event_id", F.round(F.greatest(at / F.lit(1000000.0) - 60, F.coalesce(middle(F.lag(at).over(w)), F.lit(0.0))), 3).alias("start_s"),
        F.round(F.least(at / F.lit(1000000.0) + 60, F.coalesce(middle(F.lead(at).over(w)), F.lit(1e12))), 3).alias("stop_s"),
    )


@query("wn_state_duration", """
    select user_id, event_type, count(*) as n, cast(sum(epoch_us(nxt) - epoch_us(ts)) as bigint) as micros from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null group by 1, 2""")
def state_duration(t: Tables) -> DataFrame:
    """Time spent in each state until the next event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    timed = t.events.withColumn("next", F.lead("ts").over(w)).where("next is not null")
    return timed.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(micros(F.col("next")) - micros(F.col("ts"))).alias("micros"))


@query("wn_best_pick", """
    select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) = 1""")
def best_pick(t: Tables) -> DataFrame:
    best = F.max(F.struct(F.col("c_acctbal"), (-F.col("c_custkey")).alias("minus")))
    return t.customer.groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", (-F.col("b.minus")).alias("c_custkey"), F.col("b.c_acctbal").alias("c_acctbal"))


@query("wn_interarrival", """
    with g as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000000.0 as gap from events)
    select user_id, round(max(gap), 6) as longest, round(quantile_cont(gap::double, 0.95), 6) as p95, count(gap) as n from g group by 1""")
def interarrival(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = t.events.select("user_id", ((at - F.lag(at).over(w)) / F.lit(1000000.0)).alias("gap"))
    return gaps.groupBy("user_id").agg(F.round(F.max("gap"), 6).alias("longest"), F.round(F.expr("percentile(gap, 0.95)"), 6).alias("p95"), F.count("gap").alias("n"))
