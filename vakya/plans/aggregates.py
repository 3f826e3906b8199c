"""Queries on aggregation, sorting and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from .registry import Tables, count_n, query



def month(col: str = "o_orderdate"):
    return F.month(col).cast("int")


def judged(t: Tables) -> DataFrame:
    """Gold labels beside a prediction by rule."""
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("pred", (F.col("n_chars") > 800).cast("int"))


JUDGED = "(select l.*, lang, source, n_chars, case when n_chars > 800 then 1 else 0 end as pred from labels l join documents using (doc_id))"


@query("ag_counts", "select event_type, count(*) as n from events group by 1")
def counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(count_n())


@query("ag_two_level", """
    with m as (select c_mktsegment, month(o_orderdate) as seed, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey group by 1, 2)
    select c_mktsegment, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, count(m) as n from m group by 1""")
def two_level(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", month().alias("seed"), "o_totalprice")
    return A.two_level(rows, ["c_mktsegment"], ["seed"], "o_totalprice")


@query("ag_bands_pooled", """
    with g as (select coalesce(l_returnflag, 'all') as band, month(l_shipdate) as seed, sum(l_extendedprice * l_discount) as num, sum(l_extendedprice) as den, count(*) as n, grouping(l_returnflag) as g
               from lineitem group by grouping sets ((l_returnflag, month(l_shipdate)), (month(l_shipdate))))
    select band, round(avg(num / den), 6) as mean_ratio, round(stddev_pop(num / den), 6) as std_ratio, round(sum(num) / sum(den), 6) as pooled, cast(sum(n) as bigint) as n, array_to_string(list(distinct seed order by seed), ',') as seeds from g group by 1""")
def bands_pooled(t: Tables) -> DataFrame:
    """By band and for all: the mean over months of a ratio, and the ratio of the sums."""
    rows = t.lineitem.select("l_returnflag", month("l_shipdate").alias("seed"), (F.col("l_extendedprice") * F.col("l_discount")).alias("num"), F.col("l_extendedprice").alias("den"))
    level = rows.groupingSets([["l_returnflag", "seed"], ["seed"]], "l_returnflag", "seed").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), count_n())
    ratio = F.try_divide("num", "den")
    return level.groupBy(F.coalesce("l_returnflag", F.lit("all")).alias("band")).agg(
        F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.stddev_pop(ratio), 6).alias("std_ratio"), F.round(F.try_divide(F.sum("num"), F.sum("den")), 6).alias("pooled"), F.sum("n").alias("n"),
        F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"),
    )


@query("ag_complete_groups", """
    select user_id, count(distinct event_type) as kinds from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)""")
def complete_groups(t: Tables) -> DataFrame:
    """Users that have every event type."""
    every = t.events.agg(F.countDistinct("event_type").alias("k")).scalar()
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds")).where(F.col("kinds") == every)


@query("ag_summary", """
    select l_returnflag, min(l_quantity) as least, max(l_quantity) as most, round(avg(l_quantity), 6) as mean, median(l_quantity) as middle, round(sum(l_extendedprice), 2) as total from lineitem group by 1""")
def summary(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.median("l_quantity").alias("middle"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("ag_conditional_counts", """
    select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) filter (where o_orderpriority like '1%' or o_orderpriority like '2%') as urgent, count(*) as n from orders group by 1""")
def conditional_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.count_if(F.col("o_orderpriority").rlike("^[12]")).alias("urgent"), count_n())


@query("ag_rollup_total", "select case when grouping(event_type) = 1 then 'ALL' else event_type end as event_type, count(*) as n, round(sum(value), 4) as total from events group by rollup(event_type)")
def rollup_total(t: Tables) -> DataFrame:
    kind = F.when(F.grouping("event_type") == 1, "ALL").otherwise(F.col("event_type"))
    return t.events.rollup("event_type").agg(count_n(), F.round(F.sum("value"), 4).alias("total"), kind.alias("kind")).select(F.col("kind").alias("event_type"), "n", "total")


@query("ag_cube", """
    select l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) as level, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)""")
def cube(t: Tables) -> DataFrame:
    level = (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int")
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(level.alias("level"), count_n())


@query("ag_breakdowns", f"""
    select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'quality' end as dimension, coalesce(lang, source, cast(quality as varchar)) as value, count(*) as n,
           count(*) filter (where pred = quality) as hits from {JUDGED} group by grouping sets ((lang), (source), (quality))""")
def breakdowns(t: Tables) -> DataFrame:
    """One pass over several single dimensions."""
    rows = judged(t).withColumn("q", F.col("quality").cast("string"))
    name = F.when(F.grouping("lang") == 0, "lang").when(F.grouping("source") == 0, "source").otherwise("quality")
    out = rows.groupingSets([["lang"], ["source"], ["q"]], "lang", "source", "q").agg(name.alias("dimension"), count_n(), F.count_if(F.col("pred") == F.col("quality")).alias("hits"))
    return out.select("dimension", F.coalesce("lang", "source", "q").alias("value"), "n", "hits")


@query("ag_proportion", f"select lang, count(*) filter (where pred = quality) as k, count(*) as n, round(100.0 * count(*) filter (where pred = quality) / count(*), 1) as pct from {JUDGED} group by 1")
def proportion(t: Tables) -> DataFrame:
    found = judged(t).groupBy("lang").agg(A.share(F.count_if(F.col("pred") == F.col("quality")), F.count(F.lit(1))).alias("s"))
    return found.select("lang", "s.k", "s.n", "s.pct")


@query("ag_nested_ratios", f"""
    select source, round(count(*) filter (where quality = 1 and pred = 1) / nullif(count(*) filter (where pred = 1), 0), 6) as precision_, round(count(*) filter (where quality = 1 and pred = 1) / nullif(count(*) filter (where quality = 1), 0), 6) as recall,
           round(count(*) filter (where toxic = 1 and quality = 0) / nullif(count(*) filter (where toxic = 1), 0), 6) as bad_of_toxic from {JUDGED} group by 1""")
def nested_ratios(t: Tables) -> DataFrame:
    of = lambda k, n: F.round(F.try_divide(F.count_if(F.expr(k)), F.count_if(F.expr(n))), 6)
    hit = "quality = 1 and pred = 1"
    return judged(t).groupBy("source").agg(of(hit, "pred = 1").alias("precision_"), of(hit, "quality = 1").alias("recall"), of("toxic = 1 and quality = 0", "toxic = 1").alias("bad_of_toxic"))


@query("ag_confusion", """
    select coalesce(cast(quality as varchar), 'none') as gold, cast(case when n_chars > 800 then 1 else 0 end as varchar) as pred, count(*) as n from documents left join labels using (doc_id) group by 1, 2""")
def confusion(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", (F.col("n_chars") > 800).cast("int").cast("string").alias("pred")).join(t.labels, "doc_id", "left")
    return rows.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("gold"), "pred").agg(count_n())


@query("ag_argument_table", """
    with a as (select event_id, event_type, unnest(['k', 'user', 'kind']) as arg, unnest([json_extract_string(props, '$.k'), cast(user_id as varchar), event_type]) as value from events)
    select event_type, arg, count(*) as n, count(value) as filled, count(distinct value) as different from a group by 1, 2""")
def argument_table(t: Tables) -> DataFrame:
    """Arguments as a map whose keys are data."""
    args = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return t.events.select("event_type", F.explode(args).alias("arg", "value")).groupBy("event_type", "arg").agg(count_n(), F.count("value").alias("filled"), F.countDistinct("value").alias("different"))


@query("ag_failure_groups", """
    select case when quality = 1 then 'pass' when toxic = 1 then 'toxic' when n_chars < 500 then 'short' else 'other' end as failure, count(*) as n, count(*) filter (where lang = 'en') as english from labels join documents using (doc_id) group by 1 order by n desc, failure""")
def failure_groups(t: Tables) -> DataFrame:
    kind = F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 500, "short").otherwise("other")
    return judged(t).groupBy(kind.alias("failure")).agg(count_n(), F.count_if(F.col("lang") == "en").alias("english")).orderBy(F.desc("n"), "failure")


@query("ag_percentiles", """
    with s as (select user_id, value, list_sort(list(value) over (partition by user_id)) as v from events), g as (select user_id, any_value(v) as v from s group by 1)
    select g.user_id, round(q.p, 6) as linear, round(v[least(len(v) - 1, cast(floor(len(v) * 0.95) as bigint)) + 1], 6) as truncated, round(v[cast(floor((len(v) - 1) * 0.95 + 0.5) as bigint) + 1], 6) as half_up, round(v[cast(floor((len(v) - 1) * 0.95) as bigint) + 1], 6) as lower_
    from g join (select user_id, quantile_cont(value, 0.95) as p from events group by 1) q using (user_id)""")
def percentiles(t: Tables) -> DataFrame:
    """Four definitions of a percentile."""
    at = A.at_indexes(t.events, ["user_id"], "value", {"truncated": A.truncated_rank(0.95), "half_up": A.half_up_rank(0.95), "lower_": A.lower_rank(0.95)})
    linear = t.events.groupBy("user_id").agg(A.linear("value", 0.95).alias("linear"))
    return linear.join(at, "user_id").select("user_id", *[F.round(c, 6).alias(c) for c in ("linear", "truncated", "half_up", "lower_")])


@query("ag_recent_stats", """
    with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
    select user_id, round(max(value) filter (where rn = 1), 6) as last, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as most, count(*) as n from r where rn <= 50 group by 1""")
def recent_stats(t: Tables) -> DataFrame:
    """Of the last fifty events of a user."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    r = lambda c: F.round(c, 6)
    return recent.groupBy("user_id").agg(r(F.max(F.when(F.col("rn") == 1, F.col("value")))).alias("last"), r(A.linear("value", 0.5)).alias("p50"), r(A.linear("value", 0.95)).alias("p95"), r(F.max("value")).alias("most"), count_n())


@query("ag_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(distinct l_orderkey) as orders from lineitem group by 1")
def distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"))


@query("ag_mode_alphabetical", """
    with c as (select p_brand, p_type, count(*) as n from part group by 1, 2) select p_brand, p_type as mode, n from c qualify row_number() over (partition by p_brand order by n desc, p_type) = 1""")
def mode(t: Tables) -> DataFrame:
    """The most frequent value; ties: the first by name."""
    c = t.part.groupBy("p_brand", "p_type").agg(count_n())
    best = F.min(F.struct((-F.col("n")).alias("m"), "p_type"))
    return c.groupBy("p_brand").agg(best.alias("b")).select("p_brand", F.col("b.p_type").alias("mode"), (-F.col("b.m")).alias("n"))


@query("ag_top_words", """
    with w as (select unnest(string_split_regex(lower(text), '[^a-z]+')) as word from conversations) select word, count(*) as n from w where word <> '' group by 1 order by n desc, word limit 25""")
def top_words(t: Tables) -> DataFrame:
    words = t.conversations.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(count_n()).orderBy(F.desc("n"), "word").limit(25)


@query("ag_diversity", """
    with c as (select c_mktsegment as kind, c_nationkey as value, count(*) as n from customer group by 1, 2) select kind, count(*) as different, max(n) as most_reused, arg_min(value, row(-n, value)) as which from c group by 1""")
def diversity(t: Tables) -> DataFrame:
    """Of each kind: distinct values, and the one used most."""
    c = t.customer.groupBy(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("value")).agg(count_n())
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("different"), F.max("n").alias("most_reused"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("which"))


@query("ag_histogram", "select turns, count(*) as n from (select conv_id, count(*) as turns from conversations group by 1) group by 1 order by 1")
def histogram(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).groupBy("turns").agg(count_n()).orderBy("turns")


@query("ag_bool_as_ratio", f"select lang, count(*) filter (where quality = 1) || '/' || count(quality) as good, round(avg(n_chars), 6) as chars from {JUDGED} group by 1")
def bool_ratio(t: Tables) -> DataFrame:
    return judged(t).groupBy("lang").agg(F.concat(F.count_if(F.col("quality") == 1).cast("string"), F.lit("/"), F.count("quality").cast("string")).alias("good"), F.round(F.avg("n_chars"), 6).alias("chars"))


@query("ag_ratio_to_median", """
    select c_custkey, round(c_acctbal / nullif(quantile_cont(c_acctbal, 0.5) over (partition by c_nationkey), 0), 6) as ratio from customer""")
def ratio_to_median(t: Tables) -> DataFrame:
    middle = t.customer.groupBy("c_nationkey").agg(A.linear("c_acctbal", 0.5).alias("m"))
    return t.customer.join(middle, "c_nationkey").select("c_custkey", F.round(F.try_divide("c_acctbal", F.nullif(F.col("m"), F.lit(0.0))), 6).alias("ratio"))


@query("ag_micro_f1", """
    with w as (select conv_id, role, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from conversations where role in ('user', 'assistant')),
    c as (select conv_id, word, count(*) filter (where role = 'user') as g, count(*) filter (where role = 'assistant') as p from w where word <> '' group by 1, 2),
    s as (select conv_id, sum(least(g, p)) as hit, sum(g) as gold, sum(p) as pred from c group by 1)
    select cast(sum(hit) as bigint) as hit, cast(sum(gold) as bigint) as gold, cast(sum(pred) as bigint) as pred, round(sum(hit) / sum(pred), 6) as precision_, round(sum(hit) / sum(gold), 6) as recall,
           round(2 * sum(hit) / (sum(gold) + sum(pred)), 6) as f1 from s""")
def micro_f1(t: Tables) -> DataFrame:
    """Words of answers against those of questions, as multisets, over all conversations."""
    words = t.conversations.where("role in ('user', 'assistant')").select("conv_id", "role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    c = words.groupBy("conv_id", "word").agg(F.count_if(F.col("role") == "user").alias("g"), F.count_if(F.col("role") == "assistant").alias("p"))
    s = c.agg(F.sum(F.least("g", "p")).alias("hit"), F.sum("g").alias("gold"), F.sum("p").alias("pred"))
    return s.select("hit", "gold", "pred", F.round(F.try_divide("hit", "pred"), 6).alias("precision_"), F.round(F.try_divide("hit", "gold"), 6).alias("recall"), F.round(F.try_divide(F.col("hit") * 2, F.col("gold") + F.col("pred")), 6).alias("f1"))


@query("ag_trigram_repeats", """
    with w as (select doc_id, list_filter(string_split_regex(trim(text), '[ \\t\\n\\r]+'), lambda x: x <> '') as w from documents), g as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as gram from w where len(w) >= 3),
    c as (select doc_id, gram, count(*) as n from g group by 1, 2) select doc_id, max(n) as most, count(*) as different from c group by 1""")
def trigram_repeats(t: Tables) -> DataFrame:
    """How often the most frequent three words of a document occur, and how many different ones there are: sorted within the row, nothing is shuffled."""
    words = t.documents.select("doc_id", F.filter(F.split(F.trim("text"), "[ \\t\\n\\r]+"), lambda x: x != "").alias("w"))
    n = F.size("w") - 2
    three = F.arrays_zip(*[F.slice("w", k, n).alias(f"w{k}") for k in (1, 2, 3)])
    grams = words.where(n >= 1).select("doc_id", F.sort_array(three).alias("g"))
    return grams.select("doc_id", X.runs("g").alias("r")).select("doc_id", "r.most", "r.different")


@query("ag_threshold_sweep", f"""
    select t as threshold, count(*) filter (where n_chars >= t) as kept, count(*) filter (where n_chars >= t and quality = 1) as good from {JUDGED}, (select unnest([200, 500, 1000, 2000, 4000]) as t) group by 1""")
def threshold_sweep(t: Tables) -> DataFrame:
    """All thresholds in one pass."""
    rows = judged(t).select("n_chars", "quality", F.explode(F.array(*map(F.lit, (200, 500, 1000, 2000, 4000)))).alias("threshold"))
    over = F.col("n_chars") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(over).alias("kept"), F.count_if(over & (F.col("quality") == 1)).alias("good"))


@query("ag_spearman", """
    with r as (select (2 * rank() over (order by l_quantity) + count(*) over (partition by l_quantity) - 1) / 2.0 as x, (2 * rank() over (order by l_discount) + count(*) over (partition by l_discount) - 1) / 2.0 as y from lineitem) select round(corr(x, y), 6) as rho, count(*) as n from r""")
def spearman(t: Tables) -> DataFrame:
    return A.spearman(t.lineitem, "l_quantity", "l_discount")


@query("ag_weighted_means", """
    select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as weighted, round(avg(l_discount), 6) as plain from lineitem group by 1""")
def weighted_means(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity")), 6).alias("weighted"), F.round(F.avg("l_discount"), 6).alias("plain"))


@query("ag_batch_means", """
    with b as (select l_returnflag, l_orderkey // 100 as batch, avg(l_discount) as m from lineitem group by 1, 2) select l_returnflag, round(avg(m), 6) as mean_of_means, count(*) as batches from b group by 1""")
def batch_means(t: Tables) -> DataFrame:
    b = t.lineitem.groupBy("l_returnflag", F.floor(F.col("l_orderkey") / 100).alias("batch")).agg(F.avg("l_discount").alias("m"))
    return b.groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count(F.lit(1)).alias("batches"))


@query("ag_latency_legs", """
    select o_orderstatus, round(quantile_cont(a, 0.5), 6) as first_leg, round(quantile_cont(b, 0.5), 6) as second_leg, round(quantile_cont(a + b, 0.5) - quantile_cont(a, 0.5) - quantile_cont(b, 0.5), 6) as residual
    from (select o_orderstatus, l_quantity as a, l_extendedprice / 1000 as b from orders join lineitem on o_orderkey = l_orderkey) group by 1""")
def latency_legs(t: Tables) -> DataFrame:
    """Medians of the legs, and what they leave of the median of the whole."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderstatus", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    legs = F.array(*[F.struct(F.lit(name).alias("leg"), v.alias("v")) for name, v in (("a", F.col("a")), ("b", F.col("b")), ("whole", F.col("a") + F.col("b")))])
    middle = A.percentiles(rows.select("o_orderstatus", F.explode(legs).alias("l")).select("o_orderstatus", "l.*"), ["o_orderstatus", "leg"], "v", {"m": 0.5}, 0.01)
    m = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("m")))
    return middle.groupBy("o_orderstatus").agg(F.round(m("a"), 6).alias("first_leg"), F.round(m("b"), 6).alias("second_leg"), F.round(m("whole") - m("a") - m("b"), 6).alias("residual"))


@query("ag_composite_score", """
    with s as (select c_nationkey, avg(c_acctbal) as a, count(*) as n, count(*) filter (where c_acctbal < 0) as bad from customer group by 1) select c_nationkey, round((a / 1000 + n / 100.0) / 2 - 0.05 * bad, 10) as score from s where bad < n / 4.0""")
def composite_score(t: Tables) -> DataFrame:
    """A mean of metrics less a penalty, where groups with too many faults are out."""
    s = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), count_n(), F.count_if(F.col("c_acctbal") < 0).alias("bad"))
    return s.where(F.col("bad") < F.col("n") / 4.0).select("c_nationkey", F.round((F.col("a") / 1000 + F.col("n") / 100.0) / 2 - F.col("bad") * 0.05, 10).alias("score"))


@query("ag_best_of_n", """
    select c_mktsegment, round(avg(rate), 6) as pass_rate, round(avg(any_), 6) as best_of from (select c_mktsegment, o_custkey, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as rate, max(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as any_ from orders join customer on o_custkey = c_custkey group by 1, 2) group by 1""")
def best_of_n(t: Tables) -> DataFrame:
    ok = (F.col("o_orderstatus") == "F").cast("double")
    calls = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.avg(ok).alias("rate"), F.max(ok).alias("any_"))
    return calls.groupBy("c_mktsegment").agg(F.round(F.avg("rate"), 6).alias("pass_rate"), F.round(F.avg("any_"), 6).alias("best_of"))


@query("ag_rates", "select l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) as pooled, round(avg(l_extendedprice / l_quantity), 6) as mean_rate from lineitem group by 1")
def rates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 6).alias("pooled"), F.round(F.avg(F.try_divide("l_extendedprice", "l_quantity")), 6).alias("mean_rate"))


@query("ag_unpivot", """
    select c_mktsegment, metric, value from (select c_mktsegment, round(avg(c_acctbal), 6) as mean, round(stddev_pop(c_acctbal), 6) as std, cast(count(*) as double) as n from customer group by 1) unpivot (value for metric in (mean, std, n))""")
def unpivot(t: Tables) -> DataFrame:
    """A wide report as long rows."""
    wide = t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 6).alias("std"), F.count(F.lit(1)).cast("double").alias("n"))
    return wide.unpivot("c_mktsegment", ["mean", "std", "n"], "metric", "value")


@query("ag_pivot", """
    select n_name, count(*) filter (where c_mktsegment = 'BUILDING') as building, count(*) filter (where c_mktsegment = 'MACHINERY') as machinery from customer join nation on c_nationkey = n_nationkey group by 1""")
def pivot(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = rows.groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return wide.select("n_name", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("ag_mean_std_text", """
    select c_mktsegment, printf('%.2f ± %.2f (%.2f to %.2f)', avg(c_acctbal), stddev_pop(c_acctbal), min(c_acctbal), max(c_acctbal)) as text from customer group by 1""")
def mean_std_text(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.format_string("%.2f ± %.2f (%.2f to %.2f)", F.avg("c_acctbal"), F.stddev_pop("c_acctbal"), F.min("c_acctbal"), F.max("c_acctbal")).alias("text"))


@query("st_custom_order", """
    select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 3 else 0 end as place from orders order by place, o_orderkey""")
def custom_order(t: Tables) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")).cast("int")
    return t.orders.select("o_orderkey", place.alias("place")).orderBy("place", "o_orderkey")


@query("st_worst_three", """
    select source, doc_id, n_chars from documents qualify row_number() over (partition by source order by case when source < 'src5' then n_chars else -n_chars end, doc_id) <= 3""")
def worst_three(t: Tables) -> DataFrame:
    """The three shortest or longest, by the side that the group is on."""
    key = F.when(F.col("source") < "src5", F.col("n_chars")).otherwise(-F.col("n_chars"))
    return t.documents.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(key, "doc_id"))).where("rn <= 3").select("source", "doc_id", "n_chars")


@query("st_worst_n", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 12")
def worst_n(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(12)


@query("st_min_candidate", """
    select o_custkey, arg_min(o_orderkey, row(case when o_orderstatus = 'F' then 0 else 1 end, o_totalprice, o_orderkey)) as choice from orders group by 1""")
def min_candidate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct((F.col("o_orderstatus") != "F").cast("int"), F.col("o_totalprice"), F.col("o_orderkey"))).alias("choice"))
