"""Queries on text, validation rules and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cuts as K
from ..functions import text as X
from .registry import Tables, count_n, query

ALNUM = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9@]+'), lambda t: t <> '')"
FOLD = ("áàâäéèêëíïîóöôúüûñçÁÀÂÄÉÈÊËÍÏÎÓÖÔÚÜÛÑÇ", "aaaaeeeeiiiooouuuncAAAAEEEEIIIOOOUUUNC")


@query("tx_word_counts", r"""
    select doc_id, len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\r]+'), lambda w: regexp_matches(w, '[0-9A-Za-z_]|[^\x00-\x7F]'))) as words, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9@]+'), lambda t: t <> '')) as tokens,
           len(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) as scored, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from documents""")
def word_counts(t: Tables) -> DataFrame:
    c, size = F.col("text"), lambda x: F.size(x).cast("bigint")
    return t.documents.select("doc_id", size(X.words(c)).alias("words"), size(X.alnum_tokens(c)).alias("tokens"), size(X.score_words(c)).alias("scored"), F.length(X.digits(c)).cast("bigint").alias("digits"))


@query("tx_spoken_duration", r"""
    with w as (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9@]+'), lambda t: t <> '') as t from conversations), u as (select conv_id, turn, list_sum(list_transform(t, lambda x: case when length(regexp_replace(x, '[^0-9]', '', 'g')) = 0 then 1 else length(regexp_replace(x, '[^0-9]', '', 'g')) end)) as units from w)
    select conv_id, cast(sum(coalesce(units, 0)) as bigint) as units, round(1.0 + sum(coalesce(units, 0) / 2.5 + 0.4), 6) as seconds, 1.0 + sum(coalesce(units, 0) / 2.5 + 0.4) between 20 and 600 as in_band from u group by 1""")
def spoken_duration(t: Tables) -> DataFrame:
    units = t.conversations.select("conv_id", X.spoken_units(X.alnum_tokens(F.col("text"))).alias("units"))
    total = F.lit(1.0) + F.sum(F.col("units") / 2.5 + 0.4)
    return units.groupBy("conv_id").agg(F.sum("units").alias("units"), F.round(total, 6).alias("seconds"), total.between(20, 600).alias("in_band"))


@query("tx_overlap_with_previous", f"""
    with t as (select conv_id, turn, {ALNUM.format('text')} as a, lag({ALNUM.format('text')}) over (partition by conv_id order by turn) as b from conversations), c as (select conv_id, turn, list_filter(a, lambda t: length(t) >= 2 and t not in ('the', 'a', 'of', 'and', 'to')) as c, b from t where b is not null)
    select conv_id, turn, round(case when len(c) = 0 then 1.0 else len(list_filter(c, lambda t: list_contains(b, t))) / len(c) end, 6) as share from c""")
def overlap_with_previous(t: Tables) -> DataFrame:
    """Share of a turn's content tokens that the turn before has."""
    tokens = X.alnum_tokens(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", tokens.alias("a"), F.lag(tokens).over(W.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return rows.select("conv_id", "turn", F.round(X.overlap_share(F.col("a"), F.col("b")), 6).alias("share"))


@query("tx_ascii_fold", rf"""
    select doc_id, md5(regexp_replace(translate(text, '{FOLD[0]}', '{FOLD[1]}'), '[^\x00-\x7F]', '', 'g')) as folded, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) as accents from documents""")
def ascii_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.ascii_fold(F.col("text"))).alias("folded"), F.length(F.regexp_replace("text", "[\\x00-\\x7F]", "")).cast("bigint").alias("accents"))


@query("tx_template", "select c_custkey, 'You are ' || c_name || ' of ' || n_name || ', a ' || lower(c_mktsegment) || ' buyer.' as prompt from customer join nation on c_nationkey = n_nationkey")
def template(t: Tables) -> DataFrame:
    """A prompt for each customer, by a dimension that is joined."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.format_string("You are %s of %s, a %s buyer.", "c_name", "n_name", F.lower("c_mktsegment")).alias("prompt"))


EMAIL = "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z.]+"
PHONE = "[+]?[0-9][0-9 ()-]{8,14}[0-9]"


@query("tx_contacts", f"""
    select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{EMAIL}'))), ' ') as emails, len(regexp_extract_all(text, '{PHONE}')) as phones from documents where regexp_matches(text, '{EMAIL}') or regexp_matches(text, '{PHONE}')""")
def contacts(t: Tables) -> DataFrame:
    """Typed entities harvested from text."""
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    rows = t.documents.where(F.col("text").rlike(EMAIL) | F.col("text").rlike(PHONE))
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found(EMAIL))), " ").alias("emails"), F.size(found(PHONE)).cast("bigint").alias("phones"))


@query("tx_email_check", f"""
    with e as (select doc_id, unnest(regexp_extract_all(text, '[^ \\n]*@[^ \\n]*')) as raw from documents), n as (select doc_id, replace(replace(replace(lower(raw), ' at ', '@'), ' dot ', '.'), ' ', '') as email from e)
    select doc_id, email, case when email not like '%_@_%' then 'incomplete' when not regexp_matches(email, '[.][a-z]+$') then 'no domain' when email like '%@%@%' then 'two signs' else 'ok' end as reason, count(*) as n from n group by 1, 2, 3""")
def email_check(t: Tables) -> DataFrame:
    raw = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^ \\n]*@[^ \\n]*"), F.lit(0))).alias("raw"))
    email = raw.select("doc_id", X.email_normal(F.col("raw")).alias("email"))
    c = F.col("email")
    reason = F.when(~c.like("%_@_%"), "incomplete").when(~c.rlike("[.][a-z]+$"), "no domain").when(c.like("%@%@%"), "two signs").otherwise("ok")
    return email.groupBy("doc_id", "email", reason.alias("reason")).agg(count_n())


@query("tx_phone_canonical", f"""
    with p as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '{PHONE}')), '[^0-9]', '', 'g') as d from documents)
    select doc_id, case when length(d) = 12 and starts_with(d, '91') then substr(d, 3, 10) when length(d) = 11 and starts_with(d, '0') then substr(d, 2, 10) else d end as phone, count(*) as n from p group by 1, 2""")
def phone_canonical(t: Tables) -> DataFrame:
    raw = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("raw"))
    return raw.groupBy("doc_id", X.phone_canonical(F.col("raw")).alias("phone")).agg(count_n())


@query("tx_skeletons")
def skeletons(t: Tables) -> DataFrame:
    """Words by their consonant skeleton and their sound; tests hold both against Python."""
    w = t.conversations.select(F.explode(X.alnum_tokens(X.ascii_fold(F.col("text")))).alias("word")).distinct()
    return w.select("word", X.consonant_skeleton(F.col("word")).alias("skeleton"), X.sound_fold(F.col("word")).alias("sound"))


@query("tx_script_share", """
    select doc_id, round(case when length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) = 0 then 0.0 else length(regexp_replace(text, '[^À-ÿ]', '', 'g')) / length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) end, 6) as accented from documents""")
def script_share(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(X.script_share(F.col("text"), "[À-ÿ]", "[A-Za-zÀ-ÿ]"), 6).alias("accented"))


@query("tx_flags", """
    select doc_id, regexp_matches(lower(text), 'licen[sc]e') as licence, regexp_matches(text, '[0-9]{6,}') as number, regexp_matches(text, '[!?]{2}') as loud, len(regexp_extract_all(text, '[.!?]')) as stops from documents""")
def flags(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.lower(c).rlike("licen[sc]e").alias("licence"), c.rlike("[0-9]{6,}").alias("number"), c.rlike("[!?]{2}").alias("loud"), F.size(F.regexp_extract_all(c, F.lit("[.!?]"), F.lit(0))).cast("bigint").alias("stops"))


@query("tx_cleanup", r"""
    select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[*#%&$]{3}', '', 'g'), '([.,])[.,]+', '\1', 'g'), '[ \t\n]+', ' ', 'g'))) as clean from documents""")
def cleanup(t: Tables) -> DataFrame:
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[*#%&$]{3}", ""), "([.,])[.,]+", "$1"), "[ \\t\\n]+", " ")
    return t.documents.select("doc_id", F.md5(F.trim(c)).alias("clean"))


@query("tx_bigrams", f"""
    with w as (select conv_id, {ALNUM.format('text')} as w from conversations), g as (select conv_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w where len(w) >= 2)
    select gram, count(*) as n, count(distinct conv_id) as calls from g group by 1 having count(*) > 1""")
def bigrams(t: Tables) -> DataFrame:
    grams = t.conversations.select("conv_id", F.explode(X.ngrams(X.alnum_tokens(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(count_n(), F.countDistinct("conv_id").alias("calls")).where("n > 1")


@query("tx_json_paths", "select event_id, cast(json_extract_string(props, '$.k') as int) as k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' as canonical from events")
def json_paths(t: Tables) -> DataFrame:
    """A field of JSON text, and canonical JSON (sorted keys, no spaces)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("canonical"))


@query("tx_coverage_label", f"""
    with t as (select conv_id, turn, role, {ALNUM.format('text')} as w from conversations), s as (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as before, first_value(w) over (partition by conv_id order by turn) as opening from t)
    select conv_id, turn, case when list_has_any(w, before) and list_has_any(w, opening) then 'both' when list_has_any(w, before) then 'window_only' when list_has_any(w, opening) then 'record_only' else 'neither' end as coverage from s where before is not null""")
def coverage_label(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    tokens = X.alnum_tokens(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", tokens.alias("w"), F.lag(tokens).over(w).alias("before"), F.first(tokens).over(w).alias("opening")).where("before is not null")
    a, b = F.arrays_overlap("w", "before"), F.arrays_overlap("w", "opening")
    return rows.select("conv_id", "turn", F.when(a & b, "both").when(a, "window_only").when(b, "record_only").otherwise("neither").alias("coverage"))


@query("tx_fact_spelled")
def fact_spelled(t: Tables) -> DataFrame:
    """Whether contiguous tokens of a turn join to the first two tokens of the turn before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    tokens = X.alnum_tokens(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", tokens.alias("t"), F.array_join(F.slice(F.lag(tokens).over(w), 1, 2), "").alias("fact")).where("fact is not null and fact <> ''")
    return rows.select("conv_id", "turn", "fact", X.spells(F.col("t"), F.col("fact")).alias("spelled"))


@query("ma_levenshtein", """
    with n as (select p_name as a, lead(p_name) over (partition by p_brand order by p_partkey) as b, p_partkey from part)
    select p_partkey, levenshtein(a, b) as distance, round(levenshtein(a, b) / length(b), 6) as cer from n where b is not null""")
def levenshtein(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b is not null")
    return rows.select("p_partkey", F.levenshtein("a", "b").cast("bigint").alias("distance"), F.round(X.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query("ma_token_f1", f"""
    with t as (select conv_id, turn, {ALNUM.format('text')} as a, lag({ALNUM.format('text')}) over (partition by conv_id order by turn) as b from conversations), p as (select * from t where b is not null),
    c as (select conv_id, turn, w, sum(l) as l, sum(r) as r from (select conv_id, turn, unnest(a) as w, 1 as l, 0 as r from p union all select conv_id, turn, unnest(b), 0, 1 from p) group by 1, 2, 3), s as (select conv_id, turn, sum(least(l, r)) as hit, sum(l + r) as n from c group by 1, 2)
    select p.conv_id, p.turn, round(case when coalesce(n, 0) = 0 then 1.0 else 2.0 * hit / n end, 6) as f1 from p left join s using (conv_id, turn)""")
def token_f1(t: Tables) -> DataFrame:
    tokens = X.alnum_tokens(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", tokens.alias("a"), F.lag(tokens).over(W.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return rows.select("conv_id", "turn", F.round(X.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("set_arrays", f"""
    with t as (select conv_id, turn, list_distinct({ALNUM.format('text')}) as a, lag(list_distinct({ALNUM.format('text')})) over (partition by conv_id order by turn) as b, first_value(list_distinct({ALNUM.format('text')})) over (partition by conv_id order by turn) as c from conversations)
    select conv_id, turn, len(list_filter(a, lambda x: not list_contains(b, x) and not list_contains(c, x))) as novel, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as subset, list_sort(a) = list_sort(b) as equal from t where b is not null""")
def set_arrays(t: Tables) -> DataFrame:
    """Novel tokens, subset and equality of token sets of neighbouring turns."""
    w = W.partitionBy("conv_id").orderBy("turn")
    a = F.array_distinct(X.alnum_tokens(F.col("text")))
    rows = t.conversations.select("conv_id", "turn", a.alias("a"), F.lag(a).over(w).alias("b"), F.first(a).over(w).alias("c")).where("b is not null")
    novel = F.array_except("a", F.array_union("b", "c"))
    return rows.select("conv_id", "turn", F.size(novel).cast("bigint").alias("novel"), (F.size(F.array_except("a", "b")) == 0).alias("subset"), (F.array_sort("a") == F.array_sort("b")).alias("equal"))


def rule(df: DataFrame, key: str, check: str, message) -> DataFrame:
    """Failing rows of a rule."""
    return df.select(F.col(key).alias("key"), F.lit(check).alias("check"), message.alias("message"))


@query("val_call_checks", """
    with t as (select conv_id, count(*) as turns, min_by(role, turn) as first_role, max_by(role, turn) as last_role, max(length(text)) as longest from conversations group by 1)
    select conv_id as key, 'turn_count' as "check", cast(turns as varchar) as message from t where turns not between 3 and 7 union all
    select conv_id, 'first_role', first_role from t where first_role = 'assistant' union all select conv_id, 'last_role', last_role from t where last_role <> 'assistant' union all select conv_id, 'line_length', cast(longest as varchar) from t where longest > 3000""")
def call_checks(t: Tables) -> DataFrame:
    """Rows (key, check, message) of what fails."""
    c = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.max(F.length("text")).alias("longest"))
    found = [
        rule(c.where("turns not between 3 and 7"), "conv_id", "turn_count", F.col("turns").cast("string")),
        rule(c.where("first_role = 'assistant'"), "conv_id", "first_role", F.col("first_role")),
        rule(c.where("last_role <> 'assistant'"), "conv_id", "last_role", F.col("last_role")),
        rule(c.where("longest > 3000"), "conv_id", "line_length", F.col("longest").cast("string")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("val_bands", """
    with m as (select lang, quantile_cont(n_chars::double, 0.5) as middle, max(n_chars) as most, count(*) as n from documents group by 1) select lang, middle, most, most <= 20 * middle as shape_ok from m""")
def bands(t: Tables) -> DataFrame:
    m = t.documents.groupBy("lang").agg(F.expr("percentile(n_chars, 0.5d)").alias("middle"), F.max("n_chars").alias("most"))
    return m.select("lang", "middle", "most", (F.col("most") <= F.col("middle") * 20).alias("shape_ok"))


@query("val_adjacent_roles", """
    select conv_id, count(*) filter (where role = before) as same_twice, bool_and(role is distinct from before) as alternates from (select conv_id, role, lag(role) over (partition by conv_id order by turn) as before from conversations) group by 1""")
def adjacent_roles(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "role", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("role") == F.col("before")).alias("same_twice"), F.bool_and(~F.col("role").eqNullSafe(F.col("before"))).alias("alternates"))


@query("val_leak_into_documents", """
    select b.item_id, count(distinct d.doc_id) as documents from benchmark b join (select doc_id, unnest(string_split(text, chr(10))) as line from documents) d on trim(d.line) = trim(string_split(b.text, chr(10))[1]) group by 1""")
def leak_into_documents(t: Tables) -> DataFrame:
    """Documents that have the first line of a benchmark item: an equality on lines, not a search in texts."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    first = t.benchmark.select("item_id", F.trim(F.element_at(F.split("text", "\n"), 1)).alias("line"))
    return first.join(lines, "line").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


#: Words of a run that an item and a document share; a shorter item is one run.
RUN = 13
#: Runs of items up to which they are broadcast; beyond, Spark shuffles.
BROADCAST_RUNS = 400_000


@query("val_leak_passages", r"""
    with b as (select item_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') as w from benchmark), d as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') as w from documents),
    i as (select item_id, w, least(13, len(w)) as n from b where len(w) > 0), r as (select distinct item_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as run from i),
    e as (select distinct doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as run from d join (select distinct n from i) on len(w) >= n),
    t as (select item_id, count(*) as runs from r group by 1)
    select item_id, doc_id, count(*) as found, any_value(runs) as runs from r join e using (run) join t using (item_id) group by 1, 2""")
def leak_passages(t: Tables) -> DataFrame:
    """How many of an item's runs of 13 words stand in a document, over the whole texts of both; by hashes, then confirmed in the text."""
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    hashed = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.xxhash64(F.slice("w", k, n)))
    items = t.benchmark.where("item_id is not null").select("item_id", words.alias("w")).where("size(w) > 0").withColumn("n", F.least(F.lit(RUN), F.size("w")))
    run = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda k: F.struct(F.xxhash64(F.slice("w", k, F.col("n"))).alias("h"), F.array_join(F.slice("w", k, F.col("n")), " ").alias("run")))
    runs = items.select("item_id", F.explode(run).alias("r")).select("item_id", "r.h", "r.run").distinct()
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS else df
    sizes = sorted(r.n for r in items.select("n").distinct().collect())  # 13 at most
    docs = t.documents.where("doc_id is not null").select("doc_id", words.alias("w"))
    all_sizes = F.concat(*[F.when(F.size("w") >= n, hashed(n)).otherwise(F.expr("cast(array() as array<bigint>)")) for n in sizes]) if sizes else F.expr("cast(array() as array<bigint>)")
    hits = docs.select("doc_id", F.explode(F.array_distinct(all_sizes)).alias("h")).join(small(runs), "h").select("doc_id", "item_id", "run").distinct()
    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "run")).alias("hits"))
    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    sure = docs.join(lists, "doc_id").select("doc_id", F.explode(F.filter("hits", lambda x: text.contains(F.concat(F.lit(" "), x["run"], F.lit(" "))))).alias("x")).select("doc_id", "x.*").distinct()
    return sure.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("found")).join(runs.groupBy("item_id").agg(F.count(F.lit(1)).alias("runs")), "item_id")


@query("val_report", """
    with f as (select o_orderkey, 'cheap' as c, o_custkey from orders where o_totalprice < 5000 union all select o_orderkey, 'pending', o_custkey from orders where o_orderstatus = 'P' union all select o_orderkey, 'late', o_custkey from orders where o_orderdate > timestamp '2000-01-01')
    select c as rule, count(*) as rows_, count(distinct o_custkey) as customers, array_to_string(list_sort(list(o_orderkey))[1:5], ',') as examples from f group by 1""")
def report(t: Tables) -> DataFrame:
    """Counts of each rule and its first five examples."""
    failing = F.filter(F.array(F.when(F.col("o_totalprice") < 5000, "cheap"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp_ntz"), "late")), lambda x: x.isNotNull())
    rows = t.orders.select("o_orderkey", "o_custkey", F.explode(failing).alias("rule"))
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("rule").orderBy("o_orderkey")))
    few = F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.col("o_orderkey")))), ",")
    return ranked.groupBy("rule").agg(F.count(F.lit(1)).alias("rows_"), F.countDistinct("o_custkey").alias("customers"), few.alias("examples"))


@query("er_precedence", """
    with q as (select o_orderkey, o_custkey, o_orderpriority, o_orderstatus from orders), c as (
      select o_orderkey, 1 as rule, c_custkey as hit from q join customer on o_custkey = c_custkey and c_acctbal > 5000 union all
      select o_orderkey, 2, l_suppkey from q join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' union all select o_orderkey, 3, l_partkey from q join lineitem on l_orderkey = o_orderkey),
    u as (select o_orderkey, rule, min(hit) as hit from c group by 1, 2 having count(distinct hit) = 1), b as (select o_orderkey, min(rule) as rule, arg_min(hit, rule) as hit from u group by 1)
    select q.o_orderkey, b.rule, b.hit from q left join b using (o_orderkey)""")
def precedence(t: Tables) -> DataFrame:
    """The first rule that has exactly one candidate decides; none gives null."""
    rich = t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.lit(1).alias("rule"), F.col("c_custkey").alias("hit"))
    lines = t.orders.select("o_orderkey").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    both = rich.unionByName(lines.where("l_returnflag = 'R'").select("o_orderkey", F.lit(2).alias("rule"), F.col("l_suppkey").alias("hit"))).unionByName(lines.select("o_orderkey", F.lit(3).alias("rule"), F.col("l_partkey").alias("hit")))
    unique = both.groupBy("o_orderkey", "rule").agg(F.min("hit").alias("hit"), F.max("hit").alias("other")).where("hit = other")
    best = unique.groupBy("o_orderkey").agg(F.min(F.struct("rule", "hit")).alias("b"))
    return t.orders.select("o_orderkey").join(best, "o_orderkey", "left").select("o_orderkey", "b.rule", "b.hit")


@query("er_order_class", """
    select o_custkey, case when a = b then 'same order' when list_sort(a) = list_sort(b) then 'other order' when len(list_filter(a, lambda x: not list_contains(b, x))) = 0 then 'subset' else 'different' end as kind from (
      select o_custkey, list(o_orderstatus order by o_orderkey) as a, list(o_orderstatus order by o_orderdate, o_orderkey) as b from orders group by 1)""")
def order_class(t: Tables) -> DataFrame:
    """How two lists of calls agree."""
    listed = lambda *k: F.transform(F.array_sort(F.collect_list(F.struct(*k, "o_orderstatus"))), lambda x: x["o_orderstatus"])
    rows = t.orders.groupBy("o_custkey").agg(listed("o_orderkey").alias("a"), listed("o_orderdate", "o_orderkey").alias("b"))
    kind = F.when(F.col("a") == F.col("b"), "same order").when(F.array_sort("a") == F.array_sort("b"), "other order").when(F.size(F.array_except("a", "b")) == 0, "subset").otherwise("different")
    return rows.select("o_custkey", kind.alias("kind"))


@query("er_best_checkpoint", """
    select c_nationkey, arg_min(c_custkey, row(c_acctbal, c_custkey)) as pick, count(*) as usable from customer where c_acctbal > 0 group by 1""")
def best_checkpoint(t: Tables) -> DataFrame:
    """The least loss of the usable rows."""
    return t.customer.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("pick"), count_n().alias("usable"))


@query("er_dimension_analysis", """
    with d as (select doc_id, toxic, unnest([coalesce(lang, '-'), source, case when n_chars > 1000 then 'long' else 'short' end]) as value, unnest(['lang', 'source', 'length']) as dimension from labels join documents using (doc_id) where quality = 0)
    select dimension, value, count(*) as n, count(*) filter (where toxic = 1) as toxic from d group by 1, 2""")
def dimension_analysis(t: Tables) -> DataFrame:
    """Negative rows by each of several dimensions, in one pass."""
    rows = t.labels.where("quality = 0").join(t.documents, "doc_id")
    dims = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("-")), F.lit("source"), F.col("source"), F.lit("length"), F.when(F.col("n_chars") > 1000, "long").otherwise("short"))
    return rows.select("toxic", F.explode(dims).alias("dimension", "value")).groupBy("dimension", "value").agg(count_n(), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("tx_best_cuts")
def best_cuts(t: Tables) -> DataFrame:
    """Whole texts of conversations in up to three pieces at their best boundaries, and the same cuts in the text without its articles."""
    parallel = F.regexp_replace("text", "(?i)(^|(?<=\\s))(the|der|die|das|le|la|les|el|los)\\s+", "")
    found = t.conversations.select("conv_id", "turn", K.cut_texts()("text", parallel).alias("c"))
    return found.select("conv_id", "turn", *[F.array_join(f"c.{x}", ",").alias(x) for x in ("cuts", "parallel")], "c.forced", "c.way")


ARTICLES = ", ".join(f"'{x}'" for x in K.ARTICLES)


@query("tx_noise_protected", rf"""
    with w as (select conv_id, turn, conv_id || '/' || turn as seed, string_split(text, ' ') as w from conversations where text is not null),
    f as (select *, list_transform(w, lambda x: regexp_matches(x, '[0-9@]|^[A-Z]')) as p, list_transform(w, lambda x: list_contains([{ARTICLES}], lower(x))) as art from w),
    k as (select *, coalesce(list_min(list_transform(list_filter(range(1, len(w)), lambda i: not p[i] and not p[i + 1] and not art[i] and not art[i + 1] and regexp_matches(w[i], '^[A-Za-z]+$')), lambda i: row(md5(seed || ':pair:' || i), i)))[2], 0) as pair from f),
    s as (select *, coalesce(list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: not p[i] and regexp_matches(w[i], '^[A-Za-z]{{5,}}$') and i <> pair and i <> pair + 1), lambda i: row(md5(seed || ':swap:' || i), i)))[2], 0) as swap from k),
    l as (select *, ('0x' || substr(md5(seed || ':letter:' || swap), 1, 4))::int % greatest(length(w[swap]) - 3, 1) + 2 as place from s)
    select conv_id, turn, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i:
        case when art[i] and not p[i] and ('0x' || substr(md5(seed || ':drop:' || i), 1, 4))::int % 3 = 0 then null when pair > 0 and i = pair + 1 then null when pair > 0 and i = pair then w[i] || w[i + 1]
             when i = swap then substr(w[i], 1, place - 1) || substr(w[i], place + 1, 1) || substr(w[i], place, 1) || substr(w[i], place + 2) else w[i] end), lambda x: x is not null), ' ') as noisy from l""")
def noise_protected(t: Tables) -> DataFrame:
    """Whole texts with articles dropped, a pair merged and a word misspelt; words with digits, at signs or a capital stay as they are."""
    return with_noise(t.conversations).select("conv_id", "turn", "noisy")


def with_noise(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text, noisy): texts beside their noisy form, which depends on the keys."""
    rows = turns.where("text is not null").select("conv_id", "turn", "text", F.split("text", " ").alias("w"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("seed"))
    marked = rows.withColumn("p", F.transform("w", lambda x: x.rlike("[0-9@]|^[A-Z]")))
    return marked.select("conv_id", "turn", "text", F.array_join(K.noisy(F.col("w"), F.col("p"), F.col("seed")), " ").alias("noisy"))
