"""Queries on lexicons that are made from the tables, labels by ordered rules, and two scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import script as SC
from ..functions import spoken as N
from ..functions import text as X
from .registry import Tables, count_n, query
from .texts import ALNUM

SQL_WORDS = f"w as (select lang, unnest({ALNUM.format('text')}) as word from documents), k as (select word, count(*) filter (where lang = 'en') as e, count(*) filter (where lang = 'de') as h from w group by 1)"


def word_counts(t: Tables) -> DataFrame:
    """(word, e, h): how often English and German documents have a word."""
    words = t.documents.select("lang", F.explode(X.alnum_tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count_if(F.col("lang") == "en").alias("e"), F.count_if(F.col("lang") == "de").alias("h"))


@query("tx_rule_labels", f"""
    with {SQL_WORDS}, c as (select conv_id, unnest({ALNUM.format('text')}) as word from conversations), l as (select conv_id, case when regexp_matches(c.word, '^[0-9]+$') then 'N' when k.word is null or e + h = 0 then 'U' when e >= 4 * h then 'E' when h >= 4 * e then 'H' when length(c.word) <= 2 then 'X' when e >= h then 'E' else 'H' end as label from c left join k using (word))
    select conv_id, count(*) filter (where label = 'N') as numbers, count(*) filter (where label = 'U') as unknown, count(*) filter (where label = 'E') as e, count(*) filter (where label = 'H') as h, count(*) filter (where label = 'X') as ambiguous from l group by 1""")
def rule_labels(t: Tables) -> DataFrame:
    """Labels of tokens by rules in order: numbers, unknown words, words of one language, short ambiguous words, the more frequent language."""
    k = word_counts(t)
    counted = t.conversations.select("conv_id", F.explode(X.alnum_tokens(F.col("text"))).alias("word")).groupBy("conv_id", "word").agg(count_n())
    wide = counted.join(k, "word", "left")
    e, h = F.col("e"), F.col("h")
    label = F.when(F.col("word").rlike("^[0-9]+$"), "N").when(e.isNull() | (e + h == 0), "U").when(e >= h * 4, "E").when(h >= e * 4, "H").when(F.length("word") <= 2, "X").when(e >= h, "E").otherwise("H")
    n = lambda x: F.coalesce(F.sum(F.when(label == x, F.col("n"))), F.lit(0))
    return wide.groupBy("conv_id").agg(n("N").alias("numbers"), n("U").alias("unknown"), n("E").alias("e"), n("H").alias("h"), n("X").alias("ambiguous"))


@query("tx_generated_forms", f"""
    with {SQL_WORDS}, r as (select word as root from k where e >= 3 and length(word) between 3 and 6), f as (select root, s, root || s as form from r, (select unnest(['ed', 'ing', 'er', 'ly']) as s)), known as (select word, e from k where e > 0)
    select s as suffix, count(*) as generated, count(known.word) as attested, cast(coalesce(sum(known.e), 0) as bigint) as used from f left join known on f.form = known.word where form not in ('thing', 'other') group by 1""")
def generated_forms(t: Tables) -> DataFrame:
    """A lexicon of roots with suffixes, without forbidden forms, and how many of the forms texts use."""
    k = word_counts(t)
    roots = k.where((F.col("e") >= 3) & F.length("word").between(3, 6)).select(F.col("word").alias("root"))
    forms = roots.select(F.explode(F.array(*map(F.lit, ("ed", "ing", "er", "ly")))).alias("suffix"), "root").withColumn("word", F.concat("root", "suffix")).where(~F.col("word").isin("thing", "other"))
    return forms.join(k.where("e > 0").select("word", "e"), "word", "left").groupBy("suffix").agg(count_n().alias("generated"), F.count("e").alias("attested"), F.coalesce(F.sum("e"), F.lit(0)).alias("used"))


@query("tx_measured_duration", f"""
    with t as (select conv_id, turn, role, length(text) / 15.0 as s, list_sum(list_transform({ALNUM.format('text')}, lambda x: case when length(regexp_replace(x, '[^0-9]', '', 'g')) = 0 then 1 else length(regexp_replace(x, '[^0-9]', '', 'g')) end)) as u from conversations), r as (select role, sum(u) / sum(s) as rate from t group by 1)
    select conv_id, round(1.0 + sum(coalesce(u, 0) / rate) + 0.3 * (count(*) - 1) - 0.2 * count(*) filter (where turn % 3 = 0), 4) as seconds from t join r using (role) group by 1""")
def measured_duration(t: Tables) -> DataFrame:
    """Estimated length of a call with a rate measured for each speaker, pauses between turns and overlaps."""
    rows = t.conversations.select("conv_id", "turn", "role", (F.length("text") / 15.0).alias("s"), X.spoken_units(X.alnum_tokens(F.col("text"))).alias("u"))
    rates = rows.groupBy("role").agg((F.sum("u") / F.sum("s")).alias("rate"))
    total = F.lit(1.0) + F.sum(F.col("u") / F.col("rate")) + (F.count(F.lit(1)) - 1) * 0.3 - F.count_if(F.col("turn") % 3 == 0) * 0.2
    return rows.join(F.broadcast(rates), "role").groupBy("conv_id").agg(F.round(total, 4).alias("seconds"))  # one row for each role


@query("tx_echo_kinds", """
    select o_orderkey, case o_orderkey % 4 when 0 then 'phone' when 1 then 'id' when 2 then 'email' else 'words' end as kind, o_orderkey % 8 < 4 as echoed from orders""")
def echo_kinds(t: Tables) -> DataFrame:
    """Whether a line repeats a value, by its kind: phone by ten digits, identifier by its run, mail in normal form, words by a share."""
    key = F.col("o_orderkey")
    d = F.lpad(key.cast("string"), 10, "8")
    case, right = key % 4, key % 8 < 4
    value = F.when(case == 0, d).when(case == 1, F.concat(F.lit("AB"), d)).when(case == 2, F.concat(F.lit("u"), d, F.lit("@example.com"))).otherwise("green house by river")
    said = F.when(case == 0, F.concat(F.lit("+91 "), F.when(right, d).otherwise(F.reverse(F.concat(F.lit("1"), F.substring(d, 2, 9)))))).when(case == 1, F.concat(F.lit("it is ab"), F.when(right, d).otherwise(F.concat(d, F.lit("0"))), F.lit(" yes"))).when(case == 2, F.concat(F.when(right, "u").otherwise("v"), d, F.lit(" at example dot com"))).otherwise(F.when(right, "the green house by river").otherwise("a house"))
    rows = t.orders.select("o_orderkey", case.alias("k"), value.alias("value"), said.alias("said"))
    k = F.col("k")
    echoed = F.when(k == 0, X.phone_canonical(F.col("said")) == F.col("value")).when(k == 1, F.array_contains(X.alnum_tokens(F.col("said")), F.lower("value"))).when(k == 2, X.email_normal(F.col("said")) == F.col("value")).otherwise(X.overlap_share(F.split("value", " "), F.split("said", " ")) >= 0.6)
    kind = F.element_at(F.array(*map(F.lit, ("phone", "id", "email", "words"))), (k + 1).cast("int"))
    return rows.select("o_orderkey", kind.alias("kind"), echoed.alias("echoed"))


FAMILIES = {"promise": "werde|wird|will|vais", "done": "was|war|est|ist", "formal": "sie|vous|usted", "familiar": "du|tu|te"}


@query("tx_registers", "select conv_id, role, " + ", ".join(f"len(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:{p})(?:[^a-z]|$)')) as {n}" for n, p in FAMILIES.items()) + ", turn from conversations")
def registers(t: Tables) -> DataFrame:
    """Words of four families in a line: promises, done actions, formal and familiar address."""
    n = lambda p: F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"(?:^|[^a-z])(?:{p})(?:[^a-z]|$)"), F.lit(0))).cast("bigint")
    return t.conversations.select("conv_id", "turn", "role", *[n(p).alias(k) for k, p in FAMILIES.items()])


OVERRIDES = [("red", "name", "colour", 1), ("blue", "name", "colour", 1), ("old", "name", "used", 2), ("PROMO", "type", "offer", 3), ("SMALL", "type", "light", 4)]


@query("tx_override_flags", """
    with o as (select * from (values ('red', 'name', 'colour', 1), ('blue', 'name', 'colour', 1), ('old', 'name', 'used', 2), ('PROMO', 'type', 'offer', 3), ('SMALL', 'type', 'light', 4)) v(word, field, flag, rank)), w as (select p_partkey, 'name' as field, unnest(string_split(p_name, ' ')) as word from part union all select p_partkey, 'type', p_type from part), f as (select p_partkey, flag, rank from w join o using (field, word))
    select p_partkey, string_agg(distinct flag, ',' order by flag) as flags, arg_min(flag, rank) as first_flag from f group by 1""")
def override_flags(t: Tables) -> DataFrame:
    """Flags that a table of keywords by field gives a record; the rule of the least rank comes first."""
    rules = t.spark.createDataFrame(OVERRIDES, "word string, field string, flag string, rank int")
    words = t.part.select("p_partkey", F.explode(F.concat(F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("name").alias("field"), w.alias("word"))), F.array(F.struct(F.lit("type").alias("field"), F.col("p_type").alias("word"))))).alias("x")).select("p_partkey", "x.field", "x.word")
    found = words.join(F.broadcast(rules), ["field", "word"])  # five rules
    return found.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.min_by("flag", "rank").alias("first_flag"))


@query("tx_fuzzy_guard", f"""
    with {SQL_WORDS}, known as (select distinct unnest(string_split(lower(p_name), ' ')) as part_word from part), d as (select distinct word from w where length(word) >= 3), u as (select word from d where word not in (select part_word from known))
    select word, part_word, round(1 - levenshtein(word, part_word) / greatest(length(word), length(part_word)), 6) as similarity from u join known on left(word, 2) = left(part_word, 2) where levenshtein(word, part_word) * 4 <= greatest(length(word), length(part_word))""")
def fuzzy_guard(t: Tables) -> DataFrame:
    """Words that are no known word but near one: candidates share their first two letters, so nothing is paired freely."""
    known = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("part_word")).distinct()
    words = word_counts(t).where(F.length("word") >= 3).select("word").join(known.select(F.col("part_word").alias("word")), "word", "left_anti")
    block = lambda c: F.substring(c, 1, 2)
    pairs = words.withColumn("b", block("word")).join(known.withColumn("b", block("part_word")), "b")
    d, n = F.levenshtein("word", "part_word"), F.greatest(F.length("word"), F.length("part_word"))
    return pairs.where(d * 4 <= n).select("word", "part_word", F.round(1 - d / n, 6).alias("similarity"))


@query("jn_fuzzy_titles", """
    with n as (select distinct p_name || ' ' || lower(p_type) as title from part), k as (select title, list_aggregate(list_sort(string_split(title, ' ')), 'string_agg', ' ') as sorted from n), w as (select title, sorted, unnest(string_split(title, ' ')) as word from k)
    select distinct a.title as title, b.title as other, round(1 - levenshtein(a.sorted, b.sorted) / greatest(length(a.sorted), length(b.sorted)), 6) as similarity from w a join w b on a.word = b.word and a.title < b.title where levenshtein(a.sorted, b.sorted) * 5 <= greatest(length(a.sorted), length(b.sorted)) * 2""")
def fuzzy_titles(t: Tables) -> DataFrame:
    """Titles that are alike whatever the order of their words; candidates share a word."""
    titles = t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title")).distinct().withColumn("sorted", F.array_join(F.array_sort(F.split("title", " ")), " "))
    words = titles.select("title", "sorted", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    pairs = words.join(words.select(F.col("title").alias("other"), F.col("sorted").alias("other_sorted"), "word"), "word").where("title < other").select("title", "other", "sorted", "other_sorted").distinct()
    d, n = F.levenshtein("sorted", "other_sorted"), F.greatest(F.length("sorted"), F.length("other_sorted"))
    return pairs.where(d * 5 <= n * 2).select("title", "other", F.round(1 - d / n, 6).alias("similarity"))


@query("num_token_kinds", """
    select event_id, cast(json_extract_string(props, '$.k') as bigint) % 10 + 200 as value, case when event_id % 3 = 0 then 'en' when event_id % 3 = 1 then 'hi' else 'hi-deva' end as lang, case when cast(json_extract_string(props, '$.k') as bigint) % 10 = 0 then 2 else 3 end as number_tokens from events""")
def token_kinds(t: Tables) -> DataFrame:
    """Tokens with their kind, language and value, by a join with a lexicon of number words in three forms; the values make up a number."""
    ones = list(zip(N.SMALL[1:10], N.HINDI, N.DEVANAGARI, range(1, 10), strict=True))
    rows = [(w, lang, "small", v) for en, hi, deva, v in ones for w, lang in ((en, "en"), (hi, "hi"), (deva, "hi-deva"))]
    rows += [("hundred", "en", "scale", 100), ("sau", "hi", "scale", 100), ("सौ", "hi-deva", "scale", 100)]
    lexicon = t.spark.createDataFrame(rows, "word string, lang string, kind string, value long")
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    word = lambda words: F.when(k > 0, F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, words)), F.greatest(k, F.lit(1)).cast("int")))).otherwise("")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("pay two hundred"), word(N.SMALL[1:10]))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("de do sau"), word(N.HINDI))).otherwise(F.concat(F.lit("दे दो सौ"), word(N.DEVANAGARI)))
    tokens = t.events.select("event_id", F.posexplode(F.split(said, " ")).alias("i", "word"))
    marked = tokens.join(F.broadcast(lexicon), "word")  # thirty words
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "kind", "value"))), lambda x: F.struct(x["kind"], x["value"]))
    value = F.aggregate(listed, F.lit(0).cast("bigint"), lambda a, x: F.when(x["kind"] == "scale", F.greatest(a, F.lit(1)) * x["value"]).otherwise(a + x["value"]))
    return marked.groupBy("event_id").agg(value.alias("value"), F.max("lang").alias("lang"), count_n().alias("number_tokens"))


@query("sc_transliterated", "select p_partkey, p_name as roman, length(p_name) > 0 as deva from part")
def transliterated(t: Tables) -> DataFrame:
    """Names spelt in Devanagari and back in Latin letters, with inherent vowels and viramas."""
    deva = SC.in_devanagari(F.col("p_name"))
    rows = t.part.select("p_partkey", deva.alias("x"))
    return rows.select("p_partkey", SC.in_latin(F.col("x")).alias("roman"), F.col("x").rlike("^[\\u0900-\\u097F ]+$").alias("deva"))


@query("src_referential", "select o_orderstatus, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1")
def referential(t: Tables) -> DataFrame:
    """Rows with their parents; a row without one stops the query with its key."""
    wide = t.lineitem.select("l_orderkey").join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ok = F.assert_true(F.col("o_orderkey").isNotNull(), F.concat(F.lit("no order for "), F.col("l_orderkey").cast("string")))
    return wide.where(ok.isNull()).groupBy("o_orderstatus").agg(count_n())


@query("val_window_review", """
    with l as (select l_orderkey, l_shipdate, l_partkey, o_orderdate from lineitem left join orders on o_orderkey = l_orderkey), i as (select l_orderkey as k, unnest([case when o_orderdate is null then 'no order' end, case when l_shipdate < o_orderdate then 'before' end, case when l_shipdate > o_orderdate + interval 3 years then 'late' end]) as issue from l union all select o_orderkey, 'empty' from orders where o_orderkey not in (select l_orderkey from lineitem))
    select issue, count(*) as n, array_to_string(list_sort(list(distinct k))[1:5], ',') as examples from i where issue is not null group by 1""")
def window_review(t: Tables) -> DataFrame:
    """Counters of issues of coverage and time, with up to five examples of each."""
    l = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rules = F.array(F.when(F.col("o_orderdate").isNull(), "no order"), F.when(F.col("l_shipdate") < F.col("o_orderdate"), "before"), F.when(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 3 years"), "late"))
    found = l.select(F.col("l_orderkey").alias("k"), F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("issue"))
    empty = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("k"), F.lit("empty").alias("issue"))
    rows = found.unionByName(empty)
    # The first five of each issue by a rank over distinct keys, so that no list is longer.
    ranked = rows.select("issue", "k").distinct().withColumn("r", F.row_number().over(W.partitionBy("issue").orderBy("k"))).where("r <= 5")
    examples = ranked.groupBy("issue").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("examples"))
    return rows.groupBy("issue").agg(count_n()).join(examples, "issue")


@query("str_early_closed", """
    with f as (select *, lag(ts) over w as before, lag(event_type) over w as last from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(case when before is null or ts - before > interval 12 hours or last = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id) as seg from f)
    select user_id, seg, count(*) as n, min(event_id) as first, max(event_id) as last, max(case when event_type = 'purchase' then 1 else 0 end) = 1 as closed_early from s group by 1, 2""")
def early_closed(t: Tables) -> DataFrame:
    """Segments that end at a gap, or early at a closing event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    new = before.isNull() | (F.col("ts") - before > F.expr("interval 12 hours")) | F.coalesce(F.lag("event_type").over(w) == "purchase", F.lit(False))
    marked = t.events.withColumn("new", F.when(new, 1).otherwise(0))
    return marked.withColumn("seg", F.sum("new").over(w)).groupBy("user_id", "seg").agg(count_n(), F.min("event_id").alias("first"), F.max("event_id").alias("last"), (F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)) == 1).alias("closed_early"))
