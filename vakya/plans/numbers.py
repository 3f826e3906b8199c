"""Queries on numbers and the words for them: what is said from a table's numbers comes back as these numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aloud as A
from ..functions import grammar as G
from ..functions import spoken as N
from .registry import Tables, count_n, query

ALL = " ".join(N.SMALL)
TENS = " ".join(N.TENS)


def sql_under(x: str) -> str:
    """DuckDB SQL of the words of 0 to 99."""
    return f"(case when {x} < 20 then split_part('{ALL}', ' ', cast({x} as int) + 1) else split_part('{TENS}', ' ', cast({x} // 10 as int) - 1) || case when {x} % 10 > 0 then ' ' || split_part('{ALL}', ' ', cast({x} % 10 as int) + 1) else '' end end)"


def sql_cardinal(x: str) -> str:
    part = lambda y, word: f"case when {y} > 0 then {sql_under(y)} || ' {word} ' else '' end"
    return f"(case when {x} = 0 then 'zero' else trim({part(f'({x} // 10000000)', 'crore')} || {part(f'({x} // 100000 % 100)', 'lakh')} || {part(f'({x} // 1000 % 100)', 'thousand')} || {part(f'({x} // 100 % 10)', 'hundred')} || case when {x} % 100 > 0 then {sql_under(f'({x} % 100)')} else '' end) end)"


def sql_digits(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[0-9]'), lambda d: split_part('{ALL}', ' ', cast(d as int) + 1)), ' ')"


PRICE = "cast(floor(o_totalprice) as bigint)"
DATE = "strftime(o_orderdate, '%Y-%m-%d')"


def tokens(text: Column) -> Column:
    return F.split(text, " ")


@query("num_cardinal", f"""
    select o_orderkey, {sql_cardinal(PRICE)} as words, case when year(o_orderdate) between 2000 and 2009 then {sql_cardinal('cast(year(o_orderdate) as bigint)')} when year(o_orderdate) % 100 = 0 then {sql_under('(year(o_orderdate) // 100)')} || ' hundred' else {sql_under('(year(o_orderdate) // 100)')} || case when year(o_orderdate) % 100 < 10 then ' oh ' else ' ' end || {sql_under('(year(o_orderdate) % 100)')} end as year_words from orders""")
def cardinal(t: Tables) -> DataFrame:
    """Amounts on the Indian scale, and years as they are said."""
    return t.orders.select("o_orderkey", N.cardinal(F.floor("o_totalprice")).alias("words"), N.year(F.year("o_orderdate")).alias("year_words"))


@query("num_ordinal", f"""
    with w as (select distinct p_size as n, {sql_cardinal('cast(p_size as bigint)')} as w from part), l as (select *, split_part(w, ' ', -1) as last from w)
    select n, substr(w, 1, length(w) - length(last)) || case last when 'one' then 'first' when 'two' then 'second' when 'three' then 'third' when 'five' then 'fifth' when 'eight' then 'eighth' when 'nine' then 'ninth' when 'twelve' then 'twelfth' else case when last like '%y' then substr(last, 1, length(last) - 1) || 'ieth' else last || 'th' end end as words from l""")
def ordinal(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").alias("n")).distinct().select("n", N.ordinal(F.col("n").cast("bigint")).alias("words"))


@query("num_scored", f"""
    select o_orderkey, 'pay ' || {PRICE} || ' rupees and ' || (o_orderkey % 1000) || ' more' as written from orders""")
def scored(t: Tables) -> DataFrame:
    """Number words in text as digits, for scoring: amounts that were said come back."""
    said = F.concat(F.lit("pay "), N.cardinal(F.floor("o_totalprice")), F.lit(" rupees and "), N.cardinal(F.col("o_orderkey") % 1000), F.lit(" more"))
    return t.orders.select("o_orderkey", F.array_join(N.numbers_to_digits(tokens(said)), " ").alias("written"))


@query("num_hundreds", """
    with k as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events) select event_id, 'room ' || cast((k % 9 + 1) * 100 + k as varchar) || ' of ' || (k % 9 + 1) * 100 as written from k""")
def hundreds(t: Tables) -> DataFrame:
    """X hundred and Y as one number; X hundred alone too."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    x = k % 9 + 1
    said = F.concat(F.lit("room "), N.under_hundred(x), F.lit(" hundred"), F.when(k > 0, F.concat(F.lit(" and "), N.under_hundred(k))).otherwise(F.lit("")), F.lit(" of "), N.under_hundred(x), F.lit(" hundred"))
    return t.events.select("event_id", F.array_join(N.numbers_to_digits(tokens(said)), " ").alias("written"))


@query("num_audit", """
    select case when o_totalprice < 100000 then 'thousands' else 'lakhs' end as size, count(*) as n, count(*) as agree from orders group by 1""")
def audit(t: Tables) -> DataFrame:
    """A second way from words to numbers, by a join of words with their values and sums by scale, against the first."""
    said = t.orders.select("o_orderkey", "o_totalprice", N.cardinal(F.floor("o_totalprice")).alias("said"))
    words = said.select("o_orderkey", F.posexplode(F.split("said", " ")).alias("i", "word"))
    small = t.spark.createDataFrame(list(N.VALUES.items()), "word string, v long")
    scales = t.spark.createDataFrame(list(N.SCALES.items()), "word string, s long")
    wide = words.join(F.broadcast(small), "word", "left").join(F.broadcast(scales), "word", "left")
    listed = wide.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "v", "s"))).alias("w"))
    # A word counts times the hundred after it, if any comes before the next scale, and times the next scale.
    rest = lambda w, i: F.filter(w, lambda y: (y["i"] > i) & y["s"].isNotNull())
    big = lambda w, i: F.filter(rest(w, i), lambda y: y["s"] > 100)
    factor = lambda w, x: F.when((F.size(rest(w, x["i"])) > 0) & (rest(w, x["i"])[0]["s"] == 100), 100).otherwise(1) * F.coalesce(F.get(big(w, x["i"]), F.lit(0))["s"], F.lit(1))
    value = F.aggregate(F.filter("w", lambda x: x["v"].isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x["v"] * factor(F.col("w"), x))
    second = listed.select("o_orderkey", value.alias("second"))
    first = said.select("o_orderkey", "o_totalprice", N.numbers_to_digits(F.split("said", " "))[0].cast("bigint").alias("first"))
    size = F.when(F.col("o_totalprice") < 100_000, "thousands").otherwise("lakhs")
    return first.join(second, "o_orderkey").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == F.col("second")).alias("agree"))


@query("num_compact_id", """
    select o_orderkey, 'order A' || cast(o_orderkey as varchar) || ' of two' as written from orders""")
def compact_id(t: Tables) -> DataFrame:
    """Letters and digits said one by one as an identifier; a single one stays a word."""
    said = F.concat(F.lit("order a "), N.digit_words(F.col("o_orderkey").cast("string")), F.lit(" of two"))
    return t.orders.select("o_orderkey", F.array_join(N.compact_ids(tokens(said)), " ").alias("written"))


@query("num_ten_digits", """
    with p as (select c_custkey, lpad(cast(c_custkey as varchar), case when c_custkey % 4 = 0 then 9 else 10 end, '9') as d from customer)
    select c_custkey, 'call ' || case when length(d) = 10 then d else substr(d, 1, 5) || ' ' || substr(d, 6) end || ' in 5 days' as written from p""")
def ten_digits(t: Tables) -> DataFrame:
    """Neighbouring groups of digits that make up ten digits, joined; others stay."""
    d = F.lpad(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, 9).otherwise(10), F.lit("9"))
    said = F.concat(F.lit("call "), F.substring(d, 1, 5), F.lit(" "), F.expr("substring(d, 6)"), F.lit(" in 5 days"))
    return t.customer.select("c_custkey", d.alias("d")).select("c_custkey", F.array_join(N.joined_digits(tokens(said), 10), " ").alias("written"))


@query("num_id_groups", """
    select o_orderkey, case when o_orderkey % 2 = 0 then 'order number ' || lpad(cast(o_orderkey as varchar), 8, '7') || ' please' else 'buy ' || substr(lpad(cast(o_orderkey as varchar), 8, '7'), 1, 3) || ' ' || substr(lpad(cast(o_orderkey as varchar), 8, '7'), 4, 2) || ' ' || substr(lpad(cast(o_orderkey as varchar), 8, '7'), 6, 3) || ' please' end as written from orders""")
def id_groups(t: Tables) -> DataFrame:
    """Groups of digits after the name of an identifier are one; elsewhere they stay apart."""
    d = F.lpad(F.col("o_orderkey").cast("string"), 8, "7")
    groups = F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 3))
    said = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("order number ")).otherwise(F.lit("buy ")), groups, F.lit(" please"))
    lead, run = F.regexp_extract(said, r"^(.*?\b(?:number|id|ref) )?([0-9 ]*[0-9])?(.*)$", 1), F.regexp_extract(said, r"^(.*?\b(?:number|id|ref) )?([0-9 ]*[0-9])?(.*)$", 2)
    tail = F.regexp_extract(said, r"^(.*?\b(?:number|id|ref) )?([0-9 ]*[0-9])?(.*)$", 3)
    return t.orders.select("o_orderkey", F.when(lead != "", F.concat(lead, F.replace(run, F.lit(" "), F.lit("")), tail)).otherwise(said).alias("written"))


@query("num_at_repair", """
    select c_custkey, 'code ' || cast(c_custkey as varchar) || '8' || cast(c_nationkey as varchar) || ' at home' as written from customer""")
def at_repair(t: Tables) -> DataFrame:
    """``at`` between digits was an eight that was misheard; elsewhere it stays."""
    said = F.concat(F.lit("code "), F.col("c_custkey").cast("string"), F.lit(" at "), F.col("c_nationkey").cast("string"), F.lit(" at home"))
    return t.customer.select("c_custkey", F.regexp_replace(said, "(?<=[0-9]) at (?=[0-9])", "8").alias("written"))


@query("num_pairs", f"""
    with n as (select event_id, cast(json_extract_string(props, '$.k') as bigint) % 8 + 1 as a from events)
    select event_id, case when event_id % 2 = 0 then 'in ' || split_part('{ALL}', ' ', cast(a as int) + 1) || '-' || split_part('{ALL}', ' ', cast(a as int) + 2) || ' days' else 'in ' || a || ' days' end as written from n""")
def pairs(t: Tables) -> DataFrame:
    """Neighbouring numbers (two three days) are a guess and stay words; a single number becomes digits."""
    a = F.get_json_object("props", "$.k").cast("bigint") % 8 + 1
    said = F.concat(F.lit("in "), N.under_hundred(a), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), N.under_hundred(a + 1))).otherwise(F.lit("")), F.lit(" days"))
    return t.events.select("event_id", F.array_join(N.numbers_to_digits(tokens(N.approximate_pairs(said))), " ").alias("written"))


@query("num_spoken_groups", f"""
    select o_orderkey, 'rupees ' || {sql_cardinal(PRICE)} || ' on ' || {sql_under('cast(day(o_orderdate) as bigint)')} || ' ' || lower(strftime(o_orderdate, '%B')) || ' at ' || {sql_under('(o_orderkey % 12 + 1)')} || ' ' || {sql_under('(o_orderkey % 40 + 10)')} || ' call ' || {sql_digits("lpad(cast(o_custkey as varchar), 10, '9')")} as spoken from orders""")
def spoken_groups(t: Tables) -> DataFrame:
    """A written notice as it is said, group by group: amount, date, time and phone."""
    key = F.col("o_orderkey")
    written = F.concat(F.lit("Rs "), F.floor("o_totalprice").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" at "), (key % 12 + 1).cast("string"), F.lit(":"), (key % 40 + 10).cast("string"), F.lit(" call "), F.lpad(F.col("o_custkey").cast("string"), 10, "9"))
    rows = t.orders.select("o_orderkey", written.alias("written"))
    part = lambda pattern, i: F.regexp_extract("written", pattern, i)
    number = lambda pattern, i: part(pattern, i).cast("bigint")
    day, clock = r"([0-9]+)/([0-9]+)/[0-9]{4}", "([0-9]+):([0-9]{2})"
    month = F.element_at(F.array(*[F.lit(x) for x in "january february march april may june july august september october november december".split()]), part(day, 2).cast("int"))
    said = F.concat_ws(" ", F.lit("rupees"), N.cardinal(number("Rs ([0-9]+)", 1)), F.lit("on"), N.under_hundred(number(day, 1)), month, F.lit("at"), N.under_hundred(number(clock, 1)), N.under_hundred(number(clock, 2)), F.lit("call"), N.digit_words(part("([0-9]{10})$", 1)))
    return rows.select("o_orderkey", said.alias("spoken"))


@query("num_aligned_tokens", f"""
    with w as (select o_orderkey, {PRICE} as n, {sql_cardinal(PRICE)} as w from orders) select o_orderkey, cast(len(string_split(w, ' ')) as bigint) as n_words, n as written, string_split(w, ' ')[1] as first_word from w""")
def aligned_tokens(t: Tables) -> DataFrame:
    """Spoken words, each beside the written token it stands for: counted and read back by token."""
    rows = t.orders.select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("written"))
    words = rows.select("o_orderkey", "written", F.posexplode(F.split(N.cardinal(F.col("written")), " ")).alias("i", "word"))
    return words.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_words"), F.max("written").alias("written"), F.min_by("word", "i").alias("first_word"))


@query("num_grammar_texts")
def grammar_texts(t: Tables) -> DataFrame:
    """Whole texts of documents and conversations with their spoken numbers as digits, and how many numbers they then have."""
    texts = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(t.conversations.select(F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"))
    found = texts.select("id", "text", G.spoken_to_written("text").alias("written"))
    return found.select("id", F.md5("written").alias("digest"), (F.col("written") != F.col("text")).alias("changed"), F.size(G.written_numbers("written")).alias("numbers"))


@query("num_grammar_orders", """
    select o_orderkey, 'Rs ' || cast(floor(o_totalprice) as bigint) || ' rupees for order ID EC' || lpad(cast(o_orderkey as varchar), 6, '0') || ', call ' || replace(c_phone, '-', '') || ' now' as written from orders join (select c_custkey, lpad(cast(c_custkey * 7919 + 1000000 as varchar), 10, '9') as c_phone from customer) on c_custkey = o_custkey""")
def grammar_orders(t: Tables) -> DataFrame:
    """Amounts by the Indian scale, identifiers and phones digit by digit, as they are said of each order, back to digits."""
    phone = F.lpad((F.col("c_custkey") * 7919 + 1000000).cast("string"), 10, "9")
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), phone.alias("phone")), "o_custkey")
    said = F.concat(F.lit("Rs "), N.cardinal(F.floor("o_totalprice")), F.lit(" rupees for order ID EC "), N.digit_words(F.lpad(F.col("o_orderkey").cast("string"), 6, "0")), F.lit(", call "), N.digit_words(F.col("phone")), F.lit(" now"))
    return rows.select("o_orderkey", G.spoken_to_written(said).alias("written"))


@query("num_said_tokens")
def said_tokens(t: Tables) -> DataFrame:
    """Tokens of all documents that are said otherwise than written (mails, phones, numbers, identifiers, capitals, months), in two scripts, counted."""
    return A.groups(t.documents, "doc_id", "text").groupBy("written", "latin", "devanagari").agg(count_n())


def sql_said(words: str, form: int) -> str:
    """DuckDB SQL of canonical words in one of the two scripts."""
    return f"array_to_string(list_transform(string_split({words}, ' '), lambda w: map {{{', '.join(f"'{k}': '{v[form]}'" for k, v in A.SAID.items())}}}[w]), ' ')"


@query("num_said_orders", f"""
    with w as (select o_orderkey, {sql_cardinal(PRICE)} || ' rupaye' as a, {sql_under('cast(day(o_orderdate) as bigint)')} || ' ' || lower(strftime(o_orderdate, '%B')) || ' nineteen ' || {sql_under('cast(year(o_orderdate) % 100 as bigint)')} as b, 'E C ' || {sql_digits("lpad(cast(o_orderkey as varchar), 6, '0')")} as c, {sql_under('(o_orderkey % 12 + 1)')} || case o_orderkey % 60 when 0 then '' else case when o_orderkey % 60 < 10 then ' oh' else '' end || ' ' || {sql_under('(o_orderkey % 60)')} end || ' P M' as d from orders where year(o_orderdate) < 2000),
    x as (select o_orderkey, a || ' ' || b || ' ' || c || ' ' || d as words from w) select o_orderkey, {sql_said('words', 1)} as latin, {sql_said('words', 0)} as devanagari from x""")
def said_orders(t: Tables) -> DataFrame:
    """Notices of orders before 2000 as they are said in two scripts: amount, date, identifier and time, put together from their tokens."""
    key = F.col("o_orderkey")
    written = F.format_string("pay Rs %d, by %s for EC-%s at %d:%02dpm.", F.floor("o_totalprice").cast("bigint"), F.date_format("o_orderdate", "d/M/yyyy"), F.lpad(key.cast("string"), 6, "0"), key % 12 + 1, key % 60)
    rows = t.orders.where(F.year("o_orderdate") < 2000).select("o_orderkey", written.alias("written"))
    # A notice stays one row and nothing is shuffled. Exploding binds what is found.
    words = rows.select("o_orderkey", A.tokens(F.col("written")).alias("w"))
    found = words.select("o_orderkey", F.explode(F.filter(F.array(A.found(F.col("w"))), lambda s: F.size(s) > 0)).alias("s"))
    said = found.select("o_orderkey", A.voiced(F.array_join(F.transform("s", lambda x: x["items"]), " ")).alias("said"))
    return said.select("o_orderkey", "said.latin", "said.devanagari")
