"""Queries on nested records, spans of text, candidates in text, and tokens of access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import Tables, count_n, query
from .texts import ALNUM, FOLD

SPLIT = "regexp_split_to_array({0}, '[ \\n]+')"


def space_tokens(x: Column) -> Column:
    return F.split(x, "[ \\n]+")


@query("prj_tagged_turns", """
    with t as (select conv_id, list_concat(case when turn = 0 then ['greeting'] else [] end, case when contains(text, '?') then ['check'] else [] end, case when length(text) > 400 then ['long'] else [] end) as tags from conversations)
    select conv_id, count(*) filter (where list_has_any(tags, ['greeting', 'check'])) as tagged, count(*) filter (where not list_has_any(tags, ['greeting', 'check', 'long'])) as free from t group by 1""")
def tagged_turns(t: Tables) -> DataFrame:
    """Turns whose tags meet a set, and those that have none of it."""
    tags = F.filter(F.array(F.when(F.col("turn") == 0, "greeting"), F.when(F.col("text").contains("?"), "check"), F.when(F.length("text") > 400, "long")), lambda x: x.isNotNull())
    meet = lambda *names: F.arrays_overlap("tags", F.array(*map(F.lit, names)))
    return t.conversations.select("conv_id", tags.alias("tags")).groupBy("conv_id").agg(F.count_if(meet("greeting", "check")).alias("tagged"), F.count_if(~meet("greeting", "check", "long")).alias("free"))


@query("prj_find_key", """
    select event_id, json_extract_string(props, '$.k') as k, case when event_type in ('view', 'click', 'signup', 'purchase') then event_type else 'top' end as found_under from events""")
def find_key(t: Tables) -> DataFrame:
    """The first value of a key in nested JSON, whichever branch has it (as a variant, over the candidate paths)."""
    k = F.get_json_object("props", "$.k")
    nested = lambda *path: F.concat(*[F.lit(f'{{"{p}":') for p in path], F.lit('{"k":"'), k, F.lit('"}'), F.lit("}" * len(path)))
    kind = F.col("event_type")
    doc = F.when(kind == "view", nested("view")).when(kind == "click", nested("meta", "click")).when(kind == "signup", nested("meta", "form", "signup")).when(kind == "purchase", nested("purchase")).otherwise(F.concat(F.lit('{"k":"'), k, F.lit('"}')))
    paths = {"top": "$.k", "view": "$.view.k", "purchase": "$.purchase.k", "click": "$.meta.click.k", "signup": "$.meta.form.signup.k"}
    rows = t.events.select("event_id", F.parse_json(doc).alias("v"))
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.try_variant_get("v", p, "string").alias("k")) for n, p in paths.items()]), lambda x: x["k"].isNotNull())
    return rows.select("event_id", hits[0]["k"].alias("k"), hits[0]["name"].alias("found_under"))


@query("prj_name_tokens", """
    with r as (select c_custkey, map {'name': c_name, 'segment': c_mktsegment, 'note': 'Meets Anna in Rome', 'city': n_name} as m from customer join nation on n_nationkey = c_nationkey), e as (select c_custkey, unnest(map_entries(m)) as e from r)
    select c_custkey, count(distinct w) as excluded from (select c_custkey, unnest(case when e.key in ('name', 'city') then regexp_extract_all(e.value, '[A-Za-z]+') else regexp_extract_all(e.value, '(?:^| )([A-Z][a-z]+)', 1) end) as w from e) group by 1""")
def name_tokens(t: Tables) -> DataFrame:
    """Words of a record that are names: all under name-like keys, elsewhere those with a capital."""
    wide = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    record = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("note"), F.lit("Meets Anna in Rome"), F.lit("city"), "n_name")
    words = F.transform(F.map_entries(record), lambda e: F.when(e["key"].isin("name", "city"), F.regexp_extract_all(e["value"], F.lit("[A-Za-z]+"), F.lit(0))).otherwise(F.regexp_extract_all(e["value"], F.lit("(?:^| )([A-Z][a-z]+)"), F.lit(1))))
    return wide.select("c_custkey", F.size(F.array_distinct(F.flatten(words))).cast("bigint").alias("excluded"))


@query("prj_redacted_flags", """
    with f as (select conv_id, turn, list_filter([case when length(text) > 300 then 'too long' end, case when contains(text, '?') then 'asks' end, case when not regexp_matches(trim(text), '[.!?]$') then 'unfinished' end], lambda x: x is not null) as flags from conversations)
    select conv_id, turn, array_to_string(list_filter(flags, lambda x: not (turn % 2 = 1 and x <> 'unfinished')), ',') as kept, len(flags) as raised from f""")
def redacted_flags(t: Tables) -> DataFrame:
    """Flags of lines without those that are expected there."""
    c = F.col("text")
    flags = F.filter(F.array(F.when(F.length(c) > 300, "too long"), F.when(c.contains("?"), "asks"), F.when(~F.trim(c).rlike("[.!?]$"), "unfinished")), lambda x: x.isNotNull())
    rows = t.conversations.select("conv_id", "turn", flags.alias("flags"))
    kept = F.filter("flags", lambda x: ~((F.col("turn") % 2 == 1) & (x != "unfinished")))
    return rows.select("conv_id", "turn", F.array_join(kept, ",").alias("kept"), F.size("flags").cast("bigint").alias("raised"))


@query("prj_deep_map", f"""
    select conv_id, md5(string_agg(role || ':' || lower(translate(text, '{FOLD[0]}', '{FOLD[1]}')), '|' order by turn)) as mapped, count(*) as fields from conversations group by 1""")
def deep_map(t: Tables) -> DataFrame:
    """A function over each text field of a nested record."""
    record = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    mapped = record.withColumn("turns", F.transform("turns", lambda x: x.withField("text", F.lower(F.translate(x["text"], *FOLD)))))
    return mapped.select("conv_id", F.md5(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")).alias("mapped"), F.size("turns").cast("bigint").alias("fields"))


@query("prj_post_processed", r"""
    with w as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') as w, text from conversations), p as (select conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i)[1:5] as tags, text from w)
    select conv_id, turn, array_to_string(tags, ',') as tags, md5(case when turn % 3 = 2 then regexp_replace(trim(text), '[.,;:!?]+$', '') else trim(text) end) as text from p""")
def post_processed(t: Tables) -> DataFrame:
    """Tags once each in their order, and lines that were cut off without their last marks."""
    tags = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))), 1, 5)
    text = F.when(F.col("turn") % 3 == 2, F.regexp_replace(F.trim("text"), "[.,;:!?]+$", "")).otherwise(F.trim("text"))
    return t.conversations.select("conv_id", "turn", F.array_join(tags, ",").alias("tags"), F.md5(text).alias("text"))


@query("tx_placeholder_tokens", """
    select event_id, case when event_id % 3 = 0 then ['car', 'PLATE', 'left'] else ['car', 'left', 'gate', cast(event_id as varchar)] end as tokens from events""")
def placeholder_tokens(t: Tables) -> DataFrame:
    """Tokens with vehicle plates as one placeholder, inner apostrophes and runs with digits kept."""
    n = F.lpad((F.col("event_id") % 10_000).cast("string"), 4, "0")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Car MH 12 AB "), n, F.lit(" left."))).otherwise(F.concat(F.lit("Car left gate "), F.col("event_id").cast("string")))
    masked = F.regexp_replace(said, r"\b[A-Z]{2} ?[0-9]{1,2} ?[A-Z]{1,2} ?[0-9]{4}\b", "plate")
    found = F.regexp_extract_all(F.lower(masked), F.lit("[a-z]+(?:'[a-z]+)*|[a-z0-9]*[0-9][a-z0-9]*"), F.lit(0))
    return t.events.select("event_id", F.transform(found, lambda x: F.when(x == "plate", "PLATE").otherwise(x)).alias("tokens"))


@query("tx_lexicon_counts", f"""
    with x as (select distinct unnest(string_split(lower(p_name), ' ')) as word from part where p_size % 2 = 0 union select distinct lower(r_name) from region), w as (select lang, unnest({ALNUM.format('text')}) as word from documents)
    select lang, count(*) as n, count(x.word) as known from w left join x using (word) group by 1""")
def lexicon_counts(t: Tables) -> DataFrame:
    """Words of a lexicon, read as lines of which comments are skipped, with an optional second list."""
    lines = t.part.select(F.when(F.col("p_size") % 2 == 0, F.lower("p_name")).otherwise(F.concat(F.lit("# "), F.col("p_name"))).alias("line"))
    lexicon = lines.where(~F.col("line").startswith("#")).select(F.explode(F.split("line", " ")).alias("word")).union(t.region.select(F.lower("r_name"))).distinct()
    words = t.documents.select("lang", F.explode(X.alnum_tokens(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(count_n()).join(lexicon.withColumn("known", F.lit(True)), "word", "left").groupBy("lang").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("known"))


@query("tx_echo_any", """
    with k as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events) select event_id, case event_id % 4 when 0 then 'raw' when 1 then 'number' when 2 then 'compact' end as echo from k""")
def echo_any(t: Tables) -> DataFrame:
    """A value that a line repeats as it is, as a number in words, or as digits one by one."""
    from ..functions import spoken as N

    k = F.get_json_object("props", "$.k")
    value = F.concat(F.lit("10"), F.lpad(k, 3, "0"))
    case = F.col("event_id") % 4
    said = F.when(case == 0, F.concat(F.lit("it is "), value)).when(case == 1, F.concat(F.lit("it is "), N.cardinal(value.cast("bigint")), F.lit(" then"))).when(case == 2, F.concat(F.lit("it is "), N.digit_words(value), F.lit(" then"))).otherwise(F.lit("it is not"))
    rows = t.events.select("event_id", value.alias("value"), F.split(said, " ").alias("w"))
    raw, number, compact = F.array_contains("w", F.col("value")), F.array_contains(N.numbers_to_digits(F.col("w")), F.col("value")), F.array_contains(N.compact_ids(F.col("w")), F.col("value"))
    return rows.select("event_id", F.when(raw, "raw").when(number, "number").when(compact, "compact").alias("echo"))


@query("tx_harvested", r"""
    select doc_id, len(list_distinct(list_concat(list_concat(regexp_extract_all(text, '[0-9]+'), regexp_extract_all(text, '[0-9]+(?:[,.][0-9]+)+')), regexp_extract_all(text, '[A-Za-z]+[0-9]+[A-Za-z0-9]*')))) as items, len(regexp_extract_all(text, '[A-Za-z]+[0-9]+[A-Za-z0-9]*')) as mixed from documents""")
def harvested(t: Tables) -> DataFrame:
    """Numbers and identifiers of a text: parts, whole numbers with separators, and letters with digits, once each."""
    each = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    mixed = each("[A-Za-z]+[0-9]+[A-Za-z0-9]*")
    return t.documents.select("doc_id", F.size(F.array_union(F.array_union(each("[0-9]+"), each("[0-9]+(?:[,.][0-9]+)+")), mixed)).cast("bigint").alias("items"), F.size(mixed).cast("bigint").alias("mixed"))


@query("tx_allowed_pieces", """
    select s_suppkey, list_sort(list_distinct(list_concat(regexp_extract_all(s_name, '[A-Za-z]+'), regexp_extract_all(n_name, '[A-Za-z]+')))) as pieces from supplier join nation on n_nationkey = s_nationkey""")
def allowed_pieces(t: Tables) -> DataFrame:
    """Latin pieces that a record's values have, out of the record as JSON."""
    wide = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    values = F.map_values(F.from_json(F.to_json(F.struct(F.col("s_name").alias("a"), F.col("n_name").alias("b"))), "map<string,string>"))
    return wide.select("s_suppkey", F.array_sort(F.array_distinct(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)))))).alias("pieces"))


@query("tx_mixed_words", r"""
    with w as (select conv_id, unnest(regexp_split_to_array(text, '[ \n]+')) as word from conversations)
    select conv_id, count(*) filter (where regexp_matches(word, '[A-Za-z][^\x00-\x7F][A-Za-z]')) as inside, count(*) filter (where regexp_matches(word, '^[^\x00-\x7F]')) as at_start, count(*) filter (where regexp_matches(word, '[0-9][A-Za-z]|[A-Za-z][0-9]')) as with_digits, count(*) filter (where regexp_matches(word, '[a-z][A-Z]')) as inner_capital, count(*) filter (where regexp_matches(word, '[^\x00-\x7F]{2}')) as doubled from w group by 1""")
def mixed_words(t: Tables) -> DataFrame:
    """Five rules on letters that are mixed within words."""
    words = t.conversations.select("conv_id", F.explode(space_tokens(F.col("text"))).alias("word"))
    n = lambda p: F.count_if(F.col("word").rlike(p))
    m = "[^\\x00-\\x7F]"
    return words.groupBy("conv_id").agg(n(f"[A-Za-z]{m}[A-Za-z]").alias("inside"), n(f"^{m}").alias("at_start"), n("[0-9][A-Za-z]|[A-Za-z][0-9]").alias("with_digits"), n("[a-z][A-Z]").alias("inner_capital"), n(f"{m}{{2}}").alias("doubled"))


@query("tx_ten_digit_phone", """
    select c_custkey, case when c_custkey % 5 = 4 then null else lpad(cast(c_custkey as varchar), 10, '9') end as phone from customer""")
def ten_digit_phone(t: Tables) -> DataFrame:
    """A phone as ten digits out of what was said: with a country code, a trunk zero, in groups or in words; null if there are not ten."""
    from ..functions import spoken as N

    d = F.lpad(F.col("c_custkey").cast("string"), 10, "9")
    case = F.col("c_custkey") % 5
    said = F.when(case == 0, F.concat(F.lit("+91 "), d)).when(case == 1, F.concat(F.lit("0"), d)).when(case == 2, F.concat_ws("-", F.substring(d, 1, 5), F.expr("substring(lpad(cast(c_custkey as string), 10, '9'), 6)"))).when(case == 3, N.digit_words(d)).otherwise(F.substring(d, 1, 9))
    compact = F.array_join(N.compact_ids(F.split(said, " ")), " ")
    phone = X.phone_canonical(compact)
    return t.customer.select("c_custkey", F.when(F.length(phone) == 10, phone).alias("phone"))


@query("tx_grounded", f"""
    with v as (select doc_id, {ALNUM.format('text')}[1:5] as value, {ALNUM.format('text')} as w from documents), b as (select item_id, {ALNUM.format('text')} as w from benchmark)
    select doc_id, round(len(list_filter(value, lambda x: list_contains(b.w, x))) / greatest(len(value), 1), 6) as recall, len(list_filter(value, lambda x: list_contains(b.w, x))) >= 0.6 * len(value) as grounded from v join b on b.item_id = doc_id""")
def grounded(t: Tables) -> DataFrame:
    """Whether enough tokens of a value stand in the text it should come from."""
    tokens = X.alnum_tokens(F.col("text"))
    v = t.documents.select("doc_id", F.slice(tokens, 1, 5).alias("value")).join(t.benchmark.select(F.col("item_id").alias("doc_id"), tokens.alias("w")), "doc_id")
    hits = F.size(F.filter("value", lambda x: F.array_contains("w", x)))
    return v.select("doc_id", F.round(hits / F.greatest(F.size("value"), F.lit(1)), 6).alias("recall"), (hits >= F.size("value") * 0.6).alias("grounded"))


@query("tx_spoken_id_span", """
    select event_id, 'id ' || case when event_id % 2 = 0 then 'ab ' else '' end || lpad(cast(event_id % 10000 as varchar), 4, '0') as span from events""")
def spoken_id_span(t: Tables) -> DataFrame:
    """The last run of exactly four digit words, with the letters left of it."""
    from ..functions import spoken as N

    four = N.digit_words(F.lpad((F.col("event_id") % 10_000).cast("string"), 4, "0"))
    said = F.concat(F.lit("two rooms for one two three and id "), F.when(F.col("event_id") % 2 == 0, "ab ").otherwise(""), four, F.lit(" please"))
    word = f"(?:{'|'.join(N.SMALL[:10])})"
    found = F.regexp_extract(said, rf"^.*\b(id (?:ab )?)({word}(?: {word}){{3}})(?! {word})", 1)
    run = F.regexp_extract(said, rf"^.*\b(id (?:ab )?)({word}(?: {word}){{3}})(?! {word})", 2)
    return t.events.select("event_id", F.concat(found, F.array_join(N.compact_ids(F.split(run, " ")), "")).alias("span"))


STOP = ("of", "the", "and", "small")


@query("tx_phrases_to_four", f"""
    with w as (select list_concat({ALNUM.format("p_name || ' ' || p_type || ' ' || p_brand")}, []) as w from part), n as (select w, unnest([1, 2, 3, 4]) as n from w), g as (select unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as phrase from n where len(w) >= n)
    select phrase, count(*) as n from g where split_part(phrase, ' ', 1) not in {STOP} and split_part(phrase, ' ', -1) not in {STOP} and not regexp_matches(phrase, '^[0-9 ]+$') group by 1""")
def phrases_to_four(t: Tables) -> DataFrame:
    """All phrases of up to four words but those that start or end with a stop word or are only numbers."""
    w = X.alnum_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    phrases = t.part.select(F.explode(F.concat(w, *[X.ngrams(w, n) for n in (2, 3, 4)])).alias("phrase"))
    p = F.col("phrase")
    good = ~F.substring_index(p, " ", 1).isin(*STOP) & ~F.substring_index(p, " ", -1).isin(*STOP) & ~p.rlike("^[0-9 ]+$")
    return phrases.where(good).groupBy("phrase").agg(count_n())


@query("tx_two_nearest_labelled", f"""
    with w as (select conv_id, turn, generate_subscripts(w, 1) as i, unnest(w) as word from (select conv_id, turn, {ALNUM.format('text')} as w from conversations)), l as (select *, case when word in ('die', 'der', 'und', 'les', 'la') then 1 when word in ('the', 'of', 'to', 'and', 'in') then -1 end as vote from w),
    p as (select *, row_number() over (partition by conv_id, turn order by i) as p from l where vote is not null), u as (select l.*, (select count(*) from p where p.conv_id = l.conv_id and p.turn = l.turn and p.i < l.i) as before from l where vote is null),
    v as (select u.conv_id, u.turn, u.i, sum(p.vote) as v from u left join p on p.conv_id = u.conv_id and p.turn = u.turn and p.p between u.before - 1 and u.before + 2 group by 1, 2, 3)
    select conv_id, turn, count(*) filter (where v > 0) as to_h, count(*) filter (where v < 0) as to_e from v group by 1, 2""")
def two_nearest_labelled(t: Tables) -> DataFrame:
    """Tokens without a label go with the two nearest labelled tokens on each side, however far they stand."""
    label = lambda x: F.when(x.isin("die", "der", "und", "les", "la"), "h").when(x.isin("the", "of", "to", "and", "in"), "e").otherwise(".")
    marks = t.conversations.select("conv_id", "turn", F.array_join(F.transform(X.alnum_tokens(F.col("text")), label), "").alias("marks")).where("contains(marks, '.')")
    # A row's labels in their order, and how many tokens without one stand before each and after the last; those between two labels have the same neighbours.
    gaps = marks.select("conv_id", "turn", F.translate("marks", ".", "").alias("labels"), F.transform(F.split("marks", "[he]", -1), F.length).alias("gaps"))
    near = lambda c: F.substring("labels", F.greatest(c - 1, F.lit(1)), F.when(c == 0, 2).when(c == 1, 3).otherwise(4))
    vote = lambda x: 2 * F.length(F.translate(x, "e", "")) - F.length(x)
    votes = gaps.select("conv_id", "turn", F.transform("gaps", lambda n, c: F.struct(n.alias("n"), vote(near(c)).alias("v"))).alias("g"))
    total = lambda way: F.aggregate(F.filter("g", way), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return votes.select("conv_id", "turn", total(lambda x: x["v"] > 0).alias("to_h"), total(lambda x: x["v"] < 0).alias("to_e"))


@query("tx_masked_spans", r"""
    select doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '[A-Z]', 'x', 'g')) as masked, length(text) = length(regexp_replace(text, '[0-9]', '#', 'g')) as same_length, cast(length(regexp_replace(text, '[^0-9]', '', 'g')) as bigint) as hidden from documents""")
def masked_spans(t: Tables) -> DataFrame:
    """Spans as blanks of the same length, so that places stay."""
    blank = F.regexp_replace("text", "[0-9]", "#")
    return t.documents.select("doc_id", F.md5(F.regexp_replace(blank, "[A-Z]", "x")).alias("masked"), (F.length("text") == F.length(blank)).alias("same_length"), F.length(F.regexp_replace("text", "[^0-9]", "")).cast("bigint").alias("hidden"))


@query("tx_noise", r"""
    with h as (select item_id, cast('0x' || substr(md5(cast(item_id as varchar)), 1, 4) as bigint) as h, regexp_split_to_array(text, '[ \n]+') as w from benchmark), d as (select item_id, h, list_filter(w, lambda x: lower(x) not in ('the', 'a', 'an')) as w from h)
    select item_id, md5(array_to_string(list_transform(w, lambda x, i: case when i = h % len(w) + 1 and not regexp_matches(x, '[0-9]') then x || right(x, 1) else x end), ' ')) as noisy from d where len(w) > 0""")
def noise(t: Tables) -> DataFrame:
    """Deterministic noise: articles dropped, and one word, by a hash of the key, misspelt if it has no digit."""
    h = F.conv(F.substring(F.md5(F.col("item_id").cast("string")), 1, 4), 16, 10).cast("bigint")
    rows = t.benchmark.select("item_id", h.alias("h"), F.filter(space_tokens(F.col("text")), lambda x: ~F.lower(x).isin("the", "a", "an")).alias("w")).where(F.size("w") > 0)
    hit = lambda x, i: (i == F.col("h") % F.size("w")) & ~x.rlike("[0-9]")
    return rows.select("item_id", F.md5(F.array_join(F.transform("w", lambda x, i: F.when(hit(x, i), F.concat(x, F.right(x, F.lit(1)))).otherwise(x)), " ")).alias("noisy"))


@query("tx_reference_phrase", """
    select o_orderkey, case o_orderkey % 5 when 0 then 'id' when 1 then 'name' when 2 then 'ordinal' when 3 then 'possessive' else 'default' end as rule, case o_orderkey % 5 when 0 then cast(o_orderkey as varchar) when 1 then 'urgent' when 2 then 'second order' when 3 then 'my order' else 'it' end as phrase from orders""")
def reference_phrase(t: Tables) -> DataFrame:
    """What a line names a record by, by the first rule that finds something: identifier, name, ordinal, possessive."""
    case, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    said = F.when(case == 0, F.concat(F.lit("cancel my order "), key)).when(case == 1, F.lit("cancel the second order, the urgent one")).when(case == 2, F.lit("cancel my second order")).when(case == 3, F.lit("cancel my order")).otherwise(F.lit("cancel it"))
    rows = t.orders.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("rule"), F.nullif(F.regexp_extract(said, p, 0), F.lit("")).alias("phrase")) for i, (n, p) in enumerate((("id", "[0-9]+"), ("name", "urgent|medium"), ("ordinal", "(?:first|second|last) order"), ("possessive", "my order"), ("default", "\\bit\\b")))])).alias("c"))
    return rows.where("c.phrase is not null").groupBy("o_orderkey").agg(F.min(F.struct("c.rank", "c.rule", "c.phrase")).alias("m")).select("o_orderkey", "m.rule", "m.phrase")


@query("tx_item_list", """
    select o_orderkey, string_agg(p_name, ',' order by l_linenumber, l_partkey, l_shipdate) as items, count(*) as n from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1""")
def item_list(t: Tables) -> DataFrame:
    """Items of a record written as one line, parsed again: split, up to the next field, without prices."""
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    entry = F.struct("l_linenumber", "l_partkey", "l_shipdate", F.concat("p_name", F.lit(" (Rs "), F.col("p_size").cast("string"), F.lit(")")).alias("item"))
    listed = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["item"]), ", ").alias("items"))
    record = F.concat(F.lit("Order: open. Items: "), F.col("items"), F.lit(". Address: 5 Elm Road, Rome."))
    body = F.regexp_extract(record, r"Items: (.*?)\. [A-Z][a-z]+:", 1)
    items = F.transform(F.split(body, ", "), lambda x: F.regexp_replace(x, r" \(Rs [0-9]+\)$", ""))
    return listed.join(t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.array_join(items, ",").alias("items"), F.size(items).cast("bigint").alias("n"))


@query("tx_id_candidates", """
    select o_orderkey, cast(o_orderkey as varchar) as id, 'Order ' as left_context, case when o_orderkey % 2 = 0 then ' is late' else ' is paid' end as right_context from orders""")
def id_candidates(t: Tables) -> DataFrame:
    """Identifiers with what stands beside them, up to the separators of the field."""
    text = F.concat(F.lit("Name: Bo; Order "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " is late").otherwise(" is paid"), F.lit("; City: Rome"))
    part = lambda i: F.regexp_extract(text, "(?:^|; )([^;:]*?)([0-9]+)([^;]*)", i)
    return t.orders.select("o_orderkey", part(2).alias("id"), part(1).alias("left_context"), part(3).alias("right_context"))


@query("tx_kind_candidates", """
    select c_custkey, case when c_custkey % 2 = 0 then 'gold plan' end as plan, right(lpad(cast(c_custkey as varchar), 16, '4'), 4) as card, lpad(cast(c_custkey as varchar), 10, '9') as phone, 2 as listed from customer""")
def kind_candidates(t: Tables) -> DataFrame:
    """Candidates of each kind in a record: plan, card by its last digits, phone, and the entries of a list."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Plan: gold plan. ").otherwise(""), F.lit("Card "), F.lpad(key, 16, "4"), F.lit(". Call "), F.lpad(key, 10, "9"), F.lit(". List: red bolt, old gear."))
    one = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return t.customer.select("c_custkey", one("(\\w+ plan)\\.").alias("plan"), one("Card [0-9]{12}([0-9]{4})").alias("card"), one("(?<![0-9])([0-9]{10})(?![0-9])").alias("phone"), F.size(F.split(one("List: ([^.]*)"), ", ")).alias("listed"))


@query("tx_best_split", """
    with c as (select item_id, string_split(regexp_extract(text, '^[^\\n]*', 0), ', ') as parts from benchmark), k as (select item_id, unnest(range(1, len(parts))) as k, parts from c), s as (select item_id, k, greatest(length(array_to_string(parts[1:k], ', ')), length(array_to_string(parts[k + 1:], ', '))) as longest from k)
    select item_id, min(longest) as longest, arg_min(k, longest * 1000 + k) as pieces_first from s group by 1""")
def best_split(t: Tables) -> DataFrame:
    """The cut of a line at a comma that makes the longer half shortest (of equal ones the first)."""
    parts = F.split(F.regexp_extract("text", "^[^\\n]*", 0), ", ")
    rows = t.benchmark.select("item_id", parts.alias("p")).where(F.size("p") > 1)
    half = lambda a, n: F.length(F.array_join(F.slice("p", a, n), ", "))
    cuts = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(F.greatest(half(F.lit(1), k), half(k + 1, F.size("p"))).cast("bigint").alias("longest"), k.cast("bigint").alias("pieces_first")))
    return rows.select("item_id", F.array_min(cuts).alias("c")).select("item_id", "c.longest", "c.pieces_first")


@query("tx_parallel_split", f"""
    with c as (select item_id, regexp_extract(text, '^[^\\n]*', 0) as a from benchmark), p as (select item_id, string_split(a, '. ') as x, string_split(translate(a, '{FOLD[0]}', '{FOLD[1]}'), '. ') as y from c)
    select item_id, len(x) as pieces, len(x) = len(y) as aligned, length(y[len(x)]) as last_length from p""")
def parallel_split(t: Tables) -> DataFrame:
    """The same cuts in a text and in its Latin form."""
    a = F.regexp_extract("text", "^[^\\n]*", 0)
    p = t.benchmark.select("item_id", F.split(a, "[.] ").alias("x"), F.split(F.translate(a, *FOLD), "[.] ").alias("y"))
    return p.select("item_id", F.size("x").cast("bigint").alias("pieces"), (F.size("x") == F.size("y")).alias("aligned"), F.length(F.try_element_at("y", F.size("x"))).cast("bigint").alias("last_length"))


@query("tx_syllables", f"""
    select conv_id, turn, len(regexp_extract_all(translate(lower(text), '{FOLD[0]}', '{FOLD[1]}'), '[aeiouy]+')) as syllables, len(regexp_extract_all(text, '[,;:]')) as short_pauses, len(regexp_extract_all(text, '[.!?]+')) as long_pauses from conversations""")
def syllables(t: Tables) -> DataFrame:
    """Syllables by groups of vowels, and pauses by marks."""
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("bigint")
    return t.conversations.select("conv_id", "turn", n(F.translate(F.lower("text"), *FOLD), "[aeiouy]+").alias("syllables"), n(F.col("text"), "[,;:]").alias("short_pauses"), n(F.col("text"), "[.!?]+").alias("long_pauses"))


@query("tx_clauses", r"""
    with c as (select conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '[.,;!?]+'), lambda x: trim(x) <> '')) as clause from conversations)
    select conv_id, count(*) as clauses, count(*) filter (where regexp_matches(trim(clause), '(ed|ing|en|er)$')) as verb_last from c group by 1""")
def clauses(t: Tables) -> DataFrame:
    """Clauses, and those that end like a verb."""
    c = t.conversations.select("conv_id", F.explode(F.filter(F.split(F.lower("text"), "[.,;!?]+"), lambda x: F.trim(x) != "")).alias("clause"))
    return c.groupBy("conv_id").agg(count_n().alias("clauses"), F.count_if(F.trim("clause").rlike("(ed|ing|en|er)$")).alias("verb_last"))


@query("tx_smallest_span", f"""
    with b as (select item_id, {ALNUM.format('text')} as w from benchmark), k as (select item_id, w, w[3] || w[4] || w[5] as value from b where len(w) >= 5), s as (select item_id, value, unnest(range(1, len(w) + 1)) as i, w from k), n as (select item_id, value, i, unnest([1, 2, 3, 4]) as n, w from s)
    select item_id, min(n) as tokens, arg_min(i, n * 100000 + i) as start from n where contains(array_to_string(w[i:i + n - 1], ''), value) group by 1""")
def smallest_span(t: Tables) -> DataFrame:
    """The smallest window of tokens whose letters hold a value; windows of each size are made array by array."""
    b = t.benchmark.select("item_id", X.alnum_tokens(F.col("text")).alias("w")).where(F.size("w") >= 5)
    k = b.select("item_id", "w", F.concat(F.element_at("w", 3), F.element_at("w", 4), F.element_at("w", 5)).alias("value"))
    def windows(n: int) -> Column:
        joined = F.transform(X.ngrams(F.col("w"), n) if n > 1 else F.col("w"), lambda x: F.replace(x, F.lit(" "), F.lit("")))
        return F.filter(F.transform(joined, lambda x, i: F.struct(F.lit(n).alias("tokens"), (i + 1).cast("bigint").alias("start"), x.contains(F.col("value")).alias("hit"))), lambda x: x["hit"])

    return k.select("item_id", F.array_min(F.concat(*[windows(n) for n in (1, 2, 3, 4)])).alias("m")).where("m is not null").select("item_id", "m.tokens", "m.start")


@query("tx_best_span_f1", f"""
    with d as (select doc_id, {ALNUM.format('text')} as w from documents), b as (select item_id, {ALNUM.format('text')}[1:4] as g from benchmark), k as (select doc_id, w, g from d join b on item_id = doc_id where len(w) >= 4), s as (select doc_id, g, unnest(range(1, len(w) - 2)) as i, w from k)
    select doc_id, max(round(2.0 * len(list_intersect(w[i:i + 3], g)) / (len(list_distinct(w[i:i + 3])) + len(list_distinct(g))), 6)) as f1 from s group by 1""")
def best_span_f1(t: Tables) -> DataFrame:
    """The best F1 of a window of four tokens against a gold span, as sets."""
    tokens = X.alnum_tokens(F.col("text"))
    k = t.documents.select("doc_id", tokens.alias("w")).join(t.benchmark.select(F.col("item_id").alias("doc_id"), F.slice(tokens, 1, 4).alias("g")), "doc_id").where(F.size("w") >= 4)
    window = lambda x: F.array_distinct(F.split(x, " "))
    f1 = F.transform(X.ngrams(F.col("w"), 4), lambda x: F.round(F.size(F.array_intersect(window(x), "g")) * 2.0 / (F.size(window(x)) + F.size(F.array_distinct("g"))), 6))
    return k.select("doc_id", F.array_max(f1).alias("f1"))


@query("tx_pool_draw", """
    with o as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i from orders), p as (select p_partkey, row_number() over (order by p_partkey) - 1 as j from part where p_partkey <= 40)
    select p_partkey, count(*) as used from o join p on i % 40 = j group by 1""")
def pool_draw(t: Tables) -> DataFrame:
    """Values of a pool dealt out in turn within each group, so none is used more often than its share."""
    i = F.row_number().over(W.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    pool = t.part.where("p_partkey <= 40").select("p_partkey", (F.row_number().over(W.orderBy("p_partkey")) - 1).alias("j"))  # at most 40 rows
    return t.orders.select((i % 40).alias("j")).groupBy("j").agg(count_n().alias("used")).join(F.broadcast(pool), "j").select("p_partkey", "used")


KEY = b"a shared secret".ljust(64, b"\0")
INNER, OUTER = bytes(x ^ 0x36 for x in KEY).hex(), bytes(x ^ 0x5C for x in KEY).hex()


@query("tx_signed_tokens", f"""
    with m as (select c_custkey, '{{"sub":' || c_custkey || ',"exp":' || (1700000000 + c_custkey * 60) || '}}' as body from customer), s as (select *, rtrim(translate(to_base64(encode(body)), '+/', '-_'), '=') as token, sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode(body)))) as mac from m)
    select c_custkey, token || '.' || mac as signed, 1700000000 + c_custkey * 60 > 1700003000 as fresh from s""")
def signed_tokens(t: Tables) -> DataFrame:
    """Tokens in base64url with an HMAC-SHA256 (two hashes with padded keys), verified, within their time."""
    body = F.concat(F.lit('{"sub":'), F.col("c_custkey").cast("string"), F.lit(',"exp":'), (F.lit(1700000000) + F.col("c_custkey") * 60).cast("string"), F.lit("}"))
    mac = lambda x: F.sha2(F.concat(F.unhex(F.lit(OUTER)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(INNER)), F.encode(x, "UTF-8")), 256))), 256)
    url = lambda x: F.rtrim(F.translate(F.base64(F.encode(x, "UTF-8")), "+/", "-_"), F.lit("="))
    minted = t.customer.select("c_custkey", F.concat(url(body), F.lit("."), mac(body)).alias("signed"))
    padded = lambda x: F.concat(F.translate(x, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4))))
    read = minted.withColumn("body", F.decode(F.unbase64(padded(F.substring_index("signed", ".", 1))), "UTF-8")).where(mac(F.col("body")) == F.substring_index("signed", ".", -1))
    return read.select("c_custkey", "signed", (F.get_json_object("body", "$.exp").cast("bigint") > 1700003000).alias("fresh"))
