"""Queries on spellings: lexicons mined from parallel text, normal forms, and comparisons of typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import script as SC
from ..functions import text as X
from .registry import Tables, count_n, query
from .texts import ALNUM, FOLD

FOLDED = f"translate({{0}}, '{FOLD[0]}', '{FOLD[1]}')"
#: The second spelling of the parallel text, used in odd turns.
LONG = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"))
SQL_LONG = "replace(replace(replace({0}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"
SPACES = "[ \\n]+"


def parallel_words(t: Tables) -> DataFrame:
    """(conv_id, source, target): words beside their Latin spelling, aligned by position; odd turns spell umlauts long."""
    c = F.lower("text")
    long_ = c
    for a, b in LONG:
        long_ = F.replace(long_, F.lit(a), F.lit(b))
    target = F.translate(F.when(F.col("turn") % 2 == 1, long_).otherwise(c), *FOLD)
    pairs = F.arrays_zip(F.split(c, SPACES).alias("source"), F.split(target, SPACES).alias("target"))
    return t.conversations.select("conv_id", F.explode(pairs).alias("p")).select("conv_id", "p.source", "p.target").where(F.col("source").rlike("[^\\x00-\\x7F]"))


SQL_PARALLEL = f"""p as (select conv_id, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) as source, unnest(regexp_split_to_array({FOLDED.format("case when turn % 2 = 1 then " + SQL_LONG.format("lower(text)") + " else lower(text) end")}, '[ \\n]+')) as target from conversations),
    a as (select * from p where regexp_matches(source, '[^\\x00-\\x7F]'))"""
SQL_MINED = "c as (select source, target, count(*) as n from a where conv_id % 5 <> 0 group by 1, 2), m as (select source, target, n from c qualify row_number() over (partition by source order by n desc, target) = 1)"


def mined(words: DataFrame) -> DataFrame:
    """(source, target, n): the most frequent spelling of each word; of equal ones the first in the alphabet."""
    counted = words.groupBy("source", "target").agg(count_n())
    return counted.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("k"), "target")).alias("top")).select("source", "top.target", (-F.col("top.k")).alias("n"))


@query("sc_lexicon_mined", f"with {SQL_PARALLEL}, {SQL_MINED} select * from m")
def lexicon_mined(t: Tables) -> DataFrame:
    """A lexicon from four fifths of the conversations."""
    return mined(parallel_words(t).where("conv_id % 5 <> 0"))


@query("sc_lexicon_romanised", f"""
    with {SQL_PARALLEL}, {SQL_MINED}, k as (select {FOLDED.format('source')} as key, min(target) as target from m group by 1)
    select a.conv_id, count(*) as n, count(m.target) as by_lexicon, count(*) filter (where m.target is null and k.target is not null) as by_key, count(*) filter (where m.target is null and k.target is null) as by_rule, count(*) filter (where coalesce(m.target, k.target, {FOLDED.format('a.source')}) = a.target) as exact
    from a left join m on a.source = m.source left join k on {FOLDED.format('a.source')} = k.key group by 1""")
def lexicon_romanised(t: Tables) -> DataFrame:
    """Words by the lexicon, else by a key without marks, else by rule, with counts of each way."""
    lexicon = mined(parallel_words(t).where("conv_id % 5 <> 0")).select("source", F.col("target").alias("found"))
    keys = lexicon.groupBy(F.translate("source", *FOLD).alias("key")).agg(F.min("found").alias("near"))
    words = parallel_words(t).withColumn("key", F.translate("source", *FOLD))
    wide = words.join(lexicon, "source", "left").join(keys, "key", "left")
    no_lex, no_key = F.col("found").isNull(), F.col("near").isNull()
    return wide.groupBy("conv_id").agg(
        count_n(), F.count("found").alias("by_lexicon"), F.count_if(no_lex & ~no_key).alias("by_key"), F.count_if(no_lex & no_key).alias("by_rule"), F.count_if(F.coalesce("found", "near", "key") == F.col("target")).alias("exact")
    )


@query("sc_held_out", f"""
    with {SQL_PARALLEL}, {SQL_MINED} select count(*) as n, count(m.target) as known, count(*) filter (where m.target = a.target) as exact, count(*) filter (where {FOLDED.format('a.source')} = a.target) as by_rule from a left join m on a.source = m.source where conv_id % 5 = 0""")
def held_out(t: Tables) -> DataFrame:
    """Exact matches on the fifth of the conversations that the lexicon has not seen."""
    lexicon = mined(parallel_words(t).where("conv_id % 5 <> 0")).select("source", F.col("target").alias("found"))
    wide = parallel_words(t).where("conv_id % 5 = 0").join(lexicon, "source", "left")
    return wide.agg(count_n(), F.count("found").alias("known"), F.count_if(F.col("found") == F.col("target")).alias("exact"), F.count_if(F.translate("source", *FOLD) == F.col("target")).alias("by_rule"))


@query("sc_latin_folded", f"""
    select conv_id, turn, md5(regexp_replace(translate(regexp_replace({FOLDED.format('lower(text)')}, '([b-df-hj-np-tv-z])h', '\\1', 'g'), 'wzq', 'vjk'), 'a+|e+|i+|o+|u+', 'a', 'g')) as folded from conversations""")
def latin_folded(t: Tables) -> DataFrame:
    """Aspiration and the length of vowels folded, for comparing Latin spellings."""
    plain = F.regexp_replace(F.translate(F.lower("text"), *FOLD), "([b-df-hj-np-tv-z])h", "$1")
    return t.conversations.select("conv_id", "turn", F.md5(F.regexp_replace(F.translate(plain, "wzq", "vjk"), "a+|e+|i+|o+|u+", "a")).alias("folded"))


@query("sc_normal_forms", f"""
    select conv_id, turn, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as raw, md5(regexp_replace({FOLDED.format('lower(text)')}, '[^a-z0-9]', '', 'g')) as joined, md5(trim(regexp_replace({FOLDED.format('lower(text)')}, '[^a-z0-9]+', ' ', 'g'))) as scored from conversations""")
def normal_forms(t: Tables) -> DataFrame:
    """Three normal forms for comparing: plain letters, folded and joined, folded words."""
    low = F.lower("text")
    folded = F.translate(low, *FOLD)
    return t.conversations.select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))).alias("raw"), F.md5(F.regexp_replace(folded, "[^a-z0-9]", "")).alias("joined"), F.md5(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))).alias("scored"))


@query("sc_spelled_joined", f"""
    with w as (select doc_id, list_filter(string_split(regexp_replace({FOLDED.format('lower(text)')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
    p as (select doc_id, unnest(w) as x, unnest(range(len(w))) as i, unnest(list_concat([''], w)[1:len(w)]) as b from w), g as (select *, sum(case when i > 0 and length(x) = 1 and length(b) = 1 then 0 else 1 end) over (partition by doc_id order by i) as word from p), j as (select doc_id, word, string_agg(x, '' order by i) as x from g group by 1, 2)
    select doc_id, count(*) as words, count(*) filter (where length(x) > 1) as longer, md5(string_agg(x, ' ' order by word)) as joined from j group by 1""")
def spelled_joined(t: Tables) -> DataFrame:
    """The normal form that joins letters said one by one, of whole documents: its words, those of two characters on, and its digest."""
    joined = X.spelled_joined(F.translate(F.lower("text"), *FOLD))
    words = F.split("joined", " ")
    rows = t.documents.select("doc_id", joined.alias("joined")).where("joined <> ''")
    return rows.select("doc_id", F.size(words).cast("bigint").alias("words"), F.size(F.filter(words, lambda w: F.length(w) > 1)).cast("bigint").alias("longer"), F.md5("joined").alias("joined"))


@query("sc_cleaned", r"""
    select conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), '[ \n]+', ' ', 'g'))) as clean from conversations""")
def cleaned(t: Tables) -> DataFrame:
    """Transcripts without notes in brackets, spaces before marks, and runs of space."""
    x = F.regexp_replace(F.regexp_replace("text", r"\([^)]*\)|\[[^\]]*\]", " "), " (?=[,.;:!?])", "")
    return t.conversations.select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(x, "[ \\n]+", " "))).alias("clean"))


@query("sc_mark_sufficiency", f"""
    with {SQL_PARALLEL}, {SQL_MINED}, w as (select conv_id, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) as word from conversations), x as (select {FOLDED.format('source')} as key from m group by 1)
    select w.conv_id, count(x.key) as needed, cast(sum(length(regexp_replace(word, '[\\x00-\\x7F]', '', 'g'))) as bigint) as marks, sum(length(regexp_replace(word, '[\\x00-\\x7F]', '', 'g'))) >= count(x.key) as enough from w left join x on {FOLDED.format('w.word')} = x.key group by 1""")
def mark_sufficiency(t: Tables) -> DataFrame:
    """Whether a conversation has at least as many marked letters as words that the lexicon spells with one."""
    need = mined(parallel_words(t).where("conv_id % 5 <> 0")).select(F.translate("source", *FOLD).alias("key")).distinct()
    words = t.conversations.select("conv_id", F.explode(F.split(F.lower("text"), SPACES)).alias("word")).withColumn("plain", F.translate("word", *FOLD))
    marks = F.sum(F.length(F.regexp_replace("word", "[\\x00-\\x7F]", ""))).cast("bigint")
    return words.join(need, words.plain == need.key, "left").groupBy("conv_id").agg(F.count("key").alias("needed"), marks.alias("marks"), (marks >= F.count("key")).alias("enough"))


def beside(t: Tables, x: Column) -> DataFrame:
    """(conv_id, turn, a, b): ``x`` of a turn and of the turn before."""
    return t.conversations.select("conv_id", "turn", x.alias("a"), F.lag(x).over(W.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")


PLAIN = f"regexp_replace({FOLDED.format('lower(text)')}, '[^a-z]', '', 'g')"


@query("ma_best_cer", f"""
    with p as (select conv_id, turn, {PLAIN} as a, lag({PLAIN}) over (partition by conv_id order by turn) as b from conversations), c as (select *, regexp_replace(a, '[aeiou]', '', 'g') as a2, regexp_replace(b, '[aeiou]', '', 'g') as b2 from p where b is not null)
    select conv_id, turn, round(least(case when a = '' then 1.0 else levenshtein(a, b) / length(a) end, case when a2 = '' then 1.0 else levenshtein(a2, b2) / length(a2) end), 6) as cer from c""")
def best_cer(t: Tables) -> DataFrame:
    """The less of the error rates in two forms of writing: letters, and consonants only."""
    rows = beside(t, F.regexp_replace(F.translate(F.lower("text"), *FOLD), "[^a-z]", ""))
    rate = lambda a, b: F.when(a == "", 1.0).otherwise(F.try_divide(F.levenshtein(a, b), F.length(a)))
    thin = lambda c: F.regexp_replace(c, "[aeiou]", "")
    return rows.select("conv_id", "turn", F.round(F.least(rate(F.col("a"), F.col("b")), rate(thin("a"), thin("b"))), 6).alias("cer"))


@query("ma_template_similarity", """
    with n as (select p_brand, p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type || ' ' || cast(p_size as varchar)), '[0-9]+', '0', 'g'), 'small|large|medium', 'size', 'g') as f from part), l as (select *, lag(f) over (partition by p_brand order by p_partkey) as g from n)
    select p_partkey, round(1 - levenshtein(f, g) / greatest(length(f), length(g)), 6) as similarity, levenshtein(f, g) * 5 <= greatest(length(f), length(g)) as same_template from l where g is not null""")
def template_similarity(t: Tables) -> DataFrame:
    """Neighbouring lines after normalisation: numbers and sizes as placeholders."""
    form = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))), "[0-9]+", "0"), "small|large|medium", "size")
    rows = t.part.select("p_partkey", form.alias("f"), F.lag(form).over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("g")).where("g is not null")
    d, n = F.levenshtein("f", "g"), F.greatest(F.length("f"), F.length("g"))
    return rows.select("p_partkey", F.round(1 - F.try_divide(d, n), 6).alias("similarity"), (d * 5 <= n).alias("same_template"))


@query("ma_typed", """
    with v as (select c_custkey, c_custkey % 4 as kind, lower(c_name) as name, lpad(cast(c_custkey as varchar), 10, '9') as phone from customer)
    select c_custkey, case kind when 0 then 'phone' when 1 then 'email' when 2 then 'words' else 'id' end as kind, case kind when 0 then true when 1 then c_custkey % 8 = 1 when 2 then c_custkey % 8 = 2 else c_custkey % 8 = 3 end as equal from v""")
def typed(t: Tables) -> DataFrame:
    """Values compared by their kind: any phone among candidates by ten digits, mails in normal form, words by an overlap of 0.6, others as they are."""
    key, low = F.col("c_custkey"), F.lower("c_name")
    kind = F.element_at(F.array(*map(F.lit, ("phone", "email", "words", "id"))), (key % 4 + 1).cast("int"))
    phone = F.lpad(key.cast("string"), 10, "9")
    mail = F.concat(F.replace(low, F.lit("#"), F.lit(".")), F.lit("@example.org"))
    odd = key % 8 >= 4
    gold = F.when(kind == "phone", phone).when(kind == "email", mail).when(kind == "words", F.concat_ws(" ", low, F.lit("green door left"))).otherwise(low)
    said = F.when(kind == "phone", F.concat(F.lit("0123456789 or +91 "), F.substring(phone, 1, 5), F.lit("-"), F.expr("substring(lpad(cast(c_custkey as string), 10, '9'), 6)")))
    said = said.when(kind == "email", F.replace(F.when(odd, F.concat(F.lit("x"), mail)).otherwise(mail), F.lit("@"), F.lit(" at "))).when(kind == "words", F.when(odd, F.lit("a green house")).otherwise(F.concat(F.lit("left green "), low))).otherwise(F.when(odd, F.concat(low, F.lit("0"))).otherwise(low))
    rows = t.customer.select("c_custkey", kind.alias("kind"), gold.alias("gold"), said.alias("said"))
    candidates = F.transform(F.split("said", " or "), X.phone_canonical)
    share = X.overlap_share(F.split("gold", " "), F.split("said", " "))
    equal = F.when(F.col("kind") == "phone", F.array_contains(candidates, X.phone_canonical(F.col("gold")))).when(F.col("kind") == "email", X.email_normal(F.col("said")) == F.col("gold")).when(F.col("kind") == "words", share >= 0.6).otherwise(F.col("said") == F.col("gold"))
    return rows.select("c_custkey", "kind", equal.alias("equal"))


@query("ma_chunk_scores", f"""
    with p as (select item_id, {PLAIN} as a, regexp_extract_all(text, '[0-9]+') as m from benchmark), d as (select doc_id as item_id, {PLAIN} as b, regexp_extract_all(text, '[0-9]+') as n from documents)
    select item_id, levenshtein(a[1:200], b[1:200]) as edits, m = n as same_numbers from p join d using (item_id)""")
def chunk_scores(t: Tables) -> DataFrame:
    """Chunks of 200 letters of two texts of one key: edits, and whether their sequences of numbers agree."""
    letters = F.regexp_replace(F.translate(F.lower("text"), *FOLD), "[^a-z]", "")
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    a = t.benchmark.select("item_id", letters.alias("a"), numbers.alias("m"))
    b = t.documents.select(F.col("doc_id").alias("item_id"), letters.alias("b"), numbers.alias("n"))
    edits = F.levenshtein(F.substring("a", 1, 200), F.substring("b", 1, 200))
    return a.join(b, "item_id").select("item_id", edits.cast("bigint").alias("edits"), (F.col("m") == F.col("n")).alias("same_numbers"))


@query("ma_map_verified", "select conv_id, turn, true as equal, cast(length(text) as bigint) as units, cast(length(regexp_replace(text, '[^ \\n]', '', 'g')) as bigint) as gaps from conversations where length(text) > 0")
def map_verified(t: Tables) -> DataFrame:
    """A map of units with operations, put together again: it must give the text, and its counts must agree."""
    units = F.filter(F.split("text", ""), lambda x: x != "")
    mapped = F.transform(units, lambda x: F.struct(x.alias("unit"), F.when(x.rlike("^[ \\n]$"), "gap").otherwise("keep").alias("op")))
    listed = t.conversations.where(F.length("text") > 0).select("conv_id", "turn", "text", mapped.alias("u"))
    # The map is of one row, so nothing is dealt out by row and put together again.
    count = lambda c: F.size(c).cast("bigint")
    return listed.select("conv_id", "turn", (F.array_join("u.unit", "") == F.col("text")).alias("equal"), count("u").alias("units"), count(F.filter("u.op", lambda x: x == "gap")).alias("gaps"))


@query("ag_edit_shares")
def edit_shares(t: Tables) -> DataFrame:
    """Shares of substitutions, deletions and insertions over all pairs of neighbouring turns, by role."""
    words = F.array_join(X.alnum_tokens(X.ascii_fold(F.col("text"))), " ")
    rows = t.conversations.select("role", words.alias("ref"), F.lag(words).over(W.partitionBy("conv_id").orderBy("turn")).alias("hyp")).where("hyp is not null")
    s = rows.withColumn("e", D.word_edits("hyp", "ref")).groupBy("role").agg(F.sum("e.substituted").alias("s"), F.sum("e.deleted").alias("d"), F.sum("e.inserted").alias("i"))
    total = F.col("s") + F.col("d") + F.col("i")
    return s.select("role", "s", "d", "i", *[F.round(F.try_divide(F.col(x), total), 6).alias(f"{x}_share") for x in "sdi"])


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays: a fold over one, with the row of the table for the other."""
    places = F.sequence(F.lit(1), F.size(b))

    def row(above: Column, x: Column) -> Column:
        first = F.array(F.lit(0))
        return F.aggregate(places, first, lambda done, j: F.array_append(done, F.when(x == F.element_at(b, j), F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(done, j)))))

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)


@query("ma_sound_alignment", """
    with n as (select distinct p_name as name from part) select name, length(name) - case when length(name) % 2 = 0 then 1 else 0 end as matched, 0 as only_deva, case when length(name) % 2 = 0 then 1 else 0 end as only_latin from n""")
def sound_alignment(t: Tables) -> DataFrame:
    """Units of sound of a name in two scripts, aligned in order: how many match, and what either side has alone.

    Every second name lacks its last letter in Devanagari. Units are compared by the Latin letters that they stand for.
    """
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    heard = F.when(F.length("name") % 2 == 0, F.regexp_replace("name", ".$", "")).otherwise(F.col("name"))
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    rows = names.select("name", letters(SC.in_latin(SC.in_devanagari(heard))).alias("a"), letters("name").alias("b"))
    matched = rows.select("name", "a", "b", common_length(F.col("a"), F.col("b")).alias("matched"))
    return matched.select("name", F.col("matched").cast("bigint"), (F.size("a") - F.col("matched")).cast("int").alias("only_deva"), (F.size("b") - F.col("matched")).cast("int").alias("only_latin"))
