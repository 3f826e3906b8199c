"""Queries on whole texts and whole pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cuts as K
from ..functions import distance as D
from ..functions import spans as P
from ..functions import text as X
from ..operators import windows as O
from ..sources.tables import written
from .registry import Tables, count_n, query
from .texts import with_noise

#: Most hashes of passages that are sent to each task; beyond it both sides are shuffled.
BROADCAST = 500_000
#: Edits of letters that are looked for in a band first.
BAND = 16


@query("ma_chunk_report")
def chunk_report(t: Tables) -> DataFrame:
    """Whole texts against their noisy form, chunk by chunk at the same cuts: the error rates of letters and words, and chunks whose sequence of numbers differs."""
    # Each text is beside its noisy form within its row.
    pairs = with_noise(t.conversations.where("conv_id is not null and turn is not null")).select("conv_id", "turn", F.split(F.trim("text"), "\\s+").alias("a"), F.split(F.trim("noisy"), "\\s+").alias("b"), K.cut_texts()("text", "noisy").alias("c"))
    ends = lambda cuts, words: F.concat(F.array(F.lit(0)), cuts, F.array(F.size(words)))
    both = F.arrays_zip(ends(F.col("c.cuts"), F.col("a")).alias("x"), ends(F.col("c.parallel"), F.col("b")).alias("y"))
    bounds = pairs.select("conv_id", "turn", "a", "b", both.alias("e")).select("conv_id", "turn", "a", "b", "e", F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("i"))
    part = lambda words, side: F.array_join(F.slice(words, F.get("e", F.col("i") - 1)[side] + 1, F.get("e", F.col("i"))[side] - F.get("e", F.col("i") - 1)[side]), " ")
    chunks = bounds.select("conv_id", "turn", part("a", "x").alias("gold"), part("b", "y").alias("heard"))
    letters = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    # Few edits are found in a narrow band; only more of them (-1) need all places.
    edits = lambda a, b: F.when(F.levenshtein(a, b, BAND) >= 0, F.levenshtein(a, b, BAND)).otherwise(F.levenshtein(a, b))
    scored = chunks.select("conv_id", "turn", edits(letters("gold"), letters("heard")).alias("edits"), F.length(letters("gold")).alias("letters"), D.word_distance("heard", "gold").alias("word_edits"), F.size(F.split("gold", " ")).alias("words"), (numbers("gold") != numbers("heard")).alias("other_numbers"))
    rate = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 6)
    return scored.groupBy("conv_id", "turn").agg(count_n().alias("chunks"), rate("edits", "letters").alias("cer"), rate("word_edits", "words").alias("wer"), F.count_if("other_numbers").alias("other_numbers"))


@query("tx_passage_spans")
def passage_spans(t: Tables) -> DataFrame:
    """Documents that share eight words in a row with a passage, and the span of the whole document that is most like the whole passage."""
    tokens = lambda df, key: df.select(key, X.alnum_tokens(F.col("text")).alias("w"))
    # An array of one row binds the words, which would else be made again for each place.
    runs = lambda w: F.when(F.size(w) >= 8, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 7, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(8)))))
    keys = lambda df, key: df.select(key, F.explode(F.get(F.transform(F.array(X.alnum_tokens(F.col("text"))), runs), F.lit(0))).alias("g"))
    items = tokens(t.benchmark, "item_id")
    passages = written(keys(t.benchmark, "item_id").distinct())
    if passages.limit(BROADCAST + 1).count() <= BROADCAST:
        passages = F.broadcast(passages)
    pairs = keys(t.documents, "doc_id").join(passages, "g").select("doc_id", "item_id").distinct()
    # Stored, so that only the texts of pairs are split again.
    texts = written(t.documents.select("doc_id", "text").join(pairs, "doc_id"))
    both = texts.select("doc_id", "item_id", X.alnum_tokens(F.col("text")).alias("w")).join(items.withColumnRenamed("w", "gold"), "item_id")
    # Hashes only choose the pairs.
    shared = both.where(F.arrays_overlap(X.ngrams(F.col("w"), 8), X.ngrams(F.col("gold"), 8)))
    found = shared.select("doc_id", "item_id", P.best_spans("w", "gold").alias("s"))
    return found.select("doc_id", "item_id", F.round("s.f1", 6).alias("f1"), "s.start", "s.stop")


@query("tx_deck_draws", """
    with l as (select l_orderkey, l_linenumber, l_partkey, p_brand, l_shipdate < timestamp '1996-06-01' as early from lineitem join part on p_partkey = l_partkey), used as (select p_partkey as value, part.p_brand, count(l_partkey) as n from part left join l on l_partkey = p_partkey and early group by 1, 2),
    slots as (select p_brand, value, row_number() over (partition by p_brand order by level, value) as rank from (select p_brand, value, unnest(range(n, 12)) as level from used where n < 12)),
    draws as (select l_orderkey, l_linenumber, p_brand, row_number() over (partition by p_brand order by l_orderkey, l_linenumber) as rank from l where not early)
    select l_orderkey, l_linenumber, d.p_brand, value from draws d left join slots s on s.p_brand = d.p_brand and s.rank = d.rank""")
def deck_draws(t: Tables) -> DataFrame:
    """Each draw takes the least used value of its pool, up to twelve uses each, counting what was used before; the k-th draw takes the k-th slot, by level and value, so no draw waits for another."""
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    early = F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp_ntz")
    used = lines.where(early).groupBy(F.col("l_partkey").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    pool = t.part.select(F.col("p_partkey").alias("value"), "p_brand").join(used, "value", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < 12")
    slots = pool.select("p_brand", "value", F.explode(F.sequence(F.col("n").cast("int"), F.lit(11))).alias("level"))
    draws = lines.where(~early).select("l_orderkey", "l_linenumber", "p_brand")
    ranked = O.rank_in_bins(draws, ["p_brand"], F.floor(F.col("l_orderkey") / 4096), ["l_orderkey", "l_linenumber"])
    return ranked.join(O.rank_in_bins(slots, ["p_brand"], F.col("level"), ["value"]), ["p_brand", "rank"], "left").select("l_orderkey", "l_linenumber", "p_brand", "value")
