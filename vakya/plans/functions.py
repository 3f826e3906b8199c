"""Queries on functions that Spark has no expression for; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import numbers as NU
from ..functions import script as SC
from ..functions import text as X
from .registry import Tables, query


def neighbours(t: Tables) -> DataFrame:
    """Turns beside the turn before, as plain tokens."""
    text = F.array_join(X.alnum_tokens(X.ascii_fold(F.col("text"))), " ")
    return t.conversations.select("conv_id", "turn", text.alias("ref"), F.lag(text).over(W.partitionBy("conv_id").orderBy("turn")).alias("hyp")).where("hyp is not null")


@query("ma_word_edits")
def word_edits(t: Tables) -> DataFrame:
    """Distance, substitutions, deletions and insertions between the turns of a conversation."""
    found = neighbours(t).withColumn("e", D.word_edits("hyp", "ref"))
    return found.select("conv_id", "turn", "e.*")


@query("ma_corpus_wer")
def corpus_wer(t: Tables) -> DataFrame:
    """Edits over words of the reference, in overlapping groups: all, and by parity of the turn."""
    found = neighbours(t).withColumn("d", D.word_edits("hyp", "ref")["distance"]).withColumn("n", F.size(F.split("ref", " ")))
    keyed = found.select("d", "n", F.explode(F.array(F.lit("all"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd"))).alias("part"))
    return keyed.groupBy("part").agg(F.sum("d").alias("edits"), F.sum("n").alias("words"), F.round(F.try_divide(F.sum("d"), F.sum("n")), 6).alias("wer"))


@query("ma_matching_ratio")
def matching_ratio(t: Tables) -> DataFrame:
    """Similarity of names of parts of one brand that share a word: candidates by an equality on words, never all pairs."""
    w = t.part.select("p_brand", "p_type", "p_name").distinct()
    words = w.select("p_brand", "p_type", "p_name", F.explode(F.split("p_name", " ")).alias("word"))
    other = words.select("p_brand", "p_type", F.col("p_name").alias("other"), "word")
    pairs = words.join(other, ["p_brand", "p_type", "word"]).where("p_name < other").select("p_name", "other").distinct()
    return pairs.withColumn("ratio", F.round(D.matching_ratio("p_name", "other"), 6)).where("ratio >= 0.5")


@query("num_spoken")
def spoken(t: Tables) -> DataFrame:
    """The key of each event said digit by digit and as a number, back as digits."""
    say = F.transform(F.split(F.get_json_object("props", "$.k"), ""), lambda d: F.element_at(F.array(*map(F.lit, X.NUMBER_WORDS)), d.cast("int") + 1))
    said = t.events.select("event_id", F.concat(F.lit("code "), F.array_join(say, " "), F.lit(" double "), F.element_at(say, 1), F.lit(" ok")).alias("said"))
    return said.select("event_id", "said", NU.spoken_to_digits("said").alias("written"))


@query("num_extracted")
def extracted(t: Tables) -> DataFrame:
    """Numbers of documents, grouped and spaced ones as one."""
    rows = t.documents.where(F.col("text").rlike("[0-9]")).select("doc_id", F.explode(NU.extract_numbers("text")).alias("number"))
    return rows.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n"))


@query("sc_romanised")
def romanised(t: Tables) -> DataFrame:
    """Text in Latin letters and a key for comparing spellings; text without Devanagari stays as it is."""
    return t.conversations.select("conv_id", "turn", F.md5(SC.romanise(F.col("text"))).alias("roman"), F.md5(SC.normal_key("text")).alias("key"))


@query("sc_inherent_vowels")
def inherent_vowels(t: Tables) -> DataFrame:
    """Whole texts, written in Devanagari letter by letter and read again as they are written, shortened, and spoken: the inherent vowel falls at the end of words and between syllables."""
    deva = SC.in_devanagari(F.lower("text"))
    return t.conversations.select("conv_id", "turn", *[F.md5(SC.romanise(deva, p)).alias(p) for p in ("plain", "short", "spoken")])
