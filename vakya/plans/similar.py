"""Queries on texts that are alike by the matching ratio; SQL has no such ratio, so tests hold them against all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import similar as S
from .registry import Tables, query


def plain_title() -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9 ]", ""))


@query("jn_similar_titles")
def similar_titles(t: Tables) -> DataFrame:
    """Distinct titles that are alike by 85 percent."""
    return S.similar_texts(t.part.select(plain_title().alias("text")), percent=85).select("text", "other", F.round("ratio", 6).alias("ratio"))


@query("val_title_review")
def title_review(t: Tables) -> DataFrame:
    """Issues of each title: its length, banned words, another row with the same title, and the first title that is alike."""
    rows = t.part.select("p_partkey", plain_title().alias("title"), F.size(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("words"))
    pairs = S.similar_texts(rows.select(F.col("title").alias("text")), percent=85)
    both = pairs.select("text", "other").unionByName(pairs.select(F.col("other").alias("text"), F.col("text").alias("other")))
    alike = both.groupBy(F.col("text").alias("title")).agg(F.min("other").alias("other"))
    same = rows.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    issues = F.concat_ws("; ", F.when(~F.col("words").between(3, 4), "length"), F.when(F.col("title").rlike("bolt|old"), "banned"), F.when(F.col("n") > 1, "same title"), F.when(F.col("other").isNotNull(), F.concat(F.lit("close to "), "other")))
    return rows.join(same, "title").join(alike, "title", "left").select("p_partkey", issues.alias("issues"))


@query("tx_similar_words")
def similar_words(t: Tables) -> DataFrame:
    """Words of documents that are no known word, with the known word they are most like, from 80 percent."""
    of = lambda c, p: F.explode(F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0)))
    known = t.part.select(of("p_name", "[a-z]+").alias("text")).distinct()
    words = t.documents.select(of("text", "[a-z]{3,}").alias("text")).distinct().join(known, "text", "left_anti")
    found = S.similar_texts(words, known, 80)
    best = found.groupBy("text").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "other")).alias("m"))
    return best.select(F.col("text").alias("word"), F.col("m.other").alias("known"), F.round(-F.col("m.r"), 6).alias("ratio"))


@query("ma_nearest_template")
def nearest_template(t: Tables) -> DataFrame:
    """Lines with their values as placeholders, and the template that each is most like, from 80 percent; an equal one counts as 1."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9' ]", ""))
    lines = t.part.select(clean(F.regexp_replace(F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string")), "[0-9]+", "0")).alias("text")).distinct()
    templates = t.part.where(F.col("p_partkey") % 10 == 0).select(clean(F.concat(F.lit("brand0 "), "p_name", F.lit(" 0"))).alias("text")).distinct()
    equal = lines.join(templates, "text").select("text", F.col("text").alias("other"), F.lit(1.0).alias("ratio"))
    found = S.similar_texts(lines, templates, 80).unionByName(equal)
    best = found.groupBy("text").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "other")).alias("m"))
    return best.select("text", F.col("m.other").alias("template"), F.round(-F.col("m.r"), 6).alias("ratio"))
