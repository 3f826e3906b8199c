"""Queries on hashing, splits, quotas and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hashing as H
from ..operators import sampling as S
from .registry import Tables, query


def sql_h01(x: str) -> str:
    return f"(cast('0x' || substr(sha256({x}), 1, 12) as bigint) / 281474976710656.0)"


HC = sql_h01("cast(conv_id as varchar)")
HD = sql_h01("cast(doc_id as varchar)")


@query("prj_hash_keys", f"""
    with c as (select distinct conv_id from conversations)
    select conv_id, round({HC}, 9) as h, cast('0x' || substr(md5(cast(conv_id as varchar)), 1, 8) as bigint) as seed,
           case when {HC} < 0.4 then 'short' when {HC} < 0.8 then 'medium' else 'long' end as band,
           cast(floor({HC} * 7) as int) as template, round(0.8 + 0.7 * {HC}, 6) as gap,
           case when {HC} < 0.5 then 'a' when {HC} < 0.75 then 'b' else 'c' end as pick
    from c""")
def hash_keys(t: Tables) -> DataFrame:
    h = H.h01(F.col("conv_id"))
    return t.conversations.select("conv_id").distinct().select(
        "conv_id", F.round(h, 9).alias("h"), H.seed_of(F.col("conv_id")).alias("seed"), H.band(h, [(0.4, "short"), (0.8, "medium")], "long").alias("band"),
        H.bucket(h, 7).alias("template"), F.round(H.jitter(h, 0.8, 0.7), 6).alias("gap"), H.weighted(h, [("a", 2), ("b", 1), ("c", 1)]).alias("pick"),
    )


@query("prj_exact_quota", f"""
    select doc_id from documents qualify row_number() over (order by {HD}, doc_id) <= round(0.3 * count(*) over ())""")
def exact_quota(t: Tables) -> DataFrame:
    return S.hash_quota(t.documents.select("doc_id"), H.h01(F.col("doc_id")), 0.3, "doc_id")


@query("prj_quota_filtered_pool", f"""
    with n as (select round(0.2 * count(*)) as q from documents)
    select doc_id from (select doc_id, row_number() over (order by {HD}, doc_id) as rn from documents where n_chars > 1000), n where rn <= q""")
def quota_filtered_pool(t: Tables) -> DataFrame:
    """The pool is filtered, the quota is of all."""
    pool = t.documents.where("n_chars > 1000").select("doc_id")
    sizes = t.documents.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n_chars") > 1000).alias("pool")).first()
    share = float(round(0.2 * sizes["all"])) / max(1, sizes["pool"])
    return S.hash_quota(pool, H.h01(F.col("doc_id")), min(1.0, share), "doc_id")


@query("prj_key_parse", """
    select c_custkey, split_part(c_name, '#', 1) as kind, cast(split_part(c_name, '#', 2) as bigint) as number,
           regexp_extract(c_name, '^(.*)#', 1) as stem from customer""")
def key_parse(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.substring_index("c_name", "#", 1).alias("kind"), F.substring_index("c_name", "#", -1).cast("bigint").alias("number"), F.regexp_extract("c_name", "^(.*)#", 1).alias("stem"))


@query("prj_split_label", f"""
    with c as (select distinct conv_id, {HC} as h from conversations), test as (select conv_id from c where h < 0.1), val as (select conv_id from c where h >= 0.05 and h < 0.2)
    select conv_id, case when conv_id in (select conv_id from test) then 'test' when conv_id in (select conv_id from val) then 'val' else 'train' end as split from c""")
def split_label(t: Tables) -> DataFrame:
    """Membership in the order test, val, train."""
    ids = t.conversations.select("conv_id").distinct().withColumn("h", H.h01(F.col("conv_id")))
    test = ids.where("h < 0.1").select("conv_id", F.lit(True).alias("in_test"))
    val = ids.where("h >= 0.05 and h < 0.2").select("conv_id", F.lit(True).alias("in_val"))
    return ids.join(test, "conv_id", "left").join(val, "conv_id", "left").select("conv_id", F.when(F.col("in_test"), "test").when(F.col("in_val"), "val").otherwise("train").alias("split"))


@query("prj_language_label", """
    select doc_id, case when lang = 'en' then 'english' when lang is null then 'unknown' else 'mixed' end as label,
           coalesce(nullif(source, ''), lang, 'none') as first_known from documents""")
def language_label(t: Tables) -> DataFrame:
    first = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.col("lang"), F.lit("none"))
    return t.documents.select("doc_id", F.when(F.col("lang") == "en", "english").when(F.col("lang").isNull(), "unknown").otherwise("mixed").alias("label"), first.alias("first_known"))


@query("prj_negative_kind", """
    select conv_id, turn, case when turn < 2 then 'opening' when turn = max(turn) over (partition by conv_id) then 'closing' else 'other' end as kind,
           turn between 1 and 3 as in_window from conversations""")
def negative_kind(t: Tables) -> DataFrame:
    last = F.max("turn").over(W.partitionBy("conv_id"))
    return t.conversations.select("conv_id", "turn", F.when(F.col("turn") < 2, "opening").when(F.col("turn") == last, "closing").otherwise("other").alias("kind"), F.col("turn").between(1, 3).alias("in_window"))


@query("prj_distinct_tokens", """
    select conv_id, turn, array_to_string(list_distinct_ordered, ' ') as tokens, len(list_distinct_ordered) as n from (
      select conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) as list_distinct_ordered from (select conv_id, turn, string_split(lower(text), ' ') as w from conversations))""")
def distinct_tokens(t: Tables) -> DataFrame:
    """The first of each token stays in its place."""
    kept = F.array_distinct(F.split(F.lower("text"), " "))
    return t.conversations.select("conv_id", "turn", F.array_join(kept, " ").alias("tokens"), F.size(kept).cast("bigint").alias("n"))


@query("wn_negatives_by_ratio", f"""
    with d as (select doc_id, lang, coalesce(quality, 0) = 1 as pos, {HD} as h from documents left join labels using (doc_id)),
    n as (select lang, count(*) filter (where pos) as n from d group by lang),
    r as (select doc_id, lang, pos, row_number() over (partition by lang, pos order by h, doc_id) as rn from d)
    select doc_id, r.lang, pos from r join n on r.lang is not distinct from n.lang where pos or rn <= round(n * 0.5)""")
def negatives_by_ratio(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", (F.coalesce("quality", F.lit(0)) == 1).alias("pos"))
    return S.ratio_per_group(rows, ["lang"], F.col("pos"), 0.5, H.h01(F.col("doc_id")), "doc_id")


@query("st_sample_per_stratum", f"""
    select doc_id, source from documents qualify row_number() over (partition by source order by {HD}, doc_id) <= 5""")
def stratum_sample(t: Tables) -> DataFrame:
    return S.sample_per_stratum(t.documents.select("doc_id", "source"), ["source"], H.h01(F.col("doc_id")), 5, "doc_id")


@query("st_round_robin", f"""
    select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {HD}, doc_id) as rn from documents) order by rn, source limit 50""")
def round_robin(t: Tables) -> DataFrame:
    return S.round_robin(t.documents.select("doc_id", "source"), "source", H.h01(F.col("doc_id")), 50, "doc_id")


@query("wn_rotation", """
    select c_custkey, cast((row_number() over (partition by c_nationkey order by c_custkey) - 1) % 4 + 1 as int) as pairing from customer""")
def rotation(t: Tables) -> DataFrame:
    """Pairings take turns over the ordered ids of a nation."""
    return t.customer.select("c_custkey", ((F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1) % 4 + 1).cast("int").alias("pairing"))


@query("src_sample_report", f"""
    select doc_id, lang, n_chars from documents qualify row_number() over (partition by lang order by {HD}, doc_id) <= 5""")
def sample_report(t: Tables) -> DataFrame:
    return S.sample_per_stratum(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], H.h01(F.col("doc_id")), 5, "doc_id")
