"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversation_repair, html_text, katz, license_scan, line_dedup, media, near_dup, packing, quality, secret_scan, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Plan(words=3, percent=85))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/language/thousand/id.txt."""
    shard = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), shard, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored objects come declared as text, which the sniffed type corrects; objects within them are counted."""
    stored = media.store_payload(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text").withColumn("declared", F.lit("text/plain"))
    found = media.sniff_media(stored, ["doc_id", "n_bytes", "declared"], declared_col="declared")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "media_type", "declared_ok", F.size("embedded").cast("long").alias("n_embedded"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_corpus(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode_corpus(encoded, ranks)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_corpus(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), report=True)


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the document that the last number of their path names."""
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*[^?#]*?([0-9]{1,18})[^0-9?#]*(?:[?#]|$)', 1) as bigint)")
    pages = table(spark, sf_dir, "pages").select("page_id", number.alias("doc_id"))
    bad = F.expr("case when quality = 0 or toxic = 1 then 1 else 0 end")
    return pages.join(table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_license_scans": op2_license_scans,
    "op3_media_columns": op3_media_columns,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_secret_scan": op13_secret_scan,
}

def level_sql(k: int) -> str:
    """DuckDB SQL for level k of the template tree (the tables have fewer than four levels)."""
    return f"""
children{k} AS (SELECT template, segs[{k}] AS seg, sum(n)::BIGINT AS child_n, sum(b)::BIGINT AS child_b FROM nodes{k - 1} WHERE len(segs) >= {k} GROUP BY template, segs[{k}]),
parents{k} AS (SELECT template, sum(child_n)::DOUBLE AS all_n, sum(child_b)::DOUBLE AS all_b FROM children{k} GROUP BY template),
named{k} AS (
  SELECT c.template, seg, c.template || '/' ||
         CASE WHEN child_n < 5 OR child_n = all_n OR (child_b::DOUBLE * all_n - child_n::DOUBLE * all_b) * (child_b::DOUBLE * all_n - child_n::DOUBLE * all_b) * all_n
                   <= 3.84::DOUBLE * child_n::DOUBLE * (all_n - child_n::DOUBLE) * all_b * (all_n - all_b) THEN '*' ELSE seg END AS longer
  FROM children{k} c JOIN parents{k} p ON c.template = p.template),
nodes{k} AS (
  SELECT host, segs, n, b, template FROM nodes{k - 1} WHERE len(segs) < {k}
  UNION ALL
  SELECT host, segs, n, b, longer AS template FROM nodes{k - 1} x JOIN named{k} y ON x.template = y.template AND x.segs[{k}] = y.seg WHERE len(segs) >= {k}),"""


ORACLE_SQL: dict[str, str] = {
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM documents),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM pieces, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 10),
several AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM several, (VALUES (1), (2)) v(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM several WHERE m = 3) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer g USING (lang, phrase) WHERE place = 1 AND (most IS NULL OR array_length(string_split(s.phrase, ' ')) = 3 OR 100 * most < 50 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN sizes USING (lang) WHERE rank <= 2000
""",
    "op9_url_filters": rf"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path,
         list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS segs,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts),
marked AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM (SELECT page_id, TRY_CAST(regexp_extract(url, '://[^/?#]*[^?#]*?([0-9]{{1,18}})[^0-9?#]*(?:[?#]|$)', 1) AS BIGINT) AS doc_id FROM pages)
  JOIN labels USING (doc_id) GROUP BY page_id),
seen AS (SELECT DISTINCT page_id, host, segs FROM ruled),
nodes0 AS (SELECT host, segs, host AS template, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM seen LEFT JOIN marked USING (page_id) GROUP BY host, segs),
{"".join(level_sql(k) for k in (1, 2, 3))}
total AS (SELECT sum(b)::DOUBLE / greatest(sum(n), 1)::DOUBLE AS prior FROM nodes0),
judged AS (
  SELECT template, sum(n)::BIGINT AS n_labelled, sum(b)::BIGINT AS n_bad,
         sum(b) > 0 AND (sum(b)::DOUBLE + (SELECT prior FROM total) * 8.0::DOUBLE) / (sum(n)::DOUBLE + 8.0::DOUBLE) >= 1.5::DOUBLE * (SELECT prior FROM total) AS rejected
  FROM nodes3 GROUP BY template)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN rejected THEN 'block' ELSE 'allow' END AS verdict,
       t.template, n_labelled, n_bad
FROM ruled r LEFT JOIN nodes3 t ON r.host = t.host AND r.segs = t.segs LEFT JOIN judged j ON t.template = j.template
""",
}
