"""Queries on files: a table is written in a format, with what real files have besides rows, and read back by a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files as S
from .registry import Tables, query


def place(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{S.shared_dir(t.spark)}/vakya-files-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"


@query("src_jsonl", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def jsonl(t: Tables) -> DataFrame:
    """JSON lines between empty ones, written by appending and read with a fixed schema."""
    path = place(t)
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    S.append_jsonl(rows.where("c_custkey % 2 = 0"), path)
    rows.where("c_custkey % 2 <> 0").select(F.concat(F.to_json(F.struct("*")), F.lit("\n"))).write.mode("append").text(path)
    return S.read_jsonl(t.spark, path, CUSTOMER)


@query("src_jsonl_list", """
    select c_nationkey, arg_max(c_name, c_custkey) as c_name, max(c_custkey) as c_custkey from customer group by 1""")
def jsonl_list(t: Tables) -> DataFrame:
    """JSON lines where a later line of a key replaces those before."""
    path = place(t)
    S.append_jsonl(t.customer.select("c_nationkey", "c_name", "c_custkey"), path)
    return S.last_of_each(S.read_jsonl(t.spark, path, "c_nationkey int, c_name string, c_custkey bigint"), "c_nationkey", "c_custkey")


@query("src_json_tree", """
    select r_name, n_name, s_suppkey from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey""")
def json_tree(t: Tables) -> DataFrame:
    """One JSON document a region, of nations with their suppliers, flattened with the parents' fields."""
    path = place(t)
    nations = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.collect_list(F.struct("s_suppkey")).alias("suppliers"))
    trees = nations.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "suppliers")).alias("nations")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "nations")
    trees.select(F.to_json(F.struct("*"), {"pretty": "true"})).repartition("r_name").write.partitionBy().text(path)
    read = t.spark.read.text(path, wholetext=True)
    schema = "r_name string, nations array<struct<n_name: string, suppliers: array<struct<s_suppkey: bigint>>>>"
    parts = read.select(F.explode(F.split("value", "(?<=\\n\\})\\n")).alias("value")).where("trim(value) <> ''").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return S.flatten(parts, "nations", "suppliers")


@query("src_keyed_map", "select cast(n_nationkey as varchar) as key, n_name as name, n_regionkey as region from nation")
def keyed_map(t: Tables) -> DataFrame:
    """A JSON document whose keys are data."""
    path = place(t)
    whole = t.nation.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))).alias("records"))
    whole.write.json(path)
    return S.map_as_rows(S.read_json_document(t.spark, path, "records map<string, struct<name: string, region: int>>"), "records").select("key", "value.name", "value.region")


@query("src_csv", "select s_suppkey as id, s_name as name, s_acctbal as balance, cast(null as varchar) as note from supplier")
def csv(t: Tables) -> DataFrame:
    """A CSV file of fixed columns: others are left out, missing ones are empty, numbers are read as such."""
    path = place(t)
    S.write_csv(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_nationkey"), path, ["id", "name", "balance", "note"])
    return S.read_csv(t.spark, path, "id bigint, name string, balance double, note string")


@query("src_tsv_latest", "select p_brand, p_size, max(p_retailprice) as price from part group by 1, 2")
def tsv_latest(t: Tables) -> DataFrame:
    """A file with tabs, keyed by two columns."""
    path = place(t)
    t.part.select("p_brand", "p_size", "p_retailprice").write.option("header", True).option("sep", "\t").csv(path)
    read = S.read_csv(t.spark, path, "p_brand string, p_size int, p_retailprice double", "\t")
    return read.groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("price"))


@query("src_routed", "select event_type as route, count(*) as n, round(sum(value), 4) as total from events group by 1")
def routed(t: Tables) -> DataFrame:
    """One input written to a folder for each route in one pass; the route is read from the path."""
    path = place(t)
    S.write_routed(t.events.select("event_id", "value", F.col("event_type").alias("route")), path, "route")
    files = t.spark.read.parquet(f"{path}/route=*")
    return S.with_path_keys(files, "/route=([^/]+)/", ["route"]).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("src_zip_lines", "select doc_id, lang, quality from documents join labels using (doc_id)")
def zip_lines(t: Tables) -> DataFrame:
    """Rows beside their metadata from two files; both must have the same keys."""
    path = place(t)
    rows, meta = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang"), t.labels.join(t.documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")
    S.append_jsonl(rows, f"{path}/rows")
    S.append_jsonl(meta, f"{path}/meta")
    return S.zipped(S.read_jsonl(t.spark, f"{path}/rows", "doc_id bigint, lang string"), S.read_jsonl(t.spark, f"{path}/meta", "doc_id bigint, quality int"), "doc_id")


@query("src_json_repaired", """
    select event_id, case when event_id % 3 = 2 then null else event_type end as kind, case when event_id % 3 = 2 then null else value end as value from events""")
def json_repaired(t: Tables) -> DataFrame:
    """JSON out of answers: fenced, between other words, or broken."""
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), "value"))
    case = F.pmod("event_id", F.lit(3))
    answer = F.when(case == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(case == 1, F.concat(F.lit("It is "), body, F.lit(" as asked."))).otherwise(F.concat(F.lit("It is "), F.expr("substring(to_json(struct(event_type as kind, value)), 1, 12)")))
    found = t.events.select("event_id", S.json_in_text(answer, "kind string, value double").alias("j"))
    return found.select("event_id", "j.kind", "j.value")


@query("src_replaced", "select o_orderstatus, count(*) as n from orders group by 1")
def replaced(t: Tables) -> DataFrame:
    """A table that is written twice: readers see the second."""
    path = place(t)
    S.replace(t.orders.select("o_orderstatus").limit(10), path)
    S.replace(t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.parquet(path)


@query("src_markdown", """
    select n_name, '| ' || n_name || ' | ' || cast(count(*) as varchar) || ' |' as line from nation join supplier on s_nationkey = n_nationkey group by 1""")
def markdown(t: Tables) -> DataFrame:
    """A small report as the lines of a Markdown table."""
    report = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return report.select("n_name", S.markdown_line("n_name", "n").alias("line"))


@query("src_stale_groups", "select conv_id from conversations group by 1 having max(case when turn = 1 then 1 else 0 end) = 1")
def stale_groups(t: Tables) -> DataFrame:
    """Groups whose stored signature no longer fits, as a turn has changed since, or is missing."""
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    path = place(t)
    S.replace(S.group_signature(rows, "conv_id", "turn"), path)
    changed = rows.withColumn("text", F.when(F.col("turn") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return S.stale(S.group_signature(changed, "conv_id", "turn"), t.spark.read.parquet(path), "conv_id")


@query("src_file_digests", """
    with f as (select n_nationkey, n_name || chr(10) as body from nation) select md5(body) as md5, sha256(body) as sha256, cast(octet_length(encode(body)) as bigint) as length, true as listed from f""")
def file_digests(t: Tables) -> DataFrame:
    """Digests of files, and whether a manifest of them has each."""
    path = place(t)
    t.nation.select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    digests = S.file_digests(t.spark, f"{path}/*/part-*")
    manifest = t.nation.select(F.sha2(F.concat("n_name", F.lit("\n")), 256).alias("sha256"), F.lit(True).alias("listed"))
    return digests.join(manifest, "sha256", "left").select("md5", "sha256", "length", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("src_missing_files", "select 'n' || cast(n_nationkey as varchar) as name from nation where n_nationkey % 5 = 0")
def missing_files(t: Tables) -> DataFrame:
    """Entries of a manifest without a file of that digest: every fifth entry names another content."""
    path = place(t)
    names = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), "n_name", "n_nationkey")
    names.select("name", "n_name").repartition("name").write.partitionBy("name").text(path)
    digests = S.file_digests(t.spark, f"{path}/*/part-*").select(F.regexp_extract("path", "/name=([^/]+)/", 1).alias("path"), "sha256")
    content = F.when(F.col("n_nationkey") % 5 == 0, F.lit("other")).otherwise(F.col("n_name"))
    return S.missing_files(names.select("name", F.sha2(F.concat(content, F.lit("\n")), 256).alias("sha256")), digests).select("name")


@query("src_frames", """
    select event_id, case event_type when 'view' then 'text' when 'click' then 'event' else 'control' end as kind, case when event_type in ('view', 'click') then event_type || ':' || cast(event_id as varchar) end as text, length(event_type || ':' || cast(event_id as varchar)) as n_bytes from events""")
def frames(t: Tables) -> DataFrame:
    """Binary frames of three kinds, encoded and decoded."""
    said = t.events.select("event_id", "event_type", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("said"))
    kinds = {"view": "text", "click": "event"}
    other = ~F.col("event_type").isin(*kinds)
    parts = [S.encode_frames(said.where(F.col("event_type") == k), v, "said") for k, v in kinds.items()] + [S.encode_frames(said.where(other), "control", "said")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return S.decode_frames(whole.select("event_id", "payload")).select("event_id", "kind", "text", F.octet_length("body").cast("bigint").alias("n_bytes"))
