"""Reading and writing files: JSON lines, nested JSON, CSV, text and binary, digests and manifests."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one of our own only where all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="vakya-files-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; empty lines are skipped. Not strict: broken lines keep their text in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(wide.add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by an order that the rows carry."""
    best = F.max_by(F.struct(*df.columns), F.col(order)).alias("row")
    return df.groupBy(F.col(key).alias("__key")).agg(best).select("row.*")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def flatten(df: DataFrame, *arrays: str) -> DataFrame:
    """Nested arrays of structs as rows, with the fields of their parents: ``flatten(df, "agents", "scenarios")``."""
    for name in arrays:
        rest = [c for c in df.columns if c != name]
        df = df.select(*rest, F.explode(name).alias("__item")).select(*[c for c in rest], "__item.*")
    return df


def map_as_rows(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A map whose keys are data as rows."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(key, value))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)


def with_path_keys(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the path of each row's file, by the groups of a pattern."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def zipped(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Rows beside their metadata by key; a key that one side lacks is an error."""
    wide = rows.withColumn("__l", F.lit(True)).join(meta.withColumn("__r", F.lit(True)), key, "full_outer")
    ok = F.assert_true(F.col("__l").isNotNull() & F.col("__r").isNotNull(), F.concat(F.lit("no partner for "), F.col(key).cast("string")))
    return wide.where(ok.isNull()).drop("__l", "__r")


def json_in_text(text: Column, schema: str) -> Column:
    """The struct of a JSON object in free text, fenced or bare (from the first brace to the last); null if it is broken."""
    fenced = F.regexp_extract(text, "```(?:json)?\\s*([\\s\\S]*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.from_json(F.regexp_extract(body, "(\\{[\\s\\S]*\\})", 1), schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrites by Spark's commit protocol: readers see the old files or the new ones."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns in order; others are left out, missing ones are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_routed(df: DataFrame, path: str, route: str) -> None:
    """One input, one folder for each value of ``route``, in one pass."""
    df.write.mode("overwrite").partitionBy(route).parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table in Markdown."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def markdown_line(*columns: str) -> Column:
    """A row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5, sha256) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def missing_files(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Entries (name, sha256) of a manifest that no file has."""
    have = digests.select(F.substring_index("path", "/", -1).alias("name"), "sha256")
    return manifest.join(have, ["name", "sha256"], "left_anti")


def group_signature(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, signature): a digest of a group's rows in order, to find outputs that are stale."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.struct(*[c for c in df.columns if c != key]).alias("row"))))
    return df.groupBy(key).agg(F.md5(F.to_json(listed)).alias("signature"))


def stale(plan: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose stored signature differs or is missing."""
    old = stored.select(key, F.col("signature").alias("__old"))
    return plan.join(old, key, "left").where(~F.col("signature").eqNullSafe(F.col("__old"))).select(key)


FRAME_KINDS = ("handshake", "audio", "text", "control", "metadata", "error", "ping", "event")


def decode_frames(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``kind``, ``body`` and, for text and events, ``text`` of binary frames; a first byte that is unknown gives the kind ``unknown``."""
    first = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    kind = F.when(first < len(FRAME_KINDS), F.element_at(F.array(*map(F.lit, FRAME_KINDS)), F.least(first, F.lit(len(FRAME_KINDS) - 1)) + 1)).otherwise("unknown")
    body = F.expr(f"substring({payload}, 2)")
    return df.withColumn("kind", kind).withColumn("body", body).withColumn("text", F.when(F.col("kind").isin("text", "metadata", "error", "event"), F.decode(body, "UTF-8")))


def encode_frames(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Frames of one kind from text."""
    head = F.unhex(F.lit(f"{FRAME_KINDS.index(kind):02x}"))
    return df.withColumn("payload", F.concat(head, F.encode(text, "UTF-8")))


def ordered_by_line(df: DataFrame, key: str, line: str) -> DataFrame:
    """Rows numbered within a key by their line."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(line)))
