"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from vakya.sources import files


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "n": 1}\n\n{"id": 1, "n": 2}\n{"id": 2, "n": 3}\n')
    df = files.read_jsonl(spark, path, "id long, n long")
    assert df.count() == 3
    assert sorted(map(tuple, files.last_of_each(df, "id", "n").collect())) == [(1, 2), (2, 3)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nbroken\n')
    loose = files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id long", strict=False).collect()
    assert [r["_corrupt_record"] for r in loose] == [None, "broken"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id long").collect()


def test_nested(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"run": "r", "agents": [{"agent": "a", "scenarios": [{"id": 1}, {"id": 2}]}, {"agent": "b", "scenarios": []}]}, indent=1))
    df = files.read_json_document(spark, str(tmp_path / "s.json"), "run string, agents array<struct<agent:string,scenarios:array<struct<id:long>>>>")
    assert sorted(map(tuple, files.flatten(df, "agents", "scenarios").collect())) == [("r", "a", 1), ("r", "a", 2)]


def test_zip_needs_partners(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(2, "y")], "k long, w string")
    assert files.zipped(a, a.withColumnRenamed("v", "w"), "k").count() == 1
    with pytest.raises(Exception):
        files.zipped(a, b, "k").collect()


def test_json_in_text(spark):
    df = spark.createDataFrame([('say ```json\n{"a": 1}\n``` ok',), ('x {"a": 2} y',), ("none",)], "t string")
    assert [r[0] for r in df.select(files.json_in_text(F.col("t"), "a int")["a"]).collect()] == [1, 2, None]


def test_sinks_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id long, t string, split string")
    files.write_routed(df, str(tmp_path / "out"), "split")
    assert {p.name for p in (tmp_path / "out").glob("split=*")} == {"split=train", "split=test"}
    files.write_csv(df, str(tmp_path / "csv"), ["t", "id", "other"])
    assert files.read_csv(spark, str(tmp_path / "csv"), "t string, id long, other string").where("other is null").count() == 2
    assert files.markdown(df.select("id").orderBy("id")).splitlines()[2] == "| 1 |"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.bin").write_bytes(b"abc")
    got = files.file_digests(spark, str(tmp_path / "d"))
    assert got.first().md5 == "900150983cd24fb0d6963f7d28e17f72"
    manifest = spark.createDataFrame([("x.bin", got.first().sha256), ("y.bin", "0")], "name string, sha256 string")
    assert [r.name for r in files.missing_files(manifest, got).collect()] == ["y.bin"]
    sig = files.group_signature(df, "split", "id")
    changed = files.group_signature(df.withColumn("t", F.when(F.col("id") == 1, "z").otherwise(F.col("t"))), "split", "id")
    assert [r.split for r in files.stale(changed, sig, "split").collect()] == ["train"]


def test_frames(spark):
    df = spark.createDataFrame([(bytearray(b"\x02hi"),), (bytearray(b"\x07{}"),), (bytearray(b"\x63?"),), (bytearray(b""),)], "payload binary")
    assert [(r.kind, r.text) for r in files.decode_frames(df).collect()][:3] == [("text", "hi"), ("event", "{}"), ("unknown", None)]
    back = files.encode_frames(spark.createDataFrame([("hé",)], "t string"), "text", "t")
    assert files.decode_frames(back).first().text == "hé"
