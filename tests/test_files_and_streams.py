"""Sources, sinks and streams in temporary folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import intervals
from lexloom.sources import files
from lexloom.streaming import events as stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert files.json_array(spark, str(tmp_path / "a.json"), "x int").count() == 2
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\nnot json\n')
    assert [r.line for r in files.broken_lines(spark, str(tmp_path / "l.jsonl"), "x int").collect()] == ["not json"]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "l.jsonl"), "x int").collect()


def test_lists_and_missing_paths(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n\n boat \nferry\n")
    assert [r.word for r in files.listed_words(spark, str(tmp_path / "w.txt")).collect()] == ["boat", "ferry"]
    assert files.or_none(files.listed_words, spark, str(tmp_path / "none.txt")) is None


def test_digests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"hello")
    r = files.digests(spark, str(tmp_path)).first()
    assert r.sha256 == hashlib.sha256(b"hello").hexdigest() and r.blob == hashlib.sha1(b"blob 5\0hello").hexdigest()
    want = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, sha256 string")
    have = spark.createDataFrame([("b", "3"), ("c", "4")], "file string, sha256 string")
    assert {tuple(x) for x in files.identity_problems(have, want).collect()} == {("a", "missing"), ("b", "changed"), ("c", "unlisted")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("IPC", 1), ("BNS", 2)], "code string, n int")
    files.write_new(df, str(tmp_path / "new"))
    with pytest.raises(Exception):
        files.write_new(df, str(tmp_path / "new"))
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_by_code(df, str(tmp_path / "by"), "code")
    assert (tmp_path / "by" / "code=IPC").exists()


def test_latest_runs(spark, tmp_path):
    for run, rate in (("run-1", 0.5), ("run-2", 0.4)):
        (tmp_path / f"{run}.json").write_text(json.dumps({"lang": "hi", "rate": rate}))
    runs = spark.read.json(str(tmp_path / "*.json")).withColumn("file", F.input_file_name())
    assert files.latest_runs(runs, "lang", F.col("file")).first().rate == 0.4
    assert files.forbidden_columns(spark.createDataFrame([(1, 2)], "caseId int, correct_top1 int"), ("correctTop1",)) == ["correct_top1"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    live = stream.stream(spark, EVENTS)
    got = stream.run(stream.paired(live, "user_id", "ts", "event_id", "event_type", "view", "purchase"), str(tmp_path))
    want = intervals.pairs(events, "user_id", "ts", "event_id", "event_type", "view", "purchase")
    want = want.select("user_id", *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("opened", "closed")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_windows_and_sessions(spark, tmp_path):
    live = stream.stream(spark, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.run(stream.windowed(live, "ts", ["event_type"], "1 day", "1 day"), str(tmp_path), "complete")
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()
    ended = stream.run(stream.sessions(live, "ts", "user_id", "6 hours"), str(tmp_path))
    assert ended.count() > 0
