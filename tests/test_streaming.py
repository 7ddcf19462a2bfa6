"""Streaming forms against the batch forms, over files that arrive in turn."""

import datetime as dt

from tidemark.operators import state
from tidemark.streaming import stateful

SCHEMA = "scan_id string, ord long, time double, matches int, text string"


def test_gate_stream_matches_batch(spark, tmp_path):
    rows = [("a", k, 300.0 * k, 1 if k in (5, 6) else 0, "") for k in range(14)] + [("b", k, 200.0 * k, 0, "found" if k == 4 else "") for k in range(12)]
    source = tmp_path / "in"
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[1] >= 7) == bool(part)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stateful.gate_stream(stream).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.scan_id, r.ord): r.skipped for r in spark.table("gated").collect()}
    want = {(r.scan_id, r.ord): r.skipped for r in state.gate_frames(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_sample_stream_gives_first_frames(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "video_id string, ord long, ts timestamp"
    frames = [("v", k, base + dt.timedelta(milliseconds=40 * k)) for k in range(20)] + [("v", 99, base + dt.timedelta(minutes=5))]
    for k, part in enumerate((frames, [("v", 100, base + dt.timedelta(minutes=10))])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stateful.sample_stream(stream, 200, 100).writeStream.format("memory").queryName("sampled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(r.ord for r in spark.table("sampled").collect())
    assert got[:4] == [0, 5, 10, 15]


def test_progressive_cues(spark, tmp_path):
    schema = "video_id string, ord long, time double, text string, confidence double"
    store, made = str(tmp_path / "store"), []
    spark.createDataFrame([("v", k, 250.0 * k, "" if k == 0 else "hello", 0.95) for k in range(5)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stateful.progressive_cues(stream, lambda: spark.read.schema(schema).parquet(store), lambda cues, _: made.append(cues.collect()), lambda batch: batch.write.mode("append").parquet(store), 0.0, 5000.0, 250.0, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert [(c.start, c.end, c.text) for c in made[-1]] == [(125, 1125, "hello")]
