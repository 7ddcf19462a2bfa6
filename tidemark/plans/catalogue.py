"""Registered queries for the engine's own operators on the star-schema tables, each with SQL where SQL can express it.

None of the tables holds video data. Events stand in for observations (a user is a video, the event type a text, errors are blanks), orders
and line items for cues, vectors for small pictures. All queries run over whole tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import schema as s
from ..functions import kernels
from ..functions import geometry as g
from ..functions import text as t
from ..functions import time as ti
from ..operators import cues, intervals, jobs, sampling, state
from ..sources import project as project_files
from ..sources import sinks

HOURS_6 = 21_600_000.0
END = 2_591_999_000.0
EPOCH_US = 1_704_067_200_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000.0
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), ms.alias("time"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"))


OBS = f"""obs AS (SELECT user_id AS video_id, event_id AS ord, (epoch_us(ts) - {EPOCH_US}) / 1000.0::DOUBLE AS time,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text, least(value / 500, 1.0::DOUBLE) AS confidence FROM events)"""
NEAR = f"""{OBS},
near AS (SELECT *, lag(time) OVER w AS prev, lead(time) OVER w AS nxt FROM obs WHERE time >= 0 AND time < {END}::DOUBLE WINDOW w AS (PARTITION BY video_id ORDER BY time, ord)),
ext AS (SELECT *, coalesce(time - prev > 54000000::DOUBLE, false) AS gap_before, coalesce(nxt - time > 54000000::DOUBLE, false) AS gap_after,
  greatest(0::DOUBLE, CASE WHEN prev IS NOT NULL AND NOT coalesce(time - prev > 54000000::DOUBLE, false) THEN (prev + time) / 2 ELSE time - 10800000 END) AS "start",
  least({END}::DOUBLE, CASE WHEN nxt IS NULL THEN {END}::DOUBLE WHEN nxt - time > 54000000::DOUBLE THEN time + 10800000 ELSE (time + nxt) / 2 END) AS "end" FROM near),
marked AS (SELECT *, greatest(0::DOUBLE, "end" - "start") AS duration,
  CASE WHEN gap_before OR lag(text) OVER w IS DISTINCT FROM text THEN 1 ELSE 0 END AS fresh, CASE WHEN gap_before THEN 1 ELSE 0 END AS cut FROM ext WINDOW w AS (PARTITION BY video_id ORDER BY time, ord)),
numbered AS (SELECT *, sum(fresh) OVER w AS run_id, sum(cut) OVER w AS segment FROM marked WINDOW w AS (PARTITION BY video_id ORDER BY time, ord))"""


def extents(spark, sf_dir):
    return cues.frame_extents(observations(spark, sf_dir), 0.0, END, HOURS_6)


def frame_extents(spark, sf_dir):
    return extents(spark, sf_dir).select("video_id", "ord", F.round("start", 4).alias("start_ms"), F.round("end", 4).alias("end_ms"), "gap_before", "gap_after")


def numbered(spark, sf_dir):
    return cues.assign_runs(extents(spark, sf_dir), nfkc=False)


def runs_pass1(spark, sf_dir):
    r = numbered(spark, sf_dir).groupBy("video_id", "run_id").agg(F.first("text").alias("text"), F.min("start").alias("a"), F.max("end").alias("b"), F.count("*").alias("samples"), F.sum(F.col("confidence") * F.col("duration")).alias("c"), F.sum("duration").alias("d"))
    return r.select("video_id", F.col("run_id").cast("long").alias("run_id"), "text", F.round("a", 4).alias("start_ms"), F.round("b", 4).alias("end_ms"), "samples", F.round(F.when(F.col("d") > 0, F.col("c") / F.col("d")), 6).alias("confidence"))


def run_votes(spark, sf_dir):
    v = cues.run_votes(numbered(spark, sf_dir))
    return v.select("video_id", F.col("run_id").cast("long").alias("run_id"), "text", F.round("weight", 3).alias("weight"), F.round("best.sample_time", 4).alias("sample_time"), F.col("first.ord").alias("first_ord"), "samples")


def raw_cues(spark, sf_dir):
    c = cues.raw_cues(observations(spark, sf_dir), 0.0, END, HOURS_6, nfkc=False)
    return c.select("video_id", F.col("id").alias("cue_id"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text", F.round("confidence", 6).alias("confidence"), "needs_review", F.round("sample_time", 4).alias("sample_time"))


def cues_full(spark, sf_dir):
    c = cues.build_cues(observations(spark, sf_dir), 0.0, END, HOURS_6, nfkc=False)
    return c.select("video_id", F.col("id").alias("cue_id"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text", F.round("confidence", 6).alias("confidence"), "needs_review", F.round("sample_time", 4).alias("sample_time"))


def sample_tumbling(spark, sf_dir):
    return sampling.sample_tumbling(observations(spark, sf_dir), 0.0, END, HOURS_6).select("video_id", "ord", F.round("time", 4).alias("time"))


def _windows(spark: SparkSession) -> DataFrame:
    day = 86_400_000.0
    return spark.range(30).select(F.col("id").cast("int").alias("range_id"), (F.col("id") * day + 3_600_000.0).alias("start"), (F.col("id") * day + 50_400_000.0).alias("end"), F.lit(7_200_000.0).alias("interval"))


def sample_windows(spark, sf_dir):
    return sampling.sample_windows(observations(spark, sf_dir), _windows(spark)).select("video_id", "range_id", "ord", F.round("time", 4).alias("time"))


def refine_windows(spark, sf_dir):
    r = sampling.refine_windows(observations(spark, sf_dir), nfkc=False)
    return r.select("video_id", F.col("range_id").cast("long").alias("range_id"), F.round("start", 4).alias("start_ms"), F.round("end", 4).alias("end_ms"))


def refine_anti(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return sampling.unseen(obs.where("ord % 3 <> 0"), obs.where("ord % 3 = 0")).select("video_id", "ord")


def asof_start(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000.0).alias("time"))
    index = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("idx"), F.col("time").alias("pts"), (F.col("event_type") == "signup").alias("is_sync"))
    targets = e.where("event_type = 'purchase'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("target_id"), F.col("time").alias("target"))
    return sampling.start_sample(index, targets).select("video_id", "target_id", "start_idx")


def decode_groups(spark, sf_dir):
    """Purchases that start from the same sign-up, as adjacent groups of a user."""
    e = asof_start(spark, sf_dir).withColumnRenamed("target_id", "range_id")
    return sampling.group_by_start(e).select("video_id", "range_id", F.col("decode_group").cast("long").alias("decode_group"))


def reorder_margin(spark, sf_dir):
    day = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000).cast("long")
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey"), F.col("l_linenumber"), day("o_orderdate").alias("d"), day("l_shipdate").alias("c"))
    index = both.select("video_id", F.struct("d", "o_orderkey", "l_linenumber").alias("idx"), F.col("d").alias("dts"), F.col("c").alias("cts"), F.lit(1000).alias("timescale"))
    return sampling.reorder_margin(index).select("video_id", F.round("margin_ms", 4).alias("margin_ms"))


def _shipments(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    day = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000).cast("double")
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return both.select(F.col("o_custkey").alias("video_id"), ((F.col("o_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + day("l_shipdate").cast("long")).alias("ord"), day("o_orderdate").alias("start"), day("l_shipdate").alias("end"), F.col("l_returnflag").alias("text"))


def validate_intervals(spark, sf_dir):
    return intervals.cue_errors(_shipments(spark, sf_dir)).groupBy("video_id", F.coalesce("code", F.lit(0)).alias("code")).agg(F.count("*").alias("cues"))


def _cue_intervals(spark, sf_dir):
    """Extents of observations as cues: starts are a little early, so that they overlap."""
    return extents(spark, sf_dir).where("text <> ''").select("video_id", "ord", (F.col("start") - 600_000).alias("start"), "end")


def _points(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("point_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000.0 + 7_200_000).alias("time"))


def timeline_lookup_last(spark, sf_dir):
    found = intervals.timeline_cue_at(_points(spark, sf_dir), _cue_intervals(spark, sf_dir), 100_000.0, END, HOURS_6)
    return found.select("video_id", "point_id", "cue_ord")


def timeline_lookup_first(spark, sf_dir):
    return intervals.playing_cue(_points(spark, sf_dir), _cue_intervals(spark, sf_dir), HOURS_6).select("video_id", "point_id", "cue_ord")


def seek_band(spark, sf_dir):
    """For each click the first event of the user within ten minutes."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id"), "event_type", ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000.0).alias("time"))
    targets = e.where("event_type = 'click'").select("video_id", F.col("event_id").alias("target_id"), "time")
    samples = e.where("event_type <> 'click'").select("video_id", F.col("event_id").alias("idx"), F.col("time").alias("pts"))
    return intervals.seek_sample(targets, samples, 600_000.0).select("video_id", "target_id", "idx")


def format_time(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ti.format_time(F.col("l_extendedprice") * F.col("l_quantity") * 10).alias("clock"))


def parse_time(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    clock = F.concat(q, F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("."), F.floor(F.col("l_tax") * 100).cast("string"))
    return li.select("l_orderkey", "l_linenumber", ti.parse_time(clock).alias("ms"), ti.parse_time(q).alias("plain_ms"), ti.parse_time(F.concat(F.lit("x"), q)).alias("none_ms"))


def text_key(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", t.normalize_text(F.concat("p_brand", F.lit(" - "), "p_name"), nfkc=False).alias("norm"), t.line_count("p_name").alias("n_lines"))


def _pairs(spark, sf_dir):
    """Names of neighbouring parts, the second with its first letters left out in turn."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.expr("concat(substring(p_name, 1, 3), substring(p_name, 5))").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.col("p_name").alias("a"), "other").unionByName(p.select("p_partkey", F.col("p_name").alias("a"), F.expr("concat(substring(p_name, 1, 3), substring(p_name, 5))").alias("other")))


def pair_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", "a", "other", F.round(t.similarity("a", "other", nfkc=False), 6).alias("sim"))


def partial_reads(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", "a", "other", t.is_partial_read("other", "a", nfkc=False).alias("is_partial"))


def related_reads(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", "a", "other", t.related_read("other", "a", nfkc=False).alias("is_related"))


def _numbered_cues(spark, sf_dir):
    e = extents(spark, sf_dir).where("text <> ''")
    return e.select("video_id", "ord", ti.half_up("start").alias("start"), ti.half_up("end").alias("end"), F.concat("text", F.lit(" <"), F.col("ord").cast("string"), F.lit("> & more\r\n\nline")).alias("text"))


def srt_blocks(spark, sf_dir):
    return sinks.subtitle_blocks(_numbered_cues(spark, sf_dir), "srt")


def vtt_blocks(spark, sf_dir):
    return sinks.subtitle_blocks(_numbered_cues(spark, sf_dir), "vtt")


def srt_files(spark, sf_dir):
    f = sinks.subtitles(_numbered_cues(spark, sf_dir), "srt")
    return f.select("video_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))


def export_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", t.export_stem(F.element_at(F.split("url", "/"), -1)).alias("stem"))


def available_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.get(F.split("url", "/"), 3).alias("name"))
    return sinks.export_names(p, ("srt", "vtt")).select("ord", "fmt", "file")


def dedupe_docs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rows = d.select("doc_id", jobs.fingerprint(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "key").select("doc_id", "key", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


def natural_sort(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", t.natural_key(F.concat(F.lit("Ep "), (F.col("c_custkey") % 1000).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))).alias("natural_key"))


def stage_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    m = jobs.stage_metrics(e)
    return m.select("stage", "calls", F.round("total_ms", 4).alias("total_ms"), "max_ms", F.round("mean_ms", 6).alias("mean_ms"))


def queue_totals(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("waiting")
    rows = o.select(F.col("o_orderpriority").alias("priority"), status.alias("status"), (F.col("o_orderkey") % 10 / 10).alias("progress"), (F.col("o_orderkey") % 2 == 0).alias("selected"))
    return jobs.queue_totals(rows, "priority").withColumn("progress", F.round("progress", 6))


def effective_settings(spark, sf_dir):
    """Customers' own segment where the balance is positive, else the shared one."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.struct(F.col("c_mktsegment").alias("model"), F.col("c_acctbal").alias("confidence"))).alias("settings"))
    shared = spark.range(1).select(F.struct(F.lit("shared").alias("model"), F.lit(0.75).alias("confidence")).alias("settings"))
    return jobs.effective_settings(c, shared).select("c_custkey", "settings.model", "settings.confidence")


def pair_batches(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_type", F.col("p_partkey").alias("idx"), F.col("p_size").alias("width"), F.length("p_brand").alias("height"))
    return jobs.pair_batches(p, "p_type").select("p_type", "idx", F.col("batch").cast("long").alias("batch"))


def cue_search(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.where(t.cue_matches(F.col("text"), " THAT ", F.lit(True))).select("conv_id", "turn", "role")


def color_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    color = F.when(F.col("p_size") > 25, F.concat(F.lit("#"), F.lpad(F.hex("p_partkey"), 6, "0"))).otherwise(F.concat(F.lit("#"), F.hex("p_partkey")))
    got = t.parse_color_filter(color, F.col("p_size") * 4 - 20, F.lit(True))
    return p.select("p_partkey", got["color"].alias("color"), got["tolerance"].alias("tolerance"))


def preview_targets(spark, sf_dir):
    e = extents(spark, sf_dir)
    got = ti.cue_preview_target("start", "end", F.col("time") + F.when(F.col("ord") % 2 == 0, 0.0).otherwise(HOURS_6), F.lit(40.0))
    return e.select("video_id", "ord", F.round(got["time"], 5).alias("seek"), F.round(got["frame_time"], 5).alias("frame_time"))


def ctc_decode(spark, sf_dir):
    """Vectors as 8 steps of 8 classes."""
    got = kernels.ctc_column(F.col("embedding").cast("array<double>"), F.array(F.lit(1), F.lit(8), F.lit(8)), ["", *"abcdefg"])
    return read(spark, sf_dir, "embeddings").select("vec_id", got.alias("r")).select("vec_id", F.col("r.text").alias("text"), F.round("r.confidence", 5).alias("confidence"))


def _maps(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double") * 8).alias("p"))


def box_components(spark, sf_dir):
    size = F.lit(8)
    return _maps(spark, sf_dir).select("vec_id", kernels.boxes_column(F.col("p"), size, size, F.lit(80.0), F.lit(80.0)).alias("boxes")).select("vec_id", F.posexplode("boxes").alias("k", "b")).select("vec_id", "k", "b.x", "b.y", "b.width", "b.height")


def box_merge(spark, sf_dir):
    """Runs of four components as boxes."""
    e = _maps(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(*(F.get("p", k * 4 + j).alias(n) for j, n in enumerate(("x", "y", "width", "height"))))).alias("boxes"))
    return e.select("vec_id", kernels.merge_column(F.col("boxes")).alias("boxes")).select("vec_id", F.posexplode("boxes").alias("k", "b")).select("vec_id", "k", "b.x", "b.y", "b.width", "b.height")


@F.pandas_udf(BinaryType())
def _pixels(values: pd.Series) -> pd.Series:
    return values.map(lambda v: np.clip(np.abs(np.asarray(v, np.float64)) * 1020, 0, 255).astype(np.uint8).tobytes())


def _rasters(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", _pixels("embedding").alias("rgba"))


def color_mask(spark, sf_dir):
    """Vectors as 4 by 4 pixels."""
    got = kernels.color_column(F.col("rgba"), F.lit(4), F.lit(4), "#808080", 100, False)
    return _rasters(spark, sf_dir).select("vec_id", got.alias("m")).select("vec_id", F.hex("m.mask").alias("mask"), F.col("m.count").alias("n"))


def line_assembly(spark, sf_dir):
    """Turns of a conversation as lines, two to a row."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    box = F.struct(F.col("turn").cast("double").alias("x"), (F.floor(F.col("turn") / 2) * 10.0).alias("y"), F.lit(1.0).alias("width"), F.lit(8.0).alias("height"))
    lines = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", (F.length("text") % 10 / 10).alias("confidence"), box.alias("box")))).alias("lines"))
    return lines.select("conv_id", kernels.assemble_column(F.col("lines")).alias("r")).select("conv_id", "r.text", F.round("r.confidence", 6).alias("confidence"))


def gate_state(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 36_000_000.0
    frames = e.select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("ord"), ms.alias("time"), F.when(F.col("event_type") == "view", 5).otherwise(0).alias("matches"), F.when(F.col("value") > 480, "text").otherwise("").alias("text"))
    return state.gate_frames(frames).withColumn("time", F.round("time", 6))


def _infer(rows: pd.DataFrame) -> list[dict]:
    return [{"text": f"t{int(k) % 2}", "confidence": 0.95, "lines": [{"text": "t", "confidence": 0.95, "box": {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}}]} for k in rows.ord]


def reuse_state(spark, sf_dir):
    """Vectors of a label as frames of a scan, as 16 by 16 pictures of strokes."""

    @F.pandas_udf("binary")
    def ink(labels: pd.Series) -> pd.Series:
        return labels.map(lambda k: ((np.arange(256) // 16 % 3 != k % 3).astype(np.uint8)).tobytes())

    e = read(spark, sf_dir, "embeddings")
    frames = e.select(F.col("label").alias("scan_id"), F.col("vec_id").alias("ord"), (F.col("vec_id") * 10.0).alias("time"), F.lit(16).alias("width"), F.lit(16).alias("height"), ink(F.floor(F.col("vec_id") / 100)).alias("ink"))
    return state.reuse_frames(frames, _infer)


def crop_queue(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("scan_id"), F.col("p_partkey").alias("ord"), (F.col("p_size") * 40).alias("width"), F.lit(400).alias("height"))
    return state.crop_batches(p).select("scan_id", "ord", "batch")


def model_cache(spark, sf_dir):
    c = read(spark, sf_dir, "nation").select(F.col("n_name").alias("sha256"))
    names = [["NATION_1", "NATION_2", "NATION_3"], ["new", "NATION_2", "NATION_3"], ["new", "none", "NATION_3"]]
    return spark.createDataFrame([(k, state.model_cache_state(c, n, "NATION_9")) for k, n in enumerate(names)], "k long, state string")


def zip_plan(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("content"))
    return sinks.zip_plan(p).select("name", F.col("bytes").cast("long").alias("bytes"), "fits")


def _items(spark, sf_dir):
    """Line items, one for each order and line: some numbers occur more than once."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_tax")))


def _regions(spark, sf_dir):
    """Line items as regions: prices and quantities as fractions of a frame."""
    li = read(spark, sf_dir, "lineitem")
    w, h = F.col("l_quantity") / 100 + 0.05, F.col("l_linenumber") / 20 + 0.02
    x, y = F.col("l_partkey") % 40 / 100, F.col("l_suppkey") % 30 / 50
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount", g.region(x, y, w, h).alias("r"), ((F.col("l_orderkey") % 41 - 20) / 50).alias("dx"), ((F.col("l_partkey") % 31 - 15) / 40).alias("dy"))


def _flat(df, **regions):
    return df.select("l_orderkey", "l_linenumber", *(F.round(r[c], 6).alias(f"{n}_{c}") for n, r in regions.items() for c in ("x", "y", "width", "height")))


def region_moves(spark, sf_dir):
    """Moved, resized at two corners, resized from the middle."""
    df, r, dx, dy = _regions(spark, sf_dir), F.col("r"), F.col("dx"), F.col("dy")
    return _flat(df, moved=g.move_region(r, dx, dy, 0.02), se=g.resize_region(r, "se", dx, dy, 0.04, 0.02), nw=g.resize_region(r, "nw", dx, dy, 0.04, 0.02), mid=g.resize_from_center(r, dx, dy, 0.04, 0.02))


def region_sizes(spark, sf_dir):
    """Pixels of regions, inputs of the models, saved regions, whether they are large enough."""
    w, h = F.col("l_orderkey") % 1900 + 20, F.col("l_partkey") % 1000 + 10
    df = _regions(spark, sf_dir)
    crop, det, small, kept = g.crop_rectangle(F.col("r"), w, h), g.detector_size(w, h), g.reduced_size(w, h), g.saved_region(F.col("r"))
    return df.select("l_orderkey", "l_linenumber", *(crop[c].alias(f"crop_{c}") for c in ("x", "y", "width", "height")), *(x[c].alias(f"{n}_{c}") for n, x in (("det", det), ("small", small)) for c in ("width", "height")), F.round(kept["width"], 6).alias("kept_width"), g.large_enough(F.col("r"), w, h, F.col("dx")).alias("large"))


def line_boxes(spark, sf_dir):
    """Boxes of lines in a crop, as fractions of the frame."""
    box = g.region(F.col("l_tax"), F.col("l_discount"), F.lit(0.5), F.lit(0.25))
    lines = F.array(F.struct(F.lit("t").alias("text"), box.alias("box")))
    return _flat(_regions(spark, sf_dir).withColumn("b", g.to_frame(lines, F.col("r"))[0]["box"]), b=F.col("b"))


def pointer_modes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    bit = lambda k: F.floor(F.col("event_id") / k) % 2 == 1
    return e.select("event_id", g.pointer_mode(F.col("event_id") % 3, bit(3), bit(6), bit(12), bit(24)).alias("mode"))


def row_neighbours(spark, sf_dir):
    """Line items of an order as boxes on rows, with what is cut out of the frame for the recogniser."""
    boxes = _items(spark, sf_dir).select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_id"), (F.col("l_partkey") % 20 / 25).alias("x"), (F.col("l_linenumber") % 2 / 2 + F.col("l_tax") / 10).alias("y"), (F.col("l_quantity") / 400 + 0.01).alias("width"), F.lit(0.05).alias("height"), F.lit(2.5).alias("aspect"))
    return intervals.neighbours_on_row(boxes).select("frame_id", "box_id", F.round("crop_x", 6).alias("crop_x"), F.round("crop_width", 6).alias("crop_width"), F.col("content_width").cast("long").alias("content_width"), F.col("input_width").cast("long").alias("input_width"))


def item_times(spark, sf_dir):
    """Presentation times, what is read of an item, and how long its timeline is."""
    li = read(spark, sf_dir, "lineitem")
    span = ti.batch_range(F.col("l_extendedprice"), F.col("l_quantity") * 100 - 200, F.col("l_partkey") % 3000)
    return li.select("l_orderkey", "l_linenumber", F.round(ti.presentation_ms("l_partkey", "l_quantity", -40.0), 6).alias("pts"), F.round(ti.microseconds_to_ms("l_suppkey"), 6).alias("ms"), span["start"].alias("start"), span["end"].alias("end"), F.round(ti.timeline_duration(F.col("l_quantity") - 25, F.col("l_linenumber") - 3), 6).alias("length"))


def item_states(spark, sf_dir):
    """Status of items after a run, after another try of the high ones, and whether they run then."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select("o_orderkey", jobs.item_status(F.when(k % 3 == 0, "e"), k % 5 == 0, k % 2 == 0).alias("status"), (k % 7 / 7).alias("progress"), (k % 4 == 0).alias("selected"), "o_orderpriority")
    again = jobs.retry(rows.withColumn("before", F.col("status")), F.col("o_orderpriority").startswith("1"))
    label = t.status_label("status", F.col("o_orderpriority"), F.when(F.col("before") == "failed", "e"), F.lit(""))
    return again.select("o_orderkey", "before", "status", F.round("progress", 6).alias("progress"), (F.col("selected") & (F.col("status") == "waiting")).alias("runs"), label.alias("label"))


def review_totals(spark, sf_dir):
    cues_ = raw_cues(spark, sf_dir)
    return jobs.review_counts(cues_, "text")


def counter_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.create_map(F.col("event_type"), F.col("event_id") % 10, F.lit("all"), F.lit(1).cast("long")).alias("counts"))
    return jobs.counter_totals(e, "user_id")


def queue_additions(spark, sf_dir):
    """Pages arriving in a queue that has every seventh of them, twice each third."""
    p = read(spark, sf_dir, "pages")
    key = lambda: F.sha2(F.col("page_id").cast("string"), 256)
    have = p.where("page_id % 7 = 0").select(key().alias("key"))
    name = F.concat(F.lit("Ep "), (F.col("page_id") % 50).cast("string"), F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".MP4"))
    once = p.select(key().alias("key"), name.alias("name"), name.alias("path"), F.col("page_id").alias("arrival"))
    twice = once.where("arrival % 3 = 0").withColumn("arrival", F.col("arrival") + 10_000_000)
    return jobs.add_items(have, once.union(twice), None).select("arrival", "outcome", F.col("place").cast("long").alias("place"))


def import_cases(spark, sf_dir):
    """Line items as project files that break one rule or none."""
    li = _items(spark, sf_dir).select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("video_id"), (F.col("l_partkey") % 12).alias("c"), F.col("l_quantity").alias("q"))
    c, num = F.col("c"), lambda x: F.col("q") * x
    cue = lambda a, b, text: F.struct(F.lit("1").alias("id"), a.alias("start"), b.alias("end"), text.alias("text"), F.when(c != 2, 0.9).alias("confidence"), a.alias("sampleTime"))
    project = F.struct(
        F.when(c == 1, 2).otherwise(1).alias("schemaVersion"),
        F.lit("ms").alias("timeUnit"),
        F.struct(F.lit("v.mp4").alias("name"), num(1000.0).alias("duration"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height")).alias("source"),
        F.struct(
            F.struct(F.when(c == 8, 0.8).otherwise(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("width"), F.lit(0.2).alias("height")).alias("region"),
            F.lit(0.0).alias("start"), F.when(c == 9, 0.0).otherwise(num(1000.0)).alias("end"), F.lit(250.0).alias("sampleInterval"), F.when(c == 6, "true").alias("ignoreClippedText"),
            F.when(c == 7, F.struct(F.lit("#fff").alias("color"), F.lit(3).alias("tolerance"), F.lit(True).alias("outline"))).alias("colorFilter"),
        ).alias("extraction"),
        F.array(cue(F.lit(0.0), F.when(c == 3, 0.0).otherwise(num(10.0)), F.when(c == 4, " ").otherwise("one")), cue(F.when(c == 5, 1.0).otherwise(num(10.0)), num(20.0), F.lit("two"))).alias("cues"),
    )
    raw = F.when(c == 0, "[1]").when(c == 11, "{").otherwise(F.to_json(project))
    return project_files.import_projects(li.select("video_id", raw.alias("raw"))).select("video_id", "error", F.size("project.cues").alias("cues"))


def word_lists(spark, sf_dir):
    """Conversations as dictionary files: their turns as lines."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", project_files.dictionary(F.regexp_replace("text", " ", "\n")).alias("w"))
    return d.select("doc_id", F.size("w").alias("words"))


def scan_ends(spark, sf_dir):
    """Up to where scans that were stopped have been seen, with the colours of their videos."""
    return state.partial_end(observations(spark, sf_dir).where("ord % 2 = 0"), 0.0, END, HOURS_6).select("video_id", F.round("processed_end", 4).alias("processed_end"), t.hex_color(F.col("video_id") % 256, F.col("video_id") % 200, F.col("video_id") % 100).alias("color"))


def confident_lines(spark, sf_dir):
    """Turns of a conversation as lines, two to a row, those that are sure."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    box = F.struct(F.col("turn").cast("double").alias("x"), (F.floor(F.col("turn") / 2) * 10.0).alias("y"), F.lit(1.0).alias("width"), F.lit(8.0).alias("height"))
    obs = c.groupBy("conv_id").agg(F.collect_list(F.struct("text", (F.length("text") % 10 / 10).alias("confidence"), box.alias("box"))).alias("lines"))
    return cues.keep_confident(obs, 0.5).select("conv_id", "text", F.round("confidence", 6).alias("confidence"), F.size("lines").alias("n"))


def decode_ends(spark, sf_dir):
    """Line items as samples: those that have to be decoded for windows up to 100 ms, by an index with times out of order."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dts"), F.lit(1000).alias("timescale"))
    return sampling.decode_until(li, 100.0, None).drop("timescale")


def edit_offsets(spark, sf_dir):
    """Orders as tracks, their line items as edits."""
    media, fast = F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 35 == 0
    edits = _items(spark, sf_dir).select(
        F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("segment_duration"), F.when(media, (F.col("l_quantity") * 10).cast("long")).otherwise(-1).alias("media_time"),
        F.when(fast, 2).otherwise(1).alias("rate"), F.lit(600).alias("movie_timescale"), F.lit(1000).alias("track_timescale"),
    )
    return state.edit_offset(edits).select("track_id", F.round("offset_ms", 6).alias("offset_ms"))


def edit_checks(spark, sf_dir):
    """Line items as edited times of a cue."""
    valid = intervals.edit_valid(F.col("l_quantity") - 5, F.col("l_linenumber") * 8, F.col("l_partkey") % 60)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", valid.alias("valid"))


def model_checks(spark, sf_dir):
    """Pages as files of a model, every second of which isn't what is expected."""
    name, content = F.col("page_id").cast("string").alias("name"), F.encode("html", "utf-8")
    p = read(spark, sf_dir, "pages")
    expected = p.select(name, F.when(F.col("page_id") % 2 == 0, F.sha2(content, 256)).otherwise(F.sha2(F.lit(b""), 256)).alias("sha256"))
    return project_files.verified_models(p.select(name, content.alias("content")), expected, 6000)


def queue_limit(spark, sf_dir):
    """Documents arriving as videos in a queue of 300 items."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".mov"))
    arriving = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), name.alias("name"), name.alias("path"), F.col("doc_id").alias("arrival"))
    have = spark.range(300).select(F.concat(F.lit("have "), F.col("id").cast("string")).alias("key"))
    return jobs.add_items(have, arriving).select("arrival", "outcome", F.col("place").cast("long").alias("place"))


def item_settings(spark, sf_dir):
    """Customers as items, those of every second nation with settings of their own, those of every fifth without."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("settings"))
    shared = spark.range(1).select(F.lit("shared").alias("settings"))
    own = jobs.switch_settings(c, shared, F.col("c_nationkey") % 2 == 0, True)
    return jobs.switch_settings(own, shared, F.col("c_nationkey") % 5 == 0, False).select("c_custkey", "settings")


def project_notes(spark, sf_dir):
    """Customers as projects, opened for another video or not."""
    c = read(spark, sf_dir, "customer")
    source = F.struct(F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("duration"))
    projects = c.select(F.col("c_custkey").alias("video_id"), F.struct(source.alias("source")).alias("project"))
    videos = c.select(F.col("c_custkey").alias("video_id"), F.lit("BUILDING").alias("name"), F.lit(1000.0).alias("duration"))
    return project_files.import_warnings(projects, videos)


QUERIES = {
    f.__name__: f
    for f in (
        *(frame_extents, runs_pass1, run_votes, raw_cues, cues_full, sample_tumbling, sample_windows, refine_windows, refine_anti, asof_start, decode_groups, reorder_margin, validate_intervals),
        *(timeline_lookup_last, timeline_lookup_first, seek_band, format_time, parse_time, text_key, pair_similarity, partial_reads, related_reads, srt_blocks, vtt_blocks, srt_files, export_names, available_names),
        *(dedupe_docs, natural_sort, stage_metrics, queue_totals, effective_settings, pair_batches, cue_search, color_parse, preview_targets, ctc_decode, box_components, box_merge, color_mask, line_assembly),
        *(gate_state, reuse_state, crop_queue, model_cache, zip_plan, region_moves, region_sizes, line_boxes, pointer_modes, row_neighbours, item_times, item_states, review_totals, counter_totals),
        *(queue_additions, import_cases, word_lists, scan_ends, confident_lines),
        *(decode_ends, edit_offsets, edit_checks, model_checks, queue_limit, item_settings, project_notes),
    )
}

_CLOCK = "lpad((ms // 3600000)::VARCHAR, greatest(2, length((ms // 3600000)::VARCHAR))::INT, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '{}' || lpad((ms % 1000)::VARCHAR, 3, '0')"


def _clock(ms: str, separator: str) -> str:
    return _CLOCK.format(separator).replace("ms", f"({ms})")


_CUES = f"""WITH {NEAR}, c AS (SELECT video_id, ord, floor("start" + 0.5)::BIGINT AS a, floor("end" + 0.5)::BIGINT AS b, text || ' <' || ord || '> & more' || chr(10) || 'line' AS text FROM ext WHERE text <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, ord) AS n FROM c)"""
_BLOCK = {
    "srt": f"n || chr(10) || {_clock('a', ',')} || ' --> ' || {_clock('b', ',')} || chr(10) || text",
    "vtt": f"n || chr(10) || {_clock('a', '.')} || ' --> ' || {_clock('b', '.')} || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
}
_PICK = "t >= a - 0.01::DOUBLE AND t < b"
_TIMES = f"SELECT user_id AS video_id, event_id, event_type, (epoch_us(ts) - {EPOCH_US}) / 1000.0::DOUBLE AS time FROM events"
_POINTS = f"p AS (SELECT video_id, event_id AS point_id, time + 7200000 AS time FROM ({_TIMES}) WHERE event_type = 'error'), q AS (SELECT video_id, ord, \"start\" - 600000 AS a, \"end\" AS b FROM ext WHERE text <> '')"
_SAME = """(SELECT p_partkey, p_name AS a, substr(p_name, 1, 3) || substr(p_name, 5) AS other FROM part)"""
_PAIRS = f"""pairs AS (SELECT p.p_partkey, p.p_name AS a, substr(q.p_name, 1, 3) || substr(q.p_name, 5) AS other FROM part p JOIN part q ON p.p_partkey = q.p_partkey + 1 UNION ALL SELECT * FROM {_SAME}),
n AS (SELECT *, lower(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) AS x, lower(regexp_replace(other, '[^A-Za-z0-9]', '', 'g')) AS y FROM pairs)"""
#: Whether y is a subsequence of x: of y's letters in x, each in turn.
_SUB = "regexp_matches(x, regexp_replace(y, '(.)', '\\1.*', 'g'))"
_PARTIAL = f"(length(y) >= 3 AND length(y) < length(x) AND length(y) / length(x) >= 0.6 AND length(x) - length(y) <= greatest(2, floor(length(x) * 0.25)) AND {_SUB})"

SQL = {
    "frame_extents": f'WITH {NEAR} SELECT video_id, ord, round("start", 4) AS start_ms, round("end", 4) AS end_ms, gap_before, gap_after FROM ext',
    "runs_pass1": f"""WITH {NEAR} SELECT video_id, run_id::BIGINT AS run_id, min(text) AS text, round(min("start"), 4) AS start_ms, round(max("end"), 4) AS end_ms, count(*) AS samples,
      round(CASE WHEN sum(duration) > 0 THEN sum(confidence * duration) / sum(duration) END, 6) AS confidence FROM numbered GROUP BY video_id, run_id""",
    "run_votes": f"""WITH {NEAR} SELECT video_id, run_id::BIGINT AS run_id, text, round(sum(greatest(0.1::DOUBLE, confidence) * duration), 3) AS weight,
      round(arg_max(time, (confidence, -time, -ord)), 4) AS sample_time, arg_min(ord, (time, ord)) AS first_ord, count(*) AS samples FROM numbered GROUP BY video_id, run_id, text""",
    "raw_cues": f"""WITH {NEAR}, r AS (SELECT video_id, run_id, min(text) AS text, min("start") AS a, max("end") AS b, count(*) AS samples, sum(confidence * duration) AS c, sum(duration) AS d,
      arg_max(time, (confidence, -time, -ord)) AS sample_time FROM numbered GROUP BY video_id, run_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, b) AS n, c / d AS confidence_of FROM r WHERE text <> '' AND b > a)
      SELECT video_id, 'cue-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS cue_id, floor(a + 0.5)::BIGINT AS start_ms, floor(b + 0.5)::BIGINT AS end_ms, text, round(confidence_of, 6) AS confidence,
      confidence_of < 0.88 OR samples = 1 OR d <= 180 AS needs_review, round(sample_time, 4) AS sample_time FROM k""",
    "sample_tumbling": f"""WITH {OBS}, k AS (SELECT *, floor(time / {HOURS_6}::DOUBLE) AS bucket FROM obs WHERE time >= -0.01 AND time < {END}::DOUBLE),
      r AS (SELECT *, row_number() OVER (PARTITION BY video_id, bucket ORDER BY time) AS n FROM k)
      SELECT video_id, ord, round(time, 4) AS time FROM r WHERE (bucket >= 0 AND n = 1) OR time + 0.01::DOUBLE >= (bucket + 1) * {HOURS_6}::DOUBLE""",
    "sample_windows": f"""WITH {OBS}, w AS (SELECT i::INT AS range_id, i * 86400000::DOUBLE + 3600000 AS a, i * 86400000::DOUBLE + 50400000 AS b FROM range(30) x(i)),
      k AS (SELECT video_id, ord, time AS t, range_id, a, floor((time - a) / 7200000) AS bucket FROM obs, w WHERE time >= a - 0.01::DOUBLE AND time < b),
      r AS (SELECT *, row_number() OVER (PARTITION BY video_id, range_id, bucket ORDER BY t) AS n FROM k)
      SELECT video_id, range_id, ord, round(t, 4) AS time FROM r WHERE (bucket >= 0 AND n = 1) OR t + 0.01::DOUBLE >= a + (bucket + 1) * 7200000""",
    "refine_windows": f"""WITH {OBS}, l AS (SELECT *, lag(text) OVER w AS b4, lag(time) OVER w AS a FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY time, ord)),
      c AS (SELECT video_id, a, time AS b, ord FROM l WHERE b4 <> text),
      f AS (SELECT *, CASE WHEN coalesce(a > max(b) OVER (PARTITION BY video_id ORDER BY a, b, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM c),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY a, b, ord) AS island FROM f), g AS (SELECT video_id, island, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2)
      SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS range_id, round(a, 4) AS start_ms, round(b, 4) AS end_ms FROM g""",
    "refine_anti": f"""WITH {OBS}, k AS (SELECT *, floor(time + 0.5) AS ms FROM obs), u AS (SELECT * FROM k WHERE ord % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM k s WHERE s.ord % 3 = 0 AND s.video_id = k.video_id AND s.ms = k.ms)),
      r AS (SELECT *, row_number() OVER (PARTITION BY video_id, ms ORDER BY time, ord) AS n FROM u) SELECT video_id, ord FROM r WHERE n = 1""",
    "asof_start": f"""WITH e AS ({_TIMES}) SELECT t.video_id, t.event_id AS target_id, coalesce((SELECT max(s.event_id) FROM e s WHERE s.video_id = t.video_id AND s.event_type = 'signup' AND s.time <= t.time), 0) AS start_idx FROM e t WHERE t.event_type = 'purchase'""",
    "decode_groups": f"""WITH e AS ({_TIMES}), s AS (SELECT t.video_id, t.event_id AS range_id, coalesce((SELECT max(s.event_id) FROM e s WHERE s.video_id = t.video_id AND s.event_type = 'signup' AND s.time <= t.time), 0) AS start_idx FROM e t WHERE t.event_type = 'purchase'),
      f AS (SELECT *, CASE WHEN lag(start_idx) OVER (PARTITION BY video_id ORDER BY range_id) IS DISTINCT FROM start_idx THEN 1 ELSE 0 END AS fresh FROM s)
      SELECT video_id, range_id, (sum(fresh) OVER (PARTITION BY video_id ORDER BY range_id))::BIGINT AS decode_group FROM f""",
    "reorder_margin": """WITH b AS (SELECT o_custkey AS video_id, epoch_us(o_orderdate) // 86400000000 AS d, epoch_us(l_shipdate) // 86400000000 AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT video_id, round(greatest(0::DOUBLE, max((d - c)::DOUBLE)), 4) AS margin_ms FROM b GROUP BY 1""",
    "validate_intervals": """WITH b AS (SELECT o_custkey AS video_id, (o_orderkey * 10 + l_linenumber) * 100000 + epoch_us(l_shipdate) // 86400000000 AS ord, epoch_us(o_orderdate) / 86400000000 AS a, epoch_us(l_shipdate) / 86400000000 AS b, l_returnflag AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      l AS (SELECT *, lag(b) OVER (PARTITION BY video_id ORDER BY a, ord) AS last_end FROM b)
      SELECT video_id, CASE WHEN NOT (a >= 0 AND b > a) THEN 1 WHEN trim(text) = '' THEN 2 WHEN a < last_end THEN 3 ELSE 0 END AS code, count(*) AS cues FROM l GROUP BY 1, 2""",
    "timeline_lookup_last": f"""WITH {NEAR}, {_POINTS}, f AS (SELECT p.video_id, point_id, max(ord) AS cue_ord FROM p JOIN q ON p.video_id = q.video_id AND a <= time AND time < greatest(b, a + 2 / 100000.0::DOUBLE * {END}::DOUBLE) GROUP BY 1, 2)
      SELECT p.video_id, p.point_id, cue_ord FROM p LEFT JOIN f ON p.video_id = f.video_id AND p.point_id = f.point_id""",
    "timeline_lookup_first": f"""WITH {NEAR}, {_POINTS}, f AS (SELECT p.video_id, point_id, min(ord) AS cue_ord FROM p JOIN q ON p.video_id = q.video_id AND a <= time AND time < b GROUP BY 1, 2)
      SELECT p.video_id, p.point_id, cue_ord FROM p LEFT JOIN f ON p.video_id = f.video_id AND p.point_id = f.point_id""",
    "seek_band": f"""WITH e AS ({_TIMES}) SELECT t.video_id, t.event_id AS target_id, (SELECT min(s.event_id) FROM e s WHERE s.video_id = t.video_id AND s.event_type <> 'click' AND abs(s.time - t.time) < 600000) AS idx FROM e t WHERE t.event_type = 'click'""",
    "format_time": f"SELECT l_orderkey, l_linenumber, {_clock('floor(l_extendedprice * l_quantity * 10 + 0.5)::BIGINT', '.')} AS clock FROM lineitem",
    "parse_time": """SELECT l_orderkey, l_linenumber, l_quantity::INT * 60000::DOUBLE + l_linenumber * 1000 + rpad(floor(l_tax * 100)::INT::VARCHAR, 3, '0')::DOUBLE AS ms, l_quantity::INT * 1000::DOUBLE AS plain_ms, NULL::DOUBLE AS none_ms FROM lineitem""",
    "text_key": "SELECT p_partkey, lower(regexp_replace(p_brand || ' - ' || p_name, '[^A-Za-z0-9]', '', 'g')) AS norm, 1::INT AS n_lines FROM part",
    "pair_similarity": f"WITH {_PAIRS} SELECT p_partkey, a, other, round(CASE WHEN x = '' AND y = '' THEN 1::DOUBLE WHEN x = '' OR y = '' THEN 0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS sim FROM n",
    "partial_reads": f"WITH {_PAIRS} SELECT p_partkey, a, other, {_PARTIAL} AS is_partial FROM n",
    "related_reads": f"WITH {_PAIRS}, z AS (SELECT *, {_PARTIAL} AS f FROM n), b AS (SELECT p_partkey, a, other, f, y AS x, x AS y FROM z) SELECT p_partkey, a, other, f OR {_PARTIAL} OR 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.8 AS is_related FROM b",
    "srt_blocks": f"{_CUES} SELECT video_id, n::INT AS n, {_BLOCK['srt']} AS block FROM k",
    "vtt_blocks": f"{_CUES} SELECT video_id, n::INT AS n, {_BLOCK['vtt']} AS block FROM k",
    "srt_files": f"{_CUES}, f AS (SELECT video_id, string_agg({_BLOCK['srt']}, chr(10) || chr(10) ORDER BY n) || chr(10) AS content FROM k GROUP BY 1) SELECT video_id, sha256(content) AS sha256, strlen(content)::INT AS bytes FROM f",
    "export_names": r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') AS stem FROM pages) SELECT page_id, CASE WHEN stem = '' THEN 'episode' ELSE stem END AS stem FROM b""",
    "dedupe_docs": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS c FROM documents),
      k AS (SELECT doc_id, sha256(array_slice(c, 1, 32768) || CASE WHEN octet_length(c) > 32768 THEN array_slice(c, greatest(32768, octet_length(c) - 32768) + 1, octet_length(c)) ELSE ''::BLOB END) AS key FROM b)
      SELECT doc_id, key, doc_id <> min(doc_id) OVER (PARTITION BY key) AS duplicate FROM k""",
    "natural_sort": """SELECT c_custkey, 'ep ' || lpad(length((c_custkey % 1000)::VARCHAR)::VARCHAR, 6, '0') || (c_custkey % 1000) || '-' || lpad(length(c_nationkey::VARCHAR)::VARCHAR, 6, '0') || c_nationkey AS natural_key FROM customer""",
    "stage_metrics": "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total_ms, max(value) AS max_ms, round(avg(value), 6) AS mean_ms FROM events WHERE value >= 0 GROUP BY 1",
    "queue_totals": """SELECT o_orderpriority AS priority, count(*) AS items, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
      round(avg(CASE WHEN o_orderstatus = 'F' THEN 1::DOUBLE ELSE o_orderkey % 10 / 10 END), 6) AS progress, CASE WHEN bool_and(o_orderkey % 2 = 0) THEN 'all' WHEN bool_or(o_orderkey % 2 = 0) THEN 'some' ELSE 'none' END AS selection FROM orders GROUP BY 1""",
    "effective_settings": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'shared' END AS model, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.75::DOUBLE END AS confidence FROM customer",
    "pair_batches": """WITH k AS (SELECT p_type, p_partkey AS idx, (row_number() OVER (PARTITION BY p_type, p_size, length(p_brand) ORDER BY p_partkey) - 1) // 2 AS k, min(p_partkey) OVER (PARTITION BY p_type, p_size, length(p_brand)) AS seen FROM part)
      SELECT p_type, idx, dense_rank() OVER (PARTITION BY p_type ORDER BY seen, k) - 1 AS batch FROM k""",
    "cue_search": "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'that')",
    "color_parse": """WITH c AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN '#' || lpad(upper(to_hex(p_partkey)), 6, '0') ELSE '#' || upper(to_hex(p_partkey)) END AS color, p_size * 4 - 20 AS tol FROM part),
      g AS (SELECT *, regexp_full_match(color, '#[0-9a-fA-F]{6}') AND tol BETWEEN 0 AND 128 AS good FROM c) SELECT p_partkey, CASE WHEN good THEN lower(color) END AS color, CASE WHEN good THEN tol END AS tolerance FROM g""",
    "preview_targets": f"""WITH {NEAR}, k AS (SELECT video_id, ord, "start" AS a, "end" AS b, time + CASE WHEN ord % 2 = 0 THEN 0::DOUBLE ELSE {HOURS_6}::DOUBLE END AS t FROM ext)
      SELECT video_id, ord, round(CASE WHEN a <= t AND t < b THEN t + least(20::DOUBLE, (b - t) / 2) ELSE (a + b) / 2 END, 5) AS seek, round(CASE WHEN a <= t AND t < b THEN t END, 5) AS frame_time FROM k""",
    "ctc_decode": """WITH v AS (SELECT vec_id, s, array_slice(embedding, s * 8 + 1, s * 8 + 8)::DOUBLE[] AS p FROM embeddings, range(8) r(s)),
      b AS (SELECT vec_id, s, list_position(p, list_max(p)) - 1 AS k, list_max(p) AS q FROM v), l AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY s) AS last FROM b),
      e AS (SELECT vec_id, string_agg(substr('abcdefg', k::INT, 1), '' ORDER BY s) AS text, avg(q) AS c FROM l WHERE k <> 0 AND k IS DISTINCT FROM last GROUP BY 1)
      SELECT i.vec_id, coalesce(e.text, '') AS text, round(coalesce(least(1::DOUBLE, greatest(0::DOUBLE, c)), 0), 5) AS confidence FROM embeddings i LEFT JOIN e ON i.vec_id = e.vec_id""",
    "model_cache": "SELECT * FROM (VALUES (0::BIGINT, 'ready'), (1::BIGINT, 'upgrade'), (2::BIGINT, 'empty')) t(k, state)",
    "zip_plan": "SELECT page_id::VARCHAR AS name, (22 + sum(strlen(html) + 2 * strlen(page_id::VARCHAR) + 76) OVER (ORDER BY page_id::VARCHAR))::BIGINT AS bytes, 22 + sum(strlen(html) + 2 * strlen(page_id::VARCHAR) + 76) OVER (ORDER BY page_id::VARCHAR) <= 100663296 AS fits FROM pages",
}

_ITEMS = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)"
#: Regions of line items; halves are rounded upwards by floor(x + 0.5).
_REGION = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax, l_discount, l_partkey % 40 / 100 AS x, l_suppkey % 30 / 50 AS y, l_quantity / 100 + 0.05::DOUBLE AS w, l_linenumber / 20 + 0.02::DOUBLE AS h,
  (l_orderkey % 41 - 20) / 50 AS dx, (l_partkey % 31 - 15) / 40 AS dy, l_orderkey % 1900 + 20 AS fw, l_partkey % 1000 + 10 AS fh FROM lineitem)"""


def _moved(at: str, size: str, d: str) -> str:
    to = f"least(1 - {size}, greatest(0::DOUBLE, {at} + {d}))"
    return f"round(CASE WHEN abs({to} + {size} / 2 - 0.5) <= 0.02::DOUBLE THEN 0.5 - {size} / 2 ELSE {to} END, 6)"


def _middle(at: str, size: str, d: str, least: str) -> tuple[str, str]:
    limit = f"(2 * least({at} + {size} / 2, 1 - ({at} + {size} / 2)))"
    new = f"least({limit}, greatest(least({least}::DOUBLE, {limit}), {size} + 2 * {d}))"
    return f"round({at} + {size} / 2 - {new} / 2, 6)", f"round({new}, 6)"


_AXES = (("x", "w", "dx", "0.04", "x", "width"), ("y", "h", "dy", "0.02", "y", "height"))
_MOVES = ", ".join(
    f"{_moved(at, size, d)} AS moved_{n}, round({size}, 6) AS moved_{m}, round({at}, 6) AS se_{n}, round(least(1::DOUBLE, greatest({at} + {least}::DOUBLE, {at} + {size} + {d})) - {at}, 6) AS se_{m}, "
    f"round(least({at} + {size} - {least}::DOUBLE, greatest(0::DOUBLE, {at} + {d})), 6) AS nw_{n}, round({at} + {size} - least({at} + {size} - {least}::DOUBLE, greatest(0::DOUBLE, {at} + {d})), 6) AS nw_{m}, "
    f"{_middle(at, size, d, least)[0]} AS mid_{n}, {_middle(at, size, d, least)[1]} AS mid_{m}"
    for at, size, d, least, n, m in _AXES
)
_SIDE = "greatest(32, floor({0} * least(1::DOUBLE, 1536 / greatest(fw, fh)) / 32 + 0.5) * 32)::INT"
_SMALL = "greatest(1, floor({0} * least(1::DOUBLE, 1024 / fw, 256 / fh) + 0.5))::INT"
_LINES = "l AS (SELECT conv_id, turn, text, length(text) % 10 / 10 AS c FROM conversations WHERE text IS NOT NULL{0}), rows AS (SELECT conv_id, turn // 2 AS y, string_agg(text, ' ' ORDER BY turn) AS row, sum(c * length(text)) AS c, sum(length(text)) AS n, count(*) AS k FROM l GROUP BY 1, 2)"
SQL |= {
    # Times of these tables are hours apart and runs never short enough to be repaired, so cues are those of the runs.
    "cues_full": SQL["raw_cues"],
    "region_moves": f"WITH {_REGION} SELECT l_orderkey, l_linenumber, {_MOVES} FROM r",
    "region_sizes": f"""WITH {_REGION}, c AS (SELECT *, floor(x * fw + 0.5) AS cx, floor(y * fh + 0.5) AS cy FROM r)
      SELECT l_orderkey, l_linenumber, cx::INT AS crop_x, cy::INT AS crop_y, greatest(1, least(fw - cx, floor(w * fw + 0.5)))::INT AS crop_width, greatest(1, least(fh - cy, floor(h * fh + 0.5)))::INT AS crop_height,
      {_SIDE.format("fw")} AS det_width, {_SIDE.format("fh")} AS det_height, {_SMALL.format("fw")} AS small_width, {_SMALL.format("fh")} AS small_height,
      round(CASE WHEN x + w <= 1 + 1e-9 AND y + h <= 1 + 1e-9 THEN least(w, 1 - x) END, 6) AS kept_width, dx >= 0 AND w * fw >= 16 AND h * fh >= 8 AS large FROM c""",
    "line_boxes": f"WITH {_REGION} SELECT l_orderkey, l_linenumber, round(x + l_tax * w, 6) AS b_x, round(y + l_discount * h, 6) AS b_y, round(0.5 * w, 6) AS b_width, round(0.25 * h, 6) AS b_height FROM r",
    "pointer_modes": """WITH b AS (SELECT event_id, event_id % 3 AS button, event_id // 3 % 2 = 1 AS ctrl, event_id // 6 % 2 = 1 AS meta, event_id // 12 % 2 = 1 AS sel, event_id // 24 % 2 = 1 AS corner FROM events)
      SELECT event_id, CASE WHEN button <> 0 AND NOT (button = 2 AND ctrl) THEN NULL WHEN sel THEN 'select' WHEN ctrl OR meta THEN 'center' WHEN corner THEN 'resize' ELSE 'move' END AS mode FROM b""",
    "row_neighbours": """WITH b AS (SELECT l_orderkey AS f, l_linenumber AS i, l_partkey % 20 / 25 AS x, l_linenumber % 2 / 2 + l_tax / 10 AS y, l_quantity / 400 + 0.01::DOUBLE AS w, 0.05::DOUBLE AS h FROM """ + _ITEMS + """),
      m AS (SELECT a.f, a.i, any_value(a.x) AS x, any_value(a.w) AS w, any_value(a.h) AS h, max(CASE WHEN b.x + b.w <= a.x THEN (b.x + b.w + a.x) / 2 END) AS lo, min(CASE WHEN b.x >= a.x + a.w THEN (a.x + a.w + b.x) / 2 END) AS hi
        FROM b a LEFT JOIN b ON a.f = b.f AND a.i <> b.i AND abs((a.y + a.h / 2) - (b.y + b.h / 2)) <= least(a.h, b.h) / 2 GROUP BY 1, 2),
      c AS (SELECT *, greatest(0::DOUBLE, coalesce(lo, 0), x - 0.35::DOUBLE * h / 2.5) AS x0, least(1::DOUBLE, coalesce(hi, 1), x + w + 0.35::DOUBLE * h / 2.5) AS x1 FROM m),
      s AS (SELECT *, least(2048, greatest(8, ceil(48 * ((x1 - x0) * 2.5 / h)))) AS cw FROM c)
      SELECT f AS frame_id, i AS box_id, round(x0, 6) AS crop_x, round(x1 - x0, 6) AS crop_width, cw::BIGINT AS content_width, greatest(320, ceil(cw / 32) * 32)::BIGINT AS input_width FROM s""",
    "item_times": """WITH b AS (SELECT *, l_quantity * 100 - 200 AS a, (l_partkey % 3000)::DOUBLE AS z, floor(l_extendedprice + 0.5) AS d FROM lineitem), c AS (SELECT *, a >= 0 AND d - z > a AS good FROM b)
      SELECT l_orderkey, l_linenumber, round(l_partkey / l_quantity * 1000 - 40, 6) AS pts, round(l_suppkey / 1000, 6) AS ms, CASE WHEN good THEN a END AS "start", CASE WHEN good THEN d - z END AS "end",
      round(CASE WHEN l_quantity > 25 THEN l_quantity - 25 WHEN l_linenumber > 3 THEN (l_linenumber - 3) * 1000::DOUBLE ELSE 1 END, 6) AS length FROM c""",
    "item_states": """WITH b AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'partial' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'partial' END AS before FROM orders),
      c AS (SELECT *, before IN ('failed', 'partial') AND p LIKE '1%' AS again FROM b), d AS (SELECT *, CASE WHEN again THEN 'waiting' ELSE before END AS status FROM c)
      SELECT o_orderkey, before, status, round(CASE WHEN again THEN 0::DOUBLE ELSE k % 7 / 7 END, 6) AS progress, k % 4 = 0 AND status = 'waiting' AS runs,
      concat_ws(' | ', CASE status WHEN 'waiting' THEN 'waiting' WHEN 'completed' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'stopped, partly done' END, p, CASE WHEN before = 'failed' THEN 'e' END) AS label FROM d""",
    "review_totals": f"SELECT text, count(*) AS cues, count(*) FILTER (needs_review) AS to_review FROM ({SQL['raw_cues']}) GROUP BY 1",
    "counter_totals": "SELECT user_id, event_type AS key, sum(event_id % 10)::BIGINT AS n FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, 'all', count(*) FROM events GROUP BY 1",
    "queue_additions": """WITH o AS (SELECT page_id AS id, page_id AS arrival, 'Ep ' || page_id % 50 AS n, page_id % 50 AS k, page_id % 5 <> 0 AS video FROM pages), a AS (SELECT * FROM o UNION ALL SELECT id, arrival + 10000000, n, k, video FROM o WHERE id % 3 = 0),
      m AS (SELECT *, CASE WHEN NOT video THEN 'ignored' WHEN id % 7 = 0 OR row_number() OVER (PARTITION BY id ORDER BY arrival) > 1 THEN 'duplicate' ELSE 'added' END AS outcome FROM a)
      SELECT arrival, outcome, CASE WHEN outcome = 'added' THEN row_number() OVER (PARTITION BY outcome ORDER BY length(k::VARCHAR), k, arrival) END AS place FROM m""",
    "import_cases": """SELECT l_orderkey || '-' || l_linenumber AS video_id, CASE l_partkey % 12 WHEN 0 THEN 'format' WHEN 11 THEN 'format' WHEN 1 THEN 'version' WHEN 2 THEN 'cue fields' WHEN 3 THEN 'cue times' WHEN 4 THEN 'cue text' WHEN 5 THEN 'cue overlap'
      WHEN 6 THEN 'clipped text flag' WHEN 7 THEN 'colour filter' WHEN 8 THEN 'region' WHEN 9 THEN 'times or dimensions' END AS error, CASE WHEN l_partkey % 12 = 10 THEN 2 END::INT AS cues FROM """ + _ITEMS,
    "word_lists": r"""WITH w AS (SELECT doc_id, len(string_split(regexp_replace(replace(replace(text, chr(13), ''), ' ', chr(10)), '\s+$', ''), chr(10))) + 2 AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n BETWEEN 10 AND 100000 THEN n END::INT AS words FROM w""",
    "scan_ends": f"WITH {OBS} SELECT video_id, round(least({END}::DOUBLE, max(time) + 10800000), 4) AS processed_end, '#' || printf('%02x%02x%02x', video_id % 256, video_id % 200, video_id % 100) AS color FROM obs WHERE ord % 2 = 0 GROUP BY 1",
    "line_assembly": f"WITH {_LINES.format('')} SELECT conv_id, string_agg(row, chr(10) ORDER BY y) AS text, round(CASE WHEN sum(n) > 0 THEN sum(c) / sum(n) ELSE 0 END, 6) AS confidence FROM rows GROUP BY 1",
    "confident_lines": f"""WITH {_LINES.format(" AND text <> '' AND length(text) % 10 / 10 >= 0.5")}, f AS (SELECT conv_id, string_agg(row, chr(10) ORDER BY y) AS text, sum(c) / sum(n) AS c, sum(k) AS k FROM rows GROUP BY 1)
      SELECT a.conv_id, coalesce(f.text, '') AS text, round(coalesce(f.c, 0), 6) AS confidence, coalesce(f.k, 0)::INT AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE text IS NOT NULL) a LEFT JOIN f ON a.conv_id = f.conv_id""",
    "color_mask": """WITH p AS (SELECT vec_id, i, list_transform(range(4), lambda k: floor(least(255::DOUBLE, abs(embedding[4 * i + k + 1]::DOUBLE) * 1020))) AS v FROM embeddings, range(16) r(i)),
      m AS (SELECT vec_id, i, v[4] <> 0 AND abs(v[1] - 128) <= 100 AND abs(v[2] - 128) <= 100 AND abs(v[3] - 128) <= 100 AS hit FROM p)
      SELECT vec_id, string_agg(CASE WHEN hit THEN '01' ELSE '00' END, '' ORDER BY i) AS mask, count(*) FILTER (hit)::INT AS n FROM m GROUP BY 1""",
    # No name of these tables has a number in brackets, so numbering within a stem is exact.
    "available_names": r"""WITH b AS (SELECT page_id AS ord, regexp_replace(regexp_replace(regexp_replace(string_split(url, '/')[4], '\.[^.]*$', ''), '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') AS s FROM pages),
      n AS (SELECT ord, CASE WHEN s = '' THEN 'episode' ELSE s END AS s FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY ord) AS k FROM n)
      SELECT ord, fmt, s || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.' || fmt AS file FROM k, (VALUES ('srt'), ('vtt')) f(fmt)""",
    "crop_queue": """WITH RECURSIVE q AS (SELECT p_brand AS s, p_partkey AS ord, p_size * 40 * 400 * 4 AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
      f AS (SELECT s, ord, n, 0::BIGINT AS batch, size::BIGINT AS held, 1 AS k FROM q WHERE n = 1 UNION ALL
        SELECT q.s, q.ord, q.n, f.batch + CASE WHEN full_ THEN 1 ELSE 0 END, CASE WHEN full_ THEN q.size ELSE held + q.size END, CASE WHEN full_ THEN 1 ELSE k + 1 END
        FROM (SELECT *, f.k >= 8 OR f.held >= 16777216 OR f.held + (SELECT any_value(z.size) FROM q z WHERE z.s = f.s AND z.n = f.n + 1) > 16777216 AS full_ FROM f) f JOIN q ON q.s = f.s AND q.n = f.n + 1)
      SELECT s AS scan_id, ord, batch FROM f""",
    "gate_state": f"""WITH RECURSIVE q AS (SELECT user_id AS s, event_id AS ord, (epoch_us(ts) - {EPOCH_US}) / 36000000.0::DOUBLE AS time, event_type = 'view' AS hit, value > 480 AS found, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT s, ord, time, n, false AS skipped, NOT hit AND NOT found AS sure, CASE WHEN hit THEN NULL ELSE time END AS probed, NOT hit AND found AS off FROM q WHERE n = 1 UNION ALL
        SELECT s, ord, time, n, skip, CASE WHEN skip THEN sure WHEN hit THEN false ELSE NOT found END, CASE WHEN skip OR hit THEN probed ELSE time END, off OR (NOT skip AND NOT hit AND found)
        FROM (SELECT q.*, f.sure, f.probed, f.off, coalesce(NOT f.off AND NOT q.hit AND f.sure AND 0 < q.time - f.probed AND q.time - f.probed < 1000, false) AS skip FROM f JOIN q ON q.s = f.s AND q.n = f.n + 1))
      SELECT s AS scan_id, ord, round(time, 6) AS time, skipped FROM f""",
}

SQL |= {
    "decode_ends": "SELECT l_orderkey, l_linenumber, l_partkey AS dts FROM lineitem WHERE l_partkey <= 1100",
    "edit_offsets": f"""WITH b AS (SELECT l_orderkey AS t, l_linenumber AS o, l_partkey AS d, l_partkey % 3 = 0 AS media, l_quantity * 10 AS m, l_partkey % 35 = 0 AS fast FROM {_ITEMS}),
      w AS (SELECT *, max(CASE WHEN media THEN o END) OVER (PARTITION BY t) AS k FROM b)
      SELECT t AS track_id, CASE WHEN count(*) FILTER (media) > 1 OR bool_or(fast) THEN NULL WHEN NOT bool_or(media) THEN 0::DOUBLE
      ELSE round(coalesce(sum(d / 600::DOUBLE * 1000) FILTER (NOT media AND o < k), 0) - max(m) FILTER (media), 6) END AS offset_ms FROM w GROUP BY 1""",
    "edit_checks": "SELECT l_orderkey, l_linenumber, l_quantity >= 5 AND l_quantity - 5 < l_linenumber * 8 AND l_linenumber * 8 <= l_partkey % 60 AS valid FROM lineitem",
    "model_checks": "SELECT page_id::VARCHAR AS name, (page_id % 2 = 0 AND html IS NOT NULL OR coalesce(html = '', false)) AND strlen(html) <= 6000 AS valid FROM pages",
    "queue_limit": """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
      SELECT doc_id AS arrival, CASE WHEN n > 700 THEN 'refused' ELSE 'added' END AS outcome, CASE WHEN n <= 700 THEN n END AS place FROM n""",
    "item_settings": "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_acctbal > 0 THEN c_mktsegment WHEN c_nationkey % 2 = 0 THEN 'shared' END AS settings FROM customer",
    "project_notes": "SELECT c_custkey AS video_id, c_mktsegment <> 'BUILDING' AS other_name, abs(c_acctbal - 1000) > 1000 AS other_duration FROM customer",
}
