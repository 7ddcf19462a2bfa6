"""Choosing frames by time: the first of each tumbling bucket, within windows, and windows where a second look pays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as s
from ..functions.text import normalize_text

#: Sampling windows up to this number are broadcast for the range join; more are joined by time bins.
BROADCAST_WINDOWS = 20_000


def _pick(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of frames with start, end and interval of their window: the first of each bucket, and one that a bucket's end reaches by less than
    the tolerance. The sequential rule (accept what has come to the next bucket, then move on) in closed form."""
    t, a, i = F.col("time"), F.col("start"), F.col("interval")
    rows = rows.where((t >= a - s.SAMPLE_EPS_MS) & (t < F.col("end"))).withColumn("bucket", F.floor((t - a) / i))
    w = Window.partitionBy(*keys, "bucket").orderBy("time")
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows.where(((F.col("bucket") >= 0) & (F.col("rank") == 1)) | (t + s.SAMPLE_EPS_MS >= a + (F.col("bucket") + 1) * i)).drop("rank")


def sample_tumbling(frames: DataFrame, start: float, end: float, interval: float) -> DataFrame:
    rows = frames.withColumns({"start": F.lit(float(start)), "end": F.lit(float(end)), "interval": F.lit(float(interval))})
    return _pick(rows, ["video_id"]).drop("start", "end", "interval")


def window_faults(windows: DataFrame) -> DataFrame:
    """The windows that break the rules, and how: no positive length or interval, or a start before the end of the one before."""
    w = Window.orderBy("range_id") if "video_id" not in windows.columns else Window.partitionBy("video_id").orderBy("range_id")
    rows = windows.withColumn("last_end", F.lag("end").over(w))
    fault = F.when(~(F.col("interval") > 0), "interval").when(~(F.col("end") > F.col("start")), "length").when(F.col("start") < F.col("last_end"), "overlap")
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").drop("last_end")


def sample_windows(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames picked in several disjoint windows, each with its own origin; a frame belongs to the first whose end lies after it.

    windows may have video_id; without, they hold for every video. Few windows are broadcast; beyond that frames and windows meet in
    bins of time, so that no side has to fit anywhere.
    """
    shared = ["video_id"] if "video_id" in windows.columns else []
    order = Window.partitionBy(*shared).orderBy("end") if shared else Window.orderBy("end")
    windows = windows.withColumn("after", F.coalesce(F.lag("end").over(order), F.lit(float("-inf"))))
    t = F.col("time")
    inside = (t >= F.col("start") - s.SAMPLE_EPS_MS) & (t < F.col("end")) & (t >= F.col("after"))
    if windows.count() <= BROADCAST_WINDOWS:
        pair = [frames[c] == windows[c] for c in shared]
        met = frames.join(F.broadcast(windows), [*pair, inside], "inner")
        met = met.select(*(frames[c] for c in frames.columns), "range_id", "start", "end", "interval")
    else:
        width = float(windows.agg(F.avg(F.col("end") - F.col("start"))).first()[0])
        cell = lambda c: F.floor(c / width)
        spread = windows.withColumn("bin", F.explode(F.sequence(cell(F.col("start") - s.SAMPLE_EPS_MS), cell(F.col("end")))))
        met = frames.withColumn("bin", cell(t)).join(spread, [*shared, "bin"]).where(inside).select(*frames.columns, "range_id", "start", "end", "interval")
    return _pick(met, ["video_id", "range_id"]).drop("start", "end", "interval")


def start_sample(index: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (video_id, target_id, target): the last key frame at or before it by place, 0 if there is none.

    Targets and frames are merged in time order and the largest place of a key frame so far is carried on, so there is no join; the
    places carried are of the frames at or before the target in time.
    """
    frames = index.select("video_id", F.lit(None).cast("long").alias("target_id"), F.col("pts").alias("at"), F.when(F.col("is_sync"), F.col("idx")).alias("place"), F.lit(0).alias("kind"))
    wanted = targets.select("video_id", F.col("target_id").cast("long"), F.col("target").alias("at"), F.lit(None).cast(index.schema["idx"].dataType).alias("place"), F.lit(1).alias("kind"))
    w = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.union(wanted).withColumn("start_idx", F.coalesce(F.max("place").over(w), F.lit(0))).where("kind = 1").select("video_id", "target_id", F.col("at").alias("target"), "start_idx")


def group_by_start(windows: DataFrame) -> DataFrame:
    """Number groups of adjacent windows that start from the same key frame."""
    w = Window.partitionBy("video_id").orderBy("range_id")
    rows = windows.withColumn("fresh", (~F.lag("start_idx").over(w).eqNullSafe(F.col("start_idx"))).cast("int"))
    return rows.withColumn("decode_group", F.sum("fresh").over(w)).drop("fresh")


def reorder_margin(index: DataFrame) -> DataFrame:
    """How far decoding order is ahead of presentation, in milliseconds: the largest dts - cts, 0 at least; null if a time is missing, a
    timescale isn't positive or decoding times go back. The delay of a watermark over decoded frames."""
    dts, cts = F.col("dts") / F.col("timescale") * 1000, F.col("cts") / F.col("timescale") * 1000
    rows = index.withColumns({"d": F.when(F.col("timescale") > 0, dts), "c": F.when(F.col("timescale") > 0, cts)})
    back = F.col("d") < F.lag("d").over(Window.partitionBy("video_id").orderBy("idx"))
    rows = rows.withColumn("bad", F.col("d").isNull() | F.col("c").isNull() | F.coalesce(back, F.lit(False)))
    return rows.groupBy("video_id").agg(F.when(~F.max("bad"), F.greatest(F.lit(0.0), F.max(F.col("d") - F.col("c")))).alias("margin_ms"))


def decode_until(index: DataFrame, last_end: float, margin_ms: float | None, offset_ms: float = 0.0) -> DataFrame:
    """The frames that have to be decoded up to the end of the last window; an unknown margin is a second."""
    dts = F.col("dts") / F.col("timescale") * 1000 + offset_ms
    return index.where(dts <= last_end + (1000.0 if margin_ms is None else margin_ms) + s.SAMPLE_EPS_MS)


def refine_windows(obs: DataFrame, nfkc: bool = True) -> DataFrame:
    """Where neighbours in time differ in normalized text, the stretch between them; stretches that touch are one."""
    w = Window.partitionBy("video_id").orderBy("time", "ord")
    rows = obs.withColumn("norm", normalize_text("text", nfkc)).withColumns({"before": F.lag("norm").over(w), "start": F.lag("time").over(w)})
    rows = rows.where("before <> norm").select("video_id", "start", F.col("time").alias("end"), "ord")
    w = Window.partitionBy("video_id").orderBy("start", "end", "ord")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(past), F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    rows = rows.groupBy("video_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start"))
    return rows.select("video_id", (n - 1).alias("range_id"), "start", "end")


def as_sampling(windows: DataFrame, interval: float = s.REFINE_MS) -> DataFrame:
    """Refinement windows for sample_windows: a millisecond longer, so that the frame at the end is seen."""
    return windows.withColumn("end", F.col("end") + 1).withColumn("interval", F.lit(float(interval)))


def unseen(frames: DataFrame, seen: DataFrame) -> DataFrame:
    """Frames whose time, to the millisecond, isn't observed yet; of several with one time, the first."""
    key = F.floor(F.col("time") + 0.5)
    rows = frames.withColumn("ms", key).join(seen.select("video_id", key.alias("ms")), ["video_id", "ms"], "left_anti")
    first = F.row_number().over(Window.partitionBy("video_id", "ms").orderBy("time", "ord"))
    return rows.withColumn("first", first).where("first = 1").drop("first", "ms")
