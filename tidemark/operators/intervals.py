"""Interval checks and lookups: which cue is at a time, which sample is near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

ERRORS = {1: "times", 2: "text", 3: "overlap"}


def cue_errors(cues: DataFrame, by: str = "video_id") -> DataFrame:
    """Each cue with the first rule it breaks, null if none: 1 times that are missing, infinite, negative or not in order, 2 blank text,
    3 a start before the end of the cue before (by start, then ord)."""
    a, b = F.col("start").cast("double"), F.col("end").cast("double")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    last = F.lag("end").over(Window.partitionBy(by).orderBy("start", "ord"))
    rows = cues.withColumn("last_end", last)
    code = F.when(~(good(a) & good(b) & (a >= 0) & (b > a)), 1).when(trim(F.coalesce(F.col("text"), F.lit(""))) == "", 2).when(a < F.col("last_end"), 3)
    return rows.withColumn("code", code).drop("last_end")


def validate_cues(cues: DataFrame, by: str = "video_id") -> DataFrame:
    """The first error of each video that has one."""
    bad = cue_errors(cues, by).where("code IS NOT NULL")
    first = F.min(F.struct("start", "ord", "code")).alias("x")
    return bad.groupBy(by).agg(first).select(by, F.col("x.code").alias("code"), F.col("x.start").alias("start"), F.col("x.ord").alias("ord"))


def edit_valid(start: Column, end: Column, duration: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= duration)


def _at(points: DataFrame, cues: DataFrame, end: Column, last: bool, bin_ms: float) -> DataFrame:
    """For each point the first or last cue (by ord) whose half-open interval holds it. Points and cues meet in bins of time, so this is
    an equality join; a cue is in as many bins as it spans."""
    cell = lambda c: F.floor(c / bin_ms)
    spread = cues.withColumn("until", end).where(F.col("until") > F.col("start"))
    spread = spread.withColumn("bin", F.explode(F.sequence(cell(F.col("start")), cell(F.col("until"))))).select("video_id", "bin", F.col("ord").alias("cue_ord"), F.col("start").alias("cue_start"), "until")
    met = points.withColumn("bin", cell(F.col("time"))).join(spread, ["video_id", "bin"]).where((F.col("cue_start") <= F.col("time")) & (F.col("time") < F.col("until")))
    pick = F.max("cue_ord") if last else F.min("cue_ord")
    found = met.groupBy("video_id", "point_id").agg(pick.alias("cue_ord"))
    return points.join(found, ["video_id", "point_id"], "left")


def timeline_cue_at(points: DataFrame, cues: DataFrame, width: float, duration: float, bin_ms: float = 60_000.0) -> DataFrame:
    """The last cue at each point of a timeline `width` pixels wide; a cue is two pixels long at least."""
    least = 2 / max(1.0, width) * duration
    return _at(points, cues, F.greatest(F.col("end"), F.col("start") + F.lit(least)), True, bin_ms)


def playing_cue(points: DataFrame, cues: DataFrame, bin_ms: float = 60_000.0) -> DataFrame:
    return _at(points, cues, F.col("end"), False, bin_ms)


def seek_sample(targets: DataFrame, samples: DataFrame, eps: float = 0.001) -> DataFrame:
    """For each target the first sample (by idx) within eps of it. Samples are put in their bin of twice eps and both neighbours, so this
    is an equality join."""
    cell = lambda c: F.floor(c / (2 * eps)).cast("long")
    near = samples.withColumn("bin", F.explode(F.array(cell(F.col("pts")) - 1, cell(F.col("pts")), cell(F.col("pts")) + 1))).select("video_id", "bin", "idx", "pts")
    met = targets.withColumn("bin", cell(F.col("time"))).join(near, ["video_id", "bin"]).where(F.abs(F.col("pts") - F.col("time")) < eps)
    found = met.groupBy("video_id", "target_id").agg(F.min("idx").alias("idx"))
    return targets.join(found, ["video_id", "target_id"], "left")


def neighbours_on_row(boxes: DataFrame) -> DataFrame:
    """Recognition crops of boxes: each widened by 0.35 of its height to both sides (aspect is width / height of the frame), but not past
    the middle between it and its neighbours on the same row, nor the frame; and the size of the model's input."""
    a, b = boxes.alias("a"), boxes.alias("b")
    mid = lambda t: F.col(f"{t}.y") + F.col(f"{t}.height") / 2
    row = (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.box_id") != F.col("b.box_id")) & (F.abs(mid("a") - mid("b")) <= F.least("a.height", "b.height") / 2)
    right_a, right_b = F.col("a.x") + F.col("a.width"), F.col("b.x") + F.col("b.width")
    met = a.join(b, row, "left").groupBy("a.frame_id", "a.box_id").agg(
        F.max(F.when(right_b <= F.col("a.x"), (right_b + F.col("a.x")) / 2)).alias("left_bound"),
        F.min(F.when(F.col("b.x") >= right_a, (right_a + F.col("b.x")) / 2)).alias("right_bound"),
    )
    rows = boxes.join(met, ["frame_id", "box_id"])
    pad = F.lit(0.35) * F.col("height") / F.col("aspect")
    x0 = F.greatest(F.lit(0.0), F.coalesce("left_bound", F.lit(0.0)), F.col("x") - pad)
    x1 = F.least(F.lit(1.0), F.coalesce("right_bound", F.lit(1.0)), F.col("x") + F.col("width") + pad)
    rows = rows.withColumns({"crop_x": x0, "crop_width": x1 - x0})
    ratio = F.col("crop_width") * F.col("aspect") / F.col("height")
    content = F.least(F.lit(2048), F.greatest(F.lit(8), F.ceil(48 * ratio)))
    return rows.withColumn("content_width", content).withColumn("input_width", F.greatest(F.lit(320), F.ceil(F.col("content_width") / 32) * 32)).drop("left_bound", "right_bound")
