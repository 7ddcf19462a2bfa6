"""Queues of items: fingerprints, order, settings, ranges, states, batches and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as s
from ..functions.text import natural_key, supported_video

HEAD = 32768


def fingerprint(content: Column) -> Column:
    """SHA-256 of the first 32 KiB and what there is of the last 32 KiB after them, of binary content."""
    size = F.octet_length(content)
    tail_at = F.greatest(F.lit(HEAD), size - HEAD)
    return F.sha2(F.concat(F.substring(content, 1, HEAD), F.when(size > HEAD, content.substr(tail_at + 1, F.lit(HEAD))).otherwise(F.lit(b""))), 256)


def item_key(name: Column, size: Column, modified: Column, digest: Column) -> Column:
    return F.to_json(F.array(name, size.cast("string"), modified.cast("string"), digest))


def add_items(existing: DataFrame, arriving: DataFrame, limit: int | None = s.MAX_ITEMS) -> DataFrame:
    """Arriving items marked: `ignored` if no video, `duplicate` if their key is in the queue or came before, else `added`, with a place
    after the queue's, in natural order of their paths. From the first video on that meets a queue of `limit` items, all are `refused`.
    Both have key; arriving also name, path and arrival."""
    rows = arriving.join(existing.select("key").distinct().withColumn("known", F.lit(True)), "key", "left")
    rows = rows.withColumn("video", supported_video("name"))
    first = F.row_number().over(Window.partitionBy("key", "video").orderBy("arrival"))
    mark = F.when(~F.col("video"), "ignored").when(F.col("known") | (first > 1), "duplicate").otherwise("added")
    rows = rows.withColumn("outcome", mark)
    if limit is not None:
        seen = Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = (F.col("outcome") == "added").cast("int")
        rows = rows.join(F.broadcast(existing.agg(F.count("*").alias("held")))).withColumn("full", F.col("video") & (F.col("held") + F.sum(own).over(seen) - own >= limit))
        rows = rows.withColumn("outcome", F.when(F.max("full").over(seen), "refused").otherwise(F.col("outcome"))).drop("held", "full")
    place = F.row_number().over(Window.partitionBy("outcome").orderBy(*natural_order("path"), "arrival"))
    return rows.withColumn("place", F.when(F.col("outcome") == "added", place)).drop("known", "video")


def natural_order(column: str) -> list[Column]:
    """Runs of digits as numbers, the rest as Chinese readers sort it, letters alike in either case and with or without accents."""
    return [F.collate(natural_key(column), "zh_CI_AI")]


def natural_sort(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("natural_key", natural_key(column)).orderBy(*natural_order(column), column)


def effective_settings(items: DataFrame, shared: DataFrame) -> DataFrame:
    """An item's own settings where it has any, else the shared ones; shared is one row."""
    return items.join(F.broadcast(shared.limit(1).select(F.col("settings").alias("shared"))), how="left").withColumn("settings", F.coalesce("settings", "shared")).drop("shared")


def switch_settings(items: DataFrame, shared: DataFrame, which: Column, own: bool) -> DataFrame:
    """Items told by `which` get settings of their own, a copy of the shared ones unless they have some, or go back to the shared ones."""
    picked = F.coalesce(which, F.lit(False))
    if not own:
        return items.withColumn("settings", F.when(~picked, F.col("settings")))
    rows = items.join(F.broadcast(shared.limit(1).select(F.col("settings").alias("shared"))), how="left")
    return rows.withColumn("settings", F.when(picked, F.coalesce("settings", "shared")).otherwise(F.col("settings"))).drop("shared")


def apply_to_all(items: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items without settings of their own, and the chosen settings (one row) as the shared ones."""
    return items.withColumn("settings", F.lit(None).cast(items.schema["settings"].dataType)), chosen.limit(1).select("settings")


def item_status(error: Column, aborted: Column, complete: Column) -> Column:
    """Status after a run: a stop leaves it partial, an error failed, else complete or partial."""
    return F.when(aborted, "partial").when(error.isNotNull(), "failed").when(complete, "completed").otherwise("partial")


def retry(items: DataFrame, which: Column | None = None) -> DataFrame:
    again = F.col("status").isin("failed", "partial") & (F.lit(True) if which is None else which)
    return items.withColumns({"status": F.when(again, "waiting").otherwise(F.col("status")), "progress": F.when(again, F.lit(0.0)).otherwise(F.col("progress"))})


def remove(items: DataFrame, which: Column) -> DataFrame:
    return items.where(~F.coalesce(which, F.lit(False)))


def clear_completed(items: DataFrame) -> DataFrame:
    return remove(items, F.col("status") == "completed")


def select_all(items: DataFrame, on: bool = True) -> DataFrame:
    return items.withColumn("selected", F.lit(on))


def move(items: DataFrame, item_id: str, step: int) -> DataFrame:
    """Swap an item with the one before (step -1) or after it (1) in place; at an end nothing changes."""
    w = Window.orderBy("place")
    rows = items.withColumns({"other_id": (F.lag if step < 0 else F.lead)("id").over(w), "other_place": (F.lag if step < 0 else F.lead)("place").over(w)})
    me = rows.where(F.col("id") == item_id).select(F.col("id").alias("a"), F.col("place").alias("pa"), F.col("other_id").alias("b"), F.col("other_place").alias("pb")).where("b IS NOT NULL")
    rows = rows.join(F.broadcast(me), (F.col("id") == F.col("a")) | (F.col("id") == F.col("b")), "left")
    place = F.when(F.col("id") == F.col("a"), F.col("pb")).when(F.col("id") == F.col("b"), F.col("pa")).otherwise(F.col("place"))
    return rows.withColumn("place", place).select(items.columns)


def run_queue(items: Iterable[dict], execute: Callable[[dict], dict], save: Callable[[dict], None], stopped: Callable[[], bool] = lambda: False, between: Callable[[], None] = lambda: None) -> list[dict]:
    """Run the waiting and selected items one after another. A failure stays with its item; what is complete, or has at least a cue, is
    saved, and a failure to save keeps the result. A stop leaves the item it met partial and the rest waiting."""
    out, first = [], True
    for item in items:
        item = dict(item)
        out.append(item)
        if item.get("status") != "waiting" or not item.get("selected", True) or stopped():
            continue
        if not first:
            between()
        first, item["status"] = False, "running"
        try:
            item["result"] = execute(item)
            complete = bool(item["result"].get("complete"))
            item["status"] = "completed" if complete and not stopped() else "partial"
            item["progress"] = 1.0 if item["status"] == "completed" else item.get("progress", 0.0)
        except Exception as error:  # noqa: BLE001 - any failure belongs to its item
            item["status"], item["error"] = ("partial" if stopped() else "failed"), str(error)
            item["result"] = getattr(error, "partial", None)
            complete = False
        result = item.get("result")
        if result and (complete or result.get("cues")):
            try:
                save(item)
            except Exception as error:  # noqa: BLE001
                item["output_error"] = str(error)
    return out


def queue_totals(items: DataFrame, *by: str) -> DataFrame:
    """Counts of completed and failed items, mean progress (completed counts as 1), and how many are selected: all, some or none."""
    progress = F.when(F.col("status") == "completed", 1.0).otherwise(F.coalesce("progress", F.lit(0.0)))
    picked = F.coalesce("selected", F.lit(False))
    return items.groupBy(*by).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(progress).alias("progress"),
        F.when(F.every(picked), "all").when(F.some(picked), "some").otherwise("none").alias("selection"),
    )


def review_counts(cues: DataFrame, *by: str) -> DataFrame:
    return cues.groupBy(*by).agg(F.count("*").alias("cues"), F.count_if("needs_review").alias("to_review"))


def stage_metrics(timings: DataFrame, *by: str) -> DataFrame:
    """Calls, total, largest and mean time of each stage; times that are missing, infinite or negative don't count."""
    ms = F.col("ms").cast("double")
    return timings.where(ms.isNotNull() & ~F.isnan(ms) & (ms >= 0) & (ms < float("inf"))).groupBy(*by, "stage").agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("mean_ms"))


def counter_totals(counters: DataFrame, *by: str) -> DataFrame:
    """Sums by key of rows with a map of counters."""
    return counters.select(*by, F.explode("counts").alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))


def pair_batches(jobs: DataFrame, by: str, size: int = s.PAIR) -> DataFrame:
    """Jobs of equal shape (width, height) in batches of `size` by idx; batches come in the order in which shapes were first seen."""
    shape = [by, "width", "height"]
    rows = jobs.withColumns({"k": F.floor((F.row_number().over(Window.partitionBy(*shape).orderBy("idx")) - 1) / size), "seen": F.min("idx").over(Window.partitionBy(*shape))})
    return rows.withColumn("batch", F.dense_rank().over(Window.partitionBy(by).orderBy("seen", "k")) - 1).drop("k", "seen")
