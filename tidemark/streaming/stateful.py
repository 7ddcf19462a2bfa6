"""Structured Streaming forms: the gate with its state in the store, sampling with a watermark, and results while a scan goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cues import build_cues
from ..operators.state import EmptyGate

GATE_STATE = "confirmed boolean, probed double, disabled boolean, last double"
GATE_OUTPUT = "scan_id string, ord long, time double, skipped boolean"


def gate_stream(frames: DataFrame) -> DataFrame:
    """gate_frames over a stream. The state of a scan is that of its gate; rows of a micro-batch are taken in time order. A frame that
    comes late is never skipped and leaves the state alone."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        confirmed, probed, disabled, last = state.get if state.exists else (False, float("-inf"), False, float("-inf"))
        gate = EmptyGate(confirmed, probed, disabled)
        rows = pd.concat(list(batches)).sort_values(["time", "ord"])
        out = []
        for r in rows.itertuples(index=False):
            late = r.time < last
            skip = not late and gate.can_skip(r.matches, r.time)
            if not skip and not late:
                gate.observe(r.matches, r.time, r.text)
            last = max(last, r.time)
            out.append((key[0], r.ord, r.time, skip))
        state.update((gate.confirmed, gate.probed, gate.disabled, last))
        yield pd.DataFrame(out, columns=["scan_id", "ord", "time", "skipped"])

    return frames.select(F.col("scan_id").cast("string").alias("scan_id"), F.col("ord").cast("long").alias("ord"), "time", "matches", "text").groupBy("scan_id").applyInPandasWithState(step, GATE_OUTPUT, GATE_STATE, "append", GroupStateTimeout.NoTimeout)


def sample_stream(frames: DataFrame, interval_ms: int, delay_ms: int) -> DataFrame:
    """The first frame of each tumbling bucket of a stream with event time `ts`; the delay of the watermark is the reorder margin. A bucket
    is given when no frame of it can come any more."""
    bucket = F.window("ts", f"{interval_ms} milliseconds")
    return frames.withWatermark("ts", f"{delay_ms} milliseconds").groupBy("video_id", bucket).agg(F.min_by("ord", "ts").alias("ord"), F.min("ts").alias("ts")).select("video_id", F.col("window.start").alias("bucket"), "ord", "ts")


def progressive_cues(obs: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], append: Callable[[DataFrame], None], range_start: float, range_end: float, interval: float, checkpoint: str):
    """Cues of what has been seen so far, anew with each micro-batch: it is appended to a store, and cues are built of all the store has,
    up to half an interval after the last observation. Returns the started query."""

    def each(batch: DataFrame, batch_id: int) -> None:
        append(batch)
        seen = read()
        last = seen.agg(F.max("time")).first()[0]
        if last is not None:
            write(build_cues(seen, range_start, min(range_end, last + interval / 2), interval), batch_id)

    return obs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
