"""Reading frames with models that the caller brings: windows of frames, reuse, the gate for empty pictures, and whole extractions.

A model is a function from a stack of input tensors to a stack of outputs, whatever runs it. `Scan` is the state machine of one scan;
`read_scans` runs it over sorted Arrow batches, so a scan may be of any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .. import schema as s
from ..functions import kernels as k
from . import cues, sampling
from .state import CompatibleRunner, EmptyGate, FrameReuse, Result, group_jobs

#: Height of the recogniser's input, its width and that of its content, the detector's side, the raster of signatures.
READ_HEIGHT, READ_LEAST, CONTENT_LEAST, CONTENT_MOST, DETECT_SIDE, SIGNATURE_WIDTH, SIGNATURE_HEIGHT = 48, 320, 8, 2048, 1536, 1024, 256
STEP, CONTEXT = 32, 0.35


class Models(NamedTuple):
    """detector: N x 3 x H x W to N x 1 x H x W; recogniser: N x 3 x 48 x W to N x steps x classes, those of the dictionary (blank first)."""

    detector: Callable[[np.ndarray], np.ndarray]
    recogniser: Callable[[np.ndarray], np.ndarray]
    dictionary: list[str]


class Options(NamedTuple):
    """color: colour, tolerance and outline of the text; a scan with it passes over frames without a pixel of it."""

    confidence: float = s.DEFAULT_CONFIDENCE
    batch: bool = True
    reuse: bool = True
    ignore_clipped: bool = False
    color: tuple[str, int, bool] | None = None


class Frame(NamedTuple):
    ord: int
    time: float
    pixels: np.ndarray


class Job(NamedTuple):
    """An input of a model: the size of its picture, and what of which frame is drawn there, how wide."""

    frame: int
    width: int
    height: int
    box: dict
    content: int


WHOLE = {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}


def drawn(pixels: np.ndarray, box: dict, width: int, height: int) -> np.ndarray:
    """A box of a raster (in fractions of it) at another size, with values between pixels by their distance."""

    def places(start: float, length: float, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(start * size + (np.arange(n) + 0.5) * (length * size / n) - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    if box == WHOLE and pixels.shape[:2] == (height, width):
        return pixels
    y0, y1, fy = places(box["y"], box["height"], pixels.shape[0], height)
    x0, x1, fx = places(box["x"], box["width"], pixels.shape[1], width)
    fx, fy = fx[None, :, None], fy[:, None, None]
    rows = lambda y: pixels[y][:, x0] * (1 - fx) + pixels[y][:, x1] * fx
    return np.floor(rows(y0) * (1 - fy) + rows(y1) * fy + 0.5).astype(np.uint8)


def side(length: float) -> int:
    """A multiple of 32, the nearest one, at least one of them."""
    return max(STEP, math.floor(length / STEP + 0.5) * STEP)


def signature(pixels: np.ndarray) -> np.ndarray:
    """Strokes of a frame, made smaller if it is larger than the raster for signatures."""
    height, width = pixels.shape[:2]
    scale = min(1.0, SIGNATURE_WIDTH / width, SIGNATURE_HEIGHT / height)
    size = [max(1, math.floor(n * scale + 0.5)) for n in (width, height)]
    return k.stroke_signature(drawn(pixels, WHOLE, *size))[0]


def with_context(boxes: list[dict], aspect: float) -> list[dict]:
    """Boxes widened by 0.35 of their height to both sides (aspect is width / height of the frame), but not past the middle between them
    and the next box on their row, nor the frame."""
    if not boxes:
        return []
    x, y, w, h = (np.array([b[n] for b in boxes]) for n in ("x", "y", "width", "height"))
    middle = y + h / 2
    row = np.abs(middle[:, None] - middle) <= np.minimum(h[:, None], h) / 2
    np.fill_diagonal(row, False)
    half = (x[:, None] + x + w) / 2
    before = np.where(row & (x + w <= x[:, None]), half, 0.0).max(1)
    half = (x[:, None] + w[:, None] + x) / 2
    after = np.where(row & (x >= (x + w)[:, None]), half, 1.0).min(1)
    pad = CONTEXT * h / aspect
    left, right = np.maximum(np.clip(x - pad, 0, 1), before), np.minimum(np.clip(x + w + pad, 0, 1), after)
    return [b | {"x": float(a), "width": float(z - a)} for b, a, z in zip(boxes, left, right, strict=True)]


class Recogniser:
    """Results of windows of frames: text, confidence, sure lines in reading order, and how many boxes were left out as cut by an edge.

    All detections of a window come first, by shape in pairs, then all recognitions. A pair that a model can't take is run one by one, and so
    are all after it (`fallback`). Only the pictures of one call are held at a time.
    """

    def __init__(self, models: Models, options: Options):
        self.models, self.options, self.counts = models, options, Counter()
        self.detecting, self.reading = CompatibleRunner(self._detect), CompatibleRunner(self._read)
        self.frames: list[np.ndarray] = []

    @property
    def fallback(self) -> bool:
        return self.detecting.single or self.reading.single

    def window(self, frames: list[np.ndarray]) -> list[Result]:
        held = sum(f.shape[0] * f.shape[1] * 4 for f in frames)
        if not 0 < len(frames) <= s.WINDOW_FRAMES or (len(frames) > 1 and held > s.WINDOW_BYTES):
            raise ValueError(f"{len(frames)} frames of {held} bytes are no window")
        self.frames = frames
        try:
            found = self._by_shape(self.detecting, list(map(self._whole, range(len(frames)))), s.SINGLE_PIXELS)
            jobs = [job for at, (boxes, _) in enumerate(found) for job in self._crops(at, boxes)]
            lines = self._by_shape(self.reading, jobs)
        finally:
            self.frames = []
        sure = [[x for job, x in zip(jobs, lines, strict=True) if job.frame == at and x["text"] and x["confidence"] >= self.options.confidence] for at in range(len(frames))]
        made = [k.assemble_lines(own) for own in sure]
        place = lambda x: (x["box"]["y"], x["box"]["x"])
        return [{"text": text, "confidence": c, "lines": sorted(own, key=place), "ignored": cut} for (text, c), own, (_, cut) in zip(made, sure, found, strict=True)]

    def _by_shape(self, runner: CompatibleRunner, jobs: list[Job], most_pixels: float = math.inf) -> list:
        """What the runner makes of each job, in the order of the jobs."""
        out: list = [None] * len(jobs)
        pair = s.PAIR if self.options.batch else 1
        for own in group_jobs(range(len(jobs)), lambda at: jobs[at][1:3], pair):
            alone = jobs[own[0]].width * jobs[own[0]].height > most_pixels
            for some in [[at] for at in own] if alone else [own]:
                for at, value in zip(some, runner.run([jobs[at] for at in some]), strict=True):
                    out[at] = value
        return out

    def _whole(self, at: int) -> Job:
        height, width = self.frames[at].shape[:2]
        scale = min(1.0, DETECT_SIDE / max(width, height))
        wide = side(width * scale)
        return Job(at, wide, side(height * scale), WHOLE, wide)

    def _crops(self, at: int, boxes: list[dict]) -> Iterator[Job]:
        height, width = self.frames[at].shape[:2]
        for box in with_context(boxes, width / height):
            content = max(CONTENT_LEAST, min(CONTENT_MOST, math.ceil(READ_HEIGHT * box["width"] * width / (box["height"] * height))))
            yield Job(at, max(READ_LEAST, -(-content // STEP) * STEP), READ_HEIGHT, box, content)

    def _call(self, kind: str, jobs: list[Job], dims: int) -> tuple[list[np.ndarray], np.ndarray]:
        pictures = [drawn(self.frames[j.frame], j.box, j.content, j.height) for j in jobs]
        model, form = (self.models.detector, "det") if kind == "detector" else (self.models.recogniser, "rec")
        self.counts[f"{kind}_calls"] += 1
        self.counts[f"{kind}_pairs"] += len(jobs) == s.PAIR
        out = np.asarray(model(k.join_inputs([k.input_tensor(p, form, j.width) for p, j in zip(pictures, jobs, strict=True)])))
        if out.ndim != dims or len(out) != len(jobs) or (kind == "detector" and out.shape[1] != 1):
            raise ValueError(f"the {kind} gave {out.shape} for {len(jobs)} inputs")
        return pictures, out

    def _detect(self, jobs: list[Job]) -> list[tuple[list[dict], int]]:
        _, maps = self._call("detector", jobs, 4)
        found, clipped = [], self.options.ignore_clipped
        for job, (p,) in zip(jobs, maps, strict=True):
            frame = self.frames[job.frame]
            edges = drawn(frame, WHOLE, p.shape[1], p.shape[0]) if clipped else None
            found.append(k.detect_boxes(p, frame.shape[1], frame.shape[0], clipped, edges))
        return found

    def _read(self, jobs: list[Job]) -> list[dict]:
        pictures, out = self._call("recogniser", jobs, 3)
        return [self._line(job, picture, p) for job, picture, p in zip(jobs, pictures, out, strict=True)]

    def _line(self, job: Job, picture: np.ndarray, p: np.ndarray) -> dict:
        _, confidence, decoded = k.decode_ctc(p.ravel(), [1, *p.shape], self.models.dictionary)
        columns, rows = k.outlined_projection(picture, job.content)
        tokens = k.filter_edge_tokens(decoded, columns, job.width, job.height, len(p), job.content)
        plain = "".join(t for t, _, _ in tokens).strip()
        text = k.restore_spaces(plain, tokens, columns, rows, job.width, job.height, len(p), job.content)
        return {"text": text, "confidence": confidence, "box": job.box, "spacing_inferred": text != plain, "edge_filtered": len(tokens) != len(decoded)}


def check_models(models: Models) -> None:
    """Run the recogniser once on an empty input; ValueError if its output doesn't fit the dictionary. For before a long scan."""
    out = np.asarray(models.recogniser(np.zeros((1, 3, READ_HEIGHT, READ_LEAST), np.float32)))
    k.decode_ctc(out.ravel(), list(out.shape), models.dictionary)


class Reader:
    """Windows of frames read by a recogniser, or taken over from earlier frames of the same scope while their strokes stay."""

    def __init__(self, models: Models, options: Options):
        self.engine, self.options, self.memory, self.counts = Recogniser(models, options), options, FrameReuse(), Counter()

    def window(self, frames: list[Frame], scope: str, reuse: bool = True) -> list[tuple[Result, float | None, bool]]:
        """For each frame its result, the time of the read it comes from (None: its own), and whether it is taken over."""

        def infer(some: list[int]) -> list[Result]:
            self.counts["read"] += len(some)
            return self.engine.window([frames[at].pixels for at in some])

        if not (reuse and self.options.reuse):
            return [(result, None, False) for result in infer(list(range(len(frames))))]
        self.memory.reset(f"{scope}:{self.options.ignore_clipped}:{self.options.confidence}")
        out = list(zip(*self.memory.recognize([signature(f.pixels) for f in frames], [f.time for f in frames], infer), strict=True))
        self.counts["reused"] += sum(taken for _, _, taken in out)
        return out


class Stopped(Exception):
    """Raised by a scan that was told to stop; what it has read until then is kept."""


class Scan:
    """One pass over the frames of a scan in time order. Frames wait until a window is full. With a colour, in the coarse pass, a frame
    without a pixel of it ends the window and the stretch in which reads may be taken over; it is passed over if the gate allows, else read
    by itself, by the models, which tells the gate."""

    def __init__(self, reader: Reader, scan: str, phase: str = "coarse", stopped: Callable[[], bool] = lambda: False):
        self.reader, self.scan, self.phase, self.stopped = reader, scan, phase, stopped
        self.color = reader.options.color if phase == "coarse" else None
        self.most = s.WINDOW_FRAMES if reader.options.batch else 1
        self.gate, self.stretch = EmptyGate(), 0
        self.waiting: list[tuple[Frame, int | None]] = []
        self.made: list[dict] = []

    def take(self, frame: Frame) -> None:
        self._heed()
        matches = k.color_mask(frame.pixels, *self.color)[1] if self.color and not self.gate.disabled else None
        if matches == 0:
            self.finish()
            self.stretch += 1
            if self.gate.can_skip(matches, frame.time):
                self._tell(frame, {"text": "", "confidence": 0.0, "lines": [], "ignored": 0}, None, False, True)
            else:
                self._read([(frame, matches)], False)
            return
        size = frame.pixels.shape[0] * frame.pixels.shape[1] * 4
        if self.waiting and self._held() + size > s.WINDOW_BYTES:
            self.finish()
        self.waiting.append((frame, matches))
        if len(self.waiting) >= self.most or self._held() >= s.WINDOW_BYTES:
            self.finish()

    def finish(self) -> None:
        """Read what waits. A window that was read is kept even if the scan was told to stop meanwhile."""
        waiting, self.waiting = self.waiting, []
        if waiting:
            self._read(waiting, True)

    def drain(self) -> list[dict]:
        made, self.made = self.made, []
        return made

    def _heed(self) -> None:
        if self.stopped():
            raise Stopped(self.scan)

    def _held(self) -> int:
        return sum(f.pixels.shape[0] * f.pixels.shape[1] * 4 for f, _ in self.waiting)

    def _read(self, some: list[tuple[Frame, int | None]], reuse: bool) -> None:
        told = self.reader.window([f for f, _ in some], f"{self.scan}:{self.phase}:{self.stretch}", reuse)
        for (frame, matches), (result, source, taken) in zip(some, told, strict=True):
            if matches is not None:
                self.gate.observe(matches, frame.time, result["text"])
            self._tell(frame, result, source, taken, False)
        self._heed()

    def _tell(self, frame: Frame, result: Result, source: float | None, taken: bool, skipped: bool) -> None:
        self.made.append({"ord": frame.ord, "time": frame.time, "text": result["text"], "confidence": result["confidence"], "lines": result["lines"], "ocr_time": source, "ignored": result["ignored"], "reused": taken, "skipped": skipped})


def read_scans(frames: DataFrame, models: Callable[[], Models], options: Options = Options(), phase: str = "coarse") -> DataFrame:  # noqa: B008
    """Observations of frames (video_id, ord, time, width, height, rgba), in time order within each video. `models` is called once in each
    task, where they run; memory is that of a window and an Arrow batch."""
    rows = frames.select("video_id", F.col("ord").cast("long").alias("ord"), F.col("time").cast("double").alias("time"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgba")
    added = [("ord", LongType()), ("time", DoubleType()), ("text", StringType()), ("confidence", DoubleType()), ("lines", ArrayType(s.LINE)), ("ocr_time", DoubleType()), ("ignored", LongType()), ("reused", BooleanType()), ("skipped", BooleanType())]
    schema = StructType([rows.schema["video_id"], *(StructField(n, t) for n, t in added)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, video, scan = Reader(models(), options), object(), None
        told = lambda: pa.RecordBatch.from_pylist([{"video_id": video} | r for r in scan.drain()], schema=arrow)
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if scan is None or row["video_id"] != video:
                    if scan:
                        scan.finish()
                        yield told()
                    video, scan = row["video_id"], Scan(reader, str(row["video_id"]), phase)
                scan.take(Frame(row["ord"], row["time"], k.raster(row["rgba"], row["width"], row["height"])))
            if scan:
                yield told()
        if scan:
            scan.finish()
            yield told()

    return rows.repartition("video_id").sortWithinPartitions("video_id", "time", "ord").mapInArrow(run, schema)


def extract(frames: DataFrame, models: Callable[[], Models], options: Options, range_start: float, range_end: float, interval: float, refine: bool = True, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """Observations and cues of videos: a coarse pass at the interval, then one every 50 ms where neighbours differ, without the times already
    seen. `keep` holds on to what a pass has read (persist; on a cluster that loses executors, a checkpoint)."""
    seen = keep(read_scans(sampling.sample_tumbling(frames, range_start, range_end, interval), models, options))
    if refine:
        windows = sampling.as_sampling(sampling.refine_windows(seen))
        close = sampling.unseen(sampling.sample_windows(frames, windows).select(frames.columns), seen)
        seen = seen.unionByName(keep(read_scans(close, models, options, "refine")))
    return seen, cues.build_cues(seen, range_start, range_end, interval)
