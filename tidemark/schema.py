"""Types of the data model and the constants of its semantics, in one place."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


D, S, B, I, L = DoubleType(), StringType(), BooleanType(), IntegerType(), LongType()

REGION = _struct(x=D, y=D, width=D, height=D)
LINE = _struct(text=S, confidence=D, box=REGION, spacing_inferred=B, edge_filtered=B)
OBSERVATION = _struct(video_id=S, ord=L, time=D, text=S, confidence=D, lines=ArrayType(LINE), ocr_time=D)
CUE = _struct(id=S, start=L, end=L, text=S, lines=ArrayType(S), confidence=D, needs_review=B, sample_time=D, box=REGION)
COLOR_FILTER = _struct(color=S, tolerance=I, outline=B)
PROJECT_CUE = _struct(id=S, start=D, end=D, text=S, lines=ArrayType(S), confidence=D, needsReview=B, sampleTime=D, box=REGION)
PROJECT = _struct(
    schemaVersion=I,
    timeUnit=S,
    source=_struct(name=S, duration=D, width=D, height=D),
    extraction=_struct(region=REGION, start=D, end=D, sampleInterval=D, backend=S, model=S, complete=B, ignoreClippedText=B, colorFilter=COLOR_FILTER),
    cues=ArrayType(PROJECT_CUE),
)
FRAME_INDEX = _struct(video_id=S, idx=I, dts=L, cts=L, timescale=L, is_sync=B, offset=L, size=L, duration=L)
MOVIE = _struct(video_id=S, error=S, codec=S, width=I, height=I, timescale=L, offset_ms=D, samples=L)
WINDOW = _struct(range_id=I, start=D, end=D, interval=D)
SIGNATURE = _struct(width=I, height=I, ink=BinaryType(), count=I)
SETTINGS = _struct(region=REGION, interval=D, confidence=D, batch=B, deduplicate=B, refine=B, ignoreClippedText=B, startOffset=D, endTrim=D)
TOKEN = _struct(text=S, start=I, end=I)

#: Times in milliseconds.
FLICKER_MS = 180.0
GAP_INTERVALS = 2.5
RELATED = 0.8
PARTIAL_RATIO, PARTIAL_SHARE, PARTIAL_LEAST, PARTIAL_LENGTH = 0.6, 0.25, 2, 3
STROKE_MS, STROKE_SIDE_MS, STROKE_TIMES = 600.0, 250.0, 2.0
REVIEW_BELOW = 0.88
VOTE_FLOOR = 0.1
DEFAULT_REGION = (0.1, 0.82, 0.8, 0.15)
DEFAULT_CONFIDENCE = 0.75
REUSE_MS, GATE_MS = 1500.0, 1000.0
WINDOW_FRAMES, WINDOW_BYTES = 8, 16 << 20
PAIR, SINGLE_PIXELS = 2, 512 << 10
REFINE_MS, SAMPLE_EPS_MS = 50.0, 0.01
SAMPLE_INTERVALS_MS = (500.0, 250.0, 100.0)
MAX_ITEMS, MAX_CUES, MAX_PROJECT_BYTES, MAX_ZIP_ENTRIES, MAX_ZIP_BYTES = 1000, 100_000, 20_000_000, 65_535, 96 << 20
