"""Windows, reuse, gate and whole extractions with small models that read what a picture's corner pixel says."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tidemark import schema
from tidemark.operators import recognition as r

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = ["", "a", "b", "c", "d"]


def picture(word, strokes=True, color=(255, 255, 255), size=(64, 128)):
    """Black with light bars, of which the word tells one that lacks, and its number in the blue of the corner pixel."""
    p = np.zeros((*size, 4), np.uint8)
    p[:, :, 3] = 255
    if strokes:
        for x in (x for x in range(40, 90, 8) if x != 40 + 8 * word):
            p[26:38, x : x + 5, :3] = color
    p[:4, :4, 2] = 50 * word
    return p


class Fake:
    """The detector finds the middle of a frame with bars; the recogniser needs the frame's word, which the detector noted."""

    def __init__(self, most=8):
        self.calls, self.most, self.words = [], most, []

    def detector(self, x):
        self.calls.append(("d", len(x)))
        if len(x) > self.most:
            raise RuntimeError("too many")
        out = np.zeros((len(x), 1, *x.shape[2:]))
        for k, one in enumerate(x):
            if one[0, 26:38, 40:90].max() > 1:
                out[k, 0, 24:40, 36:92] = 0.9
                self.words.append(int(round((one[0, 1, 1] * 0.225 + 0.406) * 255 / 50)))
        return out

    def recogniser(self, x):
        self.calls.append(("r", len(x)))
        out = np.zeros((len(x), 4, len(WORDS)))
        out[:, :, 0] = 0.1
        for k in range(len(x)):
            out[k, 1, self.words.pop(0) if self.words else 1] = 0.95
        return out

    def models(self):
        return r.Models(self.detector, self.recogniser, WORDS)


def frames(*words, step=100.0, **more):
    return [r.Frame(k, k * step, picture(w or 0, bool(w), **more)) for k, w in enumerate(words)]


def scan_of(fake, some, options, **more):
    scan = r.Scan(r.Reader(fake.models(), options), "s", **more)
    for f in some:
        scan.take(f)
    scan.finish()
    return scan


def test_window_gives_results_in_order():
    fake = Fake()
    engine = r.Recogniser(fake.models(), r.Options())
    got = engine.window([f.pixels for f in frames(1, 0, 3)])
    assert [x["text"] for x in got] == ["a", "", "c"] and [len(x["lines"]) for x in got] == [1, 0, 1]
    assert fake.calls == [("d", 2), ("d", 1), ("r", 2)]
    assert engine.counts == {"detector_calls": 2, "detector_pairs": 1, "recogniser_calls": 1, "recogniser_pairs": 1} and not engine.fallback


def test_unsure_lines_go():
    got = r.Recogniser(Fake().models(), r.Options(confidence=0.96)).window([picture(1)])
    assert got == [{"text": "", "confidence": 0.0, "lines": [], "ignored": 0}]


def test_pairs_that_fail_are_run_alone():
    fake = Fake(most=1)
    engine = r.Recogniser(fake.models(), r.Options())
    assert [x["text"] for x in engine.window([f.pixels for f in frames(0, 2)])] == ["", "b"]
    assert engine.fallback and engine.window([picture(4)])[0]["text"] == "d"


@pytest.mark.parametrize("some", [[], [picture(1)] * 9, [picture(1, size=(1500, 1500))] * 2])
def test_windows_have_limits(some):
    with pytest.raises(ValueError):
        r.Recogniser(Fake().models(), r.Options()).window(some)


def test_wrong_outputs_are_errors():
    models = Fake().models()
    with pytest.raises(ValueError):
        r.Recogniser(models._replace(detector=lambda x: np.zeros((len(x), 2, 4, 4))), r.Options()).window([picture(1)])
    r.check_models(models)
    with pytest.raises(ValueError):
        r.check_models(models._replace(dictionary=WORDS[:3]))


def test_boxes_get_context_up_to_their_neighbours():
    box = lambda x, y: {"x": x, "y": y, "width": 0.2, "height": 0.2}
    a, b, c = r.with_context([box(0.0, 0.1), box(0.25, 0.1), box(0.5, 0.7)], 2.0)
    assert (a["x"], a["width"]) == (0.0, pytest.approx(0.225)) and b["x"] == pytest.approx(0.225)
    assert c["x"] == pytest.approx(0.465) and c["width"] == pytest.approx(0.27) and r.with_context([], 1.0) == []


def test_drawing():
    p = picture(2)
    assert r.drawn(p, r.WHOLE, 128, 64) is p
    assert (r.drawn(np.full((3, 5, 4), 77, np.uint8), {"x": 0.1, "y": 0.2, "width": 0.7, "height": 0.5}, 11, 7) == 77).all()
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 4, 2)
    assert abs(int(r.drawn(ramp, r.WHOLE, 50, 1)[0, 20, 0]) - 81) <= 1


def test_reuse_within_a_scope():
    fake = Fake()
    scan = scan_of(fake, frames(1, 1, 1, 1, 1), r.Options())
    assert [x["text"] for x in scan.drain()] == ["a"] * 5
    assert scan.reader.counts == {"read": 2, "reused": 3}
    assert scan_of(Fake(), frames(1, 1, 1, 1, 1), r.Options(reuse=False)).reader.counts == {"read": 5}


WHITE = ("#ffffff", 10, False)


def test_gate_passes_over_empty_frames_and_parts_the_scan():
    fake = Fake()
    scan = scan_of(fake, frames(1, 1, 0, 0, 0, 1, 1), r.Options(color=WHITE))
    got = scan.drain()
    assert [x["text"] for x in got] == ["a", "a", "", "", "", "a", "a"]
    assert [x["skipped"] for x in got] == [False, False, False, True, True, False, False]
    assert scan.stretch == 3 and scan.reader.counts["read"] == 5
    assert not any(x["skipped"] for x in scan_of(Fake(), frames(1, 0, 0), r.Options(color=WHITE), phase="refine").drain())


def test_text_of_another_colour_shuts_the_gate():
    some = [r.Frame(k, 100.0 * k, picture(2, color=(0, 0, 250))) for k in range(3)]
    scan = scan_of(Fake(), some, r.Options(color=WHITE))
    assert [x["text"] for x in scan.drain()] == ["b"] * 3 and scan.gate.disabled


def test_a_window_that_was_read_is_kept_when_stopped():
    fake = Fake()
    scan = r.Scan(r.Reader(fake.models(), r.Options(reuse=False)), "s", stopped=lambda: bool(fake.calls))
    some = frames(*[1] * 9)
    with pytest.raises(r.Stopped):
        for f in some:
            scan.take(f)
    assert [x["ord"] for x in scan.drain()] == list(range(8))


def rows_of(video, some):
    return [(video, f.ord, f.time, f.pixels.shape[1], f.pixels.shape[0], bytearray(f.pixels.tobytes())) for f in some]


FRAMES = "video_id string, ord long, time double, width int, height int, rgba binary"


def test_scans_over_batches(spark):
    words = [1, 1, 0, 0, 2, 2, 2, 3, 0, 0, 4, 1] * 2
    rows = [x for v in "xy" for x in rows_of(v, frames(*words))]
    options = r.Options(color=WHITE)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = r.read_scans(spark.createDataFrame(rows, FRAMES), lambda: Fake().models(), options).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(x["ord"], x["text"], x["skipped"], x["reused"]) for x in scan_of(Fake(), frames(*words), options).drain()]
    for v in "xy":
        assert [(x.ord, x.text, x.skipped, x.reused) for x in got if x.video_id == v] == want
    assert r.read_scans(spark.createDataFrame([], FRAMES), lambda: Fake().models()).count() == 0


def test_extraction_refines_where_texts_change(spark):
    words = [1] * 26 + [2] * 24
    seen, cues = r.extract(spark.createDataFrame(rows_of("v", frames(*words, step=50.0)), FRAMES), lambda: Fake().models(), r.Options(), 0.0, 2500.0, 500.0)
    times = sorted(x.time for x in seen.collect())
    assert times == [0.0, 500.0, 1000.0, *[1000.0 + 50 * k for k in range(1, 10)], 1500.0, 2000.0]
    got = [(c.start, c.end, c.text) for c in cues.orderBy("start").collect()]
    assert got == [(0, 1275, "a"), (1275, 2500, "b")]
    assert set(schema.OBSERVATION.names) <= set(seen.columns)
