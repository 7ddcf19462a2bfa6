"""Text, time, geometry, names, project files and kernels on the values that define them."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import geometry as g
from tidemark.functions import kernels as k
from tidemark.functions import python_text as pt
from tidemark.functions import text as t
from tidemark.functions import time as ti
from tidemark.operators import jobs, state
from tidemark.sources import project, sinks


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(n) for n, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("01:02:03.4", 3723400.0), ("02:03,045", 123045.0), ("600", 600000.0), ("12:65", None), ("-1", None), (" 1.5 ", 1500.0), ("", None)])
def test_parse_time(spark, text, want):
    assert one(spark, ti.parse_time(F.lit(text))) == want


@pytest.mark.parametrize("ms,want", [(3723400.4, "01:02:03.400"), (-5.0, "00:00:00.000"), (360_000_000.0, "100:00:00.000"), (0.5, "00:00:00.001")])
def test_format_time(spark, ms, want):
    assert one(spark, ti.format_time(F.lit(ms))) == want


def test_range_and_duration(spark):
    assert one(spark, ti.batch_range(F.lit(1000.0), F.lit(100.0), F.lit(200.0))).asDict() == {"start": 100.0, "end": 800.0}
    assert one(spark, ti.batch_range(F.lit(1000.0), F.lit(900.0), F.lit(200.0))) is None
    assert one(spark, ti.timeline_duration(F.lit(0.0), F.lit(2.0))) == 2000.0
    assert one(spark, ti.cue_preview_target(F.lit(0.0), F.lit(100.0), F.lit(40.0), F.lit(40.0))).asDict() == {"time": 60.0, "frame_time": 40.0}
    assert one(spark, ti.cue_preview_target(F.lit(0.0), F.lit(100.0), F.lit(140.0))).asDict() == {"time": 50.0, "frame_time": None}


PAIRS = [("他不是一个", "他不星一个"), ("ＡＢＣ！", "abc"), ("", "。"), ("abcdef", "abcf"), ("abc", "abcd"), ("a\nbcd", "abcd"), ("xyz", ""), ("一分价钱", "-分价钱"), ("一分价钱一", "—分价钱一")]


def test_columns_and_python_agree(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    rows = df.select("a", "b", t.normalize_text("a").alias("n"), t.similarity("a", "b").alias("s"), t.is_partial_read("a", "b").alias("p"), t.related_read("a", "b").alias("r"), t.leading_stroke_confusion("a", "b").alias("c")).collect()
    for r in rows:
        assert r.n == pt.normalize(r.a)
        assert r.s == pytest.approx(pt.similarity(r.a, r.b))
        assert (r.p, r.r, r.c) == (pt.partial(r.a, r.b), pt.related(r.a, r.b), pt.stroke(r.a, r.b))


def test_names(spark):
    assert one(spark, t.export_stem(F.lit('a<b>:"c".x.mp4'))) == "a_b___c_.x"
    assert one(spark, t.export_stem(F.lit("..."))) == "episode"
    long = one(spark, t.export_stem(F.lit("字" * 100 + ".mp4")))
    assert len(long.encode()) == 180
    used = set()
    assert [sinks.available_name("ep", "srt", used) for _ in range(3)] == ["ep.srt", "ep (2).srt", "ep (3).srt"]
    df = spark.createDataFrame([(0, "Ep.mp4"), (1, "ep.mov"), (2, "ep (2).mp4"), (3, "x.mp4")], "ord long, name string")
    assert [r.file for r in sinks.export_names(df).orderBy("ord").collect()] == ["Ep.srt", "ep (2).srt", "ep (2) (2).srt", "x.srt"]


def test_names_of_a_frequent_stem_are_spread(spark):
    """All items have one name: each gets its place, and no task has most of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sinks.export_names(spark.range(2000).select(F.col("id").alias("ord"), F.lit("Ep.mp4").alias("name")), ("srt", "vtt"))
        rows = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for fmt in ("srt", "vtt"):
        assert {r.ord: r.file for r in rows if r.fmt == fmt} == {k: f"Ep ({k + 1}).{fmt}" if k else f"Ep.{fmt}" for k in range(2000)}
    assert max(Counter(r.task for r in rows).values()) < 0.75 * len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_names_as_in_turn(spark, monkeypatch, seed):
    """Literal and given numbers of several depths against naming one item after the other."""
    rng = random.Random(seed)
    monkeypatch.setattr(sinks, "RUN", (4, 16, 1 << 16, 4)[seed])
    stems = ["ep", "Ep", "x", "x (2)", "x (02)", "y (2)", "y (3)", "z", "z (2) (2)", "(2)", "ep (99999999999999999999)", "ep (3) (2) (2)", "ep (2) (2) (3)"]
    stems = rng.sample(stems, 8) + ["ep"] * (2 * seed) + [f"ep ({k})" for k in range(9)] + [f"EP (2) ({k})" for k in range(1, 5)]
    items = [(1000 * rng.randrange(-5, 50) + k, rng.choice(stems)) for k in range(120)]
    used: set[str] = set()
    want = {ord: sinks.available_name(stem, "srt", used) for ord, stem in sorted(items)}
    rows = spark.createDataFrame([(ord, f"{stem}.mp4") for ord, stem in items], "ord long, name string")
    assert {r.ord: r.file for r in sinks.export_names(rows).collect()} == want


def test_names_of_items_without_one(spark):
    rows = spark.createDataFrame([(0, None), (1, "a.mp4"), (2, None), (3, "A.mov")], "ord long, name string")
    assert {r.ord: r.file for r in sinks.export_names(rows).collect()} == {0: None, 1: "a.srt", 2: None, 3: "A (2).srt"}
    assert sinks.export_names(rows.limit(0)).collect() == []


def test_natural_order_and_filters(spark):
    df = spark.createDataFrame([("第10集",), ("第2集",), ("第1集",)], "name string")
    assert [r.name for r in jobs.natural_sort(df, "name").collect()] == ["第1集", "第2集", "第10集"]
    assert one(spark, t.supported_video(F.lit("A.MP4"))) and not one(spark, t.supported_video(F.lit("a.mp3")))
    assert one(spark, t.parse_color_filter(F.lit("#FFaa00"), F.lit(60), F.lit(False))).asDict() == {"color": "#ffaa00", "tolerance": 60, "outline": False}
    assert one(spark, t.parse_color_filter(F.lit("#fff"), F.lit(60), F.lit(False))) is None
    assert one(spark, t.hex_color(F.lit(255), F.lit(1), F.lit(16))) == "#ff0110"


def test_subtitle_files(spark):
    cues = spark.createDataFrame([("v", 0, 1230, 3560, "你 <我> & 他\n\n第二行")], "video_id string, ord long, start long, end long, text string")
    assert sinks.subtitles(cues, "srt").first().content == "1\n00:00:01,230 --> 00:00:03,560\n你 <我> & 他\n第二行\n"
    assert sinks.subtitles(cues, "vtt").first().content == "WEBVTT\n\n1\n00:00:01.230 --> 00:00:03.560\n你 &lt;我&gt; &amp; 他\n第二行\n"
    none = spark.createDataFrame([("w",)], "video_id string")
    assert sinks.subtitles(cues.where("false"), "vtt", none).first().content == "WEBVTT\n\n\n"
    assert sinks.subtitles(cues.where("false"), "srt", none).first().content == "\n"
    with pytest.raises(ValueError):
        sinks.subtitles(cues.union(cues), "srt")


def valid():
    cue = {"id": "1", "start": 0, "end": 10.5, "text": "a\nb", "lines": [], "confidence": 0.9, "sampleTime": 1}
    return {"schemaVersion": 1, "timeUnit": "ms", "source": {"name": "x", "duration": 100, "width": 10, "height": 10}, "extraction": {"region": {"x": 0, "y": 0, "width": 1, "height": 1}, "start": 0, "end": 100, "sampleInterval": 250, "backend": "b", "model": "m", "complete": True}, "cues": [cue]}


def broken(path, value):
    p = valid()
    at = p
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    return p


def test_project_import(spark):
    cases = [
        ("ok", json.dumps(valid()), None),
        ("no json", "{", "format"),
        ("list", "[1]", "format"),
        ("unit", json.dumps(broken(["timeUnit"], "s")), "version"),
        ("cue", json.dumps(broken(["cues", 0, "start"], "0")), "cue fields"),
        ("order", json.dumps(broken(["cues", 0, "end"], 0)), "cue times"),
        ("blank", json.dumps(broken(["cues", 0, "text"], " ")), "cue text"),
        ("flag", json.dumps(broken(["extraction", "ignoreClippedText"], "true")), "clipped text flag"),
        ("colour", json.dumps(broken(["extraction", "colorFilter"], {"color": "#fff", "tolerance": 1, "outline": False})), "colour filter"),
        ("region", json.dumps(broken(["extraction", "region", "x"], 0.8)), "region"),
        ("times", json.dumps(broken(["extraction", "sampleInterval"], 0)), "times or dimensions"),
    ]
    got = {r.video_id: r for r in project.import_projects(spark.createDataFrame([c[:2] for c in cases], "video_id string, raw string")).collect()}
    assert {v: r.error for v, r in got.items()} == {c[0]: c[2] for c in cases}
    assert got["ok"].project.cues[0].lines == ["a", "b"] and got["ok"].project.cues[0].needsReview is False
    again = sinks.contents(spark.createDataFrame([got["ok"]], project.import_projects(spark.createDataFrame([], "video_id string, raw string")).schema), "json")
    assert json.loads(again.first().content)["cues"][0]["text"] == "a\nb"


def test_archive():
    import io
    import zipfile
    import zlib

    assert zlib.crc32(b"123456789") == 0xCBF43926
    z = zipfile.ZipFile(io.BytesIO(sinks.zip_bytes([("名.srt", b"x")])))
    assert z.namelist() == ["名.srt"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_queue():
    def execute(item):
        if item["id"] == "b":
            raise ValueError("broken")
        return {"complete": True, "cues": []}

    saved = []
    done = jobs.run_queue([{"id": i, "status": "waiting"} for i in "abc"], execute, lambda i: saved.append(i["id"]))
    assert [d["status"] for d in done] == ["completed", "failed", "completed"] and saved == ["a", "c"]


def test_queue_edits(spark):
    df = spark.createDataFrame([("a", 1, "failed", 0.5), ("b", 2, "completed", 1.0), ("c", 3, "waiting", 0.0)], "id string, place int, status string, progress double")
    assert {r.id: r.place for r in jobs.move(df, "c", -1).collect()} == {"a": 1, "b": 3, "c": 2}
    assert {r.id: r.place for r in jobs.move(df, "c", 1).collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r.id: r.status for r in jobs.retry(df).collect()} == {"a": "waiting", "b": "completed", "c": "waiting"}
    assert jobs.clear_completed(df).count() == 2
    arriving = spark.createDataFrame([("k1", "a.mp4", "第10集/a.mp4", 0), ("k2", "b.mp4", "第2集/b.mp4", 1), ("k1", "c.mp4", "c.mp4", 2), ("k3", "d.txt", "d.txt", 3), ("k0", "e.mp4", "e.mp4", 4)], "key string, name string, path string, arrival int")
    got = {r.arrival: (r.outcome, r.place) for r in jobs.add_items(spark.createDataFrame([("k0",)], "key string"), arriving).collect()}
    assert got == {0: ("added", 2), 1: ("added", 1), 2: ("duplicate", None), 3: ("ignored", None), 4: ("duplicate", None)}


def test_geometry(spark):
    r = F.struct(*(F.lit(v).alias(n) for n, v in (("x", 0.1), ("y", 0.8), ("width", 0.8), ("height", 0.15))))
    moved = one(spark, g.move_region(r, F.lit(0.5), F.lit(0.5)))
    assert (moved.x, moved.y) == (pytest.approx(0.2), pytest.approx(0.85))
    assert one(spark, g.move_region(r, F.lit(0.005), F.lit(0.0), 0.01)).x == pytest.approx(0.1)
    small = one(spark, g.resize_region(r, "se", F.lit(-5.0), F.lit(-5.0), 0.1, 0.05))
    assert (small.x, small.width, small.height) == (0.1, pytest.approx(0.1), pytest.approx(0.05))
    wide = one(spark, g.resize_from_center(r, F.lit(1.0), F.lit(0.0), 0.1, 0.05))
    assert (wide.x, wide.width) == (pytest.approx(0.0), pytest.approx(1.0))
    assert one(spark, g.crop_rectangle(r, F.lit(100), F.lit(50))).asDict() == {"x": 10, "y": 40, "width": 80, "height": 8}
    assert one(spark, g.detector_size(F.lit(3072), F.lit(100))).asDict() == {"width": 1536, "height": 64}


def test_ctc():
    labels, words = [0, 1, 1, 0, 1, 2], ["", "哈", "！"]
    p = np.full((6, 3), 0.025)
    p[np.arange(6), labels] = 0.95
    text, confidence, tokens = k.decode_ctc(p.ravel(), [1, 6, 3], words)
    assert (text, tokens) == ("哈哈！", [("哈", 1, 3), ("哈", 4, 5), ("！", 5, 6)]) and confidence == pytest.approx(0.95)
    with pytest.raises(ValueError):
        k.decode_ctc(p.ravel(), [1, 6, 3], words[:2])


def test_boxes():
    box = lambda *v: dict(zip(("x", "y", "width", "height"), map(float, v), strict=True))
    assert k.merge_boxes([box(200, 930, 230, 60), box(400, 935, 50, 50)]) == [box(200, 930, 250, 60)]
    p = np.zeros((64, 160))
    p[20:40, 10:80] = 0.9
    p[0:10, 100:150] = 0.9
    found = k.text_candidates(p)
    assert [f["clipped"] for f in found] == [True, False]
    kept, left_out = k.detect_boxes(p, 160, 64, True, np.zeros((64, 160, 4), np.uint8))
    assert len(kept) == 1 and left_out == 1


def flood(mask, corners):
    seen, count, out = set(), 0, np.zeros(mask.shape, int)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        count += 1
        todo = [(y, x)]
        seen.add((y, x))
        while todo:
            cy, cx = todo.pop()
            out[cy, cx] = count
            for a, b in steps:
                n = (cy + a, cx + b)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in seen:
                    seen.add(n)
                    todo.append(n)
    return out, count


@pytest.mark.parametrize("corners", [False, True])
def test_components_against_flood_fill(corners):
    rng = np.random.default_rng(0)
    for density in (0.1, 0.4, 0.6, 0.9):
        for _ in range(10):
            mask = rng.random((rng.integers(1, 20), rng.integers(1, 20))) < density
            a, n = k.components(mask, corners)
            b, m = flood(mask, corners)
            assert n == m and (a == b).all()


def test_color_mask():
    px = np.array([[[195, 255, 195, 255], [194, 255, 255, 255], [255, 255, 255, 0]]], np.uint8)
    mask, count = k.color_mask(px, "#ffffff", 60, False)
    assert mask.ravel().tolist() == [1, 0, 0] and count == 1


def picture(shift=0, edit=False):
    px = np.zeros((64, 512, 4), np.uint8)
    px[:, :, 3] = 255
    for n in range(16):
        x = 20 + n * 28 + shift
        px[20:38, x : x + 3, :3] = 255
        px[20:23, x : x + 18, :3] = 255
        px[35:38, x : x + 18, :3] = 255
        if edit and n == 5:
            px[20:38, x + 15 : x + 18, :3] = 255
    return k.stroke_signature(px)[0]


def test_strokes_and_reuse():
    a = picture()
    assert k.same_strokes(a, picture(1)) and not k.same_strokes(a, picture(3)) and not k.same_strokes(a, picture(edit=True))
    calls = []

    def infer(which):
        calls.append(list(which))
        return [{"text": "t", "confidence": 0.95 - 0.01 * w, "lines": [{"text": "t", "confidence": 0.95, "box": {"x": 0.03, "y": 0.25, "width": 0.9, "height": 0.4}}]} for w in which]

    reuse = state.FrameReuse()
    reuse.reset("s")
    values, sources, reused = reuse.recognize([a] * 4, [0.0, 250.0, 500.0, 750.0], infer)
    assert calls == [[0, 1]] and sources == [0.0, 250.0, 0.0, 0.0] and reused == [False, False, True, True]
    reuse.recognize([a], [3000.0], infer)
    assert calls[1:] == [[0]]


def test_gate():
    gate = state.EmptyGate()
    assert not gate.can_skip(0, 0)
    gate.observe(0, 0, "")
    assert gate.can_skip(0, 999) and not gate.can_skip(0, 1000) and not gate.can_skip(0, 0) and not gate.can_skip(1, 500)
    gate.observe(1, 100, "x")
    assert not gate.can_skip(0, 200)
    gate.observe(0, 300, "x")
    gate.observe(0, 400, "")
    assert gate.disabled and not gate.can_skip(0, 500)


def test_batches_and_fallback():
    assert state.group_jobs(range(5), [320, 640, 320, 320, 640].__getitem__) == [[0, 2], [3], [1, 4]]
    tried = []

    def infer(jobs_):
        tried.append(len(jobs_))
        if len(jobs_) > 1:
            raise ValueError("no batches")
        return [j * 2 for j in jobs_]

    runner = state.CompatibleRunner(infer)
    assert runner.run([1, 2]) == [2, 4] and runner.run([3, 4]) == [6, 8] and tried == [2, 1, 1, 1, 1]


def test_lines_in_reading_order():
    line = lambda text, x, y: {"text": text, "confidence": 0.5 if text == "a" else 1.0, "box": {"x": x, "y": y, "width": 1, "height": 10}}
    assert k.assemble_lines([line("b", 5, 1), line("a", 0, 2), line("ccc", 0, 20)]) == ("a b\nccc", pytest.approx(0.9))
    assert k.assemble_lines([]) == ("", 0.0)


def test_edge_tokens_and_spaces():
    tokens = [(c, n * 4, n * 4 + 2) for n, c in enumerate("中文字幕吗")]
    columns = np.full(200, 30)
    columns[150:] = 0
    assert [x for x, _, _ in k.filter_edge_tokens(tokens, columns, 200, 40, 20, 200)] == list("中文字幕")
    assert k.filter_edge_tokens(tokens[:3], columns, 200, 40, 20, 200) == tokens[:3]
    apart = [("中", 0, 2), ("文", 4, 6), ("字", 12, 14)]
    ink = np.zeros(200)
    ink[0:60] = ink[120:150] = 5
    assert k.restore_spaces("中文字", apart, ink, np.full(40, 9), 200, 40, 20, 200) == "中文 字"


def test_dictionary_and_constants(spark):
    words = one(spark, project.dictionary(F.lit("﻿a\r\nb\nc\nd\ne\nf\ng\nh\n\n")))
    assert words == ["", *"abcdefgh", " "]
    assert schema.REVIEW_BELOW == 0.88


def test_natural_order_of_accents_and_case(spark):
    df = spark.createDataFrame([("é 10",), ("E 9",), ("e 2",), ("f 1",), ("d 3",)], "name string")
    assert [r.name for r in jobs.natural_sort(df, "name").collect()] == ["d 3", "e 2", "E 9", "é 10", "f 1"]


def test_a_full_queue_refuses(spark):
    names = ["a.mp4", "b.txt", "b.mp4", "a.mp4", "c.mp4", "d.txt", "e.mp4"]
    arriving = spark.createDataFrame([(n, n, n, k) for k, n in enumerate(names)], "key string, name string, path string, arrival int")
    have = spark.createDataFrame([("k0",)], "key string")
    got = [r.outcome for r in jobs.add_items(have, arriving, 3).orderBy("arrival").collect()]
    assert got == ["added", "ignored", "added", "refused", "refused", "refused", "refused"]
    assert [r.outcome for r in jobs.add_items(have, arriving).orderBy("arrival").collect()] == ["added", "ignored", "added", "duplicate", "added", "ignored", "added"]


def test_settings_of_items(spark):
    items = spark.createDataFrame([(1, "own"), (2, None), (3, None)], "id int, settings string")
    shared = spark.createDataFrame([("all",)], "settings string")
    listed = lambda df: [r.settings for r in df.orderBy("id").collect()]
    assert listed(jobs.switch_settings(items, shared, F.col("id") < 3, True)) == ["own", "all", None]
    assert listed(jobs.switch_settings(items, shared, F.col("id") < 3, False)) == [None] * 3
    cleared, now = jobs.apply_to_all(items, items.where("id = 1").select("settings"))
    assert listed(cleared) == [None] * 3 and [r.settings for r in now.collect()] == ["own"]


def test_chosen_models(spark):
    files = spark.createDataFrame([("detector", 200_000_000), ("dictionary", 2_000_001)], "name string, bytes long")
    assert {r.name: r.fault for r in project.model_faults(files).collect()} == {"detector": None, "recogniser": "missing", "dictionary": "too large"}


def test_videos_of_a_folder(spark, tmp_path):
    root = tmp_path / ".home's" / "in"
    for name in ("a.MP4", "s 1/b.mov", "s 1/.c.mp4", ".s/d.mp4", "e.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    got = project.video_files(spark, str(root)).collect()
    assert sorted((r.name, r.relative, r.length) for r in got) == [("a.MP4", "a.MP4", 1), ("b.mov", "s 1/b.mov", 1)]
