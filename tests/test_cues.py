"""Golden intervals, and a sequential model against the distributed form on random scans."""

import random

import pytest

from tidemark.functions import python_text
from tidemark.operators import cues, intervals, sampling, state

SCHEMA = "video_id string, ord long, time double, text string, confidence double, lines array<struct<text:string,confidence:double,box:struct<x:double,y:double,width:double,height:double>,spacing_inferred:boolean,edge_filtered:boolean>>, ocr_time double"


def obs(spark, rows, video="v"):
    made = []
    for k, r in enumerate(rows):
        time, text, *more = r
        lines = [("t", 1.0, None, False, True)] if len(more) > 1 and more[1] else []
        made.append((video, k, float(time), text, more[0] if more else 0.96, lines, None))
    return spark.createDataFrame(made, SCHEMA)


def build(spark, rows, a, b, i=250.0):
    return cues.build_cues(obs(spark, rows), float(a), float(b), i).orderBy("start").collect()


def test_blanks_part_repeats(spark):
    got = build(spark, [(0, ""), (250, "出发"), (500, "出发"), (750, ""), (1000, "出发"), (1250, "")], 0, 1500)
    assert [(c.start, c.end, c.text) for c in got] == [(125, 625, "出发"), (875, 1125, "出发")]
    assert [c.id for c in got] == ["cue-0001", "cue-0002"]


def test_punctuation_consensus(spark):
    got = build(spark, [(0, "去北京"), (250, "去南京"), (500, "去南京。"), (750, "去南京")], 0, 1000)
    assert [c.text for c in got] == ["去北京", "去南京"] and got[1].needs_review


def test_dense_samples_do_not_outvote(spark):
    rows = [(0, "他不是一个"), (250, "他不是一个"), (500, "他不是一个"), *((600 + k, "他不是") for k in range(100)), (750, "他不是一个"), (1000, "他不是一个")]
    got = build(spark, rows, 0, 1250)
    assert [c.text for c in got] == ["他不是一个"] and got[0].needs_review


def test_sustained_changes_stay(spark):
    texts = ["他不是", "他不是一个", "他不是一个男主", "他不是一个女主"]
    got = build(spark, [(250 * k, texts[k // 2]) for k in range(8)], 0, 2000)
    assert [c.text for c in got] == texts


def test_prefix_does_not_bridge(spark):
    got = build(spark, [(0, "他不是一个"), (250, "他不是一个"), (500, "他不是一个"), (540, "他不是"), (580, "他不是别人"), (830, "他不是别人")], 0, 1000)
    assert len(got) == 2


def test_short_cue_is_kept(spark):
    got = build(spark, [(0, ""), (40, "好"), (80, "好"), (120, ""), (160, "他不是一个"), (410, "他不是一个")], 0, 600)
    assert [c.text for c in got] == ["好", "他不是一个"] and got[0].needs_review


def test_substitution_is_repaired(spark):
    got = build(spark, [(0, "他不是一个"), (250, "他不是一个"), (500, "他不是一个"), (540, "他不星一个", 0.8), (580, "他不是一个"), (830, "他不是一个")], 0, 1000)
    assert [c.text for c in got] == ["他不是一个"]


def test_leading_dash(spark):
    rows = [(44700 + 250 * k, "一分价钱一分货") for k in range(3)] + [(45380, "-分价钱一分货"), (45600, "-分价钱一分货"), (45700, "一分价钱一分货"), (45890, "一分价钱一分货")]
    got = build(spark, rows, 44700, 45960)
    assert [(c.start, c.end, c.needs_review) for c in got] == [(44700, 45960, True)] and got[0].text == "一分价钱一分货"


def test_edge_filtered_flag(spark):
    got = build(spark, [(29100, "你好吗", 0.98, True), (29500, "你好吗", 0.98), (29740, "你好吗", 1.0), (29990, "你好吗", 1.0)], 29100, 30180)
    assert [(c.start, c.end, c.sample_time, c.needs_review) for c in got] == [(29100, 30180, 29740.0, True)]


def model(rows, a, b, i):
    """The whole computation for one video by rewriting a list of runs, each the list of its observations (start, end, text, confidence)."""
    text_of = python_text.normalize
    rows = sorted((r for r in rows if a <= r[0] < b), key=lambda r: r[0])
    obs = []
    for k, (t, text, conf) in enumerate(rows):
        prev, nxt = (rows[k - 1][0] if k else None), (rows[k + 1][0] if k + 1 < len(rows) else None)
        gap = prev is not None and t - prev > 2.5 * i
        start = max(a, (prev + t) / 2 if prev is not None and not gap else t - i / 2)
        end = min(b, b if nxt is None else t + i / 2 if nxt - t > 2.5 * i else (t + nxt) / 2)
        obs.append((start, end, text, conf, gap))

    def text(run):
        weight = {}
        for x in run:
            weight[x[2]] = weight.get(x[2], 0) + max(0.1, x[3]) * max(0.0, x[1] - x[0])
        best = max(round(w, 9) for w in weight.values())
        return next(t for t, w in weight.items() if round(w, 9) == best)

    length = lambda run: sum(max(0.0, x[1] - x[0]) for x in run)
    equal = lambda x, y: text_of(text(x)) == text_of(text(y)) and text(x).count("\n") == text(y).count("\n")
    meets = lambda x, y: x[-1][1] == y[0][0]

    def part(x, y):
        x, y = text_of(text(x)), text_of(text(y))
        rest = iter(y)
        return 3 <= len(x) < len(y) and len(x) >= 0.6 * len(y) and len(y) - len(x) <= max(2, len(y) // 4) and all(c in rest for c in x)

    def alike(x, y):
        p, q = text_of(text(x)), text_of(text(y))
        d = {(j, 0): j for j in range(len(p) + 1)} | {(0, j): j for j in range(len(q) + 1)}
        for j in range(1, len(p) + 1):
            for k in range(1, len(q) + 1):
                d[j, k] = min(d[j - 1, k] + 1, d[j, k - 1] + 1, d[j - 1, k - 1] + (p[j - 1] != q[k - 1]))
        return part(x, y) or part(y, x) or (not p and not q) or (p and q and 1 - d[len(p), len(q)] / max(len(p), len(q)) >= 0.8)

    runs = []
    for x in obs:
        if runs and not x[4] and equal(runs[-1], [x]):
            runs[-1].append(x)
        else:
            runs.append([x])
    k = 1
    while k < len(runs) - 1:
        x, y, z = runs[k - 1 : k + 2]
        if meets(x, y) and meets(y, z) and text(y) and text(x) and length(y) <= 180 and equal(x, z) and alike(x, y):
            runs[k - 1 : k + 2] = [x + y + z]
        else:
            k += 1
    k = 0
    while k < len(runs):
        x, y, z = runs[k - 1] if k else None, runs[k], runs[k + 1] if k + 1 < len(runs) else None
        if x and text(x) and text(y) and meets(x, y) and (equal(x, y) or (length(y) <= 180 and part(y, x))):
            runs[k - 1 : k + 1] = [x + y]
        elif z and text(y) and text(z) and meets(y, z) and length(y) <= 180 and part(y, z):
            runs[k : k + 2] = [y + z]
            if x and text(x) and meets(x, y + z) and equal(x, y + z):
                runs[k - 1 : k + 1] = [x + y + z]
            else:
                k += 1
        else:
            k += 1
    k = 1
    while k < len(runs):
        if meets(runs[k - 1], runs[k]) and equal(runs[k - 1], runs[k]):
            runs[k - 1 : k + 1] = [runs[k - 1] + runs[k]]
        else:
            k += 1
    out = [(r[0][0], r[-1][1], text(r), sum(x[3] * max(0.0, x[1] - x[0]) for x in r), length(r)) for r in runs]
    return [(int(x + 0.5), int(y + 0.5), t, round(c / d, 6) if d else None) for x, y, t, c, d in out if t and y > x]


def test_random_scans_match_sequential_model(spark):
    rng, rows, want = random.Random(5), [], {}
    words = ["", "abcde", "abcd", "abxde", "abcde.", "zz", "abcdefgh", "。"]
    for v in range(120):
        t, own = 0.0, []
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([40.0, 60.0, 100.0, 250.0, 250.0, 900.0])
            own.append((t, rng.choice(words), rng.choice([0.5, 0.9, 0.96, 1.0])))
        rows += [(str(v), k, *r, [], None) for k, r in enumerate(own)]
        want[str(v)] = model(own, 100.0, t + 100, 250.0) if v % 2 else model(own, 0.0, 6000.0, 250.0)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for c in cues.build_cues(df.where("video_id % 2 = 0"), 0.0, 6000.0, 250.0).orderBy("start").collect():
        got.setdefault(c.video_id, []).append((c.start, c.end, c.text, round(c.confidence, 6)))
    assert got == {k: v for k, v in want.items() if int(k) % 2 == 0 and v}


def test_confident_lines(spark):
    """Unsure and empty lines go; a frame without a sure line is blank, and so parts repeats."""
    box = lambda x, y: (x, y, 0.1, 0.1)
    line = lambda t, c, x=0.1, y=0.1: (t, c, box(x, y), False, False)
    rows = [("v", 0, 0.0, "x", 0.5, [line("b", 0.9, 0.5), line("a", 0.75), line("zz", 0.74), line("", 0.99)], None), ("v", 1, 250.0, "x", 0.5, [line("a b", 0.7)], None), ("v", 2, 500.0, "x", 0.5, None, None)]
    got = cues.keep_confident(spark.createDataFrame(rows, SCHEMA)).orderBy("ord").collect()
    assert [(r.text, round(r.confidence, 3), len(r.lines)) for r in got] == [("a b", 0.825, 2), ("", 0.0, 0), ("", 0.0, 0)]


def test_sampling_windows_golden(spark):
    frames = spark.createDataFrame([("v", k, k * 40.0) for k in range(20)], "video_id string, ord long, time double")
    windows = spark.createDataFrame([(0, 13.0, 174.0, 50.0), (1, 217.0, 378.0, 50.0), (2, 417.0, 618.0, 50.0)], "range_id int, start double, end double, interval double")
    want = [40, 80, 120, 240, 280, 320, 440, 480, 520, 600]
    assert [r.time for r in sampling.sample_windows(frames, windows).orderBy("time").collect()] == want
    keep, sampling.BROADCAST_WINDOWS = sampling.BROADCAST_WINDOWS, 0
    try:
        assert [r.time for r in sampling.sample_windows(frames, windows).orderBy("time").collect()] == want
    finally:
        sampling.BROADCAST_WINDOWS = keep
    assert sampling.window_faults(windows).count() == 0


def test_tumbling_matches_sequential_rule(spark):
    rng = random.Random(1)
    rows, want = [], []
    for v in range(40):
        t, nxt = rng.uniform(-20, 5), 10.0
        for k in range(60):
            t += rng.choice([7.0, 13.0, 39.995, 40.0, 50.0, 110.0])
            rows.append((str(v), k, t))
            if t + 0.01 >= nxt and t < 900:
                want.append((str(v), k))
                nxt = 10.0 + ((t - 10.0) // 50.0 + 1) * 50.0
    got = sampling.sample_tumbling(spark.createDataFrame(rows, "video_id string, ord long, time double"), 10.0, 900.0, 50.0)
    assert sorted((r.video_id, r.ord) for r in got.collect()) == sorted(want)


def test_reorder_margin(spark):
    schema = "video_id string, idx int, dts long, cts long, timescale long"
    rows = [("a", 0, 0, 0, 1000), ("a", 1, 40, 120, 1000), ("a", 2, 80, 40, 1000), ("a", 3, 120, 80, 1000), ("b", 0, 40, 40, 1000), ("b", 1, 0, 0, 1000), ("c", 0, 0, 0, 0)]
    got = {r.video_id: r.margin_ms for r in sampling.reorder_margin(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": 40.0, "b": None, "c": None}


def test_validation_order(spark):
    rows = [("a", 0, 0.0, 100.0, "x"), ("a", 1, 90.0, 200.0, "y"), ("b", 0, 5.0, 5.0, "x"), ("c", 0, 0.0, 1.0, "　"), ("d", 0, 0.0, 1.0, "x"), ("e", 0, float("nan"), 1.0, "x")]
    got = {r.video_id: r.code for r in intervals.validate_cues(spark.createDataFrame(rows, "video_id string, ord long, start double, end double, text string")).collect()}
    assert got == {"a": 3, "b": 1, "c": 2, "e": 1}


def test_lookup_first_and_last(spark):
    cs = spark.createDataFrame([("v", 0, 0.0, 10.0), ("v", 1, 5.0, 20.0), ("v", 2, 30.0, 30.0)], "video_id string, ord long, start double, end double")
    pts = spark.createDataFrame([("v", k, t) for k, t in enumerate([0.0, 6.0, 10.0, 20.0, 30.5])], "video_id string, point_id int, time double")
    first = {r.point_id: r.cue_ord for r in intervals.playing_cue(pts, cs, 7.0).collect()}
    last = {r.point_id: r.cue_ord for r in intervals.timeline_cue_at(pts, cs, 100.0, 100.0, 7.0).collect()}
    assert first == {0: 0, 1: 0, 2: 1, 3: None, 4: None}
    assert last == {0: 0, 1: 1, 2: 1, 3: None, 4: 2}


@pytest.mark.parametrize("limit,want", [(8, [[0, 1, 2]]), (2, [[0, 1], [2]])])
def test_crop_batches(spark, limit, want):
    df = spark.createDataFrame([("s", k, 100, 50) for k in range(3)], "scan_id string, ord long, width int, height int")
    got = {}
    for r in state.crop_batches(df, limit).orderBy("ord").collect():
        got.setdefault(r.batch, []).append(r.ord)
    assert [got[k] for k in sorted(got)] == want
