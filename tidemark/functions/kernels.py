"""Kernels on dense arrays, in numpy, and their column functions. Rasters are uint8 arrays of height, width, 4."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = regex.compile(r"\p{Han}")
HAN_LINE = regex.compile(r"[\p{Han}\p{P}\s]+")
HAN_SPACES = regex.compile(r"[\p{Han}\p{Zs}]+")
SPACES = regex.compile(r"\p{Zs}+")
BOX = "struct<x:double,y:double,width:double,height:double>"


def raster(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8)[: width * height * 4].reshape(height, width, 4)


def components(mask: np.ndarray, corners: bool) -> tuple[np.ndarray, int]:
    """Label the components of a boolean array from 1 on, in the order of their first pixels, and count them.

    Runs of each row are united with those of the row above that they touch (or, with corners, meet diagonally).
    """
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = list(range(len(row)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(row, np.arange(height + 1))
    reach = 1 if corners else 0
    for y in range(1, height):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(k) for k in range(len(parent))], np.int64)
    names, number = np.unique(roots, return_inverse=True)
    labels = np.zeros((height, width), np.int32)
    for k, (y, a, b) in enumerate(zip(row, start, end, strict=True)):
        labels[y, a:b] = number[k] + 1
    return labels, len(names)


def extents(labels: np.ndarray, count: int) -> np.ndarray:
    """x0, x1, y0, y1 (inclusive) and number of pixels of each component."""
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    out = np.zeros((count, 5), np.int64)
    out[:, 0] = out[:, 2] = 1 << 40
    np.minimum.at(out[:, 0], k, x)
    np.maximum.at(out[:, 1], k, x)
    np.minimum.at(out[:, 2], k, y)
    np.maximum.at(out[:, 3], k, y)
    out[:, 4] = np.bincount(k, minlength=count)
    return out


def decode_ctc(data: np.ndarray, dims: list[int], dictionary: list[str]) -> tuple[str, float, list[tuple[str, int, int]]]:
    """Text, confidence and tokens of the greedy path: the best class of each step (the first of equals); a class other than blank counts
    when the step before had another; steps that repeat it extend it."""
    if len(dims) != 3 or dims[0] != 1 or dims[2] != len(dictionary) or len(data) < dims[1] * dims[2]:
        raise ValueError(f"output {dims} does not fit a dictionary of {len(dictionary)}")
    p = np.asarray(data)[: dims[1] * dims[2]].reshape(dims[1], dims[2])
    best = p.argmax(1)
    fresh = np.flatnonzero((best != 0) & np.concatenate(([True], best[1:] != best[:-1])))
    tokens = []
    for t in fresh:
        end = t + 1
        while end < len(best) and best[end] == best[t]:
            end += 1
        tokens.append((dictionary[best[t]], int(t), int(end)))
    chance = float(min(1.0, max(0.0, p[fresh, best[fresh]].mean()))) if len(fresh) else 0.0
    return "".join(x for x, _, _ in tokens).strip(), chance, tokens


def light_strokes(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components (with corners) of light, hardly coloured pixels, and for each the edges it touches: 1 top, 2 bottom, 0 if it is too small."""
    rgb = pixels[:, :, :3].astype(np.int16)
    high, low = rgb.max(2), rgb.min(2)
    labels, count = components((pixels[:, :, 3] != 0) & (high >= 180) & (high - low <= 75), True)
    e = extents(labels, count)
    touch = (e[:, 2] <= 1) * 1 + (e[:, 3] >= len(pixels) - 2) * 2
    good = (e[:, 4] >= 8) & (e[:, 1] - e[:, 0] >= 2) & (e[:, 3] - e[:, 2] >= 2)
    return labels, np.concatenate(([0], touch * good))


def text_candidates(p: np.ndarray, pixels: np.ndarray | None = None) -> list[dict]:
    """Boxes (fractions of the map) of the components of probability 0.3 and more, widened; of each whether the text is cut by an edge. The
    first 20 by y and x."""
    height, width = p.shape
    labels, count = components(p >= 0.3, False)
    e = extents(labels, count)
    total = np.bincount(labels.ravel(), p.ravel(), minlength=count + 1)[1:]
    strokes, out = None, []
    for k in range(count):
        x0, x1, y0, y1, n = (int(v) for v in e[k])
        w, h = x1 - x0 + 1, y1 - y0 + 1
        if n < 6 or w < 3 or h < 2 or total[k] / n < 0.55:
            continue
        margin = max(2.0, w * h * 1.6 / (2 * (w + h)))
        left, right = max(0.0, x0 - margin), min(float(width), x1 + margin + 1)
        top, bottom = max(0.0, y0 - margin), min(float(height), y1 + margin + 1)
        cut, middle = y0 <= 1 or y1 >= height - 2, (y0 + y1) / 2
        if not cut and pixels is not None and not 0.4 * height <= middle <= 0.6 * height:
            strokes = strokes or light_strokes(pixels)
            near = strokes[1][np.unique(strokes[0][y0 : y1 + 1, x0 : x1 + 1])]
            cut = bool((near & (1 if middle < 0.4 * height else 2)).any())
        out.append({"x": left / width, "y": top / height, "width": (right - left) / width, "height": (bottom - top) / height, "clipped": bool(cut)})
    return sorted(out, key=lambda b: (b["y"], b["x"]))[:20]


def merge_boxes(boxes: list[dict]) -> list[dict]:
    """Join boxes on a row that nearly touch. A box that grew is held against all later ones anew; earlier ones aren't looked at again."""
    todo = [dict(b) for b in boxes]
    k = 0
    while k < len(todo):
        a, j = todo[k], k + 1
        while j < len(todo):
            b = todo[j]
            least = min(a["height"], b["height"])
            overlap = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
            gap = max(a["x"], b["x"]) - min(a["x"] + a["width"], b["x"] + b["width"])
            if overlap >= 0.6 * least and gap <= 0.5 * least:
                x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
                a.update(width=max(a["x"] + a["width"], b["x"] + b["width"]) - x, height=max(a["y"] + a["height"], b["y"] + b["height"]) - y, x=x, y=y)
                del todo[j]
                j = k + 1
            else:
                j += 1
        k += 1
    return sorted(todo, key=lambda b: (b["y"], b["x"]))


def detect_boxes(p: np.ndarray, crop_width: float, crop_height: float, ignore_clipped: bool = False, pixels: np.ndarray | None = None) -> tuple[list[dict], int]:
    """Merged text boxes as fractions of the crop, and how many were left out because a part of them is cut by an edge."""
    found = text_candidates(p, pixels if ignore_clipped else None)
    scale = {"x": crop_width, "width": crop_width, "y": crop_height, "height": crop_height}
    scaled = [{k: b[k] * scale[k] for k in scale} for b in found]
    eps, kept, left_out = 1e-6, [], 0
    for box in merge_boxes(scaled):
        inside = (b["clipped"] and s["x"] >= box["x"] - eps and s["y"] >= box["y"] - eps and s["x"] + s["width"] <= box["x"] + box["width"] + eps and s["y"] + s["height"] <= box["y"] + box["height"] + eps for b, s in zip(found, scaled, strict=True))
        if ignore_clipped and any(inside):
            left_out += 1
        else:
            kept.append({k: box[k] / scale[k] for k in scale})
    return kept, left_out


def assemble_lines(lines: list[dict]) -> tuple[str, float]:
    """Text of recognised lines in reading order, and their confidence weighted by length in UTF-16 units. A line joins the first row whose
    first line's middle is less than half the smaller height away."""
    middle = lambda b: b["y"] + b["height"] / 2
    rows: list[list[dict]] = []
    for x in sorted(lines, key=lambda x: (x["box"]["y"], x["box"]["x"])):
        for row in rows:
            if abs(middle(x["box"]) - middle(row[0]["box"])) < 0.5 * min(x["box"]["height"], row[0]["box"]["height"]):
                row.append(x)
                break
        else:
            rows.append([x])
    size = lambda t: len(t.encode("utf-16-le")) // 2
    total = sum(size(x["text"]) for x in lines)
    text = "\n".join(" ".join(x["text"] for x in sorted(row, key=lambda x: x["box"]["x"])) for row in rows)
    return text, (sum(x["confidence"] * size(x["text"]) for x in lines) / total if total else 0.0)


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


CROSS = ((0, -1), (0, 1), (-1, 0), (1, 0))


def outlined_projection(pixels: np.ndarray, content_width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bright pixels with a dark one at the outline's distance each column and row has."""
    height = len(pixels)
    rgb = pixels[:, :, :3].astype(np.int16)
    high, low, r = rgb.max(2), rgb.min(2), max(1, math.floor(height / 24 + 0.5))
    dark = np.zeros(high.shape, bool)
    for dy, dx in CROSS:
        dark |= shifted(high, dy * r, dx * r, 255) < 125
    ink = (low >= 185) & (high - low <= 70) & dark
    ink[:r] = ink[height - r :] = False
    ink[:, :r] = False
    ink[:, max(0, content_width - r) :] = False
    return ink.sum(0)[:content_width], ink.sum(1)


def filter_edge_tokens(tokens: list[tuple[str, int, int]], columns: np.ndarray, width: int, height: int, steps: int, content_width: int) -> list[tuple[str, int, int]]:
    """Without a first or last Han token that has hardly any ink near it, where most of at least four have plenty."""
    han = [k for k, t in enumerate(tokens) if HAN.fullmatch(t[0])]
    if len(han) < 4 or not all(HAN_LINE.fullmatch(t[0]) for t in tokens):
        return tokens
    centers = np.array([(a + b) / 2 / steps * width for _, a, b in tokens])
    bounds = np.concatenate(([0.0], (centers[1:] + centers[:-1]) / 2, [content_width]))
    sums = np.concatenate(([0], np.cumsum(columns)))
    cut = np.clip(np.ceil(bounds), 0, min(content_width, len(columns))).astype(int)
    ink = sums[cut[1:]] - sums[np.minimum(cut[:-1], cut[1:])]
    typical = sorted(ink[han])[len(han) // 2]
    if typical < 2 * height or (ink[han] >= 0.15 * typical).sum() < 0.75 * len(han):
        return tokens
    filled = [k for k, t in enumerate(tokens) if t[0].strip()]
    gone = {k for k in (filled[0], filled[-1]) if k in han and ink[k] <= max(2, 0.01 * typical)}
    return [t for k, t in enumerate(tokens) if k not in gone]


def restore_spaces(text: str, tokens: list[tuple[str, int, int]], columns: np.ndarray, rows: np.ndarray, width: int, height: int, steps: int, content_width: int) -> str:
    """A blank between two Han tokens that lie 1.35 times the usual distance apart, if the picture has a gap between them too."""
    han = [bool(HAN.fullmatch(t[0])) for t in tokens]
    if sum(han) < 2 or not HAN_SPACES.fullmatch(text) or any(not h and not SPACES.fullmatch(t[0]) for h, t in zip(han, tokens, strict=True)):
        return text
    centers = [(a + b) / 2 for _, a, b in tokens]
    pairs = [k for k in range(1, len(tokens)) if han[k] and han[k - 1]]
    if not pairs:
        return text
    usual = sorted(centers[k] - centers[k - 1] for k in pairs)[(len(pairs) - 1) // 2]
    inked = np.flatnonzero(rows >= sum(han))
    if len(inked) < 0.2 * height:
        return text
    least = max(6.0, 0.45 * (inked[-1] - inked[0] + 1))
    full = np.flatnonzero(columns[:content_width] >= 2)
    wide = np.flatnonzero(np.diff(full) - 1 >= least)
    middles = (full[wide] + 1 + full[wide + 1]) / 2
    out = []
    for k, t in enumerate(tokens):
        if k in pairs and centers[k] - centers[k - 1] + 0.5 >= 1.35 * usual:
            left, right = centers[k - 1] / steps * width, centers[k] / steps * width
            if ((middles > left) & (middles < right)).any():
                out.append(" ")
        out.append(t[0])
    return "".join(out).strip()


def color_mask(pixels: np.ndarray, color: str, tolerance: int, outline: bool) -> tuple[np.ndarray, int]:
    """Pixels of a colour, and how many; with outline only those with a dark pixel within 3 to a side."""
    target = np.array([int(color[k : k + 2], 16) for k in (1, 3, 5)])
    rgb = pixels[:, :, :3].astype(np.int16)
    mask = (pixels[:, :, 3] != 0) & (np.abs(rgb - target) <= tolerance).all(2)
    if outline:
        dark = (pixels[:, :, 3] != 0) & (rgb.max(2) < min(110, 0.55 * target.max()))
        near = np.zeros_like(mask)
        for r in (1, 2, 3):
            for dy, dx in CROSS:
                near |= shifted(dark, dy * r, dx * r, False)
        mask &= near
    return mask.astype(np.uint8), int(mask.sum())


def stroke_signature(pixels: np.ndarray) -> tuple[np.ndarray, int]:
    """Class of each bright pixel with a dark one within 3 to a side: 1 neutral, 2 red, 3 green, 4 blue; 0 elsewhere and in the border."""
    rgb = pixels[:, :, :3].astype(np.int16)
    high, low = rgb.max(2), rgb.min(2)
    dark = np.zeros(high.shape, bool)
    for r in (1, 2, 3):
        for dy, dx in CROSS:
            dark |= shifted(high, dy * r, dx * r, 255) < 110
    kind = np.where(high - low < 70, 1, np.where(rgb[:, :, 0] == high, 2, np.where(rgb[:, :, 1] == high, 3, 4)))
    ink = np.where((high >= 180) & dark, kind, 0).astype(np.uint8)
    inner = np.zeros_like(ink)
    inner[3:-3, 3:-3] = ink[3:-3, 3:-3]
    return inner, int((inner != 0).sum())


def same_strokes(a: np.ndarray, b: np.ndarray, boxes: list[dict] | None = None) -> bool:
    """Whether two signatures show the same text: a stroke may move by a pixel, few pixels may differ, not over two in a tile of 32 by 16;
    outside the boxes nothing the size of a glyph may differ."""
    if a.shape != b.shape or min(np.count_nonzero(a), np.count_nonzero(b)) < 64:
        return False
    height, width = a.shape
    inside = np.ones(a.shape, bool)
    if boxes is not None:
        inside[:] = False
        ys, xs = np.arange(height), np.arange(width)
        for box in boxes:
            h, x, y = box["height"] * height, box["x"] * width, box["y"] * height
            across = (xs >= max(0, x - 0.5 * h)) & (xs < min(width, x + box["width"] * width + 0.5 * h))
            down = (ys >= max(0, y - 0.1 * h)) & (ys < min(height, y + h + 0.1 * h))
            inside |= down[:, None] & across[None, :]

    def near(v: np.ndarray, other: np.ndarray) -> np.ndarray:
        hit = v == 0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                hit |= shifted(other, dy, dx, 255) == v
        return hit

    differ = (a != b) & ~(near(a, b) & near(b, a))
    na, nb = np.count_nonzero(a[inside]), np.count_nonzero(b[inside])
    most = max(na, nb)
    within = differ & inside
    tiles = np.zeros((-(-height // 16), -(-width // 32)), np.int64)
    y, x = np.nonzero(within)
    np.add.at(tiles, (y // 16, x // 32), 1)
    if min(na, nb) < 64 or abs(na - nb) > 0.08 * most or len(y) > 0.006 * most or tiles.max(initial=0) > 2:
        return False
    if boxes is None:
        return True
    labels, count = components(differ & ~inside, True)
    e = extents(labels, count)
    return not ((e[:, 4] >= 12) & (e[:, 1] - e[:, 0] >= 2) & (e[:, 3] - e[:, 2] >= 1)).any()


def supported_result(text: str, confidence: float, lines: list[dict], ink: np.ndarray) -> bool:
    """Whether strokes cover each box of a sure result."""
    if not text or confidence < 0.9 or not len(lines) or np.count_nonzero(ink) < 64:
        return False
    height, width = ink.shape
    for x in lines:
        box = x["box"]
        left, right = max(0, math.floor(box["x"] * width)), min(width, math.ceil((box["x"] + box["width"]) * width))
        top, bottom = max(0, math.floor(box["y"] * height)), min(height, math.ceil((box["y"] + box["height"]) * height))
        part = ink[top : max(top, bottom), left : max(left, right)] != 0
        if x["confidence"] < 0.9 or part.sum() < max(32, (right - left) * (bottom - top) * 0.015) or part.any(0).sum() < 0.25 * (right - left):
            return False
    return True


def input_tensor(pixels: np.ndarray, kind: str, width: int | None = None) -> np.ndarray:
    """Planar BGR floats for a model: `rec` to -1..1, zero to the right up to width; `det` by the usual means and deviations."""
    bgr = pixels[:, :, 2::-1].astype(np.float32) / 255
    mean, std = (np.full(3, 0.5), np.full(3, 0.5)) if kind == "rec" else (np.array([0.406, 0.456, 0.485]), np.array([0.225, 0.224, 0.229]))
    out = ((bgr - mean) / std).transpose(2, 0, 1).astype(np.float32)
    if width and width > out.shape[2]:
        out = np.pad(out, ((0, 0), (0, 0), (0, width - out.shape[2])))
    return out


def join_inputs(tensors: list[np.ndarray]) -> np.ndarray:
    return np.stack(tensors)


def split_outputs(data: np.ndarray, dims: list[int]) -> list[tuple[np.ndarray, list[int]]]:
    stride = int(np.prod(dims[1:]))
    if len(data) != stride * dims[0]:
        raise ValueError(f"{len(data)} values are no {dims}")
    return [(data[k * stride : (k + 1) * stride], [1, *dims[1:]]) for k in range(dims[0])]


# Column functions: Arrow batches in, one structure out for each row.


def ctc_column(data: Column, dims: Column, dictionary: list[str]) -> Column:
    @F.pandas_udf("struct<text:string,confidence:double,tokens:array<struct<text:string,start:int,end:int>>>")
    def run(values: pd.Series, shapes: pd.Series) -> pd.DataFrame:
        rows = [decode_ctc(np.asarray(v, np.float64), list(d), dictionary) for v, d in zip(values, shapes, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "confidence": [r[1] for r in rows], "tokens": [[{"text": t, "start": a, "end": b} for t, a, b in r[2]] for r in rows]})

    return run(data, dims)


def boxes_column(p: Column, width: Column, height: Column, crop_width: Column, crop_height: Column) -> Column:
    @F.pandas_udf(f"array<{BOX}>")
    def run(ps: pd.Series, ws: pd.Series, hs: pd.Series, cws: pd.Series, chs: pd.Series) -> pd.Series:
        return pd.Series([detect_boxes(np.asarray(v, np.float64).reshape(h, w), cw, ch)[0] for v, w, h, cw, ch in zip(ps, ws, hs, cws, chs, strict=True)])

    return run(p, width, height, crop_width, crop_height)


def merge_column(boxes: Column) -> Column:
    @F.pandas_udf(f"array<{BOX}>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([merge_boxes(list(v)) for v in values])

    return run(boxes)


def assemble_column(lines: Column) -> Column:
    @F.pandas_udf("struct<text:string,confidence:double>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([assemble_lines(list(v)) for v in values], columns=["text", "confidence"])

    return run(lines)


def color_column(rgba: Column, width: Column, height: Column, color: str, tolerance: int, outline: bool) -> Column:
    @F.pandas_udf("struct<mask:binary,count:int>")
    def run(data: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.DataFrame:
        rows = [color_mask(raster(d, w, h), color, tolerance, outline) for d, w, h in zip(data, ws, hs, strict=True)]
        return pd.DataFrame({"mask": [m.tobytes() for m, _ in rows], "count": [n for _, n in rows]})

    return run(rgba, width, height)


def signature_column(rgba: Column, width: Column, height: Column) -> Column:
    @F.pandas_udf("struct<width:int,height:int,ink:binary,count:int>")
    def run(data: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.DataFrame:
        rows = [stroke_signature(raster(d, w, h)) for d, w, h in zip(data, ws, hs, strict=True)]
        return pd.DataFrame({"width": ws, "height": hs, "ink": [m.tobytes() for m, _ in rows], "count": [n for _, n in rows]})

    return run(rgba, width, height)
