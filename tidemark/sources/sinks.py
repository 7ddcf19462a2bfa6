"""Subtitle files, project files, names that don't collide, and archives."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as s
from ..functions.text import export_stem, newlines, vtt_escape
from ..functions.time import format_time
from ..operators.intervals import validate_cues

SEPARATORS = {"srt": ",", "vtt": "."}
PREFIX = {"srt": "", "vtt": "WEBVTT\n\n"}


def subtitle_blocks(cues: DataFrame, fmt: str) -> DataFrame:
    """Number and text block of each cue of each video, by start (then ord)."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "ord"))
    text = newlines("text") if fmt == "srt" else vtt_escape(newlines("text"))
    times = F.concat(format_time("start", SEPARATORS[fmt]), F.lit(" --> "), format_time("end", SEPARATORS[fmt]))
    return cues.withColumn("n", n).select("video_id", "n", F.concat_ws("\n", F.col("n").cast("string"), times, text).alias("block"))


def subtitles(cues: DataFrame, fmt: str, videos: DataFrame | None = None) -> DataFrame:
    """The subtitle file of each video as content; of videos without cues, if videos names them, the empty file. Cues that break a rule
    raise an error. A file is built on one task, as it must; it holds 100 000 cues at most."""
    bad = validate_cues(cues).limit(1).collect()
    if bad:
        raise ValueError(f"cue at {bad[0]['start']} of {bad[0]['video_id']}: {['', 'times', 'text', 'overlap'][bad[0]['code']]}")
    blocks = subtitle_blocks(cues, fmt).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    if videos is not None:
        blocks = videos.select("video_id").distinct().join(blocks, "video_id", "left")
    body = F.concat_ws("\n\n", F.transform(F.coalesce("b", F.array().cast("array<struct<n:int,block:string>>")), lambda x: x["block"]))
    return blocks.select("video_id", F.concat(F.lit(PREFIX[fmt]), body, F.lit("\n")).alias("content"))


def project_json(project: Column) -> Column:
    return F.to_json(project, {"pretty": "true"})


def contents(projects: DataFrame, fmt: str) -> DataFrame:
    """Content of each project in a format: srt, vtt or json. projects: video_id and project (struct)."""
    if fmt == "json":
        return projects.select("video_id", project_json(F.col("project")).alias("content"))
    cues = projects.select("video_id", F.posexplode("project.cues").alias("ord", "c")).select("video_id", "ord", "c.start", "c.end", "c.text")
    return subtitles(cues, fmt, projects)


def available_name(stem: str, fmt: str, used: set[str]) -> str:
    """A name that isn't used, whatever its case; it is used from now on."""
    name, k = f"{stem}.{fmt}", 1
    while name.lower() in used:
        k += 1
        name = f"{stem} ({k}).{fmt}"
    used.add(name.lower())
    return name


#: A stem that could be a numbered name: what precedes the number, and the number.
NUMBERED = r"(?s)^(.+) \(([1-9]\d{0,17})\)\z"
#: Items are dealt by quantiles of ord, positions by runs of this length, so that those of one stem are spread over tasks.
CELLS, RUN = 256, 1 << 16


def _cell(ord: Column, bounds: list[int] | None) -> Column:
    """How many of CELLS - 1 ascending bounds are at most ord, by bisection."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # one constant, rather than a call for each
    steps = F.array(*(F.lit(CELLS >> k) for k in range(1, CELLS.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= ord, at + step).otherwise(at))


def _running(rows: DataFrame, *order: str | Column) -> DataFrame:
    """total: the sum of amount over the rows of a key up to each row, in order. cell ascends with the order; what the cells before hold is
    added to a sum within the cell, so that a frequent key's rows don't meet in one task."""
    cells = rows.groupBy("key", "cell").agg(F.sum("amount").alias("held"))
    past = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("key", "cell", F.coalesce(F.sum("held").over(past), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(cells, ["key", "cell"]).withColumn("total", F.col("base") + F.sum("amount").over(within)).drop("cell", "base")


def _contests(batches):
    """Who gets the names that are a stem's and another one's numbered name: rows (root, parent, number, seen, key), each for the first item of
    a stem that ends in a number, sorted by family, length of parent, parent and number; seen items of the parent came before it.

    An item of the parent that comes to a number which the other stem has already goes on to the next one: from its item `at` on, the
    parent's numbers are greater by one. Where the parent was earlier, all items of the other stem are numbered.
    """
    import pandas as pd

    family = parent = None
    for batch in batches:
        out = []
        for root, above, number, seen, key in batch.itertuples(index=False, name=None):
            if root != family:
                family, parent, beaten = root, None, set()
            if above != parent:
                parent, late, passed = above, int(above in beaten), 0
            place = number - 1 - passed
            if seen - 1 + late >= place:
                beaten.add(key)
                out.append((key, 0))
            else:
                passed += 1
                out.append((parent, place + 1 - late))
        yield pd.DataFrame(out, columns=["key", "at"])


def export_names(items: DataFrame, formats: tuple[str, ...] = ("srt",)) -> DataFrame:
    """Names of items' files in each format: the stem, with a number where an earlier item (by ord) has the same one, whatever its case.

    The names are those of `available_name` for each item in turn. An item's number is its place among those of its stem, and one more for
    each number that another stem's first item (a literal `x (2)`) had before; only the latter, one row a stem, are followed in turn.
    Names are read once before for quantiles of ord. Items without a name have no file.
    """
    rows = items.select(F.col("ord").cast("long").alias("ord"), export_stem("name").alias("stem"))
    rows = rows.withColumn("key", F.coalesce(F.lower("stem"), F.lit("")))
    shares = ", ".join(f"{k / CELLS}D" for k in range(1, CELLS))
    bounds, numbered = rows.agg(F.expr(f"percentile_approx(ord, array({shares}), 10000)"), F.max(F.col("key").rlike(NUMBERED))).first()
    cell = _cell(F.col("ord"), bounds).alias("cell")
    rows = rows.select("key", cell, "ord", "stem", F.lit(1).alias("amount"), F.lit(None).cast("long").alias("number"))
    if not numbered:
        rows = _running(rows, "ord", "stem")
        number = F.col("total")
    else:
        part = lambda k: F.regexp_extract("key", NUMBERED, k)
        firsts = rows.where(F.col("key").rlike(NUMBERED)).groupBy("key").agg(F.min("ord").alias("ord")).where(part(2) != "1")
        firsts = firsts.select(part(1).alias("key"), cell, "ord", F.col("key").alias("stem"), F.lit(0).alias("amount"), part(2).cast("long").alias("number"))
        rows = _running(rows.union(firsts), "ord", F.desc("amount"), "stem")
        root = F.regexp_replace("key", r"( \(\d+\))+\z", "").alias("root")
        met = rows.where("amount = 0").select(root, "key", "number", F.col("total").alias("seen"), F.col("stem").alias("other"))
        met = met.repartition("root").sortWithinPartitions("root", F.length("key"), "key", "number")
        more = met.mapInPandas(_contests, "key string, at long")
        none = F.lit(None)
        more = more.select("key", none.cast("long").alias("ord"), none.cast("string").alias("stem"), F.lit(1).alias("amount"), "at")
        rows = rows.where("amount = 1").select("key", "ord", "stem", F.lit(0).alias("amount"), F.col("total").alias("at")).union(more)
        rows = _running(rows.withColumn("cell", F.floor(F.col("at") / RUN)), "at", F.desc("amount")).where("amount = 0")
        number = F.col("at") + F.col("total")
    rows = rows.select("ord", "stem", number.alias("number")).withColumn("fmt", F.explode(F.array(*map(F.lit, formats))))
    told = F.when(F.col("number") > 1, F.concat(F.lit(" ("), F.col("number").cast("string"), F.lit(")"))).otherwise("")
    return rows.select("ord", "fmt", F.concat("stem", told, F.lit("."), "fmt").alias("file"))


class DirectoryWriter:
    """Writes results of a queue to a folder: names there stay taken, a file that is written again keeps its name, and one of a partial
    result says so."""

    PARTIAL = " (未完成)"

    def __init__(self, folder: str):
        import os

        self.folder, self.names = folder, {}
        self.used = {x.lower() for x in os.listdir(folder)}

    def save(self, item_id: str, stem: str, fmt: str, content: str, complete: bool) -> str:
        key = (item_id, fmt, complete)
        if key not in self.names:
            self.names[key] = available_name(stem if complete else stem + self.PARTIAL, fmt, self.used)
        with open(posixpath.join(self.folder, self.names[key]), "w", encoding="utf-8", newline="") as f:
            f.write(content)
        return self.names[key]


def zip_plan(files: DataFrame) -> DataFrame:
    """Bytes of an archive up to each file (video_id or other columns, name, content), by name, with whether it still fits the limit."""
    size = F.octet_length("content") + 2 * F.octet_length("name") + 76
    w = Window.orderBy("name")
    return files.withColumn("bytes", 22 + F.sum(size).over(w)).withColumn("fits", F.col("bytes") <= s.MAX_ZIP_BYTES)


def zip_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """An archive of stored entries; too many, too long names and too much raise an error."""
    if len(entries) > s.MAX_ZIP_ENTRIES or any(len(n.encode()) > 65_535 for n, _ in entries):
        raise ValueError("too many entries or too long a name")
    if 22 + sum(len(c) + 2 * len(n.encode()) + 76 for n, c in entries) > s.MAX_ZIP_BYTES:
        raise ValueError("the archive is too large")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in entries:
            info = zipfile.ZipInfo(name)
            info.flag_bits |= 0x800
            z.writestr(info, content)
    return out.getvalue()


def parsed(text: str) -> dict:
    return json.loads(text)
