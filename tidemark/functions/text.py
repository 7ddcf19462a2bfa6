"""Text keys, similarity, names and formats as column expressions; Python only where the JVM has no function (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schema as s


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None and not t.isascii() else t)


def trim(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def normalize_text(c: Column | str, nfkc: bool = True) -> Column:
    """Comparison form: NFKC, no white space, punctuation or symbols, lower case. nfkc=False stays on the JVM, for ASCII data."""
    return F.lower(F.regexp_replace(_nfkc(_col(c)) if nfkc else _col(c), r"(?U)[\s\p{P}\p{S}]", ""))


def line_count(c: Column | str) -> Column:
    return F.size(F.split(_col(c), "\n"))


def read_key(c: Column | str, nfkc: bool = True) -> Column:
    """Two reads are the same if this is equal: normalized text and number of lines."""
    return F.struct(normalize_text(c, nfkc).alias("norm"), line_count(c).alias("n_lines"))


def similarity(a: Column | str, b: Column | str, nfkc: bool = True) -> Column:
    """1 - edit distance / longer length, of normalized texts, in code points."""
    x, y = normalize_text(a, nfkc), normalize_text(b, nfkc)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).when(F.least(F.length(x), F.length(y)) == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.levenshtein(x, y), longest))


def _points(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def subsequence(short: Column, long: Column) -> Column:
    """Whether all code points of short occur in long in that order: a fold that counts those found so far."""
    # What is sought travels in the state: a lambda must not hold an expression of Python.
    step = lambda a, c: F.struct((a["k"] + F.when(F.try_element_at(a["want"], a["k"] + 1) == c, 1).otherwise(0)).alias("k"), a["want"].alias("want"))
    return F.aggregate(_points(long), F.struct(F.lit(0).alias("k"), _points(short).alias("want")), step, lambda a: a["k"] == F.size(a["want"]))


def is_partial_read(partial: Column | str, complete: Column | str, nfkc: bool = True) -> Column:
    """Whether the first is the second with some code points missing: same lines, at least 3, at least 0.6 of the length, no more missing
    than a quarter (or 2)."""
    a, b = normalize_text(partial, nfkc), normalize_text(complete, nfkc)
    la, lb = F.length(a), F.length(b)
    return (
        (line_count(partial) == line_count(complete))
        & (la >= s.PARTIAL_LENGTH)
        & (la < lb)
        & F.coalesce(F.try_divide(la, lb) >= s.PARTIAL_RATIO, F.lit(False))
        & (lb - la <= F.greatest(F.lit(s.PARTIAL_LEAST), F.floor(lb * s.PARTIAL_SHARE)))
        & subsequence(a, b)
    )


def related_read(a: Column | str, b: Column | str, nfkc: bool = True) -> Column:
    return is_partial_read(a, b, nfkc) | is_partial_read(b, a, nfkc) | (similarity(a, b, nfkc) >= s.RELATED)


def leading_stroke_confusion(stable: Column | str, variant: Column | str) -> Column:
    """Whether a leading stroke that is a numeral was read as a dash, before at least three Han characters."""
    a, b = _col(stable), _col(variant)
    return a.rlike(r"^一\p{IsHan}{3,}$") & b.rlike(r"^[-−—–]\p{IsHan}{3,}$") & (F.substring(a, 2, 1 << 30) == F.substring(b, 2, 1 << 30))


def vtt_escape(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def newlines(c: Column | str) -> Column:
    """One kind of line end, no blank lines."""
    return F.regexp_replace(F.regexp_replace(_col(c), "\r\n?", "\n"), "\n{2,}", "\n")


def cue_matches(text: Column | str, query: str, needs_review: Column | str, review_only: bool = False) -> Column:
    hit = F.contains(F.lower(_col(text)), F.lower(trim(F.lit(query))))
    return hit & _col(needs_review) if review_only else hit


def natural_key(c: Column | str) -> Column:
    """Sort key in which runs of digits count as numbers: each is led by the number of its digits without zeros, case is folded."""
    marked = F.regexp_replace(F.lower(_col(c)), r"(\d+)", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")
    number = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lpad(F.length(number(x)).cast("string"), 6, "0"), number(x))).otherwise(x)), "")


def parse_color_filter(color: Column | str, tolerance: Column | str, outline: Column | str) -> Column:
    """Lower-case colour, tolerance and outline, or null if the colour isn't # and six hex digits or the tolerance no integer of 0 to 128."""
    c, t, o = _col(color), _col(tolerance).cast("double"), _col(outline)
    good = c.rlike("^#[0-9a-fA-F]{6}$") & (t == F.floor(t)) & t.between(0, 128) & o.isNotNull()
    return F.when(good, F.struct(F.lower(c).alias("color"), t.cast("int").alias("tolerance"), o.alias("outline")))


def channels(color: Column | str) -> list[Column]:
    return [F.conv(F.substring(_col(color), k, 2), 16, 10).cast("int") for k in (2, 4, 6)]


def hex_color(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(_col(c).cast("int")), 2, "0")) for c in (r, g, b)))


def status_label(status: Column | str, detail: Column | str, error: Column | str, output_error: Column | str) -> Column:
    """What a queue shows of an item: the label of its status, and what is known besides."""
    labels = {"waiting": "waiting", "running": "in progress", "completed": "done", "failed": "failed", "partial": "stopped, partly done"}
    label = F.coalesce(*(F.when(_col(status) == k, F.lit(v)) for k, v in labels.items()), _col(status))
    return F.concat_ws(" | ", label, *(F.when(_col(c) != "", _col(c)) for c in (detail, error, output_error)))


def export_stem(name: Column | str) -> Column:
    """A file stem that every system takes: no extension, no reserved or control characters, no dots or blanks at the end, 180 bytes at
    most, cut between code points; `episode` if nothing is left."""
    tail = r"[. ]+$"
    stem = F.regexp_replace(_col(name), r"\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]', "_"), tail, "")
    stem = F.when(stem == "", F.lit("episode")).otherwise(stem)
    grown = F.aggregate(
        _points(stem),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda a, c: F.struct(F.when(a["full"] | (F.octet_length(a["text"]) + F.octet_length(c) > 180), a["text"]).otherwise(F.concat(a["text"], c)).alias("text"), (a["full"] | (F.octet_length(a["text"]) + F.octet_length(c) > 180)).alias("full")),
    )["text"]
    short = F.when(F.octet_length(stem) > 180, grown).otherwise(stem)
    short = F.regexp_replace(short, tail, "")
    return F.when(short == "", F.lit("episode")).otherwise(short)


def supported_video(name: Column | str) -> Column:
    return _col(name).rlike(r"(?i)\.(mp4|mov|m4v)$")
