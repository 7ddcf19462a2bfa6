"""Main text of web pages: structure tells what surely is and isn't the article; pages next to each other by URL within a host are
aligned line by line, and lines that they share are deleted: in an article those of several near pages, else those of the nearest that isn't much like it too."""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .common import calm, least_hashed

#: Elements whose text is no content, elements that aren't the article, elements that end a line, elements without end.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "canvas", "object", "math", "xmp")
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "label", "option"}
LINES = {"address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "title", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role attributes of what isn't the article.
MARKS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer menu modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget complementary contentinfo".split()
)
#: A tag from its name on, with quoted attribute values; and one whose quotes don't end.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)")
LOOSE = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+")

PLAIN, ARTICLE, OFF = 0, 1, 2
#: Pages before and after a page that it may be compared with, those of them that are, and those that make a line of an article boilerplate.
REACH, NEAR, SEVERAL = 8, 8, 3
#: Keys that ranges are laid by at most.
SAMPLED = 1_000_000


def mark(name: str, attributes: str, inside: bool) -> int:
    """What an element is by its name and attributes; inside: of the article."""
    if name in ASIDE:
        return OFF
    found = PLAIN
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return OFF
            if (key == "role" and value == "main") or (key == "itemprop" and value == "articlebody"):
                found = ARTICLE
            elif key in ("class", "id", "role") and name not in ("body", "html", "article", "main") and MARKS & {w for part in value.split() for w in PARTS.findall(part)}:
                return OFF
    if name in ("article", "main"):
        return ARTICLE
    return OFF if name == "header" and not inside else found


def lines(page: str) -> list[tuple[int, str]]:
    """State and text of each line of a page: references decoded, blanks made one, empty lines left out.

    The article is what an article or main element, or one marked so, holds, less what in it isn't; of a header in it, headings count.
    """
    out: list[tuple[int, str]] = []
    words: list[str] = []
    stack: list[tuple[str, int]] = []
    state, at, n = PLAIN, 0, len(page)

    def end_line() -> None:
        text = "".join(words)
        text = " ".join((references.unescape(text) if "&" in text else text).split())
        if text:
            out.append((state, text))
        words.clear()

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            words.append(page[at : lt if lt >= 0 else n])
            at = lt
            if lt < 0:
                break
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark_end, skip = ("-->", 3) if page[at + 2] == "-" else ("]]>", 3)
            end = page.find(mark_end, at + 4)
            if page[at + 2] == "[":
                words.append(page[at + 9 : end if end >= 0 else n])
            at = end + skip if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = TAG.match(page, at + 1) or LOOSE.match(page, at + 1)
        if not m:
            words.append("<")
            at += 1
            continue
        at = m.end()
        name = m[2].lower()
        closing, attributes = m[1] == "/", m[3]
        if name in LINES:
            end_line()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1] != state:
                        end_line()
                    state = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at) if not attributes.endswith("/") else None
            at = close.end() if close else at if attributes.endswith("/") else n
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            state = stack.pop()[1]
        new = OFF if state == OFF else max(state, mark(name, attributes, state == ARTICLE)) if state != ARTICLE or mark(name, attributes, True) == OFF else ARTICLE
        if name == "header" and state == ARTICLE:
            new = 3
        elif state == 3:
            new = ARTICLE if name in HEADINGS else OFF if new == OFF else 3
        if new != state:
            end_line()
        stack.append((name, state))
        state = new
    end_line()
    return [(OFF if s == 3 else s, t) for s, t in out]


def shared(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of a are in a longest common subsequence of a and b."""
    hit = np.zeros(len(a), bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    hit[:head] = True
    hit[len(a) - tail :] = True
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    # Lines that only one side has align with nothing.
    both = set(a) & set(b)
    place = [k for k, x in enumerate(a) if x in both]
    a, b = [a[k] for k in place], [x for x in b if x in both]
    if a:
        number = {x: k for k, x in enumerate(both)}
        y = np.array([number[x] for x in b])
        table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a) - 1, -1, -1):
            down = table[i + 1]
            best = np.where(y == number[a[i]], down[1:] + 1, down[:-1])
            table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j] and table[i, j] == table[i + 1, j + 1] + 1:
                hit[head + place[i]] = True
                i, j = i + 1, j + 1
            elif table[i + 1, j] >= table[i, j + 1]:
                i += 1
            else:
                j += 1
    return hit


def _size(texts: list[str], which: np.ndarray) -> int:
    return sum(len(t) for t, w in zip(texts, which, strict=True) if w)


def compared(own: list[str], near: Iterable[list[tuple[int, str]]]) -> list[np.ndarray]:
    """Which of a page's lines each near page shares, of the first pages that aren't copies of it or of each other, NEAR at most.

    A copy leaves less than a hundredth of both pages' characters unshared; it tells nothing.
    """
    out, seen, mine, total = [], [], set(own), sum(map(len, own))
    for other in near:
        theirs = [t for s, t in other if s != OFF]
        if theirs in seen:
            continue
        seen.append(theirs)
        hit = np.zeros(len(own), bool) if mine.isdisjoint(theirs) else shared(own, theirs)
        both = _size(own, hit)
        if 100 * (total - both) >= total or 100 * (sum(map(len, theirs)) - both) >= sum(map(len, theirs)):
            out.append(hit)
            if len(out) == NEAR:
                break
    return out


def main_text(page: list[tuple[int, str]], near: list[list[tuple[int, str]]]) -> str:
    """The article's lines where structure names one, else the lines that aren't marked off, less what pages near by URL share.

    Lines go that SEVERAL near pages share, and three in four of them: articles of one site may share passages with a page or two. Without
    an article, so do those shared with the nearest page that shares half of the page's characters at most; if all share more, be it for
    long menus or as near copies, with the page that shares least. Copies are no near pages, so that a page with copies alone stays whole.
    """
    kind = ARTICLE if any(s == ARTICLE for s, _ in page) else PLAIN
    rest = [t for s, t in page if s == kind]
    votes = compared(rest, near)
    many = sum(votes, np.zeros(len(rest), np.int64))
    gone = (many >= SEVERAL) & (4 * many >= 3 * len(votes))
    if kind == PLAIN and votes:
        sizes, half = [_size(rest, v) for v in votes], sum(map(len, rest)) / 2
        gone |= votes[next((k for k, x in enumerate(sizes) if x <= half), int(np.argmin(sizes)))]
    return " ".join(t for t, g in zip(rest, gone, strict=True) if not g)


def order(url: Column, page_id: Column) -> tuple[Column, Column]:
    """Host, and a key that puts the pages of a host together, those of one folder side by side, numbers in their order, and ties by id."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rest = F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1), F.lit(""))
    return host, F.concat_ws("\x00", host, natural_key(rest), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("")))


def neighbours(edges: list[tuple[int, bool, int, str]], ranges: int) -> dict[str, set[int]]:
    """To which ranges the pages at the ends of others go, so that each range has the REACH pages before and after it. edges: range, whether
    from its end, place from there and key."""
    first, last, out = [[] for _ in range(ranges)], [[] for _ in range(ranges)], {}
    for k, end, _, key in sorted(edges):
        (last if end else first)[k].append(key)
    for k in range(ranges):
        for side, step in ((last, -1), (first, 1)):
            left, at = REACH, k + step
            while left > 0 and 0 <= at < ranges:
                for key in side[at][:left]:
                    out.setdefault(key, set()).add(k)
                left, at = left - len(side[at]), at + step
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row.

    Null and empty pages have an empty text. Pages are put in order by host, path and id, in ranges whose borders come from a bounded
    sample of URLs, so that a host of any size is spread over tasks; the pages at the ends of a range are given to the ranges beside it too.
    So each page is compared with the REACH pages before and after it in its host that aren't its copies, NEAR at most, a lone one with none,
    wherever borders lie. Pages without URL or host form one host. Ties of URL go by id, then by content. Repeated rows each give a row.
    Columns other than the three named are not read. A page is shuffled once and parsed once, but for those at the ends of ranges.
    """

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True)

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            ids, urls, texts = zip(*some, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        def texts():
            """The page in the middle of the window is told once REACH pages after it, or the last of its host, are read."""
            window: deque = deque()
            at = 0

            def told() -> list[tuple]:
                i, u, own, _, page = window[at]
                if not own:
                    return []
                # By distance, the page before a page first.
                order = [at + d * side for d in range(1, REACH + 1) for side in (-1, 1)]
                return [(i, u, main_text(page, [window[k][4] for k in order if 0 <= k < len(window)]))]

            for i, u, own, group, page in rows():
                if window and window[-1][3] != group:
                    for at in range(at, len(window)):
                        yield from told()
                    window.clear()
                    at = 0
                window.append((i, u, own, group, lines(page or "")))
                if len(window) > at + REACH:
                    yield from told()
                    at += 1
                    if at > REACH:
                        window.popleft()
                        at -= 1
            for at in range(at, len(window)):
                yield from told()

        done: list[tuple] = []
        for row in texts():
            done.append(row)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    spark = pages.sparkSession
    calm(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host, key = order(F.col("url"), F.col("page_id"))
    rows = rows.withColumns({"host": host, "key": key})
    total = rows.count()
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 64 + 1)
    # As many keys as a range partitioner takes; the edges are 2 * REACH keys a range.
    sample = sorted({r[0] for r in least_hashed(rows.select("key"), min(SAMPLED, 60 * ranges), "key", total=total).collect()})
    borders = [sample[len(sample) * k // ranges] for k in range(1, ranges) if len(sample)]
    rows = rows.withColumn("range", F.size(F.filter(F.lit(borders), lambda b: b <= F.col("key"))) if borders else F.lit(0))
    ends = []
    for end, by in ((False, F.col("key")), (True, F.desc("key"))):
        place = F.row_number().over(Window.partitionBy("range").orderBy(by))
        ends.append(rows.select("range", F.lit(end).alias("end"), place.alias("place"), "key").where(F.col("place") <= REACH))
    extra = [(k, sorted(v)) for k, v in neighbours([tuple(r) for r in ends[0].union(ends[1]).collect()], ranges).items()] if ranges > 1 else []
    to = F.array(F.struct("range", F.lit(True).alias("own")))
    if extra:
        rows = rows.join(F.broadcast(spark.createDataFrame(extra, "key string, ranges array<int>")), "key", "left")
        to = F.concat(to, F.coalesce(F.transform("ranges", lambda r: F.struct(r.alias("range"), F.lit(False).alias("own"))), F.array().cast("array<struct<range:int,own:boolean>>")))
    rows = rows.withColumn("to", F.explode(to)).select("page_id", "url", "to.own", "host", "html", "key", F.col("to.range").alias("range"))
    rows = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("key", F.xxhash64("html")).select("page_id", "url", "own", "host", "html")
    return rows.mapInArrow(difference, "page_id long, url string, text string, n_chars long")
