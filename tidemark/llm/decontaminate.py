"""Benchmark decontamination: n-gram and rare-word seeds join passages of documents to test items, and Smith-Waterman alignment of words
scores them, so that edited copies count too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, shingles
from .tokens import parts, two

#: Bytes of item text that are held at once; a larger benchmark is taken in blocks.
HELD = 8 << 20
MATCH, MISS, GAP = 2, -1, -1
#: Words whose points an alignment needs at least, or all that an item has: fewer are common to texts that have nothing to do with it.
EVIDENCE = 7
#: ASCII characters other than letters and digits part words.
APART = [c for c in range(128) if not chr(c).isalnum()]


def align(item: np.ndarray, words: np.ndarray) -> int:
    """Best local alignment score of two word sequences, with linear gaps. A row's gaps to the left are a running maximum."""
    at = np.arange(len(words), dtype=np.int64)
    above, best = np.zeros(len(words) + 1, np.int64), 0
    for w in item:
        t = np.maximum(above[:-1] + np.where(words == w, MATCH, MISS), above[1:] + GAP)
        np.maximum(t, 0, out=t)
        above[1:] = np.maximum.accumulate(t - GAP * at) + GAP * at
        best = max(best, int(above.max()))
    return best


def spread(keys: np.ndarray, at: np.ndarray, first: np.ndarray, item: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item and diagonal for each place of an item where a key lies; first tells where a key's items and positions begin."""
    n = first[keys + 1] - first[keys]
    k = np.repeat(first[keys] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return item[k], np.repeat(at, n) - pos[k]


class Seeds:
    """The n-grams and words of a block of items, and where they stand.

    No copy is lost for the frequency of what it holds. Every n-gram of an item is a seed. A copy without a whole n-gram has a miss or gap
    after n - 1 matches at most, so that it reaches the score only with more of the item's words; the item's rarest words are seeds too,
    one more than such a copy can lack. Frequency only tells which words cost least.
    """

    def __init__(self, items: list[tuple[int, str]], n: int, least: float):
        self.hasher, self.n = WordHasher(APART), n
        split = [(i, w) for i, t in items if len(w := self.split(t))]
        self.ids, self.words = [i for i, _ in split], [w for _, w in split]
        self.m = m = np.array([len(w) for w in self.words], np.int64)
        self.lengths = sorted({min(n, int(k)) for k in m})
        self.grams, self.first, self.item, self.pos = self._spots([shingles(w, n) for w in self.words])
        self.vocab, self.wfirst, self.witem, self.wpos = self._spots(self.words)
        self.flat = np.searchsorted(self.vocab, np.concatenate(self.words)) if split else np.zeros(0, np.int64)
        self.starts = np.cumsum(m) - m
        #: Score in points that counts, words of an item that it takes, and words that it takes without a whole n-gram:
        #: of M matches then (M - 1) // (n - 1) points at least are lost.
        self.points = np.maximum(np.ceil(least * MATCH * m - 1e-9), MATCH * np.minimum(m, EVIDENCE)).astype(np.int64)
        self.least = -(-self.points // MATCH)
        some = np.arange(1, (int(m.max()) if split else 0) + 2)
        bare = np.maximum.accumulate(MATCH * some - (some - 1) // max(1, n - 1))
        self.bare = np.searchsorted(bare, self.points) + 1
        self.sieves = [self._sieve(self.grams), self._sieve(self.vocab)]

    def split(self, text: str) -> np.ndarray:
        return self.hasher(text.lower().encode("utf-8", "surrogatepass"))[0]

    @staticmethod
    def _spots(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, which, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        pos = np.concatenate([np.arange(len(k)) for k in keys])
        return found, np.concatenate(([0], np.cumsum(n))), item[order], pos[order]

    @staticmethod
    def _sieve(keys: np.ndarray) -> np.ndarray:
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
        return sieve

    @staticmethod
    def _look(found: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.flatnonzero(sieve[(found >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(keys, found[p]), len(keys) - 1)
        good = keys[k] == found[p]
        return k[good], p[good]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of gram and position, for each place of a document where a gram of an item stands."""
        got = [self._look(shingles(words, n), self.grams, self.sieves[0]) for n in self.lengths if len(words) >= n]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._look(words, self.vocab, self.sieves[1])

    def choose(self, counts: dict[int, int]) -> None:
        """Of each item, the places of its rarest words by the number of documents that hold them become seeds."""
        df = np.array([counts.get(k, 0) for k in range(len(self.vocab))])
        keep = np.zeros(len(self.flat), bool)
        for k, (a, m) in enumerate(zip(self.starts, self.m, strict=True)):
            if self.bare[k] <= m:
                keep[a + np.argsort(df[self.flat[a : a + m]], kind="stable")[: m - self.bare[k] + 1]] = True
        keep = keep[self.starts[self.witem] + self.wpos]
        n = np.concatenate(([0], np.cumsum(keep)))
        self.wfirst, self.witem, self.wpos = n[self.wfirst], self.witem[keep], self.wpos[keep]

    def hits(self, text: str) -> list[tuple[int, float, int]]:
        """Item id, score and number of seeds of each item that a text holds. The score is that of the alignment divided by the item's
        own."""
        words = self.split(text)
        code, at = self.find_words(words)
        if not len(code):
            return []
        held = np.zeros(len(self.vocab), bool)
        held[code] = True
        # A score of so many points takes half as many of the item's words.
        count = np.add.reduceat(held[self.flat], self.starts, dtype=np.int64)
        if not (count >= self.least).any():
            return []
        i, d = spread(*self.find(words), self.first, self.item, self.pos)
        use = count[i] >= self.least[i]
        j, e = spread(code, at, self.wfirst, self.witem, self.wpos)
        also = count[j] >= self.bare[j]
        i, d, whole = np.concatenate((i[use], j[also])), np.concatenate((d[use], e[also])), np.repeat((True, False), (use.sum(), also.sum()))
        if not len(i):
            return []
        order = np.lexsort((d, i))
        i, d, whole = i[order], d[order], whole[order]
        edges = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
        # Seeds of an item that lie over its length apart are looked at each by itself.
        apart = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (d[1:] - d[:-1] > self.m[i[1:]]), [True])))
        best: dict[int, int] = {}
        for a, b in zip(apart[:-1].tolist(), apart[1:].tolist(), strict=True):
            k = int(i[a])
            item, m = self.words[k], int(self.m[k])
            # No alignment that counts has more gaps than these.
            pad = MATCH * m - int(self.points[k])
            part = words[max(0, d[a] - pad) : max(0, d[b - 1] + m + pad)]
            if np.isin(item, part).sum() >= (self.least if whole[a:b].any() else self.bare)[k]:
                best[k] = max(best.get(k, 0), align(item, part))
        size = dict(zip(i[edges[:-1]].tolist(), np.diff(edges).tolist(), strict=True))
        return [(self.ids[k], x / (MATCH * int(self.m[k])), size[k]) for k, x in best.items() if x >= self.points[k]]


def blocks(benchmark: DataFrame, n: int, least: float, id_col: str, text_col: str, held: int = HELD) -> Iterator[Seeds]:
    """The items, block by block; one block of at most `held` bytes (or one item) is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL AND t <> ''").distinct()
    total = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    count = -(-total // held)
    for k in range(count):
        seeds = Seeds([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).orderBy("i", "t").collect()], n, least)
        if len(seeds.grams):
            yield seeds


def count_seeds(texts: DataFrame, seeds: Seeds) -> Seeds:
    """Choose seeds by the number of all documents that hold each word. What returns is bounded by the block's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(seeds.vocab), np.int64)
        for _, some in parts(batches):
            for t in some:
                df[np.unique(seeds.find_words(seeds.split(t))[0])] += 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(df[k], pa.int64())], names=["k", "df"])

    found = texts.mapInArrow(run, "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).collect()
    seeds.choose({r.k: r.df for r in found})
    return seeds


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, item_id, score and n_seeds for each item that a row's text holds, whole or edited.

    Words are runs of letters, digits and non-ASCII characters, lower-cased. An alignment counts if it has `least` of the item's own score
    and EVIDENCE words' worth of points (all that the item has, if it has fewer words). Null and empty texts hold nothing; null, empty and wordless
    items are in nothing; equal rows of the benchmark count once. Repeated rows and null ids of docs are judged each by itself. Columns
    other than those named are not read.
    """
    texts, out = two(docs, id_col, text_col), None
    for seeds in blocks(benchmark, n, least, item_id_col, item_text_col, held):
        count_seeds(texts, seeds)

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for ids, some in parts(batches):
                rows = [(i, *hit) for i, t in zip(ids.to_pylist(), some, strict=True) for hit in seeds.hits(t)]
                if rows:
                    i, k, s, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.float64()), pa.array(c, pa.int64())], names=["doc_id", "item_id", "score", "n_seeds"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, score double, n_seeds long")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, all columns as they are."""
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for seeds in blocks(benchmark, n, least, item_id_col, item_text_col):
        count_seeds(texts, seeds)

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([t is None or not seeds.hits(t) for t in text.to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
