"""Helpers that the operators share: shared storage, word hashes, groups of sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18
MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of an Arrow batch: whole texts of 10 000 rows, the default, are held several times over by each of an executor's tasks.
ROWS = 1000


def calm(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it asks for still smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation of what is above."""
    calm(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_hashed(rows: DataFrame, k: int, *keys: str, total: int | None = None) -> DataFrame:
    """The k rows of least hash of their keys. Of many rows only those below a hash that twice as many are expected under are sorted, so
    that what meets in one task doesn't grow with the number of partitions; keys that repeat may make it fewer than k."""
    total = rows.count() if total is None else total
    if total > 8 * k + 4000:
        rows = rows.where(F.xxhash64(*keys) < F.lit(int(-(1 << 63) + (2 * k + 1000) / total * (1 << 64))))
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(k)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of all words of a text in a few array operations: a polynomial over the bytes of each word, taken from running sums.

    A word is a run of bytes that are no separators; A-Z count as a-z. Hashes have 64 bits.
    """

    def __init__(self, separators: Iterable[int]):
        rng = np.random.default_rng(20240117)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        base = 0x9E3779B97F4A7C15 | 1
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE + 1)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, np.uint64(base & MASK))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _slice(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.concatenate(([False], ~self.apart[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(raw))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.table[raw] * self.powers[: len(raw)], dtype=np.uint64)))
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64)), starts, ends

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end (in bytes) of each word of data, whatever its length; slices end at separators."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) <= SLICE:
            return self._slice(raw)
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + SLICE)
            if end < len(raw):
                gaps = np.flatnonzero(self.apart[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    while end < len(raw) and not self.apart[raw[end]]:
                        end += 1
            parts.append([x if k == 0 else x + at for k, x in enumerate(self._slice(raw[at:end]))])
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: Space and the control characters from tab to carriage return.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the whole sequence where there are fewer, nothing where there are none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k])
    return out


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A table for each run of equal keys, of batches that are sorted by key; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table, keys = pa.Table.from_batches([batch]), batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix reaches."""
    n = len(linked)
    label = np.arange(n)
    for start in range(n):
        if label[start] != start or not linked[start].any():
            continue
        seen = np.zeros(n, bool)
        seen[start] = True
        front = np.array([start])
        while len(front):
            more = linked[front].any(0) & ~seen
            seen |= more
            front = np.flatnonzero(more)
        label[seen] = start
    return label


#: Keys that may be broadcast at most because many rows have them.
LISTED = 100_000


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int, weight: str = "k") -> DataFrame:
    """rows with the columns of table (one row for each key, no null keys) joined by key. weight is the number of rows of a key; those of
    over a LISTED-th of the `total` rows, of which there are LISTED at most, are broadcast, so that no task gets all rows of a hot key."""
    hot = max(64, total // LISTED)
    many, few = table.where(F.col(weight) > hot), table.where(F.col(weight) <= hot)
    listed = F.broadcast(many.select(key))
    cold = rows.join(listed, key, "left_anti").join(few, key)
    return cold.unionByName(rows.join(F.broadcast(many), key))


#: Edges that are united at once: in a batch of a partition, and in one task where no more than this are left (16 MB).
UNITED = 1 << 20


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node that each reaches: larger labels are hooked to smaller ones, then labels are followed up."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label = up


def ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, and None after them."""
    yield from (b for b in batches if b.num_rows)
    yield None


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges a, b of a partition as edges to the smallest node that each reaches within UNITED edges."""
    held: list[pa.RecordBatch] = []
    for batch in ended(batches):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= UNITED):
            nodes, least = united(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")))
            some = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(least[some])], names=["a", "b"])
            held = []


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the edges a, b.

    Edges are united within partitions first. What is left, if UNITED edges at most, is united in one task; else by rounds of alternating
    large and small stars: each is two joins on node, is written to the shared folder, and looks nodes of many edges up by broadcast, so that
    a hub isn't one task. Rounds grow with the logarithm of the longest chain. Nulls are no nodes; loops add nothing.
    """
    now = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").mapInArrow(_unite, "a long, b long"))
    if now.count() <= UNITED:
        now = now.repartition(1).mapInArrow(_unite, "a long, b long")
        return cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()))
    mark = F.expr("struct(count(*), sum(cast(xxhash64(a, b) % 1000000007 as long)), max(a))").alias("m")
    before = None
    while True:
        state = now.agg(mark).first()["m"]
        if state == before or not state[0]:
            break
        before, total = state, 2 * state[0]
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("k"))
        large = cut(lookup(both, least, "a", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        now = cut(lookup(large, least, "a", total).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return cut(stars.union(now.select("b", "b").distinct()))
