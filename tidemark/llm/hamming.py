"""Near-duplicate vectors by iterative quantisation: learned rotations give balanced binary codes, equal parts of codes (multi-index
Hamming tables) bring vectors together, the distance of whole codes tells which may be near, and the original vectors of those decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, forest, groups, least_hashed, lookup, mix

#: Vectors of a block that is reranked at once, codes of a block that is compared at once, bits of a code at least.
BLOCK, WIDE, CODE = 512, 2048, 128


def normal(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale."""
    scale = np.abs(v).max(1, keepdims=True)
    return v / (np.linalg.norm(v / scale, axis=1, keepdims=True) * scale)


def learn_rotations(v: np.ndarray, count: int, rounds: int = 30) -> list[np.ndarray]:
    """`count` projections: principal axes turned so that the signs of the projected sample lie as near as can be to the values, from a
    random start each."""
    bits = min(64, v.shape[1])
    axes = np.linalg.eigh(v.T @ v)[1][:, ::-1][:, :bits]
    v, out = v @ axes, []
    for k in range(count):
        r = np.linalg.qr(np.random.default_rng(k).standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        out.append(axes @ r)
    return out


def centre(v: np.ndarray, cosine: float) -> tuple[np.ndarray, float]:
    """What is taken from unit vectors before the signs are, and the share of bits in which a pair at the threshold then differs.

    Codes are balanced about the sample's mean. Vectors that all point one way lie so near to their mean that a pair at the threshold would
    differ in many more bits; their signs are taken about zero, where the angle alone counts.
    """
    mean, plain = v.mean(0), math.acos(cosine) / math.pi
    least = float(np.quantile(np.linalg.norm(v - mean, axis=1), 0.05))
    flips = math.acos(max(-1.0, 1 - (1 - cosine) / max(1e-9, least * least))) / math.pi
    return (mean, flips) if flips <= 1.2 * plain else (np.zeros_like(mean), plain)


def plan(n: int, flips: float, recall: float, dims: int) -> tuple[int, int, int, int]:
    """Bits of a table's key, tables, rotations, and the most bits of the first CODE ones that a pair may differ in: keys of so many bits that
    about 64 unlike vectors of n meet in a bucket, which the distance of whole codes sorts out, and so many tables that a pair at the
    threshold itself is found with this probability."""
    own = min(64, dims)
    bits = max(4, min(32, own, round(math.log2(max(n, 2) / 64))))
    miss = 1 - (1 - flips) ** bits
    tables = max(2, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 2
    rotations = max(math.ceil(tables / max(1, own // bits)), math.ceil(CODE / own))
    return bits, tables, rotations, math.ceil(CODE * flips + 4 * math.sqrt(CODE * flips * (1 - flips)))


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, sample: int = 8192, recall: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are their own component. Vectors
    link with those of their length only; each length has its own rotations and index, but lengths of BLOCK classes at most, other than
    the most frequent one, are compared whole. Equal vectors are one class, compared once and
    counted as often as they occur; rows that share an id, and rows without one by their vector, count as one node in components; the
    component of rows of which none has an id is null. The rotations are learned from `sample` vectors of least hash at most; all vectors
    are indexed. A bucket of any size is compared in blocks, all of it; a pair is counted in the first table where it meets. Columns other
    than the two named are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)"), F.lit(False))
    rows = cut(rows.withColumns({"usable": usable, "node": F.when(usable, F.xxhash64("v"))}))
    good, total = rows.where("usable"), rows.count()
    classes = cut(good.groupBy("v").agg(F.first("node").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum("copies").alias("k")).where("n > 1")
    common = sizes.orderBy(F.desc("k"), "d").limit(1).collect()
    # Lengths of more than BLOCK classes are at most a share 1 / BLOCK of the rows.
    indexed = {r["d"] for r in common} | {r["d"] for r in sizes.where(F.col("n") > BLOCK).select("d").collect()}
    some = [_pairs(classes.where(F.size("v") == d), d, cosine, sample, recall) for d in sorted(indexed)]
    if not sizes.where(~F.col("d").isin(*indexed)).isEmpty():
        some.append(_whole(classes.where(~F.size("v").isin(*indexed)), cosine))
    some = [p for p in some if p is not None]
    pairs = reduce(DataFrame.union, some) if some else None
    own, joined = classes.select("rep", "least", "copies"), None
    if pairs is not None:
        own = own.join(pairs.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        joined = connected_components(pairs.select(F.col("rep").alias("a"), "b"))
    else:
        own = own.withColumn("links", F.lit(0))
    several = cut(good.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("vec_id", "a"))
    if not several.isEmpty():
        same = good.join(several, "vec_id").select("a", F.col("node").alias("b")).distinct()
        joined = connected_components(same if joined is None else joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same))
    if joined is not None:
        own = own.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        own = own.withColumn("component", F.col("rep"))
    own = cut(own)
    roots = own.groupBy("component").agg(F.min("least").alias("c"), F.count("*").alias("k"))
    own = lookup(own, roots, "component", total).select(F.col("rep").alias("node"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "c", F.col("copies").alias("k"))
    out = lookup(good.select("vec_id", "node"), cut(own), "node", total).select("vec_id", "n_links", F.col("c").alias("component_id"))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _whole(classes: DataFrame, cosine: float) -> DataFrame:
    """As _pairs, of all pairs of equal length."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "d"):
            if table.num_rows < 2:
                continue
            table = table.combine_chunks()
            rep, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
            v = table.column("v").chunk(0).flatten().to_numpy().reshape(len(rep), -1)
            unit = normal(v)
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            count, root = (linked * copies[None, :]).sum(1).astype(np.int64), rep[forest(linked)]
            some = np.flatnonzero((count > 0) | (root != rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(count[some]), pa.array(root[some])], names=["rep", "links", "b"])

    rows = classes.select(F.size("v").alias("d"), "rep", "copies", "v")
    return cut(rows.repartition("d").sortWithinPartitions("d").mapInArrow(compare, "rep long, links long, b long"))


def _pairs(classes: DataFrame, dims: int, cosine: float, sample: int, recall: float) -> DataFrame | None:
    """rep, links (rows linked with it, by classes), b (a class of the same component), in several rows for each rep."""
    n = classes.count()
    if n < 2:
        return None
    # The sample is bounded by its parameter; the index is not.
    taken = normal(np.array([r[0] for r in least_hashed(classes, sample, "rep", total=n).select("v").collect()], np.float64))
    mean, flips = centre(taken, cosine)
    bits, tables, rotations, most = plan(n, flips, recall, dims)
    turns = learn_rotations(taken - mean, rotations)
    own = min(64, dims)
    block, per, words = BLOCK, own // bits, math.ceil(CODE / own)
    weights, places = 1 << np.arange(bits, dtype=np.int64), np.uint64(1) << np.arange(own, dtype=np.uint64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of all tables, and the code: the signs under the first rotations, CODE of them or a few more, packed."""
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = normal(batch.column("v").flatten().to_numpy().reshape(-1, dims)) - mean
            keys, code = [], []
            for t in turns:
                sign = unit @ t >= 0
                keys += [sign[:, k * bits : (k + 1) * bits].astype(np.int64) @ weights for k in range(per)]
                code.append(np.where(sign, places, np.uint64(0)).sum(1, dtype=np.uint64).view(np.int64))
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("v"), lists(np.stack(keys[:tables], 1)), lists(np.stack(code[:words], 1))], names=["rep", "copies", "v", "keys", "code"])

    indexed = cut(classes.mapInArrow(index, "rep long, copies long, v array<double>, keys array<long>, code array<long>"))
    # Only codes go to the tables.
    light = indexed.select("rep", "code", F.posexplode("keys").alias("t", "key")).withColumn("bucket", F.col("t") * F.lit(1 << 32) + F.col("key")).drop("t", "key")
    full = light.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    met = light.join(full, "bucket").withColumn("blocks", F.ceil(F.col("k") / WIDE).cast("int")).withColumn("me", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select(F.xxhash64("bucket", F.least("me", "other"), F.greatest("me", "other")).alias("gid"), F.expr("CASE WHEN me > other THEN 1 ELSE 0 END").alias("side"), F.floor(F.col("bucket") / F.lit(1 << 32)).cast("int").alias("t"), "rep", "code")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a bucket, the rows whose code is near to another's, in groups that hold the pairs: BLOCK by BLOCK rows of it."""
        for table in groups(batches, "gid"):
            if table.num_rows < 2:
                continue
            table = table.combine_chunks()
            gid, rep, side = (table.column(c).to_numpy() for c in ("gid", "rep", "side"))
            code = table.column("code").chunk(0).flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
            cross, t = side.min() != side.max(), int(table.column("t")[0].as_py())
            found: dict[tuple[int, int], set[int]] = {}
            for a in range(0, len(rep), block):
                for b in range(a, len(rep), block):
                    apart = sum(np.bitwise_count(code[a : a + block, None, w] ^ code[None, b : b + block, w]).astype(np.int16) for w in range(code.shape[1])) <= most
                    if cross:
                        apart &= side[a : a + block, None] != side[None, b : b + block]
                    if a == b:
                        np.fill_diagonal(apart, False)
                    x, y = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                    if len(x):
                        found[a, b] = {*(a + x).tolist(), *(b + y).tolist()}
            for (a, b), rows in found.items():
                some = np.array(sorted(rows))
                group = int(mix(np.array([gid[0]], np.int64).view(np.uint64) + np.uint64(a * 1_000_003 + b))[0].view(np.int64))
                # Within a pair of blocks, the second's rows are its other side.
                far = side[some] if a == b else np.where(some >= b, 3, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), group)), pa.array(far.astype(np.int32)), pa.array(np.full(len(some), t, np.int32)), pa.array(np.full(len(some), cross)), pa.array(side[some].astype(np.int32)), pa.array(rep[some])], names=["gid", "part", "t", "crossed", "side", "rep"])

    close = cut(met.repartition("gid").sortWithinPartitions("gid").mapInArrow(near, "gid long, part int, t int, crossed boolean, side int, rep long"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gid"):
            if table.num_rows < 2:
                continue
            table = table.combine_chunks()
            rep, copies, side, part, t = (table.column(c).to_numpy() for c in ("rep", "copies", "side", "part", "t"))
            unit = normal(table.column("v").chunk(0).flatten().to_numpy().reshape(len(rep), -1))
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            if table.column("crossed")[0].as_py():
                linked &= side[:, None] != side[None, :]
            if part.min() >= 2:
                linked &= part[:, None] != part[None, :]
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            keys = table.column("keys").chunk(0).flatten().to_numpy().reshape(len(rep), -1)
            for k in range(int(t[0])):
                met_before = keys[a, k] == keys[b, k]
                if met_before.any():
                    a, b = a[~met_before], b[~met_before]
            count = np.bincount(a, copies[b], minlength=len(rep)).astype(np.int64)
            root = rep[forest(linked)]
            some = np.flatnonzero((count > 0) | (root != rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(count[some]), pa.array(root[some])], names=["rep", "links", "b"])

    rows = close.join(indexed.drop("code"), "rep").select("gid", "part", "t", "crossed", "side", "rep", "copies", "v", "keys")
    return cut(rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(compare, "rep long, links long, b long"))
