"""N-gram Jaccard join by partitioning the universe of shingles.

Sets are banded by size. In a band's scheme, shingles are dealt to segments by hash; two sets of similarity t differ in at most
H = floor((1 - t) / (1 + t) * (|x| + |y|)) shingles, so that some of H + 1 segments are equal in both (or, for a segment that is
indexed with its one-deletion neighbourhood, differ by one shingle and count twice). How many segments are indexed plainly and
how many with neighbourhoods follows from a cost estimate for each band, in which meetings by chance weigh more the larger the corpus is.
Sets that share a key are candidates unless the parities of their shingles show that they differ in more than H, in blocks for keys of any
size; connected candidates form a cluster, which is verified exactly in blocks. All this is done for distinct sets, which are numbered by
their content; ids are joined to them at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BLANKS, MASK, WordHasher, connected_components, cut, ended, forest, groups, lookup, mix, shingles

#: Sets of a block that is verified at once, and of a block whose parities are compared at once.
BLOCK, WIDE = 256, 4096
#: Ids up to this number are broadcast (their hash relation takes some 50 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets whose keys a task remembers to have written, so that repeated rows cost little.
SEEN = 100_000


def bands(size: int, num: int, den: int) -> tuple[int, int, int]:
    """Number, first and last size of the band that holds size; a set is similar only to those of its own and the next bands."""
    first, k = 1, 0
    while True:
        last = max(first, first * den // num)
        if size <= last:
            return k, first, last
        first, k = last + 1, k + 1


@lru_cache(maxsize=None)
def schemes(num: int, den: int, most: int, price: float) -> list[tuple[int, int, int, int, int]]:
    """For each band up to size most: first, last, H, plain segments, segments with neighbourhoods."""
    out, first = [], 1
    while first <= most or not out:
        last = max(first, first * den // num)
        h = (den - num) * (last + last * den // num) // (den + num)
        out.append((first, last, h, *allocate(h, first, last, price=price)))
        first = last + 1
    return out


def more_than(k: int, mean: float) -> float:
    """Chance that a Poisson number is over k."""
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def allocate(h: int, first: int, last: int, share: float = 0.5, price: float = 2.0) -> tuple[int, int]:
    """Plain segments and segments with one-deletion neighbourhoods, of weights 1 and 2, that together weigh h + 1 at least.

    Of many choices the one of least estimated cost for a set of the band: keys written; the neighbourhoods that a set needs if more of its
    segments are empty than there is weight to spare; and price times the chance that sets which share half of their shingles meet in a key.
    """
    need, best = h + 1, None
    for spare in sorted({*range(7), *(round(need * f / 40) for f in range(21))}):
        for q in sorted({round((need + spare) * f / 20) for f in range(11)}):
            p = max(0, need + spare - 2 * q)
            if p + q < 1:
                continue
            held = first / (p + q)
            short = more_than(int((p + 2 * q - need) * (p + q) / (p + 2 * q)), (p + q) * math.exp(-held))
            cost = p + q * (1 + held) + short * (last + p + q) + price * (p * share**held + q * held * share ** max(0.0, held - 1))
            if best is None or cost < best[0]:
                best = (cost, p, q)
    return best[1:]


def content_keys(s: np.ndarray, plain: int, deep: int, h: int, tag: int) -> np.ndarray:
    """Keys of a sorted set in one scheme. Equal contents of a segment have equal keys; an empty segment has none. If the
    segments that have keys could all differ, every segment's neighbourhood is added, and in the last resort a key of the whole
    band, so that a pair of which both sets lack keys still meets."""
    m = plain + deep
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    edges = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
    mixed = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    sums, sizes, at = np.add.reduceat(mixed, edges), np.diff(np.append(edges, len(s))), seg[edges]
    salt = mix(at + np.uint64(tag * 0x9E3779B97F4A7C15 & MASK))
    keys = [mix(sums ^ salt)]
    twice = at >= np.uint64(plain)
    weight = np.where(twice, np.minimum(sizes, 2), 1).sum()

    def less(which: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Keys of the segments which, each less one of its shingles."""
        n = np.where(which & (sizes > 1), sizes, 0)
        return mix((np.repeat(sums, n) - mixed[np.repeat(n > 0, sizes)]) ^ np.repeat(salts, n))

    if twice.any():
        keys.append(less(twice, salt))
    if weight <= h:
        other = mix(salt + np.uint64(77))
        keys += [mix(sums ^ other), less(np.ones(len(at), bool), other)]
        if np.minimum(sizes, 2).sum() <= h:
            keys.append(mix(np.array([tag + (1 << 40)], np.uint64)))
    return np.concatenate(keys)


def price_of(sets: int) -> float:
    """What a meeting by chance costs, in keys written. A set meets more others the more there are, so keys are rarer in a larger corpus."""
    return 2.0 * math.sqrt(sets / (1 << 18))


def keys_of(s: np.ndarray, num: int, den: int, price: float = 2.0) -> np.ndarray:
    """Keys of a sorted set in its own band's scheme and in that of the band below, whose sets may be similar."""
    table = schemes(num, den, 1 << max(14, int(len(s)).bit_length()), price)
    k = next(i for i, x in enumerate(table) if x[1] >= len(s))
    return np.unique(np.concatenate([content_keys(s, table[i][3], table[i][4], table[i][2], i + 1) for i in (k - 1, k) if i >= 0]))


def set_of(text: str | None, n: int, hasher: WordHasher) -> np.ndarray:
    return np.unique(shingles(hasher(text.encode("utf-8", "surrogatepass"))[0], n)) if text else np.zeros(0, np.uint64)


def most_apart(a, b, num: int, den: int):
    """In how many shingles sets of these sizes can differ at most if they are similar."""
    return (den - num) * (a + b) // (den + num)


def parities(s: np.ndarray, num: int, den: int) -> bytes:
    """Bit k tells whether an odd number of shingles hash to k. Two sets differ in at least as many shingles as their parities differ in
    bits, also when both are folded to fewer bits; there are so many bits that unlike sets of this size differ in more than is allowed."""
    need = 2.6 * most_apart(len(s), len(s) * den // num, num, den) + 64
    size = 64
    while size < need:
        size *= 2
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _long(x: np.ndarray) -> np.ndarray:
    return np.asarray(x).view(np.int64)


def _node(s: np.ndarray) -> int:
    """Number of a set: 64 bits that follow from its shingles alone."""
    return int(_long(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))))[0])


def _passes(docs: DataFrame, n: int, size: int = 500):
    """mapInArrow over id and text with a function of ids and sets of some rows."""

    def over(make, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, made = WordHasher(BLANKS), make()
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    found = made(part.column(0), [set_of(t, n, hasher) for t in part.column(1).to_pylist()])
                    if found is not None:
                        yield found

        return docs.mapInArrow(run, schema)

    return over


def _signs(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, size, number of the set and its parities for each row. An empty set's number follows from the id; null without one."""

    def make():
        def batch(ids, sets):
            cols = [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([parities(s, num, den) if len(s) else None for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "node", "bits"])

        return batch

    rows = _passes(docs, n)(make, "doc_id long, n long, node long, bits binary")
    return rows.withColumn("node", F.coalesce("node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("empty")))))


def _keys(docs: DataFrame, n: int, num: int, den: int, price: float) -> DataFrame:
    """key and node of each set."""

    def make():
        seen: set[int] = set()

        def batch(_, sets):
            nodes, keys = [], []
            for s in sets:
                if len(s) and (node := _node(s)) not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    nodes.append(node)
                    keys.append(_long(keys_of(s, num, den, price)))
            if not nodes:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes, np.int64), list(map(len, keys))))], names=["key", "node"])

        return batch

    return _passes(docs, n)(make, "key long, node long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """node and shingles of each row that has some."""

    def make():
        def batch(_, sets):
            sets = [s for s in sets if len(s)]
            if not sets:
                return None
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_long(np.concatenate(sets))))], names=["node", "items"])

        return batch

    return _passes(docs, n)(make, "node long, items array<long>")


def _near(num: int, den: int):
    """For rows gid, node, n, bits sorted by gid: edges a, b that join the sets of a gid which may be similar, as far as their sizes and
    parities tell. A set that is reached is held against those that aren't yet, so sets that are alike take linear time."""

    def parts(nodes: np.ndarray, n: np.ndarray, bits: list[bytes]) -> Iterator[tuple[int, int]]:
        size = min(map(len, bits)) // 8
        rows = np.empty((len(nodes), size), np.uint64)
        for k, b in enumerate(bits):
            x = np.frombuffer(b, np.uint64)
            rows[k] = x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size))
        left = np.arange(len(nodes))
        while len(left) > 1:
            first, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                k = front.pop()
                m = n[left]
                near = np.bitwise_count(rows[left] ^ rows[k]).sum(1) <= most_apart(m, n[k], num, den)
                near &= den * np.minimum(m, n[k]) >= num * np.maximum(m, n[k])
                for j in left[near].tolist():
                    front.append(j)
                    if nodes[j] != nodes[first]:
                        yield int(nodes[j]), int(nodes[first])
                left = left[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in ended(batches):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            keys = table.column("gid").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
            if batch is not None:
                held = table.slice(cuts[-2])
                cuts.pop()
            nodes, n, bits = table.column("node").to_numpy(), table.column("n").to_numpy(), table.column("bits").slice(0, cuts[-1]).to_pylist()
            edges = {e for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for e in parts(nodes[a:b], n[a:b], bits[a:b])}
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(num: int, den: int):
    """For rows gid, node, items sorted by gid: edges a, b that join the sets of a gid which are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gid"):
            table = table.combine_chunks()
            nodes, items = table.column("node").to_numpy(), table.column("items").chunk(0)
            n = np.diff(items.offsets.to_numpy())
            flat, row = items.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), n)
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
            gram = np.cumsum(fresh) - 1
            counts = np.bincount(gram)
            both = counts[gram] > 1
            gram = np.unique(gram[both], return_inverse=True)[1]
            row = row[both]
            common = np.zeros((len(nodes), len(nodes)), np.float32)
            width = int(gram.max()) + 1 if len(gram) else 0
            for at in range(0, width, 8192):
                a, b = np.searchsorted(gram, [at, at + 8192])
                dense = np.zeros((len(nodes), min(8192, width - at)), np.float32)
                dense[row[a:b], gram[a:b] - at] = 1
                common += dense @ dense.T
            inter = common.astype(np.int64)
            linked = (den * inter >= num * (n[:, None] + n[None, :] - inter)) & (inter > 0)
            np.fill_diagonal(linked, False)
            label = forest(linked)
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

    return run


def _first(members: DataFrame, group: str, size: int) -> DataFrame:
    """gid and node: the blocks of each group of members (group, node, k), each but the first together with the first, so that a set meets
    its own block and the first one. This is linear in the group, and most large groups become one component by it."""
    rows = members.withColumn("blocks", F.ceil(F.col("k") / size).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) WHEN block = 0 THEN sequence(1, blocks - 1) ELSE array(block) END")))
    return rows.select(F.xxhash64(group, "other").alias("gid"), "node")


def _rest(members: DataFrame, joined: DataFrame, group: str, size: int) -> DataFrame | None:
    """gid and node: in groups of several blocks, what the first round left outside the group's largest component, in blocks with all of the
    group; None if nothing is left."""
    large = members.where(F.col("k") > size).join(joined.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = large.groupBy(group, "comp").agg(F.countDistinct("node").alias("k"))
    core = counts.groupBy(group).agg(F.max(F.struct("k", "comp")).alias("x"), F.count("*").alias("comps"), F.sum("k").alias("total")).where("comps > 1")
    core = cut(core.select(group, F.col("x.comp").alias("core"), F.ceil(F.col("x.k") / size).cast("int").alias("cores"), F.ceil((F.col("total") - F.col("x.k")) / size).cast("int").alias("others")))
    if core.isEmpty():
        return None
    rows = large.join(core, group).withColumn("inner", F.expr("comp = core"))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(node), CASE WHEN inner THEN cores ELSE others END) as int)"))
    # Blocks of others are 0 .. others - 1, those of the core follow. A block of others meets itself, later ones and the core's.
    rows = rows.withColumn("me", F.expr("CASE WHEN inner THEN others + block ELSE block END"))
    rows = rows.withColumn("other", F.explode(F.expr("CASE WHEN inner THEN sequence(0, others - 1) ELSE sequence(0, others + cores - 1) END")))
    return rows.select(F.xxhash64(group, F.least("me", "other"), F.greatest("me", "other"), F.lit(2)).alias("gid"), "node").distinct()


def _joined(members: DataFrame, values: DataFrame, group: str, size: int, links) -> DataFrame:
    """node and component of the nodes that links (a function of sorted rows gid, node and values) joins within groups."""

    def edges(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(values, "node").select("gid", "node", *(c for c in values.columns if c != "node"))
        return cut(rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(links, "a long, b long"))

    joined = connected_components(edges(_first(members, group, size)))
    if members.where(F.col("k") > size).isEmpty():
        return joined
    pairs = _rest(members, joined, group, size)
    if pairs is None:
        return joined
    return connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges(pairs)))


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of docs (doc_id, text): rows (doc_id, n, node; node is null for an empty text without id), classes (node, class_id, k: the rows that
    have the set), joined (node and component of each set that is similar to another), and the number of rows."""
    signed = cut(_signs(docs, n, num, den))
    total = signed.count()
    # A class has one size; its rows have the same bits.
    classes = cut(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.count("*").alias("k")))
    rows = signed.select("doc_id", "n", "node")
    own = lookup(rows.where("doc_id IS NOT NULL"), classes.select("node", "class_id", "k"), "node", total)
    copies = cut(own.groupBy("doc_id").agg(F.max(F.expr("doc_id = class_id")).alias("rep")).where("NOT rep").select("doc_id"))
    reps = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti").select("doc_id", "text")

    keyed = _keys(reps, n, num, den, price_of(total)).repartition("key")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("k")).where("a <> z").select("key", "k")
    met = cut(keyed.join(hubs.hint("shuffle_hash"), "key"))
    clusters = _joined(met, classes.select("node", "n", "bits"), "key", WIDE, _near(num, den)).withColumnRenamed("component", "cluster")

    wanted = cut(clusters.select("node").join(classes.select("node", "class_id"), "node").where("class_id IS NOT NULL").select(F.col("class_id").alias("doc_id")).distinct())
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi").union(docs.where("doc_id IS NULL"))
    sets = cut(_sets(texts, n).join(clusters.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("k"))
    joined = _joined(lookup(clusters, sizes, "cluster", total), sets, "cluster", BLOCK, _links(num, den))
    return rows, classes.select("node", "class_id", "k"), joined, total


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reached by links) and class_id (smallest id with the same set) of each row.

    Sets hold the distinct runs of n words (A-Z lowered, words cut at blanks), as 64-bit hashes; two rows link when
    den * |intersection| >= num * |union|. A text with fewer words is one shingle; null, empty and blank texts have no set, link
    with nothing and are their own component. Rows with equal sets are one class, which is joined once, whatever their ids. Rows that
    share an id count as one node with all their sets, and each gets its row. A row without id is a node by its set; it has its class's
    component, and null ids if no row reached has an id. Columns other than the two named are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, classes, joined, total = _components(docs, n, num, den)
    none, whole = F.lit(None).cast("long"), rows.where("node IS NOT NULL")
    several = cut(whole.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a"))
    if not several.isEmpty():
        same = whole.join(several, "doc_id").select("a", F.col("node").alias("b")).distinct()
        joined = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same))
    members = cut(classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    roots = members.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("nodes"))
    members = cut(lookup(members, roots, "component", total, "nodes").drop("component"))
    out = lookup(whole, members, "node", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    return out.union(rows.where("node IS NULL").select("doc_id", "n", none, none))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without near copies, all columns as they are: of each group of rows linked as in ngram_jaccard_join one stays, that of
    the smallest id (rows without id come last; of rows with the same id and set, any one).

    Here a row is a document by its text, so rows that share an id but not a set are in no common group for that. Null, empty and blank texts
    are in no group and stay. Rows are found by their ids, so texts are read again only of ids that several rows share, and of null ids.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, classes, joined, total = _components(texts, n, num, den)
    members = cut(classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # The first row of a component is of the class with the smallest id.
    roots = members.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("last"), "class_id", "node")).alias("first"), F.count("*").alias("nodes"))
    members = cut(lookup(members, roots, "component", total, "nodes").select("node", "class_id", "k", (F.col("first.node") == F.col("node")).alias("first")))
    marked = lookup(rows.where("n > 0"), members, "node", total).select("doc_id", "node", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))
    ids = cut(marked.union(rows.where("n = 0").select("doc_id", "node", F.lit(True))).groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("k")).where("doc_id IS NULL OR NOT stays OR k > 1"))
    gone, mixed = ids.where("doc_id IS NOT NULL AND NOT stays").select("doc_id"), ids.where("doc_id IS NULL OR (stays AND k > 1)")
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    key = F.col(id_col).cast("long")
    kept = docs.withColumn(KEY, key).join(small(gone.withColumnRenamed("doc_id", KEY)), KEY, "left_anti")
    if mixed.isEmpty():
        return kept.select(docs.columns)
    listed = small(mixed.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(KEY)))
    alone = kept.where(F.col(KEY).isNotNull()).join(listed, KEY, "left_anti").select(docs.columns)
    again = _numbered(kept.join(listed, KEY, "left_semi").union(kept.where(F.col(KEY).isNull())), text_col, n)
    empty = again.where(F.col(NODE).isNull())
    firsts = marked.where("stays").select(F.col("doc_id").alias(KEY), F.col("node").alias(NODE)).distinct()
    met = again.alias("r").join(firsts.alias("f"), F.col(f"r.{NODE}").eqNullSafe(F.col(f"f.{NODE}")) & F.col(f"r.{KEY}").eqNullSafe(F.col(f"f.{KEY}")), "left_semi")
    return alone.union(met.dropDuplicates([KEY, NODE]).select(docs.columns)).union(empty.select(docs.columns))


#: Names of columns that are added to a caller's.
KEY, NODE = "tidemark key", "tidemark node"


def _numbered(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """docs with the number of each row's set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BLANKS)
        for batch in batches:
            sets = (set_of(t, n, hasher) for t in batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist())
            nodes = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, NODE])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(NODE, LongType())]))
