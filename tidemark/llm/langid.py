"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Every position of a text gets language probabilities from the states of both directions; a document's are their mean. Runs of a text
are read side by side, with the bytes around them, so that states go over from run to run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import parts, two

#: Bytes of a run, bytes that are read around it, and bytes of the rows that are learned.
SPAN, WARM, LEARNED = 256, 24, 64
LETTER = regex.compile(r"\p{L}").search


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """For each direction: input tables wx (byte by gates r, z and candidate), u (state by gates), bias; then out and its bias."""

    def __init__(self, labels: list[str], width: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.width = labels, width
        put = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{n}{d}": a for d in "fb" for n, a in (("x", put(256, 3 * width)), ("u", put(width, 3 * width)))}
        self.p |= {"o": put(2 * width, len(labels)), "c": np.zeros(len(labels), np.float32)}

    def states(self, data: np.ndarray, d: str, keep: bool = False):
        """States after each byte of rows of equal length; keep: with what the backward pass needs."""
        n, steps, w = len(data), data.shape[1], self.width
        x, u, h = self.p["x" + d], self.p["u" + d], np.zeros((n, w), np.float32)
        out, kept = np.empty((steps, n, w), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = x[data[:, t]], h @ u
            g = sigmoid(a[:, : 2 * w] + b[:, : 2 * w])
            c = np.tanh(a[:, 2 * w :] + g[:, :w] * b[:, 2 * w :])
            new = h + g[:, w:] * (c - h)
            if keep:
                kept.append((t, h, b[:, 2 * w :], g, c))
            out[t] = h = new
        return (out, kept) if keep else out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Language probabilities at each position: steps by rows by labels."""
        s = np.concatenate([self.states(data, "f"), self.states(data, "b")], 2)
        y = s @ self.p["o"] + self.p["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        return y / y.sum(2, keepdims=True)

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of rows with one label each, summed over positions and divided by their number."""
        w, grads = self.width, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self.states(data, d, True) for d in "fb"}
        s = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        y = s @ self.p["o"] + self.p["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        rows = np.arange(len(data))
        loss = -np.log(y[:, rows, target] + 1e-9).mean()
        y[:, rows, target] -= 1
        y /= data.size
        grads["o"] = np.einsum("tnk,tnl->kl", s, y, optimize=True)
        grads["c"] = y.sum((0, 1))
        ds = y @ self.p["o"].T
        for k, d in enumerate("fb"):
            u, dh, each = self.p["u" + d], np.zeros((len(data), w), np.float32), []
            for t, h, b, g, c in reversed(runs[d][1]):
                dh = dh + ds[t][:, k * w : (k + 1) * w]
                r, z = g[:, :w], g[:, w:]
                dc = dh * z * (1 - c * c)
                da = np.concatenate([dc * b * r * (1 - r), dh * (c - h) * z * (1 - z), dc], 1)
                db = np.concatenate([da[:, : 2 * w], dc * r], 1)
                each.append((data[:, t], da))
                grads["u" + d] += h.T @ db
                dh = dh * (1 - z) + db @ u.T
            at, da = (np.concatenate(x) for x in zip(*each, strict=True))
            for j in range(3 * w):
                grads["x" + d][:, j] = np.bincount(at, da[:, j], 256)
        return float(loss), grads

    def fit(self, data: np.ndarray, target: np.ndarray, rounds: int = 3, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Network:
        """Adam over shuffled rows."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(rounds):
            order = rng.permutation(len(data))
            for at in range(0, len(order), batch):
                some, step = order[at : at + batch], step + 1
                for k, g in self.gradients(data[some], target[some])[1].items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


class Reader:
    """Document probabilities with a trained network: the same sums as Network.positions, in buffers that stay in the cache.

    A text is read in runs of SPAN bytes side by side. Each direction begins WARM bytes before its run (after it, backwards), so that its
    state at the run's first byte is that of a reading of the whole text but for what it still remembers of more distant bytes; only where
    a text begins or ends it starts from zero. sigmoid(x) is 0.5 + 0.5 * tanh(x / 2), so one tanh does both gates; the halves are folded
    into the weights.
    """

    ROWS = 1024

    def __init__(self, net: Network):
        w = self.w = net.width
        half = np.concatenate([np.full(2 * w, 0.5), np.ones(w)]).astype(np.float32)
        self.labels, self.side = net.labels, {d: (np.ascontiguousarray(net.p["x" + d] * half), np.ascontiguousarray(net.p["u" + d] * half)) for d in "fb"}
        self.out = {"f": net.p["o"][:w].copy(), "b": net.p["o"][w:].copy()}
        self.bias = net.p["c"]

    def rows(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sum of position probabilities of each row over its `own` bytes from place WARM on; its text lies from begin to end (exclusive)."""
        n, w, span = len(data), self.w, int(own.max())
        turned = np.ascontiguousarray(data.T)
        logits = np.empty((span, n, len(self.labels)), np.float32)
        a, b, h, c = np.empty((n, 3 * w), np.float32), np.empty((n, 3 * w), np.float32), np.zeros((n, w), np.float32), np.empty((n, w), np.float32)
        late, least, most = int(begin.max()), int(end.min()), int(end.max())
        for d in "fb":
            x, u = self.side[d]
            h[:] = 0
            for t in range(int(begin.min()), WARM + span) if d == "f" else range(most - 1, WARM - 1, -1):
                np.take(x, turned[t], axis=0, out=a, mode="clip")
                np.matmul(h, u, out=b)
                g = a[:, : 2 * w]
                g += b[:, : 2 * w]
                np.tanh(g, out=g)
                g *= 0.5
                g += 0.5
                np.multiply(g[:, :w], b[:, 2 * w :], out=c)
                c += a[:, 2 * w :]
                np.tanh(c, out=c)
                c -= h
                c *= g[:, w:]
                h += c
                if d == "f" and t < late:
                    h[begin > t] = 0
                if d == "b" and t >= least:
                    h[end <= t] = 0
                if d == "f" and t >= WARM:
                    np.matmul(h, self.out[d], out=logits[t - WARM])
                elif d == "b" and t < WARM + span:
                    logits[t - WARM] += h @ self.out[d]
        logits += self.bias
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        if int(own.min()) < span:
            logits[np.arange(span)[:, None] >= own[None, :]] = 0
        return logits.sum(0, dtype=np.float64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities of each text: over the whole of it."""
        sizes = np.array([len(t) for t in texts])
        spans = -(-sizes // SPAN)
        total, owner = int(spans.sum()), np.repeat(np.arange(len(texts)), spans)
        number = np.arange(total) - np.repeat(np.cumsum(spans) - spans, spans)
        # Each text is padded by WARM to both sides, so that a run and what is around it are one slice of all texts.
        pad = b"\0" * (WARM + SPAN)
        flat = np.frombuffer(pad[:WARM] + b"".join(t + pad for t in texts), np.uint8)
        start = np.repeat(np.cumsum(sizes + len(pad)) - sizes - len(pad), spans) + number * SPAN
        left = np.repeat(sizes, spans) - number * SPAN
        own, begin, end = np.minimum(left, SPAN), np.where(number == 0, WARM, 0), WARM + np.minimum(left, SPAN + WARM)
        order = np.argsort(-own, kind="stable")
        sums, wide = np.zeros((len(texts), len(self.labels))), np.arange(SPAN + 2 * WARM)
        for at in range(0, total, self.ROWS):
            some = order[at : at + self.ROWS]
            data = flat[np.minimum(start[some][:, None] + wide, len(flat) - 1)]
            np.add.at(sums, owner[some], self.rows(data, begin[some], end[some], own[some]))
        return sums / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 600, width: int = 8) -> Network | None:
    """A network fitted on the whole texts of `sample` documents at most that have text and language and aren't held out: those of least
    hash, as many of each language as of the others where there are so many. Each language of the table can be learned while there are no more
    than `sample`. None if there is nothing to learn. The table is read twice: for the languages' counts, and for the sample.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.encode(F.col(text_col).cast("string"), "utf-8").alias("raw"))
    rows = rows.where(~held_out("i") & F.col("i").isNotNull() & F.col("lang").isNotNull() & (F.length("raw") > 0))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    if not languages:
        return None
    each, h = max(1, sample // languages), F.xxhash64("i")
    # Twice as many as are wanted are expected below the bound, so what is sorted doesn't grow with the table.
    below = (h.cast("double") + 2.0**63) * F.col("n") < (2 * each + 1000) * 2.0**64
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "i", "raw"))
    chosen = rows.withColumn("h", h).join(counts, "lang").where((F.col("n") <= 8 * each) | below).withColumn("rank", rank).where(F.col("rank") <= each)
    chosen = chosen.orderBy("rank", "h", "i", "raw").limit(sample).select("lang", "raw").collect()
    labels = sorted({r[0] for r in chosen})
    data, target = [], []
    for lang, raw in sorted((r[0], bytes(r[1])) for r in chosen):
        for at in range(0, len(raw), LEARNED):
            data.append((raw[at : at + LEARNED] if at + LEARNED <= len(raw) else raw[-LEARNED:]).ljust(LEARNED, b" "))
            target.append(labels.index(lang))
    return Network(labels, width).fit(np.frombuffer(b"".join(data), np.uint8).reshape(-1, LEARNED), np.array(target))


def languages(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its whole text alone.

    A null text, one without letters, and every text where nothing could be learned are `und` with score 0. Repeated rows and null
    ids (held_out false) each give a row. Columns other than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = network and Reader(network)
        for batch in batches:
            flags = batch.column(2)
            done = 0
            for ids, texts in parts(iter([batch]), 2_000_000):
                lang, score = predict(reader, texts)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), flags.slice(done, len(ids)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
                done += len(ids)

    rows = two(docs, id_col, text_col)
    return rows.select("doc_id", "text", held_out("doc_id").alias("h")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict(reader: Reader | None, texts: list[str]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    some = [k for k, t in enumerate(texts) if reader and LETTER(t)]
    if some:
        p = reader([texts[k].encode("utf-8", "surrogatepass") for k in some])
        for k, row in zip(some, p, strict=True):
            best = int(row.argmax())
            lang[k], score[k] = reader.labels[best], min(1.0, float(row[best]))
    return lang, score


def keep_known(docs: DataFrame, network: Network | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language (not `und`) with a score of at least `least`, all columns as they are. At a half, the language is
    likelier than all others together: texts of no learned language, or of several without one that prevails, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = network and Reader(network)
        for batch in batches:
            texts, keep, at = batch.column(batch.schema.get_field_index(text_col)).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 2_000_000):
                    size += len(texts[end] or "")
                    end += 1
                keep += [a != "und" and s >= least for a, s in zip(*predict(reader, [t or "" for t in texts[at:end]]), strict=True)]
                at = end
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
