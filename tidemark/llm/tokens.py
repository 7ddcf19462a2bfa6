"""Token counts and ids from public tokenizers, each distinct pre-token encoded once while a worker keeps it.

The vocabulary files stay where they are; operators take their path.
"""

from __future__ import annotations

import zlib
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import calm

#: Pre-tokens kept in a worker's dictionary (counts and ids); beyond that it starts anew. Longer ones aren't kept.
KEPT_COUNTS, KEPT_IDS, LONG = 600_000, 300_000, 64
#: Fixed value: the pre-token pattern of the byte-level vocabulary, as its file's pre-tokenizer applies it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to here are classed alike by every version of Unicode in use; texts with others go to the library whole.
PLAIN = regex.compile("[^\x00-ɏ‐-‧€]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Separate:
    """Ids of many short texts by few calls: joined by a special token, on both sides of which a tokenizer begins anew, and cut there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [x.content for x in added.values()]
        self.mark, self.joint = next(iter(added.items()))

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 1000):
            some = texts[at : at + 1000]
            if any(s in t for t in some for s in self.special):
                out += map(self.one, some)
                continue
            ids = self.one(self.joint.content.join(some))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                raise ValueError("the vocabulary's special token does not part texts")
            a = 0
            for b in (*cuts.tolist(), len(ids)):
                out.append(ids[a:b])
                a = b + 1
        return out


class Known:
    """A value for each distinct key, computed once while it is kept: long keys aren't kept, and all go when there are too many."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.kept = compute, most, {}

    def of(self, keys) -> Callable:
        """A function that gives the values of these keys."""
        new = [k for k in keys if k not in self.kept]
        if new and len(self.kept) + len(new) > self.most:
            self.kept.clear()
            new = list(keys)
        if not new:
            return self.kept.__getitem__
        found = dict(zip(new, self.compute(new), strict=True))
        self.kept.update((k, v) for k, v in found.items() if len(k) <= LONG)
        if all(len(k) <= LONG for k in new):
            return self.kept.__getitem__
        return ChainMap(self.kept, found).__getitem__


class WordCounter:
    """Number of tokens of a text. Words between ASCII blanks are the pre-tokens: the tokenizer drops blanks, and neither its
    normaliser nor its pieces join what stands on both sides of one. A word is counted by the library, once."""

    def __init__(self, path: str):
        each = Separate(path)
        self.known = Known(lambda words: list(map(len, each(words))), KEPT_COUNTS)

    def count(self, texts: list[str]) -> list[int]:
        """Pre-token frequencies of each text, the counts of new pre-tokens, and the sum of their products."""
        tables = [Counter(t.translate(BLANKS).split(" ")) for t in texts]
        get = self.known.of({w for table in tables for w in table})
        return [sum(map(int.__mul__, map(get, table), table.values())) for table in tables]


@lru_cache(maxsize=2)
def word_counter(path: str) -> WordCounter:
    """The counter of this worker process: what one task has learned serves the next."""
    return WordCounter(path)


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


BLANKS = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, as the vocabulary's library counts the whole text.

    Null and empty texts have 0 of both. Repeated rows and repeated or null ids each give a row. Columns other than the two named
    are not read. Frequencies are joined to counts where the text is, in a dictionary of the worker, so nothing is shuffled; texts are
    taken about 4 million characters at a time, and a longer text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = word_counter(path)
        for ids, texts in parts(batches):
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    calm(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def parts(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of the batches in runs of about `most` characters."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        at, size = 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.column(0).slice(at, k - at), texts[at:k]
                at, size = k, 0
            size += len(t)
        if at < len(texts):
            yield batch.column(0).slice(at), texts[at:]


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """Entries of a byte-level vocabulary as bytes: it writes printable bytes as themselves and the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    return {bytes(byte[c] for c in word): k for word, k in vocab.items() if all(c in byte for c in word)}


class IdEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to those of the library for the file.

    The merges of this vocabulary are in the order of its ids, so the faster library for ranked bytes gives the same ids; special tokens
    are found in the text first, as the file's library does. A text is cut at its spaces. If no part is empty or begins or ends with white
    space, a space always begins the pre-token after it, so each part is encoded by itself, with the space before it, once. Other texts
    are encoded whole; those with characters that versions of Unicode may class differently by the file's library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = {x.content for x in self.library.get_added_tokens_decoder().values()}
        with open(path, encoding="utf-8") as f:
            vocab = {k: v for k, v in json.load(f)["model"]["vocab"].items() if k not in added}
        self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=byte_ranks(vocab), special_tokens={})
        self.special = sorted(added)
        self.tab, self.parts = self.ranked.encode_single_token(b"\t"), Known(self.each, KEPT_IDS)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids if PLAIN.search(text) or any(s in text for s in self.special) else self.ranked.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def each(self, parts: list[str]) -> list[bytes]:
        """Ids of parts with a space before each: of many at once, parted by a tab, which before a space is a pre-token and an id of its own."""
        text = "\t ".join(["", *parts])
        if text.count("\t") > len(parts) or PLAIN.search(text) or any(s in text for s in self.special):
            return [self.whole(" " + p) for p in parts]
        ids = np.array(self.ranked.encode_ordinary(text), "<u4")
        cuts = np.flatnonzero(ids == self.tab)
        if len(cuts) != len(parts):
            return [self.whole(" " + p) for p in parts]
        data, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip((4 * cuts + 4).tolist(), ends, strict=True)]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *parts = text.split(" ")
        known = self.parts.kept
        if first and (first[0].isspace() or first[-1].isspace()):
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(known.__getitem__, parts))
        except KeyError:
            if any(not p or p[0].isspace() or p[-1].isspace() for p in {p for p in parts if p not in known}):
                return self.whole(text)
            return self.whole(first) + b"".join(map(self.parts.of(set(parts)), parts))


def cut_pieces(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """start, length and crc32 of a document's pieces of at most size ids; the first takes what is left over."""
    n = len(ids) // 4
    first = n % size or min(n, size)
    at, out = 0, []
    while at < n:
        length = first if at == 0 else size
        out.append((at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
        at += length
    return out
