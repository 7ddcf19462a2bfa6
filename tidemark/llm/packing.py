"""Best-fit packing of documents into token sequences, with a bounded number of open bins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import cut_pieces, id_encoder, parts, two


class BestFit:
    """Online best fit with at most `most` open bins of `size`. Bit f of a bitset is set while an open bin has f free places, so
    the best bin for a piece of n is the lowest bit from n up; when all bins are open, the fullest (the lowest bit) closes."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.open, self.made = size, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of n."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.made, self.size
            self.made += 1
        if left := free - n:
            self.bins[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.size - free


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, open_bins: int = 16384, share: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    A document is the ids of its whole text and end_id; a null or empty text is end_id alone. Only longer ones than size are cut, the
    first piece taking what is left over. Pieces are dealt by hash to packers of about `share` documents, each of which takes them in
    the order of decreasing length (ties by id, piece and checksum, so that a repeated task packs alike) with at most open_bins open
    bins. Rows with repeated or null ids are packed each by itself. Columns other than the two named are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = id_encoder(path), int(end_id).to_bytes(4, "little")
        for ids, texts in parts(batches):
            rows = [(i, k, *x) for i, t in zip(ids.to_pylist(), texts, strict=True) for k, x in enumerate(cut_pieces(encoder(t) + last, size))]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(size, open_bins), (TaskContext.get().partitionId()) << 40
        for batch in batches:
            if batch.num_rows:
                placed = [bins.place(n) for n in batch.column("length").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + a for a, _ in placed], pa.int64()), pa.array([b for _, b in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    pieces = cut(two(docs, id_col, text_col).mapInArrow(encode, schema))
    packers = max(1, round(pieces.where("piece = 0").count() / share))
    dealt = pieces.repartition(packers, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(fill, schema + ", sequence_id long, offset long")
