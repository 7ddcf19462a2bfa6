"""Indexes of MP4 and MOV files: what their movie box tells of the video track, without decoding and without reading the media.

Only box headers and the movie box are read, by seeking, so a file of any size costs what its index takes, wherever in the file that lies.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as s

#: Samples of a batch of the frame index.
BATCH = 100_000

Box = tuple[str, int, int]


class MovieError(ValueError):
    """The file can't be used, and why."""


def _boxes(data: bytes, start: int, end: int) -> Iterator[Box]:
    """Kind, begin and end of what each box holds. A size of 0 is up to the end, of 1 is in the 8 bytes after the kind."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        stop = end if size == 0 else start + size
        if stop > end or stop < start + head:
            raise MovieError("a box ends outside of the one around it")
        yield kind.decode("latin-1"), start + head, stop
        start = stop


def _find(data: bytes, around: Box | None, *path: str) -> Box | None:
    """The first box of each kind on a path."""
    for kind in path:
        around = next((b for b in _boxes(data, *around[1:]) if b[0] == kind), None) if around else None
    return around


def _must(data: bytes, around: Box, *path: str) -> Box:
    found = _find(data, around, *path)
    if not found:
        raise MovieError(f"no {'/'.join(path)} box")
    return found


def _table(data: bytes, box: Box, kind: str, columns: int = 1, at: int = 4) -> np.ndarray:
    """Rows of big-endian numbers after their count at `at`."""
    count = struct.unpack_from(">I", data, box[1] + at)[0]
    kind = np.dtype(kind)
    if box[1] + at + 4 + count * columns * kind.itemsize > box[2]:
        raise MovieError(f"the {box[0]} box is too short")
    rows = np.frombuffer(data, kind, count * columns, box[1] + at + 4).astype(np.int64)
    return rows.reshape(count, columns) if columns > 1 else rows


def _timescale(data: bytes, box: Box) -> int:
    scale = struct.unpack_from(">I", data, box[1] + (20 if data[box[1]] else 12))[0]
    if not scale:
        raise MovieError("a timescale of zero")
    return scale


def movie_box(file: BinaryIO, size: int) -> bytes:
    """What the movie box holds: the file is read from header to header up to it."""
    at = 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(16)
        length, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if length == 1 and len(head) == 16:
            length, skip = struct.unpack_from(">Q", head, 8)[0], 16
        end = size if length == 0 else at + length
        if end < at + skip or end > size:
            break
        if kind == b"moov":
            file.seek(at + skip)
            return file.read(end - at - skip)
        at = end
    raise MovieError("no movie box")


def _sizes(data: bytes, table: Box) -> np.ndarray:
    if found := _find(data, table, "stsz"):
        one, count = struct.unpack_from(">II", data, found[1] + 4)
        return np.full(count, one, np.int64) if one else _table(data, found, ">u4", at=8)
    found = _must(data, table, "stz2")
    bits, count = data[found[1] + 7], struct.unpack_from(">I", data, found[1] + 8)[0]
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, -(-count // 2), found[1] + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:count].astype(np.int64)
    return _table(data, found, ">u2" if bits == 16 else ">u1", at=8)


def _offsets(data: bytes, table: Box, sizes: np.ndarray) -> np.ndarray:
    """Place of each sample: its chunk's, and the samples before it in there."""
    small = _find(data, table, "stco")
    chunks = _table(data, small, ">u4") if small else _table(data, _must(data, table, "co64"), ">u8")
    runs = _table(data, _must(data, table, "stsc"), ">u4", 3)
    if not len(runs):
        raise MovieError("samples without chunks")
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)).clip(0))[: len(chunks)]
    chunk = np.repeat(np.arange(len(each)), each)[: len(sizes)]
    if len(chunk) < len(sizes):
        raise MovieError("samples without chunks")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, chunk, "left")
    return chunks[chunk] + before - before[first]


def _spread(pairs: np.ndarray, count: int) -> np.ndarray:
    """Values of (how many, value), for each sample; 0 for those that the table leaves out."""
    values = np.repeat(pairs[:, 1], pairs[:, 0].clip(0, count))[:count]
    return np.pad(values, (0, count - len(values)))


def _offset_ms(data: bytes, track: Box, movie_scale: int, track_scale: int) -> float:
    """By the edit list: the length of the empty edits before the media's only edit, less where that begins."""
    found = _find(data, track, "edts", "elst")
    if not found:
        return 0.0
    wide = data[found[1]] == 1
    form, step = (">Qqhh", 20) if wide else (">Iihh", 12)
    count = struct.unpack_from(">I", data, found[1] + 4)[0]
    if found[1] + 8 + count * step > found[2]:
        raise MovieError("the elst box is too short")
    edits = [struct.unpack_from(form, data, found[1] + 8 + k * step) for k in range(count)]
    if any(edit[2:] != (1, 0) for edit in edits):
        raise MovieError("an edit changes the speed")
    media = [k for k, edit in enumerate(edits) if edit[1] != -1]
    if len(media) > 1:
        raise MovieError("several edits of the media")
    if not media:
        return 0.0
    return sum(edit[0] for edit in edits[: media[0]]) / movie_scale * 1000 - edits[media[0]][1] / track_scale * 1000


def read_movie(file: BinaryIO, size: int) -> tuple[dict[str, Any], dict[str, np.ndarray]]:
    """What a row of MOVIE tells of the first video track, and the columns of its frame index in decoding order. MovieError for files that are
    fragmented, turned, without a video track or samples, or edited in other ways than a start and a pause before it."""
    data = movie_box(file, size)
    try:
        return _read(data, ("moov", 0, len(data)))
    except (struct.error, ValueError, IndexError) as broken:
        raise broken if isinstance(broken, MovieError) else MovieError(f"a broken box: {broken}") from broken


def _read(data: bytes, movie: Box) -> tuple[dict[str, Any], dict[str, np.ndarray]]:
    if _find(data, movie, "mvex"):
        raise MovieError("fragmented")
    tracks = [b for b in _boxes(data, *movie[1:]) if b[0] == "trak"]
    handlers = ((b, _find(data, b, "mdia", "hdlr")) for b in tracks)
    track = next((b for b, h in handlers if h and data[h[1] + 8 : h[1] + 12] == b"vide"), None)
    if not track:
        raise MovieError("no video track")
    head = _must(data, track, "tkhd")
    a, b, _, c, d = struct.unpack_from(">5i", data, head[1] + (52 if data[head[1]] else 40))
    if b or c or a < 0 or d < 0:
        raise MovieError("turned")
    movie_scale, scale = _timescale(data, _must(data, movie, "mvhd")), _timescale(data, _must(data, track, "mdia", "mdhd"))
    table = _must(data, track, "mdia", "minf", "stbl")
    sizes = _sizes(data, table)
    count = len(sizes)
    if not count:
        raise MovieError("no samples")
    entry = next(_boxes(data, (kinds := _must(data, table, "stsd"))[1] + 8, kinds[2]), None)
    if not entry:
        raise MovieError("no description of samples")
    width, height = struct.unpack_from(">HH", data, entry[1] + 24)
    length = _spread(_table(data, _must(data, table, "stts"), ">u4", 2), count)
    dts = np.cumsum(length) - length
    shift, keys = _find(data, table, "ctts"), _find(data, table, "stss")
    # Shifts are signed in version 1; files of version 0 with signed ones are common.
    cts = dts + (_spread(_table(data, shift, ">i4", 2), count) if shift else 0)
    sync = np.ones(count, bool)
    if keys:
        sync[:] = False
        at = _table(data, keys, ">u4") - 1
        sync[at[(at >= 0) & (at < count)]] = True
    told = {"error": None, "codec": entry[0], "width": width, "height": height, "timescale": scale, "offset_ms": _offset_ms(data, track, movie_scale, scale), "samples": count}
    index = {"idx": np.arange(count), "dts": dts, "cts": cts, "timescale": np.full(count, scale), "is_sync": sync, "offset": _offsets(data, table, sizes), "size": sizes, "duration": length}
    return told, index


def _opened(path: str) -> tuple[BinaryIO, int]:
    """A file of a local path or of any URI that Arrow's file systems open."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def movies(files: DataFrame) -> DataFrame:
    """A row of MOVIE for each file (video_id, path); one that can't be read has an error, as a file among many must not stop a scan."""
    arrow = to_arrow_schema(s.MOVIE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"video_id": v} | _told(p) for v, p in zip(*batch.to_pydict().values(), strict=True)], schema=arrow)

    return files.selectExpr("CAST(video_id AS STRING) AS video_id", "CAST(path AS STRING) AS path").mapInArrow(run, s.MOVIE)


def _told(path: str | None) -> dict[str, Any]:
    try:
        if path is None:
            raise MovieError("no path")
        file, size = _opened(path)
        with file:
            return read_movie(file, size)[0]
    except (MovieError, OSError, pa.ArrowException) as error:
        return dict.fromkeys(s.MOVIE.names[2:]) | {"error": str(error)}


def frame_index(files: DataFrame) -> DataFrame:
    """Samples of the files that can be read, in the columns of FRAME_INDEX; those of the others are none."""
    arrow = to_arrow_schema(s.FRAME_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, path in zip(*batch.to_pydict().values(), strict=True):
                try:
                    file, size = _opened(path or "")
                    with file:
                        index = read_movie(file, size)[1]
                except (MovieError, OSError, pa.ArrowException):
                    continue
                for at in range(0, len(index["idx"]), BATCH):
                    part = {name: values[at : at + BATCH] for name, values in index.items()}
                    columns = [pa.array([video] * len(part["idx"]), pa.string()), *(pa.array(part[f.name]).cast(f.type) for f in list(arrow)[1:])]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return files.selectExpr("CAST(video_id AS STRING) AS video_id", "CAST(path AS STRING) AS path").mapInArrow(run, s.FRAME_INDEX)
