"""Indexes of movies that the tests build box by box."""

import io
import struct

import pytest

from tidemark.operators import sampling
from tidemark.sources import movies

MATRIX = (65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def numbers(*values, form="I"):
    return struct.pack(f">{len(values)}{form}", *values)


def movie(handler=b"vide", matrix=MATRIX, edits=None, sizes=(10, 20, 30, 40, 50), shifts=((1, 0), (1, 80), (3, -40)), wide=False, fragmented=False, keys=(1, 4), lead=b""):
    chunks = full("co64", numbers(2), numbers(5_000_000_000, 6_000_000_000, form="Q")) if wide else full("stco", numbers(2, 100, 500))
    tables = [
        full("stsd", numbers(1), box("avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))),
        full("stts", numbers(2, 4, 40, 1, 60)),
        full("ctts", numbers(len(shifts)), *(struct.pack(">Ii", *x) for x in shifts), version=1),
        full("stsz", numbers(0, len(sizes), *sizes)),
        full("stsc", numbers(2, 1, 3, 1, 2, 2, 1)),
        chunks,
    ]
    if keys is not None:
        tables.append(full("stss", numbers(len(keys), *keys)))
    head = full("tkhd", bytes(36), struct.pack(">9i", *matrix), bytes(8))
    media = box("mdia", full("mdhd", numbers(0, 0, 1000, 200)), full("hdlr", bytes(4), handler, bytes(12)), box("minf", box("stbl", *tables)))
    edited = [box("edts", full("elst", numbers(len(edits)), *(struct.pack(">Iihh", *e) for e in edits)))] if edits is not None else []
    sound = box("trak", full("tkhd", bytes(84)), box("mdia", full("hdlr", bytes(4), b"soun", bytes(12))))
    rest = [box("mvex")] if fragmented else []
    return lead + box("moov", full("mvhd", numbers(0, 0, 600, 0)), sound, box("trak", head, *edited, media), *rest)


def read(data):
    return movies.read_movie(io.BytesIO(data), len(data))


def test_samples():
    told, index = read(movie())
    assert told == {"error": None, "codec": "avc1", "width": 640, "height": 360, "timescale": 1000, "offset_ms": 0.0, "samples": 5}
    got = {k: v.tolist() for k, v in index.items()}
    assert got == {
        "idx": [0, 1, 2, 3, 4],
        "dts": [0, 40, 80, 120, 160],
        "cts": [0, 120, 40, 80, 120],
        "timescale": [1000] * 5,
        "is_sync": [True, False, False, True, False],
        "offset": [100, 110, 130, 500, 540],
        "size": [10, 20, 30, 40, 50],
        "duration": [40, 40, 40, 40, 60],
    }
    assert all(read(movie(keys=None))[1]["is_sync"]) and read(movie(wide=True))[1]["offset"].tolist()[-1] == 6_000_000_040


def test_the_media_is_passed_over():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

    large = struct.pack(">I4sQ", 1, b"mdat", 16 + 3_000_000) + bytes(3_000_000)
    data = movie(lead=box("ftyp", b"isom") + large)
    assert movies.read_movie(Counted(data), len(data))[0]["samples"] == 5
    assert Counted.taken < 2000


@pytest.mark.parametrize("edits,want", [([], 0.0), ([(300, -1, 1, 0), (120, 80, 1, 0)], 420.0), ([(120, 80, 1, 0)], -80.0), ([(120, 80, 1, 0), (600, -1, 1, 0)], -80.0), ([(300, -1, 1, 0)], 0.0)])
def test_edits(edits, want):
    assert read(movie(edits=edits))[0]["offset_ms"] == want


FAULTS = {
    "fragmented": {"fragmented": True},
    "no video track": {"handler": b"text"},
    "turned": {"matrix": (0, 65536, 0, -65536, 0, 0, 0, 0, 1 << 30)},
    "no samples": {"sizes": ()},
    "an edit changes the speed": {"edits": [(120, 80, 2, 0)]},
    "several edits of the media": {"edits": [(120, 80, 1, 0), (120, 0, 1, 0)]},
    "samples without chunks": {"sizes": (1,) * 9},
}


@pytest.mark.parametrize("why", FAULTS)
def test_faults(why):
    with pytest.raises(movies.MovieError, match=why):
        read(movie(**FAULTS[why]))


def test_broken_files():
    whole = movie()
    for data in (b"", b"abc", b"\0" * 40, box("ftyp", b"isom"), b"\x47" * 400):
        with pytest.raises(movies.MovieError, match="no movie box"):
            read(data)
    for cut in range(16, len(whole), 7):
        # A movie box that says that it is shorter than what it holds.
        short = struct.pack(">I4s", cut, b"moov") + whole[8:cut]
        try:
            read(short)
        except movies.MovieError:
            pass


def test_index_of_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie(edits=[(300, -1, 1, 0), (120, 80, 1, 0)], lead=box("ftyp", b"isom")))
    (tmp_path / "b.mp4").write_bytes(b"nothing")
    rows = [("a", f"file:{tmp_path}/a.mp4"), ("b", str(tmp_path / "b.mp4")), ("c", str(tmp_path / "none.mp4")), ("d", None)]
    files = spark.createDataFrame(rows, "video_id string, path string")
    got = {x.video_id: x for x in movies.movies(files).collect()}
    assert (got["a"].error, got["a"].offset_ms, got["a"].samples) == (None, 420.0, 5) and got["b"].error == "no movie box"
    assert got["c"].error and got["d"].error == "no path"
    index = movies.frame_index(files)
    assert [tuple(x) for x in index.orderBy("idx").select("video_id", "cts", "offset", "is_sync").collect()] == [("a", 0, 100, True), ("a", 120, 110, False), ("a", 40, 130, False), ("a", 80, 500, True), ("a", 120, 540, False)]
    assert [x.margin_ms for x in sampling.reorder_margin(index).collect()] == [40.0]
    assert movies.movies(files.limit(0)).count() == 0
