"""AVI clips as a data source whose partitions are ranges of a file.

`spark.read.format("avi_frames").load(path)` lists files on the driver, by name and size
alone, and deals each into ranges of bytes; short files share a task, each counting for
some bytes more than it has. A task reads a file's headers and index, then the frames that
begin in its range and the one before them, which the first one's motion needs. So a long
clip is decoded by many tasks, many short ones by few, and none holds more than a stack of
frames (see decode.BATCH_BYTES) and the one before.

Frames are uncompressed (8-bit gray, 24 or 32-bit BGR, rows from the bottom up unless the
height is negative) or motion JPEG, which needs Pillow. The index is `idx1`; a file
without one, or with later RIFF segments, is walked chunk by chunk. Files that can't be
read give no rows.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.config import DEFAULTS, Settings
from tidemark.sources.decode import DECODED_ROWS, SIGNALS, frame_rows, to_small_gray

#: Bytes of a partition, unless an option says otherwise.
PARTITION_BYTES = 64 << 20
#: What opening a file counts for, in bytes: a partition has at most 256 files.
OPEN_BYTES = 256 << 10
# The names of chunks and codecs.
VIDEO, JPEG = (b"db", b"dc"), (b"MJPG", b"mjpg")
_INDEX = np.dtype([("name", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])


@dataclass(frozen=True)
class Header:
    """What a file says of its first video stream."""

    fps: float
    width: int
    height: int
    bits: int
    codec: bytes
    stream: bytes
    top_down: bool


def _chunks(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, where its data begins, size) of each chunk in a stretch of a file."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            return
        name, size = struct.unpack("<4sI", head)
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def _lists(f, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the lists of all RIFF segments, and of the index."""
    for name, at, size in _chunks(f, 0, end):
        if name != b"RIFF":
            continue
        for inner, begin, length in _chunks(f, at + 4, min(at + size, end)):
            if inner == b"LIST":
                f.seek(begin)
                yield f.read(4), begin + 4, begin + length
            else:
                yield inner, begin, begin + length


def _header(f, begin: int, end: int) -> Header:
    rate, number = 0.0, -1
    for name, at, size in _chunks(f, begin, end):
        f.seek(at)
        if name == b"avih":
            micros = struct.unpack("<I", f.read(4))[0]
            rate = 1e6 / micros if micros else 0.0
        elif name == b"LIST" and f.read(4) == b"strl":
            number += 1
            parts = {k: (a, n) for k, a, n in _chunks(f, at + 4, at + size)}
            f.seek(parts[b"strh"][0])
            head = f.read(28)
            if head[:4] != b"vids":
                continue
            scale, per = struct.unpack("<II", head[20:28])
            f.seek(parts[b"strf"][0])
            _, width, height, _, bits, codec = struct.unpack("<IiiHH4s", f.read(20))
            return Header(per / scale if scale else rate, width, abs(height), bits, codec, b"%02d" % number, height < 0)
    raise ValueError("no video stream")


def read_index(f, size: int) -> tuple[Header, np.ndarray, np.ndarray]:
    """(header, where each frame's data begins, its bytes) of an open file."""
    header, movies, index = None, [], None
    for kind, begin, end in _lists(f, size):
        if kind == b"hdrl":
            header = _header(f, begin, end)
        elif kind == b"movi":
            movies.append((begin, min(end, size)))
        elif kind == b"idx1" and index is None:
            f.seek(begin)
            index = np.frombuffer(f.read(min(end, size) - begin), np.uint8)
    if header is None or not movies:
        raise ValueError("not a clip")
    names = [header.stream + v for v in VIDEO]
    if index is not None and len(movies) == 1:
        rows = index[: len(index) // _INDEX.itemsize * _INDEX.itemsize].view(_INDEX)
        # offsets count from the list's name or from the file's first byte
        rows_at = rows["offset"].astype(np.int64)
        base = 0 if len(rows_at) and rows_at[0] >= movies[0][0] else movies[0][0] - 4
        mine = np.isin(rows["name"], names)
        starts, sizes = rows_at[mine] + base + 8, rows["size"][mine].astype(np.int64)
    else:
        found = []
        for begin, end in movies:
            for name, at, n in _chunks(f, begin, end):
                if name == b"LIST":
                    found += [(a, m) for k, a, m in _chunks(f, at + 4, at + n) if k in names]
                elif name in names:
                    found.append((at, n))
        starts, sizes = np.array(found, np.int64).reshape(-1, 2).T
    whole = starts + sizes <= size  # a file that breaks off has the frames that are there
    return header, starts[whole], sizes[whole]


def frame_image(header: Header, data: bytes) -> np.ndarray:
    """A frame as gray or BGR bytes, the first row on top."""
    if header.codec in JPEG:
        from PIL import Image  # optional: only compressed clips need it

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))[:, :, ::-1]
    if header.codec not in (b"\0\0\0\0", b"DIB ", b"RGB ") or header.bits not in (8, 24, 32):
        raise ValueError(f"frames of {header.codec!r} with {header.bits} bits can't be read")
    channels = header.bits // 8
    line = -(-header.width * channels // 4) * 4
    rows = np.frombuffer(data, np.uint8, line * header.height).reshape(header.height, line)[:, : header.width * channels]
    image = rows.reshape(header.height, header.width, channels) if channels > 1 else rows
    return (image if header.top_down else image[::-1])[..., :3] if channels > 1 else image if header.top_down else image[::-1]


def frame_images(header: Header, content: bytes, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The frames of a file's bytes, one by one; uncompressed ones that lie evenly are views of these."""
    raw = header.codec in (b"\0\0\0\0", b"DIB ", b"RGB ") and header.bits in (8, 24, 32)
    channels = header.bits // 8
    line = -(-header.width * channels // 4) * 4
    steps = np.unique(np.diff(starts))
    if not raw or len(steps) != 1 or steps[0] <= 0 or sizes.min() < line * header.height:
        return (frame_image(header, content[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True))
    body = np.frombuffer(content, np.uint8)[int(starts[0]) :]
    shape, strides = (len(starts), header.height, header.width), (int(steps[0]), line, channels)
    images = np.lib.stride_tricks.as_strided(body, shape, strides, writeable=False) if channels == 1 else np.lib.stride_tricks.as_strided(body, (*shape, channels), (*strides, 1), writeable=False)
    images = images if header.top_down else images[:, ::-1]
    return iter(images if channels == 1 else images[..., :3])


def decode_range(f, size: int, low: int, high: int, path: str, settings: Settings = DEFAULTS) -> Iterator[tuple]:
    """Rows of SIGNALS of the frames whose data begin in a range of bytes."""
    header, starts, sizes = read_index(f, size)
    first, after = np.searchsorted(starts, [low, high])
    after = min(int(after), settings.max_frames)

    def image(k: int) -> np.ndarray:
        f.seek(int(starts[k]))
        return frame_image(header, f.read(int(sizes[k])))

    if first >= after:
        return
    before = to_small_gray(image(int(first) - 1), settings) if first else None
    for values in frame_rows(map(image, range(int(first), after)), settings, int(first), before):
        yield (path, *values, len(starts), header.fps or settings.default_fps)


class AviDecoder:
    """A FrameDecoder for whole AVI files, as uploads bring them: frames are decoded one by one."""

    def open(self, content: bytes) -> tuple[float, int, Iterator[np.ndarray]]:
        f = io.BytesIO(content)
        header, starts, sizes = read_index(f, len(content))
        return header.fps, len(starts), frame_images(header, content, starts, sizes)


class Ranges(InputPartition):
    """(path, size, low, high) of some ranges of files."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], settings: Settings):
        self.root, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*.avi"))
        self.bytes, self.settings = max(1, int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))), settings

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        """Ranges of the files below the path, by names and sizes alone."""
        fs, root = self._fs()
        there = fs.get_file_info(root)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if there.type == pafs.FileType.Directory else [there]
        files = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and fnmatch(f.base_name, self.glob))
        out, held = [[]], 0
        for path, size in files:
            for low in range(0, size, self.bytes):
                high = min(low + self.bytes, size)
                if out[-1] and held + high - low + OPEN_BYTES > self.bytes:
                    out.append([])
                    held = 0
                out[-1].append((path, size, low, high))
                held += high - low + OPEN_BYTES
        return [Ranges(pieces) for pieces in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = self._fs()
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SIGNALS.split(", ")])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows: list[tuple] = []
        for path, size, low, high in partition.pieces:
            with fs.open_input_file(path) as f:
                try:
                    for row in decode_range(f, size, low, high, path, self.settings):
                        rows.append(row)
                        if len(rows) >= DECODED_ROWS:
                            yield batch(rows)
                            rows = []
                except (ValueError, KeyError, struct.error):
                    pass  # like a file that a decoder can't open: what was read of it stays
        if rows:
            yield batch(rows)


class AviFrames(DataSource):
    """Options: path, pathGlobFilter (*.avi), partitionBytes, maxFrames (frames of a clip, at most)."""

    @classmethod
    def name(cls) -> str:
        return "avi_frames"

    def schema(self) -> str:
        return SIGNALS

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("maxframes", self.options.get("maxFrames"))
        return _Reader(dict(self.options), Settings(max_frames=int(most)) if most else DEFAULTS)


def read_avi(spark: SparkSession, path: str, **options: str | int):
    """Frame signals (see decode.SIGNALS) of the AVI files below a path; clip_id is the file's."""
    spark.dataSource.register(AviFrames)
    return spark.read.format("avi_frames").options(**options).load(path)


# ---- writing


_GRAYS = b"".join(struct.pack("<I", k * 0x010101) for k in range(256))


def avi_head(width: int, height: int, channels: int, frames: int, fps: float) -> bytes:
    """All that stands before the first frame of an uncompressed clip with an index at its end."""
    size = frame_bytes(width, height, channels)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    micros, rate = round(1e6 / fps), round(fps * 1000)
    main = struct.pack("<14I", micros, 0, 0, 0x10, frames, 0, 1, size, width, height, 0, 0, 0, 0)
    strh = b"vids" + b"DIB " + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1000, rate, 0, frames, size, 0, 0, 0, 0, width, height)
    palette = _GRAYS if channels == 1 else b""
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8 * channels, b"\0\0\0\0", size, 0, 0, 256 if palette else 0, 0) + palette
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi = 4 + frames * (8 + size)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + movi + 8 + 16 * frames) + b"AVI " + head + b"LIST" + struct.pack("<I", movi) + b"movi"


def frame_bytes(width: int, height: int, channels: int) -> int:
    """Bytes of an uncompressed frame, its rows filled up to four; always even."""
    return -(-width * channels // 4) * 4 * height


def frame_chunk(image: np.ndarray) -> bytes:
    """A gray or BGR frame as a chunk, its last row first."""
    return frame_chunks(image[None])


def frame_chunks(images: np.ndarray) -> bytes:
    """frame_chunk of each of a stack of frames, one after the other."""
    n, height = images.shape[:2]
    rows = images[:, ::-1].reshape(n, height, -1)
    line = -(-rows.shape[2] // 4) * 4
    body = np.zeros((n, height, line), np.uint8)
    body[:, :, : rows.shape[2]] = rows
    head = np.frombuffer(b"00db" + struct.pack("<I", line * height), np.uint8)
    return np.concatenate([np.broadcast_to(head, (n, 8)), body.reshape(n, -1)], axis=1).tobytes()


def avi_index(frames: int, size: int) -> bytes:
    rows = np.zeros(frames, _INDEX)
    rows["name"], rows["flags"], rows["size"], rows["offset"] = b"00db", 0x10, size, 4 + np.arange(frames, dtype=np.int64) * (8 + size)
    return b"idx1" + struct.pack("<I", 16 * frames) + rows.tobytes()
