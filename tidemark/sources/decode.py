"""From media to frame signals: a decoder protocol, and a NumPy decoder of raw frames."""

from __future__ import annotations

import io
import time
from collections.abc import Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.config import DEFAULTS, Settings

SIGNALS = "clip_id string, frame_idx int, brightness double, motion double, aspect_ratio double, area double, latency_ms double, total_frames int, fps double"


class FrameDecoder(Protocol):
    """Opens a file's bytes: (frames per second or 0, total frames, iterator of BGR or gray uint8 arrays)."""

    def open(self, content: bytes) -> tuple[float, int, Iterator[np.ndarray]]: ...


class ArrayDecoder:
    """NPZ archives with `frames` (n x height x width, or with 3 channels) and, if given, `fps`."""

    def open(self, content: bytes) -> tuple[float, int, Iterator[np.ndarray]]:
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            frames, fps = data["frames"], float(data["fps"]) if "fps" in data else 0.0
        return fps, len(frames), iter(frames)


# ---- pixel operators


def to_gray(image: np.ndarray) -> np.ndarray:
    """BGR to gray with the weights of ITU-R 601."""
    return image if image.ndim == 2 else np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resize_area(image: np.ndarray, factor: float) -> np.ndarray:
    """Shrink by averaging the source pixels that each target pixel covers, whole or in part."""
    return _resized(image[None], factor)[0]


def _resized(images: np.ndarray, factor: float) -> np.ndarray:
    """resize_area of each of a stack of images."""

    def weights(n: int) -> np.ndarray:
        m = max(1, round(n * factor))
        edges = np.arange(m + 1) * (n / m)
        cells = np.arange(n)
        cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
        return np.clip(cover, 0, None) / (n / m)

    k, height, width = images.shape[:3]
    rows, columns = weights(height), weights(width)
    out = rows @ images.astype(np.float64).reshape(k, height, -1)  # a product for each image, so a stack changes no rounding
    out = columns @ np.moveaxis(out.reshape(k, len(rows), width, -1), 1, 2).reshape(k, width, -1)
    out = np.moveaxis(out.reshape(k, len(columns), len(rows), *images.shape[3:]), 1, 2)
    return np.rint(out).astype(np.uint8)


def blur(image: np.ndarray, size: int = 3) -> np.ndarray:
    """Gaussian blur with binomial weights, edges mirrored without the edge itself."""
    return _blurred(image[None], size)[0]


def _blurred(images: np.ndarray, size: int = 3) -> np.ndarray:
    """blur of each of a stack of images."""
    kernel = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}[size]
    half = size // 2
    out = images.astype(np.float64)
    for axis in (1, 2):
        n = out.shape[axis]
        if n <= half:
            continue
        padded = np.pad(out, [(half, half) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect")
        out = sum(k * (padded[:, i : i + n] if axis == 1 else padded[:, :, i : i + n]) for i, k in enumerate(kernel)) / sum(kernel)
    return np.rint(out).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold with the largest variance between the two classes."""
    return int(_thresholds(image[None])[0])


def _thresholds(images: np.ndarray) -> np.ndarray:
    """otsu of each of a stack of images: over the levels, or over the pixels in order where these are fewer."""
    k = len(images)
    if images[0].size < 256:
        levels = np.sort(images.reshape(k, -1), axis=1)
        below = np.arange(1, levels.shape[1])
        mass = levels.cumsum(1, dtype=np.float64)
        low, high = below, levels.shape[1] - below
        # a level's last pixel has all that don't exceed it below
        gap = np.where(levels[:, 1:] > levels[:, :-1], low * high * (mass[:, :-1] / low - (mass[:, -1:] - mass[:, :-1]) / high) ** 2, 0)
        at = gap.argmax(1)[:, None] if gap.shape[1] else np.zeros((k, 1), np.int64)
        return np.where(levels[:, -1] > levels[:, 0], np.take_along_axis(levels, at, 1)[:, 0], 0)
    places = (np.arange(k)[:, None] * 256 + images.reshape(k, -1)).ravel()
    counts = np.bincount(places, minlength=256 * k).reshape(k, 256).astype(np.float64)
    below = counts.cumsum(1)
    mass = (counts * np.arange(256)).cumsum(1)
    above = below[:, -1:] - below
    ok = (below > 0) & (above > 0)
    low, high = np.where(ok, below, 1), np.where(ok, above, 1)
    gap = np.where(ok, low * high * (mass / low - (mass[:, -1:] - mass) / high) ** 2, 0)
    return gap.argmax(1)


def regions(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """A number from 1 for each connected region, in the order of their first pixels; 0 elsewhere.

    Runs of a row are joined with the runs of the row before that they touch, with their
    corners too if diagonal; the joins are settled by halving paths.
    """
    rows, width = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(row):
        return np.zeros(mask.shape, np.int64)
    reach = 1 if diagonal else 0
    span = width + 2
    # runs of the row before that end after this begins, up to those that begin before it ends
    low = np.searchsorted(row * span + end, (row - 1) * span + begin - reach, side="right")
    high = np.searchsorted(row * span + begin, (row - 1) * span + end + reach, side="left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for ends in (a, b):
            np.minimum.at(label, label[ends], least)
            np.minimum.at(label, ends, least)
        label = label[label]
        if (label == before).all():
            break
    number = np.unique(label, return_inverse=True)[1] + 1
    steps = np.zeros((rows, width + 1), np.int64)
    steps[row, begin] = number
    steps[row, end] -= number
    return np.cumsum(steps, axis=1)[:, :width]


def largest_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) of the outer contour with the largest area, the first of equals.

    A contour runs through the centres of a region's border pixels, its holes counting as
    filled: each square of four such centres adds one, each of three a half.
    """
    box = _largest_boxes(mask[None])[0]
    return tuple(box.tolist()) if box[2] else None


def _largest_boxes(masks: np.ndarray) -> np.ndarray:
    """largest_box of each of a stack of masks, as rows; without any region all are 0."""
    k = len(masks)
    padded = np.pad(masks, ((0, 0), (1, 1), (1, 1)))
    height, width = padded.shape[1:]
    # the stack as one tall image: a row that is no ground lies between two images, and their own edges part the filled regions
    tall = np.pad(~padded, ((0, 0), (0, 1), (0, 0))).reshape(-1, width)
    ground = regions(tall, diagonal=False).reshape(k, height + 1, width)[:, :height]
    found = regions((ground != ground[:, :1, :1]).reshape(-1, width), diagonal=True).reshape(k, height, width)
    out = np.zeros((k, 4), np.int64)
    last = np.maximum.accumulate(found.reshape(k, -1).max(1))  # regions are numbered image by image
    if not last[-1]:
        return out
    corners = np.stack([found[:, :-1, :-1], found[:, :-1, 1:], found[:, 1:, :-1], found[:, 1:, 1:]])
    area = np.bincount(corners.max(0).ravel(), np.maximum((corners > 0).sum(0) - 2, 0).ravel() / 2, minlength=last[-1] + 1)[1:]
    image = np.searchsorted(last, np.arange(1, last[-1] + 1))
    order = np.lexsort((-area, image))  # stable, so the first of equals comes first
    has, at = np.unique(image[order], return_index=True)
    mine = found[has] == (order[at] + 1)[:, None, None]
    rows, columns = mine.any(2), mine.any(1)
    y, x = rows.argmax(1), columns.argmax(1)
    out[has] = np.stack([x - 1, y - 1, width - columns[:, ::-1].argmax(1) - x, height - rows[:, ::-1].argmax(1) - y], 1)
    return out


#: Frames that are measured at once: as many at most, and of as many bytes together unless one alone has more.
BATCH_FRAMES, BATCH_BYTES = 1024, 1 << 18


def to_small_gray(frame: np.ndarray, settings: Settings = DEFAULTS) -> np.ndarray:
    return to_gray(resize_area(frame, settings.initial_downscale))


def _measured(frames: np.ndarray, before: np.ndarray | None, settings: Settings, begins: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of what `measure` says of a stack, whose frames at `begins` are the first of their clips, and the last one's small gray image."""
    began, n = time.perf_counter(), len(frames)
    small = _resized(frames, settings.initial_downscale)
    gray = small if small.ndim == 3 else to_gray(small.reshape(-1, *small.shape[2:])).reshape(small.shape[:3])
    soft = _blurred(gray)
    if before is not None and before.shape != gray.shape[1:]:
        raise ValueError("frames of a clip differ in size")
    chain = np.concatenate([gray[:1] if before is None else before[None], gray]).astype(np.int16)
    motion = np.abs(np.diff(chain, axis=0)).reshape(n, -1).mean(1)
    motion[begins] = 0.0
    box = _largest_boxes(soft > _thresholds(soft)[:, None, None])
    ratio, area = box[:, 2] / np.maximum(box[:, 3], 1), (box[:, 2] * box[:, 3]).astype(np.float64)
    brightness = gray.reshape(n, -1).mean(1)
    latency = (time.perf_counter() - began) * 1000 / n
    return [brightness, motion, ratio, area, np.full(n, latency)], gray[-1]


def measure(frames: np.ndarray, before: np.ndarray | None, settings: Settings = DEFAULTS) -> tuple[list[tuple], np.ndarray]:
    """(brightness, motion, aspect ratio, area, latency) of each of a stack of frames, and the last one's small gray image for the next.

    A frame's latency is its share of the stack's.
    """
    values, last = _measured(frames, before, settings, [])
    return list(zip(*(c.tolist() for c in values), strict=True)), last


def _full(held: list[np.ndarray], frame: np.ndarray) -> bool:
    """Whether a frame must begin another stack than the held ones."""
    return bool(held) and (frame.shape != held[0].shape or len(held) >= BATCH_FRAMES or (len(held) + 1) * frame.nbytes > BATCH_BYTES)


def _stacks(frames: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Frames of one size in stacks; those before one that can't be read come before its error."""
    held, failed = [], None
    try:
        for frame in frames:
            if _full(held, frame):
                yield np.stack(held)
                held = []
            held.append(frame)
    except Exception as e:  # noqa: BLE001 - raised again below
        failed = e
    if held:
        yield np.stack(held)
    if failed is not None:
        raise failed


def frame_rows(frames: Iterator[np.ndarray], settings: Settings = DEFAULTS, first: int = 0, before: np.ndarray | None = None) -> Iterator[tuple]:
    """(index, brightness, motion, aspect ratio, area, latency) of a clip's frames, in order, at most max_frames.

    Only a stack of frames and the one before are held. Frames keep one size, so two
    always compare. `first` is the first one's index, `before` the small gray image before it.
    """
    k = first
    for stack in _stacks(islice(frames, max(0, settings.max_frames - first))):
        rows, before = measure(stack, before, settings)
        for values in rows:
            yield k, *values
            k += 1


#: Rows of decoded frames that leave a task together, about.
DECODED_ROWS = 4096

def _readable(frames: Iterator[np.ndarray], settings: Settings) -> Iterator[np.ndarray]:
    """A clip's frames before one that can't be read or that shrinks to another size, at most max_frames."""
    small = lambda shape: [max(1, round(n * settings.initial_downscale)) for n in shape[:2]]
    shape, rows = None, islice(frames, max(0, settings.max_frames))
    while True:
        try:
            frame = next(rows)
        except Exception:  # noqa: BLE001 - the end, or any decoder's any error
            return
        if frame.shape != shape:
            if shape is not None and small(frame.shape) != small(shape):
                return
            shape = frame.shape
        yield frame


def clip_stacks(clips: Iterator[tuple[tuple, Iterator[np.ndarray]]], settings: Settings = DEFAULTS) -> Iterator[tuple[list[tuple[tuple, int, int]], list[np.ndarray]]]:
    """Stacks of the frames of clips one after the other: (clip, its first index here, how many) in order, and columns of what was measured.

    Short clips of one size share stacks, to the values of single ones. Of a clip with a frame
    that can't be read, or is of another size, the frames before it stay.
    """
    held: list[np.ndarray] = []
    runs: list[tuple[tuple, int, int]] = []
    before = None

    def taken() -> tuple[list[tuple[tuple, int, int]], list[np.ndarray]]:
        nonlocal before
        ends = np.cumsum([n for _, _, n in runs])
        begins = [int(end) - n for (_, first, n), end in zip(runs, ends, strict=True) if not first]
        columns, before = _measured(np.stack(held), before if runs[0][1] else None, settings, begins)
        out = list(runs), columns
        held.clear()
        runs.clear()
        return out

    for clip, frames in clips:
        first = k = 0
        for frame in _readable(frames, settings):
            if _full(held, frame):
                if k > first:
                    runs.append((clip, first, k - first))
                    first = k
                yield taken()
            held.append(frame)
            k += 1
        if k > first:
            runs.append((clip, first, k - first))
    if held:
        yield taken()


def decode(clips: DataFrame, decoder: FrameDecoder, settings: Settings = DEFAULTS) -> DataFrame:
    """Frame signals of binaryFile rows, see clip_stacks; a file that can't be opened or has no frame gives no rows."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[np.ndarray]]]:
        for files in batches:
            for path, content in zip(files.column("path"), files.column("content"), strict=True):
                try:
                    fps, total, frames = decoder.open(content.as_py())
                except Exception:  # noqa: BLE001 - any decoder, any error
                    continue
                yield (path.as_py(), total, fps or settings.default_fps), frames

    def batch(runs: list[tuple[tuple, int, int]], columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([n for _, _, n in runs])
        ends = sizes.cumsum()
        index = np.arange(ends[-1]) - np.repeat(ends - sizes - np.array([first for _, first, _ in runs]), sizes)
        each = pa.array(np.repeat(np.arange(len(runs)), sizes))
        path, total, fps = (pa.array([clip[c] for clip, _, _ in runs], kind).take(each) for c, kind in enumerate((pa.string(), pa.int32(), pa.float64())))
        measured = [pa.array(np.concatenate(c).astype(np.float64)) for c in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([path, pa.array(index, pa.int32()), *measured, total, fps], [c.split()[0] for c in SIGNALS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[tuple, int, int]] = []
        columns: list[list[np.ndarray]] = []
        rows = 0
        for more, measured in clip_stacks(opened(batches), settings):
            runs += more
            columns.append(measured)
            rows += len(measured[0])
            if rows >= DECODED_ROWS:
                yield batch(runs, columns)
                runs, columns, rows = [], [], 0
        if runs:
            yield batch(runs, columns)

    return clips.select("path", "content").mapInArrow(run, SIGNALS)
