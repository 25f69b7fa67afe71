"""Frames from uncompressed files: Y4M clips, raw planar and packed samples.

Here are formats, heads and decoding; sources/frames.py makes data sources of them, whose
partitions are ranges of frames.  Frames are rows of (video_id, frame_idx, width, height,
fps, planes) with samples scaled to 0..1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DifferingInputs, UnsupportedInput
from ..functions.planes import cubic

FRAMES = "video_id string, frame_idx long, width int, height int, fps double, planes array<array<float>>"

#: Sample name -> (numpy type, the value of full scale).
SAMPLES = {"uint8": ("<u1", 255.0), "uint16": ("<u2", 65535.0), "half": ("<f2", 1.0), "float": ("<f4", 1.0)}
#: Packed layouts: the place of r, g, b among the samples of a pixel, and samples a pixel.
PACKED = {"rgb24": ("uint8", (0, 1, 2), 3), "rgba": ("uint8", (0, 1, 2), 4), "argb": ("uint8", (1, 2, 3), 4), "abgr": ("uint8", (3, 2, 1), 4), "bgra": ("uint8", (2, 1, 0), 4), "rgb48le": ("uint16", (0, 1, 2), 3), "rgba64le": ("uint16", (0, 1, 2), 4)}


@dataclass(frozen=True)
class PixelFormat:
    name: str
    family: str
    depth: int
    sub_w: int  # powers of two by which chroma is smaller
    sub_h: int
    full_range: bool


def pixel_format(name: str) -> PixelFormat:
    """What the name of a YUV (with or without alpha), gray or RGB format says."""
    low = name.lower()
    if low == "yuyv422":
        return PixelFormat(low, "yuv", 8, 1, 0, False)
    if low in PACKED:
        return PixelFormat(low, "rgb", 16 if PACKED[low][0] == "uint16" else 8, 0, 0, True)
    if m := re.fullmatch(r"yuv([ja]?)(420|422|440|444|411|410)p(\d+)?(le)?", low):
        sub = {"420": (1, 1), "422": (1, 0), "440": (0, 1), "444": (0, 0), "411": (2, 0), "410": (2, 2)}[m[2]]
        return PixelFormat(low, "yuv", int(m[3] or 8), *sub, m[1] == "j")
    if m := re.fullmatch(r"gbrp(\d+)?(le)?", low):
        return PixelFormat(low, "rgb", int(m[1] or 8), 0, 0, True)
    if m := re.fullmatch(r"gray(\d+)?(le)?", low):
        return PixelFormat(low, "gray", int(m[1] or 8), 0, 0, False)
    raise UnsupportedInput(f"pixel format {name!r}")


def unstride(data: np.ndarray, stride: int, width: int, height: int) -> np.ndarray:
    """Rows of `stride` samples without their padding."""
    return data[: stride * height].reshape(height, stride)[:, :width]


def matrix_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, kr: float, kb: float) -> np.ndarray:
    r, b = y + 2 * (1 - kr) * cr, y + 2 * (1 - kb) * cb
    return np.stack([r, (y - kr * r - kb * b) / (1 - kr - kb), b])


# Luma weights of red and blue by matrix name.
MATRICES = {"709": (0.2126, 0.0722), "601": (0.299, 0.114), "2020": (0.2627, 0.0593), "240": (0.212, 0.087), "fcc": (0.3, 0.11)}


@dataclass(frozen=True)
class Colour:
    """What is known about samples beyond their format; None is what the file says, or the default."""

    matrix: str | None = None  # by default 709 above 650 lines, else 601
    full_range: bool | None = None  # by default that of the format
    centred: bool | None = None  # whether chroma samples lie in the middle of their columns, or on the left one (by default)
    repeated: bool = False  # chroma repeated instead of interpolated
    transfer: str = "bt709"  # of the samples; frames come in that of BT.709
    primaries: str = "bt709"

    def weights(self, height: int) -> tuple[float, float]:
        name = self.matrix or ("709" if height > 650 else "601")
        if name not in MATRICES:
            raise UnsupportedInput(f"matrix {name!r}")
        return MATRICES[name]


@lru_cache(maxsize=64)
def _taps(have: int, want: int, factor: int, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per place its four samples, mirrored at the borders, and their weights."""
    at = (np.arange(want) + 0.5) / factor - 0.5 if centred else np.arange(want) / factor
    places = np.floor(at)[:, None] + np.arange(-1, 3)
    weights = cubic(places - at[:, None])
    inside = np.mod(places.astype(int), 2 * have)
    return np.minimum(inside, 2 * have - 1 - inside), weights / weights.sum(1, keepdims=True)


def enlarged(plane: np.ndarray, size: tuple[int, int], sub_h: int, sub_w: int, centred: bool = False) -> np.ndarray:
    """Chroma at every pixel, by bicubic interpolation."""
    for axis, sub, middle in ((0, sub_h, True), (1, sub_w, centred)):
        if sub:
            places, weights = _taps(plane.shape[axis], size[axis], 1 << sub, middle)
            moved = np.moveaxis(plane, axis, 0)
            plane = np.moveaxis(np.einsum("ik,ik...->i...", weights, moved[places]), 0, axis)
    return plane


def to_rgb(planes: list[np.ndarray], form: PixelFormat, colour: Colour = Colour()) -> np.ndarray:
    """Sample planes of a format to RGB of 0..1."""
    top = float((1 << form.depth) - 1)
    if form.family == "rgb":
        return np.stack(planes) / top
    unit = 1 << (form.depth - 8)
    full = form.full_range if colour.full_range is None else colour.full_range
    scale = (lambda p, low, span: p / top if full else (p - low * unit) / (span * unit))
    y = scale(planes[0].astype(np.float64), 16, 219)
    if form.family == "gray":
        return np.stack([y, y, y])
    h, w = y.shape
    half = (1 << (form.depth - 1))
    cb, cr = ((p.astype(np.float64) - half) / (top if full else 224 * unit) for p in planes[1:3])
    if colour.repeated:
        cb, cr = (p.repeat(1 << form.sub_h, 0).repeat(1 << form.sub_w, 1)[:h, :w] for p in (cb, cr))
    else:
        cb, cr = (enlarged(p, (h, w), form.sub_h, form.sub_w, bool(colour.centred)) for p in (cb, cr))
    return matrix_rgb(y, cb, cr, *colour.weights(h))


# Y4M tags of 8-bit formats, and whether they place chroma in the middle of its columns.
_Y4M = {"420": ("yuv420p", True), "420jpeg": ("yuv420p", True), "420mpeg2": ("yuv420p", False), "420paldv": ("yuv420p", False), "422": ("yuv422p", False), "444": ("yuv444p", False), "411": ("yuv411p", False), "440": ("yuv440p", False), "mono": ("gray", False)}


def _y4m_format(tag: str) -> tuple[PixelFormat, bool]:
    """The format of a Y4M tag, and whether chroma is centred."""
    if tag in _Y4M:
        return pixel_format(_Y4M[tag][0]), _Y4M[tag][1]
    if m := re.fullmatch(r"(420|422|444)p(\d+)", tag):
        return pixel_format(f"yuv{m[1]}p{m[2]}le"), False
    if m := re.fullmatch(r"mono(\d+)", tag):
        return pixel_format(f"gray{m[1]}le"), False
    raise UnsupportedInput(f"Y4M colour space {tag!r}")


def open_file(path: str) -> pa.NativeFile:
    where = re.sub(r"^file:/+", "/", path)
    store, name = (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(where)
    return store.open_input_file(name)


@dataclass(frozen=True)
class Clip:
    """The head of a Y4M file."""

    width: int
    height: int
    fps: float
    form: PixelFormat
    full_range: bool | None
    begin: int  # where the first frame's marker is
    centred: bool = False

    @classmethod
    def of(cls, file: pa.NativeFile) -> Clip:
        head = file.read_at(min(4096, file.size()), 0).split(b"\n", 1)[0]
        if not head.startswith(b"YUV4MPEG2"):
            raise UnsupportedInput("not a Y4M file")
        words = [x for x in head.decode("ascii", "replace").split(" ")[1:] if x]
        fields = {x[:1]: x[1:] for x in words if x[0] != "X"}
        span = next((x[len("XCOLORRANGE=") :] for x in words if x.startswith("XCOLORRANGE=")), None)
        up, _, down = fields.get("F", "30:1").partition(":")
        form, centred = _y4m_format(fields.get("C", "420"))
        return cls(int(fields["W"]), int(fields["H"]), int(up) / max(int(down or 1), 1), form, None if span is None else span == "FULL", len(head) + 1, centred)

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if self.form.depth > 8 else "<u1")

    @property
    def shapes(self) -> list[tuple[int, int]]:
        chroma = (-(-self.height // (1 << self.form.sub_h)), -(-self.width // (1 << self.form.sub_w)))
        return [(self.height, self.width)] + [chroma] * (2 if self.form.family == "yuv" else 0) if self.form.family != "rgb" else [(self.height, self.width)] * 3

    @property
    def size(self) -> int:
        return sum(h * w for h, w in self.shapes) * self.kind.itemsize

    def marker(self, file: pa.NativeFile, at: int) -> int:
        """The length of the marker line at a place."""
        line = file.read_at(min(256, file.size() - at), at).split(b"\n", 1)[0]
        if not line.startswith(b"FRAME"):
            raise UnsupportedInput("a Y4M frame has no marker")
        return len(line) + 1

    def places(self, file: pa.NativeFile) -> np.ndarray:
        """Where each frame's marker is: one step apart, or else found marker by marker."""
        whole = file.size() - self.begin
        if not whole:
            return np.zeros(0, np.int64)
        step = self.marker(file, self.begin) + self.size
        if whole % step == 0:
            even = self.begin + np.arange(whole // step, dtype=np.int64) * step
            if all(file.read_at(min(5, file.size() - int(p)), int(p)) == b"FRAME" for p in (even[len(even) // 2], even[-1])) and self.marker(file, int(even[-1])) + self.size == step:
                return even
        at, out = self.begin, []
        while at < file.size():
            out.append(at)
            at += self.marker(file, at) + self.size
        if at > file.size():
            raise UnsupportedInput("the last Y4M frame is cut off")
        return np.array(out, np.int64)

    def frame(self, file: pa.NativeFile, at: int, colour: Colour) -> np.ndarray:
        skip = self.marker(file, at)
        data, done, planes = np.frombuffer(file.read_at(self.size, at + skip), self.kind), 0, []
        for h, w in self.shapes:
            planes.append(data[done : done + h * w].reshape(h, w))
            done += h * w
        return to_rgb(planes, self.form, replace(colour, full_range=self.full_range if colour.full_range is None else colour.full_range, centred=self.centred if colour.centred is None else colour.centred))


@dataclass(frozen=True)
class Raw:
    """A headerless file: three planes one after the other, or a packed layout; stride counts samples of a row.
    The layout yuyv422 holds two pixels in four samples (y, cb, y, cr)."""

    width: int
    height: int
    sample: str = "uint8"
    stride: int | None = None
    layout: str = "planar"
    fps: float = 30.0

    def __post_init__(self) -> None:
        if self.layout not in ("planar", "yuyv422", *PACKED):
            raise UnsupportedInput(f"layout {self.layout!r}")
        if self.kind not in SAMPLES:
            raise UnsupportedInput(f"sample type {self.sample!r}")

    @property
    def kind(self) -> str:
        return {"planar": self.sample, "yuyv422": "uint8"}.get(self.layout) or PACKED[self.layout][0]

    @property
    def across(self) -> int:
        """Samples of a row without its padding."""
        if self.layout == "yuyv422":
            return -(-self.width // 2) * 4
        return self.width * (1 if self.layout == "planar" else PACKED[self.layout][2])

    @property
    def row(self) -> int:
        return self.stride or self.across

    @property
    def size(self) -> int:
        return self.row * self.height * (3 if self.layout == "planar" else 1) * np.dtype(SAMPLES[self.kind][0]).itemsize

    def places(self, file: pa.NativeFile) -> np.ndarray:
        if file.size() % self.size:
            raise DifferingInputs(f"{file.size()} bytes are no whole frames of {self.size}")
        return np.arange(0, file.size(), self.size, dtype=np.int64)

    def frame(self, file: pa.NativeFile, at: int, colour: Colour) -> np.ndarray:
        kind, top = SAMPLES[self.kind]
        data, width, height = np.frombuffer(file.read_at(self.size, at), kind), self.width, self.height
        if self.layout == "planar":
            own = data.astype(np.float64) / top
            return np.stack([unstride(own[c * self.row * height :], self.row, width, height) for c in range(3)])
        pixels = unstride(data, self.row, self.across, height)
        if self.layout == "yuyv422":
            return to_rgb([pixels[:, ::2][:, :width], pixels[:, 1::4], pixels[:, 3::4]], pixel_format("yuv422p"), colour)
        places, per = PACKED[self.layout][1:]
        pixels = pixels.astype(np.float64).reshape(height, width, per) / top
        return np.stack([pixels[:, :, c] for c in places])


def head_of(file: pa.NativeFile, raw: dict[str, Any] | None) -> Clip | Raw:
    """How a file's frames are laid out: as its head says, or as the caller does."""
    return Clip.of(file) if raw is None else Raw(**raw)


def frame_index(frames: DataFrame) -> DataFrame:
    """Per video: frames, size and rate; what a caller needs to resolve a range."""
    return frames.groupBy("video_id").agg(F.count("*").alias("frames"), F.max("width").alias("width"), F.max("height").alias("height"), F.max("fps").alias("fps"), (F.countDistinct("width", "height") == 1).alias("one_size"))


def file_index(spark: SparkSession, path: str, cache: str | None = None, raw: Raw | None = None) -> DataFrame:
    """(path, modified, bytes, width, height, fps, frames) of Y4M files, or of headerless ones of one layout.

    With a cache (a Parquet table of one layout), files that it knows at the same time and size are not
    opened; new ones are added to it."""
    shape = "path string, modified timestamp, bytes long, width int, height int, fps double, frames long"
    present = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    layout = None if raw is None else asdict(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                with open_file(name) as file:  # heads and markers only; no frame is decoded
                    clip = head_of(file, layout)
                    more = [pa.array([clip.width], pa.int32()), pa.array([clip.height], pa.int32()), pa.array([clip.fps], pa.float64()), pa.array([len(clip.places(file))], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), *more], ["path", "modified", "bytes", "width", "height", "fps", "frames"])

    opened = lambda rows: rows.select("path", "modified", "bytes").mapInArrow(run, shape)
    if cache is None:
        return opened(present)
    try:
        known = spark.read.schema(shape).parquet(cache)
        known.limit(1).collect()
    except AnalysisException:
        opened(present).write.parquet(cache)
        return spark.read.schema(shape).parquet(cache)
    fresh = present.join(known, ["path", "modified", "bytes"], "left_anti")
    if not fresh.isEmpty():
        opened(fresh).write.mode("append").parquet(cache)
    return spark.read.schema(shape).parquet(cache).join(present, ["path", "modified", "bytes"], "left_semi")
