"""Data sources of frames and of frame pairs.

`pixelquill_frames` reads Y4M and headerless files; a partition is a range of about
RANGE_BYTES of one file's frames, and a task seeks to them and reads no others.  Conditions
on frame_idx and video_id are pushed into the source, which then plans only the frames they
leave.  Spark does not tell a Python source which columns a query needs; a schema given to
the reader (or `columns` of the functions here) that leaves out `planes` reads heads only.

`pixelquill_frame_pairs` reads both frames of each pair in one task, crops them and brings
the second one to the size of the first, so that no plane is ever exchanged or broadcast.

Planning opens heads (many at a time) on the driver; frames are decoded in tasks, which open
files through Arrow's file systems, so executors have to see the paths.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..errors import DifferingInputs, SamplingError
from ..functions.planes import resample
from ..operators.sampling import Span
from .formats import to_709
from .video import FRAMES, Clip, Colour, Raw, head_of, open_file

#: Bytes of frames that one task reads, and heads that the driver opens at a time.
RANGE_BYTES, HEADS = 64 << 20, 32
#: What Spark asks for before it hands conditions to a Python source.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

PAIRS = "ord int, src_frame long, enc_frame long, a_width int, a_height int, a_planes array<array<float>>, b_width int, b_height int, b_planes array<array<float>>"


def picture(head: Clip | Raw, file: pa.NativeFile, at: int, colour: Colour) -> np.ndarray:
    """A frame's RGB planes, in the transfer and primaries of BT.709."""
    return to_709(head.frame(file, at, colour), colour.transfer, colour.primaries)


def holds(condition: Filter, values: np.ndarray) -> np.ndarray | None:
    """Where a condition on one numeric column holds; None if it is of another kind."""
    known = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
    if type(condition) in known:
        return known[type(condition)](values, condition.value)
    return np.isin(values, list(condition.value)) if isinstance(condition, In) else None


def _taken(filters: list[Filter], columns: tuple[str, ...], kept: list[Filter]) -> Iterable[Filter]:
    """Puts conditions that a source answers itself into kept, and yields the rest."""
    for f in filters:
        named = getattr(f, "attribute", ())
        if len(named) == 1 and named[0] in columns and isinstance(f, IsNotNull):
            continue  # numbers are never null
        if len(named) == 1 and named[0] in columns and holds(f, np.zeros(0)) is not None:
            kept.append(f)
        else:
            yield f


def _planes(rgb: np.ndarray) -> pa.Array:
    return pa.array([[p.astype(np.float32).ravel() for p in rgb]], pa.list_(pa.list_(pa.float32())))


def _batch(values: dict[str, pa.Array], schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values[c] for c in schema.names], schema.names)


@dataclass
class FrameRange(InputPartition):
    """Some frames of one file: their numbers and places."""

    path: str
    name: str
    head: Clip | Raw
    numbers: np.ndarray
    places: np.ndarray


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.schema = schema
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.raw = json.loads(options["raw"]) if "raw" in options else None
        self.colour = Colour(**json.loads(options.get("colour", "{}")))
        self.first, self.start, self.end = int(options.get("first", 0)), int(options.get("start", 0)), int(options.get("end", -1))
        self.whole_path = options.get("whole_path", "false").lower() == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return _taken(filters, ("frame_idx",), self.conditions)

    def _ranges(self, path: str) -> list[FrameRange]:
        with open_file(path) as file:
            head = head_of(file, self.raw)
            places = head.places(file)
        at = np.arange(max(self.start, 0), len(places) if self.end < 0 else min(self.end, len(places)))
        numbers = at + self.first
        for f in self.conditions:
            stays = holds(f, numbers)
            at, numbers = at[stays], numbers[stays]
        step = max(1, self.range_bytes // max(head.size, 1))
        name = path if self.whole_path else path.rsplit("/", 1)[-1]
        return [FrameRange(path, name, head, numbers[i : i + step], places[at[i : i + step]]) for i in range(0, len(at), step)]

    def partitions(self) -> list[FrameRange]:
        with ThreadPoolExecutor(HEADS) as pool:
            return [r for found in pool.map(self._ranges, self.paths) for r in found]

    def read(self, partition: FrameRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # so Spark says that there is none
            return
        head, n = partition.head, len(partition.numbers)
        about = {
            "video_id": pa.array([partition.name] * n, pa.string()), "frame_idx": pa.array(partition.numbers, pa.int64()), "width": pa.array([head.width] * n, pa.int32()),
            "height": pa.array([head.height] * n, pa.int32()), "fps": pa.array([head.fps] * n, pa.float64()),
        }
        if "planes" not in self.schema.names:
            yield _batch(about, self.schema)
            return
        with open_file(partition.path) as file:
            for k, at in enumerate(partition.places.tolist()):
                yield _batch({c: v.slice(k, 1) for c, v in about.items()} | {"planes": _planes(picture(head, file, at, self.colour))}, self.schema)


class FrameSource(DataSource):
    """Options: path or paths (a JSON list), raw and colour (JSON objects; without raw: Y4M), first, start, end, whole_path, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "pixelquill_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options, schema)


@dataclass(frozen=True)
class Side:
    """One video of a pair: its file, its layout (None: Y4M), colour, and what is cut off (top, bottom, left, right)."""

    path: str
    raw: Raw | None = None
    colour: Colour = Colour()
    crop: tuple[int, int, int, int] = (0, 0, 0, 0)


@dataclass
class PairRange(InputPartition):
    heads: tuple[Clip | Raw, Clip | Raw]
    rows: np.ndarray  # ord, frames, places


class PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.schema = schema
        self.sides = [json.loads(options[s]) for s in "ab"]
        self.colours = [Colour(**s["colour"]) for s in self.sides]
        self.listed = json.loads(options["pairs"]) if "pairs" in options else None
        self.span = Span(*json.loads(options["span"])) if "span" in options else None
        self.fit = options.get("fit", "true").lower() == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return _taken(filters, ("ord", "src_frame", "enc_frame"), self.conditions)

    def partitions(self) -> list[PairRange]:
        heads, places = [], []
        for side in self.sides:
            with open_file(side["path"]) as file:
                heads.append(head_of(file, side["raw"]))
                places.append(heads[-1].places(file))
        if self.listed is not None:
            pairs = np.array(self.listed, np.int64).reshape(-1, 3)
        else:
            src = np.arange(self.span.start, self.span.end, self.span.every)
            pairs = np.stack([np.arange(len(src)), src, src + self.span.offset], 1)
        for k, found in enumerate(places):
            outside = (pairs[:, 1 + k] < 0) | (pairs[:, 1 + k] >= len(found))
            if outside.any():
                raise SamplingError(f"{self.sides[k]['path']} has no frame {pairs[outside][0, 1 + k]}")
        for f in self.conditions:
            pairs = pairs[holds(f, pairs[:, ("ord", "src_frame", "enc_frame").index(f.attribute[0])])]
        rows = np.column_stack([pairs, places[0][pairs[:, 1]], places[1][pairs[:, 2]]])
        step = max(1, self.range_bytes // max(1, heads[0].size + heads[1].size))
        return [PairRange((heads[0], heads[1]), rows[i : i + step]) for i in range(0, len(rows), step)]

    def _sized(self, planes: list[np.ndarray]) -> list[np.ndarray]:
        """Both frames without what is cut off; before that, the second brought to the size that then equals the first's."""
        (top, bottom, left, right), other = (s["crop"] for s in self.sides)
        h, w = (n - cut for n, cut in zip(planes[0].shape[1:], (top + bottom, left + right), strict=True))
        want = (h + other[0] + other[1], w + other[2] + other[3])
        if min(h, w) < 1:
            raise DifferingInputs("nothing is left of a frame that is cut so far")
        if planes[1].shape[1:] != want:
            if not self.fit:
                raise DifferingInputs(f"frames differ: {w} x {h} are wanted, {planes[1].shape[2] - other[2] - other[3]} x {planes[1].shape[1] - other[0] - other[1]} found")
            planes = [planes[0], np.stack([resample(p, want) for p in planes[1]])]
        return [p[:, c[0] : p.shape[1] - c[1], c[2] : p.shape[2] - c[3]] for p, c in zip(planes, ((top, bottom, left, right), other), strict=True)]

    def read(self, partition: PairRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        numbers = {"ord": pa.array(partition.rows[:, 0], pa.int32()), "src_frame": pa.array(partition.rows[:, 1]), "enc_frame": pa.array(partition.rows[:, 2])}
        if not any(c[:2] in ("a_", "b_") for c in self.schema.names):
            yield _batch(numbers, self.schema)
            return
        with open_file(self.sides[0]["path"]) as a, open_file(self.sides[1]["path"]) as b:
            for k, places in enumerate(partition.rows[:, 3:].tolist()):
                both = self._sized([picture(h, f, at, c) for h, f, at, c in zip(partition.heads, (a, b), places, self.colours, strict=True)])
                row = {c: v.slice(k, 1) for c, v in numbers.items()}
                for side, planes in zip("ab", both, strict=True):
                    row |= {f"{side}_width": pa.array([planes.shape[2]], pa.int32()), f"{side}_height": pa.array([planes.shape[1]], pa.int32()), f"{side}_planes": _planes(planes)}
                yield _batch(row, self.schema)


class PairSource(DataSource):
    """Options: a and b (a Side each, as JSON), span or pairs (JSON lists), fit, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "pixelquill_frame_pairs"

    def schema(self) -> str:
        return PAIRS

    def reader(self, schema: StructType) -> PairReader:
        return PairReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let it push conditions into them."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(PairSource)


def paths_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files at a path, as Spark lists them; their contents are not read."""
    return sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names of files


def _columns(schema: str, columns: list[str] | None) -> str:
    if columns is None:
        return schema
    kinds = dict(f.strip().split(" ", 1) for f in schema.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def read_frames(
    spark: SparkSession, path: str | list[str], raw: Raw | None = None, first: int = 0, start: int = 0, end: int | None = None, colour: Colour = Colour(), whole_path: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """Frames [start, end) of all files at path, numbered from `first` on; with `columns`, only those.
    The video_id is the file's name, or its whole path where names repeat between folders."""
    register(spark)
    given = {"paths": json.dumps(paths_of(spark, path)), "colour": json.dumps(asdict(colour)), "first": first, "start": start, "end": -1 if end is None else end, "whole_path": whole_path}
    if raw is not None:
        given["raw"] = json.dumps(asdict(raw))
    return spark.read.format(FrameSource.name()).schema(_columns(FRAMES, columns)).options(**given).load()


def read_y4m(spark: SparkSession, path: str | list[str], **given) -> DataFrame:
    """read_frames of Y4M files."""
    return read_frames(spark, path, **given)


def read_raw(spark: SparkSession, path: str | list[str], width: int, height: int, sample: str = "uint8", stride: int | None = None, layout: str = "planar", fps: float = 30.0, **given) -> DataFrame:
    """read_frames of headerless files of one layout."""
    return read_frames(spark, path, Raw(width, height, sample, stride, layout, fps), **given)


def read_pairs(spark: SparkSession, source: Side, other: Side, which: Span | list[tuple[int, int, int]], pair_id: str | None = None, fit: bool = True, columns: list[str] | None = None) -> DataFrame:
    """(pair_id, ord, src_frame, enc_frame, a_*, b_*): the pairs of a span, or of a list of (ord, source frame, other frame).

    With `fit`, frames of the other video that have another size are brought to that of the source."""
    register(spark)
    side = lambda s: json.dumps({"path": s.path, "raw": asdict(s.raw) if s.raw else None, "colour": asdict(s.colour), "crop": list(s.crop)})
    given = {"a": side(source), "b": side(other), "fit": fit}
    given |= {"span": json.dumps([which.start, which.end, which.every, which.offset])} if isinstance(which, Span) else {"pairs": json.dumps(which)}
    rows = spark.read.format(PairSource.name()).schema(_columns(PAIRS, columns)).options(**given).load()
    return rows.select(F.lit(pair_id or f"{source.path}|{other.path}").alias("pair_id"), "*")
