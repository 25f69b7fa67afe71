"""Which frames are compared: ranges, steps, offsets, index lists, crops, pairing.

Frames are rows of (video_id, frame_idx, ...).  Selection is a filter or an
equi-join on frame_idx, so it reaches the scan before any pixel is decoded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SamplingError
from ..sources.shared import materialised

#: Names of the metrics, and the short forms that are taken for them.
METRICS = {"structural": "structural", "struct": "structural", "psychovisual": "psychovisual", "psycho": "psychovisual", "display": "display", "visibility": "display"}


def metric_name(text: str) -> str:
    try:
        return METRICS[text.strip().lower()]
    except KeyError:
        raise SamplingError(f"unknown metric {text!r}") from None


def index_list(text: str | None) -> list[int]:
    """A comma-separated list of integers; spaces are skipped."""
    if text is None or not text.strip():
        return []
    try:
        return [int(part) for part in text.replace(" ", "").split(",")]
    except ValueError as e:
        raise SamplingError(f"not a list of indices: {text!r}") from e


def index_list_column(text: F.Column) -> F.Column:
    """The same over a column: an array of integers."""
    return F.transform(F.split(F.regexp_replace(text, " ", ""), ","), lambda x: x.cast("int"))


@dataclass(frozen=True)
class Span:
    """The source frames start, start + every, ... below end; a frame i meets i + offset."""

    start: int
    end: int
    every: int
    offset: int


def resolve(source_frames: int, other_frames: int, start: int = 0, end: int = -1, every: int = 1, offset: int = 0) -> Span:
    """Clamp a requested range to what both videos have."""
    if every < 1:
        raise SamplingError("every must be 1 or more")
    start = min(max(start, 0), source_frames)
    end = source_frames if end < 0 else min(end, source_frames)
    end = max(end, start)
    start = max(-offset, start)
    end = start + min(other_frames - (start + offset), end - start)
    if end < start:
        raise SamplingError(f"offset {offset} leaves no frames to compare")
    return Span(start, end, every, offset)


def sample(frames: DataFrame, span: Span, column: str = "frame_idx") -> DataFrame:
    """Every span.every-th frame of the range; deterministic, no random sample."""
    at = F.col(column)
    return frames.where((at >= span.start) & (at < span.end) & ((at - span.start) % span.every == 0))


def pair_by_offset(source: DataFrame, other: DataFrame, span: Span, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ord, src_frame, enc_frame): source frame i meets i + offset; an equi-join."""
    own = sample(source, span).select(*keys, F.col("frame_idx").alias("src_frame"), (F.col("frame_idx") + span.offset).alias("enc_frame"))
    there = other.select(*keys, F.col("frame_idx").alias("enc_frame"))
    paired = own.join(there, [*keys, "enc_frame"])
    return paired.select(*keys, ((F.col("src_frame") - span.start) / span.every).cast("int").alias("ord"), "src_frame", "enc_frame")


def listed_pairs(span: Span, source_frames: int, other_frames: int, source: list[int] | None = None, other: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(ord, source frame, other frame) from explicit lists of sampled ordinals; order and repeats stay."""
    if source:
        src = [span.start + i * span.every for i in source]
        if (bad := [i for i in src if i >= source_frames or i < 0]):
            raise SamplingError(f"source has no frame {bad[0]}")
    else:
        src = list(range(span.start, span.end, span.every))
    listed = other or source
    enc = [span.start + i * span.every + span.offset for i in listed] if listed else [i + span.offset for i in src]
    if (bad := [i for i in enc if i >= other_frames or i < 0]):
        raise SamplingError(f"the other video has no frame {bad[0]}")
    if len(src) != len(enc):
        raise SamplingError(f"{len(src)} source frames, but {len(enc)} others")
    return list(zip(range(len(src)), src, enc, strict=True))


def pair_by_lists(spark: SparkSession, span: Span, source_frames: int, other_frames: int, source: list[int] | None = None, other: list[int] | None = None) -> DataFrame:
    """listed_pairs as rows (ord, src_frame, enc_frame)."""
    return spark.createDataFrame(listed_pairs(span, source_frames, other_frames, source, other), "ord int, src_frame long, enc_frame long")


def zip_lists(lists: DataFrame, source: str, other: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ordinal zip of two array columns: the k-th with the k-th."""
    both = lists.select(*keys, F.posexplode(F.arrays_zip(F.col(source).alias("a"), F.col(other).alias("b"))).alias("ord", "z"))
    return both.select(*keys, "ord", F.col("z.a").alias("src_frame"), F.col("z.b").alias("enc_frame"))


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with `ord`, a row's number inside its key from 0, and `size`, the rows of its key.

    Rows are dealt by ranges of key and order, numbered inside their partition, and
    shifted by what earlier partitions hold of the key; so one key of any size is spread.
    The dealt rows are written once, each with the number of its partition, and both
    numbers come from what is written: ranges that are drawn twice need not be the same.
    The order has to tell all rows of a key apart; null keys are one key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    placed = materialised(dealt.withColumn("_nth", nth))
    counts = placed.groupBy(*keys, "_part").agg(F.max("_nth").cast("long").alias("_own"))  # a key's partitions: n rows at most
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_own").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_own_part"), before.alias("_before"), F.sum("_own").over(w).alias("size"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_part") == F.col("_own_part"))
    both = placed.join(shifts, same)
    return both.withColumn("ord", F.col("_before") + F.col("_nth") - 1).select(*rows.columns, "size", "ord")


def zip_ordered(source: DataFrame, other: DataFrame, keys: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Ordinal zip of numbered frames (keys, ord, frame_idx, values): an equi-join on key and number; a_* and b_* carry values."""
    a = source.select(*keys, "ord", F.col("frame_idx").alias("src_frame"), *(F.col(v).alias(f"a_{v}") for v in values))
    b = other.select(*keys, "ord", F.col("frame_idx").alias("enc_frame"), *(F.col(v).alias(f"b_{v}") for v in values))
    return a.join(b, [*keys, "ord"]).withColumn("ord", F.col("ord").cast("int"))


def attach(pairs: DataFrame, source: DataFrame, other: DataFrame, keys: tuple[str, ...] = (), values: tuple[str, ...] = ("width", "height", "planes")) -> DataFrame:
    """Both frames of each pair: columns a_* of the source and b_* of the other video."""
    a = source.select(*keys, F.col("frame_idx").alias("src_frame"), *(F.col(v).alias(f"a_{v}") for v in values))
    b = other.select(*keys, F.col("frame_idx").alias("enc_frame"), *(F.col(v).alias(f"b_{v}") for v in values))
    return pairs.join(a, [*keys, "src_frame"]).join(b, [*keys, "enc_frame"])


def crop_pixels(pixels: DataFrame, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0, width: int | F.Column = 0, height: int | F.Column = 0) -> DataFrame:
    """Pixels inside the crop, numbered anew from its corner."""
    inside = F.col("y").between(top, F.lit(height) - bottom - 1) & F.col("x").between(left, F.lit(width) - right - 1)
    return pixels.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def crop_plane(plane: F.Column, width: F.Column, height: F.Column, top: int, bottom: int, left: int, right: int) -> F.Column:
    """The crop of a row-major plane held in an array column."""
    rows = F.sequence(F.lit(top), height - bottom - 1)
    return F.flatten(F.transform(rows, lambda y: F.slice(plane, y * width + left + 1, width - left - right)))


def clip_slice(frames: DataFrame, begin: int, end: int, skip: int = 1, column: str = "frame_idx") -> DataFrame:
    """clip[begin:end:skip] with `position` (0, 1, ...) and the source index begin + skip * position."""
    cut = sample(frames, Span(begin, end, skip, 0), column)
    return cut.withColumn("position", ((F.col(column) - begin) / skip).cast("long"))


def with_properties(frames: DataFrame, pairs: DataFrame, scores: DataFrame, values: list[str], carry: str = "enc_frame") -> DataFrame:
    """Scores as columns of the frames that carry them (the other video's, or with src_frame the source's)."""
    named = pairs.join(scores.select("ord", *values), "ord").select(F.col(carry).alias("frame_idx"), *values)
    return frames.join(named, "frame_idx", "left")
