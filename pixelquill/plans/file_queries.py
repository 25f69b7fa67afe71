"""Queries that write frames derived from the tables to files, and read them back through the sources."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pooling, sampling
from ..sources import clips, frames, scores, video
from ..sources.shared import shared_folder
from ..streaming import live
from . import fixtures

#: Frames of a clip.
CLIP = 8


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clip_frames(spark: SparkSession, sf_dir: str, lines: int = 16) -> DataFrame:
    """Clips of CLIP frames from the gray frames: planes v, 1 - v and d, cut to so many lines."""
    px = fixtures.gray(spark, sf_dir).where(F.col("y") < lines)
    rows = px.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v", "d"))).alias("p"))  # 256 pixels a frame
    plane = lambda f: F.transform("p", lambda s: f(s).cast("float"))
    planes = F.array(plane(lambda s: s["v"]), plane(lambda s: F.lit(1.0) - s["v"]), plane(lambda s: s["d"]))
    name = F.format_string("clip%06d", F.floor(F.col("frame") / CLIP))
    return rows.select(name.alias("video_id"), (F.col("frame") % CLIP).alias("frame_idx"), F.lit(16).alias("width"), F.lit(lines).alias("height"), F.lit(25.0).alias("fps"), planes.alias("planes"))


def written(spark: SparkSession, sf_dir: str, raw: video.Raw | None = None, lines: int = 16) -> str | None:
    """A folder of clips of one layout, None where the tables have no full frame; padding is 255."""
    folder = new_folder(spark, "clips")
    n = clips.write_clips(clip_frames(spark, sf_dir, lines), folder, raw, 255).agg(F.sum("frames")).collect()[0][0]  # runs it
    return folder if n else None


def read_back(spark: SparkSession, sf_dir: str, raw: video.Raw, lines: int) -> DataFrame:
    folder = written(spark, sf_dir, raw, lines)
    return frames.read_frames(spark, folder, raw) if folder else spark.createDataFrame([], video.FRAMES)


def plane_sums(rows: DataFrame, top: float) -> DataFrame:
    """Per plane, the sum of its samples and of samples times place, in whole units."""
    each = rows.select("video_id", "frame_idx", F.posexplode("planes").alias("plane", "p"))
    unit = lambda x: F.round(x * top).cast("long")
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + unit(x))
    moment = F.aggregate(F.transform("p", lambda x, i: unit(x) * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select("video_id", "frame_idx", "plane", total.alias("total"), moment.alias("moment"))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded 16-bit planes; only four frames of each clip are planned and read."""
    raw = video.Raw(16, 13, "uint16", 20)
    rows = read_back(spark, sf_dir, raw, 13)
    return plane_sums(rows.where("frame_idx >= 2 AND frame_idx < 6"), 65535.0)


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed layout with alpha in front."""
    raw = video.Raw(16, 16, layout="argb")
    return plane_sums(read_back(spark, sf_dir, raw, 16), 255.0)


def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of Y4M clips, through its cache."""
    folder = written(spark, sf_dir)
    if folder is None:
        return spark.createDataFrame([], "video_id string, width int, height int, fps double, frames long, clips int")
    cache = new_folder(spark, "index")
    first = video.file_index(spark, f"{folder}/clip*", cache).count()
    found = video.file_index(spark, f"{folder}/clip*", cache)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("video_id"), "width", "height", "fps", "frames", F.lit(first).alias("clips"))


def clip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the first clip against those of the last, up to two frames later, read as pairs; their first planes' norms."""
    raw = video.Raw(16, 16)
    folder = written(spark, sf_dir, raw)
    if folder is None:
        both = spark.createDataFrame([], frames.PAIRS)
    else:
        index = video.file_index(spark, folder, raw=raw)
        first, last = index.orderBy("path").limit(1).collect()[0], index.orderBy(F.desc("path")).limit(1).collect()[0]
        span = sampling.resolve(first.frames, last.frames, offset=min(2, last.frames - 1))
        both = frames.read_pairs(spark, frames.Side(first.path, raw), frames.Side(last.path, raw), span, "clips")
    pixels = both.select("ord", "src_frame", "enc_frame", F.explode(F.arrays_zip(F.col("a_planes")[0].alias("a"), F.col("b_planes")[0].alias("b"))).alias("z"))
    difference = (F.col("z.a") - F.col("z.b")).cast("double") * 255
    return pixels.groupBy("ord", "src_frame", "enc_frame").agg(*pooling.norms(F.round(difference)))


def score_files(spark: SparkSession, sf_dir: str, values: DataFrame) -> DataFrame:
    """Scores (ord, norm_q, norm_3, norm_inf) through a JSON array in parallel parts."""
    path = new_folder(spark, "scores")
    scores.write_json(values, path, ["norm_q", "norm_3", "norm_inf"])
    return scores.read_json(spark, path, ["norm_q", "norm_3", "norm_inf"])


def live_file(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(batch, value) of the live sink: the number of scores, and a stream's lines."""
    source, out = new_folder(spark, "source"), new_folder(spark, "live")
    values.write.parquet(source)
    n = spark.read.parquet(source).count()
    stream = spark.readStream.schema(values.schema).parquet(source)
    query = live.live_scores(stream, out, new_folder(spark, "checkpoint"), ["score"], n, once=True)
    query.awaitTermination()
    return live.live_lines(spark, out)


def planes_through_a_stream(spark: SparkSession, series: DataFrame, taps: np.ndarray) -> DataFrame:
    """Planes (pair_id, strip, ord, frames, planes) through the stateful stream."""
    source, out = new_folder(spark, "source"), new_folder(spark, "filtered")
    series.write.parquet(source)
    stream = spark.readStream.schema(series.schema).parquet(source)
    query = live.stream_planes(stream, taps, idle=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
