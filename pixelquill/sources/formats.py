"""Pixel formats and colour metadata as dimension tables.

A table of videos names its pixel format and, as far as its files say, matrix, transfer,
primaries, range and chroma location.  `described` joins the names with small tables and
fills in what is not said; `to_709` brings pixels of other transfers and primaries to the
common ones.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedInput
from .video import pixel_format

# The pixel formats that are known, and names of colour metadata; "unspecified" stands for what a file does not say.
PIXEL_FORMATS = (
    "yuv420p", "yuva420p", "yuv422p", "yuva422p", "yuyv422", "yuv444p", "yuva444p", "yuv410p", "yuv411p", "yuv440p",
    "yuv420p9le", "yuva420p9le", "yuv422p9le", "yuva422p9le", "yuv444p9le", "yuva444p9le",
    "yuv420p10le", "yuva420p10le", "yuv422p10le", "yuva422p10le", "yuv444p10le", "yuva444p10le", "yuv440p10le",
    "yuv420p12le", "yuv422p12le", "yuva422p12le", "yuv444p12le", "yuva444p12le", "yuv440p12le",
    "yuv420p14le", "yuv422p14le", "yuv444p14le",
    "yuv420p16le", "yuva420p16le", "yuv422p16le", "yuva422p16le", "yuv444p16le", "yuva444p16le",
    "yuvj420p", "yuvj422p", "yuvj444p", "yuvj411p", "yuvj440p", "rgb24", "rgba", "argb", "abgr", "bgra", "rgb48le", "rgba64le",
)
MATRICES = ("rgb", "bt709", "fcc", "bt470bg", "smpte170m", "smpte240m", "ycgco", "bt2020nc", "bt2020c", "chroma-derived-nc", "chroma-derived-c")
TRANSFERS = ("bt709", "gamma22", "gamma28", "smpte170m", "smpte240m", "linear", "log100", "log316", "iec61966-2-4", "iec61966-2-1", "bt2020-10", "bt2020-12", "smpte2084", "smpte428", "arib-std-b67")
LOCATIONS = ("left", "center", "topleft", "top", "bottomleft", "bottom")
RANGES = {"tv": False, "pc": True}
# Chromaticities (x, y) of red, green, blue and white.
PRIMARIES = {
    "bt709": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), (0.3127, 0.3290)),
    "bt470m": ((0.670, 0.330), (0.210, 0.710), (0.140, 0.080), (0.310, 0.316)),
    "bt470bg": ((0.640, 0.330), (0.290, 0.600), (0.150, 0.060), (0.3127, 0.3290)),
    "smpte170m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), (0.3127, 0.3290)),
    "smpte240m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), (0.3127, 0.3290)),
    "film": ((0.681, 0.319), (0.243, 0.692), (0.145, 0.049), (0.310, 0.316)),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    "smpte428": ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1 / 3, 1 / 3)),
    "smpte431": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.314, 0.351)),
    "smpte432": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    "ebu3213": ((0.630, 0.340), (0.295, 0.605), (0.155, 0.077), (0.3127, 0.3290)),
}
# The adaptation of white points through sharpened cones.
CONES = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))


def pixel_formats(spark: SparkSession) -> DataFrame:
    """(name, family, depth, sub_w, sub_h, full_range) of PIXEL_FORMATS."""
    rows = [tuple(asdict(pixel_format(n)).values()) for n in PIXEL_FORMATS]
    return spark.createDataFrame(rows, "name string, family string, depth int, sub_w int, sub_h int, full_range boolean")


def _one_of(value: Column, names) -> Column:
    return value.isNull() | (value == "unspecified") | value.isin(*names)


def _said(name: str) -> Column:
    """What a file says, null where it says nothing."""
    return F.when(F.col(name) != "unspecified", F.col(name))


def described(videos: DataFrame) -> DataFrame:
    """videos (pixel_format, width, height, matrix, transfer, primaries, range, location and others) with family, depth, sub_w, sub_h
    and full_range, all metadata filled in, and `problem`: null, or why the video cannot be read."""
    formats = pixel_formats(videos.sparkSession).withColumnsRenamed({"name": "pixel_format", "full_range": "_full"})
    rows = videos.join(F.broadcast(formats), "pixel_format", "left")
    rgb = F.col("family") == "rgb"
    usual = F.when(rgb, "rgb").when(F.col("height") > 650, "bt709").otherwise("bt470bg")
    old = (F.col("matrix") == "bt470bg") & F.col("matrix").isNotNull()  # a stated matrix of that kind changes what else is usual
    filled = {
        "matrix": F.coalesce(_said("matrix"), usual),
        "transfer": F.coalesce(_said("transfer"), F.when(old, "gamma28").when(rgb, "iec61966-2-1").otherwise("bt709")),
        "primaries": F.coalesce(_said("primaries"), F.when(old, "bt470bg").otherwise("bt709")),
        "location": F.coalesce(_said("location"), F.lit("left")),
        "full_range": F.when(F.col("range") == "pc", True).when(F.col("range") == "tv", False).otherwise(F.col("_full")),
    }
    known = (("matrix", MATRICES), ("transfer", TRANSFERS), ("primaries", PRIMARIES), ("range", RANGES), ("location", LOCATIONS))
    uneven = lambda n, sub: F.col(n) % F.pow(F.lit(2), F.col(sub)) != 0
    problem = F.when(F.col("family").isNull(), "pixel format")
    for name, names in known:
        problem = problem.when(~_one_of(F.col(name), names), name)
    problem = problem.when(uneven("width", "sub_w") | uneven("height", "sub_h"), "size")
    return rows.withColumn("problem", problem).withColumns(filled).drop("_full", "range")


def linear_light(v: np.ndarray, transfer: str) -> np.ndarray:
    """Encoded samples to linear light, 1 being reference white (of 100 cd/m2 for absolute transfers)."""
    size, sign = np.abs(v), np.sign(v)
    if transfer in ("bt709", "smpte170m", "iec61966-2-4", "bt2020-10", "bt2020-12"):
        return sign * np.where(size < 4.5 * 0.018053968510807, size / 4.5, ((size + 0.09929682680944) / 1.09929682680944) ** (1 / 0.45))
    if transfer == "smpte240m":
        return sign * np.where(size < 4 * 0.0228, size / 4, ((size + 0.1115) / 1.1115) ** (1 / 0.45))
    if transfer in ("gamma22", "gamma28"):
        return sign * size ** (float(transfer[5:]) / 10)
    if transfer == "linear":
        return v
    if transfer in ("log100", "log316"):
        low = 2.0 if transfer == "log100" else 2.5
        return np.where(v <= 0, 0.0, 10.0 ** (low * (v - 1)))
    if transfer == "iec61966-2-1":
        return sign * np.where(size <= 0.04045, size / 12.92, ((size + 0.055) / 1.055) ** 2.4)
    if transfer == "smpte2084":
        p = np.maximum(v, 0) ** (1 / 78.84375)
        return 100 * (np.maximum(p - 0.8359375, 0) / (18.8515625 - 18.6875 * p)) ** (1 / 0.1593017578125)
    if transfer == "smpte428":
        return 52.37 / 48 * np.maximum(v, 0) ** 2.6
    if transfer == "arib-std-b67":
        return np.where(v <= 0.5, v * size / 3, (np.exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12)
    raise UnsupportedInput(f"transfer {transfer!r}")


def encoded_709(v: np.ndarray) -> np.ndarray:
    size = np.abs(v)
    return np.sign(v) * np.where(size < 0.018053968510807, 4.5 * size, 1.09929682680944 * size**0.45 - 0.09929682680944)


def _to_xyz(name: str) -> np.ndarray:
    if name not in PRIMARIES:
        raise UnsupportedInput(f"primaries {name!r}")
    columns = np.array([[x, y, 1 - x - y] for x, y in PRIMARIES[name]])
    if name == "smpte428":
        return np.eye(3)
    white = columns[3] / columns[3][1]
    return columns[:3].T * np.linalg.solve(columns[:3].T, white)


@lru_cache(maxsize=32)
def primaries_to_709(name: str) -> np.ndarray:
    """Linear RGB of other primaries to the common ones, white staying white."""
    source, wanted, cones = _to_xyz(name), _to_xyz("bt709"), np.array(CONES)
    gain = (cones @ wanted.sum(axis=1)) / (cones @ source.sum(axis=1))
    return np.linalg.inv(wanted) @ np.linalg.inv(cones) @ np.diag(gain) @ cones @ source


def to_709(rgb: np.ndarray, transfer: str = "bt709", primaries: str = "bt709") -> np.ndarray:
    """Encoded RGB planes of any transfer and primaries as those of BT.709."""
    if transfer == "bt709" and primaries == "bt709":
        return rgb
    light = linear_light(rgb, transfer)
    if primaries != "bt709":
        light = np.tensordot(primaries_to_709(primaries), light, 1)
    return encoded_709(light)
