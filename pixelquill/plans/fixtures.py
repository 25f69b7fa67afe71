"""Frames derived from the shared tables, which hold no pictures.

Gray frames of 16 x 16 come from `events`, planes of 8 x 8 from `embeddings`; the "other"
video of a pair is the same frame quantised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(v: Column, levels: int = LEVELS) -> Column:
    return F.floor(v * levels) / float(levels)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, v, d): full 16 x 16 frames of events and their quantised twins."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("value"))
    full = F.floor(e.agg(F.count("*").alias("n")).select("n").scalar() / 256)
    p = F.pmod("event_id", F.lit(256)).cast("int")
    px = e.select(F.floor(F.col("event_id") / 256).alias("frame"), F.floor(p / 16).cast("int").alias("y"), (p % 16).cast("int").alias("x"), (F.least("value", F.lit(500.0)) / 500).alias("v"))
    return px.where(F.col("frame") < full).withColumn("d", quantised(F.col("v")))


def planes8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec, y, x, v): 8 x 8 planes of embeddings, in 0..1 and a little beyond."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.posexplode("embedding").alias("p", "e"))
    return e.select("vec", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), ((F.col("e").cast("double") + 1) / 2).alias("v"))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, r, g, b): three planes each make a frame."""
    p = planes8(spark, sf_dir)
    own = lambda c, k: F.max(F.when(F.pmod("vec", F.lit(3)) == k, F.col("v"))).alias(c)
    return p.groupBy(F.floor(F.col("vec") / 3).alias("frame"), "y", "x").agg(own("r", 0), own("g", 1), own("b", 2)).where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")


def pairs_of(px: DataFrame, size: int) -> DataFrame:
    """Plane rows of square colour frames (frame, y, x, r, g, b) and their twins: (pair_id, ord, a_*, b_*)."""
    rows = px.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))  # size * size pixels a frame
    plane = lambda c, f=None: F.transform("p", lambda s: (f(s[c]) if f else s[c]).cast("float"))
    a = F.array(*(plane(c) for c in "rgb"))
    b = F.array(*(plane(c, quantised) for c in "rgb"))
    side = F.lit(size)
    return rows.select(F.lit("colour").alias("pair_id"), F.col("frame").cast("int").alias("ord"), side.alias("a_width"), side.alias("a_height"), a.alias("a_planes"), side.alias("b_width"), side.alias("b_height"), b.alias("b_planes"))


def colour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(colour(spark, sf_dir), 8)


#: The side of the larger frames.
LARGE = 48


def large_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of LARGE x LARGE from events, three planes after each other, where all three are full."""
    plane, frame = LARGE * LARGE, 3 * LARGE * LARGE
    e = table(spark, sf_dir, "events").select("event_id", (F.least(F.col("value").cast("double"), F.lit(500.0)) / 500).alias("v"))
    whole = F.floor(e.agg(F.count("*").alias("n")).select("n").scalar() / frame)
    at = F.pmod("event_id", F.lit(plane))
    px = e.select(F.floor(F.col("event_id") / frame).alias("frame"), F.pmod(F.floor(F.col("event_id") / plane), F.lit(3)).alias("c"), F.floor(at / LARGE).cast("int").alias("y"), (at % LARGE).cast("int").alias("x"), "v")
    own = lambda c, k: F.max(F.when(F.col("c") == k, F.col("v"))).alias(c)
    return pairs_of(px.where(F.col("frame") < whole).groupBy("frame", "y", "x").agg(own("r", 0), own("g", 1), own("b", 2)), LARGE)


#: Steepness and centre of the made-up sensitivities of the four channels.
MADE_UP = ((0.9, 0.4), (0.7, -0.3), (0.7, -0.4), (0.8, 0.1))


def made_up_sensitivity():
    """A smooth table for tests and examples; it is NOT a measured calibration."""
    import numpy as np

    from ..operators.visibility import Sensitivity

    background, frequency = np.logspace(-2, 4, 13), np.logspace(-1, 1.8, 15)
    lb, lf = np.log10(background)[:, None], np.log10(frequency)[None, :]
    tables = [1.5 + 0.25 * lb - 0.08 * lb**2 - k * (lf - c) ** 2 for k, c in MADE_UP]
    return Sensitivity.from_axes(background, frequency, tables)
