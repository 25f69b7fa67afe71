"""Pixels to frames, bands to channels, frames to summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def norms(value: Column, q: float = 2.0) -> list[Column]:
    """Q-norm, 3-norm and largest size of a difference map, as aggregates."""
    size = F.abs(value)
    return [F.pow(F.avg(F.pow(size, F.lit(q))), F.lit(1.0 / q)).alias("norm_q"), F.pow(F.avg(size * size * size), F.lit(1.0 / 3.0)).alias("norm_3"), F.max(size).alias("norm_inf")]


def mean_and_norm4(value: Column, name: str) -> list[Column]:
    return [F.avg(value).alias(f"{name}_mean"), F.pow(F.avg(value * value * value * value), F.lit(0.25)).alias(f"{name}_norm4")]


def beta_pool(value: Column, beta: float) -> Column:
    return F.pow(F.avg(F.pow(F.abs(value), F.lit(beta))), F.lit(1.0 / beta))


def pool_bands(scores: DataFrame, keys: list[str], p=K.DISPLAY_PARAMETERS) -> DataFrame:
    """Band and channel scores (keys, band, bands, ch, q) to one q per frame.

    Bands are pooled inside their channel, the base band with its own weights; then
    channels with theirs."""
    base = reduce(lambda a, i: F.when(F.col("ch") == i, F.lit(p["baseband_weight"][i])).otherwise(a), range(4), F.lit(1.0))
    weight = F.when(F.col("band") == F.col("bands") - 1, base).otherwise(F.lit(1.0))
    inner = F.pow(F.greatest("q", F.lit(0.0)) * weight, F.lit(p["beta_sch"]))
    channels = scores.groupBy(*keys, "ch").agg(F.pow(F.sum(inner), F.lit(1 / p["beta_sch"])).alias("q"))
    own = F.when(F.col("ch").isin(1, 2), F.lit(p["ch_chrom_w"])).when(F.col("ch") == 3, F.lit(p["ch_trans_w"])).otherwise(F.lit(1.0))
    return channels.groupBy(*keys).agg(F.pow(F.sum(F.pow(F.col("q") * own, F.lit(p["beta_tch"]))), F.lit(1 / p["beta_tch"])).alias("q"))


#: Rank accuracy of the sketch that brackets an order statistic.
ACCURACY = 10_000


def summarize(scores: DataFrame, value: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact summary per key: average, population deviation, median, 5th and 95th percentile, least, most.

    Order statistics are sorted[n div 2], sorted[n div 20] and sorted[19 n div 20].  A quantile
    sketch brackets each of them within a few ten-thousandths of the rows; what lies below the
    bracket is counted and only the values inside are ranked, so no task sorts a whole key."""
    ranks = {"median": (1, 2), "p5": (1, 20), "p95": (19, 20)}
    rows = scores.where(F.col(value).isNotNull()).select(*keys, F.lit(0).alias("_one"), F.col(value).cast("double").alias("v"))
    by = [*keys, "_one"]
    brackets = [F.percentile_approx("v", F.array(F.lit(max(0.0, a / b - 2 / ACCURACY)), F.lit(min(1.0, a / b + 3 / ACCURACY))), ACCURACY).alias(k) for k, (a, b) in ranks.items()]
    total = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("v").alias("average"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), *brackets
    )
    wanted = total.select(*by, "n", F.explode(F.array(*(
        F.struct(F.lit(k).alias("name"), F.floor(F.col("n") * a / b).alias("rank"), F.least(F.col(k)[0], F.col(k)[1]).alias("low"), F.greatest(F.col(k)[0], F.col(k)[1]).alias("high")) for k, (a, b) in ranks.items()
    ))).alias("w")).select(*by, "w.*")
    counted = rows.groupBy(*by, "v").agg(F.count("*").alias("c")).withColumnsRenamed({k: f"_{k}" for k in by})
    met = counted.join(wanted, reduce(lambda a, b: a & b, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in by)))
    below = met.where("v < low").groupBy(*by, "name").agg(F.sum("c").alias("below")).withColumnsRenamed({k: f"_{k}" for k in (*by, "name")})
    running = Window.partitionBy(*by, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = met.where("v BETWEEN low AND high").withColumn("upto", F.sum("c").over(running)).select(*by, "name", "rank", "v", "upto")
    ranked = inside.join(below, reduce(lambda a, b: a & b, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in (*by, "name"))), "left").select(*by, "name", "rank", "v", (F.col("upto") + F.coalesce("below", F.lit(0))).alias("upto"))
    picked = ranked.where("upto > rank").groupBy(*by).agg(*(F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks)).withColumnsRenamed({k: f"_{k}" for k in by})
    base = total.select(*by, "n", "average", "deviation", "minimum", "maximum")
    out = base.join(picked, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by)))
    return out.select(*keys, "n", "average", "deviation", "median", "p5", "p95", "minimum", "maximum")


def histogram(scores: DataFrame, value: str = "score", per_unit: int = 2, top: int = 100) -> DataFrame:
    """Counts of bins of width 1 / per_unit over 0..top, empty bins with 0."""
    spark = scores.sparkSession
    bins = spark.range(top * per_unit + 1).select(F.col("id").cast("int").alias("bin"))
    counted = scores.where(F.col(value).between(0, top)).groupBy(F.floor(F.col(value) * per_unit).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
