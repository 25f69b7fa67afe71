"""Scores to and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import UnsupportedInput
from ..functions.pixel import band_frequency


def score_arrays(scores: DataFrame, values: list[str]) -> DataFrame:
    """(ord, json): one JSON array per frame, in the order of the score file."""
    return scores.select("ord", F.to_json(F.array(*(F.col(v).cast("double") for v in values))).alias("json"))


def write_json(scores: DataFrame, path: str, values: list[str], parts: int | None = None) -> None:
    """The JSON array `[[...], [...], ...]` in ascending ord, as text parts that make up one array when put
    together in the order of their names; each part is written by a task of its own.  ord has to be unique."""
    spark = scores.sparkSession
    first, last = scores.agg(F.min("ord"), F.max("ord")).collect()[0]
    if first is None:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = score_arrays(scores, values).repartitionByRange(n, "ord").sortWithinPartitions("ord").select(
        F.concat(F.when(F.col("ord") == first, "[").otherwise(""), F.col("json"), F.when(F.col("ord") == last, "]").otherwise(",")).alias("value")
    )
    marked.write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    """(ord, values...) of one JSON array in a file, or in the parts that write_json wrote."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    inner = F.regexp_replace(F.regexp_replace("value", r"^\s*\[\s*(?=[\[\]])", ""), r"\]\s*\]\s*$", "]")  # the whole array's own brackets
    rows = F.filter(F.from_json(F.concat(F.lit("["), F.regexp_replace(inner, r"^\s*\]\s*$|,\s*$", ""), F.lit("]")), "array<array<double>>"), lambda x: F.size(x) > 0)
    parsed = files.select("file", rows.alias("rows"))
    sizes = parsed.select("file", F.size("rows").cast("long").alias("n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sizes.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    placed = parsed.join(F.broadcast(starts), "file").select("start", F.posexplode("rows").alias("nth", "v"))
    return placed.select((F.col("start") + F.col("nth")).cast("int").alias("ord"), *(F.col("v")[i].alias(v) for i, v in enumerate(values)))


def report(summary: DataFrame, label: str) -> str:
    """A one-row summary as text."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise UnsupportedInput("a report needs one summary row")
    names = {"average": "Average", "deviation": "Standard Deviation", "median": "Median", "p5": "5th percentile", "p95": "95th percentile", "minimum": "Minimum", "maximum": "Maximum"}
    return "\n".join([f"{label:-^33}", *(f"{title:>18} : {rows[0][k]:12.6f}" for k, title in names.items())])


#: What a telemetry document holds.
TELEMETRY = "frame int, jod double, ppd double, display string, bands array<struct<band: int, rho: double, pixels: long, channels: array<struct<ch: int, q: double, minimum: double, maximum: double, mean: double>>>>"


def telemetry(scores: DataFrame, bands: DataFrame, ppd: float, display: str) -> DataFrame:
    """(pair_id, ord, json): a frame's quality, the viewing setup and every band's frequency (rho, cycles per degree),
    pixels and channels, each with its pooled, least, largest and mean difference."""
    channel = F.struct("ch", "q", "minimum", "maximum", "mean")
    per_band = bands.groupBy("pair_id", "ord", "band").agg(F.max("pixels").alias("pixels"), F.first(band_frequency(ppd)).alias("rho"), F.array_sort(F.collect_list(channel)).alias("channels"))
    listed = per_band.groupBy("pair_id", "ord").agg(F.array_sort(F.collect_list(F.struct("band", "rho", "pixels", "channels"))).alias("bands"))
    both = scores.join(listed, ["pair_id", "ord"])
    return both.select("pair_id", "ord", F.to_json(F.struct(F.col("ord").alias("frame"), F.col("score").alias("jod"), F.lit(ppd).alias("ppd"), F.lit(display).alias("display"), "bands")).alias("json"))
