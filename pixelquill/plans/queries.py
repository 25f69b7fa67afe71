"""One query per operator over derived frames, and its SQL for another engine."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import pixel
from ..operators import pooling, sampling, stencil, temporal
from ..operators.psychovisual import psychovisual_distance
from ..operators.structural import structural_score
from ..operators.visibility import display_difference
from ..sources import formats
from ..sources.config import Display
from . import file_queries, fixtures, metric_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column, name: str, digits: int = 6) -> Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


# The derived frames in SQL.
GRAY = """px AS (
  SELECT event_id // 256 AS frame, CAST((event_id % 256) // 16 AS INTEGER) AS y, CAST(event_id % 16 AS INTEGER) AS x, least(CAST(value AS DOUBLE), 500.0) / 500 AS v
  FROM events WHERE event_id // 256 < (SELECT count(*) FROM events) // 256
), pair AS (SELECT *, floor(v * 16) / 16.0 AS d FROM px)"""
PLANES = """pl AS (
  SELECT vec_id AS vec, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, (CAST(e AS DOUBLE) + 1) / 2 AS v
  FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings)
)"""
COLOUR = PLANES + """, rgb AS (
  SELECT vec // 3 AS frame, y, x, max(v) FILTER (vec % 3 = 0) AS r, max(v) FILTER (vec % 3 = 1) AS g, max(v) FILTER (vec % 3 = 2) AS b
  FROM pl GROUP BY 1, 2, 3 HAVING count(*) = 3
)"""


def sql_mix(row, *names: str) -> str:
    terms = " + ".join(f"{w!r} * {n}" for w, n in zip(row, names, strict=False))
    return f"({terms}{f' + {row[len(names)]!r}' if len(row) > len(names) else ''})"


# --- sampling and pairing ---------------------------------------------------


def _videos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' event sequences as two videos: the other one starts 3 frames late."""
    e = fixtures.table(spark, sf_dir, "events").groupBy((F.floor(F.col("event_id") / 256)).alias("frame_idx")).agg(F.count("*").alias("n"))
    return e, e.select((F.col("frame_idx") + 3).alias("frame_idx"), "n")


@query("""WITH f AS (SELECT DISTINCT event_id // 256 AS i FROM events)
SELECT CAST((i - 1) // 2 AS INTEGER) AS ord, i AS src_frame, i + 3 AS enc_frame FROM f WHERE i >= 1 AND i < 30 AND (i - 1) % 2 = 0""")
def pair_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, other = _videos(spark, sf_dir)
    return sampling.pair_by_offset(source, other, sampling.Span(1, 30, 2, 3))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_id, event_type, value, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST(a.ord AS INTEGER) AS ord, a.event_id AS src_frame, b.event_id AS enc_frame, a.event_type AS a_event_type, a.value AS a_value, b.event_type AS b_event_type, b.value AS b_value
FROM e a JOIN e b USING (user_id) WHERE b.ord = a.n - 1 - a.ord""")
def pair_zip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's frames forwards against the same frames backwards; what frames carry comes along."""
    e = fixtures.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    forwards = sampling.numbered(e, ("user_id",), ("ts", "event_id")).withColumnRenamed("event_id", "frame_idx")
    backwards = forwards.withColumn("ord", F.col("size") - 1 - F.col("ord"))
    return sampling.zip_ordered(forwards, backwards, ("user_id",), ("event_type", "value"))


@query("SELECT event_id AS frame_idx FROM events WHERE event_id >= 100 AND event_id < 5000 AND (event_id - 100) % 7 = 0")
def sample_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_idx"))
    return sampling.sample(frames, sampling.Span(100, 5000, 7, 0))


@query("""SELECT page_id, i AS pos, CAST(trim(e) AS INTEGER) AS idx FROM (
  SELECT page_id, unnest(range(3)) AS i, unnest([CAST(page_id AS VARCHAR), ' ' || CAST(page_id * 2 AS VARCHAR), CAST(page_id + 7 AS VARCHAR) || ' ']) AS e FROM pages)""")
def index_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.table(spark, sf_dir, "pages")
    text = F.concat(F.col("page_id").cast("string"), F.lit(", "), (F.col("page_id") * 2).cast("string"), F.lit(","), (F.col("page_id") + 7).cast("string"), F.lit(" "))
    return p.select("page_id", F.posexplode(sampling.index_list_column(text)).alias("pos", "idx")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {GRAY} SELECT frame, y - 2 AS y, x - 3 AS x, round(v, 6) + 0.0 AS v FROM px WHERE y BETWEEN 2 AND 14 AND x BETWEEN 3 AND 11")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.crop_pixels(fixtures.gray(spark, sf_dir), 2, 1, 3, 4, 16, 16).select("frame", "y", "x", r6(F.col("v"), "v"))


# --- summaries --------------------------------------------------------------


def _frame_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.gray(spark, sf_dir)
    return g.groupBy("frame").agg(*pooling.norms(pixel.squared(F.col("v"), F.col("d"), 100.0)))


NORMS = GRAY + """, sq AS (SELECT frame, 100.0 * (v - d) * (v - d) AS e FROM pair), n AS (
  SELECT frame, pow(avg(pow(abs(e), 2.0)), 0.5) AS norm_q, pow(avg(abs(e) * abs(e) * abs(e)), 1.0 / 3.0) AS norm_3, max(abs(e)) AS norm_inf FROM sq GROUP BY frame
)"""


@query(f"WITH {NORMS} SELECT frame, round(norm_q, 6) + 0.0 AS norm_q, round(norm_3, 6) + 0.0 AS norm_3, round(norm_inf, 6) + 0.0 AS norm_inf FROM n")
def norms_q3inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_norms(spark, sf_dir).select("frame", *(r6(F.col(c), c) for c in ("norm_q", "norm_3", "norm_inf")))


SUMMARY = """count(*) AS n, round(avg({v}), 6) + 0.0 AS average, round(stddev_pop({v}), 6) + 0.0 AS deviation,
  round(list_sort(list({v}))[count(*) // 2 + 1], 6) + 0.0 AS median, round(list_sort(list({v}))[count(*) // 20 + 1], 6) + 0.0 AS p5, round(list_sort(list({v}))[19 * count(*) // 20 + 1], 6) + 0.0 AS p95,
  round(min({v}), 6) + 0.0 AS minimum, round(max({v}), 6) + 0.0 AS maximum"""


def _rounded(summary: DataFrame, *keys: str) -> DataFrame:
    return summary.select(*keys, "n", *(r6(F.col(c), c) for c in ("average", "deviation", "median", "p5", "p95", "minimum", "maximum")))


@query(f"WITH {NORMS} SELECT {SUMMARY.format(v='norm_q')} FROM n")
def norm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: frames, twins, differences, norms, summary."""
    return _rounded(pooling.summarize(_frame_norms(spark, sf_dir), "norm_q"))


@query(f"SELECT event_type, {SUMMARY.format(v='value')} FROM events GROUP BY event_type")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pooling.summarize(fixtures.table(spark, sf_dir, "events"), "value", ("event_type",)), "event_type")


@query("""WITH b AS (SELECT CAST(unnest(range(201)) AS INTEGER) AS bin), c AS (SELECT CAST(floor(value * 2) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.histogram(fixtures.table(spark, sf_dir, "events"), "value")


@query(f"WITH {GRAY}, s AS (SELECT frame, abs(v - d) AS e FROM pair) SELECT frame, round(avg(e), 6) + 0.0 AS e_mean, round(pow(avg(e * e * e * e), 0.25), 6) + 0.0 AS e_norm4 FROM s GROUP BY frame")
def norm4_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.gray(spark, sf_dir)
    return g.groupBy("frame").agg(*pooling.mean_and_norm4(F.abs(F.col("v") - F.col("d")), "e")).select("frame", r6(F.col("e_mean"), "e_mean"), r6(F.col("e_norm4"), "e_norm4"))


@query(f"WITH {GRAY} SELECT frame, round(pow(avg(pow(abs(v - d), 2.0)), 0.5), 6) + 0.0 AS q FROM pair GROUP BY frame")
def beta_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.gray(spark, sf_dir).groupBy("frame").agg(r6(pooling.beta_pool(F.col("v") - F.col("d"), 2.0), "q"))


P = K.DISPLAY_PARAMETERS


@query(f"""WITH {PLANES}, s AS (SELECT vec // 12 AS frame, (vec % 12) // 4 AS band, vec % 4 AS ch, avg(v) * 10 AS q FROM pl GROUP BY 1, 2, 3), w AS (
  SELECT *, CASE WHEN band < 2 THEN 1.0 WHEN ch = 0 THEN {P['baseband_weight'][0]!r} WHEN ch = 1 THEN {P['baseband_weight'][1]!r} WHEN ch = 2 THEN {P['baseband_weight'][2]!r} ELSE {P['baseband_weight'][3]!r} END AS bw FROM s
), c AS (SELECT frame, ch, pow(sum(pow(q * bw, 4.0)), 0.25) AS q FROM w GROUP BY 1, 2)
SELECT frame, round(pow(sum(pow(q * CASE WHEN ch = 3 THEN {P['ch_trans_w']!r} ELSE 1.0 END, 4.0)), 0.25), 6) + 0.0 AS q FROM c GROUP BY frame""")
def band_channel_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.planes8(spark, sf_dir).groupBy("vec").agg((F.avg("v") * 10).alias("q"))
    s = p.select(F.floor(F.col("vec") / 12).alias("frame"), F.floor(F.pmod("vec", F.lit(12)) / 4).alias("band"), F.lit(3).alias("bands"), F.pmod("vec", F.lit(4)).alias("ch"), "q")
    return pooling.pool_bands(s, ["frame"]).select("frame", r6(F.col("q"), "q"))


# --- per-pixel expressions ---------------------------------------------------


def _colour_query(name: str, names: list[str], exprs: Callable, sql: list[str], tables: str = COLOUR, source: str = "rgb") -> None:
    """A query that projects expressions of r, g, b (or v, d) per pixel."""
    make = fixtures.colour if source == "rgb" else fixtures.gray

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = make(spark, sf_dir)
        return px.select("frame", "y", "x", *(r6(e, n) for e, n in zip(exprs(*(F.col(c) for c in ("rgb" if source == "rgb" else "vd"))), names, strict=True)))

    run.__name__ = name
    query(f"WITH {tables} SELECT frame, y, x, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for e, n in zip(sql, names, strict=True)) + f" FROM {source}")(run)


def _gray_query(name: str, names: list[str], exprs: Callable, sql: list[str]) -> None:
    _colour_query(name, names, exprs, sql, GRAY, "pair")


def _s(v: str, exponent: str = "2.4") -> str:
    return f"(sign({v}) * pow(abs({v}), {exponent}))"


_colour_query("linearise", ["r", "g", "b"], lambda r, g, b: [pixel.linear(c - 0.5) for c in (r, g, b)], [_s(f"({c} - 0.5)") for c in "rgb"])

_lms = [f"(cbrt(greatest({sql_mix(row, 'r', 'g', 'b')}, 0.0)) + {K.STRUCTURAL_CUBE_BIAS!r})" for row in K.STRUCTURAL_OPSIN]
_x = f"(0.5 * ({_lms[0]} - {_lms[1]}))"
_colour_query("xyb_positive", ["x_", "y_", "b_"], pixel.positive_xyb, [f"{_x} * 14.0 + 0.42", f"({_x} + {_lms[1]}) + 0.01", f"({_lms[2]} - ({_x} + {_lms[1]})) + 0.55"])
_absorbed = [f"greatest({sql_mix(row, 'r', 'g', 'b')}, {row[3]!r})" for row in K.PSYCHO_OPSIN]
_colour_query("opsin_absorbance", ["l", "m", "s"], lambda r, g, b: pixel.absorbance(r, g, b, True), _absorbed)

_i = [f"greatest({sql_mix(row, '(r * 203.0)', '(g * 203.0)', '(b * 203.0)')}, {row[3]!r})" for row in K.PSYCHO_OPSIN]
_sens = [f"greatest((19.245013259874995 * ln(greatest({e}, 1e-4) + 9.9710635769299145) - 23.16046239805755) / greatest({e}, 1e-4), 1e-4)" for e in _i]
_ad = [f"greatest({sql_mix(row, '(r * 203.0)', '(g * 203.0)', '(b * 203.0)')} * {s}, {row[3]!r})" for row, s in zip(K.PSYCHO_OPSIN, _sens, strict=True)]
_colour_query("opsin_dynamics", ["x_", "y_", "b_"], lambda r, g, b: pixel.adapted_xyb([r, g, b], [r, g, b]), [f"{_ad[0]} - {_ad[1]}", f"{_ad[0]} + {_ad[1]}", _ad[2]])
_colour_query("low_to_values", ["x_", "y_", "b_"], pixel.low_to_values, ["r * 33.832837186260", "g * 14.458268100570", "(b + -0.362267051518 * g) * 49.87984651440"])
_colour_query("suppress_by_luma", ["x_"], lambda r, g, b: [pixel.suppress_by(r, g * 10)], [f"r * (0.653020556257 + {46.0 * (1 - 0.653020556257)!r} / (46.0 + (g * 10) * (g * 10)))"])

_gray_query(
    "range_around_zero", ["shrunk", "stretched", "clamped"],
    lambda v, d: [pixel.shrink_near_zero((v - d) * 20, 0.29), pixel.stretch_near_zero((v - d) * 20, 0.1), pixel.soft_clamp((v - d) * 20 - 0.5, 0.4)],
    ["CASE WHEN (v - d) * 20 > 0.29 THEN (v - d) * 20 - 0.29 WHEN (v - d) * 20 < -0.29 THEN (v - d) * 20 + 0.29 ELSE 0.0 END",
     "CASE WHEN (v - d) * 20 > 0.1 THEN (v - d) * 20 + 0.1 WHEN (v - d) * 20 < -0.1 THEN (v - d) * 20 - 0.1 ELSE (v - d) * 20 * 2.0 END",
     "CASE WHEN (v - d) * 20 - 0.5 >= 0.4 THEN ((v - d) * 20 - 0.5 - 0.4) * 0.688059627878 + 0.4 WHEN (v - d) * 20 - 0.5 < -0.4 THEN ((v - d) * 20 - 0.5 + 0.4) * 0.688059627878 - 0.4 ELSE (v - d) * 20 - 0.5 END"],
)
_gray_query("l2_diff", ["e"], lambda v, d: [pixel.squared(v, d, 29.2353797994)], ["29.2353797994 * (v - d) * (v - d)"])
_out = lambda low, high: f"greatest(CASE WHEN a < 0 THEN b + abs(a) * {low} ELSE abs(a) * {low} - b END, CASE WHEN a < 0 THEN -b - abs(a) * {high} ELSE b - abs(a) * {high} END, 0.0)"
_ab = GRAY + ", ab AS (SELECT frame, y, x, (v - 0.3) * 10 AS a, (d - 0.25) * 10 AS b FROM pair)"


def _ab_query(name: str, names: list[str], exprs: Callable, sql: list[str]) -> None:
    """As above, over signed values a and b."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = fixtures.gray(spark, sf_dir).select("frame", "y", "x", ((F.col("v") - 0.3) * 10).alias("a"), ((F.col("d") - 0.25) * 10).alias("b"))
        return px.select("frame", "y", "x", *(r6(e, n) for e, n in zip(exprs(F.col("a"), F.col("b")), names, strict=True)))

    run.__name__ = name
    query(f"WITH {_ab} SELECT frame, y, x, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for e, n in zip(sql, names, strict=True)) + " FROM ab")(run)


_ab_query("l2_asym_diff", ["e"], lambda a, b: [pixel.squared_asymmetric(a, b, 1.2, 2.5)], [f"{1.2 * 0.8!r} * (a - b) * (a - b) + {2.5 * 0.8!r} * {_out(0.4, 1.0)} * {_out(0.4, 1.0)}"])


def _oriented_sql(lines: str, weight: float, exponent: float, norm: float) -> str:
    per = K.LINE_SCALE[lines] / (K.LINE_LENGTH * 2 + 1)
    more, less = per * (0.5 * weight * K.ASYMMETRY**exponent) ** 0.5 * norm, per * (0.33 * weight / K.ASYMMETRY**exponent) ** 0.5 * norm
    size = f"({norm!r} + 0.5 * abs(a) + 0.5 * abs(b))"
    return f"(a - b) * ({more!r} / {size}) + CASE WHEN a - b < 0 THEN -1 ELSE 1 END * {_out(0.55, 1.05)} * ({less!r} / {size})"


_ab_query("oriented_pre_diff", ["high", "low"], lambda a, b: [pixel.oriented_difference(a, b, *K.ORIENTED[0][2:]), pixel.oriented_difference(a, b, *K.ORIENTED[3][2:])], [_oriented_sql(*K.ORIENTED[0][2:]), _oriented_sql(*K.ORIENTED[3][2:])])
_ab_query(
    "mask_input", ["m", "c"], lambda a, b: [pixel.mask_input(a, b, b, a), pixel.mask_compress(a)],
    ["sqrt(((b + a) * 2.5) * ((b + a) * 2.5) + (a * 0.4 + b * 0.4) * (a * 0.4 + b * 0.4))", f"sqrt(6.19424080439 * abs(a) + {6.19424080439 * 12.61050594197!r}) - sqrt({6.19424080439 * 12.61050594197!r})"],
)
_gain = lambda m, o, s, k: f"pow((1.0 + {k!r} / ({s!r} * {m} + {o!r})) * {1.0 / (0.79079917404 * 17.83)!r}, 2)"
_ab_query(
    "mask_combine", ["e"], lambda a, b: [pixel.combined_difference(F.abs(a), b * b, F.abs(b))],
    [f"sqrt({_gain('abs(a)', 0.829591754942, 0.451936922203, 2.5485944793)} * b * b + {_gain('abs(a)', 0.20025578522, 3.87449418804, 0.505054525019)} * abs(b))"],
)
_ab_query("weber_contrast", ["c"], lambda a, b: [pixel.weber(a, b)], ["least(a / greatest(b, 0.01), 1000.0)"])
_ab_query("mutual_mask", ["m"], lambda a, b: [pixel.mutual(a, b)], ["least(abs(a), abs(b))"])
_xcm = lambda d: " + ".join(f"{m} * {2.0 ** P['xcm_weights'][s * 4 + d]!r}" for s, m in enumerate(("abs(a)", "abs(b)", "abs(a - b)", "abs(a + b)")))
_ab_query("cross_channel_mask", ["m0", "m1", "m2", "m3"], lambda a, b: pixel.across_channels([F.abs(a), F.abs(b), F.abs(a - b), F.abs(a + b)]), [_xcm(d) for d in range(4)])
_pw = lambda v, p: f"(pow({v} + 1e-5, {p!r}) - {1e-5**p!r})"
_mk = f"({_pw('abs(a - b)', P['mask_p'])} / (1.0 + {_pw('greatest(abs(b), 0.0)', P['mask_q'][1])}))"
_most = 10.0 ** P["d_max"]
_ab_query(
    "masking_clamp", ["soft", "hard", "none_"], lambda a, b: [pixel.masked(a, b, F.abs(b), P["mask_q"][1], kind=k) for k in ("soft", "hard", "none")],
    [f"{_mk} * {_most!r} / ({_most!r} + {_mk})", f"least({_mk}, {_most!r})", _mk],
)
_jod = f"least(greatest(CASE WHEN abs(a) <= 0.1 THEN 10.0 - abs(a) * {P['jod_a'] * 0.1 ** (P['jod_exp'] - 1)!r} ELSE 10.0 - {P['jod_a']!r} * pow(abs(a), {P['jod_exp']!r}) END, 0.0), 10.0)"
_ab_query("jod_map", ["q"], lambda a, b: [pixel.quality_units(F.abs(a))], [_jod])
_poly = "(v * 20 * 0.9562382616834844)"
_gray_query(
    "structural_polynomial", ["score"], lambda v, d: [pixel.structural_value(v * 20)],
    [f"CASE WHEN {_poly} * {_poly} * {_poly} * 6.248496625763138e-5 + {_poly} * 2.326765642916932 - {_poly} * {_poly} * 0.020884521182843837 > 0 THEN pow({_poly} * {_poly} * {_poly} * 6.248496625763138e-5 + {_poly} * 2.326765642916932 - {_poly} * {_poly} * 0.020884521182843837, 0.6276336467831387) * -10.0 + 100.0 ELSE 100.0 END"],
)
_pq = "pow(v, 0.012683313515655966)"
_gray_query(
    "display_luminance", ["srgb", "pq", "hlg", "gamma"], lambda v, d: [pixel.luminance(v, e, 200.0, 0.2, 2.2) for e in ("sRGB", "PQ", "HLG", "gamma")],
    ["0.2 + 199.8 * CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END",
     f"greatest(pow(greatest({_pq} - 0.8359375, 0.0) / greatest(18.8515625 - {_pq} * 18.6875, 1e-10), {1 / 0.1593017578125!r}) * 10000.0, 0.2)",
     "greatest(CASE WHEN v <= 0.5 THEN v * v / 3.0 ELSE (exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12.0 END * 200.0, 0.2)", "0.2 + 199.8 * pow(v, 2.2)"],
)
_xyz = [sql_mix(row, "r", "g", "b") for row in Display().rgb_to_xyz]
_cone = [sql_mix(row, *_xyz) for row in K.XYZ_TO_LMS]
_colour_query("opponent_channels", ["y_", "rg", "by_"], lambda r, g, b: pixel.opponent(r, g, b, Display().rgb_to_xyz), [sql_mix(row, *_cone) for row in K.LMS_TO_DKL])


@query("""WITH d AS (SELECT c_custkey AS id, 640 + c_custkey % 3200 AS w, 480 + c_custkey % 1680 AS h, 5.0 + c_custkey % 50 AS diag, 0.2 + (c_custkey % 30) / 10.0 AS dist FROM customer)
SELECT id, round(w / degrees(2 * atan(diag * 0.0254 * (w / sqrt(w * w + h * h)) * 0.5 / dist)), 6) + 0.0 AS ppd, round(200.0 / (100 + id % 900) + (id % 400) * (0.005 / pi()), 6) + 0.0 AS black FROM d""")
def display_ppd(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = fixtures.table(spark, sf_dir, "customer").select(k.alias("id"), (k % 3200 + 640).alias("w"), (k % 1680 + 480).alias("h"), (k % 50 + 5.0).alias("diag"), (F.lit(0.2) + (k % 30) / 10.0).alias("dist"))
    return d.select("id", r6(pixel.pixels_per_degree(F.col("w"), F.col("h"), F.col("diag"), F.col("dist")), "ppd"), r6(pixel.black_level(F.lit(200.0), F.col("id") % 900 + 100.0, F.col("id") % 400), "black"))


# --- neighbourhoods -----------------------------------------------------------


def _taps(sigma: float, radius: int) -> list[tuple[int, float]]:
    return [(j, math.exp(-j * j / (2 * sigma * sigma))) for j in range(-radius, radius + 1)]


def _blur_sql(source: str, name: str, value: str = "v", sigma: float = 1.5, radius: int = 8) -> str:
    """Two passes as joins with a table of taps."""
    taps = ", ".join(f"({j}, {w!r})" for j, w in _taps(sigma, radius))
    one = lambda src, out, axis, other: f"{out} AS (SELECT a.frame, a.y, a.x, sum(b.v * t.w) / sum(t.w) AS v FROM {src} a JOIN (VALUES {taps}) t(j, w) ON true JOIN {src} b ON b.frame = a.frame AND b.{other} = a.{other} AND b.{axis} = a.{axis} + t.j GROUP BY 1, 2, 3)"
    return f"{name}_0 AS (SELECT frame, y, x, {value} AS v FROM {source}), {one(f'{name}_0', f'{name}_1', 'x', 'y')}, {one(f'{name}_1', name, 'y', 'x')}"


@query(f"WITH {GRAY}, {_blur_sql('px', 'bl')} SELECT frame, y, x, round(v, 6) + 0.0 AS v FROM bl")
def gauss_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gaussian(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v"), K.STRUCTURAL_SIGMA, K.STRUCTURAL_RADIUS).select("frame", "y", "x", r6(F.col("v"), "v"))


@query(f"WITH {GRAY} SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM px WHERE y < 15 AND x < 13 GROUP BY 1, 2, 3")
def box_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = fixtures.gray(spark, sf_dir).where("y < 15 AND x < 13")
    return stencil.halve(odd).select("frame", "y", "x", r6(F.col("v"), "v"))


@query(f"WITH {GRAY}, h AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(d) AS s FROM pair GROUP BY 1, 2, 3) SELECT p.frame, p.y, p.x, round(v * 0.85 + s * 0.5, 9) + 0.0 AS v FROM px p JOIN h ON h.frame = p.frame AND h.y = p.y // 2 AND h.x = p.x // 2")
def supersample_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.gray(spark, sf_dir)
    small = stencil.halve(g.select("frame", "y", "x", F.col("d").alias("v")))
    return stencil.add_supersampled(g.select("frame", "y", "x", "v"), small).select("frame", "y", "x", r6(F.col("v"), "v", 9))


_CUBIC = "CASE WHEN {x} < 1 THEN (7 * pow({x}, 3) - 12 * pow({x}, 2) + 16.0 / 3) / 6 WHEN {x} < 2 THEN (-7.0 / 3 * pow({x}, 3) + 12 * pow({x}, 2) - 20 * {x} + 32.0 / 3) / 6 ELSE 0.0 END"


def _resample_sql(source: str, out: str, along: str, across: str, have: int, want: int) -> str:
    """One axis: taps of the bicubic kernel, mirrored at the ends, made wider where the line becomes shorter."""
    step = min(1.0, want / have)
    n = 2 * math.ceil(2 / step)
    return f"""{out}_k AS (SELECT o, k, (o + 0.5) * {have / want!r} AS c, floor((o + 0.5) * {have / want!r} - {n / 2} + 0.5) + k AS p FROM range({want}) a(o), range({n}) b(k)
), {out}_w AS (SELECT o, CAST(least((p + {4 * have}) % {2 * have}, {2 * have} - 1 - (p + {4 * have}) % {2 * have}) AS INTEGER) AS i, {_CUBIC.format(x=f"abs((p + 0.5 - c) * {step!r})")} AS w FROM {out}_k
), {out}_t AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM {out}_w
), {out} AS (SELECT frame, CAST(o AS INTEGER) AS {along}, {across}, sum(v * w) AS v FROM {source} JOIN {out}_t ON {along} = i GROUP BY 1, 2, 3)"""


@query(f"WITH {GRAY}, {_resample_sql('px', 'wide', 'x', 'y', 16, 23)}, {_resample_sql('wide', 'low', 'y', 'x', 16, 5)} SELECT frame, y, x, round(v, 6) + 0.0 AS v FROM low")
def resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 16 x 16 at 5 lines of 23: one way larger, the other smaller."""
    return stencil.resample(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v"), (16, 16), (5, 23)).select("frame", "y", "x", r6(F.col("v"), "v"))


_lines = ", ".join(f"({k}, {dx}, {dy})" for k, taps in enumerate(K.LINES_LOW) for dx, dy in taps)
_lines_high = ", ".join(f"({k}, {dx}, {dy})" for k, taps in enumerate(K.LINES_HIGH) for dx, dy in taps)
_line_sql = "WITH {g}, s AS (SELECT a.frame, a.y, a.x, t.k, sum(b.v) AS s FROM px a JOIN (VALUES {t}) t(k, dx, dy) ON true JOIN px b ON b.frame = a.frame AND b.y = a.y + t.dy AND b.x = a.x + t.dx GROUP BY 1, 2, 3, 4) SELECT frame, y, x, round(sum(s * s), 11) + 0.0 AS v FROM s GROUP BY 1, 2, 3"


def _line_query(spark: SparkSession, sf_dir: str, lines) -> DataFrame:
    return stencil.line_sums(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v"), lines).select("frame", "y", "x", r6(F.col("v"), "v", 11))


@query(_line_sql.format(g=GRAY, t=_lines))
def line_sums_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_query(spark, sf_dir, K.LINES_LOW)


@query(_line_sql.format(g=GRAY, t=_lines_high))
def line_sums_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_query(spark, sf_dir, K.LINES_HIGH)


@query(f"""WITH {GRAY}, n AS (
  SELECT a.frame, a.y, a.x, b.v FROM px a JOIN (VALUES {", ".join(f"({dx}, {dy})" for dx in (-3, 0, 3) for dy in (-3, 0, 3))}) t(dx, dy) ON true JOIN px b ON b.frame = a.frame AND b.y = a.y + t.dy AND b.x = a.x + t.dx
  UNION ALL SELECT frame, y, x, 2 * v FROM px UNION ALL SELECT frame, y, x, 2 * v FROM px
), l AS (SELECT frame, y, x, list_sort(list(v)) AS a FROM n GROUP BY 1, 2, 3) SELECT frame, y, x, round(a[1] * 0.45 + a[2] * 0.3 + a[3] * 0.25, 6) + 0.0 AS v FROM l""")
def fuzzy_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.erode(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v")).select("frame", "y", "x", r6(F.col("v"), "v"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, a, b, m1, m2, s11, s22, s12): both frames and their blurred products."""
    g = fixtures.gray(spark, sf_dir)
    long = g.select("frame", "y", "x", F.explode(F.array(*(F.struct(F.lit(n).alias("k"), e.alias("v")) for n, e in (("m1", F.col("v")), ("m2", F.col("d")), ("s11", F.col("v") * F.col("v")), ("s22", F.col("d") * F.col("d")), ("s12", F.col("v") * F.col("d")))))).alias("s")).select("frame", "y", "x", "s.k", "s.v")
    soft = stencil.gaussian(long, K.STRUCTURAL_SIGMA, K.STRUCTURAL_RADIUS, keys=("frame", "k"))
    wide = soft.groupBy("frame", "y", "x").agg(*(F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in ("m1", "m2", "s11", "s22", "s12")))
    return g.join(wide, ["frame", "y", "x"]).withColumnsRenamed({"v": "a", "d": "b"})


STATS = f"""WITH {GRAY}, {_blur_sql('pair', 'm1')}, {_blur_sql('pair', 'm2', 'd')}, {_blur_sql('pair', 's11', 'v * v')}, {_blur_sql('pair', 's22', 'd * d')}, {_blur_sql('pair', 's12', 'v * d')}, st AS (
  SELECT p.frame, p.y, p.x, p.v AS a, p.d AS b, m1.v AS m1, m2.v AS m2, s11.v AS s11, s22.v AS s22, s12.v AS s12 FROM pair p JOIN m1 USING (frame, y, x) JOIN m2 USING (frame, y, x) JOIN s11 USING (frame, y, x) JOIN s22 USING (frame, y, x) JOIN s12 USING (frame, y, x)
)"""


@query(STATS + " SELECT frame, y, x, round(greatest(1.0 - (1.0 - (m1 - m2) * (m1 - m2)) * (2.0 * (s12 - m1 * m2) + 0.0009) / ((s11 - m1 * m1) + (s22 - m2 * m2) + 0.0009), 0.0), 6) + 0.0 AS e FROM st")
def ssim_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(n) for n in ("m1", "m2", "s11", "s22", "s12")]
    return _stats(spark, sf_dir).select("frame", "y", "x", r6(pixel.structure_loss(*c), "e"))


@query(STATS + " SELECT frame, y, x, round(greatest((abs(b - m2) + 1.0) / (abs(a - m1) + 1.0) - 1.0, 0.0), 6) + 0.0 AS artifact, round(greatest(-((abs(b - m2) + 1.0) / (abs(a - m1) + 1.0) - 1.0), 0.0), 6) + 0.0 AS detail FROM st")
def edge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifact, detail = pixel.edge_change(F.col("a"), F.col("m1"), F.col("b"), F.col("m2"))
    return _stats(spark, sf_dir).select("frame", "y", "x", r6(artifact, "artifact"), r6(detail, "detail"))


_five = "(VALUES (-2, 0.05), (-1, 0.25), (0, 0.4), (1, 0.25), (2, 0.05)) t(k, w)"


@query(f"""WITH {GRAY}, v1 AS (SELECT frame, c AS y, x, sum(w * v) AS v FROM range(8) r(c), {_five}, px WHERE px.y = CASE WHEN 2 * c + k < 0 THEN -(2 * c + k) WHEN 2 * c + k > 15 THEN 30 - (2 * c + k) ELSE 2 * c + k END GROUP BY 1, 2, 3)
SELECT frame, CAST(y AS INTEGER) AS y, CAST(c AS INTEGER) AS x, round(sum(w * v), 11) + 0.0 AS v FROM range(8) r(c), {_five}, v1 WHERE v1.x = CASE WHEN 2 * c + k < 0 THEN -(2 * c + k) WHEN 2 * c + k > 15 THEN 30 - (2 * c + k) ELSE 2 * c + k END GROUP BY 1, 2, 3""")
def lpyr_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.reduce_level(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v"), 16, 16).select("frame", "y", "x", r6(F.col("v"), "v", 11))


# --- time -----------------------------------------------------------------------

def _taps_sql() -> str:
    """Nine taps at 30 frames a second, formed in SQL: channel c, tap k, weight w."""
    response = " UNION ALL ".join(f"SELECT {c} AS c, j, exp(-pow(j * 3.75, {P['beta_tf'][c]!r}) / {P['sigma_tf'][c]!r}) AS f FROM range(5) r(j)" for c in range(3))
    return f"""res AS ({response}), full_res AS (SELECT * FROM res UNION ALL SELECT 3, j, 1 - f FROM res WHERE c = 0
), taps AS (SELECT c, k, sum(CASE WHEN j = 0 THEN f ELSE 2 * f * cos(2 * pi() * j * ((k + 5) % 9) / 9) END) AS w FROM full_res, range(9) r(k) GROUP BY c, k)"""


@query(f"""WITH {_taps_sql()}, s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(value AS DOUBLE) AS v FROM events
), past AS MATERIALIZED (SELECT user_id, event_id, c, w, greatest(n - k, 0) AS n FROM s, taps WHERE c IN (0, 3))
SELECT user_id, p.event_id, round(sum(w * v) FILTER (c = 0), 6) + 0.0 AS sustained, round(sum(w * v) FILTER (c = 3), 6) + 0.0 AS transient FROM past p JOIN s USING (user_id, n) GROUP BY 1, 2""")
def temporal_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = temporal.kernels(30.0)
    s = fixtures.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").cast("double").alias("v"))
    found = temporal.filtered_series(s, "v", {"sustained": kernel[0], "transient": kernel[3]}, ("user_id",), ("ts", "event_id"))
    return found.select("user_id", "event_id", r6(F.col("sustained"), "sustained"), r6(F.col("transient"), "transient"))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, n - 1 AS ord, CAST(CASE WHEN n > 1 THEN 4 ELSE 3 END AS INTEGER) AS channels, CAST(CASE WHEN n = 1 THEN 0.577918291091919 ELSE 1.0 END AS DOUBLE) AS factor FROM s""")
def channel_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels and the still-image factor at a pair's first frame, four and none later."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return fixtures.table(spark, sf_dir, "events").select("user_id", (n - 1).cast("long").alias("ord"), F.when(n > 1, 4).otherwise(3).alias("channels"), F.when(n == 1, F.lit(P["image_int"])).otherwise(F.lit(1.0)).alias("factor"))


# --- decoding, slicing, lookups ---------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(l_partkey % 256 / 255.0), 6) + 0.0 AS u8, round(sum(l_partkey % 65536 / 65535.0), 6) + 0.0 AS u16 FROM lineitem GROUP BY 1, 2")
def sample_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    return fixtures.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), r6(F.sum(pixel.decode(k % 256, "uint8")), "u8"), r6(F.sum(pixel.decode(k % 65536, "uint16")), "u16"))


_yuv = [f"((r * 255 - 16.0) / 219.0 + (b * 255 - 128.0) / 224.0 * {2 * (1 - 0.2126)!r})", f"((r * 255 - 16.0) / 219.0 + (g * 255 - 128.0) / 224.0 * {2 * (1 - 0.0722)!r})"]
_colour_query(
    "yuv_to_rgb", ["r_", "g_", "b_"], lambda r, g, b: pixel.yuv_to_rgb(r * 255, g * 255, b * 255),
    [_yuv[0], f"((r * 255 - 16.0) / 219.0 - {_yuv[0]} * 0.2126 - {_yuv[1]} * 0.0722) / {1 - 0.2126 - 0.0722!r}", _yuv[1]],
)


# Videos made up of customers' keys: every pixel format, and metadata that is said, unspecified, null or unknown.
_said = lambda names: ["unspecified", None, *names, "other"]
_METADATA = {"matrix": (7, _said(formats.MATRICES)), "transfer": (11, _said(formats.TRANSFERS)), "primaries": (13, _said(formats.PRIMARIES)), "range": (17, [*_said(formats.RANGES)][:-1]), "location": (19, [*_said(formats.LOCATIONS)][:-1])}
_NAMES = [*formats.PIXEL_FORMATS, "nv12"]
_sql_list = lambda names: "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"
_known = lambda c, names: f"({c} IS NULL OR {c} = 'unspecified' OR {c} IN ({', '.join(repr(n) for n in names)}))"
_filled = lambda c, other: f"coalesce(nullif({c}, 'unspecified'), {other})"


@query(f"""WITH v AS (SELECT c_custkey AS id, {_sql_list(_NAMES)}[1 + c_custkey % {len(_NAMES)}] AS name, 320 + c_custkey % 1600 AS width, 240 + c_custkey % 900 AS height,
  {", ".join(f"{_sql_list(names)}[1 + (c_custkey // {step}) % {len(names)}] AS {c}_" for c, (step, names) in _METADATA.items())} FROM customer
), f AS (SELECT *, name LIKE '%rgb%' OR name IN ('argb', 'abgr', 'bgra') AS rgb, CASE WHEN name = 'nv12' THEN NULL WHEN name IN ('rgb48le', 'rgba64le') THEN 16 ELSE coalesce(CAST(nullif(regexp_extract(name, 'p([0-9]+)le', 1), '') AS INTEGER), 8) END AS depth,
  CASE WHEN name LIKE '%420%' OR name LIKE '%422%' THEN 1 WHEN name LIKE '%41%' THEN 2 ELSE 0 END AS sub_w, CASE WHEN name LIKE '%420%' OR name LIKE '%440%' THEN 1 WHEN name LIKE '%410%' THEN 2 ELSE 0 END AS sub_h FROM v)
SELECT id, CASE WHEN depth IS NULL THEN NULL WHEN rgb THEN 'rgb' ELSE 'yuv' END AS family, depth, CASE WHEN depth IS NOT NULL THEN sub_w END AS sub_w, CASE WHEN depth IS NOT NULL THEN sub_h END AS sub_h,
  {_filled("matrix_", "CASE WHEN rgb THEN 'rgb' WHEN height > 650 THEN 'bt709' ELSE 'bt470bg' END")} AS matrix,
  {_filled("transfer_", "CASE WHEN matrix_ = 'bt470bg' THEN 'gamma28' WHEN rgb THEN 'iec61966-2-1' ELSE 'bt709' END")} AS transfer, {_filled("primaries_", "CASE WHEN matrix_ = 'bt470bg' THEN 'bt470bg' ELSE 'bt709' END")} AS primaries,
  {_filled("location_", "'left'")} AS location, CASE WHEN range_ = 'pc' THEN true WHEN range_ = 'tv' THEN false WHEN depth IS NOT NULL THEN rgb OR name LIKE 'yuvj%' END AS full_range,
  CASE WHEN depth IS NULL THEN 'pixel format' {" ".join(f"WHEN NOT {_known(c + '_', [n for n in names if n not in (None, 'other')])} THEN '{c}'" for c, (_, names) in _METADATA.items())}
    WHEN width % (1 << sub_w) <> 0 OR height % (1 << sub_h) <> 0 THEN 'size' END AS problem FROM f""")
def video_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names, step=1: F.get(F.array(*map(F.lit, names)), (F.floor(k / step) % len(names)).cast("int"))
    videos = fixtures.table(spark, sf_dir, "customer").select(
        k.alias("id"), pick(_NAMES).alias("pixel_format"), (k % 1600 + 320).alias("width"), (k % 900 + 240).alias("height"), *(pick(names, step).alias(c) for c, (step, names) in _METADATA.items())
    )
    return formats.described(videos).select("id", "family", "depth", "sub_w", "sub_h", "matrix", "transfer", "primaries", "location", "full_range", "problem")


@query("SELECT event_id AS frame_idx, (event_id - 50) // 3 AS position FROM events WHERE event_id >= 50 AND event_id < 900 AND (event_id - 50) % 3 = 0")
def clip_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.clip_slice(fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_idx")), 50, 900, 3)


@query(f"WITH {NORMS}, f AS (SELECT DISTINCT event_id // 256 AS frame_idx FROM events) SELECT frame_idx, round(norm_3, 6) + 0.0 AS norm_3 FROM f LEFT JOIN (SELECT frame + 2 AS frame_idx, norm_3 FROM n WHERE frame + 2 IN (SELECT frame_idx FROM f)) USING (frame_idx)")
def frame_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fixtures.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 256).alias("frame_idx")).distinct()
    scores = _frame_norms(spark, sf_dir).withColumnRenamed("frame", "ord")
    pairs = scores.select("ord", F.col("ord").alias("src_frame"), (F.col("ord") + 2).alias("enc_frame"))
    return sampling.with_properties(frames, pairs, scores, ["norm_3"]).select("frame_idx", r6(F.col("norm_3"), "norm_3"))


# A small made-up table: log10 axes of 4 backgrounds and 5 frequencies.
_LB, _LF = [-2.0, 0.0, 1.5, 3.0], [-1.0, -0.25, 0.5, 1.0, 1.75]
_TABLE = [[0.5 + 0.3 * i - 0.2 * (j - 1.5) ** 2 for j in range(5)] for i in range(4)]


def _place_sql(v: str, axis: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {v} BETWEEN {a!r} AND {b!r} THEN ({v} - {a!r}) / {b - a!r} + {i}" for i, (a, b) in enumerate(zip(axis, axis[1:], strict=False))) + " ELSE 0.0 END"


_SENSITIVITY = f""", lb AS (SELECT frame, y, x, v, d, v * 8 - 3 AS b, d * 4 - 1.5 AS f FROM pair), pl AS (
  SELECT *, {_place_sql('f', _LF)} AS px_, {_place_sql('b', _LB)} AS py_ FROM lb
), t AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS i, unnest([{", ".join(repr(v) for row in _TABLE for v in row)}]) AS s), s AS (
  SELECT p.*, (a.s * (1 - (px_ - floor(px_))) + b.s * (px_ - floor(px_))) * (1 - (py_ - floor(py_))) + (c.s * (1 - (px_ - floor(px_))) + e.s * (px_ - floor(px_))) * (py_ - floor(py_)) AS logs
  FROM pl p JOIN t a ON a.i = floor(py_) * 5 + floor(px_) JOIN t b ON b.i = floor(py_) * 5 + least(floor(px_) + 1, 4) JOIN t c ON c.i = least(floor(py_) + 1, 3) * 5 + floor(px_) JOIN t e ON e.i = least(floor(py_) + 1, 3) * 5 + least(floor(px_) + 1, 4)
)"""


@query(f"WITH {GRAY}{_SENSITIVITY} SELECT frame, y, x, round(px_, 6) + 0.0 AS place, round(pow(10.0, logs + {P['sensitivity_correction'] / 20!r}) * 1.45, 6) + 0.0 AS s, round(abs(v - d) * pow(10.0, logs + {P['sensitivity_correction'] / 20!r}) * 1.45, 6) + 0.0 AS base FROM s")
def csf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval lookup on two axes, bilinear sensitivity, base-band difference."""
    g = fixtures.gray(spark, sf_dir)
    b, f = F.col("v") * 8 - 3, F.col("d") * 4 - 1.5
    s = pixel.sensitivity(b, f, _LB, _LF, _TABLE, K.CHANNEL_GAIN[1])
    return g.select("frame", "y", "x", r6(pixel.interval_place(f, _LF), "place"), r6(s, "s"), r6(pixel.base_difference(F.col("v"), F.col("d"), s), "base"))


def _clamped_sql() -> str:
    raw = [math.exp(-(j * j) / 18.0) for j in range(-6, 7)]
    taps = ", ".join(f"({j}, {w / sum(raw)!r})" for j, w in zip(range(-6, 7), raw, strict=True))
    one = lambda src, out, axis, other: f"{out} AS (SELECT a.frame, a.y, a.x, sum(b.v * t.w) AS v FROM {src} a JOIN (VALUES {taps}) t(j, w) ON true JOIN {src} b ON b.frame = a.frame AND b.{other} = a.{other} AND b.{axis} = least(greatest(a.{axis} + t.j, 0), 15) GROUP BY 1, 2, 3)"
    return f"{one('px', 'c1', 'x', 'y')}, {one('c1', 'c2', 'y', 'x')}"


@query(f"WITH {GRAY}, {_clamped_sql()} SELECT frame, y, x, round(v * {10.0 ** P['mask_c']!r}, 6) + 0.0 AS v FROM c2")
def phase_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = stencil.clamped_blur(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v"), P["pu_dilate"])
    return soft.select("frame", "y", "x", r6(F.col("v") * 10.0 ** P["mask_c"], "v"))


@query(f"""WITH {GRAY}, v1 AS (SELECT frame, o AS y, x, sum(2 * w * v) AS v FROM range(32) r(o), {_five}, px WHERE (o - k) % 2 = 0 AND px.y = least(greatest((o - k) // 2, 0), 15) GROUP BY 1, 2, 3)
SELECT frame, CAST(y AS INTEGER) AS y, CAST(o AS INTEGER) AS x, round(sum(2 * w * v), 11) + 0.0 AS v FROM range(32) r(o), {_five}, v1 WHERE (o - k) % 2 = 0 AND v1.x = least(greatest((o - k) // 2, 0), 15) GROUP BY 1, 2, 3""")
def lpyr_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.expand_level(fixtures.gray(spark, sf_dir).select("frame", "y", "x", "v"), 32, 32).select("frame", "y", "x", r6(F.col("v"), "v", 11))


@query("""WITH s AS (SELECT c_custkey AS id, 16 + c_custkey % 3825 AS w, 16 + c_custkey % 2145 AS h, 10.0 + c_custkey % 70 AS ppd FROM customer
), n AS (SELECT *, greatest(1, CAST(floor(log2(least(w, h))) AS BIGINT) - 1) AS bands FROM s)
SELECT id, i AS band, greatest(1, w >> i) AS width, greatest(1, h >> i) AS height, round(CASE WHEN i = bands - 1 THEN 0.1 WHEN i = 0 THEN ppd / 2 ELSE 0.3228 * pow(2.0, -(i - 1)) * ppd / 2 END, 9) + 0.0 AS frequency
FROM n, unnest(range(bands)) AS r(i)""")
def band_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of screens whose sizes and sharpness come from customers' keys."""
    k = F.col("c_custkey")
    screens = fixtures.table(spark, sf_dir, "customer").select(k.alias("id"), (k % 3825 + 16).alias("w"), (k % 2145 + 16).alias("h"), (k % 70 + 10.0).alias("ppd"))
    found = screens.select("id", F.explode(pixel.bands_of(F.col("w"), F.col("h"), F.col("ppd"))).alias("b"))
    return found.select("id", "b.band", "b.width", "b.height", r6(F.col("b.frequency"), "frequency", 9))


# --- files and streams ----------------------------------------------------------


def _clip_sql(top: int, lines: int = 16, where: str = "true") -> str:
    """Sums of the samples of clips' planes; samples are single-precision values, rounded to whole units."""
    stored = lambda e: f"CAST(round_even(CAST(CAST({e} AS FLOAT) AS DOUBLE) * {top}, 0) AS BIGINT)"
    planes = " UNION ALL ".join(f"SELECT frame, {k} AS plane, y, x, {stored(e)} AS u FROM pair" for k, e in enumerate(("v", "1.0 - v", "d")))
    return f"""WITH {GRAY}, pl AS ({planes}) SELECT printf('clip%06d', frame // 8) AS video_id, frame % 8 AS frame_idx, CAST(plane AS INTEGER) AS plane, CAST(sum(u) AS BIGINT) AS total, CAST(sum(u * (y * 16 + x + 1)) AS BIGINT) AS moment
  FROM pl WHERE y < {lines} AND {where} GROUP BY 1, 2, 3"""


@query(_clip_sql(65535, 13, "frame % 8 BETWEEN 2 AND 5"))
def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_queries.raw_frames(spark, sf_dir)


@query(_clip_sql(255))
def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_queries.packed_frames(spark, sf_dir)


@query("""WITH f AS (SELECT DISTINCT event_id // 256 AS frame FROM events WHERE event_id // 256 < (SELECT count(*) FROM events) // 256)
SELECT printf('clip%06d', frame // 8) AS video_id, 16 AS width, 16 AS height, CAST(25.0 AS DOUBLE) AS fps, count(*) AS frames, CAST((SELECT count(DISTINCT frame // 8) FROM f) AS INTEGER) AS clips FROM f GROUP BY frame // 8""")
def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_queries.clip_index(spark, sf_dir)


@query(f"""WITH {GRAY}, u AS (SELECT frame, y, x, round_even(CAST(CAST(v AS FLOAT) AS DOUBLE) * 255, 0) AS u FROM px), f AS (SELECT count(DISTINCT frame) AS n, (count(DISTINCT frame) - 1) // 8 * 8 AS base FROM u
), e AS (
  SELECT a.frame AS src, b.frame - base AS enc, abs(a.u - b.u) AS e FROM f, u a JOIN u b ON b.frame - base = a.frame + least(2, n - base - 1) AND a.y = b.y AND a.x = b.x WHERE a.frame < 8)
SELECT CAST(src AS INTEGER) AS ord, src AS src_frame, enc AS enc_frame, round(sqrt(avg(e * e)), 6) + 0.0 AS norm_q, round(pow(avg(e * e * e), 1.0 / 3), 6) + 0.0 AS norm_3, round(max(e), 6) + 0.0 AS norm_inf FROM e GROUP BY src, enc""")
def clip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both frames of a pair come from one task of the pair reader."""
    found = file_queries.clip_pairs(spark, sf_dir)
    return found.select("ord", "src_frame", "enc_frame", *(r6(F.col(c), c) for c in ("norm_q", "norm_3", "norm_inf")))


@query(f"WITH {NORMS} SELECT CAST(frame AS INTEGER) AS ord, round(norm_q, 6) + 0.0 AS norm_q, round(norm_3, 6) + 0.0 AS norm_3, round(norm_inf, 6) + 0.0 AS norm_inf FROM n")
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's norms written as one JSON array in parallel parts, and read back."""
    values = _frame_norms(spark, sf_dir).withColumn("ord", F.col("frame").cast("int"))
    return file_queries.score_files(spark, sf_dir, values).select("ord", *(r6(F.col(c), c) for c in ("norm_q", "norm_3", "norm_inf")))


@query("""WITH s AS (SELECT event_id AS ord, CAST(round(value * 100) AS BIGINT) AS score FROM events)
SELECT -1 AS batch, CAST(count(*) AS VARCHAR) AS value FROM s UNION ALL SELECT 0, ord || ' ' || score FROM s""")
def live_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's scores through the live sink."""
    e = fixtures.table(spark, sf_dir, "events")
    return file_queries.live_file(spark, e.select(F.col("event_id").alias("ord"), F.round(F.col("value") * 100).cast("long").alias("score"))).select(F.col("batch").cast("int").alias("batch"), "value")


def _stream_sql() -> str:
    """Nine taps at 30 frames a second, formed here; the first frame stands before itself."""
    return f"""WITH {PLANES}, {_taps_sql()}, s AS (SELECT vec // 24 AS pair_id, (vec % 24) // 3 AS ord, vec % 3 AS c, y * 8 + x AS i, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM pl WHERE vec // 24 < (SELECT count(DISTINCT vec) FROM pl) // 24)
SELECT n.pair_id, n.ord, CAST(t.c AS INTEGER) AS channel, round(sum(t.w * o.v), 5) + 0.0 AS total, round(sum(t.w * o.v * (o.i + 1)), 4) + 0.0 AS moment
FROM (SELECT DISTINCT pair_id, ord FROM s) n, taps t JOIN s o ON o.pair_id = n.pair_id AND o.ord = greatest(n.ord - t.k, 0) AND o.c = t.c % 3 WHERE n.ord > 0 OR t.c < 3 GROUP BY ALL"""


@query(_stream_sql())
def streamed_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of eight frames of three planes through the stateful stream, in the kernels' four channels."""
    px = fixtures.planes8(spark, sf_dir)
    whole = F.floor(px.agg(F.countDistinct("vec").alias("n")).select("n").scalar() / 24)
    planes = px.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select("vec", F.transform("p", lambda s: s["v"].cast("float")).alias("p"))  # 64 pixels a plane
    three = planes.groupBy(F.floor(F.col("vec") / 24).alias("pair_id"), F.floor(F.pmod("vec", F.lit(24)) / 3).cast("int").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("vec", "p"))).alias("q")).where(F.col("pair_id") < whole)
    series = three.select("pair_id", F.lit(0).alias("strip"), "ord", F.lit(8).alias("frames"), F.transform("q", lambda s: s["p"]).alias("planes"))
    found = file_queries.planes_through_a_stream(spark, series, temporal.kernels(30.0)).select("pair_id", "ord", F.posexplode("filtered").alias("channel", "p"))
    moment = F.aggregate(F.transform("p", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("pair_id", "ord", "channel", r6(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), "total", 5), r6(moment, "moment", 4))


# --- whole metrics ----------------------------------------------------------------


@query(metric_sql.structural(COLOUR))
def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural_score(fixtures.colour_pairs(spark, sf_dir)).withColumn("score", r6(F.col("score"), "score"))


@query(metric_sql.psychovisual(COLOUR))
def psychovisual(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = psychovisual_distance(fixtures.colour_pairs(spark, sf_dir))
    return found.select("pair_id", "ord", *(r6(F.col(c), c) for c in ("norm_q", "norm_3", "norm_inf")))


@query(metric_sql.display(COLOUR, Display(ambient=250.0), fixtures.MADE_UP))
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a made-up sensitivity table: the values are not calibrated."""
    found = display_difference(fixtures.colour_pairs(spark, sf_dir), Display(ambient=250.0), fixtures.made_up_sensitivity())
    return found.withColumn("score", r6(F.col("score"), "score", 4))


#: Another set of parameters: seven taps, a narrower mask, a hard bound, other weights.
OTHER_PARAMETERS = P | {
    "filter_len": 7, "pu_dilate": 2, "dclamp_type": "hard", "d_max": 1.1, "mask_p": 2.0, "mask_c": -0.5, "mask_q": (1.4, 2.5, 3.1, 3.0), "beta": 2.5, "beta_tch": 3.0, "beta_sch": 3.5, "sensitivity_correction": 1.25,
    "jod_a": 0.05, "jod_exp": 0.9, "image_int": 0.6, "ch_chrom_w": 0.8, "ch_trans_w": 0.7, "sigma_tf": (6.0, 14.0, 7.0, 0.2), "beta_tf": (1.3, 1.1, 0.9, 0.2), "baseband_weight": (0.01, 1.5, 4.0, 20.0),
}


@query(metric_sql.display(COLOUR, Display(ambient=250.0), fixtures.MADE_UP, p=OTHER_PARAMETERS))
def display_other_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display metric with parameters that a caller gives."""
    found = display_difference(fixtures.colour_pairs(spark, sf_dir), Display(ambient=250.0), fixtures.made_up_sensitivity(), parameters=OTHER_PARAMETERS)
    return found.withColumn("score", r6(F.col("score"), "score", 4))


@query(metric_sql.display(COLOUR, Display(ambient=250.0), fixtures.MADE_UP, bands=True))
def display_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every band and channel adds, and the spread of its differences."""
    from ..operators.visibility import band_scores, contrast_bands

    found = band_scores(contrast_bands(fixtures.colour_pairs(spark, sf_dir), Display(ambient=250.0), fixtures.made_up_sensitivity()))
    return found.select("pair_id", "ord", "band", "ch", *(r6(F.col(c), c, 4) for c in ("q", "minimum", "maximum", "mean")), "pixels")


@query(f"""SELECT pair_id, ord, score AS jod, round({Display(ambient=250.0).ppd!r}, 6) + 0.0 AS ppd, 'default' AS display, band, ch, q, minimum, maximum, mean, pixels, round(CASE WHEN band = 0 THEN {Display(ambient=250.0).ppd / 2!r} ELSE 0.1 END, 6) + 0.0 AS rho
FROM ({metric_sql.display(COLOUR, Display(ambient=250.0), fixtures.MADE_UP)}) JOIN ({metric_sql.display(COLOUR, Display(ambient=250.0), fixtures.MADE_UP, bands=True)}) USING (pair_id, ord)""")
def display_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the telemetry documents hold, read back from their JSON."""
    from ..operators.visibility import band_scores, contrast_bands
    from ..sources.scores import TELEMETRY, telemetry

    pairs, shown, table = fixtures.colour_pairs(spark, sf_dir), Display(ambient=250.0), fixtures.made_up_sensitivity()
    found = telemetry(display_difference(pairs, shown, table), band_scores(contrast_bands(pairs, shown, table)), shown.ppd, shown.name)
    parsed = found.select("pair_id", F.from_json("json", TELEMETRY).alias("j")).select("pair_id", "j.*").withColumn("b", F.explode("bands"))
    flat = parsed.select("pair_id", F.col("frame").alias("ord"), "jod", "ppd", "display", "b.band", "b.rho", "b.pixels", F.explode("b.channels").alias("c")).select("*", "c.*")
    return flat.select("pair_id", "ord", r6(F.col("jod"), "jod", 4), r6(F.col("ppd"), "ppd"), "display", "band", "ch", *(r6(F.col(c), c, 4) for c in ("q", "minimum", "maximum", "mean")), "pixels", r6(F.col("rho"), "rho"))


# Frames of 48 x 48, where the widest blur, all six scales and tiles with their halos come into play.
_SIDE = fixtures.LARGE
BIG = f"""big AS (
  SELECT event_id // {_SIDE * _SIDE} AS vec, CAST((event_id % {_SIDE * _SIDE}) // {_SIDE} AS INTEGER) AS y, CAST(event_id % {_SIDE} AS INTEGER) AS x, least(CAST(value AS DOUBLE), 500.0) / 500 AS v FROM events
), rgb AS (
  SELECT vec // 3 AS frame, y, x, max(v) FILTER (vec % 3 = 0) AS r, max(v) FILTER (vec % 3 = 1) AS g, max(v) FILTER (vec % 3 = 2) AS b
  FROM big WHERE vec // 3 < (SELECT count(*) FROM events) // {3 * _SIDE * _SIDE} GROUP BY 1, 2, 3
)"""


@query(metric_sql.structural(BIG))
def structural_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural_score(fixtures.large_pairs(spark, sf_dir), tile=32).withColumn("score", r6(F.col("score"), "score"))


@query(metric_sql.psychovisual(BIG))
def psychovisual_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = psychovisual_distance(fixtures.large_pairs(spark, sf_dir), tile=16)
    return found.select("pair_id", "ord", *(r6(F.col(c), c) for c in ("norm_q", "norm_3", "norm_inf")))
