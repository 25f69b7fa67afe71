import numpy as np
import pytest

from pixelquill.functions import constants as K
from pixelquill.functions import planes as P
from pixelquill.operators import stencil, temporal

rng = np.random.default_rng(7)
SIZES = [(1, 1), (1, 7), (7, 1), (2, 3), (5, 5), (19, 23), (70, 66)]


@pytest.mark.parametrize("size", SIZES)
def test_blur_keeps_constants_and_equals_the_direct_sum(size):
    assert np.allclose(P.blur(np.full(size, 3.0), 1.5, 8), 3.0)
    p = rng.random(size)
    h, w = size
    want = np.zeros(size)
    for y in range(h):
        for x in range(w):
            ys, xs = np.mgrid[max(0, y - 8) : min(h, y + 9), max(0, x - 8) : min(w, x + 9)]
            k = np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * 1.5**2))
            want[y, x] = (k * p[ys, xs]).sum() / k.sum()
    assert np.allclose(P.blur(p, 1.5, 8), want)


@pytest.mark.parametrize("size", SIZES)
def test_halving_lines_and_erosion_at_borders(size):
    p = rng.random(size) - 0.5
    h, w = size
    at = lambda y, x: p[min(y, h - 1), min(x, w - 1)]
    want = np.array([[np.mean([at(2 * y + a, 2 * x + b) for a in (0, 1) for b in (0, 1)]) for x in range((w + 1) // 2)] for y in range((h + 1) // 2)])
    assert np.allclose(P.halve(p), want)
    if h * w <= 500:
        inside = lambda y, x: p[y, x] if 0 <= y < h and 0 <= x < w else 0.0
        lines = np.array([[sum(sum(inside(y + dy, x + dx) for dx, dy in t) ** 2 for t in K.LINES_HIGH) for x in range(w)] for y in range(h)])
        assert np.allclose(P.line_sums(p, K.LINES_HIGH), lines)
        q = np.abs(p)
        least = np.array([[np.dot([0.45, 0.3, 0.25], sorted([q[y, x], 2 * q[y, x], 2 * q[y, x]] + [q[y + a, x + b] for a in (-3, 0, 3) for b in (-3, 0, 3) if (a or b) and 0 <= y + a < h and 0 <= x + b < w])[:3]) for x in range(w)] for y in range(h)])
        assert np.allclose(P.erode(q), least)


def test_line_patterns():
    assert len(K.LINES_HIGH) == len(K.LINES_LOW) == 16
    for lines in (K.LINES_HIGH, K.LINES_LOW):
        assert all((0, 0) in t and max(max(abs(a), abs(b)) for a, b in t) <= 4 for t in lines)


@pytest.mark.parametrize("size", [(2, 2), (8, 8), (17, 32)])
def test_pyramid(size):
    p = rng.random(size)
    c = np.full(size, 2.0)
    assert np.allclose(P.reduce_plane(c), 2.0) and P.reduce_plane(c).shape == (max(1, size[0] // 2), max(1, size[1] // 2))
    assert np.allclose(P.expand_plane(np.full((max(1, size[0] // 2), max(1, size[1] // 2)), 2.0), size), 2.0)
    diff, levels = P.pyramid(p, 2)
    assert np.allclose(diff[0] + P.expand_plane(levels[1], size), p) and diff[1] is levels[1]


def test_band_geometry():
    sizes = P.band_sizes(1920, 1080, 60.0)
    assert len(sizes) == 9 and sizes[0] == (1920, 1080, 30.0) and sizes[1][2] == pytest.approx(0.3228 * 30) and sizes[-1][2] == 0.1
    assert len(P.band_sizes(3, 3, 60.0)) == 1


def test_lookup_outside_the_axis_is_zero():
    axis = np.array([0.0, 1.0, 3.0])
    assert P.interpolate_index(axis, [-1, 0, 0.5, 1, 2, 3, 9]).tolist() == [0, 0, 0.5, 1, 1.5, 2, 0]
    assert P.bilinear(np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([0.5, 9]), np.array([0.5, 9])).tolist() == [1.5, 3.0]


def test_temporal_kernels():
    assert [temporal.filter_length(f) for f in (30, 24, 60, 0, 1)] == [9, 7, 17, 9, 3] and temporal.filter_length(30, 4) == 5 and temporal.filter_length(30, 1) == 3
    k = temporal.kernels(30.0)
    assert k.shape == (4, 9) and np.allclose(k.sum(axis=1), [9, 9, 9, 0], atol=1e-9) and np.allclose(k, k[:, ::-1])


def rows(spark, p):
    return spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(p)], "frame int, y int, x int, v double")


def plane(df, size):
    out = np.full(size, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("size", [(1, 1), (1, 7), (5, 9), (11, 6)])
def test_relational_twins(spark, size):
    p = rng.random(size)
    df = rows(spark, p).cache()
    assert np.allclose(plane(stencil.gaussian(df, 1.2, 8), size), P.blur(p, 1.2, 8))
    assert np.allclose(plane(stencil.halve(df), ((size[0] + 1) // 2, (size[1] + 1) // 2)), P.halve(p))
    assert np.allclose(plane(stencil.line_sums(df, K.LINES_LOW), size), P.line_sums(p, K.LINES_LOW))
    assert np.allclose(plane(stencil.erode(df), size), P.erode(p))
    if min(size) > 1:
        assert np.allclose(plane(stencil.reduce_level(df, *size), (size[0] // 2, size[1] // 2)), P.reduce_plane(p))
    assert np.allclose(plane(stencil.add_supersampled(df, stencil.halve(df)), size), p * 0.85 + 0.5 * P.halve(p).repeat(2, 0).repeat(2, 1)[: size[0], : size[1]])


def test_band_geometry_as_columns(spark):
    from pyspark.sql import functions as F

    from pixelquill.functions import pixel
    from pixelquill.functions.planes import band_sizes

    sizes = [(1, 1), (3, 1), (5, 4), (8, 8), (16, 9), (1023, 777), (1920, 1080), (3840, 2160)]
    rows = spark.createDataFrame([(w, h) for w, h in sizes], "w int, h int").select("w", "h", pixel.bands_of(F.col("w"), F.col("h"), F.lit(57.0)).alias("b")).collect()
    assert [[(b.width, b.height) for b in r.b] for r in rows] == [[(w, h) for w, h, _ in band_sizes(r.w, r.h, 57.0)] for r in rows]
    assert all(np.allclose([b.frequency for b in r.b], [f for *_, f in band_sizes(r.w, r.h, 57.0)]) and [b.band for b in r.b] == list(range(len(r.b))) for r in rows)


def test_resampled_rows_equal_the_plane(spark):
    from pixelquill.functions.planes import resample
    from pixelquill.operators import stencil

    plane = np.random.default_rng(0).random((9, 13))
    px = spark.createDataFrame([(0, y, x, float(plane[y, x])) for y in range(9) for x in range(13)], "frame int, y int, x int, v double")
    for want in ((4, 20), (18, 5), (9, 13)):
        got = np.zeros(want)
        for r in stencil.resample(px, (9, 13), want).collect():
            got[r.y, r.x] = r.v
        assert np.allclose(got, resample(plane, want))


def test_long_series_are_filtered_in_chunks(spark):
    """A key of most rows is dealt over many groups and gives what one window gives."""
    from pyspark.sql import functions as F

    taps = temporal.kernels(30.0)
    rows = spark.range(3000).selectExpr("IF(id % 10 = 0, id % 3, 7) AS k", "(id * 1301) % 3000 AS t", "sin(id) AS v", "CAST(id AS string) AS other")
    got = temporal.filtered_series(rows, "v", {"a": taps[0], "b": taps[3]}, ("k",), ("t",), chunk=50)
    want = rows.select("*", temporal.fir(F.col("v"), taps[0], ["k"], ["t"]).alias("wa"), temporal.fir(F.col("v"), taps[3], ["k"], ["t"]).alias("wb"))
    both = got.join(want, ["k", "t", "v", "other"])
    assert got.count() == 3000 and both.where("abs(a - wa) < 1e-9 AND abs(b - wb) < 1e-9").count() == 3000


def test_neighbourhoods_of_pixel_rows_over_tiles(spark):
    """Frames of one tile and of several, joined without broadcasts, where places outside a frame have fewer than three values."""
    frames = {1: rng.random((16, 16)), 2: rng.random((75, 130)), 3: rng.random((2, 1))}
    rows = [(f, y, x, float(p[y, x])) for f, p in frames.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    pixels = spark.createDataFrame(rows, "frame int, y int, x int, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [{(r.frame, r.y, r.x): r.v for r in q.collect()} for q in (stencil.erode(pixels), stencil.line_sums(pixels, K.LINES_HIGH), stencil.line_sums(pixels, K.LINES_LOW))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for got, plane in zip(found, (P.erode, lambda p: P.line_sums(p, K.LINES_HIGH), lambda p: P.line_sums(p, K.LINES_LOW)), strict=True):
        assert len(got) == len(rows)
        for f, p in frames.items():
            want = plane(p)
            assert all(abs(got[f, y, x] - want[y, x]) < 1e-9 for y in range(p.shape[0]) for x in range(p.shape[1]))


def test_neighbourhoods_without_gaps_filled(spark):
    """Missing pixels count as outside."""
    pixels = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 3, 0.25), (0, 3, 0, 0.5)], "frame int, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in stencil.erode(pixels).collect()}
    assert got[0, 0] == pytest.approx(0.45 * 0.25 + 0.3 * 0.5 + 0.25 * 1.0)
    with pytest.raises(ValueError, match="offsets"):
        stencil.erode(pixels, step=9)
