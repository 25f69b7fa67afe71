import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquill.errors import DifferingInputs
from pixelquill.operators import psychovisual, visibility
from pixelquill.operators.structural import structural_score, weights
from pixelquill.plans.fixtures import made_up_sensitivity
from pixelquill.sources.config import Display

SHAPE = "pair_id string, ord int, a_width int, a_height int, a_planes array<array<float>>, b_width int, b_height int, b_planes array<array<float>>"


def pairs(spark, frames, parts=2):
    """frames: (a, b) arrays of (3, h, w)."""
    rows = [("p", k, a.shape[2], a.shape[1], [p.ravel().tolist() for p in a], b.shape[2], b.shape[1], [p.ravel().tolist() for p in b]) for k, (a, b) in enumerate(frames)]
    return spark.createDataFrame(rows, SHAPE).repartition(parts)


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(3)
    smooth = lambda: np.clip(np.add.accumulate(rng.normal(0, 0.05, (3, 19, 23)), axis=2) + 0.5, 0, 1)
    base = [smooth() for _ in range(5)]
    return base, [np.floor(f * 16) / 16 for f in base], [np.floor(f * 4) / 4 for f in base]


def scores(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("ord").collect()]


def test_identical_frames(spark, frames):
    same = pairs(spark, [(f, f) for f in frames[0]])
    assert scores(structural_score(same), "score") == [(100.0,)] * 5
    assert np.allclose(scores(psychovisual.psychovisual_distance(same), "norm_q", "norm_3", "norm_inf"), 0)
    assert np.allclose(scores(visibility.display_difference(same, Display(), made_up_sensitivity()), "score"), 10)


def test_coarser_frames_are_worse_and_partitions_do_not_matter(spark, frames):
    fine, coarse = ([(a, b) for a, b in zip(frames[0], other, strict=True)] for other in frames[1:])
    for metric, name, sign in (
        (structural_score, "score", 1), (psychovisual.psychovisual_distance, "norm_3", -1), (lambda p: visibility.display_difference(p, Display(), made_up_sensitivity()), "score", 1)
    ):
        a, b = (np.array(scores(metric(pairs(spark, f)), name)) for f in (fine, coarse))
        assert (sign * (a - b) > 0).all()
        assert np.allclose(np.array(scores(metric(pairs(spark, fine, 5)), name)), a, atol=1e-12)


def test_norms_are_those_of_the_map(spark, frames):
    p = pairs(spark, [(frames[0][0], frames[2][0])])
    data = np.array(psychovisual.distortion_maps(p).collect()[0].data)
    r = psychovisual.psychovisual_distance(p, q=5.0).collect()[0]
    assert len(data) == 19 * 23 and np.allclose([r.norm_q, r.norm_3, r.norm_inf], [(data**5).mean() ** 0.2, (data**3).mean() ** (1 / 3), data.max()])


def test_weights_table(spark):
    w = weights(spark)
    assert w.count() == 108 and w.agg(F.sum("weight")).collect()[0][0] == pytest.approx(1080.9, abs=1000)
    assert w.where("plane = 1 AND scale = 0 AND kind = 'norm4' AND map = 'structure'").collect()[0].weight == 7.466890328078848


def test_temporal_filter_in_chunks_equals_one_pass(spark, frames):
    rng = np.random.default_rng(0)
    many = [(frames[0][k % 5], np.clip(frames[0][k % 5] + rng.normal(0, 0.02, (3, 19, 23)), 0, 1)) for k in range(20)]
    p = pairs(spark, many)
    one, small, strips = (np.array(scores(visibility.display_difference(p, Display(), made_up_sensitivity(), chunk=c, strip=s), "score")) for c, s in ((64, 1 << 16), (3, 1 << 16), (7, 50)))
    assert np.allclose(one, small, atol=1e-12) and np.allclose(one, strips, atol=1e-12) and len(one) == 20


def test_first_frame_is_filtered_against_itself():
    from pixelquill.operators.temporal import kernels

    k = kernels(30.0)
    x = np.random.default_rng(1).random((3, 4, 5))
    out = visibility._fir([x] * 9, k)
    assert np.allclose(out[:3], 9 * x) and np.allclose(out[3], 0, atol=1e-9)


def test_planes_of_wrong_size(spark, frames):
    bad = pairs(spark, [(frames[0][0], frames[0][1])]).withColumn("a_width", F.lit(20))
    with pytest.raises(Exception, match=DifferingInputs.__name__):
        structural_score(bad).collect()


@pytest.mark.parametrize("size", [(150, 203), (64, 64), (33, 129), (7, 300)])
def test_tiles_give_what_whole_frames_give(size):
    """Odd sizes, tiles that end inside the frame, and halos that reach over several tiles."""
    from pixelquill.operators import structural

    rng = np.random.default_rng(5)
    a = np.clip(np.add.accumulate(rng.normal(0, 0.05, (3, *size)), axis=2) + 0.5, 0, 1).astype(np.float32)
    b = (np.floor(a * 12) / 12).astype(np.float32)
    whole, tiled = structural.pooled_maps(a, b, 1024), structural.pooled_maps(a, b, 32)
    assert whole.keys() == tiled.keys() and all(np.allclose(whole[k], tiled[k], rtol=1e-9) for k in whole)
    maps = []
    for tile in (512, 48):
        d = np.full(size, np.nan)
        for rows, columns, part in psychovisual.map_tiles(a, b, 203.0, tile):
            d[rows, columns] = part
        maps.append(d)
    assert np.allclose(maps[0], maps[1], rtol=1e-9, atol=1e-9) and maps[0].max() > 0.1


def test_memory_of_tiles_does_not_grow_with_the_frame():
    import tracemalloc

    from pixelquill.operators import structural

    peaks = []
    for n in (768, 1024):
        a = np.random.default_rng(1).random((3, n, n), dtype=np.float32)
        b = np.floor(a * 12) / 12
        for run in (lambda: structural.pooled_maps(a, b, 256), lambda: [p.max() for *_, p in psychovisual.map_tiles(a, b, 203.0, 256)]):  # noqa: B023
            tracemalloc.start()
            run()
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[2] < 1.2 * peaks[0] and peaks[3] < 1.2 * peaks[1], peaks
