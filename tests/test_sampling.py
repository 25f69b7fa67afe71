import pytest

from pixelquill.errors import SamplingError
from pixelquill.operators import sampling as S


def test_ranges_are_clamped_to_both_videos():
    assert S.resolve(100, 100) == S.Span(0, 100, 1, 0)
    assert S.resolve(100, 100, start=-5, end=1000, every=3) == S.Span(0, 100, 3, 0)
    assert S.resolve(100, 5, offset=2) == S.Span(0, 3, 1, 2)
    assert S.resolve(100, 100, offset=-4) == S.Span(4, 100, 1, -4)
    assert S.resolve(10, 10, start=8, end=3) == S.Span(8, 8, 1, 0)
    with pytest.raises(SamplingError):
        S.resolve(10, 5, offset=20)
    with pytest.raises(SamplingError):
        S.resolve(10, 10, every=0)


def test_lists(spark):
    assert S.index_list(" 1, 2 ,30") == [1, 2, 30] and S.index_list("") == [] and S.index_list(None) == []
    with pytest.raises(SamplingError):
        S.index_list("1,x")
    span = S.resolve(20, 20, start=2, every=2, offset=1)
    got = S.pair_by_lists(spark, span, 20, 20, [3, 0, 3]).orderBy("ord").collect()
    assert [(r.src_frame, r.enc_frame) for r in got] == [(8, 9), (2, 3), (8, 9)]
    got = S.pair_by_lists(spark, span, 20, 20, [1, 2], [4, 5]).orderBy("ord").collect()
    assert [(r.src_frame, r.enc_frame) for r in got] == [(4, 11), (6, 13)]
    for bad in (([50], None), ([1], [1, 2]), ([1], [60])):
        with pytest.raises(SamplingError):
            S.pair_by_lists(spark, span, 20, 20, *bad)


def test_metric_names():
    assert S.metric_name(" Struct ") == "structural" and S.metric_name("PSYCHO") == "psychovisual"
    with pytest.raises(SamplingError):
        S.metric_name("other")


def test_offset_pairing_is_an_equi_join_with_a_pushed_filter(spark, tmp_path):
    spark.range(100).selectExpr("id AS frame_idx").write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    pairs = S.pair_by_offset(f, f, S.Span(10, 20, 2, 3))
    assert [(r.ord, r.src_frame, r.enc_frame) for r in pairs.orderBy("ord").collect()] == [(k, 10 + 2 * k, 13 + 2 * k) for k in range(5)]
    plan = pairs._jdf.queryExecution().explainString(pairs._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(frame_idx,10)" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_crops(spark):
    from pyspark.sql import functions as F

    px = spark.range(20).selectExpr("0 AS frame", "CAST(id DIV 5 AS INT) AS y", "CAST(id % 5 AS INT) AS x", "CAST(id AS DOUBLE) AS v")
    got = {(r.y, r.x): r.v for r in S.crop_pixels(px, 1, 1, 2, 0, 5, 4).collect()}
    assert got == {(0, 0): 7, (0, 1): 8, (0, 2): 9, (1, 0): 12, (1, 1): 13, (1, 2): 14}
    row = spark.createDataFrame([([float(k) for k in range(20)],)], "p array<double>")
    assert row.select(S.crop_plane(F.col("p"), F.lit(5), F.lit(4), 1, 1, 2, 0)).collect()[0][0] == [7, 8, 9, 12, 13, 14]


def test_numbering_spreads_a_hot_key(spark):
    """Numbers inside keys agree with sorting each key, whatever the partitions; none holds a whole hot key."""
    rows = spark.range(900).selectExpr("IF(id % 3 = 0, id % 7, 99) AS k", "(id * 37) % 900 AS t")
    got = S.numbered(rows, ("k",), ("t",)).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append((r.ord, r.t, r.size))
    assert sum(map(len, by_key.values())) == 900
    for found in by_key.values():
        found.sort()
        assert [o for o, _, _ in found] == list(range(len(found))) and [t for _, t, _ in found] == sorted(t for _, t, _ in found)
        assert {n for _, _, n in found} == {len(found)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_right_beside_a_payload(spark, adaptive):
    """Many partitions whose ranges are sampled, and a column that only one use needs."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(0, 600_000, 1, 16).selectExpr("IF(id % 3 = 0, null, id % 5) AS k", "(id * 7919) % 600000 AS t", "sha2(CAST(id AS string), 256) AS payload")
        got = S.numbered(rows, ("k",), ("t",))
        wrong = got.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS want", "count(*) OVER (PARTITION BY k) AS n").where("ord != want OR size != n")
        assert got.count() == 600_000 and wrong.count() == 0 and got.columns == ["k", "t", "payload", "size", "ord"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_frames_of_differing_sizes_are_refused(spark):
    from pixelquill.operators.structural import structural_score

    row = [("p", 0, 2, 1, [[0.0, 0.0]] * 3, 1, 2, [[0.0, 0.0]] * 3)]
    pairs = spark.createDataFrame(row, "pair_id string, ord int, a_width int, a_height int, a_planes array<array<float>>, b_width int, b_height int, b_planes array<array<float>>")
    with pytest.raises(Exception, match="frames differ"):
        structural_score(pairs).collect()
