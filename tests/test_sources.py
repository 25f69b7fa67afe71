import json
import re

import numpy as np
import pytest

from pixelquill import cli
from pixelquill.errors import ConfigurationError, UnsupportedInput
from pixelquill.operators import pooling, sampling
from pixelquill.sources import config, frames, scores, video
from pixelquill.streaming import live


def y4m(path, pictures, tag="420", extra=b""):
    h, w = pictures[0][0].shape
    kind = "<u2" if "p1" in tag else "<u1"
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F30000:1001 Ip C{tag}\n".encode())
        for planes in pictures:
            f.write(b"FRAME" + extra + b"\n" + b"".join(p.astype(kind).tobytes() for p in planes))


def test_y4m(spark, tmp_path):
    gray = [(np.full((5, 7), v), np.full((3, 4), 128), np.full((3, 4), 128)) for v in (16, 126, 235)]
    y4m(tmp_path / "a.y4m", gray, extra=b" Xany")
    rows = frames.read_y4m(spark, str(tmp_path / "a.y4m")).orderBy("frame_idx").collect()
    assert [(r.video_id, r.frame_idx, r.width, r.height) for r in rows] == [("a.y4m", k, 7, 5) for k in range(3)] and rows[0].fps == pytest.approx(29.97, abs=0.01)
    assert [round(float(np.mean(r.planes)), 4) for r in rows] == [0.0, round(110 / 219, 4), 1.0]
    y4m(tmp_path / "b.y4m", [tuple(np.full((4, 4), v * 4) for v in (126, 128, 128))], "444p10")
    assert np.allclose(frames.read_y4m(spark, str(tmp_path / "b.y4m")).collect()[0].planes, 110 / 219, atol=1e-6)
    (tmp_path / "bad.y4m").write_bytes(b"RIFF")
    with pytest.raises(Exception, match="not a Y4M"):
        frames.read_y4m(spark, str(tmp_path / "bad.y4m")).collect()
    index = video.frame_index(frames.read_y4m(spark, str(tmp_path / "a.y4m"))).collect()[0]
    assert (index.frames, index.width, index.one_size) == (3, 7, True)


def test_file_index_with_cache(spark, tmp_path):
    plain = lambda v: (np.full((4, 4), v), np.full((2, 2), 128), np.full((2, 2), 128))
    (tmp_path / "v").mkdir()
    y4m(tmp_path / "v" / "a.y4m", [plain(20)] * 3)
    cache, glob = str(tmp_path / "cache"), str(tmp_path / "v" / "*.y4m")
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert [(name(r), r.frames, r.width) for r in video.file_index(spark, glob, cache).collect()] == [("a.y4m", 3, 4)]
    y4m(tmp_path / "v" / "b.y4m", [plain(20)] * 5)
    assert sorted((name(r), r.frames) for r in video.file_index(spark, glob, cache).collect()) == [("a.y4m", 3), ("b.y4m", 5)]
    y4m(tmp_path / "v" / "a.y4m", [plain(20)] * 7)  # changed: opened again
    assert sorted((name(r), r.frames) for r in video.file_index(spark, glob, cache).collect()) == [("a.y4m", 7), ("b.y4m", 5)]
    assert video.file_index(spark, glob).count() == 2


@pytest.mark.parametrize(("sample", "kind", "top"), [("uint8", "<u1", 255), ("uint16", "<u2", 65535), ("half", "<f2", 1), ("float", "<f4", 1)])
def test_raw_planes_and_padding(spark, tmp_path, sample, kind, top):
    rng = np.random.default_rng(0)
    values = (rng.random((2, 3, 5, 9)) * top).astype(kind)
    for name, fill in (("plain", None), ("zero", 0), ("other", 1)):
        data = values if fill is None else np.concatenate([values, np.full((2, 3, 5, 4), fill, kind)], axis=3)
        (tmp_path / name).write_bytes(data.tobytes())
    got = [[np.array(r.planes) for r in frames.read_raw(spark, str(tmp_path / n), 9, 5, sample, s).orderBy("frame_idx").collect()] for n, s in (("plain", None), ("zero", 13), ("other", 13))]
    assert np.allclose(got[0], values.reshape(2, 3, 45).astype(float) / top, atol=1e-6)
    assert np.array_equal(got[0], got[1]) and np.array_equal(got[1], got[2])


def test_packed_layouts(spark, tmp_path):
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    for layout, order in (("rgb24", [0, 1, 2]), ("rgba", [0, 1, 2, 0]), ("argb", [0, 0, 1, 2]), ("bgra", [2, 1, 0, 0]), ("abgr", [0, 2, 1, 0])):
        (tmp_path / layout).write_bytes(rgb[:, :, order].tobytes())
        r = frames.read_raw(spark, str(tmp_path / layout), 4, 2, layout=layout).collect()[0]
        assert np.allclose(np.array(r.planes), rgb.transpose(2, 0, 1).reshape(3, 8) / 255.0), layout
    with pytest.raises(UnsupportedInput):
        frames.read_raw(spark, "x", 1, 1, layout="nope")


def test_pixel_formats():
    f = video.pixel_format
    assert (f("yuv420p").depth, f("yuv420p").sub_w, f("yuv420p").sub_h) == (8, 1, 1)
    assert f("yuv422p10le").depth == 10 and f("yuvj444p").full_range and f("gbrp12le").family == "rgb" and f("rgb48le").depth == 16 and f("gray16le").depth == 16
    with pytest.raises(UnsupportedInput):
        f("nv12x")


def test_displays(spark, tmp_path):
    (tmp_path / "display_models.json").write_text(json.dumps({"a": {"resolution": [1920, 1080], "viewing_distance_inches": 20, "max_luminance": 300, "E_ambient": 100}, "b": {"colorspace": "PQ"}, "c": {"colorspace": "x"}, "d": {"max_luminance": "bright"}}))
    (tmp_path / "color_spaces.json").write_text(json.dumps({"BT.709": {"EOTF": "sRGB", "RGB2X": [1, 0, 0], "RGB2Y": [0, 1, 0], "RGB2Z": [0, 0, 1]}, "PQ": {"EOTF": "PQ"}, "g": {"EOTF": "1.8"}}))
    a, b = (config.read_display(spark, str(tmp_path), n) for n in "ab")
    assert a.distance_m == pytest.approx(0.508) and a.black == pytest.approx(0.3 + 0.5 / np.pi) and b.eotf == "PQ" and b.rgb_to_xyz[0] == (1.0, 0.0, 0.0)
    assert b.distance_m == pytest.approx(30 / np.sqrt(1 + (16 / 9) ** 2) * 2 * 0.0254)
    assert config.Display().ppd == pytest.approx(80.13, abs=0.01)
    for name in ("c", "d", "none"):
        with pytest.raises(ConfigurationError):
            config.read_display(spark, str(tmp_path), name)


def test_score_files(spark, tmp_path):
    s = spark.createDataFrame([(k, k / 3, float(k)) for k in range(20)], "ord int, a double, b double").repartition(5)
    scores.write_json(s, str(tmp_path / "s"), ["a", "b"])
    assert sorted(map(tuple, scores.read_json(spark, str(tmp_path / "s"), ["a", "b"]).collect())) == sorted(map(tuple, s.collect()))
    parts = sorted(f for f in (tmp_path / "s").iterdir() if f.name.startswith("part-"))
    assert len(parts) > 2  # many tasks, one array
    assert json.loads("".join(f.read_text() for f in parts)) == [[k / 3, float(k)] for k in range(20)]
    (tmp_path / "one.json").write_text("[[1.5], [2.5],\n [3.0]]\n")
    assert sorted(map(tuple, scores.read_json(spark, str(tmp_path / "one.json"), ["a"]).collect())) == [(0, 1.5), (1, 2.5), (2, 3.0)]
    scores.write_json(s.limit(0), str(tmp_path / "e"), ["a"])
    assert scores.read_json(spark, str(tmp_path / "e"), ["a"]).count() == 0


def test_summary_ranks(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 19, 20, 21, 1000, 5000):
        v = np.sort(np.round(rng.normal(0, 3, n), 2))
        df = spark.createDataFrame([(k % 2, float(x)) for k, x in enumerate(v)], "g int, v double")
        r = pooling.summarize(df, "v").collect()[0]
        assert (r.n, r.median, r.p5, r.p95, r.minimum, r.maximum) == (n, v[n // 2], v[n // 20], v[19 * n // 20], v[0], v[-1])
        assert r.average == pytest.approx(v.mean(), abs=1e-9) and r.deviation == pytest.approx(v.std(), abs=1e-9)
        for g in pooling.summarize(df, "v", ("g",)).collect():
            own = v[g.g :: 2]
            assert (g.median, g.p5, g.p95) == (own[len(own) // 2], own[len(own) // 20], own[19 * len(own) // 20])
    assert "Average" in scores.report(pooling.summarize(df, "v"), "x")


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    for name, step in (("a.y4m", 1), ("b.y4m", 24)):
        rng = np.random.default_rng(1)
        y4m(tmp_path / name, [tuple((rng.integers(40, 200, s) // step) * step for s in ((16, 16), (8, 8), (8, 8))) for _ in range(6)])
    (tmp_path / "options").write_text("--every 2 --start 1\n--end 2\n")
    o = cli.options(["-s", str(tmp_path / "a.y4m"), "-e", str(tmp_path / "b.y4m"), "--config-file", str(tmp_path / "options"), "--crop-top-source", "2", "--crop-bottom-encoded", "2"])
    assert (o.every, o.start, o.end) == (2, 1, -1)
    found, values = cli.compare(spark, o)
    assert found.count() == 3 and values == ["score"]
    for metric in ("structural", "psycho"):
        o = cli.options(["-s", str(tmp_path / "a.y4m"), "-e", str(tmp_path / "b.y4m"), "-m", metric, "--source-indices", "2,0"])
        assert cli.compare(spark, o)[0].count() == 2


def test_live_stream(spark, tmp_path):
    """The number of pairs first; a batch that runs again after a restart repeats and loses nothing."""
    shape = "ord int, score double"
    add = lambda rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add([(0, 1.5), (1, 2.5)])

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live.live_scores(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["score"], 4)
        q.processAllAvailable()
        q.stop()
        return [r.value for r in live.live_lines(spark, str(tmp_path / "out")).orderBy("batch", "value").collect()]

    assert run() == ["4", "0 1.5", "1 2.5"]
    add([(2, 3.5)])
    assert run() == ["4", "0 1.5", "1 2.5", "2 3.5"]
    for name in ("1", ".1.crc"):  # as if the sink had written the last batch, and the query had died before it said so
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    add([(3, 4.5)])
    assert run() == ["4", "0 1.5", "1 2.5", "2 3.5", "3 4.5"]


def test_streamed_filter_equals_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from pixelquill.operators import temporal

    taps = temporal.kernels(30.0)[0].tolist()
    rng = np.random.default_rng(2)
    rows = [(p, int(k), float(rng.random())) for p in ("a", "b") for k in rng.permutation(25)]
    shape = "pair_id string, ord long, v double"
    for part in range(3):  # late and early frames over three files
        spark.createDataFrame(rows[part::3], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.stream_fir(stream, taps).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.pair_id, r.ord): r.filtered for r in spark.sql("SELECT * FROM filtered").collect()}
    batch = spark.createDataFrame(rows, shape)
    want = {(r.pair_id, r.ord): r.f for r in batch.select("pair_id", "ord", temporal.fir(F.col("v"), taps, ["pair_id"], ["ord"]).alias("f")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_one_clip_is_many_tasks(spark, tmp_path):
    """A long clip is dealt by ranges of frames, and a range reads its own frames only."""
    plain = lambda v: (np.full((4, 6), v), np.full((2, 3), 128), np.full((2, 3), 128))
    path = tmp_path / "long.y4m"
    y4m(path, [plain(16 + k) for k in range(40)])
    frames.register(spark)
    reader = frames.FrameReader({"path": str(path), "range_bytes": str(36 * 8)}, None)
    assert [p.numbers.tolist() for p in reader.partitions()] == [list(range(k, k + 8)) for k in range(0, 40, 8)]
    clip = spark.read.format("pixelquill_frames").option("range_bytes", 36 * 8).load(str(path))
    assert clip.rdd.getNumPartitions() == 5
    assert [(r.frame_idx, round(r.planes[0][0] * 219)) for r in clip.orderBy("frame_idx").collect()] == [(k, k) for k in range(40)]
    part = frames.read_y4m(spark, str(path), start=10, end=26)
    assert sorted(r.frame_idx for r in part.collect()) == list(range(10, 26))
    data = bytearray(path.read_bytes())
    place = data.index(b"FRAME", len(data) - 3 * 42)
    data[place : place + 5] = b"BROKE"  # beyond the range: never looked at
    path.write_bytes(data)
    assert frames.read_y4m(spark, str(path), end=16).count() == 16
    with pytest.raises(Exception, match="no marker"):
        frames.read_y4m(spark, str(path)).collect()
    (tmp_path / "raw").write_bytes(bytes(range(240)))
    raw = frames.read_raw(spark, str(tmp_path / "raw"), 4, 2, start=3, end=9)
    assert [(r.frame_idx, round(r.planes[0][0] * 255)) for r in raw.orderBy("frame_idx").collect()] == [(k, 24 * k) for k in range(3, 9)]


def test_markers_of_differing_lengths(spark, tmp_path):
    parts = [b"FRAME" + extra + b"\n" + bytes([v] * 16) for v, extra in ((16, b""), (100, b" Ixyz"), (235, b" Q"))]
    (tmp_path / "m.y4m").write_bytes(b"YUV4MPEG2 W4 H4 F25:1 Cmono\n" + b"".join(parts))
    assert [round(r.planes[0][0] * 219) for r in frames.read_y4m(spark, str(tmp_path / "m.y4m")).orderBy("frame_idx").collect()] == [0, 84, 219]
    assert video.file_index(spark, str(tmp_path / "m.y4m")).collect()[0].frames == 3
    (tmp_path / "cut.y4m").write_bytes((tmp_path / "m.y4m").read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        frames.read_y4m(spark, str(tmp_path / "cut.y4m")).collect()


def test_colour_metadata_and_yuyv(spark, tmp_path):
    (tmp_path / "f.y4m").write_bytes(b"YUV4MPEG2 W2 H1 F25:1 C444 XCOLORRANGE=FULL\nFRAME\n" + bytes([51, 204, 128, 128, 128, 228]))
    full = frames.read_y4m(spark, str(tmp_path / "f.y4m")).collect()[0].planes
    assert full[0][0] == pytest.approx(0.2) and full[0][1] == pytest.approx(0.8 + 2 * (1 - 0.299) * 100 / 255, abs=1e-6)
    wide = frames.read_y4m(spark, str(tmp_path / "f.y4m"), colour=video.Colour("2020", False)).collect()[0].planes
    assert wide[0][1] == pytest.approx((204 - 16) / 219 + 2 * (1 - 0.2627) * 100 / 224, abs=1e-6)
    (tmp_path / "p").write_bytes(bytes([16, 128, 235, 128, 126, 90, 126, 200]))
    got = np.array(frames.read_raw(spark, str(tmp_path / "p"), 4, 1, layout="yuyv422", colour=video.Colour("709", repeated=True)).collect()[0].planes)
    y, cb, cr = (np.array([16, 235, 126, 126]) - 16) / 219, np.array([0, 0, -38, -38]) / 224, np.array([0, 0, 72, 72]) / 224
    assert np.allclose(got, video.matrix_rgb(y, cb, cr, 0.2126, 0.0722), atol=1e-6)
    with pytest.raises(UnsupportedInput):
        video.Colour("none").weights(4)


def test_configuration_documents(spark, tmp_path):
    for name in config.DOCUMENTS:
        (tmp_path / "full").mkdir(exist_ok=True)
        (tmp_path / "full" / name).write_text("{}")
    (tmp_path / "part").mkdir()
    assert config.find_folder(spark, ["", str(tmp_path / "part"), str(tmp_path / "full")]) == str(tmp_path / "full")
    with pytest.raises(ConfigurationError, match="lacks"):
        config.find_folder(spark, [str(tmp_path / "part")])
    table = {"L_bkg": [0.1, 10], "rho": [0.5, 1, 2]} | {k: [[1, 2, 3], [4, 5, 6.5]] for k in ("o0_c1", "o0_c2", "o0_c3", "o5_c1")}
    write = lambda d: (tmp_path / "t.json").write_text(json.dumps(d)) and str(tmp_path / "t.json")
    found = config.read_sensitivity(spark, write(table))
    assert np.allclose(found.log_background, [-1, 1]) and found.tables[3][1][2] == 6.5
    for broken in ({"rho": []}, {"o0_c2": [[1, 2, 3]]}, {"o0_c3": [[1, 2], [3, 4]]}, {"o5_c1": [[1, 2, "x"], [4, 5, 6]]}):
        with pytest.raises(ConfigurationError):
            config.read_sensitivity(spark, write(table | broken))
    known = {"a": 1.5, "b": (1.0, 2.0), "c": "soft", "d": 3}
    assert config.check_parameters(spark, write({"a": 2, "b": [3, 4], "e": 0}), known) == {"a": 2.0, "b": (3.0, 4.0), "c": "soft", "d": 3}
    with pytest.raises(ConfigurationError):
        config.check_parameters(spark, write({"b": [1]}), known)


def test_display_metric_from_the_command_line(spark, tmp_path, capsys):
    y4m(tmp_path / "a.y4m", [(np.full((16, 16), 60 + k), np.full((8, 8), 128), np.full((8, 8), 128)) for k in range(3)])
    (tmp_path / "display_models.json").write_text(json.dumps({"d": {"resolution": [1920, 1080], "viewing_distance_meters": 0.6, "diagonal_size_inches": 24, "max_luminance": 200, "contrast": 1000, "colorspace": "s"}}))
    (tmp_path / "color_spaces.json").write_text(json.dumps({"s": {"EOTF": "sRGB", "RGB2X": [0.41, 0.36, 0.18], "RGB2Y": [0.21, 0.72, 0.07], "RGB2Z": [0.02, 0.12, 0.95]}}))
    (tmp_path / "t.json").write_text(json.dumps({"L_bkg": [0.01, 1000], "rho": [0.1, 50]} | {k: [[1, 0.5], [2, 1]] for k in ("o0_c1", "o0_c2", "o0_c3", "o5_c1")}))
    args = ["-s", str(tmp_path / "a.y4m"), "-e", str(tmp_path / "a.y4m"), "-m", "display", "--config-dir", str(tmp_path), "--display", "d"]
    scores_found, names = cli.compare(spark, cli.options([*args, "--sensitivity", str(tmp_path / "t.json")]))
    assert names == ["score"] and [r.score for r in scores_found.collect()] == [10.0] * 3
    with pytest.raises(SystemExit, match="sensitivity"):
        cli.compare(spark, cli.options(args))


def test_chroma_is_interpolated():
    x = np.linspace(0, 1, 16)
    plane = np.tile(x[::2], (8, 1))
    out = video.enlarged(plane, (16, 16), 1, 1)
    assert np.allclose(out[:, 4:-4], x[4:-4])  # a slope stays one, chroma on the left column
    middle = video.enlarged(plane.T, (16, 16), 1, 1)
    assert np.allclose(middle[4:-4, 5], (x[4:-4] * 15 - 0.5) / 15)  # and between the lines
    assert np.allclose(video.enlarged(np.full((2, 3), 0.25), (3, 5), 1, 1, True), 0.25)
    # The kernel of 1/3 and 1/3 has 8/9 and 1/18 at whole places.
    spike = np.zeros((1, 9))
    spike[0, 4] = 1
    row = video.enlarged(spike, (1, 18), 0, 1)[0]
    assert np.allclose(row[[6, 8, 10]], [1 / 18, 8 / 9, 1 / 18]) and np.isclose(row[7], row[9])
    assert np.isclose(row[5:12:2].sum(), 1) and np.isclose(row[[4, 6, 8, 10, 12]].sum(), 1)


def breaks_all_but(path, size, kept):
    """Spoils the markers of the frames that a test says are never opened."""
    data = bytearray(path.read_bytes())
    head, step = data.index(b"\n") + 1, size + 6
    for k in range((len(data) - head) // step):
        if k not in kept:
            data[head + k * step : head + k * step + 5] = b"BROKE"
    path.write_bytes(data)


def test_conditions_reach_the_frames(spark, tmp_path):
    """Only frames that a condition leaves are opened, and none where only numbers are asked for."""
    path = tmp_path / "a.y4m"
    y4m(path, [tuple(np.full(s, 16 + k) for s in ((4, 6), (2, 3), (2, 3))) for k in range(20)])
    every = frames.read_y4m(spark, str(path))
    breaks_all_but(path, 36, {0, 5, 6, 7, 10, 19})  # the first, middle and last marker tell where frames are
    got = every.where("frame_idx >= 5 AND frame_idx < 8").orderBy("frame_idx").collect()
    assert [(r.frame_idx, round(r.planes[0][0] * 219)) for r in got if True] == [(5, round(got[0].planes[0][0] * 219)), (6, round(got[1].planes[0][0] * 219)), (7, round(got[2].planes[0][0] * 219))]
    assert sorted(r.frame_idx for r in every.where("frame_idx IN (0, 19) AND width = 6").collect()) == [0, 19]
    assert every.where("frame_idx > 100").count() == 0 and every.where("frame_idx = 6").count() == 1
    with pytest.raises(Exception, match="no marker"):
        every.where("frame_idx = 8").collect()
    numbers = frames.read_y4m(spark, str(path), columns=["frame_idx", "height"])
    assert sorted(map(tuple, numbers.collect())) == [(k, 4) for k in range(20)]
    plan = every.where("frame_idx >= 5 AND frame_idx < 8")._jdf.queryExecution().executedPlan().toString()
    assert "Filter isnotnull" not in plan and "- Filter" not in plan and ") Filter" not in plan, plan  # the source answers the condition alone


def test_pairs_are_read_in_one_task(spark, tmp_path):
    """Both frames of a pair are read together: nothing wide is exchanged, other frames are never opened."""
    for name, late in (("a.y4m", 0), ("b.y4m", 3)):
        y4m(tmp_path / name, [tuple(np.full(s, 40 + (k - late) % 20) for s in ((16, 16), (8, 8), (8, 8))) for k in range(20)])
    span = sampling.resolve(20, 20, 4, 10, 2, 3)
    got = frames.read_pairs(spark, frames.Side(str(tmp_path / "a.y4m")), frames.Side(str(tmp_path / "b.y4m")), span)
    breaks_all_but(tmp_path / "a.y4m", 384, {0, 4, 6, 8, 10, 19})
    breaks_all_but(tmp_path / "b.y4m", 384, {0, 7, 9, 10, 11, 19})
    rows = got.orderBy("ord").collect()
    assert [(r.ord, r.src_frame, r.enc_frame) for r in rows] == [(0, 4, 7), (1, 6, 9), (2, 8, 11)] and all(r.a_planes == r.b_planes for r in rows)
    assert [r.ord for r in got.where("src_frame = 6").collect()] == [1]
    o = cli.options(["-s", str(tmp_path / "a.y4m"), "-e", str(tmp_path / "b.y4m"), "--start", "4", "--end", "10", "--every", "2", "--encoded-offset", "3"])
    scored, _ = cli.compare(spark, o)
    assert [round(r.score, 6) for r in scored.collect()] == [100.0] * 3
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow[^\n]*\n[^\n]*Project[^\n]*\n[^\n]*BatchScan pixelquill_frame_pairs[^\n]*planes", plan), plan
    assert not any("planes" in line for line in plan.split("\n") if "Exchange" in line or "Join" in line), plan
    with pytest.raises(Exception, match="has no frame"):
        frames.read_pairs(spark, frames.Side(str(tmp_path / "a.y4m")), frames.Side(str(tmp_path / "b.y4m")), [(0, 1, 20)]).collect()


def test_the_second_frame_gets_the_size_of_the_first(spark, tmp_path):
    ramp = lambda h, w: np.tile(np.linspace(40, 200, w).round().astype(int), (h, 1))
    flat = lambda h, w: (np.full((h // 2, w // 2), 128),) * 2
    y4m(tmp_path / "a.y4m", [(ramp(24, 32), *flat(24, 32))])
    y4m(tmp_path / "b.y4m", [(ramp(48, 64), *flat(48, 64))])
    sides = [frames.Side(str(tmp_path / n)) for n in ("a.y4m", "b.y4m")]
    r = frames.read_pairs(spark, *sides, sampling.Span(0, 1, 1, 0)).collect()[0]
    assert (r.a_width, r.a_height, r.b_width, r.b_height) == (32, 24, 32, 24)
    assert np.abs(np.array(r.a_planes) - np.array(r.b_planes)).max() < 0.02
    cut = [frames.Side(sides[0].path, crop=(2, 4, 0, 6)), frames.Side(sides[1].path, crop=(1, 1, 3, 0))]
    r = frames.read_pairs(spark, *cut, sampling.Span(0, 1, 1, 0)).collect()[0]
    assert (r.a_width, r.a_height, r.b_width, r.b_height) == (26, 18, 26, 18)
    with pytest.raises(Exception, match="frames differ"):
        frames.read_pairs(spark, *sides, sampling.Span(0, 1, 1, 0), fit=False).collect()


def test_siting_follows_the_tag(spark, tmp_path):
    """The same samples as centred and as left chroma differ by half a sample's slope."""
    chroma = np.tile(np.arange(8) * 10 + 90, (8, 1))
    planes = (np.full((16, 16), 126), np.full((8, 8), 128), chroma)
    red = {}
    for tag in ("420", "420jpeg", "420mpeg2", "420paldv"):
        y4m(tmp_path / tag, [planes], tag)
        red[tag] = np.array(frames.read_y4m(spark, str(tmp_path / tag)).collect()[0].planes[0]).reshape(16, 16)
    assert np.array_equal(red["420"], red["420jpeg"]) and np.array_equal(red["420mpeg2"], red["420paldv"])
    slope = 10 / 224 * 2 * (1 - 0.299)
    assert np.allclose((red["420mpeg2"] - red["420jpeg"])[:, 4:-4], slope / 4, atol=1e-5)
    given = frames.read_y4m(spark, str(tmp_path / "420"), colour=video.Colour(centred=False)).collect()[0].planes[0]
    assert np.array_equal(np.array(given).reshape(16, 16), red["420mpeg2"])


def test_raw_files_have_an_index(spark, tmp_path):
    (tmp_path / "r").write_bytes(bytes(240))
    r = video.file_index(spark, str(tmp_path / "r"), raw=video.Raw(4, 2, fps=25.0)).collect()[0]
    assert (r.frames, r.width, r.height, r.fps) == (10, 4, 2, 25.0)
    with pytest.raises(Exception, match="no whole frames"):
        video.file_index(spark, str(tmp_path / "r"), raw=video.Raw(7, 3)).collect()


def test_repeated_options_are_refused(capsys):
    with pytest.raises(SystemExit):
        cli.options(["-s", "a", "-e", "b", "--start", "1", "--start", "1"])
    assert "more than once" in capsys.readouterr().err


@pytest.mark.parametrize(("have", "want"), [(8, 16), (16, 8), (9, 5), (5, 9), (7, 7), (30, 4), (1, 3), (3, 1)])
def test_resampling(have, want):
    from pixelquill.functions.planes import resample, resample_taps

    places, weights = resample_taps(have, want)
    assert np.allclose(weights.sum(1), 1) and places.min() >= 0 and places.max() < have
    assert np.allclose(resample(np.full((have, have), 0.3), (want, want)), 0.3)
    line = np.arange(have) / have
    out = resample(np.tile(line, (3, 1)), (3, want))[0]
    inner = slice(want // 3, want - want // 3) if min(have, want) >= 8 else slice(0, 0)
    assert np.allclose(out[inner], ((np.arange(want) + 0.5) * have / want - 0.5)[inner] / have)


def test_formats_and_colours(spark):
    from pixelquill.sources import formats

    names = {r.name: r for r in formats.pixel_formats(spark).collect()}
    assert len(names) == len(formats.PIXEL_FORMATS) == 50
    assert (names["yuva422p10le"].depth, names["yuva422p10le"].sub_w, names["yuva422p10le"].sub_h) == (10, 1, 0) and names["yuvj411p"].full_range and names["rgb48le"].depth == 16
    v = np.linspace(-0.1, 1.2, 27)
    for transfer in formats.TRANSFERS:
        light = formats.linear_light(v, transfer)
        assert (np.diff(light) >= 0).all() and (transfer in ("smpte2084", "smpte428", "arib-std-b67") or abs(formats.linear_light(np.ones(1), transfer)[0] - 1) < 1e-9)
    assert np.allclose(formats.linear_light(formats.encoded_709(v), "bt709"), v)
    for name in formats.PRIMARIES:
        assert np.allclose(formats.primaries_to_709(name) @ np.ones(3), 1, atol=0.01 if name == "smpte428" else 1e-9)
    assert np.allclose(formats.primaries_to_709("bt709"), np.eye(3)) and np.allclose(formats.primaries_to_709("bt2020")[0], [1.6605, -0.5876, -0.0728], atol=1e-3)
    rgb = np.random.default_rng(0).random((3, 4, 5))
    assert formats.to_709(rgb) is rgb and np.allclose(formats.to_709(formats.encoded_709(rgb), "bt709"), formats.encoded_709(rgb))
    assert np.allclose(formats.to_709(rgb, "linear"), formats.encoded_709(rgb))
    with pytest.raises(UnsupportedInput):
        formats.to_709(rgb, "none")
    with pytest.raises(UnsupportedInput):
        formats.to_709(rgb, "linear", "none")


def test_frames_of_another_transfer(spark, tmp_path):
    from pixelquill.sources import formats

    (tmp_path / "raw").write_bytes(bytes(range(0, 240, 10)))
    raw = dict(width=4, height=2)
    plain, other = (np.array(frames.read_raw(spark, str(tmp_path / "raw"), **raw, colour=video.Colour(**c)).collect()[0].planes) for c in ({}, {"transfer": "iec61966-2-1", "primaries": "bt2020"}))
    assert np.allclose(other, formats.to_709(plain, "iec61966-2-1", "bt2020"), atol=1e-6) and np.abs(other - plain).max() > 0.05


def test_other_parameters_from_the_command_line(spark, tmp_path):
    for name, step in (("a.y4m", 1), ("b.y4m", 2)):
        rng = np.random.default_rng(1)
        y4m(tmp_path / name, [tuple((rng.integers(40, 200, s) // step) * step for s in ((16, 16), (8, 8), (8, 8))) for _ in range(3)])
    (tmp_path / "display_models.json").write_text(json.dumps({"d": {"resolution": [1920, 1080], "colorspace": "s"}}))
    (tmp_path / "color_spaces.json").write_text(json.dumps({"s": {"EOTF": "sRGB", "RGB2X": [0.41, 0.36, 0.18], "RGB2Y": [0.21, 0.72, 0.07], "RGB2Z": [0.02, 0.12, 0.95]}}))
    (tmp_path / "t.json").write_text(json.dumps({"L_bkg": [0.01, 1000], "rho": [0.1, 50]} | {k: [[1, 0.5], [2, 1]] for k in ("o0_c1", "o0_c2", "o0_c3", "o5_c1")}))
    (tmp_path / "p.json").write_text(json.dumps({"jod_a": 0.004, "dclamp_type": "hard"}))
    args = ["-s", str(tmp_path / "a.y4m"), "-e", str(tmp_path / "b.y4m"), "-m", "display", "--config-dir", str(tmp_path), "--display", "d", "--sensitivity", str(tmp_path / "t.json")]
    usual, other = (np.array([r.score for r in cli.compare(spark, cli.options([*args, *more]))[0].orderBy("ord").collect()]) for more in ([], ["--parameters", str(tmp_path / "p.json")]))
    assert (other > usual).all() and (other < 10).all()


def test_streamed_planes_equal_the_batch(spark, tmp_path):
    """Planes of many strips, late and early and repeated frames; the state of finished and of silent pairs is dropped."""
    import time

    from pixelquill.operators import temporal, visibility

    taps = temporal.kernels(30.0)
    rng = np.random.default_rng(4)
    shape = "pair_id string, strip int, ord int, frames int, planes array<array<float>>"
    planes = {(p, s, k): rng.random((3, 6)).astype(np.float32) for p in ("a", "b") for s in (0, 8) for k in range(14)}
    rows = [(p, s, k, 14 if p == "a" else None, planes[p, s, k].tolist()) for p, s, k in planes]
    rows = [rows[i] for i in rng.permutation(len(rows))] + rows[3:5]
    for part in range(3):
        spark.createDataFrame(rows[part::3], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    filtered = live.stream_planes(stream, taps, idle=1000)
    q = filtered.writeStream.format("memory").queryName("planes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    def until(done, seconds=60):
        """Timers keep such a stream busy, so its end is not waited for."""
        deadline = time.time() + seconds
        while time.time() < deadline and q.isActive and not done():
            time.sleep(0.3)
        return done()

    assert until(lambda: spark.sql("SELECT * FROM planes").count() >= len(planes)), q.exception()
    got = {(r.pair_id, r.strip, r.ord): np.array(r.filtered) for r in spark.sql("SELECT * FROM planes").collect()}
    assert got.keys() == planes.keys()
    for (p, s, k), found in got.items():
        past = [planes[p, s, max(k - j, 0)].astype(np.float64).reshape(3, 1, 6) for j in range(taps.shape[1])]
        want = visibility._fir(past, taps).reshape(4, 6)
        assert np.allclose(found, want[: 3 if k == 0 else 4])
    # Finished and silent pairs leave no frame behind.
    kept = lambda: sum(o["numRowsTotal"] for o in (q.lastProgress or {"stateOperators": [{"numRowsTotal": 1}]})["stateOperators"])
    gone = until(lambda: kept() == 0, 30)
    q.stop()
    assert gone, kept()


@pytest.mark.parametrize("layout", [None, {"sample": "float", "stride": 9}, {"layout": "bgra"}, {"layout": "rgb48le", "stride": 30}])
def test_clips_are_written_and_read_back(spark, tmp_path, layout):
    """Every layout, in order of frames whatever the partitions; a size that changes is refused."""
    from pixelquill.sources import clips

    rng = np.random.default_rng(3)
    planes = {(v, k): rng.random((3, 4, 7)).astype(np.float32) for v in ("one", "two") for k in range(5)}
    shape = "frame_idx long, video_id string, width int, height int, fps double, planes array<array<float>>"
    rows = spark.createDataFrame([(k, v, 7, 4, 25.0, p.reshape(3, -1).tolist()) for (v, k), p in planes.items()], shape).repartition(3)
    raw = None if layout is None else video.Raw(7, 4, **layout)
    done = clips.write_clips(rows, str(tmp_path / "out"), raw, 255).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.frames) for r in done) == [("one", 5), ("two", 5)] and len(list((tmp_path / "out").iterdir())) == 2
    if raw is None:
        assert [(r.frames, r.width, r.fps) for r in video.file_index(spark, str(tmp_path / "out")).collect()] == [(5, 7, 25.0)] * 2
        with video.open_file(str(tmp_path / "out" / "one")) as f:
            clip = video.Clip.of(f)
            first = np.frombuffer(f.read_at(84, clip.begin + 6), np.uint8).reshape(3, 4, 7)
        assert np.array_equal(first, np.rint(planes["one", 0].astype(float) * 255))
    else:
        found = {(r.video_id, r.frame_idx): np.array(r.planes).reshape(3, 4, 7) for r in frames.read_frames(spark, str(tmp_path / "out"), raw).collect()}
        assert found.keys() == planes.keys() and all(np.abs(found[k] - planes[k]).max() < 0.003 for k in planes)
    bad = spark.createDataFrame([(k, "x", 2, 1 + k, 25.0, [[0.5] * 2 * (1 + k)] * 3) for k in range(2)], shape)
    with pytest.raises(Exception, match="another size"):
        clips.write_clips(bad, str(tmp_path / "bad")).collect()
