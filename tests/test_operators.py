"""Operators against NumPy and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import arrays as A
from scanloom.functions import geometry as G
from scanloom.functions import text as T
from scanloom.operators import align, blob, lines, lookup, mosaic, ordered, recon
from scanloom.plans.session import Engine, Settings
from scanloom.sources import frames as S
from scanloom.sources import sinks

NUMPY = {
    "identity": lambda a: a,
    "fliplr": np.fliplr,
    "flipud": np.flipud,
    "rot180": lambda a: np.rot90(a, 2),
    "transpose": np.transpose,
    "rot90_ccw": np.rot90,
    "rot90_cw": lambda a: np.rot90(a, -1),
    "antitranspose": lambda a: np.rot90(a, 2).T,
}


def one(spark, px, use):
    return spark.createDataFrame([(px,)], "px array<bigint>").select(use(F.col("px")).alias("r")).first()["r"]


@pytest.mark.parametrize("name", A.SYMMETRIES)
def test_orient_equals_numpy(spark, name):
    a = np.arange(12).reshape(3, 4)
    assert one(spark, a.ravel().tolist(), lambda c: A.orient(c, name, 3, 4)) == NUMPY[name](a).ravel().tolist()


def test_symmetries_are_a_group():
    for a in A.SYMMETRIES:
        assert A.compose([a, A.inverse(a)]) == "identity"
        for b in A.SYMMETRIES:
            grid = np.arange(12).reshape(3, 4)
            assert (NUMPY[A.compose([a, b])](grid) == NUMPY[b](NUMPY[a](grid))).all()
            assert A.compose([a, A.between(a, b)]) == b
    assert (A.compose(""), A.compose("cw,ccw"), A.compose("cw,cw")) == ("identity", "identity", "rot180")
    with pytest.raises(ValueError):
        A.compose("sideways")


def test_nested_orientations_stay_cheap_and_null_stays_null(spark):
    chain = lambda c: A.orient(A.orient(A.orient(c, "rot90_cw", 8, 8), "rot90_cw", 8, 8), "rot180", 8, 8)
    px = list(range(64))
    assert one(spark, px, chain) == px and one(spark, None, chain) is None


def test_crop_after_flip(spark):
    a = np.array([[r * 100 + c for c in range(8)] for r in range(6)])
    got = one(spark, a.ravel().tolist(), lambda c: A.crop(A.orient(c, "fliplr", 6, 8), 8, 2, 5, 1, 7))
    assert got == np.fliplr(a)[2:5, 1:7].ravel().tolist()
    assert A.inner_crop_margin(8, 8) == 2 and A.inner_crop_margin(8, 8, 4) == 0 and A.inner_crop_margin(8, 8, None, 3) == 3


def test_pixel_rules(spark):
    assert one(spark, [65535, 1, 2], lambda c: A.saturated_to_zero(c, 65535)) == [0, 1, 2]
    assert one(spark, [5, 6, 7], lambda c: A.hot_to_zero(c, 6)) == [5, 6, 0]
    assert one(spark, [5, 6, 7], lambda c: A.hot_to_zero(c, 6, True)) == [5, 0, 0]
    assert one(spark, [5, 6, 7], lambda c: A.hot_to_zero(c, None)) == [5, 6, 7]
    assert one(spark, [0, 3, 70000, 99], A.to_uint8) == [0, 1, 255, 9]
    assert one(spark, list(range(9)), lambda c: A.inpaint(c, 3, 3, [4, 0])) == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    a = np.arange(16).reshape(4, 4)
    assert one(spark, a.ravel().tolist(), lambda c: A.bin_mean(c, 4, 4, 2)) == a.reshape(2, 2, 2, 2).mean(axis=(1, 3)).ravel().tolist()
    assert one(spark, a.ravel().tolist(), lambda c: A.fftshift(c, 4, 4)) == np.fft.fftshift(a).ravel().tolist()
    assert one(spark, [1, 2, 3, 4], lambda c: A.pad_centre(c, 2, 2, 4, 2)) == [None, None, 1, 2, 3, 4, None, None]


@pytest.mark.parametrize("case", [(0, 10, 0, 10, 12, 5), (0, 2, 0, 2, 2, 1), (0, 1, 0, 1, 10, 5), (0, 1, 1, 0, 10, -4), (2, 2, 2, 2, 10, -3)])
def test_canvas_middle(spark, case):
    lo, hi, first, last, commanded, want = (float(x) for x in case)
    assert spark.range(1).select(G.canvas_middle(*map(F.lit, (lo, hi, first, last, commanded))).alias("m")).first()["m"] == want


def test_energies(spark):
    r = spark.range(1).select(G.encoder_ratio(F.lit(None)).alias("a"), G.encoder_ratio(F.lit(0)).alias("b"), G.encoder_ratio(F.lit(5000)).alias("c"), G.wavelength_nm(F.lit(12.0)).alias("d"), G.bragg_energy_kev(F.lit(8.0)).alias("e"), G.bragg_energy_kev(F.lit(12.0)).alias("f")).first()
    assert (r.a, r.b, r.c) == (-1e-4, -1e-4, -0.5) and r.d == 1.2398 / 12 and r.e > r.f
    with pytest.raises(ValueError):
        G.object_side(8, F.lit(1.0), 0, 2)


def test_line_fit_ignores_a_stale_start(spark):
    rng = np.random.default_rng(0)
    slow = np.concatenate((rng.normal(0, 0.05, 200), np.repeat(np.linspace(10.5, -10.5, 210), 280) + rng.normal(0, 0.02, 58800)))[:1500]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(slow)], "frame_id long, v double")
    a, b = lines.fit_line(df, "v", 1.4)
    assert a > 9 and b < 0
    kept = {r["frame_id"] for r in lines.on_line(df, "v", (a, b), 1.4).collect()}
    assert kept == set(range(200, 1500))
    assert lines.fit_line(df.limit(100), "v", 1.4) is None
    fast = df.withColumn("fast", F.sin(F.col("frame_id") * 0.7) * 14)
    assert lines.slow_axis(fast.where("frame_id >= 200"), ("fast", "v"))[0] == "v"


def test_pending_and_prefix(spark):
    f = spark.createDataFrame([(i, i) for i in range(6)], "frame_id long, arrival long")
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, float("nan"), 1.0), (2, 2.0, 2.0), (3, 1.0, None), (4, 1.0, 1.0)], "frame_id long, x double, y double")
    assert {r[0] for r in align.ready(f, p).select("frame_id").collect()} == {0, 2, 4}
    assert {r[0] for r in align.pending(f, p).select("frame_id").collect()} == {1, 3, 5}
    assert [r["frame_id"] for r in align.prefix_release(f, p).collect()] == [0]
    assert align.prefix_release(f.where("frame_id in (0, 2)"), p).count() == 2


def test_order_operators(spark):
    e = spark.createDataFrame([(i,) for i in range(10)], "arrival long")
    assert ordered.batches(e, 4).groupBy("batch_no").count().collect() == [(0, 4), (1, 4)] or ordered.batches(e, 4).count() == 8
    b = spark.createDataFrame([(k,) for k in range(7)], "batch_no long")
    groups = {}
    for r in ordered.overlapping(b, 3, 1, 2).collect():
        groups.setdefault(r["group_no"], set()).add(r["batch_no"])
    assert groups[0] == {0, 1, 2} and groups[1] == {2, 3, 4} and groups[2] == {4, 5, 6}
    p = spark.createDataFrame([(0, 5), (2, 1), (1, 2), (1, 9), (4, 3)], "packet_no long, arrival long")
    assert sorted(r["packet_no"] for r in ordered.in_order_prefix(p).collect()) == [0, 1, 2]
    assert ordered.kept_rows(10, 3) == 4
    with pytest.raises(Exception, match="starts at frame 3"):
        ordered.check_first(spark.range(3, 6), "id").collect()


def test_center_box(spark):
    y, x = np.mgrid[0:40, 0:40]

    def frame(cy, cx):
        return (1000 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 32)).astype(int).ravel().tolist()

    df = spark.createDataFrame([(k, frame(*c)) for k, c in enumerate(((20, 12), (38, 38)))] + [(2, [0] * 1600)], "g long, px array<bigint>")
    got = {r["g"]: r for r in blob.center_box(df, 40, 40, 16, 16, keys=("g",)).collect()}
    assert (got[0].y0, got[0].x0, got[0].clamped) == (12, 4, False) or abs(got[0].y0 - 12) <= 1
    assert (got[1].y1, got[1].x1, got[1].clamped) == (40, 40, True)
    assert got[2].y0 is None and got[2].clamped is False
    label = blob.label_components(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool))
    assert len(np.unique(label)) == 4


def test_solver_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n, h, w = 8, 20, 24
    truth = np.exp(1j * rng.normal(0, 0.3, (h, w)))
    probe = np.exp(-((np.mgrid[0:n, 0:n] - 3.5) ** 2).sum(axis=0) / 12).astype(complex)
    places = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(0, 13, 2) for b in range(0, 17, 2))]
    rows = [(i, np.abs(np.fft.fft2(probe * truth[a : a + n, b : b + n], norm="ortho")).ravel().tolist(), a, b) for i, a, b in places]
    df = spark.createDataFrame(rows, "frame_id long, amp array<double>, y0 int, x0 int")
    config = recon.SolverConfig(n, h, w, start_probe_update=100)
    obj, _, errors = recon.reconstruct(df, config, probe, iterations=4)
    o = recon.start_object(config)
    top = max(max(r[1]) for r in rows)
    for _ in range(4):
        up, norm = np.zeros((h, w), complex), np.zeros((h, w))
        for _, amp, a, b in rows:
            far = np.fft.fft2(probe * o[a : a + n, b : b + n], norm="ortho")
            v = recon.ml_amplitude(np.abs(far), np.reshape(amp, (n, n)), "poisson", 25.0 / top, 0.1) * np.exp(1j * np.angle(far))
            up[a : a + n, b : b + n] += np.conj(probe) * np.fft.ifft2(v, norm="ortho")
            norm[a : a + n, b : b + n] += np.abs(probe) ** 2
        o = up / (norm + config.alpha)
    assert np.abs(obj - o).max() < 1e-9 and errors[-1] < errors[0]
    with pytest.raises(NotImplementedError):
        recon.SolverConfig(n, h, w, probe_modes=2)
    with pytest.raises(ValueError):
        recon.warm_probe(np.ones((4, 4)), n)
    spot = np.zeros((8, 8))
    spot[3, 6] = 1
    assert np.roll(spot, recon.roll_centroid(spot), axis=(0, 1))[4, 4] == 1


def test_probe_propagation_and_clearing(spark):
    p = np.exp(-((np.mgrid[0:16, 0:16] - 7.5) ** 2).sum(axis=0) / 8).astype(complex)
    there = recon.propagate(p, 1e-4, 1e-10, 1e-7)
    assert np.abs(recon.propagate(there, -1e-4, 1e-10, 1e-7) - p).max() < 1e-9
    w = spark.createDataFrame([(2, 3), (10, 1)], "y0 int, x0 int")
    config = recon.SolverConfig(8, 40, 30)
    assert recon.region_to_clear(w, config, 10) == (2, 18, 1, 11) and recon.region_to_clear(w, config, 1000) is None


def test_decoding(spark):
    f = spark.createDataFrame([(1, [1, 2, 3, 65535]), (2, [0, 0, 256, 7])], "frame_id long, px array<bigint>")
    m = S.encode_frames(f, 2, 2)
    assert sorted((r["frame_id"], list(r["px"])) for r in S.decode_frames(m).collect()) == [(1, [1, 2, 3, 65535]), (2, [0, 0, 256, 7])]
    odd = m.withColumn("description", F.regexp_replace("description", "raw", "zstd<"))
    with pytest.raises(Exception, match="cannot be read"):
        S.decode_frames(odd).collect()
    plug = {"zstd<": lambda data, kind, n: np.frombuffer(data, kind, n)}
    assert S.decode_frames(odd, plug).count() == 2
    assert S.decode_frames(m.withColumn("header", F.lit("not json"))).count() == 0


def test_array_shapes():
    assert S.positions_array(np.zeros((2, 5))).shape == S.positions_array(np.zeros((5, 2))).shape == (2, 5)
    assert S.positions_array(np.eye(2)).shape == (2, 2)
    for bad in (np.zeros(5), np.zeros((3, 4))):
        with pytest.raises(ValueError):
            S.positions_array(bad)
    assert S.stack_of_frames(np.zeros((1, 3, 4, 5))).shape == S.stack_of_frames(np.zeros((3, 1, 4, 5))).shape == (3, 4, 5)


def test_headers_and_keys():
    text = "[scan]\nscan_num = 12345\nx_num = 100\nx_range = 5.0\n"
    assert T.scan_header(text)["x_num"] == 100 and T.scan_header(text)["angle"] == 0 and T.scan_header("nothing") is None
    assert T.literal("3.5") == 3.5 and T.literal("") == "" and T.literal("abc") == "abc"
    import base64

    assert T.curve_key(base64.b64encode(bytes(range(32))).decode()) == bytes(range(32)) and len(T.curve_key("0" * 40)) == 32
    with pytest.raises(ValueError):
        T.curve_key("short")
    with pytest.raises(ValueError):
        T.curve_options("a", None, None)
    assert T.curve_options(None, None, None) == {}


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    sinks.start_run(spark, base, "r1", {"scan": 7})
    sinks.complete_run(spark, base, "r1", {"frames": 3})
    row = spark.read.parquet(sinks.table_path(base, "r1", "run")).first()
    assert row["complete"] and row["metadata"] == {"scan": "7", "frames": "3"}
    f = spark.createDataFrame([(i, [i * i] * 4) for i in range(6)], "frame_id long, px array<bigint>")
    sinks.write_detector(f.where("frame_id < 4"), base, "r1", 0, stride=2)
    sinks.write_detector(f.where("frame_id >= 2").withColumn("px", F.transform("px", lambda v: v * 4)), base, "r1", 1, stride=2)
    got = sinks.newest(spark.read.parquet(sinks.table_path(base, "r1", "diffraction")), "row")
    assert {r["row"]: r["px"][0] for r in got.collect()} == {0: 0, 1: 4, 2: 8}
    live = lambda *v: spark.createDataFrame([v], "probe_re array<double>, probe_im array<double>, obj_re array<double>, obj_im array<double>")
    nan, inf = float("nan"), float("inf")
    assert sinks.write_live(live([3.0], [4.0], [1.0, nan], [0.0, nan]), base, "r1", 10)
    assert spark.read.parquet(sinks.table_path(base, "r1", "live")).first()["probe_amp"] == [5.0]
    assert not sinks.write_live(live([nan], [0.0], [1.0], [0.0]), base, "r1", 20)
    assert not sinks.write_live(live([1.0], [0.0], [inf], [0.0]), base, "r1", 20)
    assert not sinks.write_live(live([1.0], [0.0], [nan], [nan]), base, "r1", 20)
    c = spark.createDataFrame([(0, 0, 1.0), (3, 3, 2.0)], "y long, x long, s double")
    assert sinks.write_mosaic(c, base, "r1", 1, (4, 4), (2, 2)) and not sinks.write_mosaic(c, base, "r1", 1024, (4, 4))
    assert spark.read.parquet(sinks.table_path(base, "r1", "mosaics")).count() == 0
    assert sinks.dump_scan(f, f.select("frame_id"), base, "r2", 20, 2)["normalization"] == 16


def test_lookups_and_canvas(spark):
    rows = spark.createDataFrame([("a", "9"), ("a", "10"), ("b", "2")], "name string, v string")
    assert {r["name"]: r["v"] for r in lookup.newest_version(rows, "name", "v").collect()} == {"a": "10", "b": "2"}
    p = spark.createDataFrame([(0, [1, 1, 1, 1], 5.0, 5.0), (1, [3, 3, 3, 3], 5.0, 6.0)], "frame_id long, px array<bigint>, cy double, cx double")
    canvas = mosaic.scatter_add(p, 2, 2)
    norm = {(r["y"], r["x"]): r["v"] for r in mosaic.normalise(canvas).collect()}
    assert norm[4, 4] == 1 and norm[4, 5] == 2 and norm[5, 6] == 3
    exact = {(r["y"], r["x"]): r["v"] for r in mosaic.stitch_interpolated(p.where("frame_id = 0").withColumn("cy", F.lit(5.5)).withColumn("cx", F.lit(5.5)), 2, 2).collect()}
    assert exact == {(5, 5): 1, (5, 6): 1, (6, 5): 1, (6, 6): 1}


def test_engine_and_settings(spark, tmp_path):
    s = Settings(spark, f"{tmp_path}/settings")
    assert s.get("a") is None
    s.put("a", "1")
    s.put("a", "2")
    assert s.get("a") == "2"
    engine = Engine(spark, lambda sp, c: [])
    with pytest.raises(ValueError, match="lacks"):
        engine.start({"scan_num": "1"})
    engine.start(dict.fromkeys(T.REQUIRED_FIELDS, "1"))
    assert engine.config["nx"] == 1 and engine.status() == "idle"
    engine.stop()
