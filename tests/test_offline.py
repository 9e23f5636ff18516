"""The offline dump, configuration texts and grown windows."""

import configparser
import json

import numpy as np

from scanloom.functions import geometry as G
from scanloom.functions import text as T
from scanloom.sources import sinks


def test_offline_dump_with_every_step(spark, tmp_path):
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 200, (7, 6, 5))
    raw[0, 2, 2], raw[1, 3, 3], raw[2, 0, 0] = 65535, 300, 5000  # saturated, hot, and outside of the region
    frames = spark.createDataFrame([(i, raw[i].ravel().tolist()) for i in range(7)], "frame_id long, px array<bigint>")
    samples = spark.createDataFrame([(k, 2000.0 + k, 3000.0 + k * k) for k in range(13)], "sample long, x double, y double")
    scan = sinks.OfflineScan(6, 5, (1, 5, 1, 4), orientation="transpose", hot=250, bad=(4,), x_ratio=0.5, y_ratio=2.0, x_way=-1, angle=-50.0, meta={"lambda_nm": 0.1})
    meta = sinks.write_offline(frames, samples.where("sample < 13"), str(tmp_path), "r", scan)
    read = lambda kind: spark.read.parquet(sinks.table_path(str(tmp_path), "r", kind))
    want = {}
    for i in range(7):
        c = raw[i][::-1][1:5, 1:4].astype(int)
        c[c == 65535] = 0
        c[c > 250] = 0
        around = np.sort(c[0:3, 0:3].ravel())
        c[1, 1] = around[4]
        want[i] = c.T.ravel().tolist()
    assert {r["frame_id"]: list(r["dp"]) for r in read("frames").collect()} == want
    cropped = raw[:, ::-1][:, 1:5, 1:4]
    assert meta["normalization"] == cropped[cropped <= 250].max() and (meta["nx"], meta["ny"]) == (4, 3)
    stored = {k: json.loads(v) for k, v in read("run").first()["metadata"].items()}
    assert stored == meta and stored["lambda_nm"] == 0.1 and stored["dp_orient"] == "transpose"
    at = {r["frame_id"]: (r["slow_um"], r["fast_um"]) for r in read("positions").collect()}
    for i in range(7):  # 13 samples for 7 frames: one a frame
        assert np.allclose(at[i], (2.0 * (3000 + i * i), 0.5 * (2000 + i) * np.sin(np.radians(50))))


def test_offline_positions_that_are_um_or_missing(spark, tmp_path):
    frames = spark.createDataFrame([(i, [0]) for i in range(4)], "frame_id long, px array<bigint>")
    samples = spark.createDataFrame([(k, 10.0 + k, -5000.0) for k in range(9) if k != 4], "sample long, x double, y double")
    scan = sinks.OfflineScan(1, 1, (0, 1, 0, 1), flip="identity", x_ratio=3.0, x_way=-1)
    out = {r["frame_id"]: (r["slow_um"], r["fast_um"]) for r in sinks.offline_positions(frames, samples, scan).collect()}
    assert out == {0: (-5000.0, 10.5), 1: (-5000.0, 12.5), 2: (None, None), 3: (-5000.0, 16.5)}
    none = samples.where("false")
    assert {r["slow_um"] for r in sinks.offline_positions(frames, none, scan).collect()} == {None}
    assert sinks.write_offline(frames.where("false"), none, str(tmp_path), "empty", scan)["normalization"] == 0.0


def test_configuration_as_ini():
    text = T.gui_ini({"scan_num": "320045", "nx": 128, "note": "a = b"})
    parser = configparser.ConfigParser()
    parser.read_string(text)
    assert dict(parser["GUI"]) == {"scan_num": "320045", "nx": "128", "note": "a = b"}
    assert T.gui_ini({}) == "[GUI]\n"


def test_headroom_windows():
    assert G.headroom_window(10, 20, 5, 9, 3, 22, 30) == (7, 22, 2, 12)
    assert G.headroom_window(10, 20, 5, 9, 0, 22, 30) == (10, 20, 5, 9)
    assert G.headroom_window(10, 20, 5, 9, -1, 22, 30) == (0, 22, 0, 30)
