"""The solver on object tiles against the one on a canvas; exact quantiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import mosaic, object_tiles, quantiles, recon

KIND = "frame_id long, amp array<double>, y0 int, x0 int"


@pytest.mark.parametrize("n, mode", [(16, "poisson"), (80, "poisson")])
def test_tiled_solver_equals_the_canvas(spark, n, mode):
    """Windows in and across tiles, one larger than a tile, and a dwell of many frames on one place."""
    rng = np.random.default_rng(0)
    h, w = 150, 170
    places = [(int(rng.integers(0, h - n)), int(rng.integers(0, w - n))) for _ in range(25)] + [(3, 5)] * 10
    rows = [(i, rng.uniform(0.1, 3, n * n).tolist(), y, x) for i, (y, x) in enumerate(places)]
    df = spark.createDataFrame(rows, KIND)
    config = recon.SolverConfig(n, h, w, mode=mode, start_probe_update=1)
    probe = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
    obj, p, errors = recon.reconstruct(df, config, probe, iterations=3)
    tiles, q, found = object_tiles.reconstruct_tiled(df, config, probe, iterations=3)
    assert np.allclose(found, errors, rtol=1e-9) and np.allclose(q, p, rtol=1e-7, atol=1e-9)
    pixels = object_tiles.object_pixels(tiles, config.alpha).collect()
    got = np.zeros((h, w), complex)
    for r in pixels:
        got[r["y"], r["x"]] = r["re"] + 1j * r["im"]
    assert len(pixels) == np.count_nonzero(obj) and np.allclose(got, obj, rtol=1e-7, atol=1e-9)


def test_packs_split_a_dwell_and_keep_every_frame(spark):
    df = spark.createDataFrame([(i, [float(i)] * 4, 3 if i < 50 else i, 3) for i in range(90)], KIND)
    rows = object_tiles.packed(df, 2, pack=4).collect()
    assert max(len(r["y0"]) for r in rows) <= 4
    frames = sorted(v for r in rows for v in np.frombuffer(r["amp"], float)[::4])
    assert frames == [float(i) for i in range(90)]
    assert object_tiles.reconstruct_tiled(df.where("false"), recon.SolverConfig(2, 100, 100), np.ones((2, 2), complex))[2] == []


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    qs = (0.0, 0.02, 0.5, 0.98, 1.0)
    sets = {"a": rng.normal(size=1001) * 10.0 ** rng.integers(-300, 300, 1001), "b": np.repeat([3.0, -0.0, 0.0, -5.5], 50), "c": np.array([7.0]), None: np.arange(10.0), "d": np.array([np.inf, -np.inf, 1.0])}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in quantiles.exact_table(df, "v", qs, ("k",)).collect()}
    assert set(got) == set(sets)
    for k in ("a", "b", "c", None):
        assert np.allclose(got[k], np.quantile(sets[k], qs), rtol=1e-12), k
    assert got["d"][2] == 1.0
    assert quantiles.exact(df.where("k = 'none'"), "v", qs) is None
    assert quantiles.exact(df.where("k = 'c'"), "v", (0.5,)) == (7.0,)


def test_normalise_by_keys_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 0, 0, 4.0, 2), ("a", 0, 1, 9.0, 3), ("a", 0, 2, 5.0, 1), (None, 0, 0, 8.0, 2), (None, 1, 1, 1.0, 1), ("z", 0, 0, 1.0, 1)], "k string, y int, x int, s double, c int")
    out = {(r["k"], r["y"], r["x"]): r["v"] for r in mosaic.normalise(df, 2, ("k",)).collect()}
    assert out == {("a", 0, 0): 2.0, ("a", 0, 1): 3.0, ("a", 0, 2): 2.5, (None, 0, 0): 4.0, (None, 1, 1): 4.0, ("z", 0, 0): None}
    plan = mosaic.normalise(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()
    assert mosaic.normalise(df.where("false"), 2).count() == 0
    assert mosaic.percentile_stretch(df.where("false"), "s").first()["p50"] is None
    assert df.agg(F.count("*")).first()[0] == 6
