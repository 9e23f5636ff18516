"""Gates with missing numbers, the solver's probe and its end, buffers, and what fails early."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import geometry as G
from scanloom.functions import text as T
from scanloom.operators import align, lines, mosaic, recon
from scanloom.plans.session import Engine, Settings
from scanloom.sources import sinks

NAN = float("nan")


def track(spark, n=900, missing=True):
    rows = [(i, NAN if missing and i % 50 == 0 else i * 0.01 + (4.0 if i < 40 else 0.0), float(i * 37 % 101) / 5) for i in range(n)]
    return spark.createDataFrame(rows, "frame_id long, u double, v double")


def test_slow_axis_is_the_same_with_missing_numbers(spark):
    whole, some = (lines.slow_axis(track(spark, missing=m), ("u", "v"), span=20.0) for m in (False, True))
    for name, (a, b), tol in (whole, some):
        assert name == "u" and tol == 1.0 and abs(a) < 1e-9 and abs(b - 0.01) < 1e-12
    seen = lines.slow_axis(track(spark), ("u", "v"))
    assert seen[0] == "u" and seen[2] == 1.0 and abs(seen[1][1] - 0.01) < 1e-12
    assert lines.slow_axis(track(spark).where("frame_id < 100"), ("u", "v")) is None
    assert lines.slow_axis(track(spark).select("frame_id", F.lit(None).cast("double").alias("u"), "v"), ("u", "v")) is None


def test_slow_axis_is_no_column_that_hardly_moves(spark):
    """Every value of v is within the tolerance of a flat line, more than the share of u, which has stale frames."""
    df = track(spark, missing=False).select("frame_id", (F.col("u") + F.when(F.col("frame_id") % 25 == 0, 20.0).otherwise(0.0)).alias("u"), (F.col("frame_id") * 37 % 101 / 101).alias("v"))
    name, (a, b), tol = lines.slow_axis(df, ("u", "v"), span=20.0)
    assert name == "u" and abs(b - 0.01) < 1e-9
    pdf = df.toPandas()
    found = lines.slow_axis_points(pdf.frame_id.to_numpy(float), [pdf.u.to_numpy(), pdf.v.to_numpy()], 20.0, 512, 0.6)
    assert found[0] == 0 and abs(found[2] - 0.01) < 1e-9


def test_line_of_points_equals_the_line_of_rows(spark):
    df = track(spark, missing=False)
    pdf = df.toPandas()
    a, b = lines.fit_points(pdf.frame_id.to_numpy(float), pdf.u.to_numpy(), 1.0, 512)
    c, d = lines.fit_line(df, "u", 1.0)
    assert abs(a - c) < 1e-9 and abs(b - d) < 1e-12


def scan(n=8, h=20, w=24, seed=1):
    rng = np.random.default_rng(seed)
    truth = np.exp(1j * rng.normal(0, 0.3, (h, w)))
    probe = np.exp(-((np.mgrid[0:n, 0:n] - 3.5) ** 2).sum(axis=0) / 12).astype(complex)
    places = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(0, 13, 2) for b in range(0, 17, 2))]
    rows = [(i, np.abs(np.fft.fft2(probe * truth[a : a + n, b : b + n], norm="ortho")).ravel().tolist(), a, b) for i, a, b in places]
    return rows, probe, recon.SolverConfig(n, h, w)


SCHEMA = "frame_id long, amp array<double>, y0 int, x0 int"


def test_solver_updates_the_probe_from_its_third_iteration(spark):
    rows, probe, config = scan()
    wrong = probe * np.exp(0.2j * np.arange(8))
    kept = []
    obj, found, errors = recon.reconstruct(spark.createDataFrame(rows, SCHEMA), config, wrong, iterations=4, on_snapshot=lambda it, o, p: kept.append(p), every=1)
    assert (kept[0] == wrong).all() and (kept[1] == wrong).all() and np.abs(kept[2] - wrong).max() > 1e-3
    o, p, n, top = recon.start_object(config), wrong, config.n, max(max(r[1]) for r in rows)
    for it in range(4):
        up, norm, pup, pnorm = np.zeros_like(o), np.zeros(o.shape), np.zeros((n, n), complex), np.zeros((n, n))
        for _, amp, a, b in rows:
            patch = o[a : a + n, b : b + n]
            far = np.fft.fft2(p * patch, norm="ortho")
            back = np.fft.ifft2(recon.ml_amplitude(np.abs(far), np.reshape(amp, (n, n)), "poisson", 25.0 / top, 0.1) * np.exp(1j * np.angle(far)), norm="ortho")
            up[a : a + n, b : b + n] += np.conj(p) * back
            norm[a : a + n, b : b + n] += np.abs(p) ** 2
            pup += np.conj(patch) * back
            pnorm += np.abs(patch) ** 2
        o = up / (norm + config.alpha)
        p = pup / (pnorm + config.alpha) if it >= 2 else p
    assert np.abs(obj - o).max() < 1e-9 and np.abs(found - p).max() < 1e-9


def test_solver_ends_after_the_points_have_stopped_growing(spark):
    rows, probe, config = scan()
    config = recon.SolverConfig(config.n, config.height, config.width, ends_after=2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(recon.reconstruct(df, config, probe, iterations=20)[2]) == 3
    grows = lambda it: df.where(F.col("frame_id") < (20 if it < 2 else 63))
    assert len(recon.reconstruct(grows, config, probe, iterations=20)[2]) == 5


def test_sequential_engine_with_a_probe_that_moves():
    rows, probe, config = scan()
    amps, y0, x0 = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
    wrong = np.roll(probe, (1, -1), axis=(0, 1))
    _, same, held = recon.sequential_scan(amps, y0, x0, wrong, config, 6, 1.0, 0.0)
    _, moved, updated = recon.sequential_scan(amps, y0, x0, wrong, config, 6, 1.0, 0.5)
    assert (same == wrong).all() and updated[-1] < held[0] and np.abs(moved - wrong).max() > 1e-3
    assert recon.roll_centroid(np.abs(moved) ** 2) == (0, 0)


def test_buffers_of_several_scans(spark, tmp_path):
    base = str(tmp_path)
    f = spark.range(10).select(F.col("id").alias("frame_id"), F.array(F.col("id") * 4, F.lit(9)).alias("px"))
    r = f.select("frame_id", F.array(F.lit(0.5)).alias("amp"), F.array(F.col("frame_id") * 1.0).alias("phase"))
    for scan_seq, n in ((0, 10), (1, 4)):
        sinks.write_detector(f.where(F.col("frame_id") < n), base, "r", 0, stride=2, scan_seq=scan_seq)
        sinks.write_inference(r.where(F.col("frame_id") < n), base, "r", 0, stride=2, scan_seq=scan_seq)
    assert [sinks.read_buffer(spark, base, "r", "diffraction", k).count() for k in (0, 1)] == [5, 2]
    pairs = sinks.read_buffer(spark, base, "r", "inference", 1).join(sinks.read_buffer(spark, base, "r", "diffraction", 1), "row").collect()
    assert sorted((x["row"], x["phase"][0]) for x in pairs) == [(0, 0.0), (1, 2.0)]
    for k in (0, 1, 1):
        sinks.write_batch(r.where(F.col("frame_id") == k), base, "r", k)
    assert spark.read.parquet(f"{base}/run_uid=r/vit_history").count() == 2
    assert [x["batch_no"] for x in spark.read.parquet(f"{base}/run_uid=r/vit_latest").collect()] == [1]


def test_final_and_live_results(spark, tmp_path):
    base = str(tmp_path)
    sinks.start_run(spark, base, "r", {"n": 1})
    row = lambda v: spark.createDataFrame([([3.0, v], [4.0, 0.0], [1.0], [0.0])], "probe_re array<double>, probe_im array<double>, obj_re array<double>, obj_im array<double>")
    assert not sinks.write_final(row(NAN), base, "r", 7) and not spark.read.parquet(f"{base}/run_uid=r/run").first()["complete"]
    assert sinks.save_live(row(1.0), base, "r", 3) and spark.read.parquet(f"{base}/run_uid=r/live").first()["probe_amp"] == [5 * 256.0, 256.0]
    assert sinks.write_final(row(1.0), base, "r", 7)
    done = spark.read.parquet(f"{base}/run_uid=r/run").first()
    assert done["complete"] and done["metadata"]["iterations"] == "7"
    assert not sinks.save_live(row(1.0), "no-such-scheme://x", "r", 1)


def test_positions_in_metres_and_published_files(spark, tmp_path):
    sinks.write_positions(spark.createDataFrame([(1, 2.0, 3.0)], "frame_id long, slow_um double, fast_um double"), str(tmp_path), "r")
    r = spark.read.parquet(f"{tmp_path}/run_uid=r/positions").first()
    assert (r["x_m"], r["y_m"]) == (2e-6, 3e-6)
    n = sinks.publish(spark.range(25).toDF("n"), f"{tmp_path}/in", "n", 10)
    back = spark.read.parquet(f"{tmp_path}/in")
    assert n == 3 and sorted((x["file_no"], x["count"]) for x in back.groupBy("file_no").count().collect()) == [(0, 10), (1, 10), (2, 5)]
    q = spark.readStream.schema("n long").parquet(f"{tmp_path}/in").writeStream.format("memory").queryName("published_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("published_rows").count() == 25
    assert sinks.publish(spark.range(0).toDF("n"), f"{tmp_path}/none", "n", 10) == 0


def test_archive_centres_a_smaller_scan(spark, tmp_path):
    canvas = spark.createDataFrame([(0, 0, 1.0), (1, 2, 2.0)], "y long, x long, v double")
    assert sinks.write_mosaic(canvas, str(tmp_path), "r", 1, (2, 3), (6, 7))
    got = spark.read.parquet(f"{tmp_path}/run_uid=r/mosaics").collect()
    assert sorted((r["scan_seq"], r["y"], r["x"], r["v"]) for r in got) == [(1, 2, 2, 1.0), (1, 3, 4, 2.0)]
    assert not sinks.write_mosaic(canvas, str(tmp_path), "r", 1024, (2, 3))


def test_orientation_waits_for_positions(spark):
    frames = spark.createDataFrame([(i, [float(k) for k in range(4)]) for i in range(80)], "frame_id long, px array<double>")
    places = spark.createDataFrame([(i, 1.0 if i % 2 else NAN, 0.0) for i in range(80)], "frame_id long, x double, y double")
    score = lambda px, x, y: F.get(px, F.lit(0)) + x
    assert recon.detect_orientation(frames, places, 2, score) is None
    found = recon.detect_orientation(frames, places, 2, score, least=40).collect()
    assert [(r["name"], r["score"]) for r in found[:2]] == [("identity", 1.0), ("transpose", 1.0)] and found[-1]["score"] == 4.0


def test_capacity_units_and_lockstep(spark):
    p = spark.createDataFrame([(i, 2.0 * i) for i in range(10)], "frame_id long, x double")
    assert [r["frame_id"] for r in align.within_capacity(p, 8, loaded=5).collect()] == [0, 1, 2]
    got = p.select(G.as_counts(F.col("x"), F.col("frame_id") < 5, 0.5, -1).alias("c")).collect()
    assert [r["c"] for r in got] == [-4.0 * i for i in range(5)] + [2.0 * i for i in range(5, 10)]
    patches = spark.createDataFrame([(5.0, 5.0, [1.0] * 4, [2.0] * 4), (5.0, 5.0, [9.0] * 4, None)], "cy double, cx double, amp array<double>, phase array<double>")
    rows = mosaic.scatter_add_all(patches, 2, 2, ("amp", "phase")).collect()
    assert len(rows) == 4 and {(r["c"], r["s_amp"], r["s_phase"]) for r in rows} == {(1, 1.0, 2.0)}


def test_engine_tells_why_a_query_failed(spark, tmp_path):
    def build(session, config):
        def boom(df, batch):
            raise ValueError("a bad batch")

        spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/in")
        q = session.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(boom).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.awaitTermination(60)
        except Exception:
            pass
        return [q]

    engine = Engine(spark, build)
    with pytest.raises(Exception, match="a bad batch"):
        engine.start(dict.fromkeys(T.REQUIRED_FIELDS, "1"), ready_within=5)
    assert engine.status() == "failed"


def test_engine_runs_and_stops(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    build = lambda s, c: [s.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").start()]
    engine = Engine(spark, build)
    engine.start(dict.fromkeys(T.REQUIRED_FIELDS, "1"))
    assert engine.status() == "running"
    with pytest.raises(RuntimeError, match="under way"):
        engine.start(dict.fromkeys(T.REQUIRED_FIELDS, "1"))
    engine.stop(drain=True)
    assert engine.status() == "finished"


def test_settings_of_odd_names(spark, tmp_path):
    s = Settings(spark, f"{tmp_path}/settings")
    s.put("it's", "x")
    assert s.get("it's") == "x" and s.get("' OR '1' = '1") is None
