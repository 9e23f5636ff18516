"""Streams under shuffled and late arrival give what the batch forms give."""

from pyspark.sql import functions as F

import time

import numpy as np
import pytest

from scanloom.functions.text import REQUIRED_FIELDS
from scanloom.operators import align, mosaic, tiles
from scanloom.plans.session import Engine
from scanloom.sources import sinks
from scanloom.streaming.latches import auto_centre, orientation, oriented
from scanloom.streaming.mosaics import LiveMosaic, archive_ended
from scanloom.streaming.pipelines import Progress, drain, fan_out, live_mosaic, until
from scanloom.streaming.stateful import in_order, join_late, min_points, release_prefix, scan_ends, slow_gate, split_scans, state_store


def files(spark, tmp_path, name, df, parts, schema):
    path = f"{tmp_path}/{name}"
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_mosaic_with_late_positions(spark, tmp_path):
    f = spark.range(30).select(F.col("id").alias("frame_id"), F.array(*[(F.col("id") + k) for k in range(4)]).alias("px"))
    p = spark.range(25).select(F.col("id").alias("frame_id"), (F.col("id") % 7 + 3.0).alias("cy"), (F.col("id") % 5 + 3.0).alias("cx"))
    frames = files(spark, tmp_path, "f", f, 4, "frame_id long, px array<bigint>")
    places = files(spark, tmp_path, "p", p, 3, "frame_id long, cy double, cx double")
    got = live_mosaic(frames, places, 2, 2).select("y", "x", F.col("s_px").alias("s"), "c")
    want = mosaic.scatter_add(f.join(p, "frame_id"), 2, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    joined = drain(join_late(files(spark, tmp_path, "f2", f, 3, frames.schema), files(spark, tmp_path, "p2", p, 2, places.schema)), "test-join")
    assert sorted(r["frame_id"] for r in joined.collect()) == list(range(25))


def test_packets_with_a_gap(spark, tmp_path):
    rows = spark.createDataFrame([(1, n, [float(n), 0.5], [float(-n), 1.5]) for n in (3, 0, 1, 5, 6, 1, 2)], "run long, number long, x array<double>, y array<double>")
    strict = drain(in_order(files(spark, tmp_path, "a", rows, 2, rows.schema)), "test-strict")
    assert sorted((r["number"], list(r["x"]), list(r["y"])) for r in strict.collect()) == [(n, [float(n), 0.5], [float(-n), 1.5]) for n in range(4)]
    patient = drain(in_order(files(spark, tmp_path, "b", rows, 1, rows.schema), patience=1), "test-patient")
    assert sorted(r["number"] for r in patient.collect()) == [0, 1, 2, 3, 5, 6]


def test_slow_gate_locks_gives_up_and_lets_the_unknown_pass(spark, tmp_path):
    nan = float("nan")
    rows = [(1, i, nan if i % 20 == 7 else i * 0.1 + (50.0 if i % 20 == 3 else 0.0), float(i * 37 % 101)) for i in range(400)]
    rows += [(2, i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(400)]  # no line: given up
    df = spark.createDataFrame(rows, "run long, frame_id long, u double, v double")
    out = drain(slow_gate(files(spark, tmp_path, "g", df, 8, df.schema), span=100.0, min_frames=100, most_waiting=300), "test-gate").collect()
    assert sorted(r["frame_id"] for r in out if r["run"] == 1) == [i for i in range(400) if i % 20 != 3]
    assert sorted(r["frame_id"] for r in out if r["run"] == 2) == list(range(400))
    held = drain(slow_gate(files(spark, tmp_path, "h", df.where("run = 2"), 4, df.schema), span=100.0, min_frames=100), "test-held")
    assert held.count() == 0


def test_point_gate_and_prefix(spark, tmp_path):
    s = spark.createDataFrame([(r, i, 1.0, 2.0) for r, n in ((1, 5), (2, 6)) for i in range(n)], "run long, sample long, x double, y double")
    out = drain(min_points(files(spark, tmp_path, "s", s, 4, s.schema), 5), "test-points").collect()
    assert sorted((r["run"], r["sample"]) for r in out) == [(2, i) for i in range(6)]
    f = spark.createDataFrame([(1, 10 + i, i) for i in range(8)], "run long, frame_id long, arrival long")
    p = spark.createDataFrame([(1, 10 + i, float(i), 0.0) for i in range(8) if i != 5], "run long, frame_id long, x double, y double")
    out = drain(release_prefix(files(spark, tmp_path, "f3", f, 3, f.schema), files(spark, tmp_path, "p3", p, 4, p.schema)), "test-prefix").collect()
    assert sorted((r["arrival"], r["frame_id"], r["x"]) for r in out) == [(i, 10 + i, float(i)) for i in range(5)]


def test_fan_out_gives_both_writers_the_same_rows(spark, tmp_path):
    src = files(spark, tmp_path, "fan", spark.range(20), 3, "id long")
    seen = ([], [])
    first, second = (lambda df, b, k=k: seen[k].extend(r["id"] for r in df.collect()) for k in (0, 1))
    q = fan_out(src, first, second, f"{tmp_path}/fan-state")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen[0]) == sorted(seen[1]) == list(range(20))


def test_progress_stamps(spark, tmp_path):
    stamps = []
    listener = Progress(lambda name, rows, rate: stamps.append((name, rows)), every=0.0)
    spark.streams.addListener(listener)
    try:
        q = files(spark, tmp_path, "pr", spark.range(30), 3, "id long").writeStream.queryName("counted").format("noop").option("checkpointLocation", f"{tmp_path}/pr-state").start()
        q.processAllAvailable()
        q.stop()
        import time

        end = time.time() + 20
        while time.time() < end and not any(rows == 30 for _, rows in stamps):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert ("counted", 30) in stamps


NAN = float("nan")


def in_turn(spark, tmp_path, name, batches, schema):
    """A stream of one file a batch, in this order."""
    path = f"{tmp_path}/{name}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files go by their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_unknown_positions_are_not_there_yet(spark, tmp_path):
    """NULL, NaN and infinite positions let no frame through, a known one that comes later does; as in the batch form."""
    kind = "frame_id long, cy double, cx double"
    rows = [(0, 1.0, 1.0), (1, None, 1.0), (2, NAN, 1.0), (3, 1.0, float("inf")), (4, 2.0, 2.0), (5, NAN, NAN)]
    f = spark.createDataFrame([(i, [i, i]) for i in range(6)] + [(4, None)], "frame_id long, px array<bigint>")
    p = in_turn(spark, tmp_path, "p", [rows, [(5, 7.0, 8.0)]], kind)
    out = drain(join_late(files(spark, tmp_path, "f", f, 2, f.schema), p), "test-unknown").collect()
    got = sorted((r["frame_id"], r["cy"], r["cx"], r["px"] or []) for r in out)
    assert got == [(0, 1.0, 1.0, [0, 0]), (4, 2.0, 2.0, []), (4, 2.0, 2.0, [4, 4]), (5, 7.0, 8.0, [5, 5])]
    batch = align.ready(f, spark.createDataFrame(rows, kind)).collect()
    assert sorted(r["frame_id"] for r in batch) == [0, 4, 4]


def test_prefix_stops_at_an_unknown_position(spark, tmp_path):
    f = spark.createDataFrame([("a", i, i) for i in range(6)], "run string, frame_id long, arrival long")
    p = spark.createDataFrame([("a", i, NAN if i == 2 else float(i), 0.0) for i in range(6)], "run string, frame_id long, x double, y double")
    out = drain(release_prefix(files(spark, tmp_path, "f", f, 2, f.schema), files(spark, tmp_path, "p", p, 2, p.schema)), "test-stop").collect()
    assert sorted((r["run"], r["frame_id"]) for r in out) == [("a", 0), ("a", 1)]
    want = align.prefix_release(f, p, ("run",)).collect()
    assert sorted(r["frame_id"] for r in want) == [0, 1]


def test_a_new_scan_does_not_take_positions_of_the_old_one(spark, tmp_path):
    keys = ("run", "scan_seq", "frame_id")
    f = in_turn(spark, tmp_path, "f", [[("r", 0, 0, [1])], [("r", 1, 0, [2])]], "run string, scan_seq int, frame_id long, px array<bigint>")
    p = in_turn(spark, tmp_path, "p", [[("r", 0, 0, 5.0, 5.0)], [("r", 0, 9, 0.0, 0.0)], [("r", 1, 0, 9.0, 9.0)]], "run string, scan_seq int, frame_id long, cy double, cx double")
    out = drain(join_late(f, p, keys), "test-scans").collect()
    assert sorted((r["run"], r["scan_seq"], r["px"][0], r["cy"]) for r in out) == [("r", 0, 1, 5.0), ("r", 1, 2, 9.0)]


def test_state_goes_after_its_time(spark, tmp_path):
    kind = "frame_id long, px array<bigint>"
    path, check = f"{tmp_path}/f", f"{tmp_path}/check"
    places = f"{tmp_path}/p"
    spark.createDataFrame([(i, 0.0, 0.0) for i in range(50, 90)], "frame_id long, cy double, cx double").write.parquet(places)

    def run(rows, keep):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        f, p = spark.readStream.schema(kind).parquet(path), spark.readStream.schema("frame_id long, cy double, cx double").parquet(places)
        with state_store(spark, drains=True):
            join_late(f, p, keep_seconds=keep).writeStream.option("checkpointLocation", check).trigger(availableNow=True).format("noop").start().awaitTermination()
        state = lambda var: spark.read.format("statestore").option("stateVarName", var).load(check).count()
        return state("waiting") + state("place")

    assert run([(i, [i]) for i in range(40)], 4.0) == 80
    time.sleep(5)
    assert run([(100, [1])], 4.0) == 1


def test_scans_of_a_run_named_by_text(spark, tmp_path):
    s = in_turn(spark, tmp_path, "s", [[("a", k, n) for k, n in enumerate((0, 1, 2, 0, 1, 0))]], "run string, arrival long, number long")
    out = drain(split_scans(s), "test-split").collect()
    assert sorted((r["run"], r["arrival"], r["scan_seq"]) for r in out) == [("a", k, s) for k, s in enumerate((0, 0, 0, 1, 1, 2))]


def test_three_scans_give_three_archives(spark, tmp_path):
    keys = ("run", "scan_seq")
    f = [("r", s, i, [float(s + 1)] * 4) for s in range(3) for i in range(4)]
    patches = spark.createDataFrame([(*r, 2.0 + r[2], 2.0) for r in f], "run string, scan_seq long, frame_id long, px array<double>, cy double, cx double")
    live = LiveMosaic(spark, f"{tmp_path}/tiles", 2, 2, ("px",), keys, every=2)
    for k in range(5):  # a batch that runs again replaces itself, and sums do not count twice
        live.write(patches.where(F.col("frame_id") % 5 == k), k)
    live.write(patches.where(F.col("frame_id") % 5 == 4), 4)
    want = mosaic.scatter_add_all(patches, 2, 2, ("px",), keys=keys)
    assert sorted(map(tuple, live.canvas().collect())) == sorted(map(tuple, want.collect()))
    s = in_turn(spark, tmp_path, "s", [[("r", 0)], [("r", 0), ("r", 1)], [("r", 2)]], "run string, scan_seq long")
    with state_store(spark):
        q = scan_ends(s, 2.0).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").foreachBatch(archive_ended(live, str(tmp_path), (10, 10), most=1024)).start()
        until(lambda: (tmp_path / "run_uid=r" / "mosaics" / "scan_seq=2" / "_SUCCESS").exists(), q, 90)
        q.stop()
    stored = spark.read.parquet(sinks.table_path(str(tmp_path), "r", "mosaics")).groupBy("scan_seq").agg(F.sum("s_px").alias("s"), F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in stored) == [(0, 16.0, 10), (1, 32.0, 10), (2, 48.0, 10)]


def test_tiles_send_a_row_for_each_tile_and_task(spark):
    """Patches of 20 x 20 on a canvas of four tiles by four, in 4 tasks: no task sends a tile twice, and none sends pixels."""
    p = spark.range(400, numPartitions=4).select(F.array(*[F.lit(1.0)] * 400).alias("px"), (F.col("id") * 37 % 230 + 10.0).alias("cy"), (F.col("id") * 91 % 230 + 10.0).alias("cx"))
    sent = tiles.partial_tiles(p, 20, 20, ("px",))
    assert sent.count() <= 4 * 16
    canvas = mosaic.scatter_add(p, 20, 20)
    assert canvas.agg(F.sum("s"), F.sum("c")).first() == (160_000.0, 160_000)
    assert "Generate" not in canvas._jdf.queryExecution().executedPlan().toString()
    lost = p.withColumn("cy", F.when(F.col("cy") < 100, F.lit(NAN)).otherwise(F.col("cy")))
    assert mosaic.scatter_add(lost, 20, 20).where("y IS NULL").count() == 0
    with pytest.raises(Exception, match="pixels"):
        mosaic.scatter_add(p, 20, 21).collect()


def test_runs_that_share_a_group_of_state_stay_apart(spark, tmp_path, monkeypatch):
    from scanloom.streaming import stateful

    monkeypatch.setattr(stateful, "BUCKETS", 2)
    names = [None, "a", "b", "c", "d"]
    packets = [(r, n, [float(n)], [float(k)]) for k, r in enumerate(names) for n in range(150) if n != (k == 2) * 70 + (k != 2) * -1]
    rows = spark.createDataFrame(packets, "run string, number long, x array<double>, y array<double>")
    strict = drain(in_order(files(spark, tmp_path, "a", rows, 3, rows.schema)), "test-shared").collect()
    want = [p for p in packets if p[0] != "b" or p[1] < 70]
    assert sorted((str(r["run"]), r["number"], r["y"][0]) for r in strict) == sorted((str(r), n, y[0]) for r, n, _, y in want)
    patient = drain(in_order(files(spark, tmp_path, "b", rows, 1, rows.schema), patience=20), "test-shared-2").collect()
    assert sorted((str(r["run"]), r["number"]) for r in patient) == sorted((str(r), n) for r, n, _, _ in packets)
    samples = spark.createDataFrame([(r, i, 1.0, 2.0) for k, r in enumerate(names) for i in range(10 + k)], "run string, sample long, x double, y double")
    out = drain(min_points(files(spark, tmp_path, "s", samples, 4, samples.schema), 11), "test-shared-3").collect()
    assert sorted((r["run"], r["sample"]) for r in out) == [(r, i) for k, r in enumerate(names) if k > 1 for i in range(10 + k)]


def test_frames_in_a_row_share_a_group_of_state(spark, tmp_path):
    kind = "frame_id long, px array<bigint>"
    f = files(spark, tmp_path, "f", spark.createDataFrame([(i, [i]) for i in range(128)], kind), 2, kind)
    p = files(spark, tmp_path, "p", spark.createDataFrame([(200, 0.0, 0.0)], "frame_id long, cy double, cx double"), 1, "frame_id long, cy double, cx double")
    with state_store(spark, drains=True):
        join_late(f, p).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("noop").start().awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/c")
    assert state.count() == 128 and state.select("key").distinct().count() == 2


def test_scattered_patches_send_their_pixels_and_no_more(spark):
    """Each patch lies on a tile of its own, so whole tiles would be 1,024 times its pixels."""
    p = spark.range(300, numPartitions=3).select(F.array(*[F.lit(2.0)] * 4).alias("px"), (F.col("id") * 64 + 10.0).alias("cy"), (F.col("id") * 7 % 11 * 64 + 10.0).alias("cx"))
    sent = tiles.partial_pixels(p, 2, 2, ("px",))
    assert sent.count() == 1200 and sent.agg(F.sum("c"), F.sum("s_px")).first() == (1200.0, 2400.0)
    canvas = mosaic.scatter_add(p, 2, 2)
    assert canvas.count() == 1200 and "binary" not in canvas._jdf.queryExecution().analyzed().treeString() and "tile" not in canvas._jdf.queryExecution().executedPlan().toString()


def test_a_start_waits_for_the_first_look_at_the_source(spark, tmp_path):
    q = lambda s, c: [files(s, tmp_path, "e", s.range(5), 1, "id long").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ec").start()]
    engine = Engine(spark, q)
    engine.start(dict.fromkeys(REQUIRED_FIELDS, "1"))
    assert engine.queries[0].lastProgress is not None
    engine.stop()


def beam(y, x, h=12, w=14):
    px = np.ones((h, w), int)
    px[y - 1 : y + 2, x - 1 : x + 2] = 500
    return px.ravel().tolist()


def test_the_first_frames_decide_the_window(spark, tmp_path):
    """Later frames, whose beam is elsewhere, keep it; a run without a beam keeps its region; one of few frames waits."""
    kind = "run string, frame_id long, px array<bigint>"
    first = [("a", i, beam(7, 3)) for i in range(3)] + [("dark", i, [0] * 168) for i in range(4)] + [("few", 0, beam(5, 5))]
    second = [("a", 3, beam(7, 3)), ("corner", 9, None)] + [("corner", i, beam(1, 12)) for i in range(4)]
    third = [("a", i, beam(2, 10)) for i in range(4, 8)] + [("dark", 8, beam(7, 3))]
    s = in_turn(spark, tmp_path, "s", [first, second, third], kind)
    out = drain(auto_centre(s, 12, 14, (2, 6, 4, 8), least=4, threshold=0.5), "test-centre").collect()
    box = {r: {(x["y0"], x["y1"], x["x0"], x["x1"], x["found"], x["clamped"]) for x in out if x["run"] == r} for r in ("a", "dark", "corner", "few")}
    assert box == {"a": {(6, 10, 2, 6, True, False)}, "dark": {(2, 6, 4, 8, False, False)}, "corner": {(0, 4, 10, 14, True, False)}, "few": set()}
    assert sorted(x["frame_id"] for x in out if x["run"] == "a") == list(range(8))
    for x in out:
        whole = {("a", True): beam(7, 3), ("a", False): beam(2, 10)}.get((x["run"], x["frame_id"] < 4))
        if whole:
            assert list(x["px"]) == np.reshape(whole, (12, 14))[6:10, 2:6].ravel().tolist()
    near = drain(auto_centre(in_turn(spark, tmp_path, "n", [first + second], kind), 12, 14, (2, 6, 4, 8), headroom=1, least=4, threshold=0.5), "test-near").collect()
    assert {(x["y0"], x["x0"], x["clamped"]) for x in near if x["run"] == "a"} == {(3, 3, True)}  # the nearest place in the grown region


def test_orientation_is_decided_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = rng.integers(0, 100, (30, 4, 4))

    def score(px, x, y):  # the second pixel of the right orientation is the frame's x
        return np.abs(px[:, 0, 1] - x)

    def rows(run, i):
        return (run, i, images[i].ravel().tolist())

    truth = oriented(images, "rot90_cw")[:, 0, 1]
    f = in_turn(spark, tmp_path, "f", [[rows("a", i) for i in range(6)], [rows("a", i) for i in range(6, 20)] + [rows("b", i) for i in range(5)]], "run string, frame_id long, px array<bigint>")
    p = in_turn(spark, tmp_path, "p", [[("a", i, float(truth[i]), 0.0) for i in range(10, 30)] + [("a", 3, NAN, 0.0)], [("a", i, float(truth[i]), 0.0) for i in range(4)] + [("b", i, 0.0, 0.0) for i in range(5)]], "run string, frame_id long, x double, y double")
    out = drain(orientation(f, p, (4, 4), score, least=8, most=12), "test-orientation").collect()
    assert {r["run"] for r in out} <= {"a"} and len(out) in (0, 8)  # 12 frames are held; of these at most 6 have positions
    out = drain(orientation(f, p, (4, 4), score, least=5, most=12), "test-orientation-2").collect()
    assert [r["name"] for r in sorted(out, key=lambda r: r["place"]) if r["run"] == "a"][0] == "rot90_cw"
    assert sorted(r["run"] for r in out) == ["a"] * 8 + ["b"] * 8 and {r["frames"] for r in out if r["run"] == "b"} == {5}


def test_stream_symmetries_are_those_of_the_batch(spark):
    from scanloom.functions.arrays import SYMMETRIES, orient

    px = list(range(16))
    row = spark.createDataFrame([(px,)], "px array<bigint>").select(*[orient(F.col("px"), n, 4, 4).alias(n) for n in SYMMETRIES]).first()
    for n in SYMMETRIES:
        assert list(row[n]) == oriented(np.reshape(px, (1, 4, 4)), n).ravel().tolist(), n
