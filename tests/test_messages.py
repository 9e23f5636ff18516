"""Message logs, compressed payloads, CBOR."""

import json
import tracemalloc
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.sources import codecs, frames
from scanloom.sources.messages import MessageLog, segments

PACK = "parts array<binary>"


@pytest.fixture(scope="module")
def log(spark):
    spark.dataSource.register(MessageLog)
    return spark


def frame(n, payload=b"\x01\x00\x02\x00"):
    about = {"htype": "dimage_d-1.0", "encoding": "raw", "shape": [2, 1], "type": "uint16"}
    return [json.dumps({"frame": n, "series": 1}).encode(), json.dumps(about).encode(), payload]


def write(spark, path, rows, tasks=1):
    df = spark.createDataFrame([(list(r),) for r in rows], PACK).coalesce(1)
    (df if tasks == 1 else df.repartition(tasks)).write.format("scan_messages").mode("append").save(path)


def numbers(df):
    return sorted(json.loads(r["header"])["frame"] for r in df.select("header").collect())


# ---------------------------------------------------------------- codecs
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("shuffled", [True, False])
def test_payload_round_trip(kind, shuffled):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 60_000, n).astype(kind) for n in (0, 1, 7, 8, 64, 4095, 4096, 4097, 9999)] + [np.zeros(5000, kind)]
    out = codecs.decompress([codecs.compress(x, shuffled) for x in images], np.dtype(kind), shuffled)
    assert all(np.array_equal(a, b) for a, b in zip(out, images))


def test_bit_planes_are_in_their_public_order():
    # one block of 8 elements: byte r has bit r of each of them, the first element in the lowest bit
    px = np.array([1, 2, 4, 8, 0, 0, 0, 0x8000], "<u2")
    planes = codecs._shuffle(px[None])[0]
    assert planes.tolist() == [1, 2, 4, 8] + [0] * 11 + [128]


def test_damaged_payloads_are_errors():
    whole = codecs.compress(np.arange(5000, dtype="<u2"), True)
    for bad in (b"", whole[:11], whole[:-1], whole + b"x", whole[:12] + b"\xff\xff\xff\xff" + whole[16:], whole[:16] + bytes(300) + whole[316:]):
        with pytest.raises(ValueError):
            codecs.decompress([bad], np.dtype("<u2"), True)


def test_cbor_values_and_errors():
    value = {"a": [0, 23, 24, 255, 256, 70_000, 1 << 40, -1, -500, 1.5, None, True, False], "é": {"b": b"\x00\x01"}, "t": []}
    assert codecs.read_cbor(codecs.write_cbor(value)) == value
    assert codecs.read_cbor(b"\x9f\x01\x5f\x41\x41\x41\x42\xff\xff") == [1, b"AB"] and codecs.read_cbor(b"\xf9\x3c\x00") == 1.0
    assert codecs.read_cbor(b"\xbf\x61\x61\x01\xff") == {"a": 1}
    for bad in (b"", b"\x01\x01", b"\x1c", b"\x42\x00", b"\x82\x01", b"\x9f\x01", b"\x81\xff"):
        with pytest.raises(ValueError):
            codecs.read_cbor(bad)


def test_cbor_frames(spark):
    df = spark.createDataFrame([(i, [i, 70_000, 2, 3, 4, 5]) for i in range(5)], "frame_id long, px array<bigint>")
    for how in (None, "lz4", "bslz4"):
        out = frames.decode_cbor(frames.encode_cbor(df, 2, 3, how)).collect()
        assert sorted((r["frame_id"], r["rows"], r["cols"], tuple(r["px"])) for r in out) == [(i, 2, 3, (i, 70_000, 2, 3, 4, 5)) for i in range(5)]
    start = spark.createDataFrame([(bytearray(codecs.write_cbor({"type": "start"})),), (None,)], "value binary")
    assert frames.decode_cbor(start).count() == 0
    body = lambda tag: codecs.write_cbor({"type": "image", "image_id": 1, "data": {"threshold_1": codecs.Tagged(40, [[1, 2], codecs.Tagged(tag, b"\x01\x00\x02\x00")])}})
    assert codecs.image_of(codecs.read_cbor(body(69)), "threshold_1")[3].tolist() == [1, 2]
    with pytest.raises(ValueError):
        codecs.image_of(codecs.read_cbor(body(71)), "threshold_1")
    with pytest.raises(Exception, match="cannot be read"):
        frames.decode_cbor(spark.createDataFrame([(bytearray(body(71)),)], "value binary")).collect()


def test_compressed_frames_of_mixed_kinds(spark):
    df = spark.createDataFrame([(i, [i * 300 + k for k in range(64)]) for i in range(20)], "frame_id long, px array<bigint>")
    mixed = frames.encode_frames(df, 8, 8)
    for encoding, kind in (("bs16-lz4<", "uint16"), ("bs32-lz4<", "uint32"), ("lz4<", "uint16")):
        mixed = mixed.unionByName(frames.compress_frames(df, 8, 8, encoding, kind))
    out = frames.decode_frames(mixed).collect()
    assert len(out) == 80 and all(list(r["px"]) == [r["frame_id"] * 300 + k for k in range(64)] for r in out)
    damaged = frames.compress_frames(df, 8, 8).withColumn("payload", F.expr("substring(payload, 1, length(payload) - 2)"))
    with pytest.raises(Exception, match="ends early"):
        frames.decode_frames(damaged).collect()
    with pytest.raises(Exception, match="for a frame of"):
        frames.decode_frames(frames.encode_frames(df, 8, 7)).collect()


def test_frames_of_a_batch_are_unpacked_in_runs(spark):
    alive = []

    def counting(raw, dtype, n):
        image = np.full(n, 1 + sum(r() is not None for r in alive), dtype)
        alive.append(weakref.ref(image))
        return image

    about = json.dumps({"htype": "dimage_d-1.0", "encoding": "counting", "shape": [256, 256], "type": "uint16"})
    df = spark.range(0, 40, 1, 1).select(F.format_string('{"frame": %d, "series": 1}', "id").alias("header"), F.lit(about).alias("description"), F.lit(b"x").alias("payload"))
    out = frames.decode_frames(df, {"counting": counting}).select("frame_id", F.size("px").alias("n"), F.array_max("px").alias("alive")).collect()
    assert sorted((r["frame_id"], r["n"]) for r in out) == [(i, 65536) for i in range(40)]
    assert max(r["alive"] for r in out) <= 5  # 4 make a run; 40 with whole batches


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_bits_are_spread_out_by_parts(kind):
    px = np.tile(np.arange(4096, dtype=kind), 1 << 10)
    payload = codecs.compress(px, True)
    tracemalloc.start()
    try:
        (out,) = codecs.decompress([payload], np.dtype(kind), True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(out, px) and peak < 6 * px.nbytes  # 11 times with all bits at once


def test_runs_lose_no_frame(spark, monkeypatch):
    monkeypatch.setattr(frames, "AT_ONCE", 200)
    assert list(frames._runs(np.array([64, 64, 64, 64, 400, 0, 200, 1]))) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)]
    assert list(frames._runs(np.array([], np.int64))) == []
    want, packed, cbor = [], None, None
    for side in (0, 1, 8, 20):
        rows = [(100 * side + i, [(i * 300 + k) % 65536 for k in range(side * side)]) for i in range(20)]
        want += [(i, side, side, tuple(px)) for i, px in rows]
        df = spark.createDataFrame(rows, "frame_id long, px array<bigint>").coalesce(1)
        for encoding, how in (("bs16-lz4<", "bslz4"), ("lz4<", "lz4")):
            a, b = frames.compress_frames(df, side, side, encoding), frames.encode_cbor(df, side, side, how, "uint16")
            packed, cbor = a if packed is None else packed.unionByName(a), b if cbor is None else cbor.unionByName(b)
    for out in (frames.decode_frames(packed.coalesce(1)), frames.decode_cbor(cbor.coalesce(1))):
        assert sorted((r["frame_id"], r["rows"], r["cols"], tuple(r["px"])) for r in out.collect()) == sorted(2 * want)


def test_pixels_that_cannot_be_packed_are_errors(spark):
    for px, kind, says in (("array(1, null)", "uint16", "missing pixels"), ("null", "uint16", "missing pixels"), ("array(65536)", "uint16", "cannot hold"), ("array(-1)", "uint32", "cannot hold"), ("array(4294967296D)", "uint32", "cannot hold"), ("array(double('nan'))", "uint16", "cannot hold")):
        of = "array<double>" if "D" in px or "double" in px else "array<bigint>"
        df = spark.range(2).select(F.col("id").alias("frame_id"), F.expr(f"CAST({px} AS {of})").alias("px"))
        for out in (frames.compress_frames(df, 1, 1, "bs16-lz4<", kind), frames.encode_cbor(df, 1, 1, "bslz4", kind)):
            with pytest.raises(Exception, match=says):
                out.collect()


# ---------------------------------------------------------------- the log
def test_log_passes_over_what_is_no_frame(log, tmp_path):
    path = f"{tmp_path}/log"
    write(log, path, [[b"\xff\x00 noise", b'{"series": 1}'], frame(0), [b"{broken"], frame(1)[:2], frame(2), frame(3)[:1], frame(4), [b"tail"]])
    df = log.read.format("scan_messages").load(path)
    assert numbers(df) == [0, 2, 4]
    assert sorted(r["frame_id"] for r in frames.decode_frames(df).collect()) == [0, 2, 4]


def test_frames_reach_over_segments_and_tasks(log, tmp_path):
    path = f"{tmp_path}/log"
    for n in range(7):
        for part in frame(n):  # a segment a message
            write(log, path, [[part]])
    assert [s[:2] for s in segments(path)] == [(k, 1) for k in range(21)]
    assert numbers(log.read.format("scan_messages").option("messages_per_task", 2).load(path)) == list(range(7))
    write(log, path, [frame(n) for n in range(7, 30)])
    assert numbers(log.read.format("scan_messages").option("messages_per_task", 5).load(path)) == list(range(30))


def test_a_gap_or_an_empty_folder_ends_the_log(log, tmp_path):
    path = f"{tmp_path}/log"
    assert log.read.format("scan_messages").load(path).count() == 0
    for n in range(3):
        write(log, path, [frame(n)])
    (tmp_path / "log" / "segment-0000000001-3.log").rename(tmp_path / "log" / "_gone")
    assert numbers(log.read.format("scan_messages").load(path)) == [0]


def test_failed_tasks_leave_nothing(log, tmp_path):
    path = f"{tmp_path}/log"
    write(log, path, [frame(0)])
    bad = log.range(4, numPartitions=4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.array(F.lit(b"x"))).cast("array<binary>").alias("parts"))
    with pytest.raises(Exception):
        bad.write.format("scan_messages").mode("append").save(path)
    assert [s[:2] for s in segments(path)] == [(0, 3)]
    with pytest.raises(Exception, match="appended"):
        log.createDataFrame([([b"x"],)], PACK).write.format("scan_messages").mode("overwrite").save(path)


def test_stream_in_bounded_batches_goes_on_after_restarts(log, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    sizes = []

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        sizes.append(log.read.parquet(f"{out}/batch={batch}").count())

    def run():
        s = log.readStream.format("scan_messages").options(max_messages="12", messages_per_task="5", state=f"{tmp_path}/given").load(path)
        q = s.writeStream.option("checkpointLocation", f"{tmp_path}/check").foreachBatch(keep).start()
        q.processAllAvailable()
        q.stop()

    write(log, path, [frame(n) for n in range(10)])
    run()
    write(log, path, [frame(n) for n in range(10, 17)])
    run()
    run()  # nothing new
    write(log, path, [frame(17)[:2]])
    run()  # a frame that is not whole yet
    write(log, path, [frame(17)[2:], frame(18)])
    run()
    assert numbers(log.read.parquet(out)) == list(range(19)) and max(sizes) <= 4 and len(sizes) > 4


def test_stream_takes_all_without_a_bound_and_deletes_what_was_read(log, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"

    def run():
        s = log.readStream.format("scan_messages").option("delete_read", "true").option("kind", "encoder").load(path)
        s.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()

    for k in range(3):
        write(log, path, [[json.dumps({"msg_type": "data", "n": 10 * k + i}).encode()] for i in range(10)])
        run()
    assert sorted(json.loads(r["value"])["n"] for r in log.read.parquet(out).collect()) == list(range(30))
    assert [s[0] for s in segments(path)][0] > 0
    with pytest.raises(Exception, match="state"):
        log.readStream.format("scan_messages").option("max_messages", "5").load(path).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c2").start().processAllAvailable()


def test_a_reader_begins_near_its_message(spark, tmp_path, monkeypatch):
    """A task that reads from message 990 of 1,000 on walks over no more than 100; without the noted places it walks all."""
    import pyarrow.fs

    from scanloom.sources import messages

    spark.dataSource.register(messages.MessageLog)
    path = f"{tmp_path}/log"
    rows = spark.createDataFrame([([b"m%d" % i],) for i in range(1000)], "parts array<binary>").coalesce(1)
    rows.write.format("scan_messages").mode("append").save(path)
    (_, n, file), reads = messages.segments(path)[0], []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *e):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            reads.append(at)
            return self.f.read_at(n, at)

    local = pyarrow.fs.LocalFileSystem()

    class Files:
        get_file_info = staticmethod(local.get_file_info)
        open_input_file = staticmethod(lambda p: Counted(local.open_input_file(p)))

    monkeypatch.setattr(messages, "_folder", lambda p: (Files, p))
    last = [b"m%d" % i for i in range(990, 1000)]
    assert n == 1000 and list(messages.read_messages(path, file, 990)) == last and len(reads) <= 1 + 100 + 10
    local.delete_file(messages._places(file))
    assert list(messages.read_messages(path, file, 990)) == last
