"""Registered streaming queries: each drains its stream, so its rows are those of the batch form.

Sources are shuffled files of which a micro-batch takes two, so rows come in another order than they are numbered and
state has to last from batch to batch."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import SYMMETRIES
from ..operators import lines
from ..plans.catalog import CANVAS, FRAMES, POSITIONS, frames, positions, table
from ..plans.session import delete_at_exit, fresh_path
from ..sources import sinks
from ..sources.frames import compress_frames, decode_frames, encode_frames, packet_messages, parse_packets, samples_of
from ..sources.messages import MessageLog
from ..sources.sinks import table_path
from .latches import auto_centre, orientation
from .mosaics import LiveMosaic, archive_ended
from .pipelines import drain, latest_wins, live_mosaic, published, stream_table, throughput, until, watermarked_join, written
from .stateful import in_order, join_late, min_points, release_prefix, scan_ends, slow_gate, split_scans, state_store

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _frames(spark, sf):
    return published(frames(spark, sf).select("frame_id", "px"), "frames", "frame_id")


@query("stream_stitch", f"WITH {CANVAS} SELECT y, x, s, c FROM canvas")
def stream_stitch(spark, sf):
    places = positions(spark, sf).select("frame_id", F.col("y").alias("cy"), F.col("x").alias("cx"))
    canvas = live_mosaic(_frames(spark, sf), published(places, "positions", "frame_id", 5), 8, 8)
    return canvas.select("y", "x", F.col("s_px").alias("s"), "c")


#: Two runs of two scans each, whose frames are numbered anew in each scan; of ten positions two are unknown.
_SCANS = f"""{FRAMES}, {POSITIONS}, j AS (SELECT 'run ' || grp % 2 AS run, f.frame_id % 2 AS scan_seq, px, f.frame_id AS id, CAST(round_even(y, 0) AS BIGINT) - 4 AS t, CAST(round_even(x, 0) AS BIGINT) - 4 AS l
  FROM f JOIN p USING (frame_id) WHERE f.frame_id % 10 NOT IN (3, 8) AND f.frame_id % 6 <> 5)"""


def _scans(spark, sf):
    """Frames (run, scan_seq, frame_id, amp, phase) and positions (run, scan_seq, frame_id, cy, cx) of those."""
    f = frames(spark, sf).select(F.concat(F.lit("run "), F.col("grp") % 2).alias("run"), (F.col("frame_id") % 2).alias("scan_seq"), F.floor(F.col("frame_id") / 2).alias("no"), "px", F.col("frame_id").alias("id"))
    nan = F.lit(float("nan"))
    where = positions(spark, sf).select(F.col("frame_id").alias("id"), F.when(F.col("frame_id") % 10 == 3, nan).when(F.col("frame_id") % 10 != 8, F.col("y")).alias("cy"), F.col("x").alias("cx"))
    p = f.select("id", "run", "scan_seq", F.col("no").alias("frame_id")).join(where, "id").select("run", "scan_seq", "frame_id", "cy", "cx")
    phase = F.when(F.col("id") % 6 != 5, F.transform("px", lambda v: v % 17))
    return f.select("run", "scan_seq", F.col("no").alias("frame_id"), F.col("px").alias("amp"), phase.alias("phase")), p


@query("stream_mosaics", f"WITH {_SCANS} SELECT run, scan_seq, t + k // 8 AS y, l + k % 8 AS x, count(*) AS c, CAST(sum(px[k + 1]) AS DOUBLE) AS s_amp, CAST(sum(px[k + 1] % 17) AS DOUBLE) AS s_phase FROM j, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2, 3, 4")
def stream_mosaics(spark, sf):
    """Amplitude and phase of several runs and scans in lockstep, with positions that stay unknown."""
    f, p = _scans(spark, sf)
    return live_mosaic(published(f, "frames", "frame_id"), published(p, "positions", "frame_id", 5), 8, 8, "mosaics", ("amp", "phase"), ("run", "scan_seq"), keep_seconds=3600)


@query("stream_archive", f"WITH {_SCANS}, c AS (SELECT run, scan_seq, t + k // 8 AS y, l + k % 8 AS x, sum(px[k + 1]) AS s FROM j, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2, 3, 4) SELECT run, scan_seq, count(*) AS pixels, CAST(sum(s) AS DOUBLE) AS total FROM c WHERE y BETWEEN 0 AND 119 AND x BETWEEN 0 AND 159 GROUP BY 1, 2")
def stream_archive(spark, sf):
    """The canvas of each scan in its run's archive once the scan is over: the last one by the clock."""
    base = fresh_path(spark, "archive")
    f, p = _scans(spark, sf)
    mosaic = LiveMosaic(spark, f"{base}/tiles", 8, 8, ("amp", "phase"), ("run", "scan_seq"), every=2)
    runs = [r["run"] for r in f.select("run").distinct().collect()]  # two
    with state_store(spark, drains=True):
        joined = join_late(published(f, "frames", "frame_id"), published(p, "positions", "frame_id", 5), ("run", "scan_seq", "frame_id"))
        joined.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(mosaic.write).start().awaitTermination()
    with state_store(spark):
        ends = scan_ends(published(f.select("run", "scan_seq"), "scans", "scan_seq", 2), 2.0)
        q = ends.writeStream.option("checkpointLocation", f"{base}/ends").trigger(processingTime="1 second").foreachBatch(archive_ended(mosaic, base, (120, 160))).start()
        until(lambda: all(written(spark, f"{table_path(base, r, 'mosaics')}/scan_seq=1") for r in runs), q, 120)
        q.stop()
    delete_at_exit(spark, base)
    kind = "y bigint, x bigint, c bigint, s_amp double, s_phase double, scan_seq bigint"
    stored = [spark.read.schema(kind).parquet(table_path(base, r, "mosaics")).withColumn("run", F.lit(r)) for r in runs]
    return reduce(DataFrame.unionByName, stored).groupBy("run", "scan_seq").agg(F.count("*").alias("pixels"), F.sum("s_amp").alias("total"))


@query("stream_join_late", f"WITH {FRAMES} SELECT frame_id, list_sum(px) AS total, CAST(user_id AS BIGINT) AS user_id FROM f JOIN events ON event_id = frame_id")
def stream_join_late(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp")
    f = _frames(spark, sf).select("frame_id", F.aggregate("px", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"), at.alias("ts"))
    p = published(table(spark, sf, "events").select(F.col("event_id").alias("frame_id"), "user_id"), "late", "frame_id").select("frame_id", "user_id", at.alias("ts"))
    return drain(watermarked_join(f, p, "10 minutes"), "late")


@query("stream_packets", "SELECT run, n // 5 AS number, CAST(n % 5 AS INTEGER) AS k, x, y FROM (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n, value AS x, CAST(event_id AS DOUBLE) AS y FROM events)")
def stream_packets(spark, sf):
    """Packets of five samples of two channels come shuffled and leave in order."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), n.alias("n"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"))
    packed = e.groupBy("run", F.floor(F.col("n") / 5).alias("number")).agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("s"))
    packets = packed.select("run", "number", F.transform("s", lambda r: r["x"]).alias("x"), F.transform("s", lambda r: r["y"]).alias("y"))
    out = drain(in_order(published(packets, "packets", "number")), "order")
    return out.select("run", "number", F.posexplode(F.arrays_zip("x", "y")).alias("k", "s")).select("run", "number", "k", "s.x", "s.y")


@query("stream_scan_split", "SELECT conv_id % 64 AS run, turn AS number, CAST(sum(CASE WHEN turn < prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id % 64 ORDER BY conv_id, turn) AS BIGINT) AS scan_seq, conv_id * 1000 + turn AS arrival FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id % 64 ORDER BY conv_id, turn) AS prev FROM conversations)")
def stream_scan_split(spark, sf):
    """Batches come in order of arrival, so the files are written one after the other; rows of a file are shuffled."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 64).alias("run"), (F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"), F.col("turn").alias("number"))
    path, (low, high) = fresh_path(spark, "arrivals"), c.agg(F.min("arrival"), F.max("arrival")).first()
    third = F.least(F.lit(2), F.floor((F.col("arrival") - (low or 0)) * 3 / max(1, (high or 0) - (low or 0) + 1)))
    for k in range(3):
        c.where(third == k).repartition(1).write.mode("append").parquet(path)
    return drain(split_scans(spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(path)), "split")


def _through_log(spark, messages, number, kind, decode, name, bound):
    """Messages (parts, in the order of `number`) published into a log in two goes and read by a query that takes `bound`
    messages a batch and is stopped and started again in between; what it wrote, decoded."""
    spark.dataSource.register(MessageLog)
    base = fresh_path(spark, name)
    half = messages.agg(F.percentile_approx(number, 0.5)).first()[0] or 0
    schema = decode(spark.createDataFrame([], "header string, description string, payload binary, value string")).schema
    for later in (False, True):
        some = messages.where(F.col(number) > half if later else F.col(number) <= half)
        some.repartitionByRange(3, number).sortWithinPartitions(number).select("parts").write.format("scan_messages").mode("append").save(f"{base}/log")
        stream = spark.readStream.format("scan_messages").options(kind=kind, max_messages=str(bound), messages_per_task="200", state=f"{base}/given").load(f"{base}/log")
        q = stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(lambda df, batch: decode(df).write.mode("overwrite").parquet(f"{base}/out/batch_no={batch}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    delete_at_exit(spark, base)
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)


_RUN = "m AS (SELECT f.frame_id // 128 AS run, f.frame_id, x, sum(px[k + 1] * (k // 8)) / sum(px[k + 1]) AS r, sum(px[k + 1] * (k % 8)) / sum(px[k + 1]) AS c FROM f JOIN p USING (frame_id), (SELECT unnest(range(64)) AS k) GROUP BY 1, 2, 3)"


def _turned(name: str) -> str:
    swap, up, left = SYMMETRIES[name]
    row, col = ("7 - r" if up else "r"), ("7 - c" if left else "c")
    return f"SELECT run, '{name}' AS name, round(avg(abs(({col if swap else row}) - x / 10)), 6) AS score FROM m GROUP BY run HAVING count(*) = 128"


@query("stream_orientation", f"WITH {FRAMES}, {POSITIONS}, {_RUN} " + " UNION ALL ".join(map(_turned, SYMMETRIES)))
def stream_orientation(spark, sf):
    """The orientation of each run of 128 frames, once all of them have a position: as orientation_scores, but in the run."""

    def score(px, x, y):
        rows = np.arange(8)[None, :, None]
        return np.abs((px * rows).sum(axis=(1, 2)) / px.sum(axis=(1, 2)) - x / 10)

    f = frames(spark, sf).select(F.floor(F.col("frame_id") / 128).alias("run"), "frame_id", "px")
    p = positions(spark, sf).select(F.floor(F.col("frame_id") / 128).alias("run"), "frame_id", "x", "y")
    out = drain(orientation(published(f, "frames", "frame_id"), published(p, "places", "frame_id", 5), (8, 8), score, least=128, most=256), "orientation")
    return out.select("run", "name", F.round("score", 6).alias("score"))


@query("stream_auto_centre", f"WITH {FRAMES}, g AS (SELECT frame_id // 64 AS run, frame_id, px FROM f WHERE (SELECT max(frame_id) FROM f) // 64 > frame_id // 64), b AS (SELECT frame_id, run, greatest(0, least(4, 1 + run % 5)) AS t, greatest(0, least(4, 2 + run % 3)) AS l, px FROM g) SELECT run, frame_id, CAST(t AS INTEGER) AS y0, CAST(l AS INTEGER) AS x0, CAST(list_sum(list_transform(range(16), lambda k: px[CAST((t + k // 4) * 8 + l + k % 4 + 1 AS INTEGER)])) AS BIGINT) AS total FROM b")
def stream_auto_centre(spark, sf):
    """Frames cut to a window around a bright spot that lies elsewhere in each run of 64 frames and that only the first 40
    frames of a run have; runs that are not whole wait."""
    run, k = F.floor(F.col("frame_id") / 64), F.col("frame_id") % 64
    f = frames(spark, sf).select(run.alias("run"), "frame_id", "px", k.alias("k"))
    spot = lambda i: (F.floor(i / 8) == 2 + F.col("run") % 5) | (F.floor(i / 8) == 3 + F.col("run") % 5)  # noqa: E731  two rows of the spot
    there = lambda i: spot(i) & ((i % 8 == 3 + F.col("run") % 3) | (i % 8 == 4 + F.col("run") % 3)) & (F.col("k") < 40)
    lit = F.transform("px", lambda v, i: v + F.when(there(i), 1_000_000).otherwise(0))
    out = drain(auto_centre(published(f.select("run", "frame_id", lit.alias("px")), "beam", "frame_id"), 8, 8, (2, 6, 2, 6), least=64, threshold=0.5), "centre")
    # the spot is taken off again, so that the sums are those of the frames
    spots = F.when(F.col("frame_id") % 64 < 40, 4_000_000).otherwise(0)
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda s, v: s + v)
    return out.select("run", "frame_id", "y0", "x0", (total - spots).alias("total"))


@query("stream_messages", f"WITH {FRAMES} SELECT frame_id, 8 AS rows, 8 AS cols, CAST(list_sum(list_transform(range(64), lambda k: CAST(px[k + 1] AS BIGINT) * (k + 1))) AS BIGINT) AS total FROM f")
def stream_messages(spark, sf):
    """Frames as detector messages, plain and in three compressed encodings, through a log and back."""
    f = frames(spark, sf).select("frame_id", "px")
    kinds = ((0, None, None), (1, "bs16-lz4<", "uint16"), (2, "bs32-lz4<", "uint32"), (3, "lz4<", "uint16"))
    said = [encode_frames(some, 8, 8) if e is None else compress_frames(some, 8, 8, e, t) for k, e, t in kinds for some in [f.where(F.col("frame_id") % 4 == k)]]
    messages = reduce(DataFrame.unionByName, said)
    binary = [F.col(c).cast("binary") for c in ("header", "description", "payload")]
    messages = messages.select(F.get_json_object("header", "$.frame").cast("bigint").alias("frame_id"), F.array(*binary).alias("parts"))
    out = _through_log(spark, messages, "frame_id", "detector", decode_frames, "messages", 600)
    total = F.aggregate(F.zip_with("px", F.sequence(F.lit(1), F.lit(64)), lambda v, k: v * k), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return out.select("frame_id", "rows", "cols", total.alias("total"))


@query("stream_encoder", "SELECT event_id AS sample, value AS x, CAST(user_id AS DOUBLE) AS y FROM events")
def stream_encoder(spark, sf):
    """Encoder samples as packets of two channels through a log and back; what only announces or ends a scan is no packet."""
    channels = ("/fast", "/slow")
    s = table(spark, sf, "events").select(F.col("event_id").alias("sample"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    n = F.coalesce(F.get_json_object("value", "$.frame_number").cast("bigint"), F.lit(-1))
    messages = packet_messages(s, 41, channels).select(n.alias("n"), F.array(F.col("value").cast("binary")).alias("parts"))
    return samples_of(_through_log(spark, messages, "n", "encoder", lambda df: parse_packets(df, channels), "encoder", 1000), 41)


@query("stream_latest_wins", "SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
def stream_latest_wins(spark, sf):
    return latest_wins(published(table(spark, sf, "events").select("user_id", "event_id", "value"), "updates", "event_id"), "user_id", "event_id", "latest")


@query("stream_throughput", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS at, count(*) AS n FROM events GROUP BY 1")
def stream_throughput(spark, sf):
    e = stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(throughput(e, every="1 minute"), "throughput", "complete")
    return out.select(F.col("at").cast("timestamp_ntz").alias("at"), "n")


@query("stream_detector_sink", f"WITH {FRAMES} SELECT frame_id // 5 AS row, CAST(list_sum(list_transform(px, lambda v: CAST(floor(least(255, sqrt(v))) AS INTEGER))) AS BIGINT) AS total FROM f WHERE frame_id % 5 = 0")
def stream_detector_sink(spark, sf):
    """Every fifth frame as 8-bit roots at its compact row of the detector buffer, read back from there."""
    base = fresh_path(spark, "detector")
    with state_store(spark):
        q = _frames(spark, sf).writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        q.foreachBatch(lambda df, batch: sinks.write_detector(df, base, "stream", batch, stride=5, scan_seq=0)).start().awaitTermination()
    rows = sinks.read_buffer(spark, base, "stream", "diffraction", scan_seq=0)
    return rows.select("row", F.aggregate("px", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"))


_LAST = "(SELECT max(event_id) FROM events)"


@query("stream_slow_gate", f"SELECT event_id % 2 AS run, event_id AS frame_id FROM events WHERE event_id % 50 <> 0 OR event_id % 7 = 0 OR {_LAST} < 1100")
def stream_slow_gate(spark, sf):
    """Two runs, each on a line but for every 50th frame (unless that has no value): those go once the gate has locked;
    a table too small for a lock keeps them waiting, so it is held against the rule that gives up."""
    i = F.col("event_id")
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    u = F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(i * 0.01 + F.when(i % 50 == 0, 0.01 * last).otherwise(0))
    e = table(spark, sf, "events").select((i % 2).alias("run"), i.alias("frame_id"), u.alias("u"), F.col("value").cast("double").alias("v"))
    least, most = (400, 6000) if last >= 1100 else (10_000, 0)
    return drain(slow_gate(published(e, "slow", "frame_id"), span=0.01 * last, min_frames=least, most_waiting=most), "slow").select("run", "frame_id")


@query("stream_min_points", "SELECT user_id AS run, event_id AS sample FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 65)")
def stream_min_points(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("sample"), F.col("value").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return drain(min_points(published(e, "points", "sample"), 65), "points").select("run", "sample")


@query("stream_prefix_release", f"WITH {FRAMES}, {POSITIONS}, a AS (SELECT f.frame_id, f.frame_id % 16 AS run, f.frame_id // 16 AS arrival, p.x FROM f LEFT JOIN (SELECT * FROM p WHERE frame_id % 50 <> 49) p USING (frame_id)) SELECT run, arrival, frame_id FROM a WHERE arrival < coalesce((SELECT min(arrival) FROM a b WHERE x IS NULL AND b.run = a.run), 1000000000)")
def stream_prefix_release(spark, sf):
    f = published(frames(spark, sf).select((F.col("frame_id") % 16).alias("run"), "frame_id", F.floor(F.col("frame_id") / 16).alias("arrival")), "frames", "frame_id")
    p = published(positions(spark, sf).where("frame_id % 50 != 49").select((F.col("frame_id") % 16).alias("run"), "frame_id", "x", "y"), "places", "frame_id", 5)
    return drain(release_prefix(f, p), "prefix").select("run", "arrival", "frame_id")


@query("slow_axis_nan", f"SELECT 'u' AS axis, CAST(0.0 AS DOUBLE) AS a, CAST(0.01 AS DOUBLE) AS b, count(*) AS kept FROM events WHERE event_id >= 60 AND event_id % 9 <> 0")
def slow_axis_nan(spark, sf):
    """The slow axis among two columns where the first 60 frames are stale and every ninth has no number."""
    i = F.col("event_id")
    u = F.when(i % 9 == 0, F.lit(float("nan"))).otherwise(i * 0.01 + F.when(i < 60, 5.0).otherwise(0.0))
    rows = table(spark, sf, "events").select(i.alias("frame_id"), u.alias("u"), F.when(i % 4 != 0, F.col("value").cast("double")).alias("v"))
    axis, (a, b), tol = lines.slow_axis(rows, ("u", "v"), span=40.0)
    kept = lines.on_line(rows.where(~F.isnan("u")), axis, (a, b), tol).count()
    return spark.range(1).select(F.lit(axis).alias("axis"), (F.round(F.lit(a), 6) + 0.0).alias("a"), F.round(F.lit(b), 6).alias("b"), F.lit(kept).cast("long").alias("kept"))
