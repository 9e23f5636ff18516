"""Streams over tables and what they leave behind."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.session import delete_at_exit, file_system, fresh_path
from .mosaics import LiveMosaic
from .stateful import join_late, state_store


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def published(df: DataFrame, name: str, by: str, parts: int = 6) -> DataFrame:
    """A table as a stream of shuffled files, two in a micro-batch: rows come in another order than they are numbered."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.repartition(parts, F.xxhash64(by)).write.parquet(path)
    delete_at_exit(spark, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    In complete mode each micro-batch writes the whole result to a folder of its own number, so a batch that runs twice
    replaces itself, and the newest folder is the answer.  The state goes when the stream has ended, the result with the
    session."""
    spark = stream.sparkSession
    out, check = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    last = {"batch": -1}

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch_no={batch}")
        last["batch"] = batch

    with state_store(spark, drains=True):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    fs, at = file_system(spark, check)
    fs.delete(at, True)
    delete_at_exit(spark, out)
    if last["batch"] < 0:
        return spark.createDataFrame([], stream.schema)
    df = spark.read.schema(stream.schema).parquet(out if mode == "append" else f"{out}/batch_no={last['batch']}")
    return df.select(*stream.columns)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, at = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def until(done, query, seconds: float) -> None:
    """Waits until done() holds; a query that fails, or takes longer, is an error."""
    end = time.monotonic() + seconds
    while not done():
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() > end:
            query.stop()
            raise TimeoutError("the stream did not get there in time")
        time.sleep(0.2)


def live_mosaic(frames: DataFrame, positions: DataFrame, h: int, w: int, name: str = "mosaic", values: tuple[str, ...] = ("px",), keys: tuple[str, ...] = (), keep_seconds: float | None = None) -> DataFrame:
    """The canvas (keys, y, x, c, s_<value>) of all frames whose position is known by the end of the streams: frames wait
    for their positions in state, and each micro-batch adds the tiles of its own patches."""
    spark = frames.sparkSession
    base = fresh_path(spark, name)
    mosaic = LiveMosaic(spark, f"{base}/tiles", h, w, values, keys)
    joined = join_late(frames, positions, (*keys, "frame_id"), keep_seconds)
    with state_store(spark, drains=True):
        joined.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(mosaic.write).start().awaitTermination()
    delete_at_exit(spark, base)
    canvas = mosaic.canvas()
    return canvas if canvas is not None else spark.createDataFrame([], _canvas_kind(frames, values, keys))


def _canvas_kind(frames: DataFrame, values: tuple[str, ...], keys: tuple[str, ...]) -> str:
    own = [f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys]
    return ", ".join([*own, "y bigint", "x bigint", "c bigint", *[f"s_{v} double" for v in values]])


def watermarked_join(frames: DataFrame, positions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Frames and positions (each with ts) by frame_id, as far apart as `late`: state is bounded by the watermark, and
    what comes later than that is lost.  The stateful join keeps all."""
    f = frames.withWatermark("ts", late).alias("f")
    p = positions.withWatermark("ts", late).alias("p")
    near = F.expr(f"f.frame_id = p.frame_id AND p.ts BETWEEN f.ts - INTERVAL {late} AND f.ts + INTERVAL {late}")
    return f.join(p, near).select("f.frame_id", *[F.col(f"f.{c}") for c in frames.columns if c not in ("frame_id", "ts")], *[F.col(f"p.{c}") for c in positions.columns if c not in ("frame_id", "ts")])


def latest_wins(stream: DataFrame, key: str, when: str, name: str) -> DataFrame:
    """The newest row of each key over the whole stream."""
    rest = [c for c in stream.columns if c != key]
    return drain(stream.groupBy(key).agg(F.max_by(F.struct(*rest), when).alias("r")).select(key, "r.*"), name, "complete")


def throughput(stream: DataFrame, ts: str = "ts", every: str = "1 second", late: str = "1 minute") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("at"), "n")


class Progress(StreamingQueryListener):
    """Rows and rates of the queries of a session, a stamp at most every `every` seconds: stamp(name, rows, rate)."""

    def __init__(self, stamp, every: float = 1.0):
        self.stamp, self.every, self.rows, self.last = stamp, every, {}, {}

    def onQueryStarted(self, event):
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event):
        p = event.progress
        key, now = str(p.id), time.monotonic()
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        if now - self.last.get(key, -self.every) >= self.every:
            self.last[key] = now
            self.stamp(p.name or key, self.rows[key], p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.rows.pop(str(event.id), None)


def lead(frames: DataFrame, positions: DataFrame) -> DataFrame:
    """How far the newest frame is ahead of the positions: a figure to watch, as a keyed join needs no brake."""
    a = frames.agg(F.max("frame_id").alias("newest"))
    b = positions.agg(F.count("*").alias("placed"))
    return a.crossJoin(F.broadcast(b)).select("newest", "placed", (F.col("newest") - F.col("placed")).alias("lead"))


def fan_out(stream: DataFrame, first, second, checkpoint: str):
    """One source, two writers (functions of a batch and its number) that see the same rows."""

    def both(df, batch):
        df = df.persist()
        try:
            first(df, batch)
            second(df, batch)
        finally:
            df.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both).start()
