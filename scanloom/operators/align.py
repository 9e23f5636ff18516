"""Frames, encoder samples and positions brought together by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def downsample(samples: DataFrame, per_frame: int, keys: tuple[str, ...] = (), values: tuple[str, ...] = ("x", "y"), min_points: int = 0) -> DataFrame:
    """One position per frame: the mean of its `per_frame` samples.  Incomplete groups go, and so does a whole scan
    that does not have more than min_points * per_frame samples yet."""
    frame = F.floor(F.col("sample") / per_frame).cast("bigint")
    out = samples.groupBy(*keys, frame.alias("frame_id")).agg(F.count("*").alias("_n"), *[F.avg(v).alias(v) for v in values]).where(F.col("_n") == per_frame).drop("_n")
    if min_points <= 0:
        return out
    enough = samples.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > min_points * per_frame)
    return out.join(F.broadcast(enough.drop("_n")), list(keys), "left_semi") if keys else out.crossJoin(F.broadcast(enough)).drop("_n")


def known(*columns: str) -> Column:
    """All of them there and none a NaN."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return out


def ready(frames: DataFrame, positions: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Frames with their positions, as far as these are known."""
    values = [c for c in positions.columns if c not in keys]
    return frames.join(positions.where(known(*values)), list(keys))


def pending(frames: DataFrame, positions: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Frames whose position is not there or not known."""
    values = [c for c in positions.columns if c not in keys]
    return frames.join(positions.where(known(*values)), list(keys), "left_anti")


def prefix_release(frames: DataFrame, positions: DataFrame, run: tuple[str, ...] = (), keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Frames in their order of arrival up to the first one whose position is not known.

    The first such arrival is one aggregate per run: nothing is sorted and no run is gathered in one task."""
    values = [c for c in positions.columns if c not in (*run, *keys)]
    joined = frames.join(positions.where(known(*values)).withColumn("_has", F.lit(True)), [*run, *keys], "left")
    stop = joined.where("_has is null").groupBy(*run).agg(F.min("arrival").alias("_stop"))
    held = joined.join(F.broadcast(stop) if not run else stop, list(run), "left") if run else joined.crossJoin(F.broadcast(stop))
    return held.where("_has AND (_stop is null OR arrival < _stop)").drop("_has", "_stop")


def capacity(batches: DataFrame, most: int, run: tuple[str, ...] = ()) -> DataFrame:
    """Batches (batch_no, n) taken whole while they fit into a capacity; one that does not is left out, the count goes on."""
    w = Window.partitionBy(*run).orderBy("batch_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") <= most)


def ready_counts(frames: DataFrame, positions: DataFrame, most: int) -> DataFrame:
    """How many points are ready for the solver: no more than frames, positions or the capacity."""
    a = frames.agg(F.count("*").alias("frames"))
    b = positions.agg(F.count("*").alias("positions"))
    return a.crossJoin(F.broadcast(b)).select("frames", "positions", F.least("frames", "positions", F.lit(most).cast("bigint")).alias("ready"))


def within_capacity(positions: DataFrame, max_points: int, loaded: int = 0, target: int | None = None, key: str = "frame_id") -> DataFrame:
    """Positions that the solver has room for: frames below max_points, and no more rows, in the order of frames, than are
    missing to the target (max_points unless given) when `loaded` are there already."""
    room = max(0, (max_points if target is None else target) - loaded)
    return positions.where((F.col(key) >= 0) & (F.col(key) < max_points)).orderBy(key).limit(room)


def compare(a: DataFrame, b: DataFrame, value: str, key: str = "frame_id") -> DataFrame:
    """Two tables of positions against each other: differences and the line from one to the other."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).where(known("a", "b"))
    d = F.col("a") - F.col("b")
    return both.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.max(F.abs(d)).alias("most"), F.regr_slope("a", "b").alias("slope"), F.regr_intercept("a", "b").alias("intercept"))
