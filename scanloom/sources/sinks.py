"""Where results go: runs, arrays that later writes overwrite, buffers, archives.

A run is a folder run_uid=... below a base path; each kind of result is a Parquet table in it.  Tables that grow are
appended with a batch number, and the state at any time is the newest row of each key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, geometry
from ..operators import align


def table_path(base: str, run_uid: str, kind: str) -> str:
    return f"{base.rstrip('/')}/run_uid={run_uid}/{kind}"


def start_run(spark: SparkSession, base: str, run_uid: str, metadata: dict) -> None:
    row = [(run_uid, {k: json.dumps(v) for k, v in metadata.items()}, False)]
    spark.createDataFrame(row, "run_uid string, metadata map<string,string>, complete boolean").write.mode("overwrite").parquet(table_path(base, run_uid, "run"))


def complete_run(spark: SparkSession, base: str, run_uid: str, stamps: dict | None = None) -> None:
    """Marks a run as complete, with more metadata."""
    old = spark.read.parquet(table_path(base, run_uid, "run")).first()
    extra = {k: json.dumps(v) for k, v in (stamps or {}).items()}
    spark.createDataFrame([(run_uid, dict(old["metadata"]) | extra, True)], "run_uid string, metadata map<string,string>, complete boolean").write.mode("overwrite").parquet(table_path(base, run_uid, "run"))


def overwrite(df: DataFrame, base: str, run_uid: str, kind: str) -> None:
    df.write.mode("overwrite").parquet(table_path(base, run_uid, kind))


def append(df: DataFrame, base: str, run_uid: str, kind: str, batch_no: int) -> None:
    """One folder a batch: a batch that is written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{table_path(base, run_uid, kind)}/batch_no={batch_no}")


def newest(df: DataFrame, key: str | list[str], when: str = "batch_no") -> DataFrame:
    """The last write of each key wins."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), when).alias("_r")).select(*keys, "_r.*")


def dense(df: DataFrame, row: str, value: str, when: str, fill) -> DataFrame:
    """Every row number from 0 to the largest, the newest value of each, `fill` where none was written.

    The largest number comes to the driver; the numbers themselves are a range that tasks make."""
    last = newest(df.select(row, value, when), row, when).select(row, value)
    top = df.agg(F.max(row)).first()[0]
    rows = df.sparkSession.range(0 if top is None else int(top) + 1).select(F.col("id").alias(row))
    return rows.join(last, row, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def _scan_kind(kind: str, scan_seq: int | None) -> str:
    return kind if scan_seq is None else f"{kind}/scan_seq={scan_seq}"


def write_detector(frames: DataFrame, base: str, run_uid: str, batch_no: int, stride: int = 1, counts: str = "px", scan_seq: int | None = None) -> None:
    """Frames as 8-bit roots of their counts, every stride-th one, at their compact row.

    With scan_seq each scan has rows of its own: a new scan starts from row 0 again and leaves the old ones stored."""
    kept = frames.where(F.col("frame_id") % stride == 0)
    append(kept.select(F.floor(F.col("frame_id") / stride).cast("bigint").alias("row"), arrays.to_uint8(F.col(counts)).alias("px")), base, run_uid, _scan_kind("diffraction", scan_seq), batch_no)


def write_inference(results: DataFrame, base: str, run_uid: str, batch_no: int, stride: int = 1, scan_seq: int | None = None) -> None:
    """frame_id, amp, phase of inference at the compact rows of the detector buffer, so that both pair by row."""
    kept = results.where(F.col("frame_id") % stride == 0)
    single = lambda c: F.transform(c, lambda v: v.cast("float")).alias(c)
    append(kept.select(F.floor(F.col("frame_id") / stride).cast("bigint").alias("row"), single("amp"), single("phase")), base, run_uid, _scan_kind("inference", scan_seq), batch_no)


def read_buffer(spark: SparkSession, base: str, run_uid: str, kind: str, scan_seq: int | None = None) -> DataFrame:
    """The newest write of each row; with scan_seq, of that scan only."""
    return newest(spark.read.parquet(table_path(base, run_uid, _scan_kind(kind, scan_seq))), "row")


def write_batch(results: DataFrame, base: str, run_uid: str, batch_no: int, kind: str = "vit") -> None:
    """Adds a batch to the history and makes it the latest one; a batch that is written again replaces itself."""
    append(results, base, run_uid, f"{kind}_history", batch_no)
    overwrite(results.withColumn("batch_no", F.lit(batch_no)), base, run_uid, f"{kind}_latest")


def write_final(df: DataFrame, base: str, run_uid: str, iteration: int, stamps: dict | None = None) -> bool:
    """The last result (probe and object as in write_live) under its own name, and the run marked as complete; unsound
    numbers are not written and leave the run open."""
    ok = _amplitudes(df, iteration)
    if ok is None:
        return False
    overwrite(ok, base, run_uid, "final")
    complete_run(df.sparkSession, base, run_uid, {"iterations": iteration} | (stamps or {}))
    return True


def sound(probe_re: Column, probe_im: Column, obj_re: Column, obj_im: Column) -> Column:
    """Whether a live result may be written: no bad number in the probe, no infinite one in the object, and something
    finite in it; the object may have NaN."""
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    infinite = lambda v: F.abs(v) == float("inf")
    return ~F.exists(probe_re, bad) & ~F.exists(probe_im, bad) & ~F.exists(obj_re, infinite) & ~F.exists(obj_im, infinite) & F.exists(obj_re, lambda v: ~bad(v))


#: Probes are stored enlarged by this factor.
PROBE_SCALE = 256.0


def _amplitudes(df: DataFrame, iteration: int, probe_scale: float = 1.0) -> DataFrame | None:
    """df: one row with probe_re, probe_im, obj_re, obj_im (arrays): amplitudes and phases, or None where they are unsound."""
    ok = df.where(sound(*[F.col(c) for c in ("probe_re", "probe_im", "obj_re", "obj_im")]))
    if not ok.limit(1).count():
        return None
    part = lambda name, scale: (
        F.zip_with(f"{name}_re", f"{name}_im", lambda a, b: F.hypot(a, b) * scale).alias(f"{name}_amp"),
        F.zip_with(f"{name}_re", f"{name}_im", lambda a, b: F.atan2(b, a)).alias(f"{name}_phase"),
    )
    return ok.select(F.lit(iteration).alias("iteration"), *part("probe", probe_scale), *part("obj", 1.0))


def write_live(df: DataFrame, base: str, run_uid: str, iteration: int, probe_scale: float = 1.0) -> bool:
    """Writes amplitudes and phases unless the numbers are unsound; says whether it did."""
    ok = _amplitudes(df, iteration, probe_scale)
    if ok is None:
        return False
    overwrite(ok, base, run_uid, "live")
    return True


def save_live(df: DataFrame, base: str, run_uid: str, iteration: int) -> bool:
    """write_live with the enlarged probe; a write that fails is not an error of the run, as the next one replaces it."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return write_live(df, base, run_uid, iteration, PROBE_SCALE)
    except (PySparkException, Py4JJavaError, OSError):
        return False


def write_positions(positions: DataFrame, base: str, run_uid: str) -> None:
    """In um, and in metres beside."""
    overwrite(positions.select("*", (F.col("slow_um") * 1e-6).alias("x_m"), (F.col("fast_um") * 1e-6).alias("y_m")), base, run_uid, "positions")


def write_mosaic(canvas: DataFrame, base: str, run_uid: str, scan_seq: int, shape: tuple[int, int], first_shape: tuple[int, int] | None = None, most: int = 1024) -> bool:
    """A finished scan's canvas at its place in the archive, centred in the first scan's shape (cut where larger).
    Scans beyond the archive's size are not written."""
    if scan_seq >= most:
        return False
    oy, ox = ((a - b) // 2 for a, b in zip(first_shape or shape, shape, strict=True))
    h, w = first_shape or shape
    moved = canvas.withColumns({"y": F.col("y") + oy, "x": F.col("x") + ox}).where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))
    moved.write.mode("overwrite").parquet(f"{table_path(base, run_uid, 'mosaics')}/scan_seq={scan_seq}")
    return True


def dump_scan(frames: DataFrame, positions: DataFrame, base: str, run_uid: str, hot: float | None, n: int) -> dict:
    """A scan for offline work: amplitudes without hot pixels over the brightest of the rest, positions, and scalars.

    Two passes: the normalisation is one aggregate, then the frames are written."""
    px = arrays.hot_to_zero(F.col("px"), hot)
    top = frames.agg(F.max(F.array_max(px)).alias("m")).first()["m"] or 1
    overwrite(frames.select("frame_id", F.transform(px, lambda v: F.sqrt(v / F.lit(float(top)))).alias("dp")), base, run_uid, "frames")
    overwrite(positions, base, run_uid, "positions")
    meta = {"normalization": int(top), "nx": n, "ny": n}
    start_run(frames.sparkSession, base, run_uid, meta)
    return meta


@dataclass(frozen=True)
class OfflineScan:
    """How raw frames and samples become a scan for offline work.

    h, w: of the raw frames; roi: rows y0 to y1 and columns x0 to x1 after the flip; flip and orientation: symmetries before
    and after the crop; top: the number that marks saturation; hot: above it a pixel is hot (None: none is); bad: pixels of
    the cropped frame that are inpainted; ratios, ways and the angle turn encoder counts into um; meta: further scalars."""

    h: int
    w: int
    roi: tuple[int, int, int, int]
    flip: str = "flipud"
    orientation: str = "identity"
    top: int = 65535
    hot: float | None = None
    bad: tuple[int, ...] = ()
    x_ratio: float = 1.0
    y_ratio: float = 1.0
    x_way: int = 1
    y_way: int = 1
    angle: float = 0.0
    meta: dict = field(default_factory=dict)


def offline_frames(frames: DataFrame, scan: OfflineScan) -> DataFrame:
    """frame_id, dp: frames flipped, cropped, without saturated and hot pixels, bad ones inpainted, then oriented."""
    y0, y1, x0, x1 = scan.roi
    px = arrays.crop(arrays.orient(F.col("px"), scan.flip, scan.h, scan.w), scan.w, y0, y1, x0, x1)
    px = arrays.hot_to_zero(arrays.saturated_to_zero(px, scan.top), scan.hot)
    px = arrays.inpaint(px, y1 - y0, x1 - x0, list(scan.bad))
    return frames.select("frame_id", arrays.orient(px, scan.orientation, y1 - y0, x1 - x0).alias("dp"))


def offline_positions(frames: DataFrame, samples: DataFrame, scan: OfflineScan) -> DataFrame:
    """frame_id, slow_um, fast_um of every frame, null where no position is known.

    samples: sample, x (fast), y (slow), as many a frame as there are whole multiples of frames.  Values below 1,000 on
    either axis are um already and taken as such.  The fast axis is foreshortened by the angle, and from -45 degrees down it
    is mirrored."""
    counts = frames.agg(F.count("*").alias("n")).crossJoin(F.broadcast(samples.agg(F.count("*").alias("m"), F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")))).first()
    per_frame = max(1, counts["m"] // max(1, counts["n"]))
    in_um = (counts["x"] or 0.0) < 1e3 or (counts["y"] or 0.0) < 1e3
    scale = lambda c, ratio, way: F.col(c) if in_um and ratio else geometry.to_um(F.col(c), ratio, way)
    mean = align.downsample(samples, per_frame)
    fast = geometry.handed(geometry.foreshorten(scale("x", scan.x_ratio, scan.x_way), scan.angle), scan.angle, True) if scan.angle else scale("x", scan.x_ratio, scan.x_way)
    return frames.select("frame_id").join(mean.select("frame_id", scale("y", scan.y_ratio, scan.y_way).alias("slow_um"), fast.alias("fast_um")), "frame_id", "left")


def write_offline(frames: DataFrame, samples: DataFrame, base: str, run_uid: str, scan: OfflineScan) -> dict:
    """Frames, positions and scalars of a scan as tables of the run; the normalisation, the brightest pixel that is neither
    hot nor saturated, is one aggregate, the frames are written in a second pass.  Returns the scalars."""
    y0, y1, x0, x1 = scan.roi
    cut = arrays.saturated_to_zero(arrays.crop(arrays.orient(F.col("px"), scan.flip, scan.h, scan.w), scan.w, y0, y1, x0, x1), scan.top)
    within = F.filter(cut, lambda v: v <= scan.hot) if scan.hot is not None else cut
    top = frames.agg(F.max(F.array_max(within)).alias("m")).first()["m"]
    overwrite(offline_frames(frames, scan), base, run_uid, "frames")
    overwrite(offline_positions(frames, samples, scan), base, run_uid, "positions")
    h, w = arrays.oriented_shape(scan.orientation, y1 - y0, x1 - x0)
    meta = scan.meta | {"normalization": float(top or 0), "dp_orient": scan.orientation, "flip": scan.flip, "hot_pixel_count_threshold": scan.hot, "batch_x0": x0, "batch_y0": y0, "nx": w, "ny": h}
    meta |= {"x_ratio": scan.x_ratio, "y_ratio": scan.y_ratio, "x_direction": scan.x_way, "y_direction": scan.y_way, "angle": scan.angle}
    start_run(frames.sparkSession, base, run_uid, meta)
    return meta


def publish(df: DataFrame, path: str, order: str, size: int) -> int:
    """A table as files of `size` rows each, file_no=0, 1, ..., in an input folder of a stream; the number of files.

    One write: rows are dealt by their file's number.  A stream that gives its schema without file_no reads them all."""
    last = df.agg(F.max(order)).first()[0]
    n = 0 if last is None else int(last) // size + 1
    numbered = df.withColumn("file_no", F.floor(F.col(order) / size).cast("int"))
    numbered.repartition(max(1, n), "file_no").sortWithinPartitions("file_no", order).write.mode("append").partitionBy("file_no").parquet(path)
    return n
