"""Detector and encoder messages to rows, raster simulation, and stored scans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .codecs import compress, decompress, image_message, image_of, read_cbor

#: Header of a detector message, and the description of its payload (shape is [columns, rows]).
HEADER = "frame bigint, series bigint"
DESCRIPTION = "htype string, encoding string, shape array<int>, type string"
#: One message of the encoder.
PACKET = "msg_type string, frame_number bigint, datasets map<string, struct<dtype: string, size: int, starting_sample_number: bigint, data: array<double>>>"
TYPES = {"uint16": "<u2", "uint32": "<u4"}


#: Encodings that are read here, and whether their bits are shuffled.
PACKED = {"bs16-lz4<": True, "bs32-lz4<": True, "lz4<": False}
#: Pixels that a task packs or unpacks at once.  A batch can hold many times its own size in pixels; what a task needs beside
#: the batch does not grow with it, only with a single frame of more pixels.
AT_ONCE = 1 << 18


def _runs(pixels: np.ndarray):
    """(first, end) of runs of frames with AT_ONCE pixels together at most; a larger frame is a run of its own."""
    first, total = 0, 0
    for i, n in enumerate(pixels.tolist()):
        if i > first and total + n > AT_ONCE:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(pixels):
        yield first, len(pixels)


def _elements(px, dtype: np.dtype) -> list[np.ndarray]:
    """The pixels of each frame (an Arrow array of lists), without a Python number for each; missing ones and such as the type
    cannot hold are errors."""
    flat = px.flatten()
    if px.null_count or flat.null_count:
        raise ValueError("a frame has missing pixels")
    found = flat.to_numpy(zero_copy_only=False)
    if not ((found > -1) & (found < np.iinfo(dtype).max + 1)).all():
        raise OverflowError(f"a frame has pixels that {dtype} cannot hold")
    return np.split(found.astype(dtype), np.cumsum(px.value_lengths().to_numpy())[:-1])


def _packed(batch, dtype: np.dtype, pack, name: str):
    """Batches of frame_id and `name`, pack(frame_id, px) of each frame, in runs."""
    import pyarrow as pa

    for first, end in _runs(batch.column("px").value_lengths().fill_null(0).to_numpy()):
        some = batch.slice(first, end - first)
        out = list(map(pack, some.column("frame_id").to_pylist(), _elements(some.column("px"), dtype)))
        yield pa.RecordBatch.from_arrays([some.column("frame_id"), pa.array(out, pa.binary())], names=["frame_id", name])


def _frame_batch(frame_id, rows, cols, px: list[np.ndarray]):
    import pyarrow as pa

    size = np.array([len(x) for x in px], np.int64)
    flat = np.concatenate(px).astype(np.int64) if px else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([frame_id, rows, cols, lists], names=["frame_id", "rows", "cols", "px"])


def decode_frames(messages: DataFrame, decoders: dict | None = None) -> DataFrame:
    """frame_id, rows, cols, px from header, description (JSON) and payload (bytes).

    Messages without a frame or of another kind of image give no row.  Raw payloads and those in LZ4, with or without
    shuffled bits, are read here, all of a run of frames that have one type and encoding together; for each other encoding
    `decoders` may name a function (bytes, dtype, n) -> array.  Without one, for types that are not unsigned 16 or 32 bit,
    and for payloads that are damaged or have another number of pixels than their shape, the job fails."""
    decoders = decoders or {}
    parsed = messages.select(F.from_json("header", HEADER)["frame"].alias("frame_id"), F.from_json("description", DESCRIPTION).alias("d"), "payload")
    rows = parsed.where("frame_id IS NOT NULL AND d.htype = 'dimage_d-1.0'").select("frame_id", F.col("d.encoding").alias("encoding"), F.col("d.type").alias("type"), F.col("d.shape")[0].alias("cols"), F.col("d.shape")[1].alias("rows"), "payload")

    def unpacked(payloads, kinds, encodings, size):
        px = [None] * len(payloads)
        for kind, encoding in {*zip(kinds, encodings)}:
            at, dtype = np.flatnonzero((kinds == kind) & (encodings == encoding)), np.dtype(TYPES[kind])
            some = [payloads[i] for i in at]
            if encoding in decoders:
                images = [np.asarray(decoders[encoding](raw, dtype, n)) for raw, n in zip(some, size[at].tolist())]
            elif encoding == "raw":
                images = [np.frombuffer(raw, dtype) for raw in some]
            else:
                images = decompress(some, dtype, PACKED[encoding])
            for i, image in zip(at, images, strict=True):
                if len(image) != size[i]:
                    raise RuntimeError(f"a payload of {len(image)} pixels for a frame of {size[i]}")
                px[i] = image
        return px

    def run(batches):
        for batch in batches:
            kinds, encodings = (np.array(batch.column(c).to_pylist(), object) for c in ("type", "encoding"))
            if bad := [k for k in set(kinds) if k not in TYPES]:
                raise RuntimeError(f"pixels of type {bad[0]!r} cannot be read")
            if bad := [e for e in set(encodings) if e != "raw" and e not in PACKED and e not in decoders]:
                raise RuntimeError(f"encoding {bad[0]!r} cannot be read")
            size = batch.column("rows").to_numpy().astype(np.int64) * batch.column("cols").to_numpy()
            for first, end in _runs(size):
                some = batch.slice(first, end - first)
                about = (kinds[first:end], encodings[first:end], size[first:end])
                yield _frame_batch(some.column("frame_id"), some.column("rows"), some.column("cols"), unpacked(some.column("payload").to_pylist(), *about))

    return rows.mapInArrow(run, "frame_id long, rows int, cols int, px array<bigint>")


def decode_cbor(messages: DataFrame, value: str = "value", channel: str = "threshold_1") -> DataFrame:
    """frame_id, rows, cols, px of image messages in CBOR; messages of another type give no row, damaged ones, unknown
    elements and unknown compressions fail the job."""

    def run(batches):
        import pyarrow as pa

        def together(found):
            number, rows, cols, px = zip(*found)
            return _frame_batch(pa.array(number, pa.int64()), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), list(px))

        for batch in batches:
            found, pixels = [], 0
            for raw in batch.column(0):
                if (m := read_cbor(raw.as_py())).get("type") != "image":
                    continue
                found.append(image_of(m, channel))
                pixels += len(found[-1][3])
                if pixels >= AT_ONCE:
                    yield together(found)
                    found, pixels = [], 0
            if found:
                yield together(found)

    return messages.where(F.col(value).isNotNull()).select(value).mapInArrow(run, "frame_id long, rows int, cols int, px array<bigint>")


def encode_cbor(frames: DataFrame, rows: int, cols: int, compression: str | None = "bslz4", kind: str = "uint32") -> DataFrame:
    """value: an image message in CBOR of each frame (frame_id, px); compression None, "lz4" or "bslz4"."""
    dtype = np.dtype(TYPES[kind])

    def run(batches):
        for batch in batches:
            for out in _packed(batch, dtype, lambda i, px: image_message(i, px, rows, cols, compression), "value"):
                yield out.select(["value"])

    return frames.select("frame_id", "px").mapInArrow(run, "value binary")


def compress_frames(frames: DataFrame, rows: int, cols: int, encoding: str = "bs16-lz4<", kind: str = "uint16", series: int = 1) -> DataFrame:
    """As encode_frames, with payloads in one of the compressed encodings."""
    dtype, shuffled = np.dtype(TYPES[kind]), PACKED[encoding]

    def run(batches):
        for batch in batches:
            yield from _packed(batch, dtype, lambda i, px: compress(px, shuffled), "payload")

    packed = frames.select("frame_id", "px").mapInArrow(run, "frame_id bigint, payload binary")
    return packed.select(*_about(rows, cols, series, encoding, kind), "payload")


def _about(rows: int, cols: int, series: int, encoding: str, kind: str) -> list[Column]:
    """Header and description of a frame."""
    header = F.to_json(F.struct(F.col("frame_id").alias("frame"), F.lit(series).alias("series"))).alias("header")
    shape = F.array(F.lit(cols), F.lit(rows)).alias("shape")
    return [header, F.to_json(F.struct(F.lit("dimage_d-1.0").alias("htype"), F.lit(encoding).alias("encoding"), shape, F.lit(kind).alias("type"))).alias("description")]


def encode_frames(frames: DataFrame, rows: int, cols: int, series: int = 1) -> DataFrame:
    """Messages with raw 16-bit payloads of frames (frame_id, px): what a replay publishes."""
    pair = F.transform("px", lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0")))
    return frames.select(*_about(rows, cols, series, "raw", "uint16"), F.unhex(F.array_join(pair, "")).alias("payload"))


def parse_packets(messages: DataFrame, channels: tuple[str, str], value: str = "value") -> DataFrame:
    """packet_no, x, y (arrays) of the data messages; start and stop messages and others give no row."""
    m = messages.select(F.from_json(value, PACKET).alias("m")).where("m.msg_type = 'data'")
    a, b = (F.col("m.datasets")[c]["data"] for c in channels)
    return m.select(F.col("m.frame_number").alias("packet_no"), a.alias("x"), b.alias("y"))


def packet_messages(samples: DataFrame, size: int, channels: tuple[str, str]) -> DataFrame:
    """Data messages of `size` samples each (sample, x, y), with a start and a stop message around them."""
    number = F.floor(F.col("sample") / size).cast("bigint")
    grouped = samples.groupBy(number.alias("n")).agg(F.array_sort(F.collect_list(F.struct("sample", "x", "y"))).alias("s"))
    part = lambda c: F.struct(F.lit("float64").alias("dtype"), F.size("s").alias("size"), F.col("s")[0]["sample"].alias("starting_sample_number"), F.transform("s", lambda r: r[c].cast("double")).alias("data"))
    data = grouped.select(F.to_json(F.struct(F.lit("data").alias("msg_type"), F.col("n").alias("frame_number"), F.create_map(F.lit(channels[0]), part("x"), F.lit(channels[1]), part("y")).alias("datasets"))).alias("value"))
    ends = samples.sparkSession.sql("""SELECT '{"msg_type":"start"}' AS value UNION ALL SELECT '{"msg_type":"stop"}'""")
    return data.unionAll(ends)


def samples_of(packets: DataFrame, size: int) -> DataFrame:
    """sample, x, y of packets of `size` samples; a packet ends with its shorter channel."""
    n = F.least(F.size("x"), F.size("y"))
    both = F.arrays_zip(F.slice("x", F.lit(1), n).alias("x"), F.slice("y", F.lit(1), n).alias("y"))
    return packets.select("packet_no", F.posexplode(both).alias("k", "v")).select((F.col("packet_no") * size + F.col("k")).alias("sample"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))


def stored_scan(spark: SparkSession, path: str, candidates: dict[str, list[str]], skip: int = 0, most: int | None = None, number: str = "frame_id") -> DataFrame:
    """A stored scan with columns under their usual names, whichever of the candidates it has, from frame `skip` on.
    Both the range and the columns reach the Parquet scan."""
    df = spark.read.parquet(path)
    picked = {name: next((c for c in options if c in df.columns), None) for name, options in candidates.items()}
    if None in picked.values():
        raise ValueError(f"the scan has no column for {[k for k, v in picked.items() if v is None]}")
    out = df.select(*[F.col(c).alias(k) for k, c in picked.items()])
    return take_range(out, skip, most, number)


def take_range(df: DataFrame, skip: int, most: int | None, number: str = "frame_id", per_frame: int = 1) -> DataFrame:
    out = df.where(F.col(number) >= skip * per_frame)
    return out if most is None else out.where(F.col(number) < (skip + most) * per_frame)


def positions_array(points: np.ndarray) -> np.ndarray:
    """(2, N) from (2, N) or (N, 2); a 2 x 2 table is taken as (2, N)."""
    points = np.asarray(points)
    if points.ndim != 2 or 2 not in points.shape:
        raise ValueError(f"positions of shape {points.shape}")
    return points if points.shape[0] == 2 else points.T


def stack_of_frames(array: np.ndarray) -> np.ndarray:
    """(M, H, W) from that, (1, N, H, W) or (N, 1, H, W)."""
    if array.ndim == 4 and 1 in array.shape[:2]:
        return array.reshape(-1, *array.shape[2:])
    if array.ndim != 3:
        raise ValueError(f"frames of shape {array.shape}")
    return array


class RasterSource(DataSource):
    """`scan_raster`: frame_id, x, y of a simulated raster, as a table or as a stream of `rate` frames a batch.

    Options: x_num, y_num, x_range, y_range, partitions, rate."""

    @classmethod
    def name(cls) -> str:
        return "scan_raster"

    def schema(self) -> str:
        return "frame_id bigint, x double, y double"

    def reader(self, schema):
        return _RasterReader(self.options)

    def simpleStreamReader(self, schema):
        return _RasterStream(self.options)


def _raster_rows(options, start: int, end: int):
    nx, ny = int(options.get("x_num", 10)), int(options.get("y_num", 10))
    dx, dy = float(options.get("x_range", nx)) / nx, float(options.get("y_range", ny)) / ny
    for i in range(start, min(end, nx * ny)):
        yield i, (i % nx) * dx, (i // nx) * dy


class _RasterReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        total = int(self.options.get("x_num", 10)) * int(self.options.get("y_num", 10))
        n = int(self.options.get("partitions", 4))
        return [InputPartition((total * i // n, total * (i + 1) // n)) for i in range(n)]

    def read(self, partition):
        yield from _raster_rows(self.options, *partition.value)


class _RasterStream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self):
        return {"frame": 0}

    def read(self, start):
        total = int(self.options.get("x_num", 10)) * int(self.options.get("y_num", 10))
        end = min(total, start["frame"] + int(self.options.get("rate", 25)))
        return iter(list(_raster_rows(self.options, start["frame"], end))), {"frame": end}

    def readBetweenOffsets(self, start, end):
        return iter(list(_raster_rows(self.options, start["frame"], end["frame"])))
