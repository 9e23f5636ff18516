"""Registered queries on the given tables, each with SQL that gives the same rows where SQL can.

Stand-ins: embeddings are 8 x 8 frames, events are encoder samples (10 a frame), orders are runs, conversations are
frame counters that restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import text as T
from ..operators import align, lines, lookup, mosaic, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIDE = 8
RATIO, WAY, PIXEL, ANGLE = 0.5, -1, 0.75, -60.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins
def frames(spark, sf) -> DataFrame:
    """frame_id, px (64 counts), grp."""
    px = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("bigint"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), px.alias("px"), F.col("label").alias("grp"))


FRAMES = "f AS (SELECT vec_id AS frame_id, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT)) AS px, label AS grp FROM embeddings)"


def samples(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("sample"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))


def positions(spark, sf) -> DataFrame:
    """frame_id, x, y: means of ten samples."""
    return align.downsample(samples(spark, sf), 10)


POSITIONS = """p AS (SELECT event_id // 10 AS frame_id, avg(value) AS x, avg(CAST(user_id AS DOUBLE)) AS y FROM events GROUP BY 1 HAVING count(*) = 10)"""


def patches(spark, sf) -> DataFrame:
    """Frames with the centre of their patch in canvas pixels."""
    p = positions(spark, sf).select("frame_id", F.col("y").alias("cy"), F.col("x").alias("cx"))
    return align.ready(frames(spark, sf), p)


PATCHES = FRAMES + ", " + POSITIONS + ", j AS (SELECT frame_id, px, CAST(round_even(y, 0) AS BIGINT) AS cy, CAST(round_even(x, 0) AS BIGINT) AS cx FROM f JOIN p USING (frame_id))"
CANVAS = PATCHES + ", canvas AS (SELECT cy - 4 + k // 8 AS y, cx - 4 + k % 8 AS x, CAST(sum(px[k + 1]) AS DOUBLE) AS s, count(*) AS c FROM j, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2)"


def canvas(spark, sf) -> DataFrame:
    return mosaic.scatter_add(patches(spark, sf), SIDE, SIDE)


def tall(df: DataFrame, value: str, kind: str = "bigint") -> DataFrame:
    """frame_id, k, v: arrays as rows."""
    v = F.col("v").cast(kind)
    return df.select("frame_id", F.posexplode(value).alias("k", "v")).select("frame_id", F.col("k").cast("bigint").alias("k"), (F.round(v, 6) if kind == "double" else v).alias("v"))


def tall_sql(value: str, n: int = 64, kind: str = "BIGINT", source: str = FRAMES) -> str:
    v = f"round(CAST({value} AS DOUBLE), 6)" if kind == "DOUBLE" else f"CAST({value} AS {kind})"
    return f"WITH {source} SELECT frame_id, k, {v} AS v FROM f, (SELECT unnest(range({n})) AS k)"


# ---------------------------------------------------------------- orientation and shifts
def _oriented(name: str):
    i, j = "(k // 8)", "(k % 8)"
    swap, up, left = A.SYMMETRIES[name]
    row, col = (j, i) if swap else (i, j)
    at = f"({f'7 - {row}' if up else row}) * 8 + ({f'7 - {col}' if left else col}) + 1"
    query(f"d4_{name}", tall_sql(f"px[{at}]"))(lambda spark, sf: tall(frames(spark, sf).select("frame_id", A.orient(F.col("px"), name, 8, 8).alias("px")), "px"))


for _name in A.SYMMETRIES:
    _oriented(_name)


@query("d4_inverse_roundtrip", "SELECT CAST(n AS BIGINT) AS frames, n AS same FROM (SELECT count(*) AS n FROM embeddings)")
def d4_inverse_roundtrip(spark, sf):
    out = F.col("px")
    for name in A.SYMMETRIES:
        out = A.orient(A.orient(out, name, 8, 8), A.inverse(name), 8, 8)
    return frames(spark, sf).agg(F.count("*").alias("frames"), F.count_if(out == F.col("px")).alias("same"))


@query("d4_sequence", tall_sql("px[(7 - k // 8) * 8 + (7 - k % 8) + 1]"))
def d4_sequence(spark, sf):
    """Two quarter turns are half a turn."""
    return tall(frames(spark, sf).select("frame_id", A.orient(F.col("px"), "cw,cw", 8, 8).alias("px")), "px")


@query("reorient", tall_sql("px[(7 - k // 8) * 8 + k % 8 + 1]"))
def reorient(spark, sf):
    """From a transposed frame to one turned clockwise, which is a flip of columns before transposing back."""
    turned = A.orient(F.col("px"), "transpose", 8, 8)
    back = A.orient(A.reorient(turned, "transpose", "rot90_cw", 8, 8), A.inverse("transpose"), 8, 8)
    return tall(frames(spark, sf).select("frame_id", back.alias("px")), "px")


@query("fftshift", tall_sql("px[((k // 8 + 4) % 8) * 8 + (k % 8 + 4) % 8 + 1]"))
def fftshift(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.fftshift(F.col("px"), 8, 8).alias("px")), "px")


@query("crop", tall_sql("px[(k // 4 + 2) * 8 + k % 4 + 3 + 1]", 12))
def crop(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.crop(F.col("px"), 8, 2, 5, 3, 7).alias("px")), "px")


@query("inner_crop", tall_sql("px[(k // 4 + 2) * 8 + k % 4 + 2 + 1]", 16))
def inner_crop(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.inner_crop(F.col("px"), 8, 8, A.inner_crop_margin(8, 8)).alias("px")), "px")


@query("upsample_block", tall_sql("px[(k // 16 // 2) * 8 + (k % 16) // 2 + 1]", 256))
def upsample_block(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.upsample(F.col("px"), 8, 8, 2).alias("px")), "px")


@query("bin_mean", tall_sql("(px[(k // 4 * 2) * 8 + k % 4 * 2 + 1] + px[(k // 4 * 2) * 8 + k % 4 * 2 + 2] + px[(k // 4 * 2 + 1) * 8 + k % 4 * 2 + 1] + px[(k // 4 * 2 + 1) * 8 + k % 4 * 2 + 2]) / 4.0", 16, "DOUBLE"))
def bin_mean(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.bin_mean(F.col("px"), 8, 8, 2).alias("px")), "px", "double")


@query("pad_centre", tall_sql("CASE WHEN k // 10 BETWEEN 1 AND 8 AND k % 10 BETWEEN 1 AND 8 THEN px[(k // 10 - 1) * 8 + k % 10 - 1 + 1] END", 100))
def pad_centre(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.pad_centre(F.col("px"), 8, 8, 10, 10).alias("px")), "px")


# ---------------------------------------------------------------- pixel rules
@query("saturate_zero", tall_sql("CASE WHEN px[k + 1] = 100 THEN 0 ELSE px[k + 1] END"))
def saturate_zero(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.saturated_to_zero(F.col("px"), 100).alias("px")), "px")


@query("hot_zero", tall_sql("CASE WHEN px[k + 1] > 250 THEN 0 ELSE px[k + 1] END"))
def hot_zero(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.hot_to_zero(F.col("px"), 250).alias("px")), "px")


@query("hot_zero_inclusive", tall_sql("CASE WHEN px[k + 1] >= 250 THEN 0 ELSE px[k + 1] END"))
def hot_zero_inclusive(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.hot_to_zero(F.col("px"), 250, True).alias("px")), "px")


@query("floor_zero", tall_sql("CASE WHEN px[k + 1] < 30 THEN 0 ELSE px[k + 1] END"))
def floor_zero(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.floor_to_zero(F.col("px"), 30).alias("px")), "px")


@query(
    "inpaint_3x3",
    tall_sql("CASE k WHEN 9 THEN list_sort([px[1], px[2], px[3], px[9], px[10], px[11], px[17], px[18], px[19]])[5] WHEN 0 THEN list_sort([px[1], px[2], px[9], px[10]])[2] ELSE px[k + 1] END"),
)
def inpaint_3x3(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.inpaint(F.col("px"), 8, 8, [9, 0]).alias("px")), "px")


@query("amp_sqrt", tall_sql("sqrt(px[k + 1] / 1e5 * 1e4)", kind="DOUBLE"))
def amp_sqrt(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.amplitude(F.col("px")).alias("px")), "px", "double")


@query("engine_amp", tall_sql("sqrt(px[k + 1])", kind="DOUBLE"))
def engine_amp(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.engine_amplitude(A.amplitude(F.col("px"))).alias("px")), "px", "double")


@query("u8_truncate", tall_sql("floor(least(255, sqrt(px[k + 1])))", kind="INTEGER"))
def u8_truncate(spark, sf):
    return tall(frames(spark, sf).select("frame_id", A.to_uint8(F.col("px")).alias("px")), "px", "int")


@query("amp_phase", "SELECT vec_id AS frame_id, round(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2), 6) AS amp, round(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)), 6) AS phase FROM embeddings")
def amp_phase(spark, sf):
    a, p = A.amp_phase(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.round(a, 6).alias("amp"), F.round(p, 6).alias("phase"))


# ---------------------------------------------------------------- positions
@query("downsample_mean", f"WITH {POSITIONS} SELECT frame_id, round(x, 6) AS x, round(y, 6) AS y FROM p")
def downsample_mean(spark, sf):
    return positions(spark, sf).select("frame_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("min_points_gate", f"WITH {POSITIONS} SELECT count(*) AS n FROM p WHERE (SELECT count(*) FROM events) > 50 * 10")
def min_points_gate(spark, sf):
    return align.downsample(samples(spark, sf), 10, min_points=50).agg(F.count("*").alias("n"))


@query("counts_to_um", f"WITH {POSITIONS} SELECT frame_id, round(x * 0.5 * -1.0, 6) AS um FROM p")
def counts_to_um(spark, sf):
    return positions(spark, sf).select("frame_id", F.round(G.to_um(F.col("x"), RATIO, WAY), 6).alias("um"))


@query("foreshorten", f"WITH {POSITIONS} SELECT frame_id, round(x * abs(cos(radians(30.0))), 6) AS near, round(x * abs(sin(radians(-60.0))), 6) AS far FROM p")
def foreshorten(spark, sf):
    return positions(spark, sf).select("frame_id", F.round(G.foreshorten(F.col("x"), 30.0), 6).alias("near"), F.round(G.foreshorten(F.col("x"), ANGLE), 6).alias("far"))


@query("handedness", f"WITH {POSITIONS} SELECT frame_id, round(-x, 6) AS flipped, round(x, 6) AS same FROM p")
def handedness(spark, sf):
    return positions(spark, sf).select("frame_id", F.round(G.handed(F.col("x"), ANGLE, True), 6).alias("flipped"), F.round(G.handed(F.col("x"), ANGLE, False), 6).alias("same"))


@query("px_window", f"WITH {POSITIONS} SELECT frame_id, CAST(round_even(x / 0.75, 0) + 4 + 1 - 4 AS INTEGER) AS x0, CAST(round_even(x / 0.75, 0) + 4 + 1 + 4 AS INTEGER) AS x1, CAST(round_even(y / 0.75, 0) + 4 + 1 - 4 AS INTEGER) AS y0, CAST(round_even(y / 0.75, 0) + 4 + 1 + 4 AS INTEGER) AS y1 FROM p")
def px_window(spark, sf):
    p = positions(spark, sf)
    win = G.window(G.pixel_centre(F.col("y"), PIXEL, 8, 2), G.pixel_centre(F.col("x"), PIXEL, 8, 2), 8)
    return p.select("frame_id", win.alias("w")).select("frame_id", "w.*")


@query("clamp_windows", f"WITH {POSITIONS}, c AS (SELECT frame_id, round_even(x / 0.75, 0) AS v FROM p) SELECT frame_id, CAST(least(greatest(v, 4), 36) AS BIGINT) AS v, CAST(sum(CASE WHEN v < 4 OR v > 36 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS clamped FROM c")
def clamp_windows(spark, sf):
    c = positions(spark, sf).select("frame_id", F.rint(F.col("x") / PIXEL).alias("c"))
    v = c.withColumn("v", G.clamp_centre(F.col("c"), 8, 40).cast("bigint"))
    n = v.agg(F.count_if(F.col("v") != F.col("c")).alias("clamped"))
    return v.select("frame_id", "v").crossJoin(F.broadcast(n))


@query("scan_margin", f"WITH {POSITIONS} SELECT CAST(greatest(0, floor((200 - 8 - ceil((max(x) - min(x)) / 0.75)) / 2)) AS INTEGER) AS margin, CAST(8 + 4 + ceil((max(x) - min(x)) / 0.75) AS INTEGER) + CAST(8 + 4 + ceil((max(x) - min(x)) / 0.75) AS INTEGER) % 2 AS side FROM p")
def scan_margin(spark, sf):
    span = positions(spark, sf).agg((F.max("x") - F.min("x")).alias("r"))
    return span.select(G.scan_margin(200, 8, F.col("r"), PIXEL).alias("margin"), G.object_side(8, F.col("r"), PIXEL, 4).alias("side"))


@query("position_extent", f"WITH {POSITIONS} SELECT round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(max(x) - min(x), 6) AS xr, round(min(y), 6) AS y0, round(max(y), 6) AS y1, count(x) AS n FROM p")
def position_extent(spark, sf):
    r = lambda c: F.round(c, 6)
    return positions(spark, sf).agg(r(F.min("x")).alias("x0"), r(F.max("x")).alias("x1"), r(F.max("x") - F.min("x")).alias("xr"), r(F.min("y")).alias("y0"), r(F.max("y")).alias("y1"), F.count("x").alias("n"))


_RANGE = "c AS (SELECT min(x) AS lo, max(x) AS hi, min_by(x, frame_id) AS a, max_by(x, frame_id) AS b FROM p)"


@query("canvas_geometry", f"WITH {POSITIONS}, {_RANGE} SELECT CAST(ceil(greatest(hi - lo, 60.0 * 1.4) / 0.75) + 2 * 4 + 2 + 2 * 3 AS INTEGER) AS side, round(CASE WHEN hi - lo >= 30 THEN (lo + hi) / 2 WHEN b > a THEN lo + 30 ELSE hi - 30 END, 6) AS middle FROM c")
def canvas_geometry(spark, sf):
    t = positions(spark, sf).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min_by("x", "frame_id").alias("a"), F.max_by("x", "frame_id").alias("b"))
    return t.select(G.canvas_side(F.col("hi") - F.col("lo"), F.lit(60.0), 1.4, PIXEL, 4, 3).alias("side"), F.round(G.canvas_middle(F.col("lo"), F.col("hi"), F.col("a"), F.col("b"), F.lit(60.0)), 6).alias("middle"))


@query("base_offsets", f"WITH {POSITIONS} SELECT round(min(x), 6) AS fast, round(CASE WHEN max_by(y, frame_id) < min_by(y, frame_id) THEN min_by(y, frame_id) - 10 ELSE min_by(y, frame_id) END, 6) AS slow FROM p")
def base_offsets(spark, sf):
    t = positions(spark, sf).agg(F.min("x").alias("m"), F.min_by("y", "frame_id").alias("a"), F.max_by("y", "frame_id").alias("b"))
    fast, slow = G.base_offsets(F.col("m"), F.col("a"), F.col("b"), F.lit(10.0))
    return t.select(F.round(fast, 6).alias("fast"), F.round(slow, 6).alias("slow"))


@query("direction", f"WITH {POSITIONS} SELECT round(min_by(x, frame_id), 6) AS first, round(max_by(x, frame_id), 6) AS last, CAST(sign(max_by(x, frame_id) - min_by(x, frame_id)) AS INTEGER) AS way FROM p")
def direction(spark, sf):
    return ordered.travel(positions(spark, sf), "x", "frame_id").select(F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "way")


@query("raster_positions", "SELECT CAST(k AS BIGINT) AS frame_id, round((k % 20) * (10.0 / 20), 6) AS x, round((k // 20) * (5.0 / 10), 6) AS y FROM (SELECT unnest(range(200)) AS k)")
def raster_positions(spark, sf):
    x, y = G.raster(F.col("id"), 20, 10, 10.0, 5.0)
    return spark.range(200).select(F.col("id").alias("frame_id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("unit_conversion", "SELECT s_suppkey, round(12.39842 / (2 * 3.1355893 * sin(radians(8.0 + s_suppkey % 5))), 6) AS kev, round(1.2398 / (1 + s_suppkey % 12), 6) AS nm, round(-(CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE s_suppkey % 7 END) / 10000.0, 6) AS ratio FROM supplier")
def unit_conversion(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.round(G.bragg_energy_kev(8.0 + k % 5), 6).alias("kev"), F.round(G.wavelength_nm(1 + k % 12), 6).alias("nm"), F.round(G.encoder_ratio(k % 7), 6).alias("ratio"))


@query("scan_plan_range", "SELECT p_partkey, round(CASE WHEN p_type = 'ECONOMY' THEN p_retailprice - 100 ELSE (p_retailprice - 100) - (p_retailprice - 100) / p_size END, 8) AS r FROM part")
def scan_plan_range(spark, sf):
    kind = F.when(F.col("p_type") == "ECONOMY", "2D_FLY_PANDA").otherwise("FlyPlan2D")
    return table(spark, sf, "part").select("p_partkey", F.round(G.plan_range(kind, F.lit(100.0), F.col("p_retailprice"), F.col("p_size")), 8).alias("r"))


@query("upsample_ratio", "SELECT CAST(greatest(1, (SELECT count(*) FROM events) // (SELECT count(*) FROM embeddings)) AS BIGINT) AS ratio")
def upsample_ratio(spark, sf):
    a = table(spark, sf, "events").agg(F.count("*").alias("a"))
    b = table(spark, sf, "embeddings").agg(F.count("*").alias("b"))
    return a.crossJoin(F.broadcast(b)).select(G.upsample_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("unit_sniff", "SELECT max(abs(value)) < 1000 OR max(abs(user_id)) < 1000 AS um FROM events")
def unit_sniff(spark, sf):
    return samples(spark, sf).agg(G.in_um(F.max(F.abs("x")), F.max(F.abs("y"))).alias("um"))


@query("sniffed_counts", f"WITH {POSITIONS}, u AS (SELECT max(abs(x)) < 1000 OR max(abs(y)) < 1000 AS um FROM p) SELECT frame_id, round(CASE WHEN um THEN x / (0.5 * -1) ELSE x END, 6) AS counts FROM p, u")
def sniffed_counts(spark, sf):
    p = positions(spark, sf)
    um = p.agg(G.in_um(F.max(F.abs("x")), F.max(F.abs("y"))).alias("um"))
    return p.crossJoin(F.broadcast(um)).select("frame_id", F.round(G.as_counts(F.col("x"), F.col("um"), RATIO, WAY), 6).alias("counts"))


@query("position_capacity", f"WITH {POSITIONS} SELECT frame_id FROM p WHERE frame_id < 300 ORDER BY frame_id LIMIT 40")
def position_capacity(spark, sf):
    return align.within_capacity(positions(spark, sf), 300, loaded=10, target=50).select("frame_id")


@query("stitch_lockstep", f"WITH {PATCHES} SELECT cy - 4 + k // 8 AS y, cx - 4 + k % 8 AS x, count(*) AS c, CAST(sum(px[k + 1]) AS DOUBLE) AS s_amp, CAST(sum(px[k + 1] % 17) AS DOUBLE) AS s_phase FROM j, (SELECT unnest(range(64)) AS k) WHERE frame_id % 6 <> 5 GROUP BY 1, 2")
def stitch_lockstep(spark, sf):
    """Two values of each patch on one canvas; every sixth frame lacks the second and is in neither."""
    second = F.when(F.col("frame_id") % 6 != 5, F.transform("px", lambda v: v % 17))
    return mosaic.scatter_add_all(patches(spark, sf).select("*", F.col("px").alias("amp"), second.alias("phase")), 8, 8, ("amp", "phase"))


# ---------------------------------------------------------------- filters
@query("stride_sample", "SELECT vec_id AS frame_id, vec_id // 7 AS row FROM embeddings WHERE vec_id % 7 = 0")
def stride_sample(spark, sf):
    return ordered.strided(frames(spark, sf), "frame_id", 7).select("frame_id", "row")


@query("skip_limit", "SELECT vec_id AS frame_id FROM embeddings WHERE vec_id >= 10 AND vec_id < 35")
def skip_limit(spark, sf):
    from ..sources.frames import take_range

    return take_range(frames(spark, sf), 10, 25).select("frame_id")


@query("finite_filter", "SELECT event_id AS frame_id FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0")
def finite_filter(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("frame_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"), F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("y"))
    return e.where(align.known("x", "y")).select("frame_id")


@query("canvas_filter", f"WITH {PATCHES} SELECT frame_id FROM j WHERE cy >= 5 AND cy < 40 - 5 AND cx >= 5 AND cx < 60 - 5")
def canvas_filter(spark, sf):
    p = patches(spark, sf).withColumns({"cy": F.rint("cy"), "cx": F.rint("cx")})
    return mosaic.in_canvas(p, 4, 4, 40, 60).select("frame_id")


@query("first_frame_guard", "SELECT min(vec_id) AS first FROM embeddings")
def first_frame_guard(spark, sf):
    return ordered.check_first(frames(spark, sf), "frame_id")


@query("engine_capacity", "WITH b AS (SELECT label AS batch_no, count(*) AS n FROM embeddings GROUP BY 1), u AS (SELECT *, CAST(sum(n) OVER (ORDER BY batch_no) AS BIGINT) AS upto FROM b) SELECT CAST(batch_no AS INTEGER) AS batch_no, n, upto FROM u WHERE upto <= 300")
def engine_capacity(spark, sf):
    b = frames(spark, sf).groupBy(F.col("grp").alias("batch_no")).agg(F.count("*").alias("n"))
    return align.capacity(b, 300)


@query("ready_min", f"WITH {POSITIONS} SELECT (SELECT count(*) FROM embeddings) AS frames, (SELECT count(*) FROM p) AS positions, least((SELECT count(*) FROM embeddings), (SELECT count(*) FROM p), 400) AS ready")
def ready_min(spark, sf):
    return align.ready_counts(frames(spark, sf), positions(spark, sf), 400)


# ---------------------------------------------------------------- joins
@query("join_ready", f"WITH {FRAMES}, {POSITIONS} SELECT frame_id, round(x, 6) AS x, round(y, 6) AS y FROM f JOIN p USING (frame_id)")
def join_ready(spark, sf):
    return align.ready(frames(spark, sf), positions(spark, sf)).select("frame_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("join_pending", f"WITH {FRAMES}, {POSITIONS} SELECT frame_id FROM f ANTI JOIN p USING (frame_id)")
def join_pending(spark, sf):
    return align.pending(frames(spark, sf), positions(spark, sf)).select("frame_id")


@query("gather_intersect", f"WITH {POSITIONS} SELECT frame_id FROM p INTERSECT SELECT vec_id FROM embeddings")
def gather_intersect(spark, sf):
    return positions(spark, sf).select("frame_id").intersect(frames(spark, sf).select("frame_id"))


@query("gather_left_only", f"WITH {POSITIONS} SELECT vec_id AS frame_id, 'frame' AS side FROM embeddings WHERE vec_id NOT IN (SELECT frame_id FROM p) UNION ALL SELECT frame_id, 'position' FROM p WHERE frame_id NOT IN (SELECT vec_id FROM embeddings)")
def gather_left_only(spark, sf):
    f, p = frames(spark, sf).select("frame_id"), positions(spark, sf).select("frame_id")
    return f.exceptAll(p).withColumn("side", F.lit("frame")).unionByName(p.exceptAll(f).withColumn("side", F.lit("position")))


@query("prefix_release", f"WITH {FRAMES}, {POSITIONS}, a AS (SELECT f.frame_id, (f.frame_id * 7) % 500 AS arrival, p.x FROM f LEFT JOIN (SELECT * FROM p WHERE frame_id % 50 <> 49) p USING (frame_id)) SELECT frame_id, arrival FROM a WHERE x IS NOT NULL AND arrival < (SELECT min(arrival) FROM a WHERE x IS NULL)")
def prefix_release(spark, sf):
    f = frames(spark, sf).select("frame_id", (F.col("frame_id") * 7 % 500).alias("arrival"))
    return align.prefix_release(f, positions(spark, sf).where("frame_id % 50 != 49")).select("frame_id", "arrival")


@query("frame_lead", f"WITH {POSITIONS} SELECT (SELECT max(vec_id) FROM embeddings) AS newest, count(*) AS placed, (SELECT max(vec_id) FROM embeddings) - count(*) AS lead FROM p")
def frame_lead(spark, sf):
    from ..streaming.pipelines import lead

    return lead(frames(spark, sf), positions(spark, sf))


@query("finite_object", "SELECT vec_id AS frame_id, CAST(list_sum(list_transform(embedding, lambda v: CASE WHEN isfinite(v) THEN 1 ELSE 0 END)) AS BIGINT) AS finite FROM embeddings")
def finite_object(spark, sf):
    good = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.size(F.filter("embedding", good)).cast("bigint").alias("finite"))


@query("live_result_guard", "SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 1 AND vec_id % 7 <> 2 AND vec_id % 11 <> 3 AND vec_id % 13 <> 4")
def live_result_guard(spark, sf):
    """Numbers that are not finite in the probe, infinite ones in the object, and an object of NaN alone are held back; some
    NaN in the object is not."""
    from ..sources.sinks import sound

    e, k = F.transform("embedding", lambda v: v.cast("double")), F.col("vec_id")
    nan, inf = F.lit(float("nan")), F.lit(float("-inf"))
    spoilt = lambda where, by: F.transform(e, lambda v, i: F.when(where & (i == k % 64), by).otherwise(v))
    obj = F.transform(spoilt(k % 3 == 0, nan), lambda v: F.when(k % 13 == 4, nan).otherwise(v))
    ok = sound(spoilt(k % 5 == 1, nan), spoilt(k % 7 == 2, inf), obj, spoilt(k % 11 == 3, inf))
    return table(spark, sf, "embeddings").where(ok).select("vec_id")


_OFFLINE = f"{FRAMES}, u AS (SELECT greatest(1, (SELECT count(*) FROM events) // (SELECT count(*) FROM embeddings)) AS n), p AS (SELECT event_id // n AS frame_id, avg(value) AS x, avg(CAST(user_id AS DOUBLE)) AS y FROM events, u GROUP BY event_id // n, n HAVING count(*) = n), r AS (SELECT f.frame_id, p.x, p.y, list_transform(range(24), lambda k: px[(7 - (k // 4 + 1)) * 8 + k % 4 + 2 + 1]) AS c FROM f LEFT JOIN p USING (frame_id)), h AS (SELECT frame_id, x, y, list_transform(c, lambda v: CASE WHEN v > 250 THEN 0 ELSE v END) AS c FROM r)"


@query("offline_dump", f"WITH {_OFFLINE} SELECT frame_id, k, CAST(c[(5 - k % 6) * 4 + k // 6 + 1] AS BIGINT) AS v, round(y, 6) AS slow, round(-x * abs(sin(radians(-60))), 6) AS fast, (SELECT CAST(max(list_max(list_filter(c, lambda v: v <= 250))) AS BIGINT) FROM h) AS top FROM h, (SELECT unnest(range(24)) AS k)")
def offline_dump(spark, sf):
    """A scan dumped for offline work and read back: flipped, cropped to 6 x 4, without hot pixels, turned clockwise; its
    positions under a tilt; and the normalisation among its scalars."""
    import json

    from ..sources import sinks
    from .session import delete_at_exit, fresh_path

    base = fresh_path(spark, "offline")
    scan = sinks.OfflineScan(8, 8, (1, 7, 2, 6), orientation="rot90_cw", hot=250, angle=-60.0)
    sinks.write_offline(frames(spark, sf).select("frame_id", "px"), samples(spark, sf), base, "scan", scan)
    delete_at_exit(spark, base)
    dp, p, run = (spark.read.parquet(sinks.table_path(base, "scan", kind)) for kind in ("frames", "positions", "run"))
    top = int(json.loads(run.first()["metadata"]["normalization"]))
    pixels = dp.join(p, "frame_id").select("frame_id", F.posexplode("dp").alias("k", "v"), "slow_um", "fast_um")
    return pixels.select("frame_id", F.col("k").cast("bigint").alias("k"), "v", F.round("slow_um", 6).alias("slow"), F.round("fast_um", 6).alias("fast"), F.lit(top).cast("bigint").alias("top"))


@query("sample_pixel", "SELECT s_suppkey, round(1e-10 * (1 + s_suppkey % 3) * 0.5 / (64 * (55 + s_suppkey % 2 * 20) * 1e-6) * 1e9, 6) AS nm FROM supplier")
def sample_pixel(spark, sf):
    k = F.col("s_suppkey")
    px = G.sample_pixel_m((k % 3 + 1) * 1e-10, F.lit(0.5), 64, (k % 2 * 20 + 55).cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(px * 1e9, 6).alias("nm"))


@query("compare_positions", f"WITH {POSITIONS}, q AS (SELECT event_id // 10 AS frame_id, min(value) AS x FROM events GROUP BY 1) SELECT count(*) AS n, round(avg(p.x - q.x), 6) AS mean, round(stddev_pop(p.x - q.x), 6) AS sd, round(max(abs(p.x - q.x)), 6) AS most, round(regr_slope(p.x, q.x), 6) AS slope, round(regr_intercept(p.x, q.x), 6) AS intercept FROM p JOIN q USING (frame_id)")
def compare_positions(spark, sf):
    q = samples(spark, sf).groupBy(F.floor(F.col("sample") / 10).cast("bigint").alias("frame_id")).agg(F.min("x").alias("x"))
    out = align.compare(positions(spark, sf), q, "x")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "most", "slope", "intercept")])


@query("paired_rows", "SELECT a.vec_id // 5 AS row, a.vec_id AS dp, b.vec_id AS pred FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id % 5 = 0 AND b.vec_id % 5 = 1")
def paired_rows(spark, sf):
    f = frames(spark, sf).select("frame_id", F.floor(F.col("frame_id") / 5).alias("row"))
    dp = f.where("frame_id % 5 = 0").select("row", F.col("frame_id").alias("dp"))
    return dp.join(f.where("frame_id % 5 = 1").select("row", F.col("frame_id").alias("pred")), "row")


# ---------------------------------------------------------------- order
@query("batch_64", "WITH b AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) // 64 AS batch_no FROM events) SELECT event_id, batch_no FROM b WHERE (SELECT count(*) FROM b c WHERE c.user_id = b.user_id AND c.batch_no = b.batch_no) = 64")
def batch_64(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return ordered.batches(e, 64, "event_id", ("user_id",)).select("event_id", "batch_no")


@query("batch_carry", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) // 64 AS batch_no FROM events")
def batch_carry(spark, sf):
    """The rest of each run that fills no batch is kept."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    return ordered.batches(e, 64, "event_id", ("user_id",), keep_rest=True).select("event_id", "batch_no")


@query("batch_by_run", "WITH b AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch_no FROM events) SELECT user_id, event_id, batch_no FROM b QUALIFY count(*) OVER (PARTITION BY user_id, batch_no) = 8")
def batch_by_run(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    return ordered.batches(e, 8, "event_id", ("user_id",))


@query("overlap_batches", "WITH b AS (SELECT DISTINCT event_id // 64 AS batch_no FROM events), g AS (SELECT batch_no, unnest(range(greatest(0, CAST(ceil((batch_no - 3) / 3.0) AS BIGINT)), batch_no // 3 + 1)) AS group_no FROM b) SELECT batch_no, group_no, CAST(group_no % 2 AS INTEGER) AS port FROM g")
def overlap_batches(spark, sf):
    b = table(spark, sf, "events").select(F.floor(F.col("event_id") / 64).alias("batch_no")).distinct()
    return ordered.overlapping(b, 4, 1, 2)


@query("packet_prefix", "WITH k AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 2 OR conv_id % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM k) SELECT conv_id, turn FROM r WHERE turn = i")
def packet_prefix(spark, sf):
    c = table(spark, sf, "conversations").where("turn != 2 OR conv_id % 3 != 0").select("conv_id", "turn", F.hash("conv_id", "turn").alias("arrival"))
    return ordered.in_order_prefix(c, "turn", ("conv_id",)).select("conv_id", "turn")


@query("scan_split", "SELECT conv_id % 10 AS run, conv_id, turn, CAST(sum(CASE WHEN turn < prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS BIGINT) AS scan_seq FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS prev FROM conversations)")
def scan_split(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("run"), "conv_id", "turn")
    return ordered.scan_split(c, "turn", ["conv_id", "turn"], ("run",))


@query("contiguity", "WITH r AS (SELECT user_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g, event_id FROM events) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, g")
def contiguity(spark, sf):
    return ordered.islands(table(spark, sf, "events").select("user_id", "event_id"), "event_id", ("user_id",))


@query("high_water", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events")
def high_water(spark, sf):
    return ordered.high_water(table(spark, sf, "events").select("user_id", "event_id", "value"), "value", "event_id", ("user_id",)).select("user_id", "event_id", "seen")


@query("history_ring", "SELECT CAST(event_id % 7 AS BIGINT) AS slot, max(event_id) AS it, max_by(value, event_id) AS value FROM events GROUP BY 1")
def history_ring(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("it"), "value")
    return ordered.ring(e, "it", 7).select(F.col("slot").cast("bigint").alias("slot"), "it", "value")


@query("progress_counts", "SELECT count(value) AS finite, CAST(ceil(count(*) / 64.0) AS BIGINT) AS batches, max(event_id) + 1 AS high_water FROM events")
def progress_counts(spark, sf):
    return table(spark, sf, "events").agg(F.count("value").alias("finite"), F.ceil(F.count("*") / 64).alias("batches"), (F.max("event_id") + 1).alias("high_water"))


# ---------------------------------------------------------------- mosaics
@query("stitch_sum", f"WITH {CANVAS} SELECT y, x, s, c FROM canvas")
def stitch_sum(spark, sf):
    return canvas(spark, sf)


@query("stitch_norm", f"WITH {CANVAS}, m AS (SELECT y, x, CASE WHEN c >= 2 THEN s / c END AS m FROM canvas) SELECT y, x, round(coalesce(m, (SELECT median(m) FROM m)), 6) AS v FROM m")
def stitch_norm(spark, sf):
    return mosaic.normalise(canvas(spark, sf), 2).select("y", "x", F.round("v", 6).alias("v"))


@query("coverage", f"WITH {CANVAS} SELECT round(sum(CASE WHEN c >= 0.5 THEN 1 ELSE 0 END) / 12000.0, 6) AS coverage FROM canvas")
def coverage(spark, sf):
    return mosaic.coverage(canvas(spark, sf), 100, 120).select(F.round("coverage", 6).alias("coverage"))


@query("bbox", f"WITH {CANVAS} SELECT min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM canvas WHERE c > 0")
def bbox(spark, sf):
    return mosaic.bounding_box(canvas(spark, sf))


@query("border_crop", f"WITH {CANVAS} SELECT x - 3 AS y, y - 3 AS x, s, c FROM canvas WHERE y >= 3 AND y < 37 AND x >= 3 AND x < 57")
def border_crop(spark, sf):
    return mosaic.border_crop(canvas(spark, sf), 40, 60, 3, transpose=True)


@query("canvas_bin", f"WITH {CANVAS} SELECT CAST(floor(y / 2.0) AS BIGINT) AS y, CAST(floor(x / 2.0) AS BIGINT) AS x, round(sum(s) / 4, 6) AS s, round(sum(c) / 4, 6) AS c FROM canvas GROUP BY 1, 2")
def canvas_bin(spark, sf):
    return mosaic.bin_canvas(canvas(spark, sf), 2).select("y", "x", F.round("s", 6).alias("s"), F.round("c", 6).alias("c"))


@query("mean_image", f"WITH {FRAMES} SELECT k, round(avg(px[k + 1]), 6) AS mean FROM f, (SELECT unnest(range(64)) AS k) GROUP BY k")
def mean_image(spark, sf):
    return mosaic.mean_frame(frames(spark, sf)).select(F.col("k").cast("bigint").alias("k"), F.round("mean", 6).alias("mean"))


@query("max_excl_hot", f"WITH {FRAMES} SELECT max(v) AS most FROM (SELECT unnest(px) AS v FROM f) WHERE v <= 250")
def max_excl_hot(spark, sf):
    return mosaic.brightest(frames(spark, sf), 250)


@query("percentile_stretch", f"WITH {CANVAS} SELECT round(quantile_cont(s, 0.02), 6) AS p2, round(median(s), 6) AS p50, round(quantile_cont(s, 0.98), 6) AS p98 FROM canvas")
def percentile_stretch(spark, sf):
    return mosaic.percentile_stretch(canvas(spark, sf), "s").select(*[F.round(c, 6).alias(c) for c in ("p2", "p50", "p98")])


@query("merge_results", f"WITH {CANVAS}, a AS (SELECT y, x, s / c AS v FROM canvas WHERE y % 3 <> 0), b AS (SELECT y, x, s AS v FROM canvas WHERE x % 2 = 0) SELECT y, x, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN (a.v + b.v) / 2 ELSE coalesce(a.v, b.v, 0) END, 6) AS v FROM a FULL JOIN b USING (y, x)")
def merge_results(spark, sf):
    c = canvas(spark, sf)
    out = mosaic.merge_pairs(c.where("y % 3 != 0").select("y", "x", (F.col("s") / F.col("c")).alias("v")), c.where("x % 2 = 0").select("y", "x", F.col("s").alias("v")))
    return out.select("y", "x", F.round("v", 6).alias("v"))


@query("coverage_mask", f"WITH {CANVAS} SELECT y, x, CASE WHEN c > 2 THEN s END AS v FROM canvas")
def coverage_mask(spark, sf):
    c = canvas(spark, sf).select("y", "x", F.col("s").alias("v"), F.col("c").alias("norm"))
    return mosaic.mask_uncovered(c, 2.0).select("y", "x", "v")


@query("error_metric", f"WITH {FRAMES}, m AS (SELECT k, avg(sqrt(px[k + 1])) AS m FROM f, (SELECT unnest(range(64)) AS k) GROUP BY k) SELECT frame_id, round(sum((sqrt(px[k + 1]) - m) ** 2), 5) AS err FROM f, m GROUP BY frame_id")
def error_metric(spark, sf):
    amp = frames(spark, sf).select("frame_id", F.transform("px", lambda v: F.sqrt(v)).alias("px"))
    mean = mosaic.mean_frame(amp)  # 64 rows
    each = amp.select("frame_id", F.posexplode("px").alias("k", "a")).join(F.broadcast(mean), "k")
    return each.groupBy("frame_id").agg(F.round(F.sum((F.col("a") - F.col("mean")) ** 2), 5).alias("err"))


@query("circular_centroid", f"WITH {CANVAS} SELECT round(atan2(sum(s * sin(2 * pi() * y / 128)), sum(s * cos(2 * pi() * y / 128))), 6) AS ay, round(atan2(sum(s * sin(2 * pi() * x / 128)), sum(s * cos(2 * pi() * x / 128))), 6) AS ax FROM canvas")
def circular_centroid(spark, sf):
    return canvas(spark, sf).agg(*[F.round(mosaic.centroid_angle("s", c, 128), 6).alias(n) for c, n in (("y", "ay"), ("x", "ax"))])


# ---------------------------------------------------------------- lines
_LINE = "WITH d AS (SELECT event_id AS i, event_id * 0.01 + value / 1000 + CASE WHEN event_id < 60 THEN 90 ELSE 0 END AS v FROM events), a0 AS (SELECT regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM d), k1 AS (SELECT i, v FROM d, a0 WHERE abs(v - (a + b * i)) <= 5), a1 AS (SELECT regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM k1), k2 AS (SELECT i, v FROM d, a1 WHERE abs(v - (a + b * i)) <= 5), a2 AS (SELECT regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM k2)"


def _track(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(i.alias("frame_id"), (i * 0.01 + F.col("value") / 1000 + F.when(i < 60, 90).otherwise(0)).alias("v"))


@query("line_fit", _LINE + " SELECT round(a, 6) AS a, round(b, 8) AS b FROM a2")
def line_fit(spark, sf):
    a, b = lines.fit_line(_track(spark, sf), "v", 5.0)
    return spark.range(1).select(F.round(F.lit(a), 6).alias("a"), F.round(F.lit(b), 8).alias("b"))


@query("slow_gate", _LINE + " SELECT i AS frame_id FROM d, a2 WHERE abs(v - (a + b * i)) <= 5")
def slow_gate(spark, sf):
    d = _track(spark, sf)
    return lines.on_line(d, "v", lines.fit_line(d, "v", 5.0), 5.0).select("frame_id")


# ---------------------------------------------------------------- lookups
@query("latest_run", "SELECT o_custkey, max_by(o_orderkey, o_orderdate * 1.0) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, epoch(o_orderdate) * 1e9 + o_orderkey AS o_orderdate FROM orders) GROUP BY 1")
def latest_run(spark, sf):
    return lookup.latest(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("lookup_default", "SELECT c_custkey, CAST(coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 55.0 END, 75.0) AS DOUBLE) AS pixel_um FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_default(spark, sf):
    known = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(55.0).alias("pixel_um"))
    return lookup.with_default(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), known, "c_nationkey", "pixel_um", G.PIXEL_UM).select("c_custkey", "pixel_um")


@query("defaults_merge", "WITH v AS (SELECT n_name AS key, 'given' AS value FROM nation WHERE n_nationkey < 10), d AS (SELECT n_name AS key, 'default' AS value FROM nation WHERE n_nationkey BETWEEN 5 AND 20), o AS (SELECT n_name AS key, 'over' AS value FROM nation WHERE n_nationkey % 4 = 0) SELECT key, coalesce(o.value, v.value, d.value) AS value FROM v FULL JOIN d USING (key) FULL JOIN o USING (key)")
def defaults_merge(spark, sf):
    n = table(spark, sf, "nation")
    part = lambda cond, v: n.where(cond).select(F.col("n_name").alias("key"), F.lit(v).alias("value"))
    return lookup.merge_defaults(part("n_nationkey < 10", "given"), part("n_nationkey BETWEEN 5 AND 20", "default"), part("n_nationkey % 4 = 0", "over"))


@query("cached_flag", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents")
def cached_flag(spark, sf):
    return lookup.flagged(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "cached")


@query("version_max", "SELECT p_type, CAST(max(CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER)) AS VARCHAR) AS version FROM part GROUP BY 1")
def version_max(spark, sf):
    p = table(spark, sf, "part").select("p_type", F.regexp_extract("p_brand", r"#(\d+)", 1).alias("version"))
    return lookup.newest_version(p, "p_type", "version")


@query("ranked_candidates", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5")
def ranked_candidates(spark, sf):
    return lookup.best(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 5, "s_suppkey")


@query("candidate_columns", "SELECT s_suppkey, coalesce(s_name, 'x') AS name FROM supplier")
def candidate_columns(spark, sf):
    return lookup.first_of(table(spark, sf, "supplier"), ["absent", "s_name"], "name").select("s_suppkey", "name")


_CELL = "coalesce(least(3, floor(({0} - min({0}) OVER ()) * 4 / nullif(max({0}) OVER () - min({0}) OVER (), 0))), 0)"


@query("spread_sample", f"WITH {POSITIONS}, c AS (SELECT frame_id, x, y, {_CELL.format('x')} * 4 + {_CELL.format('y')} AS cell FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY frame_id) AS nth FROM c) SELECT frame_id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT * FROM n ORDER BY nth, cell LIMIT 20)")
def spread_sample(spark, sf):
    return lookup.spread_sample(positions(spark, sf), 20, "x", "y", 4, "frame_id").select("frame_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("endpoint_host", "SELECT page_id, regexp_extract(url, '^\\w+://([^/:]+)', 1) AS host FROM pages")
def endpoint_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.endpoint_host(F.col("url")).alias("host"))


@query("model_filename", "SELECT p_partkey, regexp_extract(f, '^(.+?)_v(\\d+)\\.engine$', 1) AS name, TRY_CAST(regexp_extract(f, '^(.+?)_v(\\d+)\\.engine$', 2) AS INTEGER) AS version FROM (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_v' || p_size END || '.engine' AS f FROM part)")
def model_filename(spark, sf):
    f = F.concat(F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("_v"), F.col("p_size").cast("string"))), F.lit(".engine"))
    name, version = T.model_name_version(f)
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), version.alias("version"))


@query("config_coercion", "SELECT event_id, TRY_CAST(v AS BIGINT) AS i, TRY_CAST(v AS DOUBLE) AS d, v AS s FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type ELSE '' END AS v FROM events)")
def config_coercion(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("")
    i, d, s = T.coerced(F.col("v"))
    return table(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", i.alias("i"), d.alias("d"), s.alias("s"))


@query("json_header", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_header(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("throughput", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def throughput(spark, sf):
    """Counts per interval; the live form counts per second of processing time."""
    return table(spark, sf, "events").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


# ---------------------------------------------------------------- messages, and what SQL cannot say
@query("decode_raw", tall_sql("px[k + 1]"))
def decode_raw(spark, sf):
    from ..sources.frames import decode_frames, encode_frames

    return tall(decode_frames(encode_frames(frames(spark, sf), 8, 8)), "px")


@query("decode_compressed", f"WITH {FRAMES}, w AS (SELECT unnest(['bs16-lz4<', 'bs32-lz4<', 'lz4<']) AS encoding, unnest([1, 1000, 1]) AS scale) SELECT frame_id, encoding, k, CAST(px[k + 1] * scale AS BIGINT) AS v FROM f, w, (SELECT unnest(range(64)) AS k)")
def decode_compressed(spark, sf):
    """Frames of 16 and 32 bits in each compressed encoding, and back."""
    from ..sources.frames import compress_frames, decode_frames

    out = None
    for encoding, kind, by in (("bs16-lz4<", "uint16", 1), ("bs32-lz4<", "uint32", 1000), ("lz4<", "uint16", 1)):
        f = frames(spark, sf).select("frame_id", F.transform("px", lambda v: v * by).alias("px"))
        back = decode_frames(compress_frames(f, 8, 8, encoding, kind)).select("frame_id", F.lit(encoding).alias("encoding"), F.posexplode("px").alias("k", "v"))
        out = back if out is None else out.unionByName(back)
    return out.withColumn("k", F.col("k").cast("bigint"))


@query("decode_cbor", tall_sql("px[k + 1]"))
def decode_cbor(spark, sf):
    from ..sources.frames import decode_cbor, encode_cbor

    return tall(decode_cbor(encode_cbor(frames(spark, sf), 8, 8)), "px")


@query("packet_parse", "SELECT event_id AS sample, value AS x, CAST(user_id AS DOUBLE) AS y FROM events")
def packet_parse(spark, sf):
    from ..sources.frames import packet_messages, parse_packets, samples_of

    channels = ("/fast", "/slow")
    return samples_of(parse_packets(packet_messages(samples(spark, sf), 41, channels), channels), 41)


@query("dense_buffer", "SELECT CAST(r AS BIGINT) AS row, coalesce(v, 0) AS v FROM (SELECT unnest(range(1 + (SELECT max(user_id) FROM events))) AS r) LEFT JOIN (SELECT user_id, max_by(CAST(floor(value) AS INTEGER), event_id) AS v FROM events GROUP BY 1) ON r = user_id")
def dense_buffer(spark, sf):
    from ..sources.sinks import dense

    e = table(spark, sf, "events").select(F.col("user_id").alias("row"), F.floor("value").cast("int").alias("v"), F.col("event_id").alias("batch_no"))
    return dense(e, "row", "v", "batch_no", 0)


@query("fft_power", f"WITH {FRAMES} SELECT frame_id, round(CAST(list_sum(list_transform(px, lambda v: v * v)) AS DOUBLE), 2) AS power FROM f")
def fft_power(spark, sf):
    """The power of the spectrum, which is that of the frame."""
    from ..operators.recon import fft_power as power

    return power(frames(spark, sf).select("frame_id", F.transform("px", lambda v: v.cast("double")).alias("amp")), 8).select("frame_id", F.round("power", 2).alias("power"))


@query("infer_patches", f"WITH {FRAMES}, s AS (SELECT frame_id, k, px[k + 1] / CASE WHEN list_sum(px) > 0 THEN list_sum(px) / 64.0 ELSE 1 END AS r FROM f, (SELECT unnest(range(64)) AS k)) SELECT frame_id, k, round(r, 6) AS amp, round(atan(r - 1), 6) AS phase FROM s")
def infer_patches(spark, sf):
    from ..operators.recon import infer

    out = infer(frames(spark, sf).select("frame_id", F.transform("px", lambda v: v.cast("double")).alias("amp")), 8)
    tall = out.select("frame_id", F.posexplode(F.arrays_zip("amp", "phase")).alias("k", "v"))
    return tall.select("frame_id", F.col("k").cast("bigint").alias("k"), F.round("v.amp", 6).alias("amp"), F.round("v.phase", 6).alias("phase"))


_BEAM = f"""WITH RECURSIVE {FRAMES}, m AS (SELECT grp, k, avg(px[k + 1]) AS m FROM f, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2),
t AS (SELECT grp, max(m) AS top FROM m GROUP BY 1), b AS (SELECT grp, k FROM m JOIN t USING (grp) WHERE m > 0.5 * top AND top > 0),
r AS (SELECT grp, k AS src, k FROM b UNION SELECT r.grp, r.src, b.k FROM r JOIN b ON b.grp = r.grp AND (abs(b.k - r.k) = 8 OR (abs(b.k - r.k) = 1 AND b.k // 8 = r.k // 8))),
l AS (SELECT grp, k, min(src) AS root FROM r GROUP BY 1, 2), s AS (SELECT grp, root, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, root) AS n FROM l GROUP BY 1, 2),
x AS (SELECT grp, min(k // 8) AS a, max(k // 8) + 1 AS b, min(k % 8) AS c, max(k % 8) + 1 AS d FROM l JOIN s USING (grp, root) WHERE n = 1 GROUP BY 1),
p AS (SELECT *, round_even((a + b) / 2.0 - 2, 0) AS py, round_even((c + d) / 2.0 - 2, 0) AS px FROM x), q AS (SELECT *, least(greatest(py, 0), 4) AS ky, least(greatest(px, 0), 4) AS kx FROM p)
SELECT t.grp, CAST(ky AS INTEGER) AS y0, CAST(ky + 4 AS INTEGER) AS y1, CAST(kx AS INTEGER) AS x0, CAST(kx + 4 AS INTEGER) AS x1, coalesce(ky <> py OR kx <> px, false) AS clamped, CAST(a AS INTEGER) AS by0, CAST(b AS INTEGER) AS by1, CAST(c AS INTEGER) AS bx0, CAST(d AS INTEGER) AS bx1 FROM t LEFT JOIN q USING (grp)"""


@query("center_box", _BEAM)
def center_box(spark, sf):
    from ..operators.blob import center_box as box

    return box(frames(spark, sf), 8, 8, 4, 4, keys=("grp",), threshold=0.5)


def solver_frames(spark, sf) -> DataFrame:
    p = positions(spark, sf).select("frame_id", F.least(F.lit(56), F.rint("x").cast("int")).alias("x0"), F.least(F.lit(92), F.rint("y").cast("int")).alias("y0"))
    amp = F.transform("px", lambda v: F.sqrt(v.cast("double")))
    return frames(spark, sf).select("frame_id", amp.alias("amp")).join(p, "frame_id")


@query("ml_iteration")
def ml_iteration(spark, sf):
    from ..operators import recon

    config = recon.SolverConfig(8, 100, 64)
    _, _, errors = recon.reconstruct(solver_frames(spark, sf), config, iterations=3)
    return spark.createDataFrame(list(enumerate(errors)), "iteration long, error double")


@query("ml_tiled")
def ml_tiled(spark, sf):
    """The object after three rounds on tiles, where windows cover it."""
    from ..operators import object_tiles, recon

    config = recon.SolverConfig(8, 100, 64)
    tiles, _, _ = object_tiles.reconstruct_tiled(solver_frames(spark, sf), config, iterations=3)
    out = object_tiles.object_pixels(tiles, config.alpha)
    return out.select("y", "x", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query("epie")
def epie(spark, sf):
    import numpy as np

    from ..operators import recon

    config = recon.SolverConfig(8, 100, 64)
    scans = solver_frames(spark, sf).withColumn("scan_seq", F.floor(F.col("frame_id") / 32))
    return recon.epie(scans, config, np.ones((8, 8), complex))


_WAVE = "2 * pi() * ((u // 8) * ((k // 8 + 4) % 8) + (u % 8) * ((k % 8 + 4) % 8)) / 8"


@query("probe_init", f"WITH {FRAMES}, {POSITIONS}, m AS (SELECT u, avg(sqrt(px[u + 1])) AS m FROM f JOIN p USING (frame_id), (SELECT unnest(range(64)) AS u) GROUP BY u) SELECT k, round(sqrt(sum(m * cos({_WAVE})) ** 2 + sum(m * sin({_WAVE})) ** 2) / 8, 5) AS amp FROM m, (SELECT unnest(range(64)) AS k) GROUP BY k")
def probe_init(spark, sf):
    import numpy as np

    from ..operators import recon

    p = recon.start_probe(solver_frames(spark, sf), 8)
    return spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(np.abs(p).ravel())], "k long, amp double").select("k", F.round("amp", 5).alias("amp"))


def _turned_sql(name: str) -> str:
    swap, up, left = A.SYMMETRIES[name]
    row, col = ("7 - r" if up else "r"), ("7 - c" if left else "c")
    return f"SELECT '{name}' AS name, round(avg(abs(({col if swap else row}) - x / 10)), 6) AS score FROM m"


_CENTRES = f"WITH {FRAMES}, {POSITIONS}, m AS (SELECT frame_id, x, sum(px[k + 1] * (k // 8)) / sum(px[k + 1]) AS r, sum(px[k + 1] * (k % 8)) / sum(px[k + 1]) AS c FROM f JOIN p USING (frame_id), (SELECT unnest(range(64)) AS k) GROUP BY 1, 2) "


@query("orientation_scores", _CENTRES + " UNION ALL ".join(map(_turned_sql, A.SYMMETRIES)))
def orientation_scores(spark, sf):
    """Orientations by how far the centre of a frame's counts, in rows, is from what its position says."""
    from ..operators.recon import detect_orientation

    total = lambda px, of: F.aggregate(F.transform(px, of), F.lit(0.0), lambda s, v: s + v)
    score = lambda px, x, y: A.bound(px, lambda q: F.abs(total(q, lambda v, k: v * (k / 8).cast("int") * 1.0) / total(q, lambda v: v * 1.0) - x / 10))
    found = detect_orientation(frames(spark, sf), positions(spark, sf), 8, score)
    return found.select("name", F.round("score", 6).alias("score"))


_DEALT = "SELECT floor(y) + dy AS y, floor(x) + dx AS x, v, CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS wt FROM t, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)"


@query("stitch_interpolated", f"WITH {FRAMES}, {POSITIONS}, t AS (SELECT (p.y - 3.5) + k // 8 AS y, (p.x - 3.5) + k % 8 AS x, px[k + 1] AS v FROM f JOIN p USING (frame_id), (SELECT unnest(range(64)) AS k) WHERE px[k + 1] <> 0), d AS ({_DEALT}) SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sum(wt), 5) AS c, round(sum(wt * v) / sum(wt), 4) AS v FROM d WHERE wt > 0 GROUP BY 1, 2")
def stitch_interpolated(spark, sf):
    return mosaic.stitch_interpolated(patches(spark, sf), 8, 8).select("y", "x", F.round("c", 5).alias("c"), F.round("v", 4).alias("v"))


@query("raster_source", "SELECT CAST(k AS BIGINT) AS frame_id, round((k % 20) * (10.0 / 20), 6) AS x, round((k // 20) * (5.0 / 10), 6) AS y FROM (SELECT unnest(range(200)) AS k)")
def raster_source(spark, sf):
    from ..sources.frames import RasterSource

    spark.dataSource.register(RasterSource)
    df = spark.read.format("scan_raster").options(x_num="20", y_num="10", x_range="10", y_range="5").load()
    return df.select("frame_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
