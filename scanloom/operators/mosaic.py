"""Patches added into a canvas, and what is read from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored
from . import quantiles, tiles


def scatter_add(patches: DataFrame, h: int, w: int, value: str = "px", y: str = "cy", x: str = "cx", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, y, x, s, c: the sum and the count of all pixels that fall on a canvas pixel.

    A patch is centred on the nearest whole pixel (halves to the even one).  Tasks add up their patches on tiles, so the
    shuffle has a pixel once for each task that covers it."""
    canvas = tiles.pixels(tiles.partial_pixels(patches, h, w, (value,), y, x, keys), (value,), keys)
    return canvas.select(*keys, "y", "x", F.col(f"s_{value}").alias("s"), "c")


def scatter_add_all(patches: DataFrame, h: int, w: int, values: tuple[str, ...], y: str = "cy", x: str = "cx", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, y, x, c and s_<value> of each value: several arrays of one patch (such as amplitude and phase) in lockstep,
    so a canvas never has a patch in one of them and not in the other.  Patches that lack one do not count."""
    return tiles.pixels(tiles.partial_pixels(patches, h, w, values, y, x, keys), values, keys)


def in_canvas(patches: DataFrame, half_y: int, half_x: int, height: int, width: int, y: str = "cy", x: str = "cx") -> DataFrame:
    """Patches that lie in the canvas with one pixel to spare."""
    inside = lambda c, half, size: (F.col(c) >= half + 1) & (F.col(c) < size - (half + 1))
    return patches.where(inside(y, half_y, height) & inside(x, half_x, width))


def normalise(canvas: DataFrame, min_overlap: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """v: the mean where enough patches overlap, elsewhere the median of those means.

    The median is exact, found by histograms: no canvas is sorted or gathered in one task."""
    least = max(0.5, min_overlap)
    mean = stored(canvas.withColumn("_m", F.when(F.col("c") >= least, F.col("s") / F.col("c"))), "canvas")
    if not keys:
        (middle,) = quantiles.exact(mean, "_m", (0.5,)) or (None,)
        return mean.withColumn("v", F.coalesce("_m", F.lit(middle).cast("double"))).drop("_m")
    fill = quantiles.exact_table(mean, "_m", (0.5,), keys).withColumnRenamed("q0", "_fill")
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    fill = fill.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_fill")
    return mean.join(fill, match, "left").withColumn("v", F.coalesce("_m", "_fill")).drop("_m", "_fill", *[f"_k_{k}" for k in keys])


def coverage(canvas: DataFrame, height: int, width: int) -> DataFrame:
    """The share of canvas pixels that any patch reaches."""
    return canvas.agg((F.count_if(F.col("c") >= 0.5) / F.lit(float(height * width))).alias("coverage"))


def bounding_box(canvas: DataFrame) -> DataFrame:
    """y0, y1, x0, x1 of what is covered; ends exclusive."""
    return canvas.where("c > 0").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def border_crop(canvas: DataFrame, height: int, width: int, margin: int, transpose: bool = False) -> DataFrame:
    """Cuts a margin off all sides, moves the origin there, and swaps the axes if asked to."""
    y, x = F.col("y") - margin, F.col("x") - margin
    kept = canvas.where((F.col("y") >= margin) & (F.col("y") < height - margin) & (F.col("x") >= margin) & (F.col("x") < width - margin))
    return kept.withColumns({"y": x, "x": y} if transpose else {"y": y, "x": x})


def bin_canvas(canvas: DataFrame, s: int) -> DataFrame:
    """An s times finer canvas to its own size: mean of the sums, mean of the counts over s x s pixels."""
    return canvas.groupBy(F.floor(F.col("y") / s).alias("y"), F.floor(F.col("x") / s).alias("x")).agg((F.sum("s") / (s * s)).alias("s"), (F.sum("c") / (s * s)).alias("c"))


def merge_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results on the same grid: the mean where both have a pixel, else the one that has it; 0 where neither."""
    both = a.select("y", "x", F.col("v").alias("_a")).join(b.select("y", "x", F.col("v").alias("_b")), ["y", "x"], "full")
    return both.select("y", "x", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.col("_a") + F.col("_b")) / 2).otherwise(F.coalesce("_a", "_b", F.lit(0.0))).alias("v"))


def mean_frame(frames: DataFrame, value: str = "px", keys: tuple[str, ...] = ()) -> DataFrame:
    """k and the mean over all frames of each pixel."""
    return frames.select(*keys, F.posexplode(value).alias("k", "_v")).groupBy(*keys, "k").agg(F.avg("_v").alias("mean"))


def brightest(frames: DataFrame, hot: float, value: str = "px") -> DataFrame:
    """The largest pixel that is not hot."""
    return frames.agg(F.max(F.array_max(F.filter(value, lambda v: v <= hot))).alias("most"))


def percentile_stretch(canvas: DataFrame, value: str = "v") -> DataFrame:
    """p2, p50, p98 of a canvas, exact."""
    low, middle, high = quantiles.exact(canvas, value, (0.02, 0.5, 0.98)) or (None,) * 3
    kind = "p2 double, p50 double, p98 double"
    return canvas.sparkSession.createDataFrame([(low, middle, high)], kind)


def centroid_angle(weight: str, place: str, period: int) -> Column:
    """The direction of the centre of weight on a circle of `period` places, an aggregate; no edge counts as a border."""
    angle = F.col(place) * F.lit(2 * math.pi / period)
    return F.atan2(F.sum(F.col(weight) * F.sin(angle)), F.sum(F.col(weight) * F.cos(angle)))


def mask_uncovered(obj: DataFrame, alpha: float) -> DataFrame:
    """Null where the probe's norm is not above alpha."""
    return obj.withColumn("v", F.when(F.col("norm") > alpha, F.col("v")))


def stitch_interpolated(patches: DataFrame, h: int, w: int, value: str = "px") -> DataFrame:
    """As scatter_add, but each pixel is dealt to the four canvas pixels around its exact place by distance; only
    pixels that are not 0 count.  v: the weighted mean."""
    dealt = tiles.pixels(tiles.partial_pixels(patches, h, w, (value,), linear=True), (value,), whole_counts=False)
    return dealt.select("y", "x", "c", (F.col(f"s_{value}") / F.col("c")).alias("v"))
