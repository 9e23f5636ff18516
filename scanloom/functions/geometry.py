"""Positions, windows and canvases: units, angles, clamps, ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PIXEL_UM = 75.0


def to_um(mean: Column, ratio: float, direction: int) -> Column:
    return mean * F.lit(float(ratio)) * F.lit(float(direction))


def foreshorten(fast: Column, angle_deg: float) -> Column:
    """The fast axis as seen under a tilt: by the cosine up to 45 degrees, else by the sine."""
    a = math.radians(angle_deg)
    return fast * F.lit(abs(math.cos(a)) if abs(angle_deg) <= 45 else abs(math.sin(a)))


def handed(fast: Column, angle_deg: float, enabled: bool) -> Column:
    return -fast if enabled and angle_deg <= -45 else fast


def pixel_centre(um: Column, pixel_um: float, n: int, pad: int) -> Column:
    """Nearest pixel, halves to the even one, moved by half a window and half the padding."""
    return F.rint(um / F.lit(float(pixel_um))) + (n / 2 + pad // 2)


def window(y: Column, x: Column, n: int) -> Column:
    """x0, x1, y0, y1 of the window around a centre."""
    half = n // 2
    return F.struct(*[(c + d).cast("int").alias(k) for k, c, d in (("x0", x, -half), ("x1", x, half), ("y0", y, -half), ("y1", y, half))])


def clamp_centre(c: Column, n: int, limit: int) -> Column:
    return F.least(F.greatest(c, F.lit(n // 2)), F.lit(limit - n // 2))


def scan_margin(limit: int, n: int, span: Column, pixel: float) -> Column:
    return F.greatest(F.lit(0), F.floor((F.lit(limit - n) - F.ceil(span / pixel)) / 2)).cast("int")


def object_side(n: int, span: Column, pixel: float, pad: int) -> Column:
    """Pixels that a scan of this range needs, made even; a pixel of no size is an error."""
    if pixel <= 0:
        raise ValueError("the pixel size must be above 0")
    side = (F.lit(n + pad) + F.ceil(span / pixel)).cast("int")
    return side + side % 2


def canvas_side(observed: Column, commanded: Column, factor: float, pixel: float, half: int, pad: int) -> Column:
    wanted = commanded * F.lit(float(factor))
    span = F.greatest(observed, wanted) if factor >= 1 else wanted
    return (F.ceil(span / F.lit(float(pixel))) + (2 * half + 2 + 2 * pad)).cast("int")


def canvas_middle(low: Column, high: Column, first: Column, last: Column, commanded: Column) -> Column:
    """The middle of what was seen, if that is at least half of what was commanded or nothing was; else half the
    commanded range from the end where the scan began, by the direction of travel (none: down)."""
    up = last > first
    return F.when((commanded <= 0) | (high - low >= commanded * 0.5), (low + high) / 2).when(up, low + commanded / 2).otherwise(high - commanded / 2)


def base_offsets(fast_min: Column, slow_first: Column, slow_last: Column, slow_range: Column) -> tuple[Column, Column]:
    return fast_min, F.when(slow_last < slow_first, slow_first - slow_range).otherwise(slow_first)


def headroom_window(y0: int, y1: int, x0: int, x1: int, headroom: int, h: int, w: int) -> tuple[int, int, int, int]:
    """The region of interest grown on all sides within the frame; below 0 the whole frame."""
    if headroom < 0:
        return 0, h, 0, w
    return max(0, y0 - headroom), min(h, y1 + headroom), max(0, x0 - headroom), min(w, x1 + headroom)


def sample_pixel_m(wavelength_m: Column, distance_m: Column, n: int, detector_um: Column) -> Column:
    return wavelength_m * distance_m / (F.lit(n) * detector_um * 1e-6)


def wavelength_nm(energy_kev: Column) -> Column:
    return F.lit(1.2398) / energy_kev


def bragg_energy_kev(angle_deg: Column) -> Column:
    return F.lit(12.39842) / (F.lit(2 * 3.1355893) * F.sin(F.radians(angle_deg)))


def encoder_ratio(scale: Column) -> Column:
    """None and 0 stand for a scale of 1."""
    return -F.coalesce(F.nullif(scale.cast("double"), F.lit(0.0)), F.lit(1.0)) / 10000.0


def upsample_ratio(n_samples: Column, n_frames: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n_samples / F.nullif(n_frames, F.lit(0).cast("bigint"))))


def plan_range(kind: Column, start: Column, stop: Column, points: Column) -> Column:
    """The range of a scan axis: continuous fly scans and spirals keep all of it, stepped ones end one step before."""
    whole = stop - start
    return F.when(kind.isin("2D_FLY_PANDA", "rel_spiral_fermat", "fermat"), whole).otherwise(whole - whole / points)


def in_um(max_abs_x: Column, max_abs_y: Column) -> Column:
    """Whether a table of positions is in um already: raw encoder counts are large on both axes."""
    return (max_abs_x < 1e3) | (max_abs_y < 1e3)


def as_counts(value: Column, um: Column, ratio: float, way: int) -> Column:
    """Encoder counts of a position that is in um where `um` says so, and counts already elsewhere."""
    return F.when(um, value / F.lit(ratio * way)).otherwise(value)


def raster(index: Column, x_num: int, y_num: int, x_range: float, y_range: float, x_way: int = 1, y_way: int = 1) -> tuple[Column, Column]:
    """(x, y) of a simulated raster: x runs in each row, y from row to row."""
    return (index % x_num) * F.lit(x_range / x_num * x_way), F.floor(index / x_num) * F.lit(y_range / y_num * y_way)
