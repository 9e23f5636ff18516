"""The beam in a frame: connected components, bounding box, centred window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mosaic import mean_frame


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 for groups of set pixels that touch by a side; 0 elsewhere.

    Pixels carry their own number; rows and columns in turn take the least number along each unbroken run until
    nothing changes, which is at most a few sweeps for compact blobs."""
    big = mask.size
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), big)
    while True:
        before = label
        for axis in (0, 1):
            part = label if axis else label.T
            on = part < big
            edge = np.ones(part.shape, bool)
            edge[:, 1:] = on[:, 1:] != on[:, :-1]
            starts = np.flatnonzero(edge)
            least = np.minimum.reduceat(part.ravel(), starts)
            part = np.repeat(least, np.diff(np.append(starts, part.size))).reshape(part.shape)
            label = part if axis else part.T
        if (label == before).all():
            break
    out = np.zeros(mask.shape, np.int64)
    names, inverse = np.unique(label[mask], return_inverse=True)
    if len(names):
        out[mask] = inverse + 1
    return out


def blob_box(mean: np.ndarray, threshold: float, saturation: float) -> tuple[int, int, int, int] | None:
    """y0, y1, x0, x1 (ends exclusive) of the largest group of pixels above threshold * peak, saturated ones left out."""
    masked = np.where(mean >= saturation, 0.0, mean)
    peak = masked.max(initial=0.0)
    if peak <= 0:
        return None
    label = label_components(masked > threshold * peak)
    size = np.bincount(label.ravel())
    size[0] = 0
    y, x = np.nonzero(label == size.argmax())
    return int(y.min()), int(y.max()) + 1, int(x.min()), int(x.max()) + 1


def placed_box(box: tuple[int, int, int, int], origin: tuple[int, int], size: tuple[int, int], ny: int, nx: int) -> tuple[int, int, int, int, bool]:
    """y0, y1, x0, x1 of an ny x nx window around the centre of a box, kept inside an area (its corner and size in the whole
    detector, the box in the area), and whether it had to be moved for that."""
    a, b, c, d = box
    (oy, ox), (h, w) = origin, size
    y0, x0 = round(oy + (a + b) / 2 - ny / 2), round(ox + (c + d) / 2 - nx / 2)
    ky, kx = min(max(y0, oy), oy + h - ny), min(max(x0, ox), ox + w - nx)
    return ky, ky + ny, kx, kx + nx, (ky, kx) != (y0, x0)


def center_box(frames: DataFrame, h: int, w: int, ny: int, nx: int, window: tuple[int, int] = (0, 0), threshold: float = 0.02, saturation: float = 2**32 - 2, value: str = "px", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, y0, y1, x0, x1, clamped, and the blob's box by0, by1, bx0, bx1: an ny x nx window around the centre of the
    blob's box in the mean of the frames, kept inside them.  window: where row 0 and column 0 lie in the whole
    detector.  Keys without a blob have nulls and false.  What is gathered is one mean frame a key."""
    mean = mean_frame(frames, value, keys)
    oy, ox = window
    fields = ("y0", "y1", "x0", "x1", "clamped", "by0", "by1", "bx0", "bx1")

    def run(pdf):
        import pandas as pd

        image = np.zeros(h * w)
        image[pdf["k"].to_numpy()] = pdf["mean"].to_numpy()
        box = blob_box(image.reshape(h, w), threshold, saturation)
        row = {k: pdf[k].iloc[0] for k in keys}
        if box is None:
            row |= dict.fromkeys(fields) | {"clamped": False}
        else:
            a, b, c, d = box
            row |= dict(zip(fields, (*placed_box(box, window, (h, w), ny, nx), oy + a, oy + b, ox + c, ox + d)))
        return pd.DataFrame([row])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in mean.schema.fields if f.name in keys)
    schema = kinds + "y0 int, y1 int, x0 int, x1 int, clamped boolean, by0 int, by1 int, bx0 int, bx1 int"
    grouped = mean.withColumn("_all", F.lit(0)).groupBy(*keys) if keys else mean.groupBy(F.lit(0))
    return grouped.applyInPandas(run, schema)
