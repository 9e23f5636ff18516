"""Mosaics that grow with a stream: each micro-batch adds its own pixels, and a scan's canvas is archived when it ends."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles
from ..plans.session import file_system
from ..sources import sinks


class LiveMosaic:
    """Canvases below a folder, one for each value of `keys`, of patches (keys, cy, cx and an h x w array in each of
    `values`) that come in micro-batches.

    A batch writes the sums of its own patches, one row a pixel, to a folder of its number: a batch that runs again replaces
    itself, and its cost is that of its patches, not of the canvas.  Every `every` batches what was written so far is
    added up into one folder, which counts in place of all up to it; those before it go at the next time."""

    def __init__(self, spark: SparkSession, base: str, h: int, w: int, values: tuple[str, ...] = ("px",), keys: tuple[str, ...] = (), every: int = 20):
        self.spark, self.base, self.h, self.w, self.values, self.keys, self.every = spark, base.rstrip("/"), h, w, values, keys, every
        self.schema: str | None = None

    def write(self, patches: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        added = tiles.pixels(tiles.partial_pixels(patches, self.h, self.w, self.values, keys=self.keys), self.values, self.keys, whole_counts=False)
        self.schema = added.schema
        added.write.mode("overwrite").parquet(f"{self.base}/batch={batch}")
        if batch % self.every == self.every - 1:
            self._add_up(batch)

    def _add_up(self, upto: int) -> None:
        before, sums = self._folders()
        tiles.pixels(self._read(), self.values, self.keys, whole_counts=False).write.mode("overwrite").parquet(f"{self.base}/sum={upto}")
        fs, _ = file_system(self.spark, self.base)
        for name in [f"sum={n}" for n in sums if n < upto] + [f"batch={n}" for n in before if n <= max(sums, default=-1)]:
            fs.delete(file_system(self.spark, f"{self.base}/{name}")[1], True)

    def _folders(self) -> tuple[list[int], list[int]]:
        """Numbers of the batches and of the sums that are there whole."""
        fs, at = file_system(self.spark, self.base)
        found: dict[str, list[int]] = {"batch": [], "sum": []}
        if fs.exists(at):
            for s in fs.listStatus(at):
                m = re.fullmatch(r"(batch|sum)=(\d+)", s.getPath().getName())
                if m and fs.exists(file_system(self.spark, f"{self.base}/{s.getPath().getName()}/_SUCCESS")[1]):
                    found[m[1]].append(int(m[2]))
        return found["batch"], found["sum"]

    def _read(self) -> DataFrame | None:
        batches, sums = self._folders()
        last = max(sums, default=-1)
        paths = [f"{self.base}/batch={n}" for n in sorted(batches) if n > last] + [f"{self.base}/sum={n}" for n in sums if n == last]
        if not paths:
            return None
        return self.spark.read.schema(self.schema or self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def canvas(self) -> DataFrame | None:
        """keys, y, x, c and s_<value> as of now; None before the first batch."""
        stored = self._read()
        return None if stored is None else tiles.pixels(stored, self.values, self.keys)


def archive_ended(mosaic: LiveMosaic, base: str, shape: tuple[int, int], most: int = 1024):
    """A writer for foreachBatch over scan_ends(): each ended scan's canvas (mosaic.keys: run, scan_seq) goes to its place in
    the run's archive.  A scan that ends again is written again."""

    def write(ends: DataFrame, batch: int) -> None:
        over = [tuple(r) for r in ends.select(*mosaic.keys).distinct().collect()]  # scans that ended in one batch
        canvas = mosaic.canvas() if over else None
        if canvas is None:
            return
        for run, scan in over:
            run_key, scan_key = mosaic.keys
            own = canvas.where(F.col(run_key).eqNullSafe(F.lit(run)) & (F.col(scan_key) == scan)).drop(*mosaic.keys)
            sinks.write_mosaic(own, base, str(run), scan, shape, most=most)

    return write
