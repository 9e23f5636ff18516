"""Values that a stream works out once from its first frames and keeps: the beam's window, the frames' orientation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.arrays import SYMMETRIES
from ..functions.geometry import headroom_window
from ..operators.align import known
from ..operators.blob import blob_box, placed_box


class FirstBatchCentre(StatefulProcessor):
    """Holds a run's first frames until there are `least`, finds the beam in their mean, and lets frames pass with the window
    found then; later frames do not change it."""

    def __init__(self, shape: tuple[int, int], roi: tuple[int, int, int, int], headroom: int, least: int, threshold: float, saturation: float):
        self.shape, self.roi, self.headroom, self.least = shape, roi, headroom, least
        self.threshold, self.saturation = threshold, saturation

    def init(self, handle):
        self.box = handle.getValueState("box", "y0 int, y1 int, x0 int, x1 int, found boolean, clamped boolean")
        self.waiting = handle.getListState("waiting", "frame_id bigint, px array<bigint>")

    def _find(self, frames: list[tuple[int, list]]) -> tuple:
        h, w = self.shape
        y0, y1, x0, x1 = self.roi
        a, b, c, d = headroom_window(y0, y1, x0, x1, self.headroom, h, w)
        first = sorted(frames, key=lambda f: f[0])[: self.least]
        mean = np.mean([np.asarray(px, float).reshape(h, w)[a:b, c:d] for _, px in first], axis=0)
        beam = blob_box(mean, self.threshold, self.saturation)
        if beam is None:
            return (*self.roi, False, False)
        *box, clamped = placed_box(beam, (a, c), (b - a, d - c), y1 - y0, x1 - x0)
        return (*map(int, box), True, bool(clamped))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frames = [(int(f), [int(v) for v in px]) for pdf in rows for f, px in zip(pdf["frame_id"], pdf["px"])]
        if not self.box.exists():
            held = [(w[0], list(w[1])) for w in self.waiting.get()] if self.waiting.exists() else []
            if len(held) + len(frames) < self.least:
                self.waiting.appendList(frames)
                return
            frames = held + frames
            self.box.update(self._find(frames))
            self.waiting.clear()
        y0, y1, x0, x1, found, clamped = self.box.get()
        n = len(frames)
        crops = [np.asarray(px).reshape(self.shape)[y0:y1, x0:x1].ravel().tolist() for _, px in frames]
        yield pd.DataFrame({"run": [key[0]] * n, "frame_id": [f for f, _ in frames], "y0": [y0] * n, "y1": [y1] * n, "x0": [x0] * n, "x1": [x1] * n, "found": [found] * n, "clamped": [clamped] * n, "px": crops})

    def close(self):
        pass


def auto_centre(frames: DataFrame, h: int, w: int, roi: tuple[int, int, int, int], headroom: int = -1, least: int = 64, threshold: float = 0.02, saturation: float = 2**32 - 2) -> DataFrame:
    """run, frame_id, y0, y1, x0, x1, found, clamped, px: frames (run, frame_id, px of h x w) cut to a window of the size of
    `roi` (y0, y1, x0, x1) around the beam in the mean of the run's first `least` frames (by frame_id among those there).

    The beam is sought within roi grown by `headroom` (below 0: in the whole frame).  Without a beam the window is roi
    itself and `found` is false, for the whole run.  A run of fewer frames waits."""
    kind = frames.schema["run"].dataType.simpleString()
    out = f"run {kind}, frame_id bigint, y0 int, y1 int, x0 int, x1 int, found boolean, clamped boolean, px array<bigint>"
    source = frames.where(F.col("px").isNotNull()).select("run", F.col("frame_id").cast("bigint").alias("frame_id"), F.col("px").cast("array<bigint>").alias("px"))
    return source.groupBy("run").transformWithStateInPandas(FirstBatchCentre((h, w), tuple(roi), headroom, least, threshold, saturation), out, "append", "none")


def oriented(images: np.ndarray, name: str) -> np.ndarray:
    """A symmetry of the last two axes."""
    swap, up, left = SYMMETRIES[name]
    if up:
        images = images[..., ::-1, :]
    if left:
        images = images[..., :, ::-1]
    return np.swapaxes(images, -1, -2) if swap else images


class OrientationLatch(StatefulProcessor):
    """Holds a run's first frames, `most` of them, and the positions that are known, until `least` of these frames have
    theirs; then scores the eight symmetries once and forgets both."""

    def __init__(self, side: tuple[int, int], score: Callable, least: int, most: int):
        self.side, self.score, self.least, self.most = side, score, least, most

    def init(self, handle):
        self.done = handle.getValueState("done", "is boolean")
        self.held = handle.getValueState("held", "n int")
        self.frames = handle.getMapState("frames", "frame_id bigint", "px array<bigint>")
        self.places = handle.getMapState("places", "frame_id bigint", "x double, y double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        if self.done.exists():
            return
        n = self.held.get()[0] if self.held.exists() else 0
        for pdf in rows:
            for f, is_place, px, x, y in zip(pdf["frame_id"], pdf["is_place"], pdf["px"], pdf["x"], pdf["y"]):
                if is_place:
                    self.places.updateValue((int(f),), (float(x), float(y)))
                elif n < self.most and not self.frames.containsKey((int(f),)):
                    self.frames.updateValue((int(f),), ([int(v) for v in px],))
                    n += 1
        self.held.update((n,))
        both = [(k[0], self.places.getValue(k)) for k in list(self.frames.keys()) if self.places.containsKey(k)]
        if len(both) < self.least:
            return
        px = np.array([list(self.frames.getValue((f,))[0]) for f, _ in both], float).reshape(len(both), *self.side)
        x, y = (np.array([p[i] for _, p in both]) for i in (0, 1))
        scores = sorted((float(np.mean(self.score(oriented(px, name), x, y))), name) for name in SYMMETRIES)
        self.done.update((True,))
        self.frames.clear()
        self.places.clear()
        yield pd.DataFrame({"run": [key[0]] * 8, "name": [name for _, name in scores], "score": [s for s, _ in scores], "place": list(range(1, 9)), "frames": [len(both)] * 8})

    def close(self):
        pass


def orientation(frames: DataFrame, positions: DataFrame, side: tuple[int, int], score: Callable, least: int = 64, most: int = 256) -> DataFrame:
    """run, name, score, place (1: the winner, least score), frames: once for each run, as soon as `least` of its first
    `most` frames (run, frame_id, px) have a known position (run, frame_id, x, y), whichever comes first.

    score(images, x, y) gives a number for each frame of an oriented stack; ties go by name."""
    kind = frames.schema["run"].dataType.simpleString()
    empty = F.lit(None).cast("double")
    f = frames.where(F.col("px").isNotNull()).select("run", "frame_id", F.lit(False).alias("is_place"), F.col("px").cast("array<bigint>").alias("px"), empty.alias("x"), empty.alias("y"))
    p = positions.where(known("x", "y")).select("run", "frame_id", F.lit(True).alias("is_place"), F.lit(None).cast("array<bigint>").alias("px"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    out = f"run {kind}, name string, score double, place int, frames int"
    return f.unionByName(p).groupBy("run").transformWithStateInPandas(OrientationLatch(tuple(side), score, least, most), out, "append", "none")
