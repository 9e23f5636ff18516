"""Versions of a model in a shared folder, and inference that changes version between micro-batches only."""

from __future__ import annotations

import io
import re
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recon import infer


class ModelStore:
    """Weights (named arrays) below a folder, one file a version, `<name>_v<number>.npz`.

    build(weights) gives the predictor, (B, H, W) to (B, 2, H, W).  A version appears whole, by renaming, and never
    changes; the one with the largest number counts."""

    def __init__(self, path: str, name: str, build: Callable[[dict], Callable[[np.ndarray], np.ndarray]]):
        self.path, self.name, self.build = path, name, build

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if re.match(r"\w+:", self.path) else (fs.LocalFileSystem(), self.path)

    def _file(self, version: int) -> str:
        return f"{self._folder()[1]}/{self.name}_v{version}.npz"

    def put(self, version: int, **weights: np.ndarray) -> None:
        files, base = self._folder()
        files.create_dir(base)
        raw, tmp = io.BytesIO(), f"{base}/_{uuid.uuid4().hex}"
        np.savez(raw, **weights)
        with files.open_output_stream(tmp) as f:
            f.write(raw.getvalue())
        files.move(tmp, self._file(version))

    def latest(self) -> int | None:
        from pyarrow import fs

        files, base = self._folder()
        found = [re.fullmatch(rf"{re.escape(self.name)}_v(\d+)\.npz", f.base_name) for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return max((int(m[1]) for m in found if m), default=None)

    def predictor(self, version: int) -> Callable[[np.ndarray], np.ndarray]:
        """The predictor of a version; a worker loads it once and keeps the last one."""
        file, build, files = self._file(version), self.build, self._folder

        def predict(batch: np.ndarray) -> np.ndarray:
            home = sys.modules.setdefault("_scanloom_model", types.ModuleType("_scanloom_model"))
            if getattr(home, "key", None) != file:
                with files()[0].open_input_stream(file) as f:
                    home.predict = build(dict(np.load(io.BytesIO(f.read()))))
                home.key = file
            return home.predict(batch)

        return predict


def serve(models: ModelStore, n: int, write: Callable[[DataFrame, int], None], engine_batch: int = 32):
    """A function for foreachBatch over frames (frame_id, amp): each micro-batch asks once for the newest version, and all its
    frames, replays of failed tasks too, get that one; write(results with model_version, batch)."""

    def batch(frames: DataFrame, number: int) -> None:
        version = models.latest()
        if version is None:
            raise RuntimeError(f"there is no version of {models.name!r} yet")
        write(infer(frames, n, models.predictor(version), engine_batch).withColumn("model_version", F.lit(version)), number)

    return batch
