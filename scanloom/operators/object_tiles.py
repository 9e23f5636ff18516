"""The simultaneous solver with the object as a table of tiles: no task and no driver holds the canvas.

Frames are packed once by the tile that holds their window's corner.  A round joins each pack with the few tiles its windows
can reach, adds its share of the new object up on tiles, and writes the sums as the table that the next round reads."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored
from .recon import SolverConfig, ml_amplitude, start_probe, warm_probe
from .tiles import HELD, TILE, merged_tiles

#: Frames of a pack.
PACK = 256
#: Where no tile is yet.
START = 0.99 * np.exp(-0.1j)


def packed(frames: DataFrame, n: int, pack: int = PACK) -> DataFrame:
    """ty, tx, y0, x0 (arrays), amp (64-bit floats): frames (frame_id, amp, y0, x0) of one tile, `pack` in a row.

    A tile with many frames is dealt out by a hash of the frame, so a dwell on one place does not meet in one task."""
    home = frames.select("frame_id", F.floor(F.col("y0") / TILE).alias("ty"), F.floor(F.col("x0") / TILE).alias("tx"), "y0", "x0", "amp")
    sizes = home.groupBy("ty", "tx").agg(F.ceil(F.count("*") / (4 * pack)).alias("parts"))
    dealt = home.join(sizes, ["ty", "tx"]).withColumn("part", F.pmod(F.xxhash64("frame_id"), F.col("parts")))

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, list] = {}

        def out(place):
            y0, x0, amp = zip(*held.pop(place))
            rows = [[place[0]], [place[1]], [list(y0)], [list(x0)], [np.concatenate(amp).tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["ty", "tx", "y0", "x0", "amp"])

        last = None
        for batch in batches:
            amp = batch.column("amp").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n * n)
            for i, (ty, tx, y, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "y0", "x0")))):
                place = (ty, tx)
                if last is not None and place != last and last in held:
                    yield out(last)
                held.setdefault(place, []).append((y, x, amp[i].copy()))
                last = place
                if len(held[place]) == pack:
                    yield out(place)
        if last in held:
            yield out(last)

    source = dealt.repartition("ty", "tx", "part").sortWithinPartitions("ty", "tx", "part")
    return source.select("ty", "tx", F.col("y0").cast("bigint").alias("y0"), F.col("x0").cast("bigint").alias("x0"), "amp").mapInArrow(run, "ty bigint, tx bigint, y0 array<bigint>, x0 array<bigint>, amp binary")


def _around(tiles: DataFrame, reach: int) -> DataFrame:
    """hy, hx, near: of each tile that packs can lie on, itself and those below and right of it, reach * reach at most."""
    homes = F.array(*[F.struct((F.col("ty") - dy).alias("hy"), (F.col("tx") - dx).alias("hx"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(reach) for dx in range(reach)])
    each = tiles.select(F.explode(homes).alias("h"), "tile")
    return each.groupBy("h.hy", "h.hx").agg(F.collect_list(F.struct("h.dy", "h.dx", "tile")).alias("near"))


def tiled_iteration(packs: DataFrame, tiles: DataFrame | None, probe: np.ndarray, config: SolverConfig, pois: float, update_probe: bool) -> tuple[DataFrame, np.ndarray, float]:
    """One round: (tiles of the sums: re, im and norm of each pixel, the probe, the sum of squared errors)."""
    n, mode, weight, alpha = config.n, config.mode, config.weight, config.alpha
    reach = (TILE + n - 2) // TILE + 1
    side = reach * TILE
    if tiles is None:
        joined = packs.withColumn("near", F.lit(None).cast("array<struct<dy: int, dx: int, tile: binary>>"))
    else:
        around = _around(tiles, reach)
        joined = packs.join(around, (F.col("ty") == F.col("hy")) & (F.col("tx") == F.col("hx")), "left")

    def region(near) -> np.ndarray:
        out = np.full((side, side), START)
        for x in near or ():
            re, im, norm = np.frombuffer(x["tile"], float).reshape(3, TILE, TILE)
            out[x["dy"] * TILE : (x["dy"] + 1) * TILE, x["dx"] * TILE : (x["dx"] + 1) * TILE] = (re + 1j * im) / (norm + alpha)
        return out

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}
        far_off = np.zeros(1 + 3 * n * n)  # the error, and re, im and norm of the probe

        def out():
            names, data = list(sums), [x.tobytes() for x in sums.values()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([0] * len(names), pa.int32()), *(pa.array([k[i] for k in names], pa.int64()) for i in (0, 1)), pa.array(data, pa.binary())], names=["what", "ty", "tx", "tile"])

        intensity = np.abs(probe) ** 2
        for batch in batches:
            for ty, tx, ys, xs, raw, near in zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "y0", "x0", "amp", "near"))):
                amp, o = np.frombuffer(raw, float).reshape(-1, n, n), region(near)
                top, left = np.array(ys) - ty * TILE, np.array(xs) - tx * TILE
                patch = np.stack([o[y : y + n, x : x + n] for y, x in zip(top, left)])
                far = np.fft.fft2(probe * patch, norm="ortho")
                size = np.abs(far)
                far_off[0] += float(((size - amp) ** 2).sum())
                back = np.fft.ifft2(ml_amplitude(size, amp, mode, pois, weight) * np.exp(1j * np.angle(far)), norm="ortho")
                own = np.zeros((3, side, side))
                for y, x, psi in zip(top, left, np.conj(probe) * back):
                    own[0, y : y + n, x : x + n] += psi.real
                    own[1, y : y + n, x : x + n] += psi.imag
                    own[2, y : y + n, x : x + n] += intensity
                if update_probe:
                    up = (np.conj(patch) * back).sum(axis=0)
                    far_off[1:] += np.concatenate((up.real.ravel(), up.imag.ravel(), (np.abs(patch) ** 2).sum(axis=0).ravel()))
                for dy in range(reach):
                    for dx in range(reach):
                        part = own[:, dy * TILE : (dy + 1) * TILE, dx * TILE : (dx + 1) * TILE]
                        if part[2].any():
                            place = (ty + dy, tx + dx)
                            sums[place] = sums[place] + part if place in sums else part.copy()
                if len(sums) > HELD:
                    yield out()
        if sums:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([far_off.tobytes()], pa.binary())], names=["what", "ty", "tx", "tile"])

    added = stored(merged_tiles(joined.select("ty", "tx", "y0", "x0", "amp", "near").mapInArrow(run, "what int, ty bigint, tx bigint, tile binary"), ("what",)), "object")
    rest = np.frombuffer(added.where("what = 1").first()["tile"], float)
    if update_probe:
        re, im, norm = rest[1:].reshape(3, n, n)
        probe = (re + 1j * im) / (norm + alpha)
    return added.where("what = 0").drop("what"), probe, float(rest[0])


def reconstruct_tiled(frames: DataFrame, config: SolverConfig, probe: np.ndarray | None = None, iterations: int = 10, on_snapshot: Callable | None = None, every: int = 10) -> tuple[DataFrame | None, np.ndarray, list[float]]:
    """As recon.reconstruct for a set of frames that does not grow: (object tiles, probe, errors).  What the driver holds is
    the probe, of n x n; height and width of the configuration are not used, and an object can be of any size."""
    probe = start_probe(frames, config.n) if probe is None else warm_probe(probe, config.n)
    packs, tiles, errors = stored(packed(frames, config.n), "packs"), None, []
    top = frames.agg(F.max(F.array_max("amp")).alias("top")).first()["top"]
    if top is None:
        return None, probe, []
    for it in range(min(iterations, config.max_iterations)):
        new, probe, error = tiled_iteration(packs, tiles, probe, config, 25.0 / top, it >= config.start_probe_update)
        errors.append(error)
        tiles = new if it >= config.start_object_update else tiles
        if on_snapshot and (it + 1) % every == 0:
            on_snapshot(it + 1, tiles, probe)
        if it >= config.ends_after:
            break
    return tiles, probe, errors


def object_pixels(tiles: DataFrame, alpha: float) -> DataFrame:
    """y, x, re, im of the pixels that windows cover."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ty, tx, raw in zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "tile"))):
                re, im, norm = np.frombuffer(raw, float).reshape(3, TILE * TILE)
                at = np.flatnonzero(norm)
                yield pa.RecordBatch.from_arrays([pa.array(ty * TILE + at // TILE), pa.array(tx * TILE + at % TILE), pa.array(re[at] / (norm[at] + alpha)), pa.array(im[at] / (norm[at] + alpha))], names=["y", "x", "re", "im"])

    return tiles.select("ty", "tx", "tile").mapInArrow(run, "y bigint, x bigint, re double, im double")
