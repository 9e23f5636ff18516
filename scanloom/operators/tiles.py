"""Patches added up on dense tiles: a task keeps tiles of the canvas as arrays and sends each once, whole or as its pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels along a side of a tile.
TILE = 64
#: Tiles that a task holds at most before it sends them on.
HELD = 256
#: Tiles that a task sends in one batch of rows.
SENT = 16


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def _summed(patches: DataFrame, h: int, w: int, values: tuple[str, ...], y: str, x: str, keys: tuple[str, ...], linear: bool, sent, kind: str) -> DataFrame:
    """The sums of each task's patches: sent(places, tiles) gives the columns of some tiles, as kind names them.

    A patch (h x w numbers in each of `values`) lies with its centre on the nearest whole pixel, halves on the even one; with
    `linear` each pixel is dealt to the four around its exact place by distance, and only pixels that are not 0 count.  A
    pixel counts where all its values are there.  Patches without a value or a known centre are left out."""
    from .align import known

    whole = patches.where(known(y, x))
    for v in values:
        whole = whole.where(F.col(v).isNotNull())
    n, size = len(values), h * w

    def run(batches):
        import pyarrow as pa

        tiles: dict[tuple, np.ndarray] = {}

        def out():
            """The tiles held longest."""
            places = list(tiles)[:SENT]
            repeats, columns = sent([p[1:] for p in places], [tiles.pop(p) for p in places])
            own = [pa.array([p[0][i] for p in places], kinds[i]).take(pa.array(repeats)) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*own, *columns.values()], names=[*keys, *columns])

        def add(key, top: int, left: int, stack: np.ndarray):
            """Adds count and values of a patch at a place of the canvas."""
            for ty in range(top // TILE, (top + h - 1) // TILE + 1):
                a, b = max(top, ty * TILE), min(top + h, (ty + 1) * TILE)
                for tx in range(left // TILE, (left + w - 1) // TILE + 1):
                    c, d = max(left, tx * TILE), min(left + w, (tx + 1) * TILE)
                    tile = tiles.get((key, ty, tx))
                    if tile is None:
                        tile = tiles[(key, ty, tx)] = np.zeros((n + 1, TILE, TILE))
                    tile[:, a - ty * TILE : b - ty * TILE, c - tx * TILE : d - tx * TILE] += stack[:, a - top : b - top, c - left : d - left]

        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(k).type for k in keys]
            rows = batch.num_rows
            stack = np.empty((rows, n + 1, size))
            stack[:, 0] = 1
            for j, v in enumerate(values):
                column = batch.column(v)
                flat = column.flatten()
                if len(flat) != rows * size or (np.diff(column.offsets.to_numpy()) != size).any():
                    raise ValueError(f"a patch has not {h} x {w} pixels")
                stack[:, j + 1] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(rows, size)
                if flat.null_count:
                    gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(rows, size)
                    stack[:, 0][gone] = 0
                if linear:
                    stack[:, 0][stack[:, j + 1] == 0] = 0
            lacking = stack[:, 0] == 0
            if lacking.any():
                for j in range(n):
                    stack[:, j + 1][lacking] = 0
            stack = stack.reshape(rows, n + 1, h, w)
            cy, cx = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_cy", "_cx"))
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * rows
            if linear:
                ys, xs = cy - (h - 1) / 2, cx - (w - 1) / 2
                fy, fx = ys - np.floor(ys), xs - np.floor(xs)
            else:
                ys, xs = np.rint(cy) - h // 2, np.rint(cx) - w // 2
            tops, lefts = np.floor(ys).astype(np.int64).tolist(), np.floor(xs).astype(np.int64).tolist()
            # patches of a tile one after the other, so that few tiles are open at a time
            for i in np.lexsort((np.floor_divide(lefts, TILE), np.floor_divide(tops, TILE))).tolist():
                if not linear:
                    add(names[i], tops[i], lefts[i], stack[i])
                else:
                    for dy, part in ((0, 1 - fy[i]), (1, fy[i])):
                        for dx, share in ((0, (1 - fx[i]) * part), (1, fx[i] * part)):
                            if share > 0:
                                add(names[i], tops[i] + dy, lefts[i] + dx, stack[i] * share)
                while len(tiles) > HELD:
                    yield out()
        while tiles:
            yield out()

    source = whole.select(*keys, F.col(y).cast("double").alias("_cy"), F.col(x).cast("double").alias("_cx"), *values)
    return source.mapInArrow(run, _kinds(patches, keys) + kind)


def partial_tiles(patches: DataFrame, h: int, w: int, values: tuple[str, ...], y: str = "cy", x: str = "cx", keys: tuple[str, ...] = (), linear: bool = False) -> DataFrame:
    """keys, ty, tx, tile: the sums of each task's patches; tile is the count and then each value, 64-bit floats row by row."""

    def sent(places, tiles):
        import pyarrow as pa

        ty, tx = (pa.array([p[i] for p in places], pa.int64()) for i in (0, 1))
        return np.arange(len(places)), {"ty": ty, "tx": tx, "tile": pa.array([t.tobytes() for t in tiles], pa.binary())}

    return _summed(patches, h, w, values, y, x, keys, linear, sent, "ty bigint, tx bigint, tile binary")


def partial_pixels(patches: DataFrame, h: int, w: int, values: tuple[str, ...], y: str = "cy", x: str = "cx", keys: tuple[str, ...] = (), linear: bool = False) -> DataFrame:
    """keys, y, x, c and s_<value> (64-bit floats): the same sums as rows of the pixels that any patch covers.

    A tile takes as much memory for one patch as for many, and where the canvas grows with the input there are as many as
    patches; pixels are no more than the patches have."""
    names = [f"s_{v}" for v in values]

    def sent(places, tiles):
        import pyarrow as pa

        at = [np.flatnonzero(t[0]) for t in tiles]
        repeats = np.repeat(np.arange(len(places)), [len(a) for a in at])
        place, (ty, tx) = np.concatenate(at), np.array(places, np.int64).reshape(-1, 2).T
        sums = [np.concatenate([t[j].ravel()[a] for t, a in zip(tiles, at)]) for j in range(len(names) + 1)]
        where = {"y": ty[repeats] * TILE + place // TILE, "x": tx[repeats] * TILE + place % TILE}
        return repeats, {k: pa.array(v) for k, v in (where | dict(zip(["c", *names], sums))).items()}

    return _summed(patches, h, w, values, y, x, keys, linear, sent, ", ".join(["y bigint", "x bigint", "c double", *[f"`{n}` double" for n in names]]))


def pixels(partial: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = (), whole_counts: bool = True) -> DataFrame:
    """keys, y, x, c and s_<value> of each pixel, of partial sums of pixels."""
    out = partial.groupBy(*keys, "y", "x").agg(F.sum("c").alias("c"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values])
    return out.withColumn("c", F.rint("c").cast("bigint")) if whole_counts else out


def _merged(batches, keys: tuple[str, ...]):
    """(keys and place, sum) of the tiles of a task, which come sorted."""
    last, total = None, None
    for batch in batches:
        names = zip(*(batch.column(k).to_pylist() for k in (*keys, "ty", "tx")))
        for name, raw in zip(names, batch.column("tile"), strict=True):
            tile = np.frombuffer(raw.as_buffer(), float)
            if name == last:
                total = total + tile
            else:
                if last is not None:
                    yield last, total
                last, total = name, tile
    if last is not None:
        yield last, total


def _together(tiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    place = [*keys, "ty", "tx"]
    return tiles.select(*place, "tile").repartition(*place).sortWithinPartitions(*place)


def merged_tiles(tiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same columns, one row a tile: what meets in a task is a tile's sums, one of each task before."""
    kinds = _kinds(tiles, keys)

    def run(batches):
        import pyarrow as pa

        for batch in _chunks(_merged(batches, keys), 64):
            columns = list(zip(*(name for name, _ in batch)))
            arrays = [pa.array(c, t) for c, t in zip(columns, types(pa), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([t.tobytes() for _, t in batch], pa.binary())], names=[*keys, "ty", "tx", "tile"])

    types = _arrow_types(tiles, keys)
    return _together(tiles, keys).mapInArrow(run, f"{kinds}ty bigint, tx bigint, tile binary")


def _arrow_types(tiles: DataFrame, keys: tuple[str, ...]):
    from pyspark.sql.pandas.types import to_arrow_type

    own = [to_arrow_type(tiles.schema[k].dataType) for k in keys]
    return lambda pa: [*own, pa.int64(), pa.int64()]


def _chunks(items, most: int):
    held = []
    for x in items:
        held.append(x)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held
