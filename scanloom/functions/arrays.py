"""Frames as flat row-major arrays: orientation, crops, shifts and pixel rules as native expressions.

`h` and `w` are the sizes of the given frame.  A null frame gives null; all functions keep it in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each symmetry by how an output pixel (i, j) finds its source: (rows and columns swapped, source row counted from
#: the bottom, source column counted from the right).
SYMMETRIES: dict[str, tuple[bool, bool, bool]] = {
    "identity": (False, False, False),
    "fliplr": (False, False, True),
    "flipud": (False, True, False),
    "rot180": (False, True, True),
    "transpose": (True, False, False),
    "rot90_ccw": (True, False, True),
    "rot90_cw": (True, True, False),
    "antitranspose": (True, True, True),
}
ALIASES = {"": "identity", "cw": "rot90_cw", "ccw": "rot90_ccw"}


def oriented_shape(name: str, h: int, w: int) -> tuple[int, int]:
    return (w, h) if SYMMETRIES[name][0] else (h, w)


def _source(name: str, i, j, h: int, w: int):
    swap, up, left = SYMMETRIES[name]
    row, col = (j, i) if swap else (i, j)
    return (h - 1 - row if up else row), (w - 1 - col if left else col)


def _named(word: str) -> str:
    word = ALIASES.get(word.strip(), word.strip())
    if word not in SYMMETRIES:
        raise ValueError(f"no orientation is called {word!r}; there are {', '.join(SYMMETRIES)}")
    return word


def compose(sequence: str | list[str]) -> str:
    """The one symmetry that a sequence, applied from left to right, amounts to.  Empty: identity."""
    words = sequence.split(",") if isinstance(sequence, str) else list(sequence)
    swap = up = left = False
    for name in map(_named, words):
        then_swap, then_up, then_left = SYMMETRIES[name]
        if swap:  # the later flips act on axes that are swapped
            then_up, then_left = then_left, then_up
        swap, up, left = swap != then_swap, up != then_up, left != then_left
    return next(n for n, flags in SYMMETRIES.items() if tuple(map(bool, flags)) == (swap, up, left))


def inverse(name: str) -> str:
    return next(n for n in SYMMETRIES if compose([name, n]) == "identity")


def between(given: str, wanted: str) -> str:
    """What turns a frame of one orientation into another."""
    return compose([inverse(_named(given)), _named(wanted)])


def bound(px: Column, use: Callable[[Column], Column]) -> Column:
    """use(px) with px worked out once, however often `use` reads it; null stays null.

    An expression that is read inside a lambda would else run again for every element, and nested ones for every
    element of every element."""
    return F.get(F.transform(F.array(px), lambda p: F.when(p.isNotNull(), use(p))), F.lit(0))


def pick(px: Column, h: int, w: int, source: Callable[[Column, Column], Column]) -> Column:
    """A frame of h x w pixels, each read from the given frame at source(row, column)."""
    places = F.sequence(F.lit(0), F.lit(h * w - 1))
    return bound(px, lambda p: F.transform(places, lambda k: F.get(p, source((k / w).cast("int"), k % w))))


def orient(px: Column, name: str, h: int, w: int) -> Column:
    name = compose(name)
    if name == "identity":
        return px
    oh, ow = oriented_shape(name, h, w)

    def source(i, j):
        row, col = _source(name, i, j, h, w)
        return row * w + col

    return pick(px, oh, ow, source)


def reorient(px: Column, given: str, wanted: str, h: int, w: int) -> Column:
    """Orientation `given` to `wanted`; a change that would swap unequal sides leaves the frame as it is."""
    name = between(given, wanted)
    return px if oriented_shape(name, h, w) != (h, w) else orient(px, name, h, w)


def crop(px: Column, w: int, y0: int, y1: int, x0: int, x1: int) -> Column:
    """Rows y0 to y1 - 1 and columns x0 to x1 - 1."""
    rows = F.sequence(F.lit(y0), F.lit(y1 - 1))
    return bound(px, lambda p: F.flatten(F.transform(rows, lambda r: F.slice(p, r * w + (x0 + 1), F.lit(x1 - x0)))))


def inner_crop_margin(h: int, w: int, configured: int | None = None, probed: int | None = None) -> int:
    """The configured margin, else the probed one, else a quarter of the shorter side; 0 if nothing would be left."""
    c = configured if configured is not None else probed if probed is not None else min(h, w) // 4
    return 0 if 2 * c >= min(h, w) else c


def inner_crop(px: Column, h: int, w: int, c: int) -> Column:
    return px if c <= 0 or 2 * c >= min(h, w) else crop(px, w, c, h - c, c, w - c)


def fftshift(px: Column, h: int, w: int) -> Column:
    """Moves the centre of even-sized frames to the corner and back."""
    return pick(px, h, w, lambda i, j: ((i + h // 2) % h) * w + (j + w // 2) % w)


def upsample(px: Column, h: int, w: int, s: int) -> Column:
    """Each pixel becomes s x s equal ones."""
    return pick(px, h * s, w * s, lambda i, j: (i / s).cast("int") * w + (j / s).cast("int"))


def bin_mean(px: Column, h: int, w: int, s: int) -> Column:
    """Means of s x s pixels; what does not fill a block at the far sides goes."""
    cells = [(a, b) for a in range(s) for b in range(s)]

    def mean(p, k):
        i, j = (k / (w // s)).cast("int"), k % (w // s)
        total = sum((F.get(p, (i * s + a) * w + (j * s + b)) for a, b in cells[1:]), F.get(p, i * s * w + j * s))
        return total / float(s * s)

    return bound(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit((h // s) * (w // s) - 1)), lambda k: mean(p, k)))


def pad_centre(px: Column, h: int, w: int, oh: int, ow: int) -> Column:
    """Centres a frame in one of oh x ow pixels: nulls around it, or its sides cut."""
    top, left = (oh - h) // 2, (ow - w) // 2

    def read(p, k):
        i, j = (k / ow).cast("int") - top, k % ow - left
        return F.when((i >= 0) & (i < h) & (j >= 0) & (j < w), F.get(p, i * w + j))

    return bound(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(oh * ow - 1)), lambda k: read(p, k)))


# ---------------------------------------------------------------- pixel rules
def saturated_to_zero(px: Column, top: int) -> Column:
    """The largest number of the detector's type marks saturation."""
    return F.transform(px, lambda v: F.when(v == top, F.lit(0).cast("bigint")).otherwise(v))


def hot_to_zero(px: Column, threshold: float | None, inclusive: bool = False) -> Column:
    if threshold is None:
        return px
    return F.transform(px, lambda v: F.when(v >= threshold if inclusive else v > threshold, F.lit(0).cast("bigint")).otherwise(v))


def floor_to_zero(px: Column, threshold: float) -> Column:
    return px if threshold <= 0 else F.transform(px, lambda v: F.when(v < threshold, F.lit(0).cast("bigint")).otherwise(v))


def inpaint(px: Column, h: int, w: int, bad: list[int]) -> Column:
    """Replaces bad pixels by the median of the pixels around and at them, of an even number the lower one."""

    def median(p: Column, k: int) -> Column:
        i, j = divmod(k, w)
        near = [F.get(p, F.lit(a * w + b)) for a in range(max(0, i - 1), min(h, i + 2)) for b in range(max(0, j - 1), min(w, j + 2))]
        return F.get(F.sort_array(F.array(*near)), F.lit((len(near) - 1) // 2))

    if not bad:
        return px

    def fixed(p):
        values = F.create_map(*[x for k in bad for x in (F.lit(k), median(p, k))])
        return F.get(F.transform(F.array(values), lambda m: F.transform(p, lambda v, k: F.coalesce(F.element_at(m, k), v))), F.lit(0))

    return bound(px, fixed)


def amplitude(px: Column, normalization: float = 1e5, scale: float = 1e4) -> Column:
    return F.transform(px, lambda v: F.sqrt(v / F.lit(float(normalization)) * F.lit(float(scale))))


def engine_amplitude(amp: Column, normalization: float = 1e5, scale: float = 1e4) -> Column:
    """From the normalised amplitude back to the root of the counts."""
    return F.transform(amp, lambda v: v * F.lit((normalization / scale) ** 0.5))


def to_uint8(px: Column) -> Column:
    """The root of the counts, at most 255, cut to a whole number."""
    return F.transform(px, lambda v: F.least(F.lit(255.0), F.sqrt(F.greatest(v, F.lit(0)))).cast("int"))


def amp_phase(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)
