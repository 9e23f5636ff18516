"""Exact quantiles of large tables by histograms of 16 bits a round: nothing is sorted and no group meets in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import stored

_SIGN = np.uint64(1 << 63)
#: Bits that a round decides, of the 64 of a number.
BITS = 16


def _to_order(v: np.ndarray) -> np.ndarray:
    """Longs in the order of numbers; the two zeros are one."""
    bits = (v.astype(float) + 0.0).view(np.uint64)
    bits = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    return (bits ^ _SIGN).view(np.int64)


def _from_order(o: np.ndarray) -> np.ndarray:
    bits = o.view(np.uint64) ^ _SIGN
    return np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(float)


def _mapped(df: DataFrame, column: str, out: str, kind: str, f) -> DataFrame:
    rest = [c for c in df.columns if c != column]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = pa.array(f(batch.column(column).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), got], names=[*rest, out])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return df.select(*rest, column).mapInArrow(run, f"{kinds}{out} {kind}")


def _numbers(df: DataFrame, value: str, groups: list) -> DataFrame:
    """The groups and o, a long in the order of the numbers, stored."""
    plain = df.select(*groups, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return stored(_mapped(plain, "_v", "o", "bigint", _to_order), "quantiles")


def exact_table(df: DataFrame, value: str, qs: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, q0, q1, ...: the quantiles of a column, between two values in proportion; nulls and NaNs do not count, keys
    without a number give no row.

    Four rounds: each counts, among the numbers that begin with the bits found so far, those of each next 16 bits, and
    picks the group that holds the wanted rank."""
    names = [f"_g{i}" for i in range(len(keys))]
    rows = _numbers(df, value, [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    place = lambda q: F.col("n").cast("double") * q - q  # noqa: E731  of the quantile among n numbers
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), (F.ceil(place(q)) if up else F.floor(place(q))).alias("rank")) for i, q in enumerate(qs) for up in (False, True)])
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 0")
    want = sizes.select(*names, F.explode(ranks).alias("w")).select(*names, "w.*", F.lit(0).cast("bigint").alias("prefix"))
    for k in range(64 // BITS):
        left = 64 - BITS * (k + 1)
        digit = F.shiftright("o", left) if k == 0 else F.shiftright("o", left).bitwiseAND(F.lit((1 << BITS) - 1))
        some = rows.select(*names, F.lit(0).cast("bigint").alias("prefix") if k == 0 else F.shiftright("o", left + BITS).alias("prefix"), digit.alias("digit"))
        same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*names, "prefix")]
        if k:
            some = some.alias("s").join(want.select(*names, "prefix").distinct().alias("w"), same("s", "w"), "left_semi")
        counts = some.groupBy(*names, "prefix", "digit").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*names, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto)
        found = want.alias("w").join(counts.alias("c"), same("w", "c")).where("w.rank < c.upto AND w.rank >= c.upto - c.c")
        want = found.select(*[F.col(f"w.{n}").alias(n) for n in names], "w.q", "w.up", (F.col("w.rank") - F.col("c.upto") + F.col("c.c")).alias("rank"), (F.shiftleft("w.prefix", BITS) + F.col("c.digit")).alias("prefix"))
    found = _mapped(want.select(*names, "q", "up", "prefix"), "prefix", "v", "double", _from_order)
    out = [F.max(F.when((F.col("q") == i) & (F.col("up") == up), F.col("v"))).alias(f"v{i}{'b' if up else 'a'}") for i in range(len(qs)) for up in (False, True)]
    part = [place(q) - F.floor(place(q)) for q in qs]
    joined = found.groupBy(*names).agg(*out).alias("f").join(sizes.alias("z"), [F.col(f"f.{n}").eqNullSafe(F.col(f"z.{n}")) for n in names] or F.lit(True))
    a, b = (lambda i: F.col(f"v{i}a")), (lambda i: F.col(f"v{i}b"))
    between = [F.when(a(i) == b(i), a(i)).otherwise(a(i) + (b(i) - a(i)) * p).alias(f"q{i}") for i, p in enumerate(part)]
    return joined.select(*[F.col(f"f.{n}").alias(k) for n, k in zip(names, keys, strict=True)], *between)


def exact(df: DataFrame, value: str, qs: tuple[float, ...]) -> tuple[float, ...] | None:
    """The quantiles of a whole column; None where it has no number.

    As exact_table, with the histograms of a round on the driver: 65,536 counts at most for each number that is sought."""
    rows = _numbers(df, value, [])
    n = rows.count()
    if not n:
        return None
    sought = {int(r): (0, int(r)) for q in qs for r in (np.floor(q * (n - 1)), np.ceil(q * (n - 1)))}  # rank: (prefix, rank in it)
    for k in range(64 // BITS):
        left = 64 - BITS * (k + 1)
        digit = F.shiftright("o", left) if k == 0 else F.shiftright("o", left).bitwiseAND(F.lit((1 << BITS) - 1))
        prefix = F.lit(0).cast("bigint") if k == 0 else F.shiftright("o", left + BITS)
        some = rows if k == 0 else rows.where(prefix.isin(*{p for p, _ in sought.values()}))
        counts = some.groupBy(prefix.alias("prefix"), digit.alias("digit")).agg(F.count("*").alias("c")).toArrow()
        of, digits, c = (counts.column(x).to_numpy() for x in ("prefix", "digit", "c"))
        for rank, (p, within) in sought.items():
            at = np.flatnonzero(of == p)
            at = at[np.argsort(digits[at])]
            upto = np.cumsum(c[at])
            i = int(np.searchsorted(upto, within, side="right"))
            sought[rank] = ((p << BITS) + int(digits[at[i]]), within - int(upto[i] - c[at[i]]))
    found = {r: float(_from_order(np.array([p], np.int64))[0]) for r, (p, _) in sought.items()}
    places = [q * (n - 1) for q in qs]
    low, high = ([found[int(f(x))] for x in places] for f in (np.floor, np.ceil))
    return tuple(a if a == b else float(a + (b - a) * (x - np.floor(x))) for a, b, x in zip(low, high, places))
